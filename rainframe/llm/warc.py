"""WARC archives whose records are compressed one by one with a Zstandard dictionary.

Each task trains a dictionary on the first records that it archives, writes it to the archive's leading skippable
frame, and compresses every record as a frame of its own, so a reader can start at any record. Payloads
seen before become revisit records, which hold no payload, so only a page's key and digest move to find them. Archives go to a folder that all executors reach, under
names that no other attempt uses; only those in the written manifest count, so lost tasks leave no
half archives behind for readers."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh_dir, materialize, send_if_small

SKIPPABLE = 0x184D2A5D  # fixed value: the frame that carries a dictionary in .warc.zst
DICTIONARY = b"\x37\xa4\x30\xec"  # fixed value: how a trained dictionary starts
MANIFEST = "archive string, records bigint, bytes bigint, dictionary_bytes bigint"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes | None, n_bytes: int, digest: str, revisits: int | None) -> bytes:
    """One WARC/1.1 record, a revisit where payload is None. A revisit holds no payload; X-Payload-Length keeps the full one's
    length. Line ends in a URL are written as %0D and %0A, and X-Target-URI then keeps the URL itself."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = [("WARC-Type", "revisit" if payload is None else "response"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        plain = url.replace("\r", "%0D").replace("\n", "%0A")
        head.append(("WARC-Target-URI", plain))
        if plain != url:
            head.append(("X-Target-URI", base64.b64encode(url.encode("utf-8", "surrogatepass")).decode()))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(n_bytes))]
    if payload is None:
        head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", name(revisits))]
    block = HTTP + (payload or b"")
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def train(sample: list[bytes], size: int) -> bytes | None:
    """A dictionary, or None where the sample is too small for one."""
    try:
        return zstandard.train_dictionary(size, sample).as_bytes() if len(sample) >= 8 else None
    except zstandard.ZstdError:
        return None


class Writer:
    """Archives of at most about max_bytes. The sample that trains the dictionary is bounded in bytes."""

    def __init__(self, folder: str, size: int, sample_bytes: int, max_bytes: int, level: int):
        self.fs, self.path = fs.FileSystem.from_uri(folder)
        self.folder, self.size, self.sample_bytes, self.max_bytes, self.level = folder, size, sample_bytes, max_bytes, level
        self.fs.create_dir(self.path, recursive=True)
        self.waiting: list[bytes] = []
        self.held = 0
        self.out = None

    def add(self, raw: bytes) -> Iterator[tuple]:
        if self.out is None:
            self.waiting.append(raw)
            self.held += len(raw)
            if self.held >= self.sample_bytes:
                self._open()
        else:
            self._put(raw)
        if self.out is not None and self.bytes >= self.max_bytes:
            yield self.close()

    def _open(self) -> None:
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.out = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None)
        book = train(self.waiting, self.size)
        self.records = self.bytes = 0
        self.book_bytes = len(book or b"")
        kind = {"dict_data": zstandard.ZstdCompressionDict(book)} if book else {}
        self.squeeze = zstandard.ZstdCompressor(level=self.level, write_checksum=True, write_content_size=True, **kind)
        if book:
            packed = zstandard.ZstdCompressor(level=19).compress(book)
            self.out.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
            self.bytes += 8 + len(packed)
        held, self.waiting, self.held = self.waiting, [], 0
        for raw in held:
            self._put(raw)

    def _put(self, raw: bytes) -> None:
        frame = self.squeeze.compress(raw)
        self.out.write(frame)
        self.records += 1
        self.bytes += len(frame)

    def close(self) -> tuple:
        if self.out is None:
            self._open()
        self.out.close()
        self.out = None
        return f"{self.folder}/{self.name}", self.records, self.bytes, self.book_bytes


def read_records(uri: str, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one after the other; never more than one and a chunk in memory."""
    where, path = fs.FileSystem.from_uri(uri)
    with where.open_input_stream(path, compression=None) as f:
        rest = f.read(chunk)
        kind = {}
        if rest[:4] == struct.pack("<I", SKIPPABLE):
            n = 8 + struct.unpack("<I", rest[4:8])[0]
            while len(rest) < n:
                rest += f.read(n - len(rest))
            book, rest = rest[8:n], rest[n:]
            if book[:4] != DICTIONARY:
                book = zstandard.ZstdDecompressor().decompress(book)
            kind = {"dict_data": zstandard.ZstdCompressionDict(book)}
        grow = zstandard.ZstdDecompressor(**kind)
        while rest := rest or f.read(chunk):
            one, raw = grow.decompressobj(), []
            while not one.eof:
                if not rest and not (rest := f.read(chunk)):
                    raise EOFError(f"{uri} ends within a record")
                raw.append(one.decompress(rest))
                rest = one.unused_data if one.eof else b""
            yield b"".join(raw)


def plan_records(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, payload, n_bytes, digest (hexadecimal) and first_id; payload is null in revisits.

    Null html is an empty payload; a null id counts as larger than any other; of rows alike in id and payload the first by url is
    the response; equal rows are a record each; other columns are ignored. Keys and digests are
    counted, a hot payload or row in parts; pages meet the digests that occur more than once, which are sent to them where the
    longest URL bounds them well enough, so no payload moves but those of responses that are equal rows."""
    payload = F.encode(F.coalesce(html_col, F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.length(payload).cast("long").alias("n_bytes"), F.sha1(payload).alias("digest"))
    key = F.struct(F.col("id").isNull().alias("none"), "id", F.col("url").isNull().alias("bare"), "url")
    counted = rows.where(F.col("n_bytes") >= least_bytes).groupBy("digest", "n_bytes", key.alias("key")).agg(F.count("*").alias("copies"))
    counted = materialize(counted, "warc-counts")
    least = counted.groupBy("digest").agg(F.min(F.struct("key", "copies")).alias("least"), F.sum("copies").alias("all")).where("all > 1")
    heads = materialize(least.select("digest", F.col("least.key").alias("head"), (F.col("least.copies") > 1).alias("twins")), "warc-heads")
    longest = heads.agg(F.max(F.octet_length("head.url"))).first()[0] or 0
    marked = rows.join(send_if_small(heads, 120 + longest), "digest", "left").withColumn("is_head", key.eqNullSafe(F.col("head")))
    marked = marked.withColumn("first_id", F.lit(None).cast(pages.schema[id_col].dataType))
    columns = ["id", "url", "payload", "n_bytes", "digest", "first_id"]
    out = marked.where("head is null or (is_head and not twins)").select(columns)
    if not heads.where("twins").isEmpty():  # responses that are equal rows: one of each
        out = out.unionByName(marked.where("is_head and twins").groupBy("digest").agg(*(F.first(c).alias(c) for c in columns if c != "digest")).select(columns))
    again = counted.join(heads, "digest").withColumn("left", F.col("copies") - F.col("key").eqNullSafe(F.col("head")).cast("int")).where("left > 0")
    again = again.select("digest", "n_bytes", F.col("key.id").alias("id"), F.col("key.url").alias("url"), F.col("head.id").alias("first_id"), F.explode(F.sequence(F.lit(1).cast("long"), "left")).alias("turn"))
    return out.unionByName(again.withColumn("payload", F.lit(None).cast("binary")).select(columns))


def write_archives(records: DataFrame, folder: str, dict_bytes: int = 64 << 10, sample_bytes: int = 4 << 20, max_bytes: int = 256 << 20, level: int = 3) -> DataFrame:
    """Writes the records of plan_records; the manifest: archive, records, bytes, dictionary_bytes. Records without a payload are
    revisits; null ids and URLs are left out of a record's head; equal rows are a record each; of an empty table nothing is
    written. A task that runs again writes archives of other names, of which the manifest has one set."""

    def write(batches):
        to = Writer(folder, dict_bytes, sample_bytes, max_bytes, level)
        done = []
        for b in batches:
            for i, url, payload, n, digest, first in zip(*(b.column(c).to_pylist() for c in ("id", "url", "payload", "n_bytes", "digest", "first_id"))):
                stated = payload_digest(payload) if payload is not None else base64.b32encode(bytes.fromhex(digest)).decode()
                done += to.add(record(i, url, payload, n, stated, first))
        if to.out is not None or to.waiting:
            done.append(to.close())
        cols = list(zip(*done)) if done else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["archive", "records", "bytes", "dictionary_bytes"])

    return materialize(records.mapInArrow(write, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, rows: int = 1000) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to and payload (null for revisits) of every record.
    The length and digest of a response are taken from the payload that was read; one that differs from the record's is an
    error. Ids are whole numbers, null where a record has none; so are missing URLs; an empty manifest gives no row."""

    def number(uri: str | None) -> int | None:
        return int(uri[len("<urn:page:") : -1]) if uri and uri != "<urn:page:>" else None

    def read(batches):
        for b in batches:
            for uri in b.column("archive").to_pylist():
                out: list[tuple] = []
                size = 0
                for raw in read_records(uri):
                    head, payload = parse(raw)
                    kind, stated = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and payload_digest(payload) != stated:
                        raise ValueError(f"{uri}: the payload of {head['WARC-Record-ID']} is damaged")
                    url = base64.b64decode(head["X-Target-URI"]).decode("utf-8", "surrogatepass") if "X-Target-URI" in head else head.get("WARC-Target-URI")
                    out.append((number(head["WARC-Record-ID"]), url, kind, int(head["X-Payload-Length"]) if kind == "revisit" else len(payload), stated, number(head.get("WARC-Refers-To")), payload if kind == "response" else None))
                    size += len(payload)
                    if len(out) >= rows or size >= 16 << 20:
                        yield batch(out)
                        out, size = [], 0
                if out:
                    yield batch(out)

    def batch(out):
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])

    n = max(1, manifest.count())
    spread = manifest.repartition(min(n, 4096)) if n > 1 else manifest
    return spread.mapInArrow(read, "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archives all pages, reads the archives back and returns a row per record.

    Null html is an empty payload; a null id counts as larger than any other and is null again when read; of
    rows alike in id and payload one is the response (the first by url) and the others revisit it; an empty table
    gives no archive and no row; other columns are ignored."""
    manifest = write_archives(plan_records(pages, least_bytes), fresh_dir(pages.sparkSession, "warc"))
    return read_archives(manifest)


def digests(pages: DataFrame) -> DataFrame:
    return round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
