import base64
import hashlib
import struct

import pytest

from rainframe.llm import warc

PAGE = "page_id long, url string, html string, digest string, id int"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://a.example/{i % 40}", f"<html><p>page {i % 50} of a site that says much the same on each page</p>{'x' * (i % 7)}\r\n\r\n</html>") for i in range(300)]
    rows += [(900, None, None), (901, "u", ""), (902, "nl\r\nEvil: 1", "é" * 70000), (None, "u", "null id"), (None, "u", "<html>shared</html>"), (903, "u", "<html>shared</html>"), rows[4], rows[4], (4, "http://a", rows[4][2])]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], PAGE).repartition(3).cache()


def brute(rows, least):
    seen, out = {}, []
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        payload = (html or "").encode()
        again = len(payload) >= least and payload in seen
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response", seen[payload] if again else None))
        seen.setdefault(payload, i)
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 60])
def test_round_trip(pages, least):
    got = warc.round_trip(pages, least).collect()
    rows = [tuple(r)[:3] for r in pages.collect()]
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(rows, least)
    html = {(r[0], (r[2] or "").encode()) for r in rows}
    assert all((r.page_id, bytes(r.payload)) in html for r in got if r.record_type == "response")
    assert sorted(((r.page_id, r.url) for r in got), key=str) == sorted((r[:2] for r in rows), key=str)


def test_one_row_repeated_in_a_third_of_all(spark):
    rows = [(None, None, None, "clash", 1)] * 400 + [(i, f"u{i}", f"<p>{i}</p>", "clash", 1) for i in range(800)]
    got = warc.round_trip(spark.createDataFrame(rows, PAGE).repartition(5)).collect()
    assert len(got) == 1200 and sum(r.record_type == "revisit" for r in got) == 399
    assert {r.refers_to for r in got} == {None}


def test_dictionary_leads_the_archive_and_records_stand_alone(pages, tmp_path):
    import zstandard

    manifest = warc.write_archives(warc.plan_records(pages.limit(290)), f"file://{tmp_path}/w", dict_bytes=4096, sample_bytes=20_000, max_bytes=30_000).collect()
    assert sum(m.records for m in manifest) == 290 and any(m.dictionary_bytes for m in manifest)
    for m in manifest:
        raw = open(m.archive.removeprefix("file://"), "rb").read()
        assert len(raw) == m.bytes
        if m.dictionary_bytes:
            magic, n = struct.unpack("<II", raw[:8])
            assert magic == warc.SKIPPABLE
            book = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw[8 : 8 + n]))
            one = zstandard.ZstdDecompressor(dict_data=book).decompressobj()
            assert one.decompress(raw[8 + n :]).startswith(b"WARC/1.1\r\n") and one.unused_data
        for chunk in (1 << 20, 13):
            assert len(list(warc.read_records(m.archive, chunk))) == m.records


def test_empty_table(spark):
    assert warc.digests(spark.createDataFrame([], PAGE)).count() == 0


def test_no_payload_is_shuffled_for_its_digest(pages):
    rows = pages.where("page_id < 300").dropDuplicates(["page_id"])
    plan = warc.plan_records(rows)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning(digest" not in plan
