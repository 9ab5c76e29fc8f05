"""Sharding by a k-d tree over document metadata, in DataFrame functions.

Every node splits at the weighted median of the dimension along which its documents are widest, weights being
bytes, until leaves hold the target bytes. A dimension's values fall into bins, so medians come from
counts of bytes by node, dimension and bin: a few thousand rows at most for any number of documents.
Rows of the bin that holds the median are told apart by a hash, first by its leading and then
by its following bits, so that a value shared by a third of all rows is split too. Rows meet their node's cut in a join, so a level is the
same plan for any number of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, send_if_small

BITS = 12
BINS = 1 << BITS


def dimensions() -> dict[str, Column]:
    """Metadata as bins in 0..BINS-1; nulls are in bin 0. Languages and sources have no order: they are placed by hash."""
    place = lambda c: F.when(F.col(c).isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(BINS - 1)))
    return {"size": F.least(F.lit(BINS - 1), F.floor(F.log2("size") * 96)).cast("int"), "source": place("source").cast("int"), "lang": place("lang").cast("int")}


def _cut(sums: DataFrame, half: Column, by: list[str]) -> DataFrame:
    """by, bin and before: of each group the first bin whose bytes, with all before, reach half; and the bytes before it."""
    w = Window.partitionBy(*by).orderBy("bin")
    cum = sums.withColumn("upto", F.sum("bytes").over(w)).withColumn("all", F.sum("bytes").over(Window.partitionBy(*by)))
    first = cum.where(F.col("upto") >= half).groupBy(*by).agg(F.min(F.struct("bin", (F.col("upto") - F.col("bytes")).alias("before"), "all")).alias("x"))
    return first.select(*by, "x.bin", "x.before", "x.all")


def _hash(i: int) -> Column:
    return F.shiftrightunsigned("tie", 64 - BITS * (i + 1)).bitwiseAND(BINS - 1).cast("int")


def split(rows: DataFrame, dims: list[str]) -> DataFrame:
    """node, dim (a place in dims), bin, h0, h1 for every node of rows (node, size, tie, dims): a document goes right if its
    (bin, hash, hash 2) is beyond."""
    each = rows.select("node", "size", F.posexplode(F.array(*dims)).alias("dim", "bin"))
    sums = materialize(each.groupBy("node", "dim", "bin").agg(F.sum("size").alias("bytes")), "kd-sums")
    # width: the deviation of the bins, by bytes, so that a few far values do not make a dimension wide
    wide = sums.groupBy("node", "dim").agg((F.sum(F.col("bytes").cast("double") * F.col("bin") * F.col("bin")) / F.sum("bytes") - F.pow(F.sum(F.col("bytes").cast("double") * F.col("bin")) / F.sum("bytes"), F.lit(2.0))).alias("var"))
    best = wide.groupBy("node").agg(F.max(F.struct("var", (-F.col("dim")).alias("back"))).alias("b")).select("node", (-F.col("b.back")).alias("dim"))
    cuts = _cut(sums.join(best, ["node", "dim"]), F.col("all") / 2, ["node", "dim"])
    cuts = cuts.select("node", "dim", F.col("bin").alias("cut"), (F.col("all") / 2 - F.col("before")).alias("half"))
    for i in range(2):
        cuts = send_if_small(materialize(cuts, "kd-cuts"), row_bytes=60)
        tied = rows.join(cuts, "node").where(F.element_at(F.array(*dims), F.col("dim") + 1) == F.col("cut"))
        if i:
            tied = tied.where(F.col("h0") == _hash(0))
        within = _cut(tied.groupBy("node", "half", _hash(i).alias("bin")).agg(F.sum("size").alias("bytes")), F.least(F.col("half"), F.col("all")), ["node", "half"])
        within = within.select("node", F.col("bin").alias(f"h{i}"), (F.col("half") - F.col("before")).alias("now"))
        cuts = cuts.drop("half").join(within, "node").withColumnRenamed("now", "half")
    return materialize(cuts.drop("half"), "kd-cuts")


def kd_tree(docs: DataFrame, leaves: int | None = 8, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, crc, tie (a hash) and shard (0..) of every row. leaves: a power of two; or as many as bring leaves to target_bytes.

    Sizes are the texts' UTF-8 bytes plus 1; null texts count as empty. Shards differ by about the bytes of one document:
    ties are broken by a hash of id, size and checksum, and of the row itself, so repeated rows split too. Missing
    lang or source columns count as null; other columns are ignored; an empty table gives an empty result."""
    utf8 = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    more = [F.col(c).alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]
    flat = docs.select(F.col(id_col).alias("id"), (F.octet_length(utf8) + 1).cast("long").alias("size"), F.crc32(utf8).alias("crc"), *more)
    dims = dimensions()
    flat = flat.withColumn("tie", F.xxhash64("id", "size", "crc", F.monotonically_increasing_id()))
    rows = materialize(flat.select("id", "size", "crc", "tie", *(c.alias(f"d_{k}") for k, c in dims.items())), "kd-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    levels = 0
    while (1 << levels) < (leaves or 1) if target_bytes is None else (total >> levels) > target_bytes:
        levels += 1
    names = [f"d_{k}" for k in dims]
    rows = rows.withColumn("node", F.lit(0).cast("long"))
    for _ in range(levels if total else 0):
        cuts = send_if_small(split(rows, names), row_bytes=60)
        beyond = F.struct(F.element_at(F.array(*names), F.col("dim") + 1), _hash(0), _hash(1)) > F.struct("cut", "h0", "h1")
        rows = rows.join(cuts, "node").select("id", "size", "crc", "tie", *names, (2 * F.col("node") + beyond.cast("long")).alias("node"))
        rows = materialize(rows, "kd-level")
    return rows.select("id", "size", "crc", "tie", F.col("node").cast("int").alias("shard"))


def slots(rows: DataFrame, per_block: int = 20_000) -> DataFrame:
    """rows (id, size, crc, tie, shard) with slot in place of tie, gapless from 0 in each shard: counted in blocks of a shard's rows, by
    their tie, so that repeated rows spread; then offset by the blocks before, so that no shard is sorted in one task. An empty table stays empty."""
    n = rows.count()
    blocks = max(1, n // per_block)
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("tie", F.lit(7)), F.lit(blocks)))
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offset = rows.groupBy("shard", "_b").agg(F.count("*").alias("c")).select("shard", "_b", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_before"))
    turn = F.row_number().over(Window.partitionBy("shard", "_b").orderBy("id", "size", "crc", "tie"))
    return rows.withColumn("_turn", turn).join(offset, ["shard", "_b"]).withColumn("slot", (F.col("_before") + F.col("_turn") - 1).cast("long")).drop("_b", "_turn", "_before", "tie")


def digests(docs: DataFrame) -> DataFrame:
    placed = slots(kd_tree(docs, 8))
    return placed.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
