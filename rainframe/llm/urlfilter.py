"""URL filters: a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

A rule is listed under its canonical URL, host and path prefix in one string (`com/en/`). A page's URL asks
for the suffixes of its host with as many labels as some rule's host has, with every prefix of its path whose length some
rule has; hosts of many labels ask for no more than others. The filter,
256 bits a block and eight of them set for each rule in one block, lets through what may be listed; the
join on the canonical URL removes what isn't, and the longest rule that is left decides."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, PROBES = 4, 2  # longs in a block, bits set in each


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lowered; path: from there up to ? # or the end."""
    there = F.instr(url, "://") > 0
    rest = F.expr("substring(_url, instr(_url, '://') + 3)")
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(there, low).otherwise(""), F.when(there, path).otherwise("")


def _bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key, and the mask of each long in it."""
    more = F.xxhash64(key, F.lit("bits"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(more, 6 * i).bitwiseAND(63).cast("int"))
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("long"), [bit(PROBES * w).bitwiseOR(bit(PROBES * w + 1)) for w in range(WORDS)]


def build_filter(keys: DataFrame, key: str, n: int, bits_per_key: int = 16) -> tuple[DataFrame, int]:
    """(block, w0..w3) of the blocks that keys set, and the number of blocks."""
    blocks = max(1, math.ceil(n * bits_per_key / (64 * WORDS)))
    block, masks = _bits(F.col(key), blocks)
    made = keys.select(block.alias("block"), *(m.alias(f"w{i}") for i, m in enumerate(masks)))
    return made.groupBy("block").agg(*(F.expr(f"bit_or(w{i})").alias(f"w{i}") for i in range(WORDS))), blocks


def _pass_local(asked: DataFrame, filt: DataFrame, blocks: int) -> DataFrame:
    """asked (.., keys) with the keys that the filter lets through, tested in the tasks against the whole filter."""
    rows = filt.toPandas()
    bits = np.zeros((blocks, WORDS), np.int64)
    bits[rows["block"].to_numpy()] = rows[[f"w{i}" for i in range(WORDS)]].to_numpy()
    sent = asked.sparkSession.sparkContext.broadcast(bits)
    block, masks = _bits(F.col("k"), blocks)
    tested = asked.select("*", F.transform("keys", lambda k: F.struct(*(x.alias(n) for n, x in zip(("b", *(f"m{i}" for i in range(WORDS))), [F.pmod(F.xxhash64(k), F.lit(blocks)).cast("long"), *_bits(k, blocks)[1]])))).alias("probe"))

    def probe(batches):
        table = sent.value
        for b in batches:
            keys, probes = b.column("keys"), b.column("probe").flatten()
            at = probes.field("b").to_numpy(zero_copy_only=False)
            ok = np.ones(len(at), bool)
            for i in range(WORDS):
                m = probes.field(f"m{i}").to_numpy(zero_copy_only=False)
                ok &= table[at, i] & m == m
            sums = np.concatenate([[0], np.cumsum(ok)])
            ends = np.concatenate([[0], np.cumsum(keys.value_lengths().to_numpy(zero_copy_only=False))])
            kept = pa.ListArray.from_arrays(pa.array(sums[ends], pa.int32()), keys.flatten().filter(pa.array(ok)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c not in ("keys", "probe")), kept], [*(c for c in b.schema.names if c not in ("keys", "probe")), "keys"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema if f.name != "keys"]
    return tested.mapInArrow(probe, ", ".join([*kept, "keys array<string>"]))


def _pass_joined(asked: DataFrame, filt: DataFrame, blocks: int) -> DataFrame:
    """The same by a join on the block, for a filter too large to send."""
    rest = [c for c in asked.columns if c != "keys"]
    block, masks = _bits(F.col("key"), blocks)
    each = asked.select(*rest, F.explode("keys").alias("key")).select("*", block.alias("block"), *(m.alias(f"m{i}") for i, m in enumerate(masks)))
    hit = each.join(filt, "block").where(" and ".join(f"w{i} & m{i} = m{i}" for i in range(WORDS)))
    return hit.select(*rest, F.array("key").alias("keys"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", most_sent: int = 64 << 20, url_col: str = "url") -> DataFrame:
    """pages' columns with host, path, rule and verdict in place of columns of those names.

    rules: host, path, verdict (null hosts or paths count as empty; of rules alike in both, block wins). A rule fits its
    host and all subdomains where the URL's path starts with its path; the longest in characters wins, then
    the one with the longer host. Null URLs and those without :// have neither host nor path. Repeated rows are
    judged alike; no rules, all are `default`. A filter of over most_sent bytes is joined, not sent."""
    # pages' own columns stay apart in one struct: no name of theirs can clash with one in here
    host, path = host_and_path(F.col("_url"))
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    asked = pages.select(F.struct(*(pages[f"`{c}`"] for c in own)).alias("own"), pages[f"`{url_col}`"].alias("_url")).select("own", host.alias("host"), path.alias("path"))
    back = [F.col("own").getField(c).alias(c) for c in own]

    rules = rules.select(F.coalesce("host", F.lit("")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    listed = rules.withColumn("rule", F.concat("rule_host", "rule_path")).groupBy("rule").agg(F.max_by(F.struct("rule_verdict", F.length("rule_host").alias("len")), F.struct(F.length("rule_host"), "rule_verdict")).alias("x"))
    listed = listed.select("rule", "x.rule_verdict", F.col("x.len").alias("host_len"))
    n, lengths, depths = rules.agg(F.count("*"), F.collect_set(F.length("rule_path")), F.collect_set(F.size(F.split("rule_host", r"\.")))).first()
    if not n:
        return asked.select(*back, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    tails = F.filter(F.array(*(F.substring_index(F.concat(F.lit("."), "host"), ".", -k) for k in sorted(depths))), lambda t: (F.length(t) < F.length("host")) | (t == F.col("host")))
    heads = F.transform(F.filter(F.array(*map(F.lit, sorted(lengths))), lambda k: k <= F.length("path")), lambda k: F.substring("path", F.lit(1), k))
    keys = F.array_distinct(F.flatten(F.transform(tails, lambda t: F.transform(heads, lambda h: F.concat(t, h)))))
    urls = asked.select("host", "path").distinct().withColumn("keys", keys)
    filt, blocks = build_filter(listed, "rule", n)
    passed = (_pass_local if blocks * WORDS * 8 <= most_sent else _pass_joined)(urls, filt, blocks)
    hits = passed.select("host", "path", F.explode("keys").alias("rule")).join(listed, "rule")
    # a key made from another cut of host and path than the rule's is not the rule
    hits = hits.where((F.expr("right(host, host_len)") == F.expr("left(rule, host_len)")) & ((F.length("host") == F.col("host_len")) | (F.expr("substring(host, length(host) - host_len, 1)") == ".")))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.length("rule"), "host_len")).alias("x")).select("host", "path", "x.*")
    return asked.join(best, ["host", "path"], "left").select(*back, "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"))
