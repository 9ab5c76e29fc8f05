"""Exact quantiles of groups of any size by selection.

A group's values are counted in bins between its least and greatest value; the bins that hold the ranks asked for are split again,
between the least and greatest value in them, until they hold few values. Only those few are sorted. What a task holds of a group
is its bins, whatever the group's size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import written
from ..functions.missing import finite

BINS = 4096
FEW = 4096  # values of a bin that are sorted


def quantiles(rows: DataFrame, by: list[str], columns: list[str], at: list[float], bins: int = BINS, few: int = FEW) -> DataFrame:
    """by, column and values, an array with the quantile of each of `at` (linear between the two nearest ranks, as F.percentile). Missing
    values do not count; a group's column without a value has no row; null keys are keys like any other; an empty table gives an empty result."""
    keys = [F.col(k).alias(f"k{i}") for i, k in enumerate(by)]
    made = F.array(*(F.struct(F.lit(i).alias("c"), finite(c).alias("v")) for i, c in enumerate(columns)))
    long = rows.select(F.struct(F.lit(0).alias("all"), *keys).alias("key"), F.explode(made).alias("x")).select("key", "x.c", "x.v").where("v IS NOT NULL")
    # groups are known by a hash of their key and the column from here on; the key itself comes back at the end
    long = written(long.select(F.xxhash64(F.to_json("key", {"ignoreNullFields": "false"}), "c").alias("g"), "key", "c", "v"), "quantile-values")
    groups = written(long.groupBy("g").agg(F.first("key").alias("key"), F.first("c").alias("c"), F.count("*").alias("n")), "quantile-groups")
    shares = F.array(*(F.lit(float(q)) for q in at))
    ranks = F.array_distinct(F.flatten(F.transform(shares, lambda q: F.array(F.floor(q * (F.col("n") - 1)), F.ceil(q * (F.col("n") - 1))))))
    # a part: values of a group between lo and hi, `before` of which are less; ranks: those asked for inside
    parts = groups.select("g", F.lit(0).cast("long").alias("part"), F.col("n"), F.lit(0).cast("long").alias("before"), F.sort_array(ranks).alias("ranks"))
    parts = written(parts.join(long.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi")), "g"), "quantile-parts")
    active = long.select("g", F.lit(0).cast("long").alias("part"), "v")
    found = []
    while True:
        found.append(parts.where((F.col("lo") == F.col("hi")) | (F.col("n") <= few)).select("g", "part", "n", "before", "ranks", "lo", "hi"))
        small = active.join(found[-1].where("lo < hi").select("g", "part"), ["g", "part"]).groupBy("g", "part").agg(F.sort_array(F.collect_list("v")).alias("vs"))
        found[-1] = written(found[-1].join(small, ["g", "part"], "left").select("g", "n", "before", "ranks", "lo", "vs"), "quantile-found")
        large = parts.where((F.col("lo") < F.col("hi")) & (F.col("n") > few))
        if large.isEmpty():
            break
        # halves of the range keep it from growing beyond a double's
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        spot = F.least(F.floor(share * bins), F.lit(bins - 1)).cast("long")
        active = written(active.join(large.select("g", "part", "lo", "hi"), ["g", "part"]).select("g", F.xxhash64("part", spot).alias("part"), F.col("part").alias("of"), "v"), "quantile-active")
        sums = active.groupBy("g", "of", "part").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        asked = large.select("g", F.col("part").alias("of"), "before", "ranks")

        def narrow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            """The bins of a part that hold ranks."""
            pdf = pdf.sort_values("lo")
            before = int(pdf["before"].iloc[0]) + np.r_[0, np.cumsum(pdf["n"].to_numpy())[:-1]]
            ranks = np.asarray(pdf["ranks"].iloc[0], np.int64)
            at = np.searchsorted(before, ranks, "right") - 1
            use = np.unique(at)
            out = pdf.iloc[use][["g", "part", "n", "lo", "hi"]].copy()
            out["before"], out["ranks"] = before[use], [ranks[at == k].tolist() for k in use]
            return out[["g", "part", "n", "before", "ranks", "lo", "hi"]]

        parts = written(sums.join(asked, ["g", "of"]).groupBy("g", "of").applyInPandas(narrow, "g long, part long, n long, before long, ranks array<long>, lo double, hi double"), "quantile-parts")
        active = active.select("g", "part", "v").join(parts.select("g", "part"), ["g", "part"], "left_semi")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    value = lambda r: F.coalesce(F.get("vs", (r - F.col("before")).cast("int")), F.col("lo"))
    each = every.select("g", F.map_from_arrays("ranks", F.transform("ranks", value)).alias("m"))
    met = each.groupBy("g").agg(F.flatten(F.collect_list(F.map_entries("m"))).alias("m")).select("g", F.map_from_entries("m").alias("m")).join(groups, "g")
    near = F.transform(shares, lambda q: F.struct((q * (F.col("n") - 1)).alias("p"), F.element_at("m", F.floor(q * (F.col("n") - 1))).alias("low"), F.element_at("m", F.ceil(q * (F.col("n") - 1))).alias("high")))
    between = F.transform(near, lambda x: F.when(x["low"] == x["high"], x["low"]).otherwise(x["low"] * (F.ceil(x["p"]) - x["p"]) + x["high"] * (x["p"] - F.floor(x["p"]))))
    names = F.array(*map(F.lit, columns))
    return met.select(*(F.col(f"key.k{i}").alias(k) for i, k in enumerate(by)), F.get(names, F.col("c")).alias("column"), between.alias("values"))
