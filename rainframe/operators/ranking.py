"""Multi-criteria ranking of products by a table of metrics.

A metric table (product, one column per metric) is unpivoted once to (product, metric, value); normalisation, weights
and methods are then windows and sums by metric or product, for any number of either."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import finite, isclose, paired, require
from .select import numeric_columns
from .windows import average_rank

#: Words for the two directions: fixed values.
BENEFIT, COST = ("benefit", "max", "higher", "higher_is_better", "desc"), ("cost", "min", "lower", "lower_is_better", "asc")


def directions(given: dict[str, str]) -> dict[str, str]:
    out = {}
    for metric, word in given.items():
        low = str(word).strip().lower()
        if low not in BENEFIT + COST:
            raise ValueError(f"direction of {metric}: {word!r} is neither benefit nor cost")
        out[metric] = "benefit" if low in BENEFIT else "cost"
    return out


def metric_names(table: DataFrame, product: str = "product", metrics: Iterable[str] | None = None) -> list[str]:
    """The metrics named, or all numeric columns but the product."""
    names = list(metrics) if metrics is not None else numeric_columns(table, [product])
    require(table, product, *names)
    return names


def long_table(table: DataFrame, ways: dict[str, str], product: str = "product") -> DataFrame:
    """product, metric, value, benefit. Text that holds no number is NULL."""
    ways = directions(ways)
    require(table, product, *ways)
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), finite(F.col(m).try_cast("double")).alias("value"), F.lit(w == "benefit").alias("benefit")) for m, w in ways.items())))
    return table.select(F.col(product).alias("product"), each.alias("x")).select("product", "x.*")


def normalised(long: DataFrame, method: str = "minmax") -> DataFrame:
    """long with z, larger for better. minmax: 0 to 1 over the metric, 1 for all, missing ones too, where it is constant; vector:
    value over the metric's length, costs turned by subtraction from the greatest."""
    w = Window.partitionBy("metric")
    v = F.col("value")
    if method == "minmax":
        low, high = F.min(v).over(w), F.max(v).over(w)
        scaled = F.when(F.col("benefit"), v - low).otherwise(high - v) / F.nullif(high - low, F.lit(0.0))
        return long.withColumn("z", F.when(isclose(high, low), F.lit(1.0)).otherwise(scaled))
    if method == "vector":
        long = long.withColumn("z", v / F.nullif(F.sqrt(F.sum(v * v).over(w)), F.lit(0.0)))
        return long.withColumn("z", F.when(F.col("benefit"), F.col("z")).otherwise(F.max("z").over(w) - F.col("z")))
    raise ValueError(f"unknown normalisation {method!r}: minmax or vector")


def _shares(scored: DataFrame) -> DataFrame:
    """metric and weight in proportion to score; equal where no score is positive."""
    every = Window.partitionBy(F.lit(0))
    total = F.sum("score").over(every)
    return scored.select("metric", F.when(total > 0, F.col("score") / total).otherwise(1.0 / F.count("*").over(every)).alias("weight"))


def equal_weights(long: DataFrame) -> DataFrame:
    return _shares(long.select("metric", F.lit(1.0).alias("score")).distinct())


def entropy_weights(long: DataFrame, eps: float = 1e-12) -> DataFrame:
    """A metric weighs by how unevenly its normalised values are spread over products."""
    rows = normalised(long).withColumn("z", F.coalesce("z", F.lit(0.0)))
    w = Window.partitionBy("metric")
    n, total = F.count("*").over(w), F.sum("z").over(w)
    p = F.when(total > 0, F.col("z") / F.nullif(total, F.lit(0.0))).otherwise(1.0 / n)
    parts = rows.select("metric", p.alias("p"), n.alias("n"))
    made = parts.groupBy("metric").agg((1 + F.sum(F.col("p") * F.ln(F.col("p") + eps)) / F.ln(F.greatest(F.max("n"), F.lit(2)))).alias("score"))
    return _shares(made)


def critic_weights(long: DataFrame) -> DataFrame:
    """A metric weighs by its deviation times what it does not share with the others by correlation. An undefined correlation,
    that of a constant metric with itself too, counts as none."""
    z = normalised(long).select("product", "metric", "z")
    spread = z.groupBy("metric").agg(F.coalesce(F.stddev_samp("z"), F.lit(0.0)).alias("sd"))
    a, b = z.alias("a"), z.withColumnsRenamed({"metric": "other", "z": "y"}).alias("b")
    x, y = paired(F.col("z"), F.col("y"))
    dev = F.stddev_samp(x) * F.stddev_samp(y)
    r = F.coalesce(F.when(dev > 1e-300, F.covar_samp(x, y) / F.nullif(dev, F.lit(0.0))), F.lit(0.0))
    free = a.join(b, "product").groupBy("metric", "other").agg((1 - r).alias("free")).groupBy("metric").agg(F.sum("free").alias("free"))
    return _shares(spread.join(free, "metric").select("metric", (F.col("sd") * F.col("free")).alias("score")))


WEIGHTS = {"equal": equal_weights, "entropy": entropy_weights, "critic": critic_weights}


def weights_table(spark, given: dict[str, float]) -> DataFrame:
    """metric and weight from a dict."""
    return spark.createDataFrame([(k, float(v)) for k, v in given.items()], "metric string, weight double")


def _weighted(long: DataFrame, weights: DataFrame | None) -> DataFrame:
    """long with weights that sum to 1; metrics without one weigh nothing; without any positive sum all weigh the same."""
    if weights is None:
        return long.join(equal_weights(long), "metric")
    known = long.select("metric").distinct().join(weights, "metric", "left").select("metric", F.coalesce("weight", F.lit(0.0)).alias("score"))
    return long.join(_shares(known), "metric")


def metric_ranks(long: DataFrame) -> DataFrame:
    """long with rank: 1 for the best value of the metric, ties sharing their mean place."""
    v = F.when(F.col("benefit"), -F.col("value")).otherwise(F.col("value"))
    return long.withColumn("rank", average_rank(v, ["metric"]))


def _ranked(scored: DataFrame, ascending: bool) -> DataFrame:
    return scored.withColumn("rank", average_rank(F.col("score"), [F.lit(0)], ascending)).select("product", "score", "rank")


def average_rank_method(long: DataFrame) -> DataFrame:
    """Mean of a product's ranks; the least is best."""
    return _ranked(metric_ranks(long).groupBy("product").agg(F.avg("rank").alias("score")), True)


def borda(long: DataFrame) -> DataFrame:
    """A rank r of n products earns n + 1 - r points, a missing one none; the most is best."""
    rows = metric_ranks(long).withColumn("n", F.count("*").over(Window.partitionBy("metric")))
    return _ranked(rows.groupBy("product").agg(F.sum(F.coalesce(F.col("n") + 1 - F.col("rank"), F.lit(0.0))).alias("score")), False)


def weighted_sum(long: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    rows = _weighted(normalised(long), weights)
    return _ranked(rows.groupBy("product").agg(F.sum(F.coalesce("z", F.lit(0.0)) * F.col("weight")).alias("score")), False)


def topsis(long: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Nearness to the ideal product against that to its opposite; missing values take no part in distances."""
    w = Window.partitionBy("metric")
    rows = _weighted(long, weights)
    length = F.coalesce(F.nullif(F.sqrt(F.sum(F.col("value") * F.col("value")).over(w)), F.lit(0.0)), F.lit(1.0))
    rows = rows.withColumn("v", F.col("value") / length * F.col("weight"))
    best = F.when(F.col("benefit"), F.max("v").over(w)).otherwise(F.min("v").over(w))
    worst = F.when(F.col("benefit"), F.min("v").over(w)).otherwise(F.max("v").over(w))
    rows = rows.withColumns({"p": F.pow(F.col("v") - best, F.lit(2.0)), "m": F.pow(F.col("v") - worst, F.lit(2.0))})
    far = rows.groupBy("product").agg(F.sqrt(F.coalesce(F.sum("p"), F.lit(0.0))).alias("p"), F.sqrt(F.coalesce(F.sum("m"), F.lit(0.0))).alias("m"))
    return _ranked(far.select("product", (F.col("m") / F.nullif(F.col("p") + F.col("m"), F.lit(0.0))).alias("score")), False)


def consensus(outputs: dict[str, DataFrame], score_priority: bool = True) -> DataFrame:
    """product, mean_rank, consensus_score, rank from (product, score, rank) of several methods.

    Scores are brought to 0..1 within a method, 1 for all and missing ones where they don't vary. score_priority: places
    1..n by mean rank, then score, then name; without it equal mean ranks share their mean place."""
    if not outputs:
        raise ValueError("no method to agree with")
    for name, o in outputs.items():
        require(o, "product", "rank", "score")
        one = o.select("product", F.lit(name).alias("method"), "rank", finite("score").alias("score"))
        rows = one if name == next(iter(outputs)) else rows.unionByName(one)  # noqa: F821
    grid = rows.select("product").distinct().join(rows.select("method").distinct(), F.lit(True)).join(rows, ["product", "method"], "left")
    w = Window.partitionBy("method")
    low, high = F.min("score").over(w), F.max("score").over(w)
    z = F.when(high.isNull() | isclose(high, low), F.lit(1.0)).otherwise(F.coalesce((F.col("score") - low) / F.nullif(high - low, F.lit(0.0)), F.lit(1.0)))
    both = grid.withColumn("z", z).groupBy("product").agg(F.avg("rank").alias("mean_rank"), F.avg("z").alias("consensus_score"))
    if score_priority:
        order = Window.orderBy(F.asc_nulls_last("mean_rank"), F.desc("consensus_score"), "product")
        return both.withColumn("rank", F.row_number().over(order).cast("double"))
    return both.withColumn("rank", average_rank(F.col("mean_rank"), [F.lit(0)]))


def run_methods(table: DataFrame, ways: dict[str, str], methods: Iterable[str] | None = None, product: str = "product") -> dict[str, DataFrame]:
    """Results by method: simple_metric, simple_average_rank, borda, {critic,entropy,equal}_{topsis,weighted_sum}, consensus."""
    long = long_table(table, ways, product)
    out: dict[str, DataFrame] = {}
    for m in methods if methods is not None else ("simple_average_rank", "borda", "critic_topsis", "entropy_topsis", "equal_weighted_sum", "consensus"):
        head, _, tail = m.partition("_")
        if m == "simple_metric":
            out[m] = metric_ranks(long)
        elif m == "simple_average_rank":
            out[m] = average_rank_method(long)
        elif m == "borda":
            out[m] = borda(long)
        elif head in WEIGHTS and tail in ("topsis", "weighted_sum"):
            out[m] = (topsis if tail == "topsis" else weighted_sum)(long, WEIGHTS[head](long))
        elif m == "consensus":
            out[m] = consensus({k: v for k, v in out.items() if {"score", "rank"} <= set(v.columns)})
        else:
            raise ValueError(f"unknown ranking method {m!r}")
    return out


def best(result: DataFrame, n: int = 3) -> DataFrame:
    """The n products of best rank."""
    return result.orderBy(F.asc_nulls_last("rank"), "product").limit(n)


def workflow() -> dict:
    """The steps from products to a ranking, in words."""
    return {"name": "product ranking", "steps": ["evaluate products against a reference", "choose metrics and their directions", "normalise and weigh metrics", "rank by several methods and agree on one order", "fuse the best products"]}
