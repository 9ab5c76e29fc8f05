"""Quality rules: base limits on a text's statistics, and robust multivariate outliers of what passes.

All of it is DataFrame functions. The statistics come from one pass over the texts, without an explode. The outlier
rule estimates location and covariance by minimum covariance determinant for each language and source: from three
starts, concentration steps keep the h nearest rows of every group and estimate again, until the determinant falls no
more; the least determinant of all steps wins. A step is one aggregation of a narrow table, of sums and cross products by
group, start and bin of squared distance; the bins up to the h-th row, the last one in part, add up to the next estimate. Groups of any size reduce
to a row for each bin before they move; no group is ever gathered."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

GAP = r"[\x20\x09-\x0D]+"
SYMBOL = "[#*$%&|<>]"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
POSITION = 20  # bits of a packed long that hold a word's number
BINS = 64  # of squared distance in each doubling


def _repeat_words(rows: DataFrame, words: str, name: str) -> DataFrame:
    """rows with the number of words in windows of three words that the text has twice or more.

    Windows are packed as 44 bits of hash and 20 of position and sorted as plain longs. Neighbours with the same hash are
    compared word by word; should two different windows ever share a hash, or the text have over 2**20
    words, the windows are sorted as text instead. Steps that a later one reads more than once are columns of
    their own, so that each is worked out once."""
    w = F.col(words)
    n = F.size(w)
    triples = F.arrays_zip(w.alias("a"), F.slice(w, 2, n).alias("b"), F.slice(w, 3, n).alias("c"))
    low = (1 << POSITION) - 1
    packed = F.transform(triples, lambda t, i: F.xxhash64(t["a"], t["b"], t["c"]).bitwiseAND(~low).bitwiseOR(i.cast("long")))
    rows = rows.withColumn("_keys", F.when(n > 3, F.sort_array(F.slice(packed, F.lit(1), n - 2))))
    keys = F.col("_keys")
    joint = F.zip_with(keys, F.slice(keys, 2, n), lambda p, q: F.when(F.shiftright(p, POSITION) == F.shiftright(q, POSITION), F.struct(p.bitwiseAND(low).cast("int").alias("p"), q.bitwiseAND(low).cast("int").alias("q"))))
    rows = rows.withColumn("_near", F.filter(joint, lambda x: x.isNotNull()))
    same = lambda x: (w[x["p"]] == w[x["q"]]) & (w[x["p"] + 1] == w[x["q"] + 1]) & (w[x["p"] + 2] == w[x["q"] + 2])
    fast = F.concat(F.col("_near.p"), F.col("_near.q"))

    texts = F.array_sort(F.transform(F.slice(triples, F.lit(1), n - 2), lambda t, i: F.struct(F.concat_ws(" ", t["a"], t["b"], t["c"]).alias("w"), i.alias("i"))))
    pairs = F.filter(F.zip_with(texts, F.slice(texts, 2, n), lambda p, q: F.when(p["w"] == q["w"], F.array(p["i"], q["i"]))), lambda x: x.isNotNull())
    rows = rows.withColumn("_at", F.when(F.size("_near") == 0, F.array().cast("array<int>")).when((n > low) | ~F.forall("_near", same), F.flatten(pairs)).otherwise(fast))
    at = F.col("_at")
    cover = F.size(F.array_distinct(F.concat(at, F.transform(at, lambda i: i + 1), F.transform(at, lambda i: i + 2))))
    return rows.withColumn(name, F.when(n > 3, cover).otherwise(0).cast("long")).drop("_keys", "_near", "_at")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns in keep, BASE and n_lines (lines with a word) of every text; null and empty texts have zeros."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), *(F.col(k).alias(f"_{k}") for k in keep), text.alias("_t"))
    rows = rows.withColumn("_w", F.filter(F.split("_t", GAP), lambda w: w != "")).withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return _repeat_words(rows, "_w", "n_repeat_words").select(
        "id",
        *(F.col(f"_{k}").alias(k) for k in keep),
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("_l").cast("long").alias("n_lines"),
    )


def transformed() -> dict[str, Column]:
    """The statistic vector: roughly symmetric in ordinary text, and free of scale."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "log_words": F.log(n),
        "log_word_chars": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        "symbols": F.sqrt(F.col("n_symbols") / n),
        "repeats": F.sqrt(F.col("n_repeat_words") / n),
        "dup_lines": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double")),
    }


#: Least deviation of a dimension. Most texts have no symbol, repeat or equal line at all, so without it a group's covariance is singular.
FLOORS = {"log_words": 0.1, "log_word_chars": 0.02, "symbols": 0.1, "repeats": 0.1, "dup_lines": 0.2}


def chi2_cdf(x: float, d: int) -> float:
    """Of the chi-squared distribution with d degrees of freedom, by recurrence over d."""
    out, k = (math.erf(math.sqrt(x / 2)), 1) if d % 2 else (1 - math.exp(-x / 2), 2)
    while k < d:
        out -= math.exp(k / 2 * math.log(x / 2) - x / 2 - math.lgamma(k / 2 + 1)) if x > 0 else 0
        k += 2
    return out


def chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, d) < p else (low, mid)
    return high


def _pairs(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i + 1)]


def _sums(dims: list[str]) -> list[Column]:
    sums = [f"sum({c}) AS t_{i}" for i, c in enumerate(dims)] + [f"sum({dims[i]} * {dims[j]}) AS q_{i}_{j}" for i, j in _pairs(len(dims))]
    return [F.expr(x) for x in ("count(*) AS n", *sums)]


def _estimates(sums: DataFrame, floor: list[float], factor: float = 1.0) -> DataFrame:
    """g, s, m_i, the Cholesky factor l_i_j of covariance * factor with variances of floor**2 at least, and log_det, from sums."""
    d = len(floor)
    cov = {(i, j): f"(q_{i}_{j} / n - t_{i} * t_{j} / n / n) * {factor!r}D" for i, j in _pairs(d)}
    moments = [f"greatest({v}, {floor[i] ** 2!r}D) AS s_{i}_{j}" if i == j else f"{v} AS s_{i}_{j}" for (i, j), v in cov.items()]
    return _factored(sums.selectExpr("g", "s", *(f"t_{i} / n AS m_{i}" for i in range(d)), *moments), floor)


def _factored(est: DataFrame, floor: list[float]) -> DataFrame:
    """One select, in which each entry of the factor names those before it."""
    d = len(floor)
    minus = lambda i, j: "".join(f" - l_{i}_{k} * l_{j}_{k}" for k in range(j))
    factor = []
    for j in range(d):
        factor.append(f"sqrt(greatest(s_{j}_{j}{minus(j, j)}, {(floor[j] / 100) ** 2!r}D)) AS l_{j}_{j}")
        factor += [f"(s_{i}_{j}{minus(i, j)}) / l_{j}_{j} AS l_{i}_{j}" for i in range(j + 1, d)]
    return est.selectExpr("g", "s", *(f"m_{i}" for i in range(d)), *factor, " + ".join(f"2 * ln(l_{i}_{i})" for i in range(d)) + " AS log_det")


def _distances(rows: DataFrame, est: DataFrame, dims: list[str], send) -> DataFrame:
    """rows with s and d2, the squared Mahalanobis distance to each of their group's estimates."""
    columns = [*rows.columns, "s"]
    solved = [f"({c} - m_{i}{''.join(f' - l_{i}_{k} * y_{k}' for k in range(i))}) / l_{i}_{i} AS y_{i}" for i, c in enumerate(dims)]
    d2 = " + ".join(f"y_{i} * y_{i}" for i in range(len(dims)))
    return rows.join(send(est), "g").selectExpr(*columns, *solved, f"{d2} AS d2").select(*columns, "d2")


def _concentrated(far: DataFrame, dims: list[str], share: float) -> DataFrame:
    """Sums over the `share` of each group's rows with the least d2, by bins of which BINS make a doubling. Of the bin that holds
    the last of these rows all count, each by the part of the bin that is still due, so n is that share of the group exactly."""
    binned = far.groupBy("g", "s", F.expr(f"CAST(floor(log2(greatest(d2, 1e-9D)) * {BINS}) AS INT) AS bin")).agg(*_sums(dims))
    own = "OVER (PARTITION BY g, s"
    before = f"coalesce(sum(n) {own} ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before"
    core = binned.selectExpr("*", before, f"sum(n) {own}) AS total").where(f"before < total * {share!r}D")
    due = f"least(1D, (total * {share!r}D - before) / n)"
    return core.groupBy("g", "s").agg(*(F.expr(f"sum({c} * {due}) AS {c}") for c in binned.columns if c not in ("g", "s", "bin")))


def _starts(rows: DataFrame, dims: list[str], floor: list[float], send) -> DataFrame:
    """Three estimates of each group: 0, medians and median deviations; 1, all its rows; 2, the half that is nearest to 0."""
    d = range(len(dims))
    mids = rows.groupBy("g").agg(*(F.percentile_approx(c, 0.5, 1000).alias(f"m_{i}") for i, c in enumerate(dims)))
    spread = rows.join(send(mids), "g").groupBy("g").agg(*(F.first(f"m_{i}").alias(f"m_{i}") for i in d), *(F.percentile_approx(F.abs(F.col(c) - F.col(f"m_{i}")), 0.5, 1000).alias(f"a_{i}") for i, c in enumerate(dims)))
    flat = [F.pow(F.greatest(1.4826 * F.col(f"a_{i}"), F.lit(floor[i])), F.lit(2.0)).alias(f"s_{i}_{j}") if i == j else F.lit(0.0).alias(f"s_{i}_{j}") for i, j in _pairs(len(dims))]
    middle = materialize(_factored(spread.select("g", F.lit(0).alias("s"), *(f"m_{i}" for i in d), *flat), floor), "quality-start")
    whole = _estimates(rows.groupBy("g").agg(*_sums(dims)).withColumn("s", F.lit(1)), floor)
    half = _estimates(_concentrated(_distances(rows, middle, dims, send), dims, 0.5).withColumn("s", F.lit(2)), floor)
    return middle.unionByName(whole).unionByName(half)


def minimum_determinant(rows: DataFrame, dims: list[str], floor: list[float], h: float, send, most: int = 50) -> DataFrame:
    """The estimate of each group g of rows: of the steps from three starts the one with the least determinant. Steps from a start end
    with the first that lowers it no more; as rows of a bin count alike, that one may be worse than the one before it. Covariances are scaled to what the nearest share h of normal rows would have in all."""
    d = len(dims)
    factor = h / chi2_cdf(chi2_quantile(h, d), d + 2)
    now = materialize(_starts(rows, dims, floor, send).withColumn("log_det", F.lit(math.inf)), "quality-starts")
    found = None
    for _ in range(most):
        new = _estimates(_concentrated(_distances(rows, now, dims, send), dims, h), floor, factor)
        new = materialize(new.join(now.select("g", "s", F.col("log_det").alias("old")), ["g", "s"]), "quality-estimate")
        found = new if found is None else found.unionByName(new)
        now = new.where("log_det < old - 1e-6").drop("old")
        if now.isEmpty():
            break
    found = found.drop("old")
    return found.groupBy("g").agg(F.min_by(F.struct(*(c for c in found.columns if c != "g")), F.struct("log_det", "s")).alias("x")).select("g", "x.*")


#: Groups whose estimates (some 200 bytes each) are sent to all tasks; of more, they are joined by a shuffle.
MOST_SENT = 100_000


def outliers(stats: DataFrame, h: float = 0.75, keep: float = 0.9999, least: int = 50, floors: dict[str, float] | None = None) -> DataFrame:
    """stats with d2 and outlier.

    stats: row, lang, source, BASE, n_lines; rows that failed the base limits (base_failed) take no part and have null d2. Groups
    under `least` rows are judged together with the others of their language, what is under that too all together, and what
    is then left by the estimate of all rows of its language, or of all rows where the language has under `least`. Outliers lie
    beyond the squared distance within which a share `keep` of normal rows would lie. floors: see FLOORS."""
    vector = transformed()
    dims = list(vector)
    floor = list((FLOORS | (floors or {}))[c] for c in dims)
    tag = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    of_lang, of_source = F.concat(F.lit("1\x01"), tag("lang")), F.concat_ws("\x01", F.lit("2"), tag("lang"), tag("source"))
    rows = stats.where(~F.col("base_failed")).select("row", of_source.alias("g2"), of_lang.alias("g1"), *(c.alias(k) for k, c in vector.items()))
    sizes = materialize(rows.groupBy("g1", "g2").agg(F.count("*").alias("n")), "quality-sizes")
    langs = materialize(sizes.groupBy("g1").agg(F.coalesce(F.sum(F.when(F.col("n") < least, F.col("n"))), F.lit(0)).alias("n1"), F.sum("n").alias("n_lang")), "quality-languages")
    n0 = langs.where(F.col("n1") < least).agg(F.sum("n1")).first()[0] or 0
    send = F.broadcast if sizes.count() <= MOST_SENT else (lambda df: df)
    group = F.when(F.col("n") >= least, F.col("g2")).when(F.col("n1") >= least, F.col("g1")).when(F.lit(n0 >= least), F.lit("0"))
    named = materialize(sizes.join(langs, "g1").select("g2", "g1", "n_lang", group.alias("g")), "quality-groups")
    left = named.where("g is null")
    all_of_lang = F.concat(F.lit("3"), F.col("g1"))
    judged_by = named.select("g2", F.coalesce("g", F.when(F.col("n_lang") >= least, all_of_lang).otherwise("4")).alias("g"), F.lit(True).alias("own"))
    others = named.where("g is not null").join(left.where(F.col("n_lang") >= least).select("g1").distinct(), "g1").select("g2", all_of_lang.alias("g"), F.lit(False).alias("own"))
    if not left.where(F.col("n_lang") < least).isEmpty():  # all rows, whether or not their own language is judged by itself
        apart = named.where(~(F.col("g").isNull() & (F.col("n_lang") < least)))
        others = others.unionByName(apart.select("g2", F.lit("4").alias("g"), F.lit(False).alias("own")))
    rows = materialize(rows.join(send(judged_by.unionByName(others)), "g2").select("row", "g", "own", *dims), "quality-vectors")
    best = materialize(minimum_determinant(rows, dims, floor, h, send), "quality-best")
    judged = _distances(rows.where("own"), best, dims, send).select("row", "d2")
    return stats.join(judged, "row", "left").withColumn("outlier", F.coalesce(F.col("d2") > chi2_quantile(keep, len(dims)), F.lit(False)))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """doc_id, BASE, base_failed, d2 and kept of every row.

    Null texts have no words and fail; texts under 50 words, or with over half of their words in repeated windows of
    three, fail; null languages and sources are values like any other, as are empty ones; repeated rows count each; other
    columns are ignored; an empty table gives an empty result."""
    stats = statistics(docs, id_col, text_col, ("lang", "source"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = materialize(stats.withColumn("base_failed", failed).withColumn("row", F.monotonically_increasing_id()), "quality-stats")
    found = outliers(stats, **rule)
    return found.select(F.col("id").alias("doc_id"), *BASE, "base_failed", "d2", (~F.col("base_failed") & ~F.col("outlier")).alias("kept"))


def digests(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", *BASE, "base_failed", "kept")
