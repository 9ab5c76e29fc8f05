"""Forests of all groups in one job, stored models, and the corrections that learn from them."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from rainframe.operators import fusion, learn, trees


def made(n, seed, groups=3):
    rng = np.random.default_rng(seed)
    x = rng.uniform(0, 1, (n, 4))
    g = rng.integers(0, groups, n)
    y = np.where(x[:, 0] > 0.5, 3.0, 0.0) + 2 * x[:, 1] * (g + 1) + rng.normal(0, 0.1, n)
    return [(int(k), *map(float, r), float(v)) for k, r, v in zip(g, x, y)]


SCHEMA = "g int, a double, b double, c double, d double, y double"
NAMES = ["a", "b", "c", "d"]


def brute_tree(x, y, depth):
    """Least squares by trying every cut."""
    if depth == 0 or len(y) < 2 or (y == y[0]).all():
        return np.full(len(y), y.mean())
    best = None
    for f in range(x.shape[1]):
        for c in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= c
            err = ((y[left] - y[left].mean()) ** 2).sum() + ((y[~left] - y[~left].mean()) ** 2).sum()
            if best is None or err < best[0] - 1e-12:
                best = err, left
    if best is None:
        return np.full(len(y), y.mean())
    out = np.empty(len(y))
    for side in (best[1], ~best[1]):
        out[side] = brute_tree(x[side], y[side], depth - 1)
    return out


def test_a_tree_is_the_best_by_every_cut():
    rng = np.random.default_rng(5)
    for depth in (1, 2, 3):
        x = rng.integers(0, 12, (60, 3))
        y = rng.normal(size=60) + (x[:, 1] > 5) * 4
        f, cut, child, value = trees.grow(x, y, np.ones(60), depth, 1, 3, rng)
        got = value[trees.follow(x, f, cut, child)]
        want = brute_tree(x, y, depth)
        assert ((got - y) ** 2).sum() == pytest.approx(((want - y) ** 2).sum())
    heavy = trees.grow(np.array([[0], [1], [2]]), np.array([0.0, 1.0, 5.0]), np.array([1.0, 1.0, 2.0]), 4, 2, 1, rng)
    assert heavy[0].tolist() == [0, -1, -1] and heavy[3].tolist() == [2.75, 0.5, 5.0]


def test_all_groups_in_one_fit_score_as_a_forest_of_each(spark):
    rows = spark.createDataFrame(made(6000, 1), SCHEMA).repartition(4)
    new = spark.createDataFrame(made(1500, 2), SCHEMA)
    models = trees.fit(rows, ["g"], NAMES, "y", trees.Forest(trees=24, depth=8), least=100)
    assert models.count() == 72
    got = trees.predict(new, models, ["g"], NAMES)
    score = lambda d: 1 - d.agg(F.avg(F.pow(F.col("y") - F.col("prediction"), F.lit(2.0))) / F.var_pop("y")).first()[0]
    ready = VectorAssembler(inputCols=NAMES, outputCol="x")
    for g in range(3):
        plain = RandomForestRegressor(numTrees=24, maxDepth=8, seed=1, labelCol="y", featuresCol="x").fit(ready.transform(rows.where(f"g = {g}")))
        other = score(plain.transform(ready.transform(new.where(f"g = {g}"))))
        assert score(got.where(f"g = {g}")) > other - 0.03


def test_samples_blocks_and_unknown_groups(spark, monkeypatch):
    rows = spark.createDataFrame(made(3000, 1) + [(None, 0.1, 0.2, 0.3, 0.4, 7.0)] * 150 + [(9, 1.0, 1.0, 1.0, 1.0, 1.0)], SCHEMA)
    models = trees.fit(rows, ["g"], NAMES, "y", trees.Forest(trees=10, depth=4), samples=200, least=100)
    assert {r.g for r in models.collect()} == {0, 1, 2, None}
    monkeypatch.setattr(trees, "SENT", 100)
    new = spark.createDataFrame([(None, 0.1, 0.2, 0.3, 0.4, 0.0), (9, 1.0, 1.0, 1.0, 1.0, 0.0), (1, None, 0.2, 0.3, 0.4, 0.0), (2, 0.9, 0.5, 0.5, 0.5, 0.0)], SCHEMA)
    got = {r.g: r.prediction for r in trees.predict(new, models, ["g"], NAMES).collect()}
    assert got[None] == 7.0 and got[9] is None and got[1] is None and 4 < got[2] < 8
    assert trees.fit(rows.where("y > 1e9"), ["g"], NAMES, "y", trees.Forest(trees=2)).count() == 0


def test_boosted_trees_come_close(spark):
    rows, new = spark.createDataFrame(made(4000, 3, 2), SCHEMA), spark.createDataFrame(made(800, 4, 2), SCHEMA)
    models = trees.fit(rows, ["g"], NAMES, "y", trees.Boosted(rounds=120, step=0.1))
    got = trees.predict(new, models, ["g"], NAMES, boosted=True)
    assert got.agg(F.avg(F.pow(F.col("y") - F.col("prediction"), F.lit(2.0)))).first()[0] < 0.05


def world(spark, n_t=120, n_c=30):
    rng = np.random.default_rng(3)
    rows = []
    for t in range(n_t):
        for c in range(n_c):
            ref = float(max(0.0, rng.gamma(0.6, 6) - 2))
            rows.append((dt.datetime(2001, 1, 1) + dt.timedelta(days=3 * t), c, max(0.0, 1.4 * ref + float(rng.normal(0, 0.5))), None if c % 7 == 0 and t % 5 == 0 else 0.7 * ref, ref))
    wide = spark.createDataFrame(rows, "time timestamp_ntz, cell_id long, a double, b double, ref double")
    return wide, spark.createDataFrame([(c, c % 3 + 1, "z") for c in range(n_c - 1)], "cell_id long, zone_id int, zone_name string")


def test_models_are_stored_and_predict_the_same(spark, tmp_path):
    wide, zones = world(spark)
    models = learn.fit_by_zone(wide, ["a", "b"], zones, trees.Forest(trees=10, depth=6), least=500)
    models.write.parquet(str(tmp_path / "models"))
    once = learn.predict_by_zone(wide, ["a", "b"], zones, spark.read.parquet(str(tmp_path / "models")))
    again = learn.predict_by_zone(wide, ["a", "b"], zones, spark.newSession().read.parquet(str(tmp_path / "models")).select("*"))
    rows = {(r.time, r.cell_id): r.value for r in once.collect()}
    assert rows == {(r.time, r.cell_id): r.value for r in again.collect()} and len(rows) == 120 * 29
    met = once.join(wide, ["time", "cell_id"])
    assert met.agg(F.avg(F.abs(F.col("value") - F.col("ref")))).first()[0] < 0.5 * met.agg(F.avg(F.abs(F.col("a") - F.col("ref")))).first()[0]
    gone = met.where("b is null").first()
    assert gone.value == pytest.approx(gone.a)


def test_two_stages_of_all_zones(spark):
    wide, zones = world(spark)
    cfg = learn.TwoStageConfig(trees=16, depth=6, least=200)
    got = learn.fuse_two_stage(wide, ["a", "b"], zones.where("zone_id < 3"), cfg=cfg)
    met = got.join(wide, ["time", "cell_id"])
    assert got.count() == met.count() == 120 * 20 and got.where("value is null").count() == 0
    assert met.agg(F.avg(F.abs(F.col("value") - F.col("ref")))).first()[0] < 0.6
    assert met.where("value = 0 and ref >= 0.1").count() + met.where("value > 0 and ref < 0.1").count() < 120
    assert learn.fuse_two_stage(wide, ["a", "b"], zones, cfg=learn.TwoStageConfig(least=10**6)).where("value is not null").count() == 0


def test_sampled_days_hold_their_sizes_and_can_be_drawn_again(spark):
    rows = spark.range(200 * 400).select((F.col("id") % 400).alias("cell_id"), F.timestamp_seconds((F.col("id") / 400).cast("long") * 86400).cast("timestamp_ntz").alias("time"), (F.col("id") % 5 == 0).cast("double").alias("ref"))
    rows = rows.withColumn("month", F.month("time"))
    some = learn.sample_days(rows, F.col("ref"), days=8, points=100, most_wet=30)
    by_day = some.groupBy("month", "time").agg(F.count_if(F.expr("ref > 0.1")).alias("wet"), F.count_if(F.expr("ref <= 0.1")).alias("dry")).collect()
    per_month = {m: sum(r.month == m for r in by_day) for m in range(1, 8)}
    assert all(1 <= n <= 18 for n in per_month.values()) and 30 < sum(per_month.values()) < 80
    assert abs(np.mean([r.wet for r in by_day]) - 30) < 4 and abs(np.mean([r.dry for r in by_day]) - 70) < 6
    assert some.count() == learn.sample_days(rows.repartition(7), F.col("ref"), days=8, points=100, most_wet=30).count()
    assert learn.sample_days(rows, F.col("ref"), days=1000).count() == rows.count()


def test_expectation_maximisation_over_all_rows_is_that_of_small_groups(spark):
    wide, zones = world(spark)
    zones = zones.where("zone_id < 3")
    got = {(r.zone_id, r.month): r for r in fusion.bayesian_average(wide, ["a", "b"], zones, least=60).collect()}
    rows = fusion.complete(fusion.zone_month(wide, zones), ["a", "b"]).toPandas()
    assert len(got) == 24
    for k, own in rows.groupby(["zone_id", "month"]):
        w, var, trace = fusion.em(own[["a", "b"]].to_numpy(float), own["ref"].to_numpy(float))
        r = got[k]
        assert r.weights == pytest.approx(w, abs=1e-9) and r.sig2 == pytest.approx(var, rel=1e-9) and r.trace == pytest.approx(trace)
        assert all(b >= a - 1e-7 * abs(a) for a, b in zip(r.trace, r.trace[1:]))


def test_two_stages_learn_from_all_rows(spark):
    """Both sides of a cut must weigh 120,000, which they do over all 260,000 rows alone, not over 200,000 of them."""
    rows = spark.range(260_000).select(F.lit(1).alias("zone_id"), F.lit(dt.datetime(2001, 1, 1)).alias("time"), F.col("id").alias("cell_id"), (F.col("id") % 2).cast("double").alias("x"))
    rows = rows.withColumn("_y", F.col("x"))
    models, fills = learn.fit_two_stage(rows, ["zone_id"], ["x"], "_y", F.col("x"), learn.TwoStageConfig(trees=3, depth=2, least_leaf=120_000))
    assert models.where("stage = 'wet' and feature[0] = 0").count() == 3
    assert {r.x: r.p_wet for r in learn.apply_two_stage(rows.limit(100), models, fills, ["zone_id"], ["x"]).collect()} == {0.0: 0.0, 1.0: 1.0}


def test_groups_that_no_task_holds_have_the_trees_of_those_that_one_holds(spark, monkeypatch):
    """Labels are whole numbers, so that sums are the same in any order. A task holds 1500 (one group is larger) or 90 rows."""
    rows = spark.createDataFrame([(None if g == 2 else g, a, b, c, d, float(round(y))) for g, a, b, c, d, y in made(3000, 6) + made(1000, 7, 1)], SCHEMA).repartition(4)
    monkeypatch.setattr(trees, "PACKED", 300)
    key = F.xxhash64(*NAMES)

    def scored(held, at_once=10**9, depth=7):
        monkeypatch.setattr(trees, "HELD", held)
        monkeypatch.setattr(trees, "DEALT", at_once)
        models = trees.fit(rows, ["g"], NAMES, "y", trees.Forest(trees=6, depth=depth, least=2), least=100, key=key)
        models.persist()
        assert sorted((r.g or -1, r.tree) for r in models.collect()) == sorted((g or -1, t) for g in (0, 1, None) for t in range(6))
        nodes = models.select(F.sum(F.size("feature")), F.sum(F.aggregate("threshold", F.lit(0.0), lambda a, x: a + x))).first()
        out = {(r.g, r.a): r.prediction for r in trees.predict(rows, models, ["g"], NAMES).collect()}
        models.unpersist()
        return nodes, out

    nodes, want = scored(10**6)
    for held, at_once in ((1500, 8_000), (90, 10**9)):
        n, got = scored(held, at_once)
        assert n[0] == nodes[0] and n[1] == pytest.approx(nodes[1]) and got == pytest.approx(want)
    assert scored(90, depth=1)[1] == pytest.approx(scored(10**6, depth=1)[1])
    monkeypatch.setattr(trees, "HELD", 90)
    with pytest.raises(ValueError, match="samples"):
        trees.fit(rows, ["g"], NAMES, "y", trees.Boosted(rounds=2))


def test_what_is_drawn_is_of_poissons_law():
    key = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 200_000)
    one, two = (trees._times(key, trees._salts(trees.Forest(), t)[0]) for t in (0, 1))
    for k, share in enumerate((0.36788, 0.36788, 0.18394, 0.06131)):
        assert (one == k).mean() == pytest.approx(share, abs=0.005) and (two[one == k] == k).mean() == pytest.approx(share, abs=0.012)
    looked = trees._looked(np.arange(1, 4000), 12, 4, trees._salts(trees.Forest(), 3)[1])
    assert all(len(set(r)) == 4 for r in looked.tolist()) and np.bincount(looked.ravel(), minlength=12) / 3999 == pytest.approx(np.full(12, 1 / 3), abs=0.04)
