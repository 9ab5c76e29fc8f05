import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainframe.operators import align, charts, drought, evaluate, extremes, fusion, learn, ranking, regions, regrid, resample, select, windows

CUBE = "time timestamp_ntz, cell_id long, value double"


def day(i, start=dt.datetime(2001, 1, 1)):
    return start + dt.timedelta(days=i)


@pytest.fixture(scope="module")
def cells(spark):
    return regrid.grid(spark, [0.0, 1.0, 2.0, 3.0], [10.0, 11.0, 12.0, 13.0, 14.0]).cache()


def cube(spark, values, cell=0, start=dt.datetime(2001, 1, 1)):
    return spark.createDataFrame([(day(i, start), cell, v) for i, v in enumerate(values)], CUBE)


def test_selection(spark, cells):
    assert {r.cell_id for r in select.box(cells, 11, 12, 1, 2).collect()} == {6, 7, 11, 12}
    rows = cube(spark, [float(i) for i in range(400)])
    assert select.time_range(rows, "2001-02", "2001-03-01").count() == 29 and select.time_range(rows, "2002").count() == 35
    assert select.months(rows, [2]).count() == 28 + 4
    with pytest.raises(KeyError):
        select.rename(rows, {"nope": "x"})
    assert select.standard_axes(cells.withColumnsRenamed({"lat": "Latitude", "lon": "x"})).columns[-2:] == ["lat", "lon"]
    assert select.main_variable(rows) == "value"


def test_runs_and_ranks(spark):
    rows = cube(spark, [0.0, 0.0, 5.0, None, 0.0, 0.0, 0.0, 9.0, 0.0])
    assert windows.longest_run(rows, F.col("value") < 1, ("cell_id",)).first().run == 3
    assert windows.longest_run(rows, F.col("value") > 100, ("cell_id",)).first().run == 0
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,), (5.0,)], "v double")
    assert sorted((r.v or 0, r.r) for r in df.withColumn("r", windows.average_rank(F.col("v"), [F.lit(0)])).collect() if r.r) == [(1.0, 1.0), (2.0, 2.5), (2.0, 2.5), (5.0, 4.0)]


def test_rolling_needs_all(spark):
    got = [r.value for r in windows.rolling(cube(spark, [1.0, 2.0, None, 4.0, 5.0, 6.0]), 2).orderBy("time").collect()]
    assert got == [None, 3.0, None, None, 9.0, 11.0]


def test_spells_end_with_the_year_and_empty_years_are_null(spark):
    wet = [5.0] * 10
    rows = cube(spark, wet, start=dt.datetime(2001, 12, 27)).unionByName(cube(spark, [None] * 3, start=dt.datetime(2005, 1, 1)))
    assert {r.year: r.cwd for r in extremes.cwd(rows).collect()} == {2001: 5, 2002: 5, 2005: None}
    assert {r.year: r.cdd for r in extremes.cdd(rows).collect()} == {2001: 0, 2002: 0, 2005: None}


def test_all_indices_share_a_row(spark):
    rng = np.random.default_rng(11)
    rows = cube(spark, rng.gamma(1.5, 4, 365).tolist())
    r = extremes.compute(rows, params={"r10mm": {"threshold": 5.0}}).collect()
    assert len(r) == 1 and all(r[0][k] is not None for k in extremes.INDICES)
    assert r[0].rx1day <= r[0].rx5day <= r[0].prcptot and r[0].r99p <= r[0].r95p
    with pytest.raises(KeyError):
        extremes.compute(rows, ["nope"])


def test_gaps_are_filled_on_request(spark):
    rows = cube(spark, [1.0]).unionByName(cube(spark, [2.0], start=dt.datetime(2001, 4, 5)))
    assert [r.value for r in resample.to_period(rows, "month", fill_gaps=True, empty_sum="zero").orderBy("time").collect()] == [1.0, 0.0, 0.0, 2.0]
    assert resample.to_period(rows, "month").count() == 2 and resample.to_period(rows, "native") is rows
    with pytest.raises(ValueError):
        resample.to_period(rows, "month", "median")


def test_spi_keeps_shape_and_bounds(spark):
    rng = np.random.default_rng(0)
    months = [dt.datetime(2001 + i // 12, i % 12 + 1, 1) for i in range(24)]
    rows = spark.createDataFrame([(t, c, float(x)) for c in range(4) for t, x in zip(months, rng.gamma(2, 2, 24))], CUBE)
    got = drought.spi(rows, 3).collect()
    assert len(got) == 96
    known = [r.SPI_3 for r in got if r.SPI_3 is not None]
    assert len(known) == 4 * 22 and max(map(abs, known)) <= 4.7535 and abs(np.mean(known)) < 0.1 and np.std(known) == pytest.approx(1, abs=0.15)
    short = drought.spi(rows.where("time < '2001-09-01'"), 1).collect()
    assert all(r.SPI_1 is None for r in short)
    assert all(r.SPI_1 is None for r in drought.spi(rows.withColumn("value", F.lit(0.0)), 1).collect())
    z = [r.STI_1 for r in drought.sti(rows).where("cell_id = 0").collect()]
    assert np.mean(z) == pytest.approx(0, abs=1e-9) and np.std(z, ddof=1) == pytest.approx(1)


def test_nearest_pixels(spark, cells):
    points = spark.createDataFrame([(1, 0.5, 10.49), (2, -9.0, 99.0), (3, 2.2, 12.5), (4, None, 11.0)], "station int, lat double, lon double")
    assert {r.station: r.cell_id for r in align.nearest_cells(points, cells).collect()} == {1: 5, 2: 4, 3: 13, 4: None}


def test_station_pairs_and_empty_stations(spark, cells):
    model = spark.createDataFrame([(day(i), 6, float(i)) for i in range(5)] + [(day(9), 6, None)], CUBE)
    st = spark.createDataFrame([("a", day(i), 1.1, 11.2, float(i + 1)) for i in range(4)] + [("b", day(3), 3.0, 14.0, 2.0)], "station string, time timestamp_ntz, lat double, lon double, obs double")
    got = {r.station: r for r in evaluate.evaluate_stations(st, model, cells, names=("BIAS", "CORR")).collect()}
    assert got["a"].n == 4 and got["a"].BIAS == -1.0 and got["a"].CORR == pytest.approx(1)
    assert got["b"].n == 0 and got["b"].BIAS is None
    assert evaluate.evaluate_stations(st, model, cells, keep_empty=False).count() == 1
    assert evaluate.evaluate_stations(st, model, cells, group="season").first().season == "DJF"


def test_nearest_time(spark):
    left, right = cube(spark, [0.0] * 6).select("time", "cell_id"), spark.createDataFrame([(day(0), 0, 1.0), (day(4), 0, 2.0)], CUBE)
    assert [r.near_value for r in align.nearest_time(left, right).orderBy("time").collect()] == [1.0, 1.0, 1.0, 2.0, 2.0, 2.0]


def test_grouping_sets_equal_separate_groups(spark, cells):
    rng = np.random.default_rng(3)
    rows = [(p, day(i * 17), c, float(rng.gamma(1, 3)), float(rng.gamma(1, 3))) for p in "xy" for i in range(40) for c in range(6)]
    pairs = spark.createDataFrame(rows, "product string, time timestamp_ntz, cell_id long, obs double, sim double")
    zones = spark.createDataFrame([(c, 1 + c % 2, "ab"[c % 2]) for c in range(6)], "cell_id long, zone_id int, zone_name string")
    both = evaluate.detection_rollup(pairs, zones).collect()
    apart = evaluate.region_detection(pairs, zones).collect()
    assert {(r["product"], r.zone_name, round(r.POD, 9)) for r in both if r.zone_name} == {(r["product"], r.zone_name, round(r.POD, 9)) for r in apart}
    with pytest.raises(ValueError):
        evaluate.region_detection(pairs, zones, "week")
    assert evaluate.elevation_detection(pairs, zones.select("cell_id", F.col("cell_id").cast("double").alias("dem")), [(0, 3), (2, 9)]).count() == 4
    perf = charts.performance(evaluate.region_detection(pairs, zones, "month")).collect()
    assert all(0 <= r.csi <= 1 for r in perf)


def test_polygons(spark, cells):
    shapes = spark.createDataFrame([(0, "b", [[(10.5, 0.5), (13.5, 0.5), (13.5, 2.5), (10.5, 2.5)], [(11.5, 0.6), (12.5, 0.6), (12.5, 1.5), (11.5, 1.5)]], {"kind": "k"}), (1, "a", [[(9.0, -1.0), (10.6, -1.0), (10.6, 9.0), (9.0, 9.0)]], {})], regions.REGIONS)
    zones = {r.cell_id: (r.zone_id, r.zone_name) for r in regions.zone_table(cells, shapes).collect()}
    assert zones == {**{c: (2, "b") for c in (6, 8, 11, 12, 13)}, **{c: (1, "a") for c in (0, 5, 10, 15)}}
    assert regions.fields(shapes) == ["kind"] and [r.kind for r in regions.field_values(shapes, "kind").collect()] == ["k"]
    with pytest.raises(ValueError):
        regions.with_field(shapes, "kind", ["none"])
    rows = spark.createDataFrame([(day(0), c, float(c)) for c in range(20)], CUBE)
    means = {r.zone_name: r.value for r in regions.zone_mean(rows, regions.zone_table(cells, shapes)).collect()}
    assert means == {"a": 7.5, "b": 10.0}


def test_regridding(spark, cells):
    rows = cells.select(F.lit(day(0)).cast("timestamp_ntz").alias("time"), "cell_id", (F.col("lat") * 100 + F.col("lon")).alias("value"))
    got = {r.cell_id: r.value for r in regrid.interpolate(rows, cells, [0.5, 2.0, 9.0], [10.25, 14.0]).collect()}
    assert got == pytest.approx({0: 60.25, 1: 64.0, 2: 210.25, 3: 214.0})
    holed = rows.withColumn("value", F.when(F.col("cell_id") != 0, F.col("value")))
    assert {r.cell_id: r.value for r in regrid.interpolate(holed, cells, [0.5], [10.25, 14.0]).collect()} == {0: None, 1: 64.0}
    assert regrid.resample(rows, cells, target_resolution=2.0, method="mean").count() == 4
    assert regrid.coarse_cells(cells, 2, 2).orderBy("lat", "lon").first().lat == 0.5
    for bad in ({}, {"target_resolution": 1.0, "target_grid": ([0.0], [10.0])}, {"target_resolution": 1.5, "method": "sum"}, {"target_grid": ([0.0], [10.0]), "method": "mean"}, {"target_resolution": 1.0, "method": "cubic"}):
        with pytest.raises(ValueError):
            regrid.resample(rows, cells, **bad)
    near = {r.cell_id: r.value for r in regrid.interpolate(rows, cells, [0.4], [13.6], "nearest").collect()}
    assert near == {0: 14.0}


TABLE = [("A", 1.20, 0.72, 0.80, 0.18), ("B", 0.95, 0.69, 0.76, 0.12), ("C", 1.05, 0.78, 0.83, 0.20)]
WAYS = {"RMSE": "cost", "KGE": "benefit", "POD": "max", "FAR": "lower_is_better"}


def test_ranking(spark):
    table = spark.createDataFrame(TABLE, "product string, RMSE double, KGE double, POD double, FAR double")
    got = ranking.run_methods(table, WAYS, ["simple_metric", "simple_average_rank", "borda", "critic_topsis", "entropy_topsis", "equal_weighted_sum", "consensus"])
    average = {r["product"]: r.score for r in got["simple_average_rank"].collect()}
    assert average == {"A": 2.25, "B": 2.0, "C": 1.75}
    assert [r["product"] for r in ranking.best(got["simple_average_rank"], 2).collect()] == ["C", "B"]
    assert {r["product"]: r.score for r in got["borda"].collect()} == {"A": 7.0, "B": 8.0, "C": 9.0}
    assert sorted(r.rank for r in got["consensus"].collect()) == [1, 2, 3]
    long = ranking.long_table(table, WAYS)
    for w in ranking.WEIGHTS.values():
        assert sum(r.weight for r in w(long).collect()) == pytest.approx(1)
    z = {(r["product"], r.metric): r.z for r in ranking.normalised(long, "vector").collect()}
    assert z["A", "RMSE"] == 0 and z["B", "RMSE"] > 0
    with pytest.raises(ValueError):
        ranking.run_methods(table, WAYS, ["nope"])
    with pytest.raises(ValueError):
        ranking.directions({"x": "sideways"})
    assert len(ranking.workflow()["steps"]) >= 4


def test_constant_and_missing_metrics(spark):
    table = spark.createDataFrame([("A", 1.0, None), ("B", 1.0, 2.0), ("C", 1.0, 3.0)], "product string, m double, k double")
    long = ranking.long_table(table, {"m": "benefit", "k": "benefit"})
    z = {(r["product"], r.metric): r.z for r in ranking.normalised(long).collect()}
    assert z["A", "m"] == 1.0 and z["A", "k"] is None and z["C", "k"] == 1.0
    weights = {r.metric: r.weight for r in ranking.critic_weights(long).collect()}
    assert weights == {"m": 0.0, "k": 1.0}
    ranks = {(r["product"], r.metric): r.rank for r in ranking.metric_ranks(long).collect()}
    assert ranks["A", "k"] is None and ranks["A", "m"] == 2.0 and ranks["C", "k"] == 1.0


def test_nnls_meets_its_conditions():
    rng = np.random.default_rng(4)
    for _ in range(30):
        x = rng.normal(size=(60, 4))
        y = x @ rng.normal(size=4) + rng.normal(size=60)
        g, b = x.T @ x, x.T @ y
        w = fusion.nnls(g, b)
        slope = b - g @ w
        assert (w >= 0).all() and (slope <= 1e-6).all() and abs(slope[w > 0]).max(initial=0) < 1e-6


def test_em_never_loses_likelihood():
    rng = np.random.default_rng(5)
    y = rng.gamma(2, 3, 2000)
    x = np.stack([y + rng.normal(0, s, 2000) for s in (0.3, 1.0, 3.0)], axis=1)
    w, var, trace = fusion.em(x, y)
    assert w.sum() == pytest.approx(1) and w[0] > w[2] and all(b >= a - 1e-6 for a, b in zip(trace, trace[1:]))


def make_wide(spark, n=3000):
    rng = np.random.default_rng(6)
    ref = rng.gamma(2, 5, n)
    rows = [(day(i % 300), i // 300, *(float(ref[i] + rng.normal(0, s)) for s in (1.0, 2.0, 4.0)), float(ref[i])) for i in range(n)]
    zones = spark.createDataFrame([(c, 1 + c % 2, "z") for c in range(n // 300)], "cell_id long, zone_id int, zone_name string")
    return spark.createDataFrame(rows, "time timestamp_ntz, cell_id long, a double, b double, c double, ref double").cache(), zones


def test_fitted_weights_prefer_the_better_product(spark):
    wide, zones = make_wide(spark)
    p = ["a", "b", "c"]
    for params in (fusion.fit_weights(wide, p, zones, 100), fusion.triple_collocation(wide, p, zones, 100), fusion.bayesian_average(wide, p, zones, 100)):
        for r in params.collect():
            assert sum(r.weights) == pytest.approx(1) and (r.weights[0] == max(r.weights) or r.method == "evw_tc" and r.weights[2] == min(r.weights)), r.method
    out = fusion.fuse(wide, p, zones, ["mean", "median", "inv_rmse_zone_month", "stacking_pos_zone_month", "best_single_zone_month", "evw_tc_zone_month", "bma_zone_month", "qm_zone_month"], 100)
    err = {r.method: r.e for r in out.join(wide, ["time", "cell_id"]).groupBy("method").agg(F.sqrt(F.avg(F.pow(F.col("value") - F.col("ref"), F.lit(2)))).alias("e")).collect()}
    assert len(err) == 8 and err["inv_rmse_zone_month"] < err["mean"] and err["stacking_pos_zone_month"] <= err["best_single_zone_month"] * 1.02
    with pytest.raises(ValueError):
        fusion.fuse(wide, p, zones, ["nope"])
    none = fusion.apply_weights(wide, p, zones, fusion.fit_weights(wide, p, zones, 10**9), "inv_rmse")
    assert none.where("value is not null").count() == 0
    residual = fusion.geo_residual(wide, p, zones, fusion.fit_weights(wide, p, zones, 100), regrid.grid(spark, [0.0, 1.0], [0.0, 1.0, 2.0, 3.0, 4.0]))
    assert fusion.apply_residual(wide, p, zones, fusion.fit_weights(wide, p, zones, 100), residual).where("value is null").count() == 0


def test_blends_with_missing_products(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (2.0, 4.0)], "a double, b double")
    got = [r[0] for r in df.select(fusion.blend([F.col("a"), F.col("b")], [F.lit(0.25), F.lit(0.75)])).collect()]
    assert got[0] == pytest.approx(1, rel=1e-5) and got[1] is None and got[2] == pytest.approx(3.5, rel=1e-5)
    long = spark.createDataFrame([("a", day(0), 0, 2.0), ("b", day(0), 0, None), ("a", day(1), 0, 2.0)], "product string, " + CUBE)
    assert [r.value for r in fusion.weighted(long, {"a": 1, "b": 3}).collect()] == [0.5]
    assert [r.value for r in fusion.weighted(long, {"a": 1, "b": 3}, renormalize=True).collect()] == [2.0]
    with pytest.raises(ValueError):
        fusion.weighted(long, {"a": 0})


def test_quantile_map_takes_the_last_of_equal_quantiles(spark):
    wide = spark.createDataFrame([(day(0), 0, 0.0, 9.0), (day(1), 0, None, 1.0)], "time timestamp_ntz, cell_id long, a double, ref double")
    tables = spark.createDataFrame([(1, 1, [[0.0, 0.0, 0.0, 1.0]], [0.0, 1.0, 2.0, 3.0])], "zone_id int, month int, xq array<array<double>>, yq array<double>")
    zones = spark.createDataFrame([(0, 1, "z")], "cell_id long, zone_id int, zone_name string")
    assert [r.value for r in fusion.quantile_map(wide, ["a"], zones, tables).orderBy("time").collect()] == [2.0, None]


def test_ridge_is_the_closed_form(spark):
    wide, zones = make_wide(spark, 600)
    r = learn.ridge(wide.withColumn("g", F.lit(1)), ["a", "b"], "ref", ["g"], 1.0).first()
    pdf = wide.toPandas()
    x, y = pdf[["a", "b"]].to_numpy(), pdf["ref"].to_numpy()
    xc = x - x.mean(axis=0)
    w = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ (y - y.mean()))
    assert r.coef == pytest.approx(w) and r.intercept == pytest.approx(y.mean() - x.mean(axis=0) @ w)


def test_two_stage_correction_improves(spark, cells):
    rng = np.random.default_rng(8)
    rows = [(day(i), c, float(max(0.0, rng.gamma(0.6, 6) - 2))) for i in range(60) for c in range(12)]
    ref = spark.createDataFrame(rows, CUBE)
    biased = ref.withColumn("value", F.when(F.col("value") > 0, F.col("value") * 1.4 + 1).otherwise(F.lit(0.0)))
    cfg = learn.TwoStageConfig(wet_inclusive=False, trees=10, depth=6, least=100)
    assert learn.TwoStageConfig.from_json(cfg.to_json()) == cfg
    better = learn.correct_product(biased.where("month(time) = 1"), ref, cells, cfg=cfg)
    err = lambda d: d.join(ref.withColumnRenamed("value", "y"), ["time", "cell_id"]).agg(F.avg(F.abs(F.col("value") - F.col("y")))).first()[0]
    assert err(better) < 0.6 * err(biased.where("month(time) = 1")) and better.where("value < 0").count() == 0
    few = learn.correct_product(biased.limit(5), ref, cells, cfg=cfg, constrain=False)
    assert sorted(r.value for r in few.collect()) == sorted(r.value for r in biased.limit(5).collect())


def test_standardised_rows_are_fitted_by_cell(spark):
    """Against a fit of each cell by itself; zeros and cells with under ten values are NULL."""
    import numpy as np

    from rainframe.functions import special
    from rainframe.operators import drought

    rng = np.random.default_rng(4)
    rows = [(c, m, float(x)) for c in range(6) for m, x in enumerate(rng.gamma(0.5 + c, 3, 9 if c == 5 else 60))]
    rows += [(0, 100, 0.0), (0, 101, None)]
    df = spark.createDataFrame(rows, "cell_id long, time int, value double").repartition(3)
    got = {(r.cell_id, r.time): r.value for r in drought.standardised(df).collect()}
    for c in range(5):
        x = np.array([v for k, m, v in rows if k == c and v])
        a, b = special.gamma_fit([x.mean()], [np.log(x).mean()])
        want = special.normal_quantile(special.gamma_cdf(a[0], x / b[0]))
        assert np.allclose([got[c, m] for m in range(60)], want, atol=1e-9)
    assert got[0, 100] is None and got[0, 101] is None and all(got[5, m] is None for m in range(9))
    flat = {(r.cell_id, r.time): r.value for r in drought.standardised(df, distribution="normal").collect()}
    x = np.array([v for k, m, v in rows if k == 1])
    assert np.allclose([flat[1, m] for m in range(60)], (x - x.mean()) / x.std(ddof=1))


def test_correction_needs_the_reference_at_all_times(spark):
    import pytest

    from rainframe.operators import learn

    p = spark.createDataFrame([("2001-01-01", 1, 1.0), ("2001-01-02", 1, 1.0)], "time string, cell_id long, value double")
    with pytest.raises(KeyError, match="2001-01-02"):
        learn.correct_product(p, p.where("time = '2001-01-01'"), spark.createDataFrame([(1, 0.0, 0.0)], "cell_id long, lat double, lon double"))


def test_extremes_together_are_those_apart(spark):
    import datetime as dt

    from rainframe.operators import extremes

    rows = [(c, dt.datetime(2001, 1, 1) + dt.timedelta(days=d), float((d * 7 + c * 3) % 40)) for c in range(2) for d in range(500)]
    pr = spark.createDataFrame(rows, "cell_id long, time timestamp_ntz, value double")
    together = {(r.cell_id, r.year): r for r in extremes.compute(pr, params={"cdd": {"dry_threshold": 20.0}, "rx5day": {"window": 3}}).collect()}
    apart = {(r.cell_id, r.year): r for r in extremes.compute(pr, params={"cdd": {"dry_threshold": 20.0}, "rx5day": {"window": 3}, "rx1day": {"freq": "year"}}).collect()}
    assert together == apart and len(together) == 4
