import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SOME = ["scores_by_month", "detection_by_season_and_month", "detection_by_region_and_season", "all_extreme_indices", "nearest_regrid", "station_evaluation_by_product", "own_score_by_cell", "detection_rollup", "nearest_in_time", "longest_dry_spell", "spei_3", "very_wet_days_p95", "rank_by_critic_topsis", "inputs_together", "first_maps"]


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() == 12 and "RMSE" in df.columns


@pytest.mark.parametrize("name", SOME)
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "supplier", "nation", "region", "orders", "customer", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    norm = lambda v: str(v) if hasattr(v, "isoformat") else round(v, 6) if isinstance(v, float) else v
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    r = con.sql(entry.oracle_sql()[name])
    at = [r.columns.index(c) for c in cols]
    assert got == sorted((tuple(norm(x[i]) for i in at) for x in r.fetchall()), key=repr)


def test_all_sql_can_be_run():
    con = duckdb.connect()
    for t in ("lineitem", "supplier", "nation", "region", "orders", "customer", "events", "documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in entry.oracle_sql().items():
        con.execute("EXPLAIN " + sql), name


def test_sql_only_for_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
