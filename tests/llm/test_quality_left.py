import pytest

from rainframe.llm import quality

SCHEMA = "row long, lang string, source string, base_failed boolean, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


@pytest.mark.parametrize("lang", ["en", "xx", ""])
def test_small_groups_left_over_are_judged(spark, lang):
    """Ten junk rows of a rare source, or of a rare language, beside a big group."""
    rows = [(i, "en", "big", False, 150 + i % 90, 5 * (150 + i % 90), 0, 0, 0, 5) for i in range(300)]
    rows += [(1000 + i, lang, "rare", False, 200, 200 * 60, 1600, 0, 0, 5) for i in range(10)]
    got = {r.row: r for r in quality.outliers(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 310 and all(r.d2 is not None for r in got.values())
    assert {i for i, r in got.items() if r.outlier} == set(range(1000, 1010))


def test_a_small_table_is_judged(spark):
    rows = [(i, "en", "s", False, 150 + i, 5 * (150 + i), 0, 0, 0, 5) for i in range(30)]
    got = quality.outliers(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 30 and not any(r.d2 is None or r.outlier for r in got)
