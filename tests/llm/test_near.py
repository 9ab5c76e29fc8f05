from rainframe.llm import decontaminate


def test_near_ends_with_the_text(spark):
    docs = spark.createDataFrame([(1, "x alpha"), (2, "beta y"), (3, "alpha z beta")], "doc_id long, text string").coalesce(1)
    got = decontaminate.find_near(docs, {"p": "alpha beta"}, slop=2).collect()
    assert [(r.id, r.first, r.last) for r in got] == [(3, 0, 2)]
