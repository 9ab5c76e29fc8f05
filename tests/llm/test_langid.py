import itertools

import numpy as np
import pytest

from rainframe.llm import langid

DATA = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def model(spark):
    return langid.train(spark.read.parquet(DATA), per_lang=150, epochs=4)


def test_forward_backward_sums_over_all_paths():
    rng = np.random.default_rng(0)
    emit, move = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3))
    mask = np.array([[True] * 4, [True, True, False, False]])
    post, log_z, moved = langid.posteriors(emit, mask, move, pairs=True)
    total, pairs = 0.0, np.zeros((3, 3))
    for b, n in enumerate((4, 2)):
        paths = list(itertools.product(range(3), repeat=n))
        w = np.exp([sum(emit[b, i, y] for i, y in enumerate(p)) + sum(move[a, c] for a, c in zip(p, p[1:])) for p in paths])
        total += np.log(w.sum())
        want = np.zeros((n, 3))
        for p, x in zip(paths, w / w.sum()):
            for i, y in enumerate(p):
                want[i, y] += x
            for a, c in zip(p, p[1:]):
                pairs[a, c] += x
        assert np.allclose(post[b, :n], want)
    assert np.isclose(log_z, total) and np.allclose(moved, pairs)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA)
    got = langid.digests(docs).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out and n_chars > 40").collect()
    assert len(got) > 150
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_code_switched_words(spark, model):
    texts = {r.lang: r.text for r in spark.read.parquet(DATA).where("length(text) > 900 and doc_id % 7 = 3").select("lang", "text").collect()}
    one, two = sorted(texts)[:2]
    a, b = (langid.WORD.findall(texts[k].lower())[:80] for k in (one, two))
    mixed = spark.createDataFrame([(1, " ".join([*a, *b]))], "doc_id long, text string")
    r = langid.label_words(mixed, model).first()
    assert r.words == [*a, *b]
    assert np.mean([x == y for x, y in zip(r.labels, [one] * len(a) + [two] * len(b))]) > 0.9


def test_long_texts_do_not_depend_on_the_batch(model):
    texts = ["the thing with " * 30, None, "größe und " * 500, "12 !", "of"]
    alone = [next(iter(langid.label(model, [t])))[0] for t in texts]
    together = [p for p, _ in langid.label(model, texts)]
    assert all(np.allclose(x, y) for x, y in zip(alone, together))


def test_defined_cases(spark, docs, corpus, model, nothing):
    got = langid.predict(docs, model).collect()
    assert len(got) == len(corpus)
    und = {r[0] for r in corpus if not any(map(str.isalpha, r[1] or ""))}
    assert {r.id for r in got if r.lang_pred == "und"} == und and {r.score for r in got if r.lang_pred == "und"} == {0.0}
    assert {r.lang_pred for r in got} <= {"und", *model.langs}
    assert langid.digests(nothing).count() == 0
    assert {r.lang_pred for r in langid.digests(docs.withColumn("lang", docs.lang.substr(9, 1)).replace("", None)).collect()} == {"und"}
    kept = langid.keep_known(docs, 0.0)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()}.isdisjoint(und - {3, 7})


def test_null_and_repeated_ids_are_learned_from(spark):
    """Half of the rows have no id, half the same one."""
    words = {"en": "the nation with thing of rain", "de": "der und keit schatz für größe"}
    rows = [(None if i % 2 else 7, f"{words[lang]} {i}", lang) for lang in words for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.windows(docs, 100, 4, 40, 200, "doc_id", "text", "lang")
    assert 100 < len(got) < 400 and {x for x, _ in got} == {"de", "en"}
    alike = spark.createDataFrame([(1, words["en"], "en")] * 3000 + [(2, words["de"], "de")] * 3000, docs.schema)
    assert len(langid.windows(alike, 50, 4, 40, 200, "doc_id", "text", "lang")) <= 2 * 2 * 50 * 4
    dirty = spark.createDataFrame([(i, "word and word", f"l{i}") for i in range(300)], docs.schema)
    assert len({x for x, _ in langid.windows(dirty, 50, 4, 40, 20, "doc_id", "text", "lang")}) <= 20
