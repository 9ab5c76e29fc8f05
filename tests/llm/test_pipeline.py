import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from rainframe.llm import langid
from rainframe.llm.tokens import tokenizer_path

from rainframe.llm.simhash import row_key

from .test_decontaminate import brute as contaminated
from .test_similar import jaccard

COLUMNS = corpus_pipeline.COLUMNS
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def one_of_each_group(spark, rows):
    """Of rows that chains of similar texts connect the one with the least row key; texts of the same words are linked."""
    keys = [tuple(r.k) for r in spark.createDataFrame(rows, SCHEMA).coalesce(1).select(row_key("doc_id", "text").alias("k")).collect()]
    words = [" ".join((r[1] or "").lower().split(None)) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if words[i] == words[j] or jaccard(words[i], words[j]) >= 0.8:
                root[find(i)] = find(j)
    best = {}
    for i, k in enumerate(keys):
        best.setdefault(find(i), []).append((k, i))
    return [rows[i] for i in sorted(min(x, key=lambda y: (y[0][0], y[0][1] or 0, *y[0][2:]))[1] for x in best.values())]


def cut(rows, k=35):
    texts = [(r[1] or "").encode().split() for r in rows]
    times = Counter(tuple(w[i : i + k]) for w in texts for i in range(len(w) - k + 1))
    for r, w in zip(rows, texts):
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if times[tuple(w[j : j + k])] > 1:
                gone[j : j + k] = [True] * k
        if not any(gone):
            yield tuple(r)
        elif not all(gone):
            text = b" ".join(x for x, g in zip(w, gone) if not g).decode()
            yield (r[0], text, r[2], r[3], len(text))


def test_run_is_its_stages_by_brute_force(spark, corpus, tmp_path):
    """With null ids, and ids that unlike texts share."""
    rows = [(*r[:4], len(r[1] or "")) for r in corpus]
    rows += [(None, rows[20][1], "en", "src1", 1), (None, "quite unlike any other text " + " ".join(f"the{i}" for i in range(40)), "en", "src1", 1), (5, "a second text that shares an id " + " ".join(f"of{i}" for i in range(40)), "en", "src1", 1)]
    items = [(1, rows[50][1]), (2, rows[60][1]), (3, "nothing like it")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    model = langid.train(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    numbered = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows)], "doc_id long, text string")
    ok = {r.id for r in langid.predict(numbered, model).where("score >= 0.5").collect()}
    rows = [r for i, r in enumerate(rows) if i in ok]
    rows = one_of_each_group(spark, rows)
    rows = list(cut(rows))
    rows = [r for r, c in zip(rows, contaminated([r[:2] for r in rows], items)) if not c[5]]

    import tokenizers

    to = tokenizers.Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = defaultdict(list)
    for r in rows:
        want[r[0]].append([*to.encode(r[1], add_special_tokens=False).ids, 1])
    pieces = defaultdict(list)
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[p.doc_id].append(p)
    assert set(pieces) == set(want) and 20 < len(want) < len(corpus) - 20
    assert None in want and len(want[5]) == 2
    for d, texts in want.items():
        assert sum(p.length for p in pieces[d]) == sum(map(len, texts))
        for ids in texts if len(texts) == 1 else ():
            at = 0
            for p in sorted(pieces[d], key=lambda p: p.start):
                assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
                at += p.length
            assert at == len(ids)


def test_stages_keep_the_columns_of_documents(spark, docs, tmp_path):
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == COLUMNS, name


def test_empty_table(spark, nothing, tmp_path):
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
