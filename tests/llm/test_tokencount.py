import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rainframe.llm import tokencount
from rainframe.llm.tokens import tokenizer_path

RANKS = tokenizer_path("byte_bpe_50k.tiktoken")
SOME = st.text(alphabet="ab Z9\n'.é　st", max_size=300)


def edited(text, edits):
    for e in edits:
        at = max(0, min(e["start"], len(text)))
        text = text[:at] + e["text"] + text[min(at + e["length"], len(text)) :]
    return text


@settings(max_examples=300, deadline=None)
@given(SOME, st.lists(st.fixed_dictionaries({"start": st.integers(0, 320), "length": st.integers(0, 120), "text": st.text(alphabet="a b\n'9", max_size=8)}), max_size=4))
def test_any_edits(text, edits):
    to = tokencount.Counter.get(RANKS)
    leaf, tokencount.LEAF = tokencount.LEAF, 4
    try:
        chars, tokens, _ = tokencount.build(to, text)
        got = tokencount.apply_edits(to, text, chars, tokens, edits)
        want = edited(text, edits)
        assert got.text == want
        assert got.tokens == len(to.encoding.encode_ordinary(want)) == sum(got.leaf_tokens)
        assert sum(got.leaf_chars) == len(want)
        assert got.more == len(to.pattern.findall(want)) - len(to.pattern.findall(text))
        again = tokencount.apply_edits(to, got.text, got.leaf_chars, got.leaf_tokens, edits)
    finally:
        tokencount.LEAF = leaf
    want = edited(want, edits)
    assert again.text == want
    assert again.tokens == len(to.encoding.encode_ordinary(want))


def test_leaves_stay_small():
    to = tokencount.Counter.get(RANKS)
    text, leaves = "", ([], [])
    for n in range(60):  # each edit adds 40 pre-tokens at one place
        done = tokencount.apply_edits(to, text, *leaves, [{"start": len(text) // 2, "length": 0, "text": " word" * 40}])
        text, leaves = done.text, (done.leaf_chars, done.leaf_tokens)
        at = 0
        for size in leaves[0]:
            assert len(to.pattern.findall(text[at : at + size])) <= 2 * tokencount.LEAF
            at += size
        assert done.remade < 50
    assert sum(leaves[1]) == len(to.encoding.encode_ordinary(text))
    assert len(leaves[0]) >= 60 * 40 // (2 * tokencount.LEAF)


def test_query_matches_full_count(docs):
    to = tokencount.Counter.get(RANKS)
    rows = docs.select("doc_id", "text", tokencount.sample_edits().alias("edits")).collect()
    want = sorted((r.doc_id, 3, len(to.encoding.encode_ordinary(r.text or "")), len(to.encoding.encode_ordinary(edited(r.text or "", [e.asDict() for e in r.edits])))) for r in rows)
    got = tokencount.digests(docs).collect()
    assert sorted((r.doc_id, r.n_edits, r.n_tokens_before, r.n_tokens_after) for r in got) == want
    long = max(got, key=lambda r: r.n_pieces)
    assert long.n_remade < 40 < long.n_pieces  # only what the edits touch


def test_edit_tables_and_stored_trees(spark, docs, tmp_path):
    tokencount.build_trees(docs.select("doc_id", "text").where("doc_id between 8 and 90")).write.parquet(str(tmp_path / "trees"))
    rng = random.Random(1)
    rows = [(i, s, rng.randint(0, 400), rng.randint(0, 30), rng.choice(["", "new words", " x"])) for i in range(8, 60) for s in range(3)]
    edits = tokencount.gather_edits(spark.createDataFrame(rows, "doc_id long, seq int, start long, length long, text string"))
    got = tokencount.recount(spark.read.parquet(str(tmp_path / "trees")).join(edits, "doc_id", "left")).collect()
    to = tokencount.Counter.get(RANKS)
    assert len(got) == 83
    assert all(r.n_tokens_after == len(to.encoding.encode_ordinary(r.text)) for r in got)
    assert {r.id for r in got if r.n_edits == 3} == set(range(8, 60))


def test_second_round_over_stored_trees(spark, docs, tmp_path):
    first = tokencount.recount(tokencount.build_trees(docs.select("doc_id", "text", tokencount.sample_edits().alias("edits"))))
    first.select("id", "text", "tree.*").write.parquet(str(tmp_path / "first"))
    stored = spark.read.parquet(str(tmp_path / "first"))
    second = tokencount.recount(stored.withColumn("edits", tokencount.sample_edits()), id_col="id").collect()
    to = tokencount.Counter.get(RANKS)
    assert len(second) == docs.count()
    for r in second:
        pieces = to.pattern.findall(r.text)
        assert r.n_tokens_after == r.tree.n_tokens == sum(r.tree.leaf_tokens) == len(to.encoding.encode_ordinary(r.text))
        assert (r.tree.n_chars, sum(r.tree.leaf_chars), r.tree.n_pieces) == (len(r.text), len(r.text), len(pieces))


def test_empty_table(nothing):
    assert tokencount.digests(nothing).count() == 0


def test_null_edits(docs):
    got = tokencount.recount(tokencount.build_trees(docs.select("doc_id", "text", F.lit(None).cast("array<struct<start:bigint,length:bigint,text:string>>").alias("edits"))))
    assert got.where("n_tokens_before != n_tokens_after or n_edits != 0").count() == 0
