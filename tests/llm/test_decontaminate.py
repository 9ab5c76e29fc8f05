import hashlib
import re

import pytest

from rainframe.llm import decontaminate

ITEM = "item_id long, text string, id string"


def words(t):
    low = (t or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    for d, t in docs:
        w = words(t)
        hit, found, near = [False] * len(w), set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in wins:
                    hit[k : k + size] = [True] * size
                    found |= wins[tuple(w[k : k + size])]
            for k in range(len(w) - size):
                for g in range(1, size):
                    near |= wins.get(tuple(w[k : k + g] + w[k + g + 1 : k + size + 1]), set())
        yield d, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w), len(found | near)


@pytest.fixture(scope="module")
def items(corpus):
    texts = [r[1] for r in corpus if r[1] and len(words(r[1])) > 15]
    spread = words(texts[2])[:30]
    return [(10, texts[0]), (9, " ".join(words(texts[3])[4:24]).upper()), (2, " ".join(words(texts[5])[:5])), (3, None), (4, " .. "), (5, "never found phrase"), (2, texts[8]), (6, "a b a b"), (7, "ing"), (8, " ".join(spread[:9] + spread[10:])), (11, "one three"), (12, "negative id")]


@pytest.mark.parametrize("block_words,segment_bytes", [(10**6, 4 << 20), (20, 500)])
def test_matches_brute_force(spark, docs, corpus, items, block_words, segment_bytes):
    bench = spark.createDataFrame([(*i, "x") for i in items], ITEM)
    if block_words < 100:
        assert decontaminate.block_count(bench, block_words) > 5
    found = decontaminate.find_contamination(docs, bench, block_words=block_words, segment_bytes=segment_bytes)
    got = [(r.id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated, r.n_near) for r in found.collect()]
    want = sorted(brute([r[:2] for r in corpus], items))
    assert sorted(got) == want
    assert any(w[5] for w in want) and any(w[6] > w[3] for w in want)


def test_query_and_clean(spark, docs, corpus, items):
    bench = spark.createDataFrame([(*i, "x") for i in items], ITEM)
    want = sorted(brute([r[:2] for r in corpus], items))
    assert sorted(map(tuple, decontaminate.digests(docs, bench).collect())) == want
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(w[0] for w in want if not w[5])


def test_stored_index_answers_again(spark, docs):
    index = decontaminate.build_index(docs)
    for item in ("one two", "seven one"):
        found = decontaminate.find_hits(index, [("x", item.encode().split())], 2).collect()
        assert [r["items"] for r in found] == [["x"]]
    assert index.where("term is not null").select("term").distinct().count() > 100


def test_rows_without_or_with_the_same_id_are_judged_each(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta", "r"), (1, "quite another text here", "r"), (None, "alpha beta gamma delta", "r"), (None, "one more unlike text", "r"), (None, None, "r")], "doc_id long, text string, key string")
    bench = spark.createDataFrame([(1, "beta gamma")], "item_id long, text string")
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns
    assert sorted(map(repr, (tuple(r) for r in left.collect()))) == sorted(map(repr, [(1, "quite another text here", "r"), (None, "one more unlike text", "r"), (None, None, "r")]))


@pytest.mark.parametrize("name", ["_bad", "_row", "row", "key", "id", "seg", "i", "items", "term"])
def test_clashing_columns(spark, name):
    docs = spark.createDataFrame([(1, "alpha beta", 7), (2, "gamma", 8)], f"doc_id long, text string, `{name}` long")
    bench = spark.createDataFrame([(1, "beta")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.clean(docs, bench).collect()] == [(2, "gamma", 8)]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "the red fox jumps over the lazy dog"), (2, "red x y fox dog"), (3, "fox red dog"), (4, None)], "doc_id long, text string")
    at = lambda slop: sorted((r.id, r.phrase, r.first, r.last) for r in decontaminate.find_near(docs, {"p": "Red fox", "q": "fox dog"}, slop).collect())
    assert at(0) == [(1, "p", 1, 2), (2, "q", 3, 4)]
    assert at(1) == [(1, "p", 1, 2), (2, "q", 3, 4), (3, "q", 0, 2)]
    assert at(5) == [(1, "p", 1, 2), (1, "q", 2, 7), (2, "p", 0, 3), (2, "q", 3, 4), (3, "q", 0, 2)]


def test_empty_tables(spark, docs, nothing):
    none = spark.createDataFrame([], ITEM)
    assert decontaminate.digests(nothing, none).count() == 0
    assert decontaminate.digests(docs, none).where("n_hit != 0 or contaminated").count() == 0


def test_a_search_reads_ranges_of_the_lists(spark, docs):
    index = decontaminate.build_index(docs)
    terms = {b"nation", b"rain", b"the"}
    plan = decontaminate.asked_lists(index, terms)._jdf.queryExecution().executedPlan().toString()
    pushed = [line.split("]")[0] for line in plan.split("PushedFilters: [")[1:]]
    assert any("IsNull(term)" in p for p in pushed) and any("GreaterThanOrEqual(term," in p for p in pushed)
    got = decontaminate.asked_lists(index, terms).collect()
    want = index.where("term is null or term in (cast('nation' as binary), cast('rain' as binary), cast('the' as binary))").collect()
    key = lambda r: (r.seg, bytes(r.term or b""), bytes(r.places or b""), r.n_words)
    assert sorted(map(key, got)) == sorted(map(key, want)) and any(r.term for r in got)
    assert all(r.term is None for r in decontaminate.asked_lists(index, set()).collect())


def test_ranges_hold_all_terms():
    terms = sorted(str(i).encode() for i in range(1000))
    for most in (1, 7, 128, 5000):
        ranges = decontaminate.ranges_of(terms, most)
        assert len(ranges) <= most and all(any(a <= t <= b for a, b in ranges) for t in terms)
    assert decontaminate.ranges_of([]) == [] and decontaminate.ranges_of(terms[:3]) == [(t, t) for t in terms[:3]]


def test_items_by_windows_whose_words_are_there():
    items = [("a", b"p q r s t".split()), ("b", b"q".split()), ("c", b"r s x".split()), ("d", b"p q x".split())]
    w = decontaminate.Windows(items, 3)
    assert w.items_in({b"q", b"r", b"s"}) == [0, 1] and w.items_in({b"x", b"r", b"s", b"z"}) == [2] and w.items_in(set()) == []
    assert w.items_in({b"p", b"q", b"r", b"x"}) == [0, 1, 3]
    assert decontaminate.Windows([], 3).items_in({b"q"}) == []
