"""The pipeline's near-dedup stage: a similarity of 0.8 on five words, and rows decided one by one."""

import random
import time

import pytest

import corpus_pipeline
from rainframe.llm import decontaminate, simhash
from rainframe.llm.shared import CLEANED, materialize, written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / max(1, len(x | y))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def test_copies_with_changed_words_go(spark):
    """Ten groups of 200 words with copies that differ in one to three words; of unlike ones all stay."""
    rng, rows = random.Random(3), []
    for g in range(10):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        rows.append((100 * g, " ".join(words)))
        for c in range(1, 5):
            copy = list(words)
            for at in rng.sample(range(200), min(c, 3)):
                copy[at] = f"x{rng.randrange(10**6)}"
            rows.append((100 * g + c, " ".join(copy)))
        rows.append((100 * g + 50, " ".join(words[:100] + [f"y{rng.randrange(10**6)}" for _ in range(100)])))
    assert all(jaccard(rows[0][1], t) >= 0.8 for _, t in rows[1:5]) and jaccard(rows[0][1], rows[5][1]) < 0.8
    kept = {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, frame(spark, rows), "").collect()}
    assert kept == {100 * g + k for g in range(10) for k in (0, 50)}


def test_blocks_change_nothing(spark):
    """A group of many near copies, compared in pairs of small blocks."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(i, " ".join(words[:i] + [f"x{i}"] + words[i + 1 :])) for i in range(60)]
    assert [r.doc_id for r in simhash.keep_one_similar(frame(spark, rows), block=7, budget=20).collect()] == [0]


def test_two_families_and_stragglers_of_one_group(spark):
    """What blocks leave open is compared with all: families far apart, and texts linked by a single other."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    other = base[:60] + [f"z{rng.randrange(10**6)}" for _ in range(40)]
    def near(words, n):
        at = rng.sample(range(100), n)
        return " ".join(f"x{rng.randrange(10**6)}" if i in at else w for i, w in enumerate(words))
    texts = [near(base, 1) for _ in range(30)] + [near(other, 1) for _ in range(30)]
    chain = texts[0].split()
    for k in range(8):  # each like the one before, ever less like the first
        chain = chain[: 10 * k] + [f"c{rng.randrange(10**6)}"] + chain[10 * k + 1 :]
        texts.append(" ".join(chain))
    rows = [(1, i, len(texts), t) for i, t in enumerate(texts)]
    links = simhash.similar_links(spark.createDataFrame(rows, "root long, th long, n long, text string"), 9, 5, 80)
    got = {r.node: r.root for r in simhash.components(links).collect()}
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert [got.get(i, i) for i in range(len(texts))] == [find(i) for i in range(len(texts))] and 1 < len({find(i) for i in range(len(texts))}) < 10


def test_hot_nodes_go_down(spark):
    """Fingerprints in a few tight balls are dealt to small cells, and chains in them still connect each ball."""
    import numpy as np

    rng = random.Random(8)
    centres = [rng.getrandbits(64) for _ in range(3)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(400)})
    rows = [(i, int(np.uint64(f).view(np.int64)), 7) for i, f in enumerate(fps)]
    cells = simhash.deal(spark.createDataFrame(rows, "th long, fp long, sk long"), len(rows), per_cell=16, leaf=32)
    assert cells.groupBy("t", "level", "cell").count().where("count > 32").isEmpty()
    links = cells.repartition("t", "level", "cell").sortWithinPartitions("t", "level", "cell").mapInArrow(lambda it: simhash._linked(it, 12), "a long, b long")
    got = {r.node: r.root for r in simhash.components(links).collect()}
    ball = [min(range(3), key=lambda c: (centres[c] ^ f).bit_count()) for f in fps]
    assert len({(ball[i], got[i]) for i in range(len(fps))}) == 3


@pytest.mark.parametrize("name", ["_stay", "_k1", "row", "key", "k", "id", "th", "n", "stays"])
def test_clashing_columns(spark, name):
    docs = spark.createDataFrame([(1, texts("a"), 7), (2, texts("a"), 8), (3, texts("b"), 9), (3, texts("b"), 9)], f"doc_id long, text string, `{name}` long")
    for keep in (simhash.keep_one, simhash.keep_one_similar):
        assert sorted((r[0], r[2]) for r in keep(docs).collect()) == [(1, 7), (3, 9)]


def test_empty_table(spark):
    assert simhash.keep_one_similar(frame(spark, [])).count() == 0


def test_similarity_is_exact():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(80)]
    i, j = simhash.similar([simhash.shingles(t.encode()) for t in texts], columns=3)
    want = {(a, b) for b in range(80) for a in range(b) if texts[a] and texts[b] and jaccard(texts[a], texts[b]) >= 0.8}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_large_budgets_find_all_pairs():
    import numpy as np

    rng = np.random.default_rng(1)
    v = np.unique(rng.integers(0, 2**63, 1500).astype(np.uint64) & np.uint64(0xFFFFFFFF0000FFFF))
    got = {tuple(sorted(p)) for i, j in simhash.walk(v, [np.array([x]) for x in (0, 0, len(v), 0, len(v), 0)], 12) for p in zip(i.tolist(), j.tolist())}
    i, j = np.nonzero(np.triu(np.bitwise_count(v[:, None] ^ v[None]) <= 12, 1))
    assert got == set(zip(i.tolist(), j.tolist())) and len(got) > 20


ODD = [(None, "a"), (None, "b"), (None, "c"), (1, "d"), (1, "e"), (2, "f")]


def texts(seed):
    return " ".join(f"{seed}{k}" for k in range(60))


def test_null_and_repeated_ids_are_rows_of_their_own(spark):
    rows = [(i, texts(s)) for i, s in ODD] + [(9, texts("a")), (2, texts("f"))]
    want = sorted([(9, texts("a"))] + [(i, texts(s)) for i, s in ODD[1:]], key=str)
    for keep in (simhash.keep_one, simhash.keep_one_similar):
        assert sorted(((r.doc_id, r.text) for r in keep(frame(spark, rows)).collect()), key=str) == want


def test_one_contaminated_row_takes_no_other(spark):
    bench = spark.createDataFrame([(1, texts("b")), (2, texts("d"))], "item_id long, text string")
    kept = decontaminate.clean(frame(spark, [(i, texts(s)) for i, s in ODD]), bench).collect()
    assert sorted((r.text for r in kept)) == [texts(s) for s in "acef"]


def test_no_pair_is_left_out(spark):
    """Short texts, of which fingerprints differ in many bits, that have the similarity: each pair becomes one."""
    rng, rows = random.Random(12), []
    for g in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(8, 30))]
        n = len(words) - 4
        more = [f"x{rng.randrange(10**6)}" for _ in range(n // 4)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(more + words))]
        assert n < 4 or jaccard(rows[-1][1], rows[-2][1]) >= 0.8
    assert [r.doc_id for r in simhash.keep_one_similar(frame(spark, rows)).orderBy("doc_id").collect()] == list(range(0, 300, 2))


def test_signatures_miss_no_similar_pair():
    import numpy as np

    rng = np.random.default_rng(3)
    hashes = lambda n: simhash.mix(rng.integers(0, 2**63, n).astype(np.uint64))
    seen = 0
    for percent in (60, 80, 95):
        for _ in range(3000):
            n = int(rng.choice([1, 2, 3, 4, 5, 8, 10, 15, 20, 30, 60, 200]))
            base, most = hashes(n), max(1, n * (100 - percent) // percent)
            x, y = (np.unique(np.r_[base, hashes(int(rng.integers(0, most + 1)))]) for _ in range(2))
            both = len(np.intersect1d(x, y))
            if 100 * both >= percent * (len(x) + len(y) - both):
                seen += 1
                assert len(np.intersect1d(simhash.signatures(x, percent), simhash.signatures(y, percent)))
                assert simhash.may_be_similar(simhash.spread(x), simhash.spread(y), len(x) + len(y), percent)
    assert seen > 3000


def test_shared_signatures_over_batches(spark):
    """Runs of equal signatures that go over many batches, with repeated rows."""
    rng = random.Random(2)
    rows = [(rng.randrange(40) ** 2 // 40, rng.randrange(60)) for _ in range(900)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = [tuple(r) for r in simhash.shared_signatures(spark.createDataFrame(rows + [(99, 1)] * 9, "sig long, th long")).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    held = {s: {t for k, t in rows if k == s} for s, _ in rows}
    assert sorted(got) == sorted((s, t) for s, ts in held.items() if len(ts) > 1 for t in ts)


def passages(n, seed=5):
    """Texts of which half is a passage that all have, a pair of near copies among them, and a text of the passage and little else."""
    rng = random.Random(seed)
    words = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    common = words(60)
    rows = [words(rng.randint(30, 60)) + common + words(5) for _ in range(n)]
    rows += [rows[3][:-2], common + words(5), common + words(9)]
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_a_common_passage_makes_no_pairs(spark, monkeypatch):
    """Pairs that are compared don't grow with the square of the texts that share a passage, nor of a family whose copies are far apart in bits."""
    made, sharing = [], simhash.sharing
    monkeypatch.setattr(simhash, "sharing", lambda rows, *a: made.append(sharing(rows, *a).count()) or sharing(rows, *a))
    rows = passages(150)
    kept = [r.doc_id for r in simhash.keep_one_similar(frame(spark, rows)).orderBy("doc_id").collect()]
    out = {j for i, x in rows for j, y in rows if i < j and jaccard(x, y) >= 0.8}
    assert kept == [i for i, _ in rows if i not in out] and out == {150, 152}
    assert sum(made) < 20
    made.clear()
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(40)]
    rows = [(i, " ".join([*base[i % 4 :], f"x{i}"])) for i in range(100)]
    kept = [r.doc_id for r in simhash.keep_one_similar(frame(spark, rows), budget=0).collect()]  # the tries link none of them
    assert kept == [0] and 0 < sum(made) < 20 * len(rows)


def test_texts_are_spread_over_the_tries_once(spark):
    """However many levels of nodes are too full, the dealt rows come from one explode; and each text is once in each trie."""
    rows = [(i, (i % 3) << 61 | i, 7) for i in range(600)]
    cells = simhash.deal(spark.createDataFrame(rows, "th long, fp long, sk long"), len(rows), per_cell=16, leaf=32, step=4)
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.lstrip(" :+-").startswith("Generate ") for line in plan.splitlines()) == 1
    assert cells.agg({"level": "max"}).first()[0] > 1
    assert cells.count() == cells.select("t", "th").distinct().count() == 600 * (cells.agg({"t": "max"}).first()[0] + 1)


def test_stars_take_no_further_round(spark):
    edges = spark.createDataFrame([(i, i % 5) for i in range(5, 60)] + [(7, 7)], "a long, b long")
    begin = written()
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: i % 5 for i in range(60)} and written() == begin + 1


def test_written_tables_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {str(disk.getAllFiles().apply(i)) for i in range(disk.getAllFiles().size())}
    before = files()
    materialize(spark.range(1000, numPartitions=4).selectExpr("id % 10 as k").groupBy("k").count(), "test")
    until = time.time() + 20
    while (left := {f for f in files() - before if "shuffle_" in f}) and time.time() < until:
        time.sleep(0.2)
    assert not left and spark.conf.get(CLEANED) == "false"
