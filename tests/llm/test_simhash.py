import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rainframe.llm import simhash


def fingerprint(text):
    low = (text or "").encode().lower().split()
    grams = [b" ".join(low[i : i + 3]) for i in range(max(1, len(low) - 2))] if low else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(pairs, budget):
    """Least id reachable of (id, fingerprint)s."""
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= budget:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(pairs):
        least[find(i)] = min(d, least.get(find(i), d))
    return [least[find(i)] for i in range(len(pairs))]


def test_matches_brute_force(docs, corpus):
    pairs = [(r[0], fingerprint(r[1])) for r in corpus]
    want = sorted((d, f"{f:016x}", c) for (d, f), c in zip(pairs, brute(pairs, 2)))
    assert sorted(map(tuple, simhash.digests(docs).collect())) == want


def test_hash_is_sparks(spark, docs):
    one = docs.where(F.size(F.split("text", " ")) == 3).select("text", F.xxhash64(F.lower("text")).alias("h")).first()
    assert simhash.fingerprint(one.text.encode()) == one.h


@pytest.mark.parametrize("leaf", [4, 10**6])
@pytest.mark.parametrize("budget", [0, 2, 3])
def test_hot_nodes_are_split(spark, leaf, budget):
    """Fingerprints in a few tight balls, so that nodes at the blocks' depth hold far over `leaf`."""
    rng = random.Random(budget)
    centres = [rng.getrandbits(64) for _ in range(3)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(60)} | {rng.getrandbits(64) for _ in range(50)}
    fps = sorted(np.array(sorted(fps), np.uint64).view(np.int64).tolist())
    made = simhash.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), budget, leaf))
    got = {r.node: r.root for r in made.collect()}
    assert [got.get(f, f) for f in fps] == brute([(f, f & (1 << 64) - 1) for f in fps], budget)


def test_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_one_of_each_group_stays(docs, corpus):
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    pairs = [(r[0], fingerprint(r[1])) for r in corpus]
    assert sorted(kept) == sorted(set(brute(pairs, 2)))
    assert simhash.keep_one(docs).columns == docs.columns


def test_empty_table(nothing):
    assert simhash.digests(nothing).count() == 0
