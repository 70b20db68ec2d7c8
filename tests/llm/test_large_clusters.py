"""Large clusters of units that are alike but hardly ever linked: exact links without sending a unit to all blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetwin.llm import graph, minhash
from pagetwin.session import Scratch


def linked(a, b, spec):
    n = len(a & b)
    return spec.den * n >= spec.num * (len(a) + len(b) - n)


@pytest.mark.parametrize(("num", "block"), [(80, 16), (85, 4)])
def test_links_of_a_large_cluster(spark, num, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_UNITS", block)  # 4: shingles of several blocks
    monkeypatch.setattr(minhash, "BROADCAST_UNITS", 0 if block == 4 else 400_000)
    rng, spec, sets = random.Random(num), minhash.Spec(num=num), []
    for k in range(1500):
        # A third of each is what many have; every fifth is an edit of the last but one.
        n = rng.randint(12, 30)
        sets.append({*rng.sample(range(40), n // 3), *(10_000 + 100 * k + j for j in range(n - n // 3))})
        if k % 5 == 4:
            sets[-1] = set(sets[-3])
            for j in range(rng.randint(1, 3)):
                sets[-1].discard(rng.choice(sorted(sets[-1])))
                sets[-1] |= {10_000 + 100 * k + j} if rng.random() < 0.5 else set()
    rows = [(k, k % 2, 30, np.array(sorted(s), np.int64).tobytes()) for k, s in enumerate(sets)]
    units = spark.createDataFrame([(k, c, b, bytearray(s)) for k, c, b, s in rows], "rep long, cluster long, blocks long, set binary")
    dealt, by_group = [], minhash.by_group

    def counted(rows, keys, kernel):
        dealt.append(rows.count())
        return by_group(rows, keys, kernel)

    monkeypatch.setattr(minhash, "by_group", counted)
    links = minhash.large_links(units, spark.createDataFrame([(0,), (1,)], "rep long"), spec, Scratch(spark, "t")).collect()
    assert all(linked(sets[e["a"]], sets[e["b"]], spec) and e["a"] % 2 == e["b"] % 2 for e in links)
    want = [(j, i) for i in range(len(sets)) for j in range(i) if i % 2 == j % 2 and linked(sets[i], sets[j], spec)]
    edges = lambda e: spark.createDataFrame(e, "a long, b long")
    root = lambda e: sorted(map(tuple, graph.components(edges(e), Scratch(spark, "t")).collect()))
    assert len(want) > 100 and root([tuple(e) for e in links]) == root(want)
    # In pairs of blocks of the cluster each unit stood in dozens of places.
    assert dealt[-1] <= 2 * len(sets)


@pytest.mark.parametrize("block", [8, 30])
def test_linked_neighbours_of_a_large_cluster(spark, block, monkeypatch):
    """Links between sets of which the pivots know none."""
    monkeypatch.setattr(minhash, "BLOCK_UNITS", block)
    spec, rng = minhash.Spec(), random.Random(3)
    base = [set(rng.sample(range(1000), 25)) for _ in range(60)]
    sets = [b - set(rng.sample(sorted(b), k)) for b in base for k in range(5)]
    units = spark.createDataFrame([(k, 0, 9, bytearray(np.array(sorted(s), np.int64).tobytes())) for k, s in enumerate(sets)], "rep long, cluster long, blocks long, set binary")
    links = [tuple(e) for e in minhash.large_links(units, spark.createDataFrame([(0,)], "rep long"), spec, Scratch(spark, "t")).collect()]
    want = [(j, i) for i in range(len(sets)) for j in range(i) if linked(sets[i], sets[j], spec)]
    root = lambda e: sorted(map(tuple, graph.components(spark.createDataFrame(e, "a long, b long"), Scratch(spark, "t")).collect()))
    assert len(want) > 300 and root(links) == root(want)


def test_sizes_rule_candidates_out(spark):
    reps = spark.createDataFrame([(k, n, [5, 5], [77, k]) for k, n in enumerate([10, 20, 12, 25, 100])], "rep long, n_shingles int, bits array<long>, bands array<long>")
    found = minhash.candidate_links(reps, minhash.Spec(), Scratch(spark, "t")).select(F.least("a", "b"), F.greatest("a", "b")).collect()
    assert sorted(map(tuple, found)) == [(0, 2), (1, 3)]
