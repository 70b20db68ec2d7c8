"""Matching by content with many copies: equal to a scan of all pairs, and without a round for each copy."""

import random

import pytest
from pyspark.sql import functions as F

from pagetwin.operators.assign import assign_classes
from pagetwin.operators.pairing import moved_pages
from pagetwin.session import Scratch

DDL = "key string, title string, full_text string, ord long"


def scan(edges):
    ua, ub, want = set(), set(), set()
    for s, a, b in sorted(edges):
        if a not in ua and b not in ub:
            ua.add(a), ub.add(b), want.add((a, b, -s))
    return want


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_assignment_of_classes_equals_a_scan(spark, seed):
    rng = random.Random(seed)
    members = [(side, k, k, rng.randrange(10)) for side in "ab" for k in rng.sample(range(100), 40)]
    edges = [(x, y, rng.choice([0.6, 0.7, 1.0])) for x in range(10) for y in range(10) if rng.random() < 0.2]
    in_class = lambda side, c: [m[1] for m in members if m[0] == side and m[3] == c]
    want = scan([(-s, a, b) for x, y, s in edges for a in in_class("a", x) for b in in_class("b", y)])
    got = assign_classes(spark.createDataFrame(members, "side string, key long, ord long, c long"), spark.createDataFrame(edges, "x long, y long, similarity double"), Scratch(spark, "t"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and want


def test_moved_pages_equal_a_scan(spark):
    rng = random.Random(7)
    base = [" ".join(rng.choice("abcdefghij") for _ in range(30)) for _ in range(4)]

    def near(t):
        w = t.split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice("kl")
        return " ".join(w)

    a, b = ([(f"{s}{i}", rng.choice(["", "T", None]), near(rng.choice(base)) if i else "", n) for i, n in enumerate(rng.sample(range(99), 20))] for s in "ab")
    sh = lambda t: {tuple(t.split()[k : k + 3]) for k in range(28)}
    edges = []
    for ka, ta, x, oa in a[1:]:
        for kb, tb, y, ob in b[1:]:
            s = len(sh(x) & sh(y)) / len(sh(x) | sh(y))
            s = min(1.0, s + 0.15) if ta and ta == tb else s
            edges += [(-s, (oa, ka), (ob, kb))] * (s >= 0.6)
    want = {(x[1], y[1], s) for x, y, s in scan(edges)}
    got = moved_pages(spark.createDataFrame(a, DDL), spark.createDataFrame(b, DDL), 0.6, Scratch(spark, "t"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and want


def test_copies_take_no_rounds_of_their_own(spark):
    """600 copies on each side: a round for each of them, as before, would write 1,200 tables."""
    side = lambda s: spark.range(600).select(F.concat(F.lit(s), F.col("id").cast("string")).alias("key"), F.lit("").alias("title"), F.lit("the very same words on every page").alias("full_text"), F.col("id").alias("ord"))
    scratch = Scratch(spark, "t")
    got = moved_pages(side("a"), side("b"), 0.6, scratch)
    assert {(r["a"][1:], r["b"][1:]) for r in got.collect()} == {(str(k), str(k)) for k in range(600)} and scratch._n < 30


def test_nothing_alike(spark):
    a, b = (spark.createDataFrame([(t, None, t, 0)], DDL) for t in ("some words here", "none of these"))
    assert moved_pages(a, b, 0.6, Scratch(spark, "t")).count() == 0
