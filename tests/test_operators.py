import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagetwin.config import build_config
from pagetwin.operators.align import align, common, word_diff
from pagetwin.operators.assign import assign_greedy
from pagetwin.operators.crawl import robots_allow, sitemap_urls
from pagetwin.operators.diffs import broken, form_rows, kth_match, pair_forms
from pagetwin.operators.pairing import similar_pages
from pagetwin.session import Scratch

CFG = build_config()
LISTS = st.lists(st.sampled_from("abcdef"), max_size=12)


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=200, deadline=None)
@given(LISTS, LISTS)
def test_common_is_a_longest_subsequence(a, b):
    p = common(a, b)
    assert len(p) == lcs(a, b) and all(a[i] == b[j] for i, j in p)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(p, p[1:]))


@settings(max_examples=200, deadline=None)
@given(LISTS, LISTS)
def test_align_uses_every_item_once(a, b):
    ops = align(a, b, a, b, 0.45)
    pairs = [(o.a, o.b) for o in ops if o.kind in ("pair", "moved")]
    left = {o.a for o in ops if o.a is not None}
    assert len(left) == sum(o.a is not None for o in ops)
    assert all(a[i] == b[j] for i, j in pairs)
    assert not align(a, a, a, a, 0.45)


def test_align_example():
    a = ["Intro text here", "Price is $10 per month", "Old paragraph gone", "Footer note"]
    b = ["Footer note", "Intro text here", "Price is $12 per month", "Brand new paragraph about widgets"]
    ops = align(a, b, [x.lower() for x in a], [x.lower() for x in b], 0.45)
    assert sorted(o.kind for o in ops) == ["added", "missing", "moved", "pair"]
    assert next(b[o.b] for o in ops if o.kind == "pair") == "Price is $12 per month"


def test_forced_pair_and_cross_regions():
    assert [o.kind for o in align(["x"], ["y"], ["x"], ["y"], 0.45, lambda i, j: True)] == ["pair"]
    a, b = ["one two three four", "K"], ["K", "one two three five"]
    assert [o.kind for o in align(a, b, a, b, 0.45)] == ["pair"]


@settings(max_examples=100, deadline=None)
@given(st.text("ab ,.", max_size=20), st.text("ab ,.", max_size=20))
def test_word_diff_rebuilds_both(a, b):
    d = word_diff(a, b)
    assert "".join(t for k, t in d if k != "added") == a and "".join(t for k, t in d if k != "removed") == b


@pytest.mark.parametrize("seed", [1, 2])
def test_assignment_equals_a_scan(spark, seed):
    rng = random.Random(seed)
    edges = [(a, b, round(rng.random(), 1)) for a in range(8) for b in range(8) if rng.random() < 0.5]
    got = assign_greedy(spark.createDataFrame(edges, "a int, b int, s double"), [(-F.col("s")).alias("k"), "a", "b"], Scratch(spark, "t"))
    ua, ub, want = set(), set(), set()
    for a, b, s in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if a not in ua and b not in ub:
            ua.add(a), ub.add(b), want.add((a, b, s))
    assert {tuple(r) for r in got.collect()} == want


def test_similar_pages_equals_all_pairs(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghij") for _ in range(30)) for _ in range(4)]
    def near(t):
        w = t.split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice("klm")
        return " ".join(w)
    a = [(f"a{i}", rng.choice(["", "T"]), near(rng.choice(base))) for i in range(12)] + [("a-", "", "")]
    b = [(f"b{i}", rng.choice(["", "T"]), near(rng.choice(base))) for i in range(12)]
    def sh(t):
        w = t.split()
        return {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    want = set()
    for ka, ta, x in a:
        for kb, tb, y in b:
            u = sh(x) | sh(y)
            s = len(sh(x) & sh(y)) / len(u) if sh(x) and sh(y) else 0
            s = min(1, s + 0.15) if ta and ta == tb else s
            if s >= 0.6 and sh(x) and sh(y):
                want.add((ka, kb, round(s, 6)))
    ddl = "key string, title string, full_text string"
    got = similar_pages(spark.createDataFrame(a, ddl), spark.createDataFrame(b, ddl), 0.6, Scratch(spark, "t"))
    assert {(r["a"], r["b"], round(r["similarity"], 6)) for r in got.collect()} == want and want


def test_kth_match_is_first_unused(spark):
    ddl = "path string, pos int, label string"
    a = spark.createDataFrame([("p", 0, "x"), ("p", 1, "x"), ("p", 2, "y")], ddl)
    b = spark.createDataFrame([("p", 0, "y"), ("p", 1, "x"), ("q", 2, "x")], ddl)
    assert sorted(tuple(r) for r in kth_match(a, b, "label").collect()) == [("p", 0, 1), ("p", 2, 0)]


def form(action, names, method="get", **kw):
    fields = [{"name": n, "type": "text", "required": False, "label": n, "match_name": n.lower(), "label_norm": n, "label_cos": n.lower()} | kw for n in names]
    return {"action": action, "method": method, "fields": fields, "text": {"raw": "Go", "norm": "Go", "cos": "go"}}


def test_forms_pair_by_action_then_fields():
    a, b = [form("/x", ["q"]), form("/y", ["n", "m"]), form("/z", ["r"])], [form("/w", ["n", "m", "o"]), form("/x", ["t"])]
    assert pair_forms(a, b) == [1, 0, None]
    rows = form_rows(a, b)
    assert {(r["sig"], r["title"]) for r in rows} == {("missing", "Form missing"), ("missing", "Form field missing"), ("added", "Form field added"), ("changed", "Form submits to a different URL")}
    assert form_rows(a, a) == []


def test_robots_and_sitemaps(spark):
    rules = [("/private/", False), ("/private/open", True), ("/*.tmp$", False)]
    got = spark.createDataFrame([("/private/x",), ("/private/open/y",), ("/a.tmp",), ("/a.tmpx",), ("/",)], "p string").select(robots_allow(F.col("p"), rules)).collect()
    assert [r[0] for r in got] == [False, True, False, True, True]
    xml = "<urlset><url><loc> https://a.example/x?a=1&amp;b=2 </loc></url><url><loc><![CDATA[https://a.example/y]]></loc></url></urlset>"
    assert spark.createDataFrame([(xml,), ("no",)], "x string").select(sitemap_urls(F.col("x"))).collect()[0][0] == ["https://a.example/x?a=1&b=2", "https://a.example/y"]


def test_broken_links(spark):
    rows = [(404, None, False), (200, "Not an HTML page (x)", False), (None, "Timed out", False), (500, None, True), (200, None, False), (None, None, None)]
    got = spark.createDataFrame(rows, "s int, e string, r boolean").select(broken(F.col("s"), F.col("e"), F.col("r"))).collect()
    assert [r[0] for r in got] == [True, False, True, False, False, False]
