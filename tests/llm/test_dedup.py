"""Fingerprints, exact dedup, near dedup and substring dedup against brute force."""

import hashlib
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagetwin.llm import exact, fingerprints, graph, minhash, substrings
from pagetwin.session import Scratch

ODD = [None, "", " ", "a", "A", " a\t", "ﬁne Straße", "fine STRASSE", "é", "é", "x" * 5000, "same text", "same text", "Same  TEXT", "b c", "b c"]


def canonical(t):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())
    return re.sub(r"\s+", " ", t).strip()


@pytest.mark.parametrize("bits", [128, 3])
def test_fingerprints(docs, bits, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 4)
    rows = [(k * 7, t) for k, t in enumerate(ODD)]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(docs(rows), bits).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 4
        edited = t[: len(t) - n] + nxt[:n]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == float(canonical(edited) == canonical(t)) and r["near_next"] == float(canonical(nxt) == canonical(t))
    for i, t in rows:
        for j, u in rows:
            assert (got[i]["fingerprint"] == got[j]["fingerprint"]) == (canonical(t) == canonical(u)), (t, u)
    # Edited texts keep to the same, among each other and beside documents.
    edits = {}
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 4
        edits[i] = canonical(t[: len(t) - n] + nxt[:n])
    for i in edits:
        for j, u in rows:
            assert (got[i]["edited_fingerprint"] == got[j]["edited_fingerprint"]) == (edits[i] == edits[j])
            assert (got[i]["edited_fingerprint"] == got[j]["fingerprint"]) == (edits[i] == canonical(u))


def test_fingerprints_of_odd_tables(spark, docs):
    assert fingerprints.fingerprint_documents(docs([]).where("false")).count() == 0
    one = fingerprints.fingerprint_documents(docs([(5, "only one text")])).collect()
    assert one[0]["near_next"] == 1.0
    rows = docs([(None, "a"), (1, "b"), (1, "b"), (1, "c")]).withColumn("digest", F.lit(1)).withColumn("bucket", F.lit("x"))
    assert fingerprints.fingerprint_documents(rows).count() == 4


def test_native_plan(spark, docs):
    plan = fingerprints._measured(exact.narrow(docs(["a", "b"])), 128)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chunks_are_content_defined():
    rng = np.random.default_rng(1)
    a = bytes(rng.integers(97, 123, 60_000, dtype=np.uint8))
    b = a[:20_000] + b"inserted" + a[20_000:]
    cuts = lambda t: exact.chunk_ends(pa.array([t.decode()]))[0].as_py()
    parts = lambda t: {t[x:y] for x, y in zip([0, *cuts(t)], cuts(t))}
    assert b"".join(a[x:y] for x, y in zip([0, *cuts(a)], cuts(a))) == a
    assert len(parts(a) & parts(b)) >= 0.9 * len(parts(a))
    alone = exact.chunk_ends(pa.array(["zz", a.decode(), "", b.decode()])).to_pylist()
    assert alone == [[2], cuts(a), [], cuts(b)]
    assert exact.chunk_ends(pa.array(["zz", a.decode()]).slice(1)).to_pylist() == [cuts(a)]


@pytest.mark.parametrize("bits", [128, 2])
def test_exact_groups(docs, prose, bits):
    texts = [*ODD, *(prose(k % 5, 3000) for k in range(9)), prose(1, 3000) + "!"]
    rows = exact.exact_groups(docs(texts), bits).collect()
    by = {}
    for i, t in enumerate(texts):
        by.setdefault(t or "", []).append(i)
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]] or ""
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(by[t]), len(by[t]), r["doc_id"] == max(by[t]))
        assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_drop_exact(spark, docs):
    rows = docs([(1, "a"), (1, "a"), (2, "a"), (3, None), (4, ""), (None, "n"), (None, "n"), (7, "x"), (7, "y")]).withColumn("uid", F.lit(0)).withColumn("recipe", F.lit("q"))
    kept = sorted(((r["doc_id"], r["text"]) for r in exact.drop_exact(rows).collect()), key=str)
    assert kept == sorted([(2, "a"), (4, ""), (None, "n"), (7, "x"), (7, "y")], key=str)
    assert exact.drop_exact(rows).columns == rows.columns
    assert exact.drop_exact(docs([]).where("false")).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert all(got[n] == find(n) for n in got) and {n for a, b in edges if a != b for n in (a, b)} == set(got)
    assert graph.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def words(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()


def shingle_set(w, n):
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def brute(sets, num, den):
    """Smallest index that each index reaches."""
    low = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and sets[j] and den * n >= num * len(a | sets[j]):
                x, y = sorted((low[i], low[j]))
                low = [x if v == y else v for v in low]
    return low


def near_texts(prose):
    rng = random.Random(11)
    out = [None, "", "one", "ONE", "one two", "a b c", "a B c", " \x0b\t "]
    for k in range(14):
        base = prose(k, rng.choice([6, 40, 200])).split(" ")
        for _ in range(rng.randint(1, 7)):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = "edit%d" % rng.randrange(1000)
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize(("n", "num"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, prose, n, num, small, monkeypatch):
    if small:  # hot band keys and clusters of several blocks
        monkeypatch.setattr(minhash, "HOT_LEAST", 3)
        monkeypatch.setattr(minhash, "CLUSTER_SHINGLES", 200)
        monkeypatch.setattr(minhash, "PIVOTS", 1)
        monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 300)
        monkeypatch.setattr(minhash, "BROADCAST_UNITS", 0)
    texts = near_texts(prose)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs(texts), minhash.Spec(words=n, num=num)).collect()}
    sets = [shingle_set(words(t), n) for t in texts]
    want = brute(sets, num, 100)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), w, w == i), texts[i]


def test_near_edge_tables(docs, prose):
    long = prose(1, 60_000)
    rows = docs([(1, long), (2, long + " end"), (2, long + " end"), (None, "a b c d e f"), (None, "a b c d e f"), (9, None)]).withColumn("rep", F.lit(1)).withColumn("key", F.lit("k")).withColumn("bits", F.lit(0))
    got = sorted(((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (2, 1), (None, None), (None, None), (9, 9)], key=str)
    assert sorted(r["doc_id"] or 0 for r in minhash.drop_near(rows).collect()) == [0, 0, 1, 9]
    assert minhash.near_duplicates(docs([]).where("false")).count() == 0


def test_estimates_follow_jaccard():
    rng = np.random.default_rng(5)
    spec = minhash.Spec()
    pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    a, b = np.unique(pool[:350]), np.unique(pool[50:])
    _, bits = minhash.signatures([a, b], minhash.Spec(minima=4096))
    assert abs(minhash.estimate(bits[:1], bits[1:], 4096)[0] - 300 / 400) < 0.08
    rows, bands = spec.banding()
    assert (1 - 0.8**rows) ** bands <= minhash.MISS and rows * bands <= spec.minima
    many = minhash.link_key(np.arange(2000), np.zeros((2000, 2), np.uint64), spec)
    assert len(many) == 1999


def sentences(prose, seed, n):
    return " ".join(prose(100 * seed + k, 6 + k % 7).capitalize() + "." for k in range(n))


def passages(prose):
    p, q = prose(99, 60), sentences(prose, 77, 16)
    near = p.split(" ")
    near[30] = "changed"
    texts = [prose(k, 30, lines=4) for k in range(8)]
    texts[1] += "\n" + p
    texts[3] = p + "\n" + texts[3]
    texts[4] += "\n" + " ".join(near) + "\nshort line"
    texts[5] += "\nshort line\n" + p.upper()
    # A passage inside of a line, between words.
    texts[6] = f"{prose(61, 9)} {q} {prose(62, 12)}"
    texts[7] = f"{prose(71, 40)}\n{prose(72, 5)} {q} {prose(73, 30)}\n{texts[7]}"
    return [*texts, None, "", "short line"], q


def brute_substrings(texts, spec):
    """{(doc, paragraph): (first doc, first paragraph, cluster size, removed)} of what is cut and what stays for it."""
    units = [(i, pos, s, e, w) for i, t in enumerate(texts) for pos, s, e, w in minhash.units_of(t or "", spec)]
    low = brute([shingle_set(words(texts[i][s:e]), spec.words) for i, _, s, e, _ in units], spec.num, spec.den)
    again = {k: low[k] != k for k in range(len(units)) if low.count(low[k]) > 1}
    removed = set()
    for k in sorted(k for k, a in again.items() if a):
        run = [k]
        while again.get(run[-1] + 1) and units[run[-1] + 1][0] == units[k][0] and units[run[-1] + 1][1] == units[run[-1]][1] + 1:
            run.append(run[-1] + 1)
        if k - 1 in removed and units[k - 1][0] == units[k][0] or sum(len(units[x][4]) for x in run) >= substrings.RUN_WORDS:
            removed.add(k)
    stay = {low[k] for k in removed}
    return {units[k][:2]: (*units[low[k]][:2], low.count(low[k]), k in removed) for k in removed | stay}, units


def test_substring_dedup(docs, prose):
    texts, q = passages(prose)
    got = substrings.repeated_paragraphs(docs(texts)).collect()
    want, units = brute_substrings(texts, substrings.SPEC)
    assert {(r["doc_id"], r["paragraph"]): (r["keep_doc_id"], r["keep_paragraph"], r["cluster_size"], r["removed"]) for r in got} == want
    assert {d for d, _ in want} == {1, 3, 4, 5, 6, 7} and all(d in (3, 4, 5, 7) for (d, _), v in want.items() if v[3])
    place = {(i, pos): (s, e) for i, pos, s, e, _ in units}
    assert all((r["start"], r["end"]) == place[r["doc_id"], r["paragraph"]] for r in got)
    out = {r["doc_id"]: r for r in substrings.cut_paragraphs(docs(texts)).collect()}
    for i in (0, 1, 2, 6, 8, 9, 10):
        assert out[i]["text"] == texts[i]
    lines = lambda k: texts[k].split("\n")
    assert out[3]["text"] == "\n".join(lines(3)[1:]) and out[5]["text"] == "\n".join(lines(5)[:-1])
    assert out[4]["text"] == "\n".join(x for x in lines(4) if "changed" not in x)
    left = out[7]["text"]
    assert len(left.split()) <= len(texts[7].split()) - 0.6 * len(q.split()) and all(x in left for x in (lines(7)[0], *lines(7)[2:], prose(72, 5), prose(73, 30)))
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.values())


def test_paragraphs_are_local(prose):
    p = sentences(prose, 5, 40)
    inner = lambda t: {t[s:e] for _, s, e, _ in minhash.units_of(t, substrings.SPEC)}
    assert len(inner(p) & inner("other words here " + p + " and more words")) >= len(inner(p)) - 2
    assert substrings.cut_spans("ab\ncd\nef", [(3, 5)]) == "ab\nef" and substrings.cut_spans("ab\ncd", [(3, 5)]) == "ab" and substrings.cut_spans("x y z", [(2, 3)]) == "x z"
    assert substrings.cut_spans("ab", [(0, 2)]) == "" and substrings.cut_spans("abc", [(0, 2), (1, 3)]) == ""


def test_sets_in_one_go(prose):
    units = [minhash.words_of(prose(k, n).encode()) for k, n in enumerate([1, 3, 5, 6, 400, 5])] + [[], [b"a"] * 9, [b"x", b"y"] * 7]
    for n in (3, 5):
        assert all((a == minhash.shingle_set(w, n)).all() and len(a) == len(minhash.shingle_set(w, n)) for a, w in zip(minhash.shingle_sets(units, n), units))


def test_substring_edge_tables(docs, prose):
    p = prose(1, 30)
    rows = docs([(1, p), (1, p), (2, p + "\n" + p), (None, p)]).withColumn("root", F.lit(1)).withColumn("units", F.lit(1))
    out = substrings.cut_paragraphs(rows)
    assert out.columns == rows.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(None, p), (1, ""), (1, ""), (2, "")], key=str)
    assert substrings.cut_paragraphs(docs([]).where("false")).count() == 0
