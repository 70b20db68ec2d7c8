"""Passages over words: wherever they start and end, and nothing beside them."""

import random

import numpy as np
import pytest

from pagetwin.llm import passages, substrings


def cut_texts(docs, texts):
    out = {r["doc_id"]: r["text"] for r in substrings.cut_paragraphs(docs(texts)).collect()}
    return [out[k] for k in range(len(texts))]


@pytest.mark.parametrize("sep", [". ", "\n", "! "])
def test_short_sentences_and_lines(docs, prose, sep):
    p = sep.join(prose(500 + k, 6) for k in range(10))
    texts = [f"{prose(1, 40)}\n{p}\n{prose(2, 40)}", f"{prose(3, 40)}\n{p}\n{prose(4, 40)}"]
    assert cut_texts(docs, texts) == [texts[0], f"{prose(3, 40)}\n{prose(4, 40)}"]


def test_passages_inside_of_lines(docs, prose):
    rng = random.Random(3)
    texts, want = [], []
    for k in range(40):
        p = prose(1000 + k, rng.choice([20, 21, 51, 75, 150]))
        hosts = [prose(2000 + 4 * k + j, rng.randint(1, 60)) for j in range(4)]
        first = f"{hosts[0]} xa {p} xb {hosts[1]}"
        texts += [first, f"{hosts[2]} xc {p} xd {hosts[3]}"]
        want += [first, f"{hosts[2]} xc xd {hosts[3]}"]
    assert cut_texts(docs, texts) == want
    rows = passages.repeated_passages(docs(texts)).collect()
    gone = {r["doc_id"]: r for r in rows if r["removed"]}
    stay = {r["doc_id"]: r for r in rows if not r["removed"]}
    assert sorted(gone) == list(range(1, 80, 2)) and sorted(stay) == list(range(0, 80, 2)) and len(rows) == 80
    for k, r in gone.items():
        s = stay[k - 1]
        assert (r["keep_doc_id"], r["keep_paragraph"]) == (k - 1, s["paragraph"]) and r["n_words"] == s["n_words"]
        assert texts[k][r["start"] : r["end"]] == texts[k - 1][s["start"] : s["end"]]


def test_own_lines_between_repeats_stay(docs, prose):
    p, q = prose(1, 30), prose(2, 30)
    own = "\n".join(prose(300 + k, 5) for k in range(100))
    texts = [f"{prose(8, 30)}\n{p}\n{q}", f"{p}\n{own}\n{q}", f"{prose(9, 30)}\n{p}\nshort line\n{q}", f"{p}\nshort line\n{q}\nend"]
    got = cut_texts(docs, texts)
    assert got[0] == texts[0] and got[1] == own
    # An edit of two words inside of 62 is part of a near copy.
    assert got[2] == prose(9, 30) and got[3] == "end"


def test_equal_words_and_odd_tables(spark, docs, prose):
    short = prose(5, 19)
    assert cut_texts(docs, [f"a {short} b", f"c {short} d", None, "", "w " * 3000]) == [f"a {short} b", f"c {short} d", None, "", "w " * 12]
    assert passages.repeated_passages(docs([]).where("false")).count() == 0
    p = prose(6, 40)
    ids = spark.createDataFrame([("b", f"x {p}"), ("a", p), (None, p)], "doc_id string, text string")
    assert {r["doc_id"]: r["text"] for r in substrings.cut_paragraphs(ids).collect()} == {"b": "x ", "a": "", None: p}


def test_every_shared_run_holds_an_anchor():
    rng = np.random.default_rng(2)
    for _ in range(200):
        word = lambda n: [b"%d" % x for x in rng.integers(0, 10**6, n)]
        p, n = word(passages.RUN_WORDS), rng.integers(0, 40, 4)
        keys = [set(passages.anchors_of(word(n[2 * k]) + p + word(n[2 * k + 1]))[1].tolist()) for k in (0, 1)]
        assert keys[0] & keys[1]
