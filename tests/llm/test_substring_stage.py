"""The pipeline's substring stage cuts what MinHash banding of paragraphs finds, after a comparison word by word."""

import random

import numpy as np
import pytest

import corpus_pipeline
from pagetwin.llm import minhash, passages, substrings


def cut_texts(spark, docs, texts):
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.substring_stage(spark, docs(texts), "").collect()}
    return [out[k] for k in range(len(texts))]


def edited(text, *places):
    words = text.split(" ")
    for k in places:
        words[k] = f"edit{k}"
    return " ".join(words)


def test_near_copies_of_paragraphs_go_whole(spark, docs, prose):
    texts, want = [], []
    for k, places in enumerate([(8,), (5,), (51,), (54,), (7, 50)]):
        p = prose(100 + k, 100 if len(places) > 1 else 60)
        texts += [f"{prose(200 + k, 40)}\n{p}", f"{prose(300 + k, 40)}\n{edited(p, *places)}"]
        want += [texts[-2], prose(300 + k, 40)]
    # Passages alone leave the words before or after such an edit.
    assert cut_texts(spark, docs, texts) == want


def test_runs_of_short_paragraphs(spark, docs, prose):
    p, q = (prose(k, 12).capitalize() + "." for k in (1, 2))
    texts = [f"{p} {prose(3, 30)}.", f"{q} {prose(4, 30)}.", f"{prose(5, 30)}.\n{p} {q}\n{prose(6, 30)}.", f"{p} {prose(7, 30)}."]
    # Two in a row have 24 words; one alone has too few.
    assert cut_texts(spark, docs, texts) == [texts[0], texts[1], f"{prose(5, 30)}.\n{prose(6, 30)}.", texts[3]]


def test_words_that_repeat_nothing_stay(spark, docs, prose):
    p = prose(1, 150)
    texts = [f"one two {p} three", f"four five six {p} seven eight", f"one own words {p} nine ten"]
    assert cut_texts(spark, docs, texts) == [texts[0], "four five six seven eight", "one own words nine ten"]


def test_one_place_of_each_stays(spark, docs, prose):
    """Ids that are null or repeated give no two places that are cut for each other."""
    texts = []
    for k in range(12):
        p = prose(k, 60)
        texts += [(None if k % 2 else 7, f"{prose(100 + k, 30)}\n{p}\n{prose(9999, 50)}"), (None if k % 2 else 7, f"{edited(p, 8)}\n{prose(200 + k, 30)}")]
    left = [r["text"] for r in corpus_pipeline.substring_stage(spark, docs([*texts, *texts[:3]]), "").collect()]
    lines = lambda t: set(t.split("\n"))
    have = set().union(*map(lines, left))
    assert len(left) == 27 and prose(9999, 50) in have
    for k in range(12):
        assert (prose(k, 60) in have) != (edited(prose(k, 60), 8) in have)
        assert prose(100 + k, 30) in have and prose(200 + k, 30) in have


def test_marked_paragraphs_against_brute_force(spark, docs, prose):
    """Of paragraphs with edits anywhere, all that reach 0.8 to the first one are cut as far as they agree with it."""
    rng, seen = random.Random(9), 0
    texts = []
    for k in range(60):
        p = prose(400 + k % 12, 70)
        texts.append(f"{prose(1000 + k, 25)}\n{edited(p, *(rng.randrange(70) for _ in range(k % 3)))}" if k >= 12 else f"{prose(1000 + k, 25)}\n{p}")
    got = cut_texts(spark, docs, texts)
    h = lambda t: passages.word_hashes([w.encode() for w in t.split(" ")])
    for k in range(12, 60):
        at = substrings.agreeing(h(texts[k].split("\n")[1]), h(texts[k % 12].split("\n")[1]))
        left = got[k].split("\n")[1:]
        x, y = (minhash.shingle_set([w.encode() for w in texts[j].split("\n")[1].split(" ")], 5) for j in (k, k % 12))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 80 * (len(x) + len(y) - both):
            seen += 1
            assert at
            words = texts[k].split("\n")[1].split(" ")
            kept = words[: at[0]] + words[at[1] :]
            assert len(" ".join(left).split()) <= len(kept), k
        assert got[k].startswith(prose(1000 + k, 25))
    assert seen >= 30 and got[:12] == texts[:12]


@pytest.mark.parametrize("mine, kept, want", [
    (range(40), range(40), (0, 40)),
    ([*range(900, 903), *range(40)], [*range(800, 802), *range(40)], (3, 43)),
    ([0, 900, *range(2, 60)], range(60), (0, 60)),
    ([0, 900, 901, 902, *range(4, 60)], range(60), (4, 60)),
    ([*range(57), 900, 58, 59], range(60), (0, 60)),
    ([*range(30), *range(500, 520), *range(30, 60)], range(60), None),
    (range(100, 140), range(40), None),
])
def test_agreeing(mine, kept, want):
    assert substrings.agreeing(np.array(mine, np.uint64), np.array(kept, np.uint64)) == want
