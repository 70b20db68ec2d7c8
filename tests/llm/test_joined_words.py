"""Words encoded as one string, and runs of marks behind them, against the library."""

import os
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from pagetwin.llm import packing

ODD = [
    "", " ", "a", " a", "a ", "a  b", "a\n\nb", "é b", "Ünder Straße, x.", "a<|endoftext|>b c", "日本 語 b", "x1 y2 don't I'm", "ab\tc d", "a b", "ſ K Å", "ŉ ab", "Ġ xĠ", "Ċa Ċ", "ª º word", "a\r\nb",
    "a$$$ b", "x,&&& y", "don't; a", "'s,", "a'", "1$$ 2", "\nb", "a \nb", "a\n b", "\n", "a\nÑas $", "ab\nªab", "a_b_ c_", "é!!", "w" * 70 + "##", "a" + "!" * 70,
]


def plain():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        return f.read()


@pytest.mark.parametrize("joined", [1, 3, 64])
def test_like_the_library(joined, monkeypatch):
    monkeypatch.setattr(packing, "JOINED_WORDS", joined)
    monkeypatch.setattr(packing, "_TOKENIZERS", {})
    monkeypatch.setitem(os.environ, "TOKENIZERS_PARALLELISM", "false")
    own, rng = packing.tokenizer(plain()), random.Random(joined)
    word = lambda: "".join(rng.choice("abcdeéßñÄz") for _ in range(rng.randint(1, 12)))
    texts = ODD + [rng.choice([" ", "\n"]).join(rng.choice([word(), word() + rng.choice([".", ",", "$$$", ",&&&", "'"]), rng.choice(ODD)]) for _ in range(rng.randint(1, 30))) for _ in range(2000)]
    t = Tokenizer.from_buffer(plain())
    for text, e in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert own.encode(text) == np.array(e.ids, "<u4").tobytes(), text


def test_what_is_not_remembered_is_encoded_once(monkeypatch):
    """Marks behind a word cost no second encoding of the word."""
    monkeypatch.setattr(packing, "_TOKENIZERS", {})
    own, asked = packing.tokenizer(plain()), []
    many = own.many
    monkeypatch.setattr(own, "many", lambda texts: asked.extend(texts) or many(texts))
    own.encode("x someword otherwords$$$")
    own.encode("x someword$$$ someword&&& otherwords,&&& otherwords")
    assert sorted(asked) == sorted(["x", " someword", " otherwords", "$$$", "&&&", ",&&&"])


def test_vocabularies_with_tokens_that_reach_over(monkeypatch):
    """Words are not joined where a merge could pass from one to the next."""
    assert [packing.reaches_over(x) for x in (b"ab", b" ab", b"\nab", b"a b", b"a ", b"\n ", b"\n\xc2\xa0", b"\xc3 ", b"1 ")] == [False, False, True, True, True, False, False, True, False]
    monkeypatch.setattr(packing, "_TOKENIZERS", {})
    space = packing.byte_letters()[0x20]
    letters = sorted(packing.byte_letters().values())
    t = Tokenizer(models.BPE(vocab={x: k for k, x in enumerate([*letters, f"a{space}"])}, merges=[("a", space)]))
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    own = packing.tokenizer(t.to_str().encode())
    assert own.encode("ba ba\na a") == np.array(t.encode("ba ba\na a").ids, "<u4").tobytes()
