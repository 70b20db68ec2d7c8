"""Best-fit packing of documents into token sequences, online and in bounded space.

A document is its ids and the end id. One longer than a sequence is cut into pieces of full length,
the first of which may be shorter. Pieces are dealt by hash into groups of bounded size; a group is
packed as a stream, in the order of another hash, with a fixed number of open bins in a bitset keyed by
free space: a piece goes where least space is left after it, at once, and when all bins are in use, the
fullest closes first.

Defined results: null and empty texts are the end id alone; equal rows are packed each for itself;
ties go to the bin that was used last; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import codecs
import os
import re
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetwin.llm.bpe import MEMO_CHARS, Stretches
from pagetwin.llm.rows import narrow, tidy
from pagetwin.session import Scratch, prepare

LENGTH = 2048
END_ID = 0
#: Open bins of a group, and pieces wanted in a group.
OPEN_BINS = 1024
GROUP_PIECES = 65_536
#: Words that the vocabulary's model encodes as one string, and runs of marks that a worker remembers.
JOINED_WORDS, TAILS = 64, 10_000


def pieces(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n % length or length
    return [(0, n)] if n <= length else [(0, first), *((s, length) for s in range(first, n, length))]


class Packer:
    """put() gives (bin, offset) of a piece at once."""

    def __init__(self, length: int = LENGTH, open_bins: int = OPEN_BINS):
        self.length, self.room = length, open_bins
        self.bits = 0  # bit f: a bin with f free is open
        self.stacks: list[list[int]] = [[] for _ in range(length + 1)]
        self.count = self.made = 0

    def _take(self, free: int) -> int:
        stack = self.stacks[free]
        at = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.count -= 1
        return at

    def put(self, n: int) -> tuple[int, int]:
        above = self.bits >> n
        if above:
            free = n + (above & -above).bit_length() - 1
            at = self._take(free)
        else:
            if self.count >= self.room:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest is closed for good
            at, free = self.made, self.length
            self.made += 1
        left = free - n
        if left:
            self.stacks[left].append(at)
            self.bits |= 1 << left
            self.count += 1
        return at, self.length - free


class Marked(Stretches):
    """Stretches for texts without added tokens; texts with one are encoded in one go, as such a token may end a stretch anywhere."""

    def __init__(self, many, added: list[str], whole):
        super().__init__(many)
        self.added, self.in_one_go = added, whole
        self.tails: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return self.in_one_go(text) if any(a in text for a in self.added) else super().encode(text)

    def _new(self, missing: list[str]) -> dict[str, bytes]:
        """Ids of keys not seen before; marks after a Latin letter are one match, whose ids are put behind the key without them."""
        todo, tailed = [], []
        for s in missing:
            if s[-1] in string.punctuation and (stem := s.rstrip(string.punctuation)) and stem[-1].isalpha() and stem[-1] < "\u0250":
                tailed.append((s, stem))
            else:
                todo.append(s)
        todo += [s for s in {stem for _, stem in tailed}.difference(todo) if s not in self.memo]
        out = dict(zip(todo, self.many([s[2:] if s[:2] == "\n\n" else s if s[0] == "\n" else f" {s}" for s in todo])))
        for s, stem in tailed:
            out[s] = (out[stem] if stem in out else self.memo[stem]) + self._tail(s[len(stem) :])
        return out

    def _tail(self, marks: str) -> bytes:
        if (ids := self.tails.get(marks)) is None:
            ids = self.many([marks])[0]
            if len(marks) <= MEMO_CHARS and len(self.tails) < TAILS:
                self.tails[marks] = ids
        return ids


_TOKENIZERS: dict[int, Stretches] = {}


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else the next from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(others)}


def reaches_over(token: bytes) -> bool:
    """Whether a token could hold the end of a word of letters and what follows, or a line feed and the word after it."""
    text = token.decode("utf-8", "surrogateescape")
    return bool(re.search(r"[^ \n][ \n]|\n[^ \n]", text)) and all(c in " \n" or c.isalpha() or "\ud800" <= c <= "\udfff" for c in text)


def tokenizer(blob: bytes) -> Stretches:
    """The worker's tokenizer of this vocabulary; special tokens in a text are found as the library finds them.

    A word of Latin letters, with the space before it, is one match of the split pattern, and so is a line
    feed before a word, so the vocabulary's model encodes them without the steps around it; anything else
    takes them all. Where no token reaches over the start of a word, no merge does, and many words are given
    to the model as one string: tokens that begin with a space or line feed say where words begin.
    """
    key = zlib.crc32(blob)
    if key not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_buffer(blob)
        added = [k.content for k in t.get_added_tokens_decoder().values()]
        model, letters = t.model, "".join(byte_letters()[b] for b in range(256))
        as_letters = lambda x: codecs.charmap_decode(x.encode(), "strict", letters)[0]
        byte, starts = {c: b for b, c in enumerate(letters)}, as_letters(" \n")
        known = t.get_vocab(with_added_tokens=False)
        joins = not any(reaches_over(bytes(byte[c] for c in x)) for x in known if all(c in byte for c in x))
        begins = np.zeros(max(known.values(), default=-1) + 1, bool)
        begins[[k for x, k in known.items() if x[0] in starts]] = True

        def joined(words: list[str]) -> list[bytes]:
            """Ids of words that begin with a space or line feed each."""
            out = []
            for at in range(0, len(words), JOINED_WORDS):
                ids = np.array([k.id for k in model.tokenize(as_letters("".join(words[at : at + JOINED_WORDS])))], "<u4")
                raw, cuts = ids.tobytes(), [*(4 * np.flatnonzero(begins[ids])).tolist(), 4 * len(ids)]
                out += [raw[a:b] for a, b in zip(cuts, cuts[1:])]
            return out

        def many(texts: list[str]) -> list[bytes]:
            words, rest = [], []
            for x in texts:
                word = x[1:] if x[:1] in " \n" else x
                latin = word.isalpha() and (word.isascii() or max(word) < "\u0250")
                (words if latin and joins and word is not x else rest).append(x)
            ids = dict(zip(words, joined(words)))
            if rest:
                ids.update((x, array("I", k.ids).tobytes()) for x, k in zip(rest, t.encode_batch(rest, add_special_tokens=False)))
            return [ids[x] for x in texts]

        whole = lambda x: array("I", t.encode(x, add_special_tokens=False).ids).tobytes()
        _TOKENIZERS[key] = Marked(many, added, whole)
    return _TOKENIZERS[key]


def tokenized_pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """One row per input row: doc_id, uid, pieces (start, length, ids_crc32)."""
    spark = prepare(docs.sparkSession)
    rows = narrow(docs).withColumn("uid", F.monotonically_increasing_id())
    with open(vocabulary, "rb") as f:
        blob = spark.sparkContext.broadcast(f.read())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(blob.value)
        for batch in batches:
            out = []
            for t in batch.column(1):
                ids = own.encode(t.as_py()) + end
                view = memoryview(ids)
                out.append([{"start": s, "length": n, "ids_crc32": zlib.crc32(view[4 * s : 4 * (s + n)])} for s, n in pieces(len(ids) // 4, length)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, kind)], names=["doc_id", "uid", "pieces"])

    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, uid long, pieces array<struct<start:long,length:long,ids_crc32:long>>")


def pack_documents(docs: DataFrame, vocabulary: str, length: int = LENGTH, open_bins: int = OPEN_BINS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(docs.sparkSession, "packing")
    made = scratch.table(tokenized_pieces(docs, vocabulary, length))
    n = made.agg(F.coalesce(F.sum(F.size("pieces")), F.lit(0)).alias("n")).first()["n"]
    groups = max(1, -(-n // group_pieces))
    each = made.select("doc_id", "uid", F.posexplode("pieces").alias("piece", "p")).select("doc_id", "uid", "piece", "p.*")
    each = each.withColumn("group", F.pmod(F.xxhash64("doc_id", "uid", "piece"), F.lit(groups))).withColumn("turn", F.xxhash64(F.lit(1), "doc_id", "uid", "piece"))
    dealt = each.repartition(F.col("group")).sortWithinPartitions("group", "turn").drop("turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, packer = None, None
        for batch in batches:
            seq, off = [], []
            for g, m in zip(batch.column(6).to_pylist(), batch.column(4).to_pylist()):
                if g != group:
                    group, packer = g, Packer(length, open_bins)
                at, o = packer.put(m)
                seq.append((g << 32) + at)
                off.append(o)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 2, 3, 4, 5)), pa.array(seq, pa.int64()), pa.array(off, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return dealt.mapInArrow(tidy(run), f"doc_id {made.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
