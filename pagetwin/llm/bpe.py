"""Byte-level BPE encoding and decoding with a segment tree per piece.

A piece is one match of the split pattern. The tree's leaves are byte positions; each node keeps the
leftmost minimum of the ranks of neighbouring pairs, so the root names the next merge and a merge
costs a few logarithmic point updates on live neighbours. Ids of pieces, and of whole stretches
between single spaces, are remembered per Python worker up to a fixed number of entries.

Defined results: null and empty texts have no ids; every byte must have a rank, so every text can be
encoded; equal rows give equal rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pagetwin.llm.rows import narrow
from pagetwin.session import prepare

#: Entries that a worker remembers, for stretches and for pieces; later ones are encoded each time.
REMEMBERED = 200_000
#: Longer stretches and pieces are not remembered.
MEMO_CHARS = 64


def load_ranks(blob: bytes) -> dict[bytes, int]:
    """Ranks in the tiktoken text format: base64 token and rank in each line."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in blob.splitlines() if line)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the lowest rank, leftmost first, is merged until no pair has a rank."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    size = 1 << max(1, n - 1).bit_length()
    none = 1 << 62
    # A node holds rank * size + position, so its minimum is the leftmost of the lowest rank.
    tree = [none] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        if (r := get(piece[i : i + 2])) is not None:
            tree[size + i] = r * size + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    end = list(range(1, n + 1))  # where the token that starts here ends
    prev = list(range(-1, n))  # start of the token before

    def put(at: int, value: int) -> None:
        k = size + at
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            m = a if a < b else b
            if tree[k] == m:
                break
            tree[k] = m
            k >>= 1

    while (top := tree[1]) < none:
        i = top & (size - 1)
        j = end[i]
        stop = end[i] = end[j]
        if stop < n:
            prev[stop] = i
            r = get(piece[i : end[stop]])
            put(i, none if r is None else r * size + i)
        else:
            put(i, none)
        put(j, none)
        if (p := prev[i]) >= 0:
            r = get(piece[p:stop])
            put(p, none if r is None else r * size + p)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Stretches:
    """Ids of texts as little-endian unsigned 32-bit bytes, by remembered stretches.

    For split patterns in which a single space or line feed between two non-space characters begins a
    new match, a line feed is a match of its own there, and a letter and a mark never share one (the
    public pattern and that of the byte-level vocabularies). A text of such gaps only is joined from
    the ids of `x`, `\\nx` and ` x`; any other text goes to `many` as it is.
    Keys: `\\n\\nx` for the start of a text, `\\nx` after a line feed, `x` after a space.
    """

    def __init__(self, many: Callable[[list[str]], list[bytes]], remembered: int = REMEMBERED):
        self.many, self.remembered = many, remembered
        self.memo: dict[str, bytes] = {}
        self.marks = dict(zip(",.", many([",", "."])))

    def encode(self, text: str) -> bytes:
        keys = ("\n\n" + text.replace("\n", " \n")).split(" ")
        got = list(map(self.memo.get, keys))
        if gaps := got.count(None):
            at, places = -1, []
            for _ in range(gaps):
                at = got.index(None, at + 1)
                places.append(at)
            missing = list({keys[k] for k in places})
            bare = [s.lstrip("\n") for s in missing]
            if "" in bare or len("".join(bare).split(None, 1)) > 1 and any(x[0].isspace() or x[-1].isspace() for x in bare):
                return self.many([text])[0]
            new = self._new(missing)
            for k in places:
                got[k] = new[keys[k]]
            room = self.remembered - len(self.memo)
            if room > 0:
                self.memo.update([(s, v) for s, v in new.items() if len(s) <= MEMO_CHARS][:room])
        return b"".join(got)

    def _new(self, missing: list[str]) -> dict[str, bytes]:
        """Ids of keys not seen before; a mark after a Latin letter is put behind the key without it."""
        memo, stems = self.memo, {}
        for s in missing:
            marked = s[-1] in self.marks and len(s) > 1 and s[-2].isalpha() and s[-2] < "\u0250"
            stems[s] = s[:-1] if marked else s
        todo = [s for s in set(stems.values()) if s not in memo]
        ids = dict(zip(todo, self.many([s[2:] if s[:2] == "\n\n" else s if s[0] == "\n" else f" {s}" for s in todo])))
        out = dict(ids)
        for s, stem in stems.items():
            if stem is not s:
                out[s] = (ids[stem] if stem in ids else memo[stem]) + self.marks[s[-1]]
        return out


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t
        self.memo: dict[str, bytes] = {}
        self.stretches = Stretches(self.whole)

    def piece(self, p: str) -> bytes:
        if (ids := self.memo.get(p)) is None:
            ids = array("I", merge_piece(p.encode("utf-8", "surrogatepass"), self.ranks)).tobytes()
            if len(p) <= MEMO_CHARS and len(self.memo) < REMEMBERED:
                self.memo[p] = ids
        return ids

    def whole(self, texts: list[str]) -> list[bytes]:
        return [b"".join(map(self.piece, self.split(t))) for t in texts]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.stretches.encode(text)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, array("I", ids)))


_CODECS: dict[str, Codec] = {}


def codec(blob: bytes, pattern: str) -> Codec:
    """The worker's codec of this vocabulary, so that what it remembers outlives a task."""
    key = hashlib.sha256(blob + pattern.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(load_ranks(blob), pattern)
    return _CODECS[key]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """One row per input row: doc_id, ids (binary), decoded (binary). vocabulary: path on the driver, sent to the executors once."""
    return _run(docs, vocabulary, pattern, [("ids", pa.binary(), "binary"), ("decoded", pa.binary(), "binary")], lambda ids, decoded: (ids, decoded))


def digest_documents(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256 of what encode_documents gives, without moving the ids."""
    sha = lambda b: hashlib.sha256(b).hexdigest()
    kinds = [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]
    return _run(docs, vocabulary, pattern, kinds, lambda ids, decoded: (len(ids) // 4, sha(ids), sha(decoded)))


def _run(docs: DataFrame, vocabulary: str, pattern: str, kinds: list, result: Callable) -> DataFrame:
    spark = prepare(docs.sparkSession)
    rows = narrow(docs)
    with open(vocabulary, "rb") as f:
        blob = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(blob.value, pattern)
        for batch in batches:
            got = []
            for t in batch.column(1):
                ids = own.encode(t.as_py())
                got.append(result(ids, own.decode(ids)))
            cols = zip(*got) if got else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k[1]) for c, k in zip(cols, kinds))], names=["doc_id", *(k[0] for k in kinds)])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{k[0]} {k[2]}" for k in kinds))
