"""Near-duplicate linking by b-bit MinHash, for whole texts or for their paragraphs.

1. sketch: word shingles of every unit as a set of 64-bit hashes; minima of `minima` hash functions;
   band keys from groups of minima; the lowest bit of each mixed minimum is kept and packed.
2. Units of equal sets form one class and are represented by one unit.
3. Units that share a band key are candidates. Inside a key, similarity is estimated from the packed
   bits (bit counts, corrected for chance agreement), and what may reach the threshold by it and by both
   set sizes is linked. Keys with very many units are not estimated: all of their units are linked, natively.
4. Linked candidates make clusters. All links within a cluster are confirmed on full sets. A cluster of
   more than CLUSTER_SHINGLES shingles or CLUSTER_UNITS units is dealt out in blocks: first every unit is
   compared with PIVOTS of its cluster, then what is not in the largest component so far with all units.
   In a cluster of more than PAIRED_BLOCKS blocks only those are compared that share one of their rarest
   shingles, as two linked sets always do. Only spanning edges of a task's components leave it, never all pairs.
5. Components of the confirmed links are the result.

A pair at the threshold misses every band with a probability of at most MISS.

Texts: bytes are lower-cased A-Z; words are runs without ASCII white space; a unit with fewer words
than a shingle is one shingle of all its words; without words its set is empty and links with nothing.
Sets are compared as 64-bit hashes.

Defined results: null text counts as empty; equal rows are linked with each other; the smallest doc_id
of a component is that of its non-null ones; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetwin.llm.graph import components
from pagetwin.llm.rows import narrow, opened, own, sealed, tidy
from pagetwin.session import Scratch, prepare

MISS = 1e-6
#: Units of a band key that are compared by their bits in one go; more are linked without it.
KEY_UNITS = 1024
#: Share of all units from which a band key is handled natively; so there are at most minima / share of them.
HOT_SHARE, HOT_LEAST = 1e-4, 50_000
#: What one task compares of a cluster at most, unless a single unit is larger.
CLUSTER_SHINGLES, CLUSTER_UNITS = 24_000, 128
#: Units of a large cluster that all others are compared with first; shingles and units of a block of what is left after that.
PIVOTS, BLOCK_SHINGLES, BLOCK_UNITS = 16, 200_000, 512
#: Such blocks of a cluster that are compared in pairs at most; in a larger cluster, units meet where they share a rare shingle.
PAIRED_BLOCKS = 16
#: Classes with candidates that are broadcast at most; beyond, the join is shuffled.
BROADCAST_UNITS = 400_000
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BLOCK = 1 << 16


@dataclass(frozen=True)
class Spec:
    words: int = 5  # words of a shingle
    num: int = 80  # linked when den * intersection >= num * union
    den: int = 100
    minima: int = 128
    lines: bool = False  # units are paragraphs, not whole texts
    min_words: int = 0  # shorter units are left out
    rows: int = 0  # minima in a band; 0: the most that keep MISS
    bands: int = 0

    def banding(self) -> tuple[int, int]:
        if self.rows:
            return self.rows, self.bands
        s = self.num / self.den
        fit = [r for r in range(1, 17) if (1 - s**r) ** (self.minima // r) <= MISS]
        r = max(fit, default=1)
        need = next((b for b in range(1, self.minima // r + 1) if (1 - s**r) ** b <= MISS), self.minima // r)
        return r, need

    def margin(self) -> float:
        """Estimates below this rule a pair out: five standard deviations under the threshold."""
        s = self.num / self.den
        p = (1 + s) / 2
        return s - 5 * 2 * (p * (1 - p) / self.minima) ** 0.5


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def shingle_set(words: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(n, len(h))
    acc = np.full(len(h) - k + 1, 0x9E3779B97F4A7C15 * k & (2**64 - 1), np.uint64)
    for j in range(k):
        acc = mix(acc + h[j : len(h) - k + 1 + j])
    return np.unique(acc)


def shingle_sets(units: list[list[bytes]], n: int) -> list[np.ndarray]:
    """shingle_set of every unit, many units in one go."""
    out: list[np.ndarray] = [shingle_set(w, n) if len(w) < n else None for w in units]
    wait = [k for k, w in enumerate(units) if len(w) >= n]
    at = 0
    while at < len(wait):
        to, size = at, 0
        while to < len(wait) and (to == at or size + len(units[wait[to]]) <= _BLOCK):
            size += len(units[wait[to]])
            to += 1
        part = wait[at:to]
        lens = np.array([len(units[k]) for k in part])
        h = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(units[k] for k in part)), np.uint64, size)
        acc = np.full(size - n + 1, 0x9E3779B97F4A7C15 * n & (2**64 - 1), np.uint64)
        for j in range(n):
            acc = mix(acc + h[j : size - n + 1 + j])
        owner, ends = np.repeat(np.arange(len(part)), lens), np.cumsum(lens)
        inside = np.flatnonzero(np.arange(size - n + 1) + n <= ends[owner[: size - n + 1]])
        acc, owner = acc[inside], owner[inside]
        order = np.lexsort((acc, owner))
        acc, owner = acc[order], owner[order]
        new = np.ones(len(acc), bool)
        new[1:] = (acc[1:] != acc[:-1]) | (owner[1:] != owner[:-1])
        acc, owner = acc[new], owner[new]
        cuts = np.searchsorted(owner, np.arange(len(part) + 1))
        for i, k in enumerate(part):
            out[k] = acc[cuts[i] : cuts[i + 1]]
        at = to
    return out


_ENDS = re.compile(r"[.!?](?=\s)")


def paragraph_ends(line: str) -> list[int]:
    """Where paragraphs of a line end: at its sentences. The decision is local, so a passage is parted alike wherever it was put."""
    ends = [m.end() for m in _ENDS.finditer(line)]
    return ends if ends and ends[-1] == len(line) else [*ends, len(line)]


def units_of(text: str, spec: Spec) -> Iterator[tuple[int, int, int, list[bytes]]]:
    """(position, start, end, words) of the units of a text; start and end count code points.

    Paragraphs end with their line, or inside of it as paragraph_ends says; those with too few words have no position.
    """
    if not spec.lines:
        yield -1, 0, len(text), words_of(text.encode("utf-8", "surrogatepass"))
        return
    at = k = 0
    for line in text.split("\n"):
        start = 0
        for end in paragraph_ends(line):
            while start < end and line[start].isspace():
                start += 1
            words = words_of(line[start:end].encode("utf-8", "surrogatepass"))
            if len(words) >= spec.min_words:
                yield k, at + start, at + end, words
                k += 1
            start = end
        at += len(line) + 1


def functions_of(spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(7919))
    return rng.integers(0, 1 << 63, spec.minima, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, spec.minima, np.uint64)


def signatures(sets: list[np.ndarray], spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, packed low bits), a row for each set; sets must not be empty."""
    a, b = functions_of(spec)
    low = np.full((len(sets), spec.minima), np.iinfo(np.uint64).max, np.uint64)
    k = 0
    while k < len(sets):
        take, size = k, 0
        while take < len(sets) and (take == k or size + len(sets[take]) <= _BLOCK):
            size += len(sets[take])
            take += 1
        u = np.concatenate(sets[k:take])
        starts = np.cumsum([0, *map(len, sets[k : take - 1])])
        for p in range(spec.minima):
            if len(u) <= 4 * _BLOCK:
                low[k:take, p] = np.minimum.reduceat(u * a[p] + b[p], starts)
            else:  # one very long unit, piece by piece
                low[k, p] = min(int((u[x : x + _BLOCK] * a[p] + b[p]).min()) for x in range(0, len(u), _BLOCK))
        k = take
    low = mix(low)
    rows, bands = spec.banding()
    keys = np.empty((len(sets), bands), np.uint64)
    for j in range(bands):
        acc = np.full(len(sets), j + 1, np.uint64)
        for r in range(rows):
            acc = mix(acc + low[:, j * rows + r])
        keys[:, j] = acc
    bits = np.packbits((low & np.uint64(1)).astype(np.uint8), axis=1).view(np.uint64)
    return keys, bits


_EMPTY: list = []
_SKETCH = "uid long, pos int, start int, end int, n_words int, n_shingles int, s1 long, s2 long, bits array<long>, bands array<long>"


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1] or 1, dtype=np.int32)), pa.array(m.reshape(-1).view(np.int64)))


def sketch(docs: DataFrame, spec: Spec) -> DataFrame:
    """A row for each unit: doc_id, text_hash, uid, place in the text, set size, class hash, bits and band keys. Units without words have empty lists."""
    prepare(docs.sparkSession)
    rows = narrow(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("row"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, places, units = [], [], []
            for k, t in enumerate(batch.column(3)):
                for pos, start, end, words in units_of(t.as_py(), spec):
                    src.append(k)
                    places.append((pos, start, end, len(words)))
                    units.append(words)
            sets = shingle_sets(units, spec.words)
            meta = []
            for place, s in zip(places, sets):
                d = xxhash.xxh3_128_digest(s.tobytes())
                meta.append((*place, len(s), int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
            for lo in range(0, len(src), 4096) or [0]:
                part = slice(lo, lo + 4096)
                full = [k for k, s in enumerate(sets[part]) if len(s)]
                keys, bits = signatures([sets[part][k] for k in full], spec) if full else (np.zeros((0, 1), np.uint64), np.zeros((0, 1), np.uint64))
                take = pa.array(src[part], pa.int64())
                cols = [batch.column(k).take(take) for k in (0, 1, 2)]
                m = [pa.array(c, t) for c, t in zip(zip(*meta[part]) if meta[part] else [()] * 7, (pa.int32(),) * 5 + (pa.int64(),) * 2)]
                at = np.full(len(src[part]), -1)
                at[full] = np.arange(len(full))
                where = pa.array(at, mask=at < 0)
                yield pa.RecordBatch.from_arrays([*cols, *m, _lists(bits).take(where), _lists(keys).take(where)], names=["doc_id", "text_hash", "uid", "pos", "start", "end", "n_words", "n_shingles", "s1", "s2", "bits", "bands"])

    out = rows.mapInArrow(tidy(run), f"doc_id {kind}, text_hash long, {_SKETCH}")
    # Units get ids of their own; the caller writes them down before they are used twice.
    return out.withColumnRenamed("uid", "row").withColumn("uid", F.monotonically_increasing_id())


def estimate(x: np.ndarray, y: np.ndarray, minima: int) -> np.ndarray:
    """Similarity from packed bits: agreement beyond the half that chance gives."""
    differ = np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)
    return 1 - 2 * differ / minima


def alike(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, spec: Spec) -> np.ndarray:
    """Whether units of bits x and y and set sizes n and m may be linked: a link needs den * smaller >= num * larger."""
    return (estimate(x, y, spec.minima) >= spec.margin()) & (spec.den * np.minimum(n, m) >= spec.num * np.maximum(n, m))


def link_key(ids: np.ndarray, bits: np.ndarray, spec: Spec, sizes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Star edges over the units of one band key whose estimates, and set sizes where given, connect them."""
    n, sizes = len(ids), np.ones(len(ids), np.int64) if sizes is None else sizes
    if n > KEY_UNITS:
        low = int(ids.min())
        return [(low, int(x)) for x in ids if x != low]
    left, edges = np.arange(n), []
    while len(left):
        todo, left = [left[0]], left[1:]
        members = [left[:0]]
        head = todo[0]
        while todo and len(left):
            u = todo.pop()
            near = alike(bits[u], bits[left], sizes[u], sizes[left], spec)
            members.append(left[near])
            todo += list(left[near])
            left = left[~near]
        edges += [(int(ids[head]), int(ids[m])) for part in members for m in part]
    return edges


def hot_keys(reps: DataFrame, least: int) -> DataFrame:
    """(key) of the band keys with about `least` units or more.

    Every task counts all of its keys and hands on those that it met twice or more, so the many keys of
    one unit are not shuffled; a count is short by one for each stretch in which a key is met once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def count():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys[n > 1]), pa.array(n[n > 1].astype(np.int64))], names=["key", "n"])

        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy())
            size += len(held[-1])
            if size >= 1 << 19:
                yield count()
                held, size = [], 0
        if held:
            yield count()

    return reps.select("bands").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key")


def candidate_links(reps: DataFrame, spec: Spec, scratch: Scratch) -> DataFrame:
    """Edges (a, b) between class representatives that share a band key and may be similar enough."""
    rows = reps.select(F.col("rep"), "bits", F.col("n_shingles").cast("long").alias("size"), F.explode("bands").alias("key"))
    n = reps.count()
    hot_from = max(HOT_LEAST, int(n * HOT_SHARE))
    keys = scratch.table(hot_keys(reps, hot_from))
    hot = scratch.table(rows.join(F.broadcast(keys), "key").groupBy("key").agg(F.min("rep").alias("low")))
    native = rows.join(F.broadcast(hot), "key").select(F.col("low").alias("a"), F.col("rep").alias("b"))
    dealt = rows.join(F.broadcast(hot), "key", "left_anti").repartition(F.col("key")).sortWithinPartitions("key")
    dealt = dealt.select("key", "rep", "bits", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(key, rep, bits, sizes):
            """Edges of whole keys."""
            cuts = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
            n = ends - starts
            two = starts[n == 2]
            ok = alike(bits[two], bits[two + 1], sizes[two], sizes[two + 1], spec)
            edges = list(zip(rep[two[ok]].tolist(), rep[two[ok] + 1].tolist()))
            for s, e in zip(starts[n > 2].tolist(), ends[n > 2].tolist()):
                edges += link_key(rep[s:e], bits[s:e], spec, sizes[s:e])
            edges = list(set(edges))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            words = spec.minima // 64
            now = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).flatten().to_numpy().view(np.uint64).reshape(-1, words), batch.column(3).to_numpy())
            held = now if held is None else tuple(np.concatenate(p) for p in zip(held, now))
            last = int(np.searchsorted(held[0], held[0][-1]))
            if last and len(held[0]) >= 20_000:
                yield flush(*(c[:last] for c in held))
                held = tuple(c[last:] for c in held)
        if held is not None:
            yield flush(*held)

    return native.where("a <> b").unionByName(dealt.mapInArrow(run, "a long, b long"))


def full_sets(docs: DataFrame, wanted: DataFrame, spec: Spec) -> DataFrame:
    """(rep, cluster, blocks, set: hashes as bytes) for the units in `wanted` (doc_id, text_hash, pos, rep, cluster, blocks), from a second scan of the texts."""
    few = wanted.count() <= BROADCAST_UNITS
    lists = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("pos", "rep", "cluster", "blocks")).alias("units"))
    lists = lists.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "units")
    rows = narrow(docs).withColumn("text_hash", F.xxhash64("text"))
    found = rows.join(F.broadcast(lists) if few else lists, rows["doc_id"].eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))).select("text", "units")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, units in zip(batch.column(0), batch.column(1)):
                want: dict[int, dict] = {u["pos"]: u for u in units.as_py()}
                found = [(want[pos], words) for pos, _, _, words in units_of(t.as_py(), spec) if pos in want]
                rows = [(u, s.tobytes()) for (u, _), s in zip(found, shingle_sets([w for _, w in found], spec.words))]
                yield pa.RecordBatch.from_arrays([*(pa.array([u[c] for u, _ in rows], pa.int64()) for c in ("rep", "cluster", "blocks")), pa.array([s for _, s in rows], pa.binary())], names=["rep", "cluster", "blocks", "set"])

    return found.mapInArrow(tidy(run), "rep long, cluster long, blocks long, set binary")


def confirm(ids: list[int], sets: list[np.ndarray], spec: Spec, labels: list[int] | None = None) -> list[tuple[int, int]]:
    """Edges that join the components which exact links make among the sets; sets of equal labels are known to be linked."""
    group = np.unique(labels, return_inverse=True)[1] if labels else np.arange(len(sets))
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    first = np.concatenate([[0], np.cumsum(size)])
    flag = np.zeros(len(values), bool)
    left, edges = np.arange(len(sets)), []
    while len(left):
        head = int(left[0])
        mine = group[left] == group[head]
        todo, left = left[mine].tolist(), left[~mine]
        while todo and len(left):
            u = todo.pop()
            # Sizes alone rule many out: a link needs den * smaller >= num * larger.
            lo, hi = np.minimum(size[u], size[left]), np.maximum(size[u], size[left])
            some = left[spec.den * lo >= spec.num * hi]
            if not len(some):
                continue
            mine = flat[first[u] : first[u + 1]]
            flag[mine] = True
            if len(some) == len(left) and left[-1] - left[0] + 1 == len(left):
                counts = np.add.reduceat(flag[flat[first[left[0]] : first[left[-1] + 1]]], first[left] - first[left[0]], dtype=np.int64)
            else:
                counts = np.array([np.count_nonzero(flag[flat[first[x] : first[x + 1]]]) for x in some])
            flag[mine] = False
            near = some[spec.den * counts >= spec.num * (size[u] + size[some] - counts)]
            edges += [(ids[head], ids[int(x)]) for x in near]
            if len(near):
                mine = np.isin(group[left], group[near])
                todo += left[mine].tolist()
                left = left[~mine]
    return edges


_PAIRS = "a long, b long"


def _edges(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def by_group(rows: DataFrame, keys: list[str], kernel) -> DataFrame:
    """Edges that `kernel` finds in each group of rows (keys, rep, set, mark): kernel(reps, sets, marks). Groups stand in one task each."""
    dealt = rows.select(*keys, "rep", "set", "mark").repartition(*keys).sortWithinPartitions(*keys)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:n] != key:
                    if len(held) > 1:
                        out += kernel(*zip(*held))
                    key, held = row[:n], []
                held.append((row[n], np.frombuffer(row[n + 1], np.uint64), row[n + 2]))
            if out:
                yield _edges(out)
                out = []
        if len(held) > 1:
            out += kernel(*zip(*held))
        yield _edges(out)

    return dealt.mapInArrow(tidy(run), _PAIRS)


def small_links(sets: DataFrame, spec: Spec) -> DataFrame:
    """Edges inside clusters that fit into a task each."""
    return by_group(sets.withColumn("mark", F.lit(0).cast("long")), ["cluster"], lambda ids, units, _: confirm(list(ids), list(units), spec))


def pivot_links(ids, units, is_pivot, spec: Spec) -> list[tuple[int, int]]:
    """Edges between pivots and the units that they are linked with."""
    pivots = {i: u for i, u, p in zip(ids, units, is_pivot) if p}
    out = []
    for i, u, p in zip(ids, units, is_pivot):
        if p:
            continue
        for k, v in pivots.items():
            lo, hi = sorted((len(u), len(v)))
            if k == i or spec.den * lo < spec.num * hi:
                continue
            at = np.searchsorted(v, u)
            both = int((v[np.minimum(at, len(v) - 1)] == u).sum())
            if spec.den * both >= spec.num * (len(u) + len(v) - both):
                out.append((k, i))
    return out


def hubs(large: DataFrame, reps: DataFrame, scratch: Scratch) -> DataFrame:
    """(rep) of up to PIVOTS units of each cluster, those that share band keys with most others: a text that many edit is one."""
    mine = large.select("cluster", "rep")
    mine = F.broadcast(mine) if mine.count() <= BROADCAST_UNITS else mine
    keys = scratch.table(reps.select("rep", "bands").join(mine, "rep").select("cluster", "rep", F.explode("bands").alias("key")))
    often = scratch.table(keys.groupBy("cluster", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    few = often.count() <= BROADCAST_UNITS
    degree = keys.join(F.broadcast(often) if few else often, ["cluster", "key"]).groupBy("cluster", "rep").agg(F.sum("n").alias("n"))
    return scratch.table(degree.groupBy("cluster", F.pmod(F.xxhash64(F.lit(5), "rep"), F.lit(PIVOTS)).alias("k")).agg(F.max_by("rep", F.struct("n", "rep")).alias("rep")).select("rep"))


def rare_shingles(sets: DataFrame, spec: Spec, scratch: Scratch) -> DataFrame:
    """(cluster, shingle, rep): of each unit in `sets` (cluster, rep, set), those of its rarest shingles that others of its cluster have too.

    In one order of a cluster's shingles, a link of sets of sizes m and n shares one that is among the first
    m - t + 1 of the one and the first n - u + 1 of the other, where t and u are num / den of m and n, rounded
    up: what both share has t and u members at least. The order is by the number of units that have a
    shingle, so that what many units have is hardly ever among the first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cluster, rep, s in zip(*(c.to_pylist() for c in batch.columns)):
                s = np.frombuffer(s, np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(s), x, np.int64)) for x in (cluster, rep, len(s))), pa.array(s)], names=["cluster", "rep", "n_shingles", "shingle"])

    all_ = scratch.table(sets.select("cluster", "rep", "set").mapInArrow(tidy(run), "cluster long, rep long, n_shingles long, shingle long"))
    # Written first, so that the join has exchanges of its own, whose hot shingles can be split.
    often = scratch.table(all_.groupBy("cluster", "shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = all_.join(often, ["cluster", "shingle"]).groupBy("cluster", "rep", "n_shingles").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("list"))
    # Shingles that no other unit has come first.
    alone = "n_shingles - size(list)"
    first = f"n_shingles - (n_shingles * {spec.num} + {spec.den - 1}) div {spec.den} + 1"
    rare = shared.select("cluster", "rep", F.explode(F.expr(f"slice(list.shingle, 1, cast(greatest(0, {first} - ({alone})) as int))")).alias("shingle"))
    found = scratch.table(rare)
    scratch.drop(all_, often)
    return found


def large_links(sets: DataFrame, pivots: DataFrame, spec: Spec, scratch: Scratch) -> DataFrame:
    """Edges inside clusters that are dealt over `blocks` tasks each.

    Pivots are sent to all blocks of their cluster. What they do not join to the largest component is then
    compared with all units of the cluster, in pairs of blocks, so a unit is sent 2 * PAIRED_BLOCKS times at
    most. In a larger cluster this is done for the units of each rare shingle: a unit is sent once for each
    of its rare shingles, unless very many units have one of them.
    """
    parts = lambda n, units: F.greatest(F.lit(1), F.ceil(n / BLOCK_SHINGLES), F.ceil(units / BLOCK_UNITS)).cast("long")
    all_ = scratch.table(sets)
    every = F.explode(F.expr("sequence(0L, blocks - 1)"))
    yes, no = F.lit(1).cast("long"), F.lit(0).cast("long")
    pivots = all_.join(pivots, "rep", "left_semi").select("cluster", every.alias("block"), "rep", "set", yes.alias("mark"))
    units = all_.select("cluster", F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("block"), "rep", "set", no.alias("mark"))
    first = scratch.table(by_group(units.unionByName(pivots), ["cluster", "block"], lambda i, u, p: pivot_links(i, u, p, spec)))
    joined = components(first, scratch).select(F.col("node").alias("rep"), F.col("root").alias("mark"))
    marked = scratch.table(all_.select("rep", "cluster", (F.octet_length("set") / 8).alias("n")).join(joined, "rep", "left").withColumn("mark", F.coalesce("mark", "rep")))
    apart = marked.groupBy("cluster").agg(F.min("mark").alias("low"), F.max("mark").alias("high"), F.sum("n").alias("n_all"), F.count(F.lit(1)).alias("all")).where("low <> high")
    apart = scratch.table(apart.select("cluster", (parts(F.col("n_all"), F.col("all")) > PAIRED_BLOCKS).alias("many")))
    if apart.isEmpty():
        return first
    small = apart.count() <= BROADCAST_UNITS
    keys = ["cluster", "shingle"]
    some = all_.select("cluster", "rep", "set").join(F.broadcast(apart) if small else apart, "cluster")
    # A cluster that is not large is one group, of no shingle.
    groups = some.where("not many").select("cluster", F.lit(0).cast("long").alias("shingle"), "rep")
    if not apart.where("many").isEmpty():
        groups = groups.unionByName(rare_shingles(some.where("many"), spec, scratch))
    shared = scratch.table(groups.join(marked.select("rep", "mark", "n"), "rep"))
    sizes = shared.groupBy(*keys, "mark").agg(F.count(F.lit(1)).alias("n_units"), F.sum("n").alias("n"))
    main = sizes.groupBy(*keys).agg(F.max_by("mark", F.struct("n_units", "mark")).alias("main"), F.sum("n").alias("n_all"), F.max_by("n", F.struct("n_units", "mark")).alias("n_main"), F.sum("n_units").alias("all"), F.max("n_units").alias("most"))
    main = scratch.table(main.where("all > most").select(*keys, "main", parts(F.col("n_all") - F.col("n_main"), F.col("all") - F.col("most")).alias("rows"), parts(F.col("n_all"), F.col("all")).alias("cols")))
    rest = scratch.table(shared.drop("n").join(main, keys)).join(all_.select("rep", "set"), "rep")
    row, col = F.pmod(F.xxhash64(F.lit(6), "rep"), F.col("rows")), F.pmod(F.xxhash64(F.lit(7), "rep"), F.col("cols"))
    span = lambda n: F.explode(F.expr(f"sequence(0L, {n} - 1)"))
    # Where there is one column, each row has all units from the right side.
    left = rest.where("mark <> main and cols > 1").select(*keys, row.alias("i"), span("cols").alias("j"), "rep", "set", "mark")
    right = rest.select(*keys, span("rows").alias("i"), col.alias("j"), "rep", "set", "mark")

    def second(ids, units, marks):
        once = dict(zip(ids, zip(units, marks)))  # a unit may be on both sides
        return confirm(list(once), [u for u, _ in once.values()], spec, [m for _, m in once.values()]) if len(once) > 1 else []

    return first.unionByName(by_group(left.unionByName(right), [*keys, "i", "j"], second))


def linked_units(docs: DataFrame, spec: Spec, scratch: Scratch) -> DataFrame:
    """Every unit with `rep` (its class) and `root` (its component); both null for units without words. All other tables of `scratch` are deleted."""
    units = scratch.table(sketch(docs, spec))
    some = units.where("n_shingles > 0")
    classes = scratch.table(some.groupBy("s1", "s2").agg(F.min("uid").alias("rep")))
    slim = some.select(F.col("uid").alias("rep"), "doc_id", "text_hash", "pos", "n_shingles", "bits", "bands")
    reps = scratch.table(slim.join(classes.select("rep"), "rep", "left_semi"))
    cand = components(candidate_links(reps, spec, scratch), scratch)
    clusters = scratch.table(cand.select(F.col("node").alias("rep"), F.col("root").alias("cluster")))
    sized = reps.select("rep", "doc_id", "text_hash", "pos", "n_shingles").join(clusters, "rep")
    weights = sized.groupBy("cluster").agg(F.sum("n_shingles").alias("w"), F.count(F.lit(1)).alias("n"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("w") / CLUSTER_SHINGLES), F.ceil(F.col("n") / CLUSTER_UNITS)).cast("long")
    wanted = scratch.table(sized.join(weights.select("cluster", blocks.alias("blocks")), "cluster"))
    links = scratch.table(small_links(full_sets(docs, wanted.where("blocks = 1"), spec), spec))
    large = wanted.where("blocks > 1")
    if not large.isEmpty():
        links = links.unionByName(large_links(full_sets(docs, large, spec), hubs(large, reps, scratch), spec, scratch))
    roots = components(links, scratch).select(F.col("node").alias("rep"), "root")
    named = classes.join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    out = scratch.table(units.drop("bits", "bands").join(named, ["s1", "s2"], "left"))
    scratch.keep(out)
    return out


def near_duplicates(docs: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, class_id, component_size."""
    scratch = Scratch(prepare(docs.sparkSession), "minhash")
    units = scratch.table(linked_units(docs, spec, scratch).select("doc_id", "uid", "n_shingles", "rep", F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("uid")).alias("root"), (F.col("n_shingles") > 0).alias("some")))
    # Written first, so that the join has exchanges of its own, whose hot components can be split.
    lows = scratch.table(units.groupBy("root", "some").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("component_size")))
    return units.join(lows, ["root", "some"]).select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), F.col("rep").alias("class_id"), "component_size")


def drop_near(docs: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """`docs` without those that are near another one with a smaller (doc_id, text_hash); all columns stay. Rows of equal id and text stay or go together."""
    scratch = Scratch(prepare(docs.sparkSession), "minhash-drop")
    units = scratch.table(linked_units(docs, spec, scratch).where("root is not null").select("doc_id", "text_hash", "root"))
    # Written first, so that the join has exchanges of its own, whose hot components can be split.
    firsts = scratch.table(units.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    gone = units.join(firsts, "root").where(~F.struct("doc_id", "text_hash").eqNullSafe(F.col("first"))).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    gone = scratch.table(gone)
    scratch.keep(gone)
    left = sealed(docs).join(gone, own("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64(F.coalesce(own("text"), F.lit(""))) == F.col("hash")), "left_anti")
    return opened(left, docs.columns)
