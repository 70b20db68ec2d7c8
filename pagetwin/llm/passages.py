"""Repeated passages over the words of texts, wherever they start and end.

1. Every GRAM words in a row have a 64-bit hash; of every WINDOW neighbouring ones the least is an anchor.
   So RUN_WORDS shared words in a row hold an anchor of both texts, whatever stands around them: neither
   sentences nor lines matter.
2. Of the places of an anchor, the first by doc_id and then position stays; each other one repeats it.
   Anchors that repeat the same text at the same distance make a run.
3. Runs are extended word by word at both ends as far as both texts agree. An anchor follows within
   WINDOW words of shared text, so WINDOW - 1 words at each end are enough.
4. Runs of the same text that lie one after the other there too are one near copy with the words between
   them when the whole reaches 0.8 (Jaccard of five-word shingles). No other words between runs are cut.
5. What runs and near copies cover is a passage, and is cut when it has RUN_WORDS words or more in a row.

Every cut word equals one at an earlier place, or is an edit inside of a near copy of it. Words are runs without ASCII
white space, lower-cased A-Z, and are compared as 64-bit hashes.

Defined results: null texts have no words; a passage repeated inside one document counts as repeated; null
doc_ids are smaller than any other; equal rows are one place; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetwin.llm.minhash import _LOWER, mix, words_of
from pagetwin.llm.rows import narrow, tidy
from pagetwin.session import Scratch, prepare

RUN_WORDS = 20
GRAM = 12
WINDOW = RUN_WORDS - GRAM + 1
SHINGLE, NUM, DEN = 5, 80, 100
#: Documents whose keys are broadcast at most; beyond, the join is shuffled.
BROADCAST_DOCS = 400_000
_WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def anchors_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of a text."""
    n = len(words) - GRAM + 1
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = word_hashes(words)
    acc = np.full(n, 0x9E3779B97F4A7C15 * GRAM & (2**64 - 1), np.uint64)
    for j in range(GRAM):
        acc = mix(acc + h[j : n + j])
    at = np.unique(np.lib.stride_tricks.sliding_window_view(acc, WINDOW).argmin(1) + np.arange(n - WINDOW + 1))
    return at, acc[at]


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, text); `doc` stands for the id and the text."""
    return narrow(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("doc"), "text")


def _with(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """Texts of the documents in `lists` (doc, list)."""
    rows = _rows(docs)
    if lists.count() <= BROADCAST_DOCS:
        rows = rows.join(F.broadcast(lists.select("doc")), "doc", "left_semi")
    return rows.join(lists, "doc").select("doc_id", "doc", "text", "list")


def anchors(docs: DataFrame) -> DataFrame:
    rows = _rows(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors_of(words_of(t.as_py().encode())) for t in batch.column(2)]
            src = pa.array(np.repeat(np.arange(len(found)), [len(at) for at, _ in found]))
            at, key = (np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(src), batch.column(1).take(src), pa.array(at.astype(np.int32)), pa.array(key.astype(np.uint64).view(np.int64))], names=["doc_id", "doc", "pos", "key"])

    return rows.mapInArrow(tidy(run), f"doc_id {kind}, doc long, pos int, key long")


def runs(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, kept, keep_doc_id, from, to, shifts, n): the words from-to of `kept` stand in `doc` too, as many words later as each of `shifts` says."""
    all_ = scratch.table(anchors(docs))
    # Written first, so that the join has exchanges of its own, whose hot anchors can be split.
    firsts = scratch.table(all_.groupBy("key").agg(F.min(F.struct("doc_id", "doc", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    hits = all_.select("doc", "pos", "key").join(firsts, "key").where(f"doc <> first.doc or pos - first.pos >= {GRAM}")
    anchor = F.struct((F.col("pos") - F.col("first.pos")).alias("shift"), "pos", "n")
    pairs = hits.groupBy("doc", F.col("first.doc").alias("kept")).agg(F.first("first.doc_id").alias("keep_doc_id"), F.array_sort(F.collect_set(anchor)).alias("at"))
    # Anchors of one shift that touch or overlap are a run. Runs that repeat one stretch are a row: text that repeats itself has many.
    last = lambda at, of: f"coalesce(get({at}, k + 1), size({of})) - 1"
    most = lambda of, to: f"array_max(transform(slice({of}, i + 1, {to} - i + 1), x -> x.n))"
    pairs = pairs.withColumn("b", F.expr(f"filter(sequence(0, size(at) - 1), i -> i = 0 or at[i].shift <> at[i - 1].shift or at[i].pos - at[i - 1].pos > {GRAM})"))
    to = last("b", "at")
    pairs = pairs.withColumn("r", F.array_sort(F.expr(f"transform(b, (i, k) -> struct(at[i].pos - at[i].shift as from, at[{to}].pos + {GRAM} - at[i].shift as to, at[i].shift as shift, {most('at', to)} as n))")))
    pairs = pairs.withColumn("c", F.expr("filter(sequence(0, size(r) - 1), i -> i = 0 or r[i].from <> r[i - 1].from or r[i].to <> r[i - 1].to)"))
    to = last("c", "r")
    spans = F.expr(f"transform(c, (i, k) -> struct(r[i].from as from, r[i].to as to, transform(slice(r, i + 1, {to} - i + 1), x -> x.shift) as shifts, {most('r', to)} as n))")
    found = scratch.table(pairs.select("doc", "kept", "keep_doc_id", F.explode(spans).alias("x")).select("doc", "kept", "keep_doc_id", "x.*"))
    scratch.drop(all_, firsts)
    return found


def edges(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, at, after, words): hashes of the WINDOW - 1 words before or after the place `at`."""
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("at", "after")).alias("list"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, t, places in zip(batch.column(1), batch.column(2), batch.column(3)):
                h, places = word_hashes(words_of(t.as_py().encode())), places.as_py()
                cut = [h[p["at"] : p["at"] + WINDOW - 1] if p["after"] else h[max(0, p["at"] - WINDOW + 1) : p["at"]] for p in places]
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * len(places), pa.int64()), pa.array([p["at"] for p in places], pa.int32()), pa.array([p["after"] for p in places], pa.bool_()), pa.array([c.tobytes() for c in cut], pa.binary())], names=["doc", "at", "after", "words"])

    # Equal rows give equal edges.
    return _with(docs, lists).mapInArrow(tidy(run), "doc long, at int, after boolean, words binary").groupBy("doc", "at", "after").agg(F.first("words").alias("words"))


def near_copies(parts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Stretches (start, end, shift) that repeat one text, as (start, end, start there, end there), joined over edits where the whole is a near copy."""
    now = [(a, b, a - s, b - s, max(0, b - a - SHINGLE + 1)) for a, b, s in sorted(parts)]
    while True:
        out = now[:1]
        for a, b, c, d, k in now[1:]:
            a0, b0, c0, d0, k0 = out[-1]
            over = max(0, b0 - a, d0 - c)  # words that both hold count once
            shared = k0 + max(0, k - over)
            total = (b - a0 - SHINGLE + 1) + (d - c0 - SHINGLE + 1) - shared
            if b > b0 and d > d0 and c >= c0 and DEN * shared >= NUM * total:
                out[-1] = (a0, b, c0, d, shared)
            else:
                out.append((a, b, c, d, k))
        if len(out) == len(now):
            return [x[:4] for x in out]
        now = out


def passages_of(h, n: int, found: list[dict], run_words: int) -> list[tuple[int, int, int, list]]:
    """(start, end, places, [(kept, keep_doc_id, start there, end there)]) in words of a text of n words with hashes h(k)."""
    by: dict[int, list] = {}
    sizes = []
    for r in found:
        before, after = np.frombuffer(r["before"], np.uint64).tolist()[::-1], np.frombuffer(r["after"], np.uint64).tolist()
        for shift in r["shifts"]:
            s, e = r["from"] + shift, r["to"] + shift
            sizes.append((s, r["n"]))
            for w in before:
                if not s or h(s - 1) != w:
                    break
                s -= 1
            for w in after:
                if e == n or h(e) != w:
                    break
                e += 1
            by.setdefault(r["kept"], []).append((s, e, shift))
    ids = {r["kept"]: r["keep_doc_id"] for r in found}
    out: list = []
    for a, b, c, d, kept in sorted((*p, kept) for kept, parts in by.items() for p in near_copies(parts)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b, []])
        out[-1][2].append((kept, ids[kept], c, d))
    return [(a, b, max(k for s, k in sizes if a <= s < b), parts) for a, b, parts in out if b - a >= run_words]


def cut_passages(docs: DataFrame, scratch: Scratch, run_words: int = RUN_WORDS) -> DataFrame:
    """(doc_id, doc, at, start, end, n_words, cluster_size, parts) of what is cut; start and end count code points, `at` words."""
    prepare(docs.sparkSession)
    found = runs(docs, scratch)
    ends = found.select(F.col("kept").alias("doc"), F.explode(F.array(F.struct(F.col("from").alias("at"), F.lit(False).alias("after")), F.struct(F.col("to").alias("at"), F.lit(True).alias("after")))).alias("x"))
    known = scratch.table(edges(docs, scratch.table(ends.select("doc", "x.at", "x.after").distinct())))
    side = lambda after, name, words: known.where(F.col("after") == after).select(F.col("doc").alias("kept"), F.col("at").alias(name), F.col("words").alias(words))
    full = found.join(side(False, "from", "before"), ["kept", "from"]).join(side(True, "to", "after"), ["kept", "to"])
    lists = scratch.table(full.groupBy("doc").agg(F.collect_list(F.struct("kept", "keep_doc_id", "from", "to", "shifts", "n", "before", "after")).alias("list")))
    texts = _with(docs, lists)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, rows = [], []
            for k, (t, found) in enumerate(zip(batch.column(2), batch.column(3))):
                text = t.as_py()
                places = [(m.start(), m.end()) for m in _WORD.finditer(text)]
                h = lambda i: xxhash.xxh64_intdigest(text[places[i][0] : places[i][1]].encode().translate(_LOWER))  # noqa: B023, E731
                for a, b, n, parts in passages_of(h, len(places), found.as_py(), run_words):
                    src.append(k)
                    rows.append((a, places[a][0], places[b - 1][1], b - a, n, [dict(zip(("kept", "keep_doc_id", "start", "end"), p)) for p in parts]))
            take = pa.array(src, pa.int64())
            part = pa.list_(pa.struct([("kept", pa.int64()), ("keep_doc_id", batch.column(0).type), ("start", pa.int32()), ("end", pa.int32())]))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, (*(pa.int32(),) * 4, pa.int64(), part))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *cols], names=["doc_id", "doc", "at", "start", "end", "n_words", "cluster_size", "parts"])

    out = scratch.table(texts.mapInArrow(tidy(run), f"doc_id {kind}, doc long, at int, start int, end int, n_words int, cluster_size long, parts array<struct<kept:long,keep_doc_id:{kind},start:int,end:int>>"))
    scratch.keep(out)
    return out


def repeated_passages(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """One row per passage that is cut or stays for one that is cut: doc_id, paragraph, start, end (code points), n_words, keep_doc_id, keep_paragraph, cluster_size, removed. Passages are named by their first word."""
    scratch = Scratch(prepare(docs.sparkSession), "passages")
    cut = cut_passages(docs, scratch, run_words)
    # A passage may be put together from several places; the longest is named.
    longest = F.expr("array_max(transform(parts, p -> struct(p.end - p.start as n, p as p))).p")
    gone = cut.withColumn("p", longest).select("doc_id", F.col("at").alias("paragraph"), "start", "end", "n_words", F.col("p.keep_doc_id").alias("keep_doc_id"), F.col("p.start").alias("keep_paragraph"), "cluster_size", F.lit(True).alias("removed"))
    spans = cut.select("cluster_size", F.explode("parts").alias("p")).groupBy(F.col("p.kept").alias("doc"), F.col("p.start").alias("at"), F.col("p.end").alias("to")).agg(F.max("cluster_size").alias("n"))
    lists = scratch.table(spans.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("at", "to", "n"))).alias("list")))
    texts = _with(docs, lists)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, rows = [], []
            for k, (t, spans) in enumerate(zip(batch.column(2), batch.column(3))):
                places = [(m.start(), m.end()) for m in _WORD.finditer(t.as_py())]
                joined: list = []
                for s in spans.as_py():
                    if joined and s["at"] <= joined[-1][1]:
                        joined[-1][1:] = max(joined[-1][1], s["to"]), max(joined[-1][2], s["n"])
                    else:
                        joined.append([s["at"], s["to"], s["n"]])
                src += [k] * len(joined)
                rows += [(a, places[a][0], places[b - 1][1], b - a, n) for a, b, n in joined]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (*(pa.int32(),) * 4, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(src, pa.int64())), *cols], names=["doc_id", "paragraph", "start", "end", "n_words", "cluster_size"])

    stay = texts.mapInArrow(tidy(run), f"doc_id {kind}, paragraph int, start int, end int, n_words int, cluster_size long")
    stay = stay.withColumn("keep_doc_id", F.col("doc_id")).withColumn("keep_paragraph", F.col("paragraph")).withColumn("removed", F.lit(False))
    return gone.unionByName(stay)
