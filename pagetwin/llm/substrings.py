"""Substring dedup: passages that repeat, near copies included, are cut from all but one place.

cut_paragraphs cuts what two steps find:

1. Paragraphs by MinHash banding (repeated_paragraphs): texts are parted at line ends and at the ends of
   sentences; paragraphs of MIN_WORDS words or more are sketched, banded for high recall (one minimum a
   band), joined where a band collides, confirmed on their full sets of five-word shingles (Jaccard 0.8 or
   more) and clustered by components. The first place of a cluster, by doc_id and then position, stays; of
   the others, runs of paragraphs with RUN_WORDS words or more are marked.
   Each marked paragraph is then compared with the one that stays, word by word (agreed_paragraphs): what
   reaches 0.8 between the first and the last words that agree is cut, if the run still has RUN_WORDS words.
   Words at the ends that repeat nothing stay, and so does a member of a cluster that is near other members only.
2. Passages over words (passages), which end anywhere, not only where sentences and lines end.

Both order places by (doc_id, hash of id and text, position), so that whatever a cut refers to is earlier;
no two places are cut for each other.

Defined results: null texts have no paragraphs; a passage repeated inside one document counts as
repeated; null doc_ids are smaller than any other; a document of repeated passages only is left with an
empty text; of equal rows, the passages of both stay or go; an empty table gives no rows; other columns
are kept as they are, but n_chars follows the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagetwin.llm.minhash import Spec, linked_units, words_of
from pagetwin.llm.passages import _WORD, RUN_WORDS, _rows, _with, cut_passages, word_hashes
from pagetwin.llm.rows import opened, own, sealed, tidy
from pagetwin.session import Scratch, prepare

MIN_WORDS = 8
SPEC = Spec(words=5, num=80, den=100, minima=64, lines=True, min_words=MIN_WORDS, rows=1, bands=5)
#: Documents with cuts, and cuts in all, that are broadcast at most; beyond, the join is shuffled.
BROADCAST_DOCS, BROADCAST_SPANS = 200_000, 1_000_000


def repeated_paragraphs(docs: DataFrame, spec: Spec = SPEC, run_words: int = RUN_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """One row per paragraph that is cut or stays for one that is cut: doc_id, text_hash, row, paragraph, start, end (code points), n_words, cluster_id, cluster_size, keep_doc_id, keep_paragraph, run, removed. Intermediate tables go to `scratch`, all others of which are deleted."""
    scratch = scratch or Scratch(docs.sparkSession, "substrings")
    prepare(docs.sparkSession)
    units = scratch.table(linked_units(docs, spec, scratch).where("root is not null").select("doc_id", "text_hash", "row", "pos", "start", "end", "n_words", "root"))
    scratch.keep(units)
    # Written first, so that the join has exchanges of its own, whose hot clusters can be split.
    firsts = scratch.table(units.groupBy("root").agg(F.count(F.lit(1)).alias("cluster_size"), F.min(F.struct("doc_id", "row", "pos")).alias("first")).where("cluster_size > 1"))
    found = units.join(firsts, "root").withColumn("again", ~((F.col("row") == F.col("first.row")) & (F.col("pos") == F.col("first.pos"))))
    # Neighbouring repeats of a text make a run; the window is as large as one text.
    by_text = Window.partitionBy("row", "again").orderBy("pos")
    runs = found.withColumn("run", F.when(F.col("again"), F.col("pos") - F.row_number().over(by_text)))
    long = runs.withColumn("run_words", F.sum("n_words").over(Window.partitionBy("row", "again", "run")))
    cut = scratch.table(long.withColumn("removed", F.col("again") & (F.col("run_words") >= run_words)).where("removed or not again"))
    kept_for = scratch.table(cut.where("removed").select("root").distinct())
    return cut.join(kept_for, "root", "left_semi").select(
        "doc_id", "text_hash", "row", F.col("pos").alias("paragraph"), "start", "end", "n_words", F.col("root").alias("cluster_id"), "cluster_size",
        F.col("first.doc_id").alias("keep_doc_id"), F.col("first.pos").alias("keep_paragraph"), "run", "removed",
    )


def agreeing(mine: np.ndarray, kept: np.ndarray, spec: Spec = SPEC) -> tuple[int, int] | None:
    """(start, end) of the words of a paragraph that are a near copy of words of `kept`, both as hashes in order; None where none are.

    It reaches from the first to the last shingle that both have, and to an end of the paragraph that agrees
    with the same end of `kept` in at least as many words as are then passed over: an edit near that end.
    """
    if np.array_equal(mine, kept):
        return 0, len(mine)
    n = spec.words
    x, y = ([w[i : i + n].tobytes() for i in range(len(w) - n + 1)] for w in (mine, kept))
    both = set(x) & set(y)
    if not both:
        return None
    (a, b), (c, d) = ((at[0], at[-1] + 1) for at in ([i for i, s in enumerate(z) if s in both] for z in (x, y)))
    short = min(len(mine), len(kept))
    lead = int(np.argmin(np.append(mine[:short] == kept[:short], False)))
    tail = int(np.argmin(np.append(mine[::-1][:short] == kept[::-1][:short], False)))
    wide = (0, 0) if 0 < a <= 2 * lead else (a, c), (len(x), len(y)) if 0 < len(x) - b <= 2 * tail else (b, d)
    for (s, t), (e, f) in (wide, ((a, c), (b, d))):
        p, q = set(x[s:e]), set(y[t:f])
        if spec.den * len(p & q) >= spec.num * len(p | q):
            return s, e + n - 1
    return None


def agreed_paragraphs(docs: DataFrame, scratch: Scratch, spec: Spec = SPEC, run_words: int = RUN_WORDS) -> DataFrame:
    """(doc, start, end: code points) of the marked paragraphs, as far as they agree with the ones that stay. Equal rows are one place."""
    prepare(docs.sparkSession)
    rows = _rows(docs)
    if not rows.groupBy("doc").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates(["doc"])
    marked = repeated_paragraphs(rows.select(F.struct("doc_id", "doc").alias("doc_id"), "text"), spec, run_words, scratch)
    marked = scratch.table(marked.select(F.col("doc_id.doc").alias("doc"), "paragraph", "start", "end", "cluster_id", "removed"))
    scratch.keep(marked)
    stay = marked.where("not removed").groupBy("doc").agg(F.collect_list(F.struct("cluster_id", "start", "end")).alias("list"))
    hashes = lambda text: word_hashes(words_of(text.encode()))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, places in zip(batch.column(0), batch.column(1)):
                text, places = t.as_py(), places.as_py()
                yield pa.RecordBatch.from_arrays([pa.array([p["cluster_id"] for p in places], pa.int64()), pa.array([hashes(text[p["start"] : p["end"]]).tobytes() for p in places], pa.binary())], names=["cluster_id", "words"])

    # Written first, so that the join has exchanges of its own, whose hot clusters can be split; equal rows give equal words.
    known = _with(docs, scratch.table(stay)).select("text", "list").mapInArrow(tidy(words), "cluster_id long, words binary")
    known = scratch.table(known.groupBy("cluster_id").agg(F.first("words").alias("words")))
    lists = scratch.table(marked.where("removed").join(known, "cluster_id").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("paragraph", "start", "end", "words"))).alias("list")))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, t, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                text, held, last = t.as_py(), [], None
                for p in [*found.as_py(), None]:
                    if p is None or last is None or p["paragraph"] != last + 1:  # a run ends
                        out += [(doc, s, e) for s, e, _ in held] if sum(n for *_, n in held) >= run_words else []
                        held = []
                    if p is None:
                        break
                    part = text[p["start"] : p["end"]]
                    if at := agreeing(hashes(part), np.frombuffer(p["words"], np.uint64), spec):
                        places = [m.span() for m in _WORD.finditer(part)]
                        held.append((p["start"] + places[at[0]][0], p["start"] + places[at[1] - 1][1], at[1] - at[0]))
                        last = p["paragraph"]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], names=["doc", "start", "end"])

    out = scratch.table(_with(docs, lists).select("doc", "text", "list").mapInArrow(tidy(spans), "doc long, start int, end int"))
    scratch.keep(out)
    return out


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans, those with white space only between them as one; a line that is cut whole goes with its end, else one space beside the span goes."""
    joined: list[list[int]] = []
    for start, end in sorted(spans):
        if joined and (start <= joined[-1][1] or text[joined[-1][1] : start].isspace()):
            joined[-1][1] = max(joined[-1][1], end)
        else:
            joined.append([start, end])
    out, at = [], 0
    for start, end in joined:
        start = max(start, at)
        if end <= start:
            continue
        opens, closes = start == 0 or text[start - 1] == "\n", end == len(text) or text[end] == "\n"
        if opens and closes:
            if end < len(text):
                end += 1
            elif start > at:
                start -= 1
        elif end < len(text) and text[end] == " ":
            end += 1
        out.append(text[at:start])
        at = end
    out.append(text[at:])
    return "".join(out)


def cut_paragraphs(docs: DataFrame) -> DataFrame:
    """`docs` with the repeated paragraphs and passages cut from their texts; all rows and columns stay."""
    scratch, banded = Scratch(docs.sparkSession, "substrings-cut"), Scratch(docs.sparkSession, "substrings")
    paragraphs = agreed_paragraphs(docs, banded)
    found = cut_passages(docs, scratch).select("doc", "start", "end").unionByName(paragraphs)
    cuts = scratch.table(found.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("cut")))
    scratch.keep(cuts)
    banded.keep()
    size = cuts.agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("cut")).alias("spans")).first()
    few = size["docs"] <= BROADCAST_DOCS and (size["spans"] or 0) <= BROADCAST_SPANS

    @F.arrow_udf("string")
    def shortened(texts: pa.Array, cut: pa.Array) -> pa.Array:
        return pa.array([cut_spans(t.as_py(), [(s["start"], s["end"]) for s in c.as_py()]) for t, c in zip(texts, cut)], pa.string())

    joined = sealed(docs).join(F.broadcast(cuts) if few else cuts, F.xxhash64(own("doc_id"), F.coalesce(own("text"), F.lit(""))) == F.col("doc"), "left")
    hit = F.col("cut").isNotNull()
    none = F.array().cast("array<struct<start:int,end:int>>")
    text = F.when(hit, shortened(F.when(hit, own("text")).otherwise(F.lit("")), F.coalesce("cut", none))).otherwise(own("text"))
    made = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(hit, F.length("left").cast(docs.schema["n_chars"].dataType)).otherwise(own("n_chars"))
    return opened(joined.withColumn("left", text), docs.columns, **made)
