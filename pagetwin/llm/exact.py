"""Exact dedup by content-defined chunk recipes.

Each text is cut where a rolling gear hash of its last 32 bytes says so. Chunk ids are 128-bit
hashes whose bytes are compared inside every equal bucket; a bucket that holds different bytes gets
ids from SHA-256 instead. Two texts are equal when their ordered lists of chunk ids are. Only chunk
bytes are moved once, and ids after that; long texts are never compared with each other.

Defined results: null text counts as empty; an empty text is a recipe of no chunks; of equal texts
the largest doc_id stays (a null doc_id is smaller than any other; of wholly equal rows one stays);
an empty table gives no rows; other columns are ignored whatever their names are.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetwin.llm.rows import narrow, opened, own, sealed, wide_hash
from pagetwin.session import Scratch, prepare

WINDOW = 32
MIN_BYTES, MEAN_BITS, MAX_BYTES = 256, 10, 8192
_BLOCK = 1 << 20


def _gear_table() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240)).integers(0, 1 << 32, 256, dtype=np.uint32)


GEAR = _gear_table()


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash of the 32 bytes that end at each place, by doubling."""
    h = GEAR[data]
    step = 1
    while step < WINDOW:
        older = h[:-step] << np.uint32(step)
        h[step:] += older
        step *= 2
    return h


def candidates(data: np.ndarray) -> np.ndarray:
    """Ends of chunks that the hash proposes (offset after the byte), block by block."""
    found, mask = [], np.uint32(((1 << MEAN_BITS) - 1) << (32 - MEAN_BITS))
    for lo in range(0, len(data), _BLOCK):
        back = min(lo, WINDOW)
        h = gear(data[lo - back : lo + _BLOCK])[back:]
        found.append(np.flatnonzero((h & mask) == 0) + (lo + 1))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def cut(proposed: list[int], start: int, end: int) -> list[int]:
    """Chunk ends of data[start:end], counted from start: proposals kept MIN to MAX bytes apart."""
    ends, at = [], start
    while end - at > MIN_BYTES:
        k = bisect_left(proposed, at + MIN_BYTES)
        to = proposed[k] if k < len(proposed) else end
        to = min(to, at + MAX_BYTES, end)
        ends.append(to - start)
        at = to
    if at < end:
        ends.append(end - start)
    return ends


def chunk_ends(texts: pa.Array) -> pa.Array:
    """List of chunk ends in UTF-8 bytes for each text."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    proposed = (candidates(data[offsets[0] : offsets[-1]]) + int(offsets[0])).tolist()
    values, lens = [], [0]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        values += cut(proposed, a, b)
        lens.append(len(values))
    return pa.ListArray.from_arrays(pa.array(lens, pa.int32()), pa.array(values, pa.int32()))


def _with_chunks(docs: DataFrame) -> DataFrame:
    @F.arrow_udf("array<int>")
    def ends(text: pa.Array) -> pa.Array:
        return chunk_ends(text)

    return docs.withColumn("ends", ends("text")).withColumn(
        "chunks",
        F.expr("transform(ends, (e, i) -> substring(cast(text as binary), if(i = 0, 0, ends[i - 1]) + 1, e - if(i = 0, 0, ends[i - 1])))"),
    )


def chunk_id(c, bits: int = 128):
    """Unverified id of a chunk. Fewer bits only serve tests of the verification."""
    return wide_hash(c, salt=3) if bits >= 128 else F.pmod(F.xxhash64(c), F.lit(1 << bits)).cast("string")


def recipes(docs: DataFrame, scratch: Scratch, hash_bits: int = 128) -> DataFrame:
    """(doc_id, uid, recipe, text_sha256), one row per input row. recipe: verified chunk ids in order."""
    chunked = _with_chunks(narrow(docs))
    ident = F.transform("chunks", lambda c: chunk_id(c, hash_bits))
    base = scratch.table(chunked.select("doc_id", F.monotonically_increasing_id().alias("uid"), ident.alias("recipe"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")))
    each = chunked.select(F.explode("chunks").alias("bytes")).select(chunk_id(F.col("bytes"), hash_bits).alias("id"), "bytes")
    clashes = scratch.table(each.groupBy("id").agg(F.min("bytes").alias("lo"), F.max("bytes").alias("hi")).where("lo <> hi").select("id"))
    if clashes.isEmpty():
        return base
    # Different bytes share an id: chunks of such ids are named by their SHA-256.
    numbered = chunked.select("doc_id", F.monotonically_increasing_id().alias("uid"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "chunks")
    again = numbered.select("doc_id", "uid", "text_sha256", F.posexplode_outer("chunks").alias("at", "bytes"))
    named = again.withColumn("id", chunk_id(F.col("bytes"), hash_bits)).withColumn("sha", F.sha2("bytes", 256)).drop("bytes")
    named = named.join(clashes.withColumn("clash", F.lit(True)), "id", "left").withColumn("id", F.when(F.col("clash"), F.concat_ws("-", "id", "sha")).otherwise(F.col("id")))
    lists = named.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("text_sha256").alias("text_sha256"), F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("at", "id")))).alias("list"))
    return scratch.table(lists.select("doc_id", "uid", F.col("list.id").alias("recipe"), "text_sha256"))


def exact_groups(docs: DataFrame, hash_bits: int = 128, scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks. Intermediate tables go to `scratch`."""
    scratch = scratch or Scratch(prepare(docs.sparkSession), "exact")
    prepare(docs.sparkSession)
    base = recipes(docs, scratch, hash_bits)
    # Written first, so that the join has exchanges of its own, whose hot recipes can be split.
    best = scratch.table(base.groupBy("recipe").agg(F.max(F.struct("doc_id", "uid")).alias("best"), F.count(F.lit(1)).alias("group_size")))
    joined = base.join(best, "recipe")
    return joined.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("uid") == F.col("best.uid")).alias("kept"),
        "text_sha256",
        F.size("recipe").alias("n_chunks"),
    )


def drop_exact(docs: DataFrame) -> DataFrame:
    """`docs` without the copies that exact_groups drops; all columns stay.

    Where one doc_id has several rows, rows of equal id and text are reduced to one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-drop")
    groups = scratch.table(exact_groups(docs, scratch=scratch).select("doc_id", "kept", "text_sha256"))
    scratch.keep(groups)
    ids = groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("any_kept"))
    gone = ids.where("not any_kept").select(F.col("doc_id").alias("gone"))
    left = sealed(docs).join(gone, own("doc_id").eqNullSafe(F.col("gone")), "left_anti")
    if ids.where("n > 1").isEmpty():
        return opened(left, docs.columns)
    kept = groups.where("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("kept_sha")).distinct()
    marked = left.withColumn("sha", F.sha2(F.coalesce(own("text"), F.lit("")).cast("binary"), 256))
    found = marked.join(kept, own("doc_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("kept_sha")), "left_semi")
    return opened(found.withColumn("id", own("doc_id")).dropDuplicates(["id", "sha"]), docs.columns)
