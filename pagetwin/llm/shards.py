"""Sharding by vector bin packing under the `bytes` law.

Equal texts form a group. Groups are hashed into cells; a group with more than a cell's share of
bytes or rows is dealt over several cells by document. Cells carry a vector (bytes, tokens, rows);
the driver places at most `shards * CELLS_PER_SHARD` cells, largest first, each where the dot product
of its vector with a shard's residual capacity is highest, and last levels the bytes by moving cells.
Rows never gather in one task: a slot is the cell's base plus the rank within the cell.

Defined results: null text has no bytes (size 16, CRC of nothing); equal rows all get slots of their
own; an empty table gives no rows; null doc_ids come first in their cell. Documents larger than a
shard's share are placed alone where there is most room.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagetwin.llm.rows import narrow
from pagetwin.session import Scratch

SHARDS = 40
CELLS_PER_SHARD = 256
OVERHEAD = 16


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each row of `vectors` (cells by resources)."""
    total = vectors.sum(0)
    need = vectors / np.where(total > 0, total / shards, 1)
    residual = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), np.int32)
    for k in np.argsort(-need.max(1), kind="stable"):
        v = need[k]
        fits = (residual >= v - 1e-12).all(1)
        score = residual @ v
        # Where it fits nowhere, the shard with most bytes left takes it.
        at = int(np.argmax(np.where(fits, score, -np.inf))) if fits.any() else int(np.argmax(residual[:, 0]))
        residual[at] -= v
        out[k] = at
    return level(vectors[:, 0].astype(np.int64), out, shards)


def level(size: np.ndarray, at: np.ndarray, shards: int, rounds: int = 400) -> np.ndarray:
    """Move single cells from the fullest to the emptiest shard, or swap two, while that narrows the gap in bytes."""
    load = np.bincount(at, weights=size, minlength=shards).astype(np.int64)
    for _ in range(rounds):
        hi, lo = int(load.argmax()), int(load.argmin())
        gap = int(load[hi] - load[lo])
        mine, other = np.flatnonzero(at == hi), np.flatnonzero(at == lo)
        if gap <= 1 or not len(mine):
            break
        order = other[np.argsort(size[other], kind="stable")]
        theirs = np.concatenate([[0], size[order]])
        # The best partner (or none, size 0) makes the moved amount closest to half the gap.
        want = size[mine] - gap / 2
        k = np.clip(np.searchsorted(theirs, want), 0, len(theirs) - 1)
        k = np.where((k > 0) & (np.abs(theirs[np.maximum(k - 1, 0)] - want) < np.abs(theirs[k] - want)), k - 1, k)
        moved = size[mine] - theirs[k]
        best = int(np.argmin(np.abs(moved - gap / 2)))
        if not 0 < moved[best] < gap:
            break
        at[mine[best]] = lo
        if k[best]:
            at[order[k[best] - 1]] = hi
        load[hi] -= moved[best]
        load[lo] += moved[best]
    return at


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per input row: doc_id, size, tokens, text_crc32, shard, slot."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.col("text")
    base = scratch.table(
        narrow(docs).select(
            "doc_id",
            F.monotonically_increasing_id().alias("uid"),
            (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
            F.when(text == "", F.lit(0)).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long").alias("tokens"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(F.lit(1), text).alias("g1"),
            F.xxhash64(F.lit(2), text).alias("g2"),
        )
    )
    cells = shards * CELLS_PER_SHARD
    total = base.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    parts = F.ceil(F.greatest(F.col("b") * cells / max(total["b"], 1), F.col("n") * cells / max(total["n"], 1)))
    # A group of several rows that outweighs a cell: at most 2 * cells of them exist, so they can be broadcast.
    hot = base.groupBy("g1", "g2").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (parts > 1)).select("g1", "g2", F.least(parts, F.col("n")).cast("long").alias("parts"))
    dealt = base.join(F.broadcast(hot), ["g1", "g2"], "left")
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("doc_id", "uid"), F.col("parts"))).otherwise(F.lit(0))
    celled = dealt.withColumn("cell", F.pmod(F.xxhash64("g1", "g2", part), F.lit(cells)).cast("int"))
    loads = celled.groupBy("cell").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).orderBy("cell").collect()  # at most `cells` rows
    where = place(np.array([[r["b"], r["t"], r["n"]] for r in loads], np.float64).reshape(-1, 3), shards)
    base_slot, plan = [0] * shards, []
    for r, s in zip(loads, where.tolist()):
        plan.append((r["cell"], s, base_slot[s]))
        base_slot[s] += r["n"]
    placed = spark.createDataFrame(plan, "cell int, shard int, base_slot long")
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("doc_id", "uid"))
    return celled.join(F.broadcast(placed), "cell").select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("base_slot") + rank - 1).alias("slot"))
