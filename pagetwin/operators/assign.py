"""One-to-one assignment by a total order of edges."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagetwin.operators.graph import components
from pagetwin.session import Scratch, prepare


def assign_greedy(edges: DataFrame, order: list, scratch: Scratch, within: list[str] = ()) -> DataFrame:
    """Edges (a, b, ...) that a scan in `order` takes when each end may be used once.

    In each round the edges that come first for both of their ends are taken at once, and all edges
    at those ends go. With a strict total order that equals the scan; rounds are few, and each is
    written to shared storage. `within`: columns that part independent problems.
    """
    groups = list(within)
    left = scratch.table(edges.withColumn("__rank", F.struct(*order)))
    taken = []
    while not left.isEmpty():
        first = lambda end: F.min("__rank").over(Window.partitionBy(*groups, end))
        ranked = left.withColumn("__a", first("a")).withColumn("__b", first("b"))
        best = scratch.table(ranked.where((F.col("__rank") == F.col("__a")) & (F.col("__rank") == F.col("__b"))).drop("__a", "__b"))
        taken.append(best)
        rest = left.join(best.select(*groups, "a").distinct(), [*groups, "a"], "left_anti").join(best.select(*groups, "b").distinct(), [*groups, "b"], "left_anti")
        left = scratch.table(rest.select(*left.columns))
    out = taken[0] if taken else left
    for t in taken[1:]:
        out = out.unionByName(t)
    return out.drop("__rank")


def take_level(edges: list[tuple], free_a: dict, free_b: dict) -> Iterator[tuple]:
    """Pairs (a, b) of members that a scan by (a, b) takes along class edges (x, y) of one similarity; free members are lists, first ones last, and are used up."""
    near: dict = {}
    for x, y in edges:
        if free_a.get(x) and free_b.get(y):
            near.setdefault(x, []).append(y)
    heap = [(free_a[x][-1], x) for x in near]
    heapq.heapify(heap)
    while heap:
        _, x = heap[0]
        near[x] = [y for y in near[x] if free_b[y]]
        if near[x]:
            y = min(near[x], key=lambda y: free_b[y][-1])
            yield free_a[x].pop(), free_b[y].pop()
        if near[x] and free_a[x]:
            heapq.heapreplace(heap, (free_a[x][-1], x))
        else:
            heapq.heappop(heap)


def assign_classes(members: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, similarity) that a scan by (-similarity, ord of a, ord of b) takes when each member may be used once.

    `members`: side (a or b), key, ord (a number, unique on a side), c; `edges`: x, y, similarity of a class of a's
    and one of b's, each of which stands for all pairs of their members. A component of classes is scanned in one
    task, copies in their order, so neither all pairs of copies nor a round for each of them are made.
    """
    spark = prepare(members.sparkSession)
    linked = components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")), scratch)
    used = edges.select(F.explode(F.array("x", "y")).alias("c")).distinct()
    comp = scratch.table(used.join(linked, used["c"] == linked["node"], "left").select("c", F.coalesce("root", "c").alias("comp")))
    key = members.schema["key"].dataType.simpleString()
    nobody, nothing = F.lit(None).cast(key).alias("key"), F.lit(None).cast("long")
    rows = members.join(comp, "c").select("comp", F.lit(None).cast("double").alias("s"), (-F.col("ord").cast("long")).alias("back"), "key", F.when(F.col("side") == "a", F.col("c")).alias("x"), F.when(F.col("side") == "b", F.col("c")).alias("y"))
    links = edges.join(comp, edges["x"] == comp["c"]).select("comp", (-F.col("similarity")).alias("s"), nothing.alias("back"), nobody, "x", "y")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = at = None
        free_a: dict = {}
        free_b: dict = {}
        level: list = []
        out: list = []

        def finish() -> None:
            out.extend((a[1], b[1], -at) for a, b in take_level(level, free_a, free_b))
            level.clear()

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) or [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), pa.array(cols[1], kind), pa.array(cols[2], pa.float64())], names=["a", "b", "similarity"])

        kind = pa.null()
        for batch in batches:
            kind = batch.column(3).type
            for comp, s, back, key, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                if comp != now or s != at:
                    if level:
                        finish()
                    at = s
                if comp != now:
                    now = comp
                    free_a.clear(), free_b.clear()
                if s is not None:
                    level.append((x, y))
                elif y is None:
                    free_a.setdefault(x, []).append((-back, key))
                else:
                    free_b.setdefault(y, []).append((-back, key))
            if out:
                yield flush()
        if level:
            finish()
        if out:
            yield flush()

    # Members before edges, the last ones first; edges by falling similarity.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.unionByName(links).repartition(parts, "comp").sortWithinPartitions("comp", F.col("s").asc_nulls_first(), "back")
    return scratch.table(dealt.mapInArrow(scan, f"a {key}, b {key}, similarity double"))
