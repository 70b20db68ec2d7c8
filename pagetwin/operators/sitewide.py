"""Site-wide differences, summary and order of a comparison's pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagetwin.config import SIGNIFICANCE
from pagetwin.operators.diffs import ranked
from pagetwin.session import Scratch

KIND_ORDER = {"error": 0, "only-a": 1, "only-b": 2, "compared": 3}


@dataclass
class Consolidated:
    diffs: DataFrame  # differences left with their pages
    site_wide: DataFrame  # one row per difference on many pages, with its pages
    page_site_wide: DataFrame  # (path, fp)


def consolidate(diffs: DataFrame, pairs: DataFrame, min_pages: int = 3, min_fraction: float = 0.3) -> Consolidated:
    """Move differences that occur on many compared pages to one row each.

    Fingerprints are counted with map-side combining; those over the threshold are at most a page's
    differences divided by the fraction, so they are broadcast.
    """
    compared = pairs.where("kind = 'compared'").select("path", F.col("ord").alias("page_ord"))
    n = compared.count()
    threshold = max(min_pages, -(-int(round(min_fraction * n * 1_000_000)) // 1_000_000))
    movable = diffs.where("category not in ('page', 'visual')").join(compared, "path")
    counts = movable.groupBy("fp").agg(F.count_distinct("path").alias("n_pages")).where(F.col("n_pages") >= threshold)
    hits = movable.join(F.broadcast(counts), "fp")
    first = F.min_by(F.struct(*(c for c in diffs.columns if c not in ("path", "fp", "place"))), F.struct("page_ord", "category", "place")).alias("d")
    rows = hits.groupBy("fp").agg(first, F.array_sort(F.collect_set(F.struct("page_ord", "path"))).alias("on"), F.min(F.struct("page_ord", "category", "place")).alias("first"))
    site_wide = ranked(rows.select("fp", "d.*", F.transform("on", lambda x: x["path"]).alias("pages"), F.size("on").alias("n_pages"), "first"))
    keep = diffs.where("category in ('page', 'visual')").unionByName(diffs.where("category not in ('page', 'visual')").join(hits.select("path", "fp").distinct(), ["path", "fp"], "left_anti").select(*diffs.columns))
    return Consolidated(keep, site_wide.withColumn("place", F.row_number().over(Window.orderBy("rank", F.col("n_pages").desc(), "first")) - 1), hits.select("path", "fp").distinct())


def page_results(pairs: DataFrame, done: Consolidated) -> DataFrame:
    """Pairs with worst rank, number of differences and whether they are identical, in the order of a report."""
    per_page = ranked(done.diffs).groupBy("path").agg(F.min("rank").alias("worst"), F.count(F.lit(1)).alias("n_diffs"))
    wide = done.page_site_wide.groupBy("path").agg(F.count(F.lit(1)).alias("n_site_wide"))
    kind = F.create_map(*[F.lit(x) for kv in KIND_ORDER.items() for x in kv])
    out = pairs.join(per_page, "path", "left").join(wide, "path", "left").fillna({"worst": 99, "n_diffs": 0, "n_site_wide": 0})
    out = out.withColumn("identical", (F.col("kind") == "compared") & (F.col("n_diffs") == 0) & (F.col("n_site_wide") == 0))
    return out.withColumn("kind_ord", kind[F.col("kind")])


def report_order(pages: DataFrame) -> list:
    """Most serious first; whole pages before content; more differences first; then by path as people sort."""
    return [F.col("worst"), F.col("kind_ord"), F.col("n_diffs").desc(), F.collate("path", "UNICODE")]


def numbered(rows: DataFrame, order: list, name: str, scratch: Scratch) -> DataFrame:
    """`rows` with their places from 1 in `order` as `name`: ranges are sorted by themselves, and each adds the sizes of those before it."""
    dealt = scratch.table(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, row = F.shiftrightunsigned("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # a row for each partition
    before, starts = 0, []
    for r in sizes:
        starts.append((r["part"], before))
        before += r["n"]
    offsets = rows.sparkSession.createDataFrame(starts, "__part long, __before long")
    return dealt.join(F.broadcast(offsets), part == F.col("__part")).withColumn(name, F.col("__before") + row + 1).drop("__at", "__part", "__before")


def significance_counts(diffs: DataFrame, site_wide: DataFrame) -> DataFrame:
    """(sig, rank, n): differences of pages and site-wide ones, each of the latter once; all significances are listed."""
    spark = diffs.sparkSession
    names = spark.createDataFrame(list(enumerate(SIGNIFICANCE)), "rank int, sig string")
    counted = diffs.select("sig").unionByName(site_wide.select("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counted, "sig", "left").select("sig", "rank", F.coalesce("n", F.lit(0)).alias("n"))


def summary(pages: DataFrame, diffs: DataFrame, site_wide: DataFrame) -> DataFrame:
    """One row of totals."""
    is_kind = lambda k: F.col("kind") == k
    some = F.col("n_diffs") > 0
    totals = pages.agg(
        F.count_if(is_kind("compared")).alias("pages_compared"),
        F.count_if(F.col("identical")).alias("identical"),
        F.count_if(is_kind("compared") & ~F.col("identical") & ~some).alias("site_wide_only"),
        F.count_if(is_kind("compared") & some).alias("with_differences"),
        F.count_if(is_kind("only-a")).alias("only_a"),
        F.count_if(is_kind("only-b")).alias("only_b"),
        F.count_if(is_kind("error")).alias("errors"),
    )
    by_sig = significance_counts(diffs, site_wide).agg(F.sum("n").alias("total_differences"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("sig", "n")))).alias("by_significance"))
    wide = site_wide.agg(F.count(F.lit(1)).alias("site_wide"))
    one = F.lit(1).alias("one")
    return totals.withColumn("one", one).join(by_sig.withColumn("one", one), "one").join(wide.withColumn("one", one), "one").drop("one")


def top_per_category(diffs: DataFrame, most: int) -> DataFrame:
    """The first `most` differences of each category of a page, with how many there are."""
    w = Window.partitionBy("path", "category")
    order = w.orderBy("rank", "place", "fp")
    return ranked(diffs).withColumn("n_category", F.count(F.lit(1)).over(w)).withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
