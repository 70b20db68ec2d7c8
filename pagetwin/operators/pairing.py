"""Matching the pages of two sites, each at most once: path, redirect, URL variant, content, rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagetwin.functions.text import shingle_hashes
from pagetwin.functions.urls import loose_key
from pagetwin.operators.assign import assign_classes, assign_greedy
from pagetwin.operators.crawl import Crawl, first_wins
from pagetwin.session import Scratch

TITLE_BOOST = 0.15
#: Rows of numbers that are broadcast at most; beyond, the join is shuffled.
BROADCAST_ROWS = 1_000_000


def page_state(status: Column, error: Column, has_snapshot: Column) -> Column:
    """missing, error or ok; null (no page) is none."""
    return F.when(status.isin(404, 410), F.lit("missing")).when(error.isNotNull() | status.isNull() | (status >= 400) | ~has_snapshot, F.lit("error")).otherwise(F.lit("ok"))


def page_classes(left: DataFrame, right: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(classes, members) of pages with words: classes of equal sets and titles (c, title, set, n, in_a, in_b), and all pages (side, key, ord, c). Copies are compared as one."""
    columns = ["key", "title", "full_text", "ord"]
    sets = scratch.table(
        left.select(F.lit("a").alias("side"), *columns).unionByName(right.select(F.lit("b").alias("side"), *columns))
        .select("side", "key", "ord", F.coalesce("title", F.lit("")).alias("title"), shingle_hashes(F.col("full_text")).alias("set"))
        .where(F.size("set") > 0)
        .withColumn("sorted", F.sort_array("set"))
        .select("*", F.xxhash64("sorted").alias("h1"), F.xxhash64(F.lit(1), "sorted").alias("h2"), F.size("set").alias("n"), F.monotonically_increasing_id().alias("u"))
        .drop("sorted")
    )
    # Sets are written once and never shuffled here: only the copies' numbers are joined to them.
    same = ["h1", "h2", "n", "title"]
    groups = sets.groupBy(*same).agg(F.min("u").alias("c"), F.max(F.col("side") == "a").alias("in_a"), F.max(F.col("side") == "b").alias("in_b"), F.count(F.lit(1)).alias("k")).where("k > 1")
    copies = scratch.table(sets.select("u", *same).join(groups, same).select("u", "c", "in_a", "in_b"))
    rows = sets.join(_small(copies), "u", "left")
    own = lambda c, alone: F.coalesce(c, alone).alias(c)
    classes = rows.where("c is null or c = u").select(own("c", F.col("u")), "title", "set", "n", own("in_a", F.col("side") == "a"), own("in_b", F.col("side") == "b"))
    return classes, rows.select("side", "key", "ord", own("c", F.col("u")))


def _small(rows: DataFrame) -> DataFrame:
    """To be broadcast if there are few enough."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def similar_classes(classes: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """All pairs (x, y, similarity) of a class with left pages and one with right pages that reach the threshold, itself included.

    Exact, without a cross join: shingles are put in order of rarity, and two sets can only be similar
    enough if they share one of their first, rarest ones, and as much behind it. A shingle that is on
    every page is never joined on unless a page has nothing rarer.
    """
    each = classes.select("c", (F.col("in_a").cast("int") + F.col("in_b").cast("int") * 2).cast("byte").alias("sides"), F.explode("set").alias("s"))
    # A window, so that the shingles are shuffled once.
    by = Window.partitionBy("s")
    shared = each.withColumn("df", F.count(F.lit(1)).over(by)).withColumn("all", F.bit_or("sides").over(by)).where("df > 1 and all = 3").select("c", "s", "df")
    # Shingles that cannot be shared come first in the order; only their number matters.
    of = Window.partitionBy("c")
    ranked = shared.withColumn("rank", F.row_number().over(of.orderBy("df", "s")) - F.count(F.lit(1)).over(of))
    ranked = ranked.join(classes.select("c", "title", "n", "in_a", "in_b"), "c").withColumn("rank", F.col("rank") + F.col("n"))
    titled = max(0.01, threshold - TITLE_BOOST)
    prefix = lambda least: F.col("n") - F.ceil(F.col("n") * least) + 1
    last = F.when(F.col("title") != "", prefix(titled)).otherwise(prefix(threshold))
    head = scratch.table(ranked.where(F.col("rank") <= last).select("c", "title", "s", "n", "in_a", "in_b", "rank", (F.col("rank") <= prefix(threshold)).alias("first")))

    def sharing(rows: DataFrame, least: float, *on: str) -> DataFrame:
        """Pairs that share a prefix shingle behind which enough others can be shared: this holds for the first one that they share."""
        ha = rows.where("in_a").select(F.col("c").alias("x"), "s", *on, F.col("n").alias("na"), F.col("rank").alias("ra"))
        hb = rows.where("in_b").select(F.col("c").alias("y"), "s", *on, F.col("n").alias("nb"), F.col("rank").alias("rb"))
        most = F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb")) + 1
        return ha.join(hb, ["s", *on]).where((F.col("x") != F.col("y")) & (most * (1 + least) >= (F.col("na") + F.col("nb")) * least - 1e-6)).select("x", "y")

    # Only pages of the same title are helped over the threshold by it, so only they are looked for below it.
    cand = scratch.table(sharing(head.where("first"), threshold).union(sharing(head.where("title <> ''"), titled, "title")).distinct())
    wanted = scratch.table(cand.select(F.explode(F.array("x", "y")).alias("c")).distinct())
    picked = scratch.table(classes.select("c", "title", "set").join(_small(wanted), "c", "left_semi"))
    sx, sy = (picked.select(F.col("c").alias(k), F.col("set").alias(f"set_{k}"), F.col("title").alias(f"title_{k}")) for k in "xy")
    inter = F.size(F.array_intersect("set_x", "set_y"))
    sim = inter / (F.size("set_x") + F.size("set_y") - inter)
    boosted = F.when((F.col("title_x") != "") & (F.col("title_x") == F.col("title_y")), F.least(F.lit(1.0), sim + TITLE_BOOST)).otherwise(sim)
    found = cand.join(sx, "x").join(sy, "y").select("x", "y", boosted.alias("similarity")).where(F.col("similarity") >= threshold)
    out = scratch.table(found.unionByName(classes.where("in_a and in_b").select(F.col("c").alias("x"), F.col("c").alias("y"), F.lit(1.0).alias("similarity"))))
    scratch.drop(head, cand, wanted, picked)
    return out


def similar_pages(left: DataFrame, right: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """All pairs (a, b, similarity) of left and right (key, full_text, title) that reach the threshold."""
    classes, members = page_classes(*(d.withColumn("ord", F.lit(0)) for d in (left, right)), scratch)
    edges = similar_classes(classes, threshold, scratch)
    a, b = (members.where(F.col("side") == s).select(F.col("key").alias(s), F.col("c").alias(c)) for s, c in ("ax", "by"))
    return edges.join(a, "x").join(b, "y").select("a", "b", "similarity")


def moved_pages(left: DataFrame, right: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Left and right (key, full_text, title, ord) matched one to one: (a, b, similarity) that a scan takes by falling similarity, then by `ord` of the left and the right page."""
    classes, members = page_classes(left, right, scratch)
    return assign_classes(members, similar_classes(classes, threshold, scratch), scratch)


def pair_pages(crawl: Crawl, cfg: dict) -> DataFrame:
    """path, key_a, key_b, match, redirect_on, code, similarity, kind, other_state, other_text, ord for every pair and one-sided page."""
    spark = crawl.pages.sparkSession
    scratch = Scratch(spark, "pairing")
    pages = scratch.table(crawl.pages.withColumn("state", page_state(F.col("status"), F.col("error"), F.col("snap").isNotNull())).select("site", "key", "state", "status", "error", "probed", "crawl_ord", F.col("snap.meta.title.norm").alias("title"), "full_text"))
    side = {s: pages.where(F.col("site") == s).drop("site") for s in "AB"}
    # Only keys that a crawl reached itself are listed as one-sided; probes may still be matched.
    keys = pages.where("not probed and state <> 'missing'").select("key").distinct()
    found = []

    def add(df: DataFrame, step: int, match: str, **cols: Column) -> None:
        given = {"path": F.col("key_a"), "redirect_on": F.lit(None).cast("string"), "code": F.lit(None).cast("string"), "similarity": F.lit(None).cast("double"), "place": F.lit(0.0), "name": F.col("key_a")} | cols
        found.append(scratch.table(df.select("key_a", "key_b", F.lit(match).alias("match"), *(c.alias(n) for n, c in given.items() if n not in ("place", "name")), F.struct(F.lit(step).alias("step"), given["place"].cast("double").alias("place"), given["name"].alias("name")).alias("ord"))))

    def free(s: str, states=("ok",)) -> DataFrame:
        out = side[s].where(F.col("state").isin(*states))
        for f in found:
            out = out.join(f.select(F.col(f"key_{s.lower()}").alias("key")), "key", "left_anti")
        return out

    # 1. Same path on both; pages that fail count, missing ones don't.
    here = ("ok", "error")
    add(free("A", here).select("key").join(free("B", here).select("key"), "key").join(keys, "key").select(F.col("key").alias("key_a"), F.col("key").alias("key_b")), 1, "same-path")

    # 2. One side redirects the other's path to a page that is still free.
    fa, fb = (free(s).select("key") for s in "AB")
    alias = {s: crawl.aliases.where(F.col("site") == s).select("req_key", "final_key", "code") for s in "AB"}
    on_b = fa.join(keys, "key").join(alias["B"], F.col("key") == F.col("req_key")).join(fb.select(F.col("key").alias("kb")), F.col("final_key") == F.col("kb")).select(F.col("key").alias("a"), F.col("kb").alias("b"), F.col("key").alias("k"), F.lit(0).alias("dir"), F.lit("B").alias("redirect_on"), "code")
    on_a = fb.join(keys, "key").join(alias["A"], F.col("key") == F.col("req_key")).join(fa.select(F.col("key").alias("ka")), F.col("final_key") == F.col("ka")).select(F.col("ka").alias("a"), F.col("key").alias("b"), F.col("key").alias("k"), F.lit(1).alias("dir"), F.lit("A").alias("redirect_on"), "code")
    taken = assign_greedy(on_b.unionByName(on_a), ["k", "dir"], scratch)
    add(taken.select(F.col("a").alias("key_a"), F.col("b").alias("key_b"), "k", "dir", F.col("redirect_on").alias("r"), F.col("code").alias("c")), 2, "redirect", redirect_on=F.col("r"), code=F.col("c"), place=F.col("dir"), name=F.col("k"))

    # 3. Paths that differ only cosmetically; the first in crawl order wins on both sides.
    first = {s: first_wins(free(s).select("key", "crawl_ord", loose_key(F.col("key")).alias("loose")), ["loose"], ["crawl_ord"]) for s in "AB"}
    add(first["A"].select(F.col("key").alias("key_a"), "loose", "crawl_ord").join(first["B"].select(F.col("key").alias("key_b"), "loose"), "loose"), 3, "url-variant", place=F.col("crawl_ord"))

    # 4. Similar content under another path.
    left, right = (free(s).withColumnRenamed("crawl_ord", "ord") for s in "AB")
    moved = moved_pages(left, right, cfg["compare"]["renameSimilarity"], scratch)
    add(moved.select(F.col("a").alias("key_a"), F.col("b").alias("key_b"), F.col("similarity").alias("s")), 4, "moved", similarity=F.col("s"), place=-F.col("s"))

    # 5. What is left exists on one side only, or failed to load there.
    ra, rb = (free(s, here).join(keys, "key").select("key") for s in "AB")
    none = F.lit(None).cast("string")
    add(ra.join(rb, "key", "left_anti").select(F.col("key").alias("key_a"), none.alias("key_b")), 5, "none")
    add(rb.join(ra, "key", "left_anti").select(none.alias("key_a"), F.col("key").alias("key_b")), 5, "none", path=F.col("key_b"), name=F.col("key_b"))
    # add() made them in two goes; neither sees the other, as their keys are distinct.
    pairs = found[0]
    for f in found[1:]:
        pairs = pairs.unionByName(f)

    own = lambda s: side[s].select(F.col("key").alias(f"key_{s.lower()}"), *(F.col(c).alias(f"{c}_{s.lower()}") for c in ("state", "status", "error", "probed")))
    pairs = pairs.join(own("A"), "key_a", "left").join(own("B"), "key_b", "left")
    kind = (
        F.when((F.col("state_a") == "error") | (F.col("state_b") == "error"), F.lit("error"))
        .when(F.col("key_a").isNull(), F.lit("only-b"))
        .when(F.col("key_b").isNull(), F.lit("only-a"))
        .otherwise(F.lit("compared"))
    )
    pairs = scratch.table(pairs.withColumn("kind", kind))
    return scratch.table(_with_other(pairs, pages, crawl))


def _with_other(pairs: DataFrame, pages: DataFrame, crawl: Crawl) -> DataFrame:
    """What the other site says about a one-sided page."""
    far = F.when(F.col("key_b").isNull(), F.lit("B")).when(F.col("key_a").isNull(), F.lit("A"))
    asked = pairs.withColumn("far", far)
    blocked = crawl.robots_blocked.select(F.col("site").alias("far"), F.col("key").alias("path"), F.lit(True).alias("robots"))
    alias = crawl.aliases.select(F.col("site").alias("far"), F.col("req_key").alias("path"), F.col("final_key").alias("to"))
    rec = pages.select(F.col("site").alias("far"), F.col("key").alias("at"), F.col("state").alias("far_state"), F.col("status").alias("far_status"), F.col("error").alias("far_error"))
    used = pairs.select(F.lit("A").alias("far"), F.col("key_a").alias("to")).union(pairs.select(F.lit("B"), "key_b")).where("to is not null").distinct().withColumn("used", F.lit(True))
    down = crawl.limits.select(F.col("site").alias("far"), "unreachable")
    out = asked.join(blocked, ["far", "path"], "left").join(alias, ["far", "path"], "left").withColumn("at", F.coalesce("to", "path")).join(rec, ["far", "at"], "left").join(used, ["far", "to"], "left").join(F.broadcast(down), "far", "left")
    why = F.when(F.col("unreachable").isNotNull(), F.concat(F.lit("site unreachable ("), "unreachable", F.lit(")"))).otherwise(F.lit("crawl.maxProbes limit reached"))
    state = F.when(F.col("far").isNull(), F.lit(None)).when(F.col("robots"), F.lit("robots")).when(F.col("far_state").isNull(), F.lit("unknown")).when(F.col("to").isNotNull(), F.lit("redirect")).otherwise(F.col("far_state"))
    text = (
        F.when(state == "robots", F.lit("not checked: disallowed by robots.txt"))
        .when(state == "unknown", F.concat(F.lit("not checked: "), why))
        .when(state == "redirect", F.concat(F.lit("redirects to "), "to", F.when(F.col("used"), F.lit(" (a page matched to a different page on the other site)")).otherwise(F.lit(""))))
        .when((state == "missing") | F.col("far_error").isNull(), F.concat(F.lit("returns HTTP "), F.col("far_status").cast("string")))
        .otherwise(F.col("far_error"))
    )
    return out.withColumn("other_state", state).withColumn("other_text", F.when(state.isNotNull(), text)).select(*pairs.columns, "other_state", "other_text")
