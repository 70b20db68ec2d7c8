"""Live sites as recorded answers: crawled level by level with the polite reader, so that the comparison can work on tables.

Levels follow the order in which pages and their links were found. A site gives at most `maxPages` pages and
`maxProbes` direct requests for what only the other one has.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagetwin.functions import urls
from pagetwin.operators.crawl import first_wins, sitemap_urls
from pagetwin.operators.snapshots import with_raw
from pagetwin.session import Scratch
from pagetwin.sources.http import Fetcher, fetch
from pagetwin.sources.sites import SERVED

#: Sitemap documents that are read of a site at most, indexes included.
SITEMAP_DOCUMENTS = 6
SITEMAP = "site string, url string, ord int"


def sitemap_rows(spark: SparkSession, site: str, scope: urls.Scope, listed: list[str], read: Callable[[str], str | None]) -> DataFrame:
    """(site, url, ord) of a site's sitemaps: its own and those that robots.txt lists; an index names others. read: text of an address, or None."""
    waiting, documents, at = list(dict.fromkeys([f"{scope.origin}{scope.base_path}sitemap.xml", *listed])), [], 0
    while at < min(len(waiting), SITEMAP_DOCUMENTS):
        xml = read(waiting[at]) or ""
        at += 1
        if re.search("<sitemapindex", xml, re.I):
            inner = spark.createDataFrame([(xml,)], "x string").select(sitemap_urls(F.col("x"))).first()[0]
            waiting += [u for u in dict.fromkeys(inner) if u not in waiting]
        else:
            documents.append((site, at, xml))
    found = spark.createDataFrame(documents, "site string, n int, x string").select("site", "n", F.posexplode(sitemap_urls(F.col("x"))).alias("pos", "url"))
    first = first_wins(found, ["site", "url"], ["n", "pos"])  # six documents at most
    return first.select("site", "url", (F.row_number().over(Window.partitionBy("site").orderBy("n", "pos")) - 1).alias("ord"))


@dataclass
class Recorded:
    served: DataFrame
    robots: dict[str, list[tuple[str, bool]]]
    sitemaps: DataFrame
    stopped: bool


def answers(got: DataFrame) -> DataFrame:
    """Rows of SERVED from what the reader fetched (site and RESULT): one for every hop, and one for where it ended."""
    path = lambda u: F.regexp_replace(F.regexp_replace(u, "^[^:]+://[^/?#]*", ""), "#.*$", "")
    rooted = lambda u: F.when(F.startswith(path(u), F.lit("/")), path(u)).otherwise(F.concat(F.lit("/"), path(u)))
    none = F.lit(None).cast("string")
    hops = got.select("site", "final_url", "redirects", F.posexplode("redirects").alias("n", "hop"))
    following = F.coalesce(F.get("redirects", F.col("n") + 1)["url"], F.col("final_url"))
    moved = hops.select("site", rooted(F.col("hop.url")).alias("path"), F.col("hop.status").alias("status"), following.alias("redirect_to"), none.alias("content_type"), none.alias("html"), none.alias("error"))
    ends = got.where("not off_site").select("site", rooted(F.col("final_url")).alias("path"), "status", none.alias("redirect_to"), "content_type", "html", F.when(~F.col("robots_blocked"), F.col("error")).alias("error"))
    return moved.unionByName(ends).dropDuplicates(["site", "path"])


def record(spark: SparkSession, starts: dict[str, str], cfg: dict, stop: Callable[[], bool] = lambda: False) -> Recorded:
    """Crawl live sites (start URL by site). `stop` is asked between levels; what was fetched until then is kept."""
    scopes = {s: urls.create_scope(u, cfg) for s, u in starts.items()}
    per = lambda get: reduce(lambda rest, kv: F.when(F.col("site") == kv[0], F.lit(get(kv[1]))).otherwise(rest), scopes.items(), F.lit(None).cast("string"))
    host, base = per(lambda s: s.host), per(lambda s: s.base_path)
    key = lambda u: urls.to_key(u, base, cfg)
    scratch, reader, crawl = Scratch(spark, "live"), Fetcher(cfg), cfg["crawl"]
    respected = cfg["http"]["respectRobotsTxt"]
    robots = {s: reader.robots(sc.start_url) if respected else [] for s, sc in scopes.items()}
    listed = {s: reader.rules[sc.origin][1] if respected else [] for s, sc in scopes.items()}
    maps = [sitemap_rows(spark, s, sc, listed[s], reader.text) for s, sc in scopes.items()] if crawl["useSitemap"] else [spark.createDataFrame([], SITEMAP)]
    sitemaps = scratch.table(reduce(DataFrame.unionByName, maps))

    def ask(level: DataFrame) -> DataFrame:
        """What requests of (site, url, place) give."""
        wanted = scratch.table(level)
        got = fetch(wanted, cfg).join(wanted.select("site", F.col("url").alias("requested_url"), "place"), "requested_url")
        return scratch.table(got.withColumn("key", key(F.col("requested_url"))).withColumn("final_key", key(F.col("final_url"))))

    def linked(got: DataFrame) -> DataFrame:
        """(site, url, key, above, place) of the links that may be followed."""
        raw = with_raw(got.where("html is not null and not off_site and status < 400").select("site", "final_url", "html", F.col("place").alias("above")), cfg)
        out = raw.select("site", "above", F.posexplode("raw.links").alias("place", "l")).select("site", "above", "place", F.regexp_replace("l.href", "#.*$", "").alias("url"))
        return out.where(urls.reject_reason(F.col("url"), host, base, cfg).isNull()).withColumn("key", key(F.col("url")))

    level = spark.createDataFrame([(s, sc.start_url, 1) for s, sc in scopes.items()], "site string, url string, place int")
    all_got, stopped, left = [], False, {s: crawl["maxPages"] for s in scopes}
    for depth in range(crawl["maxDepth"] + 1):
        got = ask(level)
        all_got.append(got)
        seen = reduce(DataFrame.unionByName, [g.select("site", k).toDF("site", "key") for g in all_got for k in ("key", "final_key")]).distinct()
        for r in got.groupBy("site").agg(F.count_distinct("final_key").alias("n")).collect():
            left[r["site"]] -= r["n"]
        if stop():
            stopped = True
            break
        if depth == crawl["maxDepth"] or max(left.values()) <= 0:
            break
        found = linked(got)
        if depth == 0 and crawl["useSitemap"]:
            seeds = sitemaps.where(urls.reject_reason(F.col("url"), host, base, cfg).isNull()).select("site", "url", F.lit(1 << 30).alias("above"), F.col("ord").alias("place"))
            found = found.unionByName(seeds.withColumn("key", key(F.col("url"))).select(found.columns))
        new = first_wins(found.join(seen, ["site", "key"], "left_anti"), ["site", "key"], ["above", "place"])
        level = _first(new, ["above", "place"], left)
        if level.isEmpty():
            break
    if not stopped:
        ok = scratch.table(reduce(DataFrame.unionByName, [g.where("not robots_blocked and not off_site and status is not null and status not in (404, 410)").select("site", "final_key") for g in all_got]).distinct())
        other = ok.select(F.element_at(F.create_map(*map(F.lit, ("A", "B", "B", "A"))), F.col("site")).alias("site"), F.col("final_key").alias("key")).join(seen, ["site", "key"], "left_anti")
        direct = other.withColumn("url", F.concat(per(lambda s: s.origin + s.base_path.removesuffix("/")), "key"))
        all_got.append(ask(_first(direct, ["key"], dict.fromkeys(scopes, crawl["maxProbes"]))))
    served = scratch.table(answers(reduce(DataFrame.unionByName, all_got)).select(*(c.split()[0] for c in SERVED.split(", "))))
    return Recorded(served, robots, sitemaps, stopped)


def _first(rows: DataFrame, order: list[str | Column], most: dict[str, int]) -> DataFrame:
    """(site, url, place): the first rows of each site, as many as it has left; each site is cut by a limit of its own."""
    parts = [rows.where(F.col("site") == s).orderBy(*order).limit(max(0, n)) for s, n in most.items()]
    cut = reduce(DataFrame.unionByName, parts)
    return cut.select("site", "url", F.row_number().over(Window.partitionBy("site").orderBy(*order)).alias("place"))  # at most maxPages rows a site
