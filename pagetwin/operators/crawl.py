"""Bounded breadth-first crawl of recorded sites, as joins over a link table.

`served` holds what the sites answer: site, key, status, redirect_key (in-scope target of a redirect),
redirect_url (any other target), error, content_type, html, url. A crawl is a closure by levels; every
level is written to shared storage. Within a level, order is (place of the linking page, place of the
link), so limits cut where a first-in-first-out queue would.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagetwin.functions import urls
from pagetwin.operators.snapshots import looks_js_rendered, with_snapshots
from pagetwin.session import Scratch


@dataclass
class Crawl:
    """What a crawl of both sites found, all by `site`."""

    pages: DataFrame  # site, key, final_url, status, error, snap, full_text, depth, found_by, probed, crawl_ord, ...
    aliases: DataFrame  # site, req_key, final_key, code
    robots_blocked: DataFrame  # site, key
    skipped: DataFrame  # site, url, reason
    limits: DataFrame  # site, fetched, limit_reached, unreachable, probes


def served_pages(served: DataFrame, scopes: dict[str, urls.Scope], cfg: dict) -> DataFrame:
    """Recorded answers (site, path, status, redirect_to, content_type, html, error) with keys; the first of a key counts."""
    per = lambda get: F.coalesce(*(F.when(F.col("site") == s, F.lit(get(sc))) for s, sc in scopes.items()))
    origin, host, base = per(lambda s: s.origin), per(lambda s: s.host), per(lambda s: s.base_path)
    url = F.concat(origin, F.col("path"))
    target = F.when(F.col("redirect_to").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.col("redirect_to")).otherwise(F.concat(origin, F.col("redirect_to")))
    inside = F.col("redirect_to").isNotNull() & urls.is_in_scope(target, host, base, cfg)
    keyed = served.withColumn("url", url).withColumn("key", urls.to_key(url, base, cfg)).withColumn("redirect_key", F.when(inside, urls.to_key(target, base, cfg))).withColumn("redirect_url", F.when(F.col("redirect_to").isNotNull() & ~inside, target))
    return first_wins(keyed, ["site", "key"], ["path"])


def capped(html: Column, most: int) -> Column:
    """At most the first `most` bytes of a page; a character that is cut in two is replaced."""
    return F.when(F.octet_length(html) <= most, html).otherwise(F.decode(F.substring(F.encode(html, "UTF-8"), 1, most), "UTF-8"))


def first_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def robots_allow(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether robots rules [(path pattern, allowed)] let a path through: the longest match decides, and of equal ones the allowing."""
    out = F.lit(True)
    for pattern, allowed in sorted((r for r in rules if r[0]), key=lambda r: (len(r[0]), r[1])):
        anchored = pattern.endswith("$")
        body = ".*".join(map(_quote, pattern.removesuffix("$").split("*")))
        out = F.when(path.rlike(f"^{body}{'$' if anchored else ''}"), F.lit(allowed)).otherwise(out)
    return out


def _quote(s: str) -> str:
    return "".join(c if c.isalnum() or c in "/_~" else f"\\{c}" for c in s)


def resolve_redirects(served: DataFrame, blocked: DataFrame, cfg: dict, scratch: Scratch) -> DataFrame:
    """What a request of each key gives: site, req_key, final_key, code, hops, robots, error, off_url."""
    hop = served.select("site", F.col("key").alias("at"), "redirect_key", "redirect_url", F.col("status").cast("string").alias("hop_code"))
    stop = blocked.select("site", F.col("key").alias("at"), F.lit(True).alias("stop"))
    left = served.select("site", F.col("key").alias("req_key"), F.col("key").alias("at"), F.lit(None).cast("string").alias("code"), F.lit(0).alias("hops"))
    done = []
    for n in range(cfg["http"]["maxRedirects"] + 1):
        now = left.join(hop, ["site", "at"], "left").join(stop, ["site", "at"], "left")
        on = F.col("stop").isNull() & F.col("redirect_key").isNotNull()
        done.append(now.where(~on).select("site", "req_key", F.col("at").alias("final_key"), "code", "hops", F.col("stop").isNotNull().alias("robots"), F.when(F.col("stop").isNull() & F.col("redirect_url").isNotNull(), F.concat(F.lit("Leads off the site, to "), "redirect_url")).alias("redirect_error")))
        left = scratch.table(now.where(on).select("site", "req_key", F.col("redirect_key").alias("at"), F.coalesce("code", "hop_code").alias("code"), F.lit(n + 1).alias("hops")))
        if left.isEmpty():
            break
    else:
        done.append(left.select("site", "req_key", F.col("at").alias("final_key"), "code", "hops", F.lit(False).alias("robots"), F.lit(f"Still redirected after {cfg['http']['maxRedirects']} hops").alias("redirect_error")))
    return reduce(DataFrame.unionByName, done)


def sitemap_urls(xml: Column) -> Column:
    """Locations of a sitemap document; an index gives those of other sitemaps."""
    found = F.regexp_extract_all(xml, F.lit(r"(?i)<loc>\s*(?:<!\[CDATA\[)?\s*([^<\]]+?)\s*(?:\]\]>)?\s*</loc>"), F.lit(1))
    return F.when(xml.rlike("(?i)<(urlset|sitemapindex)"), F.transform(found, lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))).otherwise(F.array().cast("array<string>"))


def crawl_sites(served: DataFrame, scopes: dict[str, urls.Scope], robots: dict[str, list[tuple[str, bool]]], cfg: dict, sitemaps: DataFrame | None = None) -> Crawl:
    """Crawl the recorded sites, then look up on each what only the other one has (probes).

    sitemaps: (site, url, ord) of sitemap locations, if any.
    """
    spark = served.sparkSession
    scratch = Scratch(spark, "crawl")
    per = lambda get: F.coalesce(*(F.when(F.col("site") == s, F.lit(get(sc))) for s, sc in scopes.items()))
    host, base = per(lambda s: s.host), per(lambda s: s.base_path)
    crawl = cfg["crawl"]
    site_pages = served_pages(served, scopes, cfg)
    on_page = F.col("redirect_to").isNull() & F.col("html").isNotNull() & (F.col("content_type").isNull() | (F.col("content_type") == "") | F.contains("content_type", F.lit("html")))
    parsed = with_snapshots(site_pages.withColumn("html", F.when(on_page, capped(F.col("html"), cfg["http"]["maxBodyBytes"]))).withColumn("final_url", F.col("url")), scopes, cfg)
    ok = (F.col("status") >= 200) & (F.col("status") < 300)
    not_html = F.when(~on_page & ok & F.col("error").isNull() & F.col("redirect_to").isNull(), F.concat(F.lit("Not an HTML page ("), F.when(F.coalesce("content_type", F.lit("")) == "", F.lit("unknown type")).otherwise(F.col("content_type")), F.lit(")")))
    known = scratch.table(parsed.withColumn("error", F.coalesce("error", not_html)).withColumn("js_rendered", looks_js_rendered(F.col("raw"), cfg)).drop("raw", "html"))
    respects = cfg["http"]["respectRobotsTxt"]
    allowed = F.coalesce(*(F.when(F.col("site") == s, robots_allow(F.regexp_replace("url", "^[^:]+://[^/]*", ""), robots.get(s, []))) for s in scopes)) if respects else F.lit(True)
    blocked = scratch.table(known.where(~allowed).select("site", "key"))
    answers = scratch.table(resolve_redirects(known, blocked, cfg, scratch))

    link = known.where(F.col("snap").isNotNull() & (F.col("status") < 400)).select("site", "key", F.posexplode(F.filter("snap.links", lambda x: x["inside"])).alias("link_ord", "l")).select("site", "key", "link_ord", F.regexp_replace("l.href", "#.*$", "").alias("url"))
    link = link.withColumn("reason", urls.reject_reason(F.col("url"), host, base, cfg)).withColumn("target", urls.to_key(F.col("url"), base, cfg))
    links = scratch.table(link)
    edges = links.where("reason is null").select("site", F.col("key").alias("final_key"), "link_ord", "target")

    start = spark.createDataFrame([(s, sc.start_url) for s, sc in scopes.items()], "site string, url string")
    level = start.select("site", urls.to_key(F.col("url"), base, cfg).alias("key"), F.lit(0).alias("parent_ord"), F.lit(0).alias("link_ord"), F.lit("start URL").alias("found_by"))
    queued, fetched, cut = scratch.table(level.select("site", "key")), [], []
    before = spark.createDataFrame([(s, 0) for s in scopes], "site string, n int")
    for depth in range(crawl["maxDepth"] + 1):
        items = _answered(level, answers, scopes)
        held = reduce(DataFrame.unionByName, fetched).select("site", F.col("final_key").alias("key")).distinct() if fetched else None
        if held is not None:
            items = items.join(held, ["site", "key"], "left_anti")
        order = Window.partitionBy("site").orderBy("parent_ord", "link_ord", "key")
        items = scratch.table(items.withColumn("pos", F.row_number().over(order)))
        items = _skip_reached(items)
        items = items.join(F.broadcast(before), "site").withColumn("crawl_ord", F.col("n") + F.row_number().over(order)).drop("n")
        placed = scratch.table(items.withColumn("depth", F.lit(depth)))
        now = placed.where(F.col("crawl_ord") <= crawl["maxPages"])
        fetched.append(now)
        cut.append(placed.where(F.col("crawl_ord") > crawl["maxPages"]).select("site"))
        if depth == crawl["maxDepth"]:
            break
        out = now.where("not robots").select("site", "final_key", "crawl_ord").join(edges, ["site", "final_key"]).select("site", F.col("target").alias("key"), F.col("crawl_ord").alias("parent_ord"), "link_ord", F.col("final_key").alias("found_by"))
        if depth == 0 and sitemaps is not None and crawl["useSitemap"]:
            reachable = now.join(known.select("site", F.col("key").alias("final_key"), "status"), ["site", "final_key"], "left").where("status is not null").select("site")
            # Sitemaps are a few documents (sources.live), so their order is found in one task a site.
            seeds = sitemaps.join(reachable, "site").where(urls.reject_reason(F.col("url"), host, base, cfg).isNull()).withColumn("ord", F.row_number().over(Window.partitionBy("site").orderBy("ord")) - 1).where(F.col("ord") < crawl["maxPages"] * 2)
            out = out.unionByName(seeds.select("site", urls.to_key(F.col("url"), base, cfg).alias("key"), F.lit(1).alias("parent_ord"), (F.col("ord") + 1_000_000).alias("link_ord"), F.lit("sitemap.xml").alias("found_by")))
        level = scratch.table(first_wins(out.join(queued, ["site", "key"], "left_anti"), ["site", "key"], ["parent_ord", "link_ord"]))
        if level.isEmpty():
            break
        queued = scratch.table(queued.unionByName(level.select("site", "key")))
        counts = now.groupBy("site").agg(F.max("crawl_ord").alias("m"))
        before = scratch.table(before.join(counts, "site", "left").select("site", F.coalesce("m", "n").alias("n")))

    visits = scratch.table(reduce(DataFrame.unionByName, fetched).withColumn("probed", F.lit(False)))
    probes = _probes(visits, known, answers, scopes, crawl["maxProbes"])
    visits = scratch.table(visits.unionByName(probes.select(visits.columns)))
    stored = first_wins(visits.where("not robots"), ["site", "final_key"], ["crawl_ord"]).withColumn("key", F.col("final_key"))
    record = stored.join(known.drop("redirect_to", "redirect_key", "redirect_url"), ["site", "key"], "left")
    lost = F.col("url").isNull()
    pages = record.withColumn("status", F.when(F.col("redirect_error").isNotNull(), F.col("status")).when(lost, F.lit(404)).otherwise(F.col("status"))).withColumn("error", F.coalesce("redirect_error", "error"))
    origin = per(lambda s: s.origin + s.base_path.removesuffix("/"))
    pages = pages.withColumn("final_url", F.coalesce("final_url", F.concat(origin, "key"))).withColumn("rendered", F.lit(False))
    pages = scratch.table(pages.select("site", "key", "final_url", "status", "error", "content_type", "snap", "full_text", "js_rendered", "depth", "found_by", "probed", "crawl_ord", "rendered"))
    aliases = visits.where("not robots and final_key <> req_key").select("site", "req_key", "final_key", F.coalesce("code", F.lit("redirect")).alias("code"))
    robots_blocked = visits.where("robots").select("site", F.col("req_key").alias("key")).distinct()
    seen = visits.where("not robots and not probed").select("site", F.col("final_key").alias("key")).distinct()
    rejected = links.where("reason is not null and reason <> 'outside site'").join(seen, ["site", "key"]).select("site", "url", "reason").distinct()
    root = per(lambda s: s.origin + s.base_path.removesuffix("/"))
    by_robots = visits.where("robots and not probed").select("site", F.concat(root, "req_key").alias("url"), F.lit("disallowed by robots.txt").alias("reason"))
    limits = visits.groupBy("site").agg(F.count_if(~F.col("probed")).alias("fetched"), F.count_if("probed").alias("probes"))
    over = reduce(DataFrame.unionByName, cut).groupBy("site").count().select("site", F.lit(True).alias("limit_reached"))
    first = pages.where("crawl_ord = 1 and status is null and error is not null").select("site", F.col("error").alias("unreachable"))
    limits = limits.join(over, "site", "left").join(first, "site", "left").withColumn("limit_reached", F.coalesce("limit_reached", F.lit(False)))
    return Crawl(pages, aliases, robots_blocked, rejected.unionByName(by_robots), limits)


def _answered(level: DataFrame, answers: DataFrame, scopes) -> DataFrame:
    """Items with what requesting them gives; an unknown key answers for itself."""
    out = level.withColumn("req_key", F.col("key")).join(answers, ["site", "req_key"], "left")
    return out.withColumn("final_key", F.coalesce("final_key", "req_key")).withColumn("robots", F.coalesce("robots", F.lit(False)))


def _skip_reached(items: DataFrame) -> DataFrame:
    """Without items that an earlier item of the level has already been redirected to."""
    reached = items.where("final_key <> req_key and not robots").groupBy("site", F.col("final_key").alias("key")).agg(F.min("pos").alias("reached"))
    return items.join(reached, ["site", "key"], "left").where("reached is null or reached > pos").drop("reached")


def _probes(visits: DataFrame, known: DataFrame, answers: DataFrame, scopes, most: int) -> DataFrame:
    """Direct lookups on each site of the keys that only the other one reached."""
    status = known.select("site", F.col("key").alias("final_key"), "status")
    pages = first_wins(visits.where("not robots"), ["site", "final_key"], ["crawl_ord"]).join(status, ["site", "final_key"], "left")
    candidates = pages.where(~F.coalesce("status", F.lit(404)).isin(404, 410) | F.col("redirect_error").isNotNull()).select(F.col("final_key").alias("key")).distinct()
    down = pages.join(known.select("site", F.col("key").alias("final_key"), "error"), ["site", "final_key"], "left").where("crawl_ord = 1 and status is null and error is not null").select("site")
    sites = visits.sparkSession.createDataFrame([(s,) for s in scopes], "site string").join(down, "site", "left_anti")
    known_keys = visits.select("site", F.col("req_key").alias("key")).union(visits.select("site", F.col("final_key").alias("key"))).distinct()
    want = candidates.withColumn("site", F.explode(F.array(*map(F.lit, scopes)))).join(sites, "site").join(known_keys, ["site", "key"], "left_anti")
    order = Window.partitionBy("site").orderBy("key")
    items = _answered(want, answers, scopes).withColumn("pos", F.row_number().over(order))
    items = _skip_reached(items).withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    return items.select("*", (F.lit(1 << 30) + F.col("n")).cast("int").alias("crawl_ord"), F.lit(None).cast("int").alias("depth"), F.lit("direct request (not linked)").alias("found_by"), F.lit(True).alias("probed"), F.lit(0).alias("parent_ord"), F.lit(0).alias("link_ord"))
