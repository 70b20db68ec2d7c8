"""Two sites whose differences are planted by rules over the driver's tables.

Pages are HTML built from a row's number, so their differences follow from the number alone and can be
listed in SQL without parsing anything: that is what the queries here are compared with. `part` gives
pages that are compared as they are, `supplier` two linked sites that are crawled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetwin.config import build_config
from pagetwin.functions import urls
from pagetwin.operators import diffs as df_
from pagetwin.operators.crawl import Crawl, crawl_sites
from pagetwin.operators.pairing import pair_pages
from pagetwin.operators.snapshots import looks_js_rendered, snapshot, with_raw
from pagetwin.session import Scratch, scan
from pagetwin.sources.sites import SERVED

CFG = build_config()
BIG = build_config({"crawl": {"maxPages": 1 << 30, "maxProbes": 1 << 30}})
NO_RENAMES = "key_a string, key_b string"

#: Parts of a page as Spark SQL over `k`: what A has, and what B has in place of it.
TITLE = ("concat('Part ', k, ' of the list')", "CASE k % 4 WHEN 0 THEN concat('PART ', k, ' of the list!') WHEN 1 THEN concat('Part ', k, ' of a new list') WHEN 2 THEN '' ELSE concat('Part ', k, ' of the list') END")
DESCRIPTION = ("IF(k % 3 = 0, '', concat('About part ', k))", "IF(k % 3 = 1, '', concat('About part ', k))")
CANONICAL = ("concat('/p/', k)", "CASE k % 5 WHEN 0 THEN concat('/p/', k, '/') WHEN 1 THEN '' WHEN 2 THEN concat('https://other.example/p/', k) WHEN 3 THEN concat('/q/', k) ELSE concat('/p/', k) END")
ROBOTS = ("IF(k % 6 = 1, 'noindex', '')", "IF(k % 6 = 0, 'NOINDEX, follow', '')")
LANG = ("'en'", "IF(k % 7 = 0, 'DE', 'en')")
OG_IMAGE = ("concat('/i/og', k, '.png')", "CASE k % 8 WHEN 0 THEN '/i/ognew.png' WHEN 1 THEN '' ELSE concat('/i/og', k, '.png') END")
H2 = "<h2>Sizes and colours of part {k}</h2>"
HEADING = (f"'{H2}'", "CASE k % 4 WHEN 0 THEN '<h3>Sizes and colours of part {k}</h3>' WHEN 1 THEN '<h2>Sizes and prices of part {k}</h2>' WHEN 2 THEN '' ELSE '<h2>SIZES and colours of part {k}</h2>' END")
LAST_HEADING = ("''", "IF(k % 5 = 0, '<h4>Zebra yonder</h4>', '')")
PRICE = "concat('<p>The price of part ', k, ' is $', k + 10, ' with delivery.</p>')"
BOAT = "'<p>Shipping takes three days by boat for everyone.</p>'"
BLOCKS = (
    f"concat({PRICE}, {BOAT})",
    f"""CASE k % 6 WHEN 0 THEN concat('<p>The price of part ', k, ' is $', k + 11, ' with delivery.</p>', {BOAT}) WHEN 1 THEN {BOAT} WHEN 2 THEN concat({BOAT}, {PRICE})
    WHEN 3 THEN concat('<p>THE PRICE of part ', k, ' is $', k + 10, ' with delivery.</p>', {BOAT}) WHEN 4 THEN concat({PRICE}, {BOAT}, '<p>Now also sold on the moon by robots.</p>') ELSE concat({PRICE}, {BOAT}) END""",
)
NOISE = ("'<p>&copy; 2025 Shop</p><p>Made at 2025-01-02 10:11:12 for you</p>'", "'<p>&copy;  2026 Shop</p><p>Made at 2026-03-04 11:12:13 for you</p>'")
TABLES = ("'<table></table>'", "concat(repeat('<table></table>', cast(1 + k % 3 as int)), IF(k % 9 = 0, '<iframe></iframe>', ''))")
LINK = "<li><a href=\"{0}\">{1}</a></li>"
LINKS = (
    "'<li><a href=\"/l/{k}\">Detail {k}</a></li><li><a href=\"/two\">One</a></li><li><a href=\"/two\">Two</a></li><li><a href=\"https://partner.example.org/x?utm_source=A&id={k}\">Partner</a></li>'",
    """concat(CASE k % 7 WHEN 0 THEN '' WHEN 1 THEN '<li><a href="/l/{k}">Details {k}</a></li>' WHEN 2 THEN '<li><a href="/l/{k}/">DETAIL {k}</a></li>' WHEN 3 THEN '<li><a href="https://a.example/l/{k}">Detail {k}</a></li>'
    WHEN 4 THEN '<li><a href="../l/{k}?utm_source=x#top">Detail {k}</a></li>' WHEN 5 THEN '<li><a href="/l/{k}">Detail {k}</a></li><li><a href="/new/{k}">New</a></li>' ELSE '<li><a href="/m/{k}">Detail {k}</a></li>' END,
    '<li><a href="/two">Two</a></li><li><a href="/two">One</a></li><li><a href="https://www.partner.example.org/x/?id={k}&utm_source=B">Partner</a></li>')""",
)
SHOPS = ("concat('<li><a href=\"/s/', k % 10, '\">Shop</a></li><li><a href=\"#here\">here</a></li><li><a href=\"javascript:go()\">go</a></li>')",) * 2
IMAGES = (
    "IF(k % 2 = 1, '<img src=\"data:image/gif;base64,R0\" data-src=\"/img/a{k}.png\" alt=\"Picture {k}\">', '<img src=\"/img/a{k}.png\" alt=\"Picture {k}\">')",
    """concat(CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN '<img src="/img/a{k}.png" alt="">' WHEN 2 THEN '<img src="/img/a{k}.png" alt="PICTURE {k}">' WHEN 3 THEN '<img src="/img/a{k}.png" alt="Photo {k}">'
    ELSE '<img srcset="/img/a{k}-800x600.png 1x, /img/b.png 2x" alt="Picture {k}">' END, IF(k % 10 = 0, '<img src="/img/new{k}.png" alt="">', ''))""",
)
FIELDS = "<label>Phone <input name=\"phone\"></label>"
FORM = "<form action=\"/send\" method=\"post\"><input type=\"hidden\" name=\"csrf\" value=\"x\"><label for=\"m\">Email</label><input id=\"m\" name=\"email\" type=\"email\">" + FIELDS + "<button>Send</button></form>"
FORMS = (
    f"'{FORM}'",
    f"""CASE k % 8 WHEN 0 THEN '' WHEN 1 THEN '{FORM.replace('type="email"', 'type="email" required')}' WHEN 2 THEN '{FORM.replace('type="email"', 'type="text"')}' WHEN 3 THEN '{FORM.replace('>Email<', '>E-mail<')}'
    WHEN 4 THEN '{FORM.replace('method="post"', '')}' WHEN 5 THEN '{FORM.replace('"/send"', '"/send2"')}' WHEN 6 THEN '{FORM.replace('>Send<', '>Send now<')}' ELSE '{FORM.replace('Phone', 'Company').replace('"phone"', '"company"')}' END""",
)
CTAS = (
    "'<div><a class=\"btn\" href=\"/buy/{k}\">Buy {k}</a></div>'",
    """CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN '<div><a class="btn" href="/order/{k}">Buy {k}</a></div>' WHEN 2 THEN '<div><a class="btn" href="/buy/{k}">Order {k}</a></div>' WHEN 3 THEN '<div><a class="btn" href="/buy/{k}">BUY {k}</a></div>'
    WHEN 4 THEN '<div><a class="btn" href="/buy/{k}">Buy {k}</a></div><div><a class="big-button" href="/join">Join {k}</a></div>' ELSE '<div><a class="btn" href="/buy/{k}">Buy {k}</a></div>' END""",
)
GONE = "<script>t(\"</p>\")</script><p hidden>secret</p><div style=\"display: none\"><h2>unseen</h2></div><div class=\"cookie-banner\"><p>We use cookies.</p><a href=\"/cookies\">more</a></div>"


def page_html(side: int) -> str:
    """A part's page as one Spark SQL expression; {k} stands for its number."""
    meta = lambda kind, name, value: f"IF(({value}) = '', '', concat('<meta {kind}=\"{name}\" content=\"', {value}, '\">'))"
    canonical = f"IF(({CANONICAL[side]}) = '', '', concat('<link rel=\"canonical\" href=\"', {CANONICAL[side]}, '\">'))"
    parts = [
        f"'<!doctype html><html lang=\"', {LANG[side]}, '\"><head><title>', {TITLE[side]}, '</title>'", meta("name", "description", DESCRIPTION[side]), canonical, meta("name", "robots", ROBOTS[side]), meta("property", "og:image", OG_IMAGE[side]),
        f"'</head><body><nav><ul><li><a href=\"/home\">Home</a></li>', {LINKS[side]}, {SHOPS[side]}, '</ul></nav>{GONE}<h1>Part {{k}}</h1><p>Intro of part {{k}} stays the same here.</p>'",
        HEADING[side], BLOCKS[side], NOISE[side], LAST_HEADING[side], TABLES[side], IMAGES[side], FORMS[side], CTAS[side], "'</body></html>'",
    ]
    return f"replace(concat({', '.join(parts)}), '{{k}}', k)"


def part_pages(spark: SparkSession, d: str) -> DataFrame:
    """k, site, final_url, html: a page of every part on each site."""
    parts = scan(spark, f"{d}/part.parquet").select(F.col("p_partkey").alias("k"))
    side = lambda s, i: parts.select("k", F.lit(s).alias("site"), F.concat(F.lit(f"https://{s.lower()}.example/p/"), F.col("k").cast("string")).alias("final_url"), F.expr(page_html(i)).alias("html"))
    return side("A", 0).unionByName(side("B", 1))


def part_pairs(spark: SparkSession, d: str, label: str, field: str) -> DataFrame:
    """path, snap_a, snap_b of every part; only `field` of the snapshots is made. Pages are parsed once and written."""
    raw = with_raw(part_pages(spark, d), CFG)
    host = F.concat(F.lower("site"), F.lit(".example"))
    snaps = Scratch(spark, f"planted-{label}").table(raw.select("k", "site", F.struct(snapshot(F.col("raw"), host, "/", CFG)[field].alias(field)).alias("snap")))
    a, b = (snaps.where(F.col("site") == s).select("k", F.col("snap").alias(f"snap_{s.lower()}")) for s in "AB")
    return a.join(b, "k").withColumn("path", F.col("k").cast("string"))


def none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], NO_RENAMES)


def shown(found: DataFrame, *more: str) -> DataFrame:
    joined = lambda c: F.array_join(c, " / ").alias(c)
    return found.select("path", "sig", "title", joined("a"), joined("b"), *more)


def planted_metadata(spark, d):
    return shown(df_.metadata_diffs(part_pairs(spark, d, "meta", "meta"), none(spark)), "note")


def planted_headings(spark, d):
    return shown(df_.heading_diffs(part_pairs(spark, d, "headings", "headings"), CFG))


def planted_structure(spark, d):
    return shown(df_.structure_diffs(part_pairs(spark, d, "structure", "structure")))


def planted_text(spark, d):
    return shown(df_.text_diffs(part_pairs(spark, d, "text", "blocks"), CFG), "word_diff")


def planted_images(spark, d):
    return shown(df_.image_diffs(part_pairs(spark, d, "images", "images")))


def planted_forms(spark, d):
    return shown(df_.form_diffs(part_pairs(spark, d, "forms", "forms"), none(spark)), "context")


def planted_ctas(spark, d):
    return shown(df_.cta_diffs(part_pairs(spark, d, "ctas", "ctas"), none(spark)))


def planted_links(spark, d):
    """Links of B against A's, with the pages that have another path on B and what a request of each shop gives."""
    pairs = part_pairs(spark, d, "links", "links")
    renames = pairs.where("k % 7 = 6").select(F.concat(F.lit("/l/"), "path").alias("key_a"), F.concat(F.lit("/m/"), "path").alias("key_b"))
    rows = [(s, f"/s/{n}", {("B", 1): 404, ("A", 2): 500, ("A", 3): 404, ("B", 3): 410}.get((s, n), 200), None, False) for s in "AB" for n in range(10) if (s, n) != ("B", 4)]
    statuses = spark.createDataFrame([*rows, ("B", "/s/4", None, None, True)], "site string, key string, status int, error string, robots boolean")
    return shown(df_.link_diffs(pairs, renames, statuses, urls.create_scope("https://a.example/", CFG), CFG, "Site A"), "note")


def planted_counts(spark, d):
    """How many parts of each kind a page has once hidden and ignored elements are gone."""
    raw = with_raw(part_pages(spark, d), CFG)
    return raw.select("k", "site", *(F.size(f"raw.{c}").alias(f"n_{c}") for c in ("headings", "blocks", "links", "images", "forms", "ctas")), F.size(F.flatten(F.transform("raw.forms", lambda f: f["fields"]))).alias("n_fields"))


def planted_fields(spark, d):
    f = with_raw(part_pages(spark, d), CFG).select("k", "site", F.explode("raw.forms").alias("f")).select("k", "site", F.regexp_replace("f.action", "^https://[^/]*", "").alias("action"), "f.method", "f.submit", F.posexplode("f.fields").alias("ord", "x"))
    return f.select("k", "site", "action", "method", "submit", "ord", "x.name", "x.type", "x.required", "x.label")


def planted_blocks(spark, d):
    return with_raw(part_pages(spark, d), CFG).select("k", "site", F.posexplode("raw.blocks").alias("ord", "b")).select("k", "site", "ord", "b.text", "b.section")


def planted_targets(spark, d):
    """Absolute targets of links and sources of images, in their order."""
    raw = with_raw(part_pages(spark, d), CFG)
    both = F.concat(F.transform("raw.links", lambda x: x["href"]), F.transform("raw.images", lambda x: x["src"]))
    return raw.select("k", "site", F.posexplode(both).alias("ord", "target"))


def js_rendered(spark, d):
    """Pages that seem to need scripts: an empty mount, too little text beside a script, a request to enable them."""
    html = F.expr("""CASE p_partkey % 4 WHEN 0 THEN '<body><div id="root"></div><script></script></body>' WHEN 1 THEN concat('<body><p>', repeat('Plain words. ', 30), '</p><script></script></body>')
      WHEN 2 THEN '<noscript>Please enable JavaScript</noscript>' ELSE '<body><p>Short but without any script.</p></body>' END""")
    pages = scan(spark, f"{d}/part.parquet").select("p_partkey", html.alias("html"), F.lit("https://a.example/").alias("final_url"))
    return with_raw(pages, CFG).select("p_partkey", looks_js_rendered(F.col("raw"), CFG).alias("needs_scripts"))


# ---- two linked sites: page k links to 10 k .. 10 k + 9, and the start page to 1 .. 9

#: What happens to page k; the first rule that holds counts.
KIND = "CASE WHEN k % 17 = 7 THEN 'private' WHEN k % 11 = 3 THEN 'gone' WHEN k % 13 = 5 THEN 'redirect' WHEN k % 19 = 2 THEN 'fails' WHEN k % 23 = 1 THEN 'variant' WHEN k % 29 = 4 THEN 'moved' ELSE 'same' END"
PATH_A = "CASE kind WHEN 'private' THEN concat('/private/', k, '/') ELSE concat('/s/', k, '/') END"
#: The path that B's pages link to.
PATH_B = "CASE kind WHEN 'private' THEN concat('/private/', k, '/') WHEN 'variant' THEN concat('/s/', k, '.html') WHEN 'moved' THEN concat('/moved/', k, '/') ELSE concat('/s/', k, '/') END"
HOSTS = {"A": "https://a.example/", "B": "https://b.example/"}
ROBOTS_RULES = {s: [("/private/", False), ("/private/open", True)] for s in HOSTS}


def site_pages(spark: SparkSession, d: str) -> DataFrame:
    """What both sites serve (columns of SERVED)."""
    own = spark.read.parquet(f"{d}/supplier.parquet").where("s_suppkey > 0").select(F.col("s_suppkey").alias("k"))
    pages = own.union(spark.range(1).toDF("k")).withColumn("kind", F.when(F.col("k") == 0, "start").otherwise(F.expr(KIND)))
    links = pages.where("k > 0").withColumn("parent", F.floor(F.col("k") / 10)).groupBy("parent")
    links = links.agg(*(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.expr(path).alias("to")))), lambda x: F.concat(F.lit('<li><a href="'), x["to"], F.lit('">To '), x["k"].cast("string"), F.lit("</a></li>"))), "").alias(f"links_{s}") for s, path in (("A", PATH_A), ("B", PATH_B))))
    # Enough words of its own for a page to be known by them.
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat(F.lit("w"), F.col("k").cast("string"), F.lit("x"), i.cast("string"))), " ")
    full = pages.join(links, F.col("k") == F.col("parent"), "left")
    html = lambda s: F.concat(F.lit("<html><head><title>Page "), F.col("k").cast("string"), F.lit("</title></head><body><h1>Page "), F.col("k").cast("string"), F.lit("</h1><p>"), words, F.lit("</p><ul>"), F.coalesce(f"links_{s}", F.lit("")), F.lit('</ul><ul><li><a href="/file/'), F.col("k").cast("string"), F.lit('.pdf">File</a></li><li><a href="/cart/'), F.col("k").cast("string"), F.lit('">Cart</a></li><li><a href="https://else.example/">Else</a></li></ul></body></html>'))
    no = F.lit(None).cast("string")

    def answer(rows, s, path, status, page, redirect=no):
        return rows.select(F.lit(s).alias("site"), path.alias("path"), F.lit(status).alias("status"), redirect.alias("redirect_to"), F.lit("text/html").alias("content_type"), page.alias("html"), no.alias("error"))

    start = F.col("kind") == "start"
    at = lambda path: F.when(start, F.lit("/")).otherwise(F.expr(path))
    to = F.concat(F.lit("/t/"), F.col("k").cast("string"), F.lit("/"))
    parts = [
        answer(full, "A", at(PATH_A), 200, html("A")),
        answer(full.where("kind not in ('gone', 'redirect', 'fails')"), "B", at(PATH_B), 200, html("B")),
        answer(full.where("kind = 'redirect'"), "B", at(PATH_B), 301, no, to),
        answer(full.where("kind = 'redirect'"), "B", to, 200, html("B")),
        answer(full.where("kind = 'fails'"), "B", at(PATH_B), 500, F.lit("<p>Sorry</p>")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*(c.split()[0] for c in SERVED.split(", ")))


def crawled(spark: SparkSession, d: str, cfg: dict = BIG) -> Crawl:
    scopes = {s: urls.create_scope(u, cfg) for s, u in HOSTS.items()}
    return crawl_sites(site_pages(spark, d), scopes, ROBOTS_RULES, cfg)


def crawl_pages(spark, d):
    return crawled(spark, d).pages.select("site", "key", "status", "depth", "found_by", "probed")


def crawl_aliases(spark, d):
    return crawled(spark, d).aliases.select("site", "req_key", "final_key", "code")


def crawl_blocked(spark, d):
    return crawled(spark, d).robots_blocked


def crawl_skipped(spark, d):
    return crawled(spark, d).skipped


def crawl_limits(spark, d):
    """A crawl of at most seven pages a site and no probes."""
    return crawled(spark, d, build_config({"crawl": {"maxPages": 7, "maxProbes": 0}})).limits.select("site", "fetched", "probes", "limit_reached")


def crawl_statuses(spark, d):
    return df_.link_statuses(crawled(spark, d)).select("site", "key", "status", "robots")


def site_pairs(spark, d):
    """Every page of both sites with its partner: by path, redirect, URL variant, content, or none."""
    pairs = pair_pages(crawled(spark, d), BIG)
    return pairs.select("path", "key_a", "key_b", "match", "kind", "redirect_on", "code", F.round("similarity", 6).alias("similarity"), "other_state", "other_text")


def _page_diffs(spark, d):
    crawl = crawled(spark, d)
    pairs = pair_pages(crawl, BIG)
    return df_.page_diffs(pairs, df_.link_statuses(crawl), crawl.aliases, "Site A", "Site B")


def site_page_diffs(spark, d):
    return shown(_page_diffs(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        planted_metadata, planted_headings, planted_structure, planted_text, planted_links, planted_images, planted_forms, planted_ctas, planted_counts, planted_fields, planted_blocks, planted_targets,
        js_rendered, crawl_pages, crawl_aliases, crawl_blocked, crawl_skipped, crawl_limits, crawl_statuses, site_pairs, site_page_diffs,
    )
}
