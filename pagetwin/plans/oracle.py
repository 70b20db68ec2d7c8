"""SQL for DuckDB that gives the rows of the queries of the same name."""

from __future__ import annotations

from pagetwin.plans import planted_sql

_WS = r"[\t\n\x0b\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
_PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '')"
_INDEX = r"(?i)/(index\.html|index\.htm|index\.php|default\.aspx|default\.htm)$"
_CLEAN = rf"regexp_replace(regexp_replace({_PATH}, '/{{2,}}', '/', 'g'), '{_INDEX}', '/')"
KEY = f"CASE WHEN rtrim({_CLEAN}, '/') = '' THEN '/' ELSE rtrim({_CLEAN}, '/') END"
_QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
_TRACK = (
    r"(?i)^(utm_source|utm_medium|utm_campaign|utm_term|utm_content|utm_id|gclid|dclid|fbclid|msclkid|mc_cid|mc_eid|_ga|_gl|yclid|igshid"
    r"|ref|ref_src|hsa_.*|_hs.*|v|ver|version|cb|_|cachebuster|ts|t)$"
)
_KEPT = rf"array_to_string(list_sort(list_filter(string_split({_QUERY}, '&'), lambda x: x <> '' AND NOT regexp_matches(regexp_extract(x, '^([^=]*)', 1), '{_TRACK}'))), '&')"
_LOOSE = rf"regexp_replace(replace(regexp_replace(lower(k), '\.(html?|php|aspx?|jsp|cfm)$', ''), '_', '-'), '/+$', '')"


def loose(k: str) -> str:
    e = _LOOSE.replace("lower(k)", f"lower({k})")
    return f"CASE WHEN {e} = '' THEN '/' ELSE {e} END"


#: First page of each key of a site.
FIRST = f"f AS (SELECT * FROM (SELECT page_id, url, html, CASE WHEN page_id % 2 = 0 THEN 'A' ELSE 'B' END AS site, {KEY} AS key FROM pages) QUALIFY row_number() OVER (PARTITION BY site, key ORDER BY page_id) = 1)"
SAME = "same AS (SELECT a.key, a.page_id AS page_a, b.page_id AS page_b FROM f a JOIN f b ON a.key = b.key AND a.site = 'A' AND b.site = 'B')"
#: Links of each first page that has a partner: target and labels.
NAV = f"""nav AS (SELECT site, key, target, list_sort(list(DISTINCT label)) AS labels FROM (SELECT site, key, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS target, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS label
  FROM f WHERE key IN (SELECT key FROM same)) GROUP BY ALL)"""
#: The first page, in the order of page_id, of each loose key that has no partner of its own path.
VARIANTS = "x AS (SELECT a.key AS key_a, b.key AS key_b FROM l a JOIN l b ON a.loose = b.loose AND a.site = 'A' AND b.site = 'B')"
LOOSE = f"l AS (SELECT site, key, page_id, {loose('key')} AS loose FROM f WHERE key NOT IN (SELECT key FROM f GROUP BY key HAVING count(*) > 1) QUALIFY row_number() OVER (PARTITION BY site, loose ORDER BY page_id) = 1)"

#: Line items as differences of the pages that are orders; those on many compared pages are site-wide.
ITEMS = """WITH pr AS (SELECT '/o/' || o_orderkey AS path, CASE o_orderkey % 50 WHEN 0 THEN 'error' WHEN 1 THEN 'only-a' WHEN 2 THEN 'only-b' ELSE 'compared' END AS kind, o_orderkey AS ord FROM orders),
df AS (SELECT '/o/' || l_orderkey AS path, (['links', 'text', 'images', 'headings', 'forms', 'page', 'cta'])[l_linenumber] AS category, (['missing', 'changed', 'cosmetic', 'structural', 'added', 'error', 'changed'])[l_linenumber] AS sig,
  ([1, 2, 5, 4, 3, 0, 2])[l_linenumber] AS rank, CASE WHEN l_linenumber IN (1, 3) THEN 'x' ELSE l_suppkey::VARCHAR END AS a, l_linenumber AS place FROM lineitem),
mv AS (SELECT df.*, ord FROM df JOIN pr USING (path) WHERE kind = 'compared' AND category <> 'page'),
hot AS (SELECT category, a, any_value(sig) AS sig, any_value(rank) AS rank, count(DISTINCT path)::INT AS n_pages, min_by(path, ord) AS first_page, min(ord) AS ord, min(place) AS place FROM mv GROUP BY category, a
  HAVING count(DISTINCT path) >= greatest(3, ceil(0.3 * (SELECT count(*) FROM pr WHERE kind = 'compared')))),
wide AS (SELECT category, sig, rank, category || ' differ' AS title, n_pages, first_page, (row_number() OVER (ORDER BY rank, n_pages DESC, ord, category, place) - 1)::INT AS place FROM hot),
hits AS (SELECT DISTINCT path, category, a FROM mv WHERE (category, a) IN (SELECT (category, a) FROM hot)),
rest AS (SELECT * FROM df WHERE (path, category, a) NOT IN (SELECT (path, category, a) FROM hits)),
pages AS (SELECT path, kind, coalesce(worst, 99)::INT AS worst, coalesce(n_diffs, 0) AS n_diffs, coalesce(n_site_wide, 0) AS n_site_wide, kind = 'compared' AND n_diffs IS NULL AND n_site_wide IS NULL AS identical
  FROM pr LEFT JOIN (SELECT path, min(rank) AS worst, count(*) AS n_diffs FROM rest GROUP BY path) USING (path) LEFT JOIN (SELECT path, count(*) AS n_site_wide FROM hits GROUP BY path) USING (path)),
sigs AS (SELECT names.sig, names.rank, count(c.sig) AS n FROM (SELECT unnest(['error', 'missing', 'changed', 'added', 'structural', 'cosmetic']) AS sig, unnest(range(6))::INT AS rank) names
  LEFT JOIN (SELECT sig FROM rest UNION ALL SELECT sig FROM wide) c USING (sig) GROUP BY names.sig, names.rank)
"""

_COLLAPSED = f"trim(regexp_replace(regexp_replace(text, '[\\x{{200B}}-\\x{{200D}}\\x{{FEFF}}]', '', 'g'), '{_WS}', ' ', 'g'), ' ')"
_PLAIN = "replace(translate({}, '‘’‚′“”„″–—−', '''''''''\"\"\"\"---'), '…', '...')"


def plain(c: str) -> str:
    return _PLAIN.format(c)


def _mask(table: str, ident: str, text: str, pattern: str, name: str, flags: str = "g") -> str:
    return f"SELECT {ident}, regexp_replace({text}, '{pattern}', '{{{name}}}', '{flags}') AS masked FROM {table}"


# Words of \w without lookahead: what follows is captured and put back.
_SECONDS = r"\b\d{1,2}:\d{2}:\d{2}(\.\d+)?\s?([ap]\.?m\.?)?(\s?(UTC|GMT|[A-Z]{2,4}T))?([^\w]|$)"
_CLOCK = r"\b\d{1,2}:\d{2}\s?([ap]\.?m\.?)?(\s?(UTC|GMT|[A-Z]{2,4}T))?([^\w]|$)"
_HEXES = r"list_filter(regexp_extract_all(t, '(?i)\b[0-9a-f]{16,}\b'), lambda x: regexp_matches(x, '\d') AND regexp_matches(x, '(?i)[a-f]'))"
_TOKENS = r"list_filter(list_transform(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}$€£%.,]+'), lambda x: regexp_replace(x, '[.,]+$', '')), lambda x: x <> '')"


def tokens(c: str) -> str:
    return _TOKENS.format(c)


_WORDS = f"list_filter(regexp_split_to_array(lower(text), '{_WS}'), lambda x: x <> '')[1:4000]"
_SHINGLED = f"SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) END AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents)"
_SIMILAR = f"""s AS ({_SHINGLED}), g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) / (x.n + y.n - count(*)) AS sim FROM g x JOIN g y ON x.g = y.g AND x.doc_id % 2 = 0 AND y.doc_id % 2 = 1 GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING count(*) / (x.n + y.n - count(*)) >= 0.6)"""
_COS = f"trim(regexp_replace(regexp_replace(lower({plain(_COLLAPSED)}), '[^\\p{{L}}\\p{{N}}{{}}_\\s]', '', 'g'), '\\s+', ' ', 'g'), ' ')"
_HTML = "regexp_replace(html, '(?s)<script>.*?</script>|<style>.*?</style>|<!--.*?-->', '', 'g')"


def _entities(c: str) -> str:
    return f"replace(replace(replace(replace({c}, '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&amp;', '&')"


ORACLE = {
    "url_norm_host": f"SELECT page_id, {_HOST} AS host FROM pages",
    "url_page_key": f"SELECT page_id, {KEY} AS page_key FROM pages",
    "url_loose_key": f"SELECT page_id, {loose('k')} AS loose_key FROM (SELECT page_id, {KEY} AS k FROM pages)",
    "url_strip_tracking": f"SELECT page_id, {_KEPT} AS kept_query FROM pages",
    "url_external_norm": f"SELECT page_id, '//' || {_HOST} || rtrim({_PATH}, '/') || CASE WHEN {_KEPT} <> '' THEN '?' || {_KEPT} ELSE '' END AS external FROM pages",
    "url_in_scope": f"SELECT page_id, starts_with({_PATH}, '/en/') OR {_PATH} || '/' = '/en/' AS in_scope FROM pages",
    "url_skip_ext": f"SELECT page_id, lower(regexp_extract({_PATH} || CASE WHEN page_id % 3 = 0 THEN '.PDF' ELSE '' END, '\\.([A-Za-z0-9]{{1,5}})$', 1)) IN ('pdf', 'zip', 'xml', 'json', 'txt', 'css', 'js') AS skipped FROM pages",
    "url_reject_reason": "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'outside site' WHEN page_id % 4 = 3 THEN 'file download (not a page)' WHEN page_id % 4 = 1 THEN 'excluded by ignore.urlPatterns' END AS reason FROM pages",
    "image_keys": "SELECT p_partkey, 'part-' || p_partkey || '.png' AS image_key FROM part",
    "text_collapse_ws": f"SELECT doc_id, md5({_COLLAPSED}) AS collapsed_md5 FROM documents",
    "text_typography": f"SELECT conv_id, turn, md5({plain(chr(39) + '“' + chr(39) + ' || text || ' + chr(39) + '” – it’s…' + chr(39))}) AS plain_md5 FROM conversations",
    "text_cos": f"SELECT item_id, {_COS} AS cos FROM benchmark",
    "mask_iso_timestamp": _mask("events", "event_id", "'At ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' user ' || user_id", r"\b\d{4}-\d{2}-\d{2}[T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s?(Z|[+-]\d{2}:?\d{2}|UTC|GMT)?", "iso-timestamp"),
    "mask_clock_seconds": rf"SELECT event_id, regexp_replace('At ' || strftime(ts, '%H:%M:%S') || ' user ' || user_id, '{_SECONDS}', '{{clock-time-seconds}}\5', 'gi') AS masked FROM events",
    "mask_clock": rf"SELECT event_id, regexp_replace('Open ' || strftime(ts, '%H:%M') || ' daily, user ' || user_id, '{_CLOCK}', '{{clock-time}}\4', 'gi') AS masked FROM events",
    "mask_relative_time": _mask("events", "event_id", "'Seen ' || event_id || ' minutes ago by ' || user_id", r"\b(\d+|an?|one)\s+(second|minute|hour|day|week|month|year)s?\s+ago\b|\bjust now\b", "relative-time", "gi"),
    "mask_copyright": _mask("orders", "o_orderkey", "'Copyright ' || strftime(o_orderdate, '%Y') || ' order ' || o_orderkey", r"(©|&copy;|\(c\)|copyright)\s*\d{4}(\s*[-–]\s*\d{4})?", "copyright-year", "gi"),
    "mask_date": _mask("orders", "o_orderkey", "'Due ' || strftime(o_orderdate, '%Y-%m-%d') || ' order ' || o_orderkey", r"\b\d{4}-\d{2}-\d{2}\b", "date"),
    "mask_uuid": "SELECT event_id, 'Session {uuid} of ' || user_id AS masked FROM events",
    "mask_hex_token": f"SELECT doc_id, len({_HEXES})::INT AS n_tokens FROM (SELECT doc_id, {_COLLAPSED} AS t FROM documents)",
    "text_tokens": f"SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_distinct FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)",
    "token_counts": f"SELECT token, count(*) AS n FROM (SELECT unnest({tokens('text')}) AS token FROM documents) GROUP BY token",
    "dice_similarity": f"""WITH i AS (SELECT x.item_id, x.text AS a, y.text AS b FROM benchmark x JOIN benchmark y ON y.item_id = x.item_id + 1),
ta AS (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest({tokens('a')}) AS w FROM i) GROUP BY ALL), tb AS (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest({tokens('b')}) AS w FROM i) GROUP BY ALL),
c AS (SELECT ta.item_id, sum(least(ta.n, tb.n)) AS c FROM ta JOIN tb USING (item_id, w) GROUP BY ta.item_id)
SELECT item_id, round(CASE WHEN a = b THEN 1.0 WHEN len({tokens('a')}) = 0 OR len({tokens('b')}) = 0 THEN 0.0 ELSE 2.0 * coalesce(c, 0) / (len({tokens('a')}) + len({tokens('b')})) END::DOUBLE, 6) AS dice FROM i LEFT JOIN c USING (item_id)""",
    "shingle_counts": f"SELECT doc_id, len(s)::INT AS n_shingles FROM ({_SHINGLED})",
    "shingle_jaccard": f"WITH {_SIMILAR} SELECT a, b, round(sim, 6) AS similarity FROM p",
    "page_first_wins": f"WITH {FIRST} SELECT site, key AS page_key, page_id FROM f",
    "page_states": "SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'missing' WHEN 1 THEN 'error' WHEN 2 THEN 'error' WHEN 3 THEN 'error' ELSE 'ok' END AS state FROM pages",
    "pair_same_path": f"WITH {FIRST}, {SAME} SELECT key AS path, key AS key_a, key AS key_b, 'compared' AS kind FROM same",
    "pair_url_variant": f"WITH {FIRST}, {LOOSE}, {VARIANTS} SELECT key_a, key_b FROM x",
    "pair_one_sided": f"WITH {FIRST}, {LOOSE}, {VARIANTS} SELECT key AS path, CASE site WHEN 'A' THEN 'only-a' ELSE 'only-b' END AS kind FROM f WHERE key NOT IN (SELECT key FROM f GROUP BY key HAVING count(*) > 1) AND NOT EXISTS (SELECT 1 FROM x WHERE key = CASE site WHEN 'A' THEN key_a ELSE key_b END)",
    "extract_title_h1_lang": f"SELECT page_id, trim({_entities('regexp_extract(html, ' + chr(39) + '<title>(.*?)</title>' + chr(39) + ', 1)')}) AS title, trim({_entities('regexp_extract(html, ' + chr(39) + '<h1>(.*?)</h1>' + chr(39) + ', 1)')}) AS h1, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages",
    "extract_structure": f"SELECT page_id, len(regexp_extract_all(h, '<nav>'))::INT AS navs, len(regexp_extract_all(h, '<footer>'))::INT AS footers, len(regexp_extract_all(h, '<ul>'))::INT AS lists, len(regexp_extract_all(h, '<table>'))::INT AS tables FROM (SELECT page_id, {_HTML} AS h FROM pages)",
    "meta_diff_title": f"WITH {FIRST}, {SAME}, t AS (SELECT page_id, {_entities('regexp_extract(html, ' + chr(39) + '<title>(.*?)</title>' + chr(39) + ', 1)')} AS text FROM f), v AS (SELECT page_id, {plain(_COLLAPSED)} AS norm, {_COS} AS cos FROM t) SELECT key AS path, CASE WHEN a.norm = b.norm THEN 'same' WHEN a.norm = '' THEN 'added' WHEN b.norm = '' THEN 'missing' WHEN a.cos = b.cos THEN 'cosmetic' ELSE 'changed' END AS sig FROM same JOIN v a ON a.page_id = page_a JOIN v b ON b.page_id = page_b",
    "link_set_diff": f"""WITH {FIRST}, {SAME}, {NAV}, n AS (SELECT site, key, {_entities('target')} AS target, '“' || {_entities("array_to_string(labels, '” / “')")} || '” → ' || {_entities('target')} AS said FROM nav)
SELECT coalesce(a.key, b.key) AS path, CASE WHEN b.key IS NULL THEN 'missing' ELSE 'added' END AS sig, CASE WHEN b.key IS NULL THEN 'Link missing' ELSE 'Link added' END AS title, a.said AS a, b.said AS b
FROM (SELECT * FROM n WHERE site = 'A') a FULL JOIN (SELECT * FROM n WHERE site = 'B') b ON a.key = b.key AND a.target = b.target WHERE a.key IS NULL OR b.key IS NULL""",
    "text_set_diff": """WITH l AS (SELECT doc_id // 2 AS pair, doc_id % 2 AS side, unnest(string_split(text, chr(10))) AS line FROM documents),
n AS (SELECT pair, line, count(*) FILTER (side = 0) - count(*) FILTER (side = 1) AS n FROM l GROUP BY pair, line HAVING n <> 0)
SELECT pair, sum(greatest(n, 0))::BIGINT AS missing, sum(greatest(-n, 0))::BIGINT AS added FROM n GROUP BY pair""",
    "visual_first_pairs": ITEMS + "SELECT path, ord FROM pr WHERE kind = 'compared' ORDER BY ord LIMIT 50",
    "sitewide_fingerprints": ITEMS + "SELECT category, sig, title, n_pages, first_page, place FROM wide",
    "summary_by_significance": ITEMS + "SELECT sig, rank, n FROM sigs",
    "worst_rank": ITEMS + "SELECT path, kind, worst, n_diffs, n_site_wide, identical FROM pages",
    "page_order": ITEMS + "SELECT path, row_number() OVER (ORDER BY worst, CASE kind WHEN 'error' THEN 0 WHEN 'only-a' THEN 1 WHEN 'only-b' THEN 2 ELSE 3 END, n_diffs DESC, path) AS place FROM pages",
    "top_n_per_category": ITEMS + """SELECT path, category, a, row_number() OVER (PARTITION BY path, category ORDER BY rank, place, '["' || a || '"]')::INT AS n, count(*) OVER (PARTITION BY path, category) AS n_category FROM rest QUALIFY n <= 2""",
    "cta_kth_match": """WITH t AS (SELECT (conv_id // 2)::VARCHAR AS path, conv_id % 2 AS side, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations)
SELECT a.path, a.turn AS pos, b.turn AS pos_b FROM t a JOIN t b ON a.path = b.path AND a.role = b.role AND a.k = b.k AND a.side = 0 AND b.side = 1""",
    "json_config_fields": """SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k, '{"event_type":"' || event_type || '","user_id":' || user_id || '}' AS as_json FROM events""",
    "extract_nav_links": f"""WITH h AS (SELECT page_id, {_HTML} AS h FROM pages), l AS (SELECT page_id, regexp_extract_all(h, '<a href="([^"]*)">([^<]*)</a>', 1) AS t, regexp_extract_all(h, '<a href="([^"]*)">([^<]*)</a>', 2) AS n FROM h)
SELECT page_id, ord::INT AS ord, {_entities('target')} AS target, trim({_entities('label')}) AS label FROM (SELECT page_id, unnest(t) AS target, unnest(n) AS label, generate_subscripts(t, 1) - 1 AS ord FROM l)""",
    "value_significance": "SELECT event_id, (['cosmetic', 'changed', 'same', 'missing', 'added', 'same'])[event_id % 6 + 1] AS sig FROM events",
    "page_similarity": f"""WITH s AS ({_SHINGLED}), g AS (SELECT doc_id, (['', 'One', 'Two'])[doc_id // 2 % 3 + 1] AS t, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, x.t AS ta, y.t AS tb, count(*) / (x.n + y.n - count(*)) AS j FROM g x JOIN g y ON x.g = y.g AND x.doc_id % 2 = 0 AND y.doc_id % 2 = 1 GROUP BY x.doc_id, y.doc_id, x.t, y.t, x.n, y.n)
SELECT a, b, round(sim, 6) AS similarity FROM (SELECT a, b, CASE WHEN ta <> '' AND ta = tb THEN least(1.0::DOUBLE, j + 0.15::DOUBLE) ELSE j END AS sim FROM p) WHERE sim >= 0.6""",
    "pair_moved": f"""WITH RECURSIVE {_SIMILAR}, e AS (SELECT row_number() OVER (ORDER BY round(sim, 9) DESC, a, b) AS n, a, b, sim FROM p),
r(n, ua, ub, taken) AS (SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[], false
  UNION ALL SELECT e.n, CASE WHEN NOT (list_contains(ua, e.a) OR list_contains(ub, e.b)) THEN list_append(ua, e.a) ELSE ua END, CASE WHEN NOT (list_contains(ua, e.a) OR list_contains(ub, e.b)) THEN list_append(ub, e.b) ELSE ub END, NOT (list_contains(ua, e.a) OR list_contains(ub, e.b))
  FROM r JOIN e ON e.n = r.n + 1)
SELECT e.a, e.b, round(e.sim, 6) AS similarity FROM r JOIN e USING (n) WHERE taken""",
    "url_link_key": f"""SELECT page_id, k AS link_key, CASE WHEN starts_with(k, '//') THEN 'https:' || k ELSE k END AS shown FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'mailto:info ' || page_id || '@x.example' WHEN 1 THEN 'tel:+49' || page_id WHEN 2 THEN {KEY}
  ELSE '//' || {_HOST} || rtrim({_PATH}, '/') || CASE WHEN {_KEPT} <> '' THEN '?' || {_KEPT} ELSE '' END END AS k FROM pages)""",
    "url_of_key": f"SELECT page_id, 'https://www.shop.example/v2' || {KEY} AS at, 'shop.example' AS host, '/v2/' AS base FROM pages",
    "robots_paths": f"SELECT page_id, CASE WHEN starts_with(p, '/en/1') THEN true ELSE NOT (starts_with(p, '/en/') OR p LIKE '/%9' OR starts_with(p, '/f')) END AS allowed FROM (SELECT page_id, {_PATH} AS p FROM pages)",
    "sitemap_locations": "SELECT p_partkey // 10 AS n, (row_number() OVER (PARTITION BY p_partkey // 10 ORDER BY p_partkey) - 1)::INT AS ord, CASE WHEN p_partkey % 2 = 0 THEN 'https://a.example/p?k=' ELSE 'https://a.example/p?x=1&k=' END || p_partkey AS url FROM part WHERE p_partkey // 10 % 3 <> 0",
    "summary_totals": ITEMS + """SELECT count(*) FILTER (kind = 'compared') AS pages_compared, count(*) FILTER (identical) AS identical, count(*) FILTER (kind = 'compared' AND NOT identical AND n_diffs = 0) AS site_wide_only, count(*) FILTER (kind = 'compared' AND n_diffs > 0) AS with_differences,
  count(*) FILTER (kind = 'only-a') AS only_a, count(*) FILTER (kind = 'only-b') AS only_b, count(*) FILTER (kind = 'error') AS errors, (SELECT sum(n)::BIGINT FROM sigs) AS total_differences, (SELECT count(*) FROM wide) AS site_wide,
  (SELECT n FROM sigs WHERE sig = 'error') AS n_error, (SELECT n FROM sigs WHERE sig = 'missing') AS n_missing, (SELECT n FROM sigs WHERE sig = 'changed') AS n_changed, (SELECT n FROM sigs WHERE sig = 'added') AS n_added,
  (SELECT n FROM sigs WHERE sig = 'structural') AS n_structural, (SELECT n FROM sigs WHERE sig = 'cosmetic') AS n_cosmetic FROM pages""",
    "stream_title_changes": f"""WITH k AS (SELECT page_id, url, {KEY} AS key, {_entities('regexp_extract(html, ' + chr(39) + '<title>(.*?)</title>' + chr(39) + ', 1)')} AS text FROM pages), v AS (SELECT page_id, url, key, {plain(_COLLAPSED)} AS norm, {_COS} AS cos FROM k),
a AS (SELECT * FROM v WHERE page_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY url) = 1)
SELECT b.key, b.url, CASE WHEN a.norm = b.norm THEN 'same' WHEN a.norm = '' THEN 'added' WHEN b.norm = '' THEN 'missing' WHEN a.cos = b.cos THEN 'cosmetic' ELSE 'changed' END AS sig FROM a JOIN v b ON a.key = b.key AND b.page_id % 2 = 1""",
} | planted_sql.ORACLE
