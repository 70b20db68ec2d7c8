"""SQL that lists what plans.planted has planted, from the numbers of parts and suppliers alone."""

from __future__ import annotations

_P = "WITH m AS (SELECT p_partkey AS k, p_partkey::VARCHAR AS path FROM part)\n"


def _rows(*rows: tuple, more: tuple[str, ...] = ()) -> str:
    """Union of (condition, sig, title, a, b, *more); a, b and more are SQL, null where they are None."""
    text = lambda v: v if v is not None else "NULL::VARCHAR"
    one = lambda r: f"SELECT path, '{r[1]}' AS sig, '{r[2]}' AS title, {text(r[3])} AS a, {text(r[4])} AS b{''.join(f', {text(v)} AS {n}' for n, v in zip(more, r[5:] or (None,) * len(more)))} FROM m WHERE {r[0]}"
    return _P + "\nUNION ALL ".join(map(one, rows))


_T, _H, _D = "'Part ' || k || ' of the list'", "'H2 · Sizes and colours of part ' || k", "'About part ' || k"
_PRICE = "'The price of part ' || k || ' is $' || (k + 10) || ' with delivery.'"
_L = "'“Detail ' || k || '” → /l/' || k"
_I = "'a' || k || '.png — alt: “Picture ' || k || '”'"
_C = "'“Buy ' || k || '” → /buy/' || k"
_SEND = "'Form submitting to /send'"
_BOAT = "'Shipping takes three days by boat for everyone.'"
_BLOCKS_B = f"""CASE k % 6 WHEN 0 THEN ['The price of part ' || k || ' is $' || (k + 11) || ' with delivery.', {_BOAT}] WHEN 1 THEN [{_BOAT}] WHEN 2 THEN [{_BOAT}, {_PRICE}]
  WHEN 3 THEN ['THE PRICE of part ' || k || ' is $' || (k + 10) || ' with delivery.', {_BOAT}] WHEN 4 THEN [{_PRICE}, {_BOAT}, 'Now also sold on the moon by robots.'] ELSE [{_PRICE}, {_BOAT}] END"""
_SECTION_B = "CASE k % 4 WHEN 1 THEN 'Sizes and prices of part ' || k WHEN 2 THEN 'Part ' || k WHEN 3 THEN 'SIZES and colours of part ' || k ELSE 'Sizes and colours of part ' || k END"
_N_LINKS_B = "(5 + CASE k % 7 WHEN 0 THEN 0 WHEN 5 THEN 2 ELSE 1 END + CASE k % 6 WHEN 0 THEN 0 WHEN 4 THEN 2 ELSE 1 END)"
_TARGETS_A = "['https://a.example/home', 'https://a.example/l/' || k, 'https://a.example/two', 'https://a.example/two', 'https://partner.example.org/x?utm_source=A&id=' || k, 'https://a.example/s/' || (k % 10), 'https://a.example/buy/' || k, 'https://a.example/img/a' || k || '.png']"
_TARGETS_B = """list_concat(['https://b.example/home'], CASE k % 7 WHEN 0 THEN [] WHEN 2 THEN ['https://b.example/l/' || k || '/'] WHEN 3 THEN ['https://a.example/l/' || k] WHEN 4 THEN ['https://b.example/l/' || k || '?utm_source=x#top']
  WHEN 5 THEN ['https://b.example/l/' || k, 'https://b.example/new/' || k] WHEN 6 THEN ['https://b.example/m/' || k] ELSE ['https://b.example/l/' || k] END,
  ['https://b.example/two', 'https://b.example/two', 'https://www.partner.example.org/x/?id=' || k || '&utm_source=B', 'https://b.example/s/' || (k % 10)],
  CASE k % 6 WHEN 0 THEN [] WHEN 1 THEN ['https://b.example/order/' || k] WHEN 4 THEN ['https://b.example/buy/' || k, 'https://b.example/join'] ELSE ['https://b.example/buy/' || k] END,
  CASE k % 5 WHEN 0 THEN [] WHEN 4 THEN ['https://b.example/img/a' || k || '-800x600.png'] ELSE ['https://b.example/img/a' || k || '.png'] END, CASE WHEN k % 10 = 0 THEN ['https://b.example/img/new' || k || '.png'] ELSE [] END)"""


def _unnested(a: str, b: str, made: str) -> str:
    return _P + f", l AS (SELECT k, 'A' AS site, {a} AS l FROM m UNION ALL SELECT k, 'B', {b} FROM m), e AS (SELECT k, site, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS ord FROM l) SELECT k, site, ord::INT AS ord, {made} FROM e"


#: The supplier sites: what happens to a page, whether a crawl of A and of B gets to it, and where B has it.
_S = """WITH RECURSIVE s AS (SELECT s_suppkey AS k, s_suppkey // 10 AS up, CASE WHEN s_suppkey % 17 = 7 THEN 'private' WHEN s_suppkey % 11 = 3 THEN 'gone' WHEN s_suppkey % 13 = 5 THEN 'redirect' WHEN s_suppkey % 19 = 2 THEN 'fails'
    WHEN s_suppkey % 23 = 1 THEN 'variant' WHEN s_suppkey % 29 = 4 THEN 'moved' ELSE 'same' END AS kind FROM supplier WHERE s_suppkey > 0),
r AS (SELECT k, kind, 1 AS depth, '/' AS from_a, '/' AS from_b, true AS b FROM s WHERE up = 0
  UNION ALL SELECT s.k, s.kind, r.depth + 1, '/s/' || r.k, CASE r.kind WHEN 'redirect' THEN '/t/' || r.k WHEN 'variant' THEN '/s/' || r.k || '.html' WHEN 'moved' THEN '/moved/' || r.k ELSE '/s/' || r.k END, r.b AND r.kind IN ('same', 'variant', 'moved', 'redirect')
  FROM r JOIN s ON s.up = r.k WHERE r.kind <> 'private'),
w AS (SELECT *, CASE kind WHEN 'redirect' THEN '/t/' || k WHEN 'variant' THEN '/s/' || k || '.html' WHEN 'moved' THEN '/moved/' || k ELSE '/s/' || k END AS key_b,
  CASE kind WHEN 'gone' THEN 404 WHEN 'fails' THEN 500 ELSE 200 END AS status_b FROM r),
direct AS (SELECT 'direct request (not linked)' AS how),
pages AS (
  SELECT unnest(['A', 'B']) AS site, '/' AS key, 200 AS status, 0 AS depth, 'start URL' AS found_by, false AS probed
  UNION ALL SELECT 'A', '/s/' || k, 200, depth, from_a, false FROM w WHERE kind <> 'private'
  UNION ALL SELECT 'B', key_b, status_b, depth, from_b, false FROM w WHERE b AND kind <> 'private'
  UNION ALL SELECT 'A', key_b, 404, NULL, how, true FROM w, direct WHERE b AND kind IN ('redirect', 'variant', 'moved')
  UNION ALL SELECT 'B', CASE WHEN kind IN ('variant', 'moved') THEN '/s/' || k ELSE key_b END, CASE WHEN kind IN ('variant', 'moved') THEN 404 ELSE status_b END, NULL, how, true FROM w, direct WHERE kind IN ('variant', 'moved') OR (NOT b AND kind <> 'private')),
blocked AS (SELECT 'A' AS site, '/private/' || k AS key FROM w WHERE kind = 'private' UNION ALL SELECT 'B', '/private/' || k FROM w WHERE kind = 'private' AND b)
"""
_LOST = "(kind = 'gone' OR (kind IN ('variant', 'moved') AND NOT b))"
_MATCH = "CASE kind WHEN 'redirect' THEN 'redirect' WHEN 'variant' THEN 'url-variant' WHEN 'moved' THEN 'moved' ELSE 'same-path' END"

ORACLE = {
    "planted_metadata": _rows(
        ("k % 4 = 0", "cosmetic", "Page title: minor difference", _T, "'PART ' || k || ' of the list!'"),
        ("k % 4 = 1", "changed", "Page title changed", _T, "'Part ' || k || ' of a new list'"),
        ("k % 4 = 2", "missing", "Page title missing", _T, None),
        ("k % 3 = 0", "added", "Meta description added", None, _D),
        ("k % 3 = 1", "missing", "Meta description missing", _D, None),
        ("k % 5 = 1", "missing", "Canonical URL", "'/p/' || k", None),
        ("k % 5 = 2", "changed", "Canonical URL", "'/p/' || k", "'//other.example/p/' || k", "'On B the canonical address lies on another domain, which search engines will list instead.'"),
        ("k % 5 = 3", "changed", "Canonical URL", "'/p/' || k", "'/q/' || k"),
        ("k % 6 = 0", "changed", "Robots meta tag", "'(none)'", "'noindex,follow'", "'noindex on B only: search engines will NOT index this page there.'"),
        ("k % 6 = 1", "changed", "Robots meta tag", "'noindex'", "'(none)'", "'noindex on A only: B may be indexed.'"),
        ("k % 7 = 0", "changed", "Page language (html lang)", "'en'", "'de'"),
        ("k % 8 = 0", "changed", "Social image (og:image)", "'og' || k || '.png'", "'ognew.png'"),
        ("k % 8 = 1", "missing", "Social image (og:image)", "'og' || k || '.png'", None),
        more=("note",),
    ),
    "planted_headings": _rows(
        ("k % 4 = 0", "structural", "Heading level changed (H2 → H3)", _H, "'H3 · Sizes and colours of part ' || k"),
        ("k % 4 = 1", "changed", "Heading changed", _H, "'H2 · Sizes and prices of part ' || k"),
        ("k % 4 = 2", "missing", "Heading missing", _H, None),
        ("k % 4 = 3", "cosmetic", "Heading: minor difference", _H, "'H2 · SIZES and colours of part ' || k"),
        ("k % 5 = 0", "added", "Heading added", None, "'H4 · Zebra yonder'"),
    ),
    "planted_structure": _rows(("k % 3 > 0", "structural", "Number of tables differs", "'1'", "(1 + k % 3)::VARCHAR"), ("k % 9 = 0", "structural", "Number of embedded frames differs", "'0'", "'1'")),
    "planted_text": _rows(
        ("k % 6 = 0", "changed", "Text changed", _PRICE, "'The price of part ' || k || ' is $' || (k + 11) || ' with delivery.'", "true"),
        ("k % 6 = 1", "missing", "Text missing", _PRICE, None, "false"),
        ("k % 6 = 2", "structural", "Text block appears in a different position", f"'#2: ' || {_PRICE}", f"'#3: ' || {_PRICE}", "false"),
        ("k % 6 = 3", "cosmetic", "Text: minor difference (case, punctuation, dates or times)", _PRICE, "'THE PRICE of part ' || k || ' is $' || (k + 10) || ' with delivery.'", "true"),
        ("k % 6 = 4", "added", "Text added", None, "'Now also sold on the moon by robots.'", "false"),
        more=("word_diff",),
    ),
    "planted_links": _rows(
        ("k % 7 = 0", "missing", "Link missing", _L, None),
        ("k % 7 = 1", "changed", "Link text changed", _L, "'“Details ' || k || '” → /l/' || k"),
        ("k % 7 = 2", "cosmetic", "Link text: minor difference", _L, "'“DETAIL ' || k || '” → /l/' || k"),
        ("k % 7 = 3", "changed", "Link now points to the other site''s domain", _L, "'“Detail ' || k || '” → https://a.example/l/' || k", "'The target on B is Site A''s domain; B''s own page would be /l/' || k || '.'"),
        ("k % 7 = 5", "added", "Link added", None, "'“New” → /new/' || k"),
        ("k % 10 = 1", "error", "Broken link", "'/s/1 → HTTP 200'", "'/s/1 → HTTP 404'"),
        ("k % 10 = 2", "cosmetic", "Link broken on A works on B", "'/s/2 → HTTP 500'", "'/s/2 → HTTP 200'"),
        more=("note",),
    ),
    "planted_images": _rows(
        ("k % 5 = 0", "missing", "Image missing", _I, None),
        ("k % 5 = 1", "missing", "Image alt text missing", _I, "'a' || k || '.png — alt: (empty)'"),
        ("k % 5 = 2", "cosmetic", "Image alt text: minor difference", _I, "'a' || k || '.png — alt: “PICTURE ' || k || '”'"),
        ("k % 5 = 3", "changed", "Image alt text changed", _I, "'a' || k || '.png — alt: “Photo ' || k || '”'"),
        ("k % 10 = 0", "added", "Image added", None, "'new' || k || '.png — alt: (empty)'"),
    ),
    "planted_forms": _rows(
        ("k % 8 = 0", "missing", "Form missing", "'Submits to /send (POST) / Email [email] / Phone [text] / Button: “Send”'", None, None),
        ("k % 8 = 1", "changed", "Field “email” is now required", "'optional'", "'required'", _SEND),
        ("k % 8 = 2", "changed", "Field “email” type changed", "'email'", "'text'", _SEND),
        ("k % 8 = 3", "cosmetic", "Field “email” label: minor difference", "'Email'", "'E-mail'", _SEND),
        ("k % 8 = 4", "changed", "Form method changed", "'POST'", "'GET'", _SEND),
        ("k % 8 = 5", "changed", "Form submits to a different URL", "'/send'", "'/send2'", "'Form submitting to /send2'"),
        ("k % 8 = 6", "changed", "Submit button text changed", "'Send'", "'Send now'", _SEND),
        ("k % 8 = 7", "missing", "Form field missing", "'Phone (name: phone, text)'", None, _SEND),
        ("k % 8 = 7", "added", "Form field added", None, "'Company (name: company, text)'", _SEND),
        more=("context",),
    ),
    "planted_ctas": _rows(
        ("k % 6 = 0", "missing", "Call to action missing", _C, None),
        ("k % 6 = 1", "changed", "Call to action goes somewhere else", _C, "'“Buy ' || k || '” → /order/' || k"),
        ("k % 6 = 2", "changed", "Call to action text changed", _C, "'“Order ' || k || '” → /buy/' || k"),
        ("k % 6 = 3", "cosmetic", "Call to action text: minor difference", _C, "'“BUY ' || k || '” → /buy/' || k"),
        ("k % 6 = 4", "added", "Call to action added", None, "'“Join ' || k || '” → /join'"),
    ),
    "planted_counts": _P + f"""SELECT k, 'A' AS site, 2 AS n_headings, 5 AS n_blocks, 7 AS n_links, 1 AS n_images, 1 AS n_forms, 1 AS n_ctas, 2 AS n_fields FROM m
UNION ALL SELECT k, 'B', (1 + (k % 4 <> 2)::INT + (k % 5 = 0)::INT)::INT, (5 + CASE k % 6 WHEN 1 THEN -1 WHEN 4 THEN 1 ELSE 0 END)::INT, {_N_LINKS_B}::INT, ((k % 5 <> 0)::INT + (k % 10 = 0)::INT)::INT, (k % 8 <> 0)::INT, (CASE k % 6 WHEN 0 THEN 0 WHEN 4 THEN 2 ELSE 1 END)::INT, 2 * (k % 8 <> 0)::INT FROM m""",
    "planted_fields": _P + """, f AS (SELECT k, unnest(['A', 'B']) AS site FROM m), g AS (SELECT k, site, CASE WHEN site = 'A' THEN -1 ELSE k % 8 END AS c FROM f)
SELECT k, site, CASE c WHEN 5 THEN '/send2' ELSE '/send' END AS action, CASE c WHEN 4 THEN 'get' ELSE 'post' END AS method, CASE c WHEN 6 THEN 'Send now' ELSE 'Send' END AS submit, 0::INT AS ord, 'email' AS name, CASE c WHEN 2 THEN 'text' ELSE 'email' END AS type, c = 1 AS required, CASE c WHEN 3 THEN 'E-mail' ELSE 'Email' END AS label FROM g WHERE c <> 0
UNION ALL SELECT k, site, CASE c WHEN 5 THEN '/send2' ELSE '/send' END, CASE c WHEN 4 THEN 'get' ELSE 'post' END, CASE c WHEN 6 THEN 'Send now' ELSE 'Send' END, 1, CASE c WHEN 7 THEN 'company' ELSE 'phone' END, 'text', false, CASE c WHEN 7 THEN 'Company' ELSE 'Phone' END FROM g WHERE c <> 0""",
    "planted_blocks": _unnested(f"list_concat(['Intro of part ' || k || ' stays the same here.', {_PRICE}, {_BOAT}], ['© 2025 Shop', 'Made at 2025-01-02 10:11:12 for you'])", f"list_concat(['Intro of part ' || k || ' stays the same here.'], {_BLOCKS_B}, ['© 2026 Shop', 'Made at 2026-03-04 11:12:13 for you'])",
        f"x AS text, CASE WHEN ord = 0 THEN 'Part ' || k WHEN site = 'A' THEN 'Sizes and colours of part ' || k ELSE {_SECTION_B} END AS section"),
    "planted_targets": _unnested(_TARGETS_A, _TARGETS_B, "x AS target"),
    "js_rendered": "SELECT p_partkey, p_partkey % 2 = 0 AS needs_scripts FROM part",
    "crawl_pages": _S + "SELECT site, key, status, depth, found_by, probed FROM pages",
    "crawl_aliases": _S + "SELECT 'B' AS site, '/s/' || k AS req_key, '/t/' || k AS final_key, '301' AS code FROM w WHERE kind = 'redirect'",
    "crawl_blocked": _S + "SELECT site, key FROM blocked",
    "crawl_skipped": _S + """, open AS (SELECT unnest(['A', 'B']) AS site, 0 AS k UNION ALL SELECT 'A', k FROM w WHERE kind <> 'private' UNION ALL SELECT 'B', k FROM w WHERE b AND kind IN ('same', 'variant', 'moved', 'redirect'))
SELECT site, 'https://' || lower(site) || '.example/file/' || k || '.pdf' AS url, 'file download (not a page)' AS reason FROM open UNION ALL SELECT site, 'https://' || lower(site) || '.example/cart/' || k, 'excluded by ignore.urlPatterns' FROM open
UNION ALL SELECT site, 'https://' || lower(site) || '.example' || key, 'disallowed by robots.txt' FROM blocked""",
    "crawl_limits": "SELECT unnest(['A', 'B']) AS site, 7::BIGINT AS fetched, 0::BIGINT AS probes, true AS limit_reached",
    "crawl_statuses": _S + "SELECT site, key, status, false AS robots FROM pages UNION ALL SELECT 'B', '/s/' || k, 200, false FROM w WHERE kind = 'redirect' UNION ALL SELECT site, key, NULL, true FROM blocked",
    "site_pairs": _S + f"""SELECT '/' AS path, '/' AS key_a, '/' AS key_b, 'same-path' AS match, 'compared' AS kind, NULL::VARCHAR AS redirect_on, NULL::VARCHAR AS code, NULL::DOUBLE AS similarity, NULL::VARCHAR AS other_state, NULL::VARCHAR AS other_text
UNION ALL SELECT '/s/' || k, '/s/' || k, NULL, 'none', 'only-a', NULL, NULL, NULL, 'missing', 'returns HTTP 404' FROM w WHERE {_LOST}
UNION ALL SELECT '/s/' || k, '/s/' || k, key_b, {_MATCH}, CASE kind WHEN 'fails' THEN 'error' ELSE 'compared' END, CASE kind WHEN 'redirect' THEN 'B' END, CASE kind WHEN 'redirect' THEN '301' END, CASE kind WHEN 'moved' THEN 1.0 END, NULL, NULL FROM w WHERE kind <> 'private' AND NOT {_LOST}""",
    "site_page_diffs": _S + f"""SELECT '/s/' || k AS path, 'missing' AS sig, 'Page missing on Site B' AS title, '/s/' || k || ' → HTTP 200' AS a, '/s/' || k || ' returns HTTP 404' AS b FROM w WHERE {_LOST}
UNION ALL SELECT '/s/' || k, 'error', 'Page failed to load on Site B', '/s/' || k || ' → HTTP 200', '/s/' || k || ' → HTTP 500' FROM w WHERE kind = 'fails'
UNION ALL SELECT '/s/' || k, 'structural', 'URL changed (old URL redirects)', '/s/' || k, '/s/' || k || ' → 301 → /t/' || k FROM w WHERE kind = 'redirect'
UNION ALL SELECT '/s/' || k, 'structural', 'URL changed', '/s/' || k, key_b FROM w WHERE kind = 'variant' AND b
UNION ALL SELECT '/s/' || k, 'structural', 'Page appears to have moved (100% similar content)', '/s/' || k, key_b FROM w WHERE kind = 'moved' AND b
UNION ALL SELECT '/s/' || k, 'structural', 'Not linked from Site B''s pages', 'Linked (found by crawling)', 'Found only by requesting the URL directly' FROM w WHERE kind IN ('same', 'redirect') AND NOT b""",
}
