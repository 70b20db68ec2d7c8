"""URL scope, page keys and canonical link forms as column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetwin.functions.text import let


@dataclass(frozen=True)
class Scope:
    """A site: its start URL, origin, comparable host and base path."""

    start_url: str
    origin: str
    host: str
    base_path: str


def create_scope(start_url: str, cfg: dict) -> Scope:
    u = urlsplit(start_url)
    if u.scheme not in ("http", "https") or not u.hostname:
        raise ValueError(f"Only http(s) URLs are supported: {start_url}")
    path = u.path or "/"
    if not path.endswith("/"):
        folder, _, last = path.rpartition("/")
        path = f"{folder}/" if "." in last else f"{path}/"
    port = f":{u.port}" if u.port and u.port != {"http": 80, "https": 443}[u.scheme] else ""
    host = u.hostname.lower()
    bare = host.removeprefix("www.") if cfg["crawl"]["wwwEquivalent"] else host
    query = f"?{u.query}" if u.query else ""
    return Scope(f"{u.scheme}://{host}{port}{u.path or '/'}{query}", f"{u.scheme}://{host}{port}", bare + port, path)


def _c(x: str | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def path(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^:/?#]+:(?://[^/?#]*)?([^?#]*)", 1)


def query(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)


def norm_host(u: Column, www_equivalent: bool = True) -> Column:
    """Lower-case host, no leading www., a port only where it is not the scheme's own."""
    authority = F.lower(F.regexp_extract(u, r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(authority, r"^(.*?):?$", "$1"), "^www\\.", "") if www_equivalent else F.regexp_replace(authority, r"^(.*?):?$", "$1")
    return F.when(scheme(u) == "http", F.regexp_replace(host, ":80$", "")).when(scheme(u) == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)


def decode_uri(c: Column) -> Column:
    """Percent escapes decoded but for those of reserved characters; malformed input stays as it is."""
    shielded = F.regexp_replace(c, "(?i)%(3B|2F|3F|3A|40|26|3D|2B|24|2C|23)", "%25$1")
    return F.when(F.contains(c, F.lit("%")), F.coalesce(F.try_url_decode(F.replace(shielded, F.lit("+"), F.lit("%2B"))), c)).otherwise(c)


def is_in_scope(u: Column, host: str | Column, base_path: str | Column, cfg: dict) -> Column:
    p = _filled(path(u))
    same = scheme(u).isin("http", "https") & (norm_host(u, cfg["crawl"]["wwwEquivalent"]) == _c(host))
    return F.coalesce(same & (F.startswith(p, _c(base_path)) | (F.concat(p, F.lit("/")) == _c(base_path))), F.lit(False))


def to_key(u: Column, base_path: str | Column, cfg: dict) -> Column:
    """Page key: the path below the start URL without index file, trailing slashes, query and fragment."""
    base = _c(base_path)
    files = "|".join(re.escape(f) for f in cfg["crawl"]["indexFiles"])
    keep = cfg["crawl"]["keepQueryParams"]

    def below(p: Column) -> Column:
        return F.when(F.startswith(p, base), F.concat(F.lit("/"), F.substr(p, F.length(base) + 1))).when(F.concat(p, F.lit("/")) == base, F.lit("/")).otherwise(p)

    def trimmed(p: Column) -> Column:
        # Index files and trailing slashes in two replacements; nothing left is the start page.
        bare = F.regexp_replace(F.regexp_replace(p, rf"(?i)/(?:{files})$", "/") if files else p, "(?<=.)/+$", "")
        return F.when(bare == "", F.lit("/")).otherwise(bare)

    p = let(F.regexp_replace(let(_filled(path(u)), decode_uri), "/{2,}", "/"), lambda p: let(below(p), trimmed))
    if keep:
        pairs = F.array_sort(F.filter(F.split(query(u), "&"), lambda x: F.regexp_extract(x, "^([^=]*)", 1).isin(*keep)))
        p = F.concat(p, F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(F.lit("")))
    return p


def _filled(p: Column) -> Column:
    return F.when(p == "", F.lit("/")).otherwise(p)


def key_to_url(key: Column, scope: Scope) -> Column:
    return F.concat(F.lit(scope.origin + scope.base_path.removesuffix("/")), key)


def loose_key(key: Column) -> Column:
    """Pairs keys that differ only cosmetically: case, page extension, underscores."""
    k = F.regexp_replace(F.lower(key), r"\.(html?|php|aspx?|jsp|cfm)(?=$|\?)", "")
    return let(F.regexp_replace(F.translate(k, "_", "-"), "/+$", ""), _filled)


def _tracking(cfg: dict) -> str:
    return "(?i)^(?:" + "|".join(".*".join(re.escape(part) for part in p.split("*")) for p in cfg["ignore"]["trackingParams"]) + ")$"


def strip_tracking(q: Column, cfg: dict) -> Column:
    """A query string without tracking parameters, sorted by name."""
    name = lambda x: F.regexp_extract(x, "^([^=]*)", 1)
    kept = F.filter(F.split(q, "&"), lambda x: (x != "") & ~name(x).rlike(_tracking(cfg)))
    # A stable sort by name: the place in the list breaks ties.
    ranked = F.array_sort(F.transform(kept, lambda x, i: F.struct(name(x).alias("n"), i.alias("i"), x.alias("x"))))
    return F.array_join(F.transform(ranked, lambda r: F.when(F.contains(r["x"], F.lit("=")), r["x"]).otherwise(F.concat(r["x"], F.lit("=")))), "&")


def normalize_external(u: Column, cfg: dict) -> Column:
    q = strip_tracking(query(u), cfg)
    head = F.when(scheme(u).isin("http", "https"), F.lit("")).otherwise(F.concat(scheme(u), F.lit(":")))
    return F.concat(head, F.lit("//"), norm_host(u, True), F.regexp_replace(path(u), "/+$", ""), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))


def link_key(u: Column, host: str | Column, base_path: str | Column, cfg: dict) -> Column:
    """Comparable form of a link target; null stays null."""
    plain = F.concat(scheme(u), F.lit(":"), F.lower(F.coalesce(F.try_url_decode(F.replace(path(u), F.lit("+"), F.lit("%2B"))), path(u))))
    return F.when(u.isNull(), F.lit(None).cast("string")).when(scheme(u).isin("mailto", "tel", "sms"), plain).when(is_in_scope(u, host, base_path, cfg), to_key(u, base_path, cfg)).otherwise(normalize_external(u, cfg))


def show_target(k: Column) -> Column:
    return F.when(F.startswith(k, F.lit("//")), F.concat(F.lit("https:"), k)).otherwise(k)


def image_key(u: Column, cfg: dict) -> Column:
    """File name of an image, without hashes and size suffixes."""
    p = path(u)
    last = F.element_at(F.split(p, "/"), -1)
    raw = F.when(last == "", p).otherwise(last)
    name = F.lower(F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw))
    for pattern in cfg["ignore"]["imageNamePatterns"]:
        # Only the first match goes; the patterns end at the extension, so there is one.
        name = F.regexp_replace(name, f"(?i)^(.*?){pattern}", "$1")
    return F.when(name == "", u).otherwise(name)


def has_skipped_extension(p: Column, cfg: dict) -> Column:
    return F.lower(F.regexp_extract(p, r"\.([A-Za-z0-9]{1,5})$", 1)).isin(*cfg["crawl"]["skipExtensions"])


def is_excluded_path(p: Column, cfg: dict) -> Column:
    """A plain pattern matches a whole path segment and what is below; others are regular expressions."""
    plain = lambda x: not re.search(r"[\\^$*+?()\[\]{}|]", x)
    each = [f"{re.escape(x)}(?:/|$)" if plain(x) else f"(?:{x})" for x in cfg["ignore"]["allUrlPatterns"]]
    return p.rlike("(?i)" + "|".join(each)) if each else F.lit(False)


def reject_reason(u: Column, host: str | Column, base_path: str | Column, cfg: dict) -> Column:
    """Why a discovered URL is not crawled; null if it is."""
    return (
        F.when(scheme(u) == "", F.lit("invalid URL"))
        .when(~is_in_scope(u, host, base_path, cfg), F.lit("outside site"))
        .when(has_skipped_extension(path(u), cfg), F.lit("file download (not a page)"))
        .when(is_excluded_path(path(u), cfg), F.lit("excluded by ignore.urlPatterns"))
    )
