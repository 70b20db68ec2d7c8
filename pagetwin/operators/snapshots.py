"""Pages to snapshots: HTML is parsed in Python, all normal forms are column expressions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from pagetwin.functions import urls
from pagetwin.functions.html import RAW_DDL, extract
from pagetwin.functions.text import collapse_ws, cosmetic_text, norm_of_raw, norm_text, with_values
from pagetwin.session import prepare


def with_raw(pages: DataFrame, cfg: dict, html: str = "html", url: str = "final_url") -> DataFrame:
    """`pages` with `raw`, the parts of each page; null where there is no HTML."""
    prepare(pages.sparkSession)
    kind = to_arrow_type(StructType.fromDDL(re.sub(r"\s*\n\s*", " ", RAW_DDL)))
    selectors, hidden = cfg["ignore"]["allSelectors"], cfg["ignore"]["ignoreHiddenFormFields"]

    @F.arrow_udf(f"struct<{_colons(RAW_DDL)}>")
    def raw(page: pa.Array, at: pa.Array) -> pa.Array:
        rows = []
        for h, u in zip(page, at):
            row = None if h.as_py() is None else extract(h.as_py(), u.as_py() or "", selectors, hidden)
            rows.append(row and row | {"structure": list(row["structure"].items())})
        return pa.array(rows, kind)

    # As if it were not deterministic: the optimiser then never copies the parser into filters that it infers.
    return pages.withColumn("raw", raw.asNondeterministic()(F.col(html), F.col(url)))


def _colons(ddl: str) -> str:
    """Top-level `name type` pairs as `name:type`."""
    return re.sub(r"(^|,)\s*([a-z_]+) (?=string|array|map|boolean|int)", r"\1\2:", re.sub(r"\s*\n\s*", " ", ddl))


def looks_js_rendered(raw: Column, cfg: dict) -> Column:
    """Whether static HTML seems to need scripts to show its content."""
    least = cfg["render"]["minStaticTextChars"]
    asks = raw["noscript"].rlike("(?i)enable javascript|javascript (is )?required")
    return F.coalesce((raw["has_script"] & ((raw["static_chars"] < least) | raw["empty_mount"])) | (asks & (raw["static_chars"] < 1000)), F.lit(False))


def _value(raw: Column, cfg: dict) -> Column:
    norm = norm_of_raw(raw, cfg)
    return F.struct(raw.alias("raw"), norm.alias("norm"), cosmetic_text(norm, cfg).alias("cos"))


def snapshot(raw: Column, host: Column | str, base_path: Column | str, cfg: dict) -> Column:
    """The comparable form of a page's raw parts."""
    link = lambda u: urls.link_key(u, host, base_path, cfg)
    blank = lambda c: F.coalesce(c, F.lit(""))
    meta = F.struct(
        *(_value(raw[n], cfg).alias(n) for n in ("title", "description", "og_title", "og_description")),
        blank(link(raw["canonical"])).alias("canonical"),
        raw["robots"].alias("robots"),
        raw["lang"].alias("lang"),
        blank(urls.image_key(raw["og_image"], cfg)).alias("og_image"),
    )
    headings = F.filter(with_values(raw["headings"], "text", {"level": lambda x: x["level"]}, cfg), lambda h: h["text"]["norm"] != "")
    blocks = F.filter(with_values(raw["blocks"], "text", {"section": lambda x: x["section"]}, cfg), lambda b: b["text"]["norm"] != "")
    links = with_values(raw["links"], "text", {"key": lambda x: link(x["href"]), "href": lambda x: x["href"], "cta": lambda x: x["cta"], "inside": lambda x: urls.is_in_scope(x["href"], host, base_path, cfg)}, cfg)
    images = with_values(raw["images"], "alt", {"key": lambda x: urls.image_key(x["src"], cfg), "src": lambda x: x["src"], "has_alt": lambda x: x["has_alt"]}, cfg)
    ctas = with_values(raw["ctas"], "text", {"target": lambda x: F.coalesce(link(x["href"]), F.lit("(button)"))}, cfg)
    field = lambda x: F.struct(
        x["name"].alias("name"),
        x["type"].alias("type"),
        x["required"].alias("required"),
        x["label"].alias("label"),
        F.lower(norm_text(x["name"], cfg)).alias("match_name"),
        norm_text(x["label"], cfg).alias("label_norm"),
        F.regexp_replace(F.lower(norm_text(x["label"], cfg)), r"[^\p{L}\p{N}]", "").alias("label_cos"),
    )
    forms = with_values(raw["forms"], "submit", {"action": lambda x: link(x["action"]), "method": lambda x: x["method"], "fields": lambda x: F.transform(x["fields"], field)}, cfg)
    return F.struct(meta.alias("meta"), headings.alias("headings"), raw["structure"].alias("structure"), blocks.alias("blocks"), links.alias("links"), images.alias("images"), forms.alias("forms"), ctas.alias("ctas"))


def full_text(snap: Column) -> Column:
    """Title, headings and blocks in their norm forms."""
    norms = lambda items: F.transform(items, lambda x: x["text"]["norm"])
    return F.array_join(F.concat(F.array(snap["meta"]["title"]["norm"]), norms(snap["headings"]), norms(snap["blocks"])), " ")


def with_snapshots(pages: DataFrame, scopes: dict[str, urls.Scope], cfg: dict) -> DataFrame:
    """`pages` (site, final_url, html, ...) with `raw`, `snap` and `full_text`; scopes by site."""
    by_site = lambda get: F.coalesce(*(F.when(F.col("site") == s, F.lit(get(sc))) for s, sc in scopes.items()))
    host, base = by_site(lambda s: s.host), by_site(lambda s: s.base_path)
    out = with_raw(pages, cfg).withColumn("snap", F.when(F.col("raw").isNotNull(), snapshot(F.col("raw"), host, base, cfg)))
    return out.withColumn("full_text", full_text(F.col("snap")))
