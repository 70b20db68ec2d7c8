"""Reports of a comparison: JSON and one self-contained HTML file."""

from __future__ import annotations

import html as h
import json
import os
import re
from collections import Counter
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetwin.config import CATEGORIES, CATEGORY_LABELS, SIGNIFICANCE
from pagetwin.operators.align import word_diff
from pagetwin.operators.diffs import ranked
from pagetwin.operators.sitewide import report_order
from pagetwin.plans.compare import Comparison

LABEL = dict(zip(CATEGORIES, CATEGORY_LABELS))
MEANS = {
    "error": "does not load", "missing": "B lacks it", "changed": "both have it, with other content", "added": "only B has it",
    "structural": "same content, built or placed otherwise", "cosmetic": "letter case, marks, dates, small shifts",
}
OUTCOME = {"only-a": "A alone", "only-b": "B alone", "error": "not loaded"}
SKIPPED_SHOWN = 500


def run_folder(host_a: str, host_b: str, now: datetime) -> str:
    clean = lambda x: re.sub(r"[^A-Za-z0-9.-]+", "_", x)
    return f"{clean(host_a)}-vs-{clean(host_b)}-{now:%Y%m%d-%H%M%S}"


def report_rows(c: Comparison) -> DataFrame:
    """One row per page in report order, with its differences in order: the distributed form of the report."""
    ordered = ranked(c.diffs)
    fields = [x for x in c.diffs.columns if x not in ("path", "fp", "place")]
    lists = ordered.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("category_rank", "rank", "place", F.struct(*fields).alias("d")))).alias("ds")).select("path", F.transform("ds", lambda x: x["d"]).alias("diffs"))
    wide = c.page_site_wide.join(c.site_wide.select("fp", F.col("place").alias("index")), "fp").groupBy("path").agg(F.array_sort(F.collect_list("index")).alias("siteWide"))
    side = lambda s: c.crawl.pages.where(F.col("site") == s).select(F.col("key").alias(f"key_{s.lower()}"), F.col("final_url").alias(f"url{s}"), F.col("snap.meta.title.raw").alias(f"title{s}"))
    out = c.pages.join(lists, "path", "left").join(wide, "path", "left").join(side("A"), "key_a", "left").join(side("B"), "key_b", "left")
    return out.orderBy(*report_order(out)).select(
        "path", F.col("key_a").alias("keyA"), F.col("key_b").alias("keyB"), "kind", "match", "identical", "urlA", "urlB", F.col("status_a").alias("statusA"), F.col("status_b").alias("statusB"),
        "titleA", "titleB", F.coalesce("diffs", F.array().cast(lists.schema["diffs"].dataType)).alias("diffs"), F.coalesce("siteWide", F.array().cast("array<int>")).alias("siteWide"),
    )


def write_json_lines(c: Comparison, folder: str) -> None:
    """The report as tables in any file system: pages, site-wide differences and totals."""
    report_rows(c).write.mode("overwrite").json(f"{folder}/pages")
    c.site_wide.drop("fp", "first").orderBy("place").write.mode("overwrite").json(f"{folder}/site_wide")
    c.summary.write.mode("overwrite").json(f"{folder}/summary")


def result_document(c: Comparison, url_a: str, url_b: str, cfg: dict, started: datetime) -> dict:
    """The whole report as one document; meant for site comparisons of a size that people read."""
    plain = lambda rows: [r.asDict(recursive=True) for r in rows]
    fetched = {r["site"]: r["n"] for r in c.crawl.pages.groupBy("site").agg(F.count(F.lit(1)).alias("n")).collect()}
    skipped = plain(c.crawl.skipped.orderBy("site", "url").limit(2 * SKIPPED_SHOWN).collect())
    of = lambda s: [{"url": x["url"], "reason": x["reason"]} for x in skipped if x["site"] == s]
    site_wide = plain(c.site_wide.orderBy("place").drop("fp", "first", "category_rank").collect())
    return {
        "generatedAt": started.isoformat(),
        "durationSec": round((datetime.now(UTC) - started).total_seconds()),
        "sites": {s: {"label": cfg["output"][f"label{s}"], "url": u, "pagesFetched": fetched.get(s, 0), "skipped": of(s)} for s, u in (("A", url_a), ("B", url_b))},
        "settings": {"renderMode": cfg["render"]["mode"], "maxPages": cfg["crawl"]["maxPages"], "respectRobotsTxt": cfg["http"]["respectRobotsTxt"], "delayMs": cfg["http"]["delayMs"], "visual": cfg["visual"]["enabled"]},
        "notes": c.notes,
        "summary": plain(c.summary.collect())[0],
        "siteWide": site_wide,
        "pages": plain(report_rows(c).collect()),
    }


def tag(sig: str, n: int | None = None) -> str:
    return f'<abbr class="s-{sig}" title="{MEANS[sig]}">{sig}{"" if n is None else f" × {n}"}</abbr>'


def cell(values: list[str] | None) -> str:
    """One side of a difference; several values are lines."""
    return "<i>nothing</i>" if values is None else "<br>".join(map(h.escape, values))


def sides(d: dict) -> tuple[str, str]:
    """Both sides as HTML; single values that are alike have their differing words marked."""
    a, b = d["a"], d["b"]
    if not (d["word_diff"] and a and b and len(a) == len(b) == 1):
        return cell(a), cell(b)
    parts = word_diff(a[0], b[0])
    marked = lambda own, name: "".join(f"<{name}>{h.escape(t)}</{name}>" if k == own else h.escape(t) for k, t in parts if k in ("same", own))
    return marked("removed", "del"), marked("added", "ins")


def difference_row(d: dict, where: str = "") -> str:
    a, b = sides(d)
    about = " · ".join(h.escape(x) for x in (d.get("context"), d.get("note")) if x)
    return f'<tr class="difference" data-s="{d["sig"]}" data-c="{d["category"]}"><td>{tag(d["sig"])}</td><td>{LABEL[d["category"]]}: {h.escape(d["title"])}{where}<br><small>{about}</small></td><td>{a}</td><td>{b}</td></tr>'


def difference_table(diffs: list[dict], most: int, where=lambda d: "") -> str:
    """Differences by category, `most` of each."""
    rows = []
    for c in CATEGORIES:
        mine = [d for d in diffs if d["category"] == c]
        rows += [difference_row(d, where(d)) for d in mine[:most]]
        if len(mine) > most:
            rows.append(f'<tr><td colspan="4"><small>{LABEL[c]}: {len(mine) - most} not listed</small></td></tr>')
    return f"<table><tr><th>Kind</th><th>What</th><th>A</th><th>B</th></tr>{''.join(rows)}</table>"


def outcome(p: dict) -> str:
    if p["kind"] != "compared":
        return OUTCOME[p["kind"]]
    counts = Counter(d["sig"] for d in p["diffs"])
    said = [tag(s, counts[s]) for s in SIGNIFICANCE if counts[s]] + ([f"{len(p['siteWide'])} site-wide"] if p["siteWide"] else [])
    return " ".join(said) or "identical"


STYLE = "body{font:16px/1.4 system-ui;margin:auto;max-width:80rem;padding:1rem}table{border-collapse:collapse;width:100%}td,th{border:1px solid #bbb;padding:.3rem;text-align:left;vertical-align:top}dl{display:grid;grid-template-columns:max-content auto;gap:.1rem 1rem}dd{margin:0}abbr{font-weight:bold}.s-error,.s-missing{color:#b00020}.s-cosmetic,small{color:#666}del{background:#ffd6d6}ins{background:#d3f5d3}"
SCRIPT = """
const show=document.forms.show;
show.oninput=()=>{const data=new FormData(show),kinds=new Set(data.getAll('kind')),path=data.get('path').toLowerCase();
for(const row of document.querySelectorAll('.difference'))row.hidden=!kinds.has(row.dataset.s)||(data.get('category')&&row.dataset.c!==data.get('category'));
for(const part of document.querySelectorAll('[data-path]'))part.hidden=!part.dataset.path.toLowerCase().includes(path);};"""


def render_html(r: dict, cfg: dict) -> str:
    """One self-contained page: totals, notes, a list of pages, and the differences of each."""
    e, s, sites = h.escape, r["summary"], r["sites"]
    name = lambda p: " → ".join(dict.fromkeys(k for k in (p["keyA"], p["keyB"]) if k))
    totals = {"Pages compared": s["pages_compared"], "of them identical": s["identical"], "of them with differences": s["with_differences"], "Site-wide differences": s["site_wide"], "Pages of A alone": s["only_a"], "Pages of B alone": s["only_b"], "Pages that did not load": s["errors"]}
    kinds = "".join(f'<label><input type="checkbox" name="kind" value="{k}" checked>{tag(k, s["by_significance"].get(k, 0))}: {MEANS[k]}</label><br>' for k in SIGNIFICANCE)
    options = "".join(f'<option value="{c}">{LABEL[c]}</option>' for c in CATEGORIES)
    pages = "".join(f'<tr data-path="{e(name(p))}"><td><a href="#page-{n}">{e(name(p))}</a></td><td>{outcome(p)}</td><td>{p["statusA"] or ""}</td><td>{p["statusB"] or ""}</td></tr>' for n, p in enumerate(r["pages"]))
    most = cfg["output"]["maxDiffsPerCategory"]
    found = "".join(f'<section id="page-{n}" data-path="{e(name(p))}"><h3>{e(name(p))}</h3>{difference_table(p["diffs"], most)}</section>' for n, p in enumerate(r["pages"]) if p["diffs"])
    wide = difference_table(r["siteWide"], most, lambda d: f"<br><small>{len(d['pages'])} pages: {e(', '.join(d['pages'][:20]))}</small>") if r["siteWide"] else ""
    skipped = "".join(f"<li>{s}: {e(x['url'])} ({e(x['reason'])})</li>" for s in "AB" for x in sites[s]["skipped"][:SKIPPED_SHOWN])
    title = " / ".join(e(sites[s]["label"]) for s in "AB")
    parts = [
        f"<h1>{title}</h1><p>A: {e(sites['A']['url'])}<br>B: {e(sites['B']['url'])}<br>{e(r['generatedAt'])}</p>",
        f"<dl>{''.join(f'<dt>{k}</dt><dd>{v}</dd>' for k, v in totals.items())}</dl>",
        f"<ul>{''.join(f'<li>{e(n)}</li>' for n in r['notes'])}</ul>",
        f'<form name="show">{kinds}<select name="category"><option value="">every category</option>{options}</select> <input name="path" placeholder="part of a path"></form>',
        f"<h2>Pages</h2><table><tr><th>Path</th><th>Outcome</th><th>A</th><th>B</th></tr>{pages}</table>",
        f"<h2>Site-wide differences</h2>{wide}" if wide else "",
        f"<h2>Differences by page</h2>{found}" if found else "",
        f"<details><summary>Links that were not followed</summary><ul>{skipped}</ul></details>" if skipped else "",
    ]
    return f'<!doctype html><html lang="en"><meta charset="utf-8"><title>{title}</title><style>{STYLE}</style><body>{"".join(parts)}<script>{SCRIPT}</script></body></html>'


def write_report(result: dict, folder: str, cfg: dict) -> tuple[str, str | None]:
    os.makedirs(folder, exist_ok=True)
    page, data = os.path.join(folder, "report.html"), os.path.join(folder, "report.json")
    with open(page, "w", encoding="utf-8") as f:
        f.write(render_html(result, cfg))
    if not cfg["output"]["writeJson"]:
        return page, None
    with open(data, "w", encoding="utf-8") as f:
        json.dump(result, f, indent=2, ensure_ascii=False, default=str)
    return page, data
