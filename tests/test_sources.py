import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from pagetwin.config import build_config
from pagetwin.plans.compare import compare
from pagetwin.sources.http import Fetcher, PagesSource, fetch
from pagetwin.sources.live import record
from pagetwin.streaming.rediff import RunLog, baseline, title_changes, watch


@pytest.fixture(scope="module")
def server():
    class Handler(BaseHTTPRequestHandler):
        tries = 0

        def do_GET(self):
            body, status, headers = "<title>x</title>", 200, {"content-type": "text/html"}
            if self.path == "/robots.txt":
                body, headers = "User-agent: *\nDisallow: /private\n", {"content-type": "text/plain"}
            elif self.path == "/go":
                status, headers = 301, {"location": "/to"}
            elif self.path == "/away":
                status, headers = 302, {"location": "http://other.example/x"}
            elif self.path == "/loop":
                status, headers = 302, {"location": "/loop"}
            elif self.path == "/busy":
                Handler.tries += 1
                status = 503 if Handler.tries == 1 else 200
            elif self.path == "/pdf":
                headers = {"content-type": "application/pdf"}
            elif self.path == "/slow":
                time.sleep(3)
            self.send_response(status)
            for k, v in headers.items():
                self.send_header(k, v)
            self.end_headers()
            try:
                self.wfile.write(body.encode())
            except OSError:
                pass

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


CFG = build_config({"http": {"delayMs": 0, "timeoutMs": 1000, "retries": 1, "maxRedirects": 3}})


def test_fetching(server):
    f = Fetcher(CFG)
    page = lambda p: f.page(server + p)
    assert page("/")["html"] == "<title>x</title>"
    r = page("/go")
    assert (r["status"], r["final_url"], r["redirects"][0]["status"]) == (200, server + "/to", 301)
    assert page("/private/x")["robots_blocked"] and page("/away")["off_site"] and "hops" in page("/loop")["error"]
    assert page("/busy")["status"] == 200 and page("/pdf")["html"] is None
    assert Fetcher(build_config(CFG, {"http": {"retries": 0}})).page(server + "/slow")["error"].startswith("Timed out")
    assert "refuses" in f.page("http://127.0.0.1:1/")["error"] and f.text(server + "/robots.txt").startswith("User-agent")


def test_fetch_as_rows(spark, server):
    rows = fetch(spark.createDataFrame([(server + "/",), (server + "/go",), (server + "/",)], "url string"), CFG).collect()
    assert sorted(r["final_url"] for r in rows) == [server + "/", server + "/to"]
    spark.dataSource.register(PagesSource)
    got = spark.read.format("pagetwin-http").option("urls", f"{server}/ {server}/go").option("delayMs", "0").load()
    assert got.where("status = 200").count() == 2


def site(pages):
    """A server that answers with `pages` (path to text, or to the target of a redirect as a tuple)."""

    class Handler(BaseHTTPRequestHandler):
        asked: list = []

        def do_GET(self):
            Handler.asked.append(self.path)
            found = pages.get(self.path)
            self.send_response(404 if found is None else 301 if isinstance(found, tuple) else 200)
            if isinstance(found, tuple):
                self.send_header("location", found[0])
            self.send_header("content-type", "text/plain" if self.path.endswith((".txt", ".xml")) else "text/html")
            self.end_headers()
            if isinstance(found, str):
                self.wfile.write(found.encode())

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    return s, Handler.asked


def test_live_sites(spark):
    def page(name, *links):
        words = " ".join(f"{name}{k}" for k in range(30))
        return f"<html><title>{name}</title><body><h1>{name}</h1><p>{words}</p>{''.join(f'<p>see <a href={x}>{x}</a> for more about it</p>' for x in links)}</body></html>"

    a = {"/": page("home", "/one", "/old", "/private/x", "/file.pdf", "/gone"), "/one": page("one", "/deep"), "/deep": page("deep"), "/old": page("old"), "/hidden": page("hidden"), "/robots.txt": "User-agent: *\nDisallow: /private/\nSitemap: ORIGIN/more.xml\n", "/gone": page("gone")}
    b = {**{k: v for k, v in a.items() if k != "/gone"}, "/": page("home", "/one", "/old", "/private/x", "/file.pdf"), "/old": ("/new",), "/new": page("old")}
    index, more = "<sitemapindex><sitemap><loc>ORIGIN/third.xml</loc></sitemap></sitemapindex>", "<urlset><url><loc>ORIGIN/hidden</loc></url></urlset>"
    servers = []
    for pages in (a, b):
        s, asked = site(pages)
        origin = f"http://127.0.0.1:{s.server_port}"
        pages |= {"/robots.txt": pages["/robots.txt"].replace("ORIGIN", origin), "/more.xml": index.replace("ORIGIN", origin), "/third.xml": more.replace("ORIGIN", origin)}
        servers.append((s, asked, origin + "/"))
    starts = {"A": servers[0][2], "B": servers[1][2]}
    got = record(spark, starts, CFG)
    assert {(r["site"], r["url"]) for r in got.sitemaps.collect()} == {(s, u + "hidden") for s, u in starts.items()}
    assert "/private/x" not in servers[0][1] and "/file.pdf" not in servers[0][1] and servers[1][1].count("/gone") == 1
    c = compare(spark, got.served, starts["A"], starts["B"], cfg=CFG, robots=got.robots, sitemaps=got.sitemaps, stopped=got.stopped)
    pairs = {r["path"]: (r["kind"], r["match"], r["key_b"]) for r in c.pairs.collect()}
    assert pairs == {p: ("compared", "same-path", p) for p in ("/", "/one", "/deep", "/hidden")} | {"/old": ("compared", "redirect", "/new"), "/gone": ("only-a", "none", None)}
    assert not any("stopped early" in n for n in c.notes) and sum("robots.txt" in n for n in c.notes) == 2
    early = record(spark, starts, CFG, stop=lambda: True)
    assert early.stopped and {r["path"] for r in early.served.collect()} == {"/"}
    few = record(spark, starts, build_config(CFG, {"crawl": {"maxPages": 2, "maxProbes": 0, "useSitemap": False}}))
    assert sorted((r["site"], r["path"]) for r in few.served.collect()) == [("A", "/"), ("A", "/one"), ("B", "/"), ("B", "/one")]
    for s, _, _ in servers:
        s.shutdown()


def test_streams(spark, tmp_path):
    page = lambda t: f"<html><title>{t}</title><body><h1>{t}</h1><p>Some words about {t} for readers.</p></body></html>"
    old = spark.createDataFrame([("https://a.example/x/", page("One")), ("https://a.example/y", page("Two"))], "url string, html string")
    base = baseline(old, CFG)
    src = str(tmp_path / "in")
    spark.createDataFrame([("https://b.example/x", page("ONE")), ("https://b.example/y", page("Three")), ("https://b.example/z", page("New"))], "url string, html string").write.parquet(src)
    stream = spark.readStream.schema("url string, html string").parquet(src)
    q = title_changes(stream, base, CFG).writeStream.format("memory").queryName("titles").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["key"], r["sig"]) for r in spark.table("titles").collect()} == {("/x", "cosmetic"), ("/y", "changed")}
    w = watch(stream, base, CFG, str(tmp_path / "out"), str(tmp_path / "cp"))
    w.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["path"], r["category"], r["sig"]) for r in found.collect()} >= {("/x", "metadata", "cosmetic"), ("/y", "metadata", "changed"), ("/y", "headings", "changed")}


def test_run_log():
    sent = []
    log = RunLog(lambda e, d: sent.append(d["phase"]))
    for line in ("Render mode: never", "[A] 3/100 /x (200)", "[B] probe /y (404)", "Visual compare /x"):
        log(line)
    assert sent == ["Crawling both sites", "Crawling both sites", "Checking pages found on one site only", "Comparing screenshots"]
    assert log.state()["progress"] == {"A": {"n": 3, "max": 100}} and len(log.state()["lines"]) == 4
