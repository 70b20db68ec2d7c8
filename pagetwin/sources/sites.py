"""Recorded sites: folders of files as a server would answer for them, robots.txt rules, sitemaps, past runs."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SERVED = "site string, path string, status int, redirect_to string, content_type string, html string, error string"

#: Content types by extension; anything else is a download.
TYPES = {"html": "text/html", "htm": "text/html", "txt": "text/plain", "xml": "application/xml", "json": "application/json", "css": "text/css", "js": "text/javascript", "svg": "image/svg+xml", "png": "image/png", "jpg": "image/jpeg", "pdf": "application/pdf"}


def small_file(spark: SparkSession, path: str) -> str | None:
    """Text of a small file wherever Spark can read it, hidden ones too; null if there is none."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def site_folder(spark: SparkSession, folder: str, site: str) -> DataFrame:
    """Files below `folder` as served pages: index.html answers for its directory, `_redirects.json` maps paths to 301 targets."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = re.sub(r"^[a-z]+:/*", "/", folder).rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + re.escape(root), "")
    named = files.withColumn("rel", rel).withColumn("ext", F.lower(F.regexp_extract("rel", r"\.([A-Za-z0-9]+)$", 1)))
    types = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    kind = F.coalesce(types[F.col("ext")], F.lit("application/octet-stream"))
    text = F.when(F.startswith(kind, F.lit("text/html")), F.decode("content", "UTF-8"))
    plain = F.lit(None).cast("string")
    page = named.where("rel not rlike '/_[^/]*$'")
    own = page.select(F.lit(site).alias("site"), F.col("rel").alias("path"), F.lit(200).alias("status"), plain.alias("redirect_to"), kind.alias("content_type"), text.alias("html"), plain.alias("error"))
    index = own.where(F.col("path").rlike("/index\\.html$")).withColumn("path", F.regexp_replace("path", "index\\.html$", ""))
    targets = json.loads(small_file(spark, f"{folder.rstrip('/')}/_redirects.json") or "{}")
    redirects = spark.createDataFrame([(site, p, 301, t, None, None, None) for p, t in targets.items()], SERVED)
    return own.where(~F.col("path").rlike("/index\\.html$")).unionByName(index).unionByName(redirects)


def robots_rules(text: str, agent: str = "pagetwin") -> tuple[list[tuple[str, bool]], list[str], float | None]:
    """(rules [(path pattern, allowed)], sitemaps, crawl delay) of a robots.txt for an agent; its own group counts before the one for all."""
    groups: dict[str, list[tuple[str, bool]]] = {}
    delays: dict[str, float] = {}
    sitemaps, names, open_group = [], [], True
    for line in text.splitlines():
        field, _, value = line.partition("#")[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if field == "sitemap" and value:
            sitemaps.append(value)
        elif field == "user-agent":
            names = [*names, value.lower()] if open_group else [value.lower()]
            open_group = True
            groups.setdefault(value.lower(), [])
        elif field in ("allow", "disallow", "crawl-delay"):
            open_group = False
            for n in names:
                if field != "crawl-delay":
                    groups[n].append((value, field == "allow"))
                elif re.fullmatch(r"\d+(\.\d+)?", value):
                    delays[n] = min(30.0, float(value))
    own = next((n for n in groups if n != "*" and n and n in agent.lower()), "*")
    return [r for r in groups.get(own, []) if r[0]], sitemaps, delays.get(own)


def past_runs(spark: SparkSession, folder: str, most: int = 100) -> DataFrame:
    """Runs whose report.json lies in a folder of its own, latest first; unreadable files are left out."""
    site = "struct<label:string,url:string>"
    schema = f"generatedAt string, durationSec int, sites struct<A:{site},B:{site}>, summary map<string,string>, notes array<string>, _corrupt string"
    runs = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(f"{folder}/*/report.json").withColumn("file", F.col("_metadata.file_path"))
    return (
        runs.where("_corrupt is null and generatedAt is not null and sites is not null")
        .select(
            F.element_at(F.split("file", "/"), -2).alias("id"), "generatedAt", "durationSec", F.col("sites.A").alias("siteA"), F.col("sites.B").alias("siteB"), "summary",
            F.exists(F.coalesce("notes", F.array().cast("array<string>")), lambda n: F.contains(n, F.lit("stopped early"))).alias("stopped"),
        )
        .orderBy(F.col("generatedAt").desc(), "id")
        .limit(most)
    )
