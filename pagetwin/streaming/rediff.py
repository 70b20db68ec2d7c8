"""Micro-batches of re-crawled pages against a static baseline."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from pagetwin.functions import urls
from pagetwin.functions.text import value
from pagetwin.operators import diffs as d
from pagetwin.operators.crawl import first_wins
from pagetwin.operators.snapshots import snapshot, with_raw

LOG_LINES, REPLAYED = 3000, 500


def baseline(pages: DataFrame, cfg: dict) -> DataFrame:
    """key, snap_a of the baseline's pages (url, html); the first page of a key counts."""
    keyed = pages.select("url", "html").withColumn("key", urls.to_key(F.col("url"), "/", cfg)).withColumnRenamed("url", "final_url")
    raw = with_raw(first_wins(keyed, ["key"], ["final_url"]), cfg)
    return raw.select("key", snapshot(F.col("raw"), urls.norm_host(F.col("final_url")), "/", cfg).alias("snap_a"))


def title_changes(stream: DataFrame, base: DataFrame, cfg: dict, event_time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Rows key, url, sig for arriving pages (url, html) whose key is in the baseline: a stream-static join.

    With `event_time`, copies of a page that arrive again within `late` are dropped by their state.
    """
    arrived = stream.withColumn("key", urls.to_key(F.col("url"), "/", cfg))
    if event_time:
        arrived = arrived.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["url", "html"])
    titles = base.select("key", F.col("snap_a.meta.title").alias("title_a"))
    raw = with_raw(arrived.join(titles, "key"), cfg, url="url")
    joined = raw.withColumn("title_b", value(F.col("raw.title"), cfg))
    return joined.select("key", "url", F.coalesce(d.value_sig(F.col("title_a"), F.col("title_b")), F.lit("same")).alias("sig"))


def page_diffs_of_batch(batch: DataFrame, base: DataFrame, cfg: dict) -> DataFrame:
    """All differences inside the page (metadata, headings, structure, text, images) of a batch against the baseline."""
    keyed = batch.select("url", "html").withColumn("key", urls.to_key(F.col("url"), "/", cfg)).withColumnRenamed("url", "final_url")
    raw = with_raw(first_wins(keyed, ["key"], ["final_url"]), cfg)
    b = raw.select("key", snapshot(F.col("raw"), urls.norm_host(F.col("final_url")), "/", cfg).alias("snap_b"))
    pairs = base.join(b, "key").withColumnRenamed("key", "path")
    none = batch.sparkSession.createDataFrame([], "key_a string, key_b string")
    parts = (d.metadata_diffs(pairs, none), d.heading_diffs(pairs, cfg), d.structure_diffs(pairs), d.text_diffs(pairs, cfg), d.image_diffs(pairs))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def watch(stream: DataFrame, base: DataFrame, cfg: dict, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write the differences of each micro-batch below `target`, by batch; a batch that is run again replaces its rows."""

    def write(batch: DataFrame, number: int) -> None:
        page_diffs_of_batch(batch, base, cfg).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


class RunLog:
    """Log of a run: the last lines, and phase and progress read from them; a listener gets each event."""

    def __init__(self, send: Callable[[str, dict], None] = lambda event, data: None):
        self.lines: deque[str] = deque(maxlen=LOG_LINES)
        self.progress: dict[str, dict] = {}
        self.phase, self.send = "Starting", send

    def __call__(self, line: str) -> None:
        self.lines.append(line)
        if m := re.match(r"\[(A|B)\] (\d+)/(\d+) ", line):
            self.progress[m[1]] = {"n": int(m[2]), "max": int(m[3])}
            self.phase = "Crawling both sites"
        elif "] probe " in line:
            self.phase = "Checking pages found on one site only"
        elif line.startswith("Visual compare"):
            self.phase = "Comparing screenshots"
        elif line.startswith("Render mode"):
            self.phase = "Crawling both sites"
        self.send("log", {"line": line, "progress": self.progress, "phase": self.phase})

    def state(self) -> dict:
        return {"phase": self.phase, "progress": self.progress, "lines": list(self.lines)[-REPLAYED:]}


class ProgressListener(StreamingQueryListener):
    """Hands the progress of streaming queries to a run log."""

    def __init__(self, log: RunLog):
        self.log = log

    def onQueryStarted(self, event):
        self.log(f"Stream {event.id} started")

    def onQueryProgress(self, event):
        self.log(f"Stream {event.progress.id}: batch {event.progress.batchId}, {event.progress.numInputRows} rows")

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.log(f"Stream {event.id} ended")
