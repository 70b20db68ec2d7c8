"""Bounded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled(rows: DataFrame, label: str, max_rows: int) -> list:
    """About `max_rows` rows at most, as many of every label as there are, chosen by a hash of doc_id and text.

    Labels are counted first; the hash then lets through each label's share, whatever its count, so no sort
    or limit gathers rows. Only a table with more than `max_rows` labels loses the rarest of them.
    """
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), label).limit(max_rows).collect()  # at most max_rows rows
    if not sizes:
        return []
    shares = rows.sparkSession.createDataFrame([(r[label], share(r["n"], max_rows, len(sizes))) for r in sizes], f"{label} {rows.schema[label].dataType.simpleString()}, share double")
    return rows.join(F.broadcast(shares), label).where(chance() < F.col("share")).drop("share").collect()


def share(count: int, max_rows: int, labels: int) -> float:
    """Part of a label's `count` rows that is taken."""
    return min(1.0, max(1, max_rows // labels) / count)


def chance() -> Column:
    """A number from 0 to 1 for a row, by 53 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) * F.lit(2.0**-53)


def stretch(text: Column, most: int) -> Column:
    """A text, or of a longer one `most` code points from a place that its hash names."""
    n = F.length(text)
    return F.when(n <= most, text).otherwise(F.substr(text, (F.pmod(F.xxhash64(text), n - most + 1) + 1).cast("int"), F.lit(most)))
