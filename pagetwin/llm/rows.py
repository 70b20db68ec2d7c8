"""Row handling that the document operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetwin.session import scan


def documents(spark, sf_dir: str) -> DataFrame:
    return scan(spark, f"{sf_dir}/documents.parquet")


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), null texts as empty: clashing extra columns never reach an operator."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def wide_hash(c: Column, salt: int = 0) -> Column:
    """128 bits as 32 hex digits: two xxhash64 chains with different seeds."""
    return F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(2 * salt + k), c)), 16, "0") for k in (1, 2)))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sealed(docs: DataFrame) -> DataFrame:
    """`docs` as one column `d`, so that no column an operator adds can clash with one of theirs; see own and opened."""
    return docs.select(F.struct(*(F.col(_quoted(c)) for c in docs.columns)).alias("d"))


def own(column: str) -> Column:
    """A column of sealed documents."""
    return F.col(f"d.{_quoted(column)}")


def opened(rows: DataFrame, columns: list[str], **made: Column) -> DataFrame:
    """The columns of sealed documents again, those in `made` replaced."""
    return rows.select(*(made.get(c, own(c)).alias(c) for c in columns))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A mapInArrow function that hands free memory back when its task ends: workers are used again by later stages."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return tidied
