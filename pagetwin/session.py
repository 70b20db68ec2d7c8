"""What every operator needs from the session: shared storage and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: Arrow batches hold so many rows or bytes at most: texts may be long.
ARROW_ROWS, ARROW_BYTES = "512", "16m"
#: Bytes of a file for each core below which a scan is dealt out.
SMALL_SCAN = 4 << 20
_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers and keep Arrow batches short. Idempotent."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.abspath(__file__))
        out = os.path.join(tempfile.mkdtemp(prefix="pagetwin-"), "pagetwin.zip")
        with zipfile.ZipFile(out, "w") as z:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join("pagetwin", os.path.relpath(full, root)))
        sc.addPyFile(out)
        _SHIPPED.add(sc.applicationId)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark


def scan(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. One that is small for the cores is dealt over all of them, as its few files would leave most idle."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    cores = spark.sparkContext.defaultParallelism
    table = spark.read.parquet(path)
    return table.repartition(cores) if size < cores * SMALL_SCAN else table


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: `spark.checkpoint.dir`, or a local one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return os.path.join(tempfile.gettempdir(), "checkpoints")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive the loss of an executor."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/pagetwin-{label}-{uuid.uuid4().hex}"
        self._n = 0
        self._made: list[str] = []

    def table(self, df: DataFrame, *, codec: str = "zstd") -> DataFrame:
        """Write `df` as Parquet and return a scan of what was written."""
        self._n += 1
        path = f"{self.root}/t{self._n}"
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self._made.append(path)
        return out

    def keep(self, *tables: DataFrame) -> None:
        """Delete all tables made so far but these."""
        held = {t._scratch_path for t in tables}
        self._delete(p for p in self._made if p not in held)
        self._made = [p for p in self._made if p in held]

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        gone = {t._scratch_path for t in tables}
        self._delete(gone)
        self._made = [p for p in self._made if p not in gone]

    def _delete(self, paths: Iterable[str]) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
