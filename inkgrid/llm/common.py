"""Shared pieces: the workspace for tables that cut lineage, and word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch, at most, while a table is written; and of one whose rows are a few numbers.
BATCH_ROWS, NARROW_ROWS = 1000, 10_000
_own_dir: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, one of our own:
    a temporary folder for a local master, else a folder in the warehouse."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        context = spark.sparkContext
        if context.applicationId not in _own_dir:
            local = context.master.startswith("local[") or context.master == "local"
            warehouse = spark.conf.get("spark.sql.warehouse.dir")
            _own_dir[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='inkgrid-')}" if local else f"{warehouse}/_inkgrid"
        where = _own_dir[context.applicationId]
    return where.rstrip("/")


@contextmanager
def settings(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """For one action: Arrow batches of few rows, as rows hold whole texts and sets, and
    shuffle files that go with the query that made them. The session's own settings come back."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    if not 0 < int(spark.conf.get(batch)) <= rows:
        wanted[batch] = str(rows)
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Workspace:
    """A folder of its own under the shared folder. Tables written here can be
    read again after an executor is lost. Spark deletes it at its end."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._fs(self.path)[0].deleteOnExit(self._fs(self.path)[1])

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def write(self, df: DataFrame, name: str, rows: int = BATCH_ROWS) -> DataFrame:
        """``df`` as a written table, read back: later plans start from its files."""
        where = f"{self.path}/{name}"
        with settings(self.spark, rows):
            df.write.mode("overwrite").parquet(where)
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that no later plan reads."""
        for name in names:
            fs, p = self._fs(f"{self.path}/{name}")
            fs.delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
