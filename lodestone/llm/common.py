"""Shared helpers: shared-folder tables, checked broadcasts, the documents' shape."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow side (ids and a few numbers, under 64 bytes a row) is broadcast.
BROADCAST_ROWS = 500_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by a path that only Spark opens."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master, where it is unset, a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


class Scratch:
    """Tables of one run, in the shared folder: written once and reread, so a lost executor costs only its own tasks."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def keep(self, df: DataFrame, table: str) -> DataFrame:
        """Writes a table and returns it as read back; its lineage ends there."""
        df.write.mode("overwrite").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, table: str) -> None:
        """Removes a table that nothing will read again."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def broadcast_if_small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a narrow side for broadcast when its counted rows stay under the limit; a larger one is shuffled."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df.hint("shuffle_merge")


def bounded_batches(spark: SparkSession, size: int = 4 << 20, rows: int = 2000) -> None:
    """Bounds what a Python worker holds at once: Arrow batches by bytes and rows, where the session asks for more."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", size), ("spark.sql.execution.arrow.maxRecordsPerBatch", rows)):
        now = spark.conf.get(key, None)
        now = int(now) if now and now.lstrip("-").isdigit() else 0
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def crc_mod(doc_id: str, modulus: int):
    """crc32 of the id's decimal text, modulo a number."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus
