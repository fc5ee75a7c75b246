"""A change log as a stream: micro-batches merged into a collection, last writer wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import changelog


def _versions(spark: SparkSession, root: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    done = [n for n in names if n.startswith("v") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]
    return sorted(int(n[1:]) for n in done)


def _base_of(numbers: list[int], every: int) -> list[int]:
    """The versions that make up the newest state: the last compacted one and the changes after it."""
    full = [n for n in numbers if n % every == 0]
    return numbers[numbers.index(full[-1]) :] if full else numbers


def _state(spark: SparkSession, root: str, numbers: list[int], key: str, position: str) -> DataFrame:
    """The last change of each key over the versions."""
    rows = spark.read.option("mergeSchema", True).parquet(*(f"{root}/v{n}" for n in numbers))
    return changelog.latest(rows, key, "_at")


def current(spark: SparkSession, root: str, every: int = 16) -> DataFrame | None:
    """The collection as of the newest committed version."""
    found = _versions(spark, root)
    if not found:
        return None
    rows = _state(spark, root, _base_of(found, every), spark.read.parquet(f"{root}/v{found[-1]}").schema[0].name, "_at")
    return rows.where("op = 'put'").drop("op")


def apply_changes(stream: DataFrame, root: str, checkpoint: str, key: str = "id_key", position: str = "pos", interval: str | None = None, every: int = 16) -> StreamingQuery:
    """Each micro-batch is reduced to the last change of a key and written as version v<batch>; reads merge the versions.

    Every so many batches the version is the whole collection, and older ones go, so a batch costs
    what it holds, and the collection is rewritten once in `every` batches. A batch that is run again writes the
    same version, so the merge is exactly-once.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [v for v in _versions(spark, root) if v < number]
        others = [c for c in batch.columns if c not in (key, position)]
        new = changelog.latest(batch, key, position).select(key, *others, F.struct(F.lit(number).cast("long").alias("batch"), F.col(position).cast("long").alias("pos")).alias("_at"))
        if number % every or not before:
            new.write.mode("overwrite").parquet(f"{root}/v{number}")
            return
        old = spark.read.option("mergeSchema", True).parquet(*(f"{root}/v{n}" for n in _base_of(before, every)))
        changelog.latest(old.unionByName(new), key, "_at").where("op = 'put'").select(*new.columns).write.mode("overwrite").parquet(f"{root}/v{number}")
        for gone in before[:-1]:
            where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/v{gone}")
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def running_counts(stream: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Rows and the sum of value in windows of event time, with a watermark for late rows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def windows_to_table(counts: DataFrame, table: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """The windows that each batch changed, in a folder a batch, so that a batch that is run again replaces its own."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{table}/b{number}")

    writer = counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def window_totals(spark: SparkSession, table: str, *keys: str) -> DataFrame:
    """The last state of every window in a table of windows_to_table."""
    rows = spark.read.parquet(f"{table}/b*")
    last = rows.groupBy("window", *keys).agg(F.max_by(F.struct("n", "total"), "batch").alias("_last"))
    return last.select("window", *keys, F.col("_last.n").alias("n"), F.col("_last.total").alias("total"))
