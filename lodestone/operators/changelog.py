"""Change logs: last writer wins by position in the log, and compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str, position: str) -> DataFrame:
    """The last change of each key. The aggregate combines in the map tasks, so a hot key moves one row a task."""
    others = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*others), F.col(position)).alias("_last")).select(key, *(F.col("_last")[c].alias(c) for c in others))


def replay(base: DataFrame, log: DataFrame, key: str = "id_key", position: str = "pos", op: str = "op") -> DataFrame:
    """base with the log's puts and deletes applied; both have the base's columns, the log also position and op."""
    last = latest(log, key, position)
    kept = base.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where(F.col(op) == "put").select(*base.columns))


def merged(base: DataFrame, log: DataFrame) -> DataFrame:
    """A snapshot's rows with a log's changes: id_type, id, id_big, seq, embedding, context. Replaced rows keep their place, new ones follow."""
    key = F.when(F.col("id_type") == 1, F.concat(F.lit("__bigint__:"), F.regexp_replace("id", "^bigint:", ""))).otherwise(F.col("id"))
    old = base.select(key.alias("id_key"), "id_type", "id", "id_big", "seq", "embedding", F.to_json("context").alias("context"))
    last = latest(log.select("id_key", "pos", "op", "id_type", "id", "embedding", "context"), "id_key", "pos")
    first = log.where("op = 'put'").groupBy("id_key").agg(F.min("pos").alias("first"))
    puts = last.where("op = 'put'").join(first, "id_key").join(old.select("id_key", F.col("seq").alias("was")), "id_key", "left")
    after = base.agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0]
    number = F.when(F.col("id_type") == 1, F.col("id").cast("decimal(38,0)"))
    new = puts.select("id_type", "id", number.alias("id_big"), F.coalesce("was", F.col("first") + after).alias("seq"), "embedding", "context")
    both = old.join(last.select("id_key"), "id_key", "left_anti").drop("id_key").unionByName(new)
    return both.withColumn("context", F.parse_json("context"))


def compact(base: DataFrame, log: DataFrame, out_path: str, key: str = "id_key") -> DataFrame:
    """Writes the collection with its log merged to a new place and returns it; the log may go once that is committed."""
    replay(base, log, key).write.mode("overwrite").parquet(out_path)
    return base.sparkSession.read.parquet(out_path)
