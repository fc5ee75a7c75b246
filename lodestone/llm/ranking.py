"""Ranks inside groups of any size, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small

#: Rows a bucket holds on average at most; a group of more rows is split into that many buckets by hash.
BUCKET_ROWS = 4096


def quantile_cells(counts: DataFrame, key: str, rows: str, cells: int, scratch: Scratch, name: str, parts: int = 64) -> DataFrame:
    """(key, _cell): the cell from 0 to cells - 1 of each key, in order of keys, nulls first, so that cells hold about equal rows.

    counts has a row a key; a key with many rows has a cell of its own. Keys are ranged over tasks, and only
    the ranges' sums meet in one.
    """
    ranged = counts.repartitionByRange(parts, F.asc_nulls_first(key)).select(key, rows, F.spark_partition_id().alias("_part"))
    ranged = scratch.keep(ranged, name)
    sums = ranged.groupBy("_part").agg(F.sum(rows).alias("_n"))
    upto = lambda *order: Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = sums.select(F.col("_part").alias("_p"), (F.sum("_n").over(upto("_part")) - F.col("_n")).alias("_start"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_all"))
    inside = Window.partitionBy("_part").orderBy(F.asc_nulls_first(key)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.col("_start") + F.sum(rows).over(inside) - F.col(rows)
    placed = ranged.join(F.broadcast(starts), F.col("_part") == F.col("_p"))  # a row a range
    return placed.withColumn("_before", before).select(key, F.expr(f"CAST((2 * _before + {rows}) * {cells} DIV (2 * _all) AS INT)").alias("_cell"))


def rank_in_group(df: DataFrame, group: str, order: Column, ties: list[Column], bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """df with _rank, from 0, of each row in its group by a hash (a long), then ties; and (_group, _rows), the group sizes.

    A group is cut into buckets by the top bits of the hash, bucket counts give
    each bucket's first rank, and only rows of a bucket are numbered together.
    Null is a group like any other.
    """
    keyed = df.withColumns({"_group": F.col(group), "_hash": order})
    sizes = keyed.groupBy("_group").agg(F.count("*").alias("_rows"))
    bits = F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("_rows") / F.lit(float(bucket_rows))))).cast("int")
    cut = sizes.select(F.col("_group").alias("_g"), bits.alias("_bits"))
    placed = keyed.join(broadcast_if_small(cut), F.col("_group").eqNullSafe(F.col("_g"))).drop("_g")
    placed = placed.withColumn("_bucket", F.when(F.col("_bits") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftrightunsigned(_hash, 64 - _bits)"))).drop("_bits")
    counts = placed.groupBy("_group", "_bucket").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = counts.select(F.col("_group").alias("_g"), F.col("_bucket").alias("_b"), (F.sum("_n").over(upto) - F.col("_n")).alias("_first"))
    joined = placed.join(broadcast_if_small(first), F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b")))
    inside = Window.partitionBy("_group", "_bucket").orderBy("_hash", *ties)
    ranked = joined.withColumn("_rank", F.col("_first") + F.row_number().over(inside) - 1)
    return ranked.drop("_g", "_b", "_first", "_bucket", "_hash"), sizes
