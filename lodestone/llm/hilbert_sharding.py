"""Sharding along a Hilbert curve over source, language and size, for file pruning on all three.

Each dimension is quantised to 4 bits by its quantiles, in its own order: sources and
languages by name, sizes by their class, the leading four binary digits. The curve index of the
cell orders the rows, a hash of the id orders rows of a cell, and the order is cut into
runs of equal counts. A shard thus covers few cells, so its files have narrow ranges
in every dimension. Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, read_table
from .ranking import quantile_cells, rank_in_group

BITS, SHARDS = 4, 16


def hilbert_index(df: DataFrame, dims: list[str], name: str, bits: int = BITS) -> DataFrame:
    """df with the Hilbert index of the cell that integer columns in [0, 2^bits) name.

    The axes are untwisted from the highest bit down, then Gray-coded and
    interleaved; every step is a projection of bit operations.
    """
    x = [f"_x{i}" for i in range(len(dims))]
    df = df.withColumns({a: F.col(d).cast("int") for a, d in zip(x, dims, strict=True)})
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = F.lit(q - 1)
        for a in x:
            head, here = F.col(x[0]), F.col(a)
            set_ = here.bitwiseAND(q) != 0
            swap = head.bitwiseXOR(here).bitwiseAND(low)
            flipped = F.when(set_, head.bitwiseXOR(low)).otherwise(head.bitwiseXOR(swap))
            df = df.withColumns({x[0]: flipped} if a == x[0] else {x[0]: flipped, a: F.when(set_, here).otherwise(here.bitwiseXOR(swap))})
    for before, a in zip(x, x[1:], strict=False):
        df = df.withColumn(a, F.col(a).bitwiseXOR(F.col(before)))
    turn = F.lit(0)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn = turn.bitwiseXOR(F.when(F.col(x[-1]).bitwiseAND(q) != 0, F.lit(q - 1)).otherwise(F.lit(0)))
    df = df.withColumn("_turn", turn)
    index = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for a in x:
            index = F.shiftleft(index, 1).bitwiseOR(F.shiftright(F.col(a).bitwiseXOR(F.col("_turn")), b).bitwiseAND(1).cast("long"))
    return df.withColumn(name, index).drop(*x, "_turn")


def file_positions(docs: DataFrame, name: str) -> DataFrame:
    """docs, read from files that one job wrote in order, with the place from 0 of each row in that order, in a column that replaces any of its name."""
    packed = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_packed")
    rows = docs.select(packed, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    files = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    upto = Window.orderBy("_name").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a file
    starts = files.select(F.col("_file").alias("_name"), "_n").select("_name", (F.sum("_n").over(upto) - F.col("_n")).alias("_start"))
    placed = rows.join(F.broadcast(starts), F.col("_file") == F.col("_name"))
    return placed.select(*(F.col("_packed").getField(c).alias(c) for c in docs.columns if c != name), (F.col("_start") + F.col("_at")).alias(name))


def size_class(size) -> F.Column:
    """The leading four binary digits of a size and their place: at most 8 classes a power of two, in order of size."""
    bits = F.length(F.bin(size)) - 1
    return F.when(size < 8, size.cast("int")).otherwise((bits * 8 + F.call_function("shiftright", size, bits - 3).bitwiseAND(7)).cast("int"))


def shard(docs: DataFrame, shards: int = SHARDS, order: str | None = None, windows: int = 1, carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and hilbert for every row of docs, and the row itself as `row` with carry.

    The law is `rows`: shard counts differ by one at most, and slot runs from 0
    without gaps in each shard. A null text has size 1 and the checksum 0 of no
    bytes; null sources and languages come before the others; repeated rows each get a slot.
    Other columns are ignored. An empty table gives no rows. With order, a column of
    places 0 to n - 1, that order is cut into windows of equal counts, a divisor of
    shards: each has the next shards, along the curve, so shards keep the order of windows.
    """
    scratch = Scratch(docs.sparkSession, "hilbert")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.col("source").cast("string").alias("_source"),
        F.col("lang").cast("string").alias("_lang"),
        (F.lit(0) if order is None else F.col(order)).cast("long").alias("_place"),
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != order)).alias("_row")] if carry else []),
    )
    rows = scratch.keep(rows.withColumn("_size", size_class(F.col("size"))), "rows")  # a few words a row; texts are read once
    for dim in ("_source", "_lang", "_size"):
        counts = rows.groupBy(F.col(dim).alias("_key")).agg(F.count("*").alias("_rows"))
        cells = quantile_cells(counts, "_key", "_rows", 1 << BITS, scratch, f"counts{dim}")
        rows = rows.join(broadcast_if_small(cells), F.col(dim).eqNullSafe(F.col("_key"))).withColumn(f"_at{dim}", F.col("_cell")).drop("_key", "_cell")
    rows = hilbert_index(rows, ["_at_source", "_at_lang", "_at_size"], "hilbert").drop("_source", "_lang", "_size", "_at_source", "_at_lang", "_at_size")
    rows = scratch.keep(rows, "cells")
    n = rows.count() if order is not None else 1
    rows = rows.withColumn("_run", F.shiftleft(F.expr(f"(_place * {windows}) DIV {max(n, 1)}"), 3 * BITS).bitwiseOR(F.col("hilbert")))
    ranked, cells = rank_in_group(rows, "_run", F.xxhash64("doc_id", "text_crc32"), [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    # at most 2^(3 * BITS) cells a window, whatever the input: one small window, one broadcast of fixed size
    upto = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = cells.select(F.col("_group").alias("_cell"), (F.sum("_rows").over(upto) - F.col("_rows")).alias("_start"), F.sum("_rows").over(Window.partitionBy(F.lit(0))).alias("_all"))
    placed = ranked.join(F.broadcast(starts), F.col("_group") == F.col("_cell")).withColumn("_at", F.col("_start") + F.col("_rank"))
    placed = placed.withColumn("shard", F.expr(f"CAST(_at * {shards} DIV _all AS INT)"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.expr(f"_at - (CAST(shard AS BIGINT) * _all + {shards - 1}) DIV {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "hilbert",
        *([F.col("_row").alias("row")] if carry else []),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes all rows of docs, whole, as one folder a shard, in curve order, ready for pruning by file statistics."""
    placed = shard(docs, shards, carry=True)
    out = placed.repartitionByRange(shards, "shard", "slot").sortWithinPartitions("shard", "slot")
    out.select("shard", *(F.col("row").getField(c).alias(c) for c in docs.columns)).write.partitionBy("shard").parquet(path)


def scanned(docs: DataFrame, placed: DataFrame, column: str) -> DataFrame:
    """value and shards: in how many shards a predicate on each value of a column finds it between least and greatest."""
    held = docs.join(placed.select(F.col("doc_id").alias("_id"), "shard"), F.col("doc_id").eqNullSafe(F.col("_id")))
    ranges = held.groupBy("shard").agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    values = docs.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return values.join(F.broadcast(ranges), F.col("value").between(F.col("_low"), F.col("_high"))).groupBy("value").agg(F.count("*").alias("shards"))  # a row a shard


def op8_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 along the curve."""
    return shard(read_table(spark, sf_dir, "documents"))
