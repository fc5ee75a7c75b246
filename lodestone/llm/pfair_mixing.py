"""Mixing sources to target weights by Pfair scheduling.

A source of weight w gives its block j (from 0) the release time floor(j / w) and
the deadline ceil((j + 1) / w). In each slot the released block of the earliest
deadline runs, so while every source has blocks, each source's blocks among
the first t differ from w t by less than one. Weights are whole numbers over their
sum: row counts for natural shares, else the targets to 36 bits. The slots of all
blocks come from ``deadlines``, which spreads the schedule over tasks; a
document's slot follows from its rank in its source by one join. Only DataFrame
operations are used.

Blocks have the same rows and every source its own weight, however large the input
and however many its sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, read_table
from .deadlines import earliest_first
from .ranking import rank_in_group

#: Documents of a block; blocks that one expression schedules; sum of the weights where they are no row counts; blocks listed at once.
BLOCK_ROWS, CHUNK, SCALE, SPAN = 32, 1000, 1 << 36, 10_000
#: Exponent on a source's share of the rows: 1 keeps natural shares, less lifts small sources.
TEMPERATURE = 0.7


def weights(sizes: DataFrame, temperature: float, block_rows: int, targets: dict[str | None, float] | None = None) -> DataFrame:
    """_source, _w, _all, _blocks, _index: each source's weight _w of _all and its number of blocks. One row a source.

    targets names sources' weights; they are taken relative to 1, of which the other sources share what is left by their rows to the
    power of temperature. Where nothing is left, the named weights are taken relative to their sum and the others have the least weight.
    """
    every = Window.partitionBy(F.lit(0))
    raw = F.pow(F.col("_rows").cast("double"), F.lit(temperature))
    if targets:
        if any(not 0 < w < float("inf") for w in targets.values()):
            raise ValueError("target weights are positive numbers")
        named = F.coalesce(*(F.when(F.col("_group").eqNullSafe(F.lit(name)), F.lit(float(w))) for name, w in targets.items()))
        left = F.greatest(F.lit(0.0), 1 - F.coalesce(F.sum(named).over(every), F.lit(0.0)))
        others = F.sum(F.when(named.isNull(), raw)).over(every)
        raw = F.coalesce(named, F.when(others > 0, left * raw / others), F.lit(0.0))
    whole = F.col("_rows") if temperature == 1 and not targets else F.greatest(F.lit(1), F.round(F.col("_raw") / F.sum("_raw").over(every) * SCALE).cast("long"))
    return sizes.withColumn("_raw", raw).withColumn("_w", whole).select(
        F.col("_group").alias("_source"), "_w", F.sum("_w").over(every).alias("_all"), F.expr(f"(_rows + {block_rows - 1}) DIV {block_rows}").alias("_blocks"),
        (F.row_number().over(every.orderBy(F.asc_nulls_first("_group"))) - 1).alias("_index"),
    )


def schedule(weights_: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, int]:
    """_i, _b, _slot, _r, _due: every block's slot, release and deadline, by earliest deadline among the released; and the first slot that a source can't fill."""
    at = lambda block, plus: F.expr(f"(CAST({block} AS DECIMAL(19, 0)) * CAST(_all AS DECIMAL(19, 0)) + {plus}) DIV _w")
    spans = weights_.withColumn("_span", F.explode(F.expr(f"sequence(0L, (_blocks - 1) DIV {SPAN})")))
    blocks = spans.withColumn("_b", F.explode(F.expr(f"sequence(_span * {SPAN}, least(_blocks, (_span + 1) * {SPAN}) - 1)")))
    slots = earliest_first(blocks.select(F.col("_index").cast("int").alias("_i"), "_b", at("_b", 0).alias("_r"), at("(_b + 1)", "_w - 1").alias("_due")), chunk)
    # the block after each source's last: the first slot which one of them would win ends the exact part; that is before the first of their deadlines
    after = weights_.select(at("_blocks", 0).alias("_slot"), at("(_blocks + 1)", "_w - 1").alias("_due"), F.col("_index").cast("int").alias("_i"))
    low, high = after.agg(F.min("_slot"), F.min("_due")).first()
    if low is None:
        return slots, 0
    key = F.struct("_due", "_i")
    near = slots.where((F.col("_slot") >= low) & (F.col("_slot") < high)).select("_slot", key.alias("_real"), F.lit(None).cast(after.select(key).schema[0].dataType).alias("_none"))
    events = near.unionByName(after.where(F.col("_slot") < high).select("_slot", F.lit(None).cast(near.schema["_real"].dataType).alias("_real"), key.alias("_none")))
    ahead = Window.orderBy("_slot", F.asc_nulls_first("_real")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = events.withColumn("_none", F.min("_none").over(ahead)).where(F.col("_real").isNotNull())
    seen = seen.withColumn("_free", F.coalesce(F.lag("_slot").over(Window.orderBy("_slot")) + 1, F.lit(low)))
    ends = F.when(F.col("_free") < F.col("_slot"), F.col("_free")).when(F.col("_real") > F.col("_none"), F.col("_slot"))
    end, last = seen.agg(F.min(ends), F.max("_slot")).first()
    return slots, end if end is not None else low if last is None else last + 1


def mix(docs: DataFrame, temperature: float = TEMPERATURE, block_rows: int = BLOCK_ROWS, chunk: int = CHUNK, targets: dict[str | None, float] | None = None, work: int | None = None, most_sources: int | None = None) -> DataFrame:
    """docs with _block, _slot, _release, _deadline, _position and _exact: the place of every row in the mixture.

    Rows of a source are shuffled by a hash of doc_id and cut into blocks of block_rows. _slot is the block's slot, _position
    orders all rows, _exact is true before the first slot that a source can't fill; up to there the deviation is under one block.
    Afterwards the sources left go on in their order, so no row is dropped. Null is a source like any other; repeated rows each have a place.
    chunk bounds what one expression schedules and changes no result. work and most_sources once bounded the fold; they are accepted and have no effect.
    """
    held = [c for c in docs.columns if c not in ("doc_id", "source")]
    plain = docs.select("doc_id", "source", *((F.struct(*(F.col(f"`{c}`") for c in held)).alias("_held"),) if held else ()))
    scratch = Scratch(docs.sparkSession, "mixture")
    sizes = scratch.keep(docs.groupBy(F.col("source").alias("_group")).agg(F.count("*").alias("_rows")), "sizes")
    of = scratch.keep(weights(sizes, temperature, block_rows, targets), "weights")
    plan, end = schedule(of, chunk)  # a few numbers a block
    ranked, _ = rank_in_group(plain, "source", F.xxhash64("doc_id", F.lit(5)), [F.col("doc_id")])
    placed = ranked.drop("_group").withColumn("_block", F.expr(f"_rank DIV {block_rows}")).join(
        broadcast_if_small(of.select(F.col("_source").alias("_s"), "_index")), F.col("source").eqNullSafe(F.col("_s"))
    )
    placed = placed.join(broadcast_if_small(plan), (F.col("_index") == F.col("_i")) & (F.col("_block") == F.col("_b")))
    return placed.select(
        *(F.col("doc_id") if c == "doc_id" else F.col("source") if c == "source" else F.col("_held").getField(c).alias(c) for c in docs.columns),
        "_block",
        "_slot",
        F.col("_r").alias("_release"),
        F.col("_due").alias("_deadline"),
        (F.col("_slot") * block_rows + F.expr(f"_rank % {block_rows}")).alias("_position"),
        (F.col("_slot") < end).alias("_exact"),
    )


def mixed_order(docs: DataFrame, temperature: float = 1.0, targets: dict[str | None, float] | None = None) -> DataFrame:
    """The rows of docs, all of them, laid out in mixture order over the partitions; columns as they were."""
    placed = mix(docs, temperature, targets=targets)
    return placed.repartitionByRange("_position").sortWithinPartitions("_position").select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, block, slot, release, deadline, position and exact of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    placed = mix(docs)
    return placed.select("doc_id", "source", *(F.col(f"_{c}").alias(c) for c in ("block", "slot", "release", "deadline", "position", "exact")))
