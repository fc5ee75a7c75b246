"""Earliest deadline first over any number of unit jobs, without a step a job in one task.

A slot runs the released job of the earliest deadline, ties to the lowest index. Jobs in order of
release are cut into runs; a run owns the slots from its first release to that of the next, none where these are equal.
Each run is scheduled by itself, and a binary tree over the runs brings in what earlier runs leave:

* Of the jobs that wait at a run's start and those that the run executes by itself, as many as it has slots are executed, the
  first by deadline; one that it does not execute by itself waits at its end in any case. The same holds for neighbouring runs taken as one.
* All deadlines are met, so only jobs due after the end of the slots can be pushed out: one a source. Only these are ranked.
* How many wait at a run's start follows from the runs' counts by running sums and maxima.

Upwards each job learns in which nodes it is executed when nothing waits at their start; downwards, in which half of a
node it is executed with all that waits. Inside its run a job's slot follows from ranks. The jobs must have a schedule that meets all deadlines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small

#: Ranges over which jobs are ordered; a time after all slots.
PARTS, FAR = 64, 1 << 60

_UPTO = (Window.unboundedPreceding, Window.currentRow)
_BEFORE = (Window.unboundedPreceding, -1)


def _in_order(jobs: DataFrame, chunk: int, scratch: Scratch) -> DataFrame:
    """jobs with _run, their rank by release, deadline and index DIV chunk; ranges of jobs are numbered apart and shifted by the ranges' sums."""
    order = ("_r", "_due", "_i")
    ranged = scratch.keep(jobs.repartitionByRange(PARTS, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    firsts = sums.select(F.col("_part").alias("_p"), (F.sum("_n").over(Window.orderBy("_part").rowsBetween(*_UPTO)) - F.col("_n")).alias("_first"))
    ranks = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    return ranks.join(F.broadcast(firsts), F.col("_part") == F.col("_p")).select("_i", "_b", "_r", "_due", F.expr(f"(_first + _at) DIV {chunk}").alias("_run"))  # a row a range


def _alone(ordered: DataFrame, ends: DataFrame, chunk: int) -> DataFrame:
    """The jobs with _ok: whether their run executes them when nothing waits at its start."""
    inside = Window.partitionBy("_run").orderBy("_r", "_due", "_i")
    gaps = ordered.join(broadcast_if_small(ends.select(F.col("_run").alias("_g"), "_end")), F.col("_run") == F.col("_g")).withColumn("_gap", F.coalesce(F.lead("_r").over(inside), "_end") - F.col("_r"))
    runs = gaps.groupBy("_run").agg(F.sort_array(F.collect_list(F.struct("_r", "_due", "_i", "_b", "_gap"))).alias("x"))
    # state: the jobs waiting; after each release the first of them run until the next
    waiting = f"""aggregate(x, cast(array() as array<struct<_due: bigint, _i: int, _b: bigint>>), (s, e) -> slice(
      sort_array(array_append(s, named_struct('_due', e._due, '_i', e._i, '_b', e._b))), cast(least(e._gap, {chunk + 1}L) as int) + 1, {chunk + 1}))"""
    flags = "transform(x, e -> named_struct('_i', e._i, '_b', e._b, '_r', e._r, '_due', e._due, '_ok', not array_contains(w, named_struct('_due', e._due, '_i', e._i, '_b', e._b))))"
    return runs.withColumn("w", F.expr(waiting)).select("_run", F.inline(F.expr(flags)))


def _nodes(runs: DataFrame, level: int) -> DataFrame:
    """_node, _start, _end, _waits and _does of each 2^level runs: the jobs that wait at the end and those executed, when none waits at the start."""
    node = F.shiftright("_run", level)
    over = F.col("_jobs") - (F.col("_end") - F.col("_start"))
    summed = runs.withColumns({"_node": node, "_over": over}).withColumn("_sum", F.sum("_over").over(Window.partitionBy("_node").orderBy("_run").rowsBetween(*_UPTO)))
    found = summed.groupBy("_node").agg(F.min("_start").alias("_start"), F.max("_end").alias("_end"), F.sum("_jobs").alias("_jobs"), (F.sum("_over") + F.greatest(F.lit(0), F.max(F.col("_waits") - F.col("_sum")))).alias("_w"))
    return found.select("_node", "_start", "_end", F.col("_w").alias("_waits"), (F.col("_jobs") - F.col("_w")).alias("_does"))


def _halves(runs: DataFrame, level: int) -> DataFrame:
    """A row a node of the level: what _nodes says of its left and right half, _left_... and _right_..., null where there is none."""
    halves, odd = _nodes(runs, level - 1), F.col("_node") % 2 == 1
    names = ("_start", "_end", "_waits", "_does")
    return halves.groupBy(F.shiftright("_node", 1).alias("_parent")).agg(*(F.max(F.when(odd if side == "_right" else ~odd, F.col(c))).alias(side + c) for side in ("_left", "_right") for c in names))


def _up(jobs: DataFrame, runs: DataFrame, level: int, n_nodes: int) -> DataFrame:
    """jobs whose _ok tells of nodes of the level instead of their halves; _mask keeps the flags of all levels by bit."""
    pushed = F.greatest(F.lit(0), F.col("_left_waits") + F.col("_right_does") - (F.col("_right_end") - F.col("_right_start")))
    nodes = _halves(runs, level).select("_parent", "_right_end", pushed.alias("_pushed"))
    placed = jobs.withColumn("_node", F.shiftright("_run", level)).join(broadcast_if_small(nodes, n_nodes), F.col("_node") == F.col("_parent"))
    right = F.shiftright("_run", level - 1) % 2 == 1
    ranked = F.coalesce((right == F.col("_ok")) & (F.col("_due") > F.col("_right_end")), F.lit(False))
    last = F.row_number().over(Window.partitionBy("_node").orderBy(F.desc("_due"), F.desc("_i")))
    some = placed.where(ranked).withColumn("_now", last > F.col("_pushed"))
    others = placed.where(~ranked).withColumn("_now", F.col("_ok") | (~right & F.col("_right_end").isNotNull()))
    both = some.unionByName(others)
    return both.select("_i", "_b", "_r", "_due", "_run", F.col("_now").alias("_ok"), F.col("_mask").bitwiseOR(F.shiftleft(F.col("_now").cast("long"), level)).alias("_mask"))


def _down(jobs: DataFrame, runs: DataFrame, level: int, n_nodes: int) -> DataFrame:
    """jobs whose _node is the half that executes them, of the node of the level."""
    first = runs.select(F.col("_run").alias("_f"), "_before").where(F.col("_f") % (1 << level) == 0).withColumn("_f", F.shiftright("_f", level))
    nodes = _halves(runs, level).join(broadcast_if_small(first, n_nodes), F.col("_parent") == F.col("_f")).select(
        "_parent", "_left_end", "_right_end", F.least(F.col("_left_end") - F.col("_left_start"), F.col("_before") + F.col("_left_does")).alias("_left_runs")
    )
    placed = jobs.join(broadcast_if_small(nodes, n_nodes), F.col("_node") == F.col("_parent"))
    half, left = F.shiftright("_run", level - 1), F.col("_node") * 2
    alone = F.shiftright("_mask", level - 1).bitwiseAND(F.lit(1)) == 1
    to_right = F.col("_right_end").isNotNull() & ((half > left) | ((half == left) & ~alone))
    to_left = F.col("_right_end").isNull() | (F.col("_due") <= F.col("_left_end"))
    sided = placed.withColumn("_side", F.when(to_right, F.lit(1)).when(to_left, F.lit(0)))
    sure = sided.where(F.col("_side") == 0).groupBy(F.col("_node").alias("_s")).agg(F.count("*").alias("_sure"))
    rank = F.row_number().over(Window.partitionBy("_node").orderBy("_due", "_i"))
    some = sided.where(F.col("_side").isNull()).withColumn("_rank", rank).join(broadcast_if_small(sure, n_nodes), F.col("_node") == F.col("_s"), "left")
    some = some.withColumn("_side", (F.col("_rank") > F.col("_left_runs") - F.coalesce("_sure", F.lit(0))).cast("int"))
    both = some.select(*sided.columns).unionByName(sided.where(F.col("_side").isNotNull()))
    return both.select("_i", "_b", "_r", "_due", "_run", "_mask", (left + F.col("_side")).alias("_node"))


def _slots(jobs: DataFrame, starts: DataFrame, chunk: int, scratch: Scratch) -> DataFrame:
    """The slots of jobs whose _node is the run that executes them."""
    placed = jobs.join(broadcast_if_small(starts.select(F.col("_run").alias("_s"), "_start")), F.col("_node") == F.col("_s"))
    waited = F.col("_run") < F.col("_node")
    rank = F.sum(waited.cast("long")).over(Window.partitionBy("_node").orderBy("_due", "_i").rowsBetween(*_UPTO)) - waited.cast("long")
    placed = scratch.keep(placed.select("_i", "_b", "_r", "_due", "_node", "_start", waited.alias("_waited"), rank.alias("_ahead")), "placed")  # _ahead: jobs from earlier runs, due before
    own = placed.where(~F.col("_waited")).withColumn("_gap", F.coalesce(F.lead("_r").over(Window.partitionBy("_node").orderBy("_r", "_due", "_i")), F.lit(FAR)) - F.col("_r"))
    own = own.groupBy("_node", "_start").agg(F.sort_array(F.collect_list(F.struct("_r", "_due", "_i", "_b", "_ahead", "_gap"))).alias("x"))
    # state: slots so far that the run's own jobs left to those from earlier runs, own jobs waiting, own jobs done
    done = "array<struct<_due: bigint, _i: int, _b: bigint, _r: bigint, _slot: bigint>>"
    ran = """filter(transform(p, (o, k) -> named_struct('_due', o._due, '_i', o._i, '_b', o._b, '_r', o._r, '_slot', e._r + k + greatest(o._ahead - v.y, 0L))), o -> o._slot < e._r + e._gap)"""
    fold = f"""aggregate(x, named_struct('y', x[0]._r - _start, 'p', cast(array() as array<struct<_due: bigint, _i: int, _b: bigint, _r: bigint, _ahead: bigint>>), 'out', cast(array() as {done})),
      (s, e) -> aggregate(array(sort_array(array_append(s.p, named_struct('_due', e._due, '_i', e._i, '_b', e._b, '_r', e._r, '_ahead', e._ahead)))), s,
        (v, p) -> aggregate(array({ran}), v, (q, d) -> named_struct('y', q.y + e._gap - size(d), 'p', slice(p, size(d) + 1, {chunk + 1}), 'out', concat(q.out, d)))), s -> s.out)"""
    own = own.select("_node", "_start", F.inline(F.expr(fold)))
    free = F.col("_slot") - F.col("_start") - F.row_number().over(Window.partitionBy("_node").orderBy("_slot")) + 1  # free slots of the run before this one
    own = own.select("_node", "_start", "_due", "_i", "_b", "_r", "_slot", free.alias("_free"), F.lit(0).alias("_kind"))
    rest = placed.where(F.col("_waited")).select("_node", "_start", "_due", "_i", "_b", "_r", F.lit(None).cast("long").alias("_slot"), F.col("_ahead").alias("_free"), F.lit(1).alias("_kind"))
    taken = F.sum(1 - F.col("_kind")).over(Window.partitionBy("_node").orderBy("_free", "_kind").rowsBetween(*_UPTO))
    return own.unionByName(rest).withColumn("_taken", taken).select("_i", "_b", "_r", "_due", F.coalesce("_slot", F.col("_start") + F.col("_free") + F.col("_taken")).alias("_slot"))


def earliest_first(jobs: DataFrame, chunk: int) -> DataFrame:
    """jobs (_i int, index of the source; _b, number in the source; _r, release; _due, deadline) with _slot; chunk jobs make a run."""
    scratch = Scratch(jobs.sparkSession, "deadlines")
    ordered = scratch.keep(_in_order(jobs, chunk, scratch), "ordered")
    ends = ordered.groupBy("_run").agg(F.min("_r").alias("_start"), F.count("*").alias("_jobs"))
    ends = scratch.keep(ends.withColumn("_end", F.coalesce(F.lead("_start").over(Window.orderBy("_run")), F.lit(FAR))), "ends")
    state = scratch.keep(_alone(ordered, ends, chunk).withColumn("_mask", F.col("_ok").cast("long")), "up0")
    waits = state.where(~F.col("_ok")).groupBy(F.col("_run").alias("_g")).agg(F.count("*").alias("_waits"))
    runs = ends.join(broadcast_if_small(waits), F.col("_run") == F.col("_g"), "left").withColumn("_waits", F.coalesce("_waits", F.lit(0)))
    # jobs waiting at each run's start: those of the run before, and what exceeds the slots since some run
    runs = runs.withColumn("_sum", F.sum(F.col("_jobs") - (F.col("_end") - F.col("_start"))).over(Window.orderBy("_run").rowsBetween(*_UPTO)))
    before = F.lag("_sum").over(Window.orderBy("_run")) + F.greatest(F.lit(0), F.max(F.col("_waits") - F.col("_sum")).over(Window.orderBy("_run").rowsBetween(*_BEFORE)))
    runs = scratch.keep(runs.select("_run", "_start", "_end", "_jobs", "_waits", F.coalesce(before, F.lit(0)).alias("_before")), "runs")
    n_runs = runs.count()
    levels = max(0, n_runs - 1).bit_length()
    for level in range(1, levels):
        state = scratch.keep(_up(state, runs, level, -(-n_runs >> level)), f"up{level}")
        scratch.drop(f"up{level - 1}")
    state = state.withColumn("_node", F.lit(0).cast("long"))
    for level in range(levels, 0, -1):
        state = scratch.keep(_down(state, runs, level, -(-n_runs >> level)), f"down{level}")
        scratch.drop(f"down{level + 1}")
    return scratch.keep(_slots(state, runs, chunk, scratch), "slots")
