"""Outcomes of map operations, guarded remaps, range deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.running import running_sum
from ..plans.work import staged
from ..sources.schema import RANGE_DELETE_ROWS
from .refcount import ORDER, current, deltas, freed
from .state import KEY, VALUE, with_previous


def outcomes(log: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """One row per map operation: its previous value, and the address it freed if a count went to zero by it. With snapshots (as in deltas) a value that one pins is not freed."""
    gone = freed(log, snapshots).withColumnRenamed("pba", "freed_pba")
    out = with_previous(log).join(gone, ORDER, "left")
    return out.select(*ORDER, "op", "vol_ord", "lba", *(f"prev_{v}" for v in VALUE), "freed_pba")


def coalesced(log: DataFrame, by: str | Column = "lsn") -> DataFrame:
    """Changes of one record and sign, summed per address; how many operations they stand for."""
    d = deltas(log)
    return d.groupBy(by, "pba", (F.col("delta") > 0).alias("adds")).agg(F.sum("delta").alias("delta"), F.count(F.lit(1)).alias("ops"))


def range_delete_plan(view: DataFrame, start: int, end: int) -> DataFrame:
    """lba, value, chunk and op_seq of each mapped block of view (a volume's map, a clone's with what it inherits) in [start, end): a range delete captures these, in records (chunk) of at most RANGE_DELETE_ROWS blocks. Blocks are numbered after sums over spans of blocks, not in one task."""
    rows = view.where((F.col("lba") >= start) & (F.col("lba") < end)).select("lba", *VALUE)
    rows = rows.withColumn("span", F.expr(f"lba div {RANGE_DELETE_ROWS}"))
    spans = rows.groupBy("span").agg(F.count(F.lit(1)).alias("n"))
    spans = running_sum(spans, None, ["span"], "n", "upto", bucket_by="span").select("span", (F.col("upto") - F.col("n")).alias("before"))
    number = F.row_number().over(Window.partitionBy("span").orderBy("lba")) - 1 + F.col("before")
    rows = rows.join(spans, "span").withColumn("n", number)
    return rows.select("lba", *VALUE, F.expr(f"n div {RANGE_DELETE_ROWS}").alias("chunk"), F.expr(f"cast(n % {RANGE_DELETE_ROWS} as int)").alias("op_seq"))


def range_delete_freed(log: DataFrame, pinned: DataFrame, plan: DataFrame, vol: int) -> DataFrame:
    """pba, decrefs, rc_after of the addresses that a range delete releases: one each block, unless a snapshot pins its value (pinned: vol_ord, lba, value)."""
    t = plan.withColumn("vol_ord", F.lit(vol))
    t = t.join(pinned, ["vol_ord", "lba", *VALUE], "left_anti")
    gone = t.groupBy("pba").agg(F.count(F.lit(1)).alias("decrefs"))
    before = current(log)
    return gone.join(before, "pba").select("pba", "decrefs", (F.col("rc") - F.col("decrefs")).alias("rc_after"))


def guarded(log: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """log with applied: whether each operation took effect. A guarded remap does iff guard_pba has at least guard_min_rc references just before it, given which earlier operations did.

    All are taken first; each round counts references under what the round before decided and
    decides again. The earliest guard that is not yet right is right from then on, so rounds end, with the sequential answer: after the
    length of the longest chain of guards of which each decides the next, however long. Every round is written out, so its plan does not grow.
    Only the first round counts over the whole log. A decision changes counts by its own block's operations alone, so the others make the changes of
    blocks whose decisions moved again, and count only for guards that all shifts of their address so far could turn.
    """
    spark = log.sparkSession
    log = staged(spark, log, "log")
    guards = log.where("guard_pba is not null").select(*ORDER, *KEY, F.col("guard_pba").alias("pba"), F.col("guard_min_rc").cast("long").alias("guard_min_rc"))
    changes = staged(spark, deltas(log, snapshots).join(guards.select("pba").distinct(), "pba", "left_semi").select(*ORDER, "pba", "delta"), "changes")
    seen = staged(spark, _just_before(guards, changes, "rc"), "probes")
    before, rejected = None, staged(spark, seen.where("rc < guard_min_rc").select(*ORDER, *KEY), "rejected")
    shifts = None
    while True:
        moved = rejected if before is None else before.unionByName(rejected).groupBy(*ORDER, *KEY).agg(F.count(F.lit(1)).alias("n")).where("n = 1")
        blocks = staged(spark, moved.select(*(F.col(k).alias(f"_{k}") for k in KEY)).distinct(), "blocks")
        if blocks.isEmpty():
            return log.join(rejected.select(*ORDER, F.lit(False).alias("_no")), ORDER, "left").withColumn("applied", F.coalesce("_no", F.lit(True))).drop("_no")
        shifts = staged(spark, _shifts(log, snapshots, blocks, before, rejected, shifts), "shifts")
        before, rejected = rejected, staged(spark, _rejected(seen, shifts), "rejected")


def _just_before(guards: DataFrame, changes: DataFrame, name: str) -> DataFrame:
    """guards with the sum of the changes of their address before them."""
    probes = guards.withColumns({"delta": F.lit(0).cast("long"), "turn": F.lit(0)})
    rows = probes.unionByName(changes.withColumn("turn", F.lit(1)), allowMissingColumns=True)
    return running_sum(rows, "pba", [*ORDER, "turn"], "delta", name).where("turn = 0").drop("delta", "turn")


def _shifts(log: DataFrame, snapshots: DataFrame | None, blocks: DataFrame, before: DataFrame | None, rejected: DataFrame, shifts: DataFrame | None) -> DataFrame:
    """lsn, op_seq, pba, delta: shifts (changes under the decisions before, less those with all taken) carried on to the decisions now, which differ in these blocks only."""
    part = log.join(blocks, F.col("vol_ord").eqNullSafe(F.col("_vol_ord")) & F.col("lba").eqNullSafe(F.col("_lba")), "left_semi")
    part = staged(log.sparkSession, part, "part")
    now = deltas(part.join(rejected.select(*ORDER), ORDER, "left_anti"), snapshots)
    was = deltas(part if before is None else part.join(before.select(*ORDER), ORDER, "left_anti"), snapshots)
    out = now.unionByName(was.withColumn("delta", -F.col("delta")))
    out = out if shifts is None else out.unionByName(shifts)
    return out.groupBy(*ORDER, "pba").agg(F.sum("delta").alias("delta")).where("delta <> 0")


def _rejected(seen: DataFrame, shifts: DataFrame) -> DataFrame:
    """Guards (seen: with rc, the count just before each with all taken) that fail under shifts. Where the least and the greatest shift of the address decide alike, the guard needs no count of its own."""
    spans = running_sum(shifts, "pba", ORDER, "delta", "upto").groupBy("pba").agg(F.least(F.min("upto"), F.lit(0)).alias("least"), F.greatest(F.max("upto"), F.lit(0)).alias("greatest"))
    spans = staged(seen.sparkSession, spans, "spans")
    rows = seen.join(spans, "pba", "left").na.fill(0, ["least", "greatest"]).where("rc + least < guard_min_rc")
    rows = staged(seen.sparkSession, rows.withColumn("sure", F.expr("rc + greatest < guard_min_rc")).drop("least", "greatest"), "open")
    counted = _just_before(rows.where("not sure"), shifts, "shift").where("rc + shift < guard_min_rc")
    return rows.where("sure").unionByName(counted, allowMissingColumns=True).select(*ORDER, *KEY)
