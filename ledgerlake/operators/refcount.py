"""Reference counts of physical blocks: signed changes of each operation, their sums, births and releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.running import running_sum
from .state import KEY, VALUE, l2p_at, l2p_at_snapshots, with_previous

ORDER = ["lsn", "op_seq"]


def _moves(log: DataFrame) -> DataFrame:
    """lsn, op_seq, vol_ord, lba, pba, salt, delta: -1 where an operation takes a value from a block, 1 where it puts one."""
    p = with_previous(log)
    changed = (F.col("op") == "L2pDelete") | ~(F.col("pba").eqNullSafe(F.col("prev_pba")) & F.col("salt").eqNullSafe(F.col("prev_salt")))
    taken = F.struct(F.col("prev_pba").alias("pba"), F.col("prev_salt").alias("salt"), F.lit(-1).cast("long").alias("delta"))
    given = F.struct("pba", "salt", F.lit(1).cast("long").alias("delta"))
    return p.where(changed).select(*ORDER, *KEY, F.explode(F.array(taken, given)).alias("d")).select(*ORDER, *KEY, "d.*").where("pba is not null")


def _pins(log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """s_id, s_vol, s_lba, s_pba, s_salt of all snapshots, with the lsns after which each pins and at which it was dropped."""
    life = snapshots.select(F.col("id").alias("snap_id"), F.col("created_lsn").alias("since"), _dropped(snapshots).alias("until"))
    return l2p_at_snapshots(log, snapshots).join(F.broadcast(life), "snap_id").select(F.col("snap_id").alias("s_id"), F.col("vol_ord").alias("s_vol"), F.col("lba").alias("s_lba"), F.col("pba").alias("s_pba"), F.col("salt").alias("s_salt"), "since", "until")


def _dropped(snapshots: DataFrame) -> Column:
    return F.col("dropped_lsn") if "dropped_lsn" in snapshots.columns else F.lit(None).cast("long")


def live_snapshots(snapshots: DataFrame) -> DataFrame:
    return snapshots.where(_dropped(snapshots).isNull())


def _same_tuple() -> Column:
    return (F.col("vol_ord") == F.col("s_vol")) & (F.col("lba") == F.col("s_lba")) & (F.col("pba") == F.col("s_pba")) & F.col("salt").eqNullSafe(F.col("s_salt"))


def _drop_moves(log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Moves of snapshot drops, each in a record of its own: a tuple that neither the live state nor another snapshot holds then goes."""
    gone = snapshots.where(_dropped(snapshots).isNotNull())
    pins = _pins(log, snapshots)
    mine = l2p_at_snapshots(log, gone).join(F.broadcast(gone.select(F.col("id").alias("snap_id"), F.col("dropped_lsn").alias("lsn"))), "snap_id")
    others = (F.col("snap_id") != F.col("s_id")) & (F.col("since") < F.col("lsn")) & (F.col("until").isNull() | (F.col("until") > F.col("lsn")))
    mine = mine.join(pins, _same_tuple() & others, "left_anti")
    live = l2p_at_snapshots(log, gone.select("id", "vol_ord", F.col("dropped_lsn").alias("created_lsn")))
    mine = mine.join(live.select(F.col("snap_id").alias("s_id"), F.col("vol_ord").alias("s_vol"), F.col("lba").alias("s_lba"), F.col("pba").alias("s_pba"), F.col("salt").alias("s_salt")), _same_tuple() & (F.col("snap_id") == F.col("s_id")), "left_anti")
    return mine.select("lsn", F.lit(0).alias("op_seq"), *KEY, *VALUE, F.lit(-1).cast("long").alias("delta"))


def deltas(log: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """lsn, op_seq, pba, delta: net change of each operation, zeros left out. A remap to other bytes releases the old address and takes the new one; a delete releases; Incref and Decref count as they are. Netted within an operation, never across a record, so that a count's passing through zero is not lost.

    With snapshots (their history: id, vol_ord, created_lsn and, if any was dropped, dropped_lsn) a value that a snapshot of the volume pins at that
    block is neither released nor taken anew, until the drop of the last one that pins it releases what nothing else holds. The sums are then the closed form at every lsn.
    """
    moved = _moves(log)
    if snapshots is not None:
        pinned = _same_tuple() & (F.col("since") < F.col("lsn")) & (F.col("until").isNull() | (F.col("until") >= F.col("lsn")))
        moved = moved.join(_pins(log, snapshots), pinned, "left_anti")
        if "dropped_lsn" in snapshots.columns:
            moved = moved.unionByName(_drop_moves(log, snapshots))
    moved = moved.select(*ORDER, "pba", "delta")
    if "delta" in log.columns:
        sign = F.when(F.col("op") == "Incref", 1).otherwise(-1)
        moved = moved.unionByName(log.where(F.col("op").isin("Incref", "Decref")).select(*ORDER, "pba", (sign * F.col("delta")).alias("delta")))
    return moved.groupBy(*ORDER, "pba").agg(F.sum("delta").alias("delta")).where("delta <> 0")


def current(log: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """pba, rc of addresses with references: one sum, combined before the shuffle."""
    return deltas(log, snapshots).groupBy("pba").agg(F.sum("delta").alias("rc")).where("rc > 0")


def running(log: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """Each change with rc after it."""
    return running_sum(deltas(log, snapshots), "pba", ORDER, "delta", "rc")


def births(log: DataFrame) -> DataFrame:
    """pba, rc, birth_lsn of addresses with references: birth_lsn is when the count last left zero."""
    r = running(log)
    born = r.where((F.col("rc") > 0) & (F.col("rc") == F.col("delta"))).groupBy("pba").agg(F.max("lsn").alias("birth_lsn"))
    return current(log).join(born, "pba").select("pba", "rc", "birth_lsn")


def freed(log: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """lsn, op_seq, pba of every change that takes a count to zero."""
    return running(log, snapshots).where("rc = 0 and delta < 0").select(*ORDER, "pba")


def underflows(log: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """Changes that would take a count below zero: a log that holds any must not be appended."""
    return running(log, snapshots).where("rc < 0")


def pinned_tuples(log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Distinct (vol_ord, lba, value) of the live state and all snapshots that are not dropped. With clones, log is that of with_inherited."""
    tuples, snapshots = [*KEY, *VALUE], live_snapshots(snapshots)
    return l2p_at(log).select(*tuples).unionByName(l2p_at_snapshots(log, snapshots).select(*tuples)).distinct()


def closed_form(log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """pba, rc with snapshots: how many distinct tuples of live state and snapshots hold it."""
    return pinned_tuples(log, snapshots).groupBy("pba").agg(F.count(F.lit(1)).alias("rc"))


def audit(log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """pba, live_rc (sum of changes), audit_rc (closed form), pinned_only: full outer, so that either side's surplus shows."""
    live, closed = current(log).withColumnRenamed("rc", "live_rc"), closed_form(log, snapshots).withColumnRenamed("rc", "audit_rc")
    out = closed.join(live, "pba", "full_outer").na.fill(0, ["live_rc", "audit_rc"])
    return out.select("pba", "live_rc", "audit_rc", (F.col("audit_rc") - F.col("live_rc")).alias("pinned_only"))


def audit_stored(log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """pba, stored_rc (sum of changes under the snapshots' pins), audit_rc (closed form): the two agree at any lsn, with snapshots, clones and drops."""
    stored, closed = current(log, snapshots).withColumnRenamed("rc", "stored_rc"), closed_form(log, snapshots).withColumnRenamed("rc", "audit_rc")
    return closed.join(stored, "pba", "full_outer").na.fill(0, ["stored_rc", "audit_rc"]).select("pba", "stored_rc", "audit_rc")


def witnesses(log: DataFrame, snapshots: DataFrame, stored: DataFrame, at_most: int = 8) -> DataFrame:
    """Addresses whose stored rc differs from the closed form, the first at_most by pba, with up to at_most tuples each: a report, limited as such."""
    want = closed_form(log, snapshots).withColumnRenamed("rc", "audit_rc")
    off = want.join(stored.select("pba", F.col("rc").alias("stored_rc")), "pba", "full_outer").na.fill(0, ["audit_rc", "stored_rc"]).where("audit_rc <> stored_rc").orderBy("pba").limit(at_most)
    t = pinned_tuples(log, snapshots).join(F.broadcast(off.select("pba")), "pba", "left_semi")
    t = t.groupBy("pba").agg(F.slice(F.sort_array(F.collect_list(F.struct("vol_ord", "lba", "salt"))), 1, at_most).alias("tuples"))
    return off.join(t, "pba", "left")
