"""Differences between block maps, and what dropping a snapshot releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .refcount import live_snapshots, pinned_tuples
from .state import VALUE, l2p_at, l2p_at_snapshots


class InvalidArgument(ValueError):
    """A call that names what does not exist or must not be touched."""


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """lba, kind (AddedInB, RemovedInB, Changed), old and new value, by lba. a and b: maps of one volume. One shuffle of each side on lba."""
    a = a.select("lba", F.struct(*VALUE).alias("a"))
    b = b.select("lba", F.struct(*VALUE).alias("b"))
    kind = F.when(F.col("a").isNull(), "AddedInB").when(F.col("b").isNull(), "RemovedInB").otherwise("Changed")
    out = a.join(b, "lba", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return out.select("lba", kind.alias("kind"), *(F.col(f"a.{v}").alias(f"old_{v}") for v in VALUE), *(F.col(f"b.{v}").alias(f"new_{v}") for v in VALUE))


def _snapshot(snapshots: DataFrame, snap_id: int) -> Row:
    row = live_snapshots(snapshots).where(F.col("id") == snap_id).first()
    if row is None:
        raise InvalidArgument(f"unknown snapshot {snap_id}")
    return row


def snapshot_map(log: DataFrame, snapshots: DataFrame, snap_id: int) -> DataFrame:
    """The block map of a snapshot; of a clone's, if log is that of state.with_inherited."""
    return _map(log, _snapshot(snapshots, snap_id))


def _map(log: DataFrame, s: Row) -> DataFrame:
    return l2p_at(log.where(F.col("vol_ord") == s.vol_ord), s.created_lsn)


def snapshot_diff(log: DataFrame, snapshots: DataFrame, first: int, second: int) -> DataFrame:
    a, b = _snapshot(snapshots, first), _snapshot(snapshots, second)
    if a.vol_ord != b.vol_ord:
        raise InvalidArgument("snapshots of different volumes")
    return diff(_map(log, a), _map(log, b))


def diff_with_current(log: DataFrame, snapshots: DataFrame, snap_id: int) -> DataFrame:
    s = _snapshot(snapshots, snap_id)
    return diff(_map(log, s), l2p_at(log.where(F.col("vol_ord") == s.vol_ord)))


def drop_releases(log: DataFrame, snapshots: DataFrame, snap_id: int, current_only: bool = False) -> DataFrame:
    """vol_ord, lba, pba, salt that only this snapshot holds: each is one reference less when it is dropped. current_only compares with the live state alone, not with other snapshots."""
    _snapshot(snapshots, snap_id)
    mine = l2p_at_snapshots(log, snapshots.where(F.col("id") == snap_id))
    others = snapshots.where(F.col("id") != snap_id)
    others = others.where("false") if current_only else others
    return mine.join(pinned_tuples(log, others), ["vol_ord", "lba", *VALUE], "left_anti").select("vol_ord", "lba", *VALUE)


def drop_decrefs(log: DataFrame, snapshots: DataFrame, snap_id: int) -> DataFrame:
    """pba, decrefs, rc_before, rc_after, freed of dropping it; rc is the closed form, so it never goes below zero. A clone holds what it inherits, if log is that of state.with_inherited."""
    gone = drop_releases(log, snapshots, snap_id).groupBy("pba").agg(F.count(F.lit(1)).alias("decrefs"))
    before = pinned_tuples(log, snapshots).groupBy("pba").agg(F.count(F.lit(1)).alias("rc_before"))
    out = gone.join(before, "pba").withColumn("rc_after", F.col("rc_before") - F.col("decrefs"))
    return out.withColumn("freed", F.col("rc_after") == 0)
