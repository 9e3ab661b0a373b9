"""Reports over the log itself, and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def op_counts(log: DataFrame) -> DataFrame:
    """op, ops, records, first_lsn, last_lsn of each kind of operation."""
    return log.groupBy("op").agg(F.count(F.lit(1)).alias("ops"), F.count_distinct("lsn").alias("records"), F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"))


def records(log: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """lsn, ops, kinds (in order, comma-joined) of each record."""
    rows = log if first is None else log.where(F.col("lsn") >= first)
    rows = rows if last is None else rows.where(F.col("lsn") <= last)
    kinds = F.transform(F.sort_array(F.collect_list(F.struct("op_seq", "op"))), lambda x: x.op)
    return rows.groupBy("lsn").agg(F.count(F.lit(1)).alias("ops"), F.array_join(kinds, ",").alias("kinds"))


def order_report(arrivals: DataFrame, bucket: int = 1 << 16) -> DataFrame:
    """arrived, lsn of records that do not follow the one before them. arrivals: arrived (place in the file order), lsn. Each bucket of places is compared within itself and with the last record before it."""
    rows = arrivals.withColumn("b", F.expr(f"arrived div {bucket}"))
    within = Window.partitionBy("b").orderBy("arrived")
    ends = rows.groupBy("b").agg(F.max_by("lsn", "arrived").alias("last"))
    ends = ends.select("b", F.lag("last").over(Window.orderBy("b")).alias("last_before"))
    rows = rows.withColumn("own_before", F.lag("lsn").over(within)).join(ends, "b")
    return rows.where(F.col("lsn") <= F.coalesce("own_before", "last_before")).select("arrived", "lsn")


def prunable(segments: DataFrame, checkpoint: int) -> DataFrame:
    """Segments that hold nothing past the checkpoint; the newest one always stays. segments: first_lsn, last_lsn."""
    newest = segments.agg(F.max("first_lsn").alias("newest"))
    return segments.crossJoin(F.broadcast(newest)).where((F.col("last_lsn") <= checkpoint) & (F.col("first_lsn") < F.col("newest"))).drop("newest")


def orphans(allocated: DataFrame, live: DataFrame, free: DataFrame) -> DataFrame:
    """Allocated ids that are neither live nor free."""
    return allocated.join(live, "pba", "left_anti").join(free, "pba", "left_anti")


def edge_faults(edges: DataFrame, stored: DataFrame) -> DataFrame:
    """child, in_degree, rc where a stored count is not the number of edges. edges: parent, child; stored: child, rc."""
    degree = edges.groupBy("child").agg(F.count(F.lit(1)).alias("in_degree"))
    return degree.join(stored, "child", "full_outer").na.fill(0, ["in_degree", "rc"]).where("in_degree <> rc")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, with repeats, of one side only, and which."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def unit_stats(values: DataFrame, shift: int = 7) -> DataFrame:
    """vol_ord, leaf (lba >> shift), entries, units, encoded bytes and gain over a dense leaf of 3600 bytes. values: vol_ord, lba and columns unit_* that tell units apart."""
    units = [c for c in values.columns if c.startswith("unit_")]
    out = values.groupBy("vol_ord", F.shiftright("lba", shift).alias("leaf")).agg(F.count(F.lit(1)).alias("entries"), F.count_distinct(F.struct(*units)).alias("units"))
    size = 402 + 26 * F.col("units")
    return out.withColumns({"bytes": size, "gain": F.round(F.lit(3600.0) / size, 4)})
