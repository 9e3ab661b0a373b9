"""Running sums that no hot key can gather in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 1 << 16


def running_sum(rows: DataFrame, key: str | None, order: list[str], value: str, name: str, bucket_by: str = "lsn", bucket: int = BUCKET) -> DataFrame:
    """rows with the sum of value so far (own row included) of its key."""
    return running_sums(rows, key, order, {value: name}, bucket_by, bucket)


def running_sums(rows: DataFrame, key: str | None, order: list[str], names: dict[str, str], bucket_by: str = "lsn", bucket: int = BUCKET) -> DataFrame:
    """rows with sums so far of several columns (value: name), by key or over all. Sums are taken first over whole buckets of bucket_by, the leading order column, then within each: a key with most of the rows is split by bucket."""
    keys = [] if key is None else [key]
    rows = rows.withColumn("_bucket", F.expr(f"{bucket_by} div {bucket}"))
    before = rows.groupBy(*keys, "_bucket").agg(*(F.sum(v).alias(f"_sum_{v}") for v in names))
    upto = Window.partitionBy(*keys).orderBy("_bucket")
    before = before.select(*keys, "_bucket", *((F.sum(f"_sum_{v}").over(upto) - F.col(f"_sum_{v}")).alias(f"_before_{v}") for v in names))
    own = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"_own_{v}": F.sum(v).over(own) for v in names}).join(before, [*keys, "_bucket"])
    return out.withColumns({n: (F.col(f"_before_{v}") + F.col(f"_own_{v}")).cast("long") for v, n in names.items()}).drop("_bucket", *(f"_{x}_{v}" for x in ("before", "own") for v in names))


def previous(rows: DataFrame, keys: list[str], order: list[str], values: list[str], bucket_by: str = "lsn", bucket: int = BUCKET) -> DataFrame:
    """rows with prev_<value>: the values of the row before it of equal keys, null for the first. Rows are compared within buckets of bucket_by, the leading order column; the first of a bucket takes what the last one before the bucket held. So a key with most of the rows is split by bucket."""
    rows = rows.withColumn("_bucket", F.expr(f"{bucket_by} div {bucket}"))
    ends = rows.groupBy(*keys, "_bucket").agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_last"))
    ends = ends.select(*keys, "_bucket", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_carried"))
    own = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    rows = rows.withColumns({"_first": F.row_number().over(own) == 1, **{f"_own_{v}": F.lag(v).over(own) for v in values}}).join(ends, [*keys, "_bucket"])
    return rows.withColumns({f"prev_{v}": F.when(F.col("_first"), F.col(f"_carried.{v}")).otherwise(F.col(f"_own_{v}")) for v in values}).drop("_bucket", "_carried", "_first", *(f"_own_{v}" for v in values))


def latest(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The values of each key's last row; an aggregate, so that versions are dropped before the shuffle."""
    top = F.max_by(F.struct(*values), F.struct(*order)).alias("_top")
    return rows.groupBy(*keys).agg(top).select(*keys, *(F.col(f"_top.{v}").alias(v) for v in values))


def nearest_rank(n: Column, share: float) -> Column:
    """1-based rank of a share of n sorted rows: round((n - 1) * share), halves away from zero."""
    return (F.round((n - 1) * F.lit(share)) + 1).cast("long")
