"""Per-volume block maps as views of the log: what stands at an lsn, point, batch and range reads, volumes and clones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.running import latest, previous

MAPS = ("L2pPut", "L2pRemap", "L2pDelete")
KEY, ORDER, VALUE = ["vol_ord", "lba"], ["lsn", "op_seq"], ["pba", "salt"]


def l2p_at(log: DataFrame, lsn: int | Column | None = None) -> DataFrame:
    """vol_ord, lba, pba, salt, lsn of every mapped block as of lsn (now: None). The last writer holds; a delete unmaps."""
    rows = log.where(F.col("op").isin(*MAPS))
    if lsn is not None:
        rows = rows.where(F.col("lsn") <= lsn)
    top = latest(rows.withColumn("at", F.col("lsn")), KEY, ORDER, ["op", *VALUE, "at"])
    return top.where("op <> 'L2pDelete'").select(*KEY, *VALUE, F.col("at").alias("lsn"))


def l2p_at_snapshots(log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """snap_id and the block map of its volume at its lsn, for all snapshots (a small catalog) at once. For snapshots of clones, log is that of with_inherited."""
    s = snapshots.select(F.col("id").alias("snap_id"), F.col("vol_ord").alias("s_vol"), "created_lsn")
    rows = log.where(F.col("op").isin(*MAPS)).select(*ORDER, "op", *KEY, *VALUE)
    rows = rows.join(F.broadcast(s), (F.col("vol_ord") == F.col("s_vol")) & (F.col("lsn") <= F.col("created_lsn")))
    top = latest(rows, ["snap_id", *KEY], ORDER, ["op", *VALUE])
    return top.where("op <> 'L2pDelete'").drop("op")


def volumes(log: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Ordinals in order: volume 0, those written to, and those of the catalog that are not dropped."""
    out = log.select(F.col("vol_ord").alias("ord")).where("ord is not null")
    out = out.union(log.sparkSession.sql("SELECT 0"))
    if catalog is not None:
        out = out.union(catalog.select("ord")).distinct().join(catalog.where("dropped_lsn is not null"), "ord", "left_anti")
    return out.distinct().orderBy("ord")


def multi_get(state: DataFrame, keys: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """Values for each row of keys (pos and the key columns): in input order, repeats repeated, null where nothing stands."""
    return keys.join(state.select(*on, *values), on, "left").select("pos", *on, *values).orderBy("pos")


def l2p_range(state: DataFrame, vol: int, start: int | None = None, end: int | None = None, inclusive: bool = False, limit: int | None = None) -> DataFrame:
    """Blocks of one volume from start to end (end exclusive unless inclusive), in order."""
    out = state.where(F.col("vol_ord") == vol)
    if start is not None:
        out = out.where(F.col("lba") >= start)
    if end is not None:
        out = out.where(F.col("lba") <= end if inclusive else F.col("lba") < end)
    out = out.orderBy("lba")
    return out if limit is None else out.limit(limit)


def with_previous(log: DataFrame) -> DataFrame:
    """Each map operation with prev_pba, prev_salt: what its block held before; null for none or deleted."""
    return previous(log.where(F.col("op").isin(*MAPS)), KEY, ORDER, VALUE).select(*log.columns, *(f"prev_{v}" for v in VALUE))


def lineage(spark: SparkSession, catalog: DataFrame, vol: int) -> list[tuple[int, int | None]]:
    """(volume, last lsn seen of it) from vol to its first ancestor; the catalog is one small row a volume. Each step sees no more than the one before it."""
    rows = {r.ord: r for r in catalog.collect()}
    out, bound = [(vol, None)], None
    while vol in rows and rows[vol].src_ord is not None:
        r = rows[vol]
        bound = r.src_lsn if bound is None else min(bound, r.src_lsn)
        vol = r.src_ord
        out.append((vol, bound))
    return out


def clone_view(log: DataFrame, catalog: DataFrame, vol: int, lsn: int | None = None, only_inherited: bool = False) -> DataFrame:
    """The block map of a volume (as of lsn, or now) with what it inherits: a block that it or a nearer ancestor wrote or deleted hides the farther ones. only_inherited: what it began with."""
    parts = None
    for depth, (v, bound) in enumerate(lineage(log.sparkSession, catalog, vol)):
        if only_inherited and not depth:
            continue
        bound = lsn if bound is None else bound if lsn is None else min(lsn, bound)
        own = log.where((F.col("vol_ord") == v) & F.col("op").isin(*MAPS))
        own = own if bound is None else own.where(F.col("lsn") <= bound)
        own = own.withColumn("nearness", F.lit(-depth))
        parts = own if parts is None else parts.unionByName(own)
    top = latest(parts.withColumn("own", F.col("nearness") == 0), ["lba"], ["nearness", *ORDER], ["op", *VALUE, "own"])
    return top.where("op <> 'L2pDelete'").select(F.lit(vol).alias("vol_ord"), "lba", *VALUE, "own")


#: Places in a record, after all its operations: a clone's inherited blocks, and the end of a dropped volume.
INHERITED, ENDED = (1 << 31) - 2, (1 << 31) - 1


def with_inherited(log: DataFrame, catalog: DataFrame) -> DataFrame:
    """The map operations of log, with what the catalog implies spelled out: a clone begins with a put of each block of its source, and a dropped volume ends with a delete of each of its own.

    On this log every view by volume (counts, snapshots of clones, range deletes) needs no lineage. It holds a row for each block
    that a clone shares, as counts must; reads of one volume have clone_view, which copies nothing.
    """
    names = [*ORDER, "op", *KEY, *VALUE]
    own = log.where(F.col("op").isin(*MAPS)).select(*names)
    out = own
    for v in sorted(catalog.collect(), key=lambda r: r.ord):
        if v.src_ord is not None:
            source = clone_view(own, catalog, v.ord, only_inherited=True)
            out = out.unionByName(source.select(F.lit(v.created_lsn).cast("long").alias("lsn"), F.lit(INHERITED).alias("op_seq"), F.lit("L2pPut").alias("op"), F.lit(v.ord).alias("vol_ord"), "lba", *VALUE))
        if v.dropped_lsn is not None:
            last = clone_view(own, catalog, v.ord)
            gone = [F.lit(None).cast("long").alias(x) for x in VALUE]
            out = out.unionByName(last.select(F.lit(v.dropped_lsn).cast("long").alias("lsn"), F.lit(ENDED).alias("op_seq"), F.lit("L2pDelete").alias("op"), F.lit(v.ord).alias("vol_ord"), "lba", *gone))
    return out
