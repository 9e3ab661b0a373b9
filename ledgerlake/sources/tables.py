"""Logs derived from the test tables by fixed rules: block operations from events, deduplication from documents, metrics samples from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.running import BUCKET, latest, running_sums
from ..operators import state
from .schema import VOLUMES


def op_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lsn, op_seq, op, vol_ord, lba, pba, salt: one operation an event; an error deletes, all else remaps."""
    return op_log_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def op_log_of(events: DataFrame) -> DataFrame:
    """The same of a table or a stream of events."""
    error = F.col("event_type") == "error"
    return events.select(
        (F.col("event_id") + 1).alias("lsn"),
        F.lit(0).alias("op_seq"),
        F.when(error, "L2pDelete").otherwise("L2pRemap").alias("op"),
        (F.col("user_id") % 4).cast("int").alias("vol_ord"),
        F.floor(F.col("user_id") / 4).cast("long").alias("lba"),
        F.when(~error, F.get_json_object("props", "$.k").cast("long")).alias("pba"),
        F.when(~error, (F.col("event_id") % 3).cast("long")).alias("salt"),
    )


def count_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of explicit changes of counts: a click takes 1 to 3 references from an address, all else adds as many."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    none = {n: F.lit(None).cast(t) for n, t in (("vol_ord", "int"), ("lba", "long"), ("salt", "long"))}
    return e.select(
        (F.col("event_id") + 1).alias("lsn"), F.lit(0).alias("op_seq"), F.when(F.col("event_type") == "click", "Decref").otherwise("Incref").alias("op"),
        F.get_json_object("props", "$.k").cast("long").alias("pba"), (1 + F.col("event_id") % 3).alias("delta"),
    ).withColumns(none)


def guarded_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op_log with guards on the remaps of even events: guard_pba must have guard_min_rc references."""
    guarded = (F.col("op") == "L2pRemap") & ((F.col("lsn") - 1) % 2 == 0)
    return op_log(spark, sf_dir).withColumns({"guard_pba": F.when(guarded, (F.col("pba") + 1) % 100), "guard_min_rc": F.when(guarded, 1 + (F.col("lsn") - 1) % 3)})


def last_lsn(log: DataFrame) -> int:
    return log.agg(F.max("lsn")).first()[0] or 0


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, vol_ord, created_lsn: two snapshots of volume 0 and one of volume 1, at 40, 90 and 50 % of the log."""
    top = last_lsn(op_log(spark, sf_dir))
    return spark.createDataFrame([(k, vol, top * percent // 100) for k, vol, percent in ((1, 0, 40), (2, 0, 90), (3, 1, 50))], "id long, vol_ord int, created_lsn long")


def clone_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What volume 4, a clone of snapshot 3, is written itself: volume 1's purchases and errors after that snapshot."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_type").isin("purchase", "error")).select((F.col("event_id") + 1).alias("lsn"))
    at = clone_catalog(spark, sf_dir).where("ord = 4").first().src_lsn
    log = op_log(spark, sf_dir).where((F.col("vol_ord") == 1) & (F.col("lsn") > at)).join(e, "lsn", "left_semi")
    return log.withColumn("vol_ord", F.lit(4))


def clone_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes 0 to 3, and volume 4, cloned from snapshot 3."""
    at = snapshots(spark, sf_dir).where("id = 3").first().created_lsn
    return spark.createDataFrame([(k, None, None, 0, None) for k in range(4)] + [(4, 1, at, at, None)], VOLUMES)


def whole_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op_log and clone_log, with what the clone inherits spelled out."""
    return state.with_inherited(op_log(spark, sf_dir).unionByName(clone_log(spark, sf_dir)), clone_catalog(spark, sf_dir))


def dedup_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lsn, op, hash, pba: each document's text hash points to it; every 11th is deleted again."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("hash"))
    put = d.select((F.col("doc_id") + 1).alias("lsn"), F.lit("DedupPut").alias("op"), "hash", F.col("doc_id").alias("pba"))
    after = (d.agg(F.max("doc_id")).first()[0] or 0) + 2  # deletes follow all puts at any size
    gone = d.where("doc_id % 11 = 0").select((F.col("doc_id") + after).alias("lsn"), F.lit("DedupDelete").alias("op"), "hash", F.col("doc_id").alias("pba"))
    return put.unionByName(gone)


def reverse_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lsn, op, pba, hash of the reverse index."""
    return dedup_log(spark, sf_dir).where("op = 'DedupPut'").withColumn("op", F.lit("DedupReversePut"))


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """layer, hash, op, pba, lsn: the deduplication log in four runs by lsn, 4 the newest, one row a hash in each."""
    rows = dedup_log(spark, sf_dir)
    per = rows.groupBy(F.expr(f"lsn div {BUCKET}").alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy("b").collect()
    total, cuts = sum(r.n for r in per), []
    for want in (total // 4 * k + min(k, total % 4) for k in (1, 2, 3)):  # rows in the first k runs; the first runs take what four does not divide
        before = 0
        for r in per:
            if before + r.n >= want:
                inside = rows.where((F.col("lsn") >= r.b * BUCKET) & (F.col("lsn") < (r.b + 1) * BUCKET)).select("lsn").orderBy("lsn")
                cuts.append(inside.limit(want - before).agg(F.max("lsn")).first()[0])
                break
            before += r.n
    layer = F.lit(1)
    for cut in cuts:
        layer = layer + (F.col("lsn") > cut).cast("int")
    return latest(rows.withColumns({"layer": layer, "at": F.col("lsn")}), ["layer", "hash"], ["lsn"], ["op", "pba", "at"]).select("hash", "op", "pba", F.col("at").alias("lsn"), "layer")


def metric_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts_ms and three counters that only grow: a sample every 500 events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("b", F.floor(F.col("event_id") / 500).cast("long"))
    names = {"commit_success": "purchase", "wal_batches": "view", "wal_records": "click"}
    per = e.groupBy("b").agg(*(F.count_if(F.col("event_type") == kind).alias(n) for n, kind in names.items()))
    per = running_sums(per, None, ["b"], {n: f"{n}_sum" for n in names}, bucket_by="b")
    return per.select((F.col("b") * 60_000).alias("ts_ms"), *(F.col(f"{n}_sum").alias(n) for n in names))


#: Counters of the full samples: event types, and how much each event of them counts (1, or a column).
FULL_COUNTERS = {
    "last_applied_lsn": ("view click purchase error signup", "1"), "commit_success": ("purchase error", "1"), "commit_ops": ("view click purchase error", "1"),
    "wal_batches": ("view", "1"), "wal_records": ("view click purchase", "1"), "wal_fsyncs": ("view", "1"), "wal_fsync_us": ("click", "cost"), "wal_write_us": ("view", "cost"),
    "commit_total_us": ("view click purchase error", "cost"), "commit_wal_submit_us": ("view click", "cost"), "commit_drop_gate_wait_us": ("purchase", "cost"),
    "commit_apply_wait_us": ("error", "cost"), "commit_apply_gate_wait_us": ("error", "1"), "commit_apply_us": ("purchase", "1"),
    "range_delete_calls": ("error", "1"), "range_delete_success": ("error", "1"), "range_delete_captured_entries": ("error click", "1"), "range_delete_total_us": ("error", "cost"), "range_delete_scan_us": ("purchase", "cost"),
    "cleanup_calls": ("signup", "1"), "cleanup_success": ("signup", "1"), "cleanup_pbas": ("signup view", "1"), "cleanup_total_us": ("signup", "cost"),
}


def full_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts_ms and the counters of the full report, all growing: a sample every 500 events; an event costs its value in hundredths."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.floor(F.col("event_id") / 500).cast("long").alias("b"), "event_type", F.round(F.col("value") * 100).cast("long").alias("cost"))
    per = e.groupBy("b").agg(*(F.coalesce(F.sum(F.when(F.col("event_type").isin(*kinds.split()), F.lit(1).cast("long") if by == "1" else F.col(by))), F.lit(0).cast("long")).alias(n) for n, (kinds, by) in FULL_COUNTERS.items()))
    per = running_sums(per, None, ["b"], {n: f"{n}_sum" for n in FULL_COUNTERS}, bucket_by="b")
    return per.select((F.col("b") * 60_000).alias("ts_ms"), *(F.col(f"{n}_sum").alias(n) for n in FULL_COUNTERS))


def full_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lsn, vol_ord, lba and the nine fields of a block value."""
    pba = F.col("pba")
    return op_log(spark, sf_dir).where("op = 'L2pRemap'").select(
        "lsn", "vol_ord", "lba", "pba",
        F.col("salt").cast("int").alias("compression"),
        (512 + (pba * 97) % 9000).alias("unit_compressed_size"),
        (4096 * (1 + pba % 8)).alias("unit_original_size"),
        (1 + pba % 8).cast("int").alias("unit_lba_count"),
        (F.col("lba") % 8).cast("int").alias("offset_in_unit"),
        (pba * 2654435761 % 4294967296).alias("crc32"),
        F.when(pba % 3 == 0, (pba * 16) % 4096).otherwise(0).cast("int").alias("slot_offset"),
        (pba % 2).cast("int").alias("flags"),
    )
