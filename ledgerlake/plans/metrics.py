"""Latency summaries and reports over samples of counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.running import nearest_rank

# Hints of the report, their thresholds, and the two that stand in when none holds.
HINTS = (
    ("wal_share", 45.0, ">", "wal is a large share of commit time"),
    ("fsync_us", 300.0, ">", "fsync is slow"),
    ("wal_batch", 8.0, "<", "wal batches are small"),
    ("drop_gate_share", 20.0, ">", "commits wait for drops"),
    ("apply_wait_share", 15.0, ">", "commits wait for their turn"),
    ("apply_gate_us", 10.0, ">", "the apply gate is contended"),
    ("apply_share", 5.0, "<", "applying is cheap"),
    ("range_delete_us", 1000.0, ">", "range deletes are slow"),
    ("cleanup_us", 1000.0, ">", "cleanup is slow"),
)
NO_COMMITS, NO_HINT = "no commits in the window", "no bottleneck stands out"


def latency_summary(samples: DataFrame, value: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """n, avg, p50, p95, p99, max by nearest rank. Values are counted first; ranks are then sums over distinct values, of which latencies in whole units have few."""
    counts = samples.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("avg"), F.max("v").alias("max"))
    ranked = counts.withColumn("upto", F.sum("n").over(Window.orderBy("v"))).crossJoin(F.broadcast(total))
    picks = [F.min(F.when(F.col("upto") >= nearest_rank(F.col("total"), s), F.col("v"))).alias(f"p{int(100 * s)}") for s in shares]
    return ranked.agg(F.first("total").alias("n"), F.first("avg").alias("avg"), *picks, F.first("max").alias("max"))


def write_report(rows: DataFrame, path: str, kind: str) -> None:
    """Events or a run's summary as JSON lines, each with the kind of record that it is."""
    rows.withColumn("kind", F.lit(kind)).write.mode("append").json(path)


def read_samples(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, blank ones skipped; a line that does not fit the schema is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def window(samples: DataFrame, n: int) -> DataFrame:
    """The last max(n, 2) samples."""
    return samples.orderBy(F.desc("ts_ms")).limit(max(n, 2))


def rates(samples: DataFrame, n: int, counters: list[str]) -> DataFrame:
    """seconds, and of each counter its growth over the last n samples and per second (0 if no time passed); a missing counter counts as 0."""
    w = window(samples, n)
    ends = w.agg((F.max("ts_ms") - F.min("ts_ms")).alias("ms"), *((F.coalesce(F.max_by(c, "ts_ms"), F.lit(0)) - F.coalesce(F.min_by(c, "ts_ms"), F.lit(0))).cast("long").alias(c) for c in counters))
    seconds = F.col("ms") / 1000.0
    return ends.select(seconds.alias("seconds"), *(F.col(c).alias(f"{c}_delta") for c in counters), *(F.when(seconds > 0, F.col(c) / seconds).otherwise(F.lit(0.0)).alias(f"{c}_rate") for c in counters))


def per_event(total: Column, count: Column) -> Column:
    """Mean of a total over its count; 0 where the count is not positive."""
    return F.when(count > 0, total / count).otherwise(F.lit(0.0))


def saturating_delta(now: Column, before: Column) -> Column:
    return F.greatest(now - before, F.lit(0))


def hints(report: DataFrame) -> DataFrame:
    """report with hints, an array: of each rule whose figure is a column and past its threshold; a fallback if none is, another if there were no commits (column commits)."""
    found = [F.when(F.col(c) > x if sign == ">" else F.col(c) < x, F.lit(text)) for c, x, sign, text in HINTS if c in report.columns]
    own = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    none = F.when(F.col("commits") <= 0, F.array(F.lit(NO_COMMITS))).otherwise(F.array(F.lit(NO_HINT)))
    return report.withColumn("hints", F.when(F.col("commits") <= 0, none).when(F.size(own) == 0, none).otherwise(own))


def compare(a: DataFrame, b: DataFrame, on: str = "scenario", value: str = "ops_per_s") -> DataFrame:
    """Two backends' figures: ratio and winner of each scenario."""
    out = a.select(on, F.col(value).alias("a")).join(b.select(on, F.col(value).alias("b")), on)
    return out.withColumns({"ratio": F.when(F.col("b") > 0, F.col("a") / F.col("b")), "winner": F.when(F.col("a") >= F.col("b"), "a").otherwise("b")})


def throughput(runs: DataFrame) -> DataFrame:
    """runs (scenario, ops, items, ms) with operations and items per second; 0 where no time passed."""
    s = F.col("ms") / 1000.0
    return runs.withColumns({"ops_per_s": F.when(s > 0, F.col("ops") / s).otherwise(F.lit(0.0)), "items_per_s": F.when(s > 0, F.col("items") / s).otherwise(F.lit(0.0))})


# Figures of the report. A rate is a counter's growth per second; a mean is one counter's growth over another's.
RATES = (
    ("lsn_per_s", "last_applied_lsn"), ("commits_per_s", "commit_success"), ("ops_per_s", "commit_ops"), ("records_per_s", "wal_records"), ("batches_per_s", "wal_batches"),
    ("range_deletes_per_s", "range_delete_calls"), ("range_noops_per_s", "range_delete_noop"), ("cleanups_per_s", "cleanup_calls"), ("cleanup_noops_per_s", "cleanup_noop"),
    ("cache_hits_per_s", "hits"), ("cache_misses_per_s", "misses"),
)
MEANS = (
    ("wal_batch", "wal_records", "wal_batches"),
    ("commit_us", "commit_total_us", "commit_success"), ("wal_us", "commit_wal_submit_us", "commit_success"), ("drop_gate_us", "commit_drop_gate_wait_us", "commit_success"),
    ("apply_wait_us", "commit_apply_wait_us", "commit_success"), ("apply_gate_us", "commit_apply_gate_wait_us", "commit_success"), ("apply_us", "commit_apply_us", "commit_success"),
    ("fsync_us", "wal_fsync_us", "wal_fsyncs"), ("write_us", "wal_write_us", "wal_batches"),
    ("range_captured", "range_delete_captured_entries", "range_delete_calls"), ("range_chunks", "range_delete_chunks", "range_delete_calls"),
    ("range_delete_us", "range_delete_total_us", "range_delete_success"), ("range_scan_us", "range_delete_scan_us", "range_delete_calls"),
    ("range_wal_us", "range_delete_wal_us", "range_delete_chunks"), ("range_wait_us", "range_delete_apply_wait_us", "range_delete_chunks"), ("range_apply_us", "range_delete_apply_us", "range_delete_chunks"),
    ("cleanup_addresses", "cleanup_pbas", "cleanup_calls"), ("cleanup_hashes", "cleanup_hashes_found", "cleanup_calls"), ("cleanup_ops", "cleanup_tx_ops", "cleanup_calls"),
    ("cleanup_us", "cleanup_total_us", "cleanup_success"), ("cleanup_scan_us", "cleanup_scan_us", "cleanup_calls"),
    ("cleanup_check_us", "cleanup_forward_check_us", "cleanup_forward_checks"), ("cleanup_commit_us", "cleanup_commit_us", "cleanup_success"),
)
#: Shares in percent of the mean commit, which counts as a microsecond at least.
SHARES = (("wal_share", "wal_us"), ("drop_gate_share", "drop_gate_us"), ("apply_wait_share", "apply_wait_us"), ("apply_share", "apply_us"))
#: Figures that are the last sample's own.
LAST = (
    "high_water", "wal_batch_records_max", "commit_total_max_us", "commit_wal_submit_max_us", "commit_drop_gate_wait_max_us", "commit_apply_wait_max_us", "wal_fsync_max_us",
    "range_delete_total_max_us", "cleanup_total_max_us", "current_bytes", "pinned_bytes",
)


def report(samples: DataFrame, n: int) -> DataFrame:
    """One row over the last n samples: seconds, commits, the figures of RATES, MEANS, SHARES and LAST. Counters that samples lack count as 0, and so do means over nothing."""
    counters = dict.fromkeys([c for _, c in RATES] + [c for _, *both in MEANS for c in both])
    have = samples.select("ts_ms", *((F.col(c) if c in samples.columns else F.lit(0)).cast("long").alias(c) for c in [*counters, *LAST]))
    w = window(have, n)
    ends = w.agg((F.max("ts_ms") - F.min("ts_ms")).alias("ms"), *((F.coalesce(F.max_by(c, "ts_ms"), F.lit(0)) - F.coalesce(F.min_by(c, "ts_ms"), F.lit(0))).cast("long").alias(f"_{c}") for c in counters), *(F.coalesce(F.max_by(c, "ts_ms"), F.lit(0)).alias(c) for c in LAST))
    seconds = F.col("ms") / 1000.0
    out = ends.select(
        seconds.alias("seconds"), F.col("_commit_success").alias("commits"),
        *(F.when(seconds > 0, F.col(f"_{c}") / seconds).otherwise(F.lit(0.0)).alias(name) for name, c in RATES),
        *(per_event(F.col(f"_{a}"), F.col(f"_{b}")).alias(name) for name, a, b in MEANS),
        *LAST,
    )
    return out.withColumns({name: 100 * F.col(of) / F.greatest("commit_us", F.lit(1.0)) for name, of in SHARES})


def as_json(rows: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one line of JSON, binary columns in hex."""
    shown = [F.lower(F.hex(c)).alias(c) if t == "binary" else F.col(c) for c, t in rows.dtypes]
    return rows.select(F.to_json(F.struct(*shown)).alias(name))


def write_samples(rows: DataFrame, path: str) -> None:
    """Samples as JSON lines, as read_samples reads them."""
    rows.write.mode("append").json(path)
