"""The deduplication index and its reverse: last-writer views, prefix reads, cleanup of dead addresses, and maintenance of layered runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codec import reverse_key
from ..functions.running import latest, previous


def current(log: DataFrame, lsn: int | None = None) -> DataFrame:
    """hash, pba, lsn of live entries: the last put or delete of a hash holds, and a delete hides."""
    rows = log.where(F.col("op").isin("DedupPut", "DedupDelete"))
    rows = rows if lsn is None else rows.where(F.col("lsn") <= lsn)
    top = latest(rows.withColumn("at", F.col("lsn")), ["hash"], ["lsn"], ["op", "pba", "at"])
    return top.where("op = 'DedupPut'").select("hash", "pba", F.col("at").alias("lsn"))


def tombstones(log: DataFrame) -> DataFrame:
    """hash, lsn of entries whose last operation is a delete."""
    top = latest(log.where(F.col("op").isin("DedupPut", "DedupDelete")).withColumn("at", F.col("lsn")), ["hash"], ["lsn"], ["op", "at"])
    return top.where("op = 'DedupDelete'").select("hash", F.col("at").alias("lsn"))


def reverse_current(log: DataFrame, full_key: bool = True) -> DataFrame:
    """pba, hash of live reverse entries. full_key False keys by 24 bytes of the hash, as the stored format does."""
    rows = log.where(F.col("op").isin("DedupReversePut", "DedupReverseDelete"))
    if full_key:
        return latest(rows, ["pba", "hash"], ["lsn"], ["op"]).where("op = 'DedupReversePut'").select("pba", "hash")
    rows = rows.withColumn("key", reverse_key(F.col("pba"), F.col("hash")))
    return latest(rows, ["key"], ["lsn"], ["op", "pba", "hash"]).where("op = 'DedupReversePut'").select("pba", "hash")


def reverse_scan(reverse: DataFrame, pbas: DataFrame) -> DataFrame:
    """pos, pba and the sorted hashes of each asked address: in input order, empty where none stands."""
    out = pbas.join(reverse, "pba", "left").groupBy("pos", "pba").agg(F.sort_array(F.collect_list("hash")).alias("hashes"))
    return out.orderBy("pos")


def cleanup_plan(forward: DataFrame, reverse: DataFrame, dead: DataFrame) -> DataFrame:
    """pba, hash, forward_pba, delete_forward of every reverse entry of a dead address: the reverse entry always goes, the forward one only if it still points there."""
    fwd = forward.select("hash", F.col("pba").alias("forward_pba"))
    out = reverse.join(dead.select("pba").distinct(), "pba", "left_semi").join(fwd, "hash", "left")
    return out.select("pba", "hash", "forward_pba", F.coalesce(F.col("forward_pba") == F.col("pba"), F.lit(False)).alias("delete_forward"))


def scan_layers(layers: DataFrame, prefix: str = "") -> DataFrame:
    """hash, pba, layer of what is visible over all layers: the newest one that has a hash holds, and a delete there hides."""
    rows = layers.where(F.col("hash").startswith(prefix)) if prefix else layers
    top = latest(rows.withColumn("at", F.col("layer")), ["hash"], ["layer"], ["op", "pba", "at"])
    return top.where("op = 'DedupPut'").select("hash", "pba", F.col("at").alias("layer"))


def scan_prefixes(layers: DataFrame, prefixes: DataFrame) -> DataFrame:
    """pos, prefix, hash, pba: what is visible over all layers under each asked prefix (pos, prefix: a short list, broadcast), null where nothing is. Repeats are repeated."""
    top = scan_layers(layers)
    asked = prefixes.select("pos", "prefix")
    found = top.join(F.broadcast(asked), F.col("hash").startswith(F.col("prefix"))).select("pos", "hash", "pba")
    return asked.join(found, "pos", "left")


def merge_layers(layers: DataFrame, first: int, last: int, deepest: bool) -> DataFrame:
    """Layers first to last as one run: newest wins; deletes go only if nothing lies deeper."""
    rows = layers.where(F.col("layer").between(first, last))
    top = latest(rows, ["hash"], ["layer"], ["op", "pba"])
    return top.where("op = 'DedupPut'") if deepest else top


def layer_stats(layers: DataFrame) -> DataFrame:
    """Entries, deletes and key range of each run."""
    return layers.groupBy("layer").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("op") == "DedupDelete").alias("deletes"), F.min("hash").alias("min_hash"), F.max("hash").alias("max_hash"))


def compaction_candidates(runs: DataFrame, level: int) -> DataFrame:
    """Pairs of a run of level and one of the next level whose key ranges overlap. runs: level, run, min_hash, max_hash, records; a catalog of files, so a range join of small sides."""
    a = runs.where(F.col("level") == level).select("run", "min_hash", "max_hash")
    b = runs.where(F.col("level") == level + 1).select(F.col("run").alias("below"), F.col("min_hash").alias("lo"), F.col("max_hash").alias("hi"))
    return a.join(b, (F.col("min_hash") <= F.col("hi")) & (F.col("lo") <= F.col("max_hash"))).select("run", "below")


def pick_compaction(runs: DataFrame, l0_trigger: int = 4, level_ratio: int = 10, base_records: int = 1 << 20) -> tuple[int, list[int], list[int]] | None:
    """Level and runs to merge next, with those below that overlap them: all of level 0 at l0_trigger runs, else the largest run of a level over its budget; None if nothing is due."""
    levels = {r.level: r for r in runs.groupBy("level").agg(F.count(F.lit(1)).alias("runs"), F.sum("records").alias("records")).collect()}
    chosen = None
    if 0 in levels and levels[0].runs >= l0_trigger:
        chosen = 0, [r.run for r in runs.where("level = 0").select("run").collect()]
    else:
        for level in sorted(k for k in levels if k > 0):
            if levels[level].records > base_records * level_ratio ** (level - 1):
                chosen = level, [runs.where(F.col("level") == level).orderBy(F.desc("records"), "run").first().run]
                break
    if chosen is None:
        return None
    level, own = chosen
    below = compaction_candidates(runs.where((F.col("level") != level) | F.col("run").isin(own)), level).select("below").distinct()
    return level, sorted(own), sorted(r.below for r in below.collect())


def order_report(rows: DataFrame) -> DataFrame:
    """layer, records, faults: how many rows each run holds, and how many have a hash that is not above the one before it. rows: layer, hash, pos (place in file order). Rows are compared within spans of places and across their borders."""
    seen = previous(rows.select("layer", "hash", "pos"), ["layer"], ["pos"], ["hash"], bucket_by="pos")
    return seen.groupBy("layer").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("hash") <= F.col("prev_hash")).alias("faults"))


def flush_run(log: DataFrame, after: int, upto: int, layer: int) -> DataFrame:
    """The operations with after < lsn <= upto as a new run: the last of each hash, deletes kept to hide what lies deeper."""
    rows = log.where((F.col("lsn") > after) & (F.col("lsn") <= upto) & F.col("op").isin("DedupPut", "DedupDelete"))
    return latest(rows.withColumn("at", F.col("lsn")), ["hash"], ["lsn"], ["op", "pba", "at"]).select(F.lit(layer).alias("layer"), "hash", "op", "pba", F.col("at").alias("lsn"))


def compacted(layers: DataFrame, first: int, last: int) -> DataFrame:
    """All layers after first to last have become one, numbered last. What is visible stays the same."""
    deepest = layers.where(F.col("layer") < first).isEmpty()
    merged = merge_layers(layers, first, last, deepest).select(F.lit(last).alias("layer"), "hash", "op", "pba")
    return layers.where(~F.col("layer").between(first, last)).select("layer", "hash", "op", "pba").unionByName(merged)


def maintain(layers: DataFrame, runs: DataFrame, **limits) -> tuple[DataFrame, list[int], list[int]] | None:
    """One round of compaction: the run that replaces those that pick_compaction names, and which they are (of the level, and below); None if nothing is due. layers: level, run, hash, op, pba, lsn; runs: their catalog.

    The newest lsn of a hash wins, and deletes go only if no deeper level holds anything. The caller writes the run, then swaps the catalog, so a job that dies between the two leaves the old runs in force.
    """
    due = pick_compaction(runs, **limits)
    if due is None:
        return None
    level, own, below = due
    deepest = runs.where(F.col("level") > level + 1).isEmpty()
    rows = layers.where(F.col("run").isin(own + below))
    top = latest(rows.withColumn("at", F.col("lsn")), ["hash"], ["lsn"], ["op", "pba", "at"]).select(F.lit(level + 1).alias("level"), "hash", "op", "pba", F.col("at").alias("lsn"))
    return (top.where("op = 'DedupPut'") if deepest else top), own, below


def write_run(run: DataFrame, path: str, key: str = "hash", partitions: int | None = None) -> None:
    """A run on disk: ranges of the key, sorted, with row-group limits and a Bloom filter, so that a point read opens few row groups."""
    dealt = run.repartitionByRange(key) if partitions is None else run.repartitionByRange(partitions, key)
    dealt.sortWithinPartitions(key).write.option(f"parquet.bloom.filter.enabled#{key}", "true").mode("overwrite").parquet(path)
