"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Each source's documents, in a fixed random order, form blocks of equal length. With share q of Q
in all, block i (from 0) may start at slot floor(i * Q / q) and must be done by slot
ceil((i + 1) * Q / q); in each slot, of the blocks that may start, the one with the earliest
deadline goes. On one stream with shares that sum to Q this meets every deadline, so at any slot
each source is less than one block from its exact share. The schedule repeats every Q slots:
only one period is played through, and block i is placed by arithmetic. A source that ends
leaves its slots empty; the others keep their proportions, and no document is dropped.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import staged, table

BLOCK_CHARS = 16_384
SHARES = {"src0": 8, "src1": 4, "src2": 4, "src3": 2, "src4": 2}
ROWS_A_BUCKET = 20_000
BROADCAST_SLOTS = 1 << 18  # about 16 MB
SALTS = 32

# One period as a fold over its slots. Sources of one share have the same windows, so their blocks go round by round, each round in order of k:
# the state is how many blocks of each share were placed, and a slot compares one block of each share. Slots are gathered in runs, so that appending one copies a run at most.
PERIOD = """
transform(flatten(aggregate(sequence(0L, (total - 1) div RUN),
  named_struct('placed', transform(classes, c -> 0L), 'runs', cast(array() as array<array<struct<deadline: bigint, k: int, nth: bigint>>>)),
  (done, r) -> transform(array(aggregate(sequence(r * RUN, least(total, (r + 1) * RUN) - 1),
      named_struct('placed', done.placed, 'slots', cast(array() as array<struct<deadline: bigint, k: int, nth: bigint>>)),
      (state, t) -> transform(array(array_min(transform(state.placed, (n, j) -> named_struct(
            'deadline', if((n div classes[j].size) * total div classes[j].share <= t, ((n div classes[j].size + 1) * total + classes[j].share - 1) div classes[j].share, 9 * total),
            'k', classes[j].members[int(n % classes[j].size)], 'j', j, 'nth', n div classes[j].size)))),
          p -> named_struct('placed', transform(state.placed, (n, j) -> n + if(j = p.j, 1L, 0L)),
                            'slots', state.slots || array(named_struct('deadline', p.deadline, 'k', p.k, 'nth', p.nth))))[0])),
    run -> named_struct('placed', run.placed, 'runs', done.runs || array(run.slots)))[0],
  done -> done.runs)),
  s -> named_struct('source', shares[s.k].source, 'share', shares[s.k].share, 'nth', s.nth, 'deadline', s.deadline))
""".replace("RUN", "1024L")


def _share(shares: Mapping[str, int], default_share: int) -> Column:
    share = F.lit(default_share).cast("long")
    for name, q in sorted(shares.items()):
        share = F.when(F.col("source") == name, F.lit(q).cast("long")).otherwise(share)
    return share


def period(sources: DataFrame, shares: Mapping[str, int], default_share: int = 1) -> DataFrame:
    """source, share, total, slot, nth, deadline: what stands in each of the Q slots of one period, Q = the sum of the sources' shares. Of equal deadlines the first source by name goes. It is one row's fold, in time of Q times the number of different shares and memory of Q."""
    every = sources.select("source").distinct().select("source", _share(shares, default_share).alias("share"))
    one = every.agg(F.sort_array(F.collect_list(F.struct("source", "share"))).alias("shares"), F.sum("share").alias("total")).where("total > 0")
    kinds = F.expr("transform(array_distinct(shares.share), q -> filter(transform(shares, (s, k) -> named_struct('share', s.share, 'k', k)), x -> x.share = q))")
    classes = F.transform(kinds, lambda m: F.struct(m[0]["share"].alias("share"), F.size(m).cast("long").alias("size"), m["k"].alias("members")))
    one = one.agg(*(F.first(c).alias(n) for n, c in (("shares", "shares"), ("total", "total"), ("classes", classes))))  # so that the fold reads classes, and does not make them for each slot
    slots = one.select("total", F.posexplode(F.expr(PERIOD)).alias("slot", "s"))
    return slots.select("s.source", "s.share", "total", F.col("slot").cast("long").alias("slot"), "s.nth", "s.deadline")


def schedule(docs: DataFrame, shares: Mapping[str, int], default_share: int = 1, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of docs: doc_id, source, block, release, deadline, slot, begins; the mixed stream is in order of (slot, begins, doc_id).

    A document lies in the block in which it begins and has length(text) + 1 characters (null
    text: 1); one that is longer than a block takes the place of the next ones. Null is a source
    like another, with the default share. Order within a source is that of md5(doc_id); rows
    that repeat an id follow by length. begins is the document's first character in its source.
    """
    n = docs.count()
    digits = 1
    while 16**digits * ROWS_A_BUCKET < n:
        digits += 1
    rows = docs.select("doc_id", "source", (F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))) + 1).cast("long").alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("place"))
    # Running sums in two steps, so that no task holds a whole source: over buckets of the random order, then within each.
    rows = rows.withColumn("bucket", F.substring("place", 1, digits))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    sums = sums.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), (F.sum("size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("size")).alias("before"))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    order = Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("begins", F.col("before") + F.sum("size").over(order) - F.col("size")).withColumn("block", F.expr(f"begins div {int(block_chars)}"))
    cycle = staged(docs.sparkSession, period(docs, shares, default_share), "period")
    rows = rows.select("source", "doc_id", "begins", "block", _share(shares, default_share).alias("share")).crossJoin(F.broadcast(cycle.agg(F.max("total").alias("total"))))
    cycle = cycle.select(F.col("source").alias("_s"), "nth", F.col("slot").alias("_slot"), F.col("deadline").alias("_deadline"))
    on = F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") % F.col("share") == F.col("nth"))
    if cycle.count() <= BROADCAST_SLOTS:
        cycle = F.broadcast(cycle)
    else:  # dealt by source and place in the period, and a source's turns over SALTS parts, as one place may hold most rows
        cycle = cycle.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on = on & (F.expr(f"(block div share) % {SALTS}") == F.col("_salt"))
    out = rows.join(cycle, on)
    turn = F.expr("(block div share) * total")
    return out.select("doc_id", "source", "block", F.expr("block * total div share").alias("release"), (turn + F.col("_deadline")).alias("deadline"), (turn + F.col("_slot")).alias("slot"), "begins")


def placed(rows: DataFrame, docs: DataFrame, shares: Mapping[str, int], default_share: int = 1, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """rows, all columns, which hold doc_ids of docs, with slot and begins of the schedule of docs: so the order of the mixed stream is told from any files. Rows of one doc_id take the first place of that id."""
    plan = schedule(docs, shares, default_share, block_chars).groupBy(F.col("doc_id").alias("_id")).agg(F.min(F.struct("slot", "begins")).alias("_place"))
    return rows.join(plan, rows["doc_id"].eqNullSafe(plan["_id"])).select(*(rows[c] for c in rows.columns), "_place.slot", "_place.begins")


def mixed(docs: DataFrame, shares: Mapping[str, int], default_share: int = 1, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs, all rows and columns, in the order of the mixed stream; rows of one doc_id take the first place of that id. Files read again may lose the order: placed() has it as columns."""
    name = "_place"
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    plan = schedule(docs, shares, default_share, block_chars).groupBy("doc_id").agg(F.min(F.struct("slot", "begins")).alias(name)).withColumnRenamed("doc_id", name + "id")
    out = docs.join(plan, docs["doc_id"].eqNullSafe(plan[name + "id"]))
    return out.orderBy(f"{name}.slot", f"{name}.begins", "doc_id").drop(name, name + "id")


def op4_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(table(spark, sf_dir, "documents"), SHARES)


OP4_SQL = """
WITH RECURSIVE shares AS (
  SELECT source, CASE source CASES ELSE 1 END::BIGINT AS share FROM (SELECT DISTINCT source FROM documents)),
ranked AS (SELECT source, share, row_number() OVER (ORDER BY source NULLS FIRST) AS k, (sum(share) OVER ())::BIGINT AS total FROM shares),
lists AS (SELECT list(share ORDER BY k) AS shares, list(source ORDER BY k) AS sources, sum(share)::BIGINT AS total FROM ranked),
steps(t, pick, nth, placed) AS (
  SELECT -1::BIGINT, NULL::STRUCT(due BIGINT, k BIGINT), NULL::BIGINT, list_transform(shares, lambda x: 0::BIGINT) FROM lists
  UNION ALL
  SELECT t + 1, p, placed[p.k], list_transform(placed, lambda n, i: n + (i = p.k)::BIGINT)
  FROM (SELECT t, placed, list_min(list_transform(placed, lambda n, i: {'due': CASE WHEN n * total // shares[i] <= t + 1 THEN ((n + 1) * total + shares[i] - 1) // shares[i] ELSE 9 * total END, 'k': i})) AS p
        FROM steps, lists WHERE t + 1 < total) q),
cycle AS (SELECT sources[pick.k] AS source, shares[pick.k] AS share, total, t AS slot, nth, pick.due AS due FROM steps, lists WHERE pick IS NOT NULL),
placed AS (
  SELECT doc_id, source, (sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS begins
  FROM (SELECT doc_id, source, length(coalesce(text, '')) + 1 AS size FROM documents))
SELECT doc_id, p.source, begins // BLOCK AS block, (begins // BLOCK) * total // share AS release,
       (begins // BLOCK) // share * total + due AS deadline, (begins // BLOCK) // share * total + slot AS slot, begins
FROM placed p JOIN cycle c ON p.source IS NOT DISTINCT FROM c.source AND (begins // BLOCK) % share = nth
""".replace("BLOCK", str(BLOCK_CHARS)).replace("CASES", " ".join(f"WHEN '{k}' THEN {v}" for k, v in SHARES.items()))
