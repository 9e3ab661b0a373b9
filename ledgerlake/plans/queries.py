"""Named queries over the test tables, and for those that SQL can express, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec, running
from ..operators import audit, dedup, refcount, remap, snapshot, state
from ..sources import tables, wal
from ..streaming.tail import Tail, op_rate, written
from . import metrics
from .work import shared_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# Pieces of SQL that queries share, each a common table expression.
CTE = {
    "op_log": """SELECT event_id + 1 AS lsn, 0::INT AS op_seq, CASE WHEN event_type = 'error' THEN 'L2pDelete' ELSE 'L2pRemap' END AS op,
        (user_id % 4)::INT AS vol_ord, floor(user_id / 4)::BIGINT AS lba,
        CASE WHEN event_type = 'error' THEN NULL ELSE json_extract_string(props, '$.k')::BIGINT END AS pba,
        CASE WHEN event_type = 'error' THEN NULL ELSE (event_id % 3)::BIGINT END AS salt FROM events""",
    "snaps": "SELECT id, vol_ord, (top * percent // 100)::BIGINT AS created_lsn FROM (VALUES (1::BIGINT, 0, 40), (2, 0, 90), (3, 1, 50)) v(id, vol_ord, percent), (SELECT max(lsn) AS top FROM op_log)",
    "live": "SELECT * EXCLUDE (rn, op) FROM (SELECT vol_ord, lba, pba, salt, lsn, op, row_number() OVER (PARTITION BY vol_ord, lba ORDER BY lsn DESC) AS rn FROM op_log) WHERE rn = 1 AND op <> 'L2pDelete'",
    "snapped": "SELECT * EXCLUDE (rn, op) FROM (SELECT s.id AS snap_id, l.vol_ord, lba, pba, salt, op, row_number() OVER (PARTITION BY s.id, lba ORDER BY lsn DESC) AS rn FROM op_log l JOIN snaps s ON l.vol_ord = s.vol_ord AND lsn <= created_lsn) WHERE rn = 1 AND op <> 'L2pDelete'",
    "prev": "SELECT *, lag(pba) OVER w AS prev_pba, lag(salt) OVER w AS prev_salt FROM op_log WINDOW w AS (PARTITION BY vol_ord, lba ORDER BY lsn, op_seq)",
    "moves": """SELECT lsn, op_seq, pba, sum(d)::BIGINT AS delta FROM (
        SELECT lsn, op_seq, prev_pba AS pba, -1 AS d FROM prev WHERE op = 'L2pDelete' OR pba IS DISTINCT FROM prev_pba OR salt IS DISTINCT FROM prev_salt
        UNION ALL SELECT lsn, op_seq, pba, 1 FROM prev WHERE op <> 'L2pDelete' AND (pba IS DISTINCT FROM prev_pba OR salt IS DISTINCT FROM prev_salt))
        WHERE pba IS NOT NULL GROUP BY ALL HAVING sum(d) <> 0""",
    "running": "SELECT *, (sum(delta) OVER (PARTITION BY pba ORDER BY lsn, op_seq))::BIGINT AS rc FROM moves",
    "rcs": "SELECT pba, sum(delta)::BIGINT AS rc FROM moves GROUP BY pba HAVING sum(delta) > 0",
    "tuples": "SELECT vol_ord, lba, pba, salt FROM live UNION SELECT vol_ord, lba, pba, salt FROM snapped",
    "closed": "SELECT pba, count(*) AS rc FROM tuples GROUP BY pba",
    "dlog": """SELECT doc_id + 1 AS lsn, 'DedupPut' AS op, sha256(text) AS hash, doc_id AS pba FROM documents
        UNION ALL SELECT (SELECT max(doc_id) FROM documents) + 2 + doc_id, 'DedupDelete', sha256(text), doc_id FROM documents WHERE doc_id % 11 = 0""",
    "dtop": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY lsn DESC) AS rn FROM dlog) WHERE rn = 1",
    "dlive": "SELECT hash, pba, lsn FROM dtop WHERE op = 'DedupPut'",
    "reverse": "SELECT DISTINCT pba, hash FROM dlog WHERE op = 'DedupPut'",
    "layered": "SELECT layer, hash, op, pba, lsn FROM (SELECT *, row_number() OVER (PARTITION BY layer, hash ORDER BY lsn DESC) AS rn FROM (SELECT *, ntile(4) OVER (ORDER BY lsn)::INT AS layer FROM dlog)) WHERE rn = 1",
    "samples": """SELECT b * 60000 AS ts_ms, (sum(c) OVER (ORDER BY b))::BIGINT AS commit_success, (sum(w) OVER (ORDER BY b))::BIGINT AS wal_batches, (sum(k) OVER (ORDER BY b))::BIGINT AS wal_records
        FROM (SELECT floor(event_id / 500)::BIGINT AS b, count(*) FILTER (event_type = 'purchase') AS c, count(*) FILTER (event_type = 'view') AS w, count(*) FILTER (event_type = 'click') AS k FROM events GROUP BY 1)""",
    "clog": "SELECT l.* REPLACE (4::INT AS vol_ord) FROM op_log l JOIN events e ON e.event_id + 1 = l.lsn WHERE vol_ord = 1 AND event_type IN ('purchase', 'error') AND lsn > (SELECT created_lsn FROM snaps WHERE id = 3)",
    "cloned": """SELECT lba, pba, salt, own FROM (SELECT *, row_number() OVER (PARTITION BY lba ORDER BY own DESC, lsn DESC) AS rn FROM (
        SELECT lsn, op, lba, pba, salt, true AS own FROM clog
        UNION ALL SELECT lsn, op, lba, pba, salt, false FROM op_log WHERE vol_ord = 1 AND lsn <= (SELECT created_lsn FROM snaps WHERE id = 3))) WHERE rn = 1 AND op <> 'L2pDelete'""",
    "vals": """SELECT lsn, vol_ord, lba, pba, salt::INT AS compression, 512 + (pba * 97) % 9000 AS unit_compressed_size, 4096 * (1 + pba % 8) AS unit_original_size,
        (1 + pba % 8)::INT AS unit_lba_count, (lba % 8)::INT AS offset_in_unit, (pba * 2654435761 % 4294967296)::BIGINT AS crc32,
        (CASE WHEN pba % 3 = 0 THEN (pba * 16) % 4096 ELSE 0 END)::INT AS slot_offset, (pba % 2)::INT AS flags FROM op_log WHERE op = 'L2pRemap'""",
    "keys": "SELECT lba * 16 + v AS pos, v::INT AS vol_ord, lba FROM (SELECT DISTINCT vol_ord, lba FROM op_log) k, LATERAL (SELECT unnest([vol_ord, vol_ord + 8]) AS v)",
    "asked": "SELECT 2 * pba + k AS pos, pba + k * 1000000 AS pba FROM (SELECT DISTINCT pba FROM op_log WHERE pba IS NOT NULL) a, (VALUES (0::BIGINT), (1)) v(k)",
    "tmoves": """SELECT lsn, op_seq, vol_ord, lba, prev_pba AS pba, prev_salt AS salt, -1 AS d FROM prev WHERE op = 'L2pDelete' OR pba IS DISTINCT FROM prev_pba OR salt IS DISTINCT FROM prev_salt
        UNION ALL SELECT lsn, op_seq, vol_ord, lba, pba, salt, 1 FROM prev WHERE op <> 'L2pDelete' AND (pba IS DISTINCT FROM prev_pba OR salt IS DISTINCT FROM prev_salt)""",
    "pmoves": """SELECT lsn, op_seq, pba, sum(d)::BIGINT AS delta FROM tmoves m WHERE pba IS NOT NULL AND NOT EXISTS (
        SELECT 1 FROM snapped s JOIN snaps c ON c.id = s.snap_id WHERE s.vol_ord = m.vol_ord AND s.lba = m.lba AND s.pba = m.pba AND s.salt = m.salt AND c.created_lsn < m.lsn) GROUP BY ALL HAVING sum(d) <> 0""",
    "prunning": "SELECT *, (sum(delta) OVER (PARTITION BY pba ORDER BY lsn, op_seq))::BIGINT AS rc FROM pmoves",
    "ctuples": "SELECT vol_ord, lba, pba, salt FROM tuples UNION SELECT 4, lba, pba, salt FROM cloned",
    "cclosed": "SELECT pba, count(*) AS rc FROM ctuples GROUP BY pba",
    "counts": """SELECT event_id + 1 AS lsn, CASE WHEN event_type = 'click' THEN 'Decref' ELSE 'Incref' END AS op, json_extract_string(props, '$.k')::BIGINT AS pba, 1 + event_id % 3 AS delta FROM events""",
    "counted": "SELECT *, (sum(CASE WHEN op = 'Incref' THEN delta ELSE -delta END) OVER (PARTITION BY pba ORDER BY lsn))::BIGINT AS rc FROM counts",
    "full_samples": "SELECT b * 60000 AS ts_ms, " + ", ".join(f"(sum({n}) OVER (ORDER BY b))::BIGINT AS {n}" for n in tables.FULL_COUNTERS) + " FROM (SELECT floor(event_id / 500)::BIGINT AS b, " + ", ".join(f"coalesce(sum({by if by == '1' else 'round(value * 100)::BIGINT'}) FILTER (event_type IN ({', '.join(repr(k) for k in kinds.split())})), 0) AS {n}" for n, (kinds, by) in tables.FULL_COUNTERS.items()) + " FROM events GROUP BY 1)",
}
_NEEDS = {"snaps": "op_log", "live": "op_log", "snapped": "op_log snaps", "prev": "op_log", "moves": "prev", "running": "moves", "rcs": "moves", "tuples": "live snapped", "closed": "tuples", "dtop": "dlog", "dlive": "dtop", "reverse": "dlog", "layered": "dlog", "clog": "op_log snaps", "cloned": "clog", "vals": "op_log", "keys": "op_log", "asked": "op_log", "tmoves": "prev", "pmoves": "tmoves snapped", "prunning": "pmoves", "ctuples": "tuples cloned", "cclosed": "ctuples", "counted": "counts"}


def _with(names: str, body: str) -> str:
    need: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, "").split():
            add(n)
        if name not in need:
            need.append(name)

    for n in names.split():
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in need) + "\n" + body


def query(ctes: str = "", sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = _with(ctes, sql) if ctes else sql
        return f

    return put


log, snaps, dlog = tables.op_log, tables.snapshots, tables.dedup_log


def _keys(s: SparkSession, d: str) -> DataFrame:
    """Every block that the log names, and as many of volumes that it does not."""
    known = log(s, d).select("vol_ord", "lba").distinct()
    return known.select(F.explode(F.array("vol_ord", F.col("vol_ord") + 8)).alias("vol_ord"), "lba").select((F.col("lba") * 16 + F.col("vol_ord")).alias("pos"), "vol_ord", "lba")


def _asked(s: SparkSession, d: str) -> DataFrame:
    """Every address that the log names, and as many that it does not."""
    known = log(s, d).select("pba").where("pba is not null").distinct()
    return known.select("pba", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("k")).select((2 * F.col("pba") + F.col("k")).alias("pos"), (F.col("pba") + F.col("k") * 1_000_000).alias("pba"))


# Block maps.


@query("live", "SELECT * FROM live")
def l2p_current(s, d):
    return state.l2p_at(log(s, d))


@query("op_log", "SELECT * EXCLUDE (rn, op) FROM (SELECT vol_ord, lba, pba, salt, lsn, op, row_number() OVER (PARTITION BY vol_ord, lba ORDER BY lsn DESC) AS rn FROM op_log WHERE lsn <= (SELECT max(lsn) // 2 FROM op_log)) WHERE rn = 1 AND op <> 'L2pDelete'")
def l2p_as_of(s, d):
    return state.l2p_at(log(s, d), tables.last_lsn(log(s, d)) // 2)


@query("live", "SELECT lba, pba, salt FROM live WHERE vol_ord = 0 AND lba = 3")
def l2p_get(s, d):
    return state.l2p_at(log(s, d).where("vol_ord = 0 and lba = 3")).select("lba", "pba", "salt")


@query("live keys", "SELECT pos, vol_ord, lba, pba, salt FROM keys LEFT JOIN live USING (vol_ord, lba)")
def l2p_multi_get(s, d):
    return state.multi_get(state.l2p_at(log(s, d)), _keys(s, d), state.KEY, state.VALUE)


@query("live", "SELECT * FROM live WHERE vol_ord = 2 AND lba >= 5 AND lba < 25")
def l2p_range(s, d):
    return state.l2p_range(state.l2p_at(log(s, d)), 2, 5, 25)


@query("live", "SELECT * FROM live WHERE vol_ord = 2 AND lba BETWEEN 5 AND 30 ORDER BY lba LIMIT 7")
def l2p_range_limit(s, d):
    return state.l2p_range(state.l2p_at(log(s, d)), 2, 5, 30, inclusive=True, limit=7)


@query("prev", "SELECT lsn, op, vol_ord, lba, pba, salt, prev_pba, prev_salt FROM prev")
def l2p_prev_image(s, d):
    return state.with_previous(log(s, d)).drop("op_seq")


@query("op_log", "SELECT DISTINCT vol_ord AS ord FROM op_log UNION SELECT 0")
def volumes_list(s, d):
    return state.volumes(log(s, d))


@query("snaps", "SELECT * FROM snaps")
def snapshots_list(s, d):
    return snaps(s, d).orderBy("id")


@query("snapped", "SELECT snap_id, vol_ord, lba, pba, salt FROM snapped")
def snapshot_views(s, d):
    return state.l2p_at_snapshots(log(s, d), snaps(s, d))


@query("snapped", "SELECT lba, pba, salt FROM snapped WHERE snap_id = 2 AND lba = 5")
def snapshot_get(s, d):
    return snapshot.snapshot_map(log(s, d).where("lba = 5"), snaps(s, d), 2).select("lba", "pba", "salt")


@query("snapped", "SELECT lba, pba, salt FROM snapped WHERE snap_id = 3 AND lba >= 5 AND lba < 25")
def snapshot_range(s, d):
    return state.l2p_range(snapshot.snapshot_map(log(s, d), snaps(s, d), 3), 1, 5, 25).select("lba", "pba", "salt")


@query("op_log snaps", "SELECT (SELECT max(lsn) FROM op_log) AS last_lsn, (SELECT count(DISTINCT vol_ord) FROM op_log) AS volumes, (SELECT count(*) FROM snaps) AS snapshots, (SELECT max(created_lsn) FROM snaps) AS last_snapshot_lsn")
def ledger_summary(s, d):
    """High-water marks of the log and its catalog."""
    of_log = log(s, d).agg(F.max("lsn").alias("last_lsn"), F.count_distinct("vol_ord").alias("volumes"))
    return of_log.crossJoin(F.broadcast(snaps(s, d).agg(F.count(F.lit(1)).alias("snapshots"), F.max("created_lsn").alias("last_snapshot_lsn"))))


_DIFF = "SELECT coalesce(a.lba, b.lba) AS lba, CASE WHEN a.lba IS NULL THEN 'AddedInB' WHEN b.lba IS NULL THEN 'RemovedInB' ELSE 'Changed' END AS kind, a.pba AS old_pba, a.salt AS old_salt, b.pba AS new_pba, b.salt AS new_salt FROM {a} a FULL JOIN {b} b ON a.lba = b.lba WHERE a.lba IS NULL OR b.lba IS NULL OR a.pba <> b.pba OR a.salt <> b.salt"
_S1_S2 = _DIFF.format(a="(SELECT * FROM snapped WHERE snap_id = 1)", b="(SELECT * FROM snapped WHERE snap_id = 2)")


@query("snapped", _S1_S2)
def snapshot_diff(s, d):
    return snapshot.snapshot_diff(log(s, d), snaps(s, d), 1, 2)


@query("snapped live", _DIFF.format(a="(SELECT * FROM snapped WHERE snap_id = 3)", b="(SELECT * FROM live WHERE vol_ord = 1)"))
def diff_with_current(s, d):
    return snapshot.diff_with_current(log(s, d), snaps(s, d), 3)


@query("snapped", f"SELECT kind, count(*) AS n FROM ({_S1_S2}) GROUP BY kind")
def diff_summary(s, d):
    return snapshot_diff(s, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# Reference counts.


@query("rcs", "SELECT * FROM rcs")
def refcount_current(s, d):
    return refcount.current(log(s, d))


@query("rcs asked", "SELECT pos, pba, coalesce(rc, 0) AS rc FROM asked LEFT JOIN rcs USING (pba)")
def refcount_multi_get(s, d):
    return state.multi_get(refcount.current(log(s, d)), _asked(s, d), ["pba"], ["rc"]).na.fill(0, ["rc"])


@query("rcs", "SELECT 17::BIGINT AS pba, coalesce((SELECT rc FROM rcs WHERE pba = 17), 0) AS rc")
def refcount_get(s, d):
    asked = s.range(1).select(F.lit(0).alias("pos"), F.lit(17).cast("long").alias("pba"))
    return state.multi_get(refcount.current(log(s, d)), asked, ["pba"], ["rc"]).na.fill(0, ["rc"]).drop("pos")


@query("rcs", "SELECT * FROM rcs WHERE pba BETWEEN 20 AND 60")
def refcount_range(s, d):
    return refcount.current(log(s, d)).where("pba between 20 and 60").orderBy("pba")


@query("counted", "SELECT pba, sum(CASE WHEN op = 'Incref' THEN delta ELSE -delta END)::BIGINT AS rc FROM counts GROUP BY pba HAVING sum(CASE WHEN op = 'Incref' THEN delta ELSE -delta END) > 0")
def refcount_explicit(s, d):
    """Counts of a log of explicit increments and decrements."""
    return refcount.current(tables.count_log(s, d))


@query("counted", "SELECT lsn, pba, rc FROM counted WHERE rc < 0")
def refcount_underflows(s, d):
    """Where that log would take a count below zero, which a ledger refuses."""
    return refcount.underflows(tables.count_log(s, d)).select("lsn", "pba", "rc")


@query("running", "SELECT * FROM running")
def refcount_running(s, d):
    return refcount.running(log(s, d))


@query("running rcs", "SELECT pba, any_value(rcs.rc) AS rc, max(lsn) AS birth_lsn FROM running r JOIN rcs USING (pba) WHERE r.rc > 0 AND r.rc = delta GROUP BY pba")
def refcount_birth(s, d):
    return refcount.births(log(s, d))


@query("running", "SELECT lsn, op_seq, pba FROM running WHERE rc = 0 AND delta < 0")
def pba_freed_events(s, d):
    return refcount.freed(log(s, d))


@query("closed", "SELECT * FROM closed")
def refcount_closed_form(s, d):
    return refcount.closed_form(log(s, d), snaps(s, d))


@query("closed rcs", "SELECT pba, coalesce(r.rc, 0) AS live_rc, coalesce(c.rc, 0) AS audit_rc, coalesce(c.rc, 0) - coalesce(r.rc, 0) AS pinned_only FROM closed c FULL JOIN rcs r USING (pba)")
def refcount_audit(s, d):
    return refcount.audit(log(s, d), snaps(s, d))


@query("closed rcs", "SELECT pba, c.rc AS audit_rc, coalesce(r.rc, 0) AS stored_rc FROM closed c FULL JOIN rcs r USING (pba) WHERE coalesce(c.rc, 0) <> coalesce(r.rc, 0) ORDER BY pba LIMIT 8")
def refcount_audit_witnesses(s, d):
    return refcount.witnesses(log(s, d), snaps(s, d), refcount.current(log(s, d))).drop("tuples")


@query("rcs", "SELECT sum(rc)::BIGINT AS total FROM rcs")
def refcount_sum(s, d):
    return refcount.current(log(s, d)).agg(F.sum("rc").alias("total"))


@query("moves", "SELECT (SELECT sum(delta) FROM moves WHERE lsn <= cut)::BIGINT AS before, (SELECT sum(delta) FROM moves WHERE lsn > cut)::BIGINT AS change, (SELECT sum(delta) FROM moves)::BIGINT AS after FROM (SELECT max(lsn) // 2 AS cut FROM op_log)")
def refcount_conservation(s, d):
    cut = tables.last_lsn(log(s, d)) // 2
    early = F.col("lsn") <= cut
    return refcount.deltas(log(s, d)).agg(F.sum(F.when(early, F.col("delta"))).alias("before"), F.sum(F.when(~early, F.col("delta"))).alias("change"), F.sum("delta").alias("after"))


@query("cclosed", "SELECT pba, rc AS stored_rc, rc AS audit_rc FROM cclosed")
def refcount_audit_clones(s, d):
    """Sums of changes under the snapshots' pins against the closed form, with a clone: equal for every address."""
    return refcount.audit_stored(tables.whole_log(s, d), snaps(s, d))


@query("tuples", "SELECT pba, count(*) AS rc FROM (SELECT * FROM tuples WHERE vol_ord <> 2) GROUP BY pba")
def refcount_dropped_volume(s, d):
    """Counts after volume 2, which has no snapshot, was dropped at the end of the log."""
    top = tables.last_lsn(log(s, d))
    catalog = tables.clone_catalog(s, d).where("ord < 4").withColumn("dropped_lsn", F.when(F.col("ord") == 2, F.lit(top).cast("long")))
    return refcount.current(state.with_inherited(log(s, d), catalog), snaps(s, d))


# Remaps, range deletes, drops, clones.


@query("prev prunning", "SELECT p.lsn, p.op_seq, op, vol_ord, lba, prev_pba, prev_salt, r.pba AS freed_pba FROM prev p LEFT JOIN (SELECT * FROM prunning WHERE rc = 0 AND delta < 0) r ON p.lsn = r.lsn AND p.op_seq = r.op_seq")
def remap_outcomes_pinned(s, d):
    """Outcomes while three snapshots live: what one pins is not freed."""
    return remap.outcomes(log(s, d), snaps(s, d))


@query("cloned", "SELECT lba, pba, salt, (row_number() OVER (ORDER BY lba) - 1) // 65536 AS chunk FROM cloned WHERE lba >= 4 AND lba < 30")
def range_delete_clone(s, d):
    """What a range delete on a clone captures: inherited blocks too."""
    return remap.range_delete_plan(_clone(s, d), 4, 30).drop("op_seq")


@query("cclosed", "SELECT g.pba, count(*) AS decrefs, any_value(rc) AS rc_before, any_value(rc) - count(*) AS rc_after, any_value(rc) = count(*) AS freed FROM (SELECT vol_ord, lba, pba, salt FROM snapped WHERE snap_id = 3 EXCEPT (SELECT vol_ord, lba, pba, salt FROM live UNION SELECT vol_ord, lba, pba, salt FROM snapped WHERE snap_id <> 3)) g JOIN cclosed USING (pba) GROUP BY g.pba")
def drop_snapshot_clone_held(s, d):
    """Dropping the snapshot that a clone came from: addresses that the clone maps are not freed."""
    return snapshot.drop_decrefs(tables.whole_log(s, d), snaps(s, d), 3)


@query("prev running", "SELECT p.lsn, p.op_seq, op, vol_ord, lba, prev_pba, prev_salt, r.pba AS freed_pba FROM prev p LEFT JOIN (SELECT * FROM running WHERE rc = 0 AND delta < 0) r ON p.lsn = r.lsn AND p.op_seq = r.op_seq")
def remap_outcomes(s, d):
    return remap.outcomes(log(s, d))


@query("moves", "SELECT lsn // 64 AS record, pba, delta > 0 AS adds, sum(delta)::BIGINT AS delta, count(*) AS ops FROM moves GROUP BY ALL")
def remap_coalesced(s, d):
    """Records of 64 operations."""
    return remap.coalesced(log(s, d), F.expr("lsn div 64").alias("record"))


@query("live", "SELECT lba, pba, salt, (row_number() OVER (ORDER BY lba) - 1) // 65536 AS chunk FROM live WHERE vol_ord = 1 AND lba >= 4 AND lba < 30")
def range_delete_plan(s, d):
    return remap.range_delete_plan(state.l2p_at(log(s, d).where("vol_ord = 1")), 4, 30).drop("op_seq")


@query("live snapped rcs", "SELECT pba, count(*) AS decrefs, any_value(rc) - count(*) AS rc_after FROM live l JOIN rcs USING (pba) WHERE vol_ord = 0 AND lba >= 4 AND lba < 30 AND NOT EXISTS (SELECT 1 FROM snapped s WHERE s.vol_ord = l.vol_ord AND s.lba = l.lba AND s.pba = l.pba AND s.salt = l.salt) GROUP BY pba")
def range_delete_freed(s, d):
    plan = remap.range_delete_plan(state.l2p_at(log(s, d).where("vol_ord = 0")), 4, 30)
    return remap.range_delete_freed(log(s, d), state.l2p_at_snapshots(log(s, d), snaps(s, d)), plan, 0)


_DROP = "(SELECT vol_ord, lba, pba, salt FROM snapped WHERE snap_id = 1 EXCEPT (SELECT vol_ord, lba, pba, salt FROM live UNION SELECT vol_ord, lba, pba, salt FROM snapped WHERE snap_id <> 1))"


@query("closed", f"SELECT g.pba, count(*) AS decrefs, any_value(rc) AS rc_before, any_value(rc) - count(*) AS rc_after, any_value(rc) = count(*) AS freed FROM {_DROP} g JOIN closed USING (pba) GROUP BY g.pba")
def drop_snapshot_decrefs(s, d):
    return snapshot.drop_decrefs(log(s, d), snaps(s, d), 1)


@query("closed", f"SELECT g.pba FROM {_DROP} g JOIN closed USING (pba) GROUP BY g.pba HAVING any_value(rc) = count(*)")
def drop_snapshot_freed(s, d):
    return snapshot.drop_decrefs(log(s, d), snaps(s, d), 1).where("freed").select("pba")


def _clone(s: SparkSession, d: str) -> DataFrame:
    return state.clone_view(log(s, d).unionByName(tables.clone_log(s, d)), tables.clone_catalog(s, d), 4)


@query("cloned", "SELECT lba, pba, salt FROM cloned")
def clone_read(s, d):
    return _clone(s, d).select("lba", "pba", "salt")


@query("cloned live", _DIFF.format(a="(SELECT * FROM live WHERE vol_ord = 1)", b="cloned"))
def clone_diverged(s, d):
    return snapshot.diff(state.l2p_at(log(s, d).where("vol_ord = 1")), _clone(s, d))


# Deduplication.


@query("dlive", "SELECT * FROM dlive")
def dedup_current(s, d):
    return dedup.current(dlog(s, d))


@query("dlive dlog", "SELECT pos, hash, d.pba AS pba FROM (SELECT doc_id AS pos, sha256(text) AS hash FROM documents) k LEFT JOIN dlive d USING (hash)")
def dedup_get_multi(s, d):
    keys = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("pos"), F.sha2("text", 256).alias("hash"))
    return state.multi_get(dedup.current(dlog(s, d)), keys, ["hash"], ["pba"])


@query("dlive", "SELECT hash, pba FROM dlive WHERE hash = (SELECT sha256(text) FROM documents WHERE doc_id = 7)")
def dedup_get(s, d):
    key = s.read.parquet(f"{d}/documents.parquet").where("doc_id = 7").select(F.sha2("text", 256).alias("hash")).first()
    return dedup.current(dlog(s, d).where(F.col("hash") == key.hash)).select("hash", "pba")


@query("dtop", "SELECT hash, lsn FROM dtop WHERE op = 'DedupDelete'")
def dedup_tombstones(s, d):
    return dedup.tombstones(dlog(s, d))


@query("reverse", "SELECT pba, hash FROM reverse WHERE pba = 42")
def dedup_reverse_scan(s, d):
    return dedup.reverse_current(tables.reverse_log(s, d)).where("pba = 42")


@query("reverse asked", "SELECT pos, a.pba AS pba, array_to_string(list_sort(list(hash) FILTER (hash IS NOT NULL)), ',') AS hashes FROM asked a LEFT JOIN reverse r USING (pba) GROUP BY ALL")
def dedup_reverse_multi(s, d):
    out = dedup.reverse_scan(dedup.reverse_current(tables.reverse_log(s, d)), _asked(s, d))
    return out.withColumn("hashes", F.when(F.size("hashes") > 0, F.array_join("hashes", ",")))


_CLEAN = "SELECT r.pba, r.hash, d.pba AS forward_pba, coalesce(d.pba = r.pba, false) AS delete_forward FROM reverse r LEFT JOIN dlive d USING (hash) WHERE r.pba IN (SELECT doc_id FROM labels WHERE toxic = 1)"


@query("reverse dlive", _CLEAN)
def cleanup_plan(s, d):
    dead = s.read.parquet(f"{d}/labels.parquet").where("toxic = 1").select(F.col("doc_id").alias("pba"))
    return dedup.cleanup_plan(dedup.current(dlog(s, d)), dedup.reverse_current(tables.reverse_log(s, d)), dead)


@query("reverse dlive", f"SELECT pba, hash, forward_pba FROM ({_CLEAN}) WHERE NOT delete_forward AND forward_pba IS NOT NULL")
def cleanup_race_kept(s, d):
    return cleanup_plan(s, d).where("not delete_forward and forward_pba is not null").select("pba", "hash", "forward_pba")


@query("layered", "SELECT hash, pba, layer FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY layer DESC) AS rn FROM layered WHERE starts_with(hash, 'a')) WHERE rn = 1 AND op = 'DedupPut'")
def lsm_shadow_scan(s, d):
    return dedup.scan_layers(tables.layers(s, d), "a")


@query("layered", "SELECT pos, prefix, hash, pba FROM (VALUES (0, '0a'), (1, 'f'), (2, '0a'), (3, 'zz')) p(pos, prefix) LEFT JOIN (SELECT hash, pba FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY layer DESC) AS rn FROM layered) WHERE rn = 1 AND op = 'DedupPut') v ON starts_with(hash, prefix)")
def dedup_prefix_multi(s, d):
    return dedup.scan_prefixes(tables.layers(s, d), s.createDataFrame([(0, "0a"), (1, "f"), (2, "0a"), (3, "zz")], "pos int, prefix string"))


@query("dlog", "SELECT 5 AS layer, hash, op, pba, lsn FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY lsn DESC) AS rn FROM dlog WHERE lsn > 100 AND lsn <= (SELECT max(lsn) // 2 FROM dlog)) WHERE rn = 1")
def lsm_flush(s, d):
    """The operations after lsn 100 up to half of the log as a new run."""
    return dedup.flush_run(dlog(s, d), 100, tables.last_lsn(dlog(s, d)) // 2, 5)


@query("layered", "SELECT hash, op, pba FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY layer DESC) AS rn FROM layered) WHERE rn = 1 AND op = 'DedupPut'")
def lsm_compaction_merge(s, d):
    return dedup.merge_layers(tables.layers(s, d), 1, 4, deepest=True)


@query("layered", "SELECT hash, op, pba FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY layer DESC) AS rn FROM layered WHERE layer >= 3) WHERE rn = 1")
def lsm_compaction_upper(s, d):
    return dedup.merge_layers(tables.layers(s, d), 3, 4, deepest=False)


_RUNS = "runs AS (SELECT CASE WHEN layer = 4 THEN 0 ELSE 1 END::INT AS level, layer * 16 + part AS run, min(hash) AS min_hash, max(hash) AS max_hash, count(*) AS records FROM (SELECT *, CASE WHEN layer = 4 THEN 0 ELSE (pba % 5)::INT END AS part FROM layered) GROUP BY layer, part)"


def _cut(s: SparkSession, d: str) -> DataFrame:
    """layers as files: the newest is a run of level 0, the others are cut into five of level 1."""
    part = F.when(F.col("layer") == 4, 0).otherwise((F.col("pba") % 5).cast("int"))
    return tables.layers(s, d).withColumns({"level": F.when(F.col("layer") == 4, 0).otherwise(1), "run": F.col("layer") * 16 + part})


def _runs(s: SparkSession, d: str) -> DataFrame:
    return _cut(s, d).groupBy("level", "run").agg(F.min("hash").alias("min_hash"), F.max("hash").alias("max_hash"), F.count(F.lit(1)).alias("records"))


@query()
def lsm_compaction_candidates(s, d):
    return dedup.compaction_candidates(_runs(s, d), 0)


ORACLE_SQL["lsm_compaction_candidates"] = _with("layered", "").rstrip() + f",\n{_RUNS}\nSELECT a.run AS run, b.run AS below FROM runs a JOIN runs b ON a.level = 0 AND b.level = 1 AND a.min_hash <= b.max_hash AND b.min_hash <= a.max_hash"


@query("layered", "SELECT layer, count(*) AS records, count(*) FILTER (op = 'DedupDelete') AS deletes, min(hash) AS min_hash, max(hash) AS max_hash FROM layered GROUP BY layer")
def lsm_level_stats(s, d):
    return dedup.layer_stats(tables.layers(s, d))


@query("layered", "SELECT layer, count(*) AS records, count(*) FILTER (hash <= before) AS faults FROM (SELECT *, lag(hash) OVER (PARTITION BY layer ORDER BY lsn) AS before FROM layered) GROUP BY layer")
def lsm_order_check(s, d):
    """Runs whose rows lie in the order of the log, not of their hashes: many faults."""
    return dedup.order_report(tables.layers(s, d).withColumnRenamed("lsn", "pos"))


@query()
def lsm_maintenance(s, d):
    """The run that one round of compaction makes: all of level 0 with what overlaps in level 1."""
    layers = _cut(s, d)
    merged, _, _ = dedup.maintain(layers, _runs(s, d), l0_trigger=1)
    return merged


ORACLE_SQL["lsm_maintenance"] = (
    _with("layered", "").rstrip()
    + f""",
{_RUNS},
due AS (SELECT run FROM runs WHERE level = 0 UNION SELECT b.run FROM runs a JOIN runs b ON a.level = 0 AND b.level = 1 AND a.min_hash <= b.max_hash AND b.min_hash <= a.max_hash)
SELECT 1 AS level, hash, op, pba, lsn FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY lsn DESC) AS rn FROM layered JOIN due ON due.run = layer * 16 + CASE WHEN layer = 4 THEN 0 ELSE pba % 5 END) WHERE rn = 1 AND op = 'DedupPut'"""
)


# The log.


@query("op_log", "SELECT op, count(*) AS ops, count(DISTINCT lsn) AS records, min(lsn) AS first_lsn, max(lsn) AS last_lsn FROM op_log GROUP BY op")
def wal_op_counts(s, d):
    return audit.op_counts(log(s, d))


@query("op_log", "SELECT lsn // 32 AS lsn, count(*) AS ops, string_agg(op, ',' ORDER BY lsn) AS kinds FROM op_log GROUP BY 1")
def wal_record_list(s, d):
    """Transactions of 32 operations: they share one lsn and follow op_seq."""
    rows = log(s, d).select(F.expr("lsn div 32").alias("lsn"), F.col("lsn").cast("int").alias("op_seq"), "op")
    return audit.records(rows)


@query("", "SELECT arrived, lsn FROM (SELECT *, lag(lsn) OVER (ORDER BY arrived) AS before FROM (SELECT event_id AS arrived, CASE WHEN event_id % 97 = 50 THEN event_id - 2 ELSE event_id END AS lsn FROM events)) WHERE lsn <= before")
def wal_monotonic_check(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("arrived"))
    return audit.order_report(e.withColumn("lsn", F.when(F.col("arrived") % 97 == 50, F.col("arrived") - 2).otherwise(F.col("arrived"))), bucket=4096)


@query("op_log", "SELECT segment, min(lsn) AS first_lsn, max(lsn) AS last_lsn FROM (SELECT lsn // 1000 AS segment, lsn FROM op_log) GROUP BY 1 HAVING max(lsn) <= (SELECT max(lsn) * 3 // 5 FROM op_log)")
def wal_prunable_segments(s, d):
    segments = log(s, d).groupBy(F.expr("lsn div 1000").alias("segment")).agg(F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"))
    return audit.prunable(segments, tables.last_lsn(log(s, d)) * 3 // 5)


@query("live", "SELECT * FROM live")
def log_checkpoint_delta(s, d):
    """State as a checkpoint with the later part of the log on top equals the state of the whole log."""
    cut = tables.last_lsn(log(s, d)) // 2
    base = state.l2p_at(log(s, d), cut).withColumns({"op_seq": F.lit(0), "op": F.lit("L2pRemap")})
    return state.l2p_at(base.select("lsn", "op_seq", "op", "vol_ord", "lba", "pba", "salt").unionByName(log(s, d).where(F.col("lsn") > cut)))


# Metrics.


@query("", "SELECT count(*) AS n, avg(v) AS avg, max(v) FILTER (rn = round((n - 1) * 0.5) + 1) AS p50, max(v) FILTER (rn = round((n - 1) * 0.95) + 1) AS p95, max(v) FILTER (rn = round((n - 1) * 0.99) + 1) AS p99, max(v) AS max FROM (SELECT v, row_number() OVER (ORDER BY v) AS rn, count(*) OVER () AS n FROM (SELECT round(value * 100)::BIGINT AS v FROM events))")
def latency_summary(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select(F.round(F.col("value") * 100).cast("long").alias("v"))
    return metrics.latency_summary(e, "v")


_RATES = "SELECT ms / 1000.0::DOUBLE AS seconds, c AS commit_success_delta, w AS wal_batches_delta, k AS wal_records_delta, c / (ms / 1000.0::DOUBLE) AS commit_success_rate, w / (ms / 1000.0::DOUBLE) AS wal_batches_rate, k / (ms / 1000.0::DOUBLE) AS wal_records_rate FROM (SELECT max(ts_ms) - min(ts_ms) AS ms, max(commit_success) - min(commit_success) AS c, max(wal_batches) - min(wal_batches) AS w, max(wal_records) - min(wal_records) AS k FROM (SELECT * FROM samples ORDER BY ts_ms DESC LIMIT 10))"


@query("samples", _RATES)
def metrics_rates(s, d):
    return metrics.rates(tables.metric_samples(s, d), 10, ["commit_success", "wal_batches", "wal_records"])


@query("samples", f"SELECT commits, wal_batch, CASE WHEN commits <= 0 THEN '{metrics.NO_COMMITS}' WHEN wal_batch < 8 THEN 'wal batches are small' ELSE '{metrics.NO_HINT}' END AS hints FROM (SELECT commit_success_delta AS commits, wal_records_delta / wal_batches_delta AS wal_batch FROM ({_RATES}))")
def metrics_hints(s, d):
    r = metrics_rates(s, d)
    report = r.select(F.col("commit_success_delta").alias("commits"), metrics.per_event(F.col("wal_records_delta"), F.col("wal_batches_delta")).alias("wal_batch"))
    return metrics.hints(report).withColumn("hints", F.array_join("hints", "; "))


_GROWN = sorted({c for _, c in metrics.RATES} | {c for _, *both in metrics.MEANS for c in both})
_REPORT_SQL = f"""SELECT *, {", ".join(f"100 * {of} / greatest(commit_us, 1.0) AS {name}" for name, of in metrics.SHARES)} FROM (
    SELECT seconds, _commit_success AS commits, {", ".join(f"_{c} / seconds AS {name}" for name, c in metrics.RATES)},
        {", ".join(f"CASE WHEN _{b} > 0 THEN _{a} / _{b} ELSE 0.0::DOUBLE END AS {name}" for name, a, b in metrics.MEANS)}, {", ".join(f"0::BIGINT AS {c}" for c in metrics.LAST)}
    FROM (SELECT (max(ts_ms) - min(ts_ms)) / 1000.0::DOUBLE AS seconds, {", ".join(f"max({c}) - min({c}) AS _{c}" if c in tables.FULL_COUNTERS else f"0::BIGINT AS _{c}" for c in _GROWN)}
        FROM (SELECT * FROM full_samples ORDER BY ts_ms DESC LIMIT 10)))"""


@query("full_samples", _REPORT_SQL)
def metrics_report(s, d):
    return metrics.report(tables.full_samples(s, d), 10)


@query("full_samples", "SELECT commits, list_aggregate([" + ", ".join(f"CASE WHEN {c} {sign} {x} THEN '{text}' END" for c, x, sign, text in metrics.HINTS) + f"], 'string_agg', '; ') AS hints FROM ({_REPORT_SQL})")
def metrics_all_hints(s, d):
    """All nine rules over the full report."""
    return metrics.hints(metrics_report(s, d)).select("commits", F.array_join("hints", "; ").alias("hints"))


_RUN_SQL = "SELECT event_type AS scenario, count(*) AS ops, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS items, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS ms FROM events GROUP BY 1"


@query("", f"SELECT scenario, ops, items, ms, ops / (ms / 1000.0::DOUBLE) AS ops_per_s, items / (ms / 1000.0::DOUBLE) AS items_per_s FROM ({_RUN_SQL})")
def throughput_report(s, d):
    """Operations and items of each kind of event over the time it was seen in."""
    e = s.read.parquet(f"{d}/events.parquet").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return metrics.throughput(e.groupBy(F.col("event_type").alias("scenario")).agg(F.count(F.lit(1)).alias("ops"), F.sum("k").alias("items"), F.expr("(max(us) - min(us)) div 1000").alias("ms")))


@query("samples", "SELECT ts_ms, greatest(wal_records - lag(wal_records) OVER (ORDER BY ts_ms), 0) AS records FROM samples QUALIFY lag(wal_records) OVER (ORDER BY ts_ms) IS NOT NULL")
def metrics_deltas(s, d):
    out = running.previous(tables.metric_samples(s, d), [], ["ts_ms"], ["wal_records"], bucket_by="ts_ms", bucket=60_000 * running.BUCKET)
    return out.where("prev_wal_records is not null").select("ts_ms", metrics.saturating_delta(F.col("wal_records"), F.col("prev_wal_records")).alias("records"))


@query("", "SELECT a.event_type AS scenario, a.v AS a, b.v AS b, a.v / b.v AS ratio, CASE WHEN a.v >= b.v THEN 'a' ELSE 'b' END AS winner FROM (SELECT event_type, count(*)::DOUBLE AS v FROM events WHERE user_id % 2 = 0 GROUP BY 1) a JOIN (SELECT event_type, count(*)::DOUBLE AS v FROM events WHERE user_id % 2 = 1 GROUP BY 1) b USING (event_type)")
def backend_compare(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    a, b = (e.where(F.col("user_id") % 2 == k).groupBy(F.col("event_type").alias("scenario")).agg(F.count(F.lit(1)).cast("double").alias("ops_per_s")) for k in (0, 1))
    return metrics.compare(a, b)


# Values, units, checks.


@query("vals", "SELECT vol_ord, lba >> 3 AS leaf, count(*) AS entries, count(DISTINCT (pba, compression)) AS units, 402 + 26 * count(DISTINCT (pba, compression)) AS bytes, round(3600.0 / (402 + 26 * count(DISTINCT (pba, compression))), 4)::DOUBLE AS gain FROM (SELECT v.* FROM vals v JOIN (SELECT vol_ord, lba, max(lsn) AS lsn FROM op_log GROUP BY ALL) USING (vol_ord, lba, lsn)) GROUP BY ALL")
def unit_dictionary_stats(s, d):
    live = state.l2p_at(log(s, d)).select("vol_ord", "lba", F.col("pba").alias("unit_pba"), F.col("salt").alias("unit_salt"))
    return audit.unit_stats(live, 3)


@query("vals", "SELECT lsn, pba, (CASE WHEN slot_offset > 0 OR unit_compressed_size < 4096 THEN 1 ELSE ceil(unit_compressed_size / 4096.0) END)::BIGINT AS blocks FROM vals")
def released_blocks(s, d):
    return tables.full_values(s, d).select("lsn", "pba", codec.released_blocks(F.col("slot_offset"), F.col("unit_compressed_size")).alias("blocks"))


@query("vals", "SELECT * FROM vals")
def value_codec_round_trip(s, d):
    """Packed to 28 bytes and unpacked again."""
    v = tables.full_values(s, d)
    raw = v.select("lsn", "vol_ord", "lba", codec.pack_value(F.struct(*(n for n, _ in codec.FIELDS))).alias("raw"))
    back = raw.where("length(raw) = 28").select("lsn", "vol_ord", "lba", codec.unpack_value("raw").alias("v"))
    kinds = dict(v.dtypes)
    return back.select("lsn", "vol_ord", "lba", *(F.col(f"v.{n}").cast(kinds[n]).alias(n) for n, _ in codec.FIELDS))


@query("rcs running", "SELECT DISTINCT pba FROM running EXCEPT SELECT pba FROM rcs EXCEPT SELECT pba FROM running WHERE rc = 0 AND pba % 2 = 0")
def orphan_detection(s, d):
    """Addresses ever used, less those in use, less a free list of the even ones."""
    r = refcount.running(log(s, d))
    return audit.orphans(r.select("pba").distinct(), refcount.current(log(s, d)).select("pba"), r.where("rc = 0 and pba % 2 = 0").select("pba").distinct())


_AT_90 = "SELECT vol_ord, lba, pba, salt FROM (SELECT *, row_number() OVER (PARTITION BY vol_ord, lba ORDER BY lsn DESC) AS rn FROM op_log WHERE lsn <= (SELECT max(lsn) * 9 // 10 FROM op_log)) WHERE rn = 1 AND op <> 'L2pDelete'"


@query("live", f"SELECT child, coalesce(in_degree, 0) AS in_degree, coalesce(rc, 0) AS rc FROM (SELECT pba AS child, count(*) AS in_degree FROM live GROUP BY 1) FULL JOIN (SELECT pba AS child, count(*) AS rc FROM ({_AT_90}) GROUP BY 1) USING (child) WHERE coalesce(in_degree, 0) <> coalesce(rc, 0)")
def edge_count_check(s, d):
    """Edges of the live maps against counts that stopped at nine tenths of the log: the check finds what has changed since."""
    edges = state.l2p_at(log(s, d)).select(F.col("lba").alias("parent"), F.col("pba").alias("child"))
    early = log(s, d).where(F.col("lsn") <= tables.last_lsn(log(s, d)) * 9 // 10)
    return audit.edge_faults(edges, refcount.current(early).withColumnRenamed("pba", "child"))


@query("live", f"SELECT *, 'a' AS side FROM (SELECT vol_ord, lba, pba, salt FROM live EXCEPT {_AT_90}) UNION ALL SELECT *, 'b' FROM (({_AT_90}) EXCEPT SELECT vol_ord, lba, pba, salt FROM live)")
def model_equality(s, d):
    """The live map against one by another way (changes of a snapshot on top of it), which stops at nine tenths of the log: the rows of one side only."""
    cut = tables.last_lsn(log(s, d)) * 9 // 10
    names = ["vol_ord", "lba", "pba", "salt"]
    spine = s.createDataFrame([(k, k, cut) for k in range(4)], "id long, vol_ord int, created_lsn long")
    return audit.differences(state.l2p_at(log(s, d)).select(*names), state.l2p_at_snapshots(log(s, d), spine).select(*names))


@query("vals live", "SELECT vol_ord, lba, printf('%016x%02x%08x%08x%04x%04x%08x%04x%02x', pba, compression, unit_compressed_size, unit_original_size, unit_lba_count, offset_in_unit, crc32, slot_offset, flags) AS value FROM (SELECT v.* FROM vals v JOIN live USING (vol_ord, lba, lsn))")
def dump_values(s, d):
    """The live maps as a dump shows them: values of 28 bytes in hex."""
    live = state.l2p_at(log(s, d)).select("vol_ord", "lba", "lsn")
    v = tables.full_values(s, d).join(live, ["vol_ord", "lba", "lsn"])
    return v.select("vol_ord", "lba", F.lower(F.hex(codec.pack_value(F.struct(*(n for n, _ in codec.FIELDS))))).alias("value"))


@query("live", "SELECT vol_ord, lba, pba, salt FROM live")
def wal_replay_state(s, d):
    """The log as binary segments, read back from them, decoded and applied."""
    value = wal.pack(F.col("pba"), F.col("salt"))
    ops = log(s, d).select("lsn", "op_seq", "op", "vol_ord", "lba", F.when(F.col("pba").isNotNull(), value).alias("value"))
    return state.l2p_at(wal.to_log(wal.through_segments(ops))).select("vol_ord", "lba", "pba", "salt")


# One step an operation, in order. m holds each block's value as pba * 4 + salt (-1: none), c each address's count.
_GUARDED = """WITH RECURSIVE glog AS MATERIALIZED (SELECT event_id + 1 AS lsn, (user_id % 4)::INT AS vol_ord, floor(user_id / 4)::BIGINT AS lba, event_type = 'error' AS gone,
        json_extract_string(props, '$.k')::BIGINT AS pba, event_id % 3 AS salt, event_type <> 'error' AND event_id % 2 = 0 AS guarded FROM events),
    sizes AS (SELECT max(lba) + 1 AS width, max(pba) + 2 AS addresses FROM glog),
    fold AS (SELECT 0::BIGINT AS lsn, list_transform(range(4 * width), lambda x: -1::BIGINT) AS m, list_transform(range(greatest(addresses, 101)), lambda x: 0::BIGINT) AS c, true AS applied FROM sizes
        UNION ALL
        SELECT lsn, CASE WHEN applied THEN list_transform(m, lambda x, i: CASE WHEN i = place THEN now ELSE x END) ELSE m END,
            CASE WHEN applied AND now <> was THEN list_transform(c, lambda x, i: x + (now >= 0 AND i = now // 4 + 1)::BIGINT - (was >= 0 AND i = was // 4 + 1)::BIGINT) ELSE c END, applied
        FROM (SELECT g.lsn, m, c, g.vol_ord * width + g.lba + 1 AS place, m[g.vol_ord * width + g.lba + 1] AS was, CASE WHEN gone THEN -1 ELSE pba * 4 + salt END AS now,
                NOT guarded OR c[(pba + 1) % 100 + 1] >= 1 + (g.lsn - 1) % 3 AS applied FROM fold f JOIN glog g ON g.lsn = f.lsn + 1, sizes))
    SELECT lsn, 0::INT AS op_seq, vol_ord, lba, CASE WHEN guarded THEN (pba + 1) % 100 END AS guard_pba, CASE WHEN guarded THEN 1 + (lsn - 1) % 3 END AS guard_min_rc, applied FROM glog JOIN (SELECT lsn, applied FROM fold) USING (lsn)"""


@query("", _GUARDED)
def guarded_remap(s, d):
    return remap.guarded(tables.guarded_log(s, d)).select("lsn", "op_seq", "vol_ord", "lba", "guard_pba", "guard_min_rc", "applied")


# Streams: read to their end and compared as tables.


def _event_stream(s: SparkSession, d: str) -> DataFrame:
    """events.parquet as a stream of files, whether it is one file or a folder of parts."""
    path = f"{d}/events.parquet"
    at = s.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    stream = s.readStream.schema(s.read.parquet(path).schema)
    return stream.parquet(path) if folder else stream.option("pathGlobFilter", "events.parquet").parquet(d)


def _followed(s: SparkSession, d: str) -> Tail:
    tail = Tail(s, shared_path(s, "tail"))
    tail.start(tables.op_log_of(_event_stream(s, d))).awaitTermination()
    return tail


@query("live", "SELECT vol_ord, lba, pba, salt FROM live")
def stream_tail_maps(s, d):
    return _followed(s, d).live()


@query("rcs", "SELECT * FROM rcs")
def stream_tail_counts(s, d):
    return _followed(s, d).counts()


@query("", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_op_windows(s, d):
    """All windows, as the end of the stream closes them: the sums of a stream in complete mode."""
    out = shared_path(s, "windows")
    plan = op_rate(_event_stream(s, d).withColumn("ts", F.col("ts").cast("timestamp")))
    plan.writeStream.outputMode("complete").foreachBatch(lambda b, k: b.write.mode("overwrite").parquet(f"{out}/{k}")).option("checkpointLocation", f"{out}-offsets").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{out}/{written(s, out)[-1]}").withColumn("start", F.col("start").cast("timestamp_ntz"))
