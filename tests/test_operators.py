"""Operators on handwritten and random logs, against the sequential fold."""

import random

import pytest
from ledgerlake.functions import codec, running
from ledgerlake.operators import audit, dedup, refcount, remap, snapshot, state
from ledgerlake.plans import metrics, work
from ledgerlake.sources.schema import SNAPSHOTS, VOLUMES
from pyspark.sql import functions as F

from tests.fold import Fold

LOG = "lsn long, op_seq int, op string, vol_ord int, lba long, pba long, salt long"


def log_of(spark, ops):
    return spark.createDataFrame([(i + 1, 0, *o) for i, o in enumerate(ops)], LOG)


def put(lba, pba, salt=0, vol=0):
    return ("L2pRemap", vol, lba, pba, salt)


def gone(lba, vol=0):
    return ("L2pDelete", vol, lba, None, None)


def snaps_of(spark, *rows):
    return spark.createDataFrame([(*r, None)[:4] for r in rows], SNAPSHOTS)


def rcs(df):
    return {r.pba: r.rc for r in df.collect()}


def freed(spark, ops):
    return [(r.lsn, r.pba) for r in refcount.freed(log_of(spark, ops)).orderBy("lsn", "pba").collect()]


def random_ops(seed, n, vols=3, lbas=12, pbas=9):
    rng = random.Random(seed)
    return [gone(rng.randrange(lbas), rng.randrange(vols)) if rng.random() < 0.2 else put(rng.randrange(lbas), rng.randrange(pbas), rng.randrange(2), rng.randrange(vols)) for _ in range(n)]


def fold_of(ops):
    f = Fold()
    for i, (op, vol, lba, pba, salt) in enumerate(ops):
        f.apply(i + 1, op, vol, lba, None if pba is None else (pba, salt))
    return f


# Handwritten scenarios: first remap, shared and packed addresses, same address with other bytes.


@pytest.mark.parametrize(
    "ops,rc,frees",
    [
        ([put(1, 10)], {10: 1}, []),
        ([put(1, 10), put(1, 10, 1)], {10: 1}, []),
        ([put(1, 10), put(1, 11)], {11: 1}, [(2, 10)]),
        ([put(1, 10), put(2, 10), put(1, 11)], {10: 1, 11: 1}, []),
        ([put(1, 10), put(2, 10), put(3, 10), gone(1), gone(2), gone(3)], {}, [(6, 10)]),
        ([put(1, 10), gone(1), put(1, 10), gone(1)], {}, [(2, 10), (4, 10)]),
        ([gone(5), put(1, 10), put(1, 10)], {10: 1}, []),
    ],
)
def test_counts(spark, ops, rc, frees):
    log = log_of(spark, ops)
    assert rcs(refcount.current(log)) == rc and freed(spark, ops) == frees
    f = fold_of(ops)
    assert {p: n for p, n in f.rc.items() if n} == rc and f.freed == frees


def test_counts_with_snapshots(spark):
    same_pba = [put(1, 10), put(1, 10, 1)]
    assert rcs(refcount.closed_form(log_of(spark, same_pba), snaps_of(spark, (1, 0, 1)))) == {10: 2}
    other_pba = [put(1, 10), put(1, 11)]
    assert rcs(refcount.closed_form(log_of(spark, other_pba), snaps_of(spark, (1, 0, 1)))) == {10: 1, 11: 1}
    out = snapshot.drop_decrefs(log_of(spark, other_pba), snaps_of(spark, (1, 0, 1)), 1).collect()
    assert [(r.pba, r.decrefs, r.rc_after, r.freed) for r in out] == [(10, 1, 0, True)]
    both = snaps_of(spark, (1, 0, 1), (2, 0, 1))  # two snapshots pin one tuple: the first drop frees nothing
    assert snapshot.drop_decrefs(log_of(spark, other_pba), both, 1).count() == 0
    assert snapshot.drop_releases(log_of(spark, other_pba), both, 1, current_only=True).count() == 1


@pytest.mark.parametrize("seed", range(4))
def test_random_logs_against_the_fold(spark, seed):
    ops = random_ops(seed, 300)
    log, f = log_of(spark, ops), fold_of(ops)
    assert {(r.vol_ord, r.lba): (r.pba, r.salt) for r in state.l2p_at(log).collect()} == f.maps
    assert rcs(refcount.current(log)) == {p: n for p, n in f.rc.items() if n}
    assert freed(spark, ops) == f.freed
    assert {r.pba: r.birth_lsn for r in refcount.births(log).collect()} == {p: b for p, b in f.birth.items() if f.rc[p]}
    got = {r.lsn: (None if r.prev_pba is None else (r.prev_pba, r.prev_salt), r.freed_pba) for r in remap.outcomes(log).collect()}
    assert got == {lsn: (prev, p) for lsn, prev, p in f.outcomes}
    cut = fold_of(ops[:120])
    assert {(r.vol_ord, r.lba): (r.pba, r.salt) for r in state.l2p_at(log, 120).collect()} == cut.maps
    s = snaps_of(spark, (1, 0, 60), (2, 1, 120), (3, 0, 200))
    tuples = set((k, v) for k, v in f.maps.items())
    for vol, at in ((0, 60), (1, 120), (0, 200)):
        tuples |= {(k, v) for k, v in fold_of(ops[:at]).maps.items() if k[0] == vol}
    want = {}
    for _, (p, _) in tuples:
        want[p] = want.get(p, 0) + 1
    assert rcs(refcount.closed_form(log, s)) == want
    audit_rows = {r.pba: (r.live_rc, r.audit_rc) for r in refcount.audit(log, s).collect()}
    assert all(audit_rows[p] == (f.rc.get(p, 0), n) for p, n in want.items())


@pytest.mark.parametrize("seed", range(3))
def test_counts_under_snapshots_clones_and_drops(spark, seed):
    """At every lsn the sums of changes are the closed form, by a fold that counts distinct tuples anew after each step."""
    rng, rows, snaps, volumes, maps, freed_at = random.Random(seed), [], {}, {k: (k, None, None, 0, None) for k in range(2)}, {}, []

    def counts():
        tuples = {(v, lba, x) for (v, lba), x in maps.items() if volumes[v][4] is None}
        tuples |= {(s["vol"], lba, x) for s in snaps.values() if s["dropped"] is None for lba, x in s["map"].items()}
        out = {}
        for _, _, (p, _) in tuples:
            out[p] = out.get(p, 0) + 1
        return out

    before, lsn = {}, 0
    while lsn < 160:
        live = [v for v in volumes if volumes[v][4] is None]
        kind, vol = rng.random(), rng.choice(live)
        if kind < 0.06:
            snaps[len(snaps) + 1] = {"vol": vol, "at": lsn, "dropped": None, "map": {lba: x for (v, lba), x in maps.items() if v == vol}}
        elif kind < 0.09 and snaps and len(volumes) < 6:
            s = rng.choice([*snaps.values()])
            if s["dropped"] is None:
                new = len(volumes)
                volumes[new] = (new, s["vol"], s["at"], lsn, None)
                maps.update({(new, lba): x for lba, x in s["map"].items()})
        elif kind < 0.12 and [s for s in snaps.values() if s["dropped"] is None]:
            lsn += 1
            rng.choice([s for s in snaps.values() if s["dropped"] is None])["dropped"] = lsn
        elif kind < 0.14 and vol > 0 and not any(s["vol"] == vol and s["dropped"] is None for s in snaps.values()):
            volumes[vol] = (*volumes[vol][:4], lsn)
            for key in [k for k in maps if k[0] == vol]:
                del maps[key]
        else:
            lsn += 1
            op = random_ops(rng.random(), 1, 1)[0]
            rows.append((lsn, 0, op[0], vol, *op[2:]))
            if op[0] == "L2pDelete":
                maps.pop((vol, op[2]), None)
            else:
                maps[vol, op[2]] = op[3:]
        after = counts()
        freed_at += [(lsn, p) for p in before if p not in after]
        before = after
    log = state.with_inherited(spark.createDataFrame(rows, LOG), spark.createDataFrame([*volumes.values()], VOLUMES))
    history = spark.createDataFrame([(k, s["vol"], s["at"], s["dropped"]) for k, s in snaps.items()], SNAPSHOTS)
    assert rcs(refcount.current(log, history)) == before == rcs(refcount.closed_form(log, history))
    assert sorted((r.lsn, r.pba) for r in refcount.freed(log, history).collect()) == sorted(freed_at)
    assert all(r.stored_rc == r.audit_rc for r in refcount.audit_stored(log, history).collect())
    assert refcount.underflows(log, history).count() == 0
    assert {(r.vol_ord, r.lba): (r.pba, r.salt) for r in state.l2p_at(log).collect()} == maps


def test_previous_values_across_buckets(spark):
    rng = random.Random(2)
    rows = [(k, rng.randrange(3), rng.randrange(9)) for k in range(150)]
    got = {r.lsn: r.prev_v for r in running.previous(spark.createDataFrame(rows, "lsn long, key int, v int"), ["key"], ["lsn"], ["v"], bucket=7).collect()}
    last = {}
    for lsn, key, v in rows:
        assert got[lsn] == last.get(key)
        last[key] = v


@pytest.mark.parametrize("seed", range(3))
def test_guards_against_the_fold(spark, seed):
    rng, f, rows, want = random.Random(seed), Fold(), [], {}
    for i in range(150):
        guard = (rng.randrange(6), rng.randrange(1, 4)) if rng.random() < 0.5 else None
        op = ("L2pRemap", rng.randrange(2), rng.randrange(8), rng.randrange(6), rng.randrange(2))
        rows.append((i + 1, 0, *op, *(guard or (None, None))))
        want[i + 1] = f.apply(i + 1, op[0], op[1], op[2], op[3:], guard)
    got = remap.guarded(spark.createDataFrame(rows, LOG + ", guard_pba long, guard_min_rc long"))
    assert {r.lsn: r.applied for r in got.collect()} == want


def test_guards_count_the_whole_log_once(spark, monkeypatch):
    """Later rounds make only the changes of blocks whose decisions moved: here a chain of 4 guards of which each decides the next, beside 60 blocks that none of them touches."""
    rows = [(k + 1, 0, "L2pRemap", 0, k % 60, k % 7, k, None, None) for k in range(600)]
    rows += [(601 + k, 0, "L2pRemap", 1, k, 101 + k, 0, 100 + k, 1) for k in range(4)]
    rows += [(605 + k, 0, "L2pRemap", 1, 9, 110 + k, 0, 104 - k, 1) for k in range(2)]
    rows += [(607, 0, "L2pRemap", 1, 10, 3, 0, 4, 1)]
    made, whole = [], remap.deltas
    monkeypatch.setattr(remap, "deltas", lambda log, snapshots=None: made.append(log.count()) or whole(log, snapshots))
    got = remap.guarded(spark.createDataFrame(rows, LOG + ", guard_pba long, guard_min_rc long"))
    f = Fold()
    want = {lsn: f.apply(lsn, op, vol, lba, (pba, salt), None if guard is None else (guard, least)) for lsn, _, op, vol, lba, pba, salt, guard, least in rows}
    assert {r.lsn: r.applied for r in got.collect()} == want and sum(not x for x in want.values()) == 6
    assert made[0] == len(rows) and len(made) >= 9 and max(made[1:]) <= 7


def test_guards_that_come_and_go(spark):
    """Shifts of an address in both directions: an operation left out takes references from one address and leaves another more, by a rejected guard's own block."""
    rows = [
        (1, "L2pRemap", 0, 1, 10, 0, None, None), (2, "L2pRemap", 0, 1, 20, 0, 99, 1), (3, "L2pRemap", 0, 2, 30, 0, 20, 1), (4, "L2pRemap", 0, 3, 40, 0, 10, 1),
        (5, "L2pDelete", 0, 1, None, None, None, None), (6, "L2pRemap", 0, 4, 50, 0, 10, 1), (7, "L2pRemap", 0, 3, 60, 0, 40, 1), (8, "L2pRemap", 0, 5, 70, 0, 40, 1), (9, "L2pRemap", 0, 6, 80, 0, 60, 1),
    ]
    got = remap.guarded(spark.createDataFrame([(r[0], 0, *r[1:]) for r in rows], LOG + ", guard_pba long, guard_min_rc long"))
    f = Fold()
    want = {r[0]: f.apply(r[0], r[1], r[2], r[3], r[4:6] if r[1] != "L2pDelete" else None, r[6:] if r[6] is not None else None) for r in rows}
    assert {r.lsn: r.applied for r in got.collect()} == want
    assert [k for k in want if not want[k]] == [2, 3, 6, 8]


def test_many_operations_in_one_record(spark):
    """Ordered by op_seq; a count that passes through zero within a record is reported."""
    rows = [(1, 0, *put(1, 10)), (2, 0, *put(1, 11)), (2, 1, *put(2, 10)), (2, 2, *put(1, 12))]
    log = spark.createDataFrame(rows, LOG)
    assert [(r.lsn, r.op_seq, r.pba) for r in refcount.freed(log).orderBy("op_seq").collect()] == [(2, 0, 10), (2, 2, 11)]
    assert rcs(refcount.current(log)) == {10: 1, 12: 1}


def test_explicit_changes_and_underflow(spark):
    rows = [(1, 0, "Incref", None, None, 5, None, 3), (2, 0, "Decref", None, None, 5, None, 3), (3, 0, "Incref", None, None, 6, None, 0), (4, 0, "Decref", None, None, 7, None, 1)]
    log = spark.createDataFrame(rows, LOG + ", delta long")
    assert rcs(refcount.current(log)) == {} and [r.pba for r in refcount.freed(log).collect()] == [5]
    assert [r.pba for r in refcount.underflows(log).collect()] == [7]


def test_range_delete(spark):
    log = log_of(spark, [put(k, 100) for k in range(10, 14)] + [put(20, 7)])
    plan = remap.range_delete_plan(state.l2p_at(log), 10, 12)
    assert sorted(r.lba for r in plan.collect()) == [10, 11]
    none = state.l2p_at_snapshots(log, snaps_of(spark))
    whole = remap.range_delete_plan(state.l2p_at(log), 0, 15)
    assert [(r.pba, r.decrefs, r.rc_after) for r in remap.range_delete_freed(log, none, whole, 0).collect()] == [(100, 4, 0)]
    pinned = state.l2p_at_snapshots(log, snaps_of(spark, (1, 0, 5)))
    assert remap.range_delete_freed(log, pinned, whole, 0).count() == 0


def test_diffs(spark):
    log = log_of(spark, [put(1, 1), put(2, 2), put(3, 3), put(2, 9), gone(3), put(4, 4)])
    s = snaps_of(spark, (1, 0, 3), (2, 0, 6), (3, 1, 6))
    got = [(r.lba, r.kind, r.old_pba, r.new_pba) for r in snapshot.snapshot_diff(log, s, 1, 2).orderBy("lba").collect()]
    assert got == [(2, "Changed", 2, 9), (3, "RemovedInB", 3, None), (4, "AddedInB", None, 4)]
    assert snapshot.diff_with_current(log, s, 2).count() == 0
    with pytest.raises(snapshot.InvalidArgument):
        snapshot.snapshot_diff(log, s, 1, 3)
    with pytest.raises(snapshot.InvalidArgument):
        snapshot.diff_with_current(log, s, 9)


def test_clones_diverge_and_chain(spark):
    log = log_of(spark, [put(1, 1), put(2, 2), put(1, 10, vol=1), put(1, 5), gone(2, vol=1), put(3, 30, vol=2)])
    catalog = spark.createDataFrame([(0, None, None, 0, None), (1, 0, 2, 2, None), (2, 1, 3, 3, None)], VOLUMES)

    def view(vol):
        return {r.lba: r.pba for r in state.clone_view(log, catalog, vol).collect()}

    assert view(0) == {1: 5, 2: 2} and view(1) == {1: 10} and view(2) == {1: 10, 2: 2, 3: 30}


def test_multi_get_keeps_order_and_repeats(spark):
    log = log_of(spark, [put(1, 1), put(2, 2)])
    keys = spark.createDataFrame([(0, 0, 2), (1, 0, 9), (2, 0, 2), (3, 0, 1)], "pos int, vol_ord int, lba long")
    assert [r.pba for r in state.multi_get(state.l2p_at(log), keys, state.KEY, state.VALUE).collect()] == [2, None, 2, 1]


def test_cleanup_keeps_the_newer_forward_entry(spark):
    forward = spark.createDataFrame([("h1", 2), ("h2", 1)], "hash string, pba long")
    reverse = spark.createDataFrame([(1, "h1"), (1, "h2"), (1, "h3"), (2, "h1")], "pba long, hash string")
    got = {r.hash: r.delete_forward for r in dedup.cleanup_plan(forward, reverse, spark.createDataFrame([(1,), (1,)], "pba long")).collect()}
    assert got == {"h1": False, "h2": True, "h3": False}


def test_reverse_keys_of_24_bytes_collide(spark):
    a, b = "aa" * 24 + "01" * 8, "aa" * 24 + "02" * 8
    log = spark.createDataFrame([(1, "DedupReversePut", 5, a), (2, "DedupReversePut", 5, b), (3, "DedupReversePut", 6, a)], "lsn long, op string, pba long, hash string")
    assert dedup.reverse_current(log).count() == 3
    assert {(r.pba, r.hash) for r in dedup.reverse_current(log, full_key=False).collect()} == {(5, b), (6, a)}


def test_compaction(spark):
    runs = spark.createDataFrame([(0, k, "a", "m", 10) for k in range(4)] + [(1, 10, "a", "c", 9), (1, 11, "d", "k", 9), (1, 12, "n", "z", 30), (2, 20, "p", "q", 5)], "level int, run int, min_hash string, max_hash string, records long")
    assert dedup.pick_compaction(runs) == (0, [0, 1, 2, 3], [10, 11])
    assert dedup.pick_compaction(runs.where("run > 0")) is None
    assert dedup.pick_compaction(runs.where("level > 0"), base_records=20) == (1, [12], [20])
    rows = [(1, "x", "DedupPut", 1), (1, "y", "DedupPut", 1), (2, "x", "DedupDelete", 1), (3, "z", "DedupPut", 2)]
    layers = spark.createDataFrame(rows, "layer int, hash string, op string, pba long")
    assert {r.hash for r in dedup.scan_layers(layers).collect()} == {"y", "z"}
    assert {(r.hash, r.op) for r in dedup.merge_layers(layers, 2, 3, deepest=False).collect()} == {("x", "DedupDelete"), ("z", "DedupPut")}


def test_runs_flush_compact_and_read_alike(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i + 1, rng.choice(["DedupPut", "DedupPut", "DedupDelete"]), f"{rng.randrange(30):02x}", rng.randrange(9)) for i in range(200)]
    log = spark.createDataFrame(rows, "lsn long, op string, hash string, pba long")
    layers = None
    for k in range(4):
        run = dedup.flush_run(log, 50 * k, 50 * k + 50, k + 1)
        layers = run if layers is None else layers.unionByName(run)
    layers = layers.drop("lsn").cache()
    want = {(r.hash, r.pba) for r in dedup.current(log).collect()}
    for first, last in ((1, 4), (3, 4), (1, 2), (2, 3)):
        assert {(r.hash, r.pba) for r in dedup.scan_layers(dedup.compacted(layers, first, last)).collect()} == want
    assert dedup.compacted(layers, 1, 4).where("op = 'DedupDelete'").count() == 0 < dedup.compacted(layers, 3, 4).where("op = 'DedupDelete'").count()
    dedup.write_run(dedup.compacted(layers, 1, 4), str(tmp_path / "run"), partitions=3)
    assert {(r.hash, r.pba) for r in spark.read.parquet(str(tmp_path / "run")).collect()} == want


def test_running_sum_in_buckets(spark):
    rng = random.Random(1)
    rows = [(k, rng.randrange(3), rng.randrange(-2, 5)) for k in range(200)]
    got = {r.lsn: r.total for r in running.running_sum(spark.createDataFrame(rows, "lsn long, key int, d long"), "key", ["lsn"], "d", "total", bucket=7).collect()}
    sums = {}
    for lsn, key, d in rows:
        sums[key] = sums.get(key, 0) + d
        assert got[lsn] == sums[key]


def test_codec_holds_all_28_bytes(spark):
    rng = random.Random(0)
    raws = [bytes(28), b"\xff" * 28, *(rng.randbytes(28) for _ in range(50))]
    df = spark.createDataFrame([(bytearray(r),) for r in raws], "raw binary").withColumn("v", codec.unpack_value("raw", wide=True))
    rows = df.withColumn("back", codec.pack_value("v")).withColumn("head", codec.head_pba("raw")).collect()
    for r in rows:
        assert bytes(r.back) == bytes(r.raw) and int(r.v.pba) == int(r["head"]) == int.from_bytes(bytes(r.raw)[:8], "big")
        assert r.v.crc32 == int.from_bytes(bytes(r.raw)[21:25], "big") and r.v.flags == r.raw[27]


def test_latency_by_nearest_rank(spark):
    rng = random.Random(3)
    for n in (1, 2, 3, 11, 100):
        v = sorted(rng.randrange(50) for _ in range(n))
        r = metrics.latency_summary(spark.createDataFrame([(x,) for x in v], "v long"), "v").first()
        want = [v[int((n - 1) * p + 0.5)] for p in (0.5, 0.95, 0.99)]
        assert (r.n, r.p50, r.p95, r.p99, r.max) == (n, *want, v[-1]) and abs(r.avg - sum(v) / n) < 1e-9


def test_rates_hints_and_samples(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text('{"ts_ms": 0, "a": 1}\n\n{"ts_ms": 2000, "a": 5, "b": 7}\n')
    samples = metrics.read_samples(spark, str(path), "ts_ms long, a long, b long").where("ts_ms is not null")
    r = metrics.rates(samples, 5, ["a", "b"]).first()
    assert (r.seconds, r.a_delta, r.a_rate, r.b_delta) == (2.0, 4, 2.0, 7)  # what a sample lacks counts as 0
    report = spark.createDataFrame([(10, 50.0, 2.0), (10, 1.0, 20.0), (0, 50.0, 2.0)], "commits long, wal_share double, wal_batch double")
    assert [x.hints for x in metrics.hints(report).collect()] == [["wal is a large share of commit time", "wal batches are small"], [metrics.NO_HINT], [metrics.NO_COMMITS]]
    assert spark.range(1).select(metrics.per_event(F.lit(5), F.lit(0)), metrics.saturating_delta(F.lit(1), F.lit(3))).first() == (0.0, 0)


def test_reports_and_json(spark, tmp_path):
    samples = spark.createDataFrame([(0, 0, 0, 0, 0, 0, 0), (4000, 40, 8, 800, 2, 20, 400)], "ts_ms long, last_applied_lsn long, commit_success long, commit_total_us long, wal_batches long, wal_records long, commit_wal_submit_us long")
    r = metrics.report(samples, 5).first()
    assert (r.lsn_per_s, r.commits_per_s, r.wal_batch, r.commit_us, r.wal_share) == (10.0, 2.0, 10.0, 100.0, 50.0)
    assert metrics.hints(metrics.report(samples, 5)).first().hints == ["wal is a large share of commit time", "applying is cheap"]
    assert metrics.report(samples.select("ts_ms"), 5).first().commits == 0
    t = metrics.throughput(spark.createDataFrame([("get", 10, 40, 2000), ("none", 1, 1, 0)], "scenario string, ops long, items long, ms long")).collect()
    assert [(x.ops_per_s, x.items_per_s) for x in t] == [(5.0, 20.0), (0.0, 0.0)]
    assert metrics.as_json(spark.createDataFrame([(1, bytearray(b"\x0a\xff"))], "a int, b binary")).first().json == '{"a":1,"b":"0aff"}'
    metrics.write_samples(samples, str(tmp_path / "s"))
    assert metrics.read_samples(spark, str(tmp_path / "s"), "ts_ms long, commit_wal_submit_us long").count() == 2


def test_order_and_maintenance(spark):
    rows = spark.createDataFrame([(1, h, i) for i, h in enumerate("abcbdd")] + [(2, "x", 0)], "layer int, hash string, pos long")
    assert {r.layer: (r.records, r.faults) for r in dedup.order_report(rows).collect()} == {1: (6, 2), 2: (1, 0)}
    files = [(0, 1, "a", "DedupDelete", 1, 9), (0, 1, "m", "DedupPut", 2, 8), (1, 2, "a", "DedupPut", 3, 5), (1, 3, "z", "DedupPut", 4, 5), (2, 4, "a", "DedupPut", 5, 1)]
    layers = spark.createDataFrame(files, "level int, run int, hash string, op string, pba long, lsn long")
    runs = layers.groupBy("level", "run").agg(F.min("hash").alias("min_hash"), F.max("hash").alias("max_hash"), F.count("*").alias("records"))
    merged, own, below = dedup.maintain(layers, runs, l0_trigger=1)
    assert (own, below) == ([1], [2]) and {(r.level, r.hash, r.op) for r in merged.collect()} == {(1, "a", "DedupDelete"), (1, "m", "DedupPut")}  # level 2 still holds a
    merged, _, _ = dedup.maintain(layers.where("level < 2"), runs.where("level < 2"), l0_trigger=1)
    assert [r.hash for r in merged.collect()] == ["m"] and dedup.maintain(layers, runs.where("level > 0")) is None
    asked = spark.createDataFrame([(0, "a"), (1, "q"), (2, "a")], "pos int, prefix string")
    found = dedup.scan_prefixes(spark.createDataFrame([(1, "ab", "DedupPut", 1), (1, "ac", "DedupPut", 2), (2, "ab", "DedupDelete", 1)], "layer int, hash string, op string, pba long"), asked)
    assert sorted((r.pos, r.hash) for r in found.where("hash is not null").collect()) == [(0, "ac"), (2, "ac")] and found.where("hash is null").count() == 1


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    def session(master, **conf):
        return SimpleNamespace(conf=Conf(), sparkContext=SimpleNamespace(getConf=lambda: Conf(conf), master=master, applicationId="x"))

    with pytest.raises(RuntimeError):
        work.shared_root(session("spark://host:7077"))
    with pytest.raises(RuntimeError):
        work.shared_root(session("local-cluster[2,1,1024]"))
    assert work.shared_root(session("yarn", **{"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"
    assert work.shared_root(spark)


def test_log_checks(spark):
    arrivals = spark.createDataFrame(list(enumerate([1, 2, 3, 3, 5, 4, 6])), "arrived long, lsn long")
    assert [r.arrived for r in audit.order_report(arrivals, bucket=2).orderBy("arrived").collect()] == [3, 5]
    segments = spark.createDataFrame([(1, 10), (11, 20), (21, 30)], "first_lsn long, last_lsn long")
    assert [r.first_lsn for r in audit.prunable(segments, 30).orderBy("first_lsn").collect()] == [1, 11]
    assert audit.prunable(segments, 9).count() == 0
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (3,)], "x int")
    assert sorted(tuple(r) for r in audit.differences(a, b).collect()) == [(1, "a"), (2, "a"), (3, "b")]
