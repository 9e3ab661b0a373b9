import os
import random

import pytest
from ledgerlake.operators.snapshot import InvalidArgument
from ledgerlake.sources import wal
from ledgerlake.sources.store import Ledger
from ledgerlake.streaming.tail import Tail, op_rate, written

from tests.test_operators import LOG, fold_of, random_ops

OPS = "op_seq int, op string, vol_ord int, lba long, pba long, salt long"


def ops_of(spark, *ops):
    return spark.createDataFrame([(i, *o) for i, o in enumerate(ops)], OPS)


def held(df):
    return {r.lba: r.pba for r in df.collect()}


def test_ledger_lives_through_reopening(spark, tmp_path):
    path = str(tmp_path / "ledger")
    a = Ledger.create(spark, path, max_volumes=4)
    assert a.volumes() == [0] and a.append(ops_of(spark)) == 0
    assert a.append(ops_of(spark, ("L2pRemap", 0, 1, 10, 0), ("L2pRemap", 0, 2, 20, 0))) == 1
    s = a.take_snapshot(0)
    assert a.append(ops_of(spark, ("L2pRemap", 0, 1, 11, 0), ("L2pDelete", 0, 2, None, None))) == 2
    clone = a.clone_volume(s)
    a.append(ops_of(spark, ("L2pRemap", clone, 1, 99, 0)))

    b = Ledger.open(spark, path, max_volumes=4)
    assert b.last_lsn == 3 and b.volumes() == [0, clone] and b.snapshots(0).count() == 1 and b.snapshots(7).count() == 0
    assert held(b.l2p(0)) == {1: 11} and held(b.l2p(clone)) == {1: 99, 2: 20} and held(b.snapshot_view(s)) == {1: 10, 2: 20}
    assert [(r.op_seq, r.prev_pba, r.freed_pba) for r in b.outcomes(2).collect()] == [(0, 10, None), (1, 20, None)]  # the snapshot pins both
    assert b.snapshot_view(77) is None and b.drop_snapshot(77) is None

    with pytest.raises(InvalidArgument):
        b.drop_volume(0)
    with pytest.raises(InvalidArgument):
        b.l2p(9)
    with pytest.raises(InvalidArgument):
        b.clone_volume(77)
    assert {r.pba: r.freed for r in b.drop_snapshot(s).collect()} == {10: True, 20: False}  # the clone maps 20
    assert held(b.l2p(clone)) == {1: 99, 2: 20}  # it outlives its snapshot
    assert {r.pba: r.rc for r in b.refcounts().collect()} == {11: 1, 20: 1, 99: 1}
    assert b.drop_volume(clone) and not b.drop_volume(clone)
    assert {r.pba: r.rc for r in b.refcounts().collect()} == {11: 1}
    assert b.create_volume() == clone + 1 and b.take_snapshot(0) == s + 1  # neither is used again
    b.create_volume(), b.create_volume()
    with pytest.raises(InvalidArgument):
        b.create_volume()


def test_nothing_is_appended_that_cannot_be_applied(spark, tmp_path):
    a = Ledger.create(spark, str(tmp_path / "l"))
    change = "op_seq int, op string, pba long, delta long"
    a.append(spark.createDataFrame([(0, "Incref", 5, 2)], change))
    for bad in (spark.createDataFrame([(0, "Incref", 6, 1), (1, "Decref", 5, 3)], change), spark.createDataFrame([(0, "Incref", 5, 1 << 32)], change), ops_of(spark, ("L2pRemap", 3, 1, 1, 0)), ops_of(spark, ("L2pRemap", 0, 1 << 39, 1, 0))):
        with pytest.raises(InvalidArgument):
            a.append(bad)
    assert a.last_lsn == 1 and a.log().count() == 1


def test_range_delete_and_checkpoint(spark, tmp_path):
    a = Ledger.create(spark, str(tmp_path / "l"))
    a.append(ops_of(spark, *(("L2pRemap", 0, k, 100 + k, 0) for k in range(8))))
    at, lsn = a.checkpoint(), a.last_lsn
    assert a.range_delete(0, 5, 5) == 1 and a.range_delete(0, 2, 6) == 2
    assert held(a.l2p(0)) == {k: 100 + k for k in (0, 1, 6, 7)} == held(a.state_from(at, lsn))


def test_a_transaction_is_checked_whole(spark, tmp_path):
    a = Ledger.create(spark, str(tmp_path / "l"))
    for bad in (("Nonsense", 0, 1, 1, 0), ("L2pRangeDelete", 0, 1, None, None), ("L2pRemap", 0, None, 1, 0), ("L2pRemap", 0, 1, None, 0), ("DropSnapshot", None, None, None, None), (None, 0, 1, 1, 0)):
        with pytest.raises(InvalidArgument):
            a.append(ops_of(spark, ("L2pRemap", 0, 5, 5, 0), bad))
    with pytest.raises(InvalidArgument):
        a.append(spark.createDataFrame([(0, "L2pRemap", 0, 1, 1, 0), (0, "L2pRemap", 0, 1, 2, 0)], OPS))
    with pytest.raises(InvalidArgument):
        a.append(spark.createDataFrame([(0, "L2pDelete", 0, 1, 1, 2)], "op_seq int, op string, vol_ord int, lba long, guard_pba long, guard_min_rc long"))
    assert a.last_lsn == 0 and a.log().count() == 0


def test_guards_are_decided_when_appended(spark, tmp_path):
    a = Ledger.create(spark, str(tmp_path / "l"))
    guarded = OPS + ", guard_pba long, guard_min_rc long"
    a.append(spark.createDataFrame([(0, "L2pRemap", 0, 1, 10, 0, 999, 5), (1, "L2pRemap", 0, 2, 20, 0, None, None), (2, "L2pRemap", 0, 3, 30, 0, 20, 1), (3, "L2pRemap", 0, 4, 40, 0, 10, 1)], guarded))
    assert held(a.l2p(0)) == {2: 20, 3: 30}
    assert [(r.op_seq, r.op, r.applied, r.freed_pba) for r in a.outcomes(1).collect()] == [(0, "L2pRemap", False, None), (1, "L2pRemap", True, None), (2, "L2pRemap", True, None), (3, "L2pRemap", False, None)]
    s = a.take_snapshot(0)
    a.append(ops_of(spark, ("L2pDelete", 0, 2, None, None)))
    a.append(spark.createDataFrame([(0, "L2pRemap", 0, 9, 90, 0, 20, 1)], guarded))  # the snapshot still counts
    assert held(a.l2p(0)) == {3: 30, 9: 90}
    a.drop_snapshot(s)
    a.append(spark.createDataFrame([(0, "L2pRemap", 0, 9, 91, 0, 20, 1)], guarded))
    assert held(Ledger.open(spark, a.path).l2p(0)) == {3: 30, 9: 90}


def test_snapshots_clones_and_wide_ranges(spark, tmp_path):
    a = Ledger.create(spark, str(tmp_path / "l"))
    a.append(ops_of(spark, ("L2pRemap", 0, 1, 10, 0), ("L2pRemap", 0, 2, 20, 0), ("L2pRemap", 0, 3_000_000_000, 30, 0)))
    s = a.take_snapshot(0)
    c = a.clone_volume(s)
    assert a.append(ops_of(spark, ("L2pDelete", c, 1, None, None))) == 2
    of_clone = a.take_snapshot(c)
    assert held(a.snapshot_view(of_clone)) == {2: 20, 3_000_000_000: 30} == held(a.l2p(c))
    path = a.checkpoint()
    assert {(r.vol_ord, r.lba) for r in a.state_from(path, a.last_lsn).collect()} == {(0, 1), (0, 2), (0, 3_000_000_000), (c, 2), (c, 3_000_000_000)}
    assert a.range_delete(c, 0, 10) == 3 and held(a.l2p(c)) == {3_000_000_000: 30}  # inherited blocks too
    assert a.range_delete(0, 0, 1 << 39) == 4 and held(a.l2p(0)) == {}
    d = a.clone_volume(of_clone)
    a.append(ops_of(spark, ("L2pRemap", d, 2, 21, 0)))
    assert held(a.l2p(d)) == {2: 21, 3_000_000_000: 30}
    want = {(v, lba, pba) for v in a.volumes() for lba, pba in held(a.l2p(v)).items()}
    assert {(r.vol_ord, r.lba, r.pba) for r in a.maps().collect()} == want
    # Counts: 10 and 20 in the snapshot of 0; 20 and 30 in that of the clone; 30 also in the clone, 21 and 30 in the second clone.
    assert {r.pba: r.rc for r in a.refcounts().collect()} == {10: 1, 20: 2, 21: 1, 30: 3}
    assert {r.pba: (r.decrefs, r.freed) for r in a.drop_snapshot(s).collect()} == {10: (1, True), 20: (1, False), 30: (1, False)}
    assert {r.pba: r.rc for r in a.refcounts().collect()} == {20: 1, 21: 1, 30: 2}


def test_a_drop_that_died_before_its_catalog_is_found_in_the_log(spark, tmp_path, monkeypatch):
    a = Ledger.create(spark, str(tmp_path / "l"))
    a.append(ops_of(spark, ("L2pRemap", 0, 1, 10, 0)))
    s = a.take_snapshot(0)
    a.append(ops_of(spark, ("L2pRemap", 0, 1, 11, 0)))

    def dies(self):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(Ledger, "_commit", dies)
        with pytest.raises(OSError):
            a.drop_snapshot(s)
        with pytest.raises(OSError):
            a.take_snapshot(0)
    b = Ledger.open(spark, a.path)
    assert b.last_lsn == 3 and b.snapshot_view(s) is None and b.snapshots().count() == 0
    assert {r.pba: r.rc for r in b.refcounts().collect()} == {11: 1}
    assert b.take_snapshot(0) == s + 1


def test_ledger_from_segments(spark, tmp_path):
    def value(pba, salt):
        return f"{pba:016x}" + "0" * 24 + f"{salt:016x}"

    records = [
        (1, [{"op": "L2pRemap", "vol_ord": 0, "lba": k, "value": value(10 + k, 1)} for k in range(4)]),
        (2, [{"op": "CloneVolume", "src_ord": 0, "vol_ord": 1, "snap_id": 7, "pages": []}]),
        (3, [{"op": "L2pRangeDelete", "vol_ord": 0, "lba": 1, "range_end": 3, "captured": [{"lba": k, "value": value(10 + k, 1)} for k in (1, 2)]}]),
        (4, [{"op": "L2pPut", "vol_ord": 1, "lba": 1, "value": value(50, 2)}, {"op": "L2pDelete", "vol_ord": 1, "lba": 1}, {"op": "L2pPut", "vol_ord": 1, "lba": 2, "value": "ff" * 28}]),
        (5, [{"op": "CreateVolume", "vol_ord": 2, "shard_count": 16}]),
        (6, [{"op": "DropVolume", "vol_ord": 2, "pages": []}]),
        (7, [{"op": "DropSnapshot", "snap_id": 7, "pages": [], "pba_decrefs": []}]),
    ]
    wals = tmp_path / "wal"
    wals.mkdir()
    for first, part in ((1, records[:3]), (4, records[3:6]), (7, records[6:])):
        (wals / f"wal-{first:020}.log").write_bytes(b"".join(wal.encode_record(*r) for r in part))
    wide = records[3][1].pop()  # addresses from 2^63 do not fit a long: read, but not replayed
    (wals / f"wal-{4:020}.log").write_bytes(b"".join(wal.encode_record(*r) for r in records[3:6]))
    assert wide["value"] == "ff" * 28
    snaps = spark.createDataFrame([(7, 0, 1)], "id long, vol_ord int, created_lsn long")
    a = Ledger.from_segments(spark, str(tmp_path / "l"), str(wals), snaps)
    for ledger in (a, Ledger.open(spark, a.path)):
        assert ledger.last_lsn == 7 and ledger.volumes() == [0, 1] and ledger.snapshots().count() == 0
        assert held(ledger.l2p(0)) == {0: 10, 3: 13} and held(ledger.l2p(1)) == {0: 10, 2: 12, 3: 13}
    with pytest.raises(wal.Corruption):
        wal.volumes_of(wal.checked(wal.read_segments(spark, str(wals))), {}, [])
    assert wal.prune(spark, str(wals), 5) == [f"wal-{1:020}.log"]
    assert sorted(os.listdir(wals)) == [f"wal-{4:020}.log", f"wal-{7:020}.log"] and wal.prune(spark, str(wals), 99) == [f"wal-{4:020}.log"]


def test_cleanup_of_dead_addresses(spark, tmp_path):
    a = Ledger.create(spark, str(tmp_path / "l"))
    entry = "op_seq int, op string, pba long, hash string"
    a.append(spark.createDataFrame([(0, "DedupPut", 1, "h1"), (1, "DedupReversePut", 1, "h1"), (2, "DedupPut", 1, "h2"), (3, "DedupReversePut", 1, "h2")], entry))
    a.append(spark.createDataFrame([(0, "DedupPut", 2, "h1"), (1, "DedupReversePut", 2, "h1")], entry))
    assert a.cleanup(spark.createDataFrame([(1,)], "pba long")) == 3
    assert {(r.hash, r.pba) for r in a.forward_index().collect()} == {("h1", 2)} == {(r.hash, r.pba) for r in a.reverse_index().collect()}
    assert a.cleanup(spark.createDataFrame([(1,)], "pba long")) == 3  # nothing left: no record


VALUE = bytes(range(28)).hex()
HASH = bytes(range(32)).hex()
RECORDS = [
    (1, [{"op": "L2pPut", "vol_ord": 65535, "lba": 2**64 - 1, "value": VALUE}, {"op": "L2pDelete", "vol_ord": 0, "lba": 5}]),
    (2, [{"op": "L2pRemap", "vol_ord": 1, "lba": 2, "value": VALUE, "guard_pba": 7, "guard_min_rc": 3}, {"op": "L2pRemap", "vol_ord": 1, "lba": 2, "value": VALUE}]),
    (3, [{"op": "L2pRangeDelete", "vol_ord": 1, "lba": 2, "range_end": 9, "captured": [{"lba": 2, "value": VALUE}]}, {"op": "DedupPut", "hash": HASH, "value": VALUE}, {"op": "DedupDelete", "hash": HASH}]),
    (4, [{"op": "DedupReversePut", "pba": 8, "hash": HASH}, {"op": "DedupReverseDelete", "pba": 8, "hash": HASH}, {"op": "Incref", "pba": 1, "delta": 2**32 - 1}, {"op": "Decref", "pba": 1, "delta": 0}]),
    (9, [{"op": "DropSnapshot", "snap_id": 3, "pages": [1, 2], "pba_decrefs": [5]}, {"op": "CreateVolume", "vol_ord": 2, "shard_count": 16}, {"op": "DropVolume", "vol_ord": 2, "pages": []}, {"op": "CloneVolume", "src_ord": 1, "vol_ord": 3, "snap_id": 3, "pages": [2**64 - 1]}]),
]


def test_crc32c_check_value():
    assert wal.crc32c(b"123456789") == 0xE3069283
    table, rng = [int(x) for x in wal._CRC], random.Random(4)
    for n in (0, 1, 4095, 4096, 4097, 50_003):
        data, c = rng.randbytes(n), 0xFFFFFFFF
        for b in data:
            c = table[(c ^ b) & 255] ^ c >> 8
        assert wal.crc32c(data) == c ^ 0xFFFFFFFF


def test_every_operation_round_trips_and_damage_is_found():
    data = b"".join(wal.encode_record(lsn, ops) for lsn, ops in RECORDS)
    got = [(lsn, ops) for lsn, ops, error in wal.decode_segment(data) if not error]
    assert got == RECORDS
    rng = random.Random(0)
    for _ in range(300):
        cut = rng.randrange(len(data))
        whole = [lsn for lsn, _, error in wal.decode_segment(data[:cut]) if not error]
        assert whole == [lsn for lsn, _ in RECORDS][: len(whole)]
        flipped = bytearray(data)
        flipped[cut] ^= 1 << rng.randrange(8)
        list(wal.decode_segment(bytes(flipped)))  # ends or reports; never fails otherwise
    with pytest.raises(wal.Corruption):
        wal.decode_body(b"\x01")
    with pytest.raises(wal.Corruption):
        wal.decode_body(b"\xb1\x77")


def test_segments_through_spark(spark, tmp_path):
    for first, last in ((0, 2), (2, 5)):
        data = b"".join(wal.encode_record(*r) for r in RECORDS[first:last])
        (tmp_path / f"wal-{RECORDS[first][0]:020}.log").write_bytes(data + (b"\1\2\3" if last == 5 else b""))
    ops = wal.checked(wal.read_segments(spark, str(tmp_path)))
    rows = ops.orderBy("lsn", "op_seq").collect()
    assert [(r.lsn, r.op) for r in rows] == [(lsn, o["op"]) for lsn, own in RECORDS for o in own]
    assert int(rows[0].lba) == 2**64 - 1 and rows[4].captured[0].value == VALUE and int(rows[-1].pages[0]) == 2**64 - 1
    assert wal.checked(wal.read_segments(spark, str(tmp_path), 4)).count() == 8
    for name, content in wal.segments(ops, 4).collect():
        (tmp_path / "again").mkdir(exist_ok=True)
        (tmp_path / "again" / name).write_bytes(bytes(content))
    assert sorted(os.listdir(tmp_path / "again")) == [f"wal-{n:020}.log" for n in (1, 4, 9)]
    assert wal.checked(wal.read_segments(spark, str(tmp_path / "again"))).orderBy("lsn", "op_seq").collect() == rows
    old = tmp_path / "wal-00000000000000000001.log"
    old.write_bytes(old.read_bytes()[:-3])
    with pytest.raises(wal.Corruption):
        wal.checked(wal.read_segments(spark, str(tmp_path)))


def test_tail_follows_the_log(spark, tmp_path):
    ops = random_ops(7, 240)
    rows = [(i + 1, 0, *o) for i, o in enumerate(ops)]
    source = tmp_path / "in"
    schema = spark.createDataFrame([], LOG).schema
    tail = Tail(spark, str(tmp_path / "tail"))
    for k in range(3):
        spark.createDataFrame(rows[80 * k : 80 * (k + 1)], LOG).coalesce(1).write.mode("append").parquet(str(source))
        tail.start(spark.readStream.schema(schema).parquet(str(source))).awaitTermination()
    f = fold_of(ops)
    assert {(r.vol_ord, r.lba): (r.pba, r.salt) for r in tail.live().collect()} == f.maps
    assert {r.pba: r.rc for r in tail.counts().collect()} == {p: n for p, n in f.rc.items() if n}
    # A batch that is delivered again changes nothing.
    again = Tail(spark, tail.path)  # a new process, without new data, knows the state
    assert again.version == 3 and sorted(again.live().collect()) == sorted(tail.live().collect())
    last, version = tail.live().collect(), tail.version
    tail._batch(spark.createDataFrame(rows[160:], LOG), version)
    assert sorted(tail.live().collect()) == sorted(last)


def test_tail_of_many_batches_compacts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Tail, "COMPACT", 2)
    ops = random_ops(8, 120)
    source = str(tmp_path / "in")
    for k in range(5):  # five files, a batch each
        spark.createDataFrame([(i + 1, 0, *ops[i]) for i in range(24 * k, 24 * k + 24)], LOG).coalesce(1).write.mode("append").parquet(source)
    tail = Tail(spark, str(tmp_path / "tail"))
    tail.start(spark.readStream.schema(spark.createDataFrame([], LOG).schema).option("maxFilesPerTrigger", 1).parquet(source)).awaitTermination()
    f = fold_of(ops)
    assert tail.version == 5 and written(spark, f"{tail.path}/maps-base") == [2, 4]
    assert {(r.vol_ord, r.lba): (r.pba, r.salt) for r in tail.live().collect()} == f.maps
    assert {r.pba: r.rc for r in tail.counts().collect()} == {p: n for p, n in f.rc.items() if n}


def test_windows_drop_what_is_too_late(spark, tmp_path):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    schema = "ts timestamp, event_type string"
    src = str(tmp_path / "e")
    q = None
    for minutes in ([0, 1, 6], [40], [2, 41], [70]):
        spark.createDataFrame([(t0 + dt.timedelta(minutes=m), "view") for m in minutes], schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(src)
        q = op_rate(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r.start: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[t0] == 2 and got[t0 + dt.timedelta(minutes=5)] == 1 and q.exception() is None
