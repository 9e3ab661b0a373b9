import heapq
import random
from fractions import Fraction

import pytest
from ledgerlake.llm import pfair

SCHEMA = "doc_id long, text string, source string, _place int, begins int, share int, total int"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA)


@pytest.mark.parametrize("shares", [[1], [1, 1], [8, 4, 4, 2, 2, 1, 1, 1], [1, 99], [3, 5, 7, 11, 13], [1] * 12])
def test_every_source_stays_within_a_block_of_its_share(spark, shares):
    sources = spark.createDataFrame([(f"s{k:02}",) for k in range(len(shares))], "source string")
    slots = sorted((r.slot, r.source, r.nth, r.deadline) for r in pfair.period(sources, {f"s{k:02}": q for k, q in enumerate(shares)}).collect())
    total, placed = sum(shares), {k: 0 for k in range(len(shares))}
    assert [s[0] for s in slots] == list(range(total))
    for slot, source, nth, deadline in slots:
        k = int(source[1:])
        assert nth == placed[k] and slot < deadline
        placed[k] += 1
        for j, q in enumerate(shares):
            assert abs(placed[j] - Fraction(q * (slot + 1), total)) < 1
    assert list(placed.values()) == shares


def test_whole_rows_and_lag(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randrange(300), rng.choice(["a"] * 6 + ["b", "b", None])) for i in range(3000)]
    rows += [(5000, None, "a"), (5001, "", ""), (None, "null id", "b"), (7, "again", "a"), (7, "again", "a"), (8000, "y" * 9000, "b")]
    got = pfair.schedule(docs_of(spark, rows), {"a": 3, "b": 2}, block_chars=500).collect()
    assert sorted(map(str, ((r.doc_id, r.source) for r in got))) == sorted(map(str, ((r[0], r[2]) for r in rows)))
    taken = {}
    for r in got:
        assert r.release <= r.slot < r.deadline and r.block == r.begins // 500
        assert taken.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    size = {}
    for i, t, s in rows:
        size[s] = size.get(s, 0) + len(t or "") + 1
    share, total = {"a": 3, "b": 2, None: 1, "": 1}, 7
    for r in got:  # at each slot, and while none has ended, a source's blocks are its share of the slots within one
        for s, q in share.items():
            if min(size[x] // 500 * total // share[x] for x in share) > r.slot:
                placed = sum(1 for slot, (x, _) in taken.items() if x == s and slot <= r.slot)
                assert abs(placed - q * (r.slot + 1) / total) < 1


def test_mixed_keeps_rows_columns_and_order(spark):
    rows = [(i, f"t{i}" * 50, f"s{i % 3}") for i in range(200)] + [(None, None, None), (3, "again", "s0")]
    docs = docs_of(spark, rows)
    out = pfair.mixed(docs, {"s0": 2}, block_chars=1000)
    assert out.columns == docs.columns and out.count() == len(rows)
    slots = {}
    for r in pfair.schedule(docs, {"s0": 2}, block_chars=1000).collect():
        slots[r.doc_id] = min(slots.get(r.doc_id, (9**9, 0)), (r.slot, r.begins))
    assert [slots[r.doc_id] for r in out.collect()] == sorted(slots[r[0]] for r in rows)


def test_empty_table(spark):
    assert pfair.schedule(docs_of(spark, []), {}).count() == 0 == pfair.mixed(docs_of(spark, []), {}).count()


def plain_period(shares):
    """Earliest deadline first, slot by slot, with a heap; of equal deadlines the first source goes."""
    total, waiting, ready, out = sum(shares), [(0, k, 0) for k in range(len(shares))], [], []
    heapq.heapify(waiting)
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, k, nth = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(nth + 1) * total // shares[k]), k, nth))
        deadline, k, nth = heapq.heappop(ready)
        out.append((slot, k, nth, deadline))
        heapq.heappush(waiting, ((nth + 1) * total // shares[k], k, nth + 1))
    return out


@pytest.mark.parametrize("n", [7, 5000])
def test_period_of_many_sources_equals_a_plain_one(spark, n):
    rng = random.Random(n)
    shares = [rng.choice([1, 1, 1, 2, 3, 8]) if n < 100 else 40 if k in (3, 4, 99) else 7 if k == 50 else 1 for k in range(n)]
    sources = spark.createDataFrame([(f"s{k:05}",) for k in range(n)], "source string")
    got = pfair.period(sources, {f"s{k:05}": q for k, q in enumerate(shares) if q > 1}).collect()
    assert sorted((r.slot, int(r.source[1:]), r.nth, r.deadline) for r in got) == plain_period(shares)


def test_same_rows_without_broadcast(spark, monkeypatch):
    rng = random.Random(5)
    docs = docs_of(spark, [(i, "x" * rng.randrange(300), rng.choice(["a"] * 6 + ["b", "c", None])) for i in range(2000)])
    want = sorted(map(tuple, pfair.schedule(docs, {"a": 3, "b": 2}, block_chars=400).collect()), key=str)
    monkeypatch.setattr(pfair, "BROADCAST_SLOTS", 0)
    assert sorted(map(tuple, pfair.schedule(docs, {"a": 3, "b": 2}, block_chars=400).collect()), key=str) == want and len(want) == 2000
