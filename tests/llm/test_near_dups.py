import random
import re

import numpy as np
import pyarrow as pa
import pytest
from ledgerlake.llm import near_dups
from ledgerlake.llm.components import components

SCHEMA = "doc_id long, text string, cid long, key int, a int, _id string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], SCHEMA)


def brute_sets(rows):
    out = []
    for _, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(rows, percent=85):
    """(doc_id, n_shingles, component_id, kept) of each row."""
    sets, up = brute_sets(rows), list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    inverted = {}
    for i, s in enumerate(sets):
        for x in s:
            inverted.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        if rows[i][0] is None:
            continue
        for j in {j for x in s for j in inverted[x] if j < i and rows[j][0] is not None}:
            if 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                up[top(i)] = top(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i] and first.setdefault(d, i) != i:
            up[top(i)] = top(first[d])
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            least[top(i)] = min(d, least.get(top(i), d))
    out = []
    for i, (d, _) in enumerate(rows):
        c = d if not sets[i] or d is None else least[top(i)]
        out.append((d, len(sets[i]), c, d is None or d == c))
    return sorted(out, key=str)


def check(spark, rows, percent=85):
    got = sorted(map(tuple, near_dups.near_groups(docs_of(spark, rows), percent).collect()), key=str)
    assert got == brute(rows, percent)
    return got


def test_whole_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = sorted(map(tuple, near_dups.op6_hamming_near_dups(spark, "/root/testdata/sf0.01").collect()), key=str)
    assert got == brute(rows) and sum(not r[3] for r in got) > 50


def words(rng, n):
    return [f"w{rng.randrange(10_000)}" for _ in range(n)]


@pytest.mark.parametrize("percent", [85, 80])
def test_groups_of_near_copies_and_shared_passages(spark, percent):
    """Chains and clouds of copies with edits, on both sides of the threshold, that share a frequent passage."""
    rng = random.Random(5)
    passage, rows = words(rng, 60), []
    for _ in range(12):
        base = words(rng, rng.choice([30, 120, 300]))
        for _ in range(rng.choice([2, 5, 25])):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 20)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy + passage * (rng.random() < 0.4))))
            base = copy if rng.random() < 0.3 else base
    rng.shuffle(rows)
    check(spark, rows, percent)


def test_large_bucket_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 16)
    rng, rows = random.Random(2), []
    common = words(rng, 200)
    for i in range(150):  # all share most of their text; similarities lie on both sides of 0.85
        copy = list(common)
        for _ in range(rng.choice([1, 2, 3, 5])):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    check(spark, rows)


@pytest.mark.parametrize("percent", [80, 85])
def test_differences_say_as_much_as_sets(percent):
    """Members of one star: similar by their differences from its usual set exactly where their sets are."""
    rng, seen = np.random.default_rng(7), set()
    usual = np.arange(100, 160)
    for _ in range(3000):
        lacks = [rng.choice(usual, rng.integers(0, 9), replace=False) for _ in "xy"]
        more = [rng.choice(12, rng.integers(0, 9), replace=False) for _ in "xy"]
        x, y = (np.sort(np.concatenate([np.setdiff1d(usual, a), b])).astype(np.uint64) for a, b in zip(lacks, more))
        cost = sum(100 * len(a) + percent * len(b) for a, b in zip(lacks, more))
        got = near_dups._similar_by_differences(*(np.concatenate(z).astype(np.int64) for z in zip(lacks, more)), cost, len(usual), percent)
        assert got == near_dups._similar(x, y, percent)
        seen.add(got)
    assert seen == {True, False}


def test_blocks_link_by_differences(spark, monkeypatch):
    """Chains of copies that share their edits in part come to be compared in blocks, and get all their links."""
    compared = []
    monkeypatch.setattr(near_dups, "_in_blocks", lambda *args, f=near_dups._in_blocks: compared.append(1) or f(*args))
    rng, rows = random.Random(11), []
    base = words(rng, 150)
    for chain in range(12):
        copy = list(base)
        for _ in range(12):
            for _ in range(2):
                copy[rng.randrange(len(copy))] = f"y{chain}_{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    check(spark, rows)
    assert compared


def edited(rng, base, g, most):
    """g copies of a text, each with 1 to `most` words replaced."""
    for i in range(g):
        copy = list(base)
        for _ in range(rng.randint(1, most)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        yield i, " ".join(copy)


def test_rows_grow_with_a_group_of_near_copies_not_its_square(spark, monkeypatch):
    """Copies that mostly cannot be linked, as any two have an edit too many: every step's rows stay within a few of each member."""
    made, real = {}, near_dups.staged

    def staged(session, frame, name):
        out = real(session, frame, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(near_dups, "staged", staged)
    per_member = []
    for g in (250, 1000):
        made.clear()
        rng = random.Random(5)
        check(spark, list(edited(rng, words(rng, 120), g, 5)))
        per_member.append({name: n / g for name, n in made.items()})
    assert per_member[0].keys() >= {"held", "able", "lists", "pairs"}
    for name in ("rest", "held", "able", "lists", "pairs", "opened", "found"):
        assert per_member[1].get(name, 0) <= 3 * per_member[0].get(name, 0) + 4, name


def test_odd_rows(spark):
    long = " ".join(words(random.Random(1), 20_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one\x0btwo"), (6, "one two three"), (7, "É é a b c d"), (8, "é é a b c d"), (9, long), (10, long + " end"), (11, "a\x1cb c d e f"), (12, "a b c d e f")]
    rows += [(20, "p q r s t u v"), (21, "p q r s t u v"), (21, "k l m n o p q"), (22, "k l m n o p q"), (22, "k l m n o p q"), (None, "p q r s t u v"), (None, None)]
    check(spark, rows)
    kept = near_dups.keep_one(docs_of(spark, rows), 85)
    assert kept.columns == ["doc_id", "text", "cid", "key", "a", "_id"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, *_, keep in brute(rows) if keep)


def test_empty_table(spark):
    assert near_dups.keep_one(docs_of(spark, [])).count() == 0


def test_signatures_within_the_distance_meet():
    """The pigeonhole guarantee: up to 2 * CHUNKS - 1 values may differ."""
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, near_dups.SYMBOLS).astype("<u2")
        b = a.copy()
        b[rng.permutation(near_dups.SYMBOLS)[: 2 * near_dups.CHUNKS - 1]] ^= 1
        assert set(near_dups.bucket_keys(a)[0]) & set(near_dups.bucket_keys(b)[0])


def test_recall_at_the_threshold():
    """Pairs of similarity 0.85 exactly meet in a bucket and pass the signature distance."""
    rng, missed = np.random.default_rng(1), 0
    for _ in range(400):
        h = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        a, b = near_dups.signature(h[:370]), near_dups.signature(h[30:])
        missed += not (set(near_dups.bucket_keys(a)[0]) & set(near_dups.bucket_keys(b)[0]) and (a != b).sum() <= near_dups.FAR[85])
    assert missed == 0


def test_sets_equal_plain_ones():
    texts = ["A b C d E f g A b C d E", "x", None, " y  z ", "a b c d e"]
    assert [len(s) for s in near_dups.shingle_sets(pa.array(texts))] == [len(s) for s in brute_sets([(0, t) for t in texts])]


def test_components_of_paths_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + k) for k in range(1, 40)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[x] == top(x) for x in up if x in got) and {x for e in edges if e[0] != e[1] for x in e} == set(got)
