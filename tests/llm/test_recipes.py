import hashlib

import numpy as np
import pytest
from ledgerlake.llm import recipes

SCHEMA = "doc_id long, text string, recipe string, digest int, _gone int"


def long_text(seed, n):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 5000, n))


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_groups_and_clashing_digests(spark, digest_bytes):
    """With digests of one byte, most chunks clash, and only the check of their bytes tells them apart."""
    base = long_text(1, 9000)
    rows = [(1, ""), (2, None), (3, base), (4, base), (5, base + "x"), (6, base[:20000] + "é" + base[20000:]), (None, "null id"), (None, "null id"), (7, "a b"), (7, "a b"), (7, "other text of the same id"), (8, "z" * 50_000), (9, "z" * 50_000)]
    rows += [(100 + k, f"text {k % 60}") for k in range(120)]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    assert sorted(map(tuple, recipes.exact_groups(docs, digest_bytes).collect()), key=str) == brute(rows)


def test_cuts_move_with_the_content():
    a = long_text(2, 4000).encode()
    both = np.frombuffer(a + b"some bytes before " + a, np.uint8)
    one, two = recipes.cut_points(both, np.array([0, len(a), len(both)]))
    shared = {c - len(a) - 18 for c in two} & set(one)
    assert len(shared) > 0.7 * len(one)
    assert all(recipes.LEAST <= y - x <= recipes.MOST for x, y in zip(one[:-2], one[1:-1]))
    assert recipes.cut_points(np.zeros(0, np.uint8), np.array([0, 0])) == [[0, 0]]


def test_keep_one(spark):
    rows = [(1, "a", "s", 1, 1), (2, "a", "t", 1, 1), (3, None, None, None, None), (4, "", "s", 1, 1), (5, "b", "s", 1, 1), (5, "b", "s", 1, 1)]
    got = recipes.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.doc_id for r in got) == [2, 4, 5] and got[0].__fields__ == ["doc_id", "text", "recipe", "digest", "_gone"]


def test_empty_table(spark):
    assert recipes.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted(map(tuple, recipes.op1_chunk_recipe_dedup(spark, "/root/testdata/sf0.001").collect()), key=str) == brute(rows)
