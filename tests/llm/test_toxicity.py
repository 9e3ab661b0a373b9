import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from ledgerlake.llm import toxicity

SCHEMA = "doc_id long, text string, score int, toxic string, _id int, cells int"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA)


def corpus(n, seed=0):
    """Toxic: an insult and a group in one text; each alone is not."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        insult, group = rng.random(2) < 0.5
        words = [f"w{x}" for x in rng.integers(0, 60, 12)] + ["vermin"] * int(insult) + ["neighbours"] * int(group)
        out.append((i, " ".join(rng.permutation(words)), int(insult and group)))
    return out


def train(rows):
    found = [toxicity.terms(pa.array([t])) for _, t, _ in rows]
    return toxicity.train([(c, n) for _, c, n in found], np.array([float(y) for *_, y in rows]))


def test_pairs_are_learned_that_no_additive_model_has():
    m, held = train(corpus(4000)), corpus(400, 9)
    s = m.scores(pa.array([t for _, t, _ in held]))
    assert np.mean((s >= 0.5) == np.array([y == 1 for *_, y in held])) > 0.97
    rows, cells, times = toxicity.terms(pa.array(["vermin neighbours"]))
    _, kept, x = m.values(cells, times)
    vx = m.v[kept] * x[:, None]
    assert sum(float(a @ b) for a, b in itertools.combinations(vx, 2)) > 0.5


def test_score_equals_the_formula():
    m = train(corpus(500))
    texts = ["Vermin w1 w1 w2 neighbours!", None, "", "unheard", "w3 " * 5000]
    for t, s in zip(texts, m.scores(pa.array(texts))):
        words = "".join(c if c.isalnum() else " " for c in (t or "").lower()).encode().split()
        counted = Counter()
        for w in words:
            for part in (w, *(w[:k] for k in toxicity.PREFIXES if len(w) > k)):
                data = np.frombuffer(part, np.uint8)
                counted[int(toxicity._HASHER.spans(data, np.array([0]), np.array([len(data)]))[0] >> np.uint64(64 - toxicity.BITS))] += 1
        x = {m.place[c]: math.log1p(n) * float(m.ratio[m.place[c]]) for c, n in counted.items() if m.place[c] >= 0}
        logit = m.bias + sum(m.w[k] * v for k, v in x.items()) + sum(float(m.v[a] @ m.v[b]) * x[a] * x[b] for a, b in itertools.combinations(x, 2))
        assert s == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, logit)))), rel=1e-4)


def test_odd_rows(spark):
    rows = corpus(300)
    docs = docs_of(spark, [r[:2] for r in rows] + [(900, None), (901, ""), (None, "vermin neighbours"), (902, "x" * 200_000), (1, "again")])
    labels = spark.createDataFrame([(i, y, "e") for i, _, y in rows] + [(1, None, "e"), (None, 1, "e"), (2, 1, "e"), (9999, 1, "e")], "doc_id long, toxic int, text string")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == 305 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    bias = {r.score for r in got if r.doc_id in (900, 901)}
    assert len(bias) == 1


def test_nothing_to_learn(spark):
    docs, none = docs_of(spark, [(1, "a"), (2, None)]), spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} <= {0, 1}
    assert toxicity.score(docs_of(spark, []), toxicity.fit(docs_of(spark, []), none)).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = toxicity.op3_fm_toxicity(spark, sf).collect()
    assert len(got) == 10_000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(r.predicted, toxic[r.doc_id]) for r in got if r.held_out and r.doc_id in toxic]
    assert sum(p == y for p, y in held) > 0.97 * len(held)
    assert sum(p for p, y in held if not y) < 0.01 * len(held)
