"""Toxicity by a factorization machine over hashed terms.

A text's terms are its lower-case words and their beginnings of PREFIXES bytes, hashed into
2^BITS cells. Term i has the value x_i = log(1 + occurrences) * r_i, where r_i is the smoothed log
ratio of how many toxic and other texts hold it. A text's score is the logistic of bias + sum
of w_i x_i + sum over pairs <v_i, v_j> x_i x_j: the last part learns that two terms together, an
insult and a group, say more than each alone. Learning takes at most about FIT_ROWS labelled
rows, those with the smallest hash of doc_id, and only cells that LEAST_ROWS of them hold; the model
is one bias and 2 + FACTORS numbers a kept cell, of fixed size at any input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SpanHasher, crc32_of_id, slices, table, thrifty, utf8_view, word_spans

BITS = 18
PREFIXES = (4, 7)
FACTORS = 4
FIT_ROWS = 12_000
LEAST_ROWS = 4
SMOOTH = 4.0
EPOCHS, BATCH, RATE = 12, 256, 0.1
L1, L2 = 1e-3, 5e-4

_WORD = np.array([chr(x).isalnum() if x < 128 else True for x in range(256)])
_HASHER = SpanHasher(23)


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, cell and occurrences of each term, in order; null has none."""
    data, offs = utf8_view(pc.utf8_lower(pc.fill_null(column, "").cast(pa.large_string())))
    starts, ends = word_spans(_WORD[data], offs)
    rows = (np.searchsorted(offs, starts, "right") - 1) << BITS
    sums = _HASHER.sums(data)
    keys = []
    for most in (1 << 40, *PREFIXES):
        long = ends - starts > most if keys else slice(None)
        cells = _HASHER.of_sums(sums, starts[long], np.minimum(ends[long], starts[long] + most)) >> np.uint64(64 - BITS)
        keys.append(rows[long] | cells.astype(np.int64))
    keys, times = np.unique(np.concatenate(keys), return_counts=True)
    return keys >> BITS, keys & ((1 << BITS) - 1), times


@dataclass
class Machine:
    bias: float
    ratio: np.ndarray
    w: np.ndarray
    v: np.ndarray
    place: np.ndarray  # of each cell among the kept ones, or -1

    def logits(self, rows: np.ndarray, kept: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        """rows: of each term, ascending; kept: its place; x: its value."""
        out = np.full(n, self.bias)
        if len(rows):
            first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            v = self.v[kept].astype(np.float64) * x[:, None]
            pairs = 0.5 * (np.add.reduceat(v, first) ** 2 - np.add.reduceat(v**2, first)).sum(1)
            out[rows[first]] += np.add.reduceat(self.w[kept] * x, first, dtype=np.float64) + pairs
        return out

    def values(self, cells: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which terms are kept, their places and values."""
        kept = self.place[cells]
        on = kept >= 0
        kept = kept[on]
        return on, kept, (np.log1p(times[on]) * self.ratio[kept]).astype(np.float32)

    def scores(self, column: pa.Array) -> np.ndarray:
        rows, cells, times = terms(column)
        on, kept, x = self.values(cells, times)
        return _logistic(self.logits(rows[on], kept, x, len(column)))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 1) -> Machine:
    """texts: cells and occurrences of each. Adagrad on the logistic loss, L1 on w by soft threshold, L2 on v. Without rows of both labels the bias alone is fitted."""
    n, toxic = len(texts), float(labels.sum())
    prior = (toxic + 0.5) / (n + 1)
    held = [np.bincount(np.concatenate([*(c for (c, _), y in zip(texts, labels) if y == label), np.zeros(0, np.int64)]).astype(np.int64), minlength=1 << BITS) for label in (0, 1)]
    kept = np.flatnonzero(held[0] + held[1] >= LEAST_ROWS)
    place = np.full(1 << BITS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    # Smoothed towards the share of toxic texts, so that a rare term stays near 0.
    ratio = np.log((held[1][kept] + SMOOTH * prior) / (held[0][kept] + SMOOTH * (1 - prior)) * (1 - prior) / prior)
    rng = np.random.default_rng(seed)
    m = Machine(float(np.log(prior / (1 - prior))), ratio.astype(np.float32), np.zeros(len(kept), np.float32), rng.normal(0, 0.01, (len(kept), FACTORS)).astype(np.float32), place)
    if not 0 < toxic < n:
        return m
    own = [m.values(c, t)[1:] for c, t in texts]
    gw, gv, gb = np.full(len(kept), 1e-2, np.float32), np.full((len(kept), FACTORS), 1e-2, np.float32), 1e-2
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for lo in range(0, n, BATCH):
            pick = order[lo : lo + BATCH]
            cells = np.concatenate([own[i][0] for i in pick])
            x = np.concatenate([own[i][1] for i in pick])
            rows = np.repeat(np.arange(len(pick)), [len(own[i][0]) for i in pick])
            error = (_logistic(m.logits(rows, cells, x, len(pick))) - labels[pick]) / len(pick)
            step = error.sum()
            gb += step**2
            m.bias -= RATE * step / np.sqrt(gb)
            if not len(cells):
                continue
            first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            vx = m.v[cells] * x[:, None]
            sums = np.zeros((len(pick), FACTORS), np.float32)
            sums[rows[first]] = np.add.reduceat(vx, first)
            by = np.argsort(cells, kind="stable")
            start = np.flatnonzero(np.concatenate(([True], cells[by][1:] != cells[by][:-1])))
            touched = cells[by][start]
            e = error[rows].astype(np.float32) * x
            dw = np.add.reduceat(e[by], start)
            dv = np.add.reduceat((e[:, None] * (sums[rows] - vx))[by], start) + L2 * m.v[touched]
            gw[touched] += dw**2
            gv[touched] += dv**2
            rate = RATE / np.sqrt(gw[touched])
            w = m.w[touched] - rate * dw
            m.w[touched] = np.sign(w) * np.maximum(np.abs(w) - rate * L1, 0)
            m.v[touched] -= RATE * dv / np.sqrt(gv[touched])
    return m


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Machine:
    """docs: doc_id, text; labels: doc_id, toxic. Null ids and labels are left out; of several labels of one id the largest holds."""
    labels = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
    most = int(min(1.0, fit_rows / max(1, labels.count())) * (1 << 40))
    place = F.xxhash64("_id", F.lit(3)).bitwiseAND(F.lit((1 << 40) - 1))
    sample = labels.where(place < most).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))  # about fit_rows small rows

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch["text"], 1 << 20):
                rows, found, times = terms(batch["text"][lo:hi])
                cuts = np.searchsorted(rows, np.arange(hi - lo + 1))
                packed = [pa.array([x[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()) for x in (found, times)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"][lo:hi], batch["toxic"][lo:hi], *packed], ["doc_id", "toxic", "cells", "times"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("doc_id", F.col("_toxic").alias("toxic"), "text")
    got = sorted((r.doc_id, r.toxic, bytes(r.cells), bytes(r.times)) for r in rows.mapInArrow(thrifty(cells), "doc_id long, toxic int, cells binary, times binary").collect())
    return train([(np.frombuffer(c, "<u4").astype(np.int64), np.frombuffer(t, "<u4")) for _, _, c, t in got], np.array([float(r[1] > 0) for r in got]))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score and predicted of each row; null and empty texts have the bias alone. Texts of any length are read whole; rows that repeat a doc_id, or a text, are scored each by its own text. Other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch["text"], 1 << 20):
                s = shared.value.scores(batch["text"][lo:hi])
                yield pa.RecordBatch.from_arrays([batch["doc_id"][lo:hi], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(thrifty(run), "doc_id long, score double, predicted int")


def held_out() -> Column:
    return crc32_of_id() % 5 == 0


def op3_fm_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, machine).select("doc_id", held_out().alias("held_out"), "score", "predicted")
