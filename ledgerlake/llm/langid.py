"""Language identification by the nearest of several centroids of each language.

A text's vector holds, for hashed 3-grams of the bytes of its letters, the root of the count times
the inverse document frequency, scaled to length 1. Spherical k-means gives each language a few
centroids; the language of the centroid with the largest cosine is predicted, and its cosine is the
score. How high it gets depends on the language and on how many different 3-grams a text has: so
each language has a limit by that number, from a low quantile of the cosines of its fitted texts, each
with centroids that do not count the text itself. A text whose best cosine is below is rejected.

Document frequencies are counted over all learning rows. Centroids are fitted on a bounded
sample: FIT_ROWS learning rows of each language, those with the smallest hash of doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bound_batches, crc32_of_id, random_words, slices, table, thrifty, utf8_view

DIMS = 8192
FIT_ROWS = 600
CENTROIDS = 4
ROUNDS = 12
LOW, MARGIN = 0.01, 0.8  # texts are rejected below MARGIN times this quantile of the fitted texts' cosines
LEAST = 20  # fitted texts that a quantile is taken of, where there are as many
HALVES = 2 * 13 + 2  # half octaves up to DIMS different grams, and one more
NO_LANGUAGE = "und"

_BYTES = np.where([chr(x).isalpha() or x > 127 for x in range(128)] + [True] * 128, np.arange(256), 32).astype(np.uint8)
_FIRST, _SECOND, _THIRD = (random_words(256, s).astype(np.uint32) for s in (11, 12, 13))


def gram_counts(column: pa.Array) -> np.ndarray:
    """A row of DIMS counts for each text: 3-grams of bytes of lower-case letters, any run of other characters read as one blank."""
    lower = pc.utf8_lower(pc.fill_null(column, "").cast(pa.large_string()))
    data, offs = utf8_view(pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in (" ", lower, " ", ""))))
    n = len(offs) - 1
    data = _BYTES[data]
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(offs))
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    keep[offs[:-1]] = True  # every text has its own blank first
    data, row = data[keep], row[keep]
    if len(data) < 3:
        return np.zeros((n, DIMS), np.float32)
    cell = (_FIRST[data[:-2]] ^ _SECOND[data[1:-1]] ^ _THIRD[data[2:]]) & np.uint32(DIMS - 1)
    whole = row[:-2] == row[2:]
    return np.bincount((row[:-2].astype(np.int64) * DIMS + cell)[whole], minlength=n * DIMS).reshape(n, DIMS).astype(np.float32)


def has_letter(texts: list[str | None]) -> list[bool]:
    return [any(map(str.isalpha, t)) if t else False for t in texts]


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(counts, out=counts)
    v *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    return v / np.where(norm > 0, norm, 1)[:, None]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one a row
    language_of: np.ndarray
    limits: np.ndarray  # languages x HALVES: least cosine by half octaves of the number of different grams

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected, of each text."""
        if not len(self.centroids):
            return [NO_LANGUAGE] * len(column), np.zeros(len(column)), np.ones(len(column), bool)
        counts = gram_counts(column)
        halves = 2 * np.log2(np.maximum(np.count_nonzero(counts, axis=1), 1))
        cosines = vectors(counts, self.idf) @ self.centroids.T
        best = cosines.argmax(1)
        score = np.clip(cosines[np.arange(len(best)), best].astype(np.float64), 0, 1)
        letters = np.array(has_letter(column.to_pylist()), bool)
        names = [self.languages[k] if ok else NO_LANGUAGE for k, ok in zip(self.language_of[best], letters)]
        score[~letters] = 0
        lower, k = halves.astype(int), self.language_of[best]
        limit = self.limits[k, lower] + (halves - lower) * (self.limits[k, lower + 1] - self.limits[k, lower])
        return names, score, ~letters | (score < limit)


def _cluster(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from the row that is nearest to the mean, then each time the farthest from those chosen. Also each row's best cosine, its own part taken out of its centroid."""
    chosen = [int((v @ v.mean(0)).argmax())]
    near = v @ v[chosen[0]]
    while len(chosen) < min(k, len(v)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, v @ v[chosen[-1]])
    c = v[chosen]
    for _ in range(ROUNDS):
        own = (v @ c.T).argmax(1)
        sums = np.stack([v[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        norm = np.sqrt((sums**2).sum(1, keepdims=True))
        c = sums / np.where(norm > 0, norm, 1)
    cosines = v @ c.T
    own, rows = cosines.argmax(1), np.arange(len(v))
    full = [j for j in range(len(c)) if (own == j).any()]
    sums = np.stack([v[own == j].sum(0) for j in range(len(c))])
    dots, squares = np.einsum("ij,ij->i", v, sums[own]), (sums**2).sum(1)[own]
    rest = np.sqrt(np.maximum(squares - 2 * dots + 1, 0))
    cosines[rows, own] = np.where(rest > 1e-3, (dots - 1) / np.maximum(rest, 1e-3), 0)
    return c[full], cosines[:, full].max(1)


def _limits(grams: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    """The least cosine at each half octave of the number of different grams; it never falls with that number. Below the shortest fitted texts it goes with the root, beyond the longest it stays."""
    halves = 2 * np.log2(grams)
    knots, lows, group = [], [], []
    order = [np.flatnonzero(halves.astype(int) == h) for h in np.unique(halves.astype(int))]
    left = len(grams)
    for rows in order:
        group.append(rows)
        left -= len(rows)
        if left == 0 or (sum(map(len, group)) >= LEAST and left >= LEAST):
            of = np.concatenate(group)
            knots.append(halves[of].mean())
            lows.append(MARGIN * max(0.0, np.quantile(cosines[of], LOW)))
            group = []
    grid = np.arange(HALVES)
    lows = np.minimum.accumulate(lows[::-1])[::-1]
    return np.interp(grid, knots, lows) * np.minimum(1, 2 ** ((grid - knots[0]) / 4))


def fit(learning: DataFrame, fit_rows: int = FIT_ROWS, centroids: int = CENTROIDS) -> Model:
    """From doc_id, text and lang of learning rows; null langs, null texts and texts without letters are left out."""
    bound_batches(learning.sparkSession)
    learning = learning.where("lang is not null and text is not null").select("doc_id", "text", "lang")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS + 1, np.int64), 0
        for batch in batches:
            for lo, hi in slices(batch["text"], 1 << 20, 256):
                df[:DIMS] += (gram_counts(batch["text"][lo:hi]) > 0).sum(0)
                n += hi - lo
        df[DIMS] = n
        dims = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(df[dims])], ["dim", "n"])

    df = np.zeros(DIMS + 1)
    for r in learning.select("text").mapInArrow(thrifty(frequencies), "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect():
        df[r.dim] = r.n
    idf = (np.log((1 + df[DIMS]) / (1 + df[:DIMS])) + 1).astype(np.float32)

    place = F.xxhash64("doc_id", F.lit(7)).bitwiseAND(F.lit((1 << 40) - 1))
    rows = {r.lang: r.n for r in learning.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(rows)
    below = F.lit(0)
    for lang in languages:  # a hash below this leaves about fit_rows of the language
        below = F.when(F.col("lang") == lang, F.lit(int(min(1.0, fit_rows / rows[lang]) * (1 << 40)))).otherwise(below)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch["text"], 1 << 20, 256):
                counts = gram_counts(batch["text"][lo:hi])
                letters = has_letter(batch["text"][lo:hi].to_pylist())
                cells = [np.flatnonzero(c) for c in counts]
                keep = pa.array([ok and len(x) > 0 for ok, x in zip(letters, cells)])
                values = [pa.array([x.astype("<u2").tobytes() for x in cells], pa.binary()), pa.array([c[x].astype("<f4").tobytes() for c, x in zip(counts, cells)], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch["lang"][lo:hi], batch["place"][lo:hi], *values], ["lang", "place", "cells", "counts"]).filter(keep)

    sample = learning.withColumn("place", place).where(F.col("place") < below).select("lang", "place", "text")
    parts: dict[str, list] = {}
    for r in sample.mapInArrow(thrifty(sparse), "lang string, place long, cells binary, counts binary").collect():
        parts.setdefault(r.lang, []).append((r.place, bytes(r.cells), bytes(r.counts)))
    found, own, limits = [], [], np.zeros((len(languages), HALVES))
    for k, lang in enumerate(languages):
        got = sorted(parts.get(lang, []))[: 2 * fit_rows]
        v = np.zeros((len(got), DIMS), np.float32)
        for i, (_, cells, counts) in enumerate(got):
            v[i, np.frombuffer(cells, "<u2")] = np.frombuffer(counts, "<f4")
        if len(v):
            c, cosines = _cluster(vectors(v, idf), centroids)
            found.append(c)
            own += [k] * len(c)
            limits[k] = _limits(np.array([len(cells) // 2 for _, cells, _ in got]), cosines)
    return Model(languages, idf, np.concatenate(found).astype(np.float32) if found else np.zeros((0, DIMS), np.float32), np.array(own, int), limits)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected of each row. Texts that are null or have no letter are NO_LANGUAGE with score 0 and rejected; all are if no language was learned. One model of DIMS x centroids floats goes to each task."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch["text"], 1 << 20, 256):
                names, score, rejected = shared.value.predict(batch["text"][lo:hi])
                yield pa.RecordBatch.from_arrays([batch["doc_id"][lo:hi], pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(thrifty(run), "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """docs, all columns, without the rows that the model rejects. Null, empty and letterless texts are rejected or not as predict has it for them; repeated rows go or stay alike; texts of any type are read as strings, and as long as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch["text"].cast(pa.string())
            for lo, hi in slices(text, 1 << 20, 256):
                yield batch.slice(lo, hi - lo).filter(pa.array(~shared.value.predict(text[lo:hi])[2]))

    return docs.mapInArrow(thrifty(run), docs.schema)


def held_out() -> Column:
    return crc32_of_id() % 3 == 1


def op10_centroid_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, fit(docs.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
