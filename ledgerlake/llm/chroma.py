"""Chroma fingerprints of audio, and their alignment.

PCM becomes frames of 12 pitch-class energies. Sixteen filters, each the log ratio of two
rectangles of the frames read off an integral image, give two Gray-coded bits a frame: one 32-bit
integer. Recordings whose integers are equal, silence at the ends left out, are one class. All classes
are indexed by pairs of their integers; a query class meets those that share one, votes for the difference
of their places, and the place with most votes is confirmed by the share of differing bits
over the whole overlap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, staged, table, thrifty

RATE, FRAME, HOP = 5512, 1024, 512
LOW_HZ, HIGH_HZ = 100.0, 2500.0
SPAN = 8  # frames that one integer sees
SILENT = 1e-6  # mean square of a frame, full scale 1
STEPS = (-0.3, 0.1, 0.45)  # of the quantiser, in log ratio; none at 0, where two empty rectangles lie
SEED_GAP = 2
LEAST_OVERLAP, MOST_ERRORS = 16, 0.05
QUERY_EVERY = 20
PAIRS_A_TASK = 1 << 22
ROWS_A_TASK = 2048  # of vectors to render


def _filters() -> list[tuple[np.ndarray, int, int, int, int]]:
    """kind, first class, classes, frames: kinds split a rectangle by time, by pitch, in quarters, or take its middle third of time against the rest."""
    return [(k % 4, (5 * k) % 9, (4, 2, 4, 3)[k % 4] if k < 8 else (2, 4, 2, 4)[k % 4], (4, 8, 6, 6)[(k // 4) % 4]) for k in range(16)]


FILTERS = _filters()
_GRAY = np.array([0, 1, 3, 2], np.uint32)
_HZ = np.fft.rfftfreq(FRAME, 1 / RATE)
_USED = np.flatnonzero((_HZ >= LOW_HZ) & (_HZ <= HIGH_HZ))
_CLASS = np.zeros((len(_USED), 12), np.float32)
_CLASS[np.arange(len(_USED)), np.round(12 * np.log2(_HZ[_USED] / 440)).astype(int) % 12] = 1
_WINDOW = np.hanning(FRAME).astype(np.float32)


def chroma(pcm: np.ndarray) -> np.ndarray:
    """Frames x 12, each of length 1 or, where silent, 0. A recording shorter than a frame has none."""
    if len(pcm) < FRAME:
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(pcm.astype(np.float32) / 32768, FRAME)[::HOP]
    loud = (frames**2).mean(1) > SILENT
    energy = np.abs(np.fft.rfft(frames * _WINDOW, axis=1)[:, _USED]).astype(np.float32) @ _CLASS
    norm = np.sqrt((energy**2).sum(1))
    return np.where(loud, 1 / np.where(norm > 0, norm, 1), 0)[:, None] * energy


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """One uint32 for each SPAN frames in a row; 0 where all are silent."""
    n = len(frames) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return image[at + t1, c1] - image[at + t0, c1] - image[at + t1, c0] + image[at + t0, c0]

    out = np.zeros(n, np.uint32)
    for k, (kind, c, h, w) in enumerate(FILTERS):
        t, half, third = w // 2, h // 2, w // 3
        whole = area(0, w, c, c + h)
        if kind == 0:
            a = area(0, t, c, c + h)
        elif kind == 1:
            a = area(0, w, c, c + half)
        elif kind == 2:
            a = area(0, t, c, c + half) + area(t, w, c + half, c + h)
        else:
            a = area(third, w - third, c, c + h)
        ratio = np.log((0.4 + a) / (0.4 + whole - a))
        out |= _GRAY[sum((ratio > s).astype(int) for s in STEPS)] << np.uint32(2 * k)
    return np.where(area(0, SPAN, 0, 12) > 0, out, np.uint32(0)).astype(np.uint32)


def recording(pcm: bytes | None) -> tuple[int, np.ndarray]:
    """Silent frames before the first other one, and the integers of the frames without silence at the ends."""
    pcm = pcm or b""
    frames = chroma(np.frombuffer(pcm[: len(pcm) // 2 * 2], "<i2"))
    on = np.flatnonzero(frames.any(1))
    return (int(on[0]), fingerprint(frames[on[0] : on[-1] + 1])) if len(on) else (0, np.zeros(0, np.uint32))


def fingerprints(media: DataFrame) -> DataFrame:
    """media: id, pcm (16-bit little-endian mono at RATE). Returns id, lead, ints, class_key; null and silent recordings have no ints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for pcm in batch["pcm"].to_pylist():
                lead, ints = recording(pcm)
                raw = ints.astype("<u4").tobytes()
                rows.append((lead, raw, hashlib.blake2b(raw, digest_size=16).digest()))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))] if rows else [pa.array([], t) for t in (pa.int32(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch["id"], *columns], ["id", "lead", "ints", "class_key"])

    return media.select(F.col("id").cast("long").alias("id"), "pcm").mapInArrow(thrifty(run), "id long, lead int, ints binary, class_key binary")


def _seeds(classes: DataFrame) -> DataFrame:
    """class_id, value, place: each integer with that SEED_GAP places on, where it begins (a held sound counts once). Pairs, as single integers meet by chance too often: their meetings would grow with the square of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values, places = [], [], []
            for k, raw in zip(batch["class_id"].to_pylist(), batch["ints"].to_pylist()):
                ints = np.frombuffer(raw, "<u4")
                begins = np.concatenate(([True], ints[1:] != ints[:-1])) & (ints > 0) if len(ints) else np.zeros(0, bool)
                at = np.flatnonzero(begins[: max(0, len(ints) - SEED_GAP)])
                ids.append(np.full(len(at), k, np.int64))
                values.append((ints[at].astype(np.uint64) << np.uint64(32) | ints[at + SEED_GAP]).view(np.int64))
                places.append(at.astype(np.int32))
            empty = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x + empty).astype(t)) for x, t in ((ids, np.int64), (values, np.int64), (places, np.int32))], ["class_id", "value", "place"])

    return classes.select("class_id", "ints").mapInArrow(thrifty(run), "class_id long, value long, place int")


def _meetings(asked: DataFrame, seeds: DataFrame) -> DataFrame:
    """All pairs of a query's seed and an equal seed of any class. A value whose pairs are over PAIRS_A_TASK is dealt over several parts by the class that holds it, and its queries go to each of these, so that no task has a common value whole."""
    counted = asked.groupBy("value").agg(F.count(F.lit(1)).alias("asked")).join(seeds.groupBy("value").agg(F.count(F.lit(1)).alias("held")), "value")
    hot = counted.where(F.col("asked") * F.col("held") > PAIRS_A_TASK).select("value", F.least(F.expr(f"asked * held div {PAIRS_A_TASK} + 1"), F.col("held")).alias("parts"))
    hot = staged(asked.sparkSession, hot, "hot")
    if hot.isEmpty():
        return asked.join(seeds, "value")
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    parts = F.coalesce("parts", F.lit(1))
    dealt = seeds.join(hot, "value", "left").withColumn("part", F.pmod(F.xxhash64("class_id", "place"), parts)).drop("parts")
    copies = asked.join(hot, "value", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
    return copies.join(dealt, ["value", "part"]).drop("part")


def overlap(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, float]:
    """How many integers overlap if b begins offset after a, and the share of differing bits."""
    lo, hi = max(0, offset), min(len(a), offset + len(b))
    if hi <= lo:
        return 0, 1.0
    return hi - lo, float(np.bitwise_count(a[lo:hi] ^ b[lo - offset : hi - offset]).mean()) / 32


def align(media: DataFrame, query_every: int = QUERY_EVERY) -> DataFrame:
    """Queries (ids that query_every divides) against all recordings. Columns: kind, id, class_id, other_class, frames, votes, overlap, bit_errors.

    A "member" row for each row of media: its class, named by the least id with the same integers,
    and in frames its silent lead. A "match" row for each query class (id and class_id) and other class that align:
    frames is where the other begins in the query, votes the equal pairs there, and at least
    LEAST_OVERLAP integers overlap with at most MOST_ERRORS of their bits different; members of one class
    align by definition, and the offset of two members is that of their classes plus the difference of
    their leads. Recordings without integers, null ones too, are members of class null and match nothing; so
    are those with a null id.
    """
    spark = media.sparkSession
    prints = staged(spark, fingerprints(media), "prints")
    able = prints.where("length(ints) > 0 and id is not null")
    classes = able.groupBy("class_key").agg(F.min("id").alias("class_id"), F.first("ints").alias("ints"), F.max((F.col("id") % query_every == 0).cast("int")).alias("asks"))
    classes = staged(spark, classes, "classes")
    seeds = staged(spark, _seeds(classes), "seeds")
    asked = staged(spark, seeds.join(classes.where("asks = 1").select("class_id"), "class_id", "left_semi").toDF("q", "value", "q_place"), "asked")
    votes = _meetings(asked, seeds).where("q != class_id").groupBy("q", F.col("class_id").alias("r"), (F.col("q_place") - F.col("place")).alias("frames")).agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("q", "r").agg(F.max(F.struct("votes", -F.abs("frames"), -F.col("frames"), "frames")).alias("top")).select("q", "r", "top.frames", "top.votes")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [overlap(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4"), f) for a, b, f in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["frames"].to_pylist())]
            on = pa.array([n >= LEAST_OVERLAP and e <= MOST_ERRORS for n, e in found], pa.bool_())
            size, errors = pa.array([n for n, _ in found], pa.int32()), pa.array([e for _, e in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch["q"], batch["r"], batch["frames"], batch["votes"], size, errors], ["q", "r", "frames", "votes", "overlap", "bit_errors"]).filter(on)

    for side, name in (("q", "a"), ("r", "b")):
        best = best.join(classes.select(F.col("class_id").alias(side), F.col("ints").alias(name)), side)
    matches = best.select("q", "r", "frames", "votes", "a", "b").mapInArrow(thrifty(confirm), "q long, r long, frames int, votes long, overlap int, bit_errors double")
    none = F.lit(None)
    members = prints.join(classes.select("class_key", "class_id"), "class_key", "left").withColumn("class_id", F.when(F.col("id").isNotNull(), F.col("class_id")))
    members = members.select(F.lit("member").alias("kind"), "id", "class_id", none.cast("long").alias("other_class"), F.col("lead").alias("frames"), none.cast("long").alias("votes"), none.cast("int").alias("overlap"), none.cast("double").alias("bit_errors"))
    return members.union(matches.select(F.lit("match"), F.col("q"), F.col("q"), "r", "frames", "votes", "overlap", "bit_errors"))


def tones(vector: np.ndarray, lead: int) -> np.ndarray:
    """PCM of a vector: after lead hops of silence a tone a component, of two hops, its pitch one of 24 semitones by the value."""
    pitch = np.clip(np.floor((np.nan_to_num(vector) + 0.3) * 40), 0, 23)
    hz = np.repeat(220 * 2 ** (pitch / 12), 2 * HOP)
    sound = np.sin(2 * np.pi * np.cumsum(hz) / RATE) * 12_000
    return np.concatenate((np.zeros(lead * HOP), sound)).astype("<i2")


def rendered(vectors: DataFrame) -> DataFrame:
    """A media column made of numbers, as the tables hold no audio: id, pcm of vec_id, embedding; null stays null. vec_id % 5 hops of silence lead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                pcm = [None if v is None else tones(np.array(v, float), (i or 0) % 5).tobytes() for i, v in zip(part["id"].to_pylist(), part["vector"].to_pylist())]
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(pcm, pa.binary())], ["id", "pcm"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.repartition(vectors.count() // ROWS_A_TASK + 1)  # a row is small and its sound is long: files say nothing of the work
    return rows.mapInArrow(thrifty(run), "id long, pcm binary")


def op2_chroma_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(rendered(table(spark, sf_dir, "embeddings")))
