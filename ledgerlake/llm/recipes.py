"""Exact deduplication by content-defined chunk recipes.

A text is cut where a rolling hash of the last 32 bytes says so, which depends on the content
alone; each chunk becomes an identifier, and a document its ordered list of identifiers (its
recipe). Chunk bytes are shuffled once, in the check that makes identifiers verified: bytes that
differ under one digest get different identifiers. Documents are then compared by recipe only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import by_id, random_words, slices, staged, table, text_or_empty, thrifty, utf8_view

WINDOW = 32
LEAST, MOST, MEAN_BITS = 256, 8192, 10
GEAR = random_words(256, 5).astype(np.uint32)
CHUNK = "digest binary, content binary"
RECIPE = "doc_id long, text_sha256 string, recipe binary"


def cut_points(data: np.ndarray, offs: np.ndarray) -> list[list[int]]:
    """For each row its chunk borders, both ends included; an empty row is one empty chunk."""
    h = GEAR[data]
    step = 1
    while step < WINDOW:  # the window doubles: h[i] then covers bytes i - 2 * step + 1 .. i
        wider = h.copy()
        wider[step:] += h[:-step] << np.uint32(step)
        h, step = wider, 2 * step
    found = np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1
    out = []
    for lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist()):
        cuts, here = [lo], found[np.searchsorted(found, lo) : np.searchsorted(found, hi, "left")].tolist()
        for cut in here:
            while cut - cuts[-1] > MOST:
                cuts.append(cuts[-1] + MOST)
            if cut - cuts[-1] >= LEAST:
                cuts.append(cut)
        while hi - cuts[-1] > MOST:
            cuts.append(cuts[-1] + MOST)
        out.append([*cuts, hi])
    return out


def _chunks(column: pa.Array, digest_bytes: int) -> Iterator[tuple[int, memoryview, list[memoryview], list[bytes]]]:
    """Row number, whole text, chunks and digests of each row."""
    for lo, hi in slices(column, 1 << 22):
        data, offs = utf8_view(column[lo:hi])
        view = memoryview(data)
        for k, cuts in enumerate(cut_points(data, offs)):
            parts = [view[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            yield lo + k, view[cuts[0] : cuts[-1]], parts, [hashlib.blake2b(p, digest_size=digest_bytes).digest() for p in parts]


def recipes(docs: DataFrame, digest_bytes: int = 16) -> DataFrame:
    """doc_id, text_sha256 and the digests of its chunks in order, joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha, recipe = [], []
            for _, text, _, digests in _chunks(batch["text"], digest_bytes):
                sha.append(hashlib.sha256(text).hexdigest())
                recipe.append(b"".join(digests))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sha, pa.string()), pa.array(recipe, pa.binary())], ["doc_id", "text_sha256", "recipe"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(thrifty(run), RECIPE)


def chunks(docs: DataFrame, digest_bytes: int = 16, positions: bool = False) -> DataFrame:
    """A row for each chunk: digest and content, and on demand whose it is and where."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            rows: list[tuple] = []
            size = 0

            def out() -> pa.RecordBatch:
                columns = [pa.array(x, t) for x, t in zip(zip(*rows), types)]
                rows.clear()
                return pa.RecordBatch.from_arrays(columns, names)

            for k, text, parts, digests in _chunks(batch["text"], digest_bytes):
                sha = hashlib.sha256(text).hexdigest() if positions else None
                for pos, (part, digest) in enumerate(zip(parts, digests)):
                    rows.append((digest, bytes(part), ids[k], sha, pos) if positions else (digest, bytes(part)))
                    size += len(part)
                if size > 1 << 22:
                    yield out()
                    size = 0
            if rows:
                yield out()

    types = [pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.int32()]
    names = ["digest", "content", "doc_id", "text_sha256", "pos"][: 5 if positions else 2]
    schema = CHUNK + (", doc_id long, text_sha256 string, pos int" if positions else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(thrifty(run), schema)


def clashes(docs: DataFrame, digest_bytes: int = 16) -> DataFrame:
    """Chunks whose digest stands for other bytes too, with their number among these; empty but for hash collisions."""
    known = chunks(docs, digest_bytes).groupBy("digest", "content").count().select("digest", "content")
    known = staged(docs.sparkSession, known.withColumn("size", F.length("content")), "dictionary") if digest_bytes < 8 else known
    twice = known.groupBy("digest").count().where("count > 1").select("digest")
    if digest_bytes >= 8:  # a second look at the bytes only if the first found a clash
        twice = staged(docs.sparkSession, twice, "clashes")
        if twice.isEmpty():
            return docs.sparkSession.createDataFrame([], "digest binary, content binary, ordinal int")
    return known.select("digest", "content").join(twice, "digest").withColumn("ordinal", F.row_number().over(Window.partitionBy("digest").orderBy("content")))


def exact_groups(docs: DataFrame, digest_bytes: int = 16) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and empty texts are copies of each other. keep_id is the largest
    doc_id of the group; null ids lose to all others, and rows that repeat the kept doc_id are
    all marked kept. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    clash = clashes(docs, digest_bytes)
    rows = staged(spark, recipes(docs, digest_bytes), "recipes")
    if clash.isEmpty():
        rows = rows.withColumn("ordinals", F.lit(b""))
    else:
        where = chunks(docs, digest_bytes, positions=True).join(clash, ["digest", "content"])
        where = where.groupBy("doc_id", "text_sha256").agg(F.to_json(F.sort_array(F.collect_set(F.struct("pos", "ordinal")))).cast("binary").alias("ordinals"))
        where = where.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "ordinals")
        rows = rows.join(where, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_sha256") == F.col("_sha")), "left").drop("_id", "_sha").withColumn("ordinals", F.coalesce("ordinals", F.lit(b"")))
    groups = rows.groupBy("recipe", "ordinals").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    out = rows.join(groups, ["recipe", "ordinals"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the copies: of equal texts the row with the largest doc_id; rows that repeat it in full go too."""
    groups = staged(docs.sparkSession, exact_groups(docs).select("doc_id", "kept"), "groups")
    out = by_id(docs, groups.where("not kept").select("doc_id").distinct(), "left_anti")
    twice = groups.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return out
    return by_id(out, twice, "left_anti").unionByName(by_id(out, twice, "left_semi").distinct())


def op1_chunk_recipe_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""
