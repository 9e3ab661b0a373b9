"""What the operators share: the shared work folder, null-safe columns, byte views of Arrow text."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import work
from ..plans.work import shared_path

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the application ends."""
    bound_batches(spark)
    return shared_path(spark, name)


def staged(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df written once and read back: what follows neither repeats its work nor depends on the executors that did it."""
    bound_batches(spark)
    return work.staged(spark, df, name)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc32_of_id(name: str = "doc_id") -> Column:
    """crc32 of the id's decimal text; a null id counts as the empty text, so as 0."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


#: What workers keep between tasks, by module: each a function that lets go of it.
CACHES: dict[str, Callable[[], None]] = {}
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Texts are long: batches to Python are bounded by bytes, unless the session asks for less already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, "67108864").rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def _let_go_of_others(module: str) -> None:
    for name, let_go in CACHES.items():
        if name != module:
            let_go()


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def thrifty(run):
    """run, a function for mapInArrow, that is modest in memory: idle workers share an executor's with busy ones. A worker keeps the caches of the operator at hand only, and gives unused memory back when its task ends."""
    module = run.__module__

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _let_go_of_others(module)
        yield from run(batches)
        _give_back()

    return wrapped


def utf8_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and its n + 1 offsets; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def slices(column: pa.Array, most_bytes: int, most_rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes and rows; a longer row stands alone."""
    _, offs = utf8_view(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + most_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), n, lo + most_rows)
        yield lo, hi
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random_words(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random uint64."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def word_spans(is_word: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes; no run crosses a row's end."""
    n = len(is_word)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    starts = is_word & np.concatenate(([True], ~is_word[:-1] | edge[1:n]))
    ends = is_word & np.concatenate((~is_word[1:] | edge[1:n], [True]))
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


class SpanHasher:
    """64-bit hashes of spans of a byte array, all at once: prefix sums of a polynomial over random byte values, then a mix."""

    BASE = 0x9E3779B97F4A7C15 | 1
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self, seed: int = 17):
        self.values = random_words(256, seed)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, 2 * len(self.powers))
            for name, base in (("powers", self.BASE), ("inverses", self.INVERSE)):
                out = np.empty(size, np.uint64)
                out[0] = 1
                out[1:] = np.uint64(base)
                setattr(self, name, np.multiply.accumulate(out))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=out[1:])
        return out

    def of_sums(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.of_sums(self.sums(data), starts, ends)


def coded_chunks(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The blank-separated chunks of each text: the distinct ones, the number of each in turn, and where each row's begin and end. A row has one chunk at least."""
    lists = pc.split_pattern(column, " ")
    coded = lists.flatten().dictionary_encode()
    offs = np.asarray(lists.offsets)
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(coded.indices), offs - offs[0]


def gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Slices of pool, one after the other."""
    return pool[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


BROADCAST_ROWS = 1 << 21


def by_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """left_semi or left_anti join of docs with a one-column table of distinct doc_ids; a null id equals a null id. Any columns of docs stay as they are. 16 MB of ids at most go to every task; beyond that docs are dealt by id."""
    ids = staged(docs.sparkSession, ids, "ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    name = "_id"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    ids = ids.toDF(name)
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids[name]), how)
