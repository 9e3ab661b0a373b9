"""Token ids in directly addressable codes (DAC).

Each id is cut into chunks, lowest first; level 0 holds the first chunk of every id, level k
the next chunk of those ids that go on. Beside each level but the last stand a bitmap of
which ids go on and a rank directory (ones before every 512th bit), so any token is read by
one chunk and one rank a level, with no block to decode.

File image, little-endian:
    8 bytes magic, u32 documents, u32 levels, u64 tokens, 8 bytes chunk widths in bits,
    i64 id and u8 null flag of each document, u64 start of each document and the end,
    then for each level: u64 count, packed chunks, and, if not last, bitmap and u32 ranks.

Images stand in a Parquet table, one row a shard, so that they can be written to and read from
any store that Spark reaches, and commit whole or not at all.
"""

from __future__ import annotations

import gc
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import CACHES, coded_chunks, fresh_path, gathered, slices, text_or_empty, thrifty

# Fixed values of the file format.
MAGIC = b"LLDAC\x00\x00\x01"
WIDTHS = ((8, 8), (4, 4, 8), (4, 4, 4, 4), (16,), (8, 8, 8, 8), (16, 16))
RANK_EVERY = 512

SHARD_TOKENS = 1 << 20
MOST_CACHED, LONGEST_CACHED = 1_200_000, 64  # chunks, and characters of one: so the cache is bounded in bytes, whatever the script
SHARDS = "part int, seq int, n_docs long, n_tokens long, image binary"
ROWS = "part int, seq int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def _pack(chunks: np.ndarray, width: int) -> bytes:
    if width == 4:
        chunks = np.append(chunks, 0) if len(chunks) % 2 else chunks
        return (chunks[::2] | chunks[1::2] << 4).astype(np.uint8).tobytes()
    return chunks.astype({8: "<u1", 16: "<u2"}[width]).tobytes()


def _unpack(data: memoryview, n: int, width: int) -> np.ndarray:
    if width == 4:
        both = np.frombuffer(data, np.uint8)
        return np.stack((both & 15, both >> 4), 1).ravel()[:n]
    return np.frombuffer(data, {8: "<u1", 16: "<u2"}[width])


def _bits(n: int, width: int) -> int:
    return (n + 1) // 2 if width == 4 else n * width // 8


def best_widths(ids: np.ndarray) -> tuple[int, ...]:
    """Of the widths that hold the largest id, those that take the fewest bits."""
    bits = int(ids.max()).bit_length() if len(ids) else 1

    long = {0: len(ids)} | {k: int(np.count_nonzero(ids >> np.uint32(k))) for k in (4, 8, 12, 16, 24)}

    def cost(widths: tuple[int, ...]) -> int:
        total, below = 0, 0
        for k, w in enumerate(widths):
            here = long[below]
            total += here * (w + (k < len(widths) - 1))
            below += w
        return total

    return min((w for w in WIDTHS if sum(w) >= bits), key=cost)


def pack_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    widths = best_widths(ids)
    starts = np.zeros(len(lengths) + 1, "<u8")
    np.cumsum(lengths, out=starts[1:])
    out = [MAGIC, struct.pack("<IIQ8s", len(doc_ids), len(widths), len(ids), bytes(widths))]
    out += [np.array([x or 0 for x in doc_ids], "<i8").tobytes(), bytes(x is None for x in doc_ids), starts.tobytes()]
    rest = ids.astype(np.uint32)
    for k, w in enumerate(widths):
        out += [struct.pack("<Q", len(rest)), _pack(rest & np.uint32((1 << w) - 1), w)]
        if k < len(widths) - 1:
            rest = rest >> np.uint32(w)
            on = rest > 0
            ranks = np.add.reduceat(on, np.arange(0, len(on), RANK_EVERY), dtype=np.uint32) if len(on) else np.zeros(0, np.uint32)
            out += [np.packbits(on, bitorder="little").tobytes(), (np.cumsum(ranks) - ranks).astype("<u4").tobytes()]
            rest = rest[on]
    return b"".join(out)


class Shard:
    """A file image opened for reading: any token by position, any document, or all ids."""

    def __init__(self, image: bytes):
        data = memoryview(image)
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a DAC image")
        n, levels, self.n_tokens, widths = struct.unpack_from("<IIQ8s", data, 8)
        at = 8 + struct.calcsize("<IIQ8s")

        def take(size: int) -> memoryview:
            nonlocal at
            at += size
            return data[at - size : at]

        ids, nulls = np.frombuffer(take(8 * n), "<i8"), bytes(take(n))
        self.doc_ids = [None if null else int(x) for x, null in zip(ids, nulls)]
        self.starts = np.frombuffer(take(8 * (n + 1)), "<u8").astype(np.int64)
        self.levels: list[tuple[np.ndarray, int, memoryview | None, np.ndarray | None]] = []
        for k, w in enumerate(widths[:levels]):
            count = struct.unpack("<Q", take(8))[0]
            chunks = _unpack(take(_bits(count, w)), count, w)
            last = k == levels - 1
            bitmap = None if last else take((count + 7) // 8)
            ranks = None if last else np.frombuffer(take(4 * -(-count // RANK_EVERY)), "<u4")
            self.levels.append((chunks, w, bitmap, ranks))

    def token(self, i: int) -> int:
        value = shift = 0
        for chunks, w, bitmap, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if bitmap is None or not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_EVERY
            before = int.from_bytes(bitmap[block * RANK_EVERY // 8 : i // 8 + 1], "little") & ((1 << (i - block * RANK_EVERY)) - 1)
            i, shift = int(ranks[block]) + before.bit_count(), shift + w
        return value

    def all_ids(self) -> np.ndarray:
        value = None
        for chunks, w, bitmap, _ in reversed(self.levels):
            here = chunks.astype(np.uint32)
            if bitmap is not None:
                on = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(here), bitorder="little").astype(bool)
                here[on] |= value << np.uint32(w)
            value = here
        return value

    def document(self, k: int) -> list[int]:
        return [self.token(i) for i in range(self.starts[k], self.starts[k + 1])]


class _Encoder:
    """Ids of whole texts. The normaliser and the splitter of the tokenizer treat white space as a border and drop it, so a text's ids are those of its blank-separated chunks in turn; each distinct chunk is encoded by the library once. Only blank, newline and tab are cut at, which are white space to every version of it.

    The splitter also parts a letter from the marks of TAIL after it, and the normaliser lowers
    case, so "Word," and "WORD" need no encoding of their own. Plain words are encoded many to a
    call, with blanks between, and told apart by the vocabulary's word-end sign.
    """

    TAIL = ".,!?%&$#*;:"  # no mark of these begins a contraction or stands in a special token
    WORDS_A_CALL = 256

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for x, i in vocab.items() if x.endswith("</w>")]] = True
        self.plain = bool(self.ends.any())
        self.words = Tokenizer.from_file(path)  # for words that the normaliser leaves as they are
        self.words.normalizer = None
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # When half of MOST_CACHED were found or used again since the last time, those before go.
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.passing: list[str] = []

    def _encode(self, new: set[str]) -> None:
        plain, other = [], []
        for x in new:
            (plain if self.plain and x.isalpha() and (x.isascii() or max(x) < "\u0130") and x.lower() == x else other).append(x)
        lines = [" ".join(plain[lo : lo + self.WORDS_A_CALL]) for lo in range(0, len(plain), self.WORDS_A_CALL)]
        for k, e in enumerate(self.words.encode_batch_fast(lines, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            words, cuts, data = plain[k * self.WORDS_A_CALL : (k + 1) * self.WORDS_A_CALL], (4 * np.flatnonzero(self.ends[ids]) + 4).tolist(), ids.tobytes()
            if len(cuts) != len(words):
                raise ValueError("a plain word is not one word to this tokenizer")
            self.known.update(zip(words, [data[a:b] for a, b in zip([0, *cuts], cuts)]))
        for lo in range(0, len(other), 4096):
            part = other[lo : lo + 4096]
            for x, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.known[x] = np.array(e.ids, "<u4").tobytes()

    def _learn(self, chunks: list[str]) -> None:
        parts, need, known, older = {}, set(), self.known, self.older
        for x in chunks:
            if x in older:
                known[x] = older[x]
                continue
            if x.isascii() and x.isalpha():
                core, tail = x.lower(), ""
            else:
                core, tail = x.rstrip(self.TAIL), ""
                if len(core) < len(x) and core and core[-1].isalpha() and core[-1] < "\u0130":
                    tail = x[len(core) :]
                else:
                    core = x
                if core.isascii() and core.isalpha():
                    core = core.lower()
            if core != x:
                parts[x] = core, tail
                need.add(tail)
            need.add(core)
        need -= known.keys()
        again = need & older.keys()
        known.update((x, older[x]) for x in again)
        self._encode(need - again)
        for x, (core, tail) in parts.items():
            known[x] = known[core] + known[tail]
        self.passing += [x for x in need | parts.keys() if len(x) > LONGEST_CACHED]

    def ids(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, end_id after each, and how many each has."""
        gc.disable()  # of the many objects made here none is in a cycle
        try:
            if len(self.known) > MOST_CACHED // 2:
                self.known, self.older = {"": b""}, self.known
            for space in "\n\t":
                texts = pc.replace_substring(texts, space, " ")
            chunks, numbers, rows = coded_chunks(texts)
            own = list(map(self.known.get, chunks))
            if None in own:
                self._learn([x for x, ids in zip(chunks, own) if ids is None])
                own = list(map(self.known.__getitem__, chunks))
                for x in self.passing:
                    self.known.pop(x, None)
                self.passing = []
        finally:
            gc.enable()
        own.append(np.array([end_id], "<u4").tobytes())
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        pool, starts = np.frombuffer(b"".join(own), "<u4"), np.cumsum(sizes) - sizes
        numbers = np.insert(numbers, rows[1:], len(chunks))
        n = sizes[numbers]
        return gathered(pool, starts[numbers], n), np.add.reduceat(n, rows[:-1] + np.arange(len(rows) - 1))


_ENCODERS: dict[str, _Encoder] = {}
CACHES[__name__] = _ENCODERS.clear


def encoder(path: str | None) -> _Encoder:
    """One a worker and tokenizer; tasks that follow in the same worker find its chunks known."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path]


def write_tokens(spark: SparkSession, docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = 1, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes each text, appends end_id, writes shards in ascending (doc_id, text) order; null ids come first, null texts count as empty. A shard closes at shard_tokens; a document is never cut."""
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        encode_texts = encoder(tokenizer_path).ids
        held: list[np.ndarray] = []
        ids: list[int | None] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal seq
            tokens = np.concatenate(held)
            image = pack_shard(ids, [len(x) for x in held], tokens)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([len(tokens)], pa.int64()), pa.array([image], pa.binary())], ["part", "seq", "n_docs", "n_tokens", "image"])
            seq += 1
            held.clear()
            ids.clear()
            return row

        for batch in batches:
            for lo, hi in slices(batch["text"], 1 << 22):
                tokens, n = encode_texts(batch["text"][lo:hi], end_id)
                for doc, own in zip(batch["doc_id"][lo:hi].to_pylist(), np.split(tokens, np.cumsum(n)[:-1])):
                    held.append(own)
                    ids.append(doc)
                    size += len(own)
                    if size >= shard_tokens:
                        yield close()
                        size = 0
        if ids:
            yield close()

    ordered.mapInArrow(thrifty(encode), SHARDS).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    shards = spark.read.schema(SHARDS).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, image in zip(batch["part"].to_pylist(), batch["seq"].to_pylist(), batch["image"]):
                shard = Shard(image.as_buffer())
                data = memoryview(shard.all_ids().astype("<u4").tobytes())
                s = shard.starts
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(s[:-1].tolist(), s[1:].tolist())]
                n = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)), pa.array(shard.doc_ids, pa.int64()), pa.array(s[:-1]), pa.array(np.diff(s)), pa.array(crc, pa.int64())], ["part", "seq", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    # Prefix sums in two steps: over a partition's shards, then over one row a partition.
    sizes = shards.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    parts = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("part_start"))
    firsts = sizes.select("part", "seq", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")).alias("shard_start"))
    firsts = firsts.join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("shard_start")).alias("shard_start"))
    rows = shards.select("part", "seq", "image").mapInArrow(thrifty(decode), ROWS)
    return rows.join(firsts, ["part", "seq"]).select("doc_id", (F.col("shard_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op7_dac_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    write_tokens(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_tokens(spark, path)
