"""SentencePiece segmentation, N best, and decoding.

All segmentations of a text into pieces of a given vocabulary form a lattice whose paths have the
sum of their pieces' scores. A forward Viterbi pass gives the best score up to each position; as
that is exactly what a path can still gain, it is a perfect heuristic for an A-star search from
the end backwards, which yields paths best first. The lattice of a text falls apart wherever no
piece of the vocabulary holds the two characters that meet there, so each distinct part is searched
once, and the N best of a text are merged from those of its parts: they differ from the best in at
most N - 1 parts, those whose second path loses least.

A character of no piece takes its byte pieces, or the unknown piece, at UNKNOWN below the least
score. Blanks read as U+2581, and one stands before the text. Nothing is trained here: pieces
and scores come from the model file. Its scores are merge ranks when it is a BPE model; the best
path is then the one of the least sum of ranks, not that of greedy merging.
"""

from __future__ import annotations

import gc
import heapq
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, count
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import CACHES, coded_chunks, gathered, slices, table, text_or_empty, thrifty, utf8_view

BLANK = "▁"
UNKNOWN = 10.0
N = 4
MOST_CACHED, LONGEST_CACHED, SHORT = 700_000, 64, 40  # chunks and parts kept, and characters of one: so the caches are bounded in bytes, whatever the script
SLICE_BYTES, MOST_IDS = 1 << 22, 1 << 19  # of texts taken at once: the more, the fewer chunks are looked up again; ids after which rows are handed on
_PARTS = re.compile(f"{BLANK}*[^{BLANK}\n]+|\n|{BLANK}+")

Path = tuple[float, tuple[int, ...]]


class Lattice:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        size = sp.vocab_size()
        self.unknown = sp.unk_id()
        self.bytes = {}
        self.pieces: dict[str, tuple[int, float]] = {}
        shown: list[bytes] = [b""] * size
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:-1], 16)
                self.bytes[value], shown[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.pieces[piece], shown[i] = (i, sp.get_score(i)), piece.replace(BLANK, " ").encode()
            elif sp.is_unknown(i):
                shown[i] = " ⁇ ".encode()
        self.least = min((s for _, s in self.pieces.values()), default=0.0) - UNKNOWN
        self.joined = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        self.longest = max(map(len, self.pieces), default=1)
        # By first and by last character: what follows, and id and score of the piece that is whole there or None.
        self.trie, self.endings = self._tree(lambda p: p), self._tree(lambda p: p[::-1])
        # All pieces' bytes in a row, for decoding.
        self.lengths = np.array([len(x) for x in shown], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.shown = np.frombuffer(b"".join(shown), np.uint8)

    def _tree(self, turned) -> dict:
        tree: dict = {}
        for p, edge in sorted((turned(p), edge) for p, edge in self.pieces.items()):
            node = tree
            for c in p[:-1]:
                node = node.setdefault(c, ({}, None))[0]
            node[p[-1]] = (node[p[-1]][0] if p[-1] in node else {}, edge)
        return tree

    def _edges(self, text: str) -> list[list[tuple[int, tuple[int, ...], float]]]:
        """For each end, the edges that reach it: start, ids, score; longest first."""
        n, ends = len(text), [[] for _ in range(len(text) + 1)]
        for i in range(n):
            single = False
            node = self.trie
            for j in range(i + 1, n + 1):
                step = node.get(text[j - 1])
                if step is None:
                    break
                node, edge = step
                if edge:
                    ends[j].append((i, (edge[0],), edge[1]))
                    single = single or j == i + 1
            if not single:
                ends[i + 1].append((i, self._fallback(text[i]), self.least))
        return ends

    def firsts(self, texts: list[str]) -> Iterator[tuple[tuple[int, ...], float, float]]:
        """Of each text the best ids, their score, and what the second path loses (infinite if there is none): a forward pass that keeps the two best scores up to each position. What it finds up to a position depends on the text before only, so that sorted texts share the work of their common beginnings."""
        never, endings, pieces, longest = -np.inf, self.endings, self.pieces, self.longest
        best, second, back, before = [0.0], [never], [(0, 0)], ""
        for text in texts:
            n, shared = len(text), 0
            for x, y in zip(text, before):
                if x != y:
                    break
                shared += 1
            del best[shared + 1 :], second[shared + 1 :], back[shared + 1 :]
            for j in range(shared + 1, n + 1):
                one, two, way, node, i = never, never, (j - 1, -1), endings, j
                for char in text[j - 1 : j - 1 - longest if j > longest else None : -1]:
                    if char not in node:
                        break
                    i -= 1
                    node, edge = node[char]
                    if edge:
                        gained = best[i] + edge[1]
                        if gained >= one:
                            other = second[i] + edge[1]
                            two = one if one > other else other
                            one, way = gained, (i, edge[0])
                        elif gained > two:
                            two = gained
                if text[j - 1] not in pieces:
                    gained = best[j - 1] + self.least
                    if gained > one:
                        two = max(one, second[j - 1] + self.least)
                        one, way = gained, (j - 1, -1)
                    elif gained > two:
                        two = gained
                best.append(one)
                second.append(two)
                back.append(way)
            ids, j = [], n
            while j:
                i, own = back[j]
                if own >= 0:
                    ids.append(own)
                else:
                    ids += self._fallback(text[i])[::-1]
                j = i
            yield tuple(reversed(ids)), best[n], best[n] - second[n]
            before = text

    def _fallback(self, char: str) -> tuple[int, ...]:
        raw = char.encode("utf-8", "surrogatepass")
        return tuple(self.bytes[b] for b in raw) if all(b in self.bytes for b in raw) else (self.unknown,)

    @staticmethod
    def _forward(ends: list) -> tuple[list[float], list]:
        ahead, back = [0.0] + [-np.inf] * (len(ends) - 1), [None] * len(ends)
        for j in range(1, len(ends)):
            for edge in ends[j]:
                if ahead[edge[0]] + edge[2] > ahead[j]:
                    ahead[j], back[j] = ahead[edge[0]] + edge[2], edge
        return ahead, back

    def search(self, text: str, n: int) -> list[Path]:
        """The n best paths of one part, A-star from the end: a path's rank is what it has gained plus the best score up to where it stands. Of equal ranks the one nearest to the start goes on first, so ties cost no more than n paths."""
        ends = self._edges(text)
        ahead, _ = self._forward(ends)
        turn = count()
        heap: list = [(-ahead[-1], len(text), next(turn), 0.0, None)]
        out: list[Path] = []
        while heap and len(out) < n:
            _, j, _, gained, tail = heapq.heappop(heap)
            if not j:
                ids: list[int] = []
                while tail:
                    ids += tail[0]
                    tail = tail[1]
                out.append((gained, tuple(ids)))
                continue
            for i, own, s in ends[j]:
                heapq.heappush(heap, (-(ahead[i] + s + gained), i, next(turn), gained + s, (own, tail)))
        return out

    def cut(self, chunk: str) -> list[str]:
        """Parts that no piece joins. Words are left whole; that costs nothing but a larger lattice."""
        if chunk[1:].isalpha():
            return [chunk]
        joined = self.joined
        at = [0, *[k for k, pair in enumerate(map(add, chunk, chunk[1:]), 1) if pair not in joined], len(chunk)]
        return [chunk[a:b] for a, b in zip(at, at[1:])]

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return gathered(self.shown, self.starts[ids], self.lengths[ids]).tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of whole ids, without the blank set before it."""
        out = self.bytes_of(ids)
        return out[1:] if out[:1] == b" " else out


def joined_chunks(column: pa.Array) -> pa.Array:
    """Each text in parts that begin at a blank or a newline, with U+2581 for its blanks, and with blanks between the parts."""
    out = pc.replace_substring(pc.replace_substring(column, " ", f" {BLANK}"), "\n", " \n ")
    out = pc.binary_join_element_wise(BLANK, out, "")
    odd = pc.or_(pc.or_(pc.match_substring(column, "  "), pc.match_substring(column, BLANK)), pc.or_(pc.starts_with(column, " "), pc.equal(column, "")))
    if pc.any(odd).as_py():  # runs of blanks stay together
        own = [" ".join(_PARTS.findall(BLANK + t.replace(" ", BLANK))) if t else "" for t in column.filter(odd).to_pylist()]
        out = pc.replace_with_mask(out, odd, pa.array(own, out.type))
    return out


def merge(lists: list[list[tuple]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best sums of one choice from each list: score and which was chosen of each."""
    out: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    for options in lists:
        out = sorted((a - option[0], c + (k,)) for a, c in out for k, option in enumerate(options))[:n]
    return [(-a, c) for a, c in out]


class Segmenter:
    """N best segmentations of many texts. What it finds of a chunk or a part it keeps: when half of MOST_CACHED were found or used again since the last time, those before go."""

    def __init__(self, path: str, n: int = N):
        self.lattice, self.n = Lattice(path), n
        self.known: dict[str, tuple[bytes, float, float]] = {"": (b"", 0.0, np.inf)}
        self.older: dict[str, tuple[bytes, float, float]] = {}
        self.searched: dict[str, tuple[list[tuple[float, np.ndarray]], bool]] = {}

    def _learn(self, new: list[str]) -> None:
        """Makes new known: as far as it was not, from its parts."""
        known, older, cut, parts = self.known, self.older, {}, set()
        for chunk in new:
            if chunk in older:
                known[chunk] = older[chunk]
                continue
            own = self.lattice.cut(chunk)
            parts.update(own)
            if len(own) > 1:
                cut[chunk] = own
        parts -= known.keys()
        again = parts & older.keys()
        known.update((p, older[p]) for p in again)
        parts = sorted(parts - again)
        for p, (ids, score, loss) in zip(parts, self.lattice.firsts(parts)):
            known[p] = struct.pack(f"<{len(ids)}I", *ids), score, loss
        for chunk, own in cut.items():
            blobs, scores, losses = zip(*[known[p] for p in own])
            known[chunk] = b"".join(blobs), sum(scores), min(losses)
        for x in (x for xs in (cut, parts) for x in xs if len(x) > LONGEST_CACHED):
            self.passing.append(x)

    def best(self, chunk: str) -> tuple[list[tuple[float, np.ndarray]], bool]:
        """The n best paths of one chunk, and whether each decodes to it; those of short ones are kept."""
        if chunk in self.searched:
            return self.searched[chunk]
        options = [self.lattice.search(part, self.n) for part in self.lattice.cut(chunk)]
        paths = [(s, np.array(tuple(chain.from_iterable(o[k][1] for o, k in zip(options, c))), "<u4")) for s, c in merge(options, self.n)]
        text = chunk.replace(BLANK, " ").encode("utf-8", "surrogatepass")
        out = paths, all(self.lattice.bytes_of(ids) == text for _, ids in paths)
        if len(chunk) <= SHORT:
            if len(self.searched) >= MOST_CACHED // 10:
                self.searched.clear()
            self.searched[chunk] = out
        return out

    def texts(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, list[tuple[float, int]]]]:
        """Of each text: the ids of the best segmentation; score and crc32 of the ids of each of the n best."""
        for paths, scores, _ in self.paths(texts):
            yield paths[0], [(s, zlib.crc32(ids)) for s, ids in zip(scores, paths)]

    def paths(self, texts: pa.Array) -> Iterator[tuple[list[np.ndarray], list[float], bool]]:
        """Of each text: ids and scores of each of the n best segmentations, and whether all others decode to what the best decodes to if that is the text."""
        gc.disable()
        try:
            if len(self.known) > MOST_CACHED // 2:
                self.known, self.older = {"": (b"", 0.0, np.inf)}, self.known
            chunks, numbers, rows = coded_chunks(joined_chunks(texts))
            found = list(map(self.known.get, chunks))
            if None in found:
                self.passing: list[str] = []
                self._learn([c for c, got in zip(chunks, found) if got is None])
                found = list(map(self.known.__getitem__, chunks))
                for x in self.passing:
                    self.known.pop(x, None)
        finally:
            gc.enable()
        blobs, scores, losses = zip(*found) if found else ((), (), ())
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        n = sizes[numbers]
        ids = gathered(np.frombuffer(b"".join(blobs), "<u4"), (np.cumsum(sizes) - sizes)[numbers], n)
        starts = np.concatenate(([0], np.cumsum(n)))
        scores, losses = np.array(scores)[numbers], np.array(losses)[numbers]
        few = self.n - 1
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
            loss = losses[a:b]
            paths, sums, alike = [ids[starts[a] : starts[b]]], [float(scores[a:b].sum())], True
            pick = np.arange(min(len(loss), few))
            if len(loss) > few > 0:  # those below the last of the smallest, then its equals in order
                last = np.partition(loss, few - 1)[few - 1]
                pick = np.sort(np.concatenate((np.flatnonzero(loss < last), np.flatnonzero(loss == last)))[:few])
            pick = [int(k) for k in pick if np.isfinite(loss[k])]
            options = []
            for k in pick:
                own, same = self.best(chunks[numbers[a + k]])
                options.append(own)
                alike = alike and same
            base = sums[0] - sum(o[0][0] for o in options)
            for score, choice in merge(options, self.n)[1:]:
                parts, done = [], starts[a]
                for k, o, c in zip(pick, options, choice):
                    parts += ids[done : starts[a + k]], o[c][1]
                    done = starts[a + k + 1]
                paths.append(np.concatenate([*parts, ids[done : starts[b]]]))
                sums.append(base + score)
            yield paths, sums, alike


_SEGMENTERS: dict[tuple[str, int], Segmenter] = {}
CACHES[__name__] = _SEGMENTERS.clear


def segmenter(path: str | None, n: int) -> Segmenter:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    if (path, n) not in _SEGMENTERS:
        _SEGMENTERS[path, n] = Segmenter(path, n)
    return _SEGMENTERS[path, n]


def lists_of(lists: list[np.ndarray]) -> pa.ListArray:
    offsets = pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*lists, np.zeros(0, "<u4")]).view(np.int32)))


def segment(docs: DataFrame, model_path: str | None = None, n: int = N) -> DataFrame:
    """One row per row of docs: doc_id, n_pieces, ids of the best segmentation, scores and crc32s (of ids as little-endian u32) of up to n best ones, best first, decoded: whether each of them decodes to the text, byte for byte, and other_ids: whole ids of the second best and those after it.

    Null counts as empty: no pieces, one segmentation of score 0. Equal scores stand in order of
    where the texts' parts first differ. A text that holds U+2581 itself decodes to blanks there, so
    decoded is false. Other columns are not read.
    """

    def row_batch(doc_ids: pa.Array, rows: list[tuple[list[np.ndarray], list[float], bool]]) -> pa.RecordBatch:
        best = [paths[0] for paths, _, _ in rows]
        others = lists_of([x for paths, _, _ in rows for x in paths[1:]])
        crcs = [list(map(zlib.crc32, paths)) for paths, _, _ in rows]
        more = pa.array(np.cumsum([0, *(len(paths) - 1 for paths, _, _ in rows)]), pa.int32())
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(list(map(len, best)), pa.int64()), lists_of(best), pa.array([x for _, x, _ in rows], pa.list_(pa.float64())), pa.array(crcs, pa.list_(pa.int64())), pa.array([x for _, _, x in rows]), pa.ListArray.from_arrays(more, others)], ["doc_id", "n_pieces", "ids", "scores", "crc32s", "decoded", "other_ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = segmenter(model_path, n)
        for batch in batches:
            for lo, hi in slices(batch["text"], SLICE_BYTES):
                texts = batch["text"][lo:hi]
                data, offs = utf8_view(texts)
                held, size = [], 0
                for k, (paths, sums, alike) in enumerate(s.paths(texts), 1):
                    held.append((paths, sums, alike and s.lattice.decode(paths[0]) == data[offs[k - 1] : offs[k]].tobytes()))
                    size += sum(map(len, paths))
                    if size >= MOST_IDS or k == hi - lo:
                        yield row_batch(batch["doc_id"][lo + k - len(held) : lo + k], held)
                        held, size = [], 0

    schema = "doc_id long, n_pieces long, ids array<int>, scores array<double>, crc32s array<long>, decoded boolean, other_ids array<array<int>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(thrifty(run), schema)


def op5_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment(table(spark, sf_dir, "documents"))
