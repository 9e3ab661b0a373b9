import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from ledgerlake.llm import pieces
from sentencepiece import SentencePieceProcessor

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string, scores int"
TEXTS = ["the cat", "a  b   c ", " lead", "x\n\ny\n", "\n", "ab\tc d", "naïve 漢字 \U0001f600", "12,5. don't", "▁ ▁x", "aaa", ", ,"]


@pytest.fixture(scope="module")
def lattice():
    return pieces.Lattice(PATH)


def brute(lattice, text, n):
    """Every path of the whole text, without parts."""
    if not text:
        return [(0.0, ())]
    ends = lattice._edges(pieces.BLANK + text.replace(" ", pieces.BLANK))
    known = {0: [(0.0, ())]}

    def paths(j):
        if j not in known:
            known[j] = [(a + s, c + ids) for i, ids, s in ends[j] for a, c in paths(i)]
        return known[j]

    return sorted(paths(len(ends) - 1), key=lambda p: -p[0])[:n]


@pytest.mark.parametrize("text", TEXTS)
def test_n_best_equal_brute_force(lattice, text):
    want = brute(lattice, text, 6)
    s = pieces.Segmenter(PATH, 6)
    (ids, ranked), = s.texts(pa.array([text]))
    assert [x for x, _ in ranked] == [x for x, _ in want] and len({c for _, c in ranked}) == len(ranked)
    everything = {zlib.crc32(np.array(c, "<u4").tobytes()): x for x, c in brute(lattice, text, 10**6)}
    assert all(everything[c] == x for x, c in ranked)


def test_search_comes_best_first_and_decodes(lattice):
    sp = SentencePieceProcessor(model_file=PATH)
    got = lattice.search("▁internationalisation", 50)
    assert [g[0] for g in got] == sorted((g[0] for g in got), reverse=True) and len({g[1] for g in got}) == 50
    assert {sp.decode(list(g[1])) for g in got} == {"internationalisation"}
    for ids, score, loss in lattice.firsts(["▁internationalisation"] * 2):
        assert score == got[0][0] and loss == got[0][0] - got[1][0] and ids in {g[1] for g in got if g[0] == score}
    words = sorted(["▁inter", "▁internal", "▁internationalism", "a\u0301b", "▁", "zzz", "", "naïf漢"])
    assert list(lattice.firsts(words)) == [next(iter(lattice.firsts([w]))) for w in words]


def test_decoding_equals_the_library(spark):
    sp = SentencePieceProcessor(model_file=PATH)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, None), (51, ""), (None, "x"), (1, "again"), (52, "word " * 30_000), (53, "q" * 60_000)]
    got = pieces.segment(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    for (_, text), r in zip(rows, got):
        text = text or ""
        assert r.decoded == (pieces.BLANK not in text) and r.n_pieces == len(r.ids)
        assert sp.decode(list(r.ids)) == text.replace(pieces.BLANK, " ")
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.crc32s[0]
        assert list(r.scores) == sorted(r.scores, reverse=True)
    assert pieces.segment(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ties_cost_no_more_than_n_paths(lattice):
    for text in ("a" * 3000, "ab" * 1500, "1" * 2000):
        got = lattice.search(text, 4)
        assert len({ids for _, ids in got}) == len(got) == (1 if text[0] == "1" else 4) and [s for s, _ in got] == sorted((s for s, _ in got), reverse=True)
        assert got[0][0] == next(iter(lattice.firsts([text])))[1]


def test_caches_are_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "MOST_CACHED", 3)
    s, fresh = pieces.Segmenter(PATH), pieces.Segmenter(PATH)
    for t in ("one two three four five six", "seven, eight nine", "one two"):
        assert [r for _, r in s.texts(pa.array([t]))] == [r for _, r in fresh.texts(pa.array([t]))]


@pytest.mark.parametrize("n", [1, 4])
def test_ids_of_all_n_best(spark, lattice, n, monkeypatch):
    monkeypatch.setattr(pieces, "MOST_IDS", 20)
    texts = [*TEXTS, None, "", "the " * 5000 + "cat"]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    for text, r in zip(texts, pieces.segment(docs, n=n).collect()):
        paths = [list(r.ids), *map(list, r.other_ids)]
        assert [zlib.crc32(np.array(p, "<u4").tobytes()) for p in paths] == list(r.crc32s) and len(r.scores) == len(paths) <= n
        assert all((lattice.decode(np.array(p, int)).decode() == (text or "")) == r.decoded for p in paths)
        if len(text or "") < 20:
            every = brute(lattice, text, 10**6)
            assert len(paths) == min(n, len(every)) and all((s, tuple(p)) in every for s, p in zip(r.scores, paths))


def test_chunks_in_use_outlive_full_caches(monkeypatch):
    monkeypatch.setattr(pieces, "MOST_CACHED", 12)
    s, learnt = pieces.Segmenter(PATH), []
    firsts = s.lattice.firsts
    s.lattice.firsts = lambda parts: learnt.extend(parts) or firsts(parts)
    for k in range(40):
        list(s.texts(pa.array([f"the cat {chr(97 + k % 26)}{chr(97 + k // 26)}x sat"])))
        assert len(s.known) + len(s.older) <= 24
    assert sorted(c for c in learnt if c in ("▁the", "▁cat", "▁sat")) == ["▁cat", "▁sat", "▁the"]


def test_whole_documents(spark):
    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    lattice = pieces.Lattice(PATH)
    got = pieces.op5_nbest_pieces(spark, sf).collect()
    assert len(got) == len(text) and all(r.decoded and len(r.scores) == pieces.N for r in got if len(text[r.doc_id]) > 20)
    for r in sorted(got, key=lambda r: len(text[r.doc_id]))[:25]:  # the whole lattice at once, without parts
        paths = lattice.search(pieces.BLANK + text[r.doc_id].replace(" ", pieces.BLANK), pieces.N)
        assert list(r.scores) == [s for s, _ in paths]
