import zlib

import numpy as np
import pyarrow as pa
import pytest
from ledgerlake.llm import dac
from ledgerlake.llm._common import fresh_path

TEXTS = ["", None, "It's  the\tend.\n\n<|endoftext|> x", "ÀÉ ß Σίσυφος ΟΔΟΣ́ ́a 漢字 123 4567's", "a" * 3000 + " b" * 500, "same", "same", "\x1c\x1d mid\x0bvt\x0cff ls　wide", "don't WE'LL 'S", "İstanbul! ǅ. K? é... e\u0301, word\u0301. Ａ. ab1. 1. a.b, <|ENDOFTEXT|> <|endoftext|>! '. \u0958. x\u0338= ſ! ª º."]


def expected(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


@pytest.mark.parametrize("top", [3, 200, 49_000, 1 << 17, (1 << 32) - 1])
def test_any_token_is_read_alone(top):
    ids = np.random.default_rng(top).integers(0, top, 3001, dtype=np.uint64).astype(np.uint32) >> np.random.default_rng(1).integers(0, 12, 3001, dtype=np.uint32)
    shard = dac.Shard(dac.pack_shard([5, None], [3000, 1], ids))
    assert shard.all_ids().tolist() == ids.tolist() == [shard.token(i) for i in range(3001)]
    assert shard.doc_ids == [5, None] and shard.document(1) == [ids[-1]]


def test_ids_equal_the_library(spark):
    rows = [(i, x, "clash", 7) for i, x in enumerate(TEXTS)] + [(None, "null id", "c", 1), (3, "again", "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string, seq int")
    path = fresh_path(spark, "t")
    dac.write_tokens(spark, docs, path, shard_tokens=40)
    got = sorted(map(tuple, dac.read_tokens(spark, path).collect()), key=lambda r: r[1])
    rows.sort(key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    start = 0
    for (doc, text, *_), ids, row in zip(rows, expected(r[1] for r in rows), got, strict=True):
        assert row == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), text
        start += len(ids)


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(dac, "MOST_CACHED", 4)
    e = dac._Encoder(__import__("public_tokenizers").path("word_bpe_49k.json"))
    for t in ("One two three. four! five Six", "one Two three. Seven, six. six", "a b c d e f g h i", "One"):
        assert e.ids(pa.array([t]), 1)[0].tolist() == expected([t])[0]


def test_chunks_in_use_outlive_full_caches(monkeypatch):
    monkeypatch.setattr(dac, "MOST_CACHED", 12)
    e, asked = dac._Encoder(__import__("public_tokenizers").path("word_bpe_49k.json")), []
    encode = e._encode
    e._encode = lambda new: asked.extend(new) or encode(new)
    for k in range(40):
        t = f"The cat, {chr(97 + k % 26)}{chr(97 + k // 26)}x sat"
        assert e.ids(pa.array([t]), 1)[0].tolist() == expected([t])[0]
        assert len(e.known) + len(e.older) <= 32
    assert sorted(x for x in asked if x in ("the", "cat", "sat")) == ["cat", "sat", "the"]


def test_empty_table(spark):
    path = fresh_path(spark, "t")
    dac.write_tokens(spark, spark.createDataFrame([], "doc_id long, text string"), path)
    assert dac.read_tokens(spark, path).count() == 0


def test_whole_documents(spark):
    got = {r.doc_id: r for r in dac.op7_dac_tokens(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    assert len(got) == len(docs)
    for d, ids in zip(docs, expected(d.text for d in docs)):
        assert got[d.doc_id].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
