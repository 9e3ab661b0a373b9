import pyarrow as pa
from ledgerlake.llm import _common
from pyspark.sql import functions as F


def test_a_worker_keeps_one_operators_caches(spark):
    """The worker's own caches are cleared, not copies that came with the function."""

    def fill(batches):
        from ledgerlake.llm import pieces

        pieces._SEGMENTERS["x"] = 1
        yield from batches

    def look(batches):
        from ledgerlake.llm import pieces

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(pieces._SEGMENTERS)] * b.num_rows)], ["id"])

    one = spark.range(1, numPartitions=1)
    fill.__module__ = "ledgerlake.llm.pieces"
    one.mapInArrow(_common.thrifty(fill), "id long").collect()
    look.__module__ = "ledgerlake.llm.langid"
    assert one.mapInArrow(_common.thrifty(look), "id long").collect()[0].id == 0


def test_long_chunks_are_not_kept():
    """In scripts without blanks a chunk is a paragraph: caches hold none of those, so their count bounds their bytes."""
    import public_tokenizers
    from ledgerlake.llm import dac, pieces

    texts = pa.array(["文字" * 5000 + str(i) for i in range(5)] + ["some plain words, and " + "x" * 500 + "."])
    encoder, segmenter = dac._Encoder(public_tokenizers.path("word_bpe_49k.json")), pieces.Segmenter(public_tokenizers.path("piece_bpe_32k.model"))
    for _ in range(2):
        ids, n = encoder.ids(texts, 1)
        found = [own.tolist() for own, _ in segmenter.texts(texts)]
    assert ids[: n[0] - 1].tolist() == encoder.tokenizer.encode(texts[0].as_py(), add_special_tokens=False).ids
    assert found == [own.tolist() for own, _ in pieces.Segmenter(public_tokenizers.path("piece_bpe_32k.model")).texts(texts)]
    for kept, most in ((encoder.known, dac.LONGEST_CACHED), (segmenter.firsts, pieces.LONGEST_CACHED), (segmenter.parts, pieces.LONGEST_CACHED)):
        assert len(kept) > 3 and max(map(len, kept)) <= most


def test_batches_are_bounded(spark):
    _common.bound_batches(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= _common.BATCH_BYTES
    rows = spark.range(40).select(F.repeat(F.lit("x"), 1 << 20).alias("t")).coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    assert max(r.n for r in rows.mapInArrow(sizes, "n long").collect()) <= 2 * _common.BATCH_BYTES
