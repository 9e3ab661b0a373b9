"""Each stage against a plain version, on its own input."""

import corpus_pipeline
import pytest
from ledgerlake.llm import langid, pfair

from tests.llm.test_near_dups import brute
from tests.llm.test_recipes import brute as brute_exact

SF = "/root/testdata/sf0.01"


def test_stages_in_turn(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        seen[name], docs = (docs.collect(), spark.read.parquet(f"{tmp_path}/{k}")), spark.read.parquet(f"{tmp_path}/{k}")
    kept = {name: {r.doc_id for r in after.collect()} for name, (_, after) in seen.items()}

    before = seen["language_id"][0]
    rejected = {r.doc_id for r in langid.predict(spark.createDataFrame(before), langid.fit(spark.createDataFrame(before).where(~langid.held_out()))).collect() if r.rejected}
    assert kept["language_id"] == {r.doc_id for r in before} - rejected and len(rejected) < 10

    before = seen["exact_dedup"][0]
    assert kept["exact_dedup"] == {r[0] for r in brute_exact([(r.doc_id, r.text) for r in before]) if r[3]}
    before = seen["near_dedup"][0]
    assert kept["near_dedup"] == {r[0] for r in brute([(r.doc_id, r.text) for r in before], 80) if r[3]}
    assert kept["mix_sources"] == kept["encode_pieces"] == kept["near_dedup"]

    before = spark.createDataFrame(seen["mix_sources"][0])
    plan = {r.doc_id: (r.slot, r.begins) for r in pfair.schedule(before, pfair.SHARES).collect()}
    order = [plan[r.doc_id] for r in seen["encode_pieces"][0]]
    assert order == sorted(order)
    assert all(r.decoded for r in seen["encode_pieces"][1].collect())


def test_the_mixed_order_outlives_files_of_unequal_size(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, SF)
    rows = mixed.collect()
    for a, b in ((0, 5), (5, 150), (150, 160), (160, len(rows))):
        spark.createDataFrame(rows[a:b], docs.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/mixed")
    again = spark.read.parquet(f"{tmp_path}/mixed")
    want = [r.doc_id for r in rows]
    assert [r.doc_id for r in again.collect()] != want
    got = corpus_pipeline.STAGES[4][1](spark, again, SF).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: (r.slot, r.begins, r.doc_id))] == want
    monkeypatch.setattr(pfair, "SHARES", {"src4": 9})
    other = corpus_pipeline.STAGES[4][1](spark, again, SF).collect()
    assert [r.doc_id for r in sorted(other, key=lambda r: (r.slot, r.begins, r.doc_id))] != want


def test_odd_rows_and_extra_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score int, _place string, cid long"
    rows = [(1, None, None, None, None), (2, "", "en", "", 0), (3, "the cat sat on the mat and the dog", "en", "s", 9), (3, "the cat sat on the mat and the dog", "en", "s", 9), (4, "the cat sat on the mat and the dog", None, "s", 9), (None, "a dog and a cat on the mat", "en", None, 1), (5, "the dog " * 40_000, "en", "t", 1)]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame((out := stage(spark, docs, SF)).collect(), out.schema)
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["4", "5", "None"]


@pytest.mark.parametrize("k", range(5))
def test_empty_table(spark, k):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert corpus_pipeline.STAGES[k][1](spark, spark.createDataFrame([], schema), SF).count() == 0
