import base64
import zlib

import numpy as np
import pyarrow as pa
from ledgerlake.llm import langid
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, score int, rejected string, place int"
WORDS = {"xx": "ka ro mi lun tes vo", "yy": "qez jub wiq zop fyx hud"}


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def text(rng, lang, n=20):
    return " ".join(rng.choice(WORDS[lang].split(), n))


def test_counts_equal_a_plain_count():
    texts = ["Ab, ab!  c", None, "", "9", "É\nÉ", "a" * 5000]
    got = langid.gram_counts(pa.array(texts))
    for row, t in zip(got, texts):
        data = " " + "".join(c if c.isalpha() else " " for c in (t or "").lower()) + " "
        data = b" " + " ".join(data.split()).encode() + b" "
        want = np.zeros(langid.DIMS)
        for k in range(len(data) - 2 if data.strip() else 0):
            want[(langid._FIRST[data[k]] ^ langid._SECOND[data[k + 1]] ^ langid._THIRD[data[k + 2]]) & np.uint32(langid.DIMS - 1)] += 1
        assert (row == want).all(), t


def test_score_equals_a_plain_cosine(spark):
    rng = np.random.default_rng(3)
    model = langid.fit(docs_of(spark, [(i, text(rng, lang), lang) for i, lang in enumerate(["xx", "yy"] * 30)]))
    assert len(model.centroids) > 2 and np.allclose((model.centroids**2).sum(1), 1, atol=1e-5)
    texts = [text(rng, "yy"), "unheard " * 3, "ka"]
    names, score, _ = model.predict(pa.array(texts))
    for t, name, s in zip(texts, names, score):
        v = np.sqrt(langid.gram_counts(pa.array([t]))[0]) * model.idf
        cosines = model.centroids @ v / np.linalg.norm(v)
        assert abs(s - cosines.max()) < 1e-5 and name == model.languages[model.language_of[cosines.argmax()]]


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, text(rng, lang), lang) for i, lang in enumerate(["xx", "yy"] * 40)]
    rows += [(500, None, "xx"), (501, "", "yy"), (502, "12 34 !", "yy"), (503, text(rng, "xx"), None), (None, text(rng, "yy"), None), (7, "ka ro", None), (7, "ka ro", None), (504, "mi lun " * 40_000, None), (505, "漢字仮名 漢字", None)]
    docs = docs_of(spark, rows)
    got = langid.predict(docs, langid.fit(docs)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in (500, 501, 502))
    assert all(by[i].lang_pred == lang for i, _, lang in rows[:80] if i != 7)
    assert by[503].lang_pred == by[504].lang_pred == "xx" and by[None].lang_pred == "yy"
    assert by[505].rejected and by[505].lang_pred in WORDS and not by[503].rejected


def test_nothing_to_learn_or_predict(spark):
    empty = docs_of(spark, [])
    model = langid.fit(empty)
    assert langid.predict(empty, model).count() == 0
    assert [r.lang_pred for r in langid.predict(docs_of(spark, [(1, "abc", None)]), model).collect()] == ["und"]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = langid.op10_centroid_langid(spark, sf).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)
    assert sum(r.rejected for r in got) < 0.005 * len(got)


def test_what_is_no_learned_language_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    learning = docs.where(~langid.held_out())
    model = langid.fit(learning)
    clean = langid.predict(docs.where(langid.held_out() & F.col("lang").isNotNull() & F.col("text").rlike("[a-z]")), model)
    assert clean.where("rejected").count() <= 0.003 * clean.count()
    rng = np.random.default_rng(5)
    words = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), k)) for k in rng.integers(2, 10, n)) for n in (20, 300) * 20]
    assert model.predict(pa.array(words))[2].all()
    assert model.predict(pa.array([base64.b64encode(rng.bytes(n)).decode() for n in (150, 1500) * 20]))[2].all()
    for lang, least in (("en", 0.4), ("de", 0.9), ("fr", 0.9), ("es", 0.9)):
        other = langid.predict(docs.where(F.col("lang") == lang), langid.fit(learning.where(F.col("lang") != lang)))
        assert other.where("rejected").count() >= least * other.count()
