import random
import zlib

import pytest
from pyspark.sql import functions as F

from tablegauge.llm.language_id import fit, counts, identify, train
from tablegauge.llm.queries import held_out, op9_language_id


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    out = op9_language_id(spark, folder).join(
        spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert sum(r.rejected for r in out) <= 5  # clean documents stay
    assert all(0 <= r.score <= 1 for r in out)


def test_training_ignores_held_out_labels_and_repeats(spark, documents):
    docs = documents.withColumn("lang", F.when(held_out(), "xx").otherwise(F.col("lang")))
    model = train(docs.unionByName(docs), "text", "lang", "doc_id", ~held_out())
    assert "xx" not in model.languages
    again = train(docs.repartition(3), "text", "lang", "doc_id", ~held_out())
    assert model.scores(["the thing"])[0].tolist() == pytest.approx(again.scores(["the thing"])[0].tolist(), rel=1e-6)


def test_rejection(spark, make_docs, documents):
    model = train(documents, "text", "lang", "doc_id")
    docs = make_docs([None, "", "123 !!", "the the thand", "x" * 200000, "the", "the"], {"score": "1", "lang_pred": "'q'"})
    out = {r.row.doc_id: r for r in identify(docs, model).collect()}
    assert [(out[i].lang_pred, out[i].score, out[i].rejected) for i in (0, 1, 2)] == [("und", 0.0, True)] * 3
    assert out[3].lang_pred == "en" and not out[3].rejected and out[5].score == out[6].score
    assert all(out[i].lang_pred in model.languages for i in (3, 4, 5))


def test_unlearned_languages_are_rejected(spark, make_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = train(docs.filter("lang <> 'es'"), "text", "lang", "doc_id")
    foreign = identify(docs.filter("lang = 'es' AND n_chars > 200"), model).collect()
    assert sum(r.rejected for r in foreign) >= 0.8 * len(foreign) > 0
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(300)) for _ in range(10)]
    texts += ["Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti.", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina."]
    assert all(r.rejected for r in identify(make_docs(texts), train(docs, "text", "lang", "doc_id")).collect())


def test_no_training_rows(spark, make_docs):
    docs = make_docs(["text"]).withColumn("lang", F.lit(None).cast("string"))
    assert train(docs, "text", "lang", "doc_id") is None
    assert [(r.lang_pred, r.rejected) for r in identify(docs, None).collect()] == [("und", True)]
    assert identify(make_docs([]), None).collect() == []


def test_one_language():
    model = fit([("en", c) for c in counts(["some text", "other text"])])
    assert model.languages == ["en"] and model.scores(["text"])[0, 0] == 1.0
