"""Held-out accuracy and odd texts."""

from pyspark.sql import functions as F

from studyloom.llm import language
from studyloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    got = QUERIES["op4_language"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    right, total, low, high = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*"), F.min("score"), F.max("score")).first()
    assert total > 50 and right >= 0.97 * total and 0 <= low <= high <= 1


def test_odd_texts(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs, per_language=40)
    assert set(model.families) == {"germanic", "romance"} and ("de", "en") in model.machines
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "7 as score", "'x' as lang_pred", "'y' as lang")
    got = {r.doc_id: r for r in language.predict(df, model).collect()}
    for i, t in enumerate(texts):
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= got[i].score <= 1 and got[i].text == t
    assert language.predict(df.where("false"), model).collect() == []


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some text", None), (None, "more", "en"), (3, None, "en")], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.predict(df, language.fit(df)).collect()] == ["und"] * 3
    one = spark.createDataFrame([(1, "some text", "xx"), (2, "12", "xx")], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.predict(one.orderBy("doc_id"), language.fit(one)).collect()] == ["xx", "und"]


def test_long_text_in_steps():
    text = "der die das und ein " * 4000
    whole, parts = language.features(text), language.features(text, step=1000)
    assert abs(whole.sum() - parts.sum()) < 0.02 * whole.sum()
