"""The cascade against its SQL twin and a plain count."""

import re
from collections import Counter

from check import canonical
from pyspark.sql import functions as F

from studyloom.llm import rules
from studyloom.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len({i + d for i, w in enumerate(windows) if often[w] > 1 for d in range(3)}))


def test_measures(spark, texts):
    more = ["a b c a b c", "a b c a b", "a a a", "a a a a", "l\nl\n\n \nl\nm #1 <x>", "a b c d a b c x b c d", " wide space", "a b\x1cc"]
    docs = list(enumerate([*texts, *more]))
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_words", "2 as _h")
    got = {r.doc_id: tuple(r)[1:6] for r in rules.cascade(df).collect()}
    assert got == {i: plain(t) for i, t in docs}
    assert rules.cascade(df.where("false")).collect() == []


def test_order_changes_no_verdict(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    forward = rules.cascade(df).select("doc_id", "kept").collect()
    backward = rules.cascade(df, rules.default_rules()[::-1]).select("doc_id", "kept").collect()
    assert sorted(forward) == sorted(backward)


def test_cheap_rejecting_rules_come_first(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"))
    slow = F.expr("aggregate(sequence(1, 3000), 0L, (a, x) -> a + x * doc_id)") < -1
    got = rules.ordered(df, [rules.Rule("slow", slow), rules.Rule("never", F.lit(False)), rules.Rule("half", F.col("doc_id") % 2 == 0)])
    assert got[0].name == "half"


def test_query(spark, duck):
    df = QUERIES["op8_quality_rules"](spark, SF)
    cur = duck.execute(SQL["op8_quality_rules"])
    cols = [d[0] for d in cur.description]
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cur.fetchall(), cols)
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())
