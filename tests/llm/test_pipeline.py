"""Every stage against a plain version of what it does."""

import corpus_pipeline as P
from test_decontam import plain as leaked
from test_jaccard import plain as groups
from test_packing import check

from studyloom.llm import pii

SF = "/root/testdata/sf0.001"


def test_stages_on_the_smallest_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, items = docs.columns, [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "packing":
            assert check(before, docs.collect(), ids=True) < 0.03
            break
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "language":
            assert set(after) == {i for i, t in before.items() if any(c.isalpha() for c in t or "")}
        elif name == "near_copies":
            want = groups(list(before.items()))
            assert set(after) == {i for i in before if want[i][1] == i} and len(after) < len(before)
        elif name == "decontamination":
            assert set(after) == {i for i, t in before.items() if not leaked(t, items, 1024)} and len(after) < len(before)
        elif name == "personal_data":
            anchors = pii.automaton()
            assert after == {i: pii.masked(t, pii.find_spans(t, anchors)) for i, t in before.items()} and after != before
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        before = after


def test_odd_rows(spark, texts):
    rows = [(i, t, None, "s", 0) for i, t in enumerate(texts)] + [(None, "a text without an id that is long enough", "en", None, None), (3, "one two three four five six", "xx", "s", 1), (8, "x" * 5000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    one = P.near_copies(spark, docs, SF)
    ids = [r.doc_id for r in one.collect()]
    assert sorted(map(str, ids)) == sorted(map(str, [0, 1, 2, 3, 4, 5, 8, 9, 10, None, 3])) or len(ids) == 11
    for stage in (P.language, P.decontamination, P.personal_data):
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.where("false"), SF).collect() == []
    assert P.near_copies(spark, docs.where("false"), SF).collect() == []


def test_clashing_columns_keep_their_values(spark, texts):
    """Input columns named like those that stages make for themselves."""
    rows = [(i, t, "en", "s", 0, 7.0 + i, "mine", 5, -i, "x") for i, t in enumerate([*texts, "one two three four five six seven"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, _class long, _best_id long, _best string")
    for stage in (P.language, P.near_copies, P.decontamination, P.personal_data):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all((r.score, r.lang_pred, r["_class"], r["_best_id"], r["_best"]) == (7.0 + r.doc_id, "mine", 5, -r.doc_id, "x") for r in got)
