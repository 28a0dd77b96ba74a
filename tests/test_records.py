import pytest
from pyspark.sql import functions as F

from studyloom.functions import dates as D
from studyloom.operators import metadata as M
from studyloom.operators import records as R
from studyloom.operators.completion import completion_tally, event_volume


def fixture(spark):
    rows = [("n1", "1", "1", "1.0", None, "0", "0", "2023-01-01"), ("n1", "1", "1", "2", None, "1", "0", "2023-02-01"),
            ("n2", None, "1", None, None, "0", "0", "bad-date"), ("n3", "2", "1", "1", None, "0", "1", "2023-05-05"), ("n4", "2", "1", None, "0", "0", "0", "2023-09-05"),
            ("n4", "2", "3", None, None, "0", "0", None)]
    return spark.createDataFrame(rows, "participant_id string, race string, status_code string, eth string, eth2 string, exclude_flag string, review_flag string, visit_date string")


def test_collapse_and_decide(spark):
    out = {r["participant_id"]: r for r in R.decide(R.collapse(fixture(spark), R.StudyRules()), R.StudyRules()).collect()}
    assert out["n1"]["included"] is False and out["n1"]["reason"] == "exclusion flag" and out["n1"]["state"] is True and out["n1"]["state_conflict"]
    assert out["n1"]["multiple_dates"] and out["n2"]["invalid_date"] and out["n2"]["first_date"] is None and out["n2"]["n_races"] == 0
    assert out["n3"]["decision"] == "review" and out["n3"]["milestone"] == "2023-08-01"
    assert out["n4"]["included"] is None and out["n4"]["decision"] == "unresolved" and out["n4"]["state"] is False and out["n4"]["milestone"] is None


def test_permissive_and_issues(spark):
    col = R.collapse(fixture(spark), R.StudyRules())
    loose = {r["participant_id"]: (r["decision"], r["reason"]) for r in R.decide_permissive(col).collect()}
    assert loose["n1"] == ("flagged-review", "exclusion flag; conflicting values")
    assert loose["n2"] == ("flagged-review", "race missing; ethnicity missing")
    strict = {r["participant_id"]: r["decision"] for r in R.decide_permissive(col, strict=True).collect()}
    assert strict["n1"] == "excluded"
    log = {(r["participant_id"], r["issue_type"]) for r in R.issue_log(R.decide(col, R.StudyRules())).collect()}
    assert {("n1", "conflicting_enrollment_dates"), ("n1", "conflicting_ethnicity_sources"), ("n2", "invalid_enrollment_date"), ("n2", "missing_race"),
            ("n4", "conflicting_enrollment_status"), ("", "unresolved_inclusion")} <= log


def test_totals_are_preserved(spark):
    rules = R.StudyRules()
    d = R.decide(R.collapse(fixture(spark), rules), rules)
    n = {r["category"]: r for r in R.inventory_counts(d).collect()}["Total"]
    assert n["included"] + n["excluded"] + n["unresolved"] == 4


def test_milestones(spark):
    assert D.milestone_dates("2023-03-01", "2024-04-01") == ["2023-04-01", "2023-08-01", "2023-12-01", "2024-04-01"]
    assert R.current_milestone(["2023-04-01", "2023-08-01"], "2023-05-01") == "2023-08-01"
    assert R.current_milestone(["2023-04-01", "2023-08-01"], "2025-05-01") == "2023-08-01"
    df = spark.createDataFrame([("2023-04-01",), ("2023-04-02",), ("2030-01-01",), (None,)], "d string").select(D.first_milestone(F.col("d").cast("date"), ["2023-04-01", "2023-08-01"]).alias("m"))
    assert [r["m"] for r in df.collect()] == ["2023-04-01", "2023-08-01", "AFTER_REPORTING_WINDOW", None]
    days = spark.createDataFrame([("a", "2023-03-01"), ("a", "2023-05-01"), ("a", None)], "k string, d string").withColumn("d", F.col("d").cast("date"))
    got = {r["milestone"].isoformat(): r["actual"] for r in R.milestone_counts(days, "d", ["2023-01-01", "2023-04-01", "2023-08-01"], ["k"]).collect()}
    assert got == {"2023-01-01": 0, "2023-04-01": 1, "2023-08-01": 2}


def test_completion(spark):
    rows = spark.createDataFrame([("1", "v1", "2", "0"), ("1", "v2", "2", ""), ("2", "v1", "1", "2"), ("2", "v2", "", "")], "id string, event string, a_complete string, b_complete string")
    t = completion_tally(rows, "event").groupBy("instrument", "status").agg(F.sum("n").alias("n")).collect()
    assert {(r["instrument"], r["status"]): r["n"] for r in t} == {("a", "Complete"): 2, ("a", "Unverified"): 1, ("a", "Not started"): 1, ("b", "Complete"): 1, ("b", "Incomplete"): 1, ("b", "Not started"): 2}
    v = {r["event"]: (r["rows"], r["records"]) for r in event_volume(rows, "event", "id").collect()}
    assert v == {"v1": (2, 2), "v2": (2, 2)}


@pytest.mark.parametrize("form,kind,codes,detail", [("survey", "radio", ["1", "2"], ""), ("other", "radio", ["1"], "form differs"), ("survey", "text", ["1"], "type differs"), ("survey", "radio", ["3"], "codes missing: 3")])
def test_schema_drift_fails_closed(spark, form, kind, codes, detail):
    fields = spark.createDataFrame([("q1", "survey", "radio", "1, M | 2, F", 1)], "field_name string, form_name string, field_type string, choices string, row_id int")
    want = spark.createDataFrame([("q1", form, kind, codes)], "field_name string, expected_form string, expected_type string, codes array<string>")
    checks = M.expectation_check(fields, want)
    assert checks.collect()[0]["detail"] == detail
    if detail:
        with pytest.raises(ValueError):
            M.assert_expectations(checks)
    else:
        M.assert_expectations(checks)
