from pyspark.sql import functions as F

from studyloom.functions import answers as A
from studyloom.functions import dates as D
from studyloom.functions import privacy as P
from studyloom.functions import text as X


def one(spark, value, expr, kind="string"):
    df = spark.createDataFrame([(value,)], f"c {kind}")
    return df.select(expr(F.col("c"))).collect()[0][0]


def test_dirty_text(spark):
    rows = [(None,), ("",), (" ",), ("&lt;b&gt;Hi&nbsp;&lt;/b&gt;",), ("<p>a\n b</p>",)]
    df = spark.createDataFrame(rows, "c string")
    out = df.select(X.safe_text(F.col("c")), X.is_filled(F.col("c")), X.plain_text(F.col("c")), X.plain_text(F.col("c"), all_entities=False)).collect()
    assert [tuple(r) for r in out] == [("", False, "", ""), ("", False, "", ""), (" ", False, "", ""), ("&lt;b&gt;Hi&nbsp;&lt;/b&gt;", True, "Hi", "Hi"), ("<p>a\n b</p>", True, "a b", "a b")]


def test_codes_and_choices(spark):
    assert one(spark, "1.0", X.string_code) == "1" and one(spark, "0", X.string_code) == "0" and one(spark, " ", X.string_code) is None
    assert one(spark, ["b", "10", "2", "b"], X.sorted_codes, "array<string>") == ["10", "2", "b"]
    assert one(spark, "1, M | 2,  F  x | bad | 1, Z", X.choice_map) == {"1": "Z", "2": "F x"}
    assert one(spark, "1, a | x, b", X.numeric_codes) == []
    assert one(spark, "@hidden a@no @READONLY @Hidden", X.tags) == ["@HIDDEN", "@READONLY"]


def test_code_maps(spark):
    for value, age, want in (("1", 9, "RING"), ("7", 9, "FISH"), ("7", 12, "POP"), ("7", None, "7"), ("squiggle2", 9, "SQUIGGLE"), ("odd  one", 9, "ODD_ONE"), ("", 9, None)):
        assert one(spark, value, lambda c: X.normalise_code(c, "toy", F.lit(age).cast("int"))) == want
    assert one(spark, "1.0", lambda c: X.normalise_code(c, "toy", custom={1: "my toy"})) == "MY_TOY"


def test_dates(spark):
    for text, validation, want in (("2026-02-03", "any", "2026-02-03"), ("02/03/2026", "date_mdy", "2026-02-03"), ("02/03/2026", "date_dmy", "2026-03-02"),
                                   ("13/02/2026", "any", "2026-02-13"), ("13/02/2026", "date_mdy", None), ("2026-02-30", "any", None)):
        got = one(spark, text, lambda c, v=validation: D.parse_date(c, v))
        assert (got.isoformat() if got else None) == want
    assert one(spark, "05-Mar-95", D.short_year_date).year == 1995 and one(spark, "05-Mar-25", D.short_year_date).year == 2025
    assert one(spark, "9_months_arm_1", X.event_month) == 9 and one(spark, "9_months_arm_1x", X.event_month) is None
    assert one(spark, -3661.5, X.hhmmss, "double") == "-01:01:01.500"


def test_redaction(spark):
    hex_run = "a" * 32
    text = f"token x api_token=abc, Bearer abcdefghijklmnop {hex_run}"
    assert one(spark, text, P.redact_text) == "token x api_token=[REDACTED], Bearer [REDACTED]".replace("Bearer [REDACTED]", "[REDACTED] [REDACTED]")
    assert one(spark, "Bearer abc", P.redact_text) == "Bearer abc"
    for v, want in (("=SUM(A1)", "'=SUM(A1)"), (" -x", "' -x"), ("a-b", "a-b"), ("", "")):
        assert one(spark, v, P.spreadsheet_safe) == want
    out = P.redact_frame(spark.createDataFrame([("k", None, "password: p1"), ("", "x", "ok")], "api_token string, n string, note string")).collect()
    assert [tuple(r) for r in out] == [("[REDACTED]", None, "password: [REDACTED]"), ("", "x", "ok")]


def test_suppression_and_status(spark):
    got = [(one(spark, n, P.public_count, "int"), one(spark, n, P.public_band, "int")) for n in (0, 1, 9, 10, 37)]
    assert got == [("0", "0"), ("<10", "<10"), ("<10", "<10"), ("10", "10–19"), ("37", "30–39")]
    for actual, target, want in ((None, 5, ("", "Pending", "Not reported")), (5, 0, ("N/A", "N/A", "N/A")), (5, 5, ("On Target", "On Target", "On target")), (4, 5, ("Below Target", "Below Target", "Behind"))):
        a, t = F.lit(actual).cast("int"), F.lit(target)
        got = spark.range(1).select(P.status(a, t), P.status(a, t, "text", F.lit(True)), P.status(a, t, "long")).collect()[0]
        assert tuple(got) == want


def test_answers(spark):
    v = lambda a, f: one(spark, a, f, "array<double>")
    assert v([1.0, None, 1.0, 1.0], A.longest_run) == 2 and v([2.0, 2.0, 2.0], A.longest_run) == 3 and v([], A.longest_run) == 0
    assert v([1.0, None, 3.0], lambda c: A.row_mean(c, 3)) is None and v([1.0, None, 3.0], lambda c: A.row_mean(c, 2)) == 2.0
    assert abs(v([1.0, 3.0], A.row_sd) - 2 ** 0.5) < 1e-12
    assert one(spark, 2, lambda c: A.scale_to_100(c, 1, 5, reverse=True), "int") == 75.0


def test_unavailability(spark):
    for text, want in (("Ana Out", ("Ana", "out")), ("Aug 11 Bo Unavailable for visits", ("Bo", "unavailable for visits")), ("Team meeting", (None, None)), ("Ana Free", (None, None))):
        assert tuple(one(spark, text, X.unavailability)) == want
