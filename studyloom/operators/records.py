"""Collapse of repeated records to one auditable row per participant (inventory A01-A12, A72, J14)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import privacy as P
from ..functions import text as X


def any_ticked(columns: list[Column]) -> Column:
    """Any of several checkbox cells ticked in this row."""
    return reduce(lambda a, b: a | b, [X.is_checked(c) for c in columns], F.lit(False))


def ever(test: Column) -> Column:
    """True when the test held in any record of the group."""
    return F.max(F.coalesce(test, F.lit(False)))


def ever_coded(code: Column, codes: list[str]) -> Column:
    """Any record carries one of the codes."""
    return ever(code.isin(*codes))


def stable(code: Column) -> Column:
    """The one value of a group, null when records disagree. Equal extremes mean one value."""
    return F.when(F.min(code) == F.max(code), F.min(code))


def conflicting(code: Column) -> Column:
    """More than one distinct value."""
    return F.coalesce(F.min(code) != F.max(code), F.lit(False))


def date_summary(raw: Column, validation: str = "any") -> list[Column]:
    """First valid date, any unreadable one, more than one distinct date."""
    d = D.parse_date(raw, validation)
    return [F.min(d).alias("first_date"), ever(X.is_filled(raw) & d.isNull()).alias("invalid_date"),
            F.coalesce(F.min(d) != F.max(d), F.lit(False)).alias("multiple_dates")]


def code_list(code: Column, allowed: list[str] | None = None) -> Column:
    """Sorted distinct codes joined by a bar. The code vocabulary bounds the set."""
    c = code if allowed is None else F.when(code.isin(*allowed), code)
    return F.concat_ws("|", X.sorted_codes(F.collect_set(c)))


def labelled_codes(source: str, codes: Column, labels: dict[str, str]) -> Column:
    """``field=code: label`` for each code of a joined list."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    parts = F.transform(F.filter(F.split(codes, r"\|"), lambda c: c != ""), lambda c: F.concat(
        F.lit(f"{source}="), c, F.coalesce(F.concat(F.lit(": "), F.try_element_at(table, c)), F.lit(""))))
    return F.concat_ws(" | ", parts)


def tri_state(sources: list[tuple[Column, dict[str, list[str]]]]) -> list[Column]:
    """True when any source is positive, else false when any is negative, else null.

    Each source gives its codes for ``positive``, ``negative`` and ``unknown``.
    """
    def seen(kind):
        return reduce(lambda a, b: a | b, [ever(c.isin(*m.get(kind, ["\0"]))) for c, m in sources])

    pos, neg = seen("positive"), seen("negative")
    return [F.when(pos, True).when(neg, False).alias("state"), (pos & neg).alias("state_conflict"),
            seen("unknown").alias("state_unknown")]


@dataclass(frozen=True)
class StudyRules:
    """What makes a participant count: status codes, code groups, cut-off and milestones."""

    enrolled: tuple[str, ...] = ("1", "2")
    known_status: tuple[str, ...] = ("0", "1", "2", "3")
    minority: tuple[str, ...] = ("2", "3", "4")
    other_race: tuple[str, ...] = ("5",)
    known_race: tuple[str, ...] = ("1", "2", "3", "4", "5")
    cut_off: str = "2024-05-31"
    milestones: tuple[str, ...] = ("2023-04-01", "2023-08-01", "2023-12-01", "2024-04-01")
    validation: str = "any"


def collapse(records: DataFrame, rules: StudyRules) -> DataFrame:
    """A01-A05 in one grouping: everything the decision needs, per participant.

    Reads ``participant_id, race, status_code, eth, eth2, exclude_flag, review_flag, visit_date`` as text.
    """
    codes = ("race", "status_code", "eth", "eth2", "exclude_flag", "review_flag")
    d = D.parse_date(F.col("visit_date"), rules.validation)
    # codes and dates are read once per row, before the grouping
    clean = records.select("participant_id", *[X.string_code(F.col(c)).alias(c) for c in codes], d.alias("_date"),
                           (X.is_filled(F.col("visit_date")) & d.isNull()).alias("_bad_date"))
    race, status = F.col("race"), F.col("status_code")
    return clean.groupBy("participant_id").agg(
        F.count(F.lit(1)).alias("records"),
        code_list(race).alias("raw_race"), code_list(status).alias("raw_status"),
        ever_coded(race, list(rules.minority)).alias("minority"),
        ever_coded(race, list(rules.other_race)).alias("race_other"),
        ever(race.isNotNull() & ~race.isin(*rules.known_race)).alias("race_unexpected"),
        F.size(F.collect_set(race)).cast("long").alias("n_races"),
        stable(status).alias("status"), conflicting(status).alias("status_conflict"),
        ever(status.isNotNull() & ~status.isin(*rules.known_status)).alias("status_invalid"),
        ever(F.col("exclude_flag") == "1").alias("excluded_flag"), ever(F.col("review_flag") == "1").alias("review_flag"),
        *tri_state([(F.col("eth"), {"positive": ["1"], "negative": ["2"], "unknown": ["9"]}),
                    (F.col("eth2"), {"positive": ["1"], "negative": ["0"]})]),
        F.min("_date").alias("first_date"), ever(F.col("_bad_date")).alias("invalid_date"),
        F.coalesce(F.min("_date") != F.max("_date"), F.lit(False)).alias("multiple_dates"))


def decide(collapsed: DataFrame, rules: StudyRules) -> DataFrame:
    """Inclusion as true, false or unknown, with decision, reason and milestone."""
    status, cut = F.col("status"), F.lit(rules.cut_off).cast("date")
    no_rule = F.lit(not rules.enrolled)
    enrolled = status.isin(*rules.enrolled) if rules.enrolled else F.lit(False)
    late = F.coalesce(F.col("first_date") > cut, F.lit(False))
    included = (F.when(F.col("excluded_flag"), False).when(F.col("status_conflict") | no_rule, None)
                .when(~F.coalesce(enrolled, F.lit(False)), False).when(late, False).otherwise(True))
    reason = (F.when(F.col("excluded_flag"), "exclusion flag").when(F.col("status_conflict"), "conflicting status")
              .when(no_rule, "no status rule").when(~F.coalesce(enrolled, F.lit(False)), "status not enrolled")
              .when(late, "after cut-off").otherwise(""))
    df = collapsed.withColumn("included", included).withColumn("reason", reason)
    datable = F.col("included") & ~F.col("invalid_date") & ~F.col("multiple_dates") & F.col("first_date").isNotNull()
    return (df.withColumn("decision", F.when(F.col("included") & F.col("review_flag"), "review").when(F.col("included"), "included")
                          .when(F.col("included").isNull(), "unresolved").otherwise("excluded"))
            .withColumn("milestone", F.when(datable, D.first_milestone(F.col("first_date"), list(rules.milestones)))))


def decide_permissive(collapsed: DataFrame, strict: bool = False) -> DataFrame:
    """Everybody counts unless strict; all triggered flags are listed in fixed order."""
    parts = [(F.col("excluded_flag"), "exclusion flag"), (F.col("review_flag"), "review flag"),
             (F.col("n_races") == 0, "race missing"), (F.col("race_other"), "race unknown/other"),
             (F.col("state").isNull(), "ethnicity missing"), (F.col("state_conflict"), "conflicting values")]
    text = F.concat_ws("; ", *[F.when(t, F.lit(n)) for t, n in parts])
    flagged = reduce(lambda a, b: a | b, [t for t, _ in parts])
    out = F.when(F.lit(strict) & F.col("excluded_flag"), "excluded").when(flagged, "flagged-review").otherwise("included")
    return collapsed.withColumn("decision", out).withColumn("reason", text)


def issue_log(decided: DataFrame) -> DataFrame:
    """Zero or more typed issues per participant."""
    c = F.col
    included = F.coalesce(c("included"), F.lit(False))
    tests = [
        ("missing_participant_id", "participant_id", ~X.is_filled(c("participant_id")), F.lit("")),
        ("unexpected_race_code", "race", c("race_unexpected"), c("raw_race")),
        ("invalid_status_code", "status_code", c("status_invalid"), c("raw_status")),
        ("missing_race", "race", c("n_races") == 0, F.lit("")),
        ("unknown_other_race", "race", c("race_other"), c("raw_race")),
        ("multiple_race_selections", "race", c("n_races") > 1, c("raw_race")),
        ("missing_ethnicity", "eth", c("state").isNull() & ~c("state_unknown"), F.lit("")),
        ("unknown_declined_ethnicity", "eth", c("state_unknown"), F.lit("")),
        ("conflicting_ethnicity_sources", "eth", c("state_conflict"), F.lit("")),
        ("excluded_status", "exclude_flag", c("excluded_flag"), F.lit("1")),
        ("review_status", "review_flag", c("review_flag"), F.lit("1")),
        ("conflicting_enrollment_status", "status_code", c("status_conflict"), c("raw_status")),
        ("missing_enrollment_date", "visit_date", c("first_date").isNull() & ~c("invalid_date"), F.lit("")),
        ("invalid_enrollment_date", "visit_date", c("invalid_date"), F.lit("")),
        ("conflicting_enrollment_dates", "visit_date", c("multiple_dates"), F.lit("")),
        ("unassignable_milestone", "visit_date", included & c("milestone").isNull(), F.lit("")),
    ]
    made = F.array_compact(F.array(*[F.when(t, F.struct(F.lit(n).alias("issue_type"), F.lit(f).alias("field_name"), v.alias("raw_value")))
                                     for n, f, t, v in tests]))
    per_id = decided.select("participant_id", F.explode(made).alias("i")).select("participant_id", "i.*")
    whole = decided.agg(F.count_if(c("included").isNull()).alias("n"), F.count_if(included & c("milestone").isNull()).alias("m"))
    rows = F.array(F.struct(F.lit("unresolved_inclusion").alias("issue_type"), c("n")), F.struct(F.lit("unresolved_milestone").alias("issue_type"), c("m").alias("n")))
    dataset = (whole.select(F.inline(rows)).where("n > 0")
               .select(F.lit("").alias("participant_id"), "issue_type", F.lit("").alias("field_name"), c("n").cast("string").alias("raw_value")))
    return per_id.unionByName(dataset)


def categories(decided: DataFrame) -> DataFrame:
    """Participants once per category they count in."""
    made = F.array_compact(F.array(F.lit("Total"), F.when(F.col("minority"), "Minority"), F.when(F.col("state"), "Hispanic")))
    return decided.withColumn("category", F.explode(made))


def inventory_counts(decided: DataFrame) -> DataFrame:
    """Included, excluded and unresolved counts per category."""
    return categories(decided).groupBy("category").agg(
        F.count_if(F.col("included")).alias("included"), F.count_if(~F.col("included")).alias("excluded"),
        F.count_if(F.col("included").isNull()).alias("unresolved"), F.count_if(F.col("decision") == "review").alias("review"))


def milestone_counts(df: DataFrame, on: str, milestones: list[str], keys: list[str]) -> DataFrame:
    """Rows dated on or before each milestone, zeros kept.

    The milestones are configuration, so each one is a conditional count in the same aggregation;
    no range join and no window are needed.
    """
    g = df.groupBy(*keys).agg(*[F.count_if(F.col(on) <= F.lit(m).cast("date")).alias(f"m{i}") for i, m in enumerate(milestones)])
    rows = F.array(*[F.struct(F.lit(m).cast("date").alias("milestone"), F.col(f"m{i}").alias("actual")) for i, m in enumerate(milestones)])
    return g.select(*keys, F.inline(rows))


def current_milestone(milestones: list[str], report_date: str) -> str:
    """First milestone on or after the report date, else the last one."""
    later = [m for m in sorted(milestones) if m >= report_date]
    return later[0] if later else sorted(milestones)[-1]


def report_rows(counts: DataFrame, targets: DataFrame, keys: list[str], current: str, dialect: str = "text") -> DataFrame:
    """Targets, actual, ratio and status per category and milestone, with where the target came from.

    Live counts belong to the current milestone and the past; later milestones have no actual yet.
    """
    j = targets.join(counts, [*keys, "milestone"], "left")
    now = F.lit(current).cast("date")
    actual = F.when(F.col("milestone") <= now, F.coalesce("actual", F.lit(0)))
    target = F.coalesce("current_target", "previous_target")
    source = F.when(F.col("current_target").isNotNull(), "current").when(F.col("previous_target").isNotNull(), "previous").otherwise("none")
    return j.select(*keys, "milestone", "previous_target", "current_target", actual.alias("actual"),
                    P.ratio(actual, target).alias("ratio"), P.status(actual, target, dialect, F.col("milestone") == now).alias("status"),
                    source.alias("target_source"))


def report_wide(rows: DataFrame, keys: list[str], milestones: list[str], value: str = "actual") -> DataFrame:
    """One column per milestone."""
    named = rows.withColumn("_m", F.date_format("milestone", "yyyy_MM_dd"))
    return named.groupBy(*keys).pivot("_m", [m.replace("-", "_") for m in milestones]).agg(F.first(value))


def complete_case_sum(values: DataFrame, keys: list[str], source: str, value: str, n_sources: int) -> DataFrame:
    """A10: sum across sources only where every source has a value."""
    per = values.groupBy(*keys, source).agg(F.sum(value).alias("v"))
    n = F.count("v")
    return per.groupBy(*keys).agg(n.alias("reporting"), F.when(n == n_sources, F.sum("v")).alias("combined"))


def exclusive_buckets(df: DataFrame, tests: list[tuple[str, Column]], keys: list[str]) -> DataFrame:
    """Counts and percent of mutually exclusive classes, first match wins, zeros kept."""
    label = reduce(lambda acc, nt: acc.when(nt[1], nt[0]), tests[1:], F.when(tests[0][1], tests[0][0])).otherwise("missing")
    names = [n for n, _ in tests] + ["missing"]
    g = df.withColumn("_b", label).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("_b") == n).alias(f"b{i}") for i, n in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(n).alias("bucket"), F.col(f"b{i}").alias("n"), (F.col(f"b{i}") * 100.0 / F.col("_n")).alias("pct"))
                     for i, n in enumerate(names)])
    return g.select(*keys, F.inline(rows))


def fill_rate(df: DataFrame, ident: str, fields: list[str]) -> DataFrame:
    """Ids with any filled value of each field, and their share."""
    flags = df.groupBy(ident).agg(*[ever(X.is_filled(F.col(f))).alias(f) for f in fields])
    one = flags.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(f)).alias(f) for f in fields])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("filled"), F.col("_n").alias("ids"),
                              F.try_divide(F.col(f) * 100.0, F.col("_n")).alias("pct")) for f in fields])
    return one.select(F.inline(rows))
