"""Field dictionary operators (inventory X30, X44, J01, F11, A17-A28, A69)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Columns of a field dictionary that the operators read.
DICTIONARY_COLUMNS = ("field_name", "form_name", "field_type", "field_label", "choices", "validation",
                      "required_field", "identifier", "branching_logic", "matrix_group_name", "annotation")
CHOICE_TYPES = ("radio", "dropdown", "checkbox")
FREE_TEXT_TYPES = ("text", "notes")
# Order of the cross-project verdicts.
CATEGORIES = ("MISSING_VS_REFERENCE", "PARTIAL_PRESENCE", "TYPE_MISMATCH", "LABEL_MISMATCH",
              "INSTRUMENT_MISMATCH", "VALIDATION_GAP", "ALIGNED")


def dictionary_from_parts(part: DataFrame) -> DataFrame:
    """A field dictionary built from the part table, one row per part."""
    kinds = F.create_map(*[F.lit(v) for v in (
        "PROMO", "text", "SMALL", "text", "STANDARD", "radio", "MEDIUM", "checkbox", "LARGE", "dropdown", "ECONOMY", "calc")])
    k, size = F.col("p_partkey"), F.col("p_size")
    kind = F.try_element_at(kinds, F.col("p_type"))

    def yes(test):
        return F.when(test, "y").otherwise("")

    return part.select(
        k.alias("row_id"), F.replace(F.lower("p_name"), F.lit(" "), F.lit("_")).alias("field_name"),
        F.col("p_brand").alias("form_name"), kind.alias("field_type"),
        F.when(k % 8 == 0, "").otherwise(F.col("p_name")).alias("field_label"),
        F.when(kind.isin(*CHOICE_TYPES) & (size % 5 != 0), "1, A | 2, B").otherwise("").alias("choices"),
        F.when(F.col("p_type") == "PROMO", "integer").otherwise("").alias("validation"),
        yes(size % 2 == 0).alias("required_field"), yes(k % 10 == 0).alias("identifier"),
        F.when(size > 40, "[x] = 1").otherwise("").alias("branching_logic"),
        F.when(k % 6 == 0, "m1").otherwise("").alias("matrix_group_name"),
        F.when(size % 7 == 0, "@HIDDEN @readonly").otherwise("").alias("annotation"),
        size.alias("size"))


def structural_flags(fields: DataFrame) -> DataFrame:
    """Boolean structure flags, prefix, action tags and type detail of every field."""
    kind = X.field_key(F.col("field_type"))
    found = X.tags(F.col("annotation"))
    return fields.select(
        "*", X.field_key(F.col("field_name")).alias("field_key"),
        F.substring_index(X.field_key(F.col("field_name")), "_", 1).alias("field_prefix"),
        (X.field_key(F.col("required_field")) == "y").alias("is_required"),
        (X.field_key(F.col("identifier")) == "y").alias("is_identifier"),
        X.is_filled(F.col("branching_logic")).alias("has_branching"),
        X.is_filled(F.col("validation")).alias("is_validated"),
        X.is_filled(F.col("matrix_group_name")).alias("is_matrix"),
        (X.plain_text(F.col("field_label"), all_entities=False) == "").alias("missing_label"),
        F.concat_ws("; ", found).alias("action_tags"),
        F.array_contains(found, "@HIDDEN").alias("tag_hidden"),
        F.array_contains(found, "@READONLY").alias("tag_readonly"),
        F.size(X.choices(F.col("choices"))).alias("choice_count"),
        F.when((kind == "text") & X.is_filled(F.col("validation")),
               F.concat(F.lit("text:"), X.field_key(F.col("validation")))).otherwise(kind).alias("type_detail"))


def expand_exports(fields: DataFrame, exports: DataFrame) -> DataFrame:
    """One row per field and exported column, falling back to the field's own name."""
    e = exports.where(X.is_filled(F.col("original_field_name"))).select(
        X.field_key(F.col("original_field_name")).alias("_key"), "export_field_name", "choice_value", "export_order")
    out = fields.withColumn("_key", X.field_key(F.col("field_name"))).join(e, "_key", "left").drop("_key")
    name = F.when(X.is_filled(F.col("export_field_name")), F.col("export_field_name")).otherwise(F.col("field_name"))
    return out.withColumn("export_field_name", name).withColumn("choice_value", F.coalesce("choice_value", F.lit("")))


def likert_fields(cells: DataFrame) -> DataFrame:
    """Fields whose choice codes are exactly 1..k with k from 4 to 7."""
    codes = X.numeric_codes(F.col("choices"))
    k = F.size(codes)
    want = F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda v: v.cast("double"))
    return cells.where(k.between(4, 7) & (codes == want)).select("field", k.alias("scale"))


def find_field(fields: DataFrame, label_pattern: str, types: list[str] | None = None,
               prefer: str | None = None) -> DataFrame:
    """the one field whose label matches, preferred names first, then by name."""
    hit = fields.where(F.col("field_label").rlike("(?i)" + label_pattern))
    if types:
        hit = hit.where(F.col("field_type").isin(*types))
    first = F.when(F.col("field_name").contains(prefer), 0).otherwise(1) if prefer else F.lit(0)
    return hit.orderBy(first, "field_name", "row_id").limit(1)


def overview(studies: DataFrame, summaries: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """One row per study, zeros where a study delivered nothing."""
    return studies.join(summaries, key, "left").select(
        key, *[F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in measures],
        F.col(measures[0]).isNotNull().alias("ok"))


def type_breakdown(fields: DataFrame, study: str) -> DataFrame:
    """Fields per study and type."""
    return fields.groupBy(study, "field_type").agg(F.count(F.lit(1)).alias("n"))


def quality_checks(flags: DataFrame) -> DataFrame:
    """Named rule counts as rows, from one pass."""
    rules = [
        ("Fields with no label", F.col("missing_label")),
        ("Text fields with no validation", F.col("field_type").isin(*FREE_TEXT_TYPES) & ~F.col("is_validated")),
        ("Choice fields with no choices", F.col("field_type").isin(*CHOICE_TYPES) & (F.col("choice_count") == 0)),
        ("Identifier-flagged fields", F.col("is_identifier")),
        ("Fields with branching logic", F.col("has_branching")),
        ("Required fields", F.col("is_required")),
        ("Calculated fields", F.col("field_type") == "calc"),
    ]
    one = flags.agg(*[F.count_if(test).alias(f"r{i}") for i, (_, test) in enumerate(rules)])
    rows = F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"r{i}").alias("n")) for i, (name, _) in enumerate(rules)])
    return one.select(F.inline(rows))


def project_summary(flags: DataFrame, project: str) -> DataFrame:
    """Sizes, flag counts, matrix groups and names used on more than one form, per project."""
    per_key = flags.groupBy(project, "field_key").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("form_name").alias("forms"),
        *[F.count_if(F.col(c)).alias(c) for c in ("is_required", "is_identifier", "has_branching", "is_validated")])
    by_key = per_key.groupBy(project).agg(
        F.sum("rows").alias("design_rows"), F.count(F.lit(1)).alias("distinct_fields"),
        F.count_if(F.col("forms") > 1).alias("name_collisions"),
        F.sum("is_required").alias("required"), F.sum("is_identifier").alias("identifiers"),
        F.sum("has_branching").alias("branching"), F.sum("is_validated").alias("validated"))
    groups = flags.where("is_matrix").groupBy(project).agg(
        F.count_distinct("form_name", "matrix_group_name").alias("matrix_groups"))
    return by_key.join(groups, project, "left").withColumn("matrix_groups", F.coalesce("matrix_groups", F.lit(0)))


def key_presence(df: DataFrame, key: str, project: str, projects: list[str]) -> DataFrame:
    """One row per key with a flag for every project of a fixed list."""
    return df.groupBy(key).agg(*[F.max(F.when(F.col(project) == p, True).otherwise(False)).alias(f"in_{p}") for p in projects])


def overlap_summary(df: DataFrame, key: str, project: str, projects: list[str], reference: str) -> DataFrame:
    """Totals, common to all, pairwise common, unique and missing against the reference."""
    flags = key_presence(df, key, project, projects)
    has = {p: F.col(f"in_{p}") for p in projects}
    present = sum((c.cast("int") for c in has.values()), F.lit(0))
    measures: list[tuple[str, str, Column]] = [("COMMON_ALL", "all", present == len(projects)), ("TOTAL", "all", present > 0)]
    for i, p in enumerate(projects):
        measures.append(("TOTAL", p, has[p]))
        measures.append(("UNIQUE", p, has[p] & (present == 1)))
        if p != reference:
            measures.append(("MISSING_VS_REFERENCE", p, has[reference] & ~has[p]))
        measures += [("COMMON_PAIR", f"{p} & {q}", has[p] & has[q]) for q in projects[i + 1:]]
    one = flags.agg(*[F.count_if(test).alias(f"m{i}") for i, (_, _, test) in enumerate(measures)])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(s).alias("scope"), F.col(f"m{i}").alias("n"))
                     for i, (m, s, _) in enumerate(measures)])
    return one.select(F.inline(rows))


def missing_keys(df: DataFrame, key: str, project: str, projects: list[str], reference: str) -> DataFrame:
    """The keys behind the missing counts, one row per project and key."""
    flags = key_presence(df, key, project, projects).where(F.col(f"in_{reference}"))
    gone = F.array_compact(F.array(*[F.when(~F.col(f"in_{p}"), F.lit(p)) for p in projects if p != reference]))
    return flags.select(key, F.explode(gone).alias("missing_in"))


def compare_projects(flags: DataFrame, project: str, projects: list[str], reference: str) -> DataFrame:
    """One row per field with presence, excess variants and a verdict."""
    order = [reference, *[p for p in projects if p != reference]]
    rank = F.array_position(F.array(*[F.lit(p) for p in order]), F.col(project))
    label = X.comparison_key(F.col("field_label"))
    g = flags.groupBy("field_key").agg(
        F.count_distinct(F.nullif(label, F.lit(""))).alias("label_variants"),
        F.count_distinct(X.field_key(F.col("field_type"))).alias("type_variants"),
        F.count_distinct(X.field_key(F.col("form_name"))).alias("instrument_variants"),
        F.min_by("form_name", F.struct(rank, F.col("row_id"))).alias("example_instrument"),
        *[F.max(F.when(F.col(project) == p, True).otherwise(False)).alias(f"in_{p}") for p in projects],
        *[F.max(F.when(F.col(project) == p, F.col("is_validated"))).alias(f"v_{p}") for p in projects],
        *[F.max(F.when(F.col(project) == p, F.col("is_identifier"))).alias(f"i_{p}") for p in projects])
    present = sum((F.col(f"in_{p}").cast("int") for p in projects), F.lit(0))

    def differs(prefix):
        got = F.array_compact(F.array(*[F.col(f"{prefix}_{p}") for p in projects]))
        return (present >= 2) & (F.size(F.array_distinct(got)) > 1)

    over = {n: F.greatest(F.col(f"{n}_variants") - 1, F.lit(0)) for n in ("label", "type", "instrument")}
    everywhere = present == len(projects)
    verdict = (F.when(~everywhere & F.col(f"in_{reference}"), CATEGORIES[0]).when(~everywhere, CATEGORIES[1])
               .when(over["type"] > 0, CATEGORIES[2]).when(over["label"] > 0, CATEGORIES[3])
               .when(over["instrument"] > 0, CATEGORIES[4]).when(differs("v"), CATEGORIES[5]).otherwise(CATEGORIES[6]))
    return g.select(
        "field_key", "example_instrument", *[f"in_{p}" for p in projects],
        F.concat_ws(", ", *[F.when(~F.col(f"in_{p}"), F.lit(p)) for p in projects]).alias("missing_in"),
        *[c.alias(f"{n}_mismatch") for n, c in over.items()],
        sum(over.values(), F.lit(0)).alias("mismatch_total"),
        differs("v").alias("validation_gap"), differs("i").alias("identifier_mismatch"), verdict.alias("category"))


def issue_profile(flags: DataFrame, project: str, projects: list[str]) -> DataFrame:
    """Structural issues per project and field, from one grouping of the dictionary.

    Blank labels are reported per field and form; the other kinds per field and project.
    """
    blank = flags.where("missing_label").groupBy(project, "field_key", "form_name").agg(F.lit(1).alias("_")).select(
        F.lit("MISSING_LABEL").alias("issue_type"), F.col(project).alias("project"), "field_key",
        F.lit("blank").alias("observed"), F.lit("").alias("compared_with"))
    g = flags.groupBy("field_key").agg(
        *[F.max(F.when(F.col(project) == p, F.col(c))).alias(f"{a}_{p}") for p in projects
          for a, c in (("v", "is_validated"), ("i", "is_identifier"), ("d", "is_date_field"))])

    def names(test):
        return F.concat_ws(", ", *[F.when(F.coalesce(test(p), F.lit(False)), F.lit(p)) for p in projects])

    def differ(prefix):
        got = F.array_compact(F.array(*[F.col(f"{prefix}_{p}") for p in projects]))
        return F.size(F.array_distinct(got)) > 1

    out = []
    for p in projects:
        out.append(F.when(differ("v") & (F.col(f"v_{p}") == False), F.struct(  # noqa: E712
            F.lit("VALIDATION_GAP").alias("issue_type"), F.lit(p).alias("project"),
            F.lit("not validated").alias("observed"), names(lambda q: F.col(f"v_{q}")).alias("compared_with"))))
        out.append(F.when(F.col(f"v_{p}").isNull() & (names(lambda q: F.col(f"d_{q}")) != ""), F.struct(
            F.lit("DATE_FIELD_MISSING").alias("issue_type"), F.lit(p).alias("project"),
            F.lit("absent").alias("observed"), names(lambda q: F.col(f"d_{q}")).alias("compared_with"))))
        out.append(F.when(differ("i") & F.col(f"i_{p}").isNotNull(), F.struct(
            F.lit("IDENTIFIER_FLAG_MISMATCH").alias("issue_type"), F.lit(p).alias("project"),
            F.when(F.col(f"i_{p}"), "identifier").otherwise("not identifier").alias("observed"),
            names(lambda q, p=p: F.col(f"i_{q}") != F.col(f"i_{p}")).alias("compared_with"))))
    rest = g.select("field_key", F.explode(F.array_compact(F.array(*out))).alias("e")).select(
        "e.issue_type", "e.project", "field_key", "e.observed", "e.compared_with")
    return blank.unionByName(rest)


def presence_matrix(df: DataFrame, item: str, study: str, studies: list[str], minimum: int = 1) -> DataFrame:
    """Item by study flags with the number of studies, kept from ``minimum`` on."""
    flags = key_presence(df, item, study, studies)
    n = sum((F.col(f"in_{s}").cast("int") for s in studies), F.lit(0))
    return flags.withColumn("studies", n).where(F.col("studies") >= minimum)


def compare_instrument(fields: DataFrame, study: str, studies: list[str], comparable: int) -> DataFrame:
    """Type of each field per study and whether the studies agree."""
    first = {s: F.min_by(F.struct("field_type", F.lower(F.trim("field_label")).alias("label")),
                         F.when(F.col(study) == s, F.col("row_id"))) for s in studies}
    g = fields.groupBy("field_name").agg(*[v.alias(f"f_{s}") for s, v in first.items()])
    types = F.array_compact(F.array(*[F.col(f"f_{s}.field_type") for s in studies]))
    labels = F.array_compact(F.array(*[F.col(f"f_{s}.label") for s in studies]))
    verdict = (F.when(F.size(types) < comparable, "partial").when(F.size(F.array_distinct(types)) > 1, "type differs")
               .when(F.size(F.array_distinct(labels)) > 1, "label differs").otherwise("identical"))
    return g.select("field_name", *[F.coalesce(f"f_{s}.field_type", F.lit("—")).alias(f"type_{s}") for s in studies],
                    F.size(types).alias("studies_with_field"), verdict.alias("consistency"))


def comparison_headline(comparison: DataFrame) -> DataFrame:
    """Number of fields per verdict, zeros included."""
    kinds = ("identical", "label differs", "type differs", "partial")
    one = comparison.agg(*[F.count_if(F.col("consistency") == k).alias(f"k{i}") for i, k in enumerate(kinds)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("consistency"), F.col(f"k{i}").alias("n"))
                                         for i, k in enumerate(kinds)])))


def availability(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in both sources, only the first or only the second."""
    left = a.select(key).distinct().withColumn("_a", F.lit(True))
    right = b.select(key).distinct().withColumn("_b", F.lit(True))
    return left.join(right, key, "full").select(
        key, F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "only_a").otherwise("only_b").alias("where"))


def range_mismatch(cells: DataFrame, source: str, a: str, b: str) -> DataFrame:
    """Fields both sources hold as numbers, with the two ranges and missing shares.

    ``cells`` is long: source, field, raw text value.
    """
    v = F.col("value").try_cast("double")
    g = cells.groupBy("field").agg(*[x for s in (a, b) for x in (
        F.min(F.when(F.col(source) == s, v)).alias(f"min_{s}"), F.max(F.when(F.col(source) == s, v)).alias(f"max_{s}"),
        F.count(F.when(F.col(source) == s, v)).alias(f"n_{s}"),
        F.try_divide(F.count_if((F.col(source) == s) & v.isNull()) * 100.0, F.count_if(F.col(source) == s)).alias(f"missing_pct_{s}"))])
    both = (F.col(f"n_{a}") > 0) & (F.col(f"n_{b}") > 0)
    return g.where(both).withColumn("mismatch", (F.col(f"min_{a}") != F.col(f"min_{b}")) | (F.col(f"max_{a}") != F.col(f"max_{b}")))


def expectation_check(fields: DataFrame, expected: DataFrame) -> DataFrame:
    """PASS or FAIL per expected field on presence, form, type and allowed codes."""
    meta = fields.groupBy("field_name").agg(
        F.min_by(F.struct("form_name", "field_type", "choices"), "row_id").alias("m"))
    j = expected.join(meta, "field_name", "left")
    codes = F.transform(X.choices(F.col("m.choices")), lambda p: p["code"])
    lacking = F.array_except(F.col("codes"), codes)
    detail = F.concat_ws("; ", F.when(F.col("m").isNull(), "missing field"),
                         F.when(F.col("m.form_name") != F.col("expected_form"), "form differs"),
                         F.when(F.col("m.field_type") != F.col("expected_type"), "type differs"),
                         F.when(F.col("m").isNotNull() & (F.size(lacking) > 0), F.concat(F.lit("codes missing: "), F.concat_ws(",", lacking))))
    return j.select("field_name", detail.alias("detail"), F.when(detail == "", "PASS").otherwise("FAIL").alias("result"))


def assert_expectations(checks: DataFrame) -> None:
    """Fail closed when any expectation failed."""
    from ..scale import require_empty

    require_empty(checks.where(F.col("result") == "FAIL"), "schema expectation failed")


def field_mapping_audit(fields: DataFrame, roles: dict[str, tuple[str, str]], exported: list[str],
                        system_rows: list[tuple[str, str, str]]) -> DataFrame:
    """Role, decision and export status of each field, with rows for system columns.

    The role and decision of a field come from a fixed map by field type.
    """
    table = F.create_map(*[x for k, (r, d) in roles.items() for x in (F.lit(k), F.struct(F.lit(r).alias("role"), F.lit(d).alias("decision")))])
    hit = F.try_element_at(table, F.col("field_type"))
    system = F.array(*[F.struct(F.lit(n).alias("field_name"), F.lit(r).alias("role"), F.lit(d).alias("decision"),
                                F.lit("system").alias("export_status")) for n, r, d in system_rows])
    own = fields.select(
        "field_name", F.coalesce(hit["role"], F.lit("other")).alias("role"), F.coalesce(hit["decision"], F.lit("not used")).alias("decision"),
        F.when(F.col("form_name").isin(*exported), "returned").otherwise("not requested").alias("export_status"))
    extra = fields.sparkSession.range(1).select(F.inline(system))
    return own.distinct().unionByName(extra)
