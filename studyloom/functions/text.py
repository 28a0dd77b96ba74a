"""Text, code and choice-list expressions (inventory X01-X16, X21-X22, X45)."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The spellings read as true.
TRUE_WORDS = ("1", "true", "t", "yes", "y")
CHECKED_WORDS = ("1", "true", "yes", "y")
# Text patterns.
TAG_PATTERN = r"(?<![A-Za-z0-9_])@([A-Za-z][A-Za-z0-9_-]*)"
MARKUP_PATTERN = r"(?s)<[^>]*>"
VISIT_EVENT_PATTERN = r"^(\d+)_months?_arm_\d+$"
COPY_ID_PATTERN = r"--[12]$"
# Default code maps of the two coded domains.
DEFAULT_CODES = {
    "toy": {
        "1": "RING", "2": "SQUIGGLE", "3": "NOISEMAKER", "4": "BLOCK", "5": "CAR", "6": "DRUM",
        "RING STACKER": "RING", "SQUIGGLE2": "SQUIGGLE", "NO TOY": "NO_TOY", "NONE": "NO_TOY",
        "NO OBJECT": "NO_TOY",
    },
    "looking": {
        "LOOK": "1", "LOOKING": "1", "YES": "1", "TRUE": "1",
        "NOT LOOKING": "0", "NO": "0", "FALSE": "0",
    },
}


def safe_text(c: Column) -> Column:
    """Null becomes the empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))


def is_filled(c: Column) -> Column:
    """True when something other than white space is there."""
    return F.length(F.regexp_replace(safe_text(c), r"^\s+|\s+$", "")) > 0


@F.pandas_udf(T.StringType())
def _decode_entities(texts: pd.Series) -> pd.Series:
    from html import unescape

    return texts.map(unescape, na_action="ignore")


def plain_text(c: Column, all_entities: bool = True) -> Column:
    """Decode entities, drop markup, collapse white space.

    With ``all_entities`` the complete entity list is applied in Arrow batches; otherwise the
    five basic ones and the no-break space are replaced by JVM expressions alone.
    """
    text = safe_text(c)
    if all_entities:
        # only texts with an ampersand leave the JVM's hands changed; the others are sent as null
        text = F.when(text.contains("&"), _decode_entities(F.when(text.contains("&"), text))).otherwise(text)
    else:
        for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                           ("&nbsp;", " "), ("&amp;", "&")):
            text = F.replace(text, F.lit(name), F.lit(char))
    text = F.replace(F.regexp_replace(text, MARKUP_PATTERN, " "), F.lit(" "), F.lit(" "))
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def comparison_key(c: Column) -> Column:
    """Plain text in lower case for exact comparison, every entity decoded."""
    return F.lower(plain_text(c))


def field_key(c: Column) -> Column:
    """Trimmed lower-case field name."""
    return F.lower(F.trim(safe_text(c)))


def as_bool(c: Column) -> Column:
    """The accepted spellings of true."""
    return F.lower(F.trim(safe_text(c))).isin(*TRUE_WORDS)


def is_checked(c: Column) -> Column:
    """A ticked checkbox cell."""
    return F.lower(F.coalesce(string_code(c), F.lit(""))).isin(*CHECKED_WORDS)


def tags(c: Column) -> Column:
    """Upper-case ``@TAG`` tokens, each once, in first-seen order."""
    found = F.regexp_extract_all(safe_text(c), F.lit(TAG_PATTERN), F.lit(1))
    return F.array_distinct(F.transform(found, lambda t: F.concat(F.lit("@"), F.upper(t))))


def usable_patterns(patterns: list[str]) -> list[str]:
    """Keep the patterns that compile; a bad one is ignored."""
    good = []
    for p in patterns:
        try:
            re.compile(p)
            good.append(p)
        except re.error:
            continue
    return good


def matches_any(columns: list[Column], patterns: list[str]) -> Column:
    """Any pattern, ignoring case, found in any of the columns."""
    tests = [safe_text(c).rlike("(?i)" + p) for c in columns for p in usable_patterns(patterns)]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def choices(c: Column) -> Column:
    """``code, label | code, label`` as an array of (code, label); a later code wins."""
    items = F.filter(F.split(safe_text(c), r"\|"), lambda s: F.instr(s, ",") > 0)
    pairs = F.transform(items, lambda s: F.struct(
        F.trim(F.substring_index(s, ",", 1)).alias("code"),
        F.trim(F.regexp_replace(F.substr(s, F.instr(s, ",") + 1), r"\s+", " ")).alias("label")))
    pairs = F.filter(pairs, lambda p: p["code"] != "")

    def mark(all_pairs):
        return F.transform(all_pairs, lambda p, i: F.struct(
            p["code"].alias("code"), p["label"].alias("label"),
            F.exists(F.slice(all_pairs, i + 2, F.size(all_pairs) + 1), lambda q: q["code"] == p["code"]).alias("again")))

    last = F.get(F.transform(F.array(pairs), mark), F.lit(0))
    return F.transform(F.filter(last, lambda p: ~p["again"]),
                       lambda p: F.struct(p["code"].alias("code"), p["label"].alias("label")))


def choice_map(c: Column) -> Column:
    """The choice list as a map of code to label."""
    return F.map_from_entries(choices(c))


def numeric_codes(c: Column) -> Column:
    """Sorted distinct numeric codes, or an empty array when any code is not a number."""
    raw = F.transform(choices(c), lambda p: p["code"].try_cast("double"))
    return F.when(F.exists(raw, lambda v: v.isNull()), F.array().cast("array<double>")).otherwise(
        F.array_sort(F.array_distinct(raw)))


def string_code(c: Column) -> Column:
    """Code text with ``1.0`` as ``1``, a real ``0`` kept, blank as null."""
    return F.nullif(F.regexp_replace(F.trim(c.cast("string")), r"^([+-]?\d+)\.0+$", "$1"), F.lit(""))


def code_order(c: Column) -> Column:
    """Sort key that puts integer codes before other text."""
    return F.struct((~c.rlike(r"^-*\d+$")).alias("other"), c.alias("code"))


def sorted_codes(codes: Column) -> Column:
    """Distinct codes, integers first, each side in text order."""
    return F.transform(F.array_sort(F.transform(F.array_distinct(codes), code_order)), lambda s: s["code"])


def event_month(c: Column) -> Column:
    """Months from an event name such as ``9_months_arm_1``."""
    return F.regexp_extract(safe_text(c), VISIT_EVENT_PATTERN, 1).try_cast("int")


def strict_iso_date(c: Column) -> Column:
    """A date only when written as yyyy-mm-dd."""
    t = F.trim(safe_text(c))
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))


def is_copy_id(c: Column) -> Column:
    """X11: a double-entry copy of a record."""
    return safe_text(c).rlike(COPY_ID_PATTERN)


def is_included_id(c: Column) -> Column:
    """X11: filled and not a copy."""
    return is_filled(c) & ~is_copy_id(c)


def allow_list(c: Column, lookup: dict[str, list[str]], missing: tuple[str, ...] = ("na", "n/a")) -> Column:
    """(canonical, members, status) of a raw value against a small fixed list.

    The canonical value is the raw text, null when missing; a listed value carries its members.
    """
    text = F.trim(safe_text(c))
    key = F.lower(text)
    table = F.create_map(*[x for k, members in lookup.items()
                           for x in (F.lit(k.lower()), F.array(*[F.lit(m) for m in members]))])
    gone = (key == "") | key.isin(*missing)
    members = F.when(~gone, F.try_element_at(table, key))
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(~gone, text).alias("canonical"),
        F.coalesce(members, none).alias("members"),
        F.when(gone, "missing").when(members.isNull(), "unexpected").otherwise("recognised").alias("status"))


def clean_token(c: Column) -> Column:
    """Upper case, no trailing ``.0``, separators as one space, blank as null."""
    t = F.upper(F.trim(c.cast("string")))
    t = F.when(t.rlike(r"^[+-]?\d+\.0+$"), F.substring_index(t, ".", 1)).otherwise(t)
    return F.nullif(F.trim(F.regexp_replace(t, r"[\s_-]+", " ")), F.lit(""))


def canonical_label(c: Column) -> Column:
    """Clean token with underscores."""
    return F.replace(clean_token(c), F.lit(" "), F.lit("_"))


def _lookup(token: Column, mapping: dict) -> Column:
    if not mapping:
        return F.lit(None).cast("string")
    pairs = {re.sub(r"[\s_-]+", " ", str(k).strip().upper()).strip():
             re.sub(r"[\s_-]+", " ", str(v).strip().upper()).strip().replace(" ", "_") for k, v in mapping.items()}
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.try_element_at(table, token)


def normalise_code(c: Column, domain: str, age_months: Column | None = None, custom: dict | None = None,
                   defaults: dict[str, dict[str, str]] | None = None) -> Column:
    """caller's map, then the age rule for code 7, then defaults, then the label itself."""
    token = clean_token(c)
    by_age = F.lit(None).cast("string")
    if domain == "toy":
        age = F.lit(None).cast("int") if age_months is None else age_months
        by_age = F.when(token == "7", F.when(age == 9, "FISH").when(age.isNotNull(), "POP").otherwise("7"))
    known = (DEFAULT_CODES if defaults is None else defaults).get(domain, {})
    return F.coalesce(_lookup(token, custom or {}), by_age, _lookup(token, known), canonical_label(c))


def hhmmss(seconds: Column) -> Column:
    """Signed HH:MM:SS.mmm."""
    total = F.abs(seconds)
    return F.when(seconds.isNotNull(), F.format_string(
        "%s%02d:%02d:%06.3f",
        F.when(seconds < 0, "-").otherwise(""),
        F.floor(total / 3600).cast("int"),
        F.floor(F.pmod(total, F.lit(3600.0)) / 60).cast("int"),
        F.pmod(total, F.lit(60.0))))


def identity_from_path(path: Column) -> Column:
    """(participant_id, age_months) read from a file name."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    pid = F.regexp_extract(stem, r"(?<!\d)(\d{3,})(?!\d)", 1)
    age = F.regexp_extract(F.lower(stem), r"(?<!\d)0?(6|9|12)m(?![a-z])", 1)
    return F.struct(F.nullif(pid, F.lit("")).alias("participant_id"), age.try_cast("int").alias("age_months"))


def fingerprint(answers: Column, null_mark: str = "<NA>") -> Column:
    """SHA-256 of the ordered answers with nulls marked."""
    return F.sha2(F.concat_ws("|", F.transform(answers, lambda v: F.coalesce(v.cast("string"), F.lit(null_mark)))), 256)


def open_text_stats(columns: list[Column]) -> Column:
    """(filled, mean_length, joined) over the filled fields."""
    filled = F.filter(F.array(*[F.trim(safe_text(c)) for c in columns]), lambda s: s != "")
    n = F.size(filled)
    total = F.aggregate(filled, F.lit(0), lambda a, s: a + F.length(s))
    return F.struct(n.alias("filled"), F.when(n > 0, total / n).otherwise(F.lit(0.0)).alias("mean_length"),
                    F.concat_ws(" ", filled).alias("joined"))


# The statuses a banner may state.
ABSENCE = r"unavailable(?: for visits)?|out(?: of office)?|ooo|pto|on leave|off"


def unavailability(c: Column, statuses: str = ABSENCE) -> Column:
    """(name, status) of a banner such as ``Aug 11 Ana Out``; anything else is null."""
    text = F.trim(F.regexp_replace(safe_text(c), r"\s+", " "))
    word = r"[A-Z][A-Za-z'’\-]{1,30}"
    pattern = rf"(?i)^(?:\S+ ){{0,2}}?({word})(?: {word})?(?: is)? ({statuses})$"
    name = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return F.struct(name.alias("name"),
                    F.when(name.isNotNull(), F.lower(F.regexp_extract(text, pattern, 2))).alias("status"))
