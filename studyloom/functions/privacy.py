"""Redaction, spreadsheet safety and small-cell suppression (inventory X28, X31-X33, S09)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import safe_text

# Patterns and limits of the sharing policy.
SENSITIVE_LABEL = r"(?:api[\s_-]*token|access[\s_-]*token|authorization|bearer|password|secret)"
SECRET_ASSIGNMENT = r"((?:api[\s_-]*token|access[\s_-]*token|password|secret)\s*[:=]\s*)([^\s,;]+)"
BEARER = r"\bBearer\s+[A-Za-z0-9._~+/=-]{12,}"
LONG_HEX = r"\b[0-9A-Fa-f]{32,64}\b"
REDACTED = "[REDACTED]"
FORMULA_START = r"^[ \t\r\n]*[=+\-@]"
SMALL_CELL = 10


def redact_text(c: Column, max_length: int | None = None) -> Column:
    """Mask secret assignments, bearer strings and long hex runs, then bound the length."""
    t = F.regexp_replace(safe_text(c), "(?i)" + SECRET_ASSIGNMENT, "$1[REDACTED]")
    t = F.regexp_replace(t, "(?i)" + BEARER, REDACTED)
    t = F.regexp_replace(t, LONG_HEX, REDACTED)
    return t if max_length is None else F.substring(t, 1, max_length)


def is_sensitive_name(name: str) -> bool:
    """A column or key name that looks like it holds a secret."""
    return re.search(SENSITIVE_LABEL, name, flags=re.IGNORECASE) is not None


def redact_frame(df: DataFrame) -> DataFrame:
    """Mask whole columns with a sensitive name, redact inside the other text columns."""
    out = []
    for name, kind in df.dtypes:
        if is_sensitive_name(name):
            value = F.when(safe_text(F.col(f"`{name}`")) == "", "").otherwise(REDACTED)
        elif kind == "string":
            value = F.when(F.col(f"`{name}`").isNotNull(), redact_text(F.col(f"`{name}`")))
        else:
            value = F.col(f"`{name}`")
        out.append(value.alias(name))
    return df.select(*out)


def redact_json(c: Column, extra_sensitive: str | None = None) -> Column:
    """The same rule inside a flat JSON object, by key."""
    names = SENSITIVE_LABEL if extra_sensitive is None else f"(?:{SENSITIVE_LABEL}|{extra_sensitive})"
    parsed = F.from_json(c, "map<string,string>")
    return F.to_json(F.transform_values(parsed, lambda k, v: F.when(
        k.rlike("(?i)" + names), F.when(safe_text(v) == "", "").otherwise(REDACTED)).otherwise(redact_text(v))))


def spreadsheet_safe(c: Column) -> Column:
    """Prefix an apostrophe when a spreadsheet would read the text as a formula."""
    return F.when(c.rlike(FORMULA_START), F.concat(F.lit("'"), c)).otherwise(c)


def is_small(n: Column) -> Column:
    return n.between(1, SMALL_CELL - 1)


def public_count(n: Column) -> Column:
    """1 to 9 shown as ``<10``; zero and larger counts as they are."""
    return F.when(is_small(n), f"<{SMALL_CELL}").otherwise(n.cast("string"))


def public_band(n: Column) -> Column:
    """Diagnostics in bands of ten, zero as zero."""
    low = n - F.pmod(n, F.lit(SMALL_CELL))
    return (F.when(n == 0, "0").when(is_small(n), f"<{SMALL_CELL}")
            .otherwise(F.concat(low.cast("string"), F.lit("–"), (low + SMALL_CELL - 1).cast("string"))))


def public_ratio(actual: Column, target: Column) -> Column:
    """No ratio for a suppressed count."""
    return F.when(~is_small(actual), ratio(actual, target))


def ratio(actual: Column, target: Column) -> Column:
    """Actual over target, null for no target."""
    return F.try_divide(actual.cast("double"), F.nullif(target.cast("double"), F.lit(0.0)))


def percent_text(actual: Column, target: Column) -> Column:
    """Whole percent, halves to even, or N/A."""
    return F.coalesce(F.concat(F.bround(ratio(actual, target) * 100).cast("long").cast("string"), F.lit("%")), F.lit("N/A"))


def status(actual: Column, target: Column, dialect: str = "report", at_current: Column | None = None) -> Column:
    """On or below target in one of three wordings."""
    no_target = target.isNull() | (target == 0)
    if dialect == "report":
        return (F.when(actual.isNull(), "").when(no_target, "N/A").when(actual >= target, "On Target")
                .otherwise("Below Target"))
    if dialect == "text":
        now = F.lit(False) if at_current is None else at_current
        return (F.when(no_target, "N/A").when(actual.isNull(), F.when(now, "Pending").otherwise(""))
                .when(actual >= target, "On Target").otherwise("Below Target"))
    if dialect == "long":
        return (F.when(no_target, "N/A").when(actual.isNull(), "Not reported").when(actual >= target, "On target")
                .otherwise("Behind"))
    raise ValueError(f"unknown dialect {dialect}")


def public_status(actual: Column, target: Column) -> Column:
    """Status hidden together with a suppressed count."""
    return F.when(is_small(actual), "Suppressed").otherwise(status(actual, target))


def refuse_identifiers(df: DataFrame, deny: set[str]) -> DataFrame:
    """Fail when a table for sharing carries a direct identifier column."""
    found = sorted({c for c in df.columns if c.lower() in {d.lower() for d in deny}})
    if found:
        raise ValueError(f"identifier columns may not be shared: {found}")
    return df
