"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Text measures are column expressions. Rules reject a row; a row is kept if none does. On a sample the cascade
estimates what each rule costs and how much it rejects, and orders the rules by rejection per cost inside one
``CASE WHEN``, which stops at the first that fires. The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words, and the symbols counted.
BLANKS = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def measures(df: DataFrame, text: str = "text", window: int = 3) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (and _text, _words, _lines for the rules) to the rows.

    Null text has no words and no lines. Sizes are code points. Word windows are compared as 64-bit hashes: sorting (hash,
    position) brings equal ones together, and each position found adds the words that the next one does not cover.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    df = df.withColumn("_text", body)
    df = df.withColumns({"_words": words_of(F.col("_text")), "_lines": F.filter(F.split(F.col("_text"), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""), "_chars": F.char_length("_text")})
    words = F.col("_words")
    keys = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + d) for d in range(1, window)]))
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.char_length(without(F.col("_text"), BLANKS)).cast("long"),
        "n_symbols": (F.col("_chars") - F.char_length(without(F.col("_text"), SYMBOLS))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_k": F.when(F.size(words) > window, F.slice(keys, F.lit(1), F.size(words) - (window - 1))),
    })
    # a distinct count is cheap, and spares texts without a repeat the sort
    df = df.withColumn("_p", F.when(F.size(F.array_distinct("_k")) < F.size("_k"), F.sort_array(F.transform("_k", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))))
    p = F.col("_p")
    twice = F.filter(p, lambda e, j: (e["k"] == F.get(p, j - 1)["k"]) | (e["k"] == F.get(p, j + 1)["k"]))
    df = df.withColumn("_at", F.sort_array(F.transform(twice, lambda e: e["i"])))
    at = F.col("_at")
    covered = F.transform(at, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(at, j + 1) - x, F.lit(window))))
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))


@dataclass(frozen=True)
class Rule:
    """A name and the condition that rejects a row of :func:`measures`; a null condition does not reject."""

    name: str
    rejects: Column


def base_rules() -> list[Rule]:
    return [Rule("too_few_words", F.col("n_words") < 50), Rule("repeats_itself", 100 * F.col("n_repeat_words") > 50 * F.col("n_words"))]


def default_rules() -> list[Rule]:
    """Rules beyond the base ones. Thresholds are lenient, so that plain prose, lists and tables pass."""
    n = F.col("n_words")
    letters = F.char_length(F.regexp_replace("_text", r"[^\p{L}]+", ""))
    return [
        Rule("symbols", 100 * F.col("n_symbols") > 30 * n),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n)),
        Rule("duplicate_lines", (F.size("_lines") >= 4) & (100 * F.col("n_dup_lines") > 50 * F.size("_lines"))),
        Rule("few_letters", 100 * letters < 30 * F.col("word_chars")),
        Rule("exclamations", F.col("_chars") - F.char_length(without(F.col("_text"), "!")) > n),
        Rule("cut_off_lines", 100 * F.size(F.filter("_lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*\z"))) > 60 * F.size("_lines")),
    ]


def ordered(docs: DataFrame, rules: list[Rule], sample_rows: int = 1000, seed: int = 1) -> list[Rule]:
    """Rules by rejected share per second on a sample of at most about ``sample_rows`` rows, best first; ties keep the order given.

    The sample only sets the order. It is drawn over the whole table, measured and cut from its lineage, so each rule is timed by itself.
    """
    total = docs.count()
    if total == 0 or len(rules) < 2:
        return rules
    from .common import written

    sample = written(measures(docs.sample(min(1.0, sample_rows / total), seed)), "rules-sample")
    n = max(1, sample.count())
    gain = {}
    for rule in rules:
        start = time.perf_counter()
        rejected = sample.where(rule.rejects).count()
        gain[rule.name] = rejected / n / max(time.perf_counter() - start, 1e-6)
    return sorted(rules, key=lambda r: -gain[r.name])


def cascade(docs: DataFrame, rules: list[Rule] | None = None, doc_id: str = "doc_id", text: str = "text", sample_rows: int = 1000) -> DataFrame:
    """One row per input row: doc_id, the measures, base_failed, kept and the rule that rejected it (null if kept).

    The base rules always come first, since they alone decide ``base_failed``. Null text has no words, so it fails them.
    Equal rows get equal verdicts; an empty table gives none. Only the id and text are read, so other columns cannot clash.
    """
    rules = default_rules() if rules is None else rules
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rules = [*base_rules(), *ordered(docs, rules, sample_rows)]
    measured = measures(docs)
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.rejects, rule.name).otherwise(verdict)
    out = measured.withColumn("rejected_by", verdict)
    names = [r.name for r in base_rules()]
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.coalesce(F.col("rejected_by").isin(names), F.lit(False)).alias("base_failed"),
                      F.col("rejected_by").isNull().alias("kept"), "rejected_by")
