"""Writers with redaction, manifests and all-or-nothing publishing (inventory S08-S13, S17)."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import privacy as P
from ..scale import running_over


def write_safe_csv(df: DataFrame, path: str) -> DataFrame:
    """Redacted, formula-safe UTF-8 CSV. Column names are redacted and made formula-safe like cells; names that become equal get a number.

    Spark writes a header per part file and no byte-order mark.
    """
    safe = P.redact_frame(df)
    # names are values of one row here, so the same expressions treat them
    names = df.sparkSession.range(1).select(*[P.spreadsheet_safe(P.redact_text(F.lit(c))).alias(str(i)) for i, c in enumerate(safe.columns)]).first()
    taken: dict[str, int] = {}
    cells = []
    for (c, k), name in zip(safe.dtypes, names):
        taken[name] = taken.get(name, 0) + 1
        cell = P.spreadsheet_safe(F.col(f"`{c}`")) if k == "string" else F.col(f"`{c}`")
        cells.append(cell.alias(name if taken[name] == 1 else f"{name}_{taken[name]}"))
    safe = safe.select(*cells)
    (safe.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").option("quoteAll", True)
     .option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return safe


def read_safe_csv(spark, path: str, schema) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").csv(path))


def write_split(df: DataFrame, base: str, name: str, restricted: bool, deny: set[str]) -> str:
    """Restricted tables to their own folder; a table to share may carry no identifier column."""
    if not restricted:
        P.refuse_identifiers(df, deny)
    path = f"{base}/{'restricted' if restricted else 'shareable'}/{name}"
    df.write.mode("overwrite").parquet(path)
    return path


def write_with_manifest(df: DataFrame, path: str, manifest: str, caption: str) -> None:
    """Write a table and append its row count, column count and content hash to the manifest."""
    seen = Observation()
    body = F.xxhash64(*[F.col(c) for c in df.columns])
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(F.pmod(body, F.lit(1 << 32))).alias("hash"))
    counted.write.mode("overwrite").parquet(path)
    got = seen.get
    row = df.sparkSession.range(1).select(
        F.lit(path).alias("path"), F.lit(caption).alias("caption"), F.lit(int(got["rows"])).cast("long").alias("rows"),
        F.lit(len(df.columns)).alias("columns"), F.lit(int(got["hash"] or 0)).cast("decimal(38,0)").alias("content_hash"))
    row.write.mode("append").parquet(manifest)


def publish_snapshot(df: DataFrame, base: str, date_column: str, source: str, required: set[str]) -> None:
    """Dated partitions plus a latest copy, only when every required source delivered rows.

    The latest copy is written to a folder of its own, and then one row that names it is appended to ``pointer``. A reader
    (:func:`read_latest`) follows the newest row, so it never meets half a copy, and a failed job leaves the one before in place.
    """
    present = {r[source] for r in df.select(source).where(F.col(source).isin(*sorted(required))).distinct().collect()}
    if present != required:
        raise ValueError(f"nothing published, sources missing: {sorted(required - present)}")
    spark = df.sparkSession
    # rebalance groups rows by date for few files, and splits a date that holds very many
    (df.hint("rebalance", date_column).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(date_column).parquet(f"{base}/dated"))
    dated = spark.read.parquet(f"{base}/dated")
    newest = dated.agg(F.max(date_column).alias("d")).collect()[0]["d"]
    path = f"{base}/latest/{uuid.uuid4().hex}"
    dated.where(F.col(date_column) == F.lit(newest)).write.parquet(path)
    turn = spark.read.parquet(f"{base}/pointer").agg(F.max("turn")).first()[0] + 1 if _has_rows(spark, f"{base}/pointer") else 0
    spark.range(1).select(F.lit(turn).cast("long").alias("turn"), F.lit(path).alias("path")).write.mode("append").parquet(f"{base}/pointer")


def _has_rows(spark, path: str) -> bool:
    try:
        return bool(spark.read.schema("turn long, path string").parquet(path).take(1))
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def read_latest(spark, base: str) -> DataFrame:
    """The latest published copy."""
    return spark.read.parquet(spark.read.parquet(f"{base}/pointer").orderBy(F.desc("turn"), "path").first()["path"])


def archive_before(df: DataFrame, date_column: str, keep_from: str) -> tuple[DataFrame, DataFrame]:
    """(kept, archived) rows of the dated copies."""
    kept = F.col(date_column) >= F.lit(keep_from).cast("date")
    return df.where(kept), df.where(~kept)


def run_manifest(counts: DataFrame, project: str, policies: dict[str, str]) -> DataFrame:
    """One JSON document per project with suppressed counts, policies and a check."""
    g = counts.groupBy(project).agg(F.sort_array(F.collect_list(F.struct("category", "n"))).alias("rows"))
    shown = F.transform("rows", lambda r: F.struct(r["category"].alias("category"), P.public_count(r["n"]).alias("count")))
    doc = F.struct(F.col(project), shown.alias("counts"),
                   F.struct(*[F.lit(v).alias(k) for k, v in policies.items()]).alias("policies"),
                   F.struct((F.size("rows") > 0).alias("has_rows")).alias("checks"))
    return g.select(project, F.to_json(doc).alias("manifest"))


def append_facts(base: str, runs: DataFrame, candidates: DataFrame, outcomes: DataFrame, date_column: str = "run_date") -> None:
    """Append the three decision tables, partitioned by run date so a period reads few files."""
    for name, df in (("run", runs), ("candidate", candidates), ("outcome", outcomes)):
        df.hint("rebalance", date_column).write.mode("append").partitionBy(date_column).parquet(f"{base}/{name}")


def code_table(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values numbered from 1, without a single global window."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    return running_over(values, [], [F.col(column)], code=("rows",))


def compact_export(df: DataFrame, columns: list[str], flags: list[tuple[str, Column]], keep: list[str]) -> DataFrame:
    """Low-cardinality text as integer codes and booleans packed into one bit field."""
    out = df
    for c in columns:
        codes = code_table(df, c).select(F.col(c), F.col("code").alias(f"{c}_code"))
        out = out.join(codes, c, "left")  # Spark broadcasts a code table only under its own size limit
    bits = F.lit(0)
    for i, (_, test) in enumerate(flags):
        bits = bits.bitwiseOR(F.shiftleft(F.when(test, 1).otherwise(0), i))
    return out.select(*keep, *[f"{c}_code" for c in columns], bits.alias("flags"))


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("Window",)]
