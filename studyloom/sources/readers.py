"""Readers and gates for messy inputs (inventory S01-S07, S14-S16, X41)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..scale import require_empty

def headerless_csv(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Every cell as text in columns c0.., malformed lines kept in ``_bad``."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)] + [T.StructField("_bad", T.StringType())])
    return (spark.read.schema(schema).option("header", False).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_bad").option("multiLine", False).csv(path))


def split_blocks(sheet: DataFrame, blocks: dict[str, list[int]], headers: set[str]) -> DataFrame:
    """Tables that stand side by side on one sheet, as (block, key, cells) from a single scan.

    A row belongs to a block when its first cell there is filled and is not a header text.
    """
    made = []
    for name, positions in blocks.items():
        key = F.trim(F.col(f"c{positions[0]}"))
        keep = X.is_filled(key) & ~F.lower(key).isin(*sorted(h.lower() for h in headers))
        made.append(F.when(keep, F.struct(F.lit(name).alias("block"), key.alias("key"),
                                          F.array(*[F.col(f"c{p}") for p in positions[1:]]).alias("cells"))))
    return sheet.select(F.explode(F.array_compact(F.array(*made))).alias("b")).select("b.block", "b.key", "b.cells")


def row_fingerprints(df: DataFrame) -> DataFrame:
    """Rows and an order-free content hash per file. Every file is read by rows, split over tasks, whatever its size.

    Row hashes are added modulo 2^64, so equal rows do not cancel out.
    """
    # the sum of unsigned halves stays exact far beyond any row count
    body = F.xxhash64(*[F.col(c) for c in df.columns])
    halves = df.select(F.col("_metadata.file_path").alias("path"), F.shiftrightunsigned(body, 32).alias("hi"), body.bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo"))
    sums = halves.groupBy("path").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("hi").cast("decimal(20,0)")).alias("hi"), F.sum(F.col("lo").cast("decimal(20,0)")).alias("lo"))
    total = F.col("hi") * F.lit(1 << 32).cast("decimal(20,0)") + F.col("lo")
    return sums.select("path", "rows", F.pmod(total, F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string").alias("row_hash"))


def file_listing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Path, size and time of every file under the paths; contents are not read."""
    return spark.read.format("binaryFile").load(paths).select("path", "length", "modificationTime")


def file_key(path: str | Column) -> Column:
    """A file's path without its scheme, percent signs decoded, so that names from different sources compare."""
    return F.regexp_replace(F.url_decode(F.replace(F.col(path) if isinstance(path, str) else path, F.lit("+"), F.lit("%2B"))), "^[a-z]+:/+", "/")


def parquet_fingerprints(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Path, rows, columns and row hash of every Parquet file; a file without rows has hash 0."""
    out = None
    for p in paths:
        df = spark.read.parquet(p)
        there = file_listing(spark, [p]).select(file_key("path").alias("path"))
        one = there.join(row_fingerprints(df).withColumn("path", file_key("path")), "path", "left")
        one = one.select("path", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), F.lit(len(df.columns)).alias("columns"), F.coalesce("row_hash", F.lit("0")).alias("row_hash"))
        out = one if out is None else out.unionByName(one)
    return out


def file_inventory(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Path, size, time, rows, columns and row hash of each file."""
    listed = file_listing(spark, paths).withColumn("path", file_key("path"))
    return listed.join(parquet_fingerprints(spark, paths), "path").select(
        F.substring_index("path", "/", -1).alias("file"), "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "rows", "columns", "row_hash")


def verified_parquet(spark: SparkSession, paths: list[str], sidecar: DataFrame) -> DataFrame:
    """Read cached files only when each has one row in the sidecar (path, rows, row_hash) that agrees with its content.

    A file without a sidecar row, a sidecar row without a file, a repeated row and a difference all stop the read.
    """
    now = parquet_fingerprints(spark, paths).select("path", "rows", "row_hash", F.lit(1).alias("_there"))
    said = sidecar.select("path", F.col("rows").alias("_rows"), F.col("row_hash").alias("_hash"))
    said = said.groupBy("path").agg(F.count(F.lit(1)).alias("_n"), F.first("_rows").alias("_rows"), F.first("_hash").alias("_hash"))
    ok = (F.col("_there") == 1) & (F.col("_n") == 1) & (F.col("rows") == F.col("_rows")) & (F.col("row_hash") == F.col("_hash"))
    require_empty(now.join(said, "path", "full").where(~F.coalesce(ok, F.lit(False))).select("path"), "cached file does not match its checksum")
    return spark.read.parquet(*paths)


def namespaced_union(sources: dict[str, DataFrame], id_column: str, expected_rows: dict[str, int] | None = None) -> DataFrame:
    """Stack sources with a source stamp and a global uid, failing on unusable ids.

    Missing columns become null. Blank ids, duplicate uids and row-count drift stop the load.
    """
    out = None
    for name, df in sources.items():
        rid = X.safe_text(F.col(id_column))
        one = df.withColumn("source", F.lit(name)).withColumn("uid", F.concat_ws("_", F.lit(name), F.trim(rid)))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    gate = out.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.max(~X.is_filled(F.col(id_column))).alias("blank"))
    require_empty(gate.where((F.col("n") > 1) | F.col("blank")), "blank or repeated record id")
    if expected_rows:
        got = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
        drift = {s: (got.get(s, 0), n) for s, n in expected_rows.items() if got.get(s, 0) != n}
        if drift:
            raise ValueError(f"row count drift: {drift}")
    return out


def normal_header(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", name.strip().lower())


def resolve_columns(columns: list[str], aliases: dict[str, list[str]], mapping: dict[str, str] | None = None) -> dict[str, str]:
    """Canonical name to source header; explicit mapping wins, an ambiguous alias is an error."""
    found: dict[str, str] = {}
    for target, names in aliases.items():
        if mapping and target in mapping:
            want = mapping[target]
            hits = [c for c in columns if c == want] or [c for c in columns if c.lower() == want.lower()]
        else:
            keys = {normal_header(n) for n in [target, *names]}
            hits = [c for c in columns if normal_header(c) in keys]
        if len(hits) > 1:
            raise ValueError(f"ambiguous columns for {target}: {hits}")
        if hits:
            found[target] = hits[0]
    return found


def aliased_scan(df: DataFrame, aliases: dict[str, list[str]], numeric: set[str], mapping: dict[str, str] | None = None) -> DataFrame:
    """Canonical columns with numbers read leniently and a flag for unreadable ones."""
    found = resolve_columns(df.columns, aliases, mapping)
    out = []
    for target, source in found.items():
        c = F.col(f"`{source}`")
        out.append(c.try_cast("double").alias(target) if target in numeric else c.alias(target))
    bad = sum(((X.is_filled(F.col(f"`{found[n]}`")) & F.col(f"`{found[n]}`").try_cast("double").isNull()).cast("int")
               for n in sorted(numeric & set(found))), F.lit(0))
    return df.select(*out, bad.alias("unreadable"))


def decode_dictionary(coded: DataFrame, labelled: DataFrame, on: str, pairs: dict[str, str]) -> DataFrame:
    """(field, code, label) for column pairs in which code and label determine each other."""
    j = coded.join(labelled, on)
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("code"), F.col(l).alias("label"))
                      for c, l in pairs.items()])
    long = j.select(F.explode(cells).alias("x")).select("x.*").where(F.col("code").isNotNull() & F.col("label").isNotNull())
    # (field, code, label) triples are counted first, so what is tested next is as small as the code lists
    triples = long.groupBy("field", "code", "label").agg(F.count(F.lit(1)).alias("n"))
    per_code = triples.groupBy("field", "code").agg(F.count(F.lit(1)).alias("k"))
    per_label = triples.groupBy("field", "label").agg(F.count(F.lit(1)).alias("k"))
    mixed = per_code.where("k > 1").select("field").unionByName(per_label.where("k > 1").select("field")).distinct()
    return triples.join(mixed, "field", "left_anti")


def decode_agreement(coded: DataFrame, labelled: DataFrame, on: str, pairs: dict[str, str]) -> DataFrame:
    """Share of cells whose decoded label equals the labelled export, per field."""
    table = decode_dictionary(coded, labelled, on, pairs)
    j = coded.join(labelled, on)
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("code"), F.col(l).alias("seen"))
                      for c, l in pairs.items()])
    cell_counts = j.select(F.explode(cells).alias("x")).select("x.*").groupBy("field", "code", "seen").agg(F.count(F.lit(1)).alias("cells"))
    d = cell_counts.join(table.select("field", "code", "label"), ["field", "code"], "left")
    return d.groupBy("field").agg(F.sum("cells").alias("cells"),
                                  F.sum(F.when(F.col("label") == F.col("seen"), F.col("cells")).otherwise(0)).alias("agreeing"))


def minimal_projection(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that exist, in order, once each."""
    return df.select(*dict.fromkeys(c for c in wanted if c in df.columns))


def runs_between(runs: DataFrame, start: str, end: str, at: str = "scored_at") -> DataFrame:
    """Runs of a half-open period; the bounds are pushed to the scan."""
    kind = dict(runs.dtypes)[at]
    return runs.where((F.col(at) >= F.lit(start).cast(kind)) & (F.col(at) < F.lit(end).cast(kind)))


def of_runs(facts: DataFrame, runs: DataFrame, key: str = "run_id") -> DataFrame:
    """Facts of the selected runs, by semi join."""
    return facts.join(runs.select(key), key, "left_semi")


def unseen(batch: DataFrame, seen: DataFrame, content: Column, name: str = "content_hash") -> DataFrame:
    """First row per content hash that no earlier import has stored; unreadable rows are left."""
    key = F.sha2(content, 256)
    fresh = batch.where(content.isNotNull()).withColumn(name, key).join(seen.select(name), name, "left_anti")
    cols = [c for c in batch.columns]
    first = fresh.groupBy(name).agg(F.min_by(F.struct(*cols), cols[0]).alias("r"))
    return first.select("r.*", name)


def latest_review(decisions: DataFrame, block: str, order: list[str], keep: list[str]) -> DataFrame:
    """Last decision per block. Partial aggregation keeps a hot block spread out."""
    last = decisions.groupBy(block).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("r"), F.count(F.lit(1)).alias("decisions"))
    return last.select(block, "r.*", "decisions")
