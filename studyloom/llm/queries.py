"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, grouping, html_text, importance, jaccard, language, licenses, negatives, packing, pii, rules, vector_codes, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def add(fn):
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return add


@query("op1_personal_data")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.col("span_text").alias("spans"), "n_login", "n_account")


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


@query("op3_licenses")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(table(spark, sf_dir, "documents"))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


@query("op4_language")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~held_out()))
    return language.predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


@query("op5_main_text")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


@query("op6_near_copies")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_copies(table(spark, sf_dir, "documents"))


@query("op7_importance")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("gumbel_key")


#: Words, lines and windows of op8, then its base rules and the cascade's.
OP8_SQL = r"""
with d as (select doc_id, coalesce(text, '') t, row_number() over () r from documents),
w as (select r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from d),
p as (select r, unnest(range(1, len(ws) - 1)) i, ws from w where len(ws) >= 3),
k as (select r, i, ws[i:i+2] g from p),
c as (select r, i, count(*) over (partition by r, g) n from k),
m as (select r, count(distinct x) n_repeat from (select r, unnest([i, i + 1, i + 2]) x from c where n > 1) group by r),
f as (select doc_id, ws, ls, t, len(ws)::bigint n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint n_symbols, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(n_repeat, 0)::bigint n_repeat_words
  from w left join m using (r)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 100 * n_symbols > 30 * n_words or word_chars < 2 * n_words or word_chars > 20 * n_words or (len(ls) >= 4 and 100 * n_dup_lines > 50 * len(ls))
    or 100 * length(regexp_replace(t, '[^\p{L}]+', '', 'g')) < 30 * word_chars or length(regexp_replace(t, '[^!]+', '', 'g')) > n_words
    or 100 * len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*\z'))) > 60 * len(ls)) kept
from b
"""


@query("op8_quality_rules", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.cascade(table(spark, sf_dir, "documents")).drop("rejected_by")


@query("op9_warc")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


#: Question and answer of each item, windows of each document, and the share of both that a window holds. An item with a question
#: of fewer than five words is also looked for whole, by n-grams of five words or, if it is shorter, of its own length.
OP10_SQL = r"""
with b as (select item_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) t from benchmark where text is not null),
c as (select *, instr(reverse(t), reverse(mark)) pos from b, (values (1, chr(10)), (2, '. '), (3, '? '), (4, '! ')) x(k, mark)),
hq as (select item_id, k, left(t, (length(t) - pos - length(mark) + 1)::int) q, right(t, (pos - 1)::int) a from c where pos > 0),
cut as (select item_id, arg_min(q, k) q, arg_min(a, k) a from hq where regexp_matches(q, '[\p{L}\p{N}_]') and regexp_matches(a, '[\p{L}\p{N}_]') group by item_id),
qa as (select b.item_id, b.t, coalesce(q, t) q, coalesce(a, '') a from b left join cut using (item_id)),
qw as (select item_id, regexp_extract_all(lower(q), '[\p{L}\p{N}_]+') w, regexp_extract_all(lower(t), '[\p{L}\p{N}_]+') whole, list_distinct(regexp_extract_all(lower(a), '[\p{L}\p{N}_]+')) a from qa),
parts as (select item_id, 'question' part, 5 n, w from qw where len(w) > 0 union all select item_id, 'whole', least(5, len(whole)), whole from qw where len(w) between 1 and 4),
ig as (select item_id, part, n, len(g) size, unnest(g) g from (select *, list_distinct(list_transform(range(1, greatest(2, len(w) - n + 2)), lambda i: array_to_string(w[i:i+n-1], ' '))) g from parts)),
big as (select greatest(1024, 2 * max(len(regexp_extract_all(lower(t), '[\p{L}\p{N}_]+')))) w from b),
d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') w, big.w size from documents, big where text is not null),
p as (select doc_id, unnest(range(0, greatest(1, len(w) - size // 2), size // 2)) s, w, size from d),
pw as (select doc_id, s, w[s+1:s+size] w from p),
pg as (select distinct doc_id, s, n, unnest(list_transform(range(1, greatest(2, len(w) - n + 2)), lambda i: array_to_string(w[i:i+n-1], ' '))) g from pw, (select distinct n from ig)),
h as (select doc_id, s, item_id, part, count(*) / any_value(size) q from pg join ig using (n, g) group by all having 100 * count(*) >= 75 * any_value(size)),
best as (select doc_id, s, item_id, max(q) q from h group by doc_id, s, item_id),
v as (select doc_id, item_id, q, case when len(a) = 0 then 1.0::double else len(list_intersect(a, pw.w)) / len(a) end a from best join pw using (doc_id, s) join qw using (item_id))
select doc_id, item_id, max(struct_pack(q := q, a := a)).q question_overlap, max(struct_pack(q := q, a := a)).a answer_overlap from v where 100 * a >= 75 group by doc_id, item_id
"""


@query("op10_benchmark_leaks", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("score")


def _codes_sql(rounds: int = 6, entries: int = 16, parts: int = 8, scale: int = 4096) -> str:
    """Codebooks by plain search of all entries, one pair of steps a round."""
    most = "(1073741824 // greatest(4, 8, (len(embedding) + 7) // 8))"
    steps = [f"""kept as materialized (select row_number() over () r, vec_id, label, list_transform(embedding, lambda x: greatest(-{most}, least({most}, floor({scale} * x::double)))::bigint) q
  from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (select r, vec_id, q, part, q[part * len(q) // {parts} + 1 : (part + 1) * len(q) // {parts}] v from kept, range({parts}) t(part)),
c0 as materialized (select part, row_number() over (partition by part order by vec_id nulls last, q) - 1 entry, v from p qualify entry < {entries})"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} as materialized (select r, part, arg_min(entry, (d, entry)) entry, min(d) d from (select r, part, entry,
  list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint d from p join c{i} c using (part)) group by r, part)""")
        if i < rounds:
            steps.append(f"""s{i} as materialized (select part, entry, j, sum(v[j]) s, count(*) n from (select part, entry, v, unnest(range(1, len(v) + 1)) j from a{i} join p using (r, part)) group by all),
c{i + 1} as materialized (select part, entry, coalesce(any_value(m.v), any_value(c.v)) v from c{i} c
  left join (select part, entry, list(((s - ((s % n) + n) % n) // n)::bigint order by j) v from s{i} group by part, entry) m using (part, entry) group by part, entry)""")
    return f"""with {", ".join(steps)},
h as (select sha256(string_agg(array_to_string(v, ','), ',' order by part, entry)) codebooks_sha256 from c{rounds}),
e as (select r, string_agg(printf('%02x', entry), '' order by part) code, sum(d)::bigint error from a{rounds} group by r)
select vec_id, code, error, sum(error) over (partition by label)::bigint label_error, codebooks_sha256 from e join kept using (r), h"""


@query("op11_vector_codes", _codes_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings")).drop("label")


#: Every anchor against every row.
OP12_SQL = """
with v as (select row_number() over () r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, list_transform(embedding, lambda x: floor(256 * x::double)) q
  from embeddings where label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (select a.r ar, a.vec_id anchor_id, b.r br, b.vec_id id, a.label = b.label same, list_inner_product(a.q, b.q)::bigint score from v a join v b on a.r <> b.r where a.vec_id % 100 = 0),
p as (select *, row_number() over (partition by ar order by score desc, id) k from s where same qualify k <= 5)
select p.anchor_id, p.id positive_id, row_number() over (partition by p.ar, p.br order by n.score desc, n.id)::int rank, n.id negative_id, p.score positive_score, n.score negative_score
from p join s n using (ar) where not n.same and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score qualify rank <= 10
"""


@query("op12_hard_negatives", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", noisy))


@query("op13_best_fit")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.best_fit_pack(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")
