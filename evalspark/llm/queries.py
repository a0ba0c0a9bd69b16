"""The queries of this package's operators over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import best_fit, bpe, fill_in_middle, html_text, langid, packing, quality, secret_scan, sharding, simhash, topk, url_filter, vector_codes
from evalspark.llm.common import table
from evalspark.plans.storage import cut

URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
SHARDS = 40


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.train(url_filter.labelled_urls(spark))
    return url_filter.judge(table(spark, sf_dir, "pages"), "page_id", "url", URL_RULES, model)


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, "doc_id", "text", packing.TRAINING, prompt_text=packing.heading(F.col("text")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs, "doc_id", "text", "lang"), "doc_id", "text")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = docs.select("doc_id", quality.features(F.col("text")).alias("r")).select("doc_id", "r.*")
    voted = cut(quality.votes(counted))
    judged = quality.judge(voted, quality.fit(voted))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), "doc_id", "text", ["lang", "source", "doc_id"], SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"), "doc_id", "text")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), "doc_id", "text")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"), "page_id", "url", "html")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.transform(table(spark, sf_dir, "documents"), "doc_id", "text")
    rebuilt = fill_in_middle.restored(F.col("output"), F.col("form"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(rebuilt, 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("label"))
    return coded.withColumn("codebooks_sha256", F.lit(vector_codes.digest(books)))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_exact_top_k, op3_packing, op4_simhash, op5_language_id,
        op6_quality_rules, op7_sharding, op8_secret_scan, op9_bpe, op10_html_extraction,
        op11_fill_in_middle, op12_vector_codes, op13_best_fit,
    )
}

ORACLES = {
    "op2_exact_top_k": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as q from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as query_id, b.vec_id, cast(list_inner_product(a.q, b.q) as bigint) as score
  from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, cast(rank as int) as rank, vec_id, score from ranked where rank <= 20""",
    "op11_fill_in_middle": r"""
with d as (
  select doc_id, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as tokens,
    sha256('42:' || coalesce(cast(doc_id as varchar), '')) as hex from documents),
h as (
  select doc_id, text, tokens, len(tokens) as n, cast('0x' || hex[1:8] as bigint) as h1, cast('0x' || hex[9:16] as bigint) as h2,
    cast('0x' || hex[17:24] as bigint) as h3, cast('0x' || hex[25:32] as bigint) as h4 from d),
f as (
  select *, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain'
      when h4 % 100 < 80 then 'spm' else 'psm' end as form,
    array_to_string(tokens[1:least(h1 % (n + 1), h2 % (n + 1))], '') as p,
    array_to_string(tokens[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') as m,
    array_to_string(tokens[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') as s from h)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m
    else '<P>' || p || '<S>' || s || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from f""",
    "op12_vector_codes": """
with k as (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select vec_id, label, i as part, q[4 * i + 1] as x0, q[4 * i + 2] as x1, q[4 * i + 3] as x2, q[4 * i + 4] as x3 from k, range(16) t(i)),
f as (select vec_id, row_number() over (order by vec_id) - 1 as entry from k qualify entry < 64),
b0 as (select part, entry, x0, x1, x2, x3 from p join f using (vec_id)),
d0 as (
  select p.*, b.entry, (p.x0 - b.x0) ** 2 + (p.x1 - b.x1) ** 2 + (p.x2 - b.x2) ** 2 + (p.x3 - b.x3) ** 2 as apart from p join b0 b using (part)),
a0 as (select * from d0 qualify row_number() over (partition by vec_id, part order by apart, entry) = 1),
n0 as (select part, entry, cast((s0 - ((s0 % n) + n) % n) // n as bigint) as x0, cast((s1 - ((s1 % n) + n) % n) // n as bigint) as x1, cast((s2 - ((s2 % n) + n) % n) // n as bigint) as x2, cast((s3 - ((s3 % n) + n) % n) // n as bigint) as x3 from (select part, entry, count(*) as n, sum(x0) as s0, sum(x1) as s1, sum(x2) as s2, sum(x3) as s3 from a0 group by part, entry)),
b1 as (select part, entry, coalesce(n.x0, b.x0) as x0, coalesce(n.x1, b.x1) as x1, coalesce(n.x2, b.x2) as x2, coalesce(n.x3, b.x3) as x3 from b0 b left join n0 n using (part, entry)),
d1 as (
  select p.*, b.entry, (p.x0 - b.x0) ** 2 + (p.x1 - b.x1) ** 2 + (p.x2 - b.x2) ** 2 + (p.x3 - b.x3) ** 2 as apart from p join b1 b using (part)),
a1 as (select * from d1 qualify row_number() over (partition by vec_id, part order by apart, entry) = 1),
n1 as (select part, entry, cast((s0 - ((s0 % n) + n) % n) // n as bigint) as x0, cast((s1 - ((s1 % n) + n) % n) // n as bigint) as x1, cast((s2 - ((s2 % n) + n) % n) // n as bigint) as x2, cast((s3 - ((s3 % n) + n) % n) // n as bigint) as x3 from (select part, entry, count(*) as n, sum(x0) as s0, sum(x1) as s1, sum(x2) as s2, sum(x3) as s3 from a1 group by part, entry)),
b2 as (select part, entry, coalesce(n.x0, b.x0) as x0, coalesce(n.x1, b.x1) as x1, coalesce(n.x2, b.x2) as x2, coalesce(n.x3, b.x3) as x3 from b1 b left join n1 n using (part, entry)),
d2 as (
  select p.*, b.entry, (p.x0 - b.x0) ** 2 + (p.x1 - b.x1) ** 2 + (p.x2 - b.x2) ** 2 + (p.x3 - b.x3) ** 2 as apart from p join b2 b using (part)),
a2 as (select * from d2 qualify row_number() over (partition by vec_id, part order by apart, entry) = 1),
v as (
  select vec_id, label, string_agg(printf('%02x', entry), '' order by part) as code, cast(sum(apart) as bigint) as error from a2 group by vec_id, label)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  (select sha256(string_agg(concat_ws(',', x0, x1, x2, x3), ',' order by part, entry)) from b2) as codebooks_sha256
from v""",
}
