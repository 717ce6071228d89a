"""The registered queries of this subpackage: one for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fm, langid, media, minhash, mixing, packing, quality, resampling, secrets, tokens, toxicity, urls, variants
from .common import table


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_report(table(spark, sf_dir, "documents"))


def op2_ngram_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken"))


def op4_digest_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.ingested(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op5_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.pfair_mix(docs).drop("row")


def op7_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for each domain that captures name, by the digest of the domain: stands in for published lists."""
    host = pages.select(urls.host_of(F.col("url")).alias("host")).where("host IS NOT NULL").distinct()
    domains = urls.with_domains(host).select("domain").distinct()
    byte = lambda i: F.conv(F.substring(F.md5("domain"), i, 2), 16, 10).cast("int")
    b1, b2, b3 = byte(1), byte(3), byte(5)
    name = F.when(b3 % 5 == 0, "allow").when(b3 % 5 < 3, "malware").otherwise("adult")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    dated = F.array(
        F.struct(day(b1 % 180).alias("on_date"), F.lit("add").alias("action")),
        F.struct(day(b1 % 180 + 30 + b2 % 90).alias("on_date"), F.lit("remove").alias("action")),
        F.struct(day(F.lit(300) + b2 % 60).alias("on_date"), F.lit("add").alias("action")),
    )
    return domains.select("domain", name.alias("list"), F.explode(dated).alias("e")).select("list", "domain", "e.on_date", "e.action")


def op8_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int"))
    joined = urls.temporal_list_join(pages.select("page_id", "url", day.alias("fetched_on")), list_entries(pages))
    return joined.select("page_id", "host", "n_active", "matched_list", "matched_domain", "blocked")


OP8_SQL = r"""
WITH caps AS (
  SELECT row_number() OVER () AS n, page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INT) AS DATE) AS fetched_on,
         nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.+$', ''), '') AS host
  FROM pages
), domains AS (
  SELECT DISTINCT array_to_string(list_slice(l, i, len(l)), '.') AS domain
  FROM (SELECT DISTINCT string_split(host, '.') AS l FROM caps WHERE host IS NOT NULL), unnest(range(1, greatest(len(l) - 1, 1) + 1)) AS t(i)
), bytes AS (
  SELECT domain, CAST('0x' || substr(md5(domain), 1, 2) AS INT) AS b1, CAST('0x' || substr(md5(domain), 3, 2) AS INT) AS b2,
         CAST('0x' || substr(md5(domain), 5, 2) AS INT) AS b3 FROM domains
), named AS (
  SELECT *, CASE WHEN b3 % 5 = 0 THEN 'allow' WHEN b3 % 5 < 3 THEN 'malware' ELSE 'adult' END AS list FROM bytes
), entries AS (
  SELECT list, domain, DATE '2024-01-01' + b1 % 180 AS on_date, 0 AS gone FROM named
  UNION ALL SELECT list, domain, DATE '2024-01-01' + (b1 % 180 + 30 + b2 % 90), 1 FROM named
  UNION ALL SELECT list, domain, DATE '2024-01-01' + (300 + b2 % 60), 0 FROM named
), daily AS (
  SELECT list, domain, on_date, max(gone) AS gone FROM entries GROUP BY ALL
), spans AS (
  SELECT *, coalesce(lead(on_date) OVER (PARTITION BY list, domain ORDER BY on_date), DATE '9999-12-31') AS to_date FROM daily
), hits AS (
  SELECT c.n, s.list, s.domain FROM caps c JOIN spans s
    ON (c.host = s.domain OR ends_with(c.host, '.' || s.domain)) AND s.gone = 0 AND s.on_date <= c.fetched_on AND c.fetched_on < s.to_date
), best AS (
  SELECT n, count(*) AS n_active,
         arg_max(list, (length(domain), CASE WHEN list = 'allow' THEN 1 ELSE 0 END, list)) AS matched_list,
         arg_max(domain, (length(domain), CASE WHEN list = 'allow' THEN 1 ELSE 0 END, list)) AS matched_domain
  FROM hits GROUP BY ALL
)
SELECT c.page_id, c.host, coalesce(b.n_active, 0) AS n_active, b.matched_list, b.matched_domain,
       coalesce(b.matched_list <> 'allow', false) AS blocked
FROM caps c LEFT JOIN best b ON c.n = b.n
"""


def op9_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.secrets_report(docs, secrets.ingested(docs))


def op11_rank_order_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _spans_sql(k: int) -> str:
    """DuckDB: the spans of rule k as rows (doc_id, s, k, e)."""
    _, pattern, group, least = secrets.RULES[k]
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, text, {k} AS k, i,
         list_sum([length(x) for x in gaps[1:i]]) + coalesce(list_sum([length(x) for x in hits[1:i-1]]), 0) AS s, length(hits[i]) AS n, length(vals[i]) AS v, {least} AS least
  FROM (SELECT doc_id, text, regexp_extract_all(text, '{p}') AS hits, regexp_extract_all(text, '{p}', {group}) AS vals,
               regexp_split_to_array(text, '{p}') AS gaps FROM docs), unnest(range(1, len(hits) + 1)) AS t(i)"""


_NAMES = "[" + ", ".join(f"'{r[0]}'" for r in secrets.RULES) + "]"
OP10_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(_spans_sql(k) for k in range(len(secrets.RULES)))}),
spans AS (SELECT doc_id, k, s, {_NAMES}[k + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT) AS t FROM found WHERE v >= least),
per AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
               string_agg(t, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(t, ',' ORDER BY s, k) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN per USING (doc_id)
"""


QUERIES = {f.__name__: f for f in (op1_interleaved_media, op2_ngram_quality_rules, op3_hierarchical_packing, op4_digest_token_counts, op5_classifier_chain, op6_pfair_mix, op7_factorisation_machine, op8_temporal_url_filter, op9_circulant_minhash, op10_secret_ledger, op11_rank_order_profiles, op12_spelling_variants, op13_importance_resampling)}
ORACLE_SQL = {"op8_temporal_url_filter": OP8_SQL, "op10_secret_ledger": OP10_SQL}
