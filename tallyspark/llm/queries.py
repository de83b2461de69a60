"""Registered queries of the training-data operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import (decontamination, html_crf, jaccard_join, language_crf, line_dedup, mixing, periodic, pii, quality, revisits, sharding,
                            token_counts, whitening)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), n_shards=24)
    return d.select("doc_id", "size", F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"),
                    "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mixing.mix(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "size", "source_size", "target", "taken")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"), min_chars=20, min_docs=3)
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.fit_list(docs, table(spark, sf_dir, "labels"))
    d = quality.judge(docs, rules)
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pii.find_spans(table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("base", lambda x: x["k"] == i)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return d.select("doc_id", *counts, F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"),
                    pii.spans_text(F.concat("base", "added")).alias("spans"))


def op5_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = revisits.resolve_revisits(revisits.records_of(table(spark, sf_dir, "pages")))
    header = lambda k: F.element_at("headers", F.lit(k)).alias(k.replace("-", "_"))
    return d.select("record_id", "url_key", "ts", "response_id", "response_ts", "outcome", header("content-type"), header("content-length"),
                    header("server"), header("cache-control"), header("date"), "digest")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = html_crf.extract(table(spark, sf_dir, "pages"))
    return d.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    d = token_counts.count_with_edits(docs, token_counts.sample_edits(docs))
    return d.select("doc_id", "n_before", "n_tokens", "n_reencoded", F.size("sizes").cast("long").alias("n_leaves"),
                    F.length("text").cast("long").alias("n_chars"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


def op11_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    chain = language_crf.fit(docs.where(~held_out))
    d = language_crf.predict(docs.select("doc_id", "text"), chain)
    return d.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = periodic.detect(table(spark, sf_dir, "documents").select("doc_id", "text"), rewrite=periodic.repeat_tail).withColumn("best", periodic.longest(F.col("runs")))
    best = F.col("best")
    return d.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
                    F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), F.sha2(periodic.runs_text(F.col("runs")), 256).alias("runs_sha256"),
                    F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, model = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), n_components=16)
    explained = F.array(*[F.lit(float(e)) for e in (model.explained if model else [])]).cast("array<double>")
    d = d.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return d.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
                    F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error if model else 0.0).alias("identity_error"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_mixing": op2_mixing,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_pii": op4_pii,
    "op5_revisits": op5_revisits,
    "op6_line_dedup": op6_line_dedup,
    "op7_html_extraction": op7_html_extraction,
    "op8_quality_rules": op8_quality_rules,
    "op9_token_counts": op9_token_counts,
    "op10_decontamination": op10_decontamination,
    "op11_language_crf": op11_language_crf,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_whitening": op13_whitening,
}

MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')) AS symbols
  FROM documents),
k AS (
  SELECT *, -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
            / (1.0::DOUBLE / (1.0::DOUBLE + symbols::DOUBLE / greatest(size, 1)::DOUBLE)) AS key
  FROM d),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight, source_size * 3 AS cap FROM t),
f AS (
  SELECT *, (sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER ()
             - coalesce(sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM w),
o AS (
  SELECT *, first_value(CASE WHEN cap::DOUBLE >= weight::DOUBLE * level THEN level END IGNORE NULLS)
            OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS open_level
  FROM f),
p AS (SELECT source, source_size, least(cap::DOUBLE, weight::DOUBLE * open_level) AS target FROM o),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM p),
u AS (
  SELECT k.source, k.key, k.doc_id, sum(k.size)::BIGINT AS size
  FROM k GROUP BY k.source, k.key, k.doc_id),
r AS (
  SELECT u.source, u.key, u.doc_id, u.size,
         sum(u.size) OVER (PARTITION BY u.source ORDER BY u.key, coalesce(u.doc_id::VARCHAR, '') ROWS UNBOUNDED PRECEDING) AS upto
  FROM u)
SELECT k.doc_id, k.size, e.source_size, e.target,
       (k.size * (e.epochs + CASE WHEN r.upto - r.size + r.size / 2.0::DOUBLE <= e.target - (e.epochs * e.source_size)::DOUBLE
                                       AND e.target > (e.epochs * e.source_size)::DOUBLE THEN 1 ELSE 0 END))::BIGINT AS taken
FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
JOIN r ON r.source IS NOT DISTINCT FROM k.source AND r.key = k.key AND r.doc_id IS NOT DISTINCT FROM k.doc_id
"""

LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.keeper AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

REVISIT_SQL = r"""
WITH p AS (
  SELECT page_id AS i, md5(coalesce(html, '')) AS digest, length(html) AS n, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
         regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
         array_to_string(list_sort(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&')), '&') AS query
  FROM pages),
k AS (
  SELECT *, 'http://' || regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www[.]', '') || path
            || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url_key
  FROM p),
c AS (SELECT url_key, i * 10 AS c_ts, i * 2 AS c_id, tag AS c_tag, digest AS c_digest, n, i % 3 AS server FROM k),
v AS (
  SELECT url_key, i * 2 + 1 AS record_id, CASE WHEN i % 11 = 0 THEN i * 10 - 5 ELSE i * 10 + 3 END AS ts,
         CASE WHEN i % 7 = 0 THEN NULL WHEN i % 5 = 0 THEN '"none"' ELSE tag END AS tag, digest, (i * 10 + 3)::VARCHAR AS date
  FROM k),
j AS (
  SELECT v.*, c.* EXCLUDE (url_key),
         CASE WHEN c_id IS NULL THEN 'no_capture' WHEN tag IS NOT NULL THEN CASE WHEN tag = c_tag THEN 'resolved' ELSE 'changed' END
              WHEN digest = c_digest THEN 'resolved' ELSE 'changed' END AS outcome
  FROM v ASOF LEFT JOIN c ON v.url_key = c.url_key AND v.ts > c.c_ts)
SELECT record_id, url_key, ts, c_id AS response_id, c_ts AS response_ts, outcome,
       CASE WHEN outcome = 'resolved' THEN 'text/html' END AS content_type, CASE WHEN outcome = 'resolved' THEN n::VARCHAR END AS content_length,
       CASE WHEN outcome = 'resolved' THEN 's' || server END AS server, CASE WHEN outcome = 'resolved' THEN 'max-age=600' END AS cache_control,
       CASE WHEN outcome = 'resolved' THEN date END AS date, CASE WHEN outcome = 'resolved' THEN c_digest END AS digest
FROM j
"""

ORACLES = {
    "op5_revisits": REVISIT_SQL,
    "op2_mixing": MIX_SQL,
    "op6_line_dedup": LINES_SQL,
}
