"""The parts of three operators' results that SQL can state, as queries with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.llm import op01_sharding, op05_rules, op10_secrets


def sharding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts: rows, bytes, and the number of shards that they are in, which is one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    placed = op01_sharding.minimax_shards(docs, 8).select("doc_id", "size", "shard")
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5")
    return docs.select("doc_id", text).join(placed, "doc_id").groupBy("text_md5").agg(F.count("*").alias("n_rows"), F.sum("size").alias("bytes"), F.countDistinct("shard").alias("n_shards"))


def rules_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of the quality rules and whether a document fails them."""
    out, _ = op05_rules.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", *op05_rules.BASE, "base_failed")


def secrets_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the fixed patterns by kind."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return op10_secrets.span_digest(op10_secrets.find_secrets(docs)).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES = {f.__name__: f for f in (sharding_groups, rules_base_counts, secrets_base_counts)}
ORACLE_SQL = {
    "sharding_groups": "SELECT md5(coalesce(text, '')) AS text_md5, count(*) AS n_rows, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes, CAST(1 AS BIGINT) AS n_shards FROM documents GROUP BY coalesce(text, '')",
    "rules_base_counts": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8), g AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS k FROM s),
r AS (SELECT doc_id, k FROM g GROUP BY doc_id, k HAVING count(*) > 1), p AS (SELECT DISTINCT g.doc_id, unnest(range(i, i + 8)) AS p FROM g JOIN r ON r.doc_id = g.doc_id AND r.k = g.k),
u AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id), l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
c AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(u.n, 0) AS BIGINT) AS n_repeat_words
FROM d JOIN l ON l.doc_id = d.doc_id LEFT JOIN u ON u.doc_id = d.doc_id) SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c""",
    "secrets_base_counts": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id,
CAST(len(list_filter(regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 12)) AS BIGINT) AS n_assign,
CAST(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS BIGINT) AS n_access, CAST(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 16)) AS BIGINT) AS n_hex FROM d""",
}
