"""The registered queries of this package, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, jaccard_join, language, licenses, mixing, packing, quality, resampling, secrets, substring_dedup, suffix_dedup, urls
from .common import table

#: The rules of the URL contract.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(sf_dir, "documents", spark), table(sf_dir, "labels", spark))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(sf_dir, "documents", spark))
    listed = F.transform("spans", lambda s: F.format_string("%s:%d:%d", s["license"], s["start"], s["end"]))
    return found.select("doc_id", "license", F.round("coverage", 6).alias("coverage"), "n_spans", F.array_join(listed, ",").alias("spans"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(table(sf_dir, "documents", spark)).select("doc_id", "class_id", "n_links")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(sf_dir, "documents", spark)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rules, and after them the list that is learned from labelled documents and contents of pages."""
    rules = spark.createDataFrame([(0, *x) for x in URL_RULES], "layer int, key string, verdict string")
    markers = urls.marker_words(table(sf_dir, "documents", spark), table(sf_dir, "labels", spark))
    return rules.unionByName(urls.listed_pages(table(sf_dir, "pages", spark), markers).withColumn("layer", F.lit(1)))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(table(sf_dir, "pages", spark), url_rules(spark, sf_dir))
    return judged.select("page_id", "host", "path", F.when(F.col("layer") == 0, F.col("fit")).alias("rule"), "verdict")


def _held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def identifier(spark: SparkSession, sf_dir: str):
    """The identifier that queries and the pipeline share: it learns from what is not held out."""
    docs = table(sf_dir, "documents", spark)
    return language.train(docs.where(~F.coalesce(_held_out(), F.lit(True))))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(table(sf_dir, "documents", spark), identifier(spark, sf_dir))
    return found.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_overlap(table(sf_dir, "documents", spark), table(sf_dir, "benchmark", spark))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(sf_dir, "documents", spark)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_seen(table(sf_dir, "documents", spark)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(sf_dir, "documents", spark)).select("doc_id", "size", "source_size", "target", "taken")


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage of conversations, by the CRC-32 of conversation and turn; nulls become one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    changed = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_")).drop("_")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(sf_dir, "conversations", spark)
    found = conversations.audits(conversations.repair(damaged(rows))).withColumnRenamed("conv_id", "own")
    ids = rows.select("conv_id").distinct()
    numbers = [F.coalesce(F.col(n), F.lit(0).cast("long")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("own")), "left").select("conv_id", *numbers, F.coalesce(F.col("audit"), F.lit("")).alias("audit"), F.coalesce(F.col("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(sf_dir, "documents", spark), table(sf_dir, "benchmark", spark)).select("doc_id", "n_features", "weight", "score", "rank")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(table(sf_dir, "documents", spark), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_rules, op2_license_scan, op3_ngram_jaccard_join, op4_suffix_dedup, op5_url_filter, op6_language_id, op7_decontamination, op8_secret_scan, op9_substring_dedup, op10_source_mix, op11_conversation_repair, op12_importance_resampling, op13_packing)}


_URL_SQL = r"""
WITH drawn AS (
  SELECT doc_id, toxic FROM labels
  WHERE CAST('0x' || substr(sha256('url:' || doc_id), 1, 8) AS UBIGINT) < (8000 * 4294967296) // (SELECT greatest(1, count(*)) FROM labels)),
held AS (
  SELECT toxic = 1 AS marked, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM documents JOIN drawn USING (doc_id)),
markers AS (
  SELECT list(word) AS m FROM (SELECT word FROM (SELECT marked, unnest(w) AS word FROM held) GROUP BY word
    HAVING count(*) FILTER (WHERE marked) >= 8 AND count(*) FILTER (WHERE marked) >= 0.9 * count(*))),
parts AS (
  SELECT page_id,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path,
    html
  FROM pages),
full_parts AS (SELECT page_id, coalesce(host, '') AS host, CASE WHEN starts_with(coalesce(path, ''), '/') THEN path ELSE '' END AS path, html FROM parts),
listed AS (
  SELECT DISTINCT host, path FROM full_parts, markers
  WHERE host <> '' AND list_has_any(regexp_extract_all(translate(html, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), m)),
crowded AS (
  SELECT f.host FROM full_parts f LEFT JOIN listed l ON f.host = l.host AND f.path = l.path
  WHERE f.host <> '' GROUP BY f.host HAVING count(*) >= 20 AND count(l.host) >= 0.5 * count(*)),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM full_parts)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN EXISTS (SELECT 1 FROM listed l WHERE l.host = ruled.host AND l.path = ruled.path) THEN 'block'
  WHEN EXISTS (SELECT 1 FROM crowded c WHERE c.host = ruled.host OR ruled.host LIKE '%.' || c.host) THEN 'block'
  ELSE 'allow' END AS verdict
FROM ruled
"""

_OVERLAP_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
starts AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes)),
hits AS (SELECT s.doc_id, s.n, s.i, w.item_id FROM starts s JOIN windows w ON s.n = w.n AND s.win = w.win),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hits)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_SEEN_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs)),
firsts AS (SELECT win, min(doc_id) AS first FROM windows GROUP BY win),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (win) WHERE doc_id > first)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id) LEFT JOIN counts c USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": _URL_SQL, "op7_decontamination": _OVERLAP_SQL, "op9_substring_dedup": _SEEN_SQL}
