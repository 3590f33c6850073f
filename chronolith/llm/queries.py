"""The queries of the ten operators, each over its whole table, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprint, license, minhash, mixing, packing, pii, topk, toxicity, urlfilter

DAY = 86400
BASE = 1704067200  # 2024-01-01


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def captures(pages: DataFrame) -> DataFrame:
    """The pages with a fetch time: the table has none, so each page_id stands for a moment of two years."""
    return pages.select("page_id", "url", F.timestamp_seconds(F.expr(f"{BASE} + (page_id % 720) * {DAY} + page_id % {DAY}")).alias("fetched_at"))


def block_list(pages: DataFrame) -> DataFrame:
    """A dated list over all hosts of the pages: blocked, half of them cleared after 90 days, one path allowed."""
    host = urlfilter.host_of(F.col("url"))
    h = pages.select(host.alias("host")).filter("host <> ''").distinct()
    h = h.withColumn("day", F.expr("CAST(conv(substr(md5(host), 1, 3), 16, 10) AS BIGINT) % 720")).withColumn("odd", F.expr("conv(substr(md5(host), 4, 1), 16, 10) % 2"))
    rows = F.expr("""array(
        struct(host AS pattern, 'block' AS action, day AS day),
        struct(IF(odd = 1, host, NULL) AS pattern, 'clear' AS action, day + 90 AS day),
        struct(concat(host, '/en') AS pattern, 'allow' AS action, day + 30 AS day),
        struct(regexp_extract(host, '([^.]+[.][^.]+)$', 1) AS pattern, 'block' AS action, 400L AS day),
        struct(regexp_extract(host, '([^.]+[.][^.]+)$', 1) AS pattern, 'clear' AS action, 460L AS day))""")
    e = h.select(F.explode(rows).alias("e")).select("e.pattern", "e.action", F.timestamp_seconds(F.expr(f"{BASE} + e.day * {DAY}")).alias("listed_at"))
    return e.filter("pattern IS NOT NULL").distinct()


def _url_filter(spark: SparkSession, d: str) -> DataFrame:
    pages = _table(spark, d, "pages")
    out = urlfilter.url_filter(captures(pages), block_list(pages))
    return out.withColumn("fetched_at", F.unix_timestamp("fetched_at"))


URL_SQL = rf"""
WITH c AS (
  SELECT DISTINCT page_id, url, {BASE} + (page_id % 720) * {DAY} + page_id % {DAY} AS fetched_at,
         rtrim(regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@?#]*@)?(\[[^]/?#]*\]|[^/:?#]+)', 1), '.') AS host,
         regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), h AS (
  SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 3) AS BIGINT) % 720 AS day,
         CAST('0x' || substr(md5(host), 4, 1) AS BIGINT) % 2 AS odd
  FROM c WHERE host <> ''
), e0 AS (
  SELECT host AS pattern, 'block' AS action, day FROM h
  UNION SELECT host, 'clear', day + 90 FROM h WHERE odd = 1
  UNION SELECT host || '/en', 'allow', day + 30 FROM h
  UNION SELECT regexp_extract(host, '([^.]+[.][^.]+)$', 1), 'block', 400 FROM h
  UNION SELECT regexp_extract(host, '([^.]+[.][^.]+)$', 1), 'clear', 460 FROM h
), e AS (
  SELECT pattern, max(action) AS action, {BASE} + day * {DAY} AS f FROM e0 GROUP BY pattern, day
), iv AS (
  SELECT *, lead(f) OVER (PARTITION BY pattern ORDER BY f) AS t FROM e
), hit AS (
  SELECT c.page_id, c.url, c.fetched_at, iv.pattern, iv.action
  FROM c JOIN iv ON iv.action <> 'clear' AND iv.f <= c.fetched_at AND (iv.t IS NULL OR c.fetched_at < iv.t)
   AND (c.host = iv.pattern OR (ends_with(c.host, '.' || iv.pattern) AND NOT regexp_full_match(c.host, '[0-9.]*'))
        OR (contains(iv.pattern, '/') AND starts_with(c.host || rtrim(regexp_replace(c.path, '/+', '/', 'g'), '/') || '/', iv.pattern || '/')))
), best AS (
  SELECT *, row_number() OVER (PARTITION BY page_id, url, fetched_at ORDER BY length(pattern) DESC, pattern DESC) AS n FROM hit
)
SELECT c.page_id, c.url, CAST(c.fetched_at AS BIGINT) AS fetched_at, coalesce(b.action, 'none') AS verdict, b.pattern
FROM c LEFT JOIN best b ON b.n = 1 AND b.page_id = c.page_id AND b.url = c.url AND b.fetched_at = c.fetched_at"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def docs(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, d: f(_table(spark, d, "documents"))

    return {
        "op1_chat_format": lambda spark, d: chat.format_chats(_table(spark, d, "conversations")),
        "op2_mix_sources": docs(mixing.mix),
        "op3_exact_topk": lambda spark, d: topk.topk(_table(spark, d, "embeddings"), queries=F.col("vec_id") % topk.EVERY == 0),
        "op4_pack": docs(packing.pack),
        "op5_near_duplicates": docs(minhash.near_duplicates),
        "op6_url_filter": _url_filter,
        "op7_fingerprints": docs(fingerprint.fingerprints),
        "op8_pii": docs(pii.pii),
        "op9_licenses": docs(license.licenses),
        "op10_toxicity": lambda spark, d: toxicity.toxicity(_table(spark, d, "documents"), _table(spark, d, "labels")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": chat.SQL,
        "op2_mix_sources": mixing.SQL,
        "op3_exact_topk": topk.SQL,
        "op4_pack": packing.SQL,
        "op6_url_filter": URL_SQL,
    }
