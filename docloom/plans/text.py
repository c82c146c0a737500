"""Text functions over whole tables and literal fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import ranking
from docloom.plans.registry import query
from docloom.session import table


@query(r"""
SELECT conv_id, turn, left(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), 500) AS normalized FROM conversations""")
def normalize_query(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalize_query(F.col("text")).alias("normalized"))


@query(r"""
SELECT doc_id, ('0x' || right(sha256(token), 6))::BIGINT AS idx, count(*) AS tf
FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM documents) GROUP BY ALL""")
def term_frequency(spark, sf_dir):
    return ranking.postings(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@query("""
SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END::BIGINT AS tokens FROM documents""")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query(r"""
SELECT page_id, coalesce(nullif(regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '[^A-Za-z0-9._-]', '_', 'g'), ''), 'file') AS name,
       regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages""")
def sanitize_filename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.sanitize_filename(F.col("url")).alias("name"), T.slugify(F.col("url")).alias("slug"))


@query("""
SELECT * FROM (VALUES ('iv', 4), ('MCMXCIV', 1994), ('iix', 8), ('x', 10), ('abc', NULL), ('', NULL), ('mmmm', NULL)) AS t(roman, number)""")
def roman_to_int(spark, sf_dir):
    rows = [(x,) for x in ("iv", "MCMXCIV", "iix", "x", "abc", "", "mmmm")]
    return spark.createDataFrame(rows, "roman string").withColumn("number", T.roman_to_int(F.col("roman")))
