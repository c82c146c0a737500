"""Versions, lookups, semi- and anti-joins, listings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.operators import ranking
from docloom.plans.registry import query
from docloom.session import table


@query("""
SELECT o_custkey, o_orderkey, o_orderdate FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def latest_version(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return ranking.latest_per(orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query("""
WITH l AS (SELECT o_custkey, o_orderkey, o_orderstatus FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1)
SELECT c_custkey, c_name, o_orderkey, coalesce(o_orderstatus, 'NONE') AS status FROM customer LEFT JOIN l ON c_custkey = o_custkey""")
def latest_job_left_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    last = orders.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey")).alias("x"))
    named = table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    return named.select("c_custkey", "c_name", F.col("x.o_orderkey").alias("o_orderkey"), F.coalesce("x.o_orderstatus", F.lit("NONE")).alias("status"))


@query("""
SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def anti_promoted(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


@query("""
SELECT doc_id, source, first_id FROM (
  SELECT doc_id, source, min(doc_id) OVER (PARTITION BY source, sha256(text)) AS first_id FROM documents WHERE text IS NOT NULL) WHERE doc_id <> first_id""")
def semi_duplicate_hash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "source", F.sha2("text", 256).alias("hash"))
    first = docs.groupBy("source", "hash").agg(F.min("doc_id").alias("first_id"))
    return docs.join(first, ["source", "hash"]).where("doc_id <> first_id").select("doc_id", "source", "first_id")


@query("""
WITH d AS (SELECT source, sha256(text) AS h, greatest(1, length(text) // 4) AS tokens,
                  row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents WHERE length(text) > 0)
SELECT source, count(*) FILTER (WHERE n > 1) AS hits, count(*) FILTER (WHERE n = 1) AS misses,
       coalesce(sum(tokens) FILTER (WHERE n = 1), 0)::BIGINT AS miss_tokens FROM d GROUP BY source""")
def cache_split(spark, sf_dir):
    """Embedding-cache hits and misses: the first document with a text misses, its copies hit."""
    from docloom.functions.text import estimate_tokens

    docs = table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", "source", F.sha2("text", 256).alias("h"), estimate_tokens(F.col("text")).alias("tokens"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first"))
    split = docs.join(first, "h").withColumn("miss", F.col("doc_id") == F.col("first"))
    return split.groupBy("source").agg(F.count_if(~F.col("miss")).alias("hits"), F.count_if("miss").alias("misses"), F.coalesce(F.sum(F.when(F.col("miss"), F.col("tokens"))), F.lit(0)).alias("miss_tokens"))


@query("""
SELECT doc_id, source, n_chars FROM documents ORDER BY source, doc_id LIMIT 50 OFFSET 100""")
def paged_listing(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").orderBy("source", "doc_id").offset(100).limit(50)


@query("""
SELECT doc_id, source FROM documents WHERE source = 'src1' AND CASE lang WHEN 'en' THEN 'PUBLIC' WHEN 'de' THEN 'INTERNAL' ELSE 'RESTRICTED' END IN ('PUBLIC', 'INTERNAL')
AND n_chars > 0""")
def visibility_scope(spark, sf_dir):
    visibility = F.when(F.col("lang") == "en", "PUBLIC").when(F.col("lang") == "de", "INTERNAL").otherwise("RESTRICTED")
    status = F.when(F.col("n_chars") > 0, "ACTIVE").otherwise("ARCHIVED")
    chunks = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("source").alias("organization"), visibility.alias("visibility"), status.alias("status"))
    return ranking.scoped(chunks, "src1", "EDITOR").select("doc_id", "source")


@query("""
SELECT event_id, user_id, ts, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rate FROM events""")
def effective_rate_asof(spark, sf_dir):
    """For each event the user's latest earlier rate."""
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rate = F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(before)
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", rate.alias("rate"))


@query("""
SELECT s_suppkey, s_name, n_name, r_name, count(l_orderkey) AS n_items FROM supplier JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL""")
def star_join(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n_items"))
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    named = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return named.join(items, "s_suppkey", "left").select("s_suppkey", "s_name", "n_name", "r_name", F.coalesce("n_items", F.lit(0)).alias("n_items"))


@query("""
SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 8""")
def recent_messages(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return ranking.top_k_per(rows, ["conv_id"], [F.desc("turn")], 8, "n").drop("n")
