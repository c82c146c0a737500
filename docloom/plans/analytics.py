"""Usage, quality and cost analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import quantiles
from docloom.plans.registry import query
from docloom.session import table

TOP = 20


@query("""
SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS answered,
       count(*) FILTER (WHERE event_type = 'error') AS insufficient, round(avg(value), 6) AS avg_latency,
       round(quantile_cont(value, 0.95), 6) AS p95_latency, round(avg(value * 0.000001), 9) AS avg_cost,
       round(count(*) FILTER (WHERE event_type <> 'error') / count(*)::DOUBLE, 6) AS answered_rate,
       round(count(*) FILTER (WHERE event_type = 'purchase') / count(*)::DOUBLE, 6) AS citation_coverage,
       round(count(*) FILTER (WHERE event_type = 'click') / count(*)::DOUBLE, 6) AS cache_hit_rate
FROM events GROUP BY user_id""")
def overview(spark, sf_dir):
    """Usage by tenant; kinds of events stand in for citations and cache hits, a share of the latency for the cost."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    failed = F.col("event_type") == "error"

    def rate(of):
        return F.round(F.coalesce(F.try_divide(F.count_if(of), F.count("*")), F.lit(0.0)), 6)

    whole = events.groupBy("user_id").agg(
        F.count("*").alias("total"),
        F.count_if(~failed).alias("answered"),
        F.count_if(failed).alias("insufficient"),
        F.round(F.avg("value"), 6).alias("avg_latency"),
        F.round(F.avg(F.col("value") * 0.000001), 9).alias("avg_cost"),
        rate(~failed).alias("answered_rate"),
        rate(F.col("event_type") == "purchase").alias("citation_coverage"),
        rate(F.col("event_type") == "click").alias("cache_hit_rate"),
    )
    counts = events.where("value is not null").groupBy("user_id", "value").agg(F.count("*").alias("c"))
    sizes = counts.groupBy("user_id").agg(F.sum("c").alias("n"))
    at = (F.col("n") - 1) * 0.95
    held = _between(counts, sizes.select("user_id", (F.floor(at) + 1).alias("place"), (at - F.floor(at)).alias("part"), F.least(F.floor(at) + 2, F.col("n")).alias("following")), "user_id")
    return whole.join(held.select("user_id", F.round("between", 6).alias("p95_latency")), "user_id", "left")


def _between(counts, wanted, key):
    """(key, between): the value ``part`` of the way from the value at ``place`` to that at ``following``."""
    places = wanted.select(key, F.explode(F.array_distinct(F.array("place", "following"))).alias("place"))
    found = quantiles.values_at(counts, places, key)
    low, high = found.select(key, "place", F.col("value").alias("low")), found.select(key, F.col("place").alias("following"), F.col("value").alias("high"))
    return wanted.join(low, [key, "place"]).join(high, [key, "following"]).select(key, (F.col("low") + F.col("part") * (F.col("high") - F.col("low"))).alias("between"))


@query(r"""
WITH asked AS (SELECT conv_id, turn, text, left(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), 500) AS normalized
               FROM conversations WHERE role = 'user' AND text IS NOT NULL)
SELECT normalized, count(*) AS frequency, max(conv_id) AS last_asked,
       arg_min(text, conv_id * 100000 + turn) AS sample
FROM asked GROUP BY normalized ORDER BY frequency DESC, normalized LIMIT 20""")
def top_questions(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").where("role = 'user' and text is not null").withColumn("normalized", T.normalize_query(F.col("text")))
    return (
        asked.groupBy("normalized")
        .agg(F.count("*").alias("frequency"), F.max("conv_id").alias("last_asked"), F.min_by("text", F.col("conv_id") * 100000 + F.col("turn")).alias("sample"))
        .orderBy(F.desc("frequency"), "normalized")
        .limit(TOP)
    )


@query("""
SELECT (props->>'$.k')::BIGINT AS k, count(*) AS frequency, max(ts) AS last_asked FROM events WHERE event_type = 'error'
GROUP BY 1 ORDER BY frequency DESC, k LIMIT 20""")
def knowledge_gaps(spark, sf_dir):
    failed = table(spark, sf_dir, "events").where("event_type = 'error'")
    found = failed.groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("frequency"), F.max("ts").alias("last_asked"))
    return found.orderBy(F.desc("frequency"), "k").limit(TOP)


@query("""
SELECT p_partkey, p_name, count(*) AS citations FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY ALL ORDER BY citations DESC, p_partkey LIMIT 20""")
def top_documents(spark, sf_dir):
    cited = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("citations"))
    return cited.join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey").orderBy(F.desc("citations"), "p_partkey").limit(TOP).select("p_partkey", "p_name", "citations")


@query("""
SELECT source, coalesce(lang, '(none)') AS lang, count(*) AS n_documents, sum(len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0)))::BIGINT AS n_chunks FROM documents GROUP BY ALL""")
def kb_status(spark, sf_dir):
    """Documents and chunks by tenant and language, whatever languages there are."""
    chunks = F.size(F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0))
    return table(spark, sf_dir, "documents").groupBy("source", F.coalesce("lang", F.lit("(none)")).alias("lang")).agg(F.count("*").alias("n_documents"), F.sum(chunks).alias("n_chunks"))


@query("""
SELECT source, count(*) FILTER (WHERE quality = 1) AS thumbs_up, count(*) FILTER (WHERE quality = 0) AS thumbs_down
FROM labels JOIN documents USING (doc_id) GROUP BY source""")
def feedback_pivot(spark, sf_dir):
    rated = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return rated.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("thumbs_up"), F.count_if(F.col("quality") == 0).alias("thumbs_down"))


@query("""
SELECT o_custkey, round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 0), 2) AS reserved,
       round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 0), 2) AS spent
FROM orders GROUP BY o_custkey""")
def budget_rollup(spark, sf_dir):
    def total(status):
        return F.round(F.coalesce(F.sum(F.when(F.col("o_orderstatus") == status, F.col("o_totalprice"))), F.lit(0.0)), 2)

    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(total("O").alias("reserved"), total("F").alias("spent"))


@query("""
WITH n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS i,
                  count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
     p AS (SELECT event_type, n, (n + 1) * 0.95 AS place, max(value) AS top,
                  max(value) FILTER (WHERE i = floor((n + 1) * 0.95)) AS low, max(value) FILTER (WHERE i = floor((n + 1) * 0.95) + 1) AS high
           FROM n GROUP BY event_type, n)
SELECT event_type, n, round(CASE WHEN n >= 20 THEN low + (place - floor(place)) * (coalesce(high, low) - low) ELSE top END, 6) AS p95 FROM p""")
def latency_p95_exclusive(spark, sf_dir):
    """The exclusive quantile from 20 values on, else the largest; ranges of values are narrowed in rounds, so no group is sorted whole."""
    counts = table(spark, sf_dir, "events").where("value is not null").groupBy("event_type", "value").agg(F.count("*").alias("c"))
    sizes = counts.groupBy("event_type").agg(F.sum("c").alias("n"))
    at = F.when(F.col("n") >= 20, (F.col("n") + 1) * 0.95).otherwise(F.col("n"))
    wanted = sizes.select("event_type", F.floor(at).alias("place"), (at - F.floor(at)).alias("part"), F.least(F.floor(at) + 1, F.col("n")).alias("following"))
    return _between(counts, wanted, "event_type").join(sizes, "event_type").select("event_type", "n", F.round("between", 6).alias("p95"))


@query("""
SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n, count(*) > 2 AS over_limit FROM events GROUP BY ALL""")
def rate_limit_tumbling(spark, sf_dir):
    found = table(spark, sf_dir, "events").groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", (F.col("n") > 2).alias("over_limit"))


@query("""
SELECT event_id, user_id FROM events WHERE event_type = 'error'
AND ts < (SELECT max(ts) FROM events) - INTERVAL 1800 SECOND""")
def stale_sweep(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    now = events.agg(F.max("ts").alias("now"))
    return events.where("event_type = 'error'").join(F.broadcast(now)).where("ts < now - interval 1800 seconds").select("event_id", "user_id")
