"""Queries that run as structured streams over all that a table holds now."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docloom.operators import answers
from docloom.plans import answers as turns
from docloom.plans.registry import query
from docloom.session import ensure_checkpoint_dir, table
from docloom.streaming import folds
from docloom.streaming.frequencies import frequencies, run_available, tumbling_counts


@query("SELECT user_id, event_type, count(*) AS frequency, max(ts) AS last_asked FROM events GROUP BY ALL")
def frequency_stream(spark, sf_dir):
    source = f"{sf_dir}/events.parque[t]"  # as a pattern it may name a file or a folder
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(source)
    place = f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4()}"
    return run_available(spark, frequencies(events, ["user_id", "event_type"]), f"{place}/out", f"{place}/state")


def _stream(spark, sf_dir, name):
    """A table as a stream of its files, and a folder for what comes of it."""
    rows = spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")
    return rows, f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4()}"


@query("""
SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n FROM events GROUP BY ALL""")
def tumbling_stream(spark, sf_dir):
    """Counts by user and day, late events up to forty days."""
    events, place = _stream(spark, sf_dir, "events")
    counted = tumbling_counts(events.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "1 day", "40 days")
    found = folds.run_updates(spark, counted, f"{place}/out", f"{place}/state", ["user_id", "window_start"])
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""
WITH m AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
SELECT conv_id, count(*) FILTER (WHERE back > 8) AS folded, coalesce(sum(n) FILTER (WHERE back > 8), 0)::BIGINT AS chars, coalesce(max(turn) FILTER (WHERE back > 8), -1) AS "cursor" FROM m GROUP BY conv_id""")
def summary_stream(spark, sf_dir):
    """What of each conversation has left the recent window, folded by a stateful stream."""
    rows, place = _stream(spark, sf_dir, "conversations")
    return folds.run_updates(spark, folds.summary_fold(rows.select("conv_id", "turn", "text")), f"{place}/out", f"{place}/state", ["conv_id"])


@query(f"""
WITH {turns._CHECKED}, r AS (SELECT s.conv_id, s.turn, string_agg(CASE WHEN k.status = 'UNSUPPORTED' THEN '{answers.REMOVED}' ELSE s.span END, '' ORDER BY s.i) AS safe FROM s LEFT JOIN checked k USING (conv_id, turn, i) GROUP BY s.conv_id, s.turn),
sp AS (SELECT conv_id, turn, string_split(safe, ' ') AS words FROM r) SELECT conv_id, turn, i - 1 AS "at", words[i] AS word FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM sp)""")
def answer_stream(spark, sf_dir):
    """Answers shown word by word, but only after their claims were checked."""
    rows, place = _stream(spark, sf_dir, "conversations")
    evidence = turns._evidence(spark, sf_dir)

    def check(batch):
        said = turns.cited(batch)
        return answers.redacted(said, answers.verified(answers.claims(said, turns.KEYS), evidence, turns.KEYS), turns.KEYS)

    folds.checked_stream(rows, check, f"{place}/out", f"{place}/state")
    return spark.read.parquet(f"{place}/out").select("conv_id", "turn", F.col("at").cast("long"), "word")
