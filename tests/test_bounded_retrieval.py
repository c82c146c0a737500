"""Sparse retrieval by bounds of blocks against the plain sum over all pairs; cached answers cut where a key rests."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import lifecycle, ranking


def drawn(rng, n, first):
    """A text of ``n`` words of one of three vocabularies, the first words by far the most frequent."""
    return " ".join(f"{first}{min(int(rng.paretovariate(0.9)), 300)}" for _ in range(n))


@pytest.mark.parametrize(("first", "leads"), [(1, 2), (4, 32)])
def test_bounds_lose_no_document(spark, monkeypatch, first, leads):
    monkeypatch.setattr(ranking, "FIRST", first)
    monkeypatch.setattr(ranking, "LEADS", leads)
    rng = random.Random(first)
    texts = [drawn(rng, int(rng.paretovariate(0.8)) % 900 + 1, rng.choice("abc")) for _ in range(400)]
    docs = spark.createDataFrame([*enumerate(texts), (400, None), (401, ""), *((402 + i, texts[7]) for i in range(40))], "doc_id long, text string")
    queries = spark.createDataFrame([(i, drawn(rng, rng.randrange(1, 30), rng.choice("abc"))) for i in range(40)] + [(40, texts[7]), (41, "a299 b299"), (42, "nowhere"), (43, None)], "item_id long, text string")
    plain = ranking.top_k_per(ranking.matches(queries, docs, "item_id", "doc_id").drop("terms"), ["item_id"], [F.desc("score"), F.col("doc_id")], 10)
    found = ranking.sparse_top(queries, docs, "item_id", "doc_id", 10)
    assert sorted(map(tuple, found.select("item_id", "doc_id", "score", "rank").collect())) == sorted(map(tuple, plain.select("item_id", "doc_id", "score", "rank").collect()))
    assert ranking.sparse_top(queries, docs.where("false"), "item_id", "doc_id", 10).count() == 0


def test_bounds_hold_for_every_document(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, drawn(rng, rng.randrange(1, 300), rng.choice("abc"))) for i in range(300)], "doc_id long, text string")
    queries = docs.where("doc_id < 20").select(F.col("doc_id").alias("item_id"), "text")
    index, weighed = ranking.weighed_index(queries, docs, "item_id", "doc_id")
    index = ranking.blocked(index, "doc_id")
    bounds = ranking.block_bounds(index, weighed, "item_id")
    scores = ranking.matches(queries, docs, "item_id", "doc_id").join(index.select("doc_id", "block").distinct(), "doc_id")
    assert scores.join(bounds, ["item_id", "block"], "left").where("bound is null or score > bound + 1e-6").isEmpty()


def test_cached_answers_of_one_key_with_rests(spark):
    rng = random.Random(2)
    times, at = [], 0
    for _ in range(3_000):
        at += rng.choice((0, 1, 40, 599, 600, 601, 5_000))
        times.append(at)
    rows = spark.range(3_000).select(F.lit("k").alias("k"), F.col("id"), F.timestamp_seconds(F.element_at(F.array(*map(F.lit, times)), (F.col("id") + 1).cast("int"))).alias("at"))
    rows = rows.unionByName(spark.createDataFrame([(None, 1), ("k", 9_999)], "k string, id long").withColumn("at", F.lit(None).cast("timestamp")))
    stored, hits = None, []
    for t in times:
        hits.append(stored is not None and t < stored + 600)
        stored = stored if hits[-1] else t
    found = lifecycle.cache_served(rows, "k", "at", "id", 600)
    assert [r.hit for r in found.where("at is not null").orderBy("id").collect()] == hits and [r.hit for r in found.where("at is null").collect()] == [False, False]
