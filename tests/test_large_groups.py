"""Groups that hold most rows: greedy admission, regions of one long document; and files of JSON lines with broken ones."""

import random

from pyspark.sql import functions as F

from docloom.operators import lifecycle, structure
from docloom.sources import files


def test_a_million_requests_of_one_tenant(spark):
    requests = spark.range(1_000_000).select((F.when(F.col("id") < 999_000, 1).otherwise(F.col("id"))).alias("g"), "id", (F.pmod(F.xxhash64("id"), F.lit(1000)) + 1).alias("amount"))
    found = lifecycle.admitted(requests, 20_000_000, ["g"], "id", "amount").where("g = 1")
    used, passed = 0, 0
    for r in requests.where("g = 1").orderBy("id").select("amount").toPandas().amount:
        if used + r <= 20_000_000:
            used, passed = used + r, passed + 1
    got = found.where("admitted").agg(F.sum("amount"), F.count("*")).first()
    assert tuple(got) == (used, passed) and found.count() == 999_000


def test_admission_of_nulls_and_ties_of_groups(spark):
    rows = spark.createDataFrame([("a", 1, 60), ("a", 2, None), ("a", 3, 50), ("a", 4, 40), (None, 1, 100), (None, 2, 1)], "g string, i long, amount long")
    assert [(r.g, r.i, r.admitted) for r in lifecycle.admitted(rows, 100, ["g"], "i", "amount").orderBy("g", "i").collect()] == [(None, 1, True), (None, 2, False), ("a", 1, True), ("a", 2, None), ("a", 3, False), ("a", 4, True)]
    assert lifecycle.admitted(rows.limit(0), 100, ["g"], "i", "amount").count() == 0


def test_a_document_of_two_hundred_thousand_lines(spark):
    nodes = spark.range(200_000).select(F.lit(1).cast("long").alias("doc"), F.col("id").alias("pos"))
    regions = spark.range(20_000).select(F.lit(1).cast("long").alias("doc"), F.col("id").alias("sequence"), (F.col("id") * 10 + 2).alias("start"), (F.col("id") * 10 + 6).alias("end"))
    found = structure.containing_region(nodes, regions, "doc", "pos")
    inside = F.pmod(F.col("pos"), F.lit(10)).between(2, 6)
    assert found.where(F.col("region") != F.when(inside, F.floor(F.col("pos") / 10)).otherwise(19_999)).count() == 0 and found.count() == 200_000


def test_regions_of_any_width(spark):
    rng = random.Random(2)
    regions = [(k, i, a, a + rng.choice([-3, 0, 1, 7, 100, 5000])) for k in (1, 2) for i in range(40) for a in [rng.randrange(-50, 3000)]]
    nodes = [(k, rng.randrange(-80, 4000)) for k in (1, 2, 3) for _ in range(150)] + [(1, None), (None, 5), (1, 7), (1, 7)]
    got = structure.containing_region(spark.createDataFrame(nodes, "k long, at long"), spark.createDataFrame(regions, "k long, sequence long, start long, end long"), "k", "at").collect()

    def plain(k, at):
        own = sorted((i, a, b) for kk, i, a, b in regions if kk == k)
        return next((i for i, a, b in own if at is not None and a <= at <= b), own[-1][0] if own else None)

    assert sorted(map(str, map(tuple, got))) == sorted(str((k, at, plain(k, at))) for k, at in nodes)


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"q": "one", "n": 1, "more": [1]}\n{"q": "two"}\nnot json\n{"q": "three", "n": "x"}\n\n{"n": 4}\n')
    good, bad = files.json_records(spark, str(tmp_path), "q string, n int")
    assert sorted(map(str, map(tuple, good.collect()))) == sorted(map(str, [("one", 1), ("two", None), (None, 4)]))
    assert sorted(r.line for r in bad.collect()) == ["not json", '{"q": "three", "n": "x"}'] and {r.file.rsplit("/", 1)[-1] for r in bad.collect()} == {"a.jsonl"}
