"""Citation spans, re-verification, content hashes and unique names by hand."""

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from docloom.operators import answers, event_folds, retrieval

CITED = re.compile(r"(?s)(.+?)\[\s*((?:S\d+\s*,?\s*)+)\]")


def plain_spans(text):
    out, at = [], 0
    for m in CITED.finditer(text):
        out.append((m[0], m[1].strip(), re.findall(r"S\d+", m[2])))
        at = m.end()
    return [*out, (text[at:], text[at:].strip(), [])]


def test_spans_are_those_of_the_plain_pattern(spark):
    rng = random.Random(5)
    parts = ["[S1]", "[S2, S3]", "[ S4 S5 ]", "[", "]", "S6", "[S7", "a", " ", "\n", "[]", "[S8,,]", "[S9 , ]", ",", "é. "]
    texts = ["", "[S1]", "[S1][S2]", "[S1][S2][S3]", "a[S1][S2]b", "[[S1]", *("".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(400))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", answers.spans(F.col("t")).alias("s")).collect()
    assert {r.i: [(x.span, x.claim, x.ids) for x in r.s] for r in rows} == {i: plain_spans(t) for i, t in enumerate(texts)}


def test_spans_of_a_long_answer_take_linear_time(spark):
    began = time.time()
    long = ["a claim of no source. " * 50_000, "x [S1" * 200_000, "claim [S1, S2] " * 70_000, "[S1]" * 250_000, "y [S1" + " " * 1_000_000]
    sizes = [r.n for r in spark.createDataFrame([(t,) for t in long], "t string").select(F.size(answers.spans(F.col("t"))).alias("n")).collect()]
    assert sizes == [1, 1, 70_001, 125_001, 1] and time.time() - began < 60


def test_fused_rows_are_checked_against_the_live_tables(spark):
    found = spark.createDataFrame([(q, c, 1.0 / c, c) for q in (1, 2, 3, 4, 5) for c in range(1, 8)], "q long, chunk_id long, score double, rank long")
    chunks = spark.createDataFrame([(c, c) for c in range(1, 7)], "chunk_id long, version_id long")  # chunk 7 is gone
    versions = spark.createDataFrame([(1, 1, "ACTIVE"), (2, 1, "SUPERSEDED"), (3, 2, "ACTIVE"), (4, 3, "ACTIVE"), (5, 4, "ACTIVE"), (6, 9, "ACTIVE")], "version_id long, document_id long, status string")
    documents = spark.createDataFrame([(1, 10, "PUBLIC", 1), (2, 10, "RESTRICTED", 1), (3, 10, "PUBLIC", None), (4, 20, "PUBLIC", 1)], "document_id long, organization long, visibility string, space long")  # document 9 is gone
    asked = spark.createDataFrame([(1, 10, "VIEWER", None, None), (2, 10, "OWNER", None, None), (3, 10, "VIEWER", 1, None), (4, 10, "OWNER", None, 1), (5, 10, "STRANGER", None, None)], "q long, organization long, role string, document_id long, space long")
    got = {}
    for r in retrieval.reverified(found, chunks, versions, documents, asked, "q").orderBy("q", "place").collect():
        got.setdefault(r.q, []).append(r.chunk_id)
    assert got == {1: [1, 4], 2: [1, 3, 4], 3: [1, 2], 4: [1, 3]}
    assert retrieval.reverified(found, chunks, versions, documents, asked, "q", 1).count() == 4


def test_content_is_checked_against_its_recorded_hash(spark):
    h = hashlib.sha256(b"x").hexdigest()
    jobs = spark.createDataFrame([(1, h), (2, h), (3, h), (4, None)], "version_id long, file_hash string")
    contents = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (3, None), (4, "x")], "version_id long, content string")
    got = {r.version_id: (r.job_status, r.version_status, r.error) for r in retrieval.hash_checked(jobs, contents).collect()}
    assert got == {1: ("PROCESSING", "PROCESSING", None), 2: ("FAILED", "PROCESSING_FAILED", retrieval.MISMATCH), 3: ("FAILED", "PROCESSING_FAILED", retrieval.MISSING), 4: ("FAILED", "PROCESSING_FAILED", retrieval.MISMATCH)}


def test_names_are_unique_in_order(spark):
    held = spark.createDataFrame([("a",), ("a-2",)], "slug string")
    asked = spark.createDataFrame([(1, "a"), (2, "a-1"), (3, "a"), (4, "a-1"), (5, "b"), (6, "b"), (7, None), (8, "b-1"), (9, "7")], "id long, slug string")
    got = {r.id: r.name for r in event_folds.unique_slugs(held, asked).collect()}
    assert got == {1: "a-1", 2: "a-1-1", 3: "a-3", 4: "a-1-2", 5: "b", 6: "b-1", 8: "b-1-1", 9: "7"}
    assert event_folds.unique_slugs(held, spark.createDataFrame([(i, "c") for i in range(3000)], "id long, slug string")).select("name").distinct().count() == 3000
