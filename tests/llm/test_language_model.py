"""N-gram tries: the sequences, the model against plain dictionaries, normalisation and the contract's base score."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import language_model as L


@pytest.mark.parametrize("top", [5, 300, 10**6, 2**63])
def test_elias_fano(top):
    rng = np.random.default_rng(top % 97)
    values = np.sort(rng.integers(0, top, 500, dtype=np.uint64))
    ef = L.EliasFano.build(values)
    assert (ef.access(np.arange(500)) == values).all()
    asked = np.concatenate([values[::7], rng.integers(0, top, 200, dtype=np.uint64), [np.uint64(0), values[-1], values[-1] + np.uint64(5)]])
    low, high = rng.integers(0, 250, len(asked)), rng.integers(250, 501, len(asked))
    want = [next((i for i in range(a, b) if values[i] >= x), b) for a, b, x in zip(low, high, asked)]
    assert ef.successor(low, high, asked).tolist() == want


def plain(docs):
    """Scores of (doc_id, text, held_out) rows by dictionaries; every word is a history of its own."""
    split = [(i, (t or "").encode().lower().split(), bool(h)) for i, t, h in docs]
    train = [w for _, w, h in split if not h]

    def grams(words):
        return zip([*words, None], [None, *words], [None, None, *words])

    c1, c2, c3, t2, t3 = Counter(), Counter(), Counter(), Counter(), Counter()
    for words in train:
        for w, h, g in grams(words):
            c1[w] += 1
            c2[h, w] += 1
            t2[h] += 1
            c3[g, h, w] += 1
            t3[g, h] += 1
    n = sum(c1.values())

    def p(w, h, g):
        p1 = (1 - L.UNSEEN) * c1[w] / n if c1[w] else L.UNSEEN / n
        a = L.SHARE2 * t2[h] / (t2[h] + L.HALF)
        p2 = (1 - a) * p1 + (a * c2[h, w] / t2[h] if a else 0)
        b = L.SHARE3 * t3[g, h] / (t3[g, h] + L.HALF)
        return (1 - b) * p2 + (b * c3[g, h, w] / t3[g, h] if b else 0)

    out = {}
    for i, words, h in split:
        tokens = [*words, None]
        base = sum(math.log10((c1[w] + 0.1) / (n + 0.1 * (len(c1) + 1))) for w in tokens)
        out.setdefault(i, []).append((h, len(tokens), sum(c1[w] > 0 for w in tokens), n, base, sum(math.log10(p(*x)) for x in grams(words))))
    return out, p, c1


def same(rows, want):
    got: dict = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))
    assert got.keys() == want.keys()
    for key, values in want.items():
        for a, b in zip(sorted(got[key]), sorted(values), strict=True):
            assert a[:4] == b[:4]
            assert a[4] == pytest.approx(b[4], rel=1e-9)
            assert a[5] == pytest.approx(b[5], abs=2 * L._STEP * a[1] + 1e-9)


@pytest.mark.parametrize("head", [65_000, 40])
def test_scores_of_the_driver_documents(spark, head):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    rows = docs.select("doc_id", "text", out.alias("h")).collect()
    want, p, c1 = plain([tuple(r) for r in rows])
    found = L.score(docs, out, head).collect()
    same(found, want)
    if head == 40:
        for h, g in ((None, None), (b"the", b"of"), (b"the", b"never seen"), (b"never seen", None)):
            assert sum(p(w, h, g) for w in c1) <= 1


@pytest.mark.parametrize("hot", [0, 4])
def test_a_very_common_pair_is_counted_before_it_is_sent(spark, monkeypatch, hot):
    monkeypatch.setattr(L, "HOT", hot)
    rows = [(i, f"hot pair {'hot pair ' * (i % 50)}word{i % 7} hot pair", i % 10 == 0) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h boolean")
    same(L.score(docs, F.col("h")).collect(), plain(rows)[0])


def test_histories_help_on_held_out_texts(spark):
    from docloom.llm.queries import QUERIES

    held = QUERIES["op8_language_model"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_small_cases(spark, monkeypatch):
    monkeypatch.setattr(L, "FLUSH_DOCS", 2)
    rows = [(1, "A b\x0ba\tB", False), (1, "A b\x0ba\tB", False), (2, None, False), (None, "", True), (3, "new É words a b", True), (4, "x " * 3000, None)]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, h boolean, bucket string, types int")
    same(L.score(docs, F.col("h")).collect(), plain(rows)[0])


def test_no_training_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = L.score(docs, F.lit(True)).first()
    assert row.train_tokens == 0 and row.n_known == 0 and row.n_tokens == 3 and math.isfinite(row.score)
    assert L.score(docs.where("false"), F.lit(False)).count() == 0


def test_every_history_and_second_word_counts(spark):
    """Contexts far past the numbered words: each rare word has its own followers, which a pooled history can't tell."""
    rows = [(i, f"rare{i} odd{i} next{i} rare{i} odd{i} next{i}", False) for i in range(400)]
    rows += [(1000 + i, f"rare{i} odd{i} next{i}", True) for i in range(0, 400, 40)] + [(2000 + i, f"rare{i + 1} odd{i} next{i}", True) for i in range(0, 400, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h boolean")
    want, _, _ = plain(rows)
    for frequent in (L.FREQUENT, 10):
        L.FREQUENT, kept = frequent, L.FREQUENT
        try:
            found = L.score(docs, F.col("h")).collect()
        finally:
            L.FREQUENT = kept
        same(found, want)
    scores = {r.doc_id: r.score for r in found}
    assert all(scores[1000 + i] > scores[2000 + i] for i in range(0, 400, 40))
