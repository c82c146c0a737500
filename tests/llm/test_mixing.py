"""Mixing: rates against a plain solver, totals against targets, and the named cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import mixing


def plain_rates(cells, targets, rounds=3000):
    p = np.array([c[:3] for c in cells])
    tokens = np.array([c[3] for c in cells], dtype=float)
    start = (p * tokens[:, None]).sum(0)
    aims = start[0] / targets["clean"] * np.array([targets[d] for d in mixing.DOMAINS])
    rate = np.ones(len(cells))
    for _ in range(rounds):
        off = ((p * (rate * tokens)[:, None]).sum(0) - aims) / np.where(start > 0, start, np.inf)
        rate = np.maximum(0.0, rate - p @ off)
    return rate, (p * (rate * tokens)[:, None]).sum(0), aims


def test_rates_reach_the_targets(spark):
    cells = [(1.0, 0.0, 0.0, 5000), (0.9, 0.1, 0.0, 700), (0.1, 0.9, 0.0, 900), (0.05, 0.0, 0.95, 1200), (0.5, 0.25, 0.25, 40)]
    rows = [(*c[:3], c[3] // 2) for c in cells for _ in range(2)]
    scored = spark.createDataFrame(rows, "p_clean double, p_low double, p_toxic double, n_tokens long")
    got = {(r.p_low, r.p_toxic): r.rate for r in mixing.rates(scored).collect()}
    want, totals, aims = plain_rates(cells, mixing.TARGETS)
    assert np.allclose(totals, aims, rtol=1e-3)
    reached = sum(np.array(c[:3]) * c[3] * got[c[1], c[2]] for c in cells)
    assert np.allclose(reached, aims, rtol=0.01)
    assert np.allclose([got[c[1], c[2]] for c in cells], want, atol=0.08)


def test_targets_out_of_reach_stay_non_negative(spark):
    scored = spark.createDataFrame([(0.0, 0.0, 1.0, 50), (1.0, 0.0, 0.0, 100)], "p_clean double, p_low double, p_toxic double, n_tokens long")
    got = {r.p_toxic: r.rate for r in mixing.rates(scored, {"clean": 1.0, "low": 0.0, "toxic": 0.0}).collect()}
    assert got[1.0] == pytest.approx(0, abs=0.01) and got[0.0] == pytest.approx(1, abs=0.01)


def test_the_query_on_the_driver_tables(spark):
    from docloom.llm.queries import QUERIES

    rows = QUERIES["op5_mixing"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000
    sums = {d: sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in rows) for d in mixing.DOMAINS}
    whole = sum(r.n_tokens * r.p_clean for r in rows) / mixing.TARGETS["clean"]
    for d in mixing.DOMAINS:
        assert sums[d] == pytest.approx(whole * mixing.TARGETS[d], rel=0.02, abs=0.002 * whole)
    labels = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    known = [r for r in rows if r.doc_id in labels]
    right = sum((r.p_clean >= 0.5) == (labels[r.doc_id].quality == 1 and labels[r.doc_id].toxic == 0) for r in known)
    assert right >= 0.85 * len(known)


def test_small_cases(spark):
    docs = spark.createDataFrame([(1, "a b", 0.5), (1, "a b", 0.5), (2, None, 1.0), (None, "", 1.0)], "doc_id long, text string, rate double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = mixing.mix(docs, none).collect()
    assert [(r.copies, r.p_clean) for r in got] == [(1, 1.0)] * 4 and sorted(r.n_tokens for r in got) == [1, 1, 3, 3]
    assert mixing.take(docs, none).columns == docs.columns and mixing.take(docs, none).count() == 4
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 1), (1, 0, None)], "doc_id long, quality int, toxic int")
    assert mixing.mix(docs, labels).where(F.col("rate").isNull()).count() == 0
    empty = spark.createDataFrame([], docs.schema)
    assert mixing.mix(empty, labels).count() == 0 and mixing.take(empty, none).count() == 0


def test_scarce_domains_are_raised_to_their_targets(spark):
    cells = [(1.0, 0.0, 0.0, 9000), (0.9, 0.1, 0.0, 300), (0.2, 0.8, 0.0, 60), (0.1, 0.0, 0.9, 20)]
    scored = spark.createDataFrame(cells, "p_clean double, p_low double, p_toxic double, n_tokens long")
    got = {(r.p_low, r.p_toxic): r.rate for r in mixing.rates(scored).collect()}
    reached = sum(np.array(c[:3]) * c[3] * got[c[1], c[2]] for c in cells)
    assert np.allclose(reached / reached.sum(), [mixing.TARGETS[d] for d in mixing.DOMAINS], rtol=0.02)
    assert got[0.0, 0.9] > 2


def test_small_posteriors_are_right_on_average(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    model = {"prior": [0.0, float(np.log(0.02 / 0.95)), float(np.log(0.03 / 0.95))], "weights": {}}
    row = mixing.posteriors(docs, model).agg(*(F.avg(f"p_{d}") for d in mixing.DOMAINS)).first()
    assert list(row) == pytest.approx([0.95, 0.02, 0.03], abs=0.002)


def test_rates_of_cells_meet_targets_for_the_posteriors_themselves(spark):
    rng = np.random.default_rng(9)
    p = np.concatenate([rng.dirichlet([30, 1, 0.3], 800), rng.dirichlet([1, 9, 1], 80), rng.dirichlet([1, 1, 9], 20)])
    tokens = rng.integers(1, 900, len(p))
    scored = spark.createDataFrame([(*map(float, x), int(t)) for x, t in zip(p, tokens)], "p_clean double, p_low double, p_toxic double, n_tokens long")
    got = {(r.low, r.toxic): r.rate for r in mixing.rates(scored).collect()}
    rate = np.array([got[int(np.floor(x[1] * mixing.STEPS)), int(np.floor(x[2] * mixing.STEPS))] for x in p])
    reached = (p * (rate * tokens)[:, None]).sum(0)
    assert np.allclose(reached / reached.sum(), [mixing.TARGETS[d] for d in mixing.DOMAINS], atol=0.001)


def test_posteriors_are_the_plain_ones(spark):
    words = [f"w{i}" for i in range(12)]
    hashes = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()]
    model = {"prior": [0.0, -1.5, -2.5], "weights": {(1, 2.0): hashes[:4], (1, -1.0): hashes[4:6], (2, 3.0): [*hashes[3:5], hashes[8]]}}
    rng = np.random.default_rng(4)
    texts = [None, "", " \t\n", "w0", "W0 w0 w0", *(" ".join(rng.choice([*words, "other"], 9)) for _ in range(40)), "w1 w8 " * 30_000]
    rows = [(i, t, 0.5, 7) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in mixing.posteriors(spark.createDataFrame(rows, "doc_id long, text string, p_low double, `x.y` int"), model).collect()}
    assert len(got) == len(texts) and got[0]["x.y"] == 7
    for i, text in enumerate(texts):
        found = (text or "").split()
        told = {h: w for h, w in zip(hashes, words)}
        weights = {k: {told[h]: w for (d, w), hs in model["weights"].items() if d == k for h in hs} for k in (1, 2)}
        held = {w for w in found if w in weights[1] or w in weights[2]}
        damp = max(1.0, (len(held) / 4) ** 0.5)
        odds = [1.0, *(np.exp(model["prior"][k] + sum(weights[k].get(w, 0) for w in held) / damp) for k in (1, 2))]
        assert [got[i].p_clean, got[i].p_low, got[i].p_toxic] == pytest.approx([x / sum(odds) for x in odds])
        assert got[i].n_tokens == len(found) + 1


def test_a_gap_is_told(spark):
    scored = spark.createDataFrame([(0.5, 0.0, 0.5, 100), (0.5, 0.5, 0.0, 100)], "p_clean double, p_low double, p_toxic double, n_tokens long")
    assert mixing.rates(scored, rounds=50).where(f"gap <= {mixing.CLOSE}").isEmpty()  # half of all tokens stay clean whatever the rates
    apart = spark.createDataFrame([(1.0, 0.0, 0.0, 100), (0.0, 1.0, 0.0, 100), (0.0, 0.0, 1.0, 5)], scored.schema)
    assert mixing.rates(apart).where(f"gap > {mixing.CLOSE}").isEmpty()
    assert mixing.rates(scored.limit(0)).isEmpty()
