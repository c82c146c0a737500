"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from docloom.llm import nearest


def brute(rows, queries, k=5):
    ok = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for i, v in queries:
        if i is None or v is None or None in v or not np.isfinite(v).all() or not np.any(v):
            continue
        v = np.array(v, dtype=float)
        scored = sorted((-float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w))), j) for j, w in ok if j != i)
        out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def run(spark, rows, queries, **options):
    schema = "vec_id long, embedding array<float>, score string"
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], schema)
    asked = spark.createDataFrame([(i, v, "x") for i, v in queries], schema)
    got: dict = {}
    for r in sorted(nearest.nearest(frame, asked, **options).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


def test_chi_square_inverse():
    for share in (0.5, 0.9, 0.97):
        assert abs(float(nearest.chi_square(np.array(nearest.chi_square_point(share)))) - share) < 1e-9
    draws = (np.random.default_rng(0).standard_normal((20000, nearest.DIMS)) ** 2).sum(1)
    assert abs((draws < nearest.chi_square_point(0.9)).mean() - 0.9) < 0.01


@pytest.mark.parametrize("cell_rows", [8192, 60])
def test_recall_and_scores(spark, cell_rows):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((600, 24)).astype(np.float32))]
    queries = rows[::20]
    want, got = brute(rows, queries), run(spark, rows, queries, cell_rows=cell_rows)
    assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    exact = {q: dict(brute(rows, [(q, v)], 600)[q]) for q, v in queries[:5]}
    assert all(abs(exact[q][j] - s) < 1e-12 for q in exact for j, s in got[q])


def test_copies_ties_and_invalid_rows(spark):
    near = [[1.0, 0.0], [1.0, 0.0], [0.9, 0.1], [0.0, 1.0]]
    rows = [(i, near[i % 4]) for i in range(40)] + [(100, None), (101, [0.0, 0.0]), (102, [float("nan"), 1.0]), (103, [1.0, None]), (None, [1.0, 0.0]), (104, [float("inf"), 1.0]), (3, [0.0, 1.0])]
    queries = [(0, near[0]), (7, near[3]), (100, None), (101, [0.0, 0.0])]
    got, want = run(spark, rows, queries), brute(rows, queries)
    assert {q: [j for j, _ in x] for q, x in got.items()} == {0: [1, 4, 5, 8, 9], 7: [3, 11, 15, 19, 23]}
    assert want.keys() == got.keys()


def test_few_candidates_and_empty_tables(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [-1.0, 0.5])]
    assert [j for j, _ in run(spark, rows, rows[:1])[0]] == [1, 2]
    assert run(spark, [], []) == {} and run(spark, rows, []) == {}


def test_recall_of_the_query(spark):
    from docloom.llm.queries import QUERIES

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    want = brute(rows, [r for r in rows if r[0] % 50 == 0])
    got: dict = {}
    for r in QUERIES["op3_nearest"](spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert got.keys() == want.keys()
    assert sum(len(got[q] & {j for j, _ in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_the_stop_fires_and_keeps_the_recall():
    """On 50,000 clustered rows in six groups a small share of them is verified, and recall stays."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((500, 64)) * 1.5
    rows = (centres[rng.integers(0, 500, 50_000)] + rng.standard_normal((50_000, 64))).astype(np.float64)
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    asked = unit[::500]
    matrix = nearest.projection(64)
    bound, best, verified = np.full(len(asked), -np.inf), [], 0
    for at in range(0, len(rows), 8_334):
        cell = nearest.Cell(rows[at : at + 8_334], matrix)
        found, cosines = cell.search(asked, asked @ matrix, bound, 6, nearest.CERTAINTY)
        best.append(np.where(found >= 0, found + at, -1))
        bound = np.maximum(bound, cosines[:, -1])
        verified += cell.verified
    hits = sum(len(set(want.tolist()) & set(np.concatenate([b[i] for b in best]).tolist())) for i, want in enumerate(np.argsort(-(asked @ unit.T), axis=1)[:, :6]))
    share = verified / len(asked) / len(rows)
    assert hits >= 0.9 * 6 * len(asked) and share < 0.2, (hits / 6 / len(asked), share)


def test_a_large_leaf_is_dealt_into_groups(spark, monkeypatch):
    """With a sample of few rows the tree has few leaves: their rows go to several groups, and all of them are asked."""
    monkeypatch.setattr(nearest, "SAMPLE", 4)
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 16)).astype(np.float32))]
    want, got = brute(rows, rows[::30]), run(spark, rows, rows[::30], cell_rows=20)
    assert sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)
