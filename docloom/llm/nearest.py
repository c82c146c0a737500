"""Approximate nearest neighbours: stable projections, a kd-tree, and a chi-square stopping test.

Unit vectors are projected to ``DIMS`` dimensions by independent Gaussian (2-stable) sums. The upper levels of
one kd-tree, grown on a bounded sample of projections, part all rows into cells, one group of a shuffle each (a cell
of more than ``CELL_ROWS`` rows is dealt into several groups); each group grows the lower levels itself. A query goes
through the tree's buckets in order of their distance and verifies a row by the cosine of the original vectors only
while the row's projected distance passes the stopping test. If a row at true distance s lies within projected
distance r, then (r / s) squared follows a chi-square law with ``DIMS`` degrees of freedom: a query is done with all
rows for which that law, at their projected distance and the k-th best true distance, exceeds ``CERTAINTY``. The
first round searches a query's home group; the bound found there tells which others the second round has to ask.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import cut_lineage

DIMS = 24
K = 5
CERTAINTY = 0.94
SAMPLE = 8_192
CELL_ROWS = 8_192
BUCKET = 64
SEED = 17


def projection(width: int, dims: int = DIMS) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((width, dims))


def chi_square(x: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """The chi-square distribution function for an even number of degrees of freedom."""
    half, term, total = x / 2, np.ones_like(x), np.ones_like(x)
    for i in range(1, dims // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def chi_square_point(share: float, dims: int = DIMS) -> float:
    """Where the distribution function reaches ``share``."""
    low, high = 0.0, 1000.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(np.array(middle), dims) < share else (low, middle)
    return high


def grow(points: np.ndarray, most: int) -> tuple[list[tuple[int, float, int, int]], list[np.ndarray]]:
    """A kd-tree: nodes (axis, cut, left, right), leaves as negative numbers, and the rows of each leaf."""
    nodes: list[tuple[int, float, int, int]] = []
    leaves: list[np.ndarray] = []

    def build(rows: np.ndarray) -> int:
        if len(rows) > most:
            spread = np.ptp(points[rows], axis=0)
            axis = int(spread.argmax())
            values = points[rows, axis]
            cut = float(np.median(values))
            left = values <= cut
            if left.all():
                left = values < cut
            if 0 < left.sum() < len(rows):
                cut = float(values[left].max())
                at = len(nodes)
                nodes.append((axis, cut, 0, 0))
                low = build(rows[left])
                nodes[at] = (axis, cut, low, build(rows[~left]))
                return at
        leaves.append(rows)
        return -len(leaves)

    build(np.arange(len(points)))
    return nodes, leaves


def home(nodes, points: np.ndarray) -> np.ndarray:
    """The leaf of each point."""
    out = np.zeros(len(points), np.int64)
    stack = [(0 if nodes else -1, np.arange(len(points)))]
    while stack:
        at, rows = stack.pop()
        if at < 0:
            out[rows] = -at - 1
        else:
            axis, cut, low, high = nodes[at]
            left = points[rows, axis] <= cut
            stack += [(low, rows[left]), (high, rows[~left])]
    return out


def boxes(nodes, dims: int, n_leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper corners of the leaves' boxes."""
    lower, upper = np.full((n_leaves, dims), -np.inf), np.full((n_leaves, dims), np.inf)
    stack = [(0 if nodes else -1, lower[0].copy(), upper[0].copy())]
    while stack:
        at, lo, hi = stack.pop()
        if at < 0:
            lower[-at - 1], upper[-at - 1] = lo, hi
        else:
            axis, cut, left, right = nodes[at]
            hi_left, lo_right = hi.copy(), lo.copy()
            hi_left[axis] = lo_right[axis] = cut
            stack += [(left, lo, hi_left), (right, lo_right, hi)]
    return lower, upper


def box_distance(points: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes."""
    out = np.zeros((len(points), len(lower)))
    for axis in range(points.shape[1]):
        x = points[:, axis, None]
        out += np.maximum(np.maximum(lower[:, axis] - x, x - upper[:, axis]), 0.0) ** 2
    return out


class Cell:
    """The lower levels of the tree over the rows of one cell, in buckets of ``BUCKET`` rows."""

    def __init__(self, vectors: np.ndarray, matrix: np.ndarray):
        self.unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        self.low = self.unit @ matrix
        _, self.leaves = grow(self.low, BUCKET)
        self.lower = np.array([self.low[rows].min(0) for rows in self.leaves])
        self.upper = np.array([self.low[rows].max(0) for rows in self.leaves])
        self.verified = 0

    def search(self, queries: np.ndarray, low: np.ndarray, bound: np.ndarray, k: int, certainty: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows (-1: none) and cosines of the k nearest found for each unit query; ``bound``: a k-th best known so far."""
        n = len(queries)
        best, rows = np.full((n, k), -np.inf), np.full((n, k), -1)
        away = box_distance(low, self.lower, self.upper)
        order = np.argsort(away, axis=1, kind="stable")
        point = chi_square_point(certainty)
        active = np.arange(n)
        for step in range(len(self.leaves)):
            # beyond this projected distance the test holds; without k rows it never does
            limit = point * np.maximum(2 - 2 * np.maximum(best[active, -1], bound[active]), 0.0)
            going = away[active, order[active, step]] <= limit
            active, limit = active[going], limit[going]
            if not len(active):
                break
            turn = order[active, step]
            by_turn = np.argsort(turn, kind="stable")
            for part in np.split(by_turn, np.flatnonzero(np.diff(turn[by_turn])) + 1):
                who, members = active[part], self.leaves[turn[part[0]]]
                near = ((low[who, None, :] - self.low[None, members, :]) ** 2).sum(2) <= limit[part, None]
                q, m = np.nonzero(near)
                self.verified += len(q)
                cosines = np.full(near.shape, -np.inf)
                cosines[q, m] = np.einsum("ij,ij->i", queries[who[q]], self.unit[members[m]])
                together = np.hstack([best[who], cosines])
                names = np.hstack([rows[who], np.where(near, members, -1)])
                top = np.argsort(-together, axis=1, kind="stable")[:, :k]
                best[who], rows[who] = np.take_along_axis(together, top, 1), np.take_along_axis(names, top, 1)
        return rows, best


def valid(vectors: DataFrame) -> DataFrame:
    """Rows whose id is there and whose vector has finite components, not all of them zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(
        F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    )


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, certainty: float = CERTAINTY, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` nearest rows of ``vectors`` other than its own.

    Both tables hold vec_id and embedding; other columns are ignored. Rows with a null id or a vector that is
    null, zero, or holds a null or non-finite component take no part; nor do rows of another width than the
    most common one's. The score is the cosine in double precision; ties go to the smaller vec_id, and all
    rows of a query's id count as its own. Rows with equal vectors are searched once and listed by their
    ``k + 1`` smallest ids, which is as many as any query can return. Empty tables give an empty table.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, asked = valid(vectors), valid(queries)
    widths = rows.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    if not widths:
        return empty
    width = int(widths[0].w)
    matrix = projection(width)
    rows, asked = rows.where(F.size("embedding") == width), asked.where(F.size("embedding") == width)
    # equal vectors are one point: each task keeps its smallest ids before anything is shuffled
    order = Window.partitionBy("embedding").orderBy("vec_id")
    listed = rows.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    points = cut_lineage(listed.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    total = points.count()
    share = max(1, -(-total // SAMPLE))
    sample = [np.array(r.embedding) for r in points.where(F.pmod(F.xxhash64("embedding"), F.lit(share)) == 0).select("embedding").collect()]
    if not total:
        return empty
    unit = np.array(sample, dtype=np.float64).reshape(-1, width)
    unit = unit[np.lexsort(unit.T)] / np.maximum(np.linalg.norm(unit[np.lexsort(unit.T)], axis=1), 1e-300)[:, None]
    cells = max(1, -(-total // cell_rows))
    nodes, leaves = grow(unit @ matrix, max(1, -(-len(unit) // cells)))
    lower, upper = boxes(nodes, DIMS, len(leaves))
    reach = chi_square_point(certainty)

    def low_of(embeddings) -> tuple[np.ndarray, np.ndarray]:
        u = np.array(list(embeddings), dtype=np.float64).reshape(-1, width)
        u = u / np.linalg.norm(u, axis=1)[:, None]
        return u, u @ matrix

    @F.pandas_udf("long")
    def leaf_of(embeddings: pd.Series) -> pd.Series:
        return pd.Series(home(nodes, low_of(embeddings)[1]), dtype="int64")

    # a leaf's rows are dealt to as many groups as keep each within cell_rows
    in_leaves = cut_lineage(points.withColumn("leaf", leaf_of("embedding")))
    groups = np.ones(len(leaves), np.int64)
    for row in in_leaves.groupBy("leaf").count().collect():
        groups[row.leaf] = -(-row["count"] // cell_rows)
    first_group = np.concatenate([[0], np.cumsum(groups)])

    @F.pandas_udf("long")
    def cell_of(leaf: pd.Series, dealt: pd.Series) -> pd.Series:
        return pd.Series(first_group[leaf.to_numpy()] + dealt.to_numpy() % groups[leaf.to_numpy()], dtype="int64")

    @F.pandas_udf("array<long>")
    def cells_within(embeddings: pd.Series, homes: pd.Series, bound: pd.Series) -> pd.Series:
        low, radius = low_of(embeddings)[1], reach * np.maximum(2 - 2 * bound.fillna(-1.0).to_numpy(), 0.0)
        out, step = [], max(1, 4_000_000 // len(lower))
        for at in range(0, len(low), step):
            near = np.repeat(box_distance(low[at : at + step], lower, upper) <= radius[at : at + step, None], groups, axis=1)
            near[np.arange(len(near)), homes.to_numpy()[at : at + step]] = False
            out += [np.flatnonzero(x).tolist() for x in near]
        return pd.Series(out)

    def search(members: pd.DataFrame, who: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        if not len(who) or not len(members):
            return pd.DataFrame({c: pd.Series([], dtype="float64" if c == "bound" else object) for c in ("embedding", "ids", "other", "bound")})
        u, low = low_of(who.embedding)
        cell = Cell(np.array(list(members.embedding), dtype=np.float64), matrix)
        at, best = cell.search(u, low, who.bound.fillna(-np.inf).to_numpy(), k + 1, certainty)
        q, col = np.nonzero(at >= 0)
        hit = at[q, col]
        return pd.DataFrame({"embedding": who.embedding.to_numpy()[q], "ids": members.ids.to_numpy()[hit], "other": members.embedding.to_numpy()[hit], "bound": best[q, col]})

    shape = "embedding array<double>, ids array<long>, other array<double>, bound double"
    dealt = F.pmod(F.xxhash64(F.lit("dealt"), "embedding"), F.lit(1 << 31))
    placed = in_leaves.withColumn("cell", cell_of("leaf", dealt)).drop("leaf")
    first = asked.select("embedding").distinct().withColumn("leaf", leaf_of("embedding")).withColumn("cell", cell_of("leaf", dealt)).drop("leaf").withColumn("bound", F.lit(None).cast("double"))
    members = placed.groupBy("cell")
    at_home = cut_lineage(members.cogroup(first.groupBy("cell")).applyInPandas(search, shape))
    # k + 1 rows, counted with their copies, bound the distance that still matters
    running = Window.partitionBy("embedding").orderBy(F.desc("bound")).rowsBetween(Window.unboundedPreceding, 0)
    bounds = at_home.withColumn("seen", F.sum(F.size("ids")).over(running)).where(F.col("seen") >= k + 1).groupBy("embedding").agg(F.max("bound").alias("bound"))
    second = first.drop("bound").join(bounds, "embedding", "left").select("embedding", F.explode(cells_within("embedding", "cell", "bound")).alias("cell"), "bound")
    others = members.cogroup(second.groupBy("cell")).applyInPandas(search, shape)
    found = at_home.unionByName(others)
    # exact scores from the original vectors, ties by id
    dot = F.aggregate(F.zip_with("embedding", "other", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def norm(column: str):
        return F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, x: s + x * x))

    listed = found.select("embedding", F.explode("ids").alias("vec_id"), (dot / (norm("embedding") * norm("other"))).alias("score"))
    nearest_first = Window.partitionBy("embedding").orderBy(F.desc("score"), "vec_id")
    top = listed.withColumn("n", F.row_number().over(nearest_first)).where(F.col("n") <= k + 1).select("embedding", "vec_id", "score")
    own = asked.select(F.col("vec_id").alias("query_id"), "embedding").distinct()
    answers = own.join(top, "embedding").where(F.col("vec_id") != F.col("query_id"))
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
