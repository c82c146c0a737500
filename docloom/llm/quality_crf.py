"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is labelled good or bad from its own features and those of the lines next to it; the
forward-backward marginals of "good", weighted by line length, add up to the document's quality. The
field is trained on every line of every labelled document: they are dealt to blocks of about ``block_docs``, a task
fits the field of a block, and the blocks' weights are averaged by their documents. Scoring covers every line of
every text, one partition at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.graph import small
from docloom.llm.once import written
from docloom.session import cut_lineage

BLOCK_DOCS, BLOCK_LINES = 3_000, 200_000
AREA = 40_000  # lines, with padding, that are worked on at a time
HELD_OUT_OF, HELD_OUT = 4, 2
ACCEPT = 0.7

N_FEATURES = 13
_SYMBOLS, _CAPITALS, _DIGITS = b"#*$%&<>~^=", bytes(range(65, 91)), bytes(range(48, 58))


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x ``N_FEATURES``) and lengths of a text's lines; an empty text is one empty line."""
    lines = [b for b in text.encode().split(b"\n") if b and not b.isspace()] or [b""]
    times = Counter(lines)
    rows, lengths = [], []
    for line in lines:
        words = line.split()
        n, size = len(words), len(line)
        chars = max(1, size - n + 1)
        rows.append(
            (
                (size - len(line.translate(None, _SYMBOLS))) / chars,
                (size - len(line.translate(None, _CAPITALS))) / chars,
                (size - len(line.translate(None, _DIGITS))) / chars,
                line.count(b"|") / max(1, n),
                line.count(b"!") / max(1, n),
                sum(map(eq, words, words[1:])) / max(1, n - 1),
                len(set(words)) / max(1, n),
                min(chars / max(1, n), 30.0) / 10.0,
                min(n, 200) / 50.0,
                n < 4,
                times[line] > 1,
                min(times[line], 10) / 10.0,
                len(lines) < 3,
            )
        )
        lengths.append(size + 1)
    return np.array(rows, dtype=np.float32), np.array(lengths, dtype=np.float64)


def with_neighbours(features: np.ndarray) -> np.ndarray:
    """A bias, the line's features and those of the lines before and after (zeros beyond the ends)."""
    none = np.zeros((1, features.shape[1]), features.dtype)
    before, after = np.vstack([none, features[:-1]]), np.vstack([features[1:], none])
    return np.hstack([np.ones((len(features), 1), features.dtype), features, before, after])


def padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences as one array (docs x longest x features), and a mask of the places in use."""
    longest = max(len(p) for p in parts)
    out = np.zeros((len(parts), longest, parts[0].shape[1]), np.float32)
    mask = np.zeros((len(parts), longest), bool)
    for i, p in enumerate(parts):
        out[i, : len(p)], mask[i, : len(p)] = p, True
    return out, mask


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def forward_backward(emissions: np.ndarray, moves: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (docs x lines x 2), those of neighbouring labels (docs x lines - 1 x 2 x 2) and log partition of each doc."""
    docs, longest, _ = emissions.shape
    alpha, beta = np.zeros_like(emissions), np.zeros_like(emissions)
    alpha[:, 0] = emissions[:, 0]
    for t in range(1, longest):
        step = _log_sum(alpha[:, t - 1, :, None] + moves, 1) + emissions[:, t]
        alpha[:, t] = np.where(mask[:, t, None], step, alpha[:, t - 1])
    for t in range(longest - 2, -1, -1):
        step = _log_sum(moves + (emissions[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where(mask[:, t + 1, None], step, beta[:, t + 1])
    log_z = _log_sum(alpha[:, -1], 1)
    marginals = np.exp(alpha + beta - log_z[:, None, None]) * mask[..., None]
    pairs = alpha[:, :-1, :, None] + moves + (emissions[:, 1:] + beta[:, 1:])[:, :, None, :] - log_z[:, None, None, None]
    return marginals, np.exp(np.minimum(pairs, 0.0)) * mask[:, 1:, None, None], log_z


def batches_of(sizes: list[int]) -> Iterator[list[int]]:
    """Places of sequences of similar length, at most ``AREA`` lines with padding at a time (a longer one stands alone)."""
    order = sorted(range(len(sizes)), key=sizes.__getitem__)
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * sizes[order[end]] <= AREA:
            end += 1
        yield order[at:end]
        at = end


class LineField:
    """The trained weights: emissions (features x 2) and moves between labels (2 x 2)."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, centre: np.ndarray, scale: np.ndarray):
        self.weights, self.moves, self.centre, self.scale = weights, moves, centre, scale

    @classmethod
    def fit(cls, parts: list[np.ndarray], labels: np.ndarray, rounds: int = 120, rate: float = 0.08, decay: float = 2e-3, scaling: tuple | None = None, share: np.ndarray | None = None) -> LineField:
        """Maximises the likelihood of the lines' labels (each line has its document's) by Adam, full batch.

        ``scaling`` (centre and scale of the features) and ``share`` of each label are the parts' own, or those of all that the parts are a block of.
        """
        width = 1 + 3 * N_FEATURES
        weights, moves = np.zeros((width, 2)), np.zeros((2, 2))
        if not parts:
            return cls(weights, moves, np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32))
        every = np.vstack(parts)
        centre, scale = scaling or (every.mean(0), every.std(0) + 1e-3)
        share = np.bincount(labels, minlength=2) / len(labels) if share is None else share
        of_doc = 0.5 / np.maximum(share, 1e-6)[labels] / np.array([len(p) for p in parts]) / len(labels)  # classes and documents weigh alike
        groups = []
        for rows in batches_of([len(p) for p in parts]):
            x, mask = padded([with_neighbours((parts[i] - centre) / scale) for i in rows])
            truth = np.zeros((*mask.shape, 2))
            truth[np.arange(len(rows)), :, labels[rows]] = 1.0
            groups.append((x, mask, truth * mask[..., None], of_doc[rows]))
        stays = np.zeros((2, 2))
        np.add.at(stays, (labels, labels), (np.array([len(p) for p in parts]) - 1) * of_doc)
        state = [np.zeros_like(a) for a in (weights, weights, moves, moves)]
        for step in range(1, rounds + 1):
            gradient, expected = -decay * weights, np.zeros((2, 2))
            for x, mask, truth, of in groups:
                marginals, pairs, _ = forward_backward((x @ weights.astype(np.float32)).astype(np.float64), moves, mask)
                off = ((truth - marginals) * of[:, None, None]).astype(np.float32)
                gradient = gradient + np.tensordot(x, off, axes=([0, 1], [0, 1]))
                expected += np.tensordot(of, pairs.sum(1), axes=1)
            for at, (value, slope) in enumerate(((weights, gradient), (moves, stays - expected - decay * moves))):
                first, second = state[2 * at], state[2 * at + 1]
                first += 0.1 * (slope - first)
                second += 0.001 * (slope**2 - second)
                value += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        return cls(weights, moves, centre, scale)

    def emissions(self, features: np.ndarray) -> np.ndarray:
        """What each line's own features and its neighbours' say of its labels, without a row of all of them."""
        own = (features - self.centre) / self.scale
        said = self.weights[0] + own @ self.weights[1 : 1 + N_FEATURES]
        said[1:] += own[:-1] @ self.weights[1 + N_FEATURES : 1 + 2 * N_FEATURES]
        said[:-1] += own[1:] @ self.weights[1 + 2 * N_FEATURES :]
        return said

    def score(self, texts: list[str]) -> np.ndarray:
        """The quality of each text, 0 to 1; texts of similar length share a batch of bounded area."""
        found = [line_features(t) for t in texts]
        scores = np.empty(len(texts))
        for rows in batches_of([len(lengths) for _, lengths in found]):
            longest = max(len(found[i][1]) for i in rows)
            emissions, mask = np.zeros((len(rows), longest, 2)), np.zeros((len(rows), longest), bool)
            for row, i in enumerate(rows):
                n = len(found[i][1])
                emissions[row, :n], mask[row, :n] = self.emissions(found[i][0]), True
            marginals, _, _ = forward_backward(emissions, self.moves, mask)
            for row, i in enumerate(rows):
                lengths = found[i][1]
                scores[i] = float(np.dot(marginals[row, : len(lengths), 1], lengths) / lengths.sum())
        return np.clip(scores, 0.0, 1.0)


def remainder(doc_id, of: int):
    """crc32 of the id as text, modulo ``of``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def train(docs: DataFrame, labels: DataFrame, block_docs: int = BLOCK_DOCS, block_lines: int = BLOCK_LINES) -> LineField:
    """Fits the field on all labelled rows outside the held-out fold.

    They are dealt by hashed id to blocks of about ``block_docs`` rows and ``block_lines`` lines, each fitted by one task with the
    scaling and the balance of labels of all; the field is the mean of the blocks' weights by documents. Labels null in either
    column are left out; of several labels of one id the largest counts, and of several texts of one id the one that is
    least by hash. With no labelled document at all every score is 0.5.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (remainder(F.col("doc_id"), HELD_OUT_OF) != HELD_OUT))
        .groupBy("doc_id")
        .agg((F.max("quality") > 0).cast("int").alias("quality"))
    )
    rows = docs.select("doc_id", "text").join(small(cut_lineage(chosen)), "doc_id").select("doc_id", "quality", "text")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [line_features(t or "")[0] for t in pdf.text]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "quality": pdf.quality, "features": [p.tobytes() for p in parts]})

    def lines(features: bytes) -> np.ndarray:
        return np.frombuffer(features, np.float32).reshape(-1, N_FEATURES)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, good, docs = np.zeros((2, 1 + N_FEATURES)), 0, 0
        for pdf in batches:
            for part in map(lines, pdf.features):
                sums += [np.append(x.sum(0), len(x)) for x in (part.astype(np.float64), part.astype(np.float64) ** 2)]
            good, docs = good + int(pdf.quality.sum()), docs + len(pdf)
        yield pd.DataFrame({"docs": [docs], "good": [good], "sums": [sums.ravel().tolist()]})

    every = rows.mapInPandas(features, "doc_id long, quality int, features binary")
    found = written(every.groupBy("doc_id").agg(F.min_by(F.struct("quality", "features"), F.xxhash64("features")).alias("x")).select("doc_id", "x.*"))
    told = found.select("quality", "features").mapInPandas(moments, "docs long, good long, sums array<double>")
    n, good, *sums = told.agg(F.sum("docs"), F.sum("good"), *(F.sum(F.get("sums", F.lit(i))) for i in range(2 * (1 + N_FEATURES)))).first()
    if not n:
        return LineField.fit([], np.zeros(0, np.int64))
    first, second = np.array(sums).reshape(2, -1)
    n_lines, centre = first[-1], first[:-1] / first[-1]
    scale = np.sqrt(np.maximum(second[:-1] / n_lines - centre**2, 0.0)) + 1e-3
    scaling, share = (centre.astype(np.float32), scale.astype(np.float32)), np.array([n - good, good]) / n
    blocks = max(-(-n // block_docs), -(-int(n_lines) // block_lines))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        field = LineField.fit([*map(lines, pdf.features)], pdf.quality.to_numpy(np.int64), scaling=scaling, share=share)
        return pd.DataFrame({"block": pdf.block[:1], "docs": [len(pdf)], "weights": [np.append(field.weights, field.moves).tolist()]})

    dealt = found.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    fitted = sorted(dealt.groupBy("block").applyInPandas(learn, "block long, docs long, weights array<double>").collect())  # a field is a hundred numbers
    mean = np.average([r.weights for r in fitted], axis=0, weights=[r.docs for r in fitted])
    return LineField(mean[:-4].reshape(-1, 2), mean[-4:].reshape(2, 2), *scaling)


def classify(docs: DataFrame, field: LineField) -> DataFrame:
    """``docs`` plus ``score`` (double) and ``predicted`` (int), from the text alone.

    A null or empty text is scored as one empty line. Repeated rows get equal scores. Columns named as the
    two new ones are replaced; all others pass through. An empty table stays empty.
    """
    kept = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("double")
    def quality(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.score([t or "" for t in texts]), dtype="float64")

    scored = kept.withColumn("score", quality(F.col("text").cast("string")))
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))
