"""The n-gram join against all pairs of plain sets, with hubs and small tiles, and against its SQL."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import ngram_join
from docloom.llm.queries import ORACLES, QUERIES
from tests.test_queries import rows_of

SMALL = "/root/testdata/sf0.001"


def plain_set(text):
    words = re.findall("[^ \t\n\v\f\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset()


def plain_links(sets, alike=85):
    found = list(set(sets) - {frozenset()})
    return [(x, y) for i, x in enumerate(found) for y in found[:i] if 100 * len(x & y) >= alike * len(x | y)]


def plain_classes(docs, alike=85):
    sets = {i: plain_set(t) for i, (_, t) in enumerate(docs)}
    root = {s: s for s in sets.values()}

    def top(s):
        while root[s] != s:
            s = root[s]
        return s

    for x, y in plain_links(sets.values(), alike):
        root[top(x)] = top(y)
    names = {}
    for i, s in sets.items():
        names.setdefault(top(s), []).append(docs[i][0])
    least = {k: min((d for d in v if d is not None), default=None) for k, v in names.items()}
    return sorted(((d, len(sets[i]), least[top(sets[i])] if sets[i] else d) for i, (d, _) in enumerate(docs)), key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def planted(seed):
    rng = random.Random(seed)
    docs, texts = [], []
    passage = [f"p{i}" for i in range(60)]
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 160))]
        texts += [edited(rng, base, rng.randrange(0, 5)) for _ in range(rng.randrange(1, 12))]
    hot = [f"h{i}" for i in range(120)]
    texts += [edited(rng, hot, rng.randrange(0, 6)) for _ in range(80)]  # a group that is alike in part
    texts += [" ".join([*passage, *(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 30)))]) for _ in range(50)]  # a shared passage that nearly suffices
    texts += ["A b C", "a B c", "a b", None, "", " \n\t", "one", "One", "w " * 40, "w " * 3, "é É ß x", "long " * 3000 + "end"]
    rng.shuffle(texts)
    docs = [(i, t) for i, t in enumerate(texts)]
    return [*docs, docs[0], (None, texts[0]), (None, "lonely words of no one here"), (None, None)]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, n int, node string").repartition(5)


@pytest.mark.parametrize("seed, tile, hub_rounds", [(1, 512, 2), (2, 8, 1), (3, 4, 0)])
def test_classes_of_all_pairs(spark, monkeypatch, seed, tile, hub_rounds):
    monkeypatch.setattr(ngram_join, "HOT_LEAST", 8)
    docs = planted(seed)
    found = ngram_join.jaccard_classes(frame(spark, docs), hub_rounds=hub_rounds, tile=tile)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, found.collect()), key=str) == plain_classes(docs)


def test_every_link_with_its_overlap(spark):
    docs = planted(4)
    members, links = ngram_join.linked_pairs(frame(spark, docs), tile=16)
    of = {r.node: plain_set(dict(docs)[r.doc_id]) for r in members.collect() if r.doc_id is not None and r.n_shingles}
    got = {frozenset((of[r.a], of[r.b])): (r.overlap, r.union) for r in links.collect()}
    want = {frozenset((x, y)): (len(x & y), len(x | y)) for x, y in plain_links([plain_set(t) for _, t in docs])}
    assert got == want


def test_equals_its_sql(spark, duck):
    found = QUERIES["op12_ngram_join"](spark, SMALL)
    rel = duck.sql(ORACLES["op12_ngram_join"])
    names = sorted(found.columns)
    assert rows_of(names, found.columns, found.collect()) == rows_of(names, list(rel.columns), rel.fetchall())


def test_empty_tables(spark):
    assert ngram_join.jaccard_classes(frame(spark, [(1, "a b c d e")]).limit(0)).collect() == []
    assert sorted(map(tuple, ngram_join.jaccard_classes(frame(spark, [(1, None), (2, ""), (3, " ")])).collect())) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_words_of_texts_in_one_batch(monkeypatch):
    texts = ["A b\tC d e", None, "", " ", "a b c d e", "é b", "B é", "x" * 50 + " y z w v", "d e", "w " * 30]
    want = [np.sort(s) for s in ngram_join.gram_sets(pa.array(texts), 4, 42)]
    assert [len(s) for s in want] == [2, 0, 0, 0, 2, 1, 1, 2, 1, 1] and (want[0] == want[4]).all() and want[5] != want[6]
    monkeypatch.setattr(ngram_join, "_BATCH_BYTES", 16)
    ngram_join._tables.cache_clear()
    for slices in (pa.array(texts), pa.array(["front", *texts])[1:]):
        assert all((x == y).all() for x, y in zip(want, ngram_join.gram_sets(slices, 4, 42), strict=True))


def test_the_first_block_follows_from_the_size():
    assert [int(n - ngram_join.least_overlap(n, 85) + 1) for n in (1, 6, 7, 20, 100)] == [1, 1, 2, 4, 16]
    assert ngram_join.least_overlap(np.array([100]), 80)[0] == 80


def test_signatures_never_rule_out_alike_sets():
    rng = np.random.default_rng(3)
    ruled = 0
    for n in (1, 7, 12, 90, 700, 5_000):
        base = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        for share in (0.0, 0.02, 0.05, 0.08, 0.1, 0.2, 0.4):
            other = np.unique(np.concatenate([base[rng.random(len(base)) >= share], rng.integers(0, 1 << 64, int(share * n), np.uint64)]))
            common = len(np.intersect1d(base, other))
            bits = [np.frombuffer(ngram_join.signature(x), np.uint64) for x in (base, other)]
            apart = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
            near = apart <= ngram_join.most_apart(np.int64(len(base) + len(other)), 85)
            assert near or 100 * common < 85 * (len(base) + len(other) - common)
            ruled += not near
    assert ruled >= 10
