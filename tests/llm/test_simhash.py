"""SimHash clusters against brute force, and the cases the docstrings name."""

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from docloom.llm import simhash


def plain_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_classes(prints, max_bits=4):
    """Smallest id reachable for each (id, fingerprint), by comparing all pairs."""
    ids, fps = [i for i, _ in prints], np.array([f for _, f in prints], dtype=np.uint64)
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= max_bits) + i + 1:
            a, b = sorted((root(i), root(int(j))))
            parent[b] = a
    known = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            known[root(i)] = min(doc, known.get(root(i), doc))
    return [(doc, f"{int(f):016x}", known.get(root(i))) for i, (doc, f) in enumerate(zip(ids, fps))]


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "one TWO three", "a b c d", "A b\x0bc d e f g", "é Éa ü b c ÀB d"])
def test_fingerprint_is_the_plain_one(text):
    assert simhash.fingerprint(text) % 2**64 == plain_fingerprint(text)


def test_fingerprint_of_a_long_text(monkeypatch):
    monkeypatch.setattr(simhash, "_CHUNK", 64)
    text = " ".join(f"w{i % 97}" for i in range(1000))
    assert simhash.fingerprint(text) % 2**64 == plain_fingerprint(text)


def crafted(seed=3):
    """Fingerprints with chains, dense clusters, copies and strangers."""
    rng = np.random.default_rng(seed)
    out = list(rng.integers(0, 2**64, 400, dtype=np.uint64))
    for centre in rng.integers(0, 2**64, 5, dtype=np.uint64):
        for _ in range(80):
            flips = rng.choice(64, rng.integers(0, 7), replace=False)
            out.append(np.bitwise_xor.reduce([centre, *(np.uint64(1) << np.uint64(f) for f in flips)]))
    at = rng.integers(0, 2**64, dtype=np.uint64)
    for step in range(12):  # a chain of which only neighbours are near
        out.append(at)
        at = at ^ (np.uint64(0b1111) << np.uint64(4 * step))
    return np.array(out, dtype=np.uint64)


@pytest.mark.parametrize("shard_rows", [20_000, 8])
def test_classes_of_crafted_fingerprints(spark, shard_rows):
    fps = crafted()
    distinct = np.unique(fps)
    frame = spark.createDataFrame([(int(x),) for x in distinct.view(np.int64)], "fp long")
    found = {r.node % 2**64: r.root for r in simhash.classes(simhash.links(frame, shard_rows=shard_rows, leaf=8)).collect()}
    want = plain_classes(list(enumerate(distinct)))
    got: dict = {}
    for i, value in enumerate(distinct):
        got.setdefault(found.get(int(value), ("own", i)), []).append(i)
    expected: dict = {}
    for i, _, least in want:
        expected.setdefault(least, []).append(i)
    assert sorted(got.values()) == sorted(expected.values())


def test_tree_with_small_leaves_finds_all_classes():
    fps = np.unique(crafted(5))
    for leaf in (2, 16, 4096):
        pairs = [p for p in simhash.tree_links(fps, np.empty(0, np.uint64), 4, leaf)]
        a, b = np.concatenate(pairs, axis=1)
        assert (np.bitwise_count(a ^ b) >= 1).all() and len(a) < 40 * len(fps)
        index = {int(x): i for i, x in enumerate(fps)}
        label = np.arange(len(fps))
        for _ in range(len(fps)):
            before = label.copy()
            for x, y in zip(a, b):
                least = min(label[index[int(x)]], label[index[int(y)]])
                label[index[int(x)]] = label[index[int(y)]] = least
            if (before == label).all():
                break
        assert [int(x) for x in label] == [least for _, _, least in plain_classes(list(enumerate(fps)))]


@pytest.mark.parametrize("max_bits", [0, 1, 2, 4, 7, 9])
def test_near_pairs_are_near_in_a_part(max_bits):
    parts = simhash.search_parts(max_bits)
    masks = np.array([m for m, _ in parts])
    assert np.bitwise_or.reduce(masks) == 2**64 - 1 and np.bitwise_count(masks).sum() == 64
    assert sum(bits + 1 for _, bits in parts) == max_bits + 1
    rng = np.random.default_rng(max_bits)
    for _ in range(300):
        apart = np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, max_bits, replace=False).astype(np.uint64), initial=np.uint64(0))
        assert any(np.bitwise_count(apart & m) <= bits for m, bits in parts)


@pytest.mark.parametrize("blocks", [(1, 1), (3, 0), (2, 2), (1, 4)])
def test_tiles_hold_every_pair_of_a_shard(blocks):
    rng = np.random.default_rng(7)
    fps, own = np.unique(rng.integers(0, 2**64, 90, dtype=np.uint64)), np.arange(90) % 3 > 0
    own = own if blocks[1] else np.ones(90, bool)
    tiles: dict = {}
    for key, rows, mine in simhash.tiled(5, fps, own, blocks):
        assert key >> 32 == 5
        tiles.setdefault(key, []).extend(zip(rows.tolist(), mine.tolist()))
    met = {frozenset((a, b)) for rows in tiles.values() for a, mine in rows if mine for b, _ in rows}
    assert all(frozenset((a, b)) in met for a in fps[own].tolist() for b in fps.tolist())


def test_few_rows_are_placed_more_than_once_in_a_part():
    fps = np.unique(np.random.default_rng(11).integers(0, 2**64, 40_000, dtype=np.uint64))
    for most, limit in ((10_000, 6), (1_250, 6.5), (110, 8)):
        rows = shards = 0
        for mask, bits in simhash.search_parts(4):
            for _, held, own in simhash.placed(fps, simhash.upper_tree(fps[::2] & mask, most, bits), bits, mask):
                rows, shards = rows + len(held), shards + 1
                assert own.sum() <= 6 * most
        assert rows <= limit * len(fps), (shards, rows / len(fps))
    assert 900 < shards < 1400


def test_one_value_of_a_part_is_cut_into_tiles(spark):
    rng = np.random.default_rng(13)
    low = rng.integers(0, 2**25, 600, dtype=np.uint64)  # all other parts are equal, so one leaf holds all
    fps = np.unique(np.concatenate([low, low[:200] ^ np.uint64(0b1011)]))
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = {r.node: r.root for r in simhash.classes(simhash.links(frame, shard_rows=64, leaf=8)).collect()}
    classes: dict = {}
    for i, _, least in plain_classes(list(enumerate(fps))):
        classes.setdefault(least, set()).add(int(fps[i]))
    want = {frozenset(c) for c in classes.values() if len(c) > 1}
    got: dict = {}
    for node, root in found.items():
        got.setdefault(root, set()).add(node)
    assert {frozenset(c) for c in got.values()} == want


def test_small_cases_of_the_operator(spark):
    rows = [(7, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, None), (None, ""), (2, "  "), (None, "x y z"), (5, "other words here again now")]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, fp string, root int")
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_digits("fp"), "component_id").collect()
    want = plain_classes([(i, plain_fingerprint(t)) for i, t in rows])
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 2), (False, 3), (False, 5), (True, 0)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0 and simhash.deduplicate(docs).count() == 0


def test_the_query_against_brute_force(spark):
    from docloom.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = plain_classes([(r.doc_id, plain_fingerprint(r.text)) for r in docs])
    got = QUERIES["op1_simhash"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_trees_grow_on_the_documents_and_prune(spark):
    """On the query's own fingerprints the upper tree parts the rows, shards split on, and the triangle bound prunes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    fps = np.unique(np.array([simhash.fingerprint(r.text) for r in docs], np.int64).view(np.uint64))
    nodes = simhash.upper_tree(fps, 256)
    shards = list(simhash.placed(fps, nodes, simhash.MAX_BITS))
    assert len(shards) > 2 and sum(int(own.sum()) for _, _, own in shards) == len(fps)
    assert sum(len(rows) for _, rows, _ in shards) < 0.8 * len(shards) * len(fps)
    seen: dict = {}
    for _, rows, own in shards:
        list(simhash.tree_links(rows[own], rows[~own], seen=seen, leaf=64))
    assert seen["splits"] > 2 and seen["pruned"] > 0


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {b""}


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def edited(rng, n_bases=150):
    """Texts and copies with edits, whose likeness lies between 0.8 and 0.95, and copies with too many edits."""
    rows = []
    for base in range(n_bases):
        words = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(60, 400))]
        rows.append((2 * base + 1, " ".join(words)))
        for at in rng.choice(len(words), max(1, int(len(words) * rng.choice([0.005, 0.012, 0.02, 0.06]))), replace=False):
            words[at] = f"new{at}"
        rows.append((2 * base + 2, " ".join(words)))
    return rows


def test_deduplicate_against_brute_force(spark):
    rows = edited(np.random.default_rng(11))
    rows += [(1000 + i, rows[0][1] + f" tail{i}") for i in range(40)] + [(None, rows[2][1]), (2000, rows[4][1].upper()), (2001, None), (2002, " "), (2003, "a b"), (2004, "A  b")]
    kept = {(r.doc_id, r.text) for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {r: shingles(r[1]) for r in rows}
    gone = [r for r in rows if r not in kept]
    assert all(any(alike(sets[r], sets[k]) for k in rows if k != r) for r in gone)
    pairs = [(a, b) for i, a in enumerate(rows) for b in rows[i + 1 :] if a in kept and b in kept and alike(sets[a], sets[b])]
    near = sum(alike(shingles(rows[i][1]), shingles(rows[i + 1][1])) for i in range(0, 300, 2))
    assert near > 60 and len(pairs) <= 0.05 * near
    assert (None, rows[2][1]) not in kept and not any((i, t) in kept for i, t in rows if i in (2000, 2002, 2004) or (i or 0) in range(1000, 1040))


def plain_kept(rows):
    """The rows that stay if all pairs are compared: the first of each class of alike sets."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                parent[root(i)] = root(j)
    first = {}
    for i, r in enumerate(rows):
        first[root(i)] = min(first.get(root(i), r), r, key=lambda x: (x[0] is None, x[0] or 0))
    return sorted(first.values(), key=str)


@pytest.mark.parametrize("tile, hub_rounds", [(512, 2), (4, 0)])
def test_deduplicate_loses_no_link(spark, tile, hub_rounds):
    """Short texts that are just alike, though their fingerprints lie far apart; and a partner behind nearer ones that aren't alike."""
    rng = np.random.default_rng(17)
    rows = []
    for base in range(300):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 9)]
        rows += [(3 * base, " ".join(words)), (3 * base + 1, " ".join(words[:-1])), (3 * base + 2, " ".join(words[:-2]))]
    long = [f"v{i}" for i in range(200)]
    for i in range(60):  # from 190 to 130 of 196 shingles in common with the first
        rows.append((2000 + i, " ".join([*long[: 199 - i], *(f"u{i}x{k}" for k in range(i))])))
    rows += [(None, "one two"), (5000, "One TWO"), (5001, None), (5002, " "), (3, "another text of a row that has the same id"), rows[4], (None, None)]
    docs = spark.createDataFrame([(i, x, 1, "c") for i, x in rows], "doc_id long, text string, t int, node string").repartition(5)
    kept = simhash.deduplicate(docs) if hub_rounds else simhash.deduplicate(docs, hub_rounds, tile)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == plain_kept(rows)
