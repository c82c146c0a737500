"""Exact joins of texts by the Jaccard likeness of their word n-grams: a blocked product of the incidence matrix.

Rows of the matrix are distinct n-gram sets, columns are n-grams, and overlaps are the entries of its product with its
own transpose. In one global order of columns, rare ones first, two sets that are alike share one of the first columns
of both, whose number follows from a set's size. So only that block of the matrix is multiplied: columns of one set
drop out, the others add to the overlaps of pairs, and pairs whose sizes, or whose overlap so far with all that is left
of a set, can't reach the likeness are discarded. For what remains the overlap is counted over all columns.

Each row has a signature too, a bit of which says whether an odd number of its columns fall on it. Two signatures differ
in no more bits than the rows do in columns, so a pair whose signatures differ in more than its sizes allow is never alike
and leaves no product: in a large group of near copies most pairs are of this kind.

Columns of many sets are never multiplied whole. First its sets are held against one of them as a hub; sets that turn out
to be of one class need no product any more. What is left is multiplied in tiles of bounded size.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from docloom.llm.graph import classes, small
from docloom.llm.once import written
from docloom.session import cut_lineage, shuffle_partitions

WORDS = 4
ALIKE = 85  # of a hundred
HOT_GRAMS = 1 << 20
HOT_BUFFER, HOT_SEEN, HOT_LEAST = 1 << 22, 4, 32
SHARD_ENTRIES = 1 << 20
FLUSH_ENTRIES = 1 << 20
TILE = 512
HUB_ROUNDS = 2
SEEN_PAIRS = 1 << 18
SIGNATURE_BITS = 1024
_BATCH_BYTES = 1 << 21
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])

_ROW = pa.schema([*((c, pa.int64()) for c in ("kind", "doc_id", "t", "node", "twin", "n")), ("signature", pa.binary())])
_MESSAGE_DDL = "bucket int, grams array<long>, refs array<int>, nodes array<long>, sizes array<int>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


@functools.cache
def _tables(seed: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte (upper case as lower), and powers of an odd base and of its inverse."""
    rng = np.random.default_rng(seed)
    of_byte = rng.integers(0, 1 << 64, 256, np.uint64)
    of_byte[65:91] = of_byte[97:123]
    base = int(rng.integers(0, 1 << 63)) * 2 + 1
    powers = [np.full(size, x % (1 << 64), np.uint64) for x in (base, pow(base, -1, 1 << 64))]
    for x in powers:
        x[0] = 1
    return of_byte, *(np.cumprod(x, dtype=np.uint64) for x in powers)


def word_hashes(data: np.ndarray, breaks: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Where words start in bytes that hold several texts, and their hashes; ``breaks``: where a text starts or ends."""
    size = max(_BATCH_BYTES, 1 << int(len(data)).bit_length())
    of_byte, power, inverse = _tables(seed, size)
    inside = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[breaks] = True
    starts = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | cut[:-1]))
    ends = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | cut[1:])) + 1
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(of_byte[data] * power[: len(data)], dtype=np.uint64)])
    return starts, _mixed((upto[ends] - upto[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def _combined(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` hashes in line."""
    grams = np.full(len(hashes) - size + 1, size, np.uint64)
    for j in range(size):
        grams = _mixed(grams * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[j : len(hashes) - size + 1 + j])
    return grams


def gram_sets(texts: pa.Array, words: int, seed: int) -> Iterator[np.ndarray]:
    """Of each text the distinct hashes of its n-grams, sorted (of its whole sequence of words, if that is shorter)."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _BATCH_BYTES, "right")) - 1)
        breaks = offsets[at : to + 1] - offsets[at]
        if breaks[-1] <= _BATCH_BYTES:
            starts, hashes = word_hashes(data[offsets[at] : offsets[to]], breaks, seed)
        else:  # one long text, in parts that end behind a word
            part, found, first = data[offsets[at] : offsets[to]], [], 0
            while first < len(part):
                spaces = np.flatnonzero(_SPACE[part[first + _BATCH_BYTES :]][: 1 << 16]) if first + _BATCH_BYTES < len(part) else ()
                last = first + _BATCH_BYTES + int(spaces[0]) if len(spaces) else len(part)
                found.append(word_hashes(part[first:last], np.array([0, last - first]), seed)[1])
                first = last
            hashes = np.concatenate(found)
            starts = np.zeros(len(hashes), np.int64)
        of = np.searchsorted(breaks, starts, "right") - 1
        bounds = np.searchsorted(of, np.arange(to - at + 1))
        grams = _combined(hashes, words) if len(hashes) >= words else hashes[:0]
        for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if last - first >= words:
                yield np.unique(grams[first : last - words + 1])
            else:
                yield _combined(hashes[first:last], last - first) if last > first else hashes[:0]
        at = to


def _names(grams: np.ndarray, seed: int) -> tuple[int, int]:
    """Two independent numbers of a set; the first is its node."""
    data = grams.tobytes()
    return xxh64_intdigest(data, seed) - (1 << 63), xxh64_intdigest(data, seed + 1) - (1 << 63)


def signature(grams: np.ndarray, bits: int = SIGNATURE_BITS) -> bytes:
    """Of each of ``bits`` places (a power of two) whether an odd number of a set's grams fall on it."""
    return np.packbits(np.bincount((grams >> np.uint64(65 - bits.bit_length())).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def most_apart(both: np.ndarray, alike: int) -> np.ndarray:
    """The most columns in which two alike sets differ that hold ``both`` grams together."""
    return both - 2 * -(-both * alike // (100 + alike))


def least_overlap(n: int | np.ndarray, alike: int):
    """The least overlap of a set of n grams with any that is alike."""
    return -(-n * alike // 100)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def keyed(docs: DataFrame, keep: list[str] = []) -> DataFrame:
    """``keep``, doc_id, text and t, a hash of the text: ids may repeat, and (doc_id, t) tells their texts apart."""
    texts = docs.select(*keep, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.withColumn("t", F.xxhash64("text", F.length("text")))


def _each(batches: Iterator[pa.RecordBatch], words: int, seed: int) -> Iterator[tuple[int | None, np.ndarray]]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), gram_sets(batch.column(1), words, seed))


def scan(docs: DataFrame, words: int, seed: int, bits: int = SIGNATURE_BITS) -> DataFrame:
    """A row of kind 0 for each document (doc_id, t, node, twin, n, signature), and rows of kind 1 for grams that a task saw often (node: gram, n: sets)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, size, seen = [], 0, set()

        def often() -> pa.RecordBatch:
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            grams, n = grams[n >= HOT_SEEN].view(np.int64), n[n >= HOT_SEEN]
            none = pa.nulls(len(n), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(n), np.int64)), none, none, pa.array(grams), none, pa.array(n), pa.nulls(len(n), pa.binary())], schema=_ROW)

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({name: [r[i] for r in rows] for i, name in enumerate(_ROW.names)}, schema=_ROW)

        for doc_id, t, grams in ((i, t, g) for b in batches for i, t, g in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), gram_sets(b.column(1), words, seed))):
            node, twin = _names(grams, seed)
            rows.append((0, doc_id, t, node, twin, len(grams), signature(grams, bits)))
            if len(grams) and node not in seen:
                seen.add(node)
                held.append(grams)
                size += len(grams)
            if size >= HOT_BUFFER:
                yield often()
                held, size, seen = [], 0, set()
            if len(rows) >= 10_000:
                yield told()
                rows = []
        if held:
            yield often()
        yield told()

    return keyed(docs).mapInArrow(read, "kind long, doc_id long, t long, node long, twin long, n long, signature binary")


def _hot(scanned: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Grams of very many sets and a level of how many, at most ``HOT_GRAMS`` of them. They come last in the order of columns, which changes speed, not results."""
    totals = cut_lineage(scanned.where("kind = 1").groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_LEAST))
    level = F.floor(F.log2("n") * 4).cast("int")
    left, least = HOT_GRAMS, None
    for row in totals.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if row["count"] > left:
            break
        left, least = left - row["count"], row.level
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = totals.where(level >= least).select("node", level.alias("level")).collect()
    grams, levels = np.array([r.node for r in found], np.int64).view(np.uint64), np.array([r.level for r in found], np.int64)
    order = np.argsort(grams)
    return grams[order], levels[order]


def _levels(grams: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    if not len(hot[0]):
        return np.zeros(len(grams), np.int64)
    at = np.minimum(np.searchsorted(hot[0], grams), len(hot[0]) - 1)
    return np.where(hot[0][at] == grams, hot[1][at], 0)


def incidence(docs: DataFrame, words: int, seed: int, alike: int, hot: tuple[np.ndarray, np.ndarray], shards: int) -> DataFrame:
    """(gram, node, n): the first block of the matrix, without the columns of one set (columns of hot grams may still be so)."""
    table = docs.sparkSession.sparkContext.broadcast(hot)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            grams = np.concatenate(held)
            ref = np.repeat(np.arange(len(held)), [len(g) for g in held])
            by = np.where(_levels(grams, table.value) > 0, _mixed(grams ^ np.array(nodes, np.int64).view(np.uint64)[ref]), _mixed(grams))
            bucket = (by % np.uint64(shards)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, grams, ref = bucket[order], grams[order].view(np.int64), ref[order]
            buckets, first = np.unique(bucket, return_index=True)
            ends = np.append(first, len(bucket))
            used, place = np.unique(np.repeat(np.arange(len(buckets)), np.diff(ends)) * len(held) + ref, return_inverse=True)
            begin = np.searchsorted(used, np.arange(len(buckets)) * len(held))
            place -= np.repeat(begin, np.diff(ends))
            lists = lambda offsets, values, kind: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
            which, uses = used % len(held), np.append(begin, len(used))
            return pa.RecordBatch.from_arrays(
                [pa.array(buckets, pa.int32()), lists(ends, grams, pa.int64()), lists(ends, place, pa.int32()), lists(uses, np.array(nodes, np.int64)[which], pa.int64()), lists(uses, np.array(sizes, np.int32)[which], pa.int32())],
                ["bucket", "grams", "refs", "nodes", "sizes"],
            )

        held, nodes, sizes, size, seen = [], [], [], 0, set()
        for _, grams in _each(batches, words, seed):
            node = _names(grams, seed)[0]
            if not len(grams) or node in seen:
                continue
            seen.add(node)
            taken = grams[np.lexsort((grams, _levels(grams, table.value)))[: len(grams) - least_overlap(len(grams), alike) + 1]]
            held.append(taken)
            nodes.append(node)
            sizes.append(len(grams))
            size += len(taken)
            if size >= FLUSH_ENTRIES:
                yield flush()
                held, nodes, sizes, size = [], [], [], 0
        if held:
            yield flush()

    def columns(messages: list[tuple]) -> pa.RecordBatch:
        grams = np.concatenate([g for g, _, _, _ in messages])
        node, n = (np.concatenate([m[i][m[1]] for m in messages]) for i in (2, 3))
        order = np.lexsort((node, grams))
        grams, node, n = grams[order], node[order], n[order]
        new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (node[1:] != node[:-1])])
        grams, node, n = grams[new], node[new], n[new]
        first = np.concatenate([[True], grams[1:] != grams[:-1]])
        alone = first & np.append(first[1:], True) & (_levels(grams.view(np.uint64), table.value) == 0)
        return pa.RecordBatch.from_arrays([pa.array(grams[~alone]), pa.array(node[~alone]), pa.array(n[~alone], pa.int64())], ["gram", "node", "n"])

    def drop_single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, messages = None, []
        for batch in batches:
            for bucket, *row in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
                if bucket != last and messages:
                    yield columns(messages)
                    messages = []
                messages.append(tuple(x.values.to_numpy() for x in row))
                last = bucket
        if messages:
            yield columns(messages)

    return _texts(docs).mapInArrow(deal, _MESSAGE_DDL).repartition(shards, "bucket").sortWithinPartitions("bucket").mapInArrow(drop_single, "gram long, node long, n long")


def _sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, words: int, seed: int) -> DataFrame:
    """(node, grams) of the wanted nodes, each read from one document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, grams in _each(batches, words, seed):
            node = _names(grams, seed)[0]
            if node not in seen:
                seen.add(node)
                yield pa.RecordBatch.from_arrays([pa.array([node]), pa.ListArray.from_arrays([0, len(grams)], pa.array(grams.view(np.int64)))], ["node", "grams"])

    of = cut_lineage(rows.join(small(wanted), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("of")).select("of").distinct())
    found = written(_texts(docs).join(small(of), F.col("doc_id").eqNullSafe(F.col("of"))).select("doc_id", "text").mapInArrow(read, "node long, grams array<long>"))
    return found if found.groupBy("node").count().where("count > 1").isEmpty() else written(found.dropDuplicates(["node"]))


def _alike(pairs: DataFrame, sets: DataFrame, alike: int) -> DataFrame:
    """(a, b, overlap, union) of the pairs that are alike, by the overlap over all columns."""
    left, right = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    overlap = F.size(F.array_intersect("ga", "gb"))
    counted = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", overlap.alias("overlap"), (F.size("ga") + F.size("gb")).alias("both"))
    return counted.select("a", "b", F.col("overlap").cast("long").alias("overlap"), (F.col("both") - F.col("overlap")).cast("long").alias("union")).where(100 * F.col("overlap") >= alike * F.col("union"))


def _bounded(pairs: DataFrame, heads: DataFrame, alike: int) -> DataFrame:
    """The pairs whose overlap in the first block, with all that is left of a set, reaches the likeness. ``heads``: node, n, head."""
    left, right = (heads.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("head").alias(f"h{x}")) for x in "ab")
    return _reaching(pairs.join(left, "a").join(right, "b").withColumn("c", F.size(F.array_intersect("ha", "hb"))), alike)


def _reaching(overlaps: DataFrame, alike: int) -> DataFrame:
    left_over = F.greatest(*(F.ceil(F.col(n) * alike / 100) - 1 for n in ("na", "nb")))
    return overlaps.where((100 + alike) * (F.col("c") + left_over) >= alike * (F.col("na") + F.col("nb"))).select("a", "b")


def _sizes_allow(a: str, b: str, alike: int):
    return 100 * F.least(a, b) >= alike * F.greatest(a, b)


def _hub_pairs(live: DataFrame, alike: int, turn: int) -> DataFrame:
    """(a, b) of each set with the hub of each of its columns that hold several classes; ``live``: gram, node, n, label."""
    first = F.struct(F.xxhash64("node", F.lit(turn)).alias("o"), F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("label").alias("hub_label"))
    hubs = live.groupBy("gram").agg(F.min(first).alias("x"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("gram", "x.hub", "x.hub_n", "x.hub_label")
    met = live.join(hubs, "gram").where((F.col("label") != F.col("hub_label")) & _sizes_allow("n", "hub_n", alike))
    return met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _meeting(rows: np.ndarray, bits: np.ndarray, alike: int, once: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, apart) of the rows of a tile that are of different classes and that sizes and signatures let be alike, a few x at a time; ``once``: not the other way round as well."""
    i, j, own, node, n, label = rows
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    for at in range(0, len(left), 64):
        a, b = left[at : at + 64, None], right[None, :]
        meets = (label[a] != label[b]) & (100 * np.minimum(n[a], n[b]) >= alike * np.maximum(n[a], n[b]))
        if once and i[0] == j[0]:
            meets &= node[a] < node[b]
        x, y = np.nonzero(meets)
        x, y = left[at + x], right[y]
        apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
        near = apart <= most_apart(n[x] + n[y], alike)
        yield x[near], y[near], apart[near]


def _pair_batch(rows: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    _, _, _, node, n, _ = rows
    swap = node[x] > node[y]
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (node[x], node[y], n[x], n[y])], ["a", "b", "na", "nb"])


def _tile_pairs(live: DataFrame, signatures: DataFrame, alike: int, least: int, tile: int) -> DataFrame:
    """(a, b) of different classes whose overlap in the first block lets them be alike; columns of ``least`` sets or more are multiplied in tiles.

    ``signatures``: node, signature. A pair that they rule out is ruled out in every column, so the overlaps of the others are whole.
    """

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bits in _gathered(batches):
            for x, y, _ in _meeting(rows, bits, alike, True):
                yield _pair_batch(rows, x, y)

    overlaps = _tiles(live, signatures, least, tile).mapInArrow(multiply, "a long, b long, na long, nb long").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
    return _reaching(overlaps, alike)


def _nearest_pairs(live: DataFrame, signatures: DataFrame, alike: int, least: int, tile: int) -> DataFrame:
    """(a, b) of each set with the one of another class that, by its signature, is nearest in a tile: what these join needs no product any more."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[int, int]] = set()
        for rows, bits in _gathered(batches):
            for x, y, apart in _meeting(rows, bits, alike, False):
                order = np.lexsort((apart, x))
                first = order[np.flatnonzero(np.diff(x[order], prepend=-1))]
                new = [k for k, pair in zip(first.tolist(), zip(rows[3][x[first]].tolist(), rows[3][y[first]].tolist())) if pair not in told and not told.add(pair)]
                if new:
                    yield _pair_batch(rows, x[new], y[new])
            if len(told) > SEEN_PAIRS:
                told.clear()  # a pair may then come again

    return _tiles(live, signatures, least, tile).mapInArrow(meet, "a long, b long, na long, nb long").select("a", "b").distinct()


def _tiles(live: DataFrame, signatures: DataFrame, least: int, tile: int) -> DataFrame:
    """Columns of ``least`` sets or more that hold several classes, dealt in tiles (gram, i, j) of ``tile`` sets by as many."""
    columns = live.groupBy("gram").agg(F.count("*").alias("k"), F.min("label").alias("l0"), F.max("label").alias("l1")).where((F.col("l0") != F.col("l1")) & (F.col("k") >= least)).select("gram", F.ceil(F.col("k") / tile).alias("of"))
    rows = live.join(columns, "gram").join(signatures, "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("of")))
    dealt = rows.select("gram", "node", "n", "label", "signature", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)).alias("other"))
    dealt = dealt.select("gram", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "label", "signature")
    return dealt.repartition(shuffle_partitions(live.sparkSession), "gram", "i", "j").sortWithinPartitions("gram", "i", "j")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j, own, node, n, label) and the signatures of each tile."""

    def whole() -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([r for r, _ in held], axis=1)[1:], np.concatenate([b for _, b in held])

    last, held = None, []
    for batch in batches:
        columns = np.stack([c.to_numpy() for c in batch.columns[:7]])
        bits = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint64).reshape(columns.shape[1], -1)
        cuts = np.flatnonzero((columns[:3, 1:] != columns[:3, :-1]).any(axis=0)) + 1
        for first, end in zip([0, *cuts.tolist()], [*cuts.tolist(), columns.shape[1]]):
            if first == end:
                continue
            key = tuple(columns[:3, first])
            if key != last and held:
                yield whole()
                held = []
            held.append((columns[:, first:end], bits[first:end]))
            last = key
    if held:
        yield whole()


def search(docs: DataFrame, words: int, alike: int, hub_rounds: int, tile: int, nearest_rounds: int = 0, bits: int = SIGNATURE_BITS) -> tuple[DataFrame, DataFrame]:
    """The rows of ``scan`` for documents, and links (a, b, overlap, union): all between different sets, or, after hub or nearest rounds, enough to join each class."""
    for seed in itertools.count(42):
        scanned = written(scan(docs, words, seed, bits))
        rows = scanned.where("kind = 0")
        nodes = rows.groupBy("node").agg(F.min("twin").alias("t0"), F.max("twin").alias("t1"), F.min("n").alias("n0"), F.max("n").alias("n1"))
        if nodes.where("t0 <> t1 or n0 <> n1").isEmpty():  # else two sets have one node
            break
    entries = rows.agg(F.sum(F.col("n") - F.ceil(F.col("n") * alike / 100) + 1)).first()[0] or 0
    shards = max(shuffle_partitions(docs.sparkSession), -(-int(entries) // SHARD_ENTRIES))
    block = written(incidence(docs, words, seed, alike, _hot(scanned), shards))
    heads = written(block.groupBy("node").agg(F.first("n").alias("n"), F.collect_list("gram").alias("head")))  # of a set's own size at most
    sets, links, tested, live = None, None, None, block.withColumn("label", F.col("node"))

    def also(table: DataFrame | None, more: DataFrame) -> DataFrame:
        return more if table is None else table.unionByName(more)

    def test(pairs: DataFrame) -> None:
        """Counts the overlaps of pairs over all columns; sets that no pair before has needed are read now."""
        nonlocal sets, links, tested
        pairs = written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        wanted = pairs.select(F.col("a").alias("node")).distinct().unionByName(pairs.select(F.col("b").alias("node")).distinct()).distinct()
        wanted = cut_lineage(wanted if sets is None else wanted.join(sets.select("node"), "node", "left_anti"))
        if sets is None or not wanted.isEmpty():
            sets = also(sets, _sets(docs, rows, wanted, words, seed))
        tested, links = also(tested, pairs), also(links, written(_alike(pairs, sets, alike)))

    def merged() -> DataFrame:
        labels = cut_lineage(classes(links.select("a", "b")).withColumnRenamed("root", "label"))
        return block.join(small(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))

    for turn in range(hub_rounds):
        test(_bounded(_hub_pairs(live, alike, turn), heads, alike))
        live = merged()
    signatures = written(rows.groupBy("node").agg(F.first("signature").alias("signature")))
    least = 3 if hub_rounds else 2
    for _ in range(nearest_rounds):
        test(_bounded(_nearest_pairs(live, signatures, alike, least, tile), heads, alike))
        live = merged()
    test(_tile_pairs(live, signatures, alike, least, tile))
    return rows, links


def linked_pairs(docs: DataFrame, words: int = WORDS, alike: int = ALIKE, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, node, n_shingles) and every link (a, b, overlap, union) of different sets; documents of one node have equal sets."""
    rows, found = search(docs, words, alike, 0, tile)
    return rows.select("doc_id", "node", F.col("n").alias("n_shingles")), found


def jaccard_classes(docs: DataFrame, words: int = WORDS, alike: int = ALIKE, hub_rounds: int = HUB_ROUNDS, tile: int = TILE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text; other columns are ignored).

    Two documents link if their sets share ``alike`` of a hundred of what either holds; a class is all that links join, and
    is named by its smallest doc_id. Null, empty and blank texts have no n-gram and link with nothing, so their component is
    their own doc_id. Repeated rows and copies have one set and one class. A null doc_id stays null and names a class only if
    it has no other. An empty table stays empty.
    """
    rows, found = search(docs, words, alike, hub_rounds, tile)
    labels = classes(found.select("a", "b"))
    least = cut_lineage(rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")))
    linked = cut_lineage(least.join(small(labels), "node"))
    named = cut_lineage(linked.groupBy("root").agg(F.min("least").alias("component_id")))
    told = cut_lineage(linked.join(small(named), "root").select("node", "component_id"))
    alone = least.join(small(told.select("node")), "node", "left_anti").select("node", F.col("least").alias("component_id"))
    of = rows.join(small(cut_lineage(told.unionByName(alone))), "node", "left")
    return of.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - {WORDS - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')))) END AS s FROM words
), distinct_sets AS MATERIALIZED (
  SELECT min(doc_id) AS a, md5(array_to_string(s, chr(10))) AS key, any_value(s) AS s FROM sets WHERE len(s) > 0 GROUP BY 2
), grams AS MATERIALIZED (
  SELECT a, len(s) AS n, unnest(s) AS gram FROM distinct_sets
), links AS MATERIALIZED (
  SELECT x.a, y.a AS b FROM grams x JOIN grams y ON x.gram = y.gram AND x.a <> y.a GROUP BY x.a, y.a, x.n, y.n HAVING 100 * count(*) >= {ALIKE} * (x.n + y.n - count(*))
), reach AS (
  SELECT a, a AS b FROM distinct_sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), component AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id
FROM sets s LEFT JOIN distinct_sets d ON d.key = md5(array_to_string(s.s, chr(10))) AND len(s.s) > 0 LEFT JOIN component c ON c.a = d.a
"""
