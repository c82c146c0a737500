"""SimHash near-duplicates by vantage-point trees over Hamming distance.

A border of four bits is wide in a space of 64: any shard would be visited by a large share of all rows. Fingerprints
are therefore searched by parts (``search_parts``): of four parts, the first allows one differing bit and the others
none, as two fingerprints that differ in more than that in every part differ in five bits or more. For each part, the
upper levels of a vantage-point tree are grown on a bounded sample and part all distinct fingerprints by the distance of
that part to a vantage point. What lies outside a radius, but within the allowed bits of it, visits the inner side as
well, and a visitor goes wherever the triangle bound lets a partner be: that is enough to find every pair that crosses a
boundary, and all else is pruned. Each leaf is a shard of a shuffle and grows the tree's lower levels itself, first over
the part, then over all 64 bits; only pairs within ``max_bits`` of the whole are linked. A leaf of more than
``shard_rows`` rows is cut into tiles of a block of its own rows and a block of its visitors, so that no task holds more.
Tasks report star-shaped links, no more than one for each fingerprint a block looked at, never all pairs of a group;
classes are found by contracting the link graph.

``deduplicate`` keeps one text of each class of texts alike by ``ALIKE`` of a hundred of their sets of ``SHINGLE`` words. Edits move
fingerprints of short texts beyond any narrow border, so its links come from the exact join of the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from xxhash import xxh64_intdigest

from docloom.llm import ngram_join
from docloom.llm.graph import classes, small
from docloom.llm.once import written
from docloom.session import cut_lineage, shuffle_partitions

WORDS = 4
MAX_BITS = 4
SEED = 42
SAMPLE = 20_000
SHARD_ROWS = 65_536
LEAF = 128
SHINGLE, ALIKE = 5, 80  # of a hundred
NEAREST_ROUNDS = 1
SIGNATURE_BITS = 4096  # below a likeness of 80, 1,024 rule out nothing beyond sets of some 2,300
VANTAGES = 8
NARROW = 13  # bits of a part that allows less than the widest: the wider the others, the fewer rows lie at their borders
_CHUNK = 1 << 16
_AREA = 1 << 21
_ALL = np.uint64((1 << 64) - 1)
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Hashes of a text's word shingles, repeats included (of the whole sequence, if shorter)."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    starts = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)])
    ends = (starts + sizes)[min(words, len(found)) - 1 :].tolist()
    hashes = (xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends))
    return np.fromiter(hashes, np.dtype("<u8"), len(ends))


def _majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes, as a signed number; 0 if there are none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = np.ascontiguousarray(hashes[at : at + _CHUNK])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > max(1, len(hashes)), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit fingerprint of a text's word shingles as a signed number; 0 if it has no word."""
    return _majority(_shingle_hashes(text, words))


@F.pandas_udf(LongType())
def _fingerprints(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, widths in batches:
        yield pd.Series([fingerprint(t, w) for t, w in zip(texts, widths)], dtype="int64")


def fingerprints(docs: DataFrame, words: int = WORDS):
    """The fingerprint column of ``docs.text``."""
    return _fingerprints(docs["text"].cast("string"), F.lit(words))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints (rows of 64-bit words), one by one or each with each."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _star(own: np.ndarray, own_ids: np.ndarray, others: np.ndarray, other_ids: np.ndarray, max_bits: int) -> Iterator[np.ndarray]:
    """Links (2 x n) of ids that join what lies within ``max_bits`` of a member of ``own``, block by block."""
    every, ids = np.concatenate([own, others]), np.concatenate([own_ids, other_ids])
    step = max(1, min(LEAF, _AREA // max(1, len(every))))
    for at in range(0, len(own), step):
        rows = own[at : at + step]
        away = np.zeros((len(rows), len(every)), np.uint8)
        for word in range(own.shape[1]):
            away += np.bitwise_count(rows[:, word, None] ^ every[None, :, word])
        near = away <= max_bits
        if near.sum() == len(rows):  # each row meets only itself
            continue
        label = np.arange(len(rows))
        while True:
            by_column = np.where(near, label[:, None], len(rows)).min(0)
            again = np.where(near, by_column[None, :], len(rows)).min(1)
            if (again == label).all():
                break
            label = again
        met = np.flatnonzero(by_column < len(rows))
        roots = own_ids[at : at + step][by_column[met]]
        apart = ids[met] != roots
        yield np.stack([ids[met][apart], roots[apart]])


def search_parts(max_bits: int) -> list[tuple[np.uint64, int]]:
    """(mask, allowed bits) of the parts of a fingerprint: what lies within ``max_bits`` is within what one of them allows.

    The allowed bits and one, summed over the parts, are more than ``max_bits``. A part that allows more is wider.
    """
    base, more = divmod(max_bits + 1, 4)
    allowed = [a for a in (base - (at >= more) for at in range(4)) if a >= 0]
    wide = more if 0 < more < len(allowed) else len(allowed)
    narrow = NARROW if wide < len(allowed) else 0
    room = 64 - narrow * (len(allowed) - wide)
    widths = [room // wide + (at < room % wide) for at in range(wide)] + [narrow] * (len(allowed) - wide)
    ends = np.cumsum(widths).tolist()
    return [(np.uint64(((1 << width) - 1) << (end - width)), bits) for end, width, bits in zip(ends, widths, allowed)]


def parted(fps: np.ndarray, max_bits: int) -> tuple[np.uint64, int] | None:
    """A vantage point and a radius that part the fingerprints with the fewest near the border; none if all are equally far.

    Of ``VANTAGES`` points and the radii that leave a quarter on either side, judged by at most 2,048 fingerprints.
    """
    judged = fps[:: max(1, len(fps) // 2048)]
    vantages = fps[:: max(1, len(fps) // VANTAGES)][:VANTAGES]
    within = np.stack([np.cumsum(np.bincount(np.bitwise_count(judged ^ v), minlength=65)) for v in vantages]) / len(judged)
    inner = within[:, :64]
    border = within[:, np.minimum(np.arange(64) + max_bits, 64)] - inner
    cost = np.where((inner >= 0.25) & (inner <= 0.75), 0, 4) + border + abs(inner - 0.5) / 1024
    cost[(inner <= 0) | (inner >= 1)] = np.inf
    at, radius = np.unravel_index(cost.argmin(), cost.shape)
    return (vantages[at], int(radius)) if np.isfinite(cost[at, radius]) else None


def tree_links(
    own: np.ndarray, visitors: np.ndarray, max_bits: int = MAX_BITS, leaf: int = LEAF, seen: dict | None = None, part: tuple[np.uint64, int] | None = None
) -> Iterator[np.ndarray]:
    """Links of distinct 64-bit fingerprints: own with own and own with visitors, by a vantage-point tree.

    With a ``part`` (mask, allowed bits), its distances split first and those of all bits only what the part can't split;
    pairs that are farther apart in the part may then be missing. ``seen`` counts the splits made and the visits
    pruned by the triangle bound.
    """
    levels = [*([part] if part else []), (_ALL, max_bits)]
    stack = [(own, visitors, 0)]
    while stack:
        own, visitors, level = stack.pop()
        split = None
        while split is None and len(own) > leaf and level < len(levels):
            mask, bits = levels[level]
            split = parted(own & mask, bits)
            level += split is None
        if split is None:
            if len(own):
                yield from _star(own[:, None], own, visitors[:, None], visitors, max_bits)
            continue
        vantage, radius = split
        far, far_v = np.bitwise_count((own & mask) ^ vantage), np.bitwise_count((visitors & mask) ^ vantage)
        inner, near_border = far <= radius, far <= radius + bits
        to_inner, to_outer = far_v <= radius + bits, far_v + bits > radius
        if seen is not None:
            seen["splits"] = seen.get("splits", 0) + 1
            seen["pruned"] = seen.get("pruned", 0) + int((~near_border).sum() + (~to_inner).sum() + (~to_outer).sum())
        stack.append((own[inner], np.concatenate([visitors[to_inner], own[~inner & near_border]]), level))
        stack.append((own[~inner], visitors[to_outer], level))


def upper_tree(sample: np.ndarray, most: int, max_bits: int = MAX_BITS) -> list[tuple[int, int, int, int]]:
    """Upper levels over a sample: nodes (vantage, radius, inner, outer), the root last; a leaf is a negative number."""
    nodes: list[tuple[int, int, int, int]] = []
    leaves = 0

    def build(fps: np.ndarray) -> int:
        nonlocal leaves
        split = parted(fps, max_bits) if len(fps) > most else None
        if split is None:
            leaves += 1
            return -leaves
        vantage, radius = split
        inner = distances(fps[:, None], vantage) <= radius
        at = build(fps[inner]), build(fps[~inner])
        nodes.append((int(vantage), radius, *at))
        return len(nodes) - 1

    build(sample)
    return nodes


def placed(fps: np.ndarray, nodes: list[tuple[int, int, int, int]], max_bits: int, mask: np.uint64 = _ALL) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, fingerprints, own) of every leaf that fingerprints live in or have to visit; distances are those of the mask's bits."""
    stack = [(len(nodes) - 1 if nodes else -1, fps, np.ones(len(fps), bool))]
    while stack:
        at, rows, own = stack.pop()
        if not len(rows):
            continue
        if at < 0:
            yield -at - 1, rows, own
            continue
        vantage, radius, inner, outer = nodes[at]
        far = np.bitwise_count((rows & mask) ^ np.uint64(vantage))
        home = far <= radius
        goes_in, goes_out = far <= radius + max_bits, np.where(own, ~home, far + max_bits > radius)
        stack.append((inner, rows[goes_in], (own & home)[goes_in]))
        stack.append((outer, rows[goes_out], own[goes_out]))


def tiled(shard: int, fps: np.ndarray, own: np.ndarray, blocks: tuple[int, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(key, fingerprints, own) of the tiles of a shard that is cut into ``blocks`` of own rows and of visitors.

    A tile (i, j) holds block i of the own rows and, for j other than i, block j of the others: own blocks after i,
    then the blocks of visitors. Every own row so meets every other row of its shard.
    """
    own_blocks, visitor_blocks = blocks
    mixed = ((fps * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64)
    block = np.where(own, mixed % own_blocks, own_blocks + mixed % max(1, visitor_blocks))
    for j in np.unique(block):
        rows = fps[block == j]
        mine = [(j, at) for at in range(j, own_blocks + visitor_blocks)] if j < own_blocks else []
        for i, at in mine:
            yield shard << 32 | int(i) << 16 | at, rows, np.ones(len(rows), bool)
        for i in range(min(j, own_blocks)):
            yield shard << 32 | i << 16 | int(j), rows, np.zeros(len(rows), bool)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of each shard of batches that come sorted by their first column."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = columns if rest is None else [np.concatenate(pair) for pair in zip(rest, columns)]
        cuts = np.flatnonzero(np.diff(held[0])) + 1
        parts = list(zip(*(np.split(x, cuts) for x in held)))
        yield from parts[:-1]  # the last shard may go on in the next batch
        rest = list(parts[-1])
    if rest is not None:
        yield rest


def _link_batch(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if parts:
        a, b = np.concatenate(parts, axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=_LINK)


def links(fps: DataFrame, max_bits: int = MAX_BITS, shard_rows: int = SHARD_ROWS, leaf: int = LEAF) -> DataFrame:
    """Distinct links (a, b) whose graph joins exactly the fingerprints that ``max_bits`` or fewer bits join.

    ``fps``: distinct fingerprints in column fp. Two are linked here if a chain of near pairs joins them;
    not every near pair has a row of its own. Shards hold about ``shard_rows`` fingerprints of their own; those that
    turn out larger, or have more visitors, are cut into tiles.
    """
    tasks = shuffle_partitions(fps.sparkSession)
    total = fps.count()
    share = max(1, -(-total // SAMPLE))
    sample = np.sort(np.array([r.fp for r in fps.where(F.pmod(F.xxhash64("fp"), F.lit(share)) == 0).collect()], np.int64)).view(np.uint64)
    sample = np.random.default_rng(SEED).permutation(sample)
    parts = search_parts(max_bits)
    trees = [upper_tree(sample & mask, max(8, shard_rows // share), bits) for mask, bits in parts]

    def shards(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for tree, (nodes, (mask, bits)) in enumerate(zip(trees, parts)):
            for shard, rows, own in placed(batch.column(0).to_numpy().view(np.uint64), nodes, bits, mask):
                yield shard << 2 | tree, rows, own

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, rows, own in shards(batch):
                sizes[shard] = sizes.get(shard, 0) + np.array([own.sum(), len(rows) - own.sum()])
        if sizes:
            mine, others = np.stack(list(sizes.values()), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(list(sizes), pa.int64()), pa.array(mine), pa.array(others)], ["shard", "mine", "others"])

    rows = fps.select("fp")
    sizes = rows.mapInArrow(counted, "shard long, mine long, others long").groupBy("shard").agg(F.sum("mine").alias("mine"), F.sum("others").alias("others"))
    large = sizes.where(F.greatest("mine", "others") > shard_rows).collect()  # no more rows than the trees have leaves, which the sample bounds
    cuts = {r.shard: (max(1, -(-r.mine // shard_rows)), -(-r.others // shard_rows)) for r in large}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, rows, own in shards(batch):
                tiles = tiled(shard, rows, own, cuts[shard]) if shard in cuts else [(shard << 32, rows, own)]
                for key, held, mine in tiles:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), key, np.int64)), pa.array(held.view(np.int64)), pa.array(mine)], ["shard", "fp", "own"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp, own in _by_shard(batches):
            fp, own = fp.view(np.uint64), own.astype(bool)
            yield from _link_batch(list(tree_links(fp[own], fp[~own], max_bits, leaf, part=parts[int(key[0]) >> 32 & 3])))

    dealt = rows.mapInArrow(place, "shard long, fp long, own boolean").repartition(tasks, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(search, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, fp, root, component_id) of each row of ``docs`` (doc_id, text; other columns are ignored).

    ``fp`` is the signed fingerprint, ``root`` names the class of fingerprints and ``component_id`` is the
    smallest doc_id in it. Null, empty and blank texts have fingerprint zero and are linked by it like any
    other. Repeated rows and copies share a fingerprint and so a class. A null doc_id stays null and never
    names a class that has another; a class of null ids alone has a null id. An empty table stays empty.
    """
    prints = cut_lineage(docs.select(F.col("doc_id").cast("long"), fingerprints(docs, words).alias("fp")))
    fps = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = classes(links(fps.select("fp"), max_bits, shard_rows)).withColumnRenamed("node", "fp")
    # only classes of several fingerprints are looked up by root
    linked = cut_lineage(fps.join(small(labels), "fp"))
    named = cut_lineage(linked.groupBy("root").agg(F.min("least").alias("component_id")))
    told = linked.join(small(named), "root").select("fp", "root", "component_id")
    alone = fps.join(small(labels), "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    return prints.join(small(cut_lineage(told.unionByName(alone))), "fp").select("doc_id", "fp", "root", "component_id")


def deduplicate(docs: DataFrame, hub_rounds: int = ngram_join.HUB_ROUNDS, tile: int = ngram_join.TILE, nearest_rounds: int = NEAREST_ROUNDS) -> DataFrame:
    """``docs`` with one row of each class of near duplicates, all columns as they were.

    Two texts are alike if their sets of ``SHINGLE``-word shingles share ``ALIKE`` of a hundred of what either holds; texts of fewer
    words are one shingle, and texts without words are all alike. Classes are joined by chains of alike texts, all of which the
    exact n-gram join finds. The row of a class's smallest doc_id stays; null ids come after all others, and of repeated rows one stays.
    An empty table stays empty.
    """
    names = docs.columns
    kept = [F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(names)]
    rows = ngram_join.keyed(docs.select(*kept, "doc_id", "text"), [f"__{i}" for i in range(len(names))])
    scanned, found = ngram_join.search(docs, SHINGLE, ALIKE, hub_rounds, tile, nearest_rounds, SIGNATURE_BITS)
    key = ["doc_id", "t"]
    prints = scanned.select(*key, "node")
    order = F.struct(F.col("doc_id").isNull().alias("none"), *key, "node")
    firsts = written(prints.groupBy("node").agg(F.min(order).alias("x")))  # of texts of one set, those without words included
    grouped = cut_lineage(firsts.join(small(classes(found.select("a", "b"))), "node").select("root", "x"))
    stays = cut_lineage(grouped.groupBy("root").agg(F.min("x").alias("x")).select("x.node"))
    dropped = cut_lineage(grouped.select("x.node").join(small(stays), "node", "left_anti"))
    # a row stays if it is the first of its set and that set is kept
    kept_keys = firsts.join(small(dropped), "node", "left_anti").select("x.doc_id", "x.t")
    goes = cut_lineage(prints.select(*key).distinct().join(kept_keys, (prints["t"] == kept_keys["t"]) & prints["doc_id"].eqNullSafe(kept_keys["doc_id"]), "left_anti"))
    again = cut_lineage(prints.groupBy(*key).count().where("count > 1").select(*key))

    def by_key(table: DataFrame) -> tuple[DataFrame, Column]:
        named = table.withColumnsRenamed({c: f"__k_{c}" for c in key})
        return small(named), F.col("t").eqNullSafe(F.col("__k_t")) & F.col("doc_id").eqNullSafe(F.col("__k_doc_id"))

    gone, same = by_key(goes)
    left = rows.join(gone, same, "left_anti")
    if not again.isEmpty():
        repeated, same = by_key(again)
        left = left.join(repeated, same, "left_anti").unionByName(left.join(repeated, same, "left_semi").dropDuplicates(key))
    return left.select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(names)))


def hex_digits(fp):
    """A fingerprint column as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
