"""Phrase collocations by PrefixSpan-style growth over contiguous words.

Texts are encoded once into blocks: a block's words are numbered and its pieces are one array of numbers. For each
word of a block that starts a phrase the block projects its occurrence pointers, that is the following words of its
piece; pointers to equal words are one entry with a weight. A task owns the whole projection of its prefixes and
extends them to the right, depth first, as long as they are frequent enough. A prefix of hot words only is dealt on by
the word after it, so no task gets more than a share of any prefix; its count is the sum of the tasks' counts.

Counts of phrases are then joined to the counts of the parts of every cut, in exact decimals.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from docloom.llm.once import written
from docloom.session import shuffle_partitions

MOST_WORDS = 3
LEAST = 10
TOP = 2000
SUBSUMED = 50  # of a hundred occurrences
SCALE = 1_000_000
BLOCK_TOKENS = 1 << 20
SHARD_TOKENS = 1 << 20
HOT_SHARE = 8  # a word is hot if it fills more than this part of a shard
HOT_WORDS = 50_000  # and no more words than this are
NO_LANG = "und"

_BREAKS = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"......... ")
_BLOCK = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("hashes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("codes", pa.binary()), ("starts", pa.int32())])
_BLOCK_DDL = "lang string, words array<string>, hashes array<long>, counts array<long>, codes binary, starts int"
_PROJECTION_DDL = "bucket int, lang string, words array<long>, context array<int>, weights array<int>"
_GROWN = pa.schema([("lang", pa.string()), ("key", pa.list_(pa.int64())), ("f", pa.int64())])


class _Numbers(dict):
    """Numbers words in the order in which they come; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def tokens(text: str) -> list[bytes]:
    """The words of a text, A to Z in lower case, with ``.`` between pieces."""
    return text.encode().lower().translate(_BREAKS).replace(b".", b" . ").split()


def _encoded(lang: str, words: list[bytes], starts: int, seed: int) -> pa.RecordBatch:
    numbers = _Numbers({b".": 0})
    codes = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
    counts = np.bincount(codes[:starts], minlength=len(numbers))
    known = list(numbers)[1:]
    hashes = np.fromiter((xxh64_intdigest(w, seed) for w in known), np.uint64, len(known)).view(np.int64)
    columns = [[lang], [pa.array(known, pa.binary()).cast(pa.string())], [hashes], [counts[1:]], [codes.tobytes()], [starts]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) if i != 1 else pa.ListArray.from_arrays([0, len(known)], c[0]) for i, (c, t) in enumerate(zip(columns, _BLOCK.types))], schema=_BLOCK)


def encode(docs: DataFrame, most_words: int = MOST_WORDS, seed: int = 42) -> DataFrame:
    """Blocks of encoded text. Only the first ``starts`` words of a block start a phrase; those behind end the last ones."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = tokens(text)
                for at in range(0, len(found), BLOCK_TOKENS) if len(found) > BLOCK_TOKENS else ():
                    yield _encoded(lang, found[at : at + BLOCK_TOKENS + most_words - 1], min(BLOCK_TOKENS, len(found) - at), seed)
                if len(found) <= BLOCK_TOKENS:
                    words = held.setdefault(lang, [])
                    words += found
                    words.append(b".")
                    size += len(found) + 1
                if size >= BLOCK_TOKENS:
                    yield from (_encoded(x, words, len(words), seed) for x, words in held.items())
                    held, size = {}, 0
        yield from (_encoded(x, words, len(words), seed) for x, words in held.items())

    return rows.mapInArrow(read, _BLOCK_DDL)


def project(codes: np.ndarray, starts: int, most_words: int) -> tuple[np.ndarray, np.ndarray]:
    """What the occurrence pointers of a block point to: distinct (word, words after it in the piece), and their weights."""
    padded = np.concatenate([codes, np.zeros(most_words - 1, codes.dtype)]).astype(np.int64)
    context = np.stack([padded[j : j + starts] for j in range(most_words)], axis=1)
    context = context[(context[:, 0] > 0) & (context[:, 1] > 0)]
    for j in range(2, most_words):
        context[:, j] *= context[:, j - 1] > 0
    if not len(context):
        return context, np.zeros(0, np.int64)
    bits = int(context.max()).bit_length()
    if bits * most_words < 64:
        packed = np.zeros(len(context), np.int64)
        for j in range(most_words):
            packed = packed << bits | context[:, j]
        distinct, weights = np.unique(packed, return_counts=True)
        return np.stack([distinct >> bits * (most_words - 1 - j) & (1 << bits) - 1 for j in range(most_words)], axis=1), weights
    return np.unique(context, axis=0, return_counts=True)


def _dealt(context: np.ndarray, hashes: np.ndarray, splits: np.ndarray, lang: str) -> np.ndarray:
    """A hash of what an entry is dealt by: its first word, or its leading hot words and a share of the word after them."""
    width = context.shape[1]
    lead = np.minimum((splits[context] > 1).cumprod(axis=1).sum(axis=1), width - 1)
    share = np.full(len(context), np.iinfo(np.int64).max)
    deal = np.full(len(context), xxh64_intdigest(lang.encode()), np.uint64)
    for j in range(width):
        word = hashes[context[:, j]]
        taken = np.where((lead > j) | (j == 0), word, np.where(lead == j, word % share.astype(np.uint64), 0).astype(np.uint64))
        share = np.where(lead > j, np.minimum(share, splits[context[:, j]]), share)
        deal = (deal ^ taken) * np.uint64(0x9E3779B97F4A7C15)
        deal ^= deal >> np.uint64(29)
    return deal


def grow(context: np.ndarray, weights: np.ndarray, hot: np.ndarray, least: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Frequent phrases and their counts by depth-first growth; phrases of hot words only come with any count, as it is a part.

    ``context``: a row of word numbers for each pointer, 0 behind its piece; ``hot``: whether a number is a hot word's.
    """
    stack = [((), np.arange(len(context)), True)]
    while stack:
        prefix, at, of_hot = stack.pop()
        word = context[at, len(prefix)]
        order = np.argsort(word, kind="stable")
        word, at = word[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        total = np.add.reduceat(weights[at], first)
        next_word = word[first]
        in_part = hot[next_word] & of_hot
        ends = np.append(first[1:], len(at))
        for i in np.flatnonzero((next_word > 0) & ((total >= least) | in_part)).tolist():
            longer = (*prefix, int(next_word[i]))
            if prefix:
                yield longer, int(total[i])
            if len(longer) < context.shape[1]:
                stack.append((longer, at[first[i] : ends[i]], bool(in_part[i])))


def count_phrases(blocks: DataFrame, words: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(lang, key, f) of phrases of 2 to ``most_words`` words found ``least`` times or more; a key lists hashes of words."""
    spark = blocks.sparkSession
    total = words.agg(F.sum("f")).first()[0] or 0
    shards = max(shuffle_partitions(spark), -(-total // shard_tokens))
    limit = max(1, least, total // shards // HOT_SHARE, total // HOT_WORDS)
    hot: dict[str, tuple] = {}
    for r in words.where(F.col("f") > limit).select("lang", "h", "f").orderBy("lang", F.col("h")).collect():  # at most HOT_WORDS
        hot.setdefault(r.lang, ([], []))[0].append(r.h)
        hot[r.lang][1].append(-(-r.f // limit))
    told = spark.sparkContext.broadcast({lang: (np.array(h, np.int64), np.array(s, np.int64)) for lang, (h, s) in hot.items()})

    def splits_of(lang: str, hashes: np.ndarray) -> np.ndarray:
        known, split = told.value.get(lang, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        if not len(known):
            return np.ones(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return np.where(known[at] == hashes, split[at], 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, hashes, codes, starts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3).to_pylist()):
                hashes = np.concatenate([[0], hashes.values.to_numpy()])
                context, weights = project(np.frombuffer(codes.as_buffer(), np.int32), starts, most_words)
                splits = splits_of(lang, hashes)
                splits[0] = 1
                bucket = (_dealt(context, hashes.view(np.uint64), splits, lang) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bucket, context, weights = bucket[order], context[order], weights[order]
                buckets, first = np.unique(bucket, return_index=True)
                if not len(buckets):
                    continue
                # every bucket gets the words that its entries use, and entries refer to those
                rank = np.repeat(np.arange(len(buckets)), np.diff(np.append(first, len(bucket))))
                used, place = np.unique((rank[:, None] * len(hashes) + context).ravel(), return_inverse=True)
                begin = np.searchsorted(used, np.arange(len(buckets)) * len(hashes))
                place = place.reshape(context.shape) - begin[rank][:, None]
                lists = lambda offsets, values, kind: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
                ends = np.append(first, len(bucket))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(buckets, pa.int32()),
                        pa.array([lang] * len(buckets)),
                        lists(np.append(begin, len(used)), hashes[used % len(hashes)], pa.int64()),
                        lists(ends * most_words, place.ravel(), pa.int32()),
                        lists(ends, weights, pa.int32()),
                    ],
                    ["bucket", "lang", "words", "context", "weights"],
                )

    def grown(lang: str, rows: list[tuple]) -> pa.RecordBatch:
        hashes = np.unique(np.concatenate([[0], *(words for words, _, _ in rows)]))
        none = np.searchsorted(hashes, 0)
        # the end of a piece takes number 0
        number = np.arange(len(hashes))
        number[: none + 1] = np.roll(number[: none + 1], -1)
        by_number = np.empty_like(hashes)
        by_number[number] = hashes
        context = np.concatenate([number[np.searchsorted(hashes, words)][refs].reshape(-1, most_words) for words, refs, _ in rows])
        found = list(grow(context, np.concatenate([w for _, _, w in rows]).astype(np.int64), splits_of(lang, by_number) > 1, least))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array([by_number[list(k)].tolist() for k, _ in found], _GROWN.types[1]), pa.array([f for _, f in found], pa.int64())], schema=_GROWN)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bucket's languages in turn; rows come sorted by both."""
        last, rows = None, []
        for batch in batches:
            bucket, langs, words, refs, weights = batch.columns
            for key, *row in zip(zip(bucket.to_pylist(), langs.to_pylist()), words, refs, weights):
                if key != last and rows:
                    yield grown(last[1], rows)
                    rows = []
                rows.append(tuple(x.values.to_numpy() for x in row))
                last = key
        if rows:
            yield grown(last[1], rows)

    projected = blocks.select("lang", "hashes", "codes", "starts").mapInArrow(deal, _PROJECTION_DDL)
    parts = projected.repartition(shards, "bucket").sortWithinPartitions("bucket", "lang").mapInArrow(search, "lang string, key array<long>, f long")
    return parts.groupBy("lang", "key").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def collocations(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST, top: int = TOP, subsumed: int = SUBSUMED, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``top`` phrases of 2 to ``most_words`` words.

    ``docs``: lang, text; other columns are ignored. A null lang is ``und``, a null text is empty and gives nothing.
    Phrases lie within pieces, are found at least ``least`` times and are scored by their weakest cut. A phrase goes if a
    longer frequent one that holds it has at least ``subsumed`` of a hundred of its occurrences. Ties go by count, then
    by phrase in byte order. Repeated rows count each. An empty table gives an empty table.

    Words are known by 64-bit hashes of a seed under which no two words of a language meet.
    """
    for seed in itertools.count(42):
        blocks = written(encode(docs, most_words, seed))
        each = blocks.select("lang", F.inline(F.arrays_zip("words", "hashes", "counts")))
        words = written(each.groupBy("lang", F.col("words").alias("word"), F.col("hashes").alias("h")).agg(F.sum("counts").alias("f")).where("f > 0"))
        if words.groupBy("lang", "h").count().where("count > 1 or h = 0").isEmpty():
            break
    phrases = written(count_phrases(blocks, words, most_words, least, shard_tokens))
    counts = phrases.unionByName(words.where(F.col("f") >= least).select("lang", F.array("h").alias("key"), "f"))
    cuts = phrases.select("lang", "key", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("key") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.slice("key", 1, F.col("k")), "rest": F.slice("key", F.col("k") + 1, F.size("key") - F.col("k"))})
    left, right = counts.select("lang", F.col("key").alias("first"), F.col("f").alias("l")), counts.select("lang", F.col("key").alias("rest"), F.col("f").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    both = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumns({"over": F.lit(SCALE).cast("decimal(7,0)") * (wide("a") * wide("a")), "under": wide("l") * wide("r")})
    weakest = both.groupBy("lang", "key", "a").agg(F.min(F.struct(F.expr("over div under").alias("score"), "k", "l", "r")).alias("x")).select("lang", "key", "a", "x.score", "x.l", "x.r")
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.size("key") - 1), lambda w: F.transform(F.sequence(F.lit(1), F.size("key") - w + 1), lambda i: F.slice("key", i, w))))
    longer = phrases.where(F.size("key") > 2).select("lang", F.explode(parts).alias("key"), "f").groupBy("lang", "key").agg(F.max("f").alias("longer"))
    kept = weakest.join(longer, ["lang", "key"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < subsumed * F.col("a"))).drop("longer")
    for i in range(1, most_words + 1):
        named = words.select("lang", F.col("h").alias(f"h{i}"), F.col("word").alias(f"word{i}"))
        kept = kept.withColumn(f"h{i}", F.get("key", F.lit(i - 1))).join(named, ["lang", f"h{i}"], "left").drop(f"h{i}")
    kept = kept.withColumn("phrase", F.concat_ws(" ", *(f"word{i}" for i in range(1, most_words + 1))))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = kept.withColumn("rank", rank).where(F.col("rank") <= top)
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(F.broadcast(n), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = rf"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (
  SELECT lang, unnest(p) AS piece FROM (SELECT lang, regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]') AS p FROM texts)
), found AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, list_slice(w, i, i + m - 1) AS key FROM (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM found, (VALUES (1), (2), (3)) sizes(m) WHERE len(w) >= m)
), counts AS MATERIALIZED (
  SELECT lang, array_to_string(key, ' ') AS phrase, any_value(key) AS key, count(*) AS f FROM grams GROUP BY 1, 2
), phrases AS MATERIALIZED (
  SELECT lang, key, f AS a FROM counts WHERE len(key) > 1 AND f >= {LEAST}
), parted AS MATERIALIZED (
  SELECT lang, key, a, k, array_to_string(key[:k], ' ') AS head, array_to_string(key[k + 1:], ' ') AS tail FROM (SELECT *, unnest(generate_series(1, len(key) - 1)) AS k FROM phrases)
), cuts AS (
  SELECT p.lang, p.key, a, k, x.f AS l, y.f AS r, ({SCALE}::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM parted p JOIN counts x ON x.lang = p.lang AND x.phrase = head JOIN counts y ON y.lang = p.lang AND y.phrase = tail
), weakest AS MATERIALIZED (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, key ORDER BY score, k) = 1
), inside AS (
  SELECT lang, part, max(a) AS longer FROM (SELECT lang, unnest([key[1:2], key[2:3]]) AS part, a FROM phrases WHERE len(key) = 3) GROUP BY ALL
), kept AS (
  SELECT w.*, array_to_string(key, ' ') AS phrase FROM weakest w LEFT JOIN inside i ON i.lang = w.lang AND i.part = w.key WHERE longer IS NULL OR 100 * longer < {SUBSUMED} * a
), sizes AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE len(key) = 1 GROUP BY lang
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN sizes USING (lang) QUALIFY rank <= {TOP}
"""
