"""Language-model scoring over Elias-Fano n-gram tries.

The model predicts a word from the two words before it; every word that occurs is a history of its own, and every
n-gram of the training rows is counted. With c for training counts and N for all training tokens,

    p1(w) = (1 - UNSEEN) c(w) / N                 or, never seen, UNSEEN / N (as many unseen types as tokens)
    p2(w | h) = (1 - a) p1(w) + a c(h w) / c(h),          a = SHARE2 c(h) / (c(h) + HALF)
    p3(w | g h) = (1 - b) p2(w | h) + b c(g h w) / c(g h),  b = SHARE3 c(g h) / (c(g h) + HALF)

Two exchanges bring the counts together. The first deals the n-grams of all texts, training and held-out alike, by
their last word w, those of a frequent w spread by the word before it, so that no shard gets a hot word whole; there c(h w) and
c(g h w) are complete, and c(w) of a rare word. A frequent word's own count is broadcast. A pair far more common than
others comes from each batch as distinct n-grams with their counts. The second exchange brings the answers back to
the texts, where c(h) and c(g h) are the answers one place before: a word's own count, and its pair's. Frequent words
travel as short numbers. That is all the frequent words are for: the rest are told apart by 64-bit hashes, and none is
left out.

Each shard keeps its training n-grams, last word first, as a trie whose levels hold quantised logarithms of the
n-grams' probabilities. Children are monotone Elias-Fano sequences relative to their parent, found through
Elias-Fano pointers and a successor search between them. All arrays of a trie lie in one memory map. Answers are
smoothed where they meet.
"""

from __future__ import annotations

import mmap
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from docloom.session import cut_lineage, shuffle_partitions

HEAD, HEAD_WORD_BYTES = 250_000, 64
FREQUENT = 10_000_000  # words of at least one in so many tokens travel as numbers
FLUSH_WORDS = 500_000
END, TAIL = 0, (1 << 24) - 1
SHARE2, SHARE3, HALF = 0.2, 0.1, 1.0
UNSEEN = 0.05
FLUSH_TOKENS = 2_000_000
FLUSH_DOCS = 60_000
HOT = 4  # so many times a shard's mean share of a batch, and n-grams are made distinct first
CHUNKS = 32  # a word with more than one in so many of a shard's mean tokens is spread
PARTS = 4  # shards a task works through, one at a time
TRAIN_OF, HELD_OUT = 10, 0
_STEP = 20.0 / 65_535  # of a log10 probability's code
_NONE = 65_535


class EliasFano:
    """A monotone sequence of unsigned numbers: low bits side by side, high bits in unary with a rank directory."""

    def __init__(self, n: int, low_bits: int, arrays: dict[str, np.ndarray]):
        self.n, self.low_bits, self.arrays = n, low_bits, arrays

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        most = int(values[-1]) if n else 0
        low_bits = min(56, max(0, (most // max(n, 1)).bit_length() - 1))
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") if low_bits else np.zeros(0, np.uint8)
        high = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        size = n + (most >> low_bits) + 1
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[high] = 1
        words = np.packbits(bits, bitorder="little").view("<u8")
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        return cls(n, low_bits, {"low": np.concatenate([low, np.zeros(8, np.uint8)]), "words": words, "ranks": ranks})

    def _select(self, i: np.ndarray, ones: bool) -> np.ndarray:
        """Positions of the i-th (from 0) one or zero bits."""
        ranks = self.arrays["ranks"]
        before = ranks if ones else np.arange(len(ranks)) * 64 - ranks
        word = np.searchsorted(before, i, side="right") - 1
        bits = self.arrays["words"][word]
        if not ones:
            bits = ~bits
        left = i - before[word]
        at = np.zeros(len(i), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            inside = np.bitwise_count(bits & np.uint64((1 << width) - 1)).astype(np.int64)
            over = left >= inside
            left = np.where(over, left - inside, left)
            at = np.where(over, at + width, at)
            bits = np.where(over, bits >> np.uint64(width), bits)
        return word * 64 + at

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low_bits
        window = self.arrays["low"][(bit >> 3)[:, None] + np.arange(8)]
        return (np.ascontiguousarray(window).view("<u8")[:, 0] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, True) - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def successor(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The first place in [low, high) whose value is ``x`` or more, else ``high``."""
        bucket = (x >> np.uint64(self.low_bits)).astype(np.int64)
        last = len(self.arrays["words"]) * 64 - self.n - 1
        inside = np.minimum(bucket, last)
        start = np.where(inside > 0, self._select(np.maximum(inside - 1, 0), False) - np.maximum(inside - 1, 0), 0)
        stop = self._select(inside, False) - inside
        a = np.clip(np.where(bucket > last, self.n, start), low, high)
        b = np.clip(np.where(bucket > last, self.n, stop), low, high)
        rest = x & np.uint64((1 << self.low_bits) - 1)
        while True:
            open_ = np.flatnonzero(a < b)
            if not len(open_):
                return a
            middle = (a[open_] + b[open_]) >> 1
            less = self._low(middle) < rest[open_]
            a[open_] = np.where(less, middle + 1, a[open_])
            b[open_] = np.where(less, b[open_], middle)


def _children(parent: np.ndarray, values: np.ndarray, n_parents: int) -> tuple[np.ndarray, np.ndarray]:
    """Pointers to each parent's children, and the children as a monotone sequence: each range goes on from the last."""
    pointers = np.searchsorted(parent, np.arange(n_parents + 1))
    last = values[pointers[1:] - 1].astype(np.uint64)
    bases = np.concatenate([np.zeros(1, np.uint64), np.cumsum(last)[:-1]]) if n_parents else np.zeros(0, np.uint64)
    return pointers, values.astype(np.uint64) + bases[parent]


def weight(total: np.ndarray, share: float) -> np.ndarray:
    """How much of the probability behind a history comes from that history's own counts."""
    return share * total / (total + HALF)


def coded(logs: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-logs / _STEP), 0, _NONE - 1).astype(np.uint16)


def _fresh(column: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it."""
    out = np.ones(len(column), bool)
    out[1:] = column[1:] != column[:-1]
    return out


def counted(columns: list[np.ndarray], trained: np.ndarray, n_all: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of n-grams, a row each, seen ``trained`` times in training: the count of a row's first word, and the codes of its first two, three ... words.

    Words are numbered within the shard and its trie is asked for each distinct prefix once.
    """
    _, numbers = np.unique(np.concatenate(columns), return_inverse=True)
    numbers = [x.astype(np.int32) for x in np.split(numbers, len(columns))]
    order = np.lexsort(numbers[::-1])
    numbers = [x[order] for x in numbers]
    new, prefixes, firsts = np.zeros(len(order), bool), [], []
    for x in numbers:
        new = new | _fresh(x)
        prefixes.append(np.cumsum(new) - 1)
        firsts.append(np.flatnonzero(new))
    seen = trained[order].astype(np.int64)
    n_trained = np.add.reduceat(seen, firsts[-1])
    kept = firsts[-1][n_trained > 0]
    trie = Trie([x[kept].astype(np.int64) for x in numbers], n_trained[n_trained > 0], n_all)
    answers = [np.add.reduceat(seen, firsts[0])]
    parent = np.zeros(1, np.int64)
    for depth, (x, first) in enumerate(zip(numbers, firsts)):
        above = parent[prefixes[depth - 1][first]] if depth else np.zeros(len(first), np.int64)
        parent, code = trie.look_up(depth, above, x[first])
        if depth:
            answers.append(code)
    rows = []
    for prefix, answer in zip(prefixes, answers):
        row = np.empty(len(order), answer.dtype)
        row[order] = answer[prefix]
        rows.append(row)
    return rows[0], rows[1:]


class Trie:
    """Training n-grams of one shard, from sorted distinct rows of whole numbers: a level a column, with the coded probability of each node."""

    def __init__(self, columns: list[np.ndarray], count: np.ndarray, n_all: int):
        self.levels, self.values = {}, {}
        parent, n_parents = np.zeros(len(count), np.int64), min(1, len(count))
        new = np.zeros(len(count), bool)
        for depth, column in enumerate(columns):
            new |= _fresh(column)
            first = np.flatnonzero(new)
            pointers, children = _children(parent[first], column[first], n_parents)
            self.levels |= {f"pointer{depth}": EliasFano.build(pointers), f"child{depth}": EliasFano.build(children)}
            parent, n_parents = np.cumsum(new) - 1, len(first)
            self.values[f"code{depth}"] = coded(np.log10(np.add.reduceat(count, first) / n_all)) if n_parents else np.zeros(0, np.uint16)
        self._map()

    def _map(self) -> None:
        """Moves every array into one memory map."""
        places = [(level.arrays, name) for level in self.levels.values() for name in level.arrays] + [(self.values, name) for name in self.values]
        size = sum(-(-owner[name].nbytes // 8) * 8 for owner, name in places)
        self.memory, at = mmap.mmap(-1, max(size, 8)), 0
        for owner, name in places:
            array = owner[name]
            view = np.frombuffer(self.memory, array.dtype, array.size, at)
            view[:] = array
            owner[name] = view
            at += -(-array.nbytes // 8) * 8

    def _child(self, depth: int, parent: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The child of each parent with that value, or -1: a successor search relative to where the parent's range begins."""
        level, pointers = self.levels[f"child{depth}"], self.levels[f"pointer{depth}"]
        if not len(parent) or not level.n:
            return np.full(len(parent), -1)
        low = pointers.access(parent).astype(np.int64)
        high = pointers.access(parent + 1).astype(np.int64)
        base = np.where(low > 0, level.access(np.maximum(low - 1, 0)), np.uint64(0))
        x = base + value.astype(np.uint64)
        at = level.successor(low, high, x)
        hit = at < high
        hit[hit] = level.access(at[hit]) == x[hit]
        return np.where(hit, at, -1)

    def look_up(self, depth: int, parent: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes (-1 if there is none, as below a parent of -1) and their codes."""
        node = np.full(len(value), -1)
        met = np.flatnonzero(parent >= 0)
        node[met] = self._child(depth, parent[met], value[met])
        code, hit = np.full(len(value), _NONE, np.uint16), node >= 0
        code[hit] = self.values[f"code{depth}"][node[hit]]
        return node, code


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


class Numbers(dict):
    """Word numbers: those of the frequent words as given, a marked 64-bit hash for any other."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = xxh64_intdigest(word) | 1 << 63
        return number


def word_counts(train: DataFrame) -> DataFrame:
    """(word, n) of the training rows; the null word is the end of a text.

    Tasks count their own words first, so that one row a task and word is shuffled.
    """

    def batch_of(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": list(seen), "n": list(seen.values())}, schema=pa.schema([("word", pa.binary()), ("n", pa.int64())]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            seen[None] += batch.num_rows
            for text in batch.column(0).to_pylist():
                seen.update(split_words(text))
                if len(seen) >= FLUSH_WORDS:
                    yield batch_of(seen)
                    seen = Counter()
        yield batch_of(seen)

    return train.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def _shut(array: np.ndarray) -> bytes:
    """An array's bytes, those of equal place side by side, compressed."""
    planes = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), array.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _opened(data: bytes, dtype: str) -> np.ndarray:
    planes = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def _packed(columns: list[np.ndarray]) -> tuple[bytes, bytes]:
    """Word numbers in three bytes each, and the long ones after them."""
    every = np.concatenate(columns)
    short = np.minimum(every, TAIL).astype("<u4")
    return _shut(short), _shut(every[every >= TAIL])


def _unpacked(short: bytes, long: bytes, n_columns: int) -> list[np.ndarray]:
    every = _opened(short, "<u4").astype(np.uint64)
    every[every == TAIL] = _opened(long, "<u8")
    return np.split(every, n_columns)


def _shut_codes(codes: np.ndarray) -> bytes:
    """Codes by their rank among a message's distinct ones, the least likely first, which is mostly a byte."""
    values, of = np.unique(codes, return_inverse=True)
    shut = _shut(values), _shut((len(values) - 1 - of).astype("<u2"))
    return len(shut[0]).to_bytes(8, "little") + b"".join(shut)


def _opened_codes(data: bytes) -> np.ndarray:
    cut = 8 + int.from_bytes(data[:8], "little")
    return _opened(data[8:cut], "<u2")[::-1][_opened(data[cut:], "<u2")]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)


def _bucket(word: np.ndarray, other: np.ndarray, share: np.ndarray, buckets: int) -> np.ndarray:
    """The shard of a word; one with a large share of all tokens is spread over so many more by the word before it."""
    spread = np.minimum(buckets, share * buckets * CHUNKS + 1).astype(np.uint64)
    return ((_mixed(word) + _mixed(other + np.uint64(1)) % spread) % np.uint64(buckets)).astype(np.int64)


def _schema(**types: pa.DataType) -> tuple[pa.Schema, str]:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return pa.schema(list(types.items())), ", ".join(f"{k} {names[t]}" for k, t in types.items())


_TEXTS, _TEXTS_DDL = _schema(bucket=pa.int32(), batch=pa.int64(), short=pa.binary(), long=pa.binary(), trained=pa.binary(), copy_of=pa.binary(), where=pa.binary(), info=pa.binary(), base=pa.binary())
_PART, _PART_DDL = _schema(batch=pa.int64(), bucket=pa.int32(), codes1=pa.binary(), codes2=pa.binary(), codes3=pa.binary(), exact=pa.binary(), copy_of=pa.binary(), where=pa.binary(), info=pa.binary(), base=pa.binary())
_ROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
_ROW_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
_NO_ID = -(1 << 63)


def _row(schema: pa.Schema, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types, strict=True)], schema=schema)


def score(docs: DataFrame, held_out, head: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs``.

    ``docs``: doc_id and text; other columns are ignored. ``held_out`` is a boolean column over it: the model
    learns from the rows where it is false or null. A null or empty text is its end alone. Repeated rows are
    counted and scored each; a null doc_id stays null. Without training rows every word is unseen and N is 0;
    an empty table stays empty. At most ``head`` words (of up to ``HEAD_WORD_BYTES`` bytes) travel as numbers, by default
    those of one in ``FREQUENT`` tokens, at most ``HEAD``; it bears on no score.
    """
    spark = docs.sparkSession
    tasks = shuffle_partitions(spark)
    buckets = tasks * PARTS
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    context = spark.sparkContext
    words = cut_lineage(word_counts(docs.where(~F.col("held_out"))))
    found = words.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("word").isNull(), F.col("n")))).first()
    train_tokens, types, ends = (int(x or 0) for x in found)
    likely = words.where(F.length("word") <= HEAD_WORD_BYTES)
    if head is None:
        likely = likely.where(F.col("n") * FREQUENT >= train_tokens)
    top = likely.orderBy(F.desc("n"), "word").limit(HEAD if head is None else head).collect()
    own = np.array([ends, *(r.n for r in top)], np.int64)
    shared = context.broadcast(({bytes(r.word): i + 1 for i, r in enumerate(top)}, own))
    n_all = max(1, train_tokens)
    hot, flush_tokens, flush_docs = HOT, FLUSH_TOKENS, FLUSH_DOCS
    place_type = "<u2" if buckets <= 1 << 16 else "<u4"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The n-grams of a batch of texts, dealt to the shards of their last words."""
        (given, own), first = shared.value, TaskContext.get().partitionId() << 36
        lookup = Numbers(given)
        n_given = len(lookup)
        held: list[tuple] = []
        n = row = 0

        def flush() -> Iterator[pa.RecordBatch]:
            held.sort(key=lambda x: x[2])  # training texts first
            sizes = np.array([len(x[0]) for x in held])
            starts = np.cumsum(sizes) - sizes
            word = np.concatenate([x[0] for x in held])
            history = np.concatenate([np.full(1, END, np.uint64), word[:-1]])
            second = np.concatenate([np.full(2, END, np.uint64), word[:-2]])[: len(word)]
            second[starts] = END
            n_trained = sum(len(x[0]) for x in held if not x[2])
            count = np.where(word < TAIL, own[np.where(word < TAIL, word, 0).astype(np.int64)], 0)
            base = np.add.reduceat(np.where(count > 0, np.log10(count + 0.1), 0.0), starts)
            known = np.add.reduceat((count > 0).astype(np.int64), starts)
            info = np.array([(_NO_ID if x[1] is None else x[1], len(x[0]), x[2], k) for x, k in zip(held, known.tolist())], np.int64)
            where = _bucket(word, history, count / n_all, buckets).astype(place_type)
            order = np.argsort(where, kind="stable")
            cuts = np.searchsorted(where[order], np.arange(buckets + 1))
            yield _row(_TEXTS, (first + row) % buckets, first + row, *[b""] * 4, _shut(where), info.tobytes(), base.tobytes())
            for b in range(buckets):
                rows = order[cuts[b] : cuts[b + 1]]
                if not len(rows):
                    continue
                trained, copy_of = (rows < n_trained).astype("<u4"), b""
                if len(rows) > hot * len(word) / buckets:
                    key = (word[rows] * np.uint64(0x9E3779B97F4A7C15) ^ history[rows]) * np.uint64(0xC2B2AE3D27D4EB4F) ^ second[rows]
                    _, distinct, of = np.unique(key, return_index=True, return_inverse=True)
                    trained, copy_of, rows = np.bincount(of, trained, len(distinct)).astype("<u4"), _shut(of.astype("<u4")), rows[distinct]
                yield _row(_TEXTS, b, first + row, *_packed([word[rows], history[rows], second[rows]]), _shut(trained), copy_of, *[b""] * 3)

        for batch in batches:
            for doc_id, text, out in zip(*(batch.column(i).to_pylist() for i in range(3))):
                split = split_words(text)
                ids = np.zeros(len(split) + 1, np.uint64)
                ids[:-1] = np.fromiter(map(lookup.__getitem__, split), np.uint64, len(split))
                held.append((ids, doc_id, out))
                n += len(ids)
                if n >= flush_tokens or len(held) >= flush_docs:
                    yield from flush()
                    row += len(held)
                    held, n = [], 0
                    if len(lookup) > n_given + FLUSH_WORDS:
                        lookup = Numbers(given)
        if held:
            yield from flush()

    def by_bucket(batches: Iterator[pa.RecordBatch]) -> dict[int, list[dict]]:
        found: dict[int, list[dict]] = {}
        for batch in batches:
            for message in batch.to_pylist():
                found.setdefault(message["bucket"], []).append(message)
        return found

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Answers to a shard's n-grams, message by message: codes of c(w), c(h w) and c(g h w), and c(w) as it is where it isn't broadcast."""
        own = shared.value[1]
        own_codes = np.full(len(own), _NONE, "<u2")
        own_codes[own > 0] = coded(np.log10(own[own > 0] / n_all))
        shards = by_bucket(batches)
        while shards:
            bucket, messages = shards.popitem()
            for m in messages:
                if m["info"]:
                    yield _row(_PART, m["batch"], bucket, *[b""] * 5, m["where"], m["info"], m["base"])
            messages = [m for m in messages if not m["info"]]
            if not messages:
                continue
            parts = [_unpacked(m["short"], m["long"], 3) for m in messages]
            cuts = np.cumsum([0, *(len(x[0]) for x in parts)]).tolist()
            columns = [np.concatenate(x) for x in zip(*parts)]
            del parts
            word, trained = columns[0], np.concatenate([_opened(m["trained"], "<u4") for m in messages])
            exact, codes = counted(columns, trained, n_all)
            codes.insert(0, np.where(word < TAIL, own_codes[np.where(word < TAIL, word, 0).astype(np.int64)], _NONE))
            codes = np.stack(codes).astype("<u2")
            for m, start, end in zip(messages, cuts, cuts[1:]):
                rare = exact[start:end][codes[0, start:end] == _NONE]
                yield _row(_PART, m["batch"], bucket, *(_shut_codes(x[start:end]) for x in codes), _shut(rare), m["copy_of"], *[b""] * 3)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The answers put back in the texts' order, smoothed, and summed by text."""
        probability = 10.0 ** (-_STEP * np.arange(_NONE + 1))
        probability[_NONE] = 0.0
        texts: dict[int, list[dict]] = {}
        for batch in batches:
            for part in batch.to_pylist():
                texts.setdefault(part["batch"], []).append(part)
        while texts:
            _, parts = texts.popitem()
            mine = next(m for m in parts if m["info"])
            ids, sizes, out, known = np.frombuffer(mine["info"], np.int64).reshape(-1, 4).T
            where = _opened(mine["where"], place_type)
            order = np.argsort(where, kind="stable")
            cuts = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=buckets))])
            codes, exact = np.empty((3, len(where)), "<u2"), np.zeros(len(where), np.int64)
            for m in parts:
                if m["info"]:
                    continue
                here = order[cuts[m["bucket"]] : cuts[m["bucket"] + 1]]
                told = np.stack([_opened_codes(m[f"codes{i}"]) for i in (1, 2, 3)])
                rare = np.zeros(told.shape[1], np.int64)
                rare[told[0] == _NONE] = _opened(m["exact"], "<i8")
                of = _opened(m["copy_of"], "<u4") if m["copy_of"] else slice(None)
                codes[:, here], exact[here] = told[:, of], rare[of]
            starts = np.cumsum(sizes) - sizes
            rare = codes[0] == _NONE
            p_w = np.where(rare, exact / n_all, probability[codes[0]])
            p_hw = probability[codes[1]]
            c_h, c_gh = (np.concatenate([np.zeros(1), x[:-1]]) * n_all for x in (p_w, p_hw))
            c_h[starts] = c_gh[starts] = ends
            p = np.where(p_w > 0, (1 - UNSEEN) * p_w, UNSEEN / n_all)
            share = weight(c_h, SHARE2)
            p = (1 - share) * p + share * p_hw * n_all / np.maximum(c_h, 1)
            share = weight(c_gh, SHARE3)
            p = (1 - share) * p + share * probability[codes[2]] * n_all / np.maximum(c_gh, 1)
            base = np.frombuffer(mine["base"]) + np.add.reduceat(np.where(rare, np.log10(exact + 0.1), 0.0), starts)
            n_known = known + np.add.reduceat((exact > 0).astype(np.int64), starts)
            columns = [pa.array(ids, mask=ids == _NO_ID), pa.array(out.astype(bool)), pa.array(sizes), pa.array(n_known), pa.array(base), pa.array(np.add.reduceat(np.log10(p), starts))]
            yield pa.RecordBatch.from_arrays(columns, schema=_ROW)

    task = F.col("bucket") % tasks
    parts = docs.mapInArrow(scan, _TEXTS_DDL).repartitionById(tasks, task).mapInArrow(count, _PART_DDL)
    rows = parts.repartition(tasks, "batch").mapInArrow(gather, _ROW_DDL)
    whole = float(np.log10(train_tokens + 0.1 * (types + 1)))
    return rows.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * whole).alias("base_score"), "score"
    )
