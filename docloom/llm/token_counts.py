"""Token counts: pieces counted once per distinct pre-token, joined to per-document frequencies.

A sentencepiece BPE model whose pieces hold the space mark only at their front never merges across the
start of a word, so the token count of a text is the sum over its pre-tokens (a run of spaces and the
characters up to the next space). Frequent pre-tokens are joined through a broadcast table of at most
``HEAD_SIZE`` short entries. Every other pre-token goes, once for each block of documents that holds it, to the
bucket that counts its pieces once for the whole corpus; the count goes back to the block, where it meets the
frequencies of the block's documents. What is shuffled is bounded by the distinct pre-tokens of the documents,
however many buckets there are. No token ids are kept anywhere.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import cut_lineage, shuffle_partitions

HEAD_SHARE = 0.05
HEAD_SIZE = 131_072
HEAD_WORD_CHARS = 48
BLOCK_ENTRIES = 400_000

_RUN = re.compile(" +[^ ]*")
_LOADED: dict = {}

_SHAPE = {
    "bucket": ("int", pa.int32()),
    "block": ("long", pa.int64()),
    "at": ("array<int>", pa.list_(pa.int32())),  # places of the words in the block's list
    "words": ("array<string>", pa.list_(pa.string())),
    "pieces": ("array<int>", pa.list_(pa.int32())),
    "docs": ("array<struct<doc_id:long,n_bytes:long,n:long,size:int>>", pa.list_(pa.struct([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n", pa.int64()), ("size", pa.int32())]))),
    "refs": ("array<int>", pa.list_(pa.int32())),  # of each document in turn: places of its words, and how often it has them
    "freqs": ("array<int>", pa.list_(pa.int32())),
}
_MESSAGE, _MESSAGE_DDL = pa.schema([(k, t) for k, (_, t) in _SHAPE.items()]), ", ".join(f"{k} {ddl}" for k, (ddl, _) in _SHAPE.items())
_COUNT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def _messages(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: [r.get(k) for r in rows] for k in _SHAPE}, schema=_MESSAGE)


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without its first space (the model adds one in front of the text)."""
    text = text.replace("▁", " ")
    if not text:
        return []
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [run[1:] for run in _RUN.findall(" " + text)]


def _processor(model: str):
    if model not in _LOADED:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
        if any("▁" in piece.lstrip("▁") for piece in pieces):
            raise ValueError("pieces of this model cross the starts of words: its counts don't add up by pre-token")
        _LOADED[model] = processor
    return _LOADED[model]


def piece_counts(model: str, words: list[str]) -> list[int]:
    """Pieces of each pre-token; the empty one stands for a lone space."""
    return [len(ids) if word else 1 for word, ids in zip(words, _processor(model).encode(words, num_threads=1))]


def _head(docs: DataFrame, model: str) -> dict[str, int]:
    """Piece counts of frequent pre-tokens, found in a share of the rows: which ones they are changes speed, not results.

    The share is counted where it lies, and only counts of distinct pre-tokens are shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(w for w in pre_tokens(text or "") if len(w) <= HEAD_WORD_CHARS)
        yield pa.RecordBatch.from_pydict({"word": list(seen), "freq": list(seen.values())}, schema=pa.schema([("word", pa.string()), ("freq", pa.int64())]))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            if words:
                yield pa.RecordBatch.from_pydict({"word": words, "n": piece_counts(model, words)}, schema=pa.schema([("word", pa.string()), ("n", pa.int32())]))

    seen = docs.select("text").sample(HEAD_SHARE, seed=1).mapInArrow(count, "word string, freq long")
    totals = cut_lineage(seen.groupBy("word").agg(F.sum("freq").alias("freq")))
    # the least frequency that leaves at most HEAD_SIZE words, from how many words there are by steps of frequency
    step = F.floor(F.log2("freq") * 8).cast("int")
    left, least = HEAD_SIZE, None
    for row in totals.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        if row["count"] > left:
            break
        left, least = left - row["count"], row.step
    if least is None:
        return {}
    top = totals.where(step >= least).select("word")
    return {row.word: row.n for row in top.mapInArrow(pieces, "word string, n int").collect()}


def count_tokens(docs: DataFrame, model: str, over: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of ``docs`` (doc_id, text; other columns are ignored).

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows, also with one doc_id, give one row each.
    A null doc_id stays null. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    buckets = shuffle_partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    head = spark.sparkContext.broadcast(_head(docs, model))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of documents with their frequencies, sums over the head taken, and the other words to their buckets."""
        known, block = head.value.get, TaskContext.get().partitionId() << 32

        def flush(places, docs, refs, freqs):
            dealt: dict[int, tuple[list, list]] = {}
            for word, at in places.items():
                ats, words = dealt.setdefault(zlib.crc32(word.encode()) % buckets, ([], []))
                ats.append(at)
                words.append(word)
            rows = [{"bucket": b, "block": block, "at": ats, "words": words} for b, (ats, words) in dealt.items()]
            return _messages([*rows, {"bucket": block % buckets, "block": block, "docs": docs, "refs": refs, "freqs": freqs}])

        places, docs, refs, freqs = {}, [], [], []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                total, before = 0, len(refs)
                for word, freq in Counter(pre_tokens(text)).items():
                    n = known(word)
                    if n is not None:
                        total += n * freq
                    else:
                        refs.append(places.setdefault(word, len(places)))
                        freqs.append(freq)
                docs.append({"doc_id": doc_id, "n_bytes": len(text.encode()), "n": total, "size": len(refs) - before})
                if len(refs) + len(docs) >= BLOCK_ENTRIES:
                    yield flush(places, docs, refs, freqs)
                    places, docs, refs, freqs = {}, [], [], []
                    block += 1
        if docs:
            yield flush(places, docs, refs, freqs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts each distinct pre-token of the bucket once; blocks of documents pass."""
        counted: dict[str, int] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["words"] is not None:
                    words = row.pop("words")
                    new = [w for w in words if w not in counted]
                    counted.update(zip(new, piece_counts(model, new)))
                    row["pieces"] = [counted[w] for w in words]
                yield _messages([row])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The counts of a block's words, joined to the frequencies of its documents and summed; rows come sorted by block."""
        import numpy as np

        def summed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts)
            held = rows.filter(pa.compute.is_valid(rows["docs"]))
            ats, pieces = (rows[c].combine_chunks().flatten().to_numpy() for c in ("at", "pieces"))
            n_of = np.zeros(len(ats), np.int64)
            n_of[ats] = pieces
            docs, refs, freqs = (held[c].combine_chunks().flatten() for c in ("docs", "refs", "freqs"))
            doc_id, n_bytes, base, size = docs.flatten()
            upto = np.concatenate([[0], np.cumsum(n_of[refs.to_numpy()] * freqs.to_numpy())])
            ends = np.cumsum(size.to_numpy())
            n = base.to_numpy() + upto[ends] - upto[ends - size.to_numpy()]
            return pa.RecordBatch.from_arrays([doc_id, n_bytes, pa.array(n, pa.int64())], schema=_COUNT)

        parts: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            at = 0
            for value, size in [(k, len(list(same))) for k, same in groupby(batch.column("block").to_pylist())]:
                if value != last and parts:
                    yield summed(parts)
                    parts = []
                parts.append(batch.slice(at, size))
                last, at = value, at + size
        if parts:
            yield summed(parts)

    counted = docs.mapInArrow(scan, _MESSAGE_DDL).repartition(buckets, "bucket").mapInArrow(count, _MESSAGE_DDL)
    blocks = counted.repartition(buckets, "block").sortWithinPartitions("block")
    found = blocks.mapInArrow(gather, "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > over)
