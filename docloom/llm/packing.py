"""Hierarchical multi-length packing of documents into training sequences.

Each task packs blocks of its own rows, so nothing is shuffled. A document's tokens give whole long windows
first; what is left is routed to the smallest context tier that holds it. Windows of the longest tier are
opened by its left-overs and their gaps are filled from shorter tiers (largest that fits, then a cut);
every shorter tier is then packed into full windows of its own power-of-two length, passing what doesn't
fill one down. At most one sequence a block is padded. Sequences of a tier are dealt to step groups of
equal token budget so that their attention costs balance.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIERS = (256, 512, 1024, 2048)
BLOCK_TOKENS = 4_000_000
STEP_TOKENS = 16 * 2048
END_ID = 1

_PIECE = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64()),
    ]
)
_PIECE_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
_LOADED: dict = {}


class Encoder:
    """Ids of a byte-level BPE vocabulary given as a tokenizers file and as the same vocabulary's ranks.

    The rank coder gives the same ids several times faster; texts that hold one of the vocabulary's special
    strings, and any text the rank coder refuses, go through the tokenizers file itself.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(json_path)
        self.special = [token.content for token in self.exact.get_added_tokens_decoder().values()]

    def ids(self, text: str) -> np.ndarray:
        if not any(s in text for s in self.special):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except Exception:  # the rank coder's pattern engine gives up on some texts; the exact coder takes all
                pass
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def encoder(*paths: str) -> Encoder:
    if paths not in _LOADED:
        _LOADED[paths] = Encoder(*paths)
    return _LOADED[paths]


def tier_of(length: int, tiers: tuple[int, ...]) -> int:
    return next(t for t in tiers if length <= t)


def pack_block(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences (tier, [(document, start, length), ...]) that hold every token of every document once."""
    longest, out = tiers[-1], []
    queues: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}
    for doc, total in enumerate(lengths):
        whole = total - total % longest
        out += [(longest, [(doc, start, longest)]) for start in range(0, whole, longest)]
        if total > whole:
            queues[tier_of(total - whole, tiers)].append((total - whole, doc, whole))
    # pieces are (length, document, start); the short ones lie in one list, sorted by length
    opened = sorted(queues[longest], reverse=True)
    short = sorted(piece for t in tiers[:-1] for piece in queues[t])
    at = 0
    while at < len(opened):
        length, doc, start = opened[at]
        at += 1
        window, gap = [(doc, start, length)], longest - length
        while gap:
            fits = bisect_right(short, gap, key=lambda piece: piece[0])
            if fits:
                length, doc, start = short.pop(fits - 1)
                window.append((doc, start, length))
                gap -= length
            elif short or len(opened) > at:
                length, doc, start = short.pop(0) if short else opened.pop()
                window.append((doc, start, gap))
                insort(short, (length - gap, doc, start + gap))
                gap = 0
            else:
                break
        out.append((longest, window))
    # what is left: full windows of each shorter tier, the rest one tier down
    carried: list[tuple[int, int, int]] = []
    by_tier: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}
    for piece in short:
        by_tier[tier_of(piece[0], tiers)].append(piece)
    for tier in reversed(tiers):
        window, room = [], tier
        for length, doc, start in carried + by_tier[tier]:
            while length:
                take = min(length, room)
                window.append((doc, start, take))
                length, start, room = length - take, start + take, room - take
                if not room:
                    out.append((tier, window))
                    window, room = [], tier
        carried = [(length, doc, start) for doc, start, length in window]
    if carried:
        out.append((longest, [(doc, start, length) for length, doc, start in carried]))
    return out


def step_groups(sequences: list[tuple[int, list[tuple[int, int, int]]]], step_tokens: int) -> list[int]:
    """A group for each sequence: equal tokens of one tier, sequences dealt back and forth by attention cost."""
    groups, used = [0] * len(sequences), 0
    by_tier: dict[int, list[int]] = {}
    for i, (tier, _) in enumerate(sequences):
        by_tier.setdefault(tier, []).append(i)
    for tier, members in sorted(by_tier.items()):
        n = -(-len(members) * tier // step_tokens)
        members.sort(key=lambda i: (-sum(piece[2] ** 2 for piece in sequences[i][1]), i))
        for place, i in enumerate(members):
            lap, within = divmod(place, n)
            groups[i] = used + (within if lap % 2 == 0 else n - 1 - within)
        used += n
    return groups


def pack(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, tiers: tuple[int, ...] = TIERS, block_tokens: int = BLOCK_TOKENS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece of each row of ``docs`` (doc_id, text; other columns are ignored).

    ``ids_crc32`` is over the piece's ids as little-endian unsigned 32-bit numbers; ``doc_tokens`` counts the
    end id. A null or empty text is its end id alone. Repeated rows are packed each on its own. A sequence
    shorter than its tier is to be padded to the longest tier. An empty table gives no piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(json_path, ranks_path, pattern)
        base, sequence, group = TaskContext.get().partitionId() << 36, 0, 0
        ends = np.array([END_ID], np.uint32)
        held: list[tuple[int | None, np.ndarray]] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, group
            sequences = pack_block([len(ids) for _, ids in held], tiers)
            groups = step_groups(sequences, step_tokens)
            columns: list[list] = [[] for _ in _PIECE.names]
            for (tier, pieces), step in zip(sequences, groups):
                offset = 0
                for doc, start, length in pieces:
                    doc_id, ids = held[doc]
                    crc = zlib.crc32(ids[start : start + length].astype("<u4").tobytes())
                    for column, value in zip(columns, (doc_id, start, length, crc, len(ids), base + sequence, offset, tier, base + group + step)):
                        column.append(value)
                    offset += length
                sequence += 1
            group += max(groups) + 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PIECE.types)], schema=_PIECE)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([coder.ids(text.as_py() or ""), ends])
                held.append((doc_id, ids))
                tokens += len(ids)
                if tokens >= block_tokens:
                    yield flush()
                    held, tokens = [], 0
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _PIECE_DDL)
