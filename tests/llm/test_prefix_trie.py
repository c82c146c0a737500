"""The conversation trie against a plain tree of tuples and against its SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from docloom.llm import prefix_trie
from docloom.llm.queries import ORACLES, QUERIES
from tests.test_queries import rows_of

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(turns):
    of = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            of[conv].append((turn is not None, turn or 0, mark, (role, text)))
    of = {c: [x[-1] for x in sorted(rows)] for c, rows in of.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c, own in of.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = of.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])[:h] + own[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
        ends[tuple(whole)].append(c)
    children = defaultdict(list)
    for key in members:
        if key:
            children[key[:-1]].append(key)

    def summed(key):
        leaves, saved = (1, 0) if not children[key] else (0, 0)
        saved += (len(members[key]) - 1) * (len(key[-1][1].encode()) if key else 0)
        for child in children[key]:
            more = sums[child]
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    sums = {}
    for key in sorted(members, key=len, reverse=True):
        sums[key] = summed(key)
    name = {key: min(m) for key, m in members.items()}
    return sorted(
        (name[k], len(k), name[k[:-1]] if k else None, len(m), len(children[k]), *sums[k], hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()) for k, m in members.items()
    )


def found(spark, turns):
    frame = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, depth int")
    result = prefix_trie.conversation_trie(frame)
    assert result.columns == COLUMNS
    return sorted(map(tuple, result.collect()))


def test_equals_its_sql(spark, duck):
    frame = QUERIES["op13_prefix_trie"](spark, SMALL)
    rel = duck.sql(ORACLES["op13_prefix_trie"])
    names = sorted(frame.columns)
    assert rows_of(names, frame.columns, frame.collect()) == rows_of(names, list(rel.columns), rel.fetchall())


@pytest.mark.parametrize("segment", [2, 512])
def test_shared_and_long_conversations(spark, monkeypatch, segment):
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    rng = random.Random(1)
    turns = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é", None])) for c in [*range(-7, 30), 101, 104] for t in range(rng.randrange(1, 14))]
    turns += [(200 + i % 2, t, "user", f"long {t}") for i in range(2) for t in range(300)]  # the same long turns, of one family
    turns += [(305, None, "user", "first"), (305, 5, "user", "last"), (305, 2, "user", "tie"), (305, 2, "user", "tie"), (305, 2, None, "other tie"), (None, 1, "user", "nobody's")]
    turns += [(c, t, "user", "hot") for c in range(400, 440, 5) for t in range(6)]  # many copies
    assert found(spark, turns) == plain(turns)


def test_turnless_single_and_empty(spark):
    alone = [(3, 1, "user", "x")]  # absent family, one turn of its own: it may keep none
    assert found(spark, alone) == plain(alone)
    assert found(spark, [(0, 1, "user", "x")]) == plain([(0, 1, "user", "x")])
    assert found(spark, [(None, 1, "user", "x")]) == []


def test_ids_of_a_node_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 20)
    ends = spark.createDataFrame([(1, 2, c) for c in range(500)] + [(1, 3, 7)], "node long, depth long, conv_id long")
    got = {(r.node, r.depth): r.ends_sha256 for r in prefix_trie.member_hashes(ends).collect()}
    assert got == {(1, 2): hashlib.sha256(",".join(map(str, range(500))).encode()).hexdigest(), (1, 3): hashlib.sha256(b"7").hexdigest()}
