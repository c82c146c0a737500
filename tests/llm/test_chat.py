"""Perspective rotation against its SQL and by hand."""

from docloom.llm import chat
from docloom.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_query_matches_sql(spark, duck):
    frame = QUERIES["op7_chat"](spark, SMALL)
    rel = duck.sql(ORACLES["op7_chat"])
    order = [list(rel.columns).index(c) for c in frame.columns]
    assert sorted(map(tuple, frame.collect())) == sorted(tuple(r[i] for i in order) for r in rel.fetchall())


def test_rotation_by_hand(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|bob|>"), (1, 2, "bob", None), (1, 3, None, "?"), (2, 0, "system", "alone"), (None, None, "x", "y"), (None, 1, "x", "y")]
    frame = spark.createDataFrame([(*r, "z", 0) for r in rows], "conv_id long, turn long, role string, text string, body string, at int")
    got = {(r.conv_id, r.perspective, r.part): r for r in chat.rotate(frame).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (1, "unknown", 0), (None, "x", 0)}
    assert got[None, "x", 0].text == 2 * "<|assistant|>\ny<|end|>\n"
    bob = got[1, "bob", 0]
    assert bob.text == "<|system|>\nbe kind<|end|>\n<|user name=ann|>\nhi < |bob|><|end|>\n<|assistant|>\n<|end|>\n<|user name=unknown|>\n?<|end|>\n"
    start, end = map(int, bob.mask.split("-"))
    assert bob.text[start:end] == "<|end|>" and bob.n_trained == 7 and bob.n_chars == len(bob.text)


def test_a_dialogue_is_whole_whatever_its_turn_numbers(spark):
    frame = spark.range(500, 530).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'ann', 'bob') as role", "concat('t', id) as text")
    got = chat.rotate(frame).collect()
    assert sorted((r.perspective, r.part, r.n_turns) for r in got) == [("ann", 0, 30), ("bob", 0, 30)]


def test_a_dialogue_of_100_000_turns_and_a_very_long_text(spark):
    long = "word " * 400_000
    turns = spark.range(100_000).selectExpr("1L as conv_id", "id as turn", "if(id % 3 = 0, 'ann', 'bob') as role", "cast(id as string) as text")
    frame = turns.unionByName(spark.createDataFrame([(2, 0, "cy", long), (2, 1, "di", "ok")], turns.schema))
    got = {(r.conv_id, r.perspective): r for r in chat.rotate(frame).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (2, "cy"), (2, "di")}
    for (conv, side), r in got.items():
        assert r.n_turns == (100_000 if conv == 1 else 2) and r.n_chars == len(r.text)
        spans = [tuple(map(int, s.split("-"))) for s in r.mask.split(",")]
        assert sum(e - s for s, e in spans) == r.n_trained
        if conv == 1:
            own = [t for t in range(100_000) if (t % 3 == 0) == (side == "ann")]
            assert [r.text[s:e] for s, e in spans] == [f"{t}<|end|>" for t in own]
    assert long in got[2, "di"].text


def test_long_conversations_come_in_parts(spark):
    rows = [(1, t % 7, "ab"[t % 2], f"t{t}") for t in range(40)]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), max_turns=4).collect()
    assert sorted((r.part, r.n_turns) for r in got if r.perspective == "a") == [(p, 4) for p in range(10)]
    for r in got:
        spans = [tuple(map(int, s.split("-"))) for s in r.mask.split(",") if s]
        assert sum(e - s for s, e in spans) == r.n_trained and all(r.text[s:e].endswith("<|end|>") for s, e in spans)
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
