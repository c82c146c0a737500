"""Operators on small literal cases whose results are known, and the cases their docstrings name."""

import re

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import answers, chunking, lifecycle, quantiles, ranking, regulations, trees
from docloom.plans import registry
from docloom.plans import regulations as plans
from docloom.streaming import folds
from docloom.streaming.frequencies import frequencies, run_available


@pytest.mark.parametrize(
    ("question", "kind", "fields"),
    [
        ("Apa isi Pasal 17?", "ARTICLE", {"article": "17"}),
        ("Apa isi Pasal 17 ayat 2?", "ARTICLE", {"article": "17", "clause": "2"}),
        ("Pasal 5 ayat 1 huruf a", "ARTICLE", {"article": "5", "clause": "1", "letter": "a"}),
        ("BAB III angka 11", "GENERIC_PATH", {"terms": ["III", "11"]}),
        ("angka 18 huruf a", "GENERIC_PATH", {"terms": ["18", "a"]}),
        ("bagian 11", "GENERIC_PATH", {"terms": ["11"]}),
        ("Lihat Lampiran II untuk mekanismenya", "APPENDIX", {"appendix": "II"}),
        ("Apa isi KESATU dalam keputusan ini?", "DECISION", {"decision": "KESATU"}),
        ("Bagaimana urut-urutan kegiatan perencanaan?", None, {}),
        (None, None, {}),
    ],
)
def test_parse_reference(spark, question, kind, fields):
    row = spark.createDataFrame([(question,)], "q string").select(T.parse_reference(F.col("q")).alias("x")).first().x
    assert row.kind == kind
    assert {k: v for k, v in row.asDict().items() if v is not None and k != "kind"} == fields


@pytest.mark.parametrize(("terms", "want"), [(["III", "11", "a"], True), (["11"], True), (["III"], True), (["a", "11"], False), (["99"], False), ([], False), (["1"], False)])
def test_path_matches(spark, terms, want):
    frame = spark.createDataFrame([(["BAB III", "11", "a"], terms)], "labels array<string>, terms array<string>")
    assert frame.select(regulations.path_matches(F.col("labels"), F.col("terms")).alias("x")).first().x is want


def test_chunks_of_a_small_tree(spark):
    long = "One sentence here. " * 120
    rows = [
        (1, 0, "SECTION", "Intro", "Intro"), (1, 1, "PARAGRAPH", "words", None), (1, 2, "ARTICLE", "Pasal 1", "Pasal 1"), (1, 3, "CLAUSE", long, None), (1, 4, "LETTER_ITEM", "short", None), (1, 5, "TABLE", "t", None),
        (2, 0, "PARAGRAPH", "alone", None), (2, 1, "PARAGRAPH", None, None), (2, 2, "SECTION", None, None),
    ]
    nodes = spark.createDataFrame([(d, p, None, k, x, t, 1) for d, p, k, x, t in rows], "doc_id long, pos long, parent long, kind string, text string, title string, page long")
    found = {(r.doc_id, r.pos): r for r in chunking.chunks(nodes).collect()}
    assert {k: r.form for k, r in found.items()} == {(1, 0): "WHOLE", (1, 2): "OWN", (1, 3): "OWN", (1, 4): "WHOLE", (1, 5): "TABLE", (2, 0): "WHOLE"}
    assert (found[1, 4].root, found[1, 4].up, found[1, 4].depth) == (2, 3, 2) and found[1, 0].next == 2 and found[1, 2].n_tokens == 1
    texts = {(r.doc_id, r.pos): r.text for r in chunking.chunk_texts(nodes, chunking.chunks(nodes)).collect()}
    assert texts[1, 0] == "Intro\nwords" and texts[1, 2] == "Pasal 1" and texts[2, 0] == "alone"
    cells = spark.createDataFrame([(1, 5, 1, 0, "c"), (1, 5, 0, 0, "a"), (1, 5, 0, 1, None), (1, 5, 1, 1, "d" * 40)], "doc_id long, pos long, row long, cell long, text string")
    held = chunking.chunks(nodes, cells=cells)
    full = "t\na | \nc | " + "d" * 40
    assert {(r.doc_id, r.pos): r.text for r in chunking.chunk_texts(nodes, held, cells).collect()} == texts | {(1, 5): full}
    assert held.where("form = 'TABLE'").select("chars", "n_tokens").first() == (len(full), len(full) // 4)
    assert chunking.chunks(nodes.where("false")).count() == 0


def test_pieces_keep_every_sentence(spark):
    text = "first line\n\n" + "A sentence. " * 300 + "\nlast"

    def pieces(text, budget):
        return chunking.split_texts(spark.createDataFrame([(text,)], "t string"), "t", budget).first().pieces

    parts = pieces(text, 100)
    assert " ".join(" ".join(parts).split()) == " ".join(text.split()) and parts[0] == "first line" and parts[-1] == "last"
    assert all(len(p) // 4 <= 150 for p in parts) and pieces("", 5) == [""] and pieces("x" * 90, 5) == ["x" * 90]
    assert pieces(None, 5) == [""] and pieces(" \n\t", 5) == [" \n\t"]
    # whole lines are packed together, a cut line stands apart from both neighbours, and a sentence over the budget is a piece
    assert pieces("aaaa bbbb\ncccc\n" + "One two. Three four. Five six seven eight nine ten eleven.\ndddd\neeee", 5) == ["aaaa bbbb\ncccc", "One two.\nThree four.", "Five six seven eight nine ten eleven.", "dddd\neeee"]
    assert sum(map(len, pieces("w " * 100_000 + "\n" + "ab cd. " * 50_000, 400))) > 500_000


def plain_pieces(text, budget=400):
    pieces, packed = [], []
    for line in [x for x in text.split("\n") if x.strip()]:
        whole = max(1, len(line) // 4) <= budget
        packed = packed if whole else []
        for part in [line] if whole else [x for x in re.split(r"(?<=[.!?])\s+", line) if x.strip()]:
            if not packed or sum(max(1, len(x) // 4) for x in [*packed, part]) > budget:
                packed = []
                pieces.append(packed)
            packed.append(part)
        packed = packed if whole else []
    return ["\n".join(p) for p in pieces] or [text]


def test_the_texts_of_all_chunks(spark):
    """The query over the whole table against plain walks of the trees; its pieces are exploded behind a join."""
    where = "/root/testdata/sf0.01"
    tree = {(r.doc_id, r.pos): r for r in chunking.regrouped(plans.chunk_nodes(spark, where)).collect()}
    rows = {(r.doc_id, r.pos): r.table_text for r in registry.QUERIES["table_text"](spark, where).collect()}
    below = {}
    for (doc, pos), r in tree.items():
        if r.parent is not None:
            below.setdefault((doc, r.parent), []).append(pos)

    def texts(doc, pos):
        r = tree[doc, pos]
        if r.kind != "TABLE":
            yield from [r.text] if r.text else []
            for child in sorted(below.get((doc, pos), [])):
                yield from texts(doc, child)

    want = []
    for r in registry.QUERIES["chunk_rows"](spark, where).select("doc_id", "pos", "form").collect():
        own = tree[r.doc_id, r.pos].text or ""
        held = {"OWN": lambda r=r, own=own: own, "TABLE": lambda r=r, own=own: "\n".join(x for x in (own, rows[r.doc_id, r.pos]) if x)}
        text = held.get(r.form, lambda r=r: "\n".join(texts(r.doc_id, r.pos)))()
        want += [(r.doc_id, r.pos, r.form, i, x) for i, x in enumerate(plain_pieces(text) if r.form == "SPLIT" else [text])]
    got = registry.QUERIES["chunk_texts"](spark, where)
    assert got.columns == ["doc_id", "pos", "form", "piece", "text"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and max(x[3] for x in want) > 0


def test_claims_and_redaction(spark):
    rows = [(1, "Fakta satu benar sekali. [S1] Pasal 9 menyatakan hal. [S2, S7] sisa"), (2, "tanpa kutipan"), (3, ""), (4, "[S1] x [S1][S2] y")]
    frame = spark.createDataFrame(rows, "id long, text string")
    found = [(r.id, r.claim_no, r.claim, r.ids) for r in answers.claims(frame, ["id"]).orderBy("id", "claim_no").collect()]
    assert found[:4] == [(1, 0, "Fakta satu benar sekali.", ["S1"]), (1, 1, "Pasal 9 menyatakan hal.", ["S2", "S7"]), (1, 2, "sisa", []), (2, 0, "tanpa kutipan", [])]
    evidence = spark.createDataFrame([(1, "S1", "11. Umum", "fakta satu benar"), (1, "S2", "11. Umum", "hal")], "id long, source_id string, path string, text string")
    checked = answers.verified(answers.claims(frame, ["id"]), evidence, ["id"])
    assert [r.status for r in checked.where("id = 1").orderBy("claim_no").collect()] == ["SUPPORTED", "UNSUPPORTED", "UNSUPPORTED"]
    safe = {r.id: r.safe for r in answers.redacted(frame, checked, ["id"]).collect()}
    assert safe[1] == "Fakta satu benar sekali. [S1]" + answers.REMOVED * 2 and safe[3] == ""
    assert {r.id: r.safe for r in answers.redacted(frame, checked.where("claim_no > 0"), ["id"]).collect()}[1] == rows[0][1]


def test_budget_requests_that_are_rejected_consume_nothing(spark):
    requests = spark.createDataFrame([(1, i, a) for i, a in enumerate((60, 50, 40, 1))], "g long, i long, a long")
    assert [r.admitted for r in lifecycle.admitted(requests, F.lit(100), ["g"], "i", "a").orderBy("i").collect()] == [True, False, True, False]


def test_values_at_places_over_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "LAST_ROWS", 3)
    monkeypatch.setattr(quantiles, "BUCKETS", 4)
    values = sorted([float(i * i % 97) for i in range(300)] + [5.0] * 40)
    counts = spark.createDataFrame([("k", v) for v in values], "k string, value double").groupBy("k", "value").agg(F.count("*").alias("c"))
    places = spark.createDataFrame([("k", p) for p in (1, 57, 200, 340)], "k string, place long")
    assert {r.place: r.value for r in quantiles.values_at(counts, places, "k").collect()} == {p: values[p - 1] for p in (1, 57, 200, 340)}


def test_moves_below_the_own_subtree_are_rejected(spark):
    nodes = spark.createDataFrame([(1, 0, None), (1, 1, 0), (1, 2, 1), (1, 3, 0)], "doc_id long, pos long, parent long")
    moves = spark.createDataFrame([(1, 0, 2), (1, 1, 1), (1, 3, 2), (1, 2, 0)], "doc_id long, pos long, to long")
    assert {(r.pos, r.to): r.rejected for r in trees.moves_checked(nodes, moves).collect()} == {(0, 2): True, (1, 1): True, (3, 2): False, (2, 0): False}


@pytest.mark.parametrize(
    ("rows", "exact", "want"),
    [([(1, 0.9)], False, False), ([(1, 0.9), (2, 0.1)], False, True), ([(1, 0.9), (1, 0.89)], True, False), ([(1, 0.9), (2, 0.89)], True, True), ([(1, 0.9), (1, 0.85)], False, True), ([(1, 0.9), (1, 0.1)], False, False), ([(1, 1 - 0.1 * i) for i in range(7)], False, True)],
)
def test_rerank_decision(spark, rows, exact, want):
    frame = spark.createDataFrame([(1, i + 1, d, float(s)) for i, (d, s) in enumerate(rows)], "q long, rank long, document long, score double")
    assert ranking.rerank_decision(frame, "q", "document", F.lit(exact)).first().rerank is want


def test_streams_resume_where_they_stopped(spark, tmp_path):
    schema = "conv_id long, turn long, text string"
    spark.createDataFrame([(1, t, "abc") for t in range(10)], schema).write.parquet(f"{tmp_path}/in/a")
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    first = folds.run_updates(spark, folds.summary_fold(stream()), f"{tmp_path}/out", f"{tmp_path}/state", ["conv_id"])
    assert [tuple(r) for r in first.collect()] == [(1, 2, 6, 1)]
    spark.createDataFrame([(1, 10, "xy"), (1, 11, "")], schema).write.parquet(f"{tmp_path}/in/b")
    again = folds.run_updates(spark, folds.summary_fold(stream()), f"{tmp_path}/out", f"{tmp_path}/state", ["conv_id"])
    assert [tuple(r) for r in again.collect()] == [(1, 4, 12, 3)]
    counted = lambda: frequencies(stream().withColumn("ts", F.col("turn")), ["conv_id"])
    assert run_available(spark, counted(), f"{tmp_path}/f", f"{tmp_path}/fs").first().frequency == 12
    assert run_available(spark, counted(), f"{tmp_path}/f", f"{tmp_path}/fs").first().frequency == 12
