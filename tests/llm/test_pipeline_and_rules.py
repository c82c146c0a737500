"""Quality, rules, packing, token counts and the pipeline against brute force."""

import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import packing, quality_crf, quality_rules, token_counts
from docloom.llm.queries import ORACLES, QUERIES, pack_documents, tokenizer_path

SMALL = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, " \n\t\n"), (4, "<|endoftext|> x  y "), (5, "é ▁ ñ z " * 40), (6, "w " * 30_000), (7, "one line\none line\n\nother " + "q r s t u v w x y " * 9)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 0.5, "s", 1) for i, t in ODD], "doc_id long, text string, score double, kept string, n_words int")


# quality rules


def plain_measures(text):
    words = [w for w in (text or "").encode().split()]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(8)}
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    return (len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_rules_match_sql_and_plain_measures(spark, duck, odd):
    frame = QUERIES["op4_quality_rules"](spark, SMALL)
    rel = duck.sql(ORACLES["op4_quality_rules"])
    order = [list(rel.columns).index(c) for c in frame.columns]
    assert sorted(map(tuple, frame.collect())) == sorted(tuple(r[i] for i in order) for r in rel.fetchall())
    rows = quality_rules.apply_policy(quality_rules.ledger(odd.drop("kept"))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(str((i, *plain_measures(t))) for i, t in ODD)


@pytest.mark.parametrize("name", ["quality_rule_ablations", "quality_policy_versions"])
def test_ledger_reports_equal_their_sql(spark, duck, name):
    frame = QUERIES[name](spark, SMALL)
    columns = sorted(frame.columns)
    assert sorted(map(tuple, frame.select(columns).collect())) == sorted(duck.sql(ORACLES[name]).project(", ".join(columns)).fetchall())


def test_policies_and_ablations_read_the_bits(spark):
    ledger = quality_rules.ledger(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"))
    bits = [r.fail_bits for r in ledger.select("fail_bits").collect()]
    mask = quality_rules.POLICIES["strict-1"]
    for r in quality_rules.ablations(ledger).collect():
        bit = quality_rules.BIT[r.rule]
        assert (r.n_failed, r.n_failed_alone, r.n_kept_without) == (sum(b & bit > 0 for b in bits), sum(b & mask == bit for b in bits), sum(b & mask & ~bit == 0 for b in bits))
    found = {r.policy: r.n_kept for r in quality_rules.compare(ledger, ["base-1", "strict-1"]).collect()}
    assert found == {p: sum(b & m == 0 for b in bits) for p, m in quality_rules.POLICIES.items()}
    assert quality_rules.ledger(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# quality classifier


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(2)
    emissions, moves = rng.standard_normal((1, 5, 2)), rng.standard_normal((2, 2))
    marginals, _, log_z = quality_crf.forward_backward(emissions, moves, np.ones((1, 5), bool))
    total, by_place = 0.0, np.zeros((5, 2))
    for path in itertools.product((0, 1), repeat=5):
        weight = np.exp(sum(emissions[0, t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        total += weight
        for t, y in enumerate(path):
            by_place[t, y] += weight
    assert np.allclose(marginals[0], by_place / total) and np.isclose(log_z[0], np.log(total))


def plain_score(field, text):
    """A text's score line by line, with plain sums over all labelings of two neighbours."""
    features, lengths = quality_crf.line_features(text or "")
    rows = quality_crf.with_neighbours((features - field.centre) / field.scale).astype(float)
    said = [np.exp(r @ field.weights) for r in rows]
    step = np.exp(field.moves)
    ahead, behind = [said[0] / said[0].sum()], [np.ones(2)]
    for e in said[1:]:
        a = np.array([sum(ahead[-1][i] * step[i, j] for i in (0, 1)) * e[j] for j in (0, 1)])
        ahead.append(a / a.sum())
    for e in said[:0:-1]:
        b = np.array([sum(step[i, j] * e[j] * behind[-1][j] for j in (0, 1)) for i in (0, 1)])
        behind.append(b / b.sum())
    good = [a[1] * b[1] / (a @ b) for a, b in zip(ahead, behind[::-1])]
    return float(np.dot(good, lengths) / lengths.sum())


def test_scores_against_a_plain_field(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    field = quality_crf.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    want = {r.doc_id: plain_score(field, r.text) for r in docs.collect()}
    got = {r.doc_id: r.score for r in QUERIES["op2_quality_crf"](spark, SMALL).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_a_text_of_very_many_lines_is_scored_whole():
    field = quality_crf.LineField(np.random.default_rng(1).standard_normal((40, 2)), np.zeros((2, 2)), np.zeros(13, np.float32), np.ones(13, np.float32))
    text = "\n".join(f"line {i} of a text !" if i % 3 else "### $$" for i in range(100_000))
    assert abs(field.score([text])[0] - plain_score(field, text)) < 1e-6


def test_held_out_accuracy(spark):
    where = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{where}/labels.parquet")
    rows = QUERIES["op2_quality_crf"](spark, where).join(labels, "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == r.quality for r in rows) >= 0.93 * len(rows)


def test_every_labelled_document_teaches(spark):
    docs = spark.createDataFrame([(i, "\n".join([f"### $$ {i} !!"] * 4) if i % 2 else f"the words of a plain line of text number {i} go on") for i in range(60)], "doc_id long, text string")
    marks = [(i, 1 - i % 2, 0) for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    shape = "doc_id long, quality int, toxic int"
    field = quality_crf.train(docs, spark.createDataFrame(marks, shape), 8)
    scores = field.score([r.text for r in docs.orderBy("doc_id").collect()])
    assert (scores[::2] > 0.9).all() and (scores[1::2] < 0.1).all()
    for i in range(0, len(marks), 12):  # one more or less is told from the others
        less = quality_crf.train(docs, spark.createDataFrame(marks[:i] + marks[i + 1 :], shape), 8)
        assert not np.allclose(less.weights, field.weights, atol=1e-9)
    lines = quality_crf.train(docs, spark.createDataFrame(marks, shape), 1_000, 40).score(["### $$ 1 !!\n### $$ 1 !!", "the words of a plain line of text"])
    assert lines[0] < 0.5 < lines[1]


def test_classifier_on_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.score == pytest.approx(0.5) for r in quality_crf.classify(odd, quality_crf.train(odd, none)).collect())
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (None, 1, 0), (7, None, 1)], "doc_id long, quality int, toxic int")
    field = quality_crf.train(odd, labels)
    got = quality_crf.classify(odd, field)
    assert got.count() == len(ODD) and got.where("score is null or score < 0 or score > 1").count() == 0
    assert quality_crf.classify(odd.where("false"), field).count() == 0


# token counts and packing


def test_token_counts_against_the_library(spark, odd):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    want = sorted(str((r.doc_id, len((r.text or "").encode()), n := len(model.encode(r.text or "")), n > 4096)) for r in docs.collect())
    assert sorted(str(tuple(r)) for r in token_counts.count_tokens(docs, tokenizer_path("piece_bpe_32k.model")).collect()) == want
    assert token_counts.count_tokens(docs.where("false"), tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_packing_is_an_exact_round_trip(spark, odd):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").where("doc_id > 10").unionByName(odd.dropDuplicates(["doc_id"]).select("doc_id", "text"))
    ids = {r.doc_id: np.array([*coder.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in docs.collect()}
    pieces, sequences, padding = defaultdict(list), defaultdict(list), 0
    for r in pack_documents(docs).collect():
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for spans, whole in [(pieces[k], len(ids[k])) for k in ids] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at and length > 0
            at += length
        assert at == whole if whole is not None else at <= 2048
        padding += 0 if whole is not None or at & (at - 1) == 0 else 2048 - at
    assert padding <= 2048 * 8
    assert pack_documents(docs.where("false")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_blocks_are_packed_whole(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, [50, 600, 3000, 9000][seed], 200).tolist()
    packed = packing.pack_block(lengths)
    spans = defaultdict(list)
    for tier, pieces in packed:
        assert sum(n for _, _, n in pieces) <= tier
        for doc, start, n in pieces:
            spans[doc].append((start, n))
    for doc, total in enumerate(lengths):
        at = 0
        for start, n in sorted(spans[doc]):
            assert start == at
            at += n
        assert at == total
    assert sum(sum(n for _, _, n in pieces) < tier for tier, pieces in packed) <= 1
    groups = packing.step_groups(packed, 16 * 2048)
    used = Counter()
    for (tier, _), group in zip(packed, groups):
        used[group] += tier
    assert max(used.values()) <= 16 * 2048


# pipeline


def test_every_stage_on_its_own_input(spark):
    from tests.llm.test_simhash import alike, shingles

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("score", F.lit("own")).withColumn("kept", F.lit(7))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "rules", "near_duplicates", "mixing", "packing"]
    held = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        held[name] = (docs.collect(), out.collect())
        docs = spark.createDataFrame(held[name][1], docs.schema)
    before, after = held["rules"]
    passed = [r for r in before if (m := plain_measures(r.text))[0] >= 20 and 100 * m[4] <= 30 * m[0]]
    assert set(after) <= set(passed) and len(after) >= 0.9 * len(passed)
    before, after = held["near_duplicates"]
    sets, stay = {r.doc_id: shingles(r.text) for r in before}, sorted(r.doc_id for r in after)
    assert all(any(alike(sets[i], sets[k]) for k in sets if k != i) for i in sets if i not in stay)
    assert sum(alike(sets[a], sets[b]) for n, a in enumerate(stay) for b in stay[n + 1 :]) <= 1  # fingerprints may miss a pair
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    before, after = held["quality"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    good = [i for i in labels if labels[i].quality == 1]
    assert len(gone & set(good)) <= 0.05 * len(good)
    pieces = stages["packing"](spark, docs, SMALL)
    assert pieces.agg(F.sum("length")).first()[0] == sum(r.doc_tokens for r in pieces.where("start = 0").collect())


def test_stages_on_odd_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies string"
    rows = spark.createDataFrame([(i, t, None, None, None, "c") for i, t in ODD], schema)
    for docs in (rows, rows.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            assert out.count() <= 3 * len(ODD)
