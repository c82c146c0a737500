"""Collocations against a plain count, on odd texts, through hot words and small shards, and against the SQL."""

import re
from collections import Counter

import numpy as np
import pytest

from docloom.llm import phrases
from docloom.llm.queries import ORACLES, QUERIES
from tests.test_queries import rows_of

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(docs, most_words=3, least=10, top=2000, subsumed=50):
    found, n = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, most_words + 1):
                found.setdefault(lang, Counter()).update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in found.items():
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in frequent.items():
            inside = any(len(q) > len(p) and 100 * b >= subsumed * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in frequent.items())
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if not inside:
                kept.append((score, a, " ".join(p), f[p[:k]], f[p[k:]]))
        kept.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, left, right, n[lang], s) for i, (s, a, p, left, right) in enumerate(kept[:top], 1)]
    return sorted(out)


def frame(spark, docs):
    return spark.createDataFrame([(lang, text, 1, "s") for lang, text in docs], "lang string, text string, a int, phrase string")


def rows(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()))


ODD = [
    (None, "A b, c D. a B c\td e" * 7), ("en", None), ("en", ""), ("en", " \t ..!\n"), ("und", "a b c. a b"), ("en", "the cat sat. The cat ran! " * 9), ("en", "the cat sat. The cat ran! " * 9),
    ("de", "ä Ä ß É é " * 40), ("fr", "x" * 50_000), ("en", "w " * 30), ("es", "\x0b".join(["p q r s"] * 12)), ("", "o o o o o o o o o o o o o"),
]


def test_equals_its_sql_and_plain_counts(spark, duck):
    found = QUERIES["op11_collocations"](spark, SMALL)
    rel = duck.sql(ORACLES["op11_collocations"])
    names = sorted(found.columns)
    assert rows_of(names, found.columns, found.collect()) == rows_of(names, list(rel.columns), rel.fetchall())
    assert rows(phrases.collocations(frame(spark, ODD))) == plain(ODD)


@pytest.mark.parametrize("most_words, least, subsumed", [(2, 3, 100), (3, 2, 50), (4, 2, 60)])
def test_hot_words_are_split_and_texts_are_cut_into_blocks(spark, monkeypatch, most_words, least, subsumed):
    rng = np.random.default_rng(3)
    docs = [("en", " ".join(rng.choice(list("aaaaaabbbcdefg."), 300).tolist())) for _ in range(30)] + [("de", " ".join(rng.choice(list("ab."), 900).tolist()))]
    monkeypatch.setattr(phrases, "BLOCK_TOKENS", 64)
    found = phrases.collocations(frame(spark, docs), most_words, least, 50, subsumed, shard_tokens=256)
    assert rows(found) == plain(docs, most_words, least, 50, subsumed)


def test_growth_is_depth_first_and_never_extends_a_rare_prefix():
    context = np.array([[1, 2, 3], [1, 2, 3], [1, 2, 0], [1, 4, 5], [6, 2, 3]])
    assert list(phrases.grow(context, np.array([5, 1, 1, 2, 3]), np.zeros(7, bool), 3)) == [((6, 2), 3), ((6, 2, 3), 3), ((1, 2), 7), ((1, 2, 3), 6)]


def test_empty_table(spark):
    assert rows(phrases.collocations(frame(spark, ODD).limit(0))) == []
    assert rows(phrases.collocations(frame(spark, [("en", None)]))) == []
