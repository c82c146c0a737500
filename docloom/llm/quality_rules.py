"""Quality rules: a bitmask ledger of measurements and failures, and versioned policies over it.

``ledger`` evaluates every rule once and stores what it measured and one failure bit a rule. A policy is a
named mask: a document is kept if none of the mask's bits is set, so that another version, or an ablation,
reads the ledger's bits and never the texts again. Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.once import computed

WINDOW = 8
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

# name, failure of the rule; the position is the bit and never changes once a ledger is stored.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 9 * word_chars"),
    ("capitals", "100 * n_capitals > 40 * word_chars"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 30 * n_words"),
]
BIT = {name: 1 << at for at, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]

POLICIES: dict[str, int] = {
    "base-1": BASE,
    "strict-1": reduce(int.__or__, BIT.values()),
}
DEFAULT_POLICY = "strict-1"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words"]


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows of the text found twice or more, from the hashes of its words.

    Window hashes are sorted with their places; equal neighbours are repeats; the union of the windows at
    the repeats' places is counted from the distances between neighbouring places. Costs n log n a text.
    """

    def covered(places: Column) -> Column:
        last = F.size(places) - 1
        steps = F.transform(places, lambda p, i: F.when(i < last, F.least(F.lit(WINDOW), F.get(places, i + 1) - p)).otherwise(F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def repeats(ordered: Column) -> Column:
        flagged = F.transform(
            ordered,
            lambda x, i: F.when((x["h"] == F.get(ordered, i - 1)["h"]) | (x["h"] == F.get(ordered, i + 1)["h"]), x["p"]),
        )
        return F.sort_array(F.filter(flagged, lambda p: p.isNotNull()))

    def by_windows(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(bound(placed, lambda o: bound(repeats(o), covered)))

    n = F.size(hashes)
    windows = F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
    return F.when(n <= WINDOW, F.lit(0)).otherwise(bound(windows, by_windows))


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` plus the measures; a null text counts as empty. Columns of these names are replaced."""
    kept = [c for c in docs.columns if c not in MEASURES]
    text = F.coalesce(F.col("text"), F.lit(""))
    split = computed(
        docs,
        kept,
        {
            # words and lines are compared as hashes: arrays of numbers have hash sets, arrays of strings have not
            "__hashes": F.transform(F.array_remove(F.split(text, SPACE), ""), lambda w: F.xxhash64(w)),
            "__lines": F.transform(F.filter(F.split(text, "\n"), lambda line: F.length(F.trim(F.translate(line, SPACE_CHARS[1:], " "))) > 0), lambda line: F.xxhash64(line)),
            "word_chars": F.length(_without(text, SPACE_CHARS)).cast("long"),
            "n_symbols": (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long"),
            "n_capitals": (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", ""))).cast("long"),
        },
    )
    return computed(
        split,
        kept,
        {
            "n_words": F.size("__hashes").cast("long"),
            "word_chars": F.col("word_chars"),
            "n_symbols": F.col("n_symbols"),
            "n_capitals": F.col("n_capitals"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": _repeat_words(F.col("__hashes")).cast("long"),
        },
    )


def ledger(docs: DataFrame) -> DataFrame:
    """``docs`` plus its measures and ``fail_bits`` (long): bit i is set if rule i of ``RULES`` fails.

    Null or empty texts fail ``few_words``. Repeated rows and ties need nothing: a row's bits depend on its
    text alone. An empty table gives an empty ledger.
    """
    bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.expr(f), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, f) in enumerate(RULES)))
    return measure(docs.drop("fail_bits")).withColumn("fail_bits", bits)


def apply_policy(rows: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """A ledger plus ``base_failed`` and ``kept`` under a policy's mask."""
    bits = F.col("fail_bits")
    return rows.withColumns(
        {"base_failed": bits.bitwiseAND(F.lit(BASE)) != 0, "kept": bits.bitwiseAND(F.lit(BASE | POLICIES[policy])) == 0}
    )


def ablations(rows: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone, and that would be kept without it.

    Documents are first counted by their bits (at most two to the number of rules), then read rule by rule.
    """
    mask = POLICIES[policy]
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("docs"))
    rules = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(bit).alias("bit")) for name, bit in BIT.items() if bit & mask))
    each = patterns.select("bits", "docs", F.explode(rules).alias("r"))
    failed = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    others = F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(failed, F.col("docs")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(failed & others, F.col("docs")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(others, F.col("docs")).otherwise(0)).alias("n_kept_without"),
    )


def compare(rows: DataFrame, policies: list[str]) -> DataFrame:
    """Documents and words kept by each of several policy versions, from one pass over a ledger."""
    sums = [F.struct(F.lit(p).alias("policy"), F.sum(F.when(F.col("fail_bits").bitwiseAND(F.lit(POLICIES[p])) == 0, 1).otherwise(0)).alias("n_kept"), F.sum(F.when(F.col("fail_bits").bitwiseAND(F.lit(POLICIES[p])) == 0, F.col("n_words")).otherwise(0)).alias("words_kept")) for p in policies]
    return rows.agg(F.array(*sums).alias("all")).select(F.inline("all"))


_LEDGER_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT row_id, doc_id, text,
         regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM texts
), windows AS (
  SELECT row_id, i, count(*) OVER (PARTITION BY row_id, gram) AS n
  FROM (SELECT row_id, i, array_to_string(words[i:i + 7], ' ') AS gram
        FROM (SELECT row_id, words, unnest(range(1, len(words) - 6)) AS i FROM split WHERE len(words) >= 8))
), repeats AS (
  SELECT row_id, count(DISTINCT i + k) AS n_repeat_words
  FROM windows, (SELECT unnest(range(0, 8)) AS k) WHERE n > 1 GROUP BY row_id
), measured AS (
  SELECT doc_id, len(words) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS n_capitals,
         len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM split LEFT JOIN repeats USING (row_id)
), bits AS (
  SELECT *, __BITS__ AS fail_bits FROM measured
)
""".replace("__BITS__", "(" + " + ".join(f"CASE WHEN {failure} THEN {1 << at} ELSE 0 END" for at, (_, failure) in enumerate(RULES)) + ")::BIGINT")

SQL = _LEDGER_SQL + """SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (fail_bits & __BASE__) <> 0 AS base_failed, (fail_bits & __MASK__) = 0 AS kept, fail_bits
FROM bits
""".replace("__BASE__", str(BASE)).replace("__MASK__", str(BASE | POLICIES[DEFAULT_POLICY]))

ABLATIONS_SQL = _LEDGER_SQL + """, rules(rule, bit) AS (VALUES __RULES__)
SELECT rule, count(*) FILTER (WHERE fail_bits & __MASK__ & bit <> 0) AS n_failed, count(*) FILTER (WHERE fail_bits & __MASK__ = bit) AS n_failed_alone,
       count(*) FILTER (WHERE fail_bits & __MASK__ IN (0, bit)) AS n_kept_without
FROM bits, rules GROUP BY rule
""".replace("__RULES__", ", ".join(f"('{name}', {bit})" for name, bit in BIT.items() if bit & POLICIES[DEFAULT_POLICY])).replace("__MASK__", f"{POLICIES[DEFAULT_POLICY]}")

COMPARE_SQL = _LEDGER_SQL + """, policies(policy, mask) AS (VALUES __POLICIES__)
SELECT policy, count(*) FILTER (WHERE fail_bits & mask = 0) AS n_kept, coalesce(sum(n_words) FILTER (WHERE fail_bits & mask = 0), 0)::BIGINT AS words_kept
FROM bits, policies GROUP BY policy
""".replace("__POLICIES__", ", ".join(f"('{name}', {mask})" for name, mask in POLICIES.items()))
