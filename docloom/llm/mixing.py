"""Mixing sources to target weights with soft memberships.

A classifier learned from the labels table gives every document posteriors over three domains (clean, low,
toxic). Documents then get non-negative rates, so that the expected tokens of each domain (rate x tokens x
posterior, over all documents) come as near as possible, in least squares, to the target weights. The rates are
found by accelerated projected gradient steps from rate one. A step's slope depends on a document's posteriors alone, so
documents of like posteriors (the same steps of ``1 / STEPS``) keep equal rates. A cell of such documents is known by its tokens
and its expected tokens of each domain, both summed over all documents, so that the totals of rates are exact; the steps fold over
the table of cells, at most ``(STEPS + 1) * (STEPS + 2) / 2`` rows, in one expression. Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.once import computed, written
from docloom.session import cut_lineage

DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.94, "low": 0.04, "toxic": 0.02}
TRAIN_DOCS = 4_000
VOCABULARY = 2_000
LEAST_DOCS = 5
STEPS = 20
ROUNDS = 2_000
CLOSE = 0.002
SPACE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Hashes of the words of a text, repeats included; null counts as empty. (Arrays of numbers are compared by hash sets.)"""
    words = F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), SPACE), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, vocabulary: int = VOCABULARY) -> dict:
    """Log-odds of each domain against clean: a prior, and whole-number weights of the most telling words.

    Learned from at most ``train_docs`` labelled documents, chosen by hashed id. Labels with a null are left
    out; quality 0 makes a document low, else toxic 1 makes it toxic. A domain of fewer than ``LEAST_DOCS`` labelled
    documents can't be learned: no document belongs to it.
    """
    domain = F.when(F.col("quality") == 0, 1).when(F.col("toxic") == 1, 2).otherwise(0)
    marked = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.max(domain).alias("domain"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    rows = cut_lineage(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("domain", F.array_distinct(words_of(F.col("text"))).alias("words")))
    sizes = {r.domain: r["count"] for r in rows.groupBy("domain").count().collect()}
    n = [sizes.get(k, 0) for k in range(3)]
    taught = [k for k in (1, 2) if n[k] >= LEAST_DOCS and n[0] >= LEAST_DOCS]
    if not taught:
        return {"prior": [0.0, -math.inf, -math.inf], "weights": {}}
    held = [F.sum((F.col("domain") == k).cast("long")).alias(f"n{k}") for k in range(3)]
    seen = rows.select("domain", F.explode("words").alias("word")).groupBy("word").agg(*held)
    share = [(F.col(f"n{k}") + 0.1) / (n[k] + 0.2) for k in range(3)]
    odds = {k: F.round(F.least(F.greatest(F.log(share[k] / share[0]), F.lit(-6.0)), F.lit(6.0))) for k in (1, 2)}
    said = F.greatest(F.lit(0.0), *(F.abs(share[k] - share[0]) * F.abs(F.log(share[k] / share[0])) for k in taught))
    telling = (
        seen.where(F.col("n0") + F.col("n1") + F.col("n2") >= LEAST_DOCS)
        .select("word", said.alias("said"), *(odds[k].cast("int").alias(f"w{k}") for k in (1, 2)))
        .where("w1 <> 0 or w2 <> 0")
        .orderBy(F.desc("said"), "word")
        .limit(vocabulary)
        .collect()
    )
    weights: dict = {}
    for row in telling:
        for k in taught:
            if row[f"w{k}"]:
                weights.setdefault((k, row[f"w{k}"]), []).append(row.word)
    prior = [math.log((n[k] + 0.5) / (n[0] + 0.5)) if k in (0, *taught) else -math.inf for k in range(3)]
    return {"prior": prior, "weights": weights}


def posteriors(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` plus p_clean, p_low, p_toxic (which add up to one) and n_tokens.

    Tokens are the words and one for the end. The sum of a document's word weights is damped by the square root of how many it has, as neighbouring
    words say much the same. A null or empty text gets the prior. Columns of these names are replaced.
    """
    names = [*(f"p_{d}" for d in DOMAINS), "n_tokens"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    every = sorted({w for words in model["weights"].values() for w in words})

    def literal(words: list[int]) -> Column:
        return F.lit(words) if words else F.array().cast("array<bigint>")

    split = computed(docs, kept, {"__words": words_of(F.col("text"))})
    held = computed(split, kept, {"n_tokens": (F.size("__words") + 1).cast("long"), "__held": F.array_intersect("__words", literal(every))})

    def score(k: int) -> Column:
        total = F.lit(0)
        for (domain, weight), words in sorted(model["weights"].items()):
            if domain == k:
                total = total + weight * F.size(F.array_intersect("__held", literal(words)))
        return F.lit(model["prior"][k]) + total / F.greatest(F.lit(1.0), F.sqrt(F.size("__held") / 4))

    if all(map(math.isinf, model["prior"][1:])):
        return held.select(*kept, F.lit(1.0).alias("p_clean"), F.lit(0.0).alias("p_low"), F.lit(0.0).alias("p_toxic"), "n_tokens")
    scored = computed(held, [*kept, "n_tokens"], {f"__e{k}": F.exp(F.least(score(k), F.lit(50.0))) for k in (1, 2)})
    whole = F.lit(1.0) + F.col("__e1") + F.col("__e2")
    return scored.select(*kept, (1 / whole).alias("p_clean"), (F.col("__e1") / whole).alias("p_low"), (F.col("__e2") / whole).alias("p_toxic"), "n_tokens")


def cell() -> list[Column]:
    """The cell of a document's posteriors: their whole steps, low and toxic."""
    return [F.floor(F.col(f"p_{d}") * STEPS).cast("int").alias(d) for d in DOMAINS[1:]]


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def rates(scored: DataFrame, targets: dict[str, float] = TARGETS, rounds: int = ROUNDS) -> DataFrame:
    """(low, toxic, p_low, p_toxic, rate, gap): the fitted rate of every cell of ``scored``, with its mean posteriors by token.

    The total is what leaves the expected tokens of the clean domain as they are. Documents of a scarce domain
    get rates above one; only a domain without any expected tokens is left out. ``gap`` is the greatest distance of a
    domain's expected tokens from its target, as a share of the target (of no less than ``CLOSE`` of the total): it is above ``CLOSE``
    if ``rounds`` steps didn't reach the targets, or no rates can. An empty table gives no rates.
    """
    mean = [F.round(F.sum(F.col("n_tokens") * F.col(f"p_{d}")) / F.sum("n_tokens"), 12).alias(f"p_{d}") for d in DOMAINS]
    cells = cut_lineage(scored.groupBy(*cell()).agg(F.sum("n_tokens").cast("double").alias("tokens"), *mean))
    names = [*DOMAINS[1:], *(f"p_{d}" for d in DOMAINS), "tokens"]
    one = F.lit(1.0)
    row = cells.agg(F.sort_array(F.collect_list(F.struct(*names, one.alias("rate"), one.alias("ahead")))).alias("cells"))

    def totals(cells: Column, rate: str) -> Column:
        def add(sums: Column, c: Column) -> Column:
            return F.struct(*((sums[d] + c[rate] * c["tokens"] * c[f"p_{d}"]).alias(d) for d in DOMAINS))

        return F.aggregate(cells, F.struct(*(F.lit(0.0).alias(d) for d in DOMAINS)), add)

    row = computed(row, ["cells"], {"start": totals(F.col("cells"), "rate")})
    whole = F.col(f"start.{DOMAINS[0]}") / targets[DOMAINS[0]]
    aims = {d: whole * targets[d] for d in DOMAINS}
    row = computed(row, ["cells", "start"], {"least": CLOSE * whole, **{f"aim_{d}": aims[d] for d in DOMAINS}})

    def gap(now: Column) -> Column:
        off = [F.when(F.col(f"start.{d}") > 0, F.abs(now[d] - F.col(f"aim_{d}")) / F.greatest(f"aim_{d}", "least")) for d in DOMAINS]
        return F.coalesce(F.greatest(*off), F.lit(0.0))

    def stepped(cells: Column, done: Column) -> Column:
        def by_slope(found: Column) -> Column:
            off = {d: F.when(F.col(f"start.{d}") > 0, (found[d] - F.col(f"aim_{d}")) / F.col(f"start.{d}")).otherwise(0.0) for d in DOMAINS}
            return F.struct(*(x.alias(d) for d, x in off.items()))

        def step(slope: Column) -> Column:
            def onward(c: Column) -> Column:
                rate = F.greatest(F.lit(0.0), c["ahead"] - sum((c[f"p_{d}"] * slope[d] for d in DOMAINS), F.lit(0.0)))
                held = [c[x].alias(x) for x in names]
                return _once(rate, lambda r: F.struct(*held, r.alias("rate"), (r + done / (done + 3) * (r - c["rate"])).alias("ahead")))

            return F.transform(cells, onward)

        return _once(_once(totals(cells, "ahead"), by_slope), step)

    def state(cells: Column) -> Column:
        return _once(cells, lambda x: F.struct(x.alias("cells"), gap(totals(x, "rate")).alias("gap")))

    def fold(held: Column, done: Column) -> Column:
        return F.when(held["gap"] <= CLOSE, held).otherwise(state(stepped(held["cells"], done)))

    fitted = computed(row, [], {"x": F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), state(F.col("cells")), fold)})
    return cut_lineage(fitted.select("x.gap", F.inline("x.cells")).select(*DOMAINS[1:], "p_low", "p_toxic", "rate", "gap"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) plus p_clean, p_low, p_toxic, n_tokens, rate, gap and copies.

    ``copies`` is the whole number of times to take the document: the rate rounded up with the chance of its
    fraction, by a hash of id and text, so that it is the same in every run and right in expectation. ``gap`` is that of the rates. Null and empty texts count one token. Repeated rows get equal
    copies. Columns of the new names are replaced; an empty table stays empty. Posteriors are written once, with the
    columns kept, and read for the rates and for the result.
    """
    model = fit(docs, labels)
    new = [*(f"p_{d}" for d in DOMAINS), "n_tokens"]
    kept = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c not in (*new, "rate", "gap", "copies")]
    at = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 24)) / float(1 << 24)
    scored = written(posteriors(docs.withColumn("__at", at), model).select(*kept, *new, "__at"))
    found = rates(scored, targets).select(F.col("low").alias("__low"), F.col("toxic").alias("__toxic"), "rate", "gap")
    low, toxic = cell()
    joined = scored.join(F.broadcast(found), (low == F.col("__low")) & (toxic == F.col("__toxic")))  # no more rows than there are cells
    return joined.select(*kept, *new, "rate", "gap", F.floor(F.col("rate") + F.col("__at")).cast("long").alias("copies"))


def take(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """``docs`` with each row as often as its copies say; columns as they were."""
    names = docs.columns
    aliased = docs.select(*(F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(names)), "doc_id", "text")
    mixed = mix(aliased, labels, targets, keep=[f"__{i}" for i in range(len(names))])
    again = mixed.where("copies > 0").withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return again.select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(names)))
