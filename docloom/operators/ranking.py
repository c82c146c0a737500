"""Scoping, ranking, fusion and evidence: the retrieval operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.session import cut_lineage

DENSE_FLOOR, DENSE_TOP, SPARSE_TOP, FUSED_TOP, EVIDENCE_TOP = 0.2, 30, 30, 20, 6
RRF_K = 60
LEADS = 32
FIRST = 4  # times k documents that are scored for a threshold
CLOSE_GAP = 0.15
QUERY_BLOCK = 256
VISIBLE = {"VIEWER": ["PUBLIC"], "EDITOR": ["PUBLIC", "INTERNAL"], "ADMIN": ["PUBLIC", "INTERNAL", "RESTRICTED"], "OWNER": ["PUBLIC", "INTERNAL", "RESTRICTED"]}


def scoped(chunks: DataFrame, organization: Column | str, role: str, space: str | None = None, document: Column | None = None) -> DataFrame:
    """The rows a role may see: tenant, visibility, and ACTIVE status, which a single-document scope replaces."""
    seen = chunks.where((F.col("organization") == organization) & F.col("visibility").isin(VISIBLE[role]))
    seen = seen.where(F.col("status") == "ACTIVE") if document is None else seen.where(F.col("document_id") == document)
    return seen if space is None else seen.where(F.col("space") == space)


def top_k_per(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key, numbered from 1; ``order`` must end in a tie-break."""
    place = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(place).cast("long")).where(F.col(rank) <= k)


def latest_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last version of each key."""
    return top_k_per(df, keys, order, 1, "__n").drop("__n")


def postings(docs: DataFrame, key: str) -> DataFrame:
    """(key, idx, tf): term frequencies by hashed token."""
    words = docs.select(F.col(key), F.explode(T.tokens(F.col("text"))).alias("token"))
    return words.groupBy(key, "token").count().groupBy(key, T.feature_hash(F.col("token")).alias("idx")).agg(F.sum("count").alias("tf"))


def weighed_index(queries: DataFrame, docs: DataFrame, query_key: str, doc_key: str) -> tuple[DataFrame, DataFrame]:
    """The postings (document, idx, tf) of the queries' terms alone, and the queries' weights (idx, query, w): query tf x idf.

    Distinct tokens are hashed once, those that share a place with a query's are joined to the documents' tokens as they are
    read, and the counts give both the frequencies and the postings.
    """
    asked = postings(queries, query_key)
    words = docs.select(F.col(doc_key), F.explode(T.tokens(F.col("text"))).alias("token"))
    places = words.select("token").distinct().select("token", T.feature_hash(F.col("token")).alias("idx"))
    vocabulary = cut_lineage(places.join(asked.select("idx").distinct(), "idx", "left_semi"))
    index = cut_lineage(words.join(vocabulary, "token").groupBy(doc_key, "idx").agg(F.count("*").alias("tf")))
    size = docs.agg(F.count("*").alias("size"))
    df = index.groupBy("idx").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("size") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return index, asked.join(df, "idx").join(F.broadcast(size)).select("idx", query_key, (F.col("tf") * idf).alias("w"))


def _summed(index: DataFrame, weighed: DataFrame, on: list[str], query_key: str, doc_key: str) -> DataFrame:
    """(query, document, score, terms). A query's weights of a term meet the term's postings as one list, so that a frequent term isn't a
    hot key of pairs; scores are summed within tasks before they are shuffled."""
    lists = weighed.groupBy(*on).agg(F.collect_list(F.struct(query_key, "w")).alias("asked"))
    pairs = index.join(lists, on).select(doc_key, "tf", F.inline("asked"))
    return pairs.groupBy(query_key, doc_key).agg(F.round(F.sum(F.col("tf") * F.col("w")), 6).alias("score"), F.count("*").alias("terms"))


def matches(queries: DataFrame, docs: DataFrame, query_key: str, doc_key: str) -> DataFrame:
    """(query, document, score, terms) of every pair with a common term: query tf x document tf x idf, summed, and how many terms are common."""
    return _summed(*weighed_index(queries, docs, query_key, doc_key), ["idx"], query_key, doc_key)


def blocked(index: DataFrame, doc_key: str) -> DataFrame:
    """``index`` plus ``block``: documents whose postings sum to about the same, within a quarter of an octave, and whose most frequent term is the same.

    The term tells languages and subjects apart, whose blocks then have low bounds for the queries of others. Only the ``LEADS`` terms that lead
    most documents are told apart, so the number of blocks is bounded.
    """
    facts = cut_lineage(index.groupBy(doc_key).agg(F.floor(F.log2(F.sum("tf")) * 4).cast("long").alias("level"), F.max(F.struct("tf", "idx"))["idx"].alias("lead")))
    order = Window.orderBy(F.desc("count"), "lead")
    leads = facts.groupBy("lead").count().orderBy(F.desc("count"), "lead").limit(LEADS).select("lead", F.row_number().over(order).cast("long").alias("slot"))
    block = F.col("level") * (LEADS + 1) + F.coalesce("slot", F.lit(0))
    return cut_lineage(index.join(facts.join(F.broadcast(leads), "lead", "left").select(doc_key, block.alias("block")), doc_key))


def block_bounds(index: DataFrame, weighed: DataFrame, query_key: str) -> DataFrame:
    """(query, block, bound): no document of a block scores above the sum of a query's weights by the block's greatest tf of each term."""
    greatest = index.groupBy("block", "idx").agg(F.max("tf").alias("tf"))
    return greatest.join(weighed, "idx").groupBy(query_key, "block").agg(F.sum(F.col("tf") * F.col("w")).alias("bound"))


def sparse_top(queries: DataFrame, docs: DataFrame, query_key: str, doc_key: str, k: int = SPARSE_TOP) -> DataFrame:
    """(query, document, score, rank) by the sum of query tf x document tf x idf, through the inverted index: the exact first ``k``, ties to the smaller document.

    The documents' postings lie in blocks of about the same sum and one leading term. For each query the block of the highest bound, and those after it until
    they hold ``FIRST`` x ``k`` documents, are scored first; the k-th score found is a threshold, and of the other blocks only
    those whose bound reaches it are scored. A query that matches fewer than ``k`` documents there has no threshold, and all its
    blocks are scored. Queries without a common term give no row.
    """
    index, weighed = weighed_index(queries, docs, query_key, doc_key)
    index, weighed = blocked(index, doc_key), cut_lineage(weighed)
    held = index.groupBy("block").agg(F.countDistinct(doc_key).alias("held"))
    before = Window.partitionBy(query_key).orderBy(F.desc("bound"), "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = block_bounds(index, weighed, query_key).join(F.broadcast(held), "block")  # at most a few thousand rows: see ``blocked``
    blocks = cut_lineage(blocks.withColumn("first", F.coalesce(F.sum("held").over(before), F.lit(0)) < FIRST * k))

    def scored(chosen: DataFrame) -> DataFrame:
        return top_k_per(_summed(index, weighed.join(chosen.select(query_key, "block"), query_key), ["block", "idx"], query_key, doc_key).drop("terms"), [query_key], order, k)

    order = [F.desc("score"), F.col(doc_key)]
    begun = cut_lineage(scored(blocks.where("first")))
    least = begun.where(F.col("rank") == k).select(query_key, F.col("score").alias("least"))
    # rounded scores may lie above their bound by half of the last place
    left = blocks.where("not first").join(least, query_key, "left").where(F.col("least").isNull() | (F.col("bound") * (1 + 1e-9) + 1e-6 >= F.col("least")))
    return top_k_per(begun.unionByName(scored(left)).drop("rank"), [query_key], order, k)


def dense_top(queries: DataFrame, vectors: DataFrame, k: int = DENSE_TOP, floor: float = DENSE_FLOOR) -> DataFrame:
    """(query_id, vec_id, score, rank): exact cosine of a stated query set against all vectors, block by block.

    Vectors are made units once. Queries are cut into blocks of at most ``QUERY_BLOCK``, and each vector meets each block
    by an equi-join on the block's number; a block keeps its best rows within the tasks before anything is ranked.
    """

    def unit(column: str):
        x = F.transform(column, lambda v: v.cast("double"))
        return F.transform(x, lambda v: v / F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, y: s + y * y)))

    n_blocks = F.broadcast(queries.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / QUERY_BLOCK)).cast("int").alias("n")))
    asked = queries.join(n_blocks).select((F.pmod(F.xxhash64("vec_id"), F.col("n"))).alias("b"), F.col("vec_id").alias("query_id"), unit("embedding").alias("q"))
    blocks = asked.groupBy("b").agg(F.collect_list(F.struct("query_id", "q")).alias("qs"))
    rows = vectors.join(n_blocks).select("vec_id", unit("embedding").alias("e"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("b"))
    pairs = rows.join(blocks, "b").select("vec_id", "e", F.inline("qs")).where("vec_id <> query_id")
    cosine = F.aggregate(F.zip_with("e", "q", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.select("query_id", "vec_id", F.round(cosine, 6).alias("score")).where(F.col("score") >= floor)
    return top_k_per(scored, ["query_id"], [F.desc("score"), F.col("vec_id")], k)


def fuse(first: DataFrame, second: DataFrame, query: str, item: str, k: int = FUSED_TOP) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists; ties in the order of the first list, then of the second."""
    both = first.select(query, item, F.col("rank").alias("r1"), F.lit(None).cast("long").alias("r2")).unionByName(
        second.select(query, item, F.lit(None).cast("long").alias("r1"), F.col("rank").alias("r2"))
    )
    merged = both.groupBy(query, item).agg(F.min("r1").alias("r1"), F.min("r2").alias("r2"))
    share = F.coalesce(1 / (RRF_K + F.col("r1")), F.lit(0.0)) + F.coalesce(1 / (RRF_K + F.col("r2")), F.lit(0.0))
    scored = merged.withColumn("score", F.round(share, 9))
    return top_k_per(scored, [query], [F.desc("score"), F.asc_nulls_last("r1"), F.asc_nulls_last("r2"), F.col(item)], k).select(query, item, "score", "rank")


def rerank_decision(ranked: DataFrame, query: str, document: str, exact: Column | None = None) -> DataFrame:
    """Per query whether to rerank: never for one row; for several documents; else never for exact matches; for over six rows, or a close lead.

    ``exact`` says of a row whether its query was matched exactly.
    """
    lead = Window.partitionBy(query).orderBy("rank")
    facts = ranked.withColumn("second", F.lead("score").over(lead)).groupBy(query).agg(
        F.count("*").alias("n"),
        F.countDistinct(document).alias("n_documents"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"),
        F.max(F.when(F.col("rank") == 1, F.col("second"))).alias("s2"),
        F.bool_or(F.lit(False) if exact is None else exact).alias("exact"),
    )
    close = (F.col("s1") > 0) & ((F.col("s1") - F.col("s2")) / F.col("s1") < CLOSE_GAP)
    verdict = F.when(F.col("n") <= 1, False).when(F.col("n_documents") > 1, True).when(F.col("exact"), False).when(F.col("n") > EVIDENCE_TOP, True).otherwise(F.coalesce(close, F.lit(False)))
    return facts.select(query, F.col("n").alias("n_rows"), "n_documents", verdict.alias("rerank"))
