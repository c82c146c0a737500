"""Chunks of a document tree: roots, subtrees within a token budget, splits, and rows with their neighbours.

Nodes are (doc_id, pos, parent, kind, text, title, page), ``pos`` in reading order. A chunk stands for a node whose
every ancestor inside the chunk root is over the budget; it holds the whole subtree's text if that fits, else
its own, and then its children are chunks of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.regulations import level_rank
from docloom.operators.structure import rank_stack
from docloom.operators.trees import ancestry, rendered_tables
from docloom.session import cut_lineage

MAX_TOKENS = 400
EXPAND_BELOW = 40
# Node types that begin a chunk.
ROOTS = ["ARTICLE", "DECISION_ITEM", "NUMBERED_SECTION", "APPENDIX"]
FALLBACK_ROOTS = ["SECTION", "SUBSECTION"]
TABLE = "TABLE"
_SENTENCE = r"(?U)(?<=[.!?])\s+"


def regrouped(nodes: DataFrame) -> DataFrame:
    """``nodes`` with flat siblings nested by rank: a ranked node takes what follows it until one of its rank or above."""
    ranked = nodes.withColumn("rank", level_rank(F.col("kind")))
    stacked = rank_stack(ranked, ["doc_id", "parent"], "pos")
    return stacked.withColumn("parent", F.coalesce(F.try_element_at("ancestors", F.lit(-1)), "parent")).drop("rank", "ancestors")


def _filled(column: str) -> Column:
    return F.coalesce(F.length(column) > 0, F.lit(False))


def _tokens(chars: Column) -> Column:
    return F.when(chars <= 0, 0).otherwise(F.greatest(F.lit(1), F.floor(chars / 4))).cast("long")


def _cuts(sizes: np.ndarray, runs: np.ndarray, budget: int) -> list[list[int]]:
    """Where pieces start among units in line, from 1, and how many each holds: a piece holds as many as the budget takes, one at least, all of one run."""
    total = np.cumsum(sizes)
    ends = np.append(np.flatnonzero(runs[1:] != runs[:-1]) + 1, len(runs))
    starts, at = [], 0
    while at < len(sizes):
        starts.append(at)
        full = np.searchsorted(total, total[at] - sizes[at] + budget, "right")
        at = max(at + 1, min(int(full), int(ends[np.searchsorted(ends, at, "right")])))
    return [[a + 1, b - a] for a, b in zip(starts, [*starts[1:], len(sizes)])]


def split_texts(df: DataFrame, text: str, budget: int = MAX_TOKENS) -> DataFrame:
    """``df`` plus ``pieces`` of each text: filled lines packed to at most ``budget`` tokens; a line over it is packed by sentences, apart from its neighbours.

    A single sentence over the budget is a piece. A blank text is its own piece, a null one an empty piece. Only sizes go to
    Python, where the cuts are found; texts stay in the engine.
    """

    @F.pandas_udf("array<array<int>>")
    def cuts(sizes: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([_cuts(np.asarray(s, np.int64), np.asarray(r, np.int64), budget) for s, r in zip(sizes, runs)])

    size = lambda part: F.greatest(F.lit(1), F.floor(F.length(part) / 4)).cast("int")
    filled = lambda part: part.rlike(r"(?U)\S")
    unit = lambda part, run: F.struct(part.alias("part"), size(part).alias("size"), run.cast("int").alias("run"))
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), filled)
    # a line that is cut into sentences is a run by its number, whole lines in line are one run
    by_line = F.transform(lines, lambda line, i: F.when(size(line) <= budget, F.array(unit(line, F.lit(-1)))).otherwise(F.transform(F.filter(F.split(line, _SENTENCE), filled), lambda x: unit(x, i))))
    # by way of generators: a filter on pieces, or one that exploding them brings in, would carry the Python call below a join, where it can't run
    columns = [F.col(f"`{c}`") for c in df.columns]
    row = lambda column, name: F.inline(F.array(F.struct(column.alias(name))))
    held = df.select(*columns, row(F.flatten(by_line), "__units"))
    held = held.select(*columns, "__units", row(cuts(F.col("__units.size"), F.col("__units.run")), "__cuts"))
    packed = F.transform("__cuts", lambda x: F.array_join(F.transform(F.slice("__units", x[0], x[1]), lambda u: u["part"]), "\n"))
    return held.select(*columns, F.when(F.size("__units") > 0, packed).otherwise(F.array(whole)).alias("pieces"))


def table_texts(nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc_id, pos, text) of the tables of ``nodes``: a table's own text, if it has any, above its rows. ``cells``: doc_id, pos, row, cell, text."""
    own = nodes.where(F.col("kind") == TABLE).select("doc_id", "pos", F.when(_filled("text"), F.col("text")).alias("own"))
    return own.join(rendered_tables(cells), ["doc_id", "pos"], "left").select("doc_id", "pos", F.concat_ws("\n", "own", "table_text").alias("text"))


def chunks(nodes: DataFrame, budget: int = MAX_TOKENS, cells: DataFrame | None = None) -> DataFrame:
    """(doc_id, pos, root, up, depth, sequence, chars, n_tokens, form, page_start, page_end, previous, next) of every node that is a chunk.

    ``up`` is the parent chunk's pos; ``form`` says what the chunk holds: TABLE, WHOLE (its subtree), OWN (its own text,
    as it is too large) or SPLIT (no text; see ``split_texts``). ``chars`` counts the text held, or to be split; that of a table
    with its ``cells``, as ``table_texts`` gives it.
    """
    if cells is not None:
        full = table_texts(nodes, cells).withColumnRenamed("text", "__full")
        nodes = nodes.join(full, ["doc_id", "pos"], "left").withColumn("text", F.coalesce("__full", "text")).drop("__full")
    # written once: the tree is read by every step below
    tree = cut_lineage(
        regrouped(nodes).select("doc_id", "pos", "parent", "kind", "page", (_filled("text") | _filled("title")).alias("has"), F.when(_filled("text"), F.length("text")).otherwise(0).alias("chars"))
    )
    above = ancestry(tree)
    facts = tree.select("doc_id", "pos", "kind", "has", "chars")
    # what lies in tables is chunked with them
    tabled = above.join(facts.where(F.col("kind") == TABLE).select("doc_id", F.col("pos").alias("above")), ["doc_id", "above"], "left_semi").select("doc_id", "pos").distinct()
    open_ = tree.join(tabled, ["doc_id", "pos"], "left_anti")
    pairs = cut_lineage(above.join(tabled, ["doc_id", "pos"], "left_anti"))
    lower = pairs.join(facts, ["doc_id", "pos"]).groupBy("doc_id", F.col("above").alias("pos")).agg(
        F.max("has").alias("has_below"),
        F.sum(F.when(F.col("kind") != TABLE, F.col("chars")).otherwise(0)).alias("chars_below"),
        F.count_if((F.col("kind") != TABLE) & (F.col("chars") > 0)).alias("texts_below"),
        F.count_if((F.col("distance") == 1) & (F.col("kind") != TABLE)).alias("children"),
        F.max(F.col("has") | F.col("kind").isin(TABLE, *ROOTS)).alias("claims_below"),
    )
    every = open_.join(lower, ["doc_id", "pos"], "left").na.fill(0, ["chars_below", "texts_below", "children"])
    leads = F.col("kind").isin(ROOTS) | (F.col("kind").isin(FALLBACK_ROOTS) & (F.col("has") | F.coalesce("has_below", F.lit(False))))
    n_texts = F.col("texts_below") + (F.col("chars") > 0).cast("int")
    whole = F.col("chars") + F.col("chars_below") + F.greatest(n_texts - 1, F.lit(0))
    every = cut_lineage(every.withColumns({"leads": leads, "whole": whole, "over": _tokens(whole) > budget}))
    over_of = every.select("doc_id", F.col("pos").alias("above"), F.col("leads").alias("leads_above"), F.col("over").alias("over_above"))
    # the outermost leading ancestor, and how many of those from the parent up to it are over the budget
    ups = pairs.join(over_of, ["doc_id", "above"]).groupBy("doc_id", "pos").agg(
        F.max(F.when(F.col("leads_above"), F.struct("distance", "above"))).alias("top"),
        F.sort_array(F.collect_list(F.struct("distance", "above", "over_above"))).alias("line"),
    )
    placed = every.join(ups, ["doc_id", "pos"], "left")
    inside = F.col("top").isNotNull() & (F.col("kind") != TABLE)
    alone = F.col("top").isNull() & ~F.col("leads") & F.col("has") & ~F.coalesce("claims_below", F.lit(False))
    is_root = (F.col("kind") == TABLE) | (F.col("top").isNull() & (F.col("leads") | alone))
    cut = inside & F.forall(F.filter("line", lambda x: x["distance"] <= F.col("top.distance")), lambda x: x["over_above"])
    kept = placed.where(is_root | cut).withColumns({"is_root": is_root, "root": F.when(is_root, F.col("pos")).otherwise(F.col("top.above"))})
    form = F.when(F.col("kind") == TABLE, "TABLE").when(~F.col("over"), "WHOLE").when(F.col("children") > 0, "OWN").otherwise("SPLIT")
    held = kept.select(
        "doc_id", "pos", "root", F.when(~F.col("is_root"), F.col("parent")).alias("up"), F.when(F.col("is_root"), 0).otherwise(F.col("top.distance")).cast("long").alias("depth"),
        form.alias("form"), F.when(form.isin("OWN", "TABLE"), F.col("chars")).otherwise(F.col("whole")).alias("chars"), "page",
    )
    held = cut_lineage(held)
    siblings = Window.partitionBy("doc_id", "up").orderBy("pos")
    spans = held.select("doc_id", "pos", "page").unionByName(
        pairs.join(held.select("doc_id", "pos", "page", "depth"), ["doc_id", "pos"]).where("distance <= depth").select("doc_id", F.col("above").alias("pos"), "page")
    ).groupBy("doc_id", "pos").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    linked = held.withColumns({"sequence": (F.row_number().over(siblings) - 1).cast("long"), "previous": F.lag("pos").over(siblings), "next": F.lead("pos").over(siblings)})
    return linked.join(spans, ["doc_id", "pos"]).select(
        "doc_id", "pos", "root", "up", "depth", "sequence", "chars", F.when(F.col("form") == "SPLIT", 0).otherwise(_tokens(F.col("chars"))).cast("long").alias("n_tokens"),
        "form", "page_start", "page_end", "previous", "next",
    )


def chunk_texts(nodes: DataFrame, found: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """(doc_id, pos, text) of the chunks ``found`` by ``chunks``: a subtree's texts in order, the node's own, or, with ``cells``, a table's; without them tables are left out."""
    tree = cut_lineage(regrouped(nodes).select("doc_id", "pos", "parent", "text", "kind"))
    own = tree.select("doc_id", "pos", "text", "kind")
    below = ancestry(tree)
    tabled = below.join(own.where(F.col("kind") == TABLE).select("doc_id", F.col("pos").alias("above")), ["doc_id", "above"], "left_semi").select("doc_id", "pos").distinct()
    members = below.join(tabled, ["doc_id", "pos"], "left_anti").select("doc_id", F.col("above").alias("of"), "pos")
    wide = found.where("form in ('WHOLE', 'SPLIT')").select("doc_id", F.col("pos").alias("of"))
    selves = found.where(F.col("form") != TABLE).select("doc_id", F.col("pos").alias("of"), "pos")
    every = members.join(wide, ["doc_id", "of"], "left_semi").unionByName(selves).join(own.where((F.col("kind") != TABLE) & _filled("text")), ["doc_id", "pos"])
    listed = every.groupBy("doc_id", F.col("of").alias("pos")).agg(F.sort_array(F.collect_list(F.struct(every["pos"].alias("at"), "text"))).alias("t"))
    texts = found.where(F.col("form") != TABLE).select("doc_id", "pos").join(listed, ["doc_id", "pos"], "left").select("doc_id", "pos", F.coalesce(F.array_join(F.transform("t", lambda x: x["text"]), "\n"), F.lit("")).alias("text"))
    if cells is None:
        return texts
    tables = found.where(F.col("form") == TABLE).select("doc_id", "pos")
    return texts.unionByName(tables.join(table_texts(nodes, cells), ["doc_id", "pos"]))


def contextual_text(title: Column, labels: Column, text: Column) -> Column:
    """A chunk's text below its document's title and the labels of its path; blank labels are left out."""
    filled = F.filter(labels, lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))
    return F.concat(F.lit("Dokumen:\n"), title, F.lit("\n\n"), F.when(F.size(filled) > 0, F.concat(F.array_join(filled, "\n"), F.lit("\n\n"))).otherwise(""), F.lit("Isi:\n"), text)


def parent_context(found: DataFrame, parents: DataFrame) -> DataFrame:
    """``found`` (chunk_id, parent_chunk_id, n_tokens) plus ``parent_text``, only for chunks of under ``EXPAND_BELOW`` tokens."""
    named = parents.select(F.col("chunk_id").alias("__p"), F.col("text").alias("parent_text"))
    return found.join(named, (F.col("parent_chunk_id") == F.col("__p")) & (F.col("n_tokens") < EXPAND_BELOW), "left").drop("__p")
