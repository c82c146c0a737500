"""Trees of nodes: adjacency from levels, table cells, ancestors, reading order, ranges of groups, uncovered pages.

A node is (doc_id, pos, parent): ``pos`` numbers a document's nodes in reading order and ``parent`` is the pos of
the node above, which comes before it. Walks are joins of nodes with their ancestors, one round a level of the tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import cut_lineage

LEVELS = 16  # deepest level of an item, from 0


def adjacency(items: DataFrame) -> DataFrame:
    """``items`` (doc_id, pos, level) plus ``parent``: the nearest earlier node of a smaller level, if just one level up; else null.

    A level of ``LEVELS`` or more is an error.
    """
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == k, F.struct("pos", "level"))).over(before).alias(f"__{k}") for k in range(LEVELS)]
    held = items.select("*", *last)
    above = F.greatest(*(F.when(F.col("level") > k, F.col(f"__{k}")) for k in range(LEVELS)))
    level = F.when(F.col("level") < LEVELS, F.col("level")).otherwise(F.raise_error(F.lit("level beyond the deepest")).cast("int"))
    parent = F.when(above["level"] == level - 1, above["pos"])
    return held.withColumn("parent", parent).drop(*(f"__{k}" for k in range(LEVELS)))


def table_cells(tables: DataFrame) -> DataFrame:
    """(doc_id, pos, row, cell, text) of ``tables`` (doc_id, pos, cells: array of arrays of text): rows, then the cells of each."""
    rows = tables.select("doc_id", "pos", F.posexplode("cells").alias("row", "cells"))
    return rows.select("doc_id", "pos", F.col("row").cast("long"), F.posexplode("cells").alias("cell", "text")).withColumn("cell", F.col("cell").cast("long"))


def rendered_tables(cells: DataFrame) -> DataFrame:
    """(doc_id, pos, table_text): cells of a row joined by bars, rows by line ends."""
    rows = cells.groupBy("doc_id", "pos", "row").agg(F.sort_array(F.collect_list(F.struct("cell", F.coalesce("text", F.lit("")).alias("t")))).alias("c"))
    lines = rows.select("doc_id", "pos", "row", F.array_join(F.transform("c", lambda x: x["t"]), " | ").alias("line"))
    held = lines.groupBy("doc_id", "pos").agg(F.sort_array(F.collect_list(F.struct("row", "line"))).alias("l"))
    return held.select("doc_id", "pos", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("table_text"))


def ancestry(nodes: DataFrame) -> DataFrame:
    """(doc_id, pos, above, distance) for every node and each node above it."""
    edges = nodes.where("parent is not null and parent < pos").select("doc_id", "pos", F.col("parent").alias("above"))
    up = edges.select("doc_id", F.col("pos").alias("above"), F.col("above").alias("next"))
    step = cut_lineage(edges.withColumn("distance", F.lit(1).cast("long")))
    found = step
    while not step.isEmpty():
        step = cut_lineage(step.join(up, ["doc_id", "above"]).select("doc_id", "pos", F.col("next").alias("above"), (F.col("distance") + 1).alias("distance")))
        found = found.unionByName(step)
    return found


def moves_checked(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """``moves`` (doc_id, pos, to) plus ``rejected``: a node can't go below itself or below a node of its own subtree."""
    below = ancestry(nodes).select("doc_id", F.col("pos").alias("to"), F.col("above").alias("pos"), F.lit(True).alias("below"))
    return moves.join(below, ["doc_id", "pos", "to"], "left").select("doc_id", "pos", "to", ((F.col("pos") == F.col("to")) | F.col("below").isNotNull()).alias("rejected"))


def reading_order(nodes: DataFrame) -> DataFrame:
    """``nodes`` (doc_id, pos, parent, sequence) plus ``place`` from 0: depth first, siblings by sequence.

    A node whose parent isn't among the nodes counts as a root.
    """
    known = nodes.select("doc_id", F.col("pos").alias("parent"), F.lit(True).alias("known"))
    held = nodes.join(known, ["doc_id", "parent"], "left").withColumn("parent", F.when(F.col("known"), F.col("parent"))).drop("known")
    key = F.struct(F.col("sequence"), F.col("pos"))
    own = held.select("doc_id", "pos", key.alias("key"))
    above = ancestry(held).join(own.withColumnRenamed("pos", "above"), ["doc_id", "above"])
    keys = above.groupBy("doc_id", "pos").agg(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), "key"))).alias("k"))
    path = F.concat(F.coalesce(F.transform("k", lambda x: x["key"]), F.array().cast("array<struct<sequence:bigint,pos:bigint>>")), F.array(key))
    placed = held.join(keys, ["doc_id", "pos"], "left").withColumn("__path", path)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("__path")) - 1
    return placed.select(*nodes.columns, place.cast("long").alias("place"))


def group_ranges(nodes: DataFrame) -> DataFrame:
    """(doc_id, pos, page_start, page_end, position): a node's own page and position, or those its descendants span.

    ``nodes``: doc_id, pos, parent, page and position; null in groups.
    """
    own = nodes.select("doc_id", "pos", F.col("pos").alias("of"), "page", "position")
    lower = ancestry(nodes).select("doc_id", F.col("above").alias("of"), "pos").join(nodes.select("doc_id", "pos", "page", "position"), ["doc_id", "pos"]).select("doc_id", "pos", "of", "page", "position")
    spans = own.unionByName(lower).groupBy("doc_id", "of").agg(F.min("page").alias("low"), F.max("page").alias("high"), F.min("position").alias("first"))
    joined = nodes.join(spans.withColumnRenamed("of", "pos"), ["doc_id", "pos"])
    return joined.select("doc_id", "pos", F.coalesce("page", "low").alias("page_start"), F.coalesce("page", "high").alias("page_end"), F.coalesce("position", "first").alias("position"))


def uncovered_pages(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, page, node_type, sequence): an unknown block for each of ``pages`` (doc_id, page) that no node of ``nodes`` lies on.

    Blocks are numbered on from the document's top-level nodes. ``nodes``: doc_id, parent, page (null in groups).
    """
    bare = pages.join(nodes.where("page is not null").select("doc_id", "page"), ["doc_id", "page"], "left_anti")
    tops = nodes.where("parent is null").groupBy("doc_id").agg(F.count("*").alias("tops"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page")) - 1
    return bare.join(tops, "doc_id", "left").select("doc_id", "page", F.lit("UNKNOWN_BLOCK").alias("node_type"), (place + F.coalesce("tops", F.lit(0))).cast("long").alias("sequence"))
