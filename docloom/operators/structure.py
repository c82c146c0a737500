"""Ordered-sequence operators over document structure: links, rank stacks, gaps, islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The rank of each ranked node type.
LEVEL_RANK = {"CHAPTER": 0, "PART": 0, "ARTICLE": 1, "NUMBERED_SECTION": 1, "DECISION_ITEM": 1, "SECTION": 1, "SUBSECTION": 2, "CLAUSE": 2, "NUMBERED_ITEM": 2, "LETTER_ITEM": 3, "ROMAN_ITEM": 4, "NESTED_ITEM": 5}
RANKS = 6
GAP_PENALTY = 0.25
USABLE_CHARS, IMAGE_HEAVY = 20, 0.6


def paragraphs(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, line): the non-blank lines of each text as nodes in reading order."""
    lines = docs.select(key, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(F.length(F.trim("line")) > 0).withColumn("pos", F.col("pos").cast("long"))


def sibling_links(nodes: DataFrame, parent: str, order: str) -> DataFrame:
    """``nodes`` plus the previous and next sibling's order value and a sequence number from 0."""
    place = Window.partitionBy(parent).orderBy(order)
    return nodes.withColumns({"previous": F.lag(order).over(place), "next": F.lead(order).over(place), "sequence": (F.row_number().over(place) - 1).cast("long")})


def _last_of_rank(keys: list[str], order: str, rank: str, carry: str | None) -> list[Column]:
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    value = F.struct(F.col(order).alias("at"), F.col(carry).alias("carried")) if carry else F.col(order)
    return [F.max(F.when(F.col(rank) == k, value)).over(before) for k in range(RANKS)]


def rank_stack(nodes: DataFrame, keys: list[str], order: str, rank: str = "rank", carry: str | None = None) -> DataFrame:
    """``nodes`` plus ``ancestors``: order values of the open ranked nodes above each, outermost first.

    A rank's last node is open if no node of a smaller rank came after it; a ranked node sees only smaller
    ranks, a node without rank sees all. Six running maxima, no loop over rows. With ``carry`` the ancestors
    are structs (at, carried) of the order value and that column.
    """
    names = [f"__last{k}" for k in range(RANKS)]
    marked = nodes.withColumns(dict(zip(names, _last_of_rank(keys, order, rank, carry))))
    open_ = []
    for k, name in enumerate(names):
        at = [F.col(f"{x}.at") if carry else F.col(x) for x in names[: k + 1]]
        smaller = [F.coalesce(x, F.lit(-1)) for x in at[:-1]]
        shut = F.greatest(*smaller) if len(smaller) > 1 else smaller[0] if smaller else F.lit(-1)
        seen = F.col(rank).isNull() | (F.col(rank) > k)
        open_.append(F.when(seen & (at[-1] > shut), F.col(name)))
    return marked.withColumn("ancestors", F.filter(F.array(*open_), lambda x: x.isNotNull())).drop(*names)


def sequence_gaps(nodes: DataFrame, keys: list[str], order: str, value: str, confidence: Column) -> DataFrame:
    """``nodes`` plus ``gap`` and ``confidence``: nodes whose number isn't the one after the last lose ``GAP_PENALTY``."""
    last = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    numbered = nodes.where(F.col(value).isNotNull()).withColumn("gap", F.coalesce(F.col(value) != last + 1, F.lit(False)))
    return numbered.withColumn("confidence", F.round(F.greatest(F.lit(0.0), confidence - F.when(F.col("gap"), GAP_PENALTY).otherwise(0.0)), 3))


def islands(rows: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """Runs of equal labels: (key, label, start, end, n)."""
    place = Window.partitionBy(key).orderBy(order)
    fresh = F.coalesce((F.lag(label).over(place) != F.col(label)).cast("long"), F.lit(1))
    marked = rows.withColumn("__fresh", fresh).withColumn("island", F.sum("__fresh").over(place))
    return marked.groupBy(key, "island", label).agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n"))


def classify_page(chars: Column, pictures: Column, tables: Column, picture_share: Column) -> Column:
    """A page's category; the first rule that fits decides."""
    usable = chars >= USABLE_CHARS
    return (
        F.when((chars == 0) & (pictures == 0) & (tables == 0), "UNKNOWN")
        .when(~usable & (pictures > 0), "SCANNED")
        .when(picture_share >= IMAGE_HEAVY, "IMAGE_HEAVY")
        .when((tables >= 1) & usable, "TABLE_HEAVY")
        .when(usable & (pictures > 0), "LAYOUT_COMPLEX")
        .when(usable, "DIGITAL_TEXT")
        .otherwise("UNKNOWN")
    )


def containing_region(nodes: DataFrame, regions: DataFrame, key: str, at: str) -> DataFrame:
    """``nodes`` plus ``region``: the first region (start, end, sequence) that contains the node's place, else the key's last region.

    A region lies in one or two cells of the smallest power of two that is as wide as it is, and a place in one cell of each
    width that occurs: regions and places meet by (key, width, cell), whatever the number of regions of a key. A null place lies in
    no region, a key without regions has a null one, and regions that end before they start contain nothing.
    """
    sized = regions.where("start <= end").withColumn("__level", F.ceil(F.log2(F.col("end") - F.col("start") + 1)).cast("int"))
    levels = sorted(r["__level"] for r in sized.select("__level").distinct().collect())  # 64 at most
    cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("__level"))).cast("long")
    cells = sized.select(key, "sequence", "start", "end", "__level", F.explode(F.sequence(cell("start"), cell("end"))).alias("__cell"))
    places = nodes.select(key, at).distinct().withColumn("__level", F.explode(F.array(*map(F.lit, levels or [0])))).withColumn("__cell", cell(at))
    met = places.join(cells, [key, "__level", "__cell"]).where(F.col(at).between(F.col("start"), F.col("end")))
    first = met.groupBy(key, at).agg(F.min("sequence").alias("__first"))
    last = regions.groupBy(key).agg(F.max(F.struct("sequence", "start", "end"))["sequence"].alias("__last"))
    joined = nodes.join(first, [key, at], "left").join(last, key, "left")
    return joined.select(*nodes.columns, F.coalesce("__first", "__last").alias("region"))
