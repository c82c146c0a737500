"""Regulation grammars over lines in reading order: segments, grammar, typed nodes, paths and parts of the tree.

Nodes are rows (doc_id, pos, node_type, text, title, style, marker, raw). Everything here is a window over a
document's nodes in order of ``pos``; no step gathers a document into one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.structure import LEVEL_RANK, rank_stack

# The words and types that decide grammars, roles and flags.
DECISION = r"(?i)\b(MENIMBANG|MENGINGAT|MEMUTUSKAN)\b"
ARTICLE = r"(?i)\bPasal\b"
PROCEDURAL = r"(?i)\b(TUJUAN|RUANG\s+LINGKUP|PROSEDUR)\b"
ARTICLE_HEADER = r"(?i)^\s*Pasal\s+\d+\b"
CHAPTER_LINE, ARTICLE_LINE = r"(?i)^\s*BAB\s+([IVXLCDM]+|\d+)\b", r"(?i)^\s*Pasal\s+(\d+)\b"
LETTERS = ["LETTER_DOT", "LETTER_PAREN_CLOSE", "LETTER_PAREN_FULL"]
ROMANS = ["ROMAN_UPPER_DOT", "ROMAN_LOWER_DOT"]
DECIMALS = ["DECIMAL_DOT", "DECIMAL_PAREN_CLOSE", "DECIMAL_PAREN_FULL"]
DECISION_ROLES = {"MENIMBANG": "LEGAL_BASIS", "MENGINGAT": "LEGAL_BASIS", "MEMUTUSKAN": "DECISION", "MENETAPKAN": "DECISION"}
PROCEDURAL_ROLES = {"TUJUAN": "OBJECTIVE", "RUANG LINGKUP": "SCOPE", "PROSEDUR": "PROCEDURE"}
NUMBERABLE = ["SECTION", "SUBSECTION", "LIST_ITEM", "PARAGRAPH"]
NUMBERED_TYPES = ["CHAPTER", "ARTICLE", "CLAUSE", "NUMBERED_SECTION", "NUMBERED_ITEM", "LETTER_ITEM", "ROMAN_ITEM", "DECISION_ITEM"]
DIAGRAMS = ["DIAGRAM", "FIGURE", "FLOWCHART", "ORGANIZATION_CHART"]
DIAGRAM_REGIONS = ["DIAGRAM_REGION", "ORGANIZATION_CHART", "FLOWCHART"]
TABLE_OF_CONTENTS, APPENDIX = r"(?i)\bDAFTAR\s+ISI\b", r"(?i)\bLAMPIRAN\b"
FALLBACK_LABEL = 60


def said(title: str = "title", text: str = "text") -> Column:
    """What a node says: its title, or else its text, trimmed."""
    return F.trim(F.coalesce(F.nullif(F.col(title), F.lit("")), F.col(text), F.lit("")))


def numbered(nodes: DataFrame) -> DataFrame:
    """``nodes`` plus style, marker (the number alone) and raw (as written, with its signs)."""
    found = nodes.withColumn("__n", T.detect_numbering(F.col("text")))
    raw = F.regexp_extract(F.trim("text"), r"^(\(\w+\)|\w+[.)]?)", 1)
    return found.withColumns({"style": F.col("__n.style"), "marker": F.col("__n.marker"), "raw": F.when(F.col("__n.style").isNotNull(), raw)}).drop("__n")


def segments(nodes: DataFrame) -> DataFrame:
    """``nodes`` plus ``segment``: 1 from the first section whose line begins with an article number, else 0."""
    header = F.when((F.col("node_type") == "SECTION") & said().rlike(ARTICLE_HEADER), F.col("pos"))
    whole = Window.partitionBy("doc_id")
    first = F.min(header).over(whole)
    return nodes.withColumn("segment", F.when(first.isNotNull() & (F.col("pos") >= first) & (F.min("pos").over(whole) < first), 1).otherwise(0))


def with_grammar(nodes: DataFrame) -> DataFrame:
    """``nodes`` plus ``grammar``, one for each segment: the first of decision, article and procedure whose words occur."""
    here = Window.partitionBy("doc_id", "segment")

    def occurs(pattern: str) -> Column:
        return F.max(said().rlike(pattern).cast("int")).over(here) == 1

    found = F.when(occurs(DECISION), "DECISION_BASED").when(occurs(ARTICLE), "ARTICLE_BASED").when(occurs(PROCEDURAL), "PROCEDURAL_BASED")
    return nodes.withColumn("grammar", found.otherwise("NUMBERED_SECTION_BASED"))


def _role(words: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for word, role in reversed(words.items()):
        out = F.when(F.upper(said()).startswith(word), role).otherwise(out)
    return out


def interpreted(nodes: DataFrame) -> DataFrame:
    """``nodes`` (with grammar) as the grammar types them: kind, label, role and the numbers of chapter, article, clause, letter.

    An article stays open until a chapter begins; the top number of a numbered section stays open to the end.
    Clauses and letters carry the article they stand in, and letters the clause.
    """
    upto = Window.partitionBy("doc_id", "segment").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("doc_id", "segment").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    style, marker = F.col("style"), F.col("marker")
    legal, decided = F.col("grammar") == "ARTICLE_BASED", F.col("grammar") == "DECISION_BASED"
    listed = ~legal & ~decided
    chapter = F.nullif(F.upper(F.regexp_extract(said(), CHAPTER_LINE, 1)), F.lit(""))
    article = F.nullif(F.regexp_extract(said(), ARTICLE_LINE, 1), F.lit(""))
    marked = nodes.withColumns({"__chapter": F.when(legal, chapter), "__article": F.when(legal & chapter.isNull(), article)})
    opened = F.when(F.col("__chapter").isNotNull(), "").when(F.col("__article").isNotNull(), F.col("__article"))
    top = listed & (style == "DECIMAL_DOT") & F.col("node_type").isin(NUMBERABLE)
    marked = marked.withColumns({"__open": F.last(opened, ignorenulls=True).over(upto), "__top": F.max(F.coalesce(top, F.lit(False)).cast("int")).over(before)})
    inside = legal & F.col("__chapter").isNull() & F.col("__article").isNull() & (F.coalesce("__open", F.lit("")) != "")
    kind = (
        F.when(F.col("__chapter").isNotNull(), "CHAPTER")
        .when(F.col("__article").isNotNull(), "ARTICLE")
        .when(inside & (style == "DECIMAL_PAREN_FULL"), "CLAUSE")
        .when(inside & style.isin(LETTERS), "LETTER_ITEM")
        .when(inside & style.isin(ROMANS), "ROMAN_ITEM")
        .when(decided & (style == "ORDINAL_WORD"), "DECISION_ITEM")
        .when(top, "NUMBERED_SECTION")
        .when(listed & style.isin(LETTERS) & (F.col("__top") == 1), "LETTER_ITEM")
        .when(listed & style.isin(ROMANS), "ROMAN_ITEM")
        .when(listed & style.isin("DECIMAL_PAREN_CLOSE", "DECIMAL_PAREN_FULL"), "NUMBERED_ITEM")
        .otherwise(F.col("node_type"))
    )
    typed = marked.withColumn("kind", kind)
    rest = F.trim(F.when(F.startswith(said(), F.col("raw")), F.substr(said(), F.length("raw") + 1)).otherwise(said()))
    retyped = F.col("kind")
    label = (
        F.when(retyped == "CHAPTER", F.concat(F.lit("BAB "), "__chapter"))
        .when(retyped == "ARTICLE", F.concat(F.lit("Pasal "), "__article"))
        .when(retyped == "CLAUSE", F.concat(F.lit("Ayat ("), marker, F.lit(")")))
        .when((retyped == "LETTER_ITEM") & legal, F.concat(F.lit("huruf "), marker))
        .when(retyped.isin("LETTER_ITEM", "ROMAN_ITEM", "DECISION_ITEM"), marker)
        .when(retyped == "NUMBERED_SECTION", F.when(rest != "", F.concat(marker, F.lit(". "), rest)).otherwise(marker))
        .when(retyped == "NUMBERED_ITEM", F.coalesce("raw", marker))
    )
    role = (
        F.when(retyped.isin("CHAPTER", "ARTICLE"), "GENERAL")
        .when(retyped == "DECISION_ITEM", "DECISION")
        .when(decided, _role(DECISION_ROLES))
        .when(F.col("grammar") == "PROCEDURAL_BASED", _role(PROCEDURAL_ROLES))
    )
    within = F.when(retyped.isin("CLAUSE", "LETTER_ITEM") & legal, F.col("__open"))
    typed = typed.withColumns({"label": label, "role": role, "chapter_number": F.col("__chapter"), "article_number": F.coalesce("__article", within)})
    clause = F.when(retyped == "CLAUSE", marker).when(retyped.isin("CHAPTER", "ARTICLE"), "")
    typed = typed.withColumns({"__clause": F.last(clause, ignorenulls=True).over(upto), "letter_number": F.when(retyped == "LETTER_ITEM", marker)})
    held = F.when(retyped == "CLAUSE", marker).when((retyped == "LETTER_ITEM") & legal, F.nullif("__clause", F.lit("")))
    return typed.withColumn("clause_number", held).drop("__chapter", "__article", "__open", "__top", "__clause")


def shown_label() -> Column:
    """A node's label, or else its title, the beginning of its text, or its type."""
    filled = [F.nullif(F.col(c), F.lit("")) for c in ("label", "title")]
    return F.coalesce(*filled, F.nullif(F.substring("text", 1, FALLBACK_LABEL), F.lit("")), F.col("kind"))


def level_rank(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in LEVEL_RANK.items() for x in pair)), kind)


def with_paths(nodes: DataFrame, keys: list[str] = ["doc_id", "segment"]) -> DataFrame:
    """``nodes`` plus ``labels`` (of the open ranked nodes and its own, outermost first), ``depth`` and ``path`` as one text."""
    ranked = nodes.withColumns({"shown": shown_label(), "rank": level_rank(F.col("kind"))})
    stacked = rank_stack(ranked, keys, "pos", carry="shown")
    labels = F.concat(F.transform("ancestors", lambda x: x["carried"]), F.array("shown"))
    held = stacked.withColumns({"labels": labels, "parent": F.try_element_at("ancestors", F.lit(-1))["at"]})
    return held.withColumns({"depth": F.size("labels").cast("long"), "path": F.array_join(F.filter("labels", lambda x: x != ""), " > ")})


def ordinal_value() -> Column:
    """The place in its list that a node's number stands for; null if its style has none."""
    style, marker = F.col("style"), F.trim("marker")
    letter = F.when(F.lower(marker).rlike("^[a-z]$"), F.ascii(F.lower(marker)) - 96)
    word = F.nullif(F.array_position(F.array(*map(F.lit, T.ORDINALS)), F.upper(marker)), F.lit(0))
    return (
        F.when(style.isin(DECIMALS), F.expr("try_cast(marker AS bigint)"))
        .when(style.isin(*LETTERS, "LETTER_UPPER_DOT"), letter)
        .when(style.isin(ROMANS), T.roman_to_int(marker))
        .when(style == "ORDINAL_WORD", word)
        .cast("long")
    )


def path_matches(labels: Column, terms: Column) -> Column:
    """Whether the terms occur in order among the labels, each as a whole label or one of its words."""

    def fits(label: Column, term: Column) -> Column:
        label, term = F.lower(F.trim(label)), F.lower(F.trim(term))
        return (label == term) | F.array_contains(F.split(label, r"\s+"), term)

    def onward(at: Column, term: Column) -> Column:
        hits = F.transform(labels, lambda label, i: (i >= at) & fits(label, term))
        found = F.array_position(hits, True)
        return F.when((at < 0) | (found == 0), F.lit(-1).cast("long")).otherwise(found)

    return (F.size(terms) > 0) & (F.aggregate(terms, F.lit(0).cast("long"), onward) >= 0)


def structure_flags(nodes: DataFrame, regions: DataFrame) -> DataFrame:
    """The eight flags of a document, from its node types and region types."""

    def has(column: str, *values: str) -> Column:
        return F.coalesce(F.bool_or(F.col(column).isin(*values)), F.lit(False))

    kinds = nodes.select("doc_id", "kind", F.lit(None).cast("string").alias("region_type"))
    both = kinds.unionByName(regions.select("doc_id", F.lit(None).cast("string").alias("kind"), "region_type"))
    return both.groupBy("doc_id").agg(
        has("kind", "ARTICLE").alias("articles"),
        has("kind", "NUMBERED_SECTION").alias("numbered_sections"),
        has("kind", "CHAPTER").alias("chapters"),
        has("kind", "DECISION_ITEM").alias("decision_preamble"),
        (has("kind", "APPENDIX") | has("region_type", "APPENDIX")).alias("appendices"),
        has("kind", "TABLE").alias("tables"),
        (has("kind", *DIAGRAMS) | has("region_type", *DIAGRAM_REGIONS)).alias("diagrams"),
        has("region_type", "EMBEDDED_TEMPLATE").alias("embedded_document"),
    )


def page_labels(pages: DataFrame, cover_chars: int = 400) -> DataFrame:
    """``pages`` (doc_id, page, text, chars, tables, category) plus ``region_type``; everything from the first appendix on belongs to it."""
    first = Window.partitionBy("doc_id")
    cover = (F.col("page") == 1) & (F.col("chars") < cover_chars) & (F.col("tables") == 0)
    appendix = F.min(F.when(F.col("text").rlike(APPENDIX), F.col("page"))).over(first)
    label = (
        F.when(cover, "COVER")
        .when(F.col("text").rlike(TABLE_OF_CONTENTS), "TABLE_OF_CONTENTS")
        .when(F.col("page") >= appendix, "APPENDIX")
        .when(F.col("category") == "IMAGE_HEAVY", "DIAGRAM_REGION")
        .otherwise("FREEFORM_SECTION")
    )
    return pages.withColumn("region_type", label)
