"""Regulation structure over whole documents: grammars, typed nodes, paths, regions, trees and chunks.

The driver's documents hold no regulations, so their lines are given the markers of one (``PREFIXES``): every
line of every document becomes a node of one of four kinds of text. Both engines build the nodes on their own.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import chunking, regulations, structure, trees
from docloom.plans.registry import query
from docloom.session import cut_lineage, table

# The markers that stand-in lines are given: by kind of text, then by place in a block of eight lines.
PREFIXES = [
    ["BAB {r}", "Pasal {n}", "(1) ", "a. ", "(2) ", "b) ", "", "v. "],
    ["MENIMBANG ", "a. ", "MENGINGAT ", "1. ", "MEMUTUSKAN ", "KESATU ", "KEDUA ", ""],
    ["1. TUJUAN ", "a. ", "2. RUANG LINGKUP ", "(1) ", "3. PROSEDUR ", "i. ", "DAFTAR ISI ", "b. "],
    ["{n}. ", "a. ", "1) ", "ii. ", "", "c) ", "(2) ", "LAMPIRAN {r} "],
]
LEVELS = [0, 1, 2, 3, 2, 3, 1, 4]
ROMANS = ["I", "II", "III", "IV"]
_RANK = "CASE " + " ".join(f"WHEN kind = '{k}' THEN {v}" for k, v in structure.LEVEL_RANK.items()) + " END"

NODES = f"""
ll AS (SELECT doc_id, i, lines[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
       WHERE length(trim(lines[i])) > 0),
lg AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM ll),
lp AS (SELECT doc_id, line, pos, replace(replace(({PREFIXES})[CASE WHEN doc_id % 4 = 1 AND pos >= 8 THEN 0 ELSE doc_id % 4 END + 1][pos % 8 + 1],
         '{{r}}', ({ROMANS})[pos // 8 % 4 + 1]), '{{n}}', (pos // 8 + 1)::VARCHAR) AS prefix FROM lg),
lt AS (SELECT doc_id, pos, pos // 5 + 1 AS page, ({LEVELS})[pos % 8 + 1] AS level, CASE WHEN prefix LIKE 'BAB %' OR prefix LIKE 'Pasal %' THEN prefix ELSE prefix || line END AS text,
         CASE WHEN pos % 13 = 12 THEN 'TABLE' WHEN prefix LIKE 'BAB %' OR prefix LIKE 'Pasal %' OR pos % 8 = 0 THEN 'SECTION' WHEN prefix = '' THEN 'PARAGRAPH' ELSE 'LIST_ITEM' END AS node_type FROM lp),
nodes AS (SELECT *, CASE WHEN node_type = 'SECTION' THEN text END AS title, trim(text) AS said FROM lt),
rom AS (SELECT *, regexp_extract(said, '^([IVXLCDM]+|[ivxlcdm]+)\\.', 1) AS roman FROM nodes),
num AS (SELECT *, CASE WHEN regexp_matches(said, '^\\(\\d+\\)') THEN 'DECIMAL_PAREN_FULL' WHEN regexp_matches(said, '^\\d+\\)') THEN 'DECIMAL_PAREN_CLOSE' WHEN regexp_matches(said, '^\\d+\\.') THEN 'DECIMAL_DOT'
    WHEN regexp_matches(said, '^\\([a-z]\\)') THEN 'LETTER_PAREN_FULL' WHEN regexp_matches(said, '^[a-z]\\)') THEN 'LETTER_PAREN_CLOSE' WHEN regexp_matches(said, '^({"|".join(T.ORDINALS)})\\b') THEN 'ORDINAL_WORD'
    WHEN roman <> '' AND regexp_matches(said, '^[IVXLCDM]') THEN 'ROMAN_UPPER_DOT' WHEN roman <> '' THEN 'ROMAN_LOWER_DOT'
    WHEN regexp_matches(said, '^[A-Z]\\.') THEN 'LETTER_UPPER_DOT' WHEN regexp_matches(said, '^[a-z]\\.') THEN 'LETTER_DOT' END AS style,
  regexp_extract(said, '^\\(?(\\w+)', 1) AS mark, regexp_extract(said, '^(\\(\\w+\\)|\\w+[.)]?)', 1) AS raw FROM rom),
fir AS (SELECT *, min(CASE WHEN node_type = 'SECTION' AND regexp_matches(said, '(?i)^\\s*Pasal\\s+\\d+\\b') THEN pos END) OVER (PARTITION BY doc_id) AS first FROM num),
seg AS (SELECT *, CASE WHEN first > 0 AND pos >= first THEN 1 ELSE 0 END AS segment FROM fir),
gra AS (SELECT *, CASE WHEN bool_or(regexp_matches(said, '(?i)\\b(MENIMBANG|MENGINGAT|MEMUTUSKAN)\\b')) OVER s THEN 'DECISION_BASED' WHEN bool_or(regexp_matches(said, '(?i)\\bPasal\\b')) OVER s THEN 'ARTICLE_BASED'
    WHEN bool_or(regexp_matches(said, '(?i)\\b(TUJUAN|RUANG\\s+LINGKUP|PROSEDUR)\\b')) OVER s THEN 'PROCEDURAL_BASED' ELSE 'NUMBERED_SECTION_BASED' END AS grammar FROM seg WINDOW s AS (PARTITION BY doc_id, segment))"""

TYPED = NODES + r""",
hd AS (SELECT *, grammar = 'ARTICLE_BASED' AS legal, grammar = 'DECISION_BASED' AS decided, CASE WHEN grammar = 'ARTICLE_BASED' THEN nullif(upper(regexp_extract(said, '(?i)^\s*BAB\s+([IVXLCDM]+|\d+)\b', 1)), '') END AS ch,
   CASE WHEN grammar = 'ARTICLE_BASED' THEN nullif(regexp_extract(said, '(?i)^\s*Pasal\s+(\d+)\b', 1), '') END AS ar FROM gra),
op AS (SELECT *, last_value(CASE WHEN ch IS NOT NULL THEN '' ELSE ar END IGNORE NULLS) OVER (PARTITION BY doc_id, segment ORDER BY pos) AS opened,
   coalesce(bool_or(NOT legal AND NOT decided AND coalesce(style, '') = 'DECIMAL_DOT' AND node_type IN ('SECTION', 'SUBSECTION', 'LIST_ITEM', 'PARAGRAPH')) OVER (PARTITION BY doc_id, segment ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS top FROM hd),
kd AS (SELECT *, CASE WHEN ch IS NOT NULL THEN 'CHAPTER' WHEN ar IS NOT NULL THEN 'ARTICLE' WHEN legal AND coalesce(opened, '') <> '' AND style = 'DECIMAL_PAREN_FULL' THEN 'CLAUSE'
   WHEN legal AND coalesce(opened, '') <> '' AND style IN ('LETTER_DOT', 'LETTER_PAREN_CLOSE', 'LETTER_PAREN_FULL') THEN 'LETTER_ITEM' WHEN legal AND coalesce(opened, '') <> '' AND style LIKE 'ROMAN%' THEN 'ROMAN_ITEM'
   WHEN legal THEN node_type WHEN decided AND style = 'ORDINAL_WORD' THEN 'DECISION_ITEM' WHEN decided THEN node_type
   WHEN style = 'DECIMAL_DOT' AND node_type IN ('SECTION', 'SUBSECTION', 'LIST_ITEM', 'PARAGRAPH') THEN 'NUMBERED_SECTION' WHEN top AND style IN ('LETTER_DOT', 'LETTER_PAREN_CLOSE', 'LETTER_PAREN_FULL') THEN 'LETTER_ITEM'
   WHEN style LIKE 'ROMAN%' THEN 'ROMAN_ITEM' WHEN style IN ('DECIMAL_PAREN_CLOSE', 'DECIMAL_PAREN_FULL') THEN 'NUMBERED_ITEM' ELSE node_type END AS kind FROM op),
lb AS (SELECT *, CASE WHEN kind = 'CHAPTER' THEN 'BAB ' || ch WHEN kind = 'ARTICLE' THEN 'Pasal ' || ar WHEN kind = 'CLAUSE' THEN 'Ayat (' || mark || ')' WHEN kind = 'LETTER_ITEM' AND legal THEN 'huruf ' || mark
   WHEN kind IN ('LETTER_ITEM', 'ROMAN_ITEM', 'DECISION_ITEM') THEN mark WHEN kind = 'NUMBERED_SECTION' THEN CASE WHEN trim(said[length(raw) + 1:]) = '' THEN mark ELSE mark || '. ' || trim(said[length(raw) + 1:]) END
   WHEN kind = 'NUMBERED_ITEM' THEN raw END AS label,
   CASE WHEN kind IN ('CHAPTER', 'ARTICLE') THEN 'GENERAL' WHEN kind = 'DECISION_ITEM' THEN 'DECISION' WHEN decided THEN CASE WHEN upper(said) LIKE 'MENIMBANG%' OR upper(said) LIKE 'MENGINGAT%' THEN 'LEGAL_BASIS' WHEN upper(said) LIKE 'MEMUTUSKAN%' OR upper(said) LIKE 'MENETAPKAN%' THEN 'DECISION' END
   WHEN grammar = 'PROCEDURAL_BASED' THEN CASE WHEN upper(said) LIKE 'TUJUAN%' THEN 'OBJECTIVE' WHEN upper(said) LIKE 'RUANG LINGKUP%' THEN 'SCOPE' WHEN upper(said) LIKE 'PROSEDUR%' THEN 'PROCEDURE' END END AS role,
   ch AS chapter_number, CASE WHEN kind = 'ARTICLE' THEN ar WHEN legal AND kind IN ('CLAUSE', 'LETTER_ITEM') THEN opened END AS article_number, CASE WHEN kind = 'LETTER_ITEM' THEN mark END AS letter_number,
   last_value(CASE WHEN kind = 'CLAUSE' THEN mark WHEN kind IN ('CHAPTER', 'ARTICLE') THEN '' END IGNORE NULLS) OVER (PARTITION BY doc_id, segment ORDER BY pos) AS in_clause FROM kd),
typed AS (SELECT *, CASE WHEN kind = 'CLAUSE' THEN mark WHEN kind = 'LETTER_ITEM' AND legal THEN nullif(in_clause, '') END AS clause_number,
   coalesce(nullif(label, ''), nullif(title, ''), nullif(left(text, 60), ''), kind) AS shown FROM lb)"""

PATHS = TYPED + f""",
rk AS (SELECT *, {_RANK} AS rank FROM typed),
paths AS (SELECT *, (SELECT list(b.shown ORDER BY b.pos) FROM rk b WHERE b.doc_id = a.doc_id AND b.segment = a.segment AND b.pos < a.pos AND b.rank IS NOT NULL AND (a.rank IS NULL OR b.rank < a.rank)
     AND NOT EXISTS (SELECT 1 FROM rk c WHERE c.doc_id = a.doc_id AND c.segment = a.segment AND c.pos > b.pos AND c.pos < a.pos AND c.rank <= b.rank)) AS above FROM rk a),
named AS (SELECT *, list_append(coalesce(above, []), shown) AS labels, array_to_string(list_append(coalesce(above, []), shown), ' > ') AS path FROM paths)"""


def nodes(spark, sf_dir):
    """The stand-in regulation's nodes of every document."""
    lines = structure.paragraphs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    at = lines.withColumn("pos", (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1).cast("long"))
    pos = F.col("pos")
    block, slot = F.floor(pos / 8).cast("long"), (pos % 8).cast("int")
    form = F.when((F.col("doc_id") % 4 == 1) & (pos >= 8), 0).otherwise(F.col("doc_id") % 4).cast("int")
    prefix = F.get(F.get(F.array(*(F.array(*map(F.lit, row)) for row in PREFIXES)), form), slot)
    prefix = F.replace(F.replace(prefix, F.lit("{r}"), F.get(F.array(*map(F.lit, ROMANS)), (block % 4).cast("int"))), F.lit("{n}"), (block + 1).cast("string"))
    held = at.withColumn("prefix", prefix)
    header = F.col("prefix").startswith("BAB ") | F.col("prefix").startswith("Pasal ")
    node_type = F.when(pos % 13 == 12, "TABLE").when(header | (slot == 0), "SECTION").when(F.col("prefix") == "", "PARAGRAPH").otherwise("LIST_ITEM")
    made = held.select("doc_id", "pos", (F.floor(pos / 5) + 1).alias("page"), F.get(F.array(*map(F.lit, LEVELS)), slot).alias("level"), F.when(header, F.col("prefix")).otherwise(F.concat("prefix", "line")).alias("text"), node_type.alias("node_type"))
    return made.withColumn("title", F.when(F.col("node_type") == "SECTION", F.col("text")))


def typed(spark, sf_dir):
    return regulations.interpreted(regulations.with_grammar(regulations.segments(regulations.numbered(nodes(spark, sf_dir)))))


def with_paths(spark, sf_dir):
    return regulations.with_paths(typed(spark, sf_dir))


@query(f"WITH {NODES} SELECT doc_id, segment::BIGINT AS segment, grammar, count(*) AS n_nodes, min(pos) AS first FROM gra GROUP BY ALL")
def grammar_segments(spark, sf_dir):
    found = regulations.with_grammar(regulations.segments(nodes(spark, sf_dir)))
    return found.groupBy("doc_id", F.col("segment").cast("long").alias("segment"), "grammar").agg(F.count("*").alias("n_nodes"), F.min("pos").alias("first"))


@query(f"WITH {NODES} SELECT doc_id, pos, style, CASE WHEN style IS NOT NULL THEN mark END AS marker FROM num")
def detect_numbering(spark, sf_dir):
    """The numbering of every line of every document."""
    return regulations.numbered(nodes(spark, sf_dir)).select("doc_id", "pos", "style", "marker")


@query(f"WITH {TYPED} SELECT doc_id, pos, kind, label, role, chapter_number, article_number, clause_number, letter_number FROM typed")
def interpretation(spark, sf_dir):
    return typed(spark, sf_dir).select("doc_id", "pos", "kind", "label", "role", "chapter_number", "article_number", "clause_number", "letter_number")


@query(f"WITH {PATHS} SELECT doc_id, pos, kind, len(labels)::BIGINT AS depth, path FROM named")
def structural_path(spark, sf_dir):
    """The labels of the open nodes above every node, and its own."""
    return with_paths(spark, sf_dir).select("doc_id", "pos", "kind", "depth", "path")


@query(f"""
WITH {TYPED}, o AS (SELECT doc_id, pos, segment, kind, CASE WHEN style LIKE 'DECIMAL%' THEN try_cast(mark AS BIGINT) WHEN style LIKE 'LETTER%' AND regexp_matches(lower(mark), '^[a-z]$') THEN ascii(lower(mark)) - 96
    WHEN style = 'ORDINAL_WORD' THEN list_position({T.ORDINALS}, upper(mark)) WHEN style LIKE 'ROMAN%' THEN list_sum(list_transform(range(1, length(mark) + 1), lambda i: MAP {T.ROMAN}[lower(mark)[i]]
    * CASE WHEN MAP {T.ROMAN}[lower(mark)[i]] < coalesce(list_max(list_transform(range(i + 1, length(mark) + 1), lambda j: MAP {T.ROMAN}[lower(mark)[j]])), 0) THEN -1 ELSE 1 END)) END::BIGINT AS number
  FROM typed WHERE kind IN {tuple(regulations.NUMBERED_TYPES)}),
g AS (SELECT *, coalesce(number <> lag(number) OVER (PARTITION BY doc_id, segment, kind ORDER BY pos) + 1, false) AS gap FROM o WHERE number IS NOT NULL)
SELECT doc_id, pos, kind, number, gap, round(greatest(0, 0.95 - CASE WHEN gap THEN 0.25 ELSE 0 END), 3)::DOUBLE AS confidence FROM g""")
def sequence_gaps(spark, sf_dir):
    numbered = typed(spark, sf_dir).where(F.col("kind").isin(regulations.NUMBERED_TYPES)).withColumn("number", regulations.ordinal_value())
    found = structure.sequence_gaps(numbered, ["doc_id", "segment", "kind"], "pos", "number", F.lit(0.95))
    return found.select("doc_id", "pos", "kind", "number", "gap", "confidence")


@query(f"""
WITH {TYPED}, o AS (SELECT doc_id, segment, kind, pos, try_cast(mark AS BIGINT) AS number FROM typed WHERE kind IN ('CLAUSE', 'NUMBERED_ITEM', 'NUMBERED_SECTION') AND style LIKE 'DECIMAL%'),
g AS (SELECT doc_id, CASE WHEN coalesce(number <> lag(number) OVER (PARTITION BY doc_id, segment, kind ORDER BY pos) + 1, false) THEN 0.7 ELSE 0.95 END AS confidence FROM o WHERE number IS NOT NULL),
d AS (SELECT doc_id, coalesce(min(g.confidence), 0)::DOUBLE AS confidence FROM documents LEFT JOIN g USING (doc_id) GROUP BY doc_id)
SELECT doc_id, confidence, confidence < 0.7 AS low_confidence, CASE WHEN doc_id % 9 = 0 THEN 'REVIEW_REQUIRED' WHEN confidence >= 0.9 THEN 'APPROVED' ELSE 'REVIEW_REQUIRED' END AS status FROM d""")
def document_confidence(spark, sf_dir):
    """A document's confidence, the least of its decimal-numbered nodes', and the status that follows; a review asked for by the scan stays."""
    numbered = typed(spark, sf_dir).where(F.col("kind").isin("CLAUSE", "NUMBERED_ITEM", "NUMBERED_SECTION") & F.col("style").isin(regulations.DECIMALS)).withColumn("number", regulations.ordinal_value())
    found = structure.sequence_gaps(numbered, ["doc_id", "segment", "kind"], "pos", "number", F.lit(0.95)).select("doc_id", "confidence")
    whole = table(spark, sf_dir, "documents").select("doc_id").join(found, "doc_id", "left").groupBy("doc_id").agg(F.coalesce(F.min("confidence"), F.lit(0.0)).alias("confidence"))
    status = F.when(F.col("doc_id") % 9 == 0, "REVIEW_REQUIRED").when(F.col("confidence") >= 0.9, "APPROVED").otherwise("REVIEW_REQUIRED")
    return whole.select("doc_id", "confidence", (F.col("confidence") < 0.7).alias("low_confidence"), status.alias("status"))


_PAGES = r"""
pg AS (SELECT doc_id, page, sum(length(text))::BIGINT AS chars, count(*) FILTER (WHERE node_type = 'TABLE') AS tables, bool_or(regexp_matches(text, '(?i)\bDAFTAR\s+ISI\b')) AS contents, bool_or(regexp_matches(text, '(?i)\bLAMPIRAN\b')) AS appendix FROM nodes GROUP BY ALL),
regions AS (SELECT doc_id, page, CASE WHEN page = 1 AND chars < 400 AND tables = 0 THEN 'COVER' WHEN contents THEN 'TABLE_OF_CONTENTS' WHEN page >= min(CASE WHEN appendix THEN page END) OVER (PARTITION BY doc_id) THEN 'APPENDIX'
   WHEN page % 7 = 0 THEN 'DIAGRAM_REGION' ELSE 'FREEFORM_SECTION' END AS region_type FROM pg)"""


def _regions(spark, sf_dir):
    pages = nodes(spark, sf_dir).groupBy("doc_id", "page").agg(F.sum(F.length("text")).alias("chars"), F.count_if(F.col("node_type") == "TABLE").alias("tables"), F.array_join(F.collect_list("text"), "\n").alias("text"))
    return regulations.page_labels(pages.withColumn("category", F.when(F.col("page") % 7 == 0, "IMAGE_HEAVY").otherwise("DIGITAL_TEXT")))


@query(f"""
WITH {NODES}, {_PAGES}, f AS (SELECT *, CASE WHEN region_type = lag(region_type) OVER (PARTITION BY doc_id ORDER BY page) THEN 0 ELSE 1 END AS fresh FROM regions),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY page)::BIGINT AS island FROM f)
SELECT doc_id, island, region_type, min(page) AS "start", max(page) AS "end", count(*) AS n FROM i GROUP BY ALL""")
def region_pages(spark, sf_dir):
    """Runs of pages of one region type, an appendix reaching to the end."""
    return structure.islands(_regions(spark, sf_dir), "doc_id", "page", "region_type")


@query(f"""
WITH {TYPED}, {_PAGES}, b AS (SELECT doc_id, kind, NULL AS region_type FROM typed UNION ALL SELECT doc_id, NULL, region_type FROM regions)
SELECT doc_id, coalesce(bool_or(kind = 'ARTICLE'), false) AS articles, coalesce(bool_or(kind = 'NUMBERED_SECTION'), false) AS numbered_sections, coalesce(bool_or(kind = 'CHAPTER'), false) AS chapters,
  coalesce(bool_or(kind = 'DECISION_ITEM'), false) AS decision_preamble, coalesce(bool_or(region_type = 'APPENDIX'), false) AS appendices, coalesce(bool_or(kind = 'TABLE'), false) AS tables,
  coalesce(bool_or(region_type = 'DIAGRAM_REGION'), false) AS diagrams, false AS embedded_document FROM b GROUP BY doc_id""")
def structure_profile(spark, sf_dir):
    return regulations.structure_flags(typed(spark, sf_dir), _regions(spark, sf_dir))


TREE = NODES + """,
tr AS (SELECT a.doc_id, a.pos, a.level, a.page, (SELECT max(b.pos) FROM nodes b WHERE b.doc_id = a.doc_id AND b.pos < a.pos AND b.level < a.level) AS near FROM nodes a),
tree AS (SELECT t.doc_id, t.pos, t.level, t.page, CASE WHEN b.level = t.level - 1 THEN near END AS parent FROM tr t LEFT JOIN nodes b ON b.doc_id = t.doc_id AND b.pos = near)"""
_WALK = TREE + """, walk AS (SELECT doc_id, pos, parent AS above, 1 AS distance FROM tree WHERE parent IS NOT NULL
  UNION ALL SELECT w.doc_id, w.pos, t.parent, w.distance + 1 FROM walk w JOIN tree t ON t.doc_id = w.doc_id AND t.pos = w.above WHERE t.parent IS NOT NULL)"""


def tree(spark, sf_dir):
    return trees.adjacency(nodes(spark, sf_dir).select("doc_id", "pos", "level", "page"))


@query(f"WITH {TREE} SELECT doc_id, pos, level::BIGINT AS level, parent FROM tree")
def tree_adjacency(spark, sf_dir):
    return tree(spark, sf_dir).select("doc_id", "pos", F.col("level").cast("long").alias("level"), "parent")


@query(f"WITH RECURSIVE {_WALK} SELECT doc_id, pos, above, distance::BIGINT AS distance FROM walk")
def ancestor_walk(spark, sf_dir):
    return trees.ancestry(tree(spark, sf_dir))


@query(f"""
WITH RECURSIVE {_WALK}, m AS (SELECT doc_id, pos, pos + 1 + pos % 3 AS "to" FROM tree WHERE pos % 2 = 0)
SELECT doc_id, pos, "to", EXISTS (SELECT 1 FROM walk w WHERE w.doc_id = m.doc_id AND w.pos = m."to" AND w.above = m.pos) AS rejected FROM m""")
def cycle_rejection(spark, sf_dir):
    """Moves of every second node below one of the next three; those into its own subtree are rejected."""
    found = tree(spark, sf_dir)
    return trees.moves_checked(found, found.where("pos % 2 = 0").select("doc_id", "pos", (F.col("pos") + 1 + F.col("pos") % 3).alias("to")))


@query(f"""
WITH RECURSIVE {TREE}, o AS (SELECT doc_id, pos, lpad((100000 - pos)::VARCHAR, 9, '0') AS key FROM tree WHERE parent IS NULL
  UNION ALL SELECT t.doc_id, t.pos, o.key || '/' || lpad((100000 - t.pos)::VARCHAR, 9, '0') FROM tree t JOIN o ON o.doc_id = t.doc_id AND o.pos = t.parent)
SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY key) - 1 AS place FROM o""")
def reading_order(spark, sf_dir):
    """Depth-first places with siblings last to first."""
    found = tree(spark, sf_dir).withColumn("sequence", 100000 - F.col("pos"))
    return trees.reading_order(found.select("doc_id", "pos", "parent", "sequence")).select("doc_id", "pos", "place")


@query(f"""
WITH RECURSIVE {_WALK}, g AS (SELECT doc_id, pos, CASE WHEN level < 2 THEN NULL ELSE page END AS page, CASE WHEN level < 2 THEN NULL ELSE pos END AS position FROM tree),
s AS (SELECT w.doc_id, w.above AS pos, min(g.page) AS low, max(g.page) AS high, min(g.position) AS first FROM walk w JOIN g ON g.doc_id = w.doc_id AND g.pos = w.pos GROUP BY ALL)
SELECT g.doc_id, g.pos, coalesce(g.page, low) AS page_start, coalesce(g.page, high) AS page_end, coalesce(g.position, first) AS position FROM g LEFT JOIN s USING (doc_id, pos)""")
def group_ranges(spark, sf_dir):
    """Pages and positions of groups (nodes of the two top levels) from what lies below them."""
    group = F.col("level") < 2
    return trees.group_ranges(tree(spark, sf_dir).withColumns({"page": F.when(~group, F.col("page")), "position": F.when(~group, F.col("pos"))}))


@query(f"""
WITH {TREE}, n AS (SELECT doc_id, parent, CASE WHEN page % 3 = 0 THEN NULL ELSE page END AS page FROM tree), t AS (SELECT doc_id, count(*) FILTER (WHERE parent IS NULL) AS tops, max(coalesce(page, 0)) AS last FROM n GROUP BY doc_id),
p AS (SELECT doc_id, tops, unnest(range(1, last + 3)) AS page FROM t)
SELECT doc_id, page, 'UNKNOWN_BLOCK' AS node_type, tops + row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS sequence FROM p WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = p.doc_id AND n.page = p.page)""")
def uncovered_pages(spark, sf_dir):
    found = tree(spark, sf_dir).select("doc_id", "parent", F.when(F.col("page") % 3 != 0, F.col("page")).alias("page"))
    pages = found.groupBy("doc_id").agg(F.max(F.coalesce("page", F.lit(0))).alias("last")).select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("last") + 2)).alias("page"))
    return trees.uncovered_pages(pages, found)


_CELLS = r"""c AS (SELECT doc_id, pos, string_split(text, ' ') AS w FROM nodes WHERE node_type = 'TABLE'),
e AS (SELECT doc_id, pos, unnest(range(0, len(w))) AS i, w FROM c), cells AS (SELECT doc_id, pos, i // 4 AS row, i % 4 AS cell, w[i + 1] AS text FROM e)"""
_TABLES = """tl AS (SELECT doc_id, pos, row, string_agg(text, ' | ' ORDER BY cell) AS line FROM cells GROUP BY ALL),
tt AS (SELECT doc_id, pos, string_agg(line, chr(10) ORDER BY row) AS table_text FROM tl GROUP BY ALL)"""


def _cells(spark, sf_dir):
    words = F.split("text", " ")
    rows = F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / 4).cast("int")), lambda r: F.slice(words, r * 4 + 1, 4))
    return trees.table_cells(nodes(spark, sf_dir).where("node_type = 'TABLE'").select("doc_id", "pos", rows.alias("cells")))


@query(f"WITH {NODES}, {_CELLS} SELECT doc_id, pos, row, cell, text FROM cells")
def table_expansion(spark, sf_dir):
    """Table nodes as rows of four words, a cell each."""
    return _cells(spark, sf_dir)


@query(f"""
WITH {NODES}, {_CELLS}, {_TABLES} SELECT doc_id, pos, table_text FROM tt""")
def table_text(spark, sf_dir):
    return trees.rendered_tables(_cells(spark, sf_dir))


def chunk_nodes(spark, sf_dir):
    return typed(spark, sf_dir).select("doc_id", "pos", F.lit(None).cast("long").alias("parent"), "kind", "text", "title", "page")


@query(f"""
WITH RECURSIVE {TYPED}, {_CELLS}, {_TABLES}, rk AS (SELECT *, {_RANK} AS rank FROM typed),
tree AS (SELECT doc_id, pos, kind, length(text) + CASE WHEN kind = 'TABLE' THEN coalesce((SELECT 1 + length(table_text) FROM tt WHERE tt.doc_id = a.doc_id AND tt.pos = a.pos), 0) ELSE 0 END AS chars, page, (SELECT max(b.pos) FROM rk b WHERE b.doc_id = a.doc_id AND b.pos < a.pos AND b.rank IS NOT NULL AND (a.rank IS NULL OR b.rank < a.rank)
     AND NOT EXISTS (SELECT 1 FROM rk c WHERE c.doc_id = a.doc_id AND c.pos > b.pos AND c.pos < a.pos AND c.rank <= b.rank)) AS parent FROM rk a),
walk AS (SELECT doc_id, pos, parent AS above, 1 AS distance FROM tree WHERE parent IS NOT NULL
  UNION ALL SELECT w.doc_id, w.pos, t.parent, w.distance + 1 FROM walk w JOIN tree t ON t.doc_id = w.doc_id AND t.pos = w.above WHERE t.parent IS NOT NULL),
below AS (SELECT w.doc_id, w.above AS pos, sum(chars) FILTER (WHERE kind <> 'TABLE') AS chars, count(*) FILTER (WHERE kind <> 'TABLE' AND chars > 0) AS n, count(*) FILTER (WHERE kind <> 'TABLE' AND distance = 1) AS children, true AS claims FROM walk w JOIN tree t USING (doc_id, pos) GROUP BY ALL),
facts AS (SELECT t.*, kind IN ('ARTICLE', 'DECISION_ITEM', 'NUMBERED_SECTION', 'APPENDIX', 'SECTION', 'SUBSECTION') AS leads, coalesce(claims, false) AS claims, coalesce(children, 0) AS children,
   t.chars + coalesce(b.chars, 0) + greatest(coalesce(n, 0) + (t.chars > 0)::INT - 1, 0) AS whole FROM tree t LEFT JOIN below b USING (doc_id, pos)),
sized AS (SELECT *, greatest(1, whole // 4) > 400 AS over FROM facts),
ups AS (SELECT w.doc_id, w.pos, max(CASE WHEN leads THEN distance END) AS top FROM walk w JOIN sized s ON s.doc_id = w.doc_id AND s.pos = w.above GROUP BY ALL),
cut AS (SELECT w.doc_id, w.pos, bool_and(over) AS all_over, max(CASE WHEN distance = top THEN above END) AS root FROM walk w JOIN ups USING (doc_id, pos) JOIN sized s ON s.doc_id = w.doc_id AND s.pos = w.above WHERE distance <= top GROUP BY ALL),
kept AS (SELECT s.*, top, cut.root, kind = 'TABLE' OR (top IS NULL AND (leads OR NOT claims)) AS is_root FROM sized s LEFT JOIN ups USING (doc_id, pos) LEFT JOIN cut USING (doc_id, pos)
   WHERE kind = 'TABLE' OR (top IS NULL AND (leads OR NOT claims)) OR (top IS NOT NULL AND all_over)),
held AS (SELECT doc_id, pos, CASE WHEN is_root THEN pos ELSE root END AS root, CASE WHEN NOT is_root THEN parent END AS up, CASE WHEN is_root THEN 0 ELSE top END AS depth, page,
   CASE WHEN kind = 'TABLE' THEN 'TABLE' WHEN NOT over THEN 'WHOLE' WHEN children > 0 THEN 'OWN' ELSE 'SPLIT' END AS form, CASE WHEN kind = 'TABLE' OR (over AND children > 0) THEN chars ELSE whole END AS chars FROM kept),
span AS (SELECT doc_id, pos, min(page) AS page_start, max(page) AS page_end FROM (SELECT doc_id, pos, page FROM held UNION ALL SELECT w.doc_id, w.above, h.page FROM walk w JOIN held h USING (doc_id, pos) WHERE distance <= depth) GROUP BY ALL)
SELECT doc_id, pos, root, up, depth::BIGINT AS depth, row_number() OVER s - 1 AS sequence, chars::BIGINT AS chars, CASE WHEN form = 'SPLIT' THEN 0 ELSE greatest(1, chars // 4) END::BIGINT AS n_tokens, form, page_start, page_end,
  lag(pos) OVER s AS previous, lead(pos) OVER s AS next FROM held JOIN span USING (doc_id, pos) WINDOW s AS (PARTITION BY doc_id, up ORDER BY pos)""")
def chunk_rows(spark, sf_dir):
    """The chunks of every document's tree; tables count with their cells."""
    return chunking.chunks(chunk_nodes(spark, sf_dir), cells=_cells(spark, sf_dir))


@query()
def chunk_texts(spark, sf_dir):
    """The texts of the chunks, those too large for the budget in pieces."""
    tree_nodes = cut_lineage(chunk_nodes(spark, sf_dir))
    cells = cut_lineage(_cells(spark, sf_dir))
    found = cut_lineage(chunking.chunks(tree_nodes, cells=cells))
    texts = chunking.chunk_texts(tree_nodes, found, cells).join(found.select("doc_id", "pos", "form"), ["doc_id", "pos"])
    split = chunking.split_texts(texts.where("form = 'SPLIT'"), "text")
    parts = texts.where("form <> 'SPLIT'").withColumn("pieces", F.array("text")).unionByName(split)
    return parts.select("doc_id", "pos", "form", F.posexplode("pieces").alias("piece", "text"))


@query(f"""
WITH {PATHS} SELECT n.doc_id, n.pos, 'Dokumen:' || chr(10) || source || chr(10) || chr(10) || array_to_string(list_filter(labels, lambda x: trim(x) <> ''), chr(10)) || chr(10) || chr(10) || 'Isi:' || chr(10) || n.text AS contextual
FROM named n JOIN documents d USING (doc_id)""")
def contextual_text(spark, sf_dir):
    titles = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("name"))
    found = with_paths(spark, sf_dir).join(titles, "doc_id")
    return found.select("doc_id", "pos", chunking.contextual_text(F.col("name"), F.col("labels"), F.col("text")).alias("contextual"))


@query("""
WITH c AS (SELECT doc_id AS chunk_id, doc_id - doc_id % 10 AS parent_chunk_id, text, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END::BIGINT AS n_tokens FROM documents)
SELECT c.chunk_id, c.parent_chunk_id, c.n_tokens, p.text AS parent_text FROM c LEFT JOIN c p ON c.n_tokens < 40 AND p.chunk_id = c.parent_chunk_id""")
def parent_expansion(spark, sf_dir):
    """Short chunks with the text of their parent, here the first of each ten documents."""
    found = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") - F.col("doc_id") % 10).alias("parent_chunk_id"), "text", T.estimate_tokens(F.col("text")).alias("n_tokens"))
    return chunking.parent_context(found.drop("text"), found.select("chunk_id", "text"))
