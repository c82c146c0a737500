"""Structure operators over the paragraphs of documents and the pages table."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import structure as S
from docloom.plans.registry import query
from docloom.session import table

_LINES = """
l AS (SELECT doc_id, i - 1 AS pos, lines[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
      WHERE length(trim(lines[i])) > 0)"""


def _lines(spark, sf_dir):
    return S.paragraphs(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f"""
WITH {_LINES} SELECT doc_id, pos, lag(pos) OVER w AS previous, lead(pos) OVER w AS next, row_number() OVER w - 1 AS sequence FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""")
def sibling_links(spark, sf_dir):
    return S.sibling_links(_lines(spark, sf_dir).select("doc_id", "pos"), "doc_id", "pos")


@query(f"""
WITH {_LINES}, k AS (SELECT doc_id, pos, CASE WHEN length(line) < 40 THEN 'COVER' ELSE 'BODY' END AS label FROM l),
f AS (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS fresh FROM k),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS island FROM f)
SELECT doc_id, island, label, min(pos) AS "start", max(pos) AS "end", count(*) AS n FROM i GROUP BY doc_id, island, label""")
def regions_islands(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("doc_id", "pos", F.when(F.length("line") < 40, "COVER").otherwise("BODY").alias("label"))
    return S.islands(rows, "doc_id", "pos", "label")


@query(r"""
WITH s AS (SELECT page_id, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS chars, len(regexp_extract_all(html, '<img')) AS pictures, len(regexp_extract_all(html, '<table')) AS tables FROM pages)
SELECT page_id, CASE WHEN chars = 0 AND pictures = 0 AND tables = 0 THEN 'UNKNOWN' WHEN chars < 20 AND pictures > 0 THEN 'SCANNED' WHEN least(1, pictures / 10) >= 0.6 THEN 'IMAGE_HEAVY'
  WHEN tables >= 1 AND chars >= 20 THEN 'TABLE_HEAVY' WHEN chars >= 20 AND pictures > 0 THEN 'LAYOUT_COMPLEX' WHEN chars >= 20 THEN 'DIGITAL_TEXT' ELSE 'UNKNOWN' END AS category FROM s""")
def page_class(spark, sf_dir):
    html = F.col("html")
    pictures, tables = F.regexp_count(html, F.lit("<img")), F.regexp_count(html, F.lit("<table"))
    category = S.classify_page(F.length(F.regexp_replace(html, "<[^>]*>", "")), pictures, tables, F.least(F.lit(1.0), pictures / 10))
    return table(spark, sf_dir, "pages").select("page_id", category.alias("category"))


@query(f"""
WITH {_LINES}, g AS (SELECT doc_id, pos // 8 AS sequence, min(pos) AS a, min(pos) + 5 AS b FROM l GROUP BY ALL)
SELECT l.doc_id, l.pos, coalesce((SELECT min(sequence) FROM g WHERE g.doc_id = l.doc_id AND l.pos BETWEEN a AND b), (SELECT max(sequence) FROM g WHERE g.doc_id = l.doc_id)) AS region FROM l""")
def range_join_region(spark, sf_dir):
    nodes = _lines(spark, sf_dir).select("doc_id", "pos")
    regions = nodes.groupBy("doc_id", F.floor(F.col("pos") / 8).alias("sequence")).agg(F.min("pos").alias("start"), (F.min("pos") + 5).alias("end"))
    return S.containing_region(nodes, regions, "doc_id", "pos").select("doc_id", "pos", "region")
