"""Walks of folders, persisted versions, audit rows, cached answers and single-document tests; the driver's tables stand in for the stores."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import lifecycle, ranking, retrieval
from docloom.plans import answers as turns
from docloom.plans import lifecycle as stores
from docloom.plans import regulations as laws
from docloom.plans.registry import query
from docloom.session import ensure_checkpoint_dir, table
from docloom.sources import files, snapshots, versions

_TREE = """e AS (SELECT page_id, CASE WHEN page_id % 9 = 8 THEN page_id || '.html' WHEN page_id % 4 = 3 THEN 'd' || page_id % 7 || '/' || page_id || '.html' ELSE 'd' || page_id % 7 || '/' || substr('abcde', 1, (page_id % 5 + 1)::INT) || '/' || page_id || '.html' END AS path FROM pages)"""
_KEY = """list_aggregate(list_transform(list_filter(string_split(regexp_extract(path, '^(.*)/', 1), '/'), lambda x: x <> ''), lambda x: translate(hex(x), '0123456789ABCDEF', 'FEDCBA9876543210') || 'G'), 'string_agg', '')"""


def _entries(spark, sf_dir):
    number = F.col("page_id")
    top, file = F.concat(F.lit("d"), number % 7, F.lit("/")), F.concat(number, F.lit(".html"))
    deep = F.concat(top, F.substr(F.lit("abcde"), F.lit(1), (number % 5 + 1).cast("int")), F.lit("/"), file)
    return table(spark, sf_dir, "pages").select("page_id", F.when(number % 9 == 8, file).when(number % 4 == 3, F.concat(top, file)).otherwise(deep).alias("path"))


@query(f"""
WITH {_TREE}, k AS (SELECT page_id, path, coalesce({_KEY}, '') AS folders, regexp_extract(path, '([^/]*)$', 1) AS name FROM e)
SELECT page_id, path FROM k WHERE (folders, name) > (SELECT (folders, name) FROM (SELECT coalesce({_KEY}, '') AS folders, regexp_extract(path, '([^/]*)$', 1) AS name FROM (SELECT 'd3/abc/2.html' AS path))) ORDER BY folders, name LIMIT 40""")
def paged_walk(spark, sf_dir):
    """The page of a walk that follows the file d3/abc/2.html."""
    return files.page(_entries(spark, sf_dir), 40, "d3/abc/2.html").select("page_id", "path")


@query(f"""
WITH {_TREE}, f AS (SELECT * FROM (VALUES ('d1/ab', true, 'ACCESS_DENIED'), ('d2', true, 'NOT_FOUND'), ('d2/a', true, 'ACCESS_DENIED'), ('d5/abcd', true, 'NETWORK_ERROR')) x(path, is_folder, status) UNION ALL SELECT path, false, 'NETWORK_ERROR' FROM e WHERE page_id % 10 = 9),
b AS (SELECT coalesce(e.path, f.path) AS path, coalesce(f.status, 'FOUND') AS status FROM e FULL JOIN f ON e.path = f.path)
SELECT path, status FROM b WHERE NOT EXISTS (SELECT 1 FROM f WHERE is_folder AND starts_with(b.path, f.path || '/'))""")
def scan_errors(spark, sf_dir):
    """What a scan finds where three folders and a tenth of the files can't be read."""
    entries = _entries(spark, sf_dir)
    folders = spark.createDataFrame([("d1/ab", "PermissionError"), ("d2", "FileNotFoundError"), ("d2/a", "PermissionError"), ("d5/abcd", "OSError")], "path string, error string").withColumn("is_folder", F.lit(True))
    single = entries.where("page_id % 10 = 9").select("path", F.lit("OSError").alias("error"), F.lit(False).alias("is_folder"))
    return files.scanned(entries, folders.unionByName(single))


@query()
def folder_listing(spark, sf_dir):
    """The files of the data folder itself, in the order of a walk."""
    found = files.listed(spark, sf_dir)
    return found.orderBy(files.walk_key(F.col("path"))).select("path", "size")


def _place(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}/{uuid.uuid4()}"


@query(f"""
WITH {laws.NODES} SELECT doc_id, pos, page, level, node_type, CASE WHEN doc_id % 3 = 0 THEN text || ' (2)' ELSE text END AS text FROM nodes WHERE NOT (doc_id % 3 = 0 AND pos % 2 = 1)""")
def parsed_versions(spark, sf_dir):
    """Parsed nodes written by version; every third version is parsed again, into fewer nodes, and the new ones count."""
    found = laws.nodes(spark, sf_dir).select("doc_id", "pos", "page", "level", "node_type", "text")
    place = _place(spark, "parsed")
    snapshots.upsert(found, place, 1, "doc_id")
    snapshots.upsert(found.where("doc_id % 3 = 0 and pos % 2 = 0").withColumn("text", F.concat("text", F.lit(" (2)"))), place, 2, "doc_id")
    return snapshots.as_of(spark, place, "doc_id")


@query(f"""
WITH {laws.PATHS} SELECT doc_id, pos, path, CASE WHEN doc_id % 4 = 0 THEN text || ' (2)' ELSE text END AS text FROM named""")
def chunked_versions(spark, sf_dir):
    """Chunks written by version, those of every fourth document a second time with other texts."""
    found = laws.with_paths(spark, sf_dir).select("doc_id", "pos", "path", "text")
    place = _place(spark, "chunked")
    snapshots.upsert(found, place, 1, "doc_id")
    snapshots.upsert(found.where("doc_id % 4 = 0").withColumn("text", F.concat("text", F.lit(" (2)"))), place, 2, "doc_id")
    return snapshots.as_of(spark, place, "doc_id")


@query(f"""
WITH {stores._VERSIONS}, n AS (SELECT *, CASE WHEN status NOT IN ('ACTIVE', 'INDEXING') THEN status WHEN later IS NULL THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS new_status
  FROM (SELECT *, (SELECT min(w.version_number) FROM v w WHERE w.document_id = v.document_id AND w.version_number > v.version_number AND w.status IN ('ACTIVE', 'INDEXING')) AS later FROM v)),
a AS (SELECT document_id, version_number, 'DOCUMENT_INDEXED' AS action, 'document_version' AS entity_type, '{{"status":"' || status || '"}}' AS old_value, '{{"status":"' || new_status || '"}}' AS new_value FROM n WHERE status <> new_status)
SELECT * FROM a UNION ALL SELECT document_id, version_number, 'DOCUMENT_DELETED', 'document_version', '{{"status":"' || new_status || '"}}', NULL FROM n WHERE document_id % 6 = 0""")
def audit_rows(spark, sf_dir):
    """Audit rows of an indexing run and of the deletions that follow it, appended to one data set."""
    found = lifecycle.superseded(stores._versions(spark, sf_dir))
    keys, place = ["document_id", "version_number"], _place(spark, "audit")
    after = found.select(*keys, F.col("new_status").alias("status"))
    snapshots.append_once(versions.audit(found.select(*keys, "status"), after, keys, ["status"], "DOCUMENT_INDEXED", "document_version"), place, 1)
    snapshots.append_once(versions.audit(after, after.where("document_id % 6 <> 0"), keys, ["status"], "DOCUMENT_DELETED", "document_version"), place, 2)
    return spark.read.parquet(place).drop("run")


@query(f"""
WITH RECURSIVE q AS (SELECT event_type, event_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
g AS (SELECT event_type, event_id, n, ts AS stored, false AS hit FROM q WHERE n = 1
  UNION ALL SELECT q.event_type, q.event_id, q.n, CASE WHEN q.ts < g.stored + INTERVAL {lifecycle.CACHE_SECONDS} SECOND THEN g.stored ELSE q.ts END, q.ts < g.stored + INTERVAL {lifecycle.CACHE_SECONDS} SECOND FROM g JOIN q ON q.event_type = g.event_type AND q.n = g.n + 1)
SELECT event_type, event_id, hit FROM g""")
def cache_hits(spark, sf_dir):
    """Requests by kind, and which of them an answer stored in the ten minutes before serves."""
    return lifecycle.cache_served(table(spark, sf_dir, "events").select("event_type", "event_id", "ts"), "event_type", "ts", "event_id").select("event_type", "event_id", "hit")


_ONE = turns._CHUNKS.replace("c.status = 'ACTIVE' AND", "c.doc_id = p.turn + p.conv_id % 40 AND")


@query(f"""
WITH {laws.PATHS}, {turns._PARSED}, {_ONE}, top AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY doc_id, pos) <= 6)
SELECT q.conv_id, q.turn, q.turn + q.conv_id % 40 AS document_id, count(pos) AS n_sources, count(pos) = 0 AS insufficient, string_agg(pos, ',' ORDER BY pos) AS sources FROM q LEFT JOIN top USING (conv_id, turn) GROUP BY ALL""")
def single_document_test(spark, sf_dir):
    """Every question tried on one chosen document, archived or not: its sources, or that it has none. Nothing is gated or stored in a conversation."""
    roles = F.get(F.array(*map(F.lit, ("VIEWER", "EDITOR", "OWNER"))), F.col("who").cast("int"))
    asked = turns.questions(spark, sf_dir).withColumns({"role": roles, "x": T.parse_reference(F.col("question")), "document_id": F.col("turn") + F.col("conv_id") % 40})
    keys = ["conv_id", "turn", "document_id"]
    met = retrieval.exact_matches(asked.select(*keys, "organization", "role", "x.*"), turns.chunks(spark, sf_dir), keys, document="document_id")
    top = ranking.top_k_per(met, keys, [F.col("doc_id"), F.col("pos")], 6, "place").groupBy(*keys).agg(F.sort_array(F.collect_list("pos")).alias("found"))
    n = F.coalesce(F.size("found"), F.lit(0)).cast("long")
    return asked.select(*keys).join(top, keys, "left").select(*keys, n.alias("n_sources"), (n == 0).alias("insufficient"), F.array_join("found", ",").alias("sources"))
