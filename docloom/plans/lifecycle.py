"""Catalogs, uploads, versions, budgets, ownership and listings; the driver's tables stand in for the stores."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import lifecycle, regulations, retrieval
from docloom.plans import answers as turns
from docloom.plans import regulations as laws
from docloom.plans.registry import query
from docloom.session import ensure_checkpoint_dir, table
from docloom.sources import files

_SCAN = """
old AS (SELECT page_id, url AS path, length(html) - page_id % 2 AS size FROM pages WHERE page_id % 3 <> 0), seen AS (SELECT page_id, url AS path, length(html) AS size FROM pages WHERE page_id % 5 <> 0),
j AS (SELECT coalesce(o.page_id, s.page_id) AS page_id, coalesce(s.size, o.size) AS size, CASE WHEN o.page_id IS NULL THEN 'NEW' WHEN s.page_id IS NULL THEN 'KEPT' WHEN o.size = s.size THEN 'SAME' ELSE 'UPDATED' END AS change FROM old o FULL JOIN seen s ON o.page_id = s.page_id)"""


def _scan(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.length("html").alias("size"))
    old = pages.where("page_id % 3 <> 0").select("page_id", (F.col("size") - F.col("page_id") % 2).alias("size"))
    return lifecycle.catalog_scanned(old, pages.where("page_id % 5 <> 0").select("page_id", F.col("size").cast("long")), ["page_id"], ["size"])


@query(f"WITH {_SCAN} SELECT page_id, size::BIGINT AS size, change FROM j")
def catalog_upsert(spark, sf_dir):
    """The page catalog after a scan that saw four fifths of the pages, some changed."""
    return _scan(spark, sf_dir)


@query(f"WITH {_SCAN} SELECT count(*) FILTER (WHERE change <> 'KEPT') AS seen, count(*) FILTER (WHERE change = 'NEW') AS added, count(*) FILTER (WHERE change = 'UPDATED') AS updated, (SELECT count(*) FROM pages WHERE page_id % 5 = 0) AS errors, CASE WHEN (SELECT count(*) FROM pages WHERE page_id % 5 = 0) > 0 THEN 'PARTIAL' ELSE 'COMPLETED' END AS status FROM j")
def scan_counters(spark, sf_dir):
    """A scan's counters; pages that couldn't be read are its errors."""
    found = _scan(spark, sf_dir).agg(F.count_if(F.col("change") != "KEPT").alias("seen"), F.count_if(F.col("change") == "NEW").alias("added"), F.count_if(F.col("change") == "UPDATED").alias("updated"))
    errors = table(spark, sf_dir, "pages").where("page_id % 5 = 0").agg(F.count("*").alias("errors"))
    return found.join(F.broadcast(errors)).withColumn("status", F.when(F.col("errors") > 0, "PARTIAL").otherwise("COMPLETED"))


_FILES = r"""f AS (SELECT page_id, html, CASE page_id % 6 WHEN 0 THEN '/a/~$' || page_id || '.docx' WHEN 1 THEN '/b/x' || page_id || '.tmp' WHEN 2 THEN '//HOST' || page_id % 7 || '/share/doc.PDF' WHEN 3 THEN '\\Srv' || page_id % 5 || '\s\f.v2.docx' WHEN 4 THEN url ELSE '/c/.hidden' END AS path FROM pages)"""


def _files(spark, sf_dir):
    number = F.col("page_id")
    path = (
        F.when(number % 6 == 0, F.concat(F.lit("/a/~$"), number, F.lit(".docx"))).when(number % 6 == 1, F.concat(F.lit("/b/x"), number, F.lit(".tmp"))).when(number % 6 == 2, F.concat(F.lit("//HOST"), number % 7, F.lit("/share/doc.PDF")))
        .when(number % 6 == 3, F.concat(F.lit("\\\\Srv"), number % 5, F.lit("\\s\\f.v2.docx"))).when(number % 6 == 4, F.col("url")).otherwise("/c/.hidden")
    )
    return table(spark, sf_dir, "pages").select("page_id", "html", path.alias("path"))


@query(rf"""
WITH {_FILES}, n AS (SELECT *, regexp_extract(path, '([^/\\]*)$', 1) AS name FROM f), e AS (SELECT *, lower(regexp_extract(name, '[^.](\.[^.]+)$', 1)) AS extension FROM n)
SELECT page_id, extension, regexp_matches(path, '(^|/)~\$|\.tmp$') AS locked, extension IN ('.pdf', '.docx') AND NOT regexp_matches(path, '(^|/)~\$|\.tmp$') AND length(html) <= 5000 AS accepted,
  CASE extension WHEN '.pdf' THEN 'application/pdf' WHEN '.docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'application/octet-stream' END AS mime,
  CASE WHEN extension = '' THEN name ELSE left(name, length(name) - length(extension)) END AS title, nullif(lower(regexp_extract(path, '^(?:\\\\|//)([^\\/]+)[\\/]', 1)), '') AS host FROM e""")
def file_intake(spark, sf_dir):
    """Which files a scan takes: lock files, foreign endings and those over the size cap stay out."""
    path = F.col("path")
    accepted = T.extension(path).isin(".pdf", ".docx") & ~T.is_lock_file(path) & (F.length("html") <= 5000)
    return _files(spark, sf_dir).select("page_id", T.extension(path).alias("extension"), T.is_lock_file(path).alias("locked"), accepted.alias("accepted"), T.mime_type(path).alias("mime"), T.title_of_file(path).alias("title"), T.unc_host(path).alias("host"))


@query("""
WITH a AS (SELECT page_id, length(html) AS size, sha256(html) AS h FROM pages), b AS (SELECT page_id, length(html) + (page_id % 11 = 0)::INT AS size FROM pages WHERE page_id % 13 <> 0),
s AS (SELECT a.page_id, h, b.size IS NOT NULL AND a.size = b.size AS stable, row_number() OVER (PARTITION BY h ORDER BY a.page_id) AS n FROM a LEFT JOIN b USING (page_id))
SELECT page_id, h AS file_hash, CASE WHEN NOT stable THEN 'UNSTABLE' WHEN min(CASE WHEN stable THEN page_id END) OVER (PARTITION BY h) < page_id THEN 'DUPLICATE' ELSE 'PROMOTED' END AS state FROM s""")
def promotion(spark, sf_dir):
    """Files that two looks agree on are hashed and promoted, one of each content."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.length("html").alias("size"), F.sha2("html", 256).alias("file_hash"))
    again = pages.where("page_id % 13 <> 0").select("page_id", (F.col("size") + (F.col("page_id") % 11 == 0).cast("int")).alias("size2"))
    looked = pages.join(again, "page_id", "left").withColumn("stable", F.coalesce(F.col("size") == F.col("size2"), F.lit(False)))
    first = looked.where("stable").groupBy("file_hash").agg(F.min("page_id").alias("first"))
    state = F.when(~F.col("stable"), "UNSTABLE").when(F.col("first") < F.col("page_id"), "DUPLICATE").otherwise("PROMOTED")
    return looked.join(first, "file_hash", "left").select("page_id", "file_hash", state.alias("state"))


_VERSIONS = "v AS (SELECT doc_id, doc_id // 4 AS document_id, doc_id % 4 + 1 AS version_number, source AS organization, sha256(text) AS file_hash, (['ACTIVE', 'INDEXING', 'ARCHIVED', 'ACTIVE', 'PROCESSING_FAILED'])[doc_id % 5 + 1] AS status FROM documents)"


def _versions(spark, sf_dir):
    status = F.get(F.array(*map(F.lit, ("ACTIVE", "INDEXING", "ARCHIVED", "ACTIVE", "PROCESSING_FAILED"))), (F.col("doc_id") % 5).cast("int"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.floor(F.col("doc_id") / 4).cast("long").alias("document_id"), (F.col("doc_id") % 4 + 1).alias("version_number"), F.col("source").alias("organization"), F.sha2("text", 256).alias("file_hash"), status.alias("status")
    )


@query(f"""
WITH {_VERSIONS} SELECT document_id, version_number, status, CASE WHEN status NOT IN ('ACTIVE', 'INDEXING') THEN status WHEN later IS NULL THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS new_status, CASE WHEN status IN ('ACTIVE', 'INDEXING') THEN later END AS superseded_by
FROM (SELECT *, (SELECT min(w.version_number) FROM v w WHERE w.document_id = v.document_id AND w.version_number > v.version_number AND w.status IN ('ACTIVE', 'INDEXING')) AS later FROM v)""")
def supersession(spark, sf_dir):
    """Indexing a version makes it active and supersedes the one before."""
    return lifecycle.superseded(_versions(spark, sf_dir)).select("document_id", "version_number", "status", "new_status", "superseded_by")


@query(f"""
WITH {_VERSIONS}, d AS (SELECT document_id, max(version_number) AS latest, max(version_number) FILTER (WHERE status = 'ACTIVE') AS latest_active, arg_max(status, version_number) AS status FROM v GROUP BY document_id)
SELECT * FROM d""")
def document_listing(spark, sf_dir):
    """Documents with their latest version, its status, and the latest active one."""
    return _versions(spark, sf_dir).groupBy("document_id").agg(
        F.max("version_number").alias("latest"), F.max(F.when(F.col("status") == "ACTIVE", F.col("version_number"))).alias("latest_active"), F.max_by("status", "version_number").alias("status")
    )


@query(f"""
WITH {_VERSIONS}, s AS (SELECT * FROM v WHERE doc_id % 10 < 7), u AS (SELECT doc_id AS upload_id, organization, document_id, CASE WHEN doc_id % 2 = 0 THEN file_hash ELSE sha256(file_hash || doc_id % 4) END AS file_hash FROM v WHERE doc_id % 10 >= 5),
f AS (SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.organization = u.organization AND s.file_hash = u.file_hash) QUALIFY row_number() OVER (PARTITION BY organization, file_hash ORDER BY upload_id) = 1)
SELECT upload_id, organization, document_id, file_hash, coalesce((SELECT max(version_number) FROM s WHERE s.document_id = f.document_id), 0) + row_number() OVER (PARTITION BY document_id ORDER BY upload_id) AS version_number FROM f""")
def uploads(spark, sf_dir):
    """Uploads of which some hold content that their organization has."""
    versions = _versions(spark, sf_dir)
    new = F.when(F.col("doc_id") % 2 == 0, F.col("file_hash")).otherwise(F.sha2(F.concat("file_hash", F.col("doc_id") % 4), 256))
    sent = versions.where("doc_id % 10 >= 5").select(F.col("doc_id").alias("upload_id"), "organization", "document_id", new.alias("file_hash"))
    return lifecycle.uploads_admitted(sent, versions.where("doc_id % 10 < 7").drop("doc_id"))


@query("""
WITH s AS (SELECT doc_id, source AS name, doc_id % 2 = 0 AS enabled FROM documents WHERE doc_id % 3 <> 0), c AS (SELECT doc_id, source || '-new' AS name, true AS enabled, n AS step, (doc_id + n) % 5 = 0 AS gone FROM documents, (VALUES (1), (2)) AS x(n) WHERE doc_id % 4 < n),
l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY step DESC) = 1)
SELECT coalesce(s.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN s.name ELSE l.name END AS name, CASE WHEN l.doc_id IS NULL THEN s.enabled ELSE l.enabled END AS enabled FROM s FULL JOIN l ON s.doc_id = l.doc_id WHERE coalesce(NOT l.gone, true)""")
def snapshot_changes(spark, sf_dir):
    """A snapshot of sources after creations, updates and deletions."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    held = docs.where("doc_id % 3 <> 0").select("doc_id", F.col("source").alias("name"), (F.col("doc_id") % 2 == 0).alias("enabled"))
    each = docs.select("doc_id", "source", F.explode(F.array(F.lit(1), F.lit(2))).alias("at")).where("doc_id % 4 < at")
    changes = each.select("doc_id", F.concat("source", F.lit("-new")).alias("name"), F.lit(True).alias("enabled"), "at", ((F.col("doc_id") + F.col("at")) % 5 == 0).alias("gone"))
    return lifecycle.snapshot_changed(held, changes, ["doc_id"], "at", "gone")


@query("""
WITH r AS (SELECT doc_id AS from_version, doc_id // 2 AS to_version, (['AMENDS', 'REPEALS', 'REPLACES', 'IMPLEMENTS', 'REFERS_TO', 'SUPERSEDED_BY'])[doc_id % 6 + 1] AS relation_type FROM documents)
SELECT from_version, to_version, relation_type, CASE WHEN relation_type = 'SUPERSEDED_BY' THEN 'SYSTEM_ONLY' WHEN from_version // 3 = to_version // 3 THEN 'SELF_RELATION' ELSE 'ACCEPTED' END AS verdict FROM r""")
def relation_requests(spark, sf_dir):
    """Relations asked for: the system's own type and relations of a document to itself are refused."""
    found, _, _ = turns._relations(spark, sf_dir)
    same = F.floor(F.col("from_version") / 3) == F.floor(F.col("to_version") / 3)
    return found.withColumn("verdict", F.when(F.col("relation_type") == "SUPERSEDED_BY", "SYSTEM_ONLY").when(same, "SELF_RELATION").otherwise("ACCEPTED"))


@query("""
SELECT 'message' AS kind, conv_id * 1000 + turn AS id, conv_id AS conversation FROM conversations WHERE conv_id % 7 <> 0
UNION ALL SELECT 'log', event_id, CASE WHEN event_id % 100 IN (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 7 = 0) THEN NULL ELSE event_id % 100 END FROM events""")
def cascade_delete(spark, sf_dir):
    """Deleted conversations lose their messages; query logs stay and lose the reference."""
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    gone = messages.where("conv_id % 7 = 0").select("conv_id").distinct()
    left = messages.join(gone, "conv_id", "left_anti").select(F.lit("message").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("conversation"))
    logs = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 100).alias("conv_id")).join(gone.withColumn("gone", F.lit(True)), "conv_id", "left")
    return left.unionByName(logs.select(F.lit("log").alias("kind"), F.col("event_id").alias("id"), F.when(F.col("gone").isNull(), F.col("conv_id")).alias("conversation")))


@query("""
WITH m AS (SELECT c_nationkey AS organization, c_custkey AS user_id, CASE WHEN c_custkey % 50 = 0 THEN 'OWNER' WHEN c_custkey % 3 = 0 THEN 'EDITOR' ELSE 'VIEWER' END AS role FROM customer),
o AS (SELECT organization, count(*) AS owners FROM m WHERE role = 'OWNER' GROUP BY 1)
SELECT m.organization, user_id, role, role <> 'OWNER' OR owners > 1 AS allowed FROM m LEFT JOIN o USING (organization) WHERE user_id % 2 = 0""")
def owner_guard(spark, sf_dir):
    """Members who leave: an organization's last owner can't."""
    role = F.when(F.col("c_custkey") % 50 == 0, "OWNER").when(F.col("c_custkey") % 3 == 0, "EDITOR").otherwise("VIEWER")
    members = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("organization"), F.col("c_custkey").alias("user_id"), role.alias("role"))
    return lifecycle.owner_guard(members, members.where("user_id % 2 = 0").select("organization", "user_id"))


@query("""
WITH RECURSIVE q AS (SELECT o_custkey, o_orderkey, round(o_totalprice)::BIGINT AS amount, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
g AS (SELECT o_custkey, o_orderkey, amount, n, amount <= 400000 AS admitted, CASE WHEN amount <= 400000 THEN amount ELSE 0 END AS used FROM q WHERE n = 1
  UNION ALL SELECT q.o_custkey, q.o_orderkey, q.amount, q.n, used + q.amount <= 400000, CASE WHEN used + q.amount <= 400000 THEN used + q.amount ELSE used END FROM g JOIN q ON q.o_custkey = g.o_custkey AND q.n = g.n + 1)
SELECT o_custkey, o_orderkey, amount, admitted FROM g""")
def budget_admission(spark, sf_dir):
    """Orders as requests against a customer's budget, admitted greedily in order."""
    requests = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round("o_totalprice").cast("long").alias("amount"))
    return lifecycle.admitted(requests, F.lit(400000), ["o_custkey"], "o_orderkey", "amount")


@query("""
SELECT o_custkey, coalesce(sum(amount) FILTER (WHERE o_orderstatus = 'O'), 0)::BIGINT AS reserved, coalesce(sum(amount) FILTER (WHERE o_orderstatus = 'F'), 0)::BIGINT AS spent, coalesce(sum(amount) FILTER (WHERE o_orderstatus = 'P'), 0)::BIGINT AS released
FROM (SELECT *, round(o_totalprice)::BIGINT AS amount FROM orders) GROUP BY 1""")
def ledger_settlement(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "RESERVED").when(F.col("o_orderstatus") == "F", "SETTLED").otherwise("RELEASED")
    return lifecycle.settled(table(spark, sf_dir, "orders").select("o_custkey", status.alias("status"), F.round("o_totalprice").cast("long").alias("amount")), ["o_custkey"])


@query("""
WITH d AS (SELECT min(ts) AS t0 FROM events), r AS (SELECT event_type, n, t0 + INTERVAL (n * 5) DAY AS effective_from, CASE WHEN n % 2 = 0 THEN t0 + INTERVAL (n * 5 + 7) DAY END AS effective_until, n * 10 + length(event_type) AS rate FROM (SELECT DISTINCT event_type FROM events), range(0, 4) AS x(n), d WHERE n <> 1 OR event_type <> 'error')
SELECT event_id, e.event_type, (SELECT arg_max(rate, effective_from) FROM r WHERE r.event_type = e.event_type AND effective_from <= e.ts AND (effective_until IS NULL OR effective_until > e.ts))::BIGINT AS rate FROM events e""")
def effective_rate(spark, sf_dir):
    """Each event's rate: the latest of its type that has begun and not ended."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    kinds = events.groupBy("event_type").agg(F.lit(1)).select("event_type").join(F.broadcast(events.agg(F.min("ts").alias("t0"))))
    each = kinds.select("event_type", "t0", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("n")).where("n <> 1 or event_type <> 'error'")
    rates = each.selectExpr("event_type", "t0 + make_dt_interval(n * 5) as effective_from", "case when n % 2 = 0 then t0 + make_dt_interval(n * 5 + 7) end as effective_until", "cast(n * 10 + length(event_type) as bigint) as rate")
    return lifecycle.rates_at(events, F.broadcast(rates), "event_type", "ts", "event_id").select("event_id", "event_type", "rate")


@query("""
WITH b AS (SELECT conv_id, min(turn) AS lo, max(turn) AS hi FROM conversations GROUP BY 1) SELECT c.conv_id, c.turn FROM conversations c JOIN b USING (conv_id) WHERE c.turn > lo AND c.turn < hi""")
def message_slice(spark, sf_dir):
    """Messages strictly between a conversation's first and last."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    ends = rows.groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"))
    return rows.join(ends, "conv_id").where("turn > lo and turn < hi").select("conv_id", "turn")


@query("""
SELECT c.conv_id, c.turn, f.event_id FROM conversations c JOIN events f ON f.event_id % 100 = c.conv_id AND f.event_id % 7 = c.turn WHERE c.role = 'assistant' AND f.user_id = c.conv_id % 150 AND f.event_type <> 'error'""")
def own_feedback(spark, sf_dir):
    """Ratings of chat answers in a user's own conversations; failed traffic isn't chat."""
    messages = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", (F.col("conv_id") % 150).alias("user_id"))
    given = table(spark, sf_dir, "events").where("event_type <> 'error'").select("event_id", "user_id", (F.col("event_id") % 100).alias("conv_id"), (F.col("event_id") % 7).alias("turn"))
    return given.join(messages, ["conv_id", "turn", "user_id"]).select("conv_id", "turn", "event_id")


@query("""
WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations), o AS (SELECT conv_id, min(turn) FILTER (WHERE back <= 8) AS first_recent FROM m GROUP BY 1)
SELECT conv_id, string_agg(CASE WHEN back <= 8 THEN upper(left(role, 1)) || role[2:] || ': ' || coalesce(text, '') END, chr(10) ORDER BY turn) AS recent, count(*) FILTER (WHERE turn < first_recent AND turn > 1) AS aged_out, max(turn) FILTER (WHERE turn < first_recent AND turn > 1) AS cursor FROM m JOIN o USING (conv_id) GROUP BY 1""")
def conversation_context(spark, sf_dir):
    """The last eight messages, and how many older ones a summary up to turn 1 hasn't seen."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    placed = rows.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))))
    first = F.min(F.when(F.col("back") <= 8, F.col("turn"))).over(Window.partitionBy("conv_id"))
    held = placed.withColumn("old", (F.col("turn") < first) & (F.col("turn") > 1))
    line = F.concat(F.initcap("role"), F.lit(": "), "text")
    recent = F.sort_array(F.collect_list(F.when(F.col("back") <= 8, F.struct("turn", line.alias("l")))))
    return held.groupBy("conv_id").agg(F.array_join(F.transform(recent, lambda x: x["l"]), "\n").alias("recent"), F.count_if("old").alias("aged_out"), F.max(F.when(F.col("old"), F.col("turn"))).alias("cursor"))


@query("""
SELECT conv_id, max(turn) AS updated_at, left(arg_min(text, turn), 255) AS title FROM conversations WHERE role = 'user' GROUP BY 1 ORDER BY updated_at DESC, conv_id LIMIT 50""")
def conversation_listing(spark, sf_dir):
    """Conversations, last changed first, titled by their first question."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    found = rows.groupBy("conv_id").agg(F.max("turn").alias("updated_at"), F.substring(F.min_by("text", "turn"), 1, 255).alias("title"))
    return found.orderBy(F.desc("updated_at"), "conv_id").limit(50)


@query(r"""
SELECT conv_id, turn, 'event: token' || chr(10) || 'data: ' || replace(coalesce(text, ''), chr(10), chr(10) || 'data: ') || chr(10) || chr(10) AS block, coalesce(text, '') AS read_back FROM conversations""")
def sse_blocks(spark, sf_dir):
    """Messages as server-sent blocks, and what a reader makes of them."""
    text = F.coalesce("text", F.lit(""))
    block = F.concat(F.lit("event: token\n"), F.array_join(F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit("data: "), x)), "\n"), F.lit("\n\n"))
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", block.alias("block"))
    lines = F.filter(F.split(F.regexp_replace("block", "\n\n$", ""), "\n"), lambda x: x.startswith("data: "))
    return found.select("conv_id", "turn", "block", F.array_join(F.transform(lines, lambda x: F.substr(x, F.lit(7))), "\n").alias("read_back"))


@query("""
SELECT conv_id, turn, question, expect_insufficient FROM (SELECT conv_id, turn, text AS question, conv_id % 4 = 0 AS expect_insufficient FROM conversations WHERE role = 'user')""")
def golden_questions(spark, sf_dir):
    """Questions written as JSON and read by a declared schema."""
    packed = F.to_json(F.struct(F.col("text").alias("question"), (F.col("conv_id") % 4 == 0).alias("expect_insufficient"), F.lit(None).cast("string").alias("expected_article")))
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", packed.alias("j"))
    read = F.from_json("j", "question string, expected_article string, expect_insufficient boolean")
    return rows.select("conv_id", "turn", read["question"].alias("question"), read["expect_insufficient"].alias("expect_insufficient"))


@query("""
WITH r AS (SELECT conv_id * 1000 + turn AS id, left(coalesce(text, ''), 40) AS text, conv_id % 4 = 0 AS insufficient, (conv_id + turn) % 9 AS damage FROM conversations WHERE role = 'user')
SELECT id, CASE WHEN damage = 3 THEN NULL ELSE text END AS question, insufficient AS expect_insufficient, CASE WHEN damage = 3 THEN 'NO_QUESTION' END AS error FROM r WHERE damage NOT IN (1, 2)
UNION ALL SELECT NULL, NULL, NULL, 'BROKEN' FROM r WHERE damage IN (1, 2)""")
def golden_dataset(spark, sf_dir):
    """A file of golden questions read by its declared schema; lines that break it, or lack the question, are rows of their own with an error."""
    user = table(spark, sf_dir, "conversations").where("role = 'user'")
    damage = (F.col("conv_id") + F.col("turn")) % 9
    question = F.when(damage != 3, F.substring(F.coalesce("text", F.lit("")), 1, 40)).alias("question")
    line = F.to_json(F.struct((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), question, (F.col("conv_id") % 4 == 0).alias("expect_insufficient")))
    broken = F.when(damage == 1, F.concat(F.lit("{\"id\": oops"), line)).when(damage == 2, F.regexp_replace(line, "\"expect_insufficient\":(true|false)", "\"expect_insufficient\":\"perhaps\"")).otherwise(line)
    place = f"{ensure_checkpoint_dir(spark)}/golden/{uuid.uuid4()}"
    user.select(broken.alias("value")).write.text(place)
    good, bad = files.json_records(spark, place, "id long, question string, expected_document string, expected_article string, expected_page int, expected_answer string, expect_insufficient boolean")
    told = good.select("id", "question", "expect_insufficient", F.when(F.col("question").isNull(), "NO_QUESTION").alias("error"))
    return told.unionByName(bad.select(F.lit("BROKEN").alias("error")), allowMissingColumns=True)


@query("""
WITH u AS (SELECT event_id, value, CASE event_type WHEN 'error' THEN NULL WHEN 'purchase' THEN 'STRONG' ELSE 'FAST' END AS tier, user_id AS tokens_in, event_id % 900 AS tokens_out, epoch((SELECT max(ts) FROM events)) - epoch(ts) AS age FROM events)
SELECT event_id, tier, ((tokens_in + tokens_out) * CASE tier WHEN 'FAST' THEN 5 WHEN 'STRONG' THEN 100 END + 5) // 10 / 1e6 AS cost, CASE WHEN value < 1000 THEN round(value)::BIGINT || 'ms' ELSE printf('%.1fs', value / 1000) END AS latency,
  CASE WHEN floor(age / 3600 + 0.5) < 1 THEN 'just now' WHEN floor(age / 3600 + 0.5) < 24 THEN floor(age / 3600 + 0.5)::BIGINT || 'h ago' ELSE floor(floor(age / 3600 + 0.5) / 24 + 0.5)::BIGINT || 'd ago' END AS asked FROM u""")
def usage_display(spark, sf_dir):
    """What a query cost by its tier's rate, and how its latency and age are shown."""
    events = table(spark, sf_dir, "events")
    tier = F.when(F.col("event_type") == "purchase", "STRONG").when(F.col("event_type") != "error", "FAST")
    rows = events.join(F.broadcast(events.agg(F.max("ts").alias("now"))))
    cost = T.estimated_cost(tier, F.col("user_id"), F.col("event_id") % 900).cast("double")
    age = F.unix_micros(F.col("now").cast("timestamp")) / 1e6 - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return rows.select("event_id", tier.alias("tier"), cost.alias("cost"), T.shown_latency(F.col("value")).alias("latency"), T.shown_age(age).alias("asked"))


@query("""
WITH s AS (SELECT user_id, event_type, max(ts) AS stored FROM events GROUP BY ALL) SELECT user_id, event_type, stored > (SELECT max(ts) FROM events) - INTERVAL 600 SECOND AS alive FROM s""")
def cache_expiry(spark, sf_dir):
    """Cached answers by user and kind: alive for ten minutes after they were stored."""
    events = table(spark, sf_dir, "events")
    stored = events.groupBy("user_id", "event_type").agg(F.max("ts").alias("stored"))
    now = F.broadcast(events.agg(F.max("ts").alias("now")))
    return stored.join(now).select("user_id", "event_type", (F.col("stored") > F.col("now") - F.expr(f"interval {lifecycle.CACHE_SECONDS} seconds")).alias("alive"))


@query(f"""
WITH {laws.PATHS}, {laws._PAGES} SELECT n.doc_id, n.pos, d.source AS organization, coalesce(CASE WHEN n.doc_id % 4 <> 0 THEN 'INTERNAL' END, 'PUBLIC') AS visibility, n.kind AS node_type, n.role AS semantic_role, r.region_type, len(n.labels)::BIGINT AS structural_depth, n.raw AS number_raw,
  CASE WHEN n.style IS NOT NULL THEN n.mark END AS number_normalized, n.style AS numbering_style, n.path AS structural_path, n.chapter_number AS chapter, n.article_number AS article, n.clause_number AS clause, n.letter_number AS letter, n.page AS page_start, n.doc_id % 4 + 1 AS index_version
FROM (SELECT * EXCLUDE (raw), CASE WHEN style IS NOT NULL THEN raw END AS raw FROM named) n JOIN regions r USING (doc_id, page) JOIN documents d USING (doc_id)""")
def chunk_payload(spark, sf_dir):
    """Every node with its region, version and document, as the vector store keeps it; a missing visibility is public."""
    found = laws.with_paths(spark, sf_dir)
    regions = laws._regions(spark, sf_dir).select("doc_id", "page", "region_type")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("organization"), F.when(F.col("doc_id") % 4 != 0, "INTERNAL").alias("given"))
    joined = found.join(regions, ["doc_id", "page"]).join(docs, "doc_id")
    return joined.select(
        "doc_id", "pos", "organization", F.coalesce("given", F.lit("PUBLIC")).alias("visibility"), F.col("kind").alias("node_type"), F.col("role").alias("semantic_role"), "region_type", F.col("depth").alias("structural_depth"), F.col("raw").alias("number_raw"),
        F.col("marker").alias("number_normalized"), F.col("style").alias("numbering_style"), F.col("path").alias("structural_path"), F.col("chapter_number").alias("chapter"), F.col("article_number").alias("article"),
        F.col("clause_number").alias("clause"), F.col("letter_number").alias("letter"), F.col("page").alias("page_start"), (F.col("doc_id") % 4 + 1).alias("index_version"),
    )


@query(f"""
WITH {laws.TYPED.replace("typed AS (SELECT *,", "typed AS (SELECT * REPLACE (CASE WHEN pos % 17 = 9 THEN 'PARAGRAPH' ELSE kind END AS kind, CASE WHEN pos % 17 = 9 THEN NULL ELSE label END AS label),").replace("coalesce(nullif(label, ''), nullif(title, ''), nullif(left(text, 60), ''), kind) AS shown FROM lb", "coalesce(CASE WHEN pos % 17 = 9 THEN NULL ELSE nullif(label, '') END, nullif(title, ''), nullif(left(text, 60), ''), kind) AS shown FROM lb")}{laws.PATHS.removeprefix(laws.TYPED)}
SELECT doc_id, pos, kind, path FROM named""")
def corrected_paths(spark, sf_dir):
    """Paths after corrections: every seventeenth node is a plain paragraph after all."""
    wrong = F.col("pos") % 17 == 9
    fixed = laws.typed(spark, sf_dir).withColumns({"kind": F.when(wrong, "PARAGRAPH").otherwise(F.col("kind")), "label": F.when(~wrong, F.col("label"))})
    return regulations.with_paths(fixed).select("doc_id", "pos", "kind", "path")


@query(f"""
WITH {laws.TREE} SELECT doc_id, coalesce(parent, -1) AS parent, count(*) AS n, string_agg(pos, ',' ORDER BY pos) AS children FROM tree GROUP BY ALL""")
def tree_groups(spark, sf_dir):
    """The children of every node, in order."""
    found = laws.tree(spark, sf_dir).groupBy("doc_id", F.coalesce("parent", F.lit(-1)).alias("parent"))
    return found.agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("pos")), ",").alias("children"))


@query(f"""
WITH {laws.NODES}, p AS (SELECT doc_id, page, CASE WHEN bool_or(node_type = 'TABLE') THEN 'TABLE_HEAVY' WHEN sum(length(text)) < 200 THEN 'SCANNED' ELSE 'DIGITAL_TEXT' END AS category FROM nodes GROUP BY ALL)
SELECT doc_id, bool_or(category IN ('TABLE_HEAVY', 'LAYOUT_COMPLEX')) AS needs_layout, bool_or(category = 'SCANNED') AS needs_reading, count(DISTINCT category) AS n_categories FROM p GROUP BY 1""")
def parser_escalation(spark, sf_dir):
    """Which documents need a stronger parser, by the categories of their pages."""
    pages = laws.nodes(spark, sf_dir).groupBy("doc_id", "page").agg(F.bool_or(F.col("node_type") == "TABLE").alias("t"), F.sum(F.length("text")).alias("c"))
    category = F.when(F.col("t"), "TABLE_HEAVY").when(F.col("c") < 200, "SCANNED").otherwise("DIGITAL_TEXT")
    sets = pages.groupBy("doc_id").agg(F.collect_set(category).alias("has"))
    return sets.select("doc_id", F.arrays_overlap("has", F.array(F.lit("TABLE_HEAVY"), F.lit("LAYOUT_COMPLEX"))).alias("needs_layout"), F.array_contains("has", "SCANNED").alias("needs_reading"), F.size("has").cast("long").alias("n_categories"))


@query(f"""
WITH {laws.PATHS}, {turns._PARSED}, {turns._CHUNKS} SELECT conv_id, turn, doc_id, pos, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos, doc_id) AS place FROM hits QUALIFY place <= 6""")
def exact_ordered(spark, sf_dir):
    """The first six exact matches of each question in order of their place in the document."""
    return retrieval.exact_first(*turns._asked(spark, sf_dir), ["conv_id", "turn"], 6)
