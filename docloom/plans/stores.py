"""The snapshot store, version actions, structure corrections and the reservation ledger, over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docloom.operators import event_folds
from docloom.plans import regulations as laws
from docloom.plans.registry import query
from docloom.session import ensure_checkpoint_dir, table
from docloom.sources import snapshots
from docloom.streaming import ledger


def _place(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}/{uuid.uuid4()}"


@query("""
WITH d AS (SELECT doc_id, source FROM documents), p AS (SELECT doc_id, source, n FROM d, (VALUES (1), (2)) x(n)),
s AS (SELECT 3 AS at_run, doc_id, n, CASE WHEN doc_id % 3 = 0 THEN source || '-2' ELSE source END AS source FROM p WHERE doc_id % 5 <> 0 AND NOT (doc_id % 3 = 0 AND n = 2)
  UNION ALL SELECT 4, doc_id, n, CASE WHEN doc_id % 3 = 0 THEN source || '-2' ELSE source END FROM p WHERE NOT (doc_id % 3 = 0 AND n = 2)
  UNION ALL SELECT 7, doc_id, n, CASE WHEN doc_id % 7 = 0 THEN source || '-5' WHEN doc_id % 3 = 0 THEN source || '-2' ELSE source END FROM p WHERE doc_id % 11 <> 0 AND (doc_id % 7 = 0 OR NOT (doc_id % 3 = 0 AND n = 2))
  UNION ALL SELECT 8, doc_id, n, source FROM p)
SELECT at_run::BIGINT AS at_run, doc_id, n, source FROM s""")
def snapshot_runs(spark, sf_dir):
    """Documents' parts as of four runs: after a deletion, after its rollback, after compaction and another deletion, and rolled back to the first run."""
    place = _place(spark, "snapshots")
    parts = table(spark, sf_dir, "documents").select("doc_id", "source", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    renamed = lambda end: F.concat("source", F.lit(end)).alias("source")
    snapshots.upsert(parts, place, 1, "doc_id")
    snapshots.upsert(parts.where("doc_id % 3 = 0 and n = 1").select("doc_id", renamed("-2"), "n"), place, 2, "doc_id")
    snapshots.delete(parts.where("doc_id % 5 = 0"), place, 3, "doc_id")
    snapshots.rollback(spark, place, 4, 2)
    snapshots.upsert(parts.where("doc_id % 7 = 0").select("doc_id", renamed("-5"), "n"), place, 5, "doc_id")
    snapshots.compact(spark, place, 6, "doc_id")
    snapshots.delete(parts.where("doc_id % 11 = 0"), place, 7, "doc_id")
    snapshots.rollback(spark, place, 8, 1)
    found = None
    for run in (3, 4, 7, 8):
        rows = snapshots.as_of(spark, place, "doc_id", run).select(F.lit(run).cast("long").alias("at_run"), "doc_id", "n", "source")
        found = rows if found is None else found.unionByName(rows)
    return found


_STATES = ("ACTIVE", "SUPERSEDED", "ARCHIVED", "REVIEW_REQUIRED", "PROCESSING_FAILED", "SUPERSEDED", "ACTIVE")
_ACTIONS = ("ARCHIVE", "ROLLBACK", "REPROCESS", "APPROVE", "ROLLBACK")
_FOLD = f"""
WITH RECURSIVE v AS (SELECT doc_id // 4 AS document_id, list(({list(_STATES)})[doc_id % 7 + 1] ORDER BY doc_id) AS st FROM documents GROUP BY 1),
a AS (SELECT event_id % 260 AS document_id, event_id AS event, CASE WHEN event_id % 97 = 0 THEN 'DELETE' ELSE ({list(_ACTIONS)})[(event_id // 7) % 5 + 1] END AS action, user_id % 5 + 1 AS version_number, row_number() OVER (PARTITION BY event_id % 260 ORDER BY event_id) AS n FROM events),
g AS (SELECT document_id, 0::BIGINT AS n, NULL::BIGINT AS event, NULL::VARCHAR AS action, NULL::BIGINT AS version_number, NULL::VARCHAR AS verdict, NULL::BIGINT AS superseded, st FROM (SELECT document_id, st FROM v UNION ALL SELECT DISTINCT document_id, NULL FROM a WHERE document_id NOT IN (SELECT document_id FROM v))
  UNION ALL SELECT document_id, n, event, action, version_number, verdict, CASE WHEN verdict = 'APPLIED' AND action = 'ROLLBACK' THEN last_active END,
    CASE WHEN verdict <> 'APPLIED' THEN st WHEN action = 'DELETE' THEN NULL ELSE list_transform(st, lambda x, i: CASE WHEN i = target THEN CASE action WHEN 'ARCHIVE' THEN 'ARCHIVED' WHEN 'APPROVE' THEN 'APPROVED' WHEN 'ROLLBACK' THEN 'ACTIVE' ELSE 'UPLOADED' END WHEN action = 'ROLLBACK' AND i = last_active THEN 'SUPERSEDED' ELSE x END) END
  FROM (SELECT *, CASE WHEN st IS NULL THEN 'NOT_FOUND' WHEN action = 'DELETE' THEN 'APPLIED' WHEN target > len(st) THEN 'NOT_FOUND' WHEN list_contains(CASE action WHEN 'ARCHIVE' THEN ['ACTIVE'] WHEN 'APPROVE' THEN ['REVIEW_REQUIRED'] WHEN 'ROLLBACK' THEN ['SUPERSEDED', 'ARCHIVED'] ELSE ['PROCESSING_FAILED'] END, st[target]) THEN 'APPLIED' ELSE 'CONFLICT' END AS verdict
    FROM (SELECT a.document_id, a.n, a.event, a.action, a.version_number, g.st, CASE WHEN a.action IN ('ARCHIVE', 'APPROVE') THEN len(g.st) ELSE a.version_number END AS target, len(g.st) + 1 - nullif(list_position(list_reverse(g.st), 'ACTIVE'), 0) AS last_active FROM g JOIN a ON a.document_id = g.document_id AND a.n = g.n + 1)))
"""


def _version_fold(spark, sf_dir):
    pick = lambda names, at: F.get(F.array(*map(F.lit, names)), at.cast("int"))
    held = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 4).cast("long").alias("document_id"), (F.col("doc_id") % 4 + 1).alias("version_number"), pick(_STATES, F.col("doc_id") % 7).alias("status"))
    event = F.col("event_id")
    action = F.when(event % 97 == 0, "DELETE").otherwise(pick(_ACTIONS, F.floor(event / 7) % 5))
    asked = table(spark, sf_dir, "events").select((event % 260).alias("document_id"), event.alias("event"), action.alias("action"), (F.col("user_id") % 5 + 1).alias("version_number"))
    return event_folds.version_events(held, asked)


@query(_FOLD + "SELECT document_id, event, action, version_number, verdict, superseded FROM g WHERE n > 0")
def version_actions(spark, sf_dir):
    """Archivings, approvals, rollbacks, reprocessings and deletions in order, each judged by the versions as they then are."""
    return _version_fold(spark, sf_dir).where("event IS NOT NULL").select("document_id", "event", "action", "version_number", "verdict", "superseded")


@query(_FOLD + "SELECT document_id, i AS version_number, st[i] AS status FROM (SELECT document_id, st, unnest(range(1, len(st) + 1)) AS i FROM g QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY n DESC) = 1)")
def version_states(spark, sf_dir):
    """Every version's status after all actions."""
    return _version_fold(spark, sf_dir).where("event IS NULL").select("document_id", "version_number", "status")


_CORRECTED = f"""
WITH RECURSIVE {laws.TREE}, k AS (SELECT t.doc_id, t.pos, t.parent, n.node_type AS kind FROM tree t JOIN nodes n USING (doc_id, pos)),
d AS (SELECT doc_id, list(pos ORDER BY pos) AS ps, list(coalesce(parent, -1) ORDER BY pos) AS up, list(kind ORDER BY pos) AS kinds, list(0::BIGINT ORDER BY pos) AS changes, max(pos) AS top FROM k GROUP BY doc_id),
e AS (SELECT doc_id, pos AS event, 'CORRECT' AS action, pos, CASE WHEN pos % 5 = 4 THEN NULL ELSE (pos * 7 + doc_id) % (top + 2) END AS parent, CASE WHEN pos % 3 = 0 THEN 'PARAGRAPH' END AS kind FROM k JOIN d USING (doc_id)
  UNION ALL SELECT doc_id, 100000 + x.n, CASE WHEN x.n < 3 THEN 'APPROVE' ELSE 'CORRECT' END, CASE WHEN x.n < 3 THEN NULL ELSE top END, CASE WHEN x.n < 3 THEN NULL ELSE top // 2 END, NULL FROM d, (VALUES (1), (2), (3)) x(n) WHERE x.n < 3 OR doc_id % 2 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY event) AS n FROM e),
g AS (SELECT doc_id, 0::BIGINT AS n, NULL::BIGINT AS event, NULL::BIGINT AS pos, NULL::VARCHAR AS verdict, ps, up, kinds, changes, false AS approved FROM d
  UNION ALL SELECT doc_id, n, event, pos, verdict, ps, CASE WHEN changed AND parent IS NOT NULL THEN list_transform(up, lambda x, i: CASE WHEN i = place THEN parent ELSE x END) ELSE up END,
    CASE WHEN changed AND kind IS NOT NULL THEN list_transform(kinds, lambda x, i: CASE WHEN i = place THEN kind ELSE x END) ELSE kinds END, CASE WHEN changed THEN list_transform(changes, lambda x, i: CASE WHEN i = place THEN x + 1 ELSE x END) ELSE changes END, CASE WHEN verdict <> 'APPLIED' THEN approved ELSE action = 'APPROVE' END
  FROM (SELECT *, verdict = 'APPLIED' AND action = 'CORRECT' AS changed FROM (SELECT *, CASE WHEN action = 'APPROVE' THEN CASE WHEN approved THEN 'CONFLICT' ELSE 'APPLIED' END WHEN place IS NULL OR (parent IS NOT NULL AND list_position(ps, parent) IS NULL) THEN 'NOT_FOUND'
      WHEN parent IS NOT NULL AND list_reduce(list_prepend(parent, range(len(ps))), lambda c, z: CASE WHEN c = pos OR c = -1 THEN c ELSE up[list_position(ps, c)] END) = pos THEN 'CYCLE' ELSE 'APPLIED' END AS verdict
    FROM (SELECT o.doc_id, o.n, o.event, o.action, o.pos, o.parent, o.kind, g.ps, g.up, g.kinds, g.changes, g.approved, nullif(list_position(g.ps, o.pos), 0) AS place FROM g JOIN o ON o.doc_id = g.doc_id AND o.n = g.n + 1))))
"""


def _corrected(spark, sf_dir):
    kinds = laws.nodes(spark, sf_dir).select("doc_id", "pos", F.col("node_type").alias("kind"))
    held = laws.tree(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("parent").cast("long").alias("parent")).join(kinds, ["doc_id", "pos"])
    tops = held.groupBy("doc_id").agg(F.max("pos").alias("top"))
    pos = F.col("pos")
    moved = F.when(pos % 5 != 4, (pos * 7 + F.col("doc_id")) % (F.col("top") + 2))
    first = held.join(tops, "doc_id").select("doc_id", pos.alias("event"), F.lit("CORRECT").alias("action"), "pos", moved.alias("parent"), F.when(pos % 3 == 0, "PARAGRAPH").alias("kind"))
    late, n = F.col("n") == 3, F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("n")
    then = tops.select("doc_id", "top", n).where(~late | (F.col("doc_id") % 2 == 0))
    then = then.select("doc_id", (100000 + F.col("n")).cast("long").alias("event"), F.when(late, "CORRECT").otherwise("APPROVE").alias("action"), F.when(late, F.col("top")).alias("pos"), F.when(late, F.floor(F.col("top") / 2)).alias("parent"), F.lit(None).cast("string").alias("kind"))
    return event_folds.corrections(held, first.unionByName(then))


@query(_CORRECTED + "SELECT doc_id, event, pos, verdict FROM g WHERE n > 0")
def correction_verdicts(spark, sf_dir):
    """Moves and retypings in order, each checked against the tree that those before it left, and approvals of the structure."""
    return _corrected(spark, sf_dir).where("event IS NOT NULL").select("doc_id", "event", "pos", "verdict")


@query(_CORRECTED + "SELECT doc_id, unnest(ps) AS pos, nullif(unnest(up), -1) AS parent, unnest(kinds) AS kind, unnest(changes) AS changes, approved FROM (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) = 1)")
def corrected_nodes(spark, sf_dir):
    """The trees after all corrections, and whether they are approved."""
    return _corrected(spark, sf_dir).where("event IS NULL").select("doc_id", "pos", "parent", "kind", "changes", "approved")


@query("""
WITH o AS (SELECT o_custkey AS owner, round(o_totalprice)::BIGINT AS amount, o_orderdate AS began, o_orderkey % 45 * 60 AS after, o_orderstatus AS s FROM orders),
m AS (SELECT max(CASE WHEN s = 'O' THEN began ELSE began + INTERVAL (after) SECOND END) AS t FROM o),
e AS (SELECT owner, amount, CASE WHEN s <> 'O' AND after <= 1800 THEN CASE s WHEN 'F' THEN 'SETTLED' ELSE 'RELEASED' END WHEN s <> 'O' OR began + INTERVAL 1800 SECOND < t THEN 'STALE' ELSE 'RESERVED' END AS status FROM o, m)
SELECT owner, coalesce(sum(amount) FILTER (WHERE status = 'RESERVED'), 0)::BIGINT AS reserved, coalesce(sum(amount) FILTER (WHERE status = 'SETTLED'), 0)::BIGINT AS spent, coalesce(sum(amount) FILTER (WHERE status IN ('RELEASED', 'STALE')), 0)::BIGINT AS released, count(*) FILTER (WHERE status = 'STALE') AS stale FROM e GROUP BY owner""")
def ledger_stream(spark, sf_dir):
    """Orders as reservations that are settled, released or go stale, as keyed state with timers."""
    orders = spark.readStream.schema(table(spark, sf_dir, "orders").schema).parquet(f"{sf_dir}/orders.parque[t]")
    at, after, entry = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 45 * 60, [F.col("o_orderkey").alias("entry_id"), F.col("o_custkey").alias("owner"), F.round("o_totalprice").cast("long").alias("amount")]
    ends = F.when(F.col("o_orderstatus") == "F", "SETTLE").when(F.col("o_orderstatus") != "O", "RELEASE")
    both = F.filter(F.array(F.struct(F.lit("RESERVE").alias("event"), at.alias("at")), F.struct(ends.alias("event"), (at + F.make_dt_interval(secs=after)).alias("at"))), lambda x: x["event"].isNotNull())
    place = _place(spark, "streams")
    return ledger.balances(ledger.run(spark, orders.select(*entry, F.inline(both)), f"{place}/out", f"{place}/state"))
