"""Ordered folds: events applied one after another to the state of their key, each checked against the state as it then is.

A key's state rows and events pass through one task in order, state first, in batches; what is held is the state of one
key, never its events. The order is what makes it a fold: an event may be legal only because of the one before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

APPLIED, CONFLICT, NOT_FOUND, CYCLE = "APPLIED", "CONFLICT", "NOT_FOUND", "CYCLE"
ACTIVE, ARCHIVED, SUPERSEDED, UPLOADED, FAILED, REVIEW, APPROVED = "ACTIVE", "ARCHIVED", "SUPERSEDED", "UPLOADED", "PROCESSING_FAILED", "REVIEW_REQUIRED", "APPROVED"


def folded(state: DataFrame, events: DataFrame, key: str, order: str, fold: Callable, out: str) -> DataFrame:
    """What ``fold()`` tells of each key. It has ``begin(row)``, ``apply(row)``, which returns a row of ``out``, and ``end()``, which yields rows."""
    both = state.withColumns({"__event": F.lit(False), order: F.lit(None).cast(events.schema[order].dataType)}).unionByName(events.withColumn("__event", F.lit(True)), allowMissingColumns=True)
    dealt = both.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, "__event", order)
    spark = state.sparkSession
    shape = spark.createDataFrame([], f"{key} {dealt.schema[key].dataType.simpleString()}, {out}").schema
    names = shape.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, last, held = to_arrow_schema(shape), None, None

        def told(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({n: [r.get(n) for r in rows] for n in names}, schema=arrow)

        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if held is None or row[key] != last:
                    if held is not None:
                        rows += [{key: last, **r} for r in held.end()]
                    last, held = row[key], fold()
                if row["__event"]:
                    rows.append({key: last, **held.apply(row)})
                else:
                    held.begin(row)
            yield told(rows)
        if held is not None:
            yield told([{key: last, **r} for r in held.end()])

    return dealt.mapInArrow(run, shape)


class Lifecycle:
    """The versions of one document. Archiving and approving mean its last version; rollback and reprocessing name one."""

    def __init__(self) -> None:
        self.status: dict[int, str] = {}

    def begin(self, row: dict) -> None:
        self.status[row["version_number"]] = row["status"]

    def apply(self, row: dict) -> dict:
        verdict, gave_way = self._verdict(row["action"], row["version_number"])
        return {"event": row["event"], "action": row["action"], "version_number": row["version_number"], "verdict": verdict, "superseded": gave_way}

    def _verdict(self, action: str, version: int | None) -> tuple[str, int | None]:
        held = self.status
        if not held:
            return NOT_FOUND, None
        if action == "DELETE":
            held.clear()
            return APPLIED, None
        at = max(held) if action in ("ARCHIVE", "APPROVE") else version
        if at not in held:
            return NOT_FOUND, None
        needs, becomes = {"ARCHIVE": ((ACTIVE,), ARCHIVED), "APPROVE": ((REVIEW,), APPROVED), "ROLLBACK": ((SUPERSEDED, ARCHIVED), ACTIVE), "REPROCESS": ((FAILED,), UPLOADED)}.get(action, ((), None))
        if held[at] not in needs:
            return CONFLICT, None
        gave_way = max((v for v, s in held.items() if s == ACTIVE), default=None) if action == "ROLLBACK" else None
        if gave_way is not None:
            held[gave_way] = SUPERSEDED
        held[at] = becomes
        return APPLIED, gave_way

    def end(self) -> Iterator[dict]:
        return ({"version_number": v, "status": s} for v, s in self.status.items())


def version_events(versions: DataFrame, actions: DataFrame) -> DataFrame:
    """Verdicts (document_id, event, action, version_number, verdict, superseded) and, where event is null, final versions (document_id, version_number, status).

    ``versions``: document_id, version_number, status; ``actions``: document_id, event, action, version_number. ARCHIVE, APPROVE,
    ROLLBACK, REPROCESS and DELETE are taken by event; other actions are a CONFLICT. A rollback supersedes the last active version.
    Null document ids are left out; an action on a document without versions is NOT_FOUND.
    """
    own = versions.select("document_id", "version_number", "status")
    asked = actions.select("document_id", "event", "action", "version_number")
    return folded(own, asked, "document_id", "event", Lifecycle, "event long, action string, version_number long, verdict string, superseded long, status string")


class Corrections:
    """The nodes of one document."""

    def __init__(self) -> None:
        self.nodes: dict[int, list] = {}
        self.approved = False

    def begin(self, row: dict) -> None:
        self.nodes[row["pos"]] = [row["parent"], row["kind"], 0]

    def apply(self, row: dict) -> dict:
        return {"event": row["event"], "pos": row["pos"], "verdict": self._verdict(row)}

    def _verdict(self, row: dict) -> str:
        if row["action"] == "APPROVE":
            if self.approved or not self.nodes:
                return CONFLICT
            self.approved = True
            return APPLIED
        node, to = self.nodes.get(row["pos"]), row["parent"]
        if node is None or (to is not None and to not in self.nodes):
            return NOT_FOUND
        above = to
        while above is not None and above in self.nodes:
            if above == row["pos"]:
                return CYCLE
            above = self.nodes[above][0]
        node[0] = node[0] if to is None else to
        node[1] = node[1] if row["kind"] is None else row["kind"]
        node[2] += 1
        self.approved = False
        return APPLIED

    def end(self) -> Iterator[dict]:
        return ({"pos": pos, "parent": parent, "kind": kind, "changes": n, "approved": self.approved} for pos, (parent, kind, n) in self.nodes.items())


def corrections(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """Verdicts (doc_id, event, pos, verdict) and, where event is null, final nodes (doc_id, pos, parent, kind, changes, approved).

    ``nodes``: doc_id, pos, parent, kind, a tree; ``events``: doc_id, event, action (CORRECT or APPROVE), pos, parent, kind; a null
    parent or kind stays as it is. A move below the node itself or its subtree, as earlier events left it, is a CYCLE and changes
    nothing of its event. A structure is approved once; a correction after that asks for approval anew. Null doc ids are left out.
    """
    own = nodes.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("parent").cast("long").alias("parent"), "kind")
    asked = events.select("doc_id", "event", "action", F.col("pos").cast("long").alias("pos"), F.col("parent").cast("long").alias("parent"), "kind")
    return folded(own, asked, "doc_id", "event", Corrections, "event long, pos long, verdict string, parent long, kind string, changes long, approved boolean")


class Names:
    """The names taken of one family: all that differ by trailing numbers only, so that no other family's names can clash with them."""

    def __init__(self) -> None:
        self.taken: set[str] = set()
        self.next: dict[str, int] = {}

    def begin(self, row: dict) -> None:
        self.taken.add(row["slug"])

    def apply(self, row: dict) -> dict:
        base, n = row["slug"], self.next.get(row["slug"], 0)
        while (name := base if n == 0 else f"{base}-{n}") in self.taken:
            n += 1
        self.next[base] = n + 1  # names are never given back
        self.taken.add(name)
        return {"id": row["id"], "slug": base, "name": name}

    def end(self) -> Iterator[dict]:
        return iter(())


def unique_slugs(held: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, slug, name): each of ``asked`` (id, slug) in order of id gets its slug or the first of slug-1, slug-2, ... that is free.

    ``held``: slug, the names that are taken before. A name counts as taken however it came about. Null slugs get no row.
    """
    family = F.regexp_replace("slug", r"(-[0-9]+)+$", "").alias("family")
    found = folded(held.select(family, "slug"), asked.select(family, "id", "slug"), "family", "id", Names, "id long, slug string, name string")
    return found.select("id", "slug", "name")
