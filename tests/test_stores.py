"""The snapshot store, ordered folds and the reservation ledger by hand: failed and repeated runs, order, restarts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docloom.operators import event_folds
from docloom.sources import snapshots
from docloom.streaming import ledger


def state(spark, place, at=None):
    return sorted(map(tuple, snapshots.as_of(spark, place, "v", at).select("v", "x").collect()))


def test_runs_are_atomic_and_repeatable(spark, tmp_path):
    place = str(tmp_path / "store")
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "v long, x string")
    snapshots.upsert(rows, place, 1, "v")
    snapshots.stage(rows.where("v = 2").withColumn("x", F.lit("half")), place, 2, "v")  # fails before its commit
    assert state(spark, place) == [(1, "a"), (1, "b"), (2, "c")]
    for _ in range(2):  # repeated after the failure, and once more after it was committed
        snapshots.upsert(rows.where("x = 'a'"), place, 2, "v")
        assert state(spark, place) == [(1, "a"), (2, "c")]
    assert spark.read.parquet(f"{place}/rows").where("run = 2").count() == 1
    snapshots.upsert(rows.limit(0), place, 3, "v", touched=rows.where("v = 1"))  # parsed again into nothing
    assert state(spark, place) == [(2, "c")]
    with pytest.raises(ValueError, match="older"):
        snapshots.upsert(rows, place, 0, "v")


def test_rollbacks_compaction_and_deletion(spark, tmp_path):
    place = str(tmp_path / "store")
    rows = spark.createDataFrame([(1, "a"), (2, "c"), (None, "n")], "v long, x string")
    snapshots.upsert(rows.where("v is not null"), place, 1, "v")
    snapshots.delete(rows.where("v = 1"), place, 2, "v")
    snapshots.rollback(spark, place, 3, 1)
    assert state(spark, place) == [(1, "a"), (2, "c")] and state(spark, place, 2) == [(2, "c")]
    snapshots.rollback(spark, place, 4, 2)  # a rollback is rolled back
    assert state(spark, place) == [(2, "c")]
    snapshots.compact(spark, place, 5, "v")
    snapshots.upsert(rows.where("v = 1"), place, 6, "v")
    assert state(spark, place) == [(1, "a"), (2, "c")] and snapshots.effective(snapshots.manifest(spark, place)) == [5, 6]
    snapshots.rollback(spark, place, 7, 0)
    assert state(spark, place) == [] and state(spark, place, 6) == [(1, "a"), (2, "c")]
    with pytest.raises(ValueError, match="isn't committed"):
        snapshots.rollback(spark, place, 8, 99)


def test_a_repeated_audit_run_doubles_nothing(spark, tmp_path):
    place = str(tmp_path / "audit")
    rows = spark.createDataFrame([(1, "X")], "id long, action string")
    for run in (1, 2, 2, 1):
        snapshots.append_once(rows, place, run)
    assert spark.read.parquet(place).count() == 2


def test_version_actions_follow_the_state_as_it_then_is(spark):
    versions = spark.createDataFrame([(1, 1, "SUPERSEDED"), (1, 2, "ACTIVE"), (2, 1, "PROCESSING_FAILED"), (3, 1, "REVIEW_REQUIRED"), (None, 1, "ACTIVE")], "document_id long, version_number long, status string")
    asked = [
        (1, 1, "ROLLBACK", 1, "APPLIED", 2), (1, 2, "ROLLBACK", 1, "CONFLICT", None), (1, 3, "ARCHIVE", None, "CONFLICT", None), (1, 4, "ROLLBACK", 2, "APPLIED", 1), (1, 5, "ARCHIVE", None, "APPLIED", None),
        (1, 6, "ROLLBACK", 2, "APPLIED", None), (1, 7, "ROLLBACK", 9, "NOT_FOUND", None), (2, 1, "REPROCESS", 1, "APPLIED", None), (2, 2, "REPROCESS", 1, "CONFLICT", None), (2, 3, "DELETE", None, "APPLIED", None), (2, 4, "REPROCESS", 1, "NOT_FOUND", None),
        (3, 1, "APPROVE", None, "APPLIED", None), (3, 2, "APPROVE", None, "CONFLICT", None), (3, 3, "SHRED", 1, "CONFLICT", None), (4, 1, "DELETE", None, "NOT_FOUND", None),
    ]
    actions = spark.createDataFrame([a[:4] for a in asked], "document_id long, event long, action string, version_number long").repartition(3)
    found = event_folds.version_events(versions, actions).collect()
    assert sorted((r.document_id, r.event, r.verdict, r.superseded) for r in found if r.event is not None) == sorted((d, e, v, s) for d, e, _, _, v, s in asked)
    assert sorted((r.document_id, r.version_number, r.status) for r in found if r.event is None) == [(1, 1, "SUPERSEDED"), (1, 2, "ACTIVE"), (3, 1, "APPROVED")]


def test_a_move_may_be_legal_only_after_another(spark):
    nodes = spark.createDataFrame([(1, 0, None, "CHAPTER"), (1, 1, 0, "ARTICLE"), (1, 2, 1, "CLAUSE"), (1, 3, None, "CHAPTER")], "doc_id long, pos long, parent long, kind string")
    moves = [
        (1, 1, "CORRECT", 1, 2, None, "CYCLE"), (1, 2, "CORRECT", 2, 3, None, "APPLIED"), (1, 3, "CORRECT", 1, 2, None, "APPLIED"), (1, 4, "CORRECT", 3, 1, "X", "CYCLE"), (1, 5, "CORRECT", 0, 0, None, "CYCLE"),
        (1, 6, "CORRECT", 9, 0, None, "NOT_FOUND"), (1, 7, "CORRECT", 0, 9, None, "NOT_FOUND"), (1, 8, "APPROVE", None, None, None, "APPLIED"), (1, 9, "APPROVE", None, None, None, "CONFLICT"), (1, 10, "CORRECT", 3, None, "APPENDIX", "APPLIED"),
        (2, 1, "APPROVE", None, None, None, "CONFLICT"),
    ]
    events = spark.createDataFrame([m[:6] for m in moves], "doc_id long, event long, action string, pos long, parent long, kind string").repartition(3)
    found = event_folds.corrections(nodes, events).collect()
    assert sorted((r.doc_id, r.event, r.verdict) for r in found if r.event is not None) == sorted((m[0], m[1], m[6]) for m in moves)
    assert sorted((r.pos, r.parent, r.kind, r.changes, r.approved) for r in found if r.event is None) == [(0, None, "CHAPTER", 0, False), (1, 2, "ARTICLE", 1, False), (2, 3, "CLAUSE", 1, False), (3, None, "APPENDIX", 1, False)]


def test_folds_of_empty_tables(spark):
    versions = spark.createDataFrame([], "document_id long, version_number long, status string")
    assert event_folds.version_events(versions, spark.createDataFrame([], "document_id long, event long, action string, version_number long")).collect() == []


def test_the_ledger_goes_on_after_a_restart(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    at = lambda minutes: t0 + dt.timedelta(minutes=minutes)
    first = [(1, 7, "RESERVE", 10, at(0)), (2, 7, "RESERVE", 20, at(1)), (2, 7, "SETTLE", 20, at(5)), (3, 7, "RESERVE", 30, at(2)), (4, 8, "RESERVE", 40, at(20)), (5, 8, "SETTLE", 50, at(3)), (None, 8, "RESERVE", 1, at(3))]
    second = [(3, 7, "RELEASE", 30, at(21)), (4, 8, "SETTLE", 40, at(22)), (2, 7, "RELEASE", 20, at(22)), (1, 7, "SETTLE", 10, at(40)), (6, 9, "RESERVE", 60, at(45)), (6, 9, "RESERVE", 60, at(46)), (7, 9, "RESERVE", 70, at(50))]
    third = [(8, 9, "RESERVE", 80, at(77))]
    shape = "entry_id long, owner long, event string, amount long, at timestamp"
    for number, rows in enumerate((first, second, third)):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
        moves = ledger.run(spark, events, str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted(map(tuple, ledger.balances(moves).collect()))
    # 1 went stale before it was settled, 6 by its timer; 7 and 8 are still open
    assert got == [(7, 0, 20, 40, 1), (8, 0, 40, 0, 0), (9, 150, 0, 60, 1)]
    once = ledger.run(spark, spark.readStream.schema(shape).parquet(str(tmp_path / "in")), str(tmp_path / "out2"), str(tmp_path / "state2"))
    assert sorted(map(tuple, ledger.balances(once).collect())) == got


def test_the_ledger_doesnt_mind_the_order_of_batches(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(1, 7, "RESERVE", 10, 0), (1, 7, "SETTLE", 10, 5), (2, 7, "RESERVE", 20, 1), (2, 7, "RELEASE", 20, 31), (3, 8, "SETTLE", 30, 2), (3, 8, "RESERVE", 30, 3), (4, 8, "RESERVE", 40, 2), (4, 8, "SETTLE", 40, 33), (4, 8, "RESERVE", 41, 34), (5, 9, "RESERVE", 50, 30)]
    shape = "entry_id long, owner long, event string, amount long, at timestamp"
    frame = spark.createDataFrame([(*r[:4], t0 + dt.timedelta(minutes=r[4])) for r in rows], shape)
    moves = {}
    for name, parts in (("once", [frame]), ("apart", [frame.where("event <> 'RESERVE'"), frame.where("event = 'RESERVE'")]), ("timers", [frame])):
        for part in parts:
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
            events = spark.readStream.schema(shape).parquet(str(tmp_path / name / "in"))
            found = ledger.run(spark, events, str(tmp_path / name / "out"), str(tmp_path / name / "state"), timers=name == "timers")
        moves[name] = sorted(map(tuple, found.select("entry_id", "owner", "amount", "status", "reason", "seq").collect()))
    assert moves["once"] == moves["apart"] == moves["timers"]
    assert moves["once"] == [
        (1, 7, 10, "RESERVED", "RESERVE", 1), (1, 7, 10, "SETTLED", "SETTLE", 2), (2, 7, 20, "RELEASED", "RELEASE", 2), (2, 7, 20, "RESERVED", "RESERVE", 1), (3, 8, 30, "RELEASED", "STALE", 2), (3, 8, 30, "RESERVED", "RESERVE", 1),
        (4, 8, 40, "RELEASED", "STALE", 2), (4, 8, 40, "RESERVED", "RESERVE", 1), (5, 9, 50, "RESERVED", "RESERVE", 1),
    ]
