"""Walks, persisted versions, audit rows, cached answers and single-document tests by hand."""

import datetime as dt
import os

from docloom.operators import lifecycle
from docloom.plans import registry
from docloom.sources import files, versions
from tests.conftest import SMALL

NAMES = ["z.pdf", "b/1.pdf", "b/a/2.pdf", "ba/3.pdf", "a/4.pdf", "a/c/5.pdf", "a/b/6.pdf", "é/7.pdf", "b-x/8.pdf", "a.txt"]


def walked(root):
    """The walk that the keys stand for, with a real stack."""
    stack, found = [""], []
    while stack:
        at = stack.pop()
        for child in sorted(os.scandir(os.path.join(root, at)), key=lambda e: e.name):
            path = f"{at}/{child.name}" if at else child.name
            stack.append(path) if child.is_dir() else found.append(path)
    return found


def test_pages_of_a_walk_follow_the_stack(spark, tmp_path):
    for name in NAMES:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    found = files.listed(spark, str(tmp_path))
    assert {(r.path, r.size) for r in found.collect()} == {(n, len(n.encode())) for n in NAMES}
    pages, after = [], None
    while rows := files.page(found, 3, after).collect():
        pages, after = pages + [r.path for r in rows], rows[-1].path
    assert pages == walked(tmp_path) and sorted(pages) == sorted(NAMES)


def test_failures_take_what_lies_below(spark):
    entries = spark.createDataFrame([("a/1",), ("a/b/2",), ("ab/3",), ("c/4",), ("c/4",), (None,)], "path string")
    failures = spark.createDataFrame([("a/b", True, "PermissionError"), ("a/b/x", True, "OSError"), ("c/4", False, "FileNotFoundError"), ("gone", True, "FileNotFoundError")], "path string, is_folder boolean, error string")
    got = {(r.path, r.status) for r in files.scanned(entries, failures).collect()}
    assert got == {("a/1", "FOUND"), ("ab/3", "FOUND"), ("a/b", "ACCESS_DENIED"), ("c/4", "NETWORK_ERROR"), ("gone", "NOT_FOUND")}
    whole = failures.limit(0).union(spark.createDataFrame([("", True, "OSError")], failures.schema))
    assert [(r.path, r.status) for r in files.scanned(entries, whole).collect()] == [("", "NETWORK_ERROR")]
    assert files.scanned(entries.limit(0), failures.limit(0)).count() == 0


def test_audit_holds_what_changed(spark):
    before = spark.createDataFrame([(1, "A"), (2, "B"), (3, None)], "id long, status string")
    after = spark.createDataFrame([(1, "A"), (2, "C"), (4, None)], "id long, status string")
    got = {(r.id, r.old_value, r.new_value) for r in versions.audit(before, after, ["id"], ["status"], "X", "y").collect()}
    assert got == {(2, '{"status":"B"}', '{"status":"C"}'), (3, "{}", None), (4, None, "{}")}


def test_cache_serves_ten_minutes_from_storing(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [("a", 1, 0), ("a", 2, 599), ("a", 3, 600), ("a", 4, 1199), ("b", 5, 10), (None, 6, 0), (None, 7, 5), ("a", 8, None), ("a", 9, 600)]
    frame = spark.createDataFrame([(k, i, None if s is None else start + dt.timedelta(seconds=s)) for k, i, s in rows], "k string, i long, t timestamp")
    got = {r.i: r.hit for r in lifecycle.cache_served(frame, "k", "t", "i").collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: False, 6: False, 7: True, 8: False, 9: True}
    assert lifecycle.cache_served(frame.limit(0), "k", "t", "i").count() == 0


def test_both_outcomes_occur(spark):
    assert {r.hit for r in registry.QUERIES["cache_hits"](spark, SMALL).select("hit").distinct().collect()} == {True, False}
    assert {r.insufficient for r in registry.QUERIES["single_document_test"](spark, SMALL).select("insufficient").distinct().collect()} == {True, False}
    assert "documents.parquet" in {r.path.split("/")[0] for r in registry.QUERIES["folder_listing"](spark, SMALL).collect()}
