"""A store of versions with a manifest of runs: read as of any run, roll back, compact; a run that fails or is repeated adds nothing twice.

A run writes its rows and the versions that it touches to partitions of its own and is then committed by one file. Without
that file nobody reads the run, and running it again replaces its own partitions only. A run that is committed isn't written
again. Runs are numbered by their caller, ever higher; the manifest has one small row a run.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPSERT, DELETE, ROLLBACK, COMPACT = "UPSERT", "DELETE", "ROLLBACK", "COMPACT"
_MANIFEST = "run long, action string, target long"


def _partition(rows: DataFrame, path: str, run: int) -> None:
    """``rows`` as the partition of ``run``; what the partition held before is replaced, other runs' stay."""
    rows.withColumn("run", F.lit(run).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def stage(rows: DataFrame, path: str, run: int, version: str, touched: DataFrame | None = None) -> None:
    """Writes what ``run`` makes of its versions. ``touched`` names versions beyond those of ``rows``, which thereby lose all their rows."""
    _partition(rows, f"{path}/rows", run)
    named = rows.select(version) if touched is None else rows.select(version).unionByName(touched.select(version))
    _partition(named.distinct(), f"{path}/touched", run)


def commit(spark: SparkSession, path: str, run: int, action: str, target: int | None = None) -> None:
    spark.createDataFrame([(run, action, target)], _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/commits/run={run}")


def manifest(spark: SparkSession, path: str) -> list:
    """The committed runs in order: (run, action, target)."""
    try:
        held = spark.read.schema(_MANIFEST).json(f"{path}/commits/*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(map(tuple, held.select("run", "action", "target").collect()))


def _committed(spark: SparkSession, path: str, run: int) -> bool:
    """Whether ``run`` is committed; a run before the last committed one can't come later."""
    runs = [r for r, _, _ in manifest(spark, path)]
    if run not in runs and runs and run < runs[-1]:
        raise ValueError(f"run {run} is older than the committed run {runs[-1]}")
    return run in runs


def upsert(rows: DataFrame, path: str, run: int, version: str, touched: DataFrame | None = None) -> None:
    """Replaces all rows of the versions that ``rows`` or ``touched`` name."""
    if not _committed(rows.sparkSession, path, run):
        stage(rows, path, run, version, touched)
        commit(rows.sparkSession, path, run, UPSERT)


def delete(gone: DataFrame, path: str, run: int, version: str) -> None:
    """Removes the versions that ``gone`` names."""
    spark = gone.sparkSession
    if not _committed(spark, path, run):
        stage(spark.read.parquet(f"{path}/rows").drop("run").limit(0), path, run, version, gone)
        commit(spark, path, run, DELETE)


def effective(runs: list, at: int | None = None) -> list[int]:
    """The runs that make up the state as of run ``at`` (None: the last)."""
    state: list[int] = []
    states = {0: state}
    for run, action, target in runs:
        if at is None or run <= at:
            state = [run] if action == COMPACT else list(states[target]) if action == ROLLBACK else [*state, run]
            states[run] = state
    return state


def as_of(spark: SparkSession, path: str, version: str, at: int | None = None) -> DataFrame:
    """The rows as of run ``at``: of each version those of the last effective run that touched it. Only effective runs' partitions are read."""
    runs = effective(manifest(spark, path), at)
    rows, touched = (spark.read.parquet(f"{path}/{name}").where(F.col("run").isin(runs)) for name in ("rows", "touched"))
    last = touched.groupBy(version).agg(F.max("run").alias("run"))
    return rows.join(last, [version, "run"], "left_semi").drop("run")


def rollback(spark: SparkSession, path: str, run: int, target: int) -> None:
    """Makes the state as of run ``target`` (0: before the first) the present one. Nothing is rewritten, so a rollback can be rolled back."""
    if not _committed(spark, path, run):
        if target != 0 and target not in [r for r, _, _ in manifest(spark, path)]:
            raise ValueError(f"run {target} isn't committed")
        commit(spark, path, run, ROLLBACK, target)


def compact(spark: SparkSession, path: str, run: int, version: str) -> None:
    """Writes the present state as one run, from which later readers start; states before it can still be read."""
    if not _committed(spark, path, run):
        stage(as_of(spark, path, version), path, run, version)
        commit(spark, path, run, COMPACT)


def append_once(rows: DataFrame, path: str, run: int) -> None:
    """Rows that are never changed, such as audit rows, as the part of ``run``: repeated, it replaces its own part."""
    _partition(rows, path, run)
