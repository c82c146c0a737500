"""Catalogs, versions, snapshots, budgets and guards as rewrites of whole tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CACHE_SECONDS = 600


def catalog_scanned(catalog: DataFrame, seen: DataFrame, keys: list[str], facts: list[str]) -> DataFrame:
    """The catalog after a scan: keys, facts and ``change`` (NEW, UPDATED, SAME or, not seen, KEPT). Entries are never marked missing."""
    old = catalog.select(*keys, F.struct(*facts).alias("old"))
    new = seen.dropDuplicates(keys).select(*keys, F.struct(*facts).alias("new"))
    joined = old.join(new, keys, "full")
    change = F.when(F.col("old").isNull(), "NEW").when(F.col("new").isNull(), "KEPT").when(F.col("old").eqNullSafe(F.col("new")), "SAME").otherwise("UPDATED")
    now = F.coalesce("new", "old")
    return joined.select(*keys, *(now[f].alias(f) for f in facts), change.alias("change"))


def snapshot_changed(snapshot: DataFrame, changes: DataFrame, keys: list[str], order: str, deleted: str) -> DataFrame:
    """The snapshot with each key's last change applied: rows replaced, added, or gone where ``deleted`` is true."""
    both = snapshot.withColumns({order: F.lit(None).cast(changes.schema[order].dataType), deleted: F.lit(False)}).unionByName(changes)
    place = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last())
    return both.withColumn("__n", F.row_number().over(place)).where(F.col("__n") == 1).where(~F.col(deleted)).drop("__n", order, deleted)


def uploads_admitted(uploads: DataFrame, versions: DataFrame) -> DataFrame:
    """(upload_id, organization, document_id, file_hash, version_number) of uploads whose content their organization doesn't hold yet.

    Of several uploads of one content the first counts; a document's uploads go on from its last version.
    ``uploads``: upload_id, organization, document_id, file_hash; ``versions``: organization, document_id, version_number, file_hash.
    """
    fresh = uploads.join(versions.select("organization", "file_hash"), ["organization", "file_hash"], "left_anti")
    first = fresh.withColumn("n", F.row_number().over(Window.partitionBy("organization", "file_hash").orderBy("upload_id"))).where("n = 1").drop("n")
    last = versions.groupBy("document_id").agg(F.max("version_number").alias("last"))
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("upload_id"))
    return first.join(last, "document_id", "left").select("upload_id", "organization", "document_id", "file_hash", (F.coalesce("last", F.lit(0)) + place).cast("long").alias("version_number"))


def superseded(versions: DataFrame) -> DataFrame:
    """``versions`` (document_id, version_number, status) with ``new_status`` and ``superseded_by``: of a document's ACTIVE or INDEXING versions the last is ACTIVE, the others give way to the next."""
    live = F.col("status").isin("ACTIVE", "INDEXING")
    after = Window.partitionBy("document_id").orderBy("version_number").rowsBetween(1, Window.unboundedFollowing)
    later = F.min(F.when(live, F.col("version_number"))).over(after)
    new = F.when(~live, F.col("status")).when(later.isNull(), "ACTIVE").otherwise("SUPERSEDED")
    return versions.withColumns({"new_status": new, "superseded_by": F.when(live, later)})


def admitted(requests: DataFrame, limit: Column | float, groups: list[str], order: str, amount: str) -> DataFrame:
    """(groups, order, amount, admitted): in order, a request passes if it fits beside what has passed; one that doesn't consumes nothing.

    Greedy admission has no parallel form within a group, a tenant's budget period. A group's requests pass through one task in
    sorted batches, of which only the sum so far is kept. A null amount is neither admitted nor refused and consumes nothing.
    """
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    rows = requests.select(*groups, order, amount, limit.cast(requests.schema[amount].dataType).alias("__limit"))
    shape = rows.drop("__limit").withColumn("admitted", F.lit(None).cast("boolean")).schema
    n = len(groups)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, used = None, 0
        for batch in batches:
            told = []
            for *key, _, wanted, most in zip(*(c.to_pylist() for c in batch.columns)):
                if key != last:
                    last, used = key, 0
                fits = None if wanted is None or most is None else used + wanted <= most
                used = used + wanted if fits else used
                told.append(fits)
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 2], pa.array(told, pa.bool_())], names=[*batch.schema.names[: n + 2], "admitted"])

    return rows.repartition(*groups).sortWithinPartitions(*groups, order).mapInArrow(decide, shape)


def settled(entries: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, reserved, spent, released) of ledger entries (status, amount): open reservations, charges, and what was given back."""

    def total(status: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("status") == status, F.col("amount"))), F.lit(0))

    return entries.groupBy(*groups).agg(total("RESERVED").alias("reserved"), total("SETTLED").alias("spent"), total("RELEASED").alias("released"))


def owner_guard(members: DataFrame, leaving: DataFrame) -> DataFrame:
    """``leaving`` (organization, user_id) plus ``allowed``: the last owner of an organization stays."""
    owners = members.where("role = 'OWNER'").groupBy("organization").agg(F.count("*").alias("owners"))
    own = members.select("organization", "user_id", "role")
    others = F.coalesce("owners", F.lit(0)) - (F.col("role") == "OWNER").cast("int")
    return leaving.join(own, ["organization", "user_id"]).join(owners, "organization", "left").select("organization", "user_id", "role", ((F.col("role") != "OWNER") | (others > 0)).alias("allowed"))


def rates_at(facts: DataFrame, rates: DataFrame, key: str, at: str, fact: str) -> DataFrame:
    """``facts`` plus ``rate``: the latest rate of its key in force at its time. ``rates``: key, effective_from, effective_until, rate."""
    inside = (F.col("effective_from") <= F.col(at)) & (F.col("effective_until").isNull() | (F.col("effective_until") > F.col(at)))
    met = facts.select(fact, key, at).join(rates, key).where(inside).groupBy(fact).agg(F.max_by("rate", "effective_from").alias("rate"))
    return facts.join(met, fact, "left")


def cache_served(requests: DataFrame, key: str, at: str, order: str, seconds: int = CACHE_SECONDS) -> DataFrame:
    """``requests`` plus ``hit``: an answer of the same key was stored less than ``seconds`` before.

    A request that isn't served stores its answer; one that is doesn't prolong it. Requests are taken by time, ties by
    ``order``. Where a key rests for ``seconds`` or more nothing stored before counts, so its requests are cut there; each piece passes
    through one task in sorted batches, of which only the last storing time is kept. Null keys
    share one entry; a request without a time is never served and stores nothing.
    """
    span = pd.Timedelta(seconds=seconds)

    def serve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun, last, stored = False, None, pd.NaT
        for batch in batches:
            hits = []
            for k, t in zip(batch[key], batch[at]):
                k = None if pd.isna(k) else k
                if not begun or k != last:
                    begun, last, stored = True, k, pd.NaT
                hit = bool(pd.notna(t) and pd.notna(stored) and t < stored + span)
                if pd.notna(t) and not hit:
                    stored = t
                hits.append(hit)
            yield batch.assign(hit=hits)

    line = Window.partitionBy(key).orderBy(at, order)
    rested = F.col(at) >= F.lag(at).over(line) + F.make_dt_interval(secs=F.lit(seconds))
    pieces = requests.withColumn("__rested", F.when(rested, F.col(at))).withColumn("__piece", F.last("__rested", ignorenulls=True).over(line))
    dealt = pieces.repartition(key, "__piece").sortWithinPartitions(key, at, order).select(*requests.columns)
    return dealt.mapInPandas(serve, requests.withColumn("hit", F.lit(False)).schema)
