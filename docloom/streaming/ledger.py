"""Reservations as keyed state: reserved, then settled, released or, after half an hour, given back.

``histories`` keeps each entry's events as the keyed state of a native streaming aggregation, and ``told`` folds them in order of
time; what is due by the clock of event time is given back when the moves are read. ``transitions`` is for streams that
stay up: a timer tells a release when it falls due, at the price of a call to Python for each entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STALE_SECONDS = 1800
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "entry_id long, owner long, amount long, status string, reason string, seq long"


class Reservations(StatefulProcessor):
    """One entry's state: (owner, amount, created in ms, status, how many transitions). Only RESERVED moves on; all else is ignored."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "owner long, amount long, created long, status string, seq long")

    def _told(self, key: int, held: tuple, reason: str) -> dict:
        return {"entry_id": key, "owner": held[0], "amount": held[1], "status": held[3], "reason": reason, "seq": held[4]}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.entry.get() if self.entry.exists() else None
        began, out = held, []
        for row in pd.concat(list(rows)).sort_values(["at", "rank"], kind="stable").itertuples():
            at = int(row.at.timestamp() * 1000)
            if held is not None and held[3] == "RESERVED" and at > held[2] + STALE_SECONDS * 1000:
                held = (*held[:3], "RELEASED", held[4] + 1)
                out.append(self._told(key[0], held, "STALE"))
            if row.event == "RESERVE" and held is None:
                held = (int(row.owner), int(row.amount), at, "RESERVED", 1)
            elif row.event in ("SETTLE", "RELEASE") and held is not None and held[3] == "RESERVED":
                held = (*held[:3], "SETTLED" if row.event == "SETTLE" else "RELEASED", held[4] + 1)
            else:
                continue
            out.append(self._told(key[0], held, row.event))
        if held is not None and held != began:
            self.entry.update(held)
            if held[3] == "RESERVED":
                self.handle.registerTimer(held[2] + STALE_SECONDS * 1000)
        yield pd.DataFrame(out, columns=["entry_id", "owner", "amount", "status", "reason", "seq"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.entry.get() if self.entry.exists() else None
        if held is not None and held[3] == "RESERVED":
            held = (*held[:3], "RELEASED", held[4] + 1)
            self.entry.update(held)
            yield pd.DataFrame([self._told(key[0], held, "STALE")])

    def close(self) -> None:
        pass


def transitions(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(entry_id, owner, amount, status, reason, seq) of every transition, as a stream.

    ``events``: entry_id, owner, event (RESERVE, SETTLE, RELEASE), amount, at. Events up to ``late`` behind are taken. An entry that is
    reserved for longer than ``STALE_SECONDS`` of event time is released, by a timer or by its own next event, whichever comes first;
    so the batches in which events come don't matter. Null entry ids are left out.
    """
    rank = F.when(F.col("event") == "RESERVE", 0).otherwise(1)
    keyed = events.where("entry_id IS NOT NULL").withColumn("rank", rank).withWatermark("at", late).groupBy("entry_id")
    return keyed.transformWithStateInPandas(Reservations(), _OUT, "Append", "EventTime")


def balances(moves: DataFrame) -> DataFrame:
    """(owner, reserved, spent, released, stale) by each entry's last transition; ``moves`` is what ``transitions`` gave so far."""
    last = moves.groupBy("entry_id").agg(F.max_by(F.struct("owner", "amount", "status", "reason"), "seq").alias("x")).select("x.*")
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("amount"))), F.lit(0))
    status = F.col("status")
    return last.groupBy("owner").agg(total(status == "RESERVED").alias("reserved"), total(status == "SETTLED").alias("spent"), total(status == "RELEASED").alias("released"), F.count_if(F.col("reason") == "STALE").alias("stale"))


def histories(events: DataFrame) -> DataFrame:
    """(entry_id, events) as a stream of updates: all events of each entry that a batch touches. ``events`` and null ids as in ``transitions``."""
    rank = F.when(F.col("event") == "RESERVE", 0).otherwise(1)
    return events.where("entry_id IS NOT NULL").groupBy("entry_id").agg(F.collect_list(F.struct("at", rank.alias("rank"), "event", "owner", "amount")).alias("events"))


def told(held: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(entry_id, owner, amount, status, reason, seq) of every transition in the histories ``held`` (entry_id, events, batch), of which an entry's last counts.

    Events are taken in order of time, a reservation before what ends it and then by name, so neither batches nor their order matter. The
    clock is the latest event of all, less ``late``; a reservation open for longer than ``STALE_SECONDS`` by then is released.
    """
    stale = F.expr(f"INTERVAL {STALE_SECONDS} SECONDS")
    kinds = "owner long, amount long, status string, reason string, seq long"
    clock = held.agg(F.max(F.array_max(F.transform("events", lambda x: x["at"]))).alias("clock")).select((F.col("clock") - F.expr(f"INTERVAL {late}")).alias("clock"))
    last = held.groupBy("entry_id").agg(F.max_by("events", "batch").alias("events")).join(F.broadcast(clock))
    none = F.array().cast(f"array<struct<{kinds.replace(' ', ':').replace(',:', ',')}>>")
    begin = F.struct(*(F.lit(None).cast(t).alias(c) for c, t in (("owner", "long"), ("amount", "long"), ("created", "timestamp"), ("status", "string"))), F.lit(0).cast("long").alias("seq"), none.alias("moves"))

    def move(owner: Column, amount: Column, status: Column | str, reason: Column | str, seq: Column) -> Column:
        named = {"owner": owner, "amount": amount, "status": status, "reason": reason, "seq": seq}
        return F.array(F.struct(*((F.lit(x) if isinstance(x, str) else x).alias(c) for c, x in named.items())))

    def due(s: Column, at: Column) -> Column:
        return F.coalesce((s["status"] == "RESERVED") & (at > s["created"] + stale), F.lit(False))

    def given_back(s: Column, at: Column) -> Column:
        seq = s["seq"] + 1
        moves = F.concat(s["moves"], move(s["owner"], s["amount"], "RELEASED", "STALE", seq))
        back = F.struct(s["owner"].alias("owner"), s["amount"].alias("amount"), s["created"].alias("created"), F.lit("RELEASED").alias("status"), seq.alias("seq"), moves.alias("moves"))
        return F.when(due(s, at), back).otherwise(s)

    def moved(s: Column, x: Column) -> Column:
        opens = (x["event"] == "RESERVE") & s["status"].isNull()
        ends = x["event"].isin("SETTLE", "RELEASE") & F.coalesce(s["status"] == "RESERVED", F.lit(False))
        owner, amount, created = (F.when(opens, x[new].cast(t)).otherwise(s[c]) for new, c, t in (("owner", "owner", "long"), ("amount", "amount", "long"), ("at", "created", "timestamp")))
        status = F.when(opens, "RESERVED").when(x["event"] == "SETTLE", "SETTLED").otherwise("RELEASED")
        seq = s["seq"] + 1
        moves = F.concat(s["moves"], move(owner, amount, status, x["event"], seq))
        onward = F.struct(owner.alias("owner"), amount.alias("amount"), created.alias("created"), status.alias("status"), seq.alias("seq"), moves.alias("moves"))
        return F.when(opens | ends, onward).otherwise(s)

    def once(value: Column, use) -> Column:
        return F.element_at(F.transform(F.array(value), use), 1)

    folded = F.aggregate(F.sort_array("events"), begin, lambda s, x: once(given_back(s, x["at"]), lambda b: moved(b, x)), lambda s: given_back(s, F.col("clock"))["moves"])
    return last.select("entry_id", F.inline(folded))


def run(spark: SparkSession, events: DataFrame, out: str, checkpoint: str, late: str = "0 seconds", timers: bool = False) -> DataFrame:
    """Every transition of all that is there so far, by ``histories`` or, with ``timers``, by ``transitions``; a later call with the same folders goes on from there."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKS)  # other streams keep theirs
    try:
        rows, mode = (transitions(events, late), "append") if timers else (histories(events), "update")
        rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    held = spark.read.parquet(out)
    return held.drop("batch") if timers else told(held, late)
