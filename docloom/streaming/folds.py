"""Conversation summaries as a stateful stream, and a stream of answers that are checked before they are shown."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.streaming.frequencies import run_available

RECENT = 8


def summary_fold(messages: DataFrame, recent: int = RECENT) -> DataFrame:
    """(conv_id, folded, chars, cursor) as a stream: messages that left the recent window are folded in once each.

    ``messages``: conv_id, turn, text. A conversation's state is its recent window and the fold so far (how many
    messages, how many characters, the last turn folded); a message at or below the cursor isn't folded again.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        folded, chars, cursor, turns, sizes = state.get if state.exists else (0, 0, -1, [], [])
        held = dict(zip(turns, sizes))
        for batch in batches:
            for turn, text in zip(batch.turn, batch.text):
                if turn > cursor:
                    held[int(turn)] = len(text or "")
        for turn in sorted(held)[: max(0, len(held) - recent)]:
            folded, chars, cursor = folded + 1, chars + held.pop(turn), turn
        kept = sorted(held)
        state.update((folded, chars, cursor, kept, [held[t] for t in kept]))
        yield pd.DataFrame({"conv_id": [key[0]], "folded": [folded], "chars": [chars], "cursor": [cursor]})

    shape = "conv_id long, folded long, chars long, cursor long"
    state = "folded long, chars long, cursor long, turns array<long>, sizes array<long>"
    return messages.groupBy("conv_id").applyInPandasWithState(fold, shape, state, "update", "NoTimeout")


def run_updates(spark: SparkSession, updates: DataFrame, out: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Runs a stream of updates over all that is there; each batch writes its own part, and the last update of a key counts."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = updates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    parts = spark.read.parquet(out)
    names = [c for c in parts.columns if c not in (*keys, "batch")]
    return parts.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch").alias("x")).select(*keys, "x.*")


def checked_stream(answers: DataFrame, check, out: str, checkpoint: str) -> None:
    """Answers are buffered by micro-batch, checked and redacted by ``check``, and only then written, word by word in order."""

    def write(batch: DataFrame, number: int) -> None:
        words = check(batch).select("conv_id", "turn", F.posexplode(F.split("safe", " ")).alias("at", "word"))
        words.write.mode("overwrite").parquet(f"{out}/batch={number}")

    answers.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


__all__ = ["checked_stream", "run_available", "run_updates", "summary_fold"]
