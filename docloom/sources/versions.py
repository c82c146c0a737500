"""Audit rows of what changed between two states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def audit(before: DataFrame, after: DataFrame, keys: list[str], facts: list[str], action: str, entity_type: str) -> DataFrame:
    """(keys, action, entity_type, old_value, new_value) of entities that came, went or changed; values are JSON, null where there was no entity."""
    old = before.select(*keys, F.struct(*facts).alias("old"))
    new = after.select(*keys, F.struct(*facts).alias("new"))
    changed = old.join(new, keys, "full").where(~F.col("old").eqNullSafe(F.col("new")))
    return changed.select(*keys, F.lit(action).alias("action"), F.lit(entity_type).alias("entity_type"), F.to_json("old").alias("old_value"), F.to_json("new").alias("new_value"))
