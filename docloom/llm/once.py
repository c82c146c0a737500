"""Columns that are computed once for each row, and tables that are computed once."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import ensure_checkpoint_dir


def computed(df: DataFrame, keep: list, columns: dict[str, Column]) -> DataFrame:
    """``keep`` and the new columns, by way of a generator of one row.

    A filter or join on a computed column is otherwise moved below the projection that computes it, with the
    whole expression written out at each use; nothing is moved through a generator's output.
    """
    row = F.struct(*(c.alias(name) for name, c in columns.items()))
    return df.select(*keep, F.inline(F.array(row)))


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: compressed and read by column, unlike a checkpoint."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
