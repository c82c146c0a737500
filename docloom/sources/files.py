"""Folders as tables: listings, the order and pages of a walk, and what unreadable folders and files take with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import cut_lineage

ACCESS_DENIED, NOT_FOUND, NETWORK_ERROR = "ACCESS_DENIED", "NOT_FOUND", "NETWORK_ERROR"


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, modified) of every file below ``root``; paths are relative to it. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit(root), r"^[a-z]+:/*|/+$|^/+", "")
    whole = F.regexp_replace("path", r"^[a-z]+:/*", "")
    return files.select(F.substr(whole, F.length(base) + 2).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/", 1)


def walk_key(path: Column) -> Column:
    """Orders paths as a walk with a stack meets them: a folder's files by name, then its folders, the last name first.

    The bytes of each folder's name are turned round, with an end mark above all of them, so that falling order of names is rising order of keys.
    """
    names = F.filter(F.split(folder(path), "/"), lambda x: x != "")
    turned = F.array_join(F.transform(names, lambda x: F.concat(F.translate(F.hex(F.encode(x, "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))), "")
    return F.struct(turned.alias("folders"), F.regexp_extract(path, "([^/]*)$", 1).alias("name"))


def page(entries: DataFrame, size: int, after: str | None = None) -> DataFrame:
    """The next ``size`` entries of the walk behind the path ``after`` (None: from the start). The last row's path resumes it; fewer rows end it."""
    key = walk_key(F.col("path"))
    left = entries if after is None else entries.where(key > walk_key(F.lit(after)))
    return left.orderBy(key).limit(size)


def scanned(entries: DataFrame, failures: DataFrame) -> DataFrame:
    """(path, status): FOUND entries and the errors of a scan.

    ``entries``: path; ``failures``: path, is_folder, error (an exception's name). Nothing below a folder that failed
    is found, and no error below it is met. A folder's error is ACCESS_DENIED, NOT_FOUND or NETWORK_ERROR; a single
    entry that fails is left out with NETWORK_ERROR. Null paths are left out; repeated rows count once.
    """
    code = F.when(~F.col("is_folder"), NETWORK_ERROR).when(F.col("error") == "PermissionError", ACCESS_DENIED).when(F.col("error") == "FileNotFoundError", NOT_FOUND).otherwise(NETWORK_ERROR)
    failed = failures.where("path is not null").groupBy("path").agg(F.bool_or("is_folder").alias("is_folder"), F.min(code).alias("code"))
    both = entries.where("path is not null").select("path").distinct().join(failed, "path", "full").select("path", F.coalesce("code", F.lit("FOUND")).alias("status"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    under = both.select("path", F.explode(above).alias("folder")).join(failed.where("is_folder").select(F.col("path").alias("folder")), "folder", "left_semi")
    return both.join(under.where("path <> folder").select("path").distinct(), "path", "left_anti")


def json_records(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The records of JSON lines under a declared schema, and (line, file) of the lines that aren't JSON or hold a value of another type.

    The files are parsed once. Fields that a line lacks are null, further ones are ignored.
    """
    read = spark.read.schema(f"{schema}, __broken string").options(mode="PERMISSIVE", columnNameOfCorruptRecord="__broken").json(path)
    parsed = cut_lineage(read.select("*", F.col("_metadata.file_path").alias("__file")))
    bad = parsed.where("__broken IS NOT NULL").select(F.col("__broken").alias("line"), F.col("__file").alias("file"))
    return parsed.where("__broken IS NULL").drop("__broken", "__file"), bad
