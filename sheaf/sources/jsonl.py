"""JSON-lines change logs: one version of a record per line, later lines win."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "_id long, _created long, _updated long, _deleted boolean"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of the files at ``path``, numbered from 1 on through all files, which follow each other by name.

    Files are read in splits, whatever their size. A split's place is known
    from the counts of those before it: one number a split goes through a
    window.
    """
    raw = (
        spark.read.option("lineSep", "\n").text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.regexp_replace("value", "\r$", "").alias("value"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    splits = raw.groupBy("file", "at").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("start"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return raw.join(splits.select("file", "at", "start", ahead.alias("ahead")), ["file", "at"]).select((F.col("ahead") + F.col("row") - F.col("start") + 1).alias("line"), "value")


def read_log(spark: SparkSession, path: str, warn: bool = True) -> DataFrame:
    """(_seq, _id, _created, _updated, _deleted, doc) of every readable version.

    Blank lines are skipped; so are lines that aren't JSON objects, with a
    RuntimeWarning that says how many there were. ``doc`` is VARIANT without
    the metadata keys' meaning taken away from it.
    """
    lines = read_lines(spark, path).where(F.trim("value") != "")
    parsed = lines.withColumn("doc", F.try_parse_json("value"))
    is_object = F.coalesce(F.schema_of_variant("doc").startswith("OBJECT"), F.lit(False))
    if warn and (bad := parsed.where(~is_object).count()):
        warnings.warn(f"{bad} damaged lines skipped in {path}", RuntimeWarning, stacklevel=2)
    get = lambda name, kind: F.try_variant_get("doc", f"$.{name}", kind)
    return parsed.where(is_object).select(
        F.col("line").alias("_seq"), get("_id", "bigint").alias("_id"), get("_created", "bigint").alias("_created"), get("_updated", "bigint").alias("_updated"),
        F.coalesce(get("_deleted", "boolean"), F.lit(False)).alias("_deleted"), "doc",
    )


def line_count(spark: SparkSession, path: str) -> int:
    return read_log(spark, path, warn=False).count()


def write_log(records: DataFrame, path: str) -> None:
    """Write a column ``value`` of JSON objects as lines."""
    records.select("value").write.mode("errorifexists").text(path)
