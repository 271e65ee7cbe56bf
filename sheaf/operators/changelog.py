"""Operators over a change log: latest versions, live rows, indexes, constraints.

A change log has one row per version of a record. Which version counts is
found by hash aggregation of numbers alone, partly before its shuffle; the rows
then meet that by the record key, so wide rows are shuffled once and sorted
never but for the join. Filters on the key reach the scan, filters on values
can't and stay above the aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import py_str


def latest(log: DataFrame, key: str, seq: str, columns: list[str] | None = None, first: str = "first_seq") -> DataFrame:
    """The last version of each record with the place where the record first appeared; ``seq`` is unique among a record's versions."""
    columns = [c for c in (columns or log.columns) if c not in (key, first)]
    ends = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(seq).alias("_last"), F.min(seq).alias("_first_seq"))
    return log.select(key, *dict.fromkeys([*columns, seq])).join(ends, key).where(F.col(seq) == F.col("_last")).select(key, *columns, F.col("_first_seq").alias(first))


def live(log: DataFrame, key: str, seq: str, deleted: Column, columns: list[str] | None = None) -> DataFrame:
    """``latest`` without the records whose last version satisfies ``deleted``."""
    return latest(log, key, seq, columns).where(~F.coalesce(deleted, F.lit(False)))


def pending(log: DataFrame, owner: str, seq: str, is_checkpoint: Column) -> DataFrame:
    """Entries after the last checkpoint of their owner."""
    marks = log.where(is_checkpoint & F.col(owner).isNotNull()).groupBy(F.col(owner).alias("_owner")).agg(F.max(seq).alias("_mark"))
    met = log.join(marks, F.col(owner) == F.col("_owner"), "left").where(F.col("_mark").isNull() | (F.col(seq) > F.col("_mark")))
    return met.select(*[log[f"`{c}`"] for c in log.columns])


def field_index(frame: DataFrame, field: str, key: str) -> DataFrame:
    """(value, ids): the keys of each ``str(value)`` of a column, sorted."""
    value = py_str(F.col(field), frame.schema[field].dataType)
    return frame.groupBy(value.alias("value")).agg(F.sort_array(F.collect_list(key)).alias("ids"))


def index_rows(frame: DataFrame, field: str, key: str) -> DataFrame:
    """(value, key): a row for each key and the ``str(value)`` of a column, near each other by value; no array grows with the table."""
    value = py_str(F.col(field), frame.schema[field].dataType)
    return frame.select(value.alias("value"), key).repartitionByRange("value", key).sortWithinPartitions("value", key)


def unique_violations(frame: DataFrame, field: str) -> DataFrame:
    """(field, n): values that more than one row has."""
    return frame.where(F.col(field).isNotNull()).groupBy(field).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def patch(frame: DataFrame, where: Column, **values) -> DataFrame:
    """``frame`` with the columns in ``values`` replaced in the rows that satisfy ``where``."""
    hit = F.coalesce(where, F.lit(False))
    return frame.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def without(frame: DataFrame, key: str, ids: list) -> DataFrame:
    """``frame`` without the rows of these keys."""
    return frame.where(~F.coalesce(F.col(key).isin(list(ids)), F.lit(False)))


def stats(frame: DataFrame, key: str) -> DataFrame:
    return frame.agg(F.count(F.lit(1)).alias("record_count"), F.max(key).alias("last_id"))
