"""Change logs as streams: an extension, for jobs that follow a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.sources.store import LOG_SCHEMA, Collection


def changes(collection: Collection, max_files: int = 1000) -> DataFrame:
    """A stream of the versions written to a collection, at least once each.

    Files that a lost race or a compaction wrote may show too; ``_seq`` tells
    versions apart, so a sink that keeps the greatest ``_seq`` of each id has
    the collection's state.
    """
    source = collection.spark.readStream.schema(LOG_SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).option("pathGlobFilter", "*.parquet")
    rows = source.parquet(str(collection.path / "data"))
    return rows.withColumn("doc", collection._plain(F.col("doc")))
