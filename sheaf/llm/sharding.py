"""Proportional stratified interleaving: shards that all match the source mixture.

Rows of each source are put in a seeded random order; the row of rank r of n
gets the fractional rank (2r + 1) / 2n. In the order of the fractional ranks
every stretch holds every source in its share of the whole, so cutting that
order into equal stretches yields shards whose mixtures match the corpus.

All ranks are found without a global sort. Keys are digests, hence uniform, so
fixed key ranges ("bins") are of even size whatever the source sizes; ranks
are the row number in a bin plus the sizes of the bins before it. A source
that holds a third of all rows spreads over a third of all (source, bin)
groups. The fractional ranks are uniform too, so the second order works alike.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.llm._shared import Scratch, table

ROWS_PER_BIN = 20_000


def interleave(
    docs: DataFrame,
    n_shards: int = 40,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    rows_per_bin: int = ROWS_PER_BIN,
) -> DataFrame:
    """Shard and slot of every row: (id, size, text_crc32, source, shard, slot).

    Row counts of any two shards differ by one at most; slots are gapless
    from 0 in each shard. Nulls: a null text has size 16 and the CRC of the
    empty text; a null source is a source of its own; null ids are sorted by
    their text's CRC. Repeated rows each get their own slot; rows that agree
    in id and text may swap places, which no output column shows. An empty
    table gives no rows. Other columns of ``docs`` are not read.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.col(source_col).cast("string").alias("source"),
    ).withColumn(
        "k", F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string")).cast("binary"))
    )
    keyed = scratch.keep(keyed, "keyed")
    total = keyed.count()
    bins = max(1, math.ceil(total / rows_per_bin))

    # rank of each row within its source
    keyed = keyed.withColumn("bin", F.floor(F.conv(F.substring("k", 1, 8), 16, 10).cast("long") * bins / F.lit(2.0**32)).cast("long"))
    by_source = Window.partitionBy("source")
    before = (
        keyed.groupBy("source", "bin").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("ahead", F.sum("n").over(by_source.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)))
        .select(F.col("source").alias("s"), F.col("bin").alias("b"), F.coalesce("ahead", F.lit(0)).alias("ahead"), F.sum("n").over(by_source).alias("of"))
    )
    within = Window.partitionBy("source", "bin").orderBy("k", "doc_id", "text_crc32", "size")
    ranked = (
        keyed.withColumn("row", F.row_number().over(within))
        .join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
        .withColumn("part", (2 * (F.col("ahead") + F.col("row") - 1) + 1) / (2 * F.col("of")))
        .select("doc_id", "size", "text_crc32", "source", "k", "part", F.least(F.floor(F.col("part") * bins), F.lit(bins - 1)).alias("bin"))
    )

    # place of each row among all, by fractional rank
    sizes = (
        ranked.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("bin").alias("b"), F.coalesce(F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    )
    placed = (
        ranked.withColumn("row", F.row_number().over(Window.partitionBy("bin").orderBy("part", "source", "k", "doc_id", "size")))
        .join(sizes, F.col("bin") == F.col("b"))
        .withColumn("place", F.col("ahead") + F.col("row") - 1)
    )
    shard = F.expr(f"(place * {n_shards}) div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {n_shards - 1}) div {n_shards}")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id", "size", "text_crc32", "source", "shard", (F.col("place") - first).cast("long").alias("slot")
    )


def op10_stratified_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 39 under the law of even row counts."""
    placed = interleave(table(spark, sf_dir, "documents"), 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


OP10_SQL = """
with bits as (select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as tab from range(256) r(i)),
raw as (select doc_id, source, coalesce(text, '') as text, hex(encode(coalesce(text, ''))) as x from documents),
sized as (
  select doc_id, source, (strlen(text) + 16)::bigint as size,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::int, 2))::bigint)),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) as text_crc32
  from raw, bits),
keyed as (select *, md5('17|' || coalesce(doc_id::varchar, '') || '|' || text_crc32) as k from sized),
parts as (
  select *, (2 * (row_number() over (partition by source order by k, doc_id nulls first, text_crc32, size) - 1) + 1) / (2 * count(*) over (partition by source)) as part
  from keyed),
placed as (select *, row_number() over (order by part, source nulls first, k, doc_id nulls first, size) - 1 as place, count(*) over () as total from parts),
sharded as (select *, (place * 40) // total as shard from placed)
select doc_id, size, text_crc32, 'rows' as law, shard::int as shard, (place - (shard * total + 39) // 40)::bigint as slot, null::int as grown_shard, source from sharded
"""
