"""Cross-site boilerplate lines, found by how many distinct sites carry them.

Each line's digest collects a HyperLogLog sketch of its sites; sketches merge
in the aggregation, partly before the shuffle, so a line that stands in a
third of all documents costs one small row per task. Lines whose estimate is
clearly above the threshold are boilerplate, clearly below they are not, and
only those near it get an exact count of their distinct sites. A boilerplate
line stays in the first document that has it (least id, then position) and is
removed everywhere else, so no content leaves the corpus as a whole.

DataFrame operations only. Texts are split once into a written table of
digests; those alone are shuffled to find the lines, and the texts at most
once, for the removal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm._shared import Scratch, spread_join, table

MIN_SITES = 3
MIN_WORDS = 4
#: log2 of the sketch's buckets; its relative standard error is 1.04 / sqrt(2**12) = 1.6 %.
LG_K = 12
#: Half the width of the band around the threshold that is counted exactly: six standard errors.
BAND = 0.1


def _lines(docs: DataFrame, text_col: str, source_col: str, id_col: str, min_words: int) -> DataFrame:
    """(doc, row, pos, h1, h2, site) of every line of ``min_words`` words or more."""
    line = F.btrim(F.col("line"), F.lit(" \t\r"))
    return (
        docs.select(
            F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("row"),
            F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("site"),
            F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("pos", "line"),
        )
        .withColumn("line", line)
        .where(F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) >= min_words - 1)
        .where(F.col("line") != "")
        .select("doc", "row", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "site")
    )


def boilerplate(lines: DataFrame, min_sites: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(h1, h2, first) of the lines on ``min_sites`` distinct sites or more, first being the (doc, row, pos) that keeps it; places and counts of all lines that come into question.

    Lines that stand in fewer than ``min_sites`` places, or on one site only,
    cannot get there; plain counts sort them out before any sketch is built.
    Joins deal the places of a hot line over several tasks.
    """
    mark = F.xxhash64("site")
    often = scratch.keep(
        lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("count"), F.min(mark).alias("lo"), F.max(mark).alias("hi"))
        .where((F.col("count") >= min_sites) & (F.col("lo") != F.col("hi"))).select("h1", "h2", "count"), "often"
    )
    some = scratch.keep(spread_join(lines, often.select("h1", "h2"), ["h1", "h2"], "doc", scratch, "left_semi", often), "some")
    spread = (
        some.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min(F.struct("doc", "row", "pos")).alias("first"))
        .select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites"))
        .where(F.col("sites") >= min_sites * (1 - BAND))
    )
    spread = scratch.keep(spread, "spread")
    near = spread.where(F.col("sites") < min_sites * (1 + BAND))
    exact = (
        spread_join(some, near.select("h1", "h2"), ["h1", "h2"], "doc", scratch, "left_semi", often)
        .groupBy("h1", "h2", "site").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("sites"))
        .where(F.col("sites") >= min_sites)
    )
    clear = spread.where(F.col("sites") >= min_sites * (1 + BAND))
    found = clear.select("h1", "h2", "first").union(near.join(exact.select("h1", "h2"), ["h1", "h2"]).select("h1", "h2", "first"))
    return scratch.keep(found, "found"), some, often


def _without(text: Column, gone: Column) -> Column:
    """``text`` without the lines at the positions in ``gone``; linear in both."""
    lines = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", removed_col: str | None = None) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text_col``; all rows and columns stay.

    Lines compare without blanks, tabs and returns at their ends, and words
    are counted by blanks. Null and empty texts
    stay as they are; a null source counts as one site; rows repeated whole
    count as one, so they keep the same lines; a text all of whose lines go
    becomes empty. ``removed_col`` names an extra column for the number of
    lines removed. An empty table gives an empty table.
    """
    if min_sites < 2:
        raise ValueError("min_sites must be 2 or more")
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.keep(_lines(docs, text_col, source_col, id_col, min_words), "lines")
    found, some, often = boilerplate(lines, min_sites, scratch)
    scratch.drop("lines")
    gone = (
        scratch.keep(spread_join(some, found, ["h1", "h2"], "doc", scratch, counts=often), "places")
        .where(~F.struct("doc", "row", "pos").eqNullSafe(F.col("first")))
        .groupBy("doc", "row").agg(F.collect_set("pos").alias("gone"))
        .select(F.col("doc").alias("_sheaf_doc"), F.col("row").alias("_sheaf_row"), F.col("gone").alias("_sheaf_gone"))
    )
    text = docs[f"`{text_col}`"]
    both = docs.join(gone, docs[f"`{id_col}`"].eqNullSafe(F.col("_sheaf_doc")) & (F.xxhash64(text) == F.col("_sheaf_row")), "left")
    new = F.when(F.col("_sheaf_gone").isNull(), text).otherwise(_without(text, F.col("_sheaf_gone")))
    cols = [new.alias(text_col) if c == text_col else docs[f"`{c}`"] for c in docs.columns]
    if removed_col:
        cols.append(F.coalesce(F.size("_sheaf_gone"), F.lit(0)).alias(removed_col))
    return both.select(*cols)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without cross-site boilerplate lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return remove_boilerplate(docs, removed_col="n_removed").select("doc_id", "text", "source", F.col("n_removed").cast("long").alias("n_removed"))


def line_sql(docs: str = "documents", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> str:
    """Body of DuckDB CTEs that end in ``cleaned(doc_id, text, n_removed)``, for tables of unique ids."""
    return f"""
split_lines as (select doc_id, source, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as pos from {docs}),
numbered as (select *, trim(raw, ' ' || chr(9) || chr(13)) as line from split_lines),
counted as (select *, len(string_split(line, ' ')) >= {min_words} and line <> '' as big from numbered),
spread as (select line, count(distinct coalesce('=' || source, '')) as sites, min(struct_pack(d := doc_id, p := pos)) as first from counted where big group by line),
marked as (select c.*, coalesce(s.sites >= {min_sites} and c.big and struct_pack(d := c.doc_id, p := c.pos) <> s.first, false) as gone from counted c left join spread s using (line)),
cleaned as (select doc_id, coalesce(string_agg(raw, chr(10) order by pos) filter (where not gone), '') as text, count(*) filter (where gone) as n_removed from marked group by doc_id)
"""


OP3_SQL = f"with {line_sql()} select c.doc_id, c.text, d.source, c.n_removed from cleaned c join documents d using (doc_id)"
