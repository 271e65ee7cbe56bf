"""Near-duplicate embeddings by spherical k-means cells and blocked cosine products.

Equal vectors are one class from the start, so copies cost nothing. Centroids
are fitted on a bounded sample; every vector goes to its nearest centroid's
cell as a resident and, as a guest, to further cells in which a vector at the
link cosine might be a resident: all whose border with its own it can reach by
a step of that angle, so no pair is missed. A guest only visits cells of a
lower number than its own, so no pair is met twice. A few cells travel
together, as a vector is then shipped once for all of them. They are cut into
parts of bounded size; a task takes two, multiplies them in double precision
block by block, counts links per row and reports one edge per row and block to
the least member of its local group, so its output is linear however dense the
links are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm._shared import Scratch, spread_join, table, tidy
from sheaf.llm.components import components, least_labels

BLOCK = 1024
#: Neighbouring numbers of cells that are placed as one, and blocks on a side of a task.
TOGETHER = 4
#: Numbers in a table of rows by cells.
NUMBERS_AT_ONCE = 1_000_000


def fit_centroids(x: np.ndarray, k: int, seed: int = 3, rounds: int = 12) -> np.ndarray:
    """Unit centroids of spherical k-means over unit rows ``x``."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        home = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        size = np.linalg.norm(sums, axis=1)
        c = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], c)
    return c


def unit_rows(raw: list[bytes], dtype: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1).astype(np.float64)
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(scale > 0, scale, 1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cells_of(x: np.ndarray, c: np.ndarray, cosine: float, margin: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home cell of each row, and (row, cell) of its visits as a guest.

    A border is the plane where two centroids score alike; a vector's angle to
    it has the sine lead / gap. ``margin`` narrows the visits to what a random
    step of so many standard deviations reaches, and loses pairs.
    """
    s = x @ c.T
    home = np.argmax(s, axis=1)
    dots = c @ c.T
    gap = np.sqrt(np.maximum(2 - 2 * dots[home], 0))  # distance of each centroid from the home one
    lead = s[np.arange(len(x)), home][:, None] - s
    step = math.sqrt(max(0.0, 1 - cosine * cosine)) if cosine > 0 else 1.0
    visit = (lead <= step * gap + 1e-6) & (np.arange(len(c))[None, :] < home[:, None])
    if margin is not None:
        visit &= cosine * lead <= margin * step * gap / math.sqrt(max(1, x.shape[1] - 1))
    return home, *np.nonzero(visit)


def _vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, dim, raw, h1, h2) of the rows whose vector can link."""
    v = F.col(vec_col).cast("array<double>")
    ok = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    v = F.transform(v, lambda x: x + F.lit(0.0))  # -0.0 is 0.0
    return df.where(ok).select(F.col(id_col).cast("long").alias("id"), F.size(vec_col).alias("dim"), v.alias("v"), F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), v).alias("h2"))


def _pack(rows: DataFrame, dtype: str) -> DataFrame:
    """Column ``v`` as the bytes of its numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(v=[np.asarray(v, dtype).tobytes() for v in pdf["v"]])

    return rows.mapInPandas(tidy(run), ", ".join(f"{f.name} {'binary' if f.name == 'v' else f.dataType.simpleString()}" for f in rows.schema))


def _block_links(rows: np.ndarray, cols: np.ndarray, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    hit = rows @ cols.T >= cosine
    if same:
        np.fill_diagonal(hit, False)
    return np.nonzero(hit)


def _block_edges(one: tuple[np.ndarray, np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray, np.ndarray], same: bool, cosine: float) -> pd.DataFrame:
    """(id, links, root) of the rows of two blocks (vectors, ids, copies) that link."""
    a, b = _block_links(one[0], two[0], same, cosine)
    ids = one[1] if same else np.r_[one[1], two[1]]
    n = one[2] if same else np.r_[one[2], two[2]]
    b = b if same else b + len(one[1])
    links = np.bincount(a, n[b], len(ids))
    if not same:
        links = links + np.bincount(b, n[a], len(ids))
    hit = np.nonzero(links)[0]
    order = np.argsort(ids, kind="stable")  # so that the least place is the least id
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    root = ids[order][least_labels(len(ids), rank[a], rank[b])[rank]]
    return pd.DataFrame({"id": ids[hit], "links": links[hit].astype(np.int64), "root": root[hit]})


def link_vectors(
    df: DataFrame,
    cosine: float = 0.9,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    rows_per_cell: int = 512,
    max_cells: int = 4096,
    max_sample_numbers: int = 4_000_000,
    margin: float | None = None,
    seed: int = 3,
) -> DataFrame:
    """One row per row of ``df``: (vec_id, n_links, component_id, kept).

    Vectors that are null, empty, zero or hold a null or non-finite component
    link with nothing, and vectors of different lengths don't link with each
    other. Rows with a null id have no links and no component and aren't kept.
    Repeated rows link with each other. An empty table gives no rows. A
    ``margin`` saves work and loses links, see ``cells_of``.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "vectors")
    single = df.schema[vec_col].dataType.elementType.simpleString() == "float"
    dtype = "<f4" if single else "<f8"
    rows = _vectors(df, id_col, vec_col)
    classes = rows.groupBy("dim", "h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    classes = scratch.keep(_pack(classes.select("id", "n", "dim", "v", "h1", "h2"), dtype), "classes")
    parts = []
    for dim, count in sorted((r["dim"], r["count"]) for r in classes.groupBy("dim").count().collect()):
        own = classes.where(F.col("dim") == dim)
        at_most = max(1, max_sample_numbers // dim)
        sample = unit_rows([bytes(r[0]) for r in own.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(at_most).select("v").collect()], dtype)
        centroids = fit_centroids(sample, min(max_cells, max(1, count // rows_per_cell)), seed)
        parts.append(_links(own.select("id", "n", "v"), centroids, cosine, margin, dtype, scratch, dim))
    ids = df.select(F.col(id_col).cast("long").alias("vec_id"))
    if not parts:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    links = parts[0]
    for p in parts[1:]:
        links = links.union(p)
    links = scratch.keep(links, "links")
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(links.select(F.col("id").alias("u"), F.col("root").alias("v")), scratch)
    by_class = (
        classes.select("id", "n", "h1", "h2").join(counts, "id", "left").join(groups, F.col("id") == F.col("node"), "left")
        .select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    linked = spread_join(rows.select("id", "h1", "h2"), by_class, ["h1", "h2"], "id", scratch, counts=classes.select("h1", "h2", F.col("n").alias("count"))).select(F.col("id").alias("k"), "n_links", "component_id")
    linked = linked.groupBy("k").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return ids.join(linked, F.col("vec_id") == F.col("k"), "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )


def _links(rows: DataFrame, centroids: np.ndarray, cosine: float, margin: float | None, dtype: str, scratch: Scratch, dim: int) -> DataFrame:
    """(id, links, root) per row and block pair with links: how many (copies counted), and a member of its group."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(centroids)  # max_cells rows at most

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        rows_at_once = max(1, NUMBERS_AT_ONCE // len(c))
        for batch in batches:
            for k in range(0, len(batch), rows_at_once):
                pdf = batch.iloc[k : k + rows_at_once]
                home, row, cell = cells_of(unit_rows(pdf["v"].tolist(), dtype), c, cosine, margin)
                home, cell = home // TOGETHER, cell // TOGETHER
                row, cell = np.unique(np.c_[row, cell][cell < home[row]], axis=0).T
                at = np.r_[np.arange(len(pdf)), row]
                yield pd.DataFrame({"cell": np.r_[home, cell].astype(np.int64), "guest": np.r_[np.zeros(len(pdf), bool), np.ones(len(row), bool)], "id": pdf["id"].to_numpy()[at], "n": pdf["n"].to_numpy()[at], "v": pdf["v"].to_numpy()[at]})

    placed = scratch.keep(rows.mapInPandas(tidy(place), "cell long, guest boolean, id long, n long, v binary"), f"placed{dim}")
    shared.destroy()
    sizes = (
        placed.groupBy("cell").agg(F.sum((~F.col("guest")).cast("int")).alias("own"), F.sum(F.col("guest").cast("int")).alias("guests"))
        .select("cell", F.ceil(F.col("own") / (TOGETHER * BLOCK)).cast("int").alias("nb"), F.ceil(F.col("guests") / (TOGETHER * BLOCK)).cast("int").alias("ng"))
        .where("nb > 0")
    )
    part = F.pmod(F.xxhash64("id"), F.when(F.col("guest"), F.col("ng")).otherwise(F.col("nb"))).cast("int")
    # a pair of parts is (i, j) with i <= j among the residents, or (i, nb + g) with a part of guests
    pairs = F.when(F.col("guest"), F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda i: F.struct(i.alias("i"), (F.col("nb") + F.col("part")).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("nb") + F.col("ng") - 1), lambda j: F.struct(F.least(F.col("part"), j).alias("i"), F.greatest(F.col("part"), j).alias("j")))
    )
    tasks = (
        placed.join(F.broadcast(sizes), "cell").withColumn("part", part).withColumn("pair", F.explode(pairs))
        .select("cell", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), (F.col("guest") | (F.col("part") != F.col("pair.i"))).alias("second"), "id", "n", "v")
    )

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        one, two = pdf[~pdf["second"]], pdf[pdf["second"]]
        same = i == j
        if same:
            two = one
        if not len(one) or not len(two):
            return pd.DataFrame({"id": [], "links": [], "root": []}).astype("int64")
        x, y = unit_rows(one["v"].tolist(), dtype), unit_rows(two["v"].tolist(), dtype)
        rows = [(x[k : k + BLOCK], one["id"].to_numpy()[k : k + BLOCK], one["n"].to_numpy()[k : k + BLOCK]) for k in range(0, len(one), BLOCK)]
        cols = rows if same else [(y[k : k + BLOCK], two["id"].to_numpy()[k : k + BLOCK], two["n"].to_numpy()[k : k + BLOCK]) for k in range(0, len(two), BLOCK)]
        return pd.concat([_block_edges(r, c, same and k == m, cosine) for k, r in enumerate(rows) for m, c in enumerate(cols) if not same or k <= m])

    return tasks.groupBy("cell", "i", "j").applyInPandas(multiply, "id long, links long, root long")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings: links at cosine 0.9 and the components they form."""
    return link_vectors(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
pairs as (select a.vec_id as x, b.vec_id as y from v a, v b where a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9),
reach(x, y) as (select vec_id, vec_id from v union select r.x, p.y from reach r join pairs p on r.y = p.x),
least as (select x, min(y) as component_id from reach group by x)
select v.vec_id, (select count(*) from pairs where x = v.vec_id) as n_links, component_id, v.vec_id = component_id as kept
from v join least on v.vec_id = least.x
"""
