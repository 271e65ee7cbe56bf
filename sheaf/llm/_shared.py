"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOT: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables; the path is only ever opened by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset and Spark runs in a single local process (tests), one
    temporary folder per application; on a cluster that is an error, as
    executors couldn't read each other's tables.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOT:
        _LOCAL_ROOT[app] = tempfile.mkdtemp(prefix="sheaf-")
    return _LOCAL_ROOT[app]


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


class Scratch:
    """Written intermediate tables of one operator run.

    Writing cuts the lineage: a lost executor costs only the tasks of the
    current step, and a table that is read twice is computed once. ``drop``
    removes a table that nothing reads any more; what the returned plans still
    read goes when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/sheaf-{name}-{uuid.uuid4().hex}"
        fs, where = _file_system(spark, self.base)
        fs.mkdirs(where)
        fs.deleteOnExit(where)

    def path(self, tag: str) -> str:
        return f"{self.base}/{tag}"

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        """``df`` written as Parquet under ``tag`` and read again."""
        df.write.mode("overwrite").parquet(self.path(tag))
        return self.spark.read.schema(df.schema).parquet(self.path(tag))

    def drop(self, tag: str) -> None:
        """Remove a table that no later step reads."""
        fs, where = _file_system(self.spark, self.path(tag))
        fs.delete(where, True)


#: A key is hot if it has more than this part of a table's rows; there are fewer such keys than that.
HOT_PART = 1000


def spread_join(left: DataFrame, right: DataFrame, on: list[str], by: str, scratch: Scratch, how: str = "inner", counts: DataFrame | None = None, least: int = 1000) -> DataFrame:
    """``left.join(right, on, how)`` with the rows of hot keys dealt over several tasks by a hash of ``by``.

    ``right`` has one row per key; ``counts`` (keys, count) tells the rows of
    each key in ``left``, which is else a written table and counted here. Keys
    with more than ``least`` rows and a thousandth of all (fewer than a
    thousand keys, hence a small broadcast) get as many salts as they are
    times larger than a fair part; their rows in ``right`` are repeated for each.
    """
    if counts is None:
        counts = left.groupBy(*on).count()
        total = left.count()
    else:
        total = counts.agg(F.sum("count")).first()[0] or 0
    parts = max(8, min(1024, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    hot = counts.where((F.col("count") > least) & (F.col("count") > total / HOT_PART)).select(*on, F.ceil(F.col("count") * parts / max(total, 1)).cast("int").alias("_salts"))
    hot = scratch.keep(hot, f"hot_{uuid.uuid4().hex}")
    if hot.isEmpty():
        return left.join(right, on, how)
    one = left.join(F.broadcast(hot), on, "left").withColumn("_salt", F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(by), F.col("_salts")).cast("int")).otherwise(F.lit(0)))
    two = right.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
    return one.drop("_salts").join(two.drop("_salts"), [*on, "_salt"], how).drop("_salt")


_SHIPPED: set[tuple[str, str]] = set()


def ship(spark: SparkSession, blob: bytes, kind: str) -> str:
    """Send a file of bounded size to the executors, once; its name for ``SparkFiles.get``."""
    name = f"sheaf-{kind}-{hashlib.sha256(blob).hexdigest()[:24]}.bin"
    app = spark.sparkContext.applicationId
    if (app, name) not in _SHIPPED:
        folder = f"{scratch_root(spark)}/sheaf-files-{app}"
        fs, where = _file_system(spark, f"{folder}/{name}")
        fs.mkdirs(where.getParent())
        fs.deleteOnExit(where.getParent())
        out = fs.create(where, True)
        for at in range(0, len(blob), 1 << 22):
            out.write(bytearray(blob[at : at + (1 << 22)]))
        out.close()
        spark.sparkContext.addFile(str(fs.makeQualified(where).toString()))
        _SHIPPED.add((app, name))
    return name


_CACHES: list = []


def task_cache(cache):
    """``cache`` itself, cleared whenever a task ends."""
    _CACHES.append(cache)
    return cache


def give_back() -> None:
    """Forget caches; hand memory that Python, Arrow and the allocator hold for later back to the system."""
    for c in _CACHES:
        c.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def tidy(run: Callable) -> Callable:
    """``run`` over the batches of a task; what it used is given back at the task's end.

    Python workers outlive tasks, stages and queries, so whatever one keeps
    counts against the memory of all that follow.
    """

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """True for the rows whose labels no training may look at."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
