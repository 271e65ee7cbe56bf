"""Stores of named collections, kept as change logs of Parquet files.

Layout of a store: ``meta.json`` (registry, encryption), and per collection
``data/`` (log files) and ``log/`` (manifests, see ``manifest``). A log row is
one version of a record: ``_id, _seq, _created, _updated, _deleted, _first,
doc``, with the document as JSON text (base64 cipher text in encrypted
stores). ``_first`` is set where compaction moved a record; it keeps the place
of its first appearance.

Writers validate against a snapshot, write data, and publish a manifest; a
writer that lost the race takes the new snapshot and tries again until the
lock timeout. Single-record commits are written by the driver, bulk ones by
the executors.
"""

from __future__ import annotations

import json
import shutil
import threading
import time
import uuid
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.errors import DuplicateIndexError, EncryptionError, LockTimeoutError, RecordNotFoundError, SchemaValidationError, SheafError, TransactionError
from sheaf.functions.scalars import check_name, encode_line, is_valid_name, now_ts, public_view
from sheaf.operators import changelog
from sheaf.operators.schema import Schema
from sheaf.plans.predicates import VariantField
from sheaf.plans.query import DocumentQuery
from sheaf.sources import jsonl
from sheaf.sources.cache import LRUCache
from sheaf.sources.crypto import Cipher
from sheaf.sources.manifest import CommitLog, DataFile, Manifest, following, write_text

LOG_SCHEMA = "_id long, _seq long, _created long, _updated long, _deleted boolean, _first long, doc string"
_ARROW = pa.schema([("_id", pa.int64()), ("_seq", pa.int64()), ("_created", pa.int64()), ("_updated", pa.int64()), ("_deleted", pa.bool_()), ("_first", pa.int64()), ("doc", pa.string())])
CACHE_SIZE, LOCK_TIMEOUT = 1024, 10.0
#: From so many ids on a batch fetches its records by one Spark job.
MANY = 20
#: Seconds for which files that no version has may belong to a writer that hasn't published yet.
RETENTION = 24 * 3600.0


def py_str_value(value) -> str:
    """The key of a value in indexes and unique constraints."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")) if isinstance(value, (list, dict, tuple)) else str(value)


def _session(spark: SparkSession | None) -> SparkSession:
    return spark or SparkSession.getActiveSession() or SparkSession.builder.appName("sheaf").getOrCreate()


class Transaction:
    """Buffered changes of one collection that take effect together or not at all."""

    def __init__(self, collection: Collection):
        self._collection, self._ops, self._state = collection, [], "open"

    def _check(self) -> None:
        if self._state != "open":
            raise TransactionError(f"the transaction is {self._state}")

    def create(self, **fields) -> dict:
        """Validated and numbered now, written at commit. The preview has no ``id``."""
        self._check()
        record = self._collection._prepared(fields)
        rid = self._collection._reserve(1)
        self._ops.append(("create", rid, record))
        return dict(record)

    def update(self, record_id: int, **fields) -> None:
        self._check()
        self._ops.append(("update", record_id, fields))

    def delete(self, record_id: int) -> None:
        self._check()
        self._ops.append(("delete", record_id, None))

    def commit(self) -> None:
        self._check()
        try:
            self._collection._commit(self._ops)
        except BaseException:
            self._state = "rolled back"
            raise
        self._state = "committed"

    def rollback(self) -> None:
        self._check()
        self._ops, self._state = [], "rolled back"

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if self._state == "open":
            self.commit() if kind is None else self.rollback()


class Collection:
    def __init__(self, store: Store, name: str, schema: Schema | None = None, unique_fields=(), cache_size: int = CACHE_SIZE):
        self._store, self._name, self._schema = store, name, schema
        self._unique = frozenset(unique_fields or ())
        self._folder = store.path / name
        self._log = CommitLog(self._folder / "log")
        (self._folder / "data").mkdir(parents=True, exist_ok=True)
        self._cache, self._cached_at = LRUCache(cache_size), 0
        self._lock = threading.RLock()

    # properties

    @property
    def name(self) -> str:
        return self._name

    @property
    def schema(self) -> Schema | None:
        return self._schema

    @property
    def unique_fields(self) -> set[str]:
        return set(self._unique)

    @property
    def path(self) -> Path:
        return self._folder

    @property
    def spark(self) -> SparkSession:
        return self._store.spark

    def __repr__(self) -> str:
        return f"<Collection {self._name!r}>"

    # reading

    def _read(self, manifest: Manifest) -> DataFrame:
        paths = [str(self._folder / "data" / f.path) for f in manifest.files]
        if not paths:
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.spark.read.schema(LOG_SCHEMA).parquet(*paths)

    def log(self, manifest: Manifest | None = None) -> DataFrame:
        """All versions of all records, as stored."""
        return self._read(manifest or self._log.latest())

    def _plain(self, doc: Column) -> Column:
        return self._store.cipher.decrypt_column(doc) if self._store.cipher else doc

    def latest(self, manifest: Manifest | None = None, ids: list[int] | None = None) -> DataFrame:
        """Last version of every record, deleted ones too, with ``_first``."""
        log = self.log(manifest)
        if ids is not None:
            log = log.where(F.col("_id").isin(list(ids)))  # before the aggregate, so it reaches the scan
        return self._last_versions(log).select("_id", "_created", "_updated", "_deleted", "_first", "_seq", self._plain(F.col("doc")).alias("_json"))

    @staticmethod
    def _last_versions(log: DataFrame) -> DataFrame:
        """Each record's last version as stored, with the place of its first; numbers alone are aggregated."""
        ends = log.groupBy("_id").agg(F.max("_seq").alias("_last"), F.min(F.coalesce("_first", "_seq")).alias("_place"))
        return log.join(ends, "_id").where(F.col("_seq") == F.col("_last")).select("_id", "_seq", "_created", "_updated", "_deleted", F.col("_place").alias("_first"), "doc")

    def live(self, manifest: Manifest | None = None, ids: list[int] | None = None) -> DataFrame:
        return self.latest(manifest, ids).where(~F.col("_deleted"))

    def _documents(self, manifest: Manifest | None = None, ids: list[int] | None = None) -> DataFrame:
        return self.live(manifest, ids).withColumn("doc", F.parse_json("_json"))

    def to_df(self, schema: str | None = None) -> DataFrame:
        """Live records: (_id, _created, _updated, _deleted, doc VARIANT), or typed columns of ``schema``."""
        docs = self._documents()
        if schema is None:
            return docs.select("_id", "_created", "_updated", "_deleted", "doc")
        return docs.select("_id", F.from_json("_json", schema).alias("d")).select(F.col("_id").alias("id"), "d.*")

    def filter(self, **conditions) -> DocumentQuery:
        """A query over the records as they are now; later writes don't show in it."""
        return DocumentQuery(self._documents(self._log.latest())).filter(**conditions)

    def all(self) -> list[dict]:
        return self.filter().all()

    def sort(self, field: str, descending: bool = False) -> DocumentQuery:
        return self.filter().sort(field, descending)

    def count(self) -> int:
        return self.live().count()

    def exists(self, **conditions) -> bool:
        return self.filter(**conditions).exists()

    def _point(self, manifest: Manifest, record_id: int) -> dict | None:
        """One live record, read from the files whose id range has it."""
        best, first = None, None
        for f in manifest.files:
            if f.min_id <= record_id <= f.max_id:
                for row in pq.read_table(self._folder / "data" / f.path, schema=_ARROW, filters=pc.field("_id") == record_id).to_pylist():
                    first = min(x for x in (first, row["_first"], row["_seq"]) if x is not None)
                    if best is None or row["_seq"] > best["_seq"]:
                        best = row
        if best is None or best["_deleted"]:
            return None
        text = best.pop("doc")
        text = self._store.cipher.decrypt_str(text) if self._store.cipher else text
        return {**{k: best[k] for k in ("_id", "_created", "_updated", "_deleted")}, "_first": first, **json.loads(text)}

    def _live_record(self, manifest: Manifest, record_id: int) -> dict | None:
        with self._lock:
            if self._cached_at != manifest.version:
                self._cache.clear()
                self._cached_at = manifest.version
            found = self._cache.get(record_id)
            if found is None and (found := self._point(manifest, record_id)) is not None:
                self._cache.put(record_id, found)
            return found

    def _many(self, manifest: Manifest, ids: set[int]) -> dict[int, dict | None]:
        """Live records of ids, where there are enough to be worth one job; others are read one by one."""
        if len(ids) < MANY:
            return {}
        meta = ("_id", "_created", "_updated", "_deleted", "_first")
        rows = self.live(manifest, sorted(ids)).collect()
        return dict.fromkeys(ids) | {r["_id"]: {k: r[k] for k in meta} | json.loads(r["_json"]) for r in rows}

    def get(self, record_id: int | None = None, **field) -> dict:
        """The record of an id, or the first one (by its last write) with ``field=value``, compared as strings."""
        if record_id is not None and field:
            raise ValueError("an id or a field, not both")
        if record_id is None and len(field) != 1:
            raise ValueError("get takes an id or one field=value")
        manifest = self._log.latest()
        if record_id is not None:
            found = self._live_record(manifest, record_id)
            if found is None:
                raise RecordNotFoundError(record_id, self._name)
            found.pop("_first", None)
            return public_view(found)
        [(name, value)] = field.items()
        rows = self._holders(manifest, name, [value]).orderBy("_seq").limit(1).collect()
        if not rows:
            raise RecordNotFoundError(f"{name}={value!r}", self._name)
        return public_view({"_id": rows[0]["_id"], **json.loads(rows[0]["_json"])})

    # index-like lookups

    def _holders(self, manifest: Manifest, field: str, values: list) -> DataFrame:
        key = VariantField(F.col("doc"), field).pystr()
        return self._documents(manifest).withColumn("_key", key).where(F.col("_key").isin([py_str_value(v) for v in values]))

    def lookup(self, field: str, value) -> list[int]:
        """Ids of the live records with this value, in order of their last writes."""
        return [r[0] for r in self._holders(self._log.latest(), field, [value]).orderBy("_seq").select("_id").collect()]

    def lookup_in(self, field: str, values: list) -> list[int]:
        """Ids for several values, in the order of the values, each once."""
        place = {py_str_value(v): i for i, v in reversed(list(enumerate(values)))}
        rows = self._holders(self._log.latest(), field, list(values)).select("_id", "_key", "_seq").collect()
        return list(dict.fromkeys(r["_id"] for r in sorted(rows, key=lambda r: (place[r["_key"]], r["_seq"]))))

    def index_df(self) -> DataFrame:
        """(field, value, _id, _seq): a row for each field of each live record."""
        docs = self._documents()
        docs.createOrReplaceTempView(view := f"_sheaf_{uuid.uuid4().hex}")
        cells = self.spark.sql(f"select _id, _seq, e.key as field, e.value as v from {view}, lateral variant_explode(doc) e")
        value = VariantField(F.col("v"), None).pystr()
        return cells.where(~F.col("field").startswith("_")).select("field", value.alias("value"), "_id", "_seq")

    def check_unique(self, field: str, value, exclude_id: int | None = None) -> None:
        """DuplicateIndexError if another live record has this value."""
        if any(i != exclude_id for i in self.lookup(field, value)):
            raise DuplicateIndexError(field, value)

    def all_values(self, field: str) -> dict[str, list[int]]:
        """All values of one field with their ids, in order of last writes, on the driver."""
        out: dict[str, list[int]] = {}
        for r in self.index_df().where(F.col("field") == field).orderBy("_seq").select("value", "_id").toLocalIterator():
            out.setdefault(r["value"], []).append(r["_id"])
        return out

    def indexed_fields(self) -> list[str]:
        docs = self._documents()
        keys = docs.select(F.explode(F.map_keys(F.col("doc").cast("map<string,variant>"))).alias("k")).distinct()
        return sorted(r[0] for r in keys.collect() if not r[0].startswith("_"))

    def rebuild_index(self) -> None:
        """Lookups are derived from the data; only the record cache is forgotten."""
        self._cache.clear()

    # writing

    def _prepared(self, fields: dict) -> dict:
        bad = [k for k in fields if k.startswith("_")]
        if bad:
            raise ValueError(f"names that begin with an underscore are reserved: {', '.join(bad)}")
        record = self._schema.apply_defaults(fields) if self._schema else dict(fields)
        if self._schema:
            self._schema.validate(record)
        return json.loads(encode_line(record))

    def _race(self, attempt: Callable[[Manifest], tuple[Manifest, object] | None]):
        """Publish what ``attempt`` makes of the latest manifest; try again when another writer was first."""
        deadline = time.monotonic() + self._store.lock_timeout
        while True:
            now = self._log.latest()
            made = attempt(now)
            if made is None:
                return None
            manifest, result = made
            if self._log.publish(manifest):
                return result
            for f in set(manifest.files) - set(now.files):
                self._remove(f)
            if time.monotonic() > deadline:
                raise LockTimeoutError(str(self._folder), self._store.lock_timeout)

    def _remove(self, f: DataFile) -> None:
        path = self._folder / "data" / f.path
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)

    def _reserve(self, n: int) -> int:
        """First of ``n`` ids that no one else will get."""
        return self._race(lambda now: (following(now, next_id=now.next_id + n, ts=now_ts(), ops=()), now.next_id))

    def _write_rows(self, rows: list[dict]) -> DataFile:
        docs = [r["doc"] for r in rows]
        if self._store.cipher:
            docs = self._store.cipher.encrypt_many(docs)
        rows = [{**r, "doc": d} for r, d in zip(rows, docs, strict=True)]
        name = f"{uuid.uuid4().hex}.parquet"
        path = self._folder / "data" / name
        pq.write_table(pa.Table.from_pylist(rows, _ARROW), path)
        ids = [r["_id"] for r in rows]
        return DataFile(name, len(rows), path.stat().st_size, min(ids), max(ids))

    def _check_unique(self, manifest: Manifest, records: dict[int, dict], before: dict[int, dict | None]) -> None:
        """Values of unique fields that change must be free, among live records and among ``records``."""
        for field in sorted(self._unique):
            wanted: dict[str, tuple[int, object]] = {}
            held_by_batch = set(before)
            for rid, record in records.items():
                if field not in record:
                    continue
                key, old = py_str_value(record[field]), before.get(rid)
                if key in wanted:
                    raise DuplicateIndexError(field, record[field])
                if old is None or field not in old or py_str_value(old[field]) != key:
                    wanted[key] = (rid, record[field])
                else:
                    wanted.setdefault(key, (rid, record[field]))
            if not wanted or not manifest.files:
                continue
            keys = [v for _, v in wanted.values()]
            hits = self._holders(manifest, field, keys).where(~F.col("_id").isin(list(held_by_batch) or [-1])).select("_key").limit(1).collect()
            if hits:
                raise DuplicateIndexError(field, wanted[hits[0]["_key"]][1])

    def _commit(self, ops: list[tuple[str, int, dict | None]], results: list | None = None, skip_missing: bool = False) -> list[dict]:
        """Apply buffered operations in order, as one version."""
        if not ops:
            return []

        def attempt(now: Manifest):
            nonlocal version
            state: dict[int, dict | None] = self._many(now, {rid for kind, rid, _ in ops if kind != "create"})
            made: dict[int, dict] = {}
            rows, out, log = [], [], []
            seq, ts = now.next_seq, now_ts()
            top = now.next_id
            for kind, rid, fields in ops:
                if kind == "create":
                    if rid is None:
                        rid, top = top, top + 1
                    state.setdefault(rid, None)
                    made[rid] = {"_id": rid, "_created": ts, "_updated": ts, "_deleted": False, "_first": None, **fields}
                else:
                    if rid not in state:
                        state[rid] = self._live_record(now, rid)
                    current = made.get(rid, state[rid])
                    if current is None or current["_deleted"]:
                        if skip_missing:
                            continue
                        raise RecordNotFoundError(rid, self._name)
                    made[rid] = {**current, **(fields or {}), "_updated": ts, "_deleted": kind == "delete"}
                r = made[rid]
                meta = ("_id", "_created", "_updated", "_deleted", "_first")
                rows.append({k: r[k] for k in meta} | {"_seq": seq, "doc": encode_line({k: v for k, v in r.items() if k not in meta})})
                log.append({"op": kind, "id": rid, "seq": seq})
                out.append(dict(r))
                seq += 1
            if not rows:
                return None
            self._check_unique(now, {k: r for k, r in made.items() if not r["_deleted"]}, state)
            file = self._write_rows(rows)
            version = now.version + 1
            return following(now, next_id=top, next_seq=seq, ts=ts, files=(*now.files, file), ops=tuple(log)), out

        version = 0
        with self._lock:
            out = self._race(attempt) or []
            if version and self._cached_at == version - 1:  # what else is cached is as it was
                self._cache.invalidate_many([r["_id"] for r in out])
                self._cached_at = version
        for r in out:
            r.pop("_first", None)
        return out

    def create(self, **fields) -> dict:
        record = self._prepared(fields)
        return public_view(self._commit([("create", None, record)])[0])

    def create_many(self, records: list[dict]) -> list[dict]:
        """All records in one commit, in order."""
        return [public_view(r) for r in self._commit([("create", None, self._prepared(r)) for r in records])]

    def _patch(self, fields: dict) -> dict:
        bad = [k for k in fields if k.startswith("_")]
        if bad:
            raise ValueError(f"names that begin with an underscore are reserved: {', '.join(bad)}")
        if self._schema:
            self._schema.validate(fields, partial=True)
        return json.loads(encode_line(fields))

    def update(self, record_id: int, **fields) -> dict:
        """Replace the given fields; nested values are replaced whole."""
        return public_view(self._commit([("update", record_id, self._patch(fields))])[0])

    def update_many(self, ids: list[int], **fields) -> int:
        patch = self._patch(fields)
        return len(self._commit([("update", i, patch) for i in ids], skip_missing=True))

    def delete(self, record_id: int) -> None:
        self._commit([("delete", record_id, None)])

    def delete_many(self, ids: list[int]) -> int:
        return len(self._commit([("delete", i, None) for i in ids], skip_missing=True))

    def update_df(self, ids: DataFrame, **fields) -> int:
        """Replace the given fields of all live records whose id is in the first column of ``ids``; one commit, by the executors.

        Ids may repeat or have no record. Returns how many records changed.
        """
        patch = self._patch(fields)
        if not patch:
            return 0
        text = F.lit(encode_line(patch))
        old = F.map_filter(F.parse_json("_json").cast("map<string,variant>"), lambda k, _: ~k.isin(list(patch)))
        return self._rewrite(ids, F.to_json(F.map_concat(old, F.parse_json(text).cast("map<string,variant>"))), False, set(patch) & self._unique)

    def delete_df(self, ids: DataFrame) -> int:
        """Delete all live records whose id is in the first column of ``ids``; one commit, by the executors."""
        return self._rewrite(ids, F.col("_json"), True, set())

    def _rewrite(self, ids: DataFrame, doc: Column, deleted: bool, unique: set[str]) -> int:
        wanted = ids.select(F.col(f"`{ids.columns[0]}`").cast("long").alias("_id")).distinct()

        def attempt(now: Manifest):
            staged = self._folder / "data" / f"{uuid.uuid4().hex}.staged"
            try:
                old = self.live(now).join(wanted, "_id", "left_semi").select("_id", "_created", "_first", doc.alias("doc"))
                self._stage(old, staged)
                rows = self.spark.read.schema("part int, row long, _id long, _created long, _first long, doc string").parquet(str(staged))
                total, low, high = rows.agg(F.count(F.lit(1)), F.min("_id"), F.max("_id")).first()
                if not total:
                    return None
                for field in sorted(unique):  # all of them would hold one value
                    value = json.loads(rows.select("doc").first()["doc"])[field]
                    taken = self._holders(now, field, [value]).join(rows.select("_id"), "_id", "left_anti").limit(1).count()
                    if total > 1 or taken:
                        raise DuplicateIndexError(field, value)
                place, ts = F.lit(now.next_seq) + F.col("place"), now_ts()
                text = self._store.cipher.encrypt_column(F.col("doc")) if self._store.cipher else F.col("doc")
                new = self._numbered(rows).select("_id", place.alias("_seq"), "_created", F.lit(ts).alias("_updated"), F.lit(deleted).alias("_deleted"), "_first", text.alias("doc"))
                file = self._write_frame(new, total, low, high)
            finally:
                shutil.rmtree(staged, ignore_errors=True)
            log = ({"op": "delete" if deleted else "update", "rows": total},)
            return following(now, next_seq=now.next_seq + total, ts=ts, files=(*now.files, file), ops=log), total

        with self._lock:
            return self._race(attempt) or 0

    @staticmethod
    def _stage(rows: DataFrame, path: Path) -> None:
        """Write rows with their partition and place in it, so that numbers can be given without a global sort."""
        rows.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"), "*").write.parquet(str(path))

    @staticmethod
    def _numbered(rows: DataFrame) -> DataFrame:
        """Staged rows with ``place``, counted from 0 through the partitions."""
        parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("start"))
        ahead = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return rows.join(F.broadcast(parts.select("part", "start", ahead.alias("ahead"))), "part").withColumn("place", F.col("ahead") + F.col("row") - F.col("start"))

    def _write_frame(self, rows: DataFrame, total: int, low: int, high: int) -> DataFile:
        name = f"{uuid.uuid4().hex}.parquet"
        out = self._folder / "data" / name
        rows.select(*_ARROW.names).write.parquet(str(out))
        return DataFile(name, total, sum(p.stat().st_size for p in out.glob("*.parquet")), low, high)

    def transaction(self) -> Transaction:
        return Transaction(self)

    def insert_df(self, frame: DataFrame) -> int:
        """Add a frame's rows as records, written by the executors; returns how many.

        Ids are consecutive in the order of the frame's partitions. Null
        columns become JSON nulls. Rows are validated by the schema's column
        rules, unique fields against live records and each other.
        """
        if bad := [c for c in frame.columns if c.startswith("_")]:
            raise ValueError(f"names that begin with an underscore are reserved: {', '.join(bad)}")
        if self._schema:
            frame = self._schema.fill_defaults(frame)
        staged_name = f"{uuid.uuid4().hex}.staged"
        staged = self._folder / "data" / staged_name
        doc = F.to_json(F.struct(*[F.col(f"`{c}`") for c in frame.columns]), {"ignoreNullFields": "false"})
        body = frame if not self._schema else self._schema.with_errors(frame, "_errors")
        errors = F.col("_errors") if self._schema else F.array().cast("array<string>")
        try:
            self._stage(body.select(doc.alias("doc"), errors.alias("errors")), staged)
            return self._insert_staged(staged)
        finally:
            shutil.rmtree(staged, ignore_errors=True)

    def _insert_staged(self, staged: Path) -> int:
        rows = self.spark.read.schema("part int, row long, doc string, errors array<string>").parquet(str(staged))
        if found := rows.where(F.size("errors") > 0).select(F.explode("errors")).distinct().limit(20).collect():
            raise SchemaValidationError(sorted(r[0] for r in found))
        total = rows.count()
        if not total:
            return 0

        def attempt(now: Manifest):
            place = F.col("place")
            new = self._numbered(rows).select((F.lit(now.next_id) + place).alias("_id"), (F.lit(now.next_seq) + place).alias("_seq"), "doc")
            for field in sorted(self._unique):
                key = VariantField(F.parse_json("doc"), field).pystr()
                keys = new.select(key.alias("k")).where(F.col("k").isNotNull())
                twice = keys.groupBy("k").count().where("count > 1").limit(1).collect()
                taken = keys.join(self._documents(now).select(VariantField(F.col("doc"), field).pystr().alias("k")), "k", "left_semi").limit(1).collect()
                if twice or taken:
                    raise DuplicateIndexError(field, (twice or taken)[0]["k"])
            text = self._store.cipher.encrypt_column(F.col("doc")) if self._store.cipher else F.col("doc")
            ts = now_ts()
            new = new.select("_id", "_seq", F.lit(ts).alias("_created"), F.lit(ts).alias("_updated"), F.lit(False).alias("_deleted"), F.lit(None).cast("long").alias("_first"), text.alias("doc"))
            file = self._write_frame(new, total, now.next_id, now.next_id + total - 1)
            return following(now, next_id=now.next_id + total, next_seq=now.next_seq + total, ts=ts, files=(*now.files, file), ops=({"op": "insert", "rows": total},)), total

        with self._lock:
            return self._race(attempt)

    # maintenance

    def compact(self) -> dict:
        """Rewrite the live records as the only version; returns records_remaining and bytes_saved."""

        def attempt(now: Manifest):
            live = self._last_versions(self.log(now)).where(~F.col("_deleted"))
            name = f"{uuid.uuid4().hex}.parquet"
            out = self._folder / "data" / name
            # by id, so that a point read meets few row groups
            live.sortWithinPartitions("_id").write.parquet(str(out))
            kept = self.spark.read.schema(LOG_SCHEMA).parquet(str(out)).agg(F.count(F.lit(1)), F.min("_id"), F.max("_id")).first()
            size = sum(p.stat().st_size for p in out.glob("*.parquet"))
            files = (DataFile(name, kept[0], size, kept[1], kept[2]),) if kept[0] else ()
            if not files:
                shutil.rmtree(out, ignore_errors=True)
            saved = max(0, sum(f.size for f in now.files) - size * bool(files))
            return following(now, ts=now_ts(), files=files, ops=({"op": "compact"},)), {"records_remaining": kept[0], "bytes_saved": saved}

        with self._lock:
            self._cache.clear()
            return self._race(attempt)

    def vacuum(self, retention: float = RETENTION) -> int:
        """Delete data files that older versions had and the current one hasn't, and older manifests; queries begun earlier may then fail.

        Files that no version ever had may be those of a writer that is about
        to publish: they go when they are older than ``retention`` seconds.
        """
        now = self._log.latest()
        used = {f.path for f in now.files}
        known = {f.path for v in self._log.versions() for f in self._log.read(v).files}
        begun = time.time() - retention
        old = [p for p in (self._folder / "data").iterdir() if p.name not in used and (p.name in known or p.stat().st_mtime < begun)]
        for p in old:
            shutil.rmtree(p, ignore_errors=True) if p.is_dir() else p.unlink(missing_ok=True)
        self._log.forget(now.version)
        return len(old)

    def stats(self) -> dict:
        now = self._log.latest()
        return {
            "name": self._name, "record_count": self.count(), "file_size_bytes": sum(f.size for f in now.files),
            "indexed_fields": self.indexed_fields(), "cache": self._cache.stats(), "last_id": now.next_id - 1,
        }

    def file_size(self) -> int:
        return sum(f.size for f in self._log.latest().files)

    def line_count(self) -> int:
        return sum(f.rows for f in self._log.latest().files)

    def history(self) -> list[dict]:
        """What each kept version did: version, ts and its operations."""
        return [{"version": m.version, "ts": m.ts, "ops": list(m.ops)} for m in map(self._log.read, self._log.versions())]

    def pending_entries(self) -> list[dict]:
        """What was written but isn't published: files of running writers, or of writers that broke off. None of it shows in reads."""
        known = {f.path for v in self._log.versions() for f in self._log.read(v).files}
        files = [p for p in (self._folder / "data").iterdir() if p.name not in known]
        return [{"file": p.name, "modified": int(p.stat().st_mtime)} for p in sorted(files)]

    def drop(self) -> None:
        self._store._forget(self._name)
        self._cache.clear()
        shutil.rmtree(self._folder, ignore_errors=True)

    # exchange

    def import_jsonl(self, path: str) -> int:
        """Take over a JSON-lines change log: ids, times and order are kept. The collection must be empty."""
        log = jsonl.read_log(self.spark, path).where(F.col("_id").isNotNull())
        last = changelog.latest(log, "_id", "_seq", ["_seq", "_created", "_updated", "_deleted", "doc"])
        meta = F.map_filter(F.col("doc").cast("map<string,variant>"), lambda k, _: ~k.startswith("_"))
        doc = F.to_json(meta)
        if self._store.cipher:
            doc = self._store.cipher.encrypt_column(doc)

        def attempt(now: Manifest):
            if now.files:
                raise SheafError("the collection has records")
            name = f"{uuid.uuid4().hex}.parquet"
            out = self._folder / "data" / name
            last.where(~F.col("_deleted")).select("_id", "_seq", "_created", "_updated", "_deleted", F.col("first_seq").alias("_first"), doc.alias("doc")).write.parquet(str(out))
            top = log.agg(F.max("_id"), F.max("_seq")).first()
            kept = self.spark.read.schema(LOG_SCHEMA).parquet(str(out)).agg(F.count(F.lit(1)), F.min("_id"), F.max("_id")).first()
            size = sum(p.stat().st_size for p in out.glob("*.parquet"))
            files = (DataFile(name, kept[0], size, kept[1], kept[2]),) if kept[0] else ()
            return following(now, next_id=(top[0] or 0) + 1, next_seq=(top[1] or 0) + 1, ts=now_ts(), files=files, ops=({"op": "import"},)), kept[0]

        return self._race(attempt)

    def export_jsonl(self, path: str) -> None:
        """Live records as JSON lines, metadata first, in natural order."""
        head = F.to_json(F.struct("_id", "_created", "_updated", "_deleted"))
        body = F.substring(F.col("_json"), 2, 1 << 30)
        joined = F.when(F.col("_json") == "{}", head).otherwise(F.concat(F.expr("substring(h, 1, length(h) - 1)"), F.lit(","), body))
        jsonl.write_log(self.live().withColumn("h", head).orderBy("_first").select(joined.alias("value")), path)


class Store:
    """A folder of collections. ``password`` encrypts the documents."""

    VERSION = "1"

    def __init__(self, path: str | Path, spark: SparkSession | None = None, password: str | None = None, cache_size: int = CACHE_SIZE, lock_timeout: float = LOCK_TIMEOUT):
        self.path, self.spark = Path(path), _session(spark)
        self._cache_size, self.lock_timeout = cache_size, lock_timeout
        self._open: dict[str, Collection] = {}
        self._lock = threading.RLock()
        self.cipher: Cipher | None = None
        meta = self._meta()
        if meta is None:
            self.path.mkdir(parents=True, exist_ok=True)
            meta = {"version": self.VERSION, "encrypted": password is not None}
            if password is not None:
                self.cipher = Cipher(self.spark, password)
                meta |= {"salt": self.cipher.salt.hex(), "key_check": self.cipher.key_check()}
            self._save(meta)
        elif meta["encrypted"] != (password is not None):
            raise EncryptionError("the store is encrypted: a password is needed" if meta["encrypted"] else "the store is not encrypted")
        elif password is not None:
            self.cipher = Cipher(self.spark, password, bytes.fromhex(meta["salt"]))
            self.cipher.verify(meta["key_check"])

    @property
    def is_encrypted(self) -> bool:
        return self.cipher is not None

    def _meta(self) -> dict | None:
        path = self.path / "meta.json"
        return json.loads(path.read_text()) if path.exists() else None

    def _save(self, meta: dict) -> None:
        write_text(self.path / "meta.json", json.dumps(meta))

    def collection(self, name: str, schema: Schema | None = None, unique_fields=None, cache_size: int | None = None) -> Collection:
        """Get or create; the same object for a name. Another schema for an open collection is an error."""
        check_name(name)
        with self._lock:
            if name in self._open:
                known = self._open[name]
                if schema is not None and known.schema is not None and schema is not known.schema:
                    raise ValueError(f"{name} is open with another schema")
                if schema is not None:
                    known._schema = schema
                if unique_fields is not None:
                    known._unique = frozenset(unique_fields)
                return known
            self._open[name] = Collection(self, name, schema, unique_fields or (), cache_size or self._cache_size)
            return self._open[name]

    def list_collections(self) -> list[str]:
        """A collection is registered by the folder of its log, so processes that create different ones don't meet in a file."""
        return sorted(p.name for p in self.path.iterdir() if is_valid_name(p.name) and (p / "log").is_dir())

    def _forget(self, name: str) -> None:
        with self._lock:
            self._open.pop(name, None)

    def drop_collection(self, name: str) -> None:
        check_name(name)
        if name in self._open or name in self.list_collections():
            self.collection(name).drop()

    def compact_all(self) -> dict[str, dict]:
        """Compact every collection, and delete what that left behind."""
        done = {}
        for n in self.list_collections():
            done[n] = self.collection(n).compact()
            done[n]["files_removed"] = self.collection(n).vacuum()
        return done

    def all_pending(self) -> dict[str, list[dict]]:
        """``pending_entries`` of every collection that has any."""
        found = {n: self.collection(n).pending_entries() for n in self.list_collections()}
        return {n: entries for n, entries in found.items() if entries}

    def stats(self) -> dict:
        each = [self.collection(n) for n in self.list_collections()]
        return {
            "path": str(self.path), "version": self.VERSION, "encrypted": self.is_encrypted, "collections": [c.name for c in each],
            "total_records": sum(c.count() for c in each), "total_bytes": sum(c.file_size() for c in each),
        }

    def close(self) -> None:
        self._open.clear()

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def __repr__(self) -> str:
        return f"<Store {str(self.path)!r}{' [encrypted]' if self.is_encrypted else ''}>"


Database = Store
