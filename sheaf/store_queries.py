"""Catalogue queries that go through a store: rows of the test tables written to collections, changed and read again."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.errors import DuplicateIndexError, RecordNotFoundError, SchemaValidationError
from sheaf.operators.schema import Field, Schema
from sheaf.plans.query import DocumentQuery
from sheaf.sources.store import Collection, Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
NATION = "n_nationkey int, n_name string, n_regionkey int"


def _query(name: str, sql: str):
    def register(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return register


def _store(spark: SparkSession, **options) -> Store:
    """A new store in the folder that the session names for such files; on one machine, where none is named, in a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return Store(Path(tempfile.mkdtemp(prefix="sheaf-store-", dir=shared and urlparse(shared).path)), spark, **options)


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _filled(spark: SparkSession, d: str, name: str, **options) -> Collection:
    """A collection of all rows of a table."""
    made = _store(spark).collection(name, **options)
    made.insert_df(_read(spark, d, name))
    return made


def _customers(c: Collection) -> DataFrame:
    return c.to_df(CUSTOMER).drop("id")


def _rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@_query("store_insert", "select * from customer")
def _insert(spark, d):
    return _customers(_filled(spark, d, "customer"))


@_query("store_filter", "select c_custkey, c_name from customer where c_acctbal >= 9000 and c_mktsegment in ('BUILDING', 'MACHINERY') and ends_with(c_name, '7')")
def _filter(spark, d):
    found = _filled(spark, d, "customer").filter(c_acctbal__gte=9000, c_mktsegment__in=["BUILDING", "MACHINERY"], c_name__endswith="7")
    return found.typed("c_custkey long, c_name string").drop("id")


@_query("store_sort_page", "select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 15 offset 10")
def _page(spark, d):
    c = _store(spark).collection("c")
    c.insert_df(_read(spark, d, "customer").orderBy("c_custkey").coalesce(1))  # natural order is that of insertion
    return c.sort("c_acctbal", descending=True).offset(10).limit(15).typed("c_custkey long, c_acctbal double").drop("id")


@_query("store_terminals", "select 'all' as what, n_nationkey as n from nation union all select 'first', min(n_nationkey) from nation union all select 'count', count(*) from nation where n_regionkey > 1 union all select 'iterated', cast(sum(n_nationkey) as bigint) from nation union all select 'pluck', max(n_nationkey) from nation union all select 'exists', 1")
def _terminals(spark, d):
    c = _filled(spark, d, "nation")
    found = [("all", r["n_nationkey"]) for r in c.all()]
    found += [("first", c.sort("n_nationkey").first()["n_nationkey"]), ("count", c.filter(n_regionkey__gt=1).count()), ("iterated", sum(r["n_nationkey"] for r in c.filter()))]
    found += [("pluck", max(c.filter().pluck("n_nationkey"))), ("exists", int(c.exists(n_regionkey=1) and not c.exists(n_regionkey=99)))]
    return _rows(spark, found, "what string, n long")


@_query("store_get", "select n_nationkey, n_name from nation where n_nationkey in (3, 7)")
def _get(spark, d):
    c = _filled(spark, d, "nation")
    by_field = c.get(n_nationkey=3)
    by_id = c.get(c.lookup("n_nationkey", 7)[0])
    return _rows(spark, [(r["n_nationkey"], r["n_name"]) for r in (by_field, by_id)], "n_nationkey int, n_name string")


@_query("store_create", "select n_nationkey, n_name, n_regionkey from nation where n_nationkey < 5 union all select 100, 'NOWHERE', 1 union all select 101, 'ELSEWHERE', 2")
def _create(spark, d):
    c = _store(spark).collection("n")
    c.create_many([r.asDict() for r in _read(spark, d, "nation").where("n_nationkey < 5").collect()])
    c.create(n_nationkey=100, n_name="NOWHERE", n_regionkey=1)
    c.create(n_nationkey=101, n_name="ELSEWHERE", n_regionkey=2)
    return c.to_df(NATION).drop("id")


@_query("store_update", "select n_nationkey, case when n_nationkey = 4 then 'RENAMED' else n_name end as n_name, n_regionkey from nation")
def _update(spark, d):
    c = _filled(spark, d, "nation")
    c.update(c.lookup("n_nationkey", 4)[0], n_name="RENAMED")
    return c.to_df(NATION).drop("id")


@_query("store_update_many", "select c_custkey, c_name, c_nationkey, c_acctbal, case when c_custkey between 10 and 60 then 'PATCHED' else c_mktsegment end as c_mktsegment from customer")
def _update_many(spark, d):
    c = _filled(spark, d, "customer")
    c.update_many(c.lookup_in("c_custkey", list(range(10, 61))), c_mktsegment="PATCHED")
    return _customers(c)


@_query("store_update_frame", "select c_custkey, c_name, c_nationkey, case when c_mktsegment = 'BUILDING' then 0.5 else c_acctbal end as c_acctbal, c_mktsegment from customer")
def _update_frame(spark, d):
    c = _filled(spark, d, "customer")
    c.update_df(c.filter(c_mktsegment="BUILDING").to_df().select("_id"), c_acctbal=0.5)
    return _customers(c)


@_query("store_delete", "select * from nation where n_nationkey <> 11")
def _delete(spark, d):
    c = _filled(spark, d, "nation")
    c.delete(c.lookup("n_nationkey", 11)[0])
    return c.to_df(NATION).drop("id")


@_query("store_delete_many", "select * from customer where c_custkey not between 1 and 40")
def _delete_many(spark, d):
    c = _filled(spark, d, "customer")
    c.delete_many([*c.lookup_in("c_custkey", list(range(1, 41))), 10**9])
    return _customers(c)


@_query("store_delete_frame", "select * from customer where c_acctbal >= 0")
def _delete_frame(spark, d):
    c = _filled(spark, d, "customer")
    c.delete_df(c.filter(c_acctbal__lt=0).to_df().select("_id"))
    return _customers(c)


@_query("store_transaction", "select * from (select n_nationkey, case when n_nationkey = 2 then 'TWO' else n_name end as n_name, n_regionkey from nation where n_nationkey <> 3) union all select 200, 'NEW', 0")
def _transaction(spark, d):
    c = _filled(spark, d, "nation")
    with c.transaction() as t:
        t.create(n_nationkey=200, n_name="NEW", n_regionkey=0)
        t.update(c.lookup("n_nationkey", 2)[0], n_name="TWO")
        t.delete(c.lookup("n_nationkey", 3)[0])
    try:  # rolled back whole
        with c.transaction() as t:
            t.create(n_nationkey=201)
            t.delete(10**9)
    except RecordNotFoundError:
        pass
    t = c.transaction()
    t.create(n_nationkey=202)
    t.rollback()
    return c.to_df(NATION).drop("id")


@_query("store_unique", "select n_nationkey, n_name, n_regionkey from nation union all select 300, 'FREE', 1")
def _unique(spark, d):
    c = _filled(spark, d, "nation", unique_fields=["n_name"])
    for attempt in (lambda: c.create(n_nationkey=299, n_name="NATION_3"), lambda: c.insert_df(_read(spark, d, "nation")), lambda: c.check_unique("n_name", "NATION_3")):
        try:
            attempt()
        except DuplicateIndexError:
            continue
        raise AssertionError("a second NATION_3")
    c.create(n_nationkey=300, n_name="FREE", n_regionkey=1)
    return c.to_df(NATION).drop("id")


@_query("store_lookup", "select n_nationkey, n_name from nation where n_regionkey = 2 union all select n_nationkey, n_name from nation where n_regionkey = 0")
def _lookup(spark, d):
    c = _filled(spark, d, "nation")
    ids = [*c.lookup("n_regionkey", 2), *c.lookup_in("n_regionkey", [0, 17])]
    return _rows(spark, [(r["n_nationkey"], r["n_name"]) for r in map(c.get, ids)], "n_nationkey int, n_name string")


@_query("store_index", "select 'n_regionkey' as field, cast(n_regionkey as varchar) as value, count(*) as n from nation group by 2 union all select 'n_name', n_name, count(*) from nation group by 2 union all select 'n_nationkey', cast(n_nationkey as varchar), count(*) from nation group by 2")
def _index(spark, d):
    c = _filled(spark, d, "nation")
    c.rebuild_index()
    assert c.indexed_fields() == ["n_name", "n_nationkey", "n_regionkey"]
    return c.index_df().groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


@_query("store_all_values", "select cast(n_regionkey as varchar) as value, count(*) as n from nation group by 1")
def _all_values(spark, d):
    return _rows(spark, [(v, len(ids)) for v, ids in _filled(spark, d, "nation").all_values("n_regionkey").items()], "value string, n long")


@_query("store_compaction", "select c_custkey, c_name, c_nationkey, case when c_custkey between 1 and 29 then 1.0 else c_acctbal end as c_acctbal, c_mktsegment from customer where c_custkey not between 1 and 4")
def _compaction(spark, d):
    c = _filled(spark, d, "customer")
    c.update_many(c.lookup_in("c_custkey", list(range(1, 30))), c_acctbal=1.0)
    c.delete_many(c.lookup_in("c_custkey", [1, 2, 3, 4]))
    lines = c.line_count()
    done = c.compact()
    assert c.vacuum() >= 2 and c.line_count() == done["records_remaining"] < lines and not c.pending_entries()
    return _customers(c)


@_query("store_stats", "select 'customer' as name, count(*) as record_count, count(*) as last_id, count(*) + 4 as line_count from customer")
def _stats(spark, d):
    c = _filled(spark, d, "customer")
    c.update_many(c.lookup_in("c_custkey", [1, 2, 3, 4]), c_acctbal=2.5)
    s = c.stats()
    return _rows(spark, [(s["name"], s["record_count"], s["last_id"], c.line_count())], "name string, record_count long, last_id long, line_count long")


@_query("store_database", "select 'customers' as name, (select count(*) from customer) as n union all select 'nations', (select count(*) from nation) union all select 'total', (select count(*) from customer) + (select count(*) from nation)")
def _database(spark, d):
    store = _store(spark)
    for name, table in (("customers", "customer"), ("nations", "nation"), ("gone", "region")):
        store.collection(name).insert_df(_read(spark, d, table))
    store.drop_collection("gone")
    store.compact_all()
    assert store.all_pending() == {}
    names = store.list_collections()
    return _rows(spark, [(n, store.collection(n).count()) for n in names] + [("total", store.stats()["total_records"])], "name string, n long")


@_query("store_jsonl_round_trip", "select * from customer where c_custkey <> 5")
def _jsonl(spark, d):
    store = _store(spark)
    one, two = store.collection("one"), store.collection("two")
    one.insert_df(_read(spark, d, "customer"))
    one.delete(one.lookup("c_custkey", 5)[0])
    one.export_jsonl(str(store.path / "exported"))
    two.import_jsonl(str(store.path / "exported"))
    return _customers(two)


@_query("store_jsonl_log", "select user_id, event_id from (select *, row_number() over (partition by user_id order by event_id desc) as rn from events) where rn = 1 and event_type <> 'error'")
def _jsonl_log(spark, d):
    """A change log in JSON lines: the last line of an id wins, error events are deletions."""
    store = _store(spark)
    line = F.to_json(F.struct(F.col("user_id").alias("_id"), F.col("event_id").alias("_created"), F.col("event_id").alias("_updated"), (F.col("event_type") == "error").alias("_deleted"), "event_id"))
    _read(spark, d, "events").orderBy("event_id").select(line.alias("value")).write.text(str(store.path / "old"))
    c = store.collection("c")
    c.import_jsonl(str(store.path / "old"))
    return c.to_df("event_id long").select(F.col("id").alias("user_id"), "event_id")


@_query("store_encrypted", "select n_nationkey, n_name, n_regionkey from nation where contains(n_name, 'ION_1')")
def _encrypted(spark, d):
    c = _store(spark, password="secret words").collection("n")
    c.insert_df(_read(spark, d, "nation"))
    return c.filter(n_name__contains="ION_1").typed(NATION).drop("id")


@_query("store_views", "select n_nationkey, false as _deleted, true as has_id from nation where n_nationkey < 20")
def _views(spark, d):
    c = _filled(spark, d, "nation")
    c.delete_df(c.filter(n_nationkey__gte=20).to_df().select("_id"))
    public = {r["n_nationkey"]: "id" in r and not any(k.startswith("_") for k in r) for r in c.all()}
    raw = DocumentQuery(c.live().withColumn("doc", F.parse_json("_json")), strip_meta=False).all()
    return _rows(spark, [(r["n_nationkey"], r["_deleted"], public[r["n_nationkey"]]) for r in raw], "n_nationkey int, _deleted boolean, has_id boolean")


@_query("store_raw_log", "select count(*) + 6 as versions, count(*) as records, 3 as deleted from nation")
def _raw_log(spark, d):
    c = _filled(spark, d, "nation")
    c.update_many(c.lookup_in("n_nationkey", [0, 1, 2]), n_name="X")
    c.delete_many(c.lookup_in("n_nationkey", [0, 1, 2]))
    last = c.latest().agg(F.count(F.lit(1)).alias("records"), F.sum(F.col("_deleted").cast("int")).cast("int").alias("deleted"))
    return c.log().agg(F.count(F.lit(1)).alias("versions")).crossJoin(last)  # a row each


@_query("store_snapshot", "select 'before' as at, count(*) as n from nation union all select 'after', count(*) - 1 from nation")
def _snapshot(spark, d):
    c = _filled(spark, d, "nation")
    query = c.filter()
    c.delete(c.lookup("n_nationkey", 0)[0])
    return _rows(spark, [("before", query.count()), ("after", c.count())], "at string, n long")


@_query("store_ids", "select count(*) as n, count(*) as ids, cast(1 as bigint) as low, count(*) as high from orders")
def _ids(spark, d):
    """Ids of bulk inserts: consecutive, whatever the partitions."""
    c = _store(spark).collection("o")
    c.insert_df(_read(spark, d, "orders").select("o_orderkey").repartition(7))
    return c.to_df().agg(F.count(F.lit(1)).alias("n"), F.countDistinct("_id").alias("ids"), F.min("_id").alias("low"), F.max("_id").alias("high"))


@_query("store_history", "select 1 as version, 'insert' as op union all select 2, 'update' union all select 3, 'delete' union all select 4, 'compact'")
def _history(spark, d):
    c = _filled(spark, d, "region")
    c.update(1, r_name="X")
    c.delete(2)
    c.compact()
    return _rows(spark, [(h["version"], h["ops"][0]["op"]) for h in c.history()], "version int, op string")


@_query("store_metadata", "select count(*) as n, true as timed, false as deleted from nation")
def _metadata(spark, d):
    c = _filled(spark, d, "nation")
    return c.to_df().agg(F.count(F.lit(1)).alias("n"), F.min((F.col("_created") > 0) & (F.col("_updated") >= F.col("_created"))).alias("timed"), F.max("_deleted").alias("deleted"))


@_query("store_schema_defaults", "select n_nationkey, 'unknown' as status, cast(1.5 as double) as weight, '[\"a\",1]' as tags from nation")
def _schema_defaults(spark, d):
    """Defaults of fields that the frame has no column for, a list among them."""
    schema = Schema(n_nationkey=Field(type=int, required=True), status=Field(type=str, default="unknown"), weight=Field(type=float, default=1.5), tags=Field(type=list, default=["a", 1]))
    c = _store(spark).collection("n", schema=schema)
    c.insert_df(_read(spark, d, "nation").select("n_nationkey"))
    return c.to_df().select(F.variant_get("doc", "$.n_nationkey", "int").alias("n_nationkey"), F.variant_get("doc", "$.status", "string").alias("status"), F.variant_get("doc", "$.weight", "double").alias("weight"), F.to_json(F.variant_get("doc", "$.tags", "variant")).alias("tags"))


@_query("store_schema_refusals", "select 'absent' as what, 'required' as rule union all select 'null', 'required' union all select 'type', 'type' union all select 'range', 'max' union all select 'length', 'minlen' union all select 'choice', 'choices' union all select 'own', 'odd'")
def _schema_refusals(spark, d):
    """What a schema keeps out of a collection; nothing of a refused frame stays."""
    nation = _read(spark, d, "nation")
    cases = {
        "absent": (Schema(other=Field(required=True)), nation),
        "null": (Schema(n_name=Field(required=True)), nation.withColumn("n_name", F.when(F.col("n_nationkey") != 3, F.col("n_name")))),
        "type": (Schema(n_name=Field(type=int, min_value=0)), nation),
        "range": (Schema(n_nationkey=Field(type=int, max_value=20)), nation),
        "length": (Schema(n_name=Field(type=str, min_length=9)), nation),
        "choice": (Schema(n_regionkey=Field(choices=[0, 1, 2])), nation),
        "own": (Schema(n_nationkey=Field(validator=lambda v: "odd" if v % 2 else None)), nation),
    }
    store, found = _store(spark), []
    for what, (schema, frame) in cases.items():
        c = store.collection(f"c_{what}", schema=schema)
        try:
            c.insert_df(frame)
        except SchemaValidationError as e:
            found += [(what, rule) for rule in e.errors]
        assert c.count() == 0
    return _rows(spark, found, "what string, rule string")


@_query("schema_absent_columns", "select n_nationkey, list_filter(['required', case when n_nationkey > 20 then 'max' end], lambda x: x is not null) as errors from nation")
def _absent_columns(spark, d):
    schema = Schema(title=Field(type=str, required=True), note=Field(), n_nationkey=Field(type=int, max_value=20))
    return schema.with_errors(_read(spark, d, "nation")).select("n_nationkey", "errors")


@_query("schema_types", "select n_nationkey, ['type', 'type'] as errors from nation")
def _types(spark, d):
    schema = Schema(n_name=Field(type=int), n_nationkey=Field(type=(str, dict)), n_regionkey=Field(type=(int, str)))
    return schema.with_errors(_read(spark, d, "nation")).select("n_nationkey", "errors")


@_query("schema_validator", "select n_nationkey, list_filter([case when n_nationkey % 2 = 1 then 'odd ' || n_nationkey end], lambda x: x is not null) as errors from nation")
def _validator(spark, d):
    schema = Schema(n_nationkey=Field(type=int, validator=lambda v: f"odd {v}" if v % 2 else None))
    return schema.with_errors(_read(spark, d, "nation")).select("n_nationkey", "errors")


@_query("store_single_record_schema", "select 'bad' as what, 4 as n union all select 'partial', 1 union all select 'default', 1")
def _single(spark, d):
    schema = Schema(name=Field(type=str, required=True, min_length=3), age=Field(type=int, min_value=0, max_value=150), role=Field(choices=["a", "b"], default="a"), even=Field(type=int, validator=lambda v: "odd" if v % 2 else None))
    c, found = _store(spark).collection("s", schema=schema), []
    for what, attempt in (("bad", lambda: c.create(age=-1, role="z", even=3)), ("partial", lambda: c.update(c.create(name="anna")["id"], age=200))):
        try:
            attempt()
        except SchemaValidationError as e:
            found.append((what, len(e.errors)))
    return _rows(spark, [*found, ("default", int(c.all() == [{"name": "anna", "role": "a", "id": 1}]))], "what string, n int")


@_query("store_missing", "select 'get' as what union all select 'get_field' union all select 'update' union all select 'delete'")
def _missing(spark, d):
    c, found = _filled(spark, d, "region"), []
    for what, attempt in (("get", lambda: c.get(99)), ("get_field", lambda: c.get(r_name="NOWHERE")), ("update", lambda: c.update(99, r_name="X")), ("delete", lambda: c.delete(99))):
        try:
            attempt()
        except RecordNotFoundError:
            found.append((what,))
    return _rows(spark, found, "what string")


@_query("store_nested", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events where event_id < 200")
def _nested(spark, d):
    """Nested documents, kept as they came."""
    c = _store(spark).collection("e")
    c.create_many([{"event_id": r["event_id"], "props": json.loads(r["props"])} for r in _read(spark, d, "events").where("event_id < 200").collect()])
    return c.to_df().select(F.variant_get("doc", "$.event_id", "bigint").alias("event_id"), F.variant_get("doc", "$.props.k", "bigint").alias("k"))


@_query("store_change_stream", "select count(*) as n, 1 as deleted from nation")
def _stream(spark, d):
    """The change log as a stream, drained into a table."""
    from sheaf.streaming.tail import changes

    c = _filled(spark, d, "nation")
    c.delete(1)
    out = str(c.path / "tailed")
    query = changes(c).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "_state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = spark.read.parquet(out)
    return rows.agg((F.count(F.lit(1)) - 1).alias("n"), F.sum(F.col("_deleted").cast("int")).cast("int").alias("deleted"))
