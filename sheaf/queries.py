"""The query catalogue over the test tables, each through the library's own builder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators import changelog
from sheaf.operators.schema import Field, Schema
from sheaf.plans.query import Query, from_df

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_P = "case when o_orderkey % 7 = 0 then null else o_orderpriority end"
_ORDERS_P = f"(select *, {_P} as p from orders)"
_LATEST = "(select *, row_number() over (partition by user_id order by event_id desc) as rn, min(event_id) over (partition by user_id) as fs from events)"


def _query(name: str, sql: str):
    def register(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _filtered(name: str, table: str, sql: str, **conditions) -> None:
    _query(name, sql)(lambda spark, d: from_df(read(spark, d, table)).filter(**conditions).to_df())


def _orders_p(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").withColumn("p", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")))


def _filtered_p(name: str, sql: str, columns: tuple[str, ...], **conditions) -> None:
    _query(name, sql)(lambda spark, d: from_df(_orders_p(spark, d)).filter(**conditions).to_df().select(*columns))


_filtered("filter_eq", "customer", "select * from customer where c_mktsegment = 'BUILDING'", c_mktsegment="BUILDING")
_filtered_p("filter_eq_null", f"select o_orderkey from {_ORDERS_P} where p is null", ("o_orderkey",), p=None)
_filtered_p("filter_ne", f"select o_orderkey, p from {_ORDERS_P} where p is distinct from '5-LOW'", ("o_orderkey", "p"), p__ne="5-LOW")
_filtered("filter_gt", "orders", "select * from orders where o_totalprice > 300000", o_totalprice__gt=300000)
_filtered("filter_gte", "part", "select * from part where p_size >= 25", p_size__gte=25)
_filtered("filter_lt", "part", "select * from part where p_size < 10", p_size__lt=10)
_filtered("filter_lte", "part", "select * from part where p_size <= 10", p_size__lte=10)
_filtered("filter_in", "nation", "select * from nation where n_regionkey in (0, 2)", n_regionkey__in=[0, 2])
_filtered_p("filter_in_with_null", f"select o_orderkey, p from {_ORDERS_P} where p = '1-URGENT' or p is null", ("o_orderkey", "p"), p__in=["1-URGENT", None])
_filtered_p("filter_nin", f"select o_orderkey, p from {_ORDERS_P} where coalesce(p not in ('1-URGENT', '2-HIGH'), true)", ("o_orderkey", "p"), p__nin=["1-URGENT", "2-HIGH"])
_filtered_p("filter_nin_with_null", f"select o_orderkey, p from {_ORDERS_P} where p is not null and p not in ('1-URGENT')", ("o_orderkey", "p"), p__nin=["1-URGENT", None])
_filtered("filter_contains", "part", "select * from part where contains(p_name, 'ring')", p_name__contains="ring")
_filtered("filter_icontains", "customer", "select * from customer where contains(lower(c_name), 'customer#00000000')", c_name__icontains="CUSTOMER#00000000")
_filtered("filter_startswith", "part", "select * from part where starts_with(p_name, 'red')", p_name__startswith="red")
_filtered("filter_startswith_any", "part", "select * from part where starts_with(p_name, 'red') or starts_with(p_name, 'blue')", p_name__startswith=("red", "blue"))
_filtered("filter_endswith", "part", "select * from part where ends_with(p_name, 'bolt')", p_name__endswith="bolt")
_filtered("filter_and", "customer", "select * from customer where c_mktsegment = 'BUILDING' and c_acctbal >= 1000 and c_nationkey < 10", c_mktsegment="BUILDING", c_acctbal__gte=1000, c_nationkey__lt=10)
_filtered("filter_type_mismatch", "part", "select * from part where false", p_size="7")
_filtered("filter_exists_column", "nation", "select * from nation", n_name__exists=True)
_filtered("filter_exists_no_column", "nation", "select * from nation where false", other__exists=True)
_filtered("get_by_id", "customer", "select * from customer where c_custkey = 42", c_custkey=42)
_filtered("documents_contains", "documents", "select * from documents where contains(text, 'token')", text__contains="token")


class _Props(Query):
    """Events whose JSON ``props`` are the document."""

    def __init__(self, frame: DataFrame):
        super().__init__(frame.withColumn("_doc", F.try_parse_json("props")))

    def _resolve(self, name):
        from sheaf.plans.predicates import VariantField

        return VariantField(self._frame["_doc"], name)


def _props(spark: SparkSession, d: str, third: str | None) -> _Props:
    events = read(spark, d, "events")
    if third is not None:
        events = events.withColumn("props", F.when(F.col("event_id") % 3 == 0, F.lit(third)).otherwise(F.col("props")))
    return _Props(events)


@_query("filter_exists_true", "select event_id from events where event_id % 3 <> 0")
def _exists_true(spark, d):
    return _props(spark, d, '{"z":null}').filter(k__exists=True).to_df().select("event_id")


@_query("filter_exists_false", "select event_id from events where event_id % 3 = 0")
def _exists_false(spark, d):
    return _props(spark, d, '{"z":null}').filter(k__exists=False).to_df().select("event_id")


@_query("filter_exists_jsonnull", "select event_id from events")
def _exists_null(spark, d):
    return _props(spark, d, '{"k":null}').filter(k__exists=True).to_df().select("event_id")


@_query("json_field_filter", "select event_id, props from events where cast(json_extract_string(props, '$.k') as bigint) > 50")
def _json_filter(spark, d):
    return _props(spark, d, None).filter(k__gt=50).to_df().select("event_id", "props")


@_query("json_field_ne_missing", "select event_id from events where event_id % 3 = 0 or cast(json_extract_string(props, '$.k') as bigint) <> 7")
def _json_ne(spark, d):
    return _props(spark, d, '{"z":1}').filter(k__ne=7).to_df().select("event_id")


@_query("sort_asc_topk", "select * from customer order by c_acctbal asc nulls last, c_custkey limit 10")
def _topk(spark, d):
    return from_df(read(spark, d, "customer"), "c_custkey").sort("c_acctbal").limit(10).to_df()


@_query("sort_desc_topk", f"select o_orderkey, p from {_ORDERS_P} order by p desc nulls first, o_orderkey limit 2500")
def _desc_topk(spark, d):
    return from_df(_orders_p(spark, d).select("o_orderkey", "p"), "o_orderkey").sort("p", descending=True).limit(2500).to_df()


@_query("sort_desc_nulls_last", f"select o_orderkey, p from {_ORDERS_P} order by p desc nulls last, o_orderkey limit 2500")
def _desc_last(spark, d):
    return from_df(_orders_p(spark, d).select("o_orderkey", "p"), "o_orderkey").sort("p", descending=True, nulls="last").limit(2500).to_df()


@_query("offset_limit", "select * from orders order by o_totalprice desc nulls first, o_orderkey limit 50 offset 100")
def _offset_limit(spark, d):
    return from_df(read(spark, d, "orders"), "o_orderkey").sort("o_totalprice", descending=True).offset(100).limit(50).to_df()


@_query("offset_only", "select * from customer order by c_custkey offset 1490")
def _offset(spark, d):
    return from_df(read(spark, d, "customer"), "c_custkey").offset(1490).to_df()


@_query("limit_zero", "select * from customer limit 0")
def _limit_zero(spark, d):
    return from_df(read(spark, d, "customer")).limit(0).to_df()


@_query("natural_order_limit", "select * from orders order by o_orderkey limit 20")
def _natural(spark, d):
    return from_df(read(spark, d, "orders"), "o_orderkey").limit(20).to_df()


@_query("sort_mixed_fallback", "select event_id, case when event_id % 2 = 0 then cast(event_id as varchar) else event_type end as m from events order by m nulls last, event_id limit 40")
def _mixed(spark, d):
    from sheaf.plans.predicates import VariantField

    text = F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    events = read(spark, d, "events").select("event_id", F.parse_json(text).alias("v"))  # numbers and strings mixed
    key = VariantField(F.col("v"), None).pystr()
    return from_df(events.select("event_id", key.alias("m")), "event_id").sort("m").limit(40).to_df()


@_query("first", "select * from orders where o_orderstatus = 'F' order by o_orderdate, o_orderkey limit 1")
def _first(spark, d):
    return from_df(read(spark, d, "orders"), "o_orderkey").filter(o_orderstatus="F").sort("o_orderdate").limit(1).to_df()


@_query("count", "select count(*) as n from orders where o_orderstatus = 'F'")
def _count(spark, d):
    return from_df(read(spark, d, "orders")).filter(o_orderstatus="F").to_df().agg(F.count(F.lit(1)).alias("n"))


@_query("exists", "select count(*) > 0 as e from orders where o_totalprice > 1e9")
def _exists(spark, d):
    return from_df(read(spark, d, "orders")).filter(o_totalprice__gt=1e9).limit(1).to_df().agg((F.count(F.lit(1)) > 0).alias("e"))


@_query("pluck_one", "select n_name from nation")
def _pluck_one(spark, d):
    return from_df(read(spark, d, "nation"))._plucked(("n_name",))


@_query("pluck_many", "select n_name, n_regionkey from nation")
def _pluck_many(spark, d):
    return from_df(read(spark, d, "nation"))._plucked(("n_name", "n_regionkey"))


def _live_users(spark, d):
    return changelog.live(read(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "error", ["event_id", "event_type", "value"])


@_query("latest_live", f"select user_id, event_id, event_type, value from {_LATEST} where rn = 1 and event_type <> 'error'")
def _latest_live(spark, d):
    return _live_users(spark, d).select("user_id", "event_id", "event_type", "value")


@_query("latest_order", f"select user_id, value from {_LATEST} where rn = 1 and event_type <> 'error' order by fs limit 20")
def _latest_order(spark, d):
    return from_df(_live_users(spark, d), "first_seq").limit(20).to_df().select("user_id", "value")


@_query("get_by_field_strkey", "select * from part where cast(p_size as varchar) = '7' order by p_partkey limit 1")
def _strkey(spark, d):
    from sheaf.functions.text import py_str

    part = read(spark, d, "part")
    return from_df(part.where(py_str(F.col("p_size"), part.schema["p_size"].dataType) == "7"), "p_partkey").limit(1).to_df()


@_query("index_build", "select cast(n_regionkey as varchar) as value, list(n_nationkey order by n_nationkey) as ids from nation group by 1")
def _index(spark, d):
    return changelog.field_index(read(spark, d, "nation"), "n_regionkey", "n_nationkey")


@_query("index_rows", "select cast(n_regionkey as varchar) as value, n_nationkey from nation")
def _index_rows(spark, d):
    return changelog.index_rows(read(spark, d, "nation"), "n_regionkey", "n_nationkey")


@_query("unique_violations", "select p_name, count(*) as n from part group by 1 having count(*) > 1")
def _unique(spark, d):
    return changelog.unique_violations(read(spark, d, "part"), "p_name")


@_query("update_patch", "select c_custkey, c_name, c_nationkey, c_acctbal, case when c_custkey in (1, 2, 3) then 'PATCHED' else c_mktsegment end as c_mktsegment from customer")
def _update(spark, d):
    return changelog.patch(read(spark, d, "customer"), F.col("c_custkey").isin(1, 2, 3), c_mktsegment="PATCHED")


@_query("delete_many", "select * from customer where c_custkey not in (1, 2, 3)")
def _delete(spark, d):
    return changelog.without(read(spark, d, "customer"), "c_custkey", [1, 2, 3])


@_query(
    "schema_validate",
    "select c_custkey, list_filter([case when c_acctbal < 0 then 'min' end, case when c_mktsegment not in ('BUILDING', 'MACHINERY') then 'choices' end, case when length(c_name) > 20 then 'maxlen' end], lambda x: x is not null) as errors from customer",
)
def _validate(spark, d):
    schema = Schema(c_acctbal=Field(type=float, min_value=0), c_mktsegment=Field(choices=["BUILDING", "MACHINERY"]), c_name=Field(type=str, max_length=20))
    return schema.with_errors(read(spark, d, "customer")).select("c_custkey", "errors")


@_query("default_fill", f"select o_orderkey, coalesce({_P}, 'none') as p from orders")
def _default(spark, d):
    return Schema(p=Field(default="none")).fill_defaults(_orders_p(spark, d)).select("o_orderkey", "p")


@_query("wal_pending", "select user_id, event_id, event_type from (select *, max(case when event_type = 'signup' then event_id end) over (partition by user_id) as cp from events) where cp is null or event_id > cp")
def _pending(spark, d):
    return changelog.pending(read(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "signup").select("user_id", "event_id", "event_type")


@_query("stats", "select count(*) as record_count, max(o_orderkey) as last_id from orders")
def _stats(spark, d):
    return changelog.stats(read(spark, d, "orders"), "o_orderkey")
