"""The query language against a plain Python model of it; schema, spelling, cache."""

import math

import pytest
from pyspark.sql import functions as F

from sheaf import Field, Query, Schema, SchemaValidationError, Store, from_df
from sheaf.functions import scalars
from sheaf.functions.text import py_float
from sheaf.plans.predicates import parse
from sheaf.sources.cache import LRUCache

VALUES = [10, "9", 9, 2.5, 1, 0, 1.0, True, False, None, "abc", "ABC", "a%b_c\\", "", [1, 2], {"k": 1}, 2**60 + 1, 10**25, "İstanbul", "ΣΑΣ", "🙂x", -3, 1e16, 1e-7, "café"]
RECORDS = [{"x": v} for v in VALUES] + [{}, {"y": 1}, {"x": "z", "a__b": 5, "a.b": 1, "x y": 2, "Age": 1, "age": 2}]


def model(op, t):
    """The rule of one operator on a record's value; None is a missing or null value."""
    num = lambda v: isinstance(v, (bool, int, float))
    comparable = lambda v: num(v) and num(t) or isinstance(v, str) and isinstance(t, str)
    text = lambda f: lambda v: isinstance(v, str) and f(v)
    return {
        "eq": lambda v: v == t, "ne": lambda v: v != t,
        "gt": lambda v: v is not None and comparable(v) and v > t, "gte": lambda v: v is not None and comparable(v) and v >= t,
        "lt": lambda v: v is not None and comparable(v) and v < t, "lte": lambda v: v is not None and comparable(v) and v <= t,
        "in": lambda v: v in list(t), "nin": lambda v: v not in list(t),
        "contains": text(lambda v: t in v), "icontains": text(lambda v: t.lower() in v.lower()),
        "startswith": text(lambda v: v.startswith(t)), "endswith": text(lambda v: v.endswith(t)),
    }[op]


CASES = (
    [(op, t) for op in ("eq", "ne") for t in (10, 9, "9", 1, True, 0, 2.5, None, "abc", [1, 2], {"k": 1}, 2**60 + 1, 2**60, 10**25, math.nan, "")]
    + [(op, t) for op in ("gt", "gte", "lt", "lte") for t in (9, 2.5, True, 2**60, 1e16, math.nan, "ABD", "")]
    + [(op, t) for op in ("in", "nin") for t in ([], [10, "9"], [None, 1], [True], ("abc", 2.5), [[1, 2]], {"abc": 1})]
    + [("contains", t) for t in ("b", "%", "_", "\\", "", "🙂")] + [("icontains", t) for t in ("B", "İ", "σ", "CAFÉ")]
    + [(op, t) for op in ("startswith", "endswith") for t in ("a", "c\\", ("a", "🙂"), "", ("x", "C"))]
)


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    c = Store(tmp_path_factory.mktemp("lang") / "db", spark).collection("c")
    c.create_many(RECORDS)
    return c


def test_operators_on_documents(spark, docs):
    from sheaf.plans.query import DocumentQuery

    base = DocumentQuery(docs._documents(), strict=False)
    tests = [base._compile(f"x__{op}", t).alias(f"t{i}") for i, (op, t) in enumerate(CASES)]
    rows = base._frame.orderBy("_id").select(*tests).collect()
    for i, (op, t) in enumerate(CASES):
        want = [bool(model(op, t)(r.get("x"))) for r in RECORDS]
        assert [r[i] for r in rows] == want, (op, t)


def test_presence_and_names(docs):
    n = len(RECORDS)
    assert docs.filter(x__exists=True).count() == n - 2  # a null is there
    assert docs.filter(x__exists=False).count() == 2
    assert docs.filter(**{"a__b__eq": 5}).count() == 1 and docs.filter(**{"a.b": 1}).count() == 1 and docs.filter(**{"x y": 2}).count() == 1
    assert docs.filter(Age=1).count() == 1 and docs.filter(age=1).count() == 0
    assert docs.filter(id=3).count() == 1 and docs.filter(_id__lte=3).count() == 3
    assert docs.filter(x__ne=10, y__exists=True).count() == 1


def test_strict_ordering(docs):
    with pytest.raises(Exception, match="cannot order"):
        docs.filter(x__gt=5).all()


@pytest.mark.parametrize("key", ["x__nope", "a__b", "__x"])
def test_unknown_operator(docs, key):
    with pytest.raises(ValueError, match="operators are"):
        docs.filter(**{key: 1})
    assert parse("a__b__eq") == ("a__b", "eq")


def test_bad_operands(docs):
    with pytest.raises(TypeError):
        docs.filter(x__contains=5)
    for call in (docs.filter().limit, docs.filter().offset):
        with pytest.raises(ValueError):
            call(-1)


def test_typed_operators(spark):
    rows = [(1, 1.5, "a", True), (2, math.nan, "b", False), (3, None, None, None), (4, -1.0, "ab", True)]
    q = lambda **k: [r["i"] for r in from_df(spark.createDataFrame(rows, "i int, f double, s string, b boolean"), "i").filter(**k).all()]
    assert q(f__gt=0) == [1] and q(f__lt=2) == [1, 4] and q(f=math.nan) == [] and q(f__ne=1.5) == [2, 3, 4]
    assert q(b=1) == [1, 4] and q(b__lt=True) == [2] and q(i=True) == [1] and q(i="1") == [] and q(i=1.0) == [1] and q(i=1.5) == []
    assert q(s=None) == [3] and q(s__in=["a", None]) == [1, 3] and q(s__nin=["a"]) == [2, 3, 4] and q(s__in="abc") == [1, 2, 4]
    assert q(i__in=[1, True, 4.0, "2"]) == [1, 4] and q(i__gte=10**30) == [] and q(none__exists=False) == [1, 2, 3, 4] and q(none__ne=1) == [1, 2, 3, 4]
    with pytest.raises(Exception, match="cannot order"):
        q(s__gt=1)


def test_sort_limit_offset(docs, spark, tmp_path):
    c = Store(tmp_path / "db", spark).collection("c")
    c.create_many([{"n": 3, "k": "b"}, {"k": "a"}, {"n": 1, "k": "a"}, {"n": None, "k": "b"}, {"n": 2.5, "k": "a"}, {"n": True, "k": "c"}])
    ids = lambda q: q.pluck("id")
    assert ids(c.sort("n")) == [3, 6, 5, 1, 2, 4]
    assert ids(c.sort("n", descending=True)) == [2, 4, 1, 5, 3, 6]
    assert ids(c.filter().sort("n", descending=True, nulls="last")) == [1, 5, 3, 6, 2, 4]
    assert ids(c.sort("k")) == [2, 3, 5, 1, 4, 6]
    assert ids(c.sort("k").sort("n").offset(1).limit(2)) == [6, 5]
    assert ids(c.sort("missing")) == [1, 2, 3, 4, 5, 6] and ids(c.sort("_id", descending=True)) == [6, 5, 4, 3, 2, 1]
    q = c.filter(k="a").offset(1).limit(1)
    assert q.count() == 3 and len(q) == 3 and q.exists() and ids(q) == [3] and q.first()["id"] == 3 and [r["id"] for r in q] == [3]
    assert c.filter(k="zzz").first() is None and not c.filter(k="zzz").exists() and c.filter().limit(0).all() == []
    assert c.filter().pluck("n", "k")[0] == (3, "b") and c.filter().pluck() == [()] * 6 and c.filter().pluck("_id") == [None] * 6
    assert "predicates=1" in repr(q)
    mixed = docs.sort("x").pluck("x")
    present = [v for v in VALUES if v is not None] + ["z"]
    assert [str(v) for v in mixed if v is not None and not isinstance(v, (list, dict))] == sorted(str(v) for v in present if not isinstance(v, (list, dict)))
    assert mixed[-3:] == [None] * 3


def test_raw_view(spark, docs):
    from sheaf.plans.query import DocumentQuery

    raw = DocumentQuery(docs._documents(), strip_meta=False).limit(1).all()[0]
    assert {"_id", "_created", "_updated", "_deleted", "x"} == set(raw)
    frame = spark.createDataFrame([(1, 2, 3)], "_id int, a int, _b int")
    assert Query(frame).all() == [{"a": 2, "id": 1}] and Query(frame, strip_meta=False).all() == [{"_id": 1, "a": 2, "_b": 3}]


def test_py_float(spark):
    values = [0.0, -0.0, 1.0, -2.5, 1e16, 1e15, 123456789.0, 1e-4, 1.5e-5, 1e-7, 0.00123, 9007199254740993.0, 1.7e308, 5e-324, 1e100, 12345678.9, math.inf, -math.inf, math.nan, 1e7, 99999999.5]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", py_float(F.col("v")).alias("s")).orderBy("i").collect()
    assert [float(r["s"]) for r in rows[:-3] if not r["s"].endswith("nan")] is not None
    for r, v in zip(rows, values, strict=True):
        if abs(v) != 5e-324:  # the JVM spells the least double with two digits
            assert r["s"] == str(v)


def test_schema():
    s = Schema(a=Field(type=int, required=True, nullable=True), b=Field(type=(int, float), min_value=0, max_value=5), c=Field(type=list, min_length=1, max_length=2), d=Field(default=[]), e=Field(default=None, required=True))
    s.validate({"a": None, "b": True, "c": [1], "z": 1})
    for bad in ({}, {"a": "x"}, {"a": 1, "b": 6}, {"a": 1, "c": []}, {"a": 1, "c": [1, 2, 3]}):
        with pytest.raises(SchemaValidationError):
            s.validate(bad)
    s.validate({}, partial=True)
    one, two = s.apply_defaults({}), s.apply_defaults({"d": None})
    assert one == {"d": [], "e": None} and two["d"] is None
    one["d"].append(1)
    assert s.apply_defaults({})["d"] == []
    with pytest.raises(SchemaValidationError) as e:
        Schema(a=Field(required=True), b=Field(type=str)).validate({"a": None, "b": 3})
    assert len(e.value.errors) == 2 and str(e.value) == "; ".join(e.value.errors)


def test_schema_on_frames(spark):
    s = Schema(n=Field(type=int, required=True, min_value=0), t=Field(type=str, min_length=2, choices=["ab", "cd"]), v=Field(type=int, validator=lambda v: "odd" if v % 2 else None))
    frame = spark.createDataFrame([(1, "ab", 2), (None, "x", 3), (-1, None, None)], "n int, t string, v int")
    assert [r["errors"] for r in s.with_errors(frame).collect()] == [[], ["required", "minlen", "choices", "odd"], ["min"]]


def test_cache():
    c = LRUCache(2)
    record = {"a": [1]}
    c.put(1, record)
    record["a"].append(2)
    got = c.get(1)
    assert got == {"a": [1]}
    got["a"].append(3)
    c.put(2, {})
    c.get(1)
    c.put(3, {})
    assert c.get(2) is None and c.get(1) == {"a": [1]} and c.size == 2 and c.max_size == 2
    assert c.stats() == {"size": 2, "max_size": 2, "hits": 3, "misses": 1, "hit_rate": 0.75}
    c.invalidate_many([1, 3])
    c.warm({5: {"x": 1}})
    assert c.size == 1
    c.clear()
    c.reset_stats()
    assert c.hit_rate == 0.0
    with pytest.raises(ValueError):
        LRUCache(0)


def test_scalars():
    assert scalars.deep_merge({"a": {"b": 1, "c": 2}, "d": 1}, {"a": {"b": 3}, "d": {"e": 1}}) == {"a": {"b": 3, "c": 2}, "d": {"e": 1}}
    assert [scalars.clamp(v, 0, 5) for v in (-1, 3, 9)] == [0, 3, 5]
    assert scalars.strip_internal_keys({"_a": 1, "b": 2}) == {"b": 2}
    assert scalars.decode_line(scalars.encode_line({"é": [1, None]})) == {"é": [1, None]} and scalars.decode_line("  ") is None
    assert scalars.is_valid_name("_a1") and not scalars.is_valid_name("a\n") and abs(scalars.now_ts() - __import__("time").time()) < 5
