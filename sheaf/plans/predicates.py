"""The filter language, compiled to Spark expressions.

A predicate is ``field__op=value`` (or ``field=value`` for equality). The same
rules serve typed columns and fields of a VARIANT document; a field object
answers what a value is and gives it in the wanted form. On typed columns the
result is a plain comparison that the scan can push down.

Values compare as Python compares them: a missing field is None; booleans are
numbers; numbers never equal strings; NaN equals nothing. Ordering values of
incompatible types is an error, raised by the expression for the row that has
them (``strict=False``: no match).
"""

from __future__ import annotations

import datetime
import decimal
import json
import math
import re
from collections.abc import Callable, Container

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions.text import py_float, py_str

NUMBERS = (bool, int, float, decimal.Decimal)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_BEST = 2**63


def yes() -> Column:
    return F.lit(True)


def no() -> Column:
    return F.lit(False)


class TypedField:
    """A column of a typed table. A null can't be told from a missing value there."""

    def __init__(self, column: Column | None, kind: T.DataType | None):
        self.c, self.type = column, kind

    @property
    def absent(self) -> bool:
        return self.c is None

    def is_null(self) -> Column:
        return yes() if self.absent else self.c.isNull()

    def present(self) -> Column:
        return F.lit(not self.absent)

    def _family(self) -> str:
        if self.absent:
            return "null"
        if isinstance(self.type, T.BooleanType):
            return "bool"
        if isinstance(self.type, T.NumericType):
            return "num"
        if isinstance(self.type, T.StringType):
            return "str"
        if isinstance(self.type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return "time"
        return "nested"

    def equals(self, t) -> Column:
        """``x == t`` for a ``t`` that isn't None; never null."""
        family = self._family()
        if isinstance(t, float) and math.isnan(t):
            return no()
        if family == "bool" and isinstance(t, NUMBERS):
            return self.c.eqNullSafe(F.lit(bool(t))) if t in (0, 1) else no()
        if family == "num" and isinstance(t, NUMBERS):
            t = int(t) if isinstance(t, bool) else t
            if isinstance(self.type, _INTEGRAL) and (t != int(t) if not (isinstance(t, float) and math.isinf(t)) else True):
                return no()
            if isinstance(self.type, _INTEGRAL):
                t = int(t)
                return self.c.eqNullSafe(F.lit(t)) if -_BEST <= t < _BEST else no()
            return self.c.eqNullSafe(F.lit(t) if not isinstance(t, int) or -_BEST <= t < _BEST else F.lit(float(t)))
        if family == "str" and isinstance(t, str) or family == "time" and isinstance(t, (datetime.date, datetime.datetime)):
            return self.c.eqNullSafe(F.lit(t))
        if family == "nested" and isinstance(t, (list, tuple, dict)):
            return F.coalesce(F.to_json(F.struct(self.c.alias("v"))) == json.dumps({"v": t}, ensure_ascii=False, separators=(",", ":")), no())
        return no()

    def compare(self, t, apply: Callable[[Column, Column], Column], greater: bool, strict: bool) -> Column:
        family = self._family()
        if family == "null":
            return no()
        if isinstance(t, float) and math.isnan(t) and family in ("num", "bool"):
            return no()
        if family == "bool" and isinstance(t, NUMBERS):
            return F.coalesce(apply(self.c.cast("int"), F.lit(t if not isinstance(t, bool) else int(t))), no())
        if family == "num" and isinstance(t, NUMBERS):
            t = int(t) if isinstance(t, bool) else t
            hit = apply(self.c, F.lit(t if not isinstance(t, int) or -_BEST <= t < _BEST else float(t)))
            if greater and isinstance(self.type, (T.FloatType, T.DoubleType)):
                hit = hit & ~F.isnan(self.c)  # Spark ranks NaN above all numbers
            return hit
        if family == "str" and isinstance(t, str) or family == "time" and isinstance(t, (datetime.date, datetime.datetime)):
            return apply(self.c, F.lit(t))
        if not strict:
            return no()
        return self.c.isNotNull() & F.raise_error(F.lit(f"cannot order {self.type.simpleString()} and {type(t).__name__}")).cast("boolean")

    def string(self) -> Column | None:
        return self.c if self._family() == "str" else None

    def pystr(self) -> Column:
        return F.lit(None).cast("string") if self.absent else py_str(self.c, self.type)


class VariantField:
    """A field of a VARIANT object."""

    def __init__(self, doc: Column, name: str | None):
        if name is None:  # the value itself
            self.v = doc
        elif re.fullmatch(r"[A-Za-z0-9_ .\-]+", name):
            self.v = F.variant_get(doc, f'$["{name}"]', "variant")
        else:  # a name that a path can't quote
            self.v = F.get(F.transform(F.filter(F.map_entries(doc.cast("map<string,variant>")), lambda e: e["key"] == name), lambda e: e["value"]), F.lit(0))
        self.kind = F.schema_of_variant(self.v)

    def present(self) -> Column:
        return self.v.isNotNull()

    def is_null(self) -> Column:
        return F.coalesce(self.kind == "VOID", yes())

    def _is(self, *kinds: str) -> Column:
        return F.coalesce(self.kind.rlike(f"^({'|'.join(kinds)})"), no())

    def is_number(self) -> Column:
        return F.coalesce(self.kind.isin("BIGINT", "DOUBLE", "FLOAT") | self.kind.startswith("DECIMAL"), no())

    def is_integral(self) -> Column:
        return F.coalesce((self.kind == "BIGINT") | (self.kind.startswith("DECIMAL") & self.kind.endswith(",0)")), no())

    def is_string(self) -> Column:
        return F.coalesce(self.kind == "STRING", no())

    def is_bool(self) -> Column:
        return F.coalesce(self.kind == "BOOLEAN", no())

    def _get(self, kind: str) -> Column:
        return F.try_variant_get(self.v, "$", kind)

    def _numeric(self, t, apply) -> Column:
        """``apply`` on value and ``t`` where the value is a number or boolean, exact if both are integral."""
        t = int(t) if isinstance(t, bool) else t
        as_double = F.when(self.is_bool(), self._get("boolean").cast("double")).otherwise(self._get("double"))
        try:
            inexact = apply(as_double, F.lit(float(t)))
        except OverflowError:
            inexact = apply(as_double, F.lit(math.inf if t > 0 else -math.inf))
        if isinstance(t, int) and abs(t) < 10**38:
            exact = apply(self._get("decimal(38,0)"), F.lit(decimal.Decimal(t)).cast("decimal(38,0)"))
            return F.when(self.is_integral(), exact).otherwise(inexact)
        return inexact

    def _small(self, t, apply) -> Column | None:
        """``apply`` where the value is a 64-bit integer, the common case, with a plain comparison; None if ``t`` isn't one."""
        if isinstance(t, int) and -_BEST <= t < _BEST:
            return apply(self._get("bigint"), F.lit(int(t)).cast("bigint"))
        return None

    def equals(self, t) -> Column:
        if isinstance(t, float) and math.isnan(t):
            return no()
        if isinstance(t, NUMBERS):
            slow = (self.is_number() | self.is_bool()) & self._numeric(t, lambda a, b: a == b)
            fast = self._small(t, lambda a, b: a == b)
            return F.coalesce(slow if fast is None else F.when(self.kind == "BIGINT", fast).otherwise(slow), no())
        if isinstance(t, str):
            return F.coalesce(self.is_string() & (self._get("string") == t), no())
        if isinstance(t, (list, tuple, dict)):
            same = F.to_json(F.parse_json(F.lit(json.dumps(t, ensure_ascii=False))))
            return F.coalesce(self._is("ARRAY" if not isinstance(t, dict) else "OBJECT") & (F.to_json(self.v) == same), no())
        return no()

    def compare(self, t, apply, greater: bool, strict: bool) -> Column:
        if isinstance(t, NUMBERS):
            fits = self.is_number() | self.is_bool()
            hit = no() if isinstance(t, float) and math.isnan(t) else self._numeric(t, apply)
        elif isinstance(t, str):
            fits, hit = self.is_string(), apply(self._get("string"), F.lit(t))
        else:
            fits, hit = no(), no()
        wrong = F.raise_error(F.concat(F.lit("cannot order "), self.kind, F.lit(f" and {type(t).__name__}"))).cast("boolean") if strict else no()
        rest = F.when(self.is_null(), no()).when(fits, hit).otherwise(wrong)
        fast = self._small(t, apply)
        return F.coalesce(rest if fast is None else F.when(self.kind == "BIGINT", fast).otherwise(rest), no())

    def string(self) -> Column:
        return F.when(self.is_string(), self._get("string"))

    def pystr(self) -> Column:
        """Python's ``str()``; null where missing, ``None`` where null; lists and dicts as JSON."""
        return (
            F.when(self.v.isNull(), F.lit(None).cast("string")).when(self.kind == "VOID", F.lit("None"))
            .when(self.is_string(), self._get("string")).when(self.is_bool(), F.initcap(self._get("string")))
            .when(self.is_integral(), self._get("string")).when(self.is_number(), py_float(self._get("double"))).otherwise(F.to_json(self.v))
        )


Field = TypedField | VariantField


def _text(t, op: str) -> str:
    if not isinstance(t, str):
        raise TypeError(f"{op} takes a string, not {type(t).__name__}")
    return t


def _any(tests: list[Column]) -> Column:
    out = no()
    for i, t in enumerate(tests):
        out = t if i == 0 else out | t
    return out


def _equals(x: Field, t) -> Column:
    return x.is_null() if t is None else x.equals(t)


def _member(x: Field, t: Container, strict: bool) -> Column:
    """``x in t``, never null."""
    if isinstance(t, str):
        s = x.string()
        hit = no() if s is None else F.coalesce(F.lit(t).contains(s), no())
        if not strict:
            return hit
        is_text = no() if s is None else s.isNotNull()
        return F.when(hit, yes()).when(is_text | x.is_null(), no()).otherwise(F.raise_error(F.lit("a string only contains strings")).cast("boolean"))
    values = list(t)
    if isinstance(x, TypedField) and not x.absent and values:
        # one IN expression for the values that fit the column plainly
        plain = [v for v in values if isinstance(v, str) and isinstance(x.type, T.StringType) or isinstance(v, int) and not isinstance(v, bool) and isinstance(x.type, _INTEGRAL) and -_BEST <= v < _BEST]
        rest = [v for v in values if v not in plain or isinstance(v, bool)]
        tests = [F.coalesce(x.c.isin(plain), no())] if plain else []
        return _any(tests + [_equals(x, v) for v in rest])
    return _any([_equals(x, v) for v in values])


def _affix(method: str, op: str):
    def make(x: Field, t, strict: bool) -> Column:
        options = [_text(v, op) for v in (t if isinstance(t, tuple) else (t,))]
        s = x.string()
        return no() if s is None else _any([F.coalesce(getattr(s, method)(v), no()) for v in options])

    return make


def _contains(x: Field, t, strict: bool) -> Column:
    s = x.string()
    t = _text(t, "contains")
    return no() if s is None else F.coalesce(s.contains(t), no())


def _icontains(x: Field, t, strict: bool) -> Column:
    s = x.string()
    t = _text(t, "icontains").lower()
    return no() if s is None else F.coalesce(F.lower(s).contains(t), no())


def _ordered(apply, greater: bool):
    return lambda x, t, strict: x.compare(t, apply, greater, strict)


OPERATORS: dict[str, Callable[[Field, object, bool], Column]] = {
    "eq": lambda x, t, strict: _equals(x, t),
    "ne": lambda x, t, strict: ~_equals(x, t),
    "gt": _ordered(lambda a, b: a > b, True),
    "gte": _ordered(lambda a, b: a >= b, True),
    "lt": _ordered(lambda a, b: a < b, False),
    "lte": _ordered(lambda a, b: a <= b, False),
    "in": _member,
    "nin": lambda x, t, strict: ~_member(x, t, strict),
    "contains": _contains,
    "icontains": _icontains,
    "startswith": _affix("startswith", "startswith"),
    "endswith": _affix("endswith", "endswith"),
    "exists": lambda x, t, strict: x.present() if t else ~x.present(),
}


def parse(key: str) -> tuple[str, str]:
    """(field, operator) of a keyword; the last ``__`` divides them."""
    field, mark, op = key.rpartition("__")
    if not mark:
        return key, "eq"
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op!r} in {key!r}; operators are {', '.join(OPERATORS)}")
    return field, op


def compile_predicate(key: str, target, resolve: Callable[[str], Field], strict: bool = True) -> Column:
    field, op = parse(key)
    return OPERATORS[op](resolve(field), target, strict)
