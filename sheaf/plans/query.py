"""Queries: a builder whose every state is one DataFrame plan.

Order of execution is fixed: filter, sort, offset, limit, projection. The
builder changes itself and returns itself. Without a sort, rows come in
natural order, the order in which records first appeared; a sort is stable
over it. Ascending sorts put missing values last, descending ones first
(``nulls`` of ``sort`` overrides that).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions.scalars import public_view
from sheaf.plans.predicates import TypedField, VariantField, compile_predicate, parse

META = ("_id", "_created", "_updated", "_deleted")


class Query:
    """Filters, one sort, offset and limit over a frame."""

    def __init__(self, frame: DataFrame, strip_meta: bool = True, order: tuple[str, ...] = (), strict: bool = True):
        self._frame, self._strip, self._order, self._strict = frame, strip_meta, order, strict
        self._tests: list[tuple[str, object]] = []
        self._sort: tuple[str, bool, str | None] | None = None
        self._offset, self._limit = 0, None

    # building

    def filter(self, **conditions) -> Query:
        for key, target in conditions.items():
            self._compile(key, target)  # bad operators and operands fail here
        self._tests += conditions.items()
        return self

    def sort(self, field: str, descending: bool = False, nulls: str | None = None) -> Query:
        if nulls not in (None, "first", "last"):
            raise ValueError("nulls is 'first' or 'last'")
        self._sort = (field, descending, nulls)
        return self

    def limit(self, n: int) -> Query:
        if n < 0:
            raise ValueError("limit must not be negative")
        self._limit = n
        return self

    def offset(self, n: int) -> Query:
        if n < 0:
            raise ValueError("offset must not be negative")
        self._offset = n
        return self

    # planning; a subclass for documents overrides the next four

    def _resolve(self, name: str) -> TypedField | VariantField:
        for f in self._frame.schema:
            if f.name == name:
                column = self._frame[f"`{name.replace('`', '``')}`"]
                return VariantField(column, None) if isinstance(f.dataType, T.VariantType) else TypedField(column, f.dataType)
        if name == "id" and "_id" in self._frame.columns:
            return self._resolve("_id")
        return TypedField(None, None)

    def _sort_keys(self, name: str) -> list[Column]:
        field = self._resolve(name)
        return [] if field.absent else [field.c]

    def _project(self, frame: DataFrame) -> DataFrame:
        if not self._strip or not any(c.startswith("_") for c in frame.columns):
            return frame
        kept = [frame[f"`{c}`"] for c in frame.columns if not c.startswith("_") and not (c == "id" and "_id" in frame.columns)]
        return frame.select(*kept, *([F.col("_id").alias("id")] if "_id" in frame.columns else []))

    def _record(self, row) -> dict:
        return row.asDict(recursive=True)

    def _compile(self, key: str, target) -> Column:
        return compile_predicate(key, target, self._resolve, self._strict)

    def _filtered(self) -> DataFrame:
        out = self._frame
        for key, target in self._tests:
            out = out.where(self._compile(key, target))
        return out

    def _ordered(self) -> DataFrame:
        keys: list[Column] = []
        if self._sort:
            field, descending, nulls = self._sort
            nulls = nulls or ("first" if descending else "last")
            how = f"{'desc' if descending else 'asc'}_nulls_{nulls}"
            keys = [getattr(k, how)() for k in self._sort_keys(field)]
        keys += [F.col(f"`{c}`").asc() for c in self._order]
        frame = self._filtered()
        return frame.orderBy(*keys) if keys else frame

    def to_df(self) -> DataFrame:
        """The query's plan, open to any other DataFrame operation."""
        return self._project(self._paged())

    def _paged(self) -> DataFrame:
        out = self._ordered()
        if self._offset:
            out = out.offset(self._offset)
        return out if self._limit is None else out.limit(self._limit)

    def explain(self, mode: str = "formatted") -> None:
        self.to_df().explain(mode)

    # terminals

    def all(self) -> list[dict]:
        return [self._record(r) for r in self.to_df().collect()]

    def first(self) -> dict | None:
        out = self._ordered().offset(self._offset)
        rows = self._project(out.limit(1 if self._limit is None else min(1, self._limit))).collect()
        return self._record(rows[0]) if rows else None

    def count(self) -> int:
        """Matches of the filters; sort, offset and limit don't matter."""
        return self._filtered().count()

    def exists(self) -> bool:
        return not self._filtered().isEmpty()

    def pluck(self, *fields: str) -> list:
        """Values of one field, or tuples of several, of the projected records; missing ones are None."""
        records = self.all() if not fields else [self._record(r) for r in self._plucked(fields).collect()]
        if len(fields) == 1:
            return [r.get(fields[0]) for r in records]
        return [tuple(r.get(f) for f in fields) for r in records]

    def _plucked(self, fields: tuple[str, ...]) -> DataFrame:
        out = self.to_df()
        return out.select(*[F.col(f"`{f}`") for f in dict.fromkeys(fields) if f in out.columns])

    def __iter__(self) -> Iterator[dict]:
        for row in self.to_df().toLocalIterator():
            yield self._record(row)

    def __len__(self) -> int:
        return self.count()

    def __repr__(self) -> str:
        return f"<{type(self).__name__} predicates={len(self._tests)} sort={self._sort and self._sort[0]!r} limit={self._limit}>"


class DocumentQuery(Query):
    """A query over live records: metadata columns, ``doc`` as VARIANT and as JSON text."""

    def __init__(self, frame: DataFrame, strip_meta: bool = True, strict: bool = True):
        super().__init__(frame, strip_meta, ("_first",), strict)

    def _resolve(self, name: str):
        if name == "id":
            name = "_id"
        if name in META:
            return TypedField(self._frame[name], self._frame.schema[name].dataType)
        return VariantField(self._frame["doc"], name)

    def _sort_keys(self, name: str) -> list[Column]:
        field = self._resolve(name)
        if isinstance(field, TypedField):
            return [field.c]
        family = (
            F.when(field.is_null(), F.lit(None).cast("string")).when(field.is_number() | field.is_bool(), F.lit("num"))
            .when(field.is_string(), F.lit("str")).otherwise(F.lit("other"))
        )
        found = set(self._filtered().agg(F.collect_set(family)).first()[0])  # three values at most
        if found == {"str"}:
            return [field.string()]
        if found == {"num"}:
            inexact = F.when(field.is_bool(), field._get("boolean").cast("double")).otherwise(field._get("double"))
            # integers that one double stands for are told apart; equal numbers of other types stay equal
            exact = F.when(field.is_integral(), field._get("decimal(38,0)")).otherwise(inexact.try_cast("decimal(38,0)"))
            return [F.when(field.is_null(), F.lit(None).cast("double")).otherwise(inexact), exact]
        return [F.when(~field.is_null(), field.pystr())] if found else []

    def _project(self, frame: DataFrame) -> DataFrame:
        return frame.select("_id", "_created", "_updated", "_deleted", "_json")

    def _record(self, row) -> dict:
        meta = {k: row[k] for k in META}
        record = meta | json.loads(row["_json"])
        return public_view(record) if self._strip else record

    def _plucked(self, fields):
        return self.to_df()

    def typed(self, schema: str | T.StructType) -> DataFrame:
        """The matching documents with typed columns, for joins and aggregates."""
        out = self._paged()
        kind = schema if isinstance(schema, str) else schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
        return out.select(F.from_json("_json", kind).alias("d"), "_id").select("d.*", F.col("_id").alias("id"))


def from_df(frame: DataFrame, order: tuple[str, ...] | list[str] | str = (), strip_meta: bool = True, strict: bool = True) -> Query:
    """A query over a typed frame; ``order`` names the columns of its natural order."""
    return Query(frame, strip_meta, (order,) if isinstance(order, str) else tuple(order), strict)


__all__ = ["DocumentQuery", "Query", "from_df", "parse"]
