"""Record schemas: checked on the driver for single records, as expressions for frames."""

from __future__ import annotations

import copy
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.errors import SchemaValidationError


#: Spark types whose values are instances of a Python type once they are a record's.
_SPARK_TYPES: dict[type, tuple[type[T.DataType], ...]] = {
    str: (T.StringType,), bool: (T.BooleanType,), int: (T.IntegralType, T.BooleanType), float: (T.FractionalType,),
    list: (T.ArrayType,), dict: (T.MapType, T.StructType), object: (T.DataType,),
}


def literal(value, kind: T.DataType | None = None) -> Column:
    """A default as a column, of type ``kind`` if that is given; lists and dicts are else VARIANT."""
    if isinstance(value, (list, dict, tuple)):
        text = F.lit(json.dumps(value, ensure_ascii=False))
        return F.parse_json(text) if kind is None or isinstance(kind, T.VariantType) else F.from_json(text, kind)
    return F.lit(value) if kind is None or isinstance(kind, T.VariantType) else F.lit(value).cast(kind)


class Field:
    """Rules for one field. A default (also None) makes the field optional."""

    def __init__(
        self,
        type: type | tuple[type, ...] | None = None,  # noqa: A002
        required: bool = False,
        default=...,
        nullable: bool = False,
        min_value=None,
        max_value=None,
        min_length: int | None = None,
        max_length: int | None = None,
        choices=None,
        validator: Callable[[object], str | None] | None = None,
    ):
        self.type, self.default, self.nullable = type, default, nullable
        self.required = required and default is ...
        self.min_value, self.max_value, self.min_length, self.max_length = min_value, max_value, min_length, max_length
        self.choices, self.validator = None if choices is None else list(choices), validator

    @property
    def has_default(self) -> bool:
        return self.default is not ...

    def validate(self, name: str, value) -> list[str]:
        """Messages of all rules that ``value`` breaks; a wrong type hides the rest."""
        if value is None:
            return [f"{name}: must not be null"] if self.required and not self.nullable else []
        if self.type is not None and not isinstance(value, self.type):
            wanted = self.type if isinstance(self.type, tuple) else (self.type,)
            return [f"{name}: {' or '.join(t.__name__ for t in wanted)} expected, not {type(value).__name__}"]
        found = []
        if isinstance(value, (int, float)):
            if self.min_value is not None and value < self.min_value:
                found.append(f"{name}: {value} is below {self.min_value}")
            if self.max_value is not None and value > self.max_value:
                found.append(f"{name}: {value} is above {self.max_value}")
        if hasattr(value, "__len__"):
            if self.min_length is not None and len(value) < self.min_length:
                found.append(f"{name}: shorter than {self.min_length}")
            if self.max_length is not None and len(value) > self.max_length:
                found.append(f"{name}: longer than {self.max_length}")
        if self.choices is not None and value not in self.choices:
            found.append(f"{name}: {value!r} is not one of {self.choices!r}")
        if self.validator is not None and (message := self.validator(value)):
            found.append(f"{name}: {message}")
        return found

    def fits(self, kind: T.DataType) -> bool:
        """Whether values of a column of this type are of the wanted one; of VARIANT columns nothing is known."""
        if self.type is None or isinstance(kind, (T.VariantType, T.NullType)):
            return True
        wanted = self.type if isinstance(self.type, tuple) else (self.type,)
        return any(isinstance(kind, k) for t in wanted for k in _SPARK_TYPES.get(t, ()))

    def errors(self, name: str, kind: T.DataType | None) -> list[Column]:
        """The same rules on a typed column: a rule's name where it is broken, else null; ``kind`` is None for an absent column.

        A wrong type hides the rules on values, as it does for single records.
        """
        if kind is None:
            return [F.lit("required")] if self.required else []
        c, out = F.col(f"`{name}`"), []
        if self.required and not self.nullable:
            out.append(F.when(c.isNull(), F.lit("required")))
        if not self.fits(kind):
            return [*out, F.when(c.isNotNull(), F.lit("type"))]
        if isinstance(kind, T.NumericType):
            if self.min_value is not None:
                out.append(F.when(c < self.min_value, F.lit("min")))
            if self.max_value is not None:
                out.append(F.when(c > self.max_value, F.lit("max")))
        if isinstance(kind, (T.StringType, T.ArrayType, T.MapType)):
            size = F.length(c) if isinstance(kind, T.StringType) else F.size(c)
            if self.min_length is not None:
                out.append(F.when(size < self.min_length, F.lit("minlen")))
            if self.max_length is not None:
                out.append(F.when(size > self.max_length, F.lit("maxlen")))
        if self.choices is not None:
            out.append(F.when(~c.isin(self.choices), F.lit("choices")))
        if self.validator is not None:
            # by Arrow batches; values keep their Python types, which pandas would change where there are nulls
            check = F.udf(lambda v, f=self.validator: (f(v) or None) if v is not None else None, "string", useArrow=True)
            out.append(check(c))
        return out


class Schema:
    """Named fields; fields that it doesn't name are accepted."""

    def __init__(self, **fields: Field):
        self.fields = fields

    def apply_defaults(self, record: dict) -> dict:
        """A copy with defaults for the fields that are missing (not for nulls)."""
        return record | {k: copy.deepcopy(f.default) for k, f in self.fields.items() if f.has_default and k not in record}

    def validate(self, record: dict, partial: bool = False) -> None:
        found = []
        for name, field in self.fields.items():
            if name in record:
                found += field.validate(name, record[name])
            elif field.required and not partial:
                found.append(f"{name}: required")
        if found:
            raise SchemaValidationError(found)

    def with_errors(self, frame: DataFrame, column: str = "errors") -> DataFrame:
        """``frame`` with an array of the names of broken rules, in declaration order; required fields that it has no column for count in every row."""
        tests = [e for n, f in self.fields.items() for e in f.errors(n, frame.schema[n].dataType if n in frame.columns else None)]
        errors = F.filter(F.array(*tests), lambda x: x.isNotNull()) if tests else F.array().cast("array<string>")
        return frame.withColumn(column, errors)

    def fill_defaults(self, frame: DataFrame) -> DataFrame:
        """Defaults for absent columns and for the nulls of typed ones, in which null and missing are one.

        A default that doesn't fit a column's type isn't put there; the type's error tells.
        """
        new = {}
        for n, f in self.fields.items():
            if not f.has_default:
                continue
            if n not in frame.columns:
                new[n] = literal(f.default)
            elif f.default is not None and f.fits(frame.schema[n].dataType):
                new[n] = F.coalesce(F.col(f"`{n}`"), literal(f.default, frame.schema[n].dataType))
        return frame.withColumns(new)

    def __repr__(self) -> str:
        return f"Schema({', '.join(self.fields)})"
