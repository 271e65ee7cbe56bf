"""``py_str``: Python's ``str()`` of a value, as a Spark expression.

Unique constraints, lookups by field value and the mixed-type sort compare
values by this spelling.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def py_float(x: Column) -> Column:
    """Python's ``repr`` of a double: exponents from 1e16 up and below 1e-4, at least two exponent digits."""
    java = F.abs(x).cast("string")
    sign = F.when((x < 0) | (x.cast("string") == "-0.0"), F.lit("-")).otherwise(F.lit(""))
    mantissa, power = F.split(java, "E").getItem(0), F.coalesce(F.get(F.split(java, "E"), F.lit(1)).cast("int"), F.lit(0))
    lead = F.regexp_replace(mantissa, r"\.0$", "")
    digits = F.regexp_replace(lead, r"\.", "")
    n = F.length(digits)
    large = F.when(n - 1 <= power, F.concat(digits, F.repeat(F.lit("0"), power - n + 1), F.lit(".0"))).otherwise(
        F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2))
    )
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    scientific = F.concat(lead, F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(power).cast("string"), 2, "0"))
    scientific = F.when(F.abs(power) > 99, F.concat(lead, F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.abs(power).cast("string"))).otherwise(scientific)
    body = F.when(power == 0, java).when((power > 0) & (power < 16), large).when((power < 0) & (power >= -4), small).otherwise(scientific)
    return (
        F.when(x.isNull(), F.lit(None).cast("string")).when(F.isnan(x), F.lit("nan"))
        .when(x == float("inf"), F.lit("inf")).when(x == float("-inf"), F.lit("-inf")).otherwise(F.concat(sign, body))
    )


def py_str(c: Column, kind: T.DataType) -> Column:
    """``str(value)`` of a typed column; null stays null."""
    if isinstance(kind, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return py_float(c.cast("double"))
    return c.cast("string")
