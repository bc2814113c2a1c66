"""Constants and native columns: equality is that of canonical texts, filters stay on native columns where they can.

Whole numbers, booleans and strings keep their types inside plans: their canonical texts differ exactly where they do.
Columns of any other type become their text where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Kinds of columns in plans: "bigint", "boolean", "string".
KINDS = {"bigint": T.LongType(), "boolean": T.BooleanType(), "string": T.StringType()}


def kind_of(dtype: T.DataType) -> str:
    return "bigint" if isinstance(dtype, WHOLE) else "boolean" if isinstance(dtype, T.BooleanType) else "string"


def native(column: Column, dtype: T.DataType) -> Column:
    """The column in its kind."""
    kind = kind_of(dtype)
    return column if dtype == KINDS[kind] else column.cast(kind)


def equals(column: Column, kind: str, constant: str) -> Column:
    """Whether a column's text is that constant, as a comparison that can be pushed to the source."""
    if kind == "string":
        return column == F.lit(constant)
    if kind == "boolean":
        return column == F.lit(constant == "true") if constant in ("true", "false") else F.lit(False)
    try:
        value = int(constant)
    except ValueError:
        return F.lit(False)
    return column == F.lit(value) if str(value) == constant and -(1 << 63) <= value < 1 << 63 else F.lit(False)


def join_kind(*kinds: str) -> str:
    """The kind in which columns of these kinds can be compared."""
    return kinds[0] if len(set(kinds)) == 1 else "string"


def as_kind(column: Column, have: str, want: str) -> Column:
    return column if have == want else column.cast(want)
