"""Codes in a source that stand for names in programs."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..terms import text_of
from .canonical import equals, kind_of


@dataclass(frozen=True)
class Encoder:
    """A mapping of a column's values to names; a value without a name keeps its text."""

    names: tuple[tuple[str, str], ...]

    @classmethod
    def of(cls, names: Mapping[object, str]) -> Encoder:
        return cls(tuple((text_of(k), v) for k, v in names.items()))

    def name(self, column: Column) -> Column:
        text = column.cast("string")
        out = text
        for code, name in reversed(self.names):
            out = F.when(text == F.lit(code), F.lit(name)).otherwise(out)
        return out

    def equals(self, column: Column, dtype: T.DataType, name: str) -> Column:
        """Whether a row's name is that, as comparisons of the column itself, so that they reach the source."""
        kind = kind_of(dtype)
        text = column if kind != "string" or isinstance(dtype, T.StringType) else column.cast("string")
        codes = [code for code, n in self.names if n == name]
        if name not in {code for code, _ in self.names}:
            codes.append(name)
        out = F.lit(False)
        for i, code in enumerate(codes):
            test = equals(text, kind, code)
            out = test if i == 0 else out | test
        return out
