"""Literals of a body as relational operators over frames of variables.

A frame has a column for each bound variable, and knows its kind. Occurrences of a predicate get columns of their own, so
that a relation can meet itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import as_kind, equals, join_kind
from ..terms import Const, Literal, SetTerm, Var

#: Members of a set that are compared one by one; a larger set is joined.
INLINE_SET = 1000


def select_constants(df: DataFrame, kinds: Sequence[str], literal: Literal) -> DataFrame:
    """Rows that have the literal's constants, and equal values where it repeats a variable."""
    first: dict[str, int] = {}
    for i, term in enumerate(literal.terms):
        column = F.col(f"c{i}")
        if isinstance(term, Const):
            df = df.where(equals(column, kinds[i], term.value))
        elif isinstance(term, Var):
            j = first.setdefault(term.name, i)
            if j != i:
                kind = join_kind(kinds[i], kinds[j])
                df = df.where(as_kind(column, kinds[i], kind) == as_kind(F.col(f"c{j}"), kinds[j], kind))
    return df


class Frame:
    """The bindings of variables so far."""

    def __init__(self, df: DataFrame, kinds: dict[str, str], names: dict[str, str]) -> None:
        self.df, self.kinds, self.names = df, kinds, names

    @classmethod
    def unit(cls, spark: SparkSession) -> Frame:
        """One row that binds nothing."""
        return cls(spark.range(1).select(F.lit(True).alias("u")), {}, {})

    @classmethod
    def of(cls, df: DataFrame, kinds: Sequence[str], literal: Literal, keep: Iterable[str], prefix: str) -> Frame:
        """The bindings that a positive literal gives, of the variables to keep."""
        df = select_constants(df, kinds, literal)
        keep = set(keep)
        places = {t.name: i for i, t in reversed(list(enumerate(literal.terms))) if isinstance(t, Var) and t.name in keep}
        names = {v: f"{prefix}_{i}" for v, i in places.items()}
        if not places:
            return cls(df.select(F.lit(True).alias(f"{prefix}_u")), {}, {})
        return cls(df.select(*(F.col(f"c{i}").alias(names[v]) for v, i in places.items())), {v: kinds[i] for v, i in places.items()}, names)

    def column(self, variable: str, kind: str | None = None) -> Column:
        have = self.kinds[variable]
        return as_kind(F.col(self.names[variable]), have, kind or have)

    def keep(self, variables: Iterable[str]) -> Frame:
        """Only these variables' columns."""
        names = {v: n for v, n in self.names.items() if v in set(variables)}
        if names == self.names:
            return self
        df = self.df.select(*names.values()) if names else self.df.select(F.lit(True).alias("u"))
        return Frame(df, {v: self.kinds[v] for v in names}, names)

    def join(self, other: Frame) -> Frame:
        """Bindings that agree on the shared variables; a product if there are none, a semi-join if it adds none."""
        shared = [v for v in other.names if v in self.names]
        new = [v for v in other.names if v not in self.names]
        if not shared:
            if not new:  # only whether there is a row matters
                guard = other.df.limit(1)
                return Frame(self.df.crossJoin(guard).select(*self.df.columns), self.kinds, self.names)
            both = self.df.distinct().crossJoin(other.df.distinct())
            return Frame(both, self.kinds | other.kinds, self.names | other.names)
        kinds = {v: join_kind(self.kinds[v], other.kinds[v]) for v in shared}
        condition = None
        for v in shared:
            test = self.column(v, kinds[v]) == other.column(v, kinds[v])
            condition = test if condition is None else condition & test
        if not new:
            return Frame(self.df.join(other.df, condition, "left_semi"), self.kinds, self.names)
        both = self.df.join(other.df, condition, "inner").select(*self.df.columns, *(other.names[v] for v in new))
        return Frame(both, self.kinds | {v: other.kinds[v] for v in new}, self.names | {v: other.names[v] for v in new})

    def without(self, other: Frame) -> Frame:
        """Bindings for which the other has no row: an anti-join, or emptiness if nothing is shared."""
        condition = F.lit(True)
        df = other.df
        for i, v in enumerate(other.names):
            kind = join_kind(self.kinds[v], other.kinds[v])
            test = self.column(v, kind) == other.column(v, kind)
            condition = test if i == 0 else condition & test
        if not other.names:
            df = df.limit(1)
        return Frame(self.df.join(df, condition, "left_anti"), self.kinds, self.names)

    def member(self, literal: Literal, spark: SparkSession) -> Frame:
        """Set membership: a filter of a bound variable, the members of an unbound one, or the truth of a constant."""
        item, members = literal.terms
        assert isinstance(members, SetTerm)
        if isinstance(item, Const):
            return self if (item.value in members.members) != literal.negated else Frame(self.df.where(F.lit(False)), self.kinds, self.names)
        assert isinstance(item, Var)
        variable, n = item.name, len(members.members)
        if variable not in self.names:
            name = f"s{len(self.names)}_{len(members.members)}"
            values = spark.createDataFrame([(m,) for m in members.members], f"{name} string")
            return self.join(Frame(values, {variable: "string"}, {variable: name}))
        if n > INLINE_SET:
            values = F.broadcast(spark.createDataFrame([(m,) for m in members.members], "member string")) if n <= 1_000_000 else spark.createDataFrame([(m,) for m in members.members], "member string")
            other = Frame(values, {variable: "string"}, {variable: "member"})
            return self.without(other) if literal.negated else self.join(other)
        column, kind = F.col(self.names[variable]), self.kinds[variable]
        if kind == "string":
            test = column.isin(list(members.members))
        else:
            test = F.lit(False)
            for m in members.members:
                test = test | equals(column, kind, m)
        return Frame(self.df.where(~test if literal.negated else test), self.kinds, self.names)
