"""A clause as one DataFrame: joins in a connected order, then negations, then the head."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import as_kind
from ..operators.relational import Frame
from ..terms import Clause, Const, Key, Literal, Var

#: The rows of a literal's predicate, by the literal and its place in the body.
Rows = Callable[[Literal, int], DataFrame]


def order(body: list[tuple[int, Literal]], first: int | None = None) -> list[tuple[int, Literal]]:
    """Positive literals: that with the most constants (or the given one), then those that share most bound variables."""
    left, out, bound = list(body), [], set()
    while left:
        def rank(x: tuple[int, Literal]) -> tuple:
            place, literal = x
            constants = sum(isinstance(t, Const) for t in literal.terms)
            shared = sum(v in bound for v in literal.variables)
            return (bool(out) and (shared > 0 or not literal.variables), place == first, shared, constants, -place)

        best = max(left, key=rank)
        left.remove(best)
        out.append(best)
        bound |= set(best[1].variables)
    return out


def bindings(spark: SparkSession, clause: Clause, rows: Rows, kinds: Mapping[Key, list[str]], keep: set[str], first: int | None = None) -> Frame:
    """The bindings of the variables to keep, under which the body holds."""
    body = list(enumerate(clause.body))
    members = [x for _, x in body if x.is_member]
    positive = order([(i, x) for i, x in body if not x.is_member and not x.negated], first)
    negative = [(i, x) for i, x in body if not x.is_member and x.negated]
    late = keep | {v for x in members for v in x.variables} | {v for _, x in negative for v in x.variables}
    frame = None
    for k, (i, literal) in enumerate(positive):
        rest = {v for _, x in positive[k + 1 :] for v in x.variables}
        before = set(frame.names) if frame else set()
        part = Frame.of(rows(literal, i), kinds[literal.key], literal, late | rest | before, f"b{i}")
        frame = part if frame is None else frame.join(part).keep(late | rest)
    frame = frame or Frame.unit(spark)
    for literal in sorted(members, key=lambda x: x.negated):
        frame = frame.member(literal, spark)
    for i, literal in negative:
        frame = frame.without(Frame.of(rows(literal, i), kinds[literal.key], literal, literal.variables, f"n{i}"))
    return frame


def compile_clause(spark: SparkSession, clause: Clause, rows: Rows, kinds: Mapping[Key, list[str]], first: int | None = None) -> DataFrame:
    """The clause's rows as c0, c1, ... in the predicate's kinds, with repetitions."""
    head = clause.head
    frame = bindings(spark, clause, rows, kinds, set(head.variables), first)
    if not head.terms:
        return frame.df.limit(1).select(F.lit(True).alias("u"))
    out = []
    for i, (term, kind) in enumerate(zip(head.terms, kinds[head.key])):
        value = as_kind(F.col(frame.names[term.name]), frame.kinds[term.name], kind) if isinstance(term, Var) else F.lit(term.value)  # type: ignore[union-attr]
        out.append(value.alias(f"c{i}"))
    return frame.df.select(*out)
