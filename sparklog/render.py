"""Terms, clauses and results to program text that can be parsed again."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .terms import Clause, Command, Const, Literal, SetTerm, Term, Var

_PLAIN = re.compile(r"[a-z0-9][A-Za-z0-9_-]*\Z")


def constant(value: str) -> str:
    """A quote in a quoted name is written twice."""
    return value if _PLAIN.match(value) else "'" + value.replace("'", "''") + "'"


def constant_column(value: Column) -> Column:
    """``constant`` of each row's value."""
    quoted = F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(value.rlike(r"\A" + _PLAIN.pattern.replace(r"\Z", r"\z")), value).otherwise(quoted)


def term(t: Term) -> str:
    if isinstance(t, Var):
        return "_" if t.name.startswith("_") else t.name
    if isinstance(t, Const):
        return constant(t.value)
    return "[" + ", ".join(map(constant, t.members)) + "]"


def literal(x: Literal) -> str:
    sign = "!" if x.negated else ""
    if x.is_member and isinstance(x.terms[1], SetTerm):
        return f"{sign}{term(x.terms[0])} in {term(x.terms[1])}"
    name = x.predicate if re.match(r"[A-Za-z0-9][A-Za-z0-9_-]*\Z", x.predicate) else "'" + x.predicate.replace("'", "''") + "'"
    return f"{sign}{name}({', '.join(map(term, x.terms))})" if x.terms else f"{sign}{name}"


def clause(x: Clause) -> str:
    if not x.body:
        return literal(x.head) + "."
    head = literal(x.head) if x.head.terms else literal(x.head) + "()"
    return f"{head} :- {', '.join(literal(b) if b.terms else literal(b) + '()' for b in x.body)}."


def clause_column(x: Clause, values: dict[str, Column]) -> Column:
    """The clause with each row's values in the place of variables."""
    marks = {v: f"\0{i}\0" for i, v in enumerate(values)}
    text = clause(Clause(_marked(x.head, marks), tuple(_marked(b, marks) for b in x.body)))
    parts = re.split("'?\0(\\d+)\0'?", text)
    columns = list(values.values())
    return F.concat(*(F.lit(p) if i % 2 == 0 else constant_column(columns[int(p)]) for i, p in enumerate(parts)))


def _marked(x: Literal, marks: dict[str, str]) -> Literal:
    return Literal(x.predicate, tuple(Const(marks[t.name]) if isinstance(t, Var) else t for t in x.terms), x.negated)


def fact_column(predicate: str, columns: list[Column]) -> Column:
    """A fact of each row, as ``results`` writes it."""
    name = literal(Literal(predicate, (Const("x"),))).removesuffix("(x)")
    if not columns:
        return F.lit(name + ".")
    parts = [part for c in columns for part in (F.lit(", "), constant_column(c))][1:]
    return F.concat(F.lit(name + "("), *parts, F.lit(")."))


def command(x: Command) -> str:
    return clause(x.clause) if x.clause.body else literal(x.clause.head) + x.kind.value


def results(predicate: str, rows: Iterable[Iterable[str]]) -> str:
    """Facts, one in a line, sorted."""
    return "".join(sorted(literal(Literal(predicate, tuple(Const(v) for v in row))) + ".\n" for row in rows))
