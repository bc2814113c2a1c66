"""Proofs of facts: a rule and the premises under which it gives the fact, down to facts and sources.

In a recursive component a premise must have been found in an earlier round than the fact, so proofs never go in circles.
Of all proofs, that of the first rule and the smallest bindings (as texts, of variables in order of first use) is taken. The
driver walks; each step is one small query. All last steps of a fact are one plan that isn't collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import render
from .functions.canonical import as_kind, equals
from .operators.relational import select_constants
from .plans import strata
from .plans.compiler import bindings
from .plans.evaluate import Evaluation
from .terms import Clause, Const, Key, Literal, SetTerm, Var, substitute


@dataclass(frozen=True)
class Step:
    """A fact, and how it is known: "fact", "external", "rule", "member" or "absent"."""

    literal: Literal
    how: str
    rule: Clause | None = None
    premises: tuple[Literal, ...] = ()

    def __str__(self) -> str:
        if self.how == "rule":
            return render.clause(Clause(self.literal, self.premises))
        note = {"fact": "", "external": " % from a source", "member": " % by the set", "absent": " % no derivation"}[self.how]
        return f"{render.literal(self.literal)}.{note}"


class Prover:
    def __init__(self, evaluation: Evaluation) -> None:
        self.e = evaluation
        self.rounds: dict[Key, DataFrame] = {}

    def _with_rounds(self, key: Key) -> DataFrame | None:
        """A recursive predicate's rows and the rounds that found them, by the plain loop; None for other predicates."""
        if key not in self.rounds:
            for component in self.e.prepare(key):
                self.e.frame(component[0])
                if key in component and strata.recursive(self.e.rules, component):
                    self.e._fixpoint(component, plain=True)
                    for k in component:
                        self.rounds[k] = self.e.stored[k].by_round()
        return self.rounds.get(key)

    def _round(self, fact: Literal) -> int | None:
        rows = self._with_rounds(fact.key)
        if rows is None:
            return None
        found = select_constants(rows, self.e.kinds[fact.key], fact).agg(F.min("_round")).first()
        return None if found is None else found[0]

    def _holds(self, df: DataFrame | None, fact: Literal) -> bool:
        return df is not None and not select_constants(df, self.e.kinds[fact.key], fact).isEmpty()

    def _frame(self, clause: Clause, fact: Literal, before: int | None) -> tuple[dict[str, str], list[str], DataFrame] | None:
        """The variables that the fact binds, the other ones, and the bindings of these (x0, x1, ... as texts) that give the fact."""
        values: dict[str, str] = {}
        for t, c in zip(clause.head.terms, fact.terms):
            assert isinstance(c, Const)
            if isinstance(t, Var):
                if values.setdefault(t.name, c.value) != c.value:
                    return None
            elif t != c:
                return None
        body = tuple(substitute(b, values) for b in clause.body)
        inside = {k for c in self.e.prepare(fact.key) if fact.key in c for k in c}

        def rows(literal: Literal, _place: int) -> DataFrame:
            if before is not None and literal.key in inside:
                found = self._with_rounds(literal.key)
                assert found is not None
                return found.where(F.col("_round") < before).drop("_round")
            return self.e.frame(literal.key)

        for b in body:
            if not b.is_member:
                self.e.frame(b.key)
        variables = list(dict.fromkeys(v for b in body for v in b.variables))  # in order of first use, which no fresh name changes
        frame = bindings(self.e.spark, Clause(clause.head, body), rows, self.e.kinds, set(variables))
        columns = [as_kind(F.col(frame.names[v]), frame.kinds[v], "string").alias(f"x{i}") for i, v in enumerate(variables)]
        return values, variables, frame.df.select(*columns) if columns else frame.df.limit(1)

    def _bindings(self, clause: Clause, fact: Literal, before: int | None) -> dict[str, str] | None:
        """The smallest binding of the clause's variables that gives the fact."""
        found = self._frame(clause, fact, before)
        if found is None:
            return None
        values, variables, df = found
        first = df.orderBy(*df.columns).limit(1).collect()
        return values | dict(zip(variables, first[0])) if first else None

    def all_steps(self, fact: Literal) -> DataFrame:
        """Every last step of a proof of the fact, in a row: how, rule, line; as many as bodies of rules give the fact."""
        out = self.e.spark.createDataFrame([], "how string, rule string, line string")
        self.e.frame(fact.key)
        if any(c.head == fact for c in self.e.facts.get(fact.key, ())):
            out = out.unionByName(self.e.spark.createDataFrame([("fact", None, str(Step(fact, "fact")))], out.schema))
        bound = {i: t.value for i, t in enumerate(fact.terms) if isinstance(t, Const)}
        for external in self.e.catalog.of(fact.key):
            there = external.rows(bound, self.e.catalog.clock()).limit(1)
            out = out.unionByName(there.select(F.lit("external").alias("how"), F.lit(None).cast("string").alias("rule"), F.lit(str(Step(fact, "external"))).alias("line")))
        for clause in self.e.rules.get(fact.key, ()):
            found = self._frame(clause, fact, None)
            if found is not None:
                values, variables, df = found
                body = tuple(substitute(b, values) for b in clause.body)
                line = render.clause_column(Clause(fact, body), {v: F.col(f"x{i}") for i, v in enumerate(variables)})
                out = out.unionByName(df.select(F.lit("rule").alias("how"), F.lit(render.clause(clause)).alias("rule"), line.alias("line")).distinct())
        return out

    def step(self, fact: Literal) -> Step | None:
        """The last step of the fact's proof; None if it doesn't hold."""
        if fact.is_member:
            item, members = fact.terms
            assert isinstance(item, Const) and isinstance(members, SetTerm)
            return Step(fact, "member") if (item.value in members.members) != fact.negated else None
        self.e.frame(fact.key)
        if fact.negated:
            return None if self._holds(self.e.frame(fact.key), fact.positive()) else Step(fact, "absent")
        if any(c.head == fact for c in self.e.facts.get(fact.key, ())):
            return Step(fact, "fact")
        bound = {i: t.value for i, t in enumerate(fact.terms) if isinstance(t, Const)}
        for external in self.e.catalog.of(fact.key):
            if not external.rows(bound, self.e.catalog.clock()).isEmpty():
                return Step(fact, "external")
        before = self._round(fact)
        for clause in self.e.rules.get(fact.key, ()):
            if (values := self._bindings(clause, fact, before)) is not None:
                return Step(fact, "rule", clause, tuple(substitute(b, values) for b in clause.body))
        return None

    def steps(self, fact: Literal) -> Iterator[Step]:
        """The proof, depth first, each literal once; nothing if the fact doesn't hold."""
        todo, seen = [fact], set()
        while todo:
            now = todo.pop()
            if now in seen:
                continue
            seen.add(now)
            step = self.step(now)
            if step is None:
                return
            yield step
            todo += reversed(step.premises)
