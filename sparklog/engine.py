"""The engine: a program over sources, queries, proofs, and results that are kept until they change."""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import render
from .cache import Cache, Report
from .checks import check, check_literal
from .errors import DatalogError
from .functions.canonical import as_kind
from .operators.relational import select_constants
from .parser import SupportsRead, parse, parse_one
from .plans import rewrite, strata
from .plans.evaluate import Evaluation, Options
from .provenance import Prover, Step
from .sources.catalog import Catalog, External
from .storage import Stored
from .terms import Clause, Command, Const, Key, Kind, L, Literal, Var, free, variant

log = logging.getLogger("sparklog")


class Engine:
    """A program and its sources. All methods may be called from several threads."""

    def __init__(self, spark: SparkSession, clock: Callable[[], float] = time.monotonic, options: Options | None = None) -> None:
        self.spark, self.options = spark, options or Options()
        self.catalog = Catalog(spark, clock)
        self.clauses: dict[Key, list[Clause]] = {}
        self.cache = Cache()
        self.version = 0
        self._lock = threading.RLock()
        self._tables: list[Stored] = []

    def close(self) -> None:
        """Remove all tables and stored rows of this engine; its answers can't be read any more."""
        with self._lock:
            self.cache.clear([*map(free, self.cache.frames), *self.cache.answers])
            while self._tables:
                self._tables.pop().delete()

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    # Sources

    def register(self, name: str, source, columns=None, **options) -> External:
        """A DataFrame or a callable as a predicate; see Catalog.register."""
        external = self.catalog.register(name, source, columns, **options)
        self._changed(free(external.key))
        return external

    # Program

    def _rules(self) -> dict[Key, list[Clause]]:
        return {k: list(v) for k, v in self.clauses.items()}

    def _changed(self, pattern: Literal) -> Report:
        with self._lock:
            self.version += 1
            if not self.cache.frames and not self.cache.answers:
                return Report()
            return self.cache.clear(strata.affected(self._rules(), pattern))

    def add(self, what: Clause | Literal) -> None:
        """A fact or a rule; one that is there already changes nothing."""
        clause = check(what if isinstance(what, Clause) else Clause(what))
        with self._lock:
            known = self.clauses.setdefault(clause.head.key, [])
            if clause not in known:
                known.append(clause)
                self._changed(clause.head)

    def retract(self, what: Clause | Literal) -> bool:
        """Take back a fact or rule of the program; tells whether it was there."""
        clause = check(what if isinstance(what, Clause) else Clause(what))
        with self._lock:
            known = self.clauses.get(clause.head.key, [])
            if clause not in known:
                return False
            self._changed(clause.head)
            known.remove(clause)
            return True

    def load(self, source: str | SupportsRead) -> list[DataFrame]:
        """Run the commands of a program, a text or something with ``read``, in order; the answers of its queries."""
        return [df for df in map(self.apply, parse(source)) if df is not None]

    def apply(self, command: Command) -> DataFrame | None:
        if command.kind is Kind.QUERY:
            return self.ask(command.clause.head)
        if command.kind is Kind.ASSERT:
            self.add(command.clause)
        else:
            self.retract(command.clause)
        return None

    # Queries

    def _evaluation(self) -> Evaluation:
        for key in self.catalog.expired():
            log.info("a source of %s/%d is stale", *key)
            self._changed(free(key))
        return Evaluation(self.spark, self.catalog, self._rules(), self.options, self.cache.frames, self._tables)

    def _query(self, query: str | Literal) -> Literal:
        if isinstance(query, str):
            command = parse_one(query if query.rstrip().endswith("?") else query + "?")
            query = command.clause.head
        check_literal(query)
        if query.negated:
            raise DatalogError(f"a query can't be negated: {render.literal(query)}")
        return query

    def ask(self, query: str | Literal) -> DataFrame:
        """The distinct rows of a predicate that fit a literal: its arguments as texts c0, c1, ...; for a predicate without
        arguments a row with holds = true, or none."""
        query = self._query(query)
        if query.is_member:
            query, helper = Literal("#member", query.terms[:1]), Clause(Literal("#member", query.terms[:1]), (query,))
            rules = Evaluation(self.spark, self.catalog, {query.key: [helper]}, self.options)
            return self._answer(rules, query)
        with self._lock:
            evaluation, same = self._evaluation(), variant(query)
            found = self.cache.find(same) if self.options.keep != "never" else None
            if found is None:
                found = self._asked_anew(evaluation, query)
                if self.options.keep != "never":
                    self.cache.keep(same, found, self.options.keep == "always")
            return found

    def _asked_anew(self, evaluation: Evaluation, query: Literal) -> DataFrame:
        bound = {i: t.value for i, t in enumerate(query.terms) if isinstance(t, Const)}
        if query.key not in self.cache.frames and bound:
            if not evaluation.rules.get(query.key):  # a plain source: constants go to it
                evaluation.prepare(query.key)
                rows = evaluation.base(query.key, bound)
                if rows is not None:
                    return self._texts(evaluation, query, rows)
            elif self.options.magic and (component := self._recursive(evaluation, query.key)):
                return self._asked(evaluation, query, component)
        return self._answer(evaluation, query)

    @staticmethod
    def _recursive(evaluation: Evaluation, key: Key) -> list[Key] | None:
        component = strata.strata(evaluation.rules, key)[-1]
        return component if strata.recursive(evaluation.rules, component) else None

    def _asked(self, evaluation: Evaluation, query: Literal, component: list[Key]) -> DataFrame:
        """A recursive predicate with constants: only what they need is computed."""
        rules, goal = rewrite.magic(evaluation.rules, component, query, {k for k in component if evaluation.has_base(k)})
        every = {k: list(v) for k, v in evaluation.rules.items()}
        for k, facts in evaluation.facts.items():
            every.setdefault(k, []).extend(facts)
        return self._answer(Evaluation(self.spark, self.catalog, every | rules, self.options, dict(self.cache.frames), self._tables), goal)

    def _answer(self, evaluation: Evaluation, query: Literal) -> DataFrame:
        return self._texts(evaluation, query, evaluation.frame(query.key))

    @staticmethod
    def _texts(evaluation: Evaluation, query: Literal, rows: DataFrame) -> DataFrame:
        kinds = evaluation.kinds[query.key]
        rows = select_constants(rows, kinds, query)
        if not evaluation.rules.get(query.key):
            rows = rows.distinct()
        if not query.terms:
            return rows.limit(1).select(F.lit(True).alias("holds"))
        return rows.select(*(as_kind(F.col(f"c{i}"), k, "string").alias(f"c{i}") for i, k in enumerate(kinds)))

    def holds(self, query: str | Literal) -> bool:
        """Whether there is any answer."""
        return not self.ask(query).isEmpty()

    def text(self, query: str | Literal) -> str:
        """The answers as facts, one in a line, sorted."""
        query = self._query(query)
        rows = [tuple(r) if query.terms else () for r in self.ask(query).collect()]
        return render.results(query.predicate, rows)

    def lines(self, query: str | Literal) -> DataFrame:
        """The answers as facts, one in a row (line), written where the rows are; unlike ``text`` for answers of any size."""
        query = self._query(query)
        df = self.ask(query)
        return df.select(render.fact_column(query.predicate, [F.col(c) for c in df.columns] if query.terms else []).alias("line"))

    # Proofs

    def steps(self, fact: str | Literal) -> list[Step]:
        """A proof of a ground literal, depth first; empty if it doesn't hold."""
        fact = self._query(fact)
        if not fact.ground:
            raise DatalogError(f"only a fact can be proved: {render.literal(fact)}")
        with self._lock:
            return list(Prover(self._evaluation()).steps(fact))

    def proof(self, fact: str | Literal) -> str:
        return "".join(f"{s}\n" for s in self.steps(fact))

    def proofs(self, fact: str | Literal) -> DataFrame:
        """Every way in which a fact is known by one step, in a row: how ("fact", "external", "rule"), rule, line (with the
        premises). The rows are computed where the data are."""
        fact = self._query(fact)
        if not fact.ground or fact.is_member:
            raise DatalogError(f"only a fact can be proved: {render.literal(fact)}")
        with self._lock:
            return Prover(self._evaluation()).all_steps(fact)

    def proof_frame(self, fact: str | Literal) -> DataFrame:
        """The proof's steps as rows: step, line, how."""
        rows = [(i, str(s), s.how) for i, s in enumerate(self.steps(fact))]
        return self.spark.createDataFrame(rows, "step int, line string, how string")

    # Kept results

    def invalidate(self, what: str | Literal | Iterable[Key]) -> Report:
        """Forget what depends on the rows of a literal, and read its sources anew when next asked for.

        Frames of predicates go whole; of kept answers, those that a row of the literal may be among or behind.
        """
        patterns = [self._query(what)] if isinstance(what, str | Literal) else [free(k) for k in what]
        with self._lock:
            cleared: set[Key] = set()
            answers: dict[Literal, None] = {}
            for pattern in patterns:
                for external in self.catalog.of(pattern.key):
                    external.forget()
                report = self._changed(pattern)
                cleared |= set(report.cleared)
                answers |= dict.fromkeys(report.answers)
            return Report(tuple(sorted(cleared)), len(self.cache), tuple(answers))


class Sweeper:
    """Looks for stale sources at intervals, in a thread that can be stopped; without it they are found when asked for."""

    def __init__(self, engine: Engine, cycle: float) -> None:
        self.engine, self.cycle = engine, cycle
        self._stop = threading.Event()
        self._thread = threading.Thread(target=self._run, daemon=True)

    def _run(self) -> None:
        while not self._stop.wait(self.cycle):
            for key in self.engine.catalog.expired():
                self.engine._changed(free(key))

    def __enter__(self) -> Sweeper:
        self._thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self._stop.set()
        self._thread.join()


__all__ = ["Engine", "L", "Options", "Sweeper", "Var"]
