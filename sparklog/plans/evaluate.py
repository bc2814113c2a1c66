"""Predicates to DataFrames: one plan for each predicate that isn't recursive, a semi-naive loop for each recursive component."""

from __future__ import annotations

import logging
import math
from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NoFixpoint
from ..functions.canonical import KINDS, as_kind
from ..sources.catalog import Catalog
from ..storage import Stored
from ..terms import Clause, Const, Key
from . import kinds as kinds_
from . import rewrite, strata
from .compiler import compile_clause

log = logging.getLogger("sparklog")

#: Members of a class that are in one row, about.
BLOCK = 512
#: Rows of members of classes that one task makes, about.
TASK_ROWS = 4_000_000


def schema_of(kinds: list[str]) -> T.StructType:
    if not kinds:
        return T.StructType([T.StructField("u", T.BooleanType())])
    return T.StructType([T.StructField(f"c{i}", KINDS[k]) for i, k in enumerate(kinds)])


@dataclass
class Options:
    """keep: whether rows of answers are stored: "never", "repeated" (from the second time that a query is asked; a query
    that is asked once pays nothing) or "always" (from the first). classes: whether recursions may go over classes of values.
    """

    max_rounds: int = 10_000
    doubling: bool = True
    magic: bool = True
    classes: bool = True
    keep: str = "repeated"

    def __post_init__(self) -> None:
        if self.keep not in ("never", "repeated", "always"):
            raise ValueError("keep is never, repeated or always")


class Evaluation:
    """All frames of one program version. Rules hold facts too, as clauses without a body."""

    def __init__(self, spark: SparkSession, catalog: Catalog, rules: Mapping[Key, list[Clause]], options: Options, frames: dict[Key, DataFrame] | None = None, tables: list[Stored] | None = None) -> None:
        """tables: gets every table that is written, for whoever removes them."""
        self.tables = [] if tables is None else tables
        self.spark, self.catalog, self.options = spark, catalog, options
        self.facts: dict[Key, list[Clause]] = {k: [c for c in v if not c.body and c.head.ground] for k, v in rules.items()}
        self.rules: dict[Key, list[Clause]] = {k: [c for c in v if c.body or not c.head.ground] for k, v in rules.items()}
        self.frames: dict[Key, DataFrame] = {} if frames is None else frames
        self.stored: dict[Key, Stored] = {}
        self.kinds: dict[Key, list[str]] = {}
        #: Kinds of predicates that have frames only.
        self.given: dict[Key, list[str]] = {}

    @staticmethod
    def plain(key: Key) -> Key:
        """The predicate whose facts and sources these are."""
        return (key[0].removesuffix(rewrite.BASE), key[1])

    def _base_kinds(self, key: Key) -> list[str] | None:
        own, now = self.plain(key), self.catalog.clock()
        if key in self.given:
            return self.given[key]
        if own != key or not self.rules.get(key) or self.facts.get(own) or self.catalog.of(own):
            found = [e.kinds(now) for e in self.catalog.of(own)]
            if self.facts.get(own):
                found.append(["string"] * key[1])
            if found:
                return [k[0] if len(set(k)) == 1 else "string" for k in zip(*found)]
        return None

    def has_base(self, key: Key) -> bool:
        return bool(self.facts.get(key) or self.catalog.of(key))

    def base(self, key: Key, bound: dict[int, str] | None = None) -> DataFrame | None:
        """Facts and sources of a predicate, in its kinds."""
        own, kinds, parts = self.plain(key), self.kinds[key], []
        now = self.catalog.clock()
        for external in self.catalog.of(own):
            have, df = external.kinds(now), external.rows(bound or {}, now)
            parts.append(df.select(*(as_kind(F.col(f"c{i}"), h, k).alias(f"c{i}") for i, (h, k) in enumerate(zip(have, kinds)))) if kinds else df)
        if facts := self.facts.get(own):
            rows = [tuple(t.value for t in c.head.terms if isinstance(t, Const)) for c in facts]
            rows = [r for r in rows if all(r[i] == v for i, v in (bound or {}).items())]
            text = self.spark.createDataFrame(rows if kinds else [(True,) for _ in rows], schema_of(["string"] * len(kinds)))
            parts.append(text)
        out = None
        for part in parts:
            out = part if out is None else out.unionByName(part)
        return out

    def prepare(self, key: Key) -> list[list[Key]]:
        """The components that a predicate needs, in order, with the kinds of their predicates."""
        order = strata.strata(self.rules, key)
        self.kinds |= kinds_.infer(self.rules, [k for c in order for k in c], self._base_kinds)
        return order

    def frame(self, key: Key) -> DataFrame:
        """The rows of a predicate: distinct, but for one without rules, whose sources are read as they are."""
        for component in self.prepare(key):
            if all(k in self.frames for k in component):
                continue
            if strata.recursive(self.rules, component):
                self._fixpoint(component)
            else:
                rules = self.rules.get(component[0], [])
                out = self._union(component[0], rules)
                # What joins a source needn't shuffle it first: the rows of a rule are made distinct at its head.
                self.frames[component[0]] = out.distinct() if rules else out
        return self.frames[key]

    def _rows(self, literal, _place: int = 0) -> DataFrame:
        """The rows of a literal's predicate; a source that wants bound arguments gets the literal's constants."""
        bound = {i: t.value for i, t in enumerate(literal.terms) if isinstance(t, Const)}
        if bound and not self.rules.get(literal.key) and any(e.bound_calls for e in self.catalog.of(literal.key)):
            rows = self.base(literal.key, bound)
            assert rows is not None
            return rows
        return self.frames[literal.key]

    def _stored(self, key: Key) -> Stored:
        self.tables.append(Stored(self.spark, schema_of(self.kinds[key])))
        return self.tables[-1]

    def _union(self, key: Key, rules: list[Clause]) -> DataFrame:
        out = self.base(key)
        for clause in rules:
            part = compile_clause(self.spark, clause, self._rows, self.kinds)
            out = part if out is None else out.unionByName(part)
        if out is None:
            return self.spark.createDataFrame([], schema_of(self.kinds[key]))
        return out

    def _store(self, key: Key) -> None:
        """A derived predicate that is read several times, in a table."""
        if self.rules.get(key) and key not in self.stored:
            self.stored[key] = self._stored(key)
            self.stored[key].add(self.frames[key])
            self.frames[key] = self.stored[key].all()

    def _classes(self, place: rewrite.Place) -> Stored:
        """The classes of a place's values in blocks: class, block, members. Values whose rows are the same but for that
        place are one class, which has the name of its smallest member.

        Values with equal counts and hashes of rows are candidates; each row is then looked up among those of the smallest
        value, and a value with a row that isn't there is a class by itself. No set of rows or class is held as a whole.
        """
        (key, i), kind = place, KINDS[self.kinds[place[0]][place[1]]]
        rest = [f"c{j}" for j in range(key[1]) if j != i]
        rows = self.frames[key].distinct().withColumnRenamed(f"c{i}", "value")
        mark = ["n", "a", "b"]
        marks = rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"), *(F.bit_xor(F.xxhash64(F.lit(s), *rest)).alias(s) for s in mark[1:]))
        first = marks.groupBy(*mark).agg(F.min("value").alias("class"))
        named = marks.join(first, mark).select("value", "class")
        known = rows.join(first.select(F.col("class").alias("value")), "value", "left_semi").withColumnRenamed("value", "class")
        wrong = rows.join(named.where(F.col("value") != F.col("class")), "value").join(known, ["class", *rest], "left_anti").select("value", F.lit(True).alias("wrong")).distinct()
        named = named.join(wrong, "value", "left").select("value", F.when(F.col("wrong"), F.col("value")).otherwise(F.col("class")).alias("class"))
        blocks = F.ceil(F.col("n") / BLOCK)
        sized = named.join(named.groupBy("class").agg(F.count(F.lit(1)).alias("n")), "class")
        out = sized.groupBy("class", F.pmod(F.xxhash64("value"), blocks).alias("block")).agg(F.collect_list("value").alias("members"))
        self.tables.append(Stored(self.spark, T.StructType([T.StructField("class", kind), T.StructField("block", T.LongType()), T.StructField("members", T.ArrayType(kind))])))
        self.tables[-1].add(out)
        return self.tables[-1]

    def _by_class(self, key: Key) -> bool:
        """The fixpoint over classes of values, if the rules allow it and there are at most half as many classes as values.

        The members' rows are made where they are read; they are distinct, as a value is in one class.
        """
        found = rewrite.by_class(self.rules[key])
        if not found:
            return False
        rules, fed = found
        blocks: dict[rewrite.Place, DataFrame] = {}
        fewer = False
        for place in fed.values():
            self._store(place[0])
        for place in dict.fromkeys(fed.values()):
            blocks[place] = self._classes(place).all()
            values, classes = blocks[place].agg(F.sum(F.size("members")), F.count_distinct("class")).first()  # type: ignore[misc]
            fewer = fewer or 2 * classes <= (values or 0)
        if not fewer:
            for _ in blocks:
                self.tables.pop().delete()
            return False
        every = {k: [*self.facts.get(k, []), *self.rules.get(k, [])] for k in {*self.facts, *self.rules}}
        inner = Evaluation(self.spark, self.catalog, every | rules, replace(self.options, classes=False), dict(self.frames), self.tables)
        inner.stored = dict(self.stored)
        for place, df in blocks.items():
            (name, n), i = place
            kinds = self.kinds[place[0]]
            of, rows = rewrite.class_of(place), rewrite.rows_of(place)
            inner.frames[of] = df.select(F.explode("members").alias("c0"), F.col("class").alias("c1"))
            inner.frames[rows] = self.frames[place[0]].distinct().join(df.select(F.col("class").alias(f"c{i}")).distinct(), f"c{i}", "left_semi")
            inner.given |= {of: [kinds[i]] * 2, rows: kinds}
        out = inner.frame((key[0] + rewrite.CLASSES, key[1]))
        total, ids = F.lit(1.0), []
        for i, place in fed.items():
            part = blocks[place].select(F.col("class").alias(f"c{i}"), F.col("block").alias(f"b{i}"), F.col("members").alias(f"m{i}"))
            out = out.join(part, f"c{i}")
            total, ids = total * F.size(f"m{i}"), [*ids, f"c{i}", f"b{i}"]
        n = out.agg(F.sum(total)).first()[0] or 0  # type: ignore[index]
        tasks = min(math.ceil(n / TASK_ROWS) or 1, 1_000_000)
        out = out.repartition(tasks, *ids)
        for i in fed:
            # Compiled code holds all rows that it makes of one; what isn't compiled, as a lambda, hands on one at a time.
            members = F.col(f"m{i}") if i == max(fed) else F.transform(f"m{i}", lambda x: x)
            out = out.select(*(c for c in out.columns if c not in (f"c{i}", f"b{i}", f"m{i}")), F.explode(members).alias(f"c{i}"))
        out = out.select(*(f"c{i}" for i in range(key[1])))
        # What is known of its size is that of the blocks: a join must not take it for small.
        self.frames[key] = out.hint("merge") if tasks > 1 else out
        return True

    def _fixpoint(self, component: list[Key], plain: bool = False) -> None:
        """Semi-naive rounds: each recursive literal in turn reads what the last round added, the others all there is."""
        spark, inside = self.spark, set(component)
        rules = {k: self.rules.get(k, []) for k in component}
        closure = None
        if self.options.doubling and not plain and len(component) == 1:
            closure = rewrite.doubling(rules[component[0]], self.has_base(component[0]))
            if closure:
                rules = {component[0]: closure}
        if self.options.classes and not plain and not closure and len(component) == 1 and not self.has_base(component[0]) and self._by_class(component[0]):
            return
        for key in {b.key for k in component for c in rules[k] for b in c.body if not b.is_member} - inside:
            self._store(key)  # it would be computed anew in each round
        stored = {k: self._stored(k) for k in component}
        for key in component:
            start = self._union(key, [c for c in rules[key] if not any(b.key in inside for b in c.body)])
            stored[key].add(start.distinct())
        loops = [(c, i) for k in component for c in rules[k] for i, b in enumerate(c.body) if b.key in inside]
        rounds = 0
        while any(s.rounds[-1][1] for s in stored.values()):
            rounds += 1
            if rounds > self.options.max_rounds:
                raise NoFixpoint(f"{component} needs more than {self.options.max_rounds} rounds")
            for s in stored.values():
                s.compact()
            fresh = {k: s.last() for k, s in stored.items()}
            full = {k: s.all() for k, s in stored.items()}
            added = {}
            for key in component:
                out = None
                for clause, place in loops:
                    if clause.head.key != key or not stored[clause.body[place].key].rounds[-1][1]:
                        continue

                    def rows(literal, i: int, place=place) -> DataFrame:
                        if literal.key not in inside:
                            return self._rows(literal)
                        return fresh[literal.key] if i == place else full[literal.key]

                    part = compile_clause(spark, clause, rows, self.kinds, first=place)
                    out = part if out is None else out.unionByName(part)
                columns = [f"c{i}" for i in range(key[1])] or ["u"]
                added[key] = None if out is None else out.distinct().join(full[key], columns, "left_anti").select(*columns)
            for key, df in added.items():
                if df is None:
                    stored[key].skip()
                else:
                    stored[key].add(df)
            log.debug("round %d of %s: %s", rounds, component, {k: s.rounds[-1][1] for k, s in stored.items()})
        for key in component:
            self.stored[key] = stored[key]
            self.frames[key] = stored[key].all()
