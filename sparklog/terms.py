"""Terms, literals, clauses and commands, and the builders that make them from Python values."""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from enum import Enum


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    value: str


@dataclass(frozen=True)
class SetTerm:
    members: tuple[str, ...]


Term = Var | Const | SetTerm
Key = tuple[str, int]

#: The predicate of set membership; its second argument is a set.
MEMBER = "in"


@dataclass(frozen=True)
class Literal:
    predicate: str
    terms: tuple[Term, ...] = ()
    negated: bool = False

    @property
    def key(self) -> Key:
        return self.predicate, len(self.terms)

    @property
    def variables(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(t.name for t in self.terms if isinstance(t, Var)))

    @property
    def ground(self) -> bool:
        return not self.variables

    @property
    def is_member(self) -> bool:
        return self.predicate == MEMBER and len(self.terms) == 2

    def positive(self) -> Literal:
        return Literal(self.predicate, self.terms)


@dataclass(frozen=True)
class Clause:
    head: Literal
    body: tuple[Literal, ...] = ()


def free(key: Key) -> Literal:
    """The literal of a predicate that every row of it fits."""
    return Literal(key[0], tuple(Var(f"#{i}") for i in range(key[1])))


def variant(x: Literal) -> Literal:
    """The literal with its variables numbered: literals that differ in the names of variables only give the same one."""
    names = {v: Var(f"#{i}") for i, v in enumerate(x.variables)}
    return Literal(x.predicate, tuple(names[t.name] if isinstance(t, Var) else t for t in x.terms), x.negated)


def substitute(x: Literal, values: dict[str, str]) -> Literal:
    """The literal with constants in the place of these variables."""
    return Literal(x.predicate, tuple(Const(values[t.name]) if isinstance(t, Var) and t.name in values else t for t in x.terms), x.negated)


def meet(a: Literal, b: Literal) -> dict[str, str] | None:
    """The constants that a's variables get where a and b, whose variables have nothing to do with each other, are made
    equal; None if they can't be."""
    if a.key != b.key:
        return None
    joined: dict[object, object] = {}

    def root(x: object) -> object:
        while x in joined:
            x = joined[x]
        return x

    for s, t in zip(a.terms, b.terms):
        x, y = (root((side, z) if isinstance(z, Var) else z) for side, z in (("a", s), ("b", t)))
        if x != y:
            if isinstance(x, Const) and isinstance(y, Const):
                return None
            joined.update({y: x} if isinstance(x, Const) else {x: y})
    found = {v: root(("a", Var(v))) for v in a.variables}
    return {v: c.value for v, c in found.items() if isinstance(c, Const)}


class Kind(Enum):
    ASSERT = "."
    QUERY = "?"
    RETRACT = "~"


@dataclass(frozen=True)
class Command:
    kind: Kind
    clause: Clause


def text_of(value: object) -> str:
    """The constant that a Python value stands for: equality is that of canonical texts."""
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


_fresh = itertools.count(1)


def V(name: str) -> Var:  # noqa: N802
    """A variable; each ``_`` is a new one."""
    return Var(f"_{next(_fresh)}") if name == "_" else Var(name)


def _term(value: object) -> Term:
    return value if isinstance(value, Var | Const | SetTerm) else Const(text_of(value))


def L(predicate: str, *terms: object) -> Literal:  # noqa: N802
    return Literal(predicate, tuple(map(_term, terms)))


def C(head: Literal, *body: Literal) -> Clause:  # noqa: N802
    return Clause(head, tuple(body))


def Negate(literal: Literal) -> Literal:  # noqa: N802
    return Literal(literal.predicate, literal.terms, not literal.negated)


def InSet(item: object, *members: object) -> Literal:  # noqa: N802
    return Literal(MEMBER, (_term(item), SetTerm(tuple(sorted({text_of(m) for m in members})))))


def _command(kind: Kind, what: Clause | Literal) -> Command:
    return Command(kind, what if isinstance(what, Clause) else Clause(what))


def Ask(literal: Literal) -> Command:  # noqa: N802
    return _command(Kind.QUERY, literal)


def Assert(what: Clause | Literal) -> Command:  # noqa: N802
    return _command(Kind.ASSERT, what)


def Retract(what: Clause | Literal) -> Command:  # noqa: N802
    return _command(Kind.RETRACT, what)
