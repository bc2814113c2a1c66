"""What makes a clause safe, and the order of its body."""

from __future__ import annotations

from . import render
from .errors import UnsafeClause
from .terms import MEMBER, Clause, Literal, SetTerm


def check_literal(x: Literal) -> None:
    sets = [isinstance(t, SetTerm) for t in x.terms]
    if any(sets) and not (x.is_member and sets == [False, True]):
        raise UnsafeClause(f"a set may only be the right side of in: {render.literal(x)}")
    if x.predicate == MEMBER and not any(sets):
        raise UnsafeClause(f"in takes a set on its right side: {render.literal(x)}")


def check(x: Clause) -> Clause:
    """The clause with negated literals last, in order otherwise; UnsafeClause if it can't be evaluated."""
    for literal in (x.head, *x.body):
        check_literal(literal)
    if x.head.negated or x.head.predicate == MEMBER:
        raise UnsafeClause(f"this can't be a head: {render.literal(x.head)}")
    bound = {v for b in x.body if not b.negated for v in b.variables}
    if loose := [v for v in x.head.variables if v not in bound]:
        raise UnsafeClause(f"{', '.join(loose)} in the head of {render.clause(x)} isn't in a positive literal of the body")
    for b in x.body:
        if b.negated and (loose := [v for v in b.variables if v not in bound]):
            names = ", ".join("_" if v.startswith("_") else v for v in loose)
            raise UnsafeClause(f"{names} in {render.literal(b)} isn't in a positive literal of the body")
    return Clause(x.head, tuple(sorted(x.body, key=lambda b: b.negated)))
