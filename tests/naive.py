"""A naive evaluator for tests: stratified programs over small domains, by enumeration of bindings."""

from __future__ import annotations

from sparklog.plans.strata import strata
from sparklog.terms import Const, SetTerm, Var


def matches(literal, facts, env):
    """Bindings that extend env, under which the literal is one of the facts."""
    for row in facts.get(literal.key, ()):
        new = dict(env)
        if all((new.setdefault(t.name, v) if isinstance(t, Var) else t.value) == v for t, v in zip(literal.terms, row)):
            yield new


def solve(body, facts, env):
    if not body:
        yield env
        return
    literal, rest = body[0], body[1:]
    if literal.is_member:
        item, members = literal.terms
        assert isinstance(members, SetTerm)
        value = item.value if isinstance(item, Const) else env.get(item.name)
        if value is not None:
            if (value in members.members) != literal.negated:
                yield from solve(rest, facts, env)
        else:
            for m in members.members:
                yield from solve(rest, facts, {**env, item.name: m})
    elif literal.negated:
        if not any(True for _ in matches(literal.positive(), facts, env)):
            yield from solve(rest, facts, env)
    else:
        for new in matches(literal, facts, env):
            yield from solve(rest, facts, new)


def evaluate(rules, key):
    """All rows of a predicate; rules include facts."""
    facts: dict = {}
    for component in strata(rules, key):
        changed = True
        while changed:
            changed = False
            for k in component:
                for clause in rules.get(k, ()):
                    body = sorted(clause.body, key=lambda b: (b.negated, b.is_member))
                    for env in list(solve(tuple(body), facts, {})):
                        row = tuple(env[t.name] if isinstance(t, Var) else t.value for t in clause.head.terms)
                        if row not in facts.setdefault(k, set()):
                            facts[k].add(row)
                            changed = True
    return facts.get(key, set())
