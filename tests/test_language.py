"""Text to commands and back, and what is refused."""

import string

import pytest
from hypothesis import given
from hypothesis import strategies as st

from sparklog import Ask, Assert, C, InSet, L, Negate, NotStratified, ParseError, UnsafeClause, V, parse, render
from sparklog.checks import check
from sparklog.plans import strata
from sparklog.terms import Clause, Const, Kind, Literal, SetTerm, Var


def rules_of(text):
    out = {}
    for c in parse(text):
        out.setdefault(c.clause.head.key, []).append(c.clause)
    return out


def test_kinds_of_commands():
    a, b, c, d = parse("likes(ann, Book). % a comment\nlikes(X, 'Big Book')?\nlikes(ann, book)~ done.")
    assert (a.kind, b.kind, c.kind, d.kind) == (Kind.ASSERT, Kind.QUERY, Kind.RETRACT, Kind.ASSERT)
    assert a.clause.head == Literal("likes", (Const("ann"), Var("Book")))
    assert b.clause.head.terms[1] == Const("Big Book")
    assert d.clause.head == Literal("done")


def test_rule_with_all_literals():
    (c,) = parse("ok(X) :- item(X, _), !sold(X), X in [b a, c], !X in [d], open().")
    assert [x.negated for x in c.clause.body] == [False, True, False, True, False]
    assert c.clause.body[2].terms[1] == SetTerm(("a", "b", "c"))
    assert c.clause.body[4] == Literal("open")


def test_each_underscore_is_new():
    (c,) = parse("p(_, _)?")
    assert c.clause.head.terms[0] != c.clause.head.terms[1]


@pytest.mark.parametrize(
    ("text", "line", "column"),
    [("p(a", 1, 4), ("p(a;b).", 1, 4), ("p(a).\nq(b) :- r(", 2, 11), ("p('a).", 1, 3), ("p(X) :- q(X)?", 1, 13), ("p(a)", 1, 5), ("p(_) :- q(_).", 1, 1), ("p(X) :- X in [Y].", 1, 15), (".", 1, 1)],
)
def test_errors_have_a_place(text, line, column):
    with pytest.raises(ParseError) as e:
        parse(text)
    assert (e.value.line, e.value.column) == (line, column)


@pytest.mark.parametrize(
    "text",
    ["p(X).", "p(X, Y) :- q(X).", "p(X) :- q(X), !r(X, Y).", "!p(a) :- q(a).", "p(X) :- q(X), !r(_).", "in(a, b).", "p(a) :- in(a, b)."],
)
def test_unsafe_clauses(text):
    with pytest.raises(UnsafeClause):
        check(parse(text)[0].clause)


def test_set_in_a_wrong_place():
    with pytest.raises(UnsafeClause):
        check(Clause(Literal("p", (SetTerm(("a",)),))))


def test_negations_go_last():
    c = check(parse("p(X) :- !q(X), r(X), !s(X), t(X).")[0].clause)
    assert [b.predicate for b in c.body] == ["r", "t", "q", "s"]


def test_strata():
    rules = rules_of("a(X) :- b(X), !c(X). b(X) :- a(X). c(X) :- d(X). c(X) :- c(X), e(X).")
    order = strata.strata(rules, ("a", 1))
    assert order.index([("c", 1)]) < order.index([("a", 1), ("b", 1)])
    assert strata.recursive(rules, [("c", 1)]) and not strata.recursive(rules, [("d", 1)])
    assert strata.dependants(rules, ("d", 1)) == {("d", 1), ("c", 1), ("a", 1), ("b", 1)}


def test_negation_in_a_cycle():
    with pytest.raises(NotStratified):
        strata.strata(rules_of("win(X) :- move(X, Y), !win(Y)."), ("win", 1))


def test_builders():
    assert L("p", 1, True, "x", V("X")).terms == (Const("1"), Const("true"), Const("x"), Var("X"))
    assert V("_") != V("_")
    assert InSet(V("X"), 2, 1, 2).terms[1] == SetTerm(("1", "2"))
    assert Negate(Negate(L("p"))) == L("p")
    assert Ask(L("p")).kind is Kind.QUERY and Assert(C(L("p"), L("q"))).clause.body == (L("q"),)


names = st.text(string.ascii_letters + string.digits, min_size=1, max_size=4)
constants = st.text(string.ascii_letters + string.digits + " -#_.", min_size=0, max_size=5).map(Const)
terms = st.one_of(constants, names.map(lambda n: Var("V" + n)))
plain = st.builds(lambda p, t, n: Literal("p" + p, tuple(t), n), names, st.lists(terms, max_size=3), st.booleans())
members = st.builds(lambda t, m, n: Literal("in", (t, SetTerm(tuple(sorted(set(m))))), n), terms, st.lists(st.text(string.ascii_letters, max_size=3), max_size=3), st.booleans())


@given(plain, st.lists(st.one_of(plain, members), max_size=3))
def test_rendered_clauses_come_back(head, body):
    clause = Clause(head, tuple(body))
    assert parse(render.clause(clause))[0].clause == clause


@given(st.text(string.printable, max_size=30))
def test_any_text_is_parsed_or_refused(text):
    try:
        parse(text)
    except ParseError as e:
        assert e.line >= 1 and e.column >= 1
