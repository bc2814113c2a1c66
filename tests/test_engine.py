"""Programs and their answers."""

import io
import itertools
import os
import random

import pytest

from sparklog import C, Engine, L, Negate, NoFixpoint, NotStratified, Options, UnsafeClause, V, parse
from sparklog import render
from sparklog.errors import DatalogError, ParseError
from sparklog.plans import evaluate as evaluation
from sparklog.plans import rewrite
from sparklog.storage import Stored
from sparklog.terms import meet, variant
from tests.naive import evaluate


def answers(df):
    return {tuple(r) for r in df.collect()}


def run(spark, text, **options):
    return answers(Engine(spark, options=Options(**options)).load(text)[-1])


def pairs(text):
    return {tuple(x) for x in text.split()}


CASES = {
    "three relations meet": ("num(one). num(two). num(three). gap(one, three). gap(one, four). both(P, Q) :- num(P), num(Q), gap(P, Q). both(P, Q)?", {("one", "three")}),
    "two predicates, each from the other": ("ping(seed). pong(N) :- ping(N). ping(N) :- pong(N). pong(N)?", {("seed",)}),
    "forebears": ("child(y, x). child(z, y). child(w, z). above(P, Q) :- child(Q, P). above(P, Q) :- child(M, P), above(M, Q). above(P, Q)?", pairs("xy yz zw xz yw xw")),
    "a ring both ways": ("link(k, l). link(l, m). link(m, n). link(n, k). far(P, Q) :- link(P, Q). far(P, Q) :- link(P, M), far(M, Q). far(P, Q) :- far(P, M), link(M, Q). far(P, Q)?", set(itertools.product("klmn", repeat=2))),
    "rights that are passed on": (
        "holds(root, shelf, sofa, ann). holds(ann, fetch, sofa, will). sure(root). holds(root, fetch, What, Who) :- holds(root, shelf, What, Owner), holds(Owner, fetch, What, Who). "
        "may(Who, Do, What) :- sure(By), holds(By, Do, What, Who). may(Who, Do, What)?",
        {("ann", "shelf", "sofa"), ("will", "fetch", "sofa")},
    ),
    "long names": ("a" * 90 + "('" + "Z" * 80 + "'). " + "a" * 90 + "(X)?", {("Z" * 80,)}),
    "a proposition": ("fine. fine?", {(True,)}),
    "one that isn't so": ("fine. bad?", set()),
    "a negation": ("all(p). all(q). out(p). left(X) :- all(X), !out(X). left(X)?", {("q",)}),
    "a negation first": ("all(p). all(q). out(p). left(X) :- !out(X), all(X). left(X)?", {("q",)}),
    "two negations": ("all(p). all(q). all(r). out(p). gone(q). left(X) :- all(X), !out(X), !gone(X). left(X)?", {("r",)}),
    "a member": ("pick(X) :- X in [p, q]. pick(p)?", {("p",)}),
    "all members": ("pick(X) :- X in [p, q, p]. pick(Any)?", {("p",), ("q",)}),
    "no member": ("fine() :- !r in [p, q]. fine?", {(True,)}),
    "an empty set": ("all(p). none(X) :- all(X), X in []. none(X)?", set()),
    "not in an empty set": ("all(p). some(X) :- all(X), !X in []. some(X)?", {("p",)}),
    "members of whole numbers": ("pick(X) :- X in [1, '01']. pick(X)?", {("1",), ("01",)}),
    "a member asked for": ("X in [p, q]?", {("p",), ("q",)}),
    "many variables": (f"u(a). m({', '.join(f'V{i}' for i in range(11))}) :- {', '.join(f'u(V{i})' for i in range(11))}. m({', '.join(f'W{i}' for i in range(11))})?", {("a",) * 11}),
    "taken back": ("at(p, q). at(q, r). at(p, q)~ at(X, Y)?", {("q", "r")}),
    "a head that repeats": ("u(a). u(b). same(X, X) :- u(X). same(P, Q)?", {("a", "a"), ("b", "b")}),
    "a query that repeats": ("at(p, q). at(r, r). at(X, X)?", {("r", "r")}),
    "arity counts": ("p(a). p(b, c). p(X)?", {("a",)}),
    "an unknown predicate": ("nobody(X)?", set()),
    "a guard": ("u(a). go. yes(X) :- u(X), go(). yes(X)?", {("a",)}),
    "a guard that fails": ("u(a). yes(X) :- u(X), go(). yes(X)?", set()),
    "the absence of a proposition": ("u(a). yes(X) :- u(X), !go(). yes(X)?", {("a",)}),
    "paths of paths": ("e(p, q). e(q, r). e(r, s). e(s, t). t(X, Y) :- e(X, Y). t(X, Y) :- t(X, Z), t(Z, Y). t(p, Y)?", pairs("pq pr ps pt")),
    "negation over recursion": ("v(p). v(q). v(r). e(p, q). t(X, Y) :- e(X, Y). t(X, Y) :- e(X, Z), t(Z, Y). no(X, Y) :- v(X), v(Y), !t(X, Y). no(p, Y)?", pairs("pp pr")),
    "for all": ("c(p). c(q). o(p, done). o(q, done). o(q, open). bad(X) :- o(X, S), !S in [done]. good(X) :- c(X), !bad(X). good(X)?", {("p",)}),
    "constants in recursion": ("s(p, one). s(X, two) :- s(X, one). s(X, three) :- s(X, two). s(X, three)?", {("p", "three")}),
    "recursive propositions": ("go() :- on(). on() :- go(). on. go?", {(True,)}),
    "facts in a recursive predicate": ("t(z, z). e(a, b). e(b, z). t(X, Y) :- e(X, Y). t(X, Y) :- e(X, M), t(M, Y). t(a, Y)?", pairs("ab az")),
}


@pytest.mark.parametrize("name", CASES)
def test_program(spark, name):
    text, expected = CASES[name]
    assert run(spark, text) == expected


@pytest.mark.parametrize("options", [{"doubling": False}, {"magic": False}, {"doubling": False, "magic": False}])
def test_rewrites_change_nothing(spark, options):
    for name in ("a ring both ways", "paths of paths", "facts in a recursive predicate"):
        text, expected = CASES[name]
        assert run(spark, text, **options) == expected


def test_refusals(spark):
    engine = Engine(spark)
    with pytest.raises(UnsafeClause):
        engine.add(L("p", V("X")))
    with pytest.raises(DatalogError):
        engine.ask(Negate(L("p", "a")))
    engine.load("win(X) :- move(X, Y), !win(Y). move(a, b).")
    with pytest.raises(NotStratified):
        engine.ask("win(X)")


def test_bound_on_rounds(spark):
    with pytest.raises(NoFixpoint):
        run(spark, CASES["forebears"][0], max_rounds=1, doubling=False)


def test_program_changes_after_a_query(spark):
    engine = Engine(spark)
    engine.load("u(a). w(X) :- u(X). only(X) :- u(X), !x(X).")
    assert answers(engine.ask("w(X)")) == {("a",)} and answers(engine.ask("only(X)")) == {("a",)}
    engine.load("u(b). x(a).")
    assert answers(engine.ask("w(X)")) == {("a",), ("b",)} and answers(engine.ask("only(X)")) == {("b",)}
    assert engine.retract(L("u", "b")) and not engine.retract(L("u", "zzz"))
    assert answers(engine.ask("w(X)")) == {("a",)}


def test_text_of_answers_comes_back(spark):
    engine = Engine(spark)
    engine.load("p('B c', x). p(a, 'Y'). go.")
    text = engine.text("p(X, Y)")
    assert text == "p('B c', x).\np(a, 'Y').\n" and engine.text("go") == "go.\n"
    assert {c.clause.head for c in parse(text)} == {c.head for c in engine.clauses[("p", 2)]}


def test_quotes_and_any_other_value_come_back(spark):
    values = ["it's", "''", "'", "B c", "", "X", "a\nb", "%", "_", "in", "é", "-x", "1"]
    engine = Engine(spark)
    for v in values:
        engine.add(L("p'q", v))
    text = engine.text(L("p'q", V("X")))
    assert {c.clause.head for c in parse(text)} == {L("p'q", v) for v in values}
    other = Engine(spark)
    other.load(io.StringIO(text))
    assert other.text(L("p'q", V("X"))) == text


def test_commands_before_an_error(spark):
    for bad in ("p(a). q(b). r(", "p(a). q(b). r('c", "p(a). q(b). ;", "p(a). q(b). r(c) s(d)."):
        with pytest.raises(ParseError) as error:
            parse(io.BytesIO(bad.encode()))
        assert [c.clause.head for c in error.value.commands] == [L("p", "a"), L("q", "b")]


def counted(spark):
    """A source of ten rows, and how often one was read."""
    reads = spark.sparkContext.accumulator(0)

    def read(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    return spark.range(10).repartition(1).mapInArrow(read, "id long"), reads


@pytest.mark.parametrize(("keep", "expected"), [("always", 10), ("repeated", 20), ("never", 30)])
def test_answers_are_kept(spark, keep, expected):
    source, reads = counted(spark)
    with Engine(spark, options=Options(keep=keep)) as engine:
        engine.register("s", source, ["id"])
        engine.load("p(X) :- s(X).")
        for name in "XYZ":
            assert len(answers(engine.ask(L("p", V(name))))) == 10
        assert reads.value == expected and engine.cache.hits == (0 if keep == "never" else 2)
        engine.invalidate("s(X)")
        assert len(answers(engine.ask("p(X)"))) == 10
        assert reads.value == expected + 10


def test_patterns_clear_what_they_meet(spark):
    engine = Engine(spark)
    engine.load("foo(a). foo(b). far(b). bar(X) :- foo(X). baz(X) :- foo(X), !far(X). one(a) :- far(a).")
    for query in ("bar(a)", "bar(b)", "bar(X)", "baz(a)", "one(X)", "foo(b)"):
        engine.ask(query)

    def kept():
        return {render.literal(k) for k in engine.cache.answers}

    assert len(kept()) == 6
    report = engine.invalidate("far(b)")  # only baz(b) may have changed
    assert report.answers == () and len(kept()) == 6
    report = engine.invalidate("far(a)")
    assert {render.literal(x) for x in report.answers} == {"baz(a)", render.literal(variant(L("one", V("X"))))}
    report = engine.invalidate("foo(b)")
    assert {x.predicate for x in report.answers} == {"bar", "foo"} and "bar(a)" in kept() and "bar(b)" not in kept()
    engine.load("foo(c).")
    assert kept() == {"bar(a)"} and answers(engine.ask("bar(X)")) == {("a",), ("b",), ("c",)}
    engine.load("foo(a)~")
    assert answers(engine.ask("bar(a)")) == set()


def test_literals_meet():
    x, y = V("X"), V("Y")
    assert meet(L("p", x, x), L("p", "a", y)) == {"X": "a"} and meet(L("p", x, x), L("p", "a", "b")) is None
    assert meet(L("p", x, y), L("p", y, "c")) == {"Y": "c"} and meet(L("p", x), L("q", x)) is None
    assert meet(L("p", x, y, x), L("p", y, y, "a")) == {"X": "a", "Y": "a"} and meet(L("p", "a"), L("p", x)) == {}


def test_all_proofs(spark):
    engine = Engine(spark)
    engine.load("e(a, b). e(b, c). e(a, 'D''d'). e('D''d', c). t(X, Y) :- e(X, Y). t(X, Y) :- e(X, Z), t(Z, Y). t(a, c). w(X) :- X in [a], !e(X, a).")
    engine.register("t", spark.createDataFrame([("a", "c"), ("a", "c")], "x string, y string"))
    lines = sorted(tuple(r) for r in engine.proofs("t(a, c)").collect())
    step = "t(X, Y) :- e(X, Z), t(Z, Y)."
    assert lines == sorted([("fact", None, "t(a, c)."), ("external", None, "t(a, c). % from a source"), ("rule", step, "t(a, c) :- e(a, b), t(b, c)."), ("rule", step, "t(a, c) :- e(a, 'D''d'), t('D''d', c).")], key=lambda r: (r[0], r[1] or "", r[2])) or len(lines) == 4
    assert {c.clause.body for c in parse(" ".join(r[2] for r in lines if r[0] == "rule"))} == {(L("e", "a", z), L("t", z, "c")) for z in ("b", "D'd")}
    assert [r["line"] for r in engine.proofs("w(a)").collect()] == ["w(a) :- a in [a], !e(a, a)."]
    assert engine.proofs("t(c, a)").count() == 0


def test_rounds_are_merged(spark, monkeypatch):
    monkeypatch.setattr(Stored, "MERGE", 2)
    facts = " ".join(f"e(n{i}, n{i + 1})." for i in range(12))
    with Engine(spark, options=Options(doubling=False)) as engine:
        engine.load(facts + " t(X, Y) :- e(X, Y). t(X, Y) :- t(X, Z), e(Z, Y).")
        assert answers(engine.ask("t(X, Y)")) == {(f"n{i}", f"n{j}") for i in range(13) for j in range(i + 1, 13)}
        (stored,) = engine._tables
        assert stored.merged[1] >= 8 and len(stored) == 78
        rounds = stored.by_round().groupBy("_round").count().collect()
        assert {r["_round"]: r["count"] for r in rounds} == {i: 12 - i for i in range(12)}
        assert len(engine.steps("t(n0, n12)")) == 24
        paths = [stored.merged[0], stored.rounds[-1][0]]
    assert not engine._tables and not any(os.path.exists(p.removeprefix("file:").replace("//", "/")) for p in paths if p)


def program_of(rng):
    """A random stratified program over a few predicates and constants."""
    consts, lines = "abc", []
    for _ in range(rng.randrange(3, 9)):
        lines.append(f"e{rng.randrange(2)}({rng.choice(consts)}, {rng.choice(consts)}).")
    for i in range(2):
        lines.append(f"u{i}({rng.choice(consts)}).")
    binary = ["e0", "e1", "r0", "r1"]
    for i in range(2):
        lines.append(f"r{i}(X, Y) :- {rng.choice(binary)}(X, Y).")
        for _ in range(rng.randrange(1, 3)):
            x, y = rng.choice(["XZ", "ZX", "XY"]), rng.choice(["ZY", "YZ"])
            extra = rng.choice(["", ", u0(X)", ", !u1(Z)", ", X in [a, b]"])
            lines.append(f"r{i}(X, Y) :- {rng.choice(binary)}({x[0]}, {x[1]}), {rng.choice(binary)}({y[0]}, {y[1]}){extra}.")
    lines.append(f"n(X, Y) :- u0(X), {rng.choice(binary)}(Y, Z), !r{rng.randrange(2)}(X, Y).")
    return lines


@pytest.mark.parametrize("seed", range(6))
def test_random_programs(spark, seed):
    rng = random.Random(seed)
    lines = program_of(rng)
    clauses = [parse(x)[0].clause for x in lines]
    rules = {}
    for c in clauses:
        rules.setdefault(c.head.key, []).append(c)
    shuffled = [C(c.head, *rng.sample(c.body, len(c.body))) for c in rng.sample(clauses, len(clauses))]
    engine = Engine(spark)
    for c in shuffled:
        engine.add(c)
    for key in (("r0", 2), ("n", 2)):
        expected = evaluate(rules, key)
        assert answers(engine.ask(L(key[0], V("X"), V("Y")))) == expected, lines
        bound = Engine(spark)
        for c in shuffled:
            bound.add(c)
        assert answers(bound.ask(L(key[0], "a", V("Y")))) == {r for r in expected if r[0] == "a"}, lines


SAME = "sg(X, Y) :- par(X, Z), par(Y, Z). sg(X, Y) :- par(X, A), sg(A, B), par(Y, B)."
#: Recursions, with the places that hold a class: of one source, of two, of rows of three values, beside another value; none.
BY_CLASS = {
    SAME: {0, 1},
    "sg(X, Y) :- par(X, Y). sg(X, Y) :- par(X, A), sg(A, Y).": set(),  # the second argument comes from two literals
    "sg(X, Y) :- par(X, Z), old(Z, Y). sg(X, Y) :- par(X, A), sg(A, B), next(B, Y).": set(),  # one place doesn't do
    "sg(X, Y) :- par(X, Z), old(Y, Z). sg(X, Y) :- par(X, A), sg(A, B), old(Y, B).": {0, 1},
    "sg(X, Y) :- by(X, Z, W), by(Y, Z, W). sg(X, Y) :- by(X, A, B), sg(A, B), by(Y, C, _), sg(C, _).": {0, 1},
    "sg(X, Y) :- par(X, Z), par(Y, Z). sg(X, Y) :- par(X, A), sg(A, A), par(Y, A).": set(),
    "sg(X, Y) :- par(X, Z), par(Y, Z), !old(Z, Z). sg(X, Y) :- par(X, A), sg(A, B), par(Y, B), old(A, _).": set(),
    "sg(X, Y, Z) :- par(X, Z), par(Y, Z). sg(X, Y, Z) :- par(X, A), sg(A, B, Z), par(Y, B).": {0, 1},
    "sg(X, X) :- par(X, Z). sg(X, Y) :- par(X, A), sg(A, B), par(Y, B).": set(),
    "sg(X, Y) :- par(X, Z), par(Y, Z). sg(X, Y) :- par(X, A), sg(A, B), next(B, C), par(Y, C).": {0, 1},
}


def test_recursion_over_classes(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "BLOCK", 2)
    monkeypatch.setattr(evaluation, "TASK_ROWS", 5)
    rng = random.Random(1)
    edges = {(f"{'abc'[k]}{i}", f"{'bcd'[k]}{rng.randrange(3 - k)}") for k in range(3) for i in range(12 // (1 + 2 * k)) for _ in range(rng.randrange(1, 3))}
    facts = [f"{name}({x}, {y})." for x, y in sorted(edges) for name in ("par", "old")[: rng.randrange(1, 3)]]
    facts += [f"next({x}, {y})." for x, y in zip("b0 b1 c0 d0 c1".split(), "b1 c0 c1 d0 c0".split())] + [f"by({x}, {y}, {z})." for x, y in sorted(edges) for z in ("b0", "c0")]
    for text, places in BY_CLASS.items():
        rules = {}
        for c in (x.clause for x in parse(" ".join(facts) + text)):
            rules.setdefault(c.head.key, []).append(c)
        (key,) = (k for k in rules if k[0] == "sg")
        found = rewrite.by_class(rules[key])
        assert set(found[1] if found else ()) == places, text
        if not places:
            continue
        expected = evaluate(rules, key)
        with Engine(spark) as engine:
            engine.load(" ".join(facts) + text + " no(X, Y) :- par(X, _), par(Y, _), !sg(X, Y).")
            rows = [tuple(r) for r in engine.ask(L("sg", *map(V, "XYZ"[: key[1]]))).collect()]
            assert len(rows) == len(expected) and set(rows) == expected, text
            if text == SAME:
                assert answers(engine.ask("no(X, Y)")) == {r for r in itertools.product({x for x, _ in edges}, repeat=2) if r not in expected}
                assert answers(engine.ask("sg(a1, Y)")) == {r for r in expected if r[0] == "a1"}


def test_same_generation_stores_classes(spark):
    leaves = spark.range(600).selectExpr("id AS x", "concat('n', id % 3) AS y")
    with Engine(spark) as engine:
        engine.register("par", leaves, ["x", "y"])
        engine.load(SAME)
        df = engine.ask("sg(X, Y)")
        assert df.count() == 3 * 200 * 200 == df.distinct().count()
        assert sum(map(len, engine._tables)) < 600
        assert answers(engine.ask("sg(5, Y)")) == {("5", str(y)) for y in range(2, 600, 3)}
        assert [s.how for s in engine.steps("sg(5, 8)")] == ["rule", "external", "external"]


def test_classes_with_equal_hashes(spark, monkeypatch):
    """Values of as many rows, but other ones, are told apart where hashes don't."""
    monkeypatch.setattr(evaluation.F, "xxhash64", lambda *_: evaluation.F.lit(7).cast("bigint"))
    text = "par(a, x). par(b, x). par(c, y). par(d, y). par(e, x). par(f, x). par(f, y). "
    assert run(spark, text + SAME + " sg(X, Y)?") == set(itertools.product("abef", repeat=2)) | set(itertools.product("cdf", repeat=2))
