"""The query catalogue over the driver's tables, as programs, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import render
from .engine import Engine
from .errors import DatalogError
from .examples.access import AccessPolicy
from .parser import parse
from .terms import Ask, C, InSet, L, Literal, Negate, V, Var

Query = Callable[[SparkSession, str], DataFrame]

#: Predicates over the tables: columns in the order of the arguments.
SOURCES = {
    "region": ("region", ["r_regionkey", "r_name"]),
    "nation": ("nation", ["n_nationkey", "n_name", "n_regionkey"]),
    "customer": ("customer", ["c_custkey", "c_nationkey", "c_mktsegment"]),
    "supplier": ("supplier", ["s_suppkey", "s_nationkey"]),
    "part": ("part", ["p_partkey", "p_brand", "p_type"]),
    "orders": ("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]),
    "lineitem": ("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag"]),
    "events": ("events", ["event_id", "user_id", "event_type"]),
    "documents": ("documents", ["doc_id", "lang", "source"]),
    "labels": ("labels", ["doc_id", "quality", "toxic"]),
    "turn": ("conversations", ["conv_id", "turn", "role"]),
}

TRADE = "trade(A, B) :- supplier(S, A), lineitem(O, P, S, _), part(P, 'Brand#13', _), orders(O, C, _, '1-URGENT'), customer(C, B, 'MACHINERY')."
BOTH_WAYS = TRADE + " path(A, B) :- trade(A, B). path(A, B) :- trade(A, Z), path(Z, B). path(A, B) :- path(A, Z), trade(Z, B)."
URGENT = "urgent(C) :- orders(_, C, _, '1-URGENT')."
FOLLOWS = "reach(C, A, B) :- next(C, A, B). reach(C, A, B) :- reach(C, A, Z), next(C, Z, B)."


def engine_over(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine with all tables, and two computed sources: next turns, and parents of suppliers and nations."""
    engine = Engine(spark)
    for name, (table, columns) in SOURCES.items():
        engine.catalog.parquet(name, f"{sf_dir}/{table}.parquet", columns)

    def read(table: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{table}.parquet")

    def following() -> DataFrame:
        a = read("conversations").select(F.col("conv_id").alias("c"), F.col("turn").alias("a"))
        b = read("conversations").select(F.col("conv_id").alias("d"), F.col("turn").alias("b"))
        return a.join(b, (F.col("c") == F.col("d")) & (F.col("b") == F.col("a") + 1)).select("c", "a", "b")

    def parents() -> DataFrame:
        low = read("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("x"), F.concat(F.lit("n"), "s_nationkey").alias("y"))
        return low.unionByName(read("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("x"), F.concat(F.lit("r"), "n_regionkey").alias("y")))

    engine.register("next", following, ["c", "a", "b"])
    engine.register("par", parents, ["x", "y"])
    return engine


def _program(text: str) -> Query:
    """The answer of a program's last command."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine_over(spark, sf_dir).load(text)[-1]

    return run


def _enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    names = {"F": "Filled", "O": "Open", "P": "Pending"}
    engine.catalog.parquet("orders", f"{sf_dir}/orders.parquet", ["o_orderkey", "o_orderstatus"], encoders={"o_orderstatus": names})
    return engine.load("p(O) :- orders(O, 'Pending'). p(O)?")[-1]


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir)
    engine.catalog.parquet("name", f"{sf_dir}/region.parquet", ["r_name"])
    return engine.load("name(special). name(X) :- nation(_, X, _). name(X)?")[-1]


def _after(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir)
    engine.load("known(N) :- region(_, N).")
    engine.ask("known(N)")
    engine.load("known('ATLANTIS').")
    return engine.ask("known(N)")


def _api(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = engine_over(spark, sf_dir).apply(Ask(L("nation", V("K"), V("N"), 1)))
    assert answer is not None
    return answer


def _builders(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir)
    engine.add(C(L("some", V("K")), L("nation", V("K"), V("_"), V("R")), InSet(V("R"), 0, 2), Negate(L("supplier", V("K"), V("R")))))
    return engine.ask(L("some", V("K")))


def _retracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_over(spark, sf_dir).load("known(N) :- region(_, N). known(atlantis). known(lemuria). known(lemuria)~ known(N)?")[-1]


def _access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that each customer may do, with market segments as roles."""
    users = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    return AccessPolicy.of_segments(spark, users).permissions()


def _proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir)
    engine.load("local(C, S) :- customer(C, N, _), orders(O, C, _, _), lineitem(O, _, S, _), supplier(S, N).")
    first = engine.ask("local(C, S)").orderBy(F.col("c0").cast("long"), F.col("c1").cast("long")).first()
    return engine.proof_frame(L("local", *first)) if first else spark.createDataFrame([], "step int, line string, how string")


def _proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every last step of the proofs of one fact."""
    engine = engine_over(spark, sf_dir)
    engine.load("at(N, R) :- nation(N, _, R). at(N, R) :- supplier(S, N), nation(N, _, R), region(R, _).")
    return engine.proofs("at('3', '3')")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as program text, values that need quotes among them."""
    engine = engine_over(spark, sf_dir)
    engine.load("told(N, 'it''s', X) :- region(N, X). told(N, plain, X) :- nation(N, X, 1), region(1, _).")
    return engine.lines("told(A, B, C)")


def _clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of several forms, parsed, written and parsed again."""
    text = "a(X):-b(X,'Y z'),!c(X),X in[p,'Q'].b('it''s','_1x').go.on:-go,!off. 'P q'(x, 1-2)?"
    written = [render.command(c) for c in parse(text)]
    assert [render.command(c) for c in parse(" ".join(written))] == written
    return spark.createDataFrame(list(enumerate(written)), "place long, line string")


def _safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether programs are taken, and why not."""
    programs = ["p(X).", "p(X) :- q(Y).", "p(X) :- q(X), !r(X, Y).", "p(X) :- !q(X).", "!p(a).", "p(X) :- q(X), X in Y.", "p([a]).", "p(X) :- !r(X), q(X).", "p(X) :- X in [a].", "p(X) :- q(X)", "p(X) :- q(X), !p(X). p(a)?"]
    found = []
    for text in programs:
        try:
            Engine(spark).load(text)
            found.append((text, "taken"))
        except DatalogError as error:
            found.append((text, type(error).__name__))
    return spark.createDataFrame(found, "program string, outcome string")


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which answers stay when rows of a pattern have changed."""
    engine = engine_over(spark, sf_dir)
    engine.load("near(A, R) :- nation(A, _, R). far(A) :- nation(A, _, 2). none(R) :- region(R, _), at(A), !near(A, R). at(0).")
    for query in ("near(A, 1)", "near(A, 2)", "near(A, R)", "far(A)", "none(1)", "none(2)"):
        engine.ask(query)
    engine.invalidate("nation(_, _, 1)")
    left = [Literal(a.predicate, tuple(V("_") if isinstance(t, Var) else t for t in a.terms)) for a in engine.cache.answers]
    return spark.createDataFrame([(render.literal(a),) for a in left], "kept string")


def _bound_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that is a call gets the constants that a rule's body has for it."""
    asked: list[dict[int, str]] = []

    def orders(bound: dict[int, str]) -> DataFrame:
        asked.append(bound)
        df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")
        return df.where(F.col("o_orderstatus") == bound[1]) if 1 in bound else df

    engine = Engine(spark)
    engine.register("o", orders, ["o_orderkey", "o_orderstatus"], bound_calls=True)
    answer = engine.load("open(K) :- o(K, 'P'). open(K)?")[-1]
    return answer.select("c0", F.lit("; ".join(sorted({f"{i}={v}" for b in asked for i, v in b.items()}))).alias("bound"))


def _ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that changes under the engine: what is seen before and after its time is over."""
    now = [0.0]
    engine = Engine(spark, clock=lambda: now[0])
    tables = iter(("region", "nation"))

    def source() -> DataFrame:
        t = next(tables)
        return spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.col(f"{t[0]}_name").alias("name"))

    engine.register("place", source, ["name"], ttl=10.0)
    engine.load("seen(X) :- place(X).")
    before = engine.ask("seen(X)").select(F.lit("before").alias("at"), "c0")
    now[0] = 5.0
    still = engine.ask("seen(X)").select(F.lit("within").alias("at"), "c0")
    now[0] = 11.0
    return before.unionByName(still).unionByName(engine.ask("seen(X)").select(F.lit("after").alias("at"), "c0"))


def _invalidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept before and after an invalidation of a source."""
    engine = engine_over(spark, sf_dir)
    engine.load("near(A, B) :- nation(A, _, R), nation(B, _, R). other(S) :- customer(_, _, S).")
    engine.ask("near(A, B)")
    engine.ask("other(S)")
    report = engine.invalidate("nation(_, _, _)")
    return spark.createDataFrame([(f"{k[0]}/{k[1]}", "cleared") for k in report.cleared] + [(f"{k[0]}/{k[1]}", "kept") for k in sorted(engine.cache.frames)], "predicate string, state string")


_ELEVEN = [f"V{i * 7 % 11}" for i in range(11)]
_MANY = f"one(R) :- region(R, 'ASIA'). many({', '.join(_ELEVEN)}) :- {', '.join(f'one({v})' for v in sorted(_ELEVEN))}. many({', '.join(_ELEVEN)})?"

PROGRAMS: dict[str, str] = {
    "q06_join": "local(C, S) :- customer(C, N, _), orders(O, C, _, _), lineitem(O, _, S, _), supplier(S, N). local(C, S)?",
    "q01_scan": "region(K, N)?",
    "q02_const_filter": "nation(K, N, '1')?",
    "q03_repeated_var": "cn(C, N) :- customer(C, N, _). cn(X, X)?",
    "q04_projection": "seg(S) :- customer(_, _, S). seg(S)?",
    "q05_head_const": "kind(K, nation) :- nation(K, _, _). kind(K, region) :- region(K, _). kind(K, T)?",
    "q07_selfjoin": "peer(A, B) :- nation(A, _, R), nation(B, _, R). peer(A, B)?",
    "q08_cross": "rs(R, S) :- region(R, _), customer(_, _, S). rs(R, S)?",
    "q09_semi": "active(U) :- customer(U, _, _), orders(_, U, 'F', _). active(U)?",
    "q10_anti": URGENT + " calm(C) :- customer(C, _, _), !urgent(C). calm(C)?",
    "q11_two_negations": URGENT + " pend(C) :- orders(_, C, 'P', _). q(C) :- customer(C, _, _), !urgent(C), !pend(C). q(C)?",
    "q12_in_bound": "p(P) :- part(P, _, T), T in ['PROMO', 'ECONOMY']. p(P)?",
    "q13_in_enumerate": "s(X) :- X in [a, b, c]. s(X)?",
    "q14_not_in": "p(P) :- part(P, _, T), !T in ['PROMO']. p(P)?",
    "q15_intersect": "both(U) :- events(_, U, error), events(_, U, purchase). both(U)?",
    "q16_division": "bad(C) :- orders(_, C, S, _), !S in ['F']. allf(C) :- customer(C, _, _), !bad(C). allf(C)?",
    "q17_zero_arity": "any() :- orders(_, _, 'P', _). any?",
    "q18_linear_tc": FOLLOWS + " reach(C, A, B)?",
    "q19_left_right": BOTH_WAYS + " path(A, B)?",
    "q20_nonlinear": TRADE + " path(A, B) :- trade(A, B). path(A, B) :- path(A, Z), path(Z, B). path(A, B)?",
    "q21_mutual": "even(C, T) :- turn(C, T, _), T in ['0']. odd(C, B) :- even(C, A), next(C, A, B). even(C, B) :- odd(C, A), next(C, A, B). odd(C, T)?",
    "q22_bound_recursion": BOTH_WAYS + " path('14', B)?",
    "q23_same_generation": "sg(X, Y) :- par(X, Z), par(Y, Z). sg(X, Y) :- par(X, A), sg(A, B), par(Y, B). sg(X, Y)?",
    "q24_neg_over_rec": BOTH_WAYS + " unreach(A, B) :- nation(A, _, _), nation(B, _, _), !path(A, B). unreach(A, B)?",
    "q28_many_vars": _MANY,
    "q29_difference": "lab(D) :- labels(D, _, _). rest(D) :- documents(D, _, _), !lab(D). rest(D)?",
    "q31_repeated_head": "same(X, X) :- region(X, _). same(A, B)?",
    "q35_ground_query": "nation('3', N, R)?",
    "q36_empty_relation": "nothing(X)?",
    "q37_member_constant": "p(K) :- region(K, _), a in [a, b], !c in [a, b]. p(K)?",
    "q38_absent_guard": "none() :- orders(_, _, 'X', _). r(K) :- region(K, _), !none(). r(K)?",
}

_TRADE_SQL = """SELECT DISTINCT s_nationkey AS a, c_nationkey AS b FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey
JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE p_brand = 'Brand#13' AND o_orderpriority = '1-URGENT' AND c_mktsegment = 'MACHINERY'"""
_PATH_SQL = f"WITH RECURSIVE trade AS ({_TRADE_SQL}), path(a, b) AS (SELECT a, b FROM trade UNION SELECT path.a, trade.b FROM path JOIN trade ON path.b = trade.a)"
_NEXT_SQL = "SELECT x.conv_id AS c, x.turn AS a, y.turn AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1"


def _t(*columns: str) -> str:
    return ", ".join(f"CAST({c} AS VARCHAR) AS c{i}" for i, c in enumerate(columns))


def _q(column: str) -> str:
    """A value as a constant of program text."""
    text = f"CAST({column} AS VARCHAR)"
    return f"CASE WHEN regexp_full_match({text}, '[a-z0-9][A-Za-z0-9_-]*') THEN {text} ELSE '''' || replace({text}, '''', '''''') || '''' END"


def _fact(predicate: str, *columns: str) -> str:
    return f"'{predicate}(' || " + " || ', ' || ".join(map(_q, columns)) + " || ')'"


_LOCAL = "customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey"
_PREMISES = [
    _fact("customer", "c_custkey", "c_nationkey", "c_mktsegment"),
    _fact("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"),
    _fact("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag"),
    _fact("supplier", "s_suppkey", "s_nationkey"),
]
_PROOF_SQL = f"""WITH f AS (SELECT c_custkey AS c, s_suppkey AS s FROM {_LOCAL} ORDER BY 1, 2 LIMIT 1),
b AS (SELECT {_fact("local", "c_custkey", "s_suppkey")} AS h, {", ".join(f"{p} AS p{i}" for i, p in enumerate(_PREMISES))} FROM {_LOCAL} JOIN f ON c_custkey = c AND s_suppkey = s
ORDER BY CAST(c_nationkey AS VARCHAR), c_mktsegment, CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority, CAST(l_partkey AS VARCHAR), l_returnflag LIMIT 1)
SELECT 0 AS step, h || ' :- ' || p0 || ', ' || p1 || ', ' || p2 || ', ' || p3 || '.' AS line, 'rule' AS how FROM b
{" ".join(f"UNION ALL SELECT {i + 1}, p{i} || '. % from a source', 'external' FROM b" for i in range(4))}"""

SQL: dict[str, str] = {
    "q33_proof": _PROOF_SQL,
    "q42_all_proofs": f"""SELECT DISTINCT 'rule' AS how, 'at(N, R) :- nation(N, _, R).' AS rule, 'at(3, 3) :- ' || {_fact("nation", "n_nationkey", "n_name", "n_regionkey")} || '.' AS line FROM nation WHERE n_nationkey = 3 AND n_regionkey = 3
UNION SELECT 'rule', 'at(N, R) :- supplier(S, N), nation(N, _, R), region(R, _).', 'at(3, 3) :- ' || {_fact("supplier", "s_suppkey", "s_nationkey")} || ', ' || {_fact("nation", "n_nationkey", "n_name", "n_regionkey")} || ', ' || {_fact("region", "r_regionkey", "r_name")} || '.'
FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey = 3 AND n_regionkey = 3""",
    "q43_result_text": f"""SELECT 'told(' || {_q("r_regionkey")} || ', ''it''''s'', ' || {_q("r_name")} || ').' AS line FROM region
UNION SELECT 'told(' || {_q("n_nationkey")} || ', plain, ' || {_q("n_name")} || ').' FROM nation WHERE n_regionkey = 1""",
    "q44_clause_text": """SELECT CAST(place AS BIGINT) AS place, line FROM (VALUES (0, 'a(X) :- b(X, ''Y z''), !c(X), X in [''Q'', p].'), (1, 'b(''it''''s'', ''_1x'').'), (2, 'go.'), (3, 'on() :- go(), !off().'), (4, '''P q''(x, 1-2)?')) t(place, line)""",
    "q45_safety": """SELECT * FROM (VALUES ('p(X).', 'UnsafeClause'), ('p(X) :- q(Y).', 'UnsafeClause'), ('p(X) :- q(X), !r(X, Y).', 'UnsafeClause'), ('p(X) :- !q(X).', 'UnsafeClause'), ('!p(a).', 'UnsafeClause'), ('p(X) :- q(X), X in Y.', 'ParseError'),
('p([a]).', 'ParseError'), ('p(X) :- !r(X), q(X).', 'taken'), ('p(X) :- X in [a].', 'taken'), ('p(X) :- q(X)', 'ParseError'), ('p(X) :- q(X), !p(X). p(a)?', 'NotStratified')) t(program, outcome)""",
    "q46_patterns": "SELECT * FROM (VALUES ('near(_, 2)'), ('far(_)'), ('none(2)')) t(kept)",
    "q47_bound_calls": f"SELECT DISTINCT {_t('o_orderkey')}, '1=P' AS bound FROM orders WHERE o_orderstatus = 'P'",
    "q06_join": f"SELECT DISTINCT {_t('c_custkey', 's_suppkey')} FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey",
    "q01_scan": f"SELECT DISTINCT {_t('r_regionkey', 'r_name')} FROM region",
    "q02_const_filter": f"SELECT DISTINCT {_t('n_nationkey', 'n_name', 'n_regionkey')} FROM nation WHERE n_regionkey = 1",
    "q03_repeated_var": f"SELECT DISTINCT {_t('c_custkey', 'c_nationkey')} FROM customer WHERE c_custkey = c_nationkey",
    "q04_projection": f"SELECT DISTINCT {_t('c_mktsegment')} FROM customer",
    "q05_head_const": f"SELECT {_t('n_nationkey')}, 'nation' AS c1 FROM nation UNION SELECT {_t('r_regionkey')}, 'region' FROM region",
    "q07_selfjoin": f"SELECT DISTINCT {_t('a.n_nationkey', 'b.n_nationkey')} FROM nation a JOIN nation b USING (n_regionkey)",
    "q08_cross": f"SELECT DISTINCT {_t('r_regionkey', 'c_mktsegment')} FROM region, customer",
    "q09_semi": f"SELECT DISTINCT {_t('c_custkey')} FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "q10_anti": f"SELECT DISTINCT {_t('c_custkey')} FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "q11_two_negations": f"SELECT DISTINCT {_t('c_custkey')} FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND (o_orderpriority = '1-URGENT' OR o_orderstatus = 'P'))",
    "q12_in_bound": f"SELECT DISTINCT {_t('p_partkey')} FROM part WHERE p_type IN ('PROMO', 'ECONOMY')",
    "q13_in_enumerate": "SELECT c0 FROM (VALUES ('a'), ('b'), ('c')) t(c0)",
    "q14_not_in": f"SELECT DISTINCT {_t('p_partkey')} FROM part WHERE p_type NOT IN ('PROMO')",
    "q15_intersect": f"SELECT {_t('user_id')} FROM events WHERE event_type = 'error' INTERSECT SELECT {_t('user_id')} FROM events WHERE event_type = 'purchase'",
    "q16_division": f"SELECT DISTINCT {_t('c_custkey')} FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'F')",
    "q17_zero_arity": "SELECT true AS holds WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'P')",
    "q18_linear_tc": f"WITH RECURSIVE nx AS ({_NEXT_SQL}), r(c, a, b) AS (SELECT c, a, b FROM nx UNION SELECT r.c, r.a, nx.b FROM r JOIN nx ON nx.c = r.c AND nx.a = r.b) SELECT {_t('c', 'a', 'b')} FROM r",
    "q19_left_right": f"{_PATH_SQL} SELECT {_t('a', 'b')} FROM path",
    "q20_nonlinear": f"{_PATH_SQL} SELECT {_t('a', 'b')} FROM path",
    "q21_mutual": f"WITH RECURSIVE nx AS ({_NEXT_SQL}), r(c, t, odd) AS (SELECT conv_id, turn, 0 FROM conversations WHERE turn = 0 UNION SELECT r.c, nx.b, 1 - r.odd FROM r JOIN nx ON nx.c = r.c AND nx.a = r.t) SELECT {_t('c', 't')} FROM r WHERE odd = 1",
    "q22_bound_recursion": f"{_PATH_SQL} SELECT {_t('a', 'b')} FROM path WHERE a = 14",
    "q23_same_generation": """WITH RECURSIVE par AS (SELECT 's' || s_suppkey AS x, 'n' || s_nationkey AS y FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
sg(c0, c1) AS (SELECT a.x, b.x FROM par a JOIN par b ON a.y = b.y UNION SELECT a.x, b.x FROM par a JOIN sg ON a.y = sg.c0 JOIN par b ON b.y = sg.c1) SELECT c0, c1 FROM sg""",
    "q24_neg_over_rec": f"{_PATH_SQL} SELECT DISTINCT {_t('x.n_nationkey', 'y.n_nationkey')} FROM nation x, nation y WHERE NOT EXISTS (SELECT 1 FROM path WHERE a = x.n_nationkey AND b = y.n_nationkey)",
    "q28_many_vars": "SELECT DISTINCT " + _t(*["r_regionkey"] * 11) + " FROM region WHERE r_name = 'ASIA'",
    "q29_difference": f"SELECT {_t('doc_id')} FROM documents EXCEPT SELECT {_t('doc_id')} FROM labels",
    "q31_repeated_head": f"SELECT DISTINCT {_t('r_regionkey', 'r_regionkey')} FROM region",
    "q35_ground_query": f"SELECT DISTINCT {_t('n_nationkey', 'n_name', 'n_regionkey')} FROM nation WHERE n_nationkey = 3",
    "q36_empty_relation": "SELECT CAST(NULL AS VARCHAR) AS c0 WHERE false",
    "q37_member_constant": f"SELECT DISTINCT {_t('r_regionkey')} FROM region",
    "q38_absent_guard": f"SELECT DISTINCT {_t('r_regionkey')} FROM region",
    "q25_rbac": """WITH act(r, a, t) AS (VALUES ('BUILDING', 'View', 'Post'), ('BUILDING', 'View', 'Comment'), ('BUILDING', 'Create', 'Comment'), ('MACHINERY', 'Create', 'Post'), ('MACHINERY', 'Edit', 'Post'), ('MACHINERY', 'Delete', 'Post'), ('MACHINERY', 'Edit', 'Comment'), ('MACHINERY', 'Delete', 'Comment')),
m AS (SELECT a, t FROM act), full_ AS (SELECT * FROM act UNION SELECT 'MACHINERY', a, t FROM m UNION SELECT 'HOUSEHOLD', a, t FROM m)
SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS c0, a AS c1, t AS c2 FROM customer JOIN full_ ON r = c_mktsegment""",
    "q26_enum": f"SELECT DISTINCT {_t('o_orderkey')} FROM orders WHERE o_orderstatus = 'P'",
    "q27_mixed_sources": "SELECT r_name AS c0 FROM region UNION SELECT 'special' UNION SELECT n_name FROM nation",
    "q30_assert_after_query": "SELECT r_name AS c0 FROM region UNION SELECT 'ATLANTIS'",
    "q32_api": f"SELECT DISTINCT {_t('n_nationkey', 'n_name', 'n_regionkey')} FROM nation WHERE n_regionkey = 1",
    "q34_ttl": "SELECT 'before' AS at, r_name AS c0 FROM region UNION ALL SELECT 'within', r_name FROM region UNION ALL SELECT 'after', n_name FROM nation",
    "q39_builders": f"SELECT DISTINCT {_t('n_nationkey')} FROM nation WHERE n_regionkey IN (0, 2) AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = n_nationkey AND s_nationkey = n_regionkey)",
    "q40_retract": "SELECT r_name AS c0 FROM region UNION SELECT 'atlantis'",
    "q41_invalidate": "SELECT * FROM (VALUES ('nation/3', 'cleared'), ('near/2', 'cleared'), ('customer/3', 'kept'), ('other/1', 'kept')) t(predicate, state)",
}


def queries() -> dict[str, Query]:
    """The catalogue; the first one is the flagship."""
    return {name: _program(text) for name, text in PROGRAMS.items()} | {
        "q25_rbac": _access,
        "q26_enum": _enum,
        "q27_mixed_sources": _mixed,
        "q30_assert_after_query": _after,
        "q32_api": _api,
        "q33_proof": _proof,
        "q42_all_proofs": _proofs,
        "q43_result_text": _lines,
        "q44_clause_text": _clauses,
        "q45_safety": _safety,
        "q46_patterns": _patterns,
        "q47_bound_calls": _bound_calls,
        "q34_ttl": _ttl,
        "q39_builders": _builders,
        "q40_retract": _retracted,
        "q41_invalidate": _invalidated,
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
