"""Lexer, parser, binder, and the values of expressions. Statements that don't write run without a warehouse."""

import pytest

from loomql import Engine, SemanticFault, SyntaxFault
from loomql.plans import syntax as S
from loomql.plans.lexer import split_statements, tokenize
from loomql.plans.parser import parse


@pytest.fixture(scope="module")
def one(spark):
    engine = Engine(spark)
    engine.register_frame("one", spark.createDataFrame([(1, 2.5, "Ab", True, None)], "i bigint, f double, s string, b boolean, n bigint"))
    engine.register_frame("xs", spark.createDataFrame([(1, 10), (2, None), (3, 30)], "id bigint, v bigint"))
    return engine


def value(engine, text):
    return engine.execute(f"FETCH {text} AS x FROM one").rows()[0][0]


def test_tokens_have_places_and_words_any_case():
    tokens = tokenize("fetch a,\n 'it''s' -- note\n >= 1.5")
    assert [(t.kind, t.value) for t in tokens] == [("key", "FETCH"), ("word", "a"), ("mark", ","), ("text", "it's"), ("mark", ">="), ("float", "1.5"), ("end", "end of input")]
    assert (tokens[3].line, tokens[3].column) == (2, 2)


def test_semicolons_in_strings_and_comments_split_nothing():
    assert split_statements("FETCH a FROM t WHEN s = ';'; -- x;y\nUNDO;") == ["FETCH a FROM t WHEN s = ';'", "-- x;y\nUNDO"]


def test_precedences():
    q = parse("FETCH a FROM t WHEN NOT a = 1 + 2 * 3 OR b = 1 AND c IS NOT NULL")
    assert S.shown(q.when) == "((NOT (a = (1 + (2 * 3)))) OR ((b = 1) AND (c IS NOT NULL)))"


def test_set_operations_associate_to_the_left():
    q = parse("FETCH a FROM t UNION ALL FETCH a FROM u EXCEPT FETCH a FROM v")
    assert q.op == "EXCEPT" and q.left.op == "UNION ALL"


@pytest.mark.parametrize("text", ["FETCH FROM t", "FETCH a t", "PUT INTO t VALUES (a)", "FETCH a FROM t SORT a", "FETCH a FROM t TAKE x", "BUILD RELATION t (a)", "FETCH a FROM t INNER LINK", "FETCH CAST(a AS DECIMAL(3,2)) FROM t", "FETCH a FROM t WHEN a = 1 = 2", "FETCH @ FROM t", "DISCARD t"])
def test_syntax_errors(text):
    with pytest.raises(SyntaxFault) as e:
        parse(text)
    assert "syntax error at line 1, column " in str(e.value)


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("7 / 2", 3), ("-7 / 2", -3), ("7 / 0", None), ("7 / 2.0", 3.5), ("f / 0", None), ("MOD(-7, 3)", -1), ("MOD(7, 0)", None), ("1 + 2 * 3 - -4", 11),
        ("SUBSTR('hello', 2, 3)", "ell"), ("SUBSTR('hello', 0, 3)", "hel"), ("SUBSTR('hello', 9)", ""), ("SUBSTR('hello', 2, -1)", ""), ("SUBSTR('hello', 4, NULL)", "lo"),
        ("LENGTH('é')", 2), ("TRIM('\t a b \n')", "a b"), ("UPPER(s)", "AB"), ("UPPER(12)", "12"), ("ABS(-2.5)", 2.5), ("CEIL(2.1)", 3), ("FLOOR(-2.1)", -3),
        ("ROUND(2.5)", 3.0), ("ROUND(-2.5)", -3.0), ("ROUND(1.005, 2)", 1.0), ("COALESCE(NULL, n, 5)", 5), ("NULLIF(4, 4)", None), ("NULLIF(4, 5)", 4),
        ("CAST(2.9 AS INT)", 2), ("CAST(-2.9 AS INT)", -2), ("CAST('12abc' AS INT)", 12), ("CAST('abc' AS INT)", None), ("CAST('1.5e1x' AS FLOAT)", 15.0), ("CAST(TRUE AS TEXT)", "TRUE"),
        ("CAST(0 AS BOOL)", False), ("CAST('x' AS BOOL)", None), ("CAST(b AS FLOAT)", None), ("CAST(12 AS VARCHAR(1))", "12"),
        ("CASE WHEN i > 5 THEN 1 WHEN i = 1 THEN 2.5 END", 2.5), ("CASE WHEN i > 5 THEN 1 END", None),
        ("(n = 1 OR i = 1)", True), ("(n = 1 AND i = 2)", False), ("(n = 1 AND i = 1)", None), ("(NOT n = 1)", None), ("(i IN (1, NULL))", True), ("(i IN (2, NULL))", None), ("(i NOT IN (2, 3))", True),
        ("(2 BETWEEN 1 AND 3)", True), ("(5 NOT BETWEEN 1 AND n)", None), ("('a%b' LIKE 'a%')", True), ("('a\\b' LIKE 'a\\b')", True), ("('Ab' LIKE '_b')", True), ("('ab' LIKE 'A%')", False), ("(i = 1.0)", True),
    ],
)
def test_values(one, text, wanted):
    assert value(one, text) == wanted


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("FETCH x FROM nope", "unknown table 'nope'"), ("FETCH x FROM one", "unknown column 'x' in table 'one'"), ("FETCH z.i FROM one", "unknown table qualifier 'z'"),
        ("FETCH i FROM one WHEN i = 'a'", "type mismatch in comparison: INT vs TEXT"), ("FETCH s + 1 FROM one", "arithmetic operator requires numeric operands"), ("FETCH i FROM one WHEN i LIKE 'a'", "LIKE requires a text operand"),
        ("FETCH i FROM one WHEN i IN ('a')", "type mismatch in IN list"), ("FETCH SUM(s) FROM one", "SUM requires a numeric column"), ("FETCH SUM(*) FROM one", "SUM(*) is not allowed"), ("FETCH ABS(1, 2) FROM one", "ABS takes 1 argument(s)"),
        ("FETCH nope(1) FROM one", "unknown function 'nope'"), ("FETCH NTILE() OVER () FROM one", "unknown window function 'ntile'"), ("FETCH id FROM xs a LINK xs b ON a.id = b.id", "ambiguous column 'id'"), ("FETCH i FROM one WHEN i", "a condition must be boolean"),
        ("FETCH i FROM one UNION FETCH id, v FROM xs", "set operation requires matching column counts"),
    ],
)
def test_semantic_errors(one, text, message):
    with pytest.raises(SemanticFault) as e:
        one.execute(text)
    assert message in str(e.value)


def test_names_are_told_apart_by_case(spark):
    engine = Engine(spark)
    engine.register_frame("t", spark.createDataFrame([(1,)], "Abc bigint"))
    assert engine.execute("FETCH Abc FROM t").rows() == [(1,)]
    with pytest.raises(SemanticFault):
        engine.execute("FETCH abc FROM t")


def test_nulls_sort_first_and_last(one):
    assert [r[0] for r in one.execute("FETCH id FROM xs SORT BY v").rows()] == [2, 1, 3]
    assert [r[0] for r in one.execute("FETCH id FROM xs SORT BY v DESC").rows()] == [3, 1, 2]


def test_window_sum_of_nulls_is_zero(one):
    assert one.execute("FETCH id, SUM(v) OVER (PARTITION BY id) AS s FROM xs SORT BY id").rows() == [(1, 10), (2, 0), (3, 30)]


def test_scalar_subquery_takes_the_first_row(one):
    assert value(one, "(FETCH id FROM xs SORT BY id DESC)") == 3
    assert value(one, "(FETCH id FROM xs WHEN id > 9)") is None


def test_a_query_is_one_lazy_frame_with_pushed_filters(spark):
    engine = Engine(spark)
    engine.register_parquet("lineitem", "/root/testdata/sf0.001/lineitem.parquet")
    frame = engine.frame("FETCH l_orderkey FROM lineitem WHEN l_quantity < 5")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), LessThan(l_quantity,5.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_streams(spark, tmp_path):
    from loomql import streaming

    spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, s string").write.parquet(str(tmp_path / "in"))
    engine = Engine(spark)
    engine.register_frame("s", spark.readStream.schema("id bigint, s string").parquet(str(tmp_path / "in")))
    query = streaming.start(engine, "FETCH UPPER(s) AS u FROM s WHEN id > 1", "shouted", checkpoint=str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert spark.table("shouted").collect()[0][0] == "B"


def test_not_in_needs_no_broadcast(spark):
    """A NOT IN over a query is an anti join by its equality; Spark's own would send out the whole query."""
    engine = Engine(spark)
    engine.register_frame("big", spark.range(50).selectExpr("id", "nullif(id % 7, 3) as k"))
    frame = engine.frame("FETCH id FROM big WHEN id < 40 AND id NOT IN (FETCH id FROM big WHEN id > 5)")
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "isnull(" not in plan.split("LeftAnti")[1].split("\n")[0]
    assert sorted(r.id for r in frame.collect()) == [0, 1, 2, 3, 4, 5]


def test_whole_windows_use_no_single_partition(spark):
    engine = Engine(spark)
    engine.register_frame("big", spark.range(50).selectExpr("id"))
    frame = engine.frame("FETCH id, SUM(id) OVER () AS s FROM big")
    assert "Window" not in frame._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.s) for r in frame.collect()} == {1225}
