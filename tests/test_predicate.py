"""Truth tables of the comparison rules, over nulls, NaN, both zeros and mixed types."""

import math

import pytest
from pyspark.errors import PySparkException

from tickframe.plans import native, prql
from tickframe.plans.parser import SqlError
from tickframe.plans.predicate import And, Compare, Literal, Mode, Name, Not, Or, compiled

NUMBERS = [None, 0.0, -0.0, 1.5, math.nan]


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(i * 5 + j, a, b) for i, a in enumerate(NUMBERS) for j, b in enumerate(NUMBERS)]
    return spark.createDataFrame(rows, "id int, a double, b double").cache()


def ids(df, e, mode=Mode.SELECT, suspect=None):
    return {r.id for r in df.where(compiled(e, df.schema, mode, suspect)).select("id").collect()}


def bits(x):
    return None if x is None else "nan" if math.isnan(x) else repr(x)


def test_doubles_are_equal_by_bits(pairs):
    expected = {i * 5 + j for i, a in enumerate(NUMBERS) for j, b in enumerate(NUMBERS) if bits(a) == bits(b)}
    assert ids(pairs, Compare("=", Name("a"), Name("b"))) == expected
    assert ids(pairs, Compare("!=", Name("A"), Name("B"))) == set(range(25)) - expected


def test_equality_with_literal_zero_tells_signs_apart(pairs):
    assert ids(pairs, Compare("=", Name("a"), Literal(0.0))) == set(range(5, 10))
    assert ids(pairs, Compare("=", Name("a"), Literal(1.5))) == set(range(15, 20))


@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
def test_ordering_fails_on_null_and_nan(pairs, op):
    test = {"<": float.__lt__, "<=": float.__le__, ">": float.__gt__, ">=": float.__ge__}[op]
    for i, a in enumerate(NUMBERS):
        for j, b in enumerate(NUMBERS):
            one = pairs.where(f"id = {i * 5 + j}")
            if a is None or b is None or math.isnan(a) or math.isnan(b):
                with pytest.raises(PySparkException, match="not comparable"):
                    ids(one, Compare(op, Name("a"), Name("b")))
                assert ids(one, Compare(op, Name("a"), Name("b")), Mode.DELETE) == set()
            else:
                assert bool(ids(one, Compare(op, Name("a"), Name("b")))) == test(a, b)


def test_null_equals_null_and_differs_from_values(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "id int, s string")
    assert ids(df, Compare("=", Name("s"), Literal("x"))) == {1}
    assert ids(df, Compare("!=", Name("s"), Literal("x"))) == {2, 3}
    assert ids(df, Compare("=", Name("s"), Literal(None))) == {2}
    assert ids(df, Compare("!=", Name("s"), Literal(None))) == {1, 3}


def test_types_are_not_coerced(spark):
    df = spark.createDataFrame([(1, 10.0, 10, True), (2, None, None, None)], "id int, f double, n bigint, b boolean")
    assert ids(df, Compare("=", Name("f"), Literal(10))) == set()
    assert ids(df, Compare("!=", Name("f"), Literal(10))) == {1, 2}
    assert ids(df, Compare("=", Name("f"), Name("n"))) == {2}
    assert ids(df, Compare("=", Name("b"), Literal(True))) == {1}
    with pytest.raises(PySparkException, match="not comparable"):
        ids(df, Compare("<", Name("f"), Literal(10)))
    assert ids(df.limit(0), Compare("<", Name("f"), Literal(10))) == set()


def test_selects_evaluate_both_sides_and_changes_only_what_decides(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "id int, s string, n bigint")
    e = And(Compare("=", Name("s"), Literal("a")), Compare("<", Name("n"), Literal(5)))
    with pytest.raises(PySparkException, match="not comparable"):
        ids(df, e)
    assert ids(df, e, Mode.UPDATE) == {1}
    either = Or(Compare("=", Name("s"), Literal("b")), Compare("<", Name("n"), Literal(5)))
    assert ids(df, either, Mode.UPDATE) == {1, 2}
    with pytest.raises(PySparkException, match="not comparable"):
        ids(df, Compare("<", Name("n"), Literal(5)), Mode.UPDATE)
    assert ids(df, Not(Compare("<", Name("n"), Literal(5))), Mode.DELETE) == set()


def test_what_may_be_a_filter(spark):
    df = spark.createDataFrame([(1, True)], "id int, b boolean")
    for mode in Mode:
        with pytest.raises(TypeError, match="bool"):
            compiled(Name("b"), df.schema, mode)
    with pytest.raises(TypeError, match="bool"):
        compiled(Literal(True), df.schema)
    assert ids(df, Literal(True), Mode.UPDATE) == {1}
    nested = Compare("=", Compare("=", Name("id"), Literal(1)), Literal(True))
    assert ids(df, nested, Mode.DELETE) == {1}
    with pytest.raises(TypeError):
        compiled(nested, df.schema)


def test_unsuspect_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([(1, 2.0)], "id bigint, v double").write.parquet(path)
    df = spark.read.parquet(path)
    plan = df.where(compiled(Compare(">", Name("v"), Literal(1.0)), df.schema, suspect=set()))._jdf.queryExecution().toString()
    assert "GreaterThan(v,1.0)" in plan
    guarded = df.where(compiled(Compare(">", Name("v"), Literal(1.0)), df.schema))._jdf.queryExecution().toString()
    assert "raise_error" in guarded


@pytest.mark.parametrize(
    "sql",
    ["select * from t", "select a+1 from t", "select count(a) from t", "select a from t, u", "select a from t join u", "select a from t group by a", "select a from t order by a", "select a from t limit 1",
     "select distinct a from t", "select a", "select a from t; select b from t", "select a from (select 1)", "select a from t where a in (1)", "select a from t union select a from t", "select 99999999999999999999 from t"],
)
def test_the_strict_language_refuses(sql):
    with pytest.raises(SqlError):
        native.parse_select(sql)


def test_strict_projection(spark):
    df = spark.createDataFrame([(1, "x")], "id bigint, s string")
    out = native.query("select t.s as k, -(2) as n, not true as f, null as z from t where id = 1", df)
    assert out.columns == ["k", "n", "f", "z"] and out.first() == ("x", -2, False, None)
    assert dict(out.dtypes)["z"] == "string"
    assert native.query("select 1 from t", df).columns == ["literal"]
    for twice in ("select id, id from t", "select 1, 2 from t", "select id, ID from t"):
        with pytest.raises(SqlError, match="duplicate"):
            native.query(twice, df)


def test_pipelines(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0), (3, "a", 4.0)], "id bigint, s string, v double")
    assert [r.v for r in prql.run("from t | filter s == 'a' && v > 2.5 | select {v}", lambda n: df).collect()] == [4.0]
    assert [tuple(r) for r in prql.run("from t\nderive w = v * 2\nsort {-id}\ntake 2\nselect {id, w}", lambda n: df).collect()] == [(3, 8.0), (2, 6.0)]
    for bad in ("filter a == 1", "from t | frobnicate x", "", "from t | filter f(x) == 1"):
        with pytest.raises(SqlError, match="PRQL"):
            prql.run(bad, lambda n: df)
