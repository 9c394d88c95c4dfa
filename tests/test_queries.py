"""Every query against its SQL in another engine, and the vector functions against plain Python."""

import datetime
import decimal
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tickframe import queries
from tickframe.functions import scalars, stats
from tickframe.operators import joins, ordered

DATA = "/root/testdata/sf0.001"
ORACLE = queries.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


def plain(x):
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return x


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, con, name):
    df = queries.queries()[name](spark, DATA)
    got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in ORACLE:
        assert got
        return
    found = con.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    place = [names.index(c) for c in sorted(df.columns)]
    assert len(names) == len(df.columns)
    assert sorted(map(repr, got)) == sorted(repr(tuple(plain(r[i]) for i in place)) for r in found.fetchall())


def test_the_window_query_is_in_order_and_reaches_both_scans(spark):
    df = queries.flagship(spark, DATA)
    ts = [r.ts for r in df.collect()]
    assert ts == sorted(ts)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedFilters: [") >= 2 and "PushedFilters: []" not in plan


def test_positions_and_totals_over_several_partitions(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("(id * 7919) % 1000 as k")
    got = {r.k: r.pos for r in ordered.positions(df, ["k"]).collect()}
    assert got == {k: k + 1 for k in range(1000)}
    total = {r.k: r.total for r in ordered.running_total(df, df.k, ["k"]).collect()}
    assert total == {k: k * (k + 1) // 2 for k in range(1000)}


@pytest.mark.parametrize("partitions, adaptive", [(8, True), (3, True), (8, False)])
def test_a_million_rows_with_a_payload_keep_every_row(spark, tmp_path, partitions, adaptive):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        n = 1_000_000
        df = spark.range(0, n, 1, 6).selectExpr("(id * 7919) % 1000000 as k", "concat('payload ', id) as payload", "id")
        got = ordered.positions(df, ["k"], descending=True)
        row = got.agg(F.count("payload"), F.count_distinct("pos"), F.sum((F.col("pos") != n - F.col("k")).cast("int"))).first()
        assert tuple(row) == (n, n, 0)
        got.write.parquet(str(tmp_path / "p"))
        assert spark.read.parquet(str(tmp_path / "p")).count() == n
        total = ordered.running_total(df, F.col("k"), ["k"])
        assert len(total.select("k", "payload", "total").toPandas()) == n
        assert total.where("total <> k * (k + 1) div 2").count() == 0
        assert {r.p: r.q for r in stats.quantiles(df, "k", (0.25, 0.5), 7).collect()} == {0.25: 249999.75, 0.5: 499999.5}
        backwards = ordered.reversed_pairs(df, ["k"], "payload")
        assert backwards.count() == n and backwards.where("i = 1").first().payload == df.where("k = 999999").first().payload
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_averages_are_not_rounded_and_pass_over_nulls(spark):
    df = spark.createDataFrame([(1, 0.004), (2, 0.001), (3, None), (4, 1e-9)], "i int, v double")
    got = [(r.m, r.a) for r in df.select("i", ordered.moving_average(df.v, 2, [], ["i"]).alias("m"), ordered.running_average(df.v, [], ["i"]).alias("a")).orderBy("i").collect()]
    assert got == [(0.004, 0.004), (0.0025, 0.0025), (0.001, 0.0025), (1e-9, pytest.approx(0.005000001 / 3))]


def test_medians_of_groups(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", None), ("b", 2.0), ("b", 2.0), ("b", 7.0), ("c", None)], "g string, v double")
    assert {r.g: r.med for r in stats.medians(df, ["g"], "v").collect()} == {"a": 2.0, "b": 2.0, "c": None}


@pytest.mark.parametrize("method", [4, 5, 6, 7, 8, 9])
def test_quantiles(spark, method):
    values = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    n, s = len(values), sorted(values)
    for p, q in ((r.p, r.q) for r in stats.quantiles(df, "v", (0.0, 0.1, 0.5, 0.9, 1.0), method).collect()):
        a, b = {4: (0, 0), 5: (0.5, 0), 6: (0, 1), 7: (1, -1), 8: (1 / 3, 1 / 3), 9: (0.375, 0.25)}[method]
        h = min(max(a + p * (n + b), 1), n)
        lo = math.floor(h)
        assert q == pytest.approx(s[lo - 1] + (h - lo) * (s[min(lo, n - 1)] - s[lo - 1]))


def test_modes_keep_ties(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("a", 2), ("a", 3), ("b", None)], "g string, v int")
    assert sorted(map(tuple, stats.modes(df, ["g"], "v").collect()), key=repr) == [("a", 1), ("a", 2), ("b", None)]


def test_covariance_matrix(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "x double, y double")
    got = {(r.a, r.b): r.value for r in stats.covariance_matrix(df, ["x", "y"]).collect()}
    assert got[("x", "y")] == pytest.approx(4 / 3) and got[("x", "x")] == pytest.approx(2 / 3)


def test_as_of_takes_the_last_earlier_row(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", 5), (3, "b", 7)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 5, 1, 1.0), ("a", 5, 2, 2.0), ("a", 11, 3, 3.0), ("a", 8, 4, None)], "k string, t int, tie int, v double")
    got = {r.id: r.asof_v for r in joins.as_of(left, right, ["k"], "t", ["v"], "tie", inner=False).collect()}
    assert got == {1: None, 2: 2.0, 3: None}


def test_parts_of_time_carry_over(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", 5), (3, "b", 7), (4, None, 30), (5, "a", 39)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 5, 1, 1.0), ("a", 5, 2, 2.0), ("a", 11, 3, 3.0), (None, 2, 5, 5.0)], "k string, t int, tie int, v double")
    whole, parts = ({r.id: r.asof_v for r in joins.as_of(left, right, ["k"], "t", ["v"], "tie", inner=False, split=f).collect()} for f in (None, lambda x: F.floor(x / 4)))
    assert whole == parts == {1: 2.0, 2: 2.0, 3: None, 4: 5.0, 5: 3.0}
    df = spark.createDataFrame([("a", i, i if i % 5 else None) for i in range(30)] + [(None, 3, 7)], "k string, t int, v int")
    one, many = (sorted(map(tuple, ordered.running_sum(df, F.col("v"), ["k"], ["t"], split=x).collect()), key=repr) for x in (None, F.floor(F.col("t") / 4)))
    assert one == many and len(one) == 31


def test_lcg_and_scalars(spark):
    got = [r.i for r in spark.range(5).select(scalars.lcg_index(F.col("id"), 1000).alias("i")).collect()]
    assert got == [((0x123456789ABCDEF0 + 6364136223846793005 * i) % (1 << 64) >> 33) % 1000 for i in range(5)]
    df = spark.createDataFrame([(255, -7.0, "a b\n c")], "n bigint, x double, s string")
    row = df.select(scalars.hex_digit_sum(df.n).alias("h"), scalars.xbar(5, df.x).alias("b"), scalars.words(df.s).alias("w"), scalars.reversed_lines(df.s).alias("r"), scalars.normal_cdf(df.x).alias("p")).first()
    assert (row.h, row.b, row.w, row.r) == (30, -10, 3, " c\na b") and row.p == pytest.approx(1.28e-12, rel=0.01)
