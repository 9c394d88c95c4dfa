"""The engine's operators as queries over the test tables, each with SQL that gives the same rows elsewhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars, stats
from .operators import dml, engines, joins, ordered
from .plans import native, prql
from .plans.predicate import And, Compare, Literal, Name, Not, Or, compiled
from .scratch import folder
from .session import Session
from .sources import formats
from .sources.catalog import ColumnSpec, Store
from .streaming import changelog

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}
_ET = "(select *, nullif(event_type,'error') as et from events)"
_BY = "partition by user_id order by ts, event_id"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with the SQL that it is compared with."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").withColumn("et", F.nullif("event_type", F.lit("error")))


def store(spark: SparkSession) -> Store:
    return Store(spark, folder(spark))


# Scan, filter, project


@query("select event_type, value from events")
def scan_project(spark, sf_dir):
    return native.query("select event_type, value from events", t(spark, sf_dir, "events"))


@query("select event_id, cast(1 as bigint) as one, -2.5e0 as neg, 'x' as tag from events")
def literal_project(spark, sf_dir):
    return native.query("select event_id, 1 as one, -2.5 as neg, ('x') as tag from events", t(spark, sf_dir, "events"))


@query("select 'ready' as status")
def const_select(spark, sf_dir):
    return spark.range(1).select(F.lit("ready").alias("status"))


@query(f"select event_id from {_ET} where et is not distinct from 'click'")
def filter_eq(spark, sf_dir):
    return native.query("select event_id from e where et = 'click'", with_nulls(spark, sf_dir))


@query(f"select event_id from {_ET} where et is distinct from 'click'")
def filter_ne_null(spark, sf_dir):
    return native.query("select event_id from e where et != 'click'", with_nulls(spark, sf_dir))


@query("select event_id, value from events where value >= 50 and value < 150.5e0")
def filter_range(spark, sf_dir):
    # The column holds neither nulls nor NaNs, so the comparisons reach the scan.
    return native.query("select event_id, value from events where value >= 50.0 and value < 150.5", t(spark, sf_dir, "events"), set())


@query(f"select event_id from {_ET} where not (et is not distinct from 'view' or (user_id = 5 and value > 10e0))")
def filter_bool(spark, sf_dir):
    e = Not(Or(Compare("=", Name("et"), Literal("view")), And(Compare("=", Name("user_id"), Literal(5)), Compare(">", Name("value"), Literal(10.0)))))
    df = with_nulls(spark, sf_dir)
    return df.where(compiled(e, df.schema, suspect={"et"})).select("event_id")


@query("select l_orderkey, l_linenumber from lineitem where l_partkey < l_suppkey")
def filter_col_col(spark, sf_dir):
    return native.query("select l_orderkey, l_linenumber from lineitem where l_partkey < l_suppkey", t(spark, sf_dir, "lineitem"), set())


@query("select event_id, value from events where user_id < 50 and not (value = 10e0 and false)")
def filter_cross_type(spark, sf_dir):
    """A double column equals no whole number literal, so all rows differ from it."""
    return native.query("select event_id, value from events where value != 10 and user_id < 50", t(spark, sf_dir, "events"), set())


@query(
    "select event_type, ts, value from events where event_type in ('click','view','error') and ts between timestamp '2024-01-14 00:00:00' and timestamp '2024-01-18 00:00:00' order by ts"
)
def hot_cold_window(spark, sf_dir):
    events, at = t(spark, sf_dir, "events"), F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    both = engines.hot_cold(events, events, "ts", at)
    low, high = (F.lit(f"2024-01-{d} 00:00:00").cast("timestamp_ntz") for d in (14, 18))
    return both.where(F.col("event_type").isin("click", "view", "error") & F.col("ts").between(low, high)).select("event_type", "ts", "value").orderBy("ts")


@query("select value from events where event_type = 'click'")
def prql_pipeline(spark, sf_dir):
    return prql.run("from events\nfilter event_type == \"click\"\nselect {value}", lambda name: t(spark, sf_dir, name), lambda _: set())


@query("select event_id from events where event_id % 7 = 0")
def where_mod(spark, sf_dir):
    return t(spark, sf_dir, "events").where(F.pmod("event_id", F.lit(7)) == 0).select("event_id")


@query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def in_subquery(spark, sf_dir):
    some = t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(some, "o_custkey", "left_semi")


# Joins


def _customers(spark, sf_dir, defaults):
    c, o = t(spark, sf_dir, "customer").select("c_custkey", "c_name"), t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return joins.left(c, o, c["c_custkey"] == o["o_custkey"], defaults).select("c_custkey", "c_name", "o_orderkey")


@query("select c_custkey, c_name, o_orderkey from customer left join orders on c_custkey = o_custkey")
def left_join(spark, sf_dir):
    return _customers(spark, sf_dir, False)


@query("select c_custkey, c_name, coalesce(o_orderkey, 0) as o_orderkey from customer left join orders on c_custkey = o_custkey")
def left_join_defaults(spark, sf_dir):
    return _customers(spark, sf_dir, True)


@query("select distinct l_partkey, n_name from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey")
def sp_distinct_fk(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").join(t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    return t(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("l_partkey", "n_name").distinct()


@query("select p_brand, sum(l_quantity) as qty from lineitem join part on l_partkey = p_partkey group by p_brand")
def sp_sum_by_fk(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.sum("l_quantity").alias("qty"))


@query(
    "select o_orderkey, l_linenumber, l_quantity from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where c_nationkey = s_nationkey"
)
def sp_same_city(spark, sf_dir):
    o = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    l_ = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "l_quantity", "s_nationkey")
    return l_.join(o, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).select("o_orderkey", "l_linenumber", "l_quantity")


@query("select r_name, n_name from region cross join nation")
def cross_join(spark, sf_dir):
    return t(spark, sf_dir, "region").select("r_name").crossJoin(t(spark, sf_dir, "nation").select("n_name"))


@query("select n_name, r_name from nation left join region on n_regionkey = r_regionkey")
def q_lj(spark, sf_dir):
    right = t(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return joins.keyed(t(spark, sf_dir, "nation"), right, ["n_regionkey"]).select("n_name", "r_name")


@query(
    "select e.event_id, arg_max(q.value, (q.ts, q.event_id)) as v from events e join events q on e.user_id = q.user_id and q.event_type = 'signup' and q.ts <= e.ts where e.event_type = 'error' group by 1"
)
def asof_ext(spark, sf_dir):
    events = t(spark, sf_dir, "events")
    errors, signups = (events.where(F.col("event_type") == k).select("event_id", "user_id", "ts", "value") for k in ("error", "signup"))
    return joins.as_of(errors.drop("value"), signups, ["user_id"], "ts", ["value"], "event_id").select("event_id", F.col("asof_value").alias("v"))


# Aggregates


@query("select event_type, count(*) as n from events group by event_type")
def count_by(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("select user_id, event_type, count(*) as n, min(value) as lo, max(value) as hi from events group by user_id, event_type")
def minmax_by(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("select user_id, max(ts) as last_ts from events group by user_id")
def group_last(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_ts"))


@query("select l_returnflag, cast(sum(l_linenumber) as bigint) as total from lineitem group by l_returnflag")
def sum_by(spark, sf_dir):
    t(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem_lines")
    s = Session(spark, folder(spark))
    s.views["totals"] = "select l_returnflag, sum(l_linenumber) as total from lineitem_lines group by l_returnflag"
    return s.query("SELECT l_returnflag, total FROM totals")


@query("select user_id, arg_max(value, (ts, event_id)) as latest from events group by user_id")
def arg_max(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("latest"))


@query("select c_nationkey, count(*) as n, any_value(c_nationkey * 2) as a from customer group by c_nationkey")
def bench_group_any(spark, sf_dir):
    return t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.any_value(F.col("c_nationkey") * 2).alias("a"))


@query("select event_type as k, count(*) as cnt, round(sum(value), 4) as total from events group by 1")
def agg_state_merge(spark, sf_dir):
    s = engines.states(t(spark, sf_dir, "events").withColumnRenamed("event_type", "k"), ["k", "user_id"], cs=F.lit(1), ss=F.col("value"))
    return engines.merged(s, ["k"], cnt="cs", total="ss").select("k", "cnt", F.round("total", 4).alias("total"))


@query("select distinct event_type from events order by event_type limit 2 offset 0")
def distinct_limit(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type").offset(0).limit(2)


@query("select cast(strftime(l_shipdate, '%Y%m') as int) as part, count(*) as n from lineitem group by part")
def group_by_month(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy(scalars.yyyymm(F.col("l_shipdate")).alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("select event_type, count(*) as numproc, round(avg(value), 6) as av, max(value) as mx, arg_min(user_id, event_id) as first_user from events group by event_type")
def q_postproc(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("numproc"), F.round(F.avg("value"), 6).alias("av"), F.max("value").alias("mx"), F.min_by("user_id", "event_id").alias("first_user")
    )


@query("select l_returnflag, median(l_quantity) as med from lineitem group by l_returnflag")
def median_by(spark, sf_dir):
    return stats.medians(t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")


@query("select l_returnflag, round(stddev_samp(l_tax), 9) as sdev, round(stddev_pop(l_tax), 9) as dev, round(var_pop(l_tax), 9) as var from lineitem group by l_returnflag")
def dispersion_by(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*(F.round(f("l_tax"), 9).alias(n) for f, n in ((F.stddev_samp, "sdev"), (F.stddev_pop, "dev"), (F.var_pop, "var"))))


@query("select l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) as w from lineitem group by l_returnflag")
def wavg_by(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(stats.weighted_average(F.col("l_quantity"), F.col("l_extendedprice")), 4).alias("w"))


@query("select l_returnflag, round(covar_pop(l_quantity, l_extendedprice), 4) as cov, round(corr(l_quantity, l_extendedprice), 9) as cor from lineitem group by l_returnflag")
def cov_cor(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.covar_pop("l_quantity", "l_extendedprice"), 4).alias("cov"), F.round(F.corr("l_quantity", "l_extendedprice"), 9).alias("cor")
    )


_MATRIX = ("l_quantity", "l_extendedprice", "l_discount")


@query(" union all ".join(f"select '{a}' as a, '{b}' as b, round(covar_pop({a}, {b}), 3) as value from lineitem" for a in _MATRIX for b in _MATRIX))
def cov_matrix(spark, sf_dir):
    return stats.covariance_matrix(t(spark, sf_dir, "lineitem"), _MATRIX).select("a", "b", F.round("value", 3).alias("value"))


@query("select user_id, event_type from (select user_id, event_type, dense_rank() over (partition by user_id order by count(*) desc) as r from events group by user_id, event_type) where r = 1")
def mode_all(spark, sf_dir):
    return stats.modes(t(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("select event_type, cast(len(ix) as int) as n, ix[1] as lo from (select event_type, list_sort(list(event_id)) as ix from events group by event_type)")
def group_indices(spark, sf_dir):
    g = ordered.groups(t(spark, sf_dir, "events"), "event_type", "event_id")
    return g.select("event_type", F.size("indices").alias("n"), F.col("indices")[0].alias("lo"))


_M8 = """with r as (select value as v, row_number() over (order by value, event_id) as i from events),
h as (select p, 1/3.0e0 + p * ((select count(*) from events) + 1/3.0e0) as h from (values (0.25e0), (0.75e0)) x(p))
select h.p, round(a.v + (h.h - floor(h.h)) * (b.v - a.v), 6) as q from h join r a on a.i = floor(h.h) join r b on b.i = floor(h.h) + 1"""


@query(_M8)
def quantile_m8(spark, sf_dir):
    return stats.quantiles(t(spark, sf_dir, "events"), "value", (0.25, 0.75)).select("p", F.round("q", 6).alias("q"))


@query(f"select round(max(q) - min(q), 6) as iqr from ({_M8.replace('round(', '(').replace(', 6) as q', ') as q')})")
def iqr_m8(spark, sf_dir):
    return stats.interquartile_range(t(spark, sf_dir, "events"), "value").select(F.round("iqr", 6).alias("iqr"))


@query("select round(quantile_cont(value, 0.25), 9) as q25, round(quantile_cont(value, 0.75), 9) as q75 from events")
def quantile_m7(spark, sf_dir):
    q = stats.quantiles(t(spark, sf_dir, "events"), "value", (0.25, 0.75), 7)
    return q.agg(*(F.round(F.max(F.when(F.col("p") == p, F.col("q"))), 9).alias(n) for p, n in ((0.25, "q25"), (0.75, "q75"))))


# Windows and vectors


@query(f"select event_id, round(sum(value) over ({_BY} rows unbounded preceding), 4) as running from events")
def running_sum(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", F.round(F.sum("value").over(ordered.upto(["user_id"], ["ts", "event_id"])), 4).alias("running"))


@query(f"select event_id, round(value - coalesce(lag(value) over ({_BY}), 0), 6) as d from events")
def deltas(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", F.round(ordered.deltas(F.col("value"), ordered.over(["user_id"], ["ts", "event_id"])), 6).alias("d"))


def _average(frame: str) -> str:
    return f"select event_id, round(avg(value) over ({_BY} rows {frame}), 9) as m from events"


@query(_average("between 99 preceding and current row"))
def mavg_100(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", F.round(ordered.moving_average(F.col("value"), 100, ["user_id"], ["ts", "event_id"]), 9).alias("m"))


@query(_average("unbounded preceding"))
def running_avg(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", F.round(ordered.running_average(F.col("value"), ["user_id"], ["ts", "event_id"]), 9).alias("m"))


@query(f"select event_id, event_type is distinct from lag(event_type) over ({_BY}) as d from events")
def differ(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", ordered.differ(F.col("event_type"), ordered.over(["user_id"], ["ts", "event_id"])).alias("d"))


@query("select a.i, b.n_name from (select row_number() over (order by n_nationkey) as i from nation) a join (select n_name, row_number() over (order by n_nationkey desc) as i from nation) b on a.i = b.i")
def reverse_index(spark, sf_dir):
    return ordered.reversed_pairs(t(spark, sf_dir, "nation"), ["n_nationkey"], "n_name")


@query("select value, row_number() over (order by value, event_id) as pos from events")
def sort_vector(spark, sf_dir):
    return ordered.positions(t(spark, sf_dir, "events").select("value", "event_id"), ["value", "event_id"]).select("value", "pos")


@query("select event_id, cast(sum(user_id) over (order by ts, event_id rows unbounded preceding) as bigint) as total from events")
def running_total_global(spark, sf_dir):
    return ordered.running_total(t(spark, sf_dir, "events").select("event_id", "ts", "user_id"), F.col("user_id"), ["ts", "event_id"]).select("event_id", "total")


@query("select user_id, ts, value from events order by user_id, ts")
def order_by_multi(spark, sf_dir):
    return t(spark, sf_dir, "events").select("user_id", "ts", "value").orderBy("user_id", "ts")


@query("select event_type, event_id, value from events")
def xasc(spark, sf_dir):
    return ordered.sorted_parts(t(spark, sf_dir, "events").select("event_type", "event_id", "value"), "event_type", ["event_id"])


# Merging tables


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1")
def replacing_latest(spark, sf_dir):
    return engines.replacing(t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("select user_id, cast(sum(case when event_type = 'error' then -1 else 1 end) as bigint) as balance from events group by user_id")
def collapsing_balance(spark, sf_dir):
    return engines.balance(t(spark, sf_dir, "events"), ["user_id"], F.when(F.col("event_type") == "error", -1).otherwise(1))


@query("select event_id, event_type from events")
def buffer_union(spark, sf_dir):
    s, events = store(spark), t(spark, sf_dir, "events").select("event_id", "event_type")
    dml.insert(s, "events", events.where("event_id < 9000"))
    waiting = engines.Buffer(s, "events", rows=1 << 60, seconds=1e9)
    waiting.insert(events.where("event_id >= 9000"))
    return waiting.df()


@query("select n_nationkey as id, n_name as v from nation union all select r_regionkey, r_name from region")
def union_all(spark, sf_dir):
    a = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("v"))
    return a.unionByName(t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("v")))


@query("select count(*) as n from events where ts >= timestamp '2024-01-31 00:00:00' - interval 10 day")
def ttl_filter(spark, sf_dir):
    return engines.unexpired(t(spark, sf_dir, "events"), "ts", 10, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")).agg(F.count(F.lit(1)).alias("n"))


@query("select count(*) as n from events where (event_id * 2654435761) % 65536 < 32768")
def sample_half(spark, sf_dir):
    return engines.sampled(t(spark, sf_dir, "events"), F.col("event_id") * F.lit(2654435761), 0.5).agg(F.count(F.lit(1)).alias("n"))


# Changes


@query("select event_id, event_type, 'n/a' as extra, cast(100 as bigint) as lot from events")
def insert_defaults(spark, sf_dir):
    s = store(spark)
    s.create("e", [ColumnSpec("event_id", "Nullable(Int64)"), ColumnSpec("event_type", "Nullable(String)")])
    s.add_column("e", ColumnSpec("lot", "Nullable(Int64)", default="7"))
    s.set_default("e", "lot", "100")
    dml.insert(s, "e", t(spark, sf_dir, "events").select("event_id", "event_type"))
    s.add_column("e", ColumnSpec("extra", "Nullable(String)", default="'n/a'"))
    return s.df("e").select("event_id", "event_type", "extra", "lot")


@query("select n_nationkey, n_name from nation")
def insert_select(spark, sf_dir):
    s = Session(spark, folder(spark))
    t(spark, sf_dir, "nation").createOrReplaceTempView("nation_source")
    s.run("CREATE TABLE target (n_nationkey Int32, n_name String) ENGINE = MergeTree ORDER BY n_nationkey; INSERT INTO target (n_nationkey, n_name) SELECT n_nationkey, n_name FROM nation_source")
    return s.df("target")


@query("select event_id, case when user_id = 5 then 0e0 else value end as value from events")
def update_where(spark, sf_dir):
    s = store(spark)
    dml.insert(s, "e", t(spark, sf_dir, "events").select("event_id", "user_id", "value"))
    dml.update(s, "e", {"value": 0.0}, Compare("=", Name("user_id"), Literal(5)))
    return s.df("e").select("event_id", "value")


@query(f"select event_id from {_ET} where et is distinct from 'click'")
def delete_where(spark, sf_dir):
    s = store(spark)
    dml.insert(s, "e", with_nulls(spark, sf_dir).select("event_id", "et"))
    dml.delete(s, "e", Compare("=", Name("et"), Literal("click")))
    return s.df("e").select("event_id")


@query("select event_id, event_type, cast(case when event_id = 2 then 1 else 0 end as bigint) as updated from events where event_id <> 3")
def mutations(spark, sf_dir):
    s = Session(spark, folder(spark))
    s.run("CREATE TABLE m (event_id Int64, event_type String, updated Int64 DEFAULT 0) ENGINE = MergeTree ORDER BY event_id")
    dml.insert(s.store, "m", t(spark, sf_dir, "events").select("event_id", "event_type"))
    s.run("ALTER TABLE m UPDATE updated = 1 WHERE event_id = 2; ALTER TABLE m DELETE WHERE event_id = 3")
    return s.df("m")


@query("select event_id, event_type, value from (select *, row_number() over (partition by user_id order by event_id desc) as rn from events) where rn = 1 and event_type <> 'error'")
def wal_replay_state(spark, sf_dir):
    changes = t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return changelog.state_of(changes, "user_id", "event_id", "event_type = 'error'").select("event_id", "event_type", "value")


@query("select user_id, cast(case when user_id % 2 = 0 then -1 else user_id end as bigint) as v from (select distinct user_id from events) union all select 1000000, 1")
def q_upsert(spark, sf_dir):
    old = t(spark, sf_dir, "events").select("user_id").distinct().withColumn("v", F.col("user_id"))
    new = old.where("user_id % 2 = 0").select("user_id", F.lit(-1).cast("bigint").alias("v"))
    more = spark.range(1).select(F.lit(1000000).cast("bigint").alias("user_id"), F.lit(1).cast("bigint").alias("v"))
    return dml.upsert(old, new.unionByName(more), ["user_id"])


@query("select event_id, case when event_id % 97 = 0 then -1e0 else value end as value from events")
def indexed_replace(spark, sf_dir):
    events = t(spark, sf_dir, "events").select("event_id", "value")
    return dml.replaced_at(events, "event_id", events.where("event_id % 97 = 0"), "value", F.lit(-1.0))


@query("select l_orderkey, l_linenumber, l_extendedprice * l_quantity as total from lineitem")
def materialized_col(spark, sf_dir):
    s = store(spark)
    kinds = {"l_orderkey": "Int64", "l_linenumber": "Int32", "l_extendedprice": "Float64", "l_quantity": "Float64"}
    s.create("l", [*(ColumnSpec(c, f"Nullable({k})") for c, k in kinds.items()), ColumnSpec("total", "Nullable(Float64)", materialized="l_extendedprice * l_quantity")])
    dml.insert(s, "l", t(spark, sf_dir, "lineitem").select(*kinds))
    return s.df("l").select("l_orderkey", "l_linenumber", "total")


# Scalar functions


@query("select l_orderkey, cast(round(cast(l_discount as decimal(18,4)), 1) as decimal(18,1)) as r from lineitem")
def decimal_round(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").select("l_orderkey", F.round(F.col("l_discount").cast("decimal(18,4)"), 1).cast("decimal(18,1)").alias("r"))


@query("select event_id, epoch_us(ts) as us from events")
def ts_micros(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", scalars.micros(F.col("ts")).alias("us"))


@query("select timestamp '2024-01-01 10:00:00' as t")
def ts_parse(spark, sf_dir):
    return Session(spark, folder(spark)).query("SELECT toDateTime64('2024-01-01 10:00:00', 6) AS t")


@query("select event_id, ts + event_id * interval 1 microsecond as later from events")
def ts_add_micros(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", scalars.after_micros(F.col("ts"), F.col("event_id")).alias("later"))


@query("select r_regionkey, unnest([1,2,3]) as num from region")
def array_join(spark, sf_dir):
    t(spark, sf_dir, "region").createOrReplaceTempView("regions_of_arrays")
    return Session(spark, folder(spark)).query("SELECT r_regionkey, arrayJoin([1, 2, 3]) AS num FROM regions_of_arrays")


@query("select r_regionkey, name, qty from region, (select unnest(['a','b']) as name) x, (select unnest([10,20]) as qty) y")
def nested_array_join(spark, sf_dir):
    t(spark, sf_dir, "region").createOrReplaceTempView("regions_of_arrays")
    return Session(spark, folder(spark)).query("SELECT r_regionkey, arrayJoin(['a', 'b']) AS name, arrayJoin([10, 20]) AS qty FROM regions_of_arrays")


@query("select n_nationkey, n_name as label from nation")
def tuple_element(spark, sf_dir):
    t(spark, sf_dir, "nation").createOrReplaceTempView("nations_of_tuples")
    return Session(spark, folder(spark)).query("SELECT n_nationkey, tupleElement(tuple(n_name, n_regionkey), 1) AS label FROM nations_of_tuples")


@query("select r_regionkey, 'env,region' as ks from region")
def map_keys(spark, sf_dir):
    pairs = F.create_map(F.lit("env"), F.lit("prod"), F.lit("region"), F.col("r_name"))
    return t(spark, sf_dir, "region").select("r_regionkey", F.array_join(F.sort_array(F.map_keys(pairs)), ",").alias("ks"))


@query("select event_id, coalesce(json_extract_string(props, '$.k'), '') as k from events")
def json_extract(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", scalars.json_string(F.col("props"), "k").alias("k"))


@query("""select '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' as j from nation""")
def format_json(spark, sf_dir):
    nation = t(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return nation.select(formats.json_column(nation).alias("j"))


@query("select floor(value / 117e0) * 117e0 as b, count(*) as n from events group by 1")
def xbar(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy(scalars.xbar(117.0, F.col("value")).alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query("select event_id, cast(floor(value / 11e0) as bigint) as d from events")
def div_floor(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", scalars.div(F.col("value"), F.lit(11.0)).alias("d"))


@query("select event_id, round(1 / (value + 1e0), 9) as r, cast(ceil(value) as bigint) as c from events")
def recip_ceil(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", F.round(1 / (F.col("value") + 1.0), 9).alias("r"), F.ceil("value").alias("c"))


@query("select round(sum(value * 1.0001e0 + 0.1e0), 4) as x from events")
def cpu_transform(spark, sf_dir):
    return t(spark, sf_dir, "events").agg(F.round(F.sum(scalars.transform(F.col("value"))), 4).alias("x"))


def _passes(n: int) -> str:
    x = "value"
    for _ in range(n):
        x = f"({x} * 1.0001e0 + 0.1e0)"
    return f"sum({x})"


@query(f"select round({' + '.join(_passes(n) for n in range(1, 6))}, 2) as x from events where event_id < (select count(*) // 10 from events)")
def cpucache_transform(spark, sf_dir):
    sums = [F.sum(scalars.transform(F.col("value"), n)) for n in range(1, 6)]
    total = sums[0]
    for s in sums[1:]:
        total = total + s
    events = t(spark, sf_dir, "events")
    return events.where(F.col("event_id") < events.count() // 10).agg(F.round(total, 2).alias("x"))


_TAIL = "(exp(-0.5e0*x*x)/sqrt(2*pi()))*t*(0.31938153e0+t*(-0.356563782e0+t*(1.781477937e0+t*(-1.821255978e0+t*1.330274429e0))))"


@query(f"select event_id, round(1 - {_TAIL}, 9) as p from (select event_id, x, 1/(1+0.2316419e0*x) as t from (select event_id, value/100e0 as x from events where value > 0))")
def normal_cdf(spark, sf_dir):
    return t(spark, sf_dir, "events").where("value > 0").select("event_id", F.round(scalars.normal_cdf(F.col("value") / 100), 9).alias("p"))


@query(
    "select event_id, round(case when p < 0.5e0 then -z else z end, 6) as z from (select event_id, p, t - (2.515517e0 + t*(0.802853e0 + t*0.010328e0)) / (1 + t*(1.432788e0 + t*(0.189269e0 + t*0.001308e0))) as z "
    "from (select event_id, p, sqrt(-2 * ln(case when p < 0.5e0 then p else 1 - p end)) as t from (select event_id, (event_id % 1000 + 1) / 1009e0 as p from events)))"
)
def normal_inv(spark, sf_dir):
    p = (F.col("event_id") % 1000 + 1) / F.lit(1009.0)
    return t(spark, sf_dir, "events").select("event_id", F.round(scalars.normal_inverse(p), 6).alias("z"))


@query("select doc_id, cast(len(string_split(text, chr(10))) as int) as ln, cast(len(list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) as int) as w, cast(length(text) as int) as n from documents")
def text_word_count(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("ln"), scalars.words(F.col("text")).alias("w"), F.length("text").alias("n"))


@query("select doc_id, array_to_string(list_reverse(string_split(text, chr(10))), chr(10)) as r from documents")
def text_reversed_lines(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", scalars.reversed_lines(F.col("text")).alias("r"))


@query("select event_id, cast(list_sum(list_transform(string_split(lower(to_hex(event_id)), ''), lambda c: instr('0123456789abcdef', c) - 1)) as bigint) as s from events")
def hex_digit_sum(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", scalars.hex_digit_sum(F.col("event_id")).alias("s"))


@query("select user_id, round(sum(cast(cast(value as varchar) as double) - cast('1e-3' as double) * cast('-' || cast(event_id as varchar) || '.5' as double)), 4) as x from events group by user_id")
def parse_sum(spark, sf_dir):
    parsed = [F.col(c).cast("double") for c in ("v", "e", "i")]
    texts = t(spark, sf_dir, "events").select("user_id", F.col("value").cast("string").alias("v"), F.lit("1e-3").alias("e"), F.concat(F.lit("-"), F.col("event_id").cast("string"), F.lit(".5")).alias("i"))
    return texts.groupBy("user_id").agg(F.round(F.sum(parsed[0] - parsed[1] * parsed[2]), 4).alias("x"))


@query(f"select event_id, coalesce(et, 'none') as et from {_ET}")
def fill_default(spark, sf_dir):
    return with_nulls(spark, sf_dir).select("event_id", F.coalesce("et", F.lit("none")).alias("et"))


# Benchmark shapes


@query("select n, round(sum(value), 4) as x, max(value) as m from events cross join (values (1), (2)) as r(n) group by n")
def reread_sum(spark, sf_dir):
    """The column twice over: the second time it comes from Spark's cache, which holds that one column."""
    kept = t(spark, sf_dir, "events").select("value").cache()
    first, again = (kept.agg(F.lit(n).alias("n"), F.round(F.sum("value"), 4).alias("x"), F.max("value").alias("m")) for n in (1, 2))
    return first.unionByName(again)


def _random_reads(block: int) -> str:
    return (
        "with n as (select count(*) as rows from events), ix as (select ((1311768467463790320::hugeint + 6364136223846793005::hugeint * id) % 18446744073709551616::hugeint // 8589934592)::bigint % "
        f"(rows // {block}) as b from (select rows, unnest(range(rows // {10 * block})) as id from n)) "
        f"select round(sum(value), 4) as x, count(*) as n from ix join events on event_id // {block} = b"
    )


def random_reads(spark, sf_dir, block: int) -> DataFrame:
    """The sum over blocks of rows at pseudo-random places, a tenth as many as there are blocks. Places that are drawn
    again are read once and count as often."""
    events = t(spark, sf_dir, "events").select("event_id", "value")
    rows = events.count()
    drawn = spark.range(rows // (10 * block)).select(scalars.lcg_index(F.col("id"), rows // block).alias("block")).groupBy("block").agg(F.count(F.lit(1)).alias("times"))
    read = events.withColumn("block", F.expr(f"event_id div {block}")).join(drawn, "block")
    return read.agg(F.round(F.sum(F.col("value") * F.col("times")), 4).alias("x"), F.sum("times").alias("n"))


@query(_random_reads(1))
def random_read_sum(spark, sf_dir):
    return random_reads(spark, sf_dir, 1)


@query(_random_reads(64))
def random_read_blocks(spark, sf_dir):
    return random_reads(spark, sf_dir, 64)


@query("select concat('SYM', cast(id % 10 as varchar)) as symbol, id as seq from range(1000) x(id)")
def numbers_gen(spark, sf_dir):
    return Session(spark, folder(spark)).query("SELECT concat('SYM', toString(number % 10)) AS symbol, number AS seq FROM numbers(1000)")


# What is the engine's own or random is compared in what is fixed of it


@query("select 'default' as db, true as named")
def system_info(spark, sf_dir):
    return Session(spark, folder(spark)).query("SELECT currentDatabase() AS db, length(version()) > 0 AS named")


@query("select 100 as n, 100 as different, 36 as signs")
def uuids(spark, sf_dir):
    found = Session(spark, folder(spark)).query("SELECT number, generateUUIDv4() AS id FROM numbers(100)")
    return found.agg(F.count("id").cast("int").alias("n"), F.count_distinct("id").cast("int").alias("different"), F.max(F.length("id")).alias("signs"))


@query("select n_nationkey from nation")
def permuted(spark, sf_dir):
    return t(spark, sf_dir, "nation").select("n_nationkey").orderBy(F.rand(42))


@query("select true as centred, true as wide, 100000 as n")
def normal_samples(spark, sf_dir):
    """Mean and spread of many samples, within five times what chance moves them by."""
    x = spark.range(100_000).select(scalars.normal_sample(7).alias("x"))
    return x.agg((F.abs(F.avg("x")) < 0.016).alias("centred"), (F.abs(F.stddev("x") - 1) < 0.012).alias("wide"), F.count("x").cast("int").alias("n"))


def queries() -> dict[str, Query]:
    from . import lifecycle  # noqa: F401  registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_ORACLE)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot_cold_window(spark, sf_dir)
