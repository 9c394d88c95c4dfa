"""Aggregates and statistics that Spark has no function for, or defines otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import running_total

#: Fraction h of the position p * n + h' by method: (a, b) of h = a + p * (n + b).
_METHODS = {4: (0.0, 0.0), 5: (0.5, 0.0), 6: (0.0, 1.0), 7: (1.0, -1.0), 8: (1 / 3.0, 1 / 3.0), 9: (0.375, 0.25)}


def weighted_average(weight: Column, x: Column) -> Column:
    return F.sum(weight * x) / F.sum(weight)


def modes(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """All values that are most frequent within their group."""
    counted = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    most = F.max("__n").over(Window.partitionBy(*by))
    return counted.withColumn("__most", most).where("__n = __most").select(*by, value)


def quantiles(df: DataFrame, value: str, ps: Sequence[float], method: int = 8) -> DataFrame:
    """(p, q): quantiles of a whole column by one of the methods 4 to 9, null for no values. Equal values are
    counted first, so that only different ones are sorted, by ranges; only those at the wanted places meet."""
    a, b = _METHODS[method]
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    upto = running_total(counted, F.col("n"), ["v"], "upto").select("v", (F.col("upto") - F.col("n")).alias("after"), "upto")
    n = df.agg(F.count(value).alias("all"))
    wanted = df.sparkSession.createDataFrame([(float(p),) for p in ps], "p double").crossJoin(n)
    h = F.least(F.greatest(F.lit(a) + F.col("p") * (F.col("all") + F.lit(b)), F.lit(1.0)), F.col("all").cast("double"))
    wanted = wanted.withColumn("h", h).withColumn("lo", F.floor("h").cast("bigint")).withColumn("hi", F.least(F.col("lo") + 1, F.col("all")))
    ends = wanted.select("p", "h", "lo", F.explode(F.array("lo", "hi")).alias("i"))
    met = upto.join(F.broadcast(ends), (F.col("after") < F.col("i")) & (F.col("i") <= F.col("upto"))).groupBy("p", "h", "lo").agg(F.min("v").alias("x"), F.max("v").alias("y"))
    return met.select("p", (F.col("x") + (F.col("h") - F.col("lo")) * (F.col("y") - F.col("x"))).alias("q"))


def interquartile_range(df: DataFrame, value: str, method: int = 8) -> DataFrame:
    return quantiles(df, value, (0.25, 0.75), method).agg((F.max("q") - F.min("q")).alias("iqr"))


def medians(df: DataFrame, by: Sequence[str], value: str, name: str = "med") -> DataFrame:
    """(by, name): the mean of the middle two values of each group, null for a group without values. Equal values of
    a group are counted before the shuffle; the rest is a sorted pass over the counts, which spills where an
    aggregate that keeps a group's values in memory can't."""
    counted = df.groupBy(*by, F.col(value).alias("__v")).agg(F.count(value).alias("__n"))
    rows = Window.partitionBy(*by).orderBy(F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    upto, total = F.sum("__n").over(rows), F.sum("__n").over(Window.partitionBy(*by))
    placed = counted.select(*by, "__v", "__n", upto.alias("__upto"), total.alias("__all"))
    lo, hi = F.floor((F.col("__all") + 1) / 2), F.floor((F.col("__all") + 2) / 2)

    def at(i: Column) -> Column:
        return F.max(F.when((F.col("__upto") - F.col("__n") < i) & (i <= F.col("__upto")), F.col("__v")))

    return placed.groupBy(*by).agg(((at(lo) + at(hi)) / 2).alias(name))


def covariance_matrix(df: DataFrame, columns: Sequence[str], correlation: bool = False) -> DataFrame:
    """(a, b, value) for all pairs of columns, population covariance or correlation, in one aggregation."""
    f = F.corr if correlation else F.covar_pop
    pairs = [(a, b) for a in columns for b in columns]
    row = df.agg(*(f(a, b).alias(f"v{i}") for i, (a, b) in enumerate(pairs)))
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"v{i}").alias("value")) for i, (a, b) in enumerate(pairs)))
    return row.select(F.inline(cells))
