"""Joins: default-filling left joins, foreign keys, and as-of."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def left(a: DataFrame, b: DataFrame, on: Column, defaults: bool = False) -> DataFrame:
    """Left join; with defaults, what has no match shows zeros and empty strings instead of nulls."""
    if not defaults:
        return a.join(b, on, "left")
    there = b.withColumn("__there", F.lit(True))
    joined = a.join(there, on, "left")
    fill = []
    for f in b.schema:
        kind = f.dataType
        zero = F.lit("") if isinstance(kind, T.StringType) else F.lit(0).cast(kind) if isinstance(kind, T.NumericType) else None
        fill.append((F.when(F.col("__there").isNull(), zero).otherwise(b[f.name]) if zero is not None else b[f.name]).alias(f.name))
    return joined.select(*(a[c] for c in a.columns), *fill)


def keyed(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns of b by its keys, in place of a's of the same name where there is a match."""
    other = b.select(*keys, *(F.col(c).alias(f"__{c}") for c in b.columns if c not in keys), F.lit(True).alias("__there"))
    joined = a.join(other, list(keys), "left")
    new = [c for c in b.columns if c not in keys and c not in a.columns]
    shown = [F.when(F.col("__there"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in b.columns and c not in keys else F.col(c) for c in a.columns]
    return joined.select(*shown, *(F.col(f"__{c}").alias(c) for c in new))


def as_of(left_: DataFrame, right: DataFrame, by: Sequence[str], time: str, value: Sequence[str], tie: str, inner: bool = True, split: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows of left_ with the values of the last row of right of the same keys that isn't later (the higher tie
    if equally late). Both sides in one sort by key and time: no row meets more than its predecessor.

    split: a function of the time that never falls, such as its day. A key's times are then searched by these parts,
    apart, and what a part begins with is carried over from the ones before it, a row a part: for keys that are too
    large for a task."""
    kept = [c for c in left_.columns if c not in by and c != time]
    l_ = left_.select(*by, F.col(time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[tie].dataType).alias("__tie"), F.struct(*kept).alias("__row"), F.lit(None).cast(right.select(F.struct(*value)).schema[0].dataType).alias("__value"))
    r_ = right.select(*by, F.col(time).alias("__t"), F.lit(0).alias("__side"), F.col(tie).alias("__tie"), F.lit(None).cast(l_.schema["__row"].dataType).alias("__row"), F.struct(*value).alias("__value"))
    both, parts = l_.unionByName(r_), list(by)
    if split is not None:
        both, parts = both.withColumn("__part", split(F.col("__t"))), [*by, "__part"]
    order = Window.partitionBy(*parts).orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__value", F.last("__value", ignorenulls=True).over(order)).where("__side = 1")
    if split is not None:
        last = both.groupBy(*parts).agg(F.max_by("__value", F.when(F.col("__side") == 0, F.struct("__t", "__tie"))).alias("__last"))
        earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        carried = last.select(*(F.col(p).alias(f"__of_{p}") for p in parts), F.last("__last", ignorenulls=True).over(earlier).alias("__carried"))
        on = [out[p].eqNullSafe(F.col(f"__of_{p}")) for p in parts]
        out = out.join(carried, reduce(and_, on), "left").withColumn("__value", F.coalesce("__value", "__carried"))
    if inner:
        out = out.where("__value is not null")
    return out.select(*by, F.col("__t").alias(time), *(F.col("__row")[c].alias(c) for c in kept), *(F.col("__value")[c].alias(f"asof_{c}") for c in value))
