"""Operators on vectors, which have an order: every one takes the partition and the order explicitly.

Over a partition they are windows. Where a vector has no partition, `positions` and `running_total` number and
add up whole tables by ranges of the order, written once, instead of pulling everything into one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..scratch import cut


def over(by: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def upto(by: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return over(by, order).rowsBetween(Window.unboundedPreceding, 0)


def deltas(x: Column, w: WindowSpec) -> Column:
    """Differences from the value before; the first stays as it is."""
    return x - F.coalesce(F.lag(x).over(w), F.lit(0))


def differ(x: Column, w: WindowSpec) -> Column:
    """Whether the value isn't that of the row before; true for the first, null equals null. A first null equals
    the nothing before it."""
    return ~x.eqNullSafe(F.lag(x).over(w))


def moving_average(x: Column, n: int, by: Sequence[str], order: Sequence[str]) -> Column:
    """Mean of up to n values; nulls count neither above nor below the line."""
    return F.avg(x).over(over(by, order).rowsBetween(1 - n, 0))


def running_average(x: Column, by: Sequence[str], order: Sequence[str]) -> Column:
    return F.avg(x).over(upto(by, order))


def _keys(order: Sequence[str], descending: bool = False) -> list[Column]:
    return [F.col(f"`{c}`").desc() if descending else F.col(f"`{c}`").asc() for c in order]


def _parted(df: DataFrame, order: Sequence[str], descending: bool, part: str) -> DataFrame:
    """df in ranges of the order, each sorted, under their numbers. A second evaluation may draw other ranges, so
    whoever needs the numbers twice cuts the lineage in between."""
    keys = _keys(order, descending)
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(part, F.spark_partition_id())


def _before(sums: DataFrame, part: str, name: str) -> DataFrame:
    """(part, name): what all parts before a part add up to. One row a part, so that one task does."""
    w = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(sums.select(part, F.coalesce(F.sum(name).over(w), F.lit(0)).alias(name)))


def _unused(df: DataFrame, *names: str) -> list[str]:
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def positions(df: DataFrame, order: Sequence[str], name: str = "pos", start: int = 1, descending: bool = False) -> DataFrame:
    """df numbered in the order (which must tell all rows apart) without a global sort in one task: one shuffle into
    ranges, written once with each row's place in its range, and the sizes of the ranges added up."""
    part, row, before = _unused(df, "__part", "__row", "__before")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = cut(_parted(df, order, descending, part).withColumn(row, place))
    sizes = ranged.groupBy(part).agg(F.count(F.lit(1)).alias(before))
    numbered = ranged.join(_before(sizes, part, before), part)
    return numbered.withColumn(name, (F.col(before) + F.col(row) + start).cast("bigint")).drop(part, row, before)


def running_total(df: DataFrame, x: Column, order: Sequence[str], name: str = "total") -> DataFrame:
    """df with the sum of x up to each row of the order, like positions: totals within ranges are written once, those
    of the ranges before come on top."""
    part, value, inside, before = _unused(df, "__part", "__x", "__in", "__before")
    parted = _parted(df.withColumn(value, x), order, False, part)
    w = Window.partitionBy(part).orderBy(*_keys(order)).rowsBetween(Window.unboundedPreceding, 0)
    ranged = cut(parted.withColumn(inside, F.sum(value).over(w)))
    sums = ranged.groupBy(part).agg(F.sum(value).alias(before))
    summed = ranged.join(_before(sums, part, before), part)
    return summed.withColumn(name, F.col(before) + F.col(inside)).drop(part, value, inside, before)


def running_sum(df: DataFrame, x: Column, by: Sequence[str], order: Sequence[str], name: str = "total", split: Column | None = None) -> DataFrame:
    """df with the sum of x up to each row of its key. split: an expression that never falls in the order, such as the
    day; a key's rows are then added up by these parts, and the sums of the parts before come on top, so that no task
    holds all of a large key."""
    if split is None:
        return df.withColumn(name, F.sum(x).over(upto(by, order)))
    part, value, inside, before = _unused(df, "__part", "__x", "__in", "__before")
    parted = df.withColumn(part, split).withColumn(value, x)
    sums = parted.groupBy(*by, part).agg(F.sum(value).alias(before))
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    keys = [f"{k}_of" for k in (*by, part)]
    sums = sums.select(*(F.col(k).alias(f"{k}_of") for k in (*by, part)), F.sum(before).over(earlier).alias(before))
    out = parted.withColumn(inside, F.sum(value).over(upto([*by, part], order)))
    on = [out[k].eqNullSafe(F.col(f"{k}_of")) for k in (*by, part)]
    total = F.when(F.col(before).isNull(), F.col(inside)).otherwise(F.col(before) + F.coalesce(F.col(inside), F.lit(0)))
    return out.join(sums, reduce(and_, on), "left").withColumn(name, total).drop(part, value, inside, before, *keys)


def reversed_pairs(df: DataFrame, order: Sequence[str], value: str, position: str = "i") -> DataFrame:
    """(position, value): the vector read backwards."""
    return positions(df.select(*dict.fromkeys([*order, value])), order, position, descending=True).select(position, value)


def groups(df: DataFrame, key: str, index: str) -> DataFrame:
    """Each value with the sorted indices where it stands."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(index)).alias("indices"))


def sorted_parts(df: DataFrame, part: str, order: Sequence[str]) -> DataFrame:
    """Equal values of part together in one partition, sorted: what a parted attribute promises."""
    return df.repartition(F.col(part)).sortWithinPartitions(part, *order)
