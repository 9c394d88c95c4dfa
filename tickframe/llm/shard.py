"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, overfull ranges cut again.

A record's key is one string: its key columns, then the md5 of its text, so that any two different records
have different keys. Sizes are bytes of text, 1 at least. A shard aims at `TARGET` bytes, or less where that would
make fewer than `SHARDS` of them. Records are drawn with probability proportional to size (`SAMPLES` a range are
expected; the draw depends on the key alone), weighted quantiles of the sampled keys are the boundaries of as
many ranges as there will be shards, and all records in each range are measured.
A range over `SLACK` times the aim is cut at the quantiles of all of its records' sizes into as many
shards as the aim asks for. Shards are numbered in key order.

The sample is added up by ranges of its keys, so no task holds all of it. The driver learns one key a shard. Those
are broadcast if they take `BROADCAST` bytes at most; beyond, records find their shard by a join on the key.
`sharded` lays consecutive shards in a partition, sorted, `SPREAD` times the root of their number of partitions: so
many that each has one of its own up to SPREAD squared, and few enough beyond that a shuffle's blocks don't
multiply with the square of the data. Written by shard, each is one file.

Null and empty texts are records of size 1; null key values come before all others. Equal records (same
key) always share a shard, also if that overfills it. An empty table has no shards. Other columns pass
through, and the new one takes another name if `shard` is taken.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import running_total
from .text import column, cut, fresh, md5_part

TARGET = 64 << 20
SAMPLES = 64
SHARDS = 64
SLACK = 1.25
BROADCAST = 256 << 20
SPREAD = 16
KEYS = ("source", "doc_id")


def sort_key(docs: DataFrame, keys: tuple[str, ...] = KEYS) -> Column:
    parts = []
    for k in keys:
        c = column(docs, k)
        if isinstance(docs.schema[k].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            text = F.lpad((c.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string"), 20, "0")
        else:
            text = F.concat(c.cast("string"), F.lit("\x01"))
        parts.append(F.coalesce(F.concat(F.lit("1"), text), F.lit("0")))
    return F.concat(*parts, F.coalesce(F.md5(column(docs, "text").cast("binary")), F.lit("0")))


def size_of(docs: DataFrame) -> Column:
    return F.greatest(F.coalesce(F.octet_length(column(docs, "text")), F.lit(0)), F.lit(1)).cast("bigint")


def placed(spark: SparkSession, boundaries: list[str]):
    """UDF: how many of the sorted boundaries are at or before a key."""
    sent = spark.sparkContext.broadcast([b.encode() for b in boundaries])

    @F.arrow_udf(T.IntegerType())
    def place(keys: pa.Array) -> pa.Array:
        bounds = sent.value
        return pa.array([bisect_right(bounds, k) for k in keys.cast(pa.binary()).to_pylist()], pa.int32())

    return place


def aim(total: int, target: int = TARGET, least: int = SHARDS) -> int:
    """Bytes that a shard should have."""
    return max(1, min(target, -(-total // least)))


def splitters(sizes: DataFrame, total: int, ranges: int) -> list[str]:
    """Boundaries between so many ranges, from a sample of sizes (k, w) drawn by weight."""
    draws = ranges * SAMPLES
    u = md5_part(F.col("k"), 1, 8).cast("double")
    drawn = sizes.where(u * F.lit(float(total)) < F.col("w").cast("double") * F.lit(float(draws) * 2.0**32)).select("k", F.greatest(F.col("w"), F.lit(total // draws)).alias("v"))
    ranked = running_total(drawn, F.col("v"), ["k"], "upto")
    everything = ranked.agg(F.sum("v")).first()[0]
    if everything is None:
        return []
    bucket = F.floor((F.col("upto") - F.col("v")).cast("double") * F.lit(float(ranges)) / F.lit(float(everything)))
    firsts = ranked.groupBy(bucket.alias("b")).agg(F.min("k").alias("k")).where("b > 0")
    return sorted({r.k for r in firsts.select("k").collect()})


def bounded(docs: DataFrame, target: int = TARGET, keys: tuple[str, ...] = KEYS, least: int = SHARDS) -> DataFrame:
    """(k): first key of each shard."""
    sizes = cut(docs.select(sort_key(docs, keys).alias("k"), size_of(docs).alias("w")))
    total = sizes.agg(F.sum("w")).first()[0] or 0
    goal = aim(total, target, least)
    ranges = max(1, -(-total // goal))
    place = placed(docs.sparkSession, splitters(sizes, total, ranges) if ranges > 1 else [])
    ranged = cut(sizes.select("k", "w", place("k").alias("r")))
    measured = ranged.groupBy("r").agg(F.sum("w").alias("bytes"), F.min("k").alias("k"))
    measured = cut(measured.withColumn("pieces", F.when(F.col("bytes") > SLACK * goal, F.ceil(F.col("bytes") / F.lit(float(goal)))).otherwise(1)))
    over = measured.where("pieces > 1").select("r", "bytes", "pieces")
    upto = F.sum("w").over(Window.partitionBy("r").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    within = ranged.join(over, "r").withColumn("before", upto - F.col("w"))
    piece = F.floor(F.col("before").cast("double") * F.col("pieces").cast("double") / F.col("bytes").cast("double"))
    firsts = within.groupBy("r", piece.alias("p")).agg(F.min("k").alias("k")).select("k")
    return cut(firsts.unionByName(measured.where("pieces = 1").select("k")).distinct())


def assign(
    docs: DataFrame, target: int = TARGET, keys: tuple[str, ...] = KEYS, name: str = "shard", least: int = SHARDS, broadcast: int = BROADCAST
) -> tuple[DataFrame, int]:
    """docs with the number of its shard, and how many shards there are."""
    shard, key = fresh(docs, name, "shard_key")
    firsts = bounded(docs, target, keys, least)
    count, length = firsts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("k")), F.lit(0))).first()
    keyed = docs.withColumn(key, sort_key(docs, keys))
    if length <= broadcast:
        place = placed(docs.sparkSession, sorted(r.k for r in firsts.collect())[1:])
        return keyed.withColumn(shard, place(F.col(key))).drop(key), count
    marks = keyed.select(key, F.lit(0).alias(shard)).distinct().unionByName(firsts.select(F.col("k").alias(key), F.lit(1).alias(shard)))
    most = marks.groupBy(key).agg(F.max(shard).alias("first"), F.min(shard).alias("is"))
    found = running_total(most, F.col("first"), [key], "upto").where(F.col("is") == 0).select(key, (F.col("upto") - 1).cast("int").alias(shard))
    return keyed.join(found, key).drop(key), count


def sharded(docs: DataFrame, target: int = TARGET, keys: tuple[str, ...] = KEYS, least: int = SHARDS) -> DataFrame:
    """docs with its shard; no shard is in two partitions, and those of a partition are in order."""
    out, count = assign(docs, target, keys, least=least)
    shard = F.col(f"`{out.columns[-1]}`")
    parts = min(count, SPREAD * math.isqrt(max(count - 1, 0)) + SPREAD)
    if count < 2:
        return out
    if parts == count:
        return out.repartitionById(count, shard)
    return out.repartitionById(parts, F.floor(shard.cast("bigint") * parts / count).cast("int")).sortWithinPartitions(shard)


def oracle(target: int = TARGET, least: int = SHARDS) -> str:
    """DuckDB SQL for sharded(documents)."""
    key = "coalesce('1' || source || chr(1), '0') || coalesce('1' || lpad(cast(cast(doc_id as hugeint) + 9223372036854775808 as varchar), 20, '0'), '0') || coalesce(md5(text), '0')"
    return f"""
with d as (select *, {key} as k, greatest(coalesce(strlen(text), 0), 1) as w from documents),
a as (select cast(coalesce(sum(w), 0) as bigint) as total from d),
g as (select total, greatest(1, least({target}, (total + {least} - 1) // {least})) as goal from a),
t as (select total, goal, greatest(1, (total + goal - 1) // goal) as n from g),
s as (select k, greatest(w, total // (n * {SAMPLES})) as v from d, t where n > 1
  and cast(cast('0x' || substr(md5(k), 1, 8) as bigint) as double) * cast(total as double) < cast(w as double) * (cast(n * {SAMPLES} as double) * 4294967296e0)),
q as (select k, floor(cast(sum(v) over (order by k rows unbounded preceding) - v as double) * cast(n as double) / cast(sum(v) over () as double)) as b from s, t),
b as (select distinct min(k) as k from q where b > 0 group by b),
r as (select d.k, d.w, (select count(*) from b where b.k <= d.k) as r from d),
m as (select r, sum(w) as bytes, min(k) as k, case when sum(w) > {SLACK}e0 * any_value(goal) then ceil(sum(w) / cast(any_value(goal) as double)) else 1 end as pieces from r, t group by r),
c as (select r, k, floor(cast(sum(w) over (partition by r order by k rows unbounded preceding) - w as double) * cast(pieces as double) / cast(bytes as double)) as p from r join (select r, bytes, pieces from m where pieces > 1) using (r)),
f as (select min(k) as k from c group by r, p union select k from m where pieces = 1)
select doc_id, text, lang, source, n_chars, cast((select count(*) from f where f.k <= d.k) - 1 as int) as shard from d"""
