"""Mixing sources to target weights by Pareto order sampling of a fixed number of documents.

Of `total` documents, source s gets a quota by its weight (largest remainders; ties by name). Within a source
a document is to be taken in proportion to its size measure, the bit length of its character count: its share
of the quota is a whole number of certain copies and a rest below 1. The rests of a source add up to a whole
number m; a document's rank is its random odds u/(1-u) divided by the odds rest/(1-rest) of its inclusion, and
the m documents of the lowest rank get one copy more. u depends on the seed, doc_id and text alone.

Weights are whole numbers by source; by default the square root of the source's characters. A source without
a weight gets none. Nothing is ranked over a whole source: ranks are counted in `BUCKETS` intervals, and only
the interval that holds the m-th document is put in order.

Null sources are a source of their own; null and empty texts count as one bit. Repeated rows have equal ranks
and are told apart arbitrarily, so that the number taken stays exact. An empty table gives an empty one. New
columns take other names if theirs are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import column, cut, fresh, lookup, same

SEED = "mix-1"
BUCKETS = 4096
_ALL_BITS = 2.0**48


def measure(docs: DataFrame) -> Column:
    chars = F.coalesce(F.char_length(column(docs, "text")), F.lit(0)).cast("bigint")
    return F.length(F.bin(chars)).cast("bigint")


def quotas(docs: DataFrame, weights: dict[str | None, int] | None = None, total: int | None = None) -> DataFrame:
    """(s, x, whole, part, mass, extra) for each source s and size x: certain copies, rest of the share in
    units of 1/mass, and the documents of the source that get one copy more."""
    spark = docs.sparkSession
    chars = F.coalesce(F.char_length(column(docs, "text")), F.lit(0)).cast("bigint")
    sizes = cut(docs.groupBy(column(docs, "source").alias("s"), measure(docs).alias("x")).agg(F.count(F.lit(1)).alias("n"), F.sum(chars).alias("chars")))
    by = sizes.groupBy("s").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("x")).alias("mass"), F.sum("chars").alias("chars"))
    if weights is None:
        by = by.withColumn("weight", F.greatest(F.floor(F.sqrt(F.col("chars").cast("double"))), F.lit(1)).cast("bigint"))
    else:
        kind = T.StructType([T.StructField("t", T.StringType()), T.StructField("weight", T.LongType())])
        given = spark.createDataFrame(list(weights.items()), kind)
        by = by.join(given, same(F.col("s"), F.col("t"))).drop("t").where("weight > 0")
    whole = by.agg(F.sum("weight").alias("weights"), (F.sum("docs") if total is None else F.lit(total)).cast("bigint").alias("total"))
    by = by.crossJoin(whole).withColumn("product", F.col("total") * F.col("weight"))
    by = by.withColumn("quota", F.expr("product div weights")).withColumn("left", F.col("product") % F.col("weights"))
    short = F.col("total") - F.sum("quota").over(Window.partitionBy())
    turn = F.row_number().over(Window.orderBy(F.col("left").desc(), F.col("s").asc_nulls_first()))
    by = by.withColumn("quota", F.col("quota") + F.when(turn <= short, 1).otherwise(0)).select(F.col("s").alias("t"), "mass", "quota")
    share = F.col("quota") * F.col("x")
    out = sizes.join(by, same(F.col("s"), F.col("t"))).withColumn("share", share)
    out = out.withColumn("whole", F.expr("share div mass")).withColumn("part", F.col("share") % F.col("mass"))
    extra = F.col("quota") - F.sum(F.col("n") * F.col("whole")).over(Window.partitionBy("s"))
    return cut(out.select("s", "x", "whole", "part", "mass", extra.alias("extra")))


def copied(docs: DataFrame, weights: dict[str | None, int] | None = None, total: int | None = None, seed: str = SEED) -> tuple[DataFrame, str, str]:
    """docs with how many copies of each row are certain and how many there are; the two columns' names."""
    quota = quotas(docs, weights, total)
    s, x, whole, part, mass, extra, rank, bucket, edge, taken, key, certain, copies, place = fresh(
        docs, "s", "x", "whole", "part", "mass", "extra", "rank", "bucket", "edge", "taken", "key", "certain", "copies", "place"
    )
    quota = lookup(quota).toDF(s, x, whole, part, mass, extra)
    text = F.coalesce(column(docs, "text"), F.lit(""))
    id_ = F.coalesce(column(docs, "doc_id").cast("string"), F.lit(""))
    own = F.concat(F.lit(seed + "|"), id_, F.lit("|"), F.md5(text.cast("binary")))
    ranked = docs.withColumns({key: F.md5(own.cast("binary"))})
    ranked = ranked.join(quota, same(column(docs, "source"), F.col(s)) & (measure(docs) == F.col(x)), "left")
    u = (F.conv(F.substring(key, 1, 12), 16, 10).cast("bigint").cast("double") + 0.5) / _ALL_BITS
    odds = (u / (1.0 - u)) / (F.col(part).cast("double") / (F.col(mass) - F.col(part)).cast("double"))
    ranked = ranked.withColumn(rank, F.when(F.col(part) > 0, odds))
    ranked = ranked.withColumn(bucket, F.floor(F.col(rank) / (F.col(rank) + 1.0) * BUCKETS).cast("int"))

    counted = ranked.where(F.col(bucket).isNotNull()).groupBy(F.col(s).alias("e"), F.col(bucket).alias(edge), F.col(extra).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("e").orderBy(edge).rowsBetween(Window.unboundedPreceding, 0))
    edges = counted.withColumn("upto", upto).where((F.col("upto") >= F.col("m")) & (F.col("upto") - F.col("n") < F.col("m")))
    edges = cut(edges.select("e", edge, (F.col("m") - F.col("upto") + F.col("n")).alias(taken)))
    (e,) = fresh(ranked, "e")
    edges = lookup(edges.withColumnRenamed("e", e))
    ranked = ranked.join(edges, same(F.col(s), F.col(e)) & F.col(bucket).isNotNull(), "left")

    at_edge = F.coalesce(F.col(bucket) == F.col(edge), F.lit(False))
    before = ranked.where(~at_edge).withColumn(place, F.coalesce(F.col(bucket) < F.col(edge), F.lit(False)).cast("int"))
    order = F.row_number().over(Window.partitionBy(s).orderBy(rank, key))
    at = ranked.where(at_edge).withColumn(place, (order <= F.col(taken)).cast("int"))
    base = F.coalesce(F.col(whole), F.lit(0)).cast("bigint")
    out = before.unionByName(at) if len({c.lower() for c in docs.columns}) == len(docs.columns) else before.union(at)
    out = out.withColumns({certain: base, copies: base + F.col(place)})
    return out.drop(s, x, whole, part, mass, extra, rank, bucket, edge, taken, key, e, place), certain, copies


def allocate(docs: DataFrame, weights: dict[str | None, int] | None = None, total: int | None = None, seed: str = SEED) -> DataFrame:
    """doc_id, source, certain copies and all copies, for every row of docs, also those of no copy."""
    out, certain, copies = copied(docs, weights, total, seed)
    return out.select(column(out, "doc_id").alias("doc_id"), column(out, "source").alias("source"), F.col(certain).alias("certain"), F.col(copies).alias("copies"))


def mixed(docs: DataFrame, weights: dict[str | None, int] | None = None, total: int | None = None, seed: str = SEED) -> DataFrame:
    """Each row of docs as often as it has copies."""
    out, certain, copies = copied(docs, weights, total, seed)
    (again,) = fresh(out, "again")
    rows = F.explode(F.array_repeat(F.lit(1), F.col(copies).cast("int")))
    return out.where(F.col(copies) > 0).withColumn(again, rows).drop(again, certain, copies)


def oracle(seed: str = SEED) -> str:
    """DuckDB SQL for allocate(documents)."""
    return f"""
with d as (select doc_id, source, text, length(coalesce(text, '')) as chars, length(bin(length(coalesce(text, '')))) as x from documents),
b as (select source, sum(x) as mass, count(*) as docs, greatest(cast(floor(sqrt(cast(sum(chars) as double))) as hugeint), 1) as weight from d group by source),
q as (select source, mass, total * weight // weights as quota, row_number() over (order by total * weight % weights desc, source nulls first) as turn,
  total - sum(total * weight // weights) over () as short
  from b, (select sum(weight) as weights, sum(docs) as total from b)),
r as (select source, mass, quota + case when turn <= short then 1 else 0 end as quota from q),
c as (select d.doc_id, d.source, quota * x // mass as whole, quota * x % mass as part, mass,
  quota - sum(quota * x // mass) over (partition by d.source) as extra, md5('{seed}|' || coalesce(cast(doc_id as varchar), '') || '|' || md5(coalesce(text, ''))) as key
  from d join r on d.source is not distinct from r.source),
o as (select *, (cast(cast('0x' || substr(key, 1, 12) as bigint) as double) + 0.5e0) / 281474976710656e0 as u from c),
p as (select *, case when part > 0 then (u / (1e0 - u)) / (cast(part as double) / cast(mass - part as double)) end as rank from o),
n as (select *, row_number() over (partition by source order by rank nulls last, key) as place from p)
select doc_id, source, cast(whole as bigint) as certain, cast(whole + case when part > 0 and place <= extra then 1 else 0 end as bigint) as copies from n"""
