"""Tables that merge their rows when read: replacing, collapsing, aggregating, buffered, expiring, sampled."""

from __future__ import annotations

import time
from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dml

if TYPE_CHECKING:
    from ..sources.catalog import Store


def replacing(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Of rows with equal keys the one of the highest version; one aggregation, without a sort."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("last"))
    return last.select(*keys, *(F.col("last")[c].alias(c) for c in rest)).select(*df.columns)


def balance(df: DataFrame, keys: Sequence[str], sign: Column, name: str = "balance") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(sign).cast("bigint").alias(name))


def collapsing(df: DataFrame, keys: Sequence[str], sign: str, order: str) -> DataFrame:
    """Of each key whose signs add up to more than 0 the last positive row by order."""
    rest = [c for c in df.columns if c not in (*keys, sign)]
    last = F.max_by(F.struct(*rest), F.when(F.col(sign) > 0, F.col(order)))
    out = df.groupBy(*keys).agg(F.sum(sign).alias("__sum"), last.alias("__last")).where("__sum > 0")
    return out.select(*keys, *(F.col("__last")[c].alias(c) for c in rest))


def states(df: DataFrame, keys: Sequence[str], **sums: Column) -> DataFrame:
    """Partial aggregates, each of which merges by addition."""
    return df.groupBy(*keys).agg(*(F.sum(c).alias(n) for n, c in sums.items()))


def merged(df: DataFrame, keys: Sequence[str], **names: str) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.sum(state).alias(name) for name, state in names.items()))


def hot_cold(cold: DataFrame, hot: DataFrame, order: str, cutoff: Column | None = None) -> DataFrame:
    """Persisted and recent rows together, none dropped; with a cutoff the cold side serves up to it and the hot
    side what follows. Filters above reach both scans."""
    if cutoff is not None:
        cold, hot = cold.where(F.col(order) <= cutoff), hot.where(F.col(order) > cutoff)
    return cold.unionByName(hot)


def unexpired(df: DataFrame, column: str, days: int, as_of: Column) -> DataFrame:
    return df.where(F.col(column) >= as_of - F.make_dt_interval(F.lit(days)))


def sampled(df: DataFrame, key: Column, share: float) -> DataFrame:
    """The rows whose key hashes into the first share of the range: the same rows of a key everywhere."""
    return df.where(F.pmod(key, F.lit(65536)) < int(share * 65536))


class Buffer:
    """Rows that wait before a table: readers see both; they move over at `rows` rows or after `seconds`."""

    def __init__(self, store: Store, table: str, rows: int = 1024, seconds: float = 1.0) -> None:
        self.store, self.table, self.rows, self.seconds = store, table, rows, seconds
        self.waiting: DataFrame | None = None
        self.count, self.since = 0, time.monotonic()

    def insert(self, rows: DataFrame, with_defaults: bool = False) -> None:
        spec = dml.evolved(self.store, self.table, rows)
        ready = dml.completed(self.store, spec, rows, with_defaults)
        if self.waiting is None:
            self.since = time.monotonic()
        self.waiting = ready if self.waiting is None else self.waiting.unionByName(ready, allowMissingColumns=True)
        self.count += ready.count()
        if self.count >= self.rows or time.monotonic() - self.since >= self.seconds:
            self.flush()

    def flush(self) -> None:
        if self.waiting is not None:
            self.store.append(self.table, self.waiting)
            self.waiting, self.count = None, 0

    def df(self) -> DataFrame:
        there = self.store.df(self.table)
        return there if self.waiting is None else there.unionByName(self.waiting, allowMissingColumns=True)
