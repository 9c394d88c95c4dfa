"""Kernels shared by the operators: UTF-8 texts of an Arrow array as one byte vector, words as spans in it.

All work in pieces of about `PIECE` bytes (a longer text is a piece of its own), so memory follows the
longest text and not the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut, shared_folder  # noqa: F401  used by the operators

PIECE = 1 << 20
_ROOT = np.uint64(0x9E3779B97F4A7C15)
_ROOT_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Characters above ASCII are letters here; the other table parts words at control characters and blanks only.
WORD_BYTES = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
INK_BYTES = np.arange(256) > 32
#: First bytes of kana and Han characters in UTF-8, which are written without blanks between words.
HAN_BYTES = (np.arange(256) >= 0xE3) & (np.arange(256) <= 0xE9)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores at least: a few small files else keep most of them idle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def column(df: DataFrame, name: str) -> Column:
    """Column by its exact name, also where the name holds dots or other columns differ from it in case only. Where
    no name is exact, one that differs in case serves; a name that is there twice is an error."""
    if df.columns.count(name) > 1:
        raise ValueError(f"column {name} is there more than once")
    quoted = "`" + name.replace("`", "``") + "`"
    if sum(c.lower() == name.lower() for c in df.columns) < 2:
        return df[quoted]
    conf, key = df.sparkSession.conf, "spark.sql.caseSensitive"
    before = conf.get(key)
    conf.set(key, "true")  # names are resolved here and now
    try:
        return df[quoted]
    finally:
        conf.set(key, before)


def lookup(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A checkpointed table for the small side of a join: broadcast if it has few rows, else left to the planner,
    which knows nothing of a checkpoint's size and would shuffle the large side."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def md5_part(key: Column, first: int, digits: int) -> Column:
    """digits hex digits of md5(key) as a bigint; the same in SQL dialects that have md5 only."""
    return F.conv(F.substring(F.md5(key.cast("binary")), first, digits), 16, 10).cast("bigint")


def pieces(texts: pa.Array, piece: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets of the texts in them); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + piece, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no trace of their order."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Hashes of any spans of a vector of 64-bit codes from prefix sums modulo 2**64; powers are kept between uses."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, PIECE + 64)
            self.up, self.down = np.full(size, _ROOT), np.full(size, _ROOT_INV)
            self.up[0] = self.down[0] = 1
            np.cumprod(self.up, out=self.up)
            np.cumprod(self.down, out=self.down)

    def sums(self, codes: np.ndarray) -> np.ndarray:
        self.grow(len(codes) + 1)
        out = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * self.up[: len(codes)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[start]


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, alone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of each maximal run of bytes that `inside` allows; texts never run together. alone: bytes
    that begin a character of three bytes that is a word of its own."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    ink = inside[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    first[edge] = ink[edge]
    if alone is not None:
        own = alone[data]
        if own.any():
            own[3:] |= own[:-3]
            first |= own & ink
    last = ink.copy()
    last[:-1] &= ~ink[1:] | first[1:]
    edge = edge[edge > 0] - 1
    last[edge] = ink[edge]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, "right") - 1


def word_hashes(rolling: Rolling, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(rolling.spans(rolling.sums(_BYTE_CODE[data]), start, end))
