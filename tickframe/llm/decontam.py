"""Benchmark decontamination: passages of benchmark items in documents, up to a share of edited words.

Words are lower-case runs of letters and digits; kana and Han characters, which no blanks part, are words by
themselves. A document holds an item of m words if one of its runs of words is at a word edit distance of
`EDITS` * m (rounded down) from it at most, so an item of up to 6 words only if it is there word for word.

Search: with k edits at most, one of any k+1 words of the item stands untouched, so the k+1 rarest words of its
first half are its anchors, and a window that reaches as far as the item does is laid wherever a document has
an anchor word. Windows and items are embedded by the CGK random walk: at each step the current word is written
and a random bit of step and word says whether to move on, which turns edit distance into Hamming distance. An
LSH key is the anchor with `SAMPLED` symbols of the embedding at random steps; it is drawn anew `repeats()`
times, enough for `RECALL` of the windows in which a symbol of the embedding differs with the probability
`DIFFER`. Keys are drawn for classes of window lengths, each twice as long as the one before. Candidates are
verified by the exact edit distance of the whole item to any run of words around the window.

Documents without words hold nothing, and items without words are in no document; every other item is searched,
however short. Equal items are all reported, equal rows each by itself. Null item ids are reported as null. The index
of the items is built once and broadcast in blocks of about `BLOCK` bytes of text, one pass over the documents
each, so a benchmark may be of any size. Extra columns pass through; an empty table or an empty benchmark gives no
matches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import HAN_BYTES, WORD_BYTES, Rolling, column, fresh, mix, pieces, word_hashes, words

EDITS = 0.15
SAMPLED = 3
RECALL = 0.95
DIFFER = 0.4
BLOCK = 16 << 20
_END = np.uint64(0x5BF0A8B1457695F5)
_MATCH = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("start", T.IntegerType())]))


def repeats() -> int:
    return math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - DIFFER) ** SAMPLED))


def budget(length: int) -> int:
    return int(EDITS * length + 1e-9)


def steps_of(length_class: int, repeat: int) -> np.ndarray:
    """Sampled steps of the walk for windows of 2**length_class words or more."""
    reach = max(SAMPLED, int(1.6 * (1 << length_class)))
    return np.sort(np.random.default_rng([repeat, length_class]).choice(np.arange(1, reach + 1), min(SAMPLED, reach), replace=False))


def walked(codes: np.ndarray, at: np.ndarray, limit: np.ndarray, classes: list[int], counts: list[int], repeat: int) -> list[np.ndarray]:
    """For each class the LSH keys of the first windows, as many as counts says, that begin at `at`; `limit` is
    where their texts end. Counts don't rise with the class."""
    salt = np.random.default_rng([77, repeat]).integers(1, 1 << 63, 64, dtype=np.uint64)
    wanted = [steps_of(c, repeat) for c in classes]
    keys = [mix(codes[at[:n]] + np.uint64(c + 1)) for c, n in zip(classes, counts)]
    where, current = at.copy(), codes[at]
    for step in range(1, max((int(w[-1]) for w in wanted), default=0) + 1):
        n = max((n for n, w in zip(counts, wanted) if w[-1] >= step), default=0)
        if n < len(where):
            where, limit, current = where[:n], limit[:n], current[:n]
        where = where + (((current ^ salt[step & 63]) * np.uint64(0x9E3779B97F4A7C15 + 2 * (step >> 6))) >> np.uint64(63)).astype(np.int64)
        np.minimum(where, limit, out=where)
        current = codes.take(where, mode="clip")
        current[where == limit] = _END
        for i, w in enumerate(wanted):
            if step in w:
                keys[i] = mix(keys[i] ^ (current[: counts[i]] + np.uint64(step)))
    return keys


class Items:
    """Benchmark items with their anchors and LSH keys."""

    def __init__(self, texts: list[str | None]) -> None:
        rolling, self.codes = Rolling(), []
        lengths: dict[int, int] = {}
        for _, data, offsets in pieces(pc.utf8_lower(pa.array(texts, pa.large_string()))):
            start, end, owner = words(data, offsets, WORD_BYTES, HAN_BYTES)
            codes = word_hashes(rolling, data, start, end)
            lengths |= zip(codes.tolist(), (end - start).tolist())
            self.codes += [codes[owner == i] for i in range(len(offsets) - 1)]
        values, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.codes]), return_counts=True)
        often = dict(zip(values.tolist(), counts.tolist()))
        entries = []
        for i, codes in enumerate(self.codes):
            m = len(codes)
            if m:
                k = budget(m)
                half = range(max(k + 1, -(-m // 2)))
                rare = sorted(half, key=lambda j: (often[int(codes[j])], -lengths[int(codes[j])], j))
                entries += [(i, j) for j in rare[: k + 1]]
        self.item, self.offset = (np.array([e[x] for e in entries], np.int64) for x in (0, 1))
        size = np.array([len(c) for c in self.codes], np.int64)
        base = np.r_[0, np.cumsum(size)]
        self.size = size
        flat = np.concatenate([np.zeros(0, np.uint64), *self.codes])
        at, limit = base[self.item] + self.offset, base[self.item + 1]
        level = np.log2(np.maximum(limit - at, 1)).astype(np.int64)
        self.classes = sorted(set(level.tolist()))
        self.anchors, which = np.unique(flat[at] if len(at) else np.zeros(0, np.uint64), return_inverse=True)
        self.top = np.zeros(len(self.anchors), np.int64)  # the highest class of an anchor's windows
        np.maximum.at(self.top, which, level)
        self.bits = max(16, int(len(self.anchors)).bit_length() + 8)
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[(self.anchors & np.uint64((1 << self.bits) - 1)).astype(np.int64)] = True
        self.tables = []  # by repeat, then class: (sorted keys, their entries)
        for r in range(repeats() if len(at) else 0):
            by_class = []
            for c, keys in zip(self.classes, walked(flat, at, limit, self.classes, [len(at)] * len(self.classes), r)):
                of = np.flatnonzero(level == c)
                of = of[np.argsort(keys[of])]
                by_class.append((keys[of], of))
            self.tables.append(by_class)

    def distance(self, item: int, codes: np.ndarray) -> tuple[int, int]:
        """Least word edit distance of the item to a run of codes, and where the first such run ends."""
        n, place = len(codes), np.arange(len(codes) + 1)
        row = np.zeros(n + 1, np.int64)
        for i, c in enumerate(self.codes[item]):
            new = np.empty(n + 1, np.int64)
            new[0] = i + 1
            np.minimum(row[:-1] + (codes != c), row[1:] + 1, out=new[1:])
            row = np.minimum.accumulate(new - place) + place
        return int(row.min()), int(row.argmin())

    def matches(self, rolling: Rolling, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """For each text (item, distance, index of the word where the window around the passage begins)."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
        start, end, owner = words(data, offsets, WORD_BYTES, HAN_BYTES)
        if not len(start) or not len(self.anchors):
            return out
        codes = word_hashes(rolling, data, start, end)
        at = np.flatnonzero(self.maybe[(codes & np.uint64((1 << self.bits) - 1)).astype(np.int64)])
        near = np.minimum(np.searchsorted(self.anchors, codes[at]), len(self.anchors) - 1)
        there = self.anchors[near] == codes[at]
        at, near = at[there], near[there]
        if not len(at):
            return out
        order = np.argsort(-self.top[near], kind="stable")
        at, near = at[order], near[order]
        counts = [int((self.top[near] >= c).sum()) for c in self.classes]
        ends = np.searchsorted(owner, np.arange(len(out)), "right")
        limit = ends[owner[at]]
        found = []
        for r, tables in enumerate(self.tables):
            for keys, (known, entry) in zip(walked(codes, at, limit, self.classes, counts, r), tables):
                low, high = np.searchsorted(known, keys, "left"), np.searchsorted(known, keys, "right")
                hit = np.flatnonzero(high > low)
                count = (high - low)[hit]
                within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                e = entry[np.repeat(low[hit], count) + within]
                window = np.repeat(at[hit], count)
                found.append(np.stack([owner[window], self.item[e], window - self.offset[e]], 1))
        begins = np.searchsorted(owner, np.arange(len(out)), "left")
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for text, item, first in np.unique(np.concatenate([np.zeros((0, 3), np.int64), *found]), axis=0).tolist():
            m = int(self.size[item])
            k = budget(m)
            low, high = max(int(begins[text]), first - k), min(int(ends[text]), first + m + k)
            if np.isin(codes[low:high], self.codes[item]).sum() < m - k:
                continue
            d, stop = self.distance(item, codes[low:high])
            if d <= k:
                begin = max(low, low + stop - m) - int(begins[text])
                if (d, begin) < best.get((text, item), (k + 1, 0)):
                    best[text, item] = (d, begin)
        for (text, item), (d, begin) in sorted(best.items()):
            out[text].append((item, d, begin))
        return out


def blocks(benchmark: DataFrame) -> Iterator[tuple[list[int | None], list[str | None]]]:
    """Ids and texts of the items, in blocks of about `BLOCK` bytes."""
    size = benchmark.agg(F.sum(F.octet_length(column(benchmark, "text")))).first()[0] or 0
    count = max(1, -(-size // BLOCK))
    rows = benchmark.select(column(benchmark, "item_id").cast("bigint").alias("i"), column(benchmark, "text").alias("t"))
    for b in range(count):
        some = rows if count == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == b)
        found = some.orderBy("i", "t").toArrow()
        yield found["i"].to_pylist(), found["t"].to_pylist()


def matcher(spark: SparkSession, ids: list[int | None], texts: list[str | None]):
    """UDF: matches of a text with the items of these texts. Their index is built here, once, and broadcast."""
    sent = spark.sparkContext.broadcast((Items(texts), pa.array(ids, pa.int64())))

    @F.arrow_udf(_MATCH)
    def matched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        (items, names), rolling = sent.value, Rolling()
        for batch in batches:
            out = []
            for _, data, offsets in pieces(pc.utf8_lower(batch)):
                out += items.matches(rolling, data, offsets)
            flat = np.array([m for ms in out for m in ms], np.int32).reshape(-1, 3)
            ends = np.r_[0, np.cumsum([len(ms) for ms in out])].astype(np.int32)
            rest = [pa.array(np.ascontiguousarray(flat[:, i])) for i in (1, 2)]
            fields = pa.StructArray.from_arrays([names.take(pa.array(np.ascontiguousarray(flat[:, 0]))), *rest], ["item_id", "distance", "start"])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields)

    return matched.asNondeterministic()  # else a filter on its result would run it twice


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance and start (the word where the passage's window begins), one row for each item
    that a row of docs holds."""
    out = None
    for ids, texts in blocks(benchmark):
        match = matcher(docs.sparkSession, ids, texts)
        found = docs.select(column(docs, "doc_id").alias("doc_id"), F.explode(match(column(docs, "text"))).alias("m")).select("doc_id", "m.*")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold an item."""
    out, text = docs, column(docs, "text")
    (name,) = fresh(docs, "leaks")
    for ids, texts in blocks(benchmark):
        out = out.withColumn(name, matcher(docs.sparkSession, ids, texts)(text)).where(F.size(F.col(name)) == 0).drop(name)
    return out
