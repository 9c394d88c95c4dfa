"""Scores of texts by a hashed maximum-entropy language model with a class-factored softmax.

Words are lower-case runs of letters and digits. Every word that the corpus has often enough, `LEAST` times and once for
every `OWN` that the root of the number of its words contains, has an output of its own; all others share the
unknown word's, inside which each has the probability of its spelling, by pairs of bytes
as the corpus's rare words have them. Outputs in order of frequency are the leaves of a tree: `CLASSES` classes of
`WIDTH` places, and where words outgrow a level, its last places hold nodes of `WIDTH` places each, so that the
number of nodes grows with the vocabulary. P(word | context) = P(class | context) * P(place | node, context) for
each node on the way to the word, all softmaxes of the unigram log-frequency and weights of the context's features:
the word before, the two words before, and, skipping one, the word before that; each hashed to a row of the class
table and, with the node, to a row of the word table. The word table has `ROOT` rows for each unit of the root of
the number of words in the corpus, the class table half as many; small corpora have `WORD_ROWS` and `CLASS_ROWS`. So
tables grow with the corpus, as slowly as it must be for every worker to hold them, and contexts share rows.

All counts are over the whole corpus. Training passes over each document once, in `ROUNDS` parts, or as many as leave a task
no more than about `WORDS` words in each, so that no task is long to do again: every task
takes gradient steps on its documents from the weights sent out, and returns the rows that it has changed
times how often; a row's new weights are the mean of the tasks' weights by that number, summed block by block on
the executors. As many tasks train at once as there are cores, as each returns up to a whole
table. So weights, and scores, depend a little on how documents lie in tasks. In training, exponentials are exact to
about 2 %; scores use exact ones. Scores are the log2 probabilities of a text's words, in batches.

Texts without words, null and empty ones too, have 0 words, 0.0 bits and null bits per word. Equal texts have
equal scores. An empty table gives an empty result. Extra columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import WORD_BYTES, Rolling, column, cut, mix, pieces, word_hashes, words

WIDTH = 32
CLASSES = 16
LEAST, OWN = 5, 512
CLASS_ROWS, WORD_ROWS = 1 << 14, 1 << 15
ROOT = 16
ROUNDS, WORDS = 2, 1 << 27
BATCH = 2048
RATE = 0.7
BLOCKS = 256
_FEATURES = 3
_NOTHING = 1e-6
_EDGE = 256


def uniform() -> np.ndarray:
    return letters(np.zeros((_EDGE + 1, _EDGE + 1)))


@dataclass
class Model:
    """known: hashes of the words with an output, sorted, and output: their places, a node's number times `WIDTH`
    and the place in it; class_bias and word_bias are unigram logarithms. above: the places that lead to the nodes
    beyond the classes; unknown: the unknown word's place; total: words in the corpus; spelling: bits of each byte after each, `_EDGE` for a
    word's start and end."""

    known: np.ndarray
    output: np.ndarray
    class_bias: np.ndarray
    word_bias: np.ndarray
    class_rows: np.ndarray
    word_rows: np.ndarray
    above: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    unknown: int = 0
    total: int = 0
    spelling: np.ndarray = field(default_factory=uniform)

    def outputs(self, codes: np.ndarray) -> np.ndarray:
        out = np.full(len(codes), self.unknown, np.int64)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
            hit = self.known[at] == codes
            out[hit] = self.output[at[hit]]
        return out

    def walk(self, out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(class of each output; and for each node on the way to one: index of the output, node, place in it)."""
        top, line, ways = np.zeros(len(out), np.int64), np.arange(len(out)), []
        while len(line):
            node = out // WIDTH
            ways.append((line, node, out % WIDTH))
            top[line] = node
            deep = node >= CLASSES
            line, out = line[deep], self.above[node[deep] - CLASSES]
        return (top, *(np.concatenate(x) for x in zip(*ways))) if ways else (top, line, line, line)


def letters(pairs: np.ndarray) -> np.ndarray:
    """Bits of each byte or end after each byte or start, from how often the pairs are there."""
    may = np.r_[WORD_BYTES, True]
    seen = np.where(may[:, None] & may, pairs + 0.02, 0.0)
    seen[_EDGE, _EDGE] = 0  # no word is empty
    with np.errstate(divide="ignore"):
        bits = -np.log2(seen / np.maximum(seen.sum(1, keepdims=True), 1e-300))
    return np.where(np.isfinite(bits), bits, 0.0)


def layout(words_: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the words in order of frequency, places that lead to the nodes beyond the classes)."""
    first, nodes, places, above = 0, CLASSES, [], []
    while True:
        free, inner = nodes * WIDTH, 0
        if words_ > free:
            inner = min(free // (2 if first else 4), -(-(words_ - free) // (WIDTH - 1)))
        places.append(first + np.arange(min(words_, free - inner)))
        words_ -= len(places[-1])
        above.append(first + free - inner + np.arange(inner))
        first, nodes = first + free, inner
        if not words_:
            return np.concatenate(places), np.concatenate(above)


def contexts(codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """64-bit features of each word's context, a column each."""
    n = len(codes)
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    one[1:] = np.where(owner[1:] == owner[:-1], codes[:-1], 0)
    two[2:] = np.where(owner[2:] == owner[:-2], codes[:-2], 0)
    return np.stack([mix(one + np.uint64(1)), mix(one * np.uint64(0x9E3779B97F4A7C15) + two + np.uint64(2)), mix(two + np.uint64(3))])


def row_at(hashes: np.ndarray, rows: int) -> np.ndarray:
    return (((hashes & np.uint64(0xFFFFFFFF)) * np.uint64(rows)) >> np.uint64(32)).astype(np.int32)


def word_at(features: np.ndarray, node: np.ndarray, rows: int) -> np.ndarray:
    return row_at(mix((features >> np.uint64(24)) + node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), rows)


_HALF_EXP, _ONE = np.float32(2**23 / np.log(2) / 2), np.float32(1064866805)


def roughly(z: np.ndarray) -> np.ndarray:
    """exp(z) to 2 %, for z from -80 to 60: z shifted into the exponent of a float, for half of z and its negative."""
    z = np.clip(z, -80, 60)
    z *= _HALF_EXP
    out = (z + _ONE).astype(np.int32).view(np.float32)
    out /= (_ONE - z).astype(np.int32).view(np.float32)
    return out


def softmax(z: np.ndarray, rough: bool = False) -> np.ndarray:
    if rough:
        z = roughly(z)
    else:
        np.minimum(z, 60, out=z)  # far beyond what the weights add up to; no exponential overflows
        np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[1], np.float32))[:, None]
    return z


def class_scores(model: Model, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, exponents of each class)."""
    at = row_at(features, len(model.class_rows))
    z = model.class_rows.take(at[0], axis=0, mode="clip")
    for f in range(1, _FEATURES):
        z += model.class_rows.take(at[f], axis=0, mode="clip")
    z += model.class_bias
    return at, z


def place_scores(model: Model, features: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, exponents of each place in the node)."""
    at = word_at(features, node, len(model.word_rows))
    z = model.word_rows.take(at[0], axis=0, mode="clip")
    for f in range(1, _FEATURES):
        z += model.word_rows.take(at[f], axis=0, mode="clip")
    z += model.word_bias.take(node, axis=0, mode="clip")
    return at, z


def forward(model: Model, features: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows of classes, rows of words, P of each class, P of each place in the group)."""
    (a, of_class), (b, of_place) = class_scores(model, features), place_scores(model, features, group)
    return a, b, softmax(of_class), softmax(of_place)


def cost(z: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Bits of one choice in each line of exponents."""
    np.minimum(z, 60, out=z)
    own = z[np.arange(len(z)), which].astype(np.float64)
    np.exp(z, out=z)
    return np.minimum((np.log((z @ np.ones(z.shape[1], np.float32)).astype(np.float64)) - own) / np.log(2), 100)


def step(rows: np.ndarray, used: np.ndarray, at: np.ndarray, gradient: np.ndarray) -> None:
    """One descent step on the rows that a batch has used; gradient has a line for each column of at."""
    flat = at.reshape(-1)
    packed = np.sort(flat.astype(np.int64) << 24 | np.arange(len(flat)))
    ranked, order = packed >> 24, packed & 0xFFFFFF
    heads = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    count = np.diff(np.r_[heads, len(ranked)])
    line = order % gradient.shape[0]
    total = gradient.take(line[heads], axis=0, mode="clip")
    few = np.flatnonzero((count > 1) & (count <= 16))
    for k in range(1, 16):  # most rows are used once or twice in a batch
        few = few[count[few] > k]
        if not len(few):
            break
        total[few] += gradient.take(line[heads[few] + k], axis=0, mode="clip")
    for r in np.flatnonzero(count > 16).tolist():
        total[r] = gradient.take(line[heads[r] : heads[r] + count[r]], axis=0, mode="clip").sum(0)
    which = ranked[heads]
    total *= (-RATE / (count + 4.0)).astype(np.float32)[:, None]
    total += rows.take(which, axis=0, mode="clip")
    whole = f"V{rows.shape[1] * rows.itemsize}"  # rows are put as one item each
    np.put(rows.view(whole).reshape(-1), which, total.view(whole).reshape(-1), mode="clip")
    used[which] += count


@dataclass
class Tokens:
    """Words of some texts: index of the first text, number of texts, hashes of words, the texts that they are in
    (from 0), and their bytes."""

    first: int
    many: int
    codes: np.ndarray
    owner: np.ndarray
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def pairs(self, some: np.ndarray) -> np.ndarray:
        """How often each byte or end follows each byte or start in some of the words."""
        side, inside = _EDGE + 1, np.zeros(len(self.data) + 1, np.int64)
        np.add.at(inside, self.start[some] + 1, 1)
        np.add.at(inside, self.end[some], -1)
        here = np.flatnonzero(np.cumsum(inside)[:-1])
        first, last = self.data[self.start[some]].astype(np.int64), self.data[self.end[some] - 1].astype(np.int64)
        at = np.concatenate([self.data[here - 1].astype(np.int64) * side + self.data[here], _EDGE * side + first, last * side + _EDGE])
        return np.bincount(at, minlength=side * side).reshape(side, side)

    def spelt(self, spelling: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Bits of the spelling of some of the words."""
        after = np.zeros(len(self.data))
        after[1:] = spelling[self.data[:-1], self.data[1:]]
        total = np.cumsum(after)
        start, last = self.start[some], self.end[some] - 1
        return spelling[_EDGE, self.data[start]] + (total[last] - total[start]) + spelling[self.data[last], _EDGE]


def tokens(rolling: Rolling, texts: pa.Array) -> Iterator[Tokens]:
    for first, data, offsets in pieces(pc.utf8_lower(texts)):
        start, end, owner = words(data, offsets, WORD_BYTES)
        yield Tokens(first, len(offsets) - 1, word_hashes(rolling, data, start, end) if len(start) else np.zeros(0, np.uint64), owner, data, start, end)


def counts(docs: DataFrame) -> DataFrame:
    """(h, n): how often each word is there, by hash."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            parts = [np.unique(codes, return_counts=True) for codes in (t.codes for t in tokens(rolling, batch.column(0)))]
            if parts:
                values, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([p[1] for p in parts]), len(values)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], ["h", "n"])

    return docs.select(column(docs, "text")).mapInArrow(counted, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def started(docs: DataFrame) -> Model:
    """The model of single words."""
    found = cut(counts(docs))
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    own = found.where(F.col("n") >= max(LEAST, math.isqrt(total) // OWN)).toArrow()
    others = total - int(np.sum(own["n"].to_numpy()))
    codes, n = own["h"].to_numpy().view(np.uint64), own["n"].to_numpy()
    order = np.lexsort((codes, -n))
    codes, n = codes[order], n[order].astype(np.float64)
    unknown = int(np.searchsorted(-n, -float(others)))
    where, above = layout(len(codes) + 1)
    weight = np.full((CLASSES + len(above)) * WIDTH, _NOTHING)
    weight[where] = np.insert(n, unknown, others + 0.5)
    by = weight.reshape(-1, WIDTH)
    end = len(above)
    while end:  # nodes come after those that lead to them: here all after the one that leads to the last
        low = max(0, int(above[end - 1]) // WIDTH - CLASSES + 1)
        weight[above[low:end]] = by[CLASSES + low : CLASSES + end].sum(1)
        end = low
    top = by[:CLASSES].sum(1)
    share, within = np.log(top / top.sum()), np.log(by / by.sum(1, keepdims=True))
    sorted_, rows = np.argsort(codes), ROOT * math.isqrt(total)
    class_rows = np.zeros((max(CLASS_ROWS, rows // 2), CLASSES), np.float32)
    word_rows = np.zeros((max(WORD_ROWS, rows), WIDTH), np.float32)
    output = np.delete(where, unknown)[sorted_].astype(np.int32)
    return Model(codes[sorted_], output, share.astype(np.float32), within.astype(np.float32), class_rows, word_rows, above, int(where[unknown]), total)


def learn(model: Model, rolling: Rolling, texts: Iterator[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient steps over texts in place; how often each row of the two tables was used, and the pairs of bytes in the
    words without an output."""
    used_c, used_w, pairs = np.zeros(len(model.class_rows)), np.zeros(len(model.word_rows)), np.zeros((_EDGE + 1, _EDGE + 1))
    for batch in texts:
        for t in tokens(rolling, batch):
            target, features = model.outputs(t.codes), contexts(t.codes, t.owner)
            strange = np.flatnonzero(target == model.unknown)
            if len(strange):
                pairs += t.pairs(strange)
            for i in range(0, len(target), BATCH):
                some = features[:, i : i + BATCH]
                top, line, node, place = model.walk(target[i : i + BATCH])
                (a, of_class), (b, of_place) = class_scores(model, some), place_scores(model, some[:, line], node)
                of_class, of_place = softmax(of_class, True), softmax(of_place, True)
                of_class[np.arange(len(top)), top] -= 1
                of_place[np.arange(len(node)), place] -= 1
                step(model.class_rows, used_c, a, of_class)
                step(model.word_rows, used_w, b, of_place)
    return used_c, used_w, pairs


def rounds(total: int, tasks: int) -> int:
    return max(ROUNDS, -(-total // (tasks * WORDS)))


def trained(docs: DataFrame) -> Model:
    spark = docs.sparkSession
    model = started(docs)
    tasks = max(1, spark.sparkContext.defaultParallelism)
    parts = rounds(model.total, tasks)
    texts = docs.select(column(docs, "text").alias("text"), F.pmod(F.xxhash64(column(docs, "doc_id")), F.lit(parts)).alias("part"))
    pairs = np.zeros((_EDGE + 1, _EDGE + 1))
    for part in range(parts):
        sent = spark.sparkContext.broadcast(model)

        def worked(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            own = replace(own, class_rows=own.class_rows.copy(), word_rows=own.word_rows.copy())
            *used, strange = learn(own, Rolling(), (b.column(0) for b in batches))
            if not used[0].any():
                return
            yield pa.RecordBatch.from_arrays([pa.array([BLOCKS], pa.int32()), pa.array([strange.astype(np.float32).tobytes()], pa.binary())], ["block", "sums"])
            for b in range(BLOCKS):
                packed = []
                for rows, n in zip((own.class_rows, own.word_rows), used):
                    cut_ = slice(b * len(rows) // BLOCKS, (b + 1) * len(rows) // BLOCKS)
                    packed += [(rows[cut_] * n[cut_, None]).astype(np.float32).tobytes(), n[cut_].astype(np.float32).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([b"".join(packed)], pa.binary())], ["block", "sums"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for b, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                    sums = np.frombuffer(sums.as_buffer(), np.float32)
                    total[b] = total[b] + sums if b in total else sums.copy()
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["block", "sums"])

        own = texts.where(F.col("part") == part).select("text").coalesce(tasks)
        sums = own.mapInArrow(worked, "block int, sums binary").repartition("block").mapInArrow(added, "block int, sums binary").toArrow()
        for b, packed in zip(sums["block"].to_pylist(), sums["sums"]):
            packed, at = np.frombuffer(packed.as_buffer(), np.float32), 0
            if b == BLOCKS:
                pairs += packed.reshape(pairs.shape)
                continue
            for rows in (model.class_rows, model.word_rows):
                low, high = b * len(rows) // BLOCKS, (b + 1) * len(rows) // BLOCKS
                size = (high - low) * rows.shape[1]
                w, n = packed[at : at + size].reshape(high - low, -1), packed[at + size : at + size + high - low]
                at += size + high - low
                rows[low:high] = np.where(n[:, None] > 0, w / np.maximum(n, 1)[:, None], rows[low:high])
        sent.unpersist()
    model.spelling = letters(pairs)
    return model


def bits(model: Model, found: Tokens) -> np.ndarray:
    """Of each word -log2 of its probability."""
    out = np.zeros(len(found.codes))
    target, features = model.outputs(found.codes), contexts(found.codes, found.owner)
    for i in range(0, len(target), BATCH):
        some = features[:, i : i + BATCH]
        top, line, node, place = model.walk(target[i : i + BATCH])
        (_, of_class), (_, of_place) = class_scores(model, some), place_scores(model, some[:, line], node)
        out[i : i + BATCH] = np.bincount(line, cost(of_place, place), len(top)) + cost(of_class, top)
    strange = np.flatnonzero(target == model.unknown)
    if len(strange):
        out[strange] += found.spelt(model.spelling, strange)
    return out


def scored(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, words, bits and bits_per_word of every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model or trained(docs))

    @F.arrow_udf(T.StructType([T.StructField("words", T.LongType()), T.StructField("bits", T.DoubleType())]))
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rolling = Rolling()
        for batch in batches:
            n, total = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for t in tokens(rolling, batch):
                n[t.first : t.first + t.many] = np.bincount(t.owner, minlength=t.many)
                total[t.first : t.first + t.many] = np.bincount(t.owner, bits(sent.value, t), t.many)
            yield pa.StructArray.from_arrays([pa.array(n), pa.array(np.round(total, 3))], ["words", "bits"])

    out = docs.select(column(docs, "doc_id").alias("doc_id"), score.asNondeterministic()(column(docs, "text")).alias("s"))
    words_, bits_ = F.col("s")["words"], F.col("s")["bits"]
    return out.select("doc_id", words_.alias("words"), bits_.alias("bits"), F.when(words_ > 0, F.round(bits_ / words_, 5)).alias("bits_per_word"))
