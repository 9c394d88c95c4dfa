"""Near-duplicates by SimHash and an LSH forest.

A text's signature has `BITS` bits: of its distinct words (lower case, letters and digits only) each votes
with its own 256-bit hash, and the majority decides each bit. Two texts are near if their signatures differ
in `NEAR` bits at most; groups are the connected parts of that relation.

The forest has several tries, each over another permutation of the bits. Near signatures share a prefix of
depth k in a trie with the probability that k bits drawn at random all agree, so a depth asks for so many
tries until their recall of pairs at the full distance `NEAR` reaches `RECALL`. The nodes of each depth, up to what the number of signatures
can fill, are counted over all of them; from the deepest prefixes the search climbs to shorter ones as long
as fewer tries and the candidates in fuller nodes cost less together. That is the forest's depth where it is
sparse. Below a node of more than `FULL` signatures, children that cost less with the tries of their own depth are
searched at that depth, and so on down: each signature has the depth of its own neighbourhood. Tries are shared:
those of a depth are the first of the next one's, and a signature stands in the nodes of its own depth and of all shorter ones.
There, each signature at home in a node is compared with everything below it, so that of two signatures of different depths
the one in the sparser place finds the other, with the recall of its own depth. Nodes are compared whole, whatever their
size; a node hands on a spanning forest of its near pairs instead of all of them. The signatures are verified in full.

Null texts and texts without a word have no signature, belong to no group and stay. Equal rows are near
copies like any others: one stays. Of a group the row with the smallest doc_id stays (null ids are larger than
others; then by text hash; of rows alike in both, the one whose columns as JSON come first). Extra columns pass through. An empty table has no groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import WORD_BYTES, Rolling, column, cut, fresh, mix, pieces, same, word_hashes, words

BITS = 256
NEAR = 36
RECALL = 0.95
#: Signatures in a node above which its children may be searched deeper, and how many such children, those of the fullest
#: nodes first, are sent to the tasks. Both only move cost: any depth has its recall.
FULL = 512
DEEPER = 1 << 20
#: What handling a row of a trie costs, in comparisons of two signatures.
ROW_COST = 150
#: Up to these sizes all pairs of a node are compared at once, of many nodes together or of one; larger nodes are searched
#: part by part, as few comparisons are enough where many are near.
SMALL_NODE, MIDDLE_NODE = 32, 2048
_LANES = sum((((np.arange(256, dtype=np.uint64) >> np.uint64(i)) & np.uint64(1)) << np.uint64(8 * i)) for i in range(8))
_PLANES = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)


def signatures(rolling: Rolling, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts that have words, their signatures as rows of 32 bytes)."""
    start, end, owner = words(data, offsets, WORD_BYTES)
    if not len(start):
        return owner, np.zeros((0, BITS // 8), np.uint8)
    codes = word_hashes(rolling, data, start, end)
    salted = codes ^ mix(np.arange(1, len(offsets), dtype=np.uint64))[owner]
    order = np.argsort(salted)
    ranked = salted[order]
    order = np.sort(order[np.r_[True, ranked[1:] != ranked[:-1]]])
    codes, owner = codes[order], owner[order]
    heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    counts = np.diff(np.r_[heads, len(owner)])
    place = np.arange(len(owner)) - np.repeat(heads, counts)
    blocks = np.flatnonzero(place % 255 == 0)  # sums of 255 fit a byte
    of_text = np.searchsorted(blocks, heads)
    out = np.empty((len(heads), BITS), bool)
    for p, plane in enumerate(_PLANES):
        lanes = mix(codes + np.uint64(plane)).view(np.uint8).reshape(-1, 8)
        for b in range(8):
            sums = np.add.reduceat(_LANES[lanes[:, b]], blocks).view(np.uint8).reshape(-1, 8)
            votes = np.add.reduceat(sums.astype(np.int64), of_text, axis=0)
            out[:, p * 64 + b * 8 : p * 64 + b * 8 + 8] = 2 * votes > counts[:, None]
    return owner[heads], np.packbits(out, axis=1)


@F.arrow_udf(T.BinaryType())
def signed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    rolling = Rolling()
    for texts in batches:
        found = np.zeros((len(texts), BITS // 8), np.uint8)
        there = np.zeros(len(texts), bool)
        for first, data, offsets in pieces(pc.utf8_lower(texts)):
            which, rows = signatures(rolling, data, offsets)
            found[first + which], there[first + which] = rows, True
        yield pc.if_else(pa.array(there), binary(found), pa.scalar(None, pa.binary()))


signed = signed.asNondeterministic()  # else a filter on its result would run it twice


def agree(depth: int) -> float:
    """Probability that two signatures at the distance `NEAR` share a prefix of so many permuted bits."""
    return math.prod((BITS - NEAR - i) / (BITS - i) for i in range(depth))


def tries(depth: int) -> int:
    return math.ceil(math.log(1 - RECALL) / math.log(1 - agree(depth)))


def permuted(sigs: np.ndarray, trie: int, depth: int) -> np.ndarray:
    """Of each signature the first bits in the trie's order, as a number."""
    order = np.random.default_rng(977 + trie).permutation(BITS)[:depth]
    out = np.zeros(len(sigs), np.int64)
    for i in order:
        out = (out << 1) | ((sigs[:, i >> 3] >> np.uint8(7 - (i & 7))) & np.uint8(1))
    return out


def rows_of(column_: pa.Array) -> np.ndarray:
    if isinstance(column_, pa.ChunkedArray):
        column_ = column_.combine_chunks()
    if not len(column_):
        return np.zeros((0, BITS // 8), np.uint8)
    offsets = np.frombuffer(column_.buffers()[1], np.int32)[column_.offset : column_.offset + len(column_) + 1]
    return np.frombuffer(column_.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, BITS // 8)


def binary(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (BITS // 8)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


@dataclass
class Plan:
    """depths that signatures may have, shortest first, with the tries of each; deeper[i]: the prefixes of depth i in
    the first trie whose signatures go down to it from the depth before, sorted."""

    depths: list[int]
    tries: list[int]
    deeper: list[np.ndarray]

    def levels(self, sigs: np.ndarray) -> np.ndarray:
        """Of each signature the index of its depth."""
        out, deep = np.zeros(len(sigs), np.int64), permuted(sigs, 0, self.depths[-1])
        for i in range(1, len(self.depths)):
            here = np.flatnonzero(out == i - 1)
            prefix, known = deep[here] >> (self.depths[-1] - self.depths[i]), self.deeper[i]
            if not len(here) or not len(known):
                break
            out[here[known[np.minimum(np.searchsorted(known, prefix), len(known) - 1)] == prefix]] = i
        return out


def planned(nodes: DataFrame) -> Plan:
    """The depths for these signatures."""
    depths = list(range(8, nodes.count().bit_length() + 4, 2)) or [8]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deep = permuted(rows_of(batch.column(0)), 0, depths[-1])
            for k in depths:
                values, counts = np.unique(deep >> (depths[-1] - k), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), k, np.int32)), pa.array(values), pa.array(counts)], ["k", "p", "n"])

    counted = cut(nodes.mapInArrow(prefixes, "k int, p bigint, n bigint").groupBy("k", "p").agg(F.sum("n").alias("n")))
    fill = {r.k: float(r.pairs) / float(r.n) for r in counted.groupBy("k").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs"), F.sum("n").alias("n")).collect()}
    if not fill:
        return Plan(depths[:1], [tries(depths[0])], [np.zeros(0, np.int64)])
    at = len(depths) - 1
    cost = [tries(k) * (ROW_COST + fill[k]) for k in depths]
    while at and cost[at - 1] <= cost[at]:
        at -= 1
    many = F.create_map(*(F.lit(x) for k in depths for x in (k, tries(k))))
    full = counted.where((F.col("n") > FULL) & (F.col("k") >= depths[at])).select((F.col("k") + 2).alias("k"), F.col("p").alias("above"), F.col("n").alias("all"))
    child = counted.withColumn("above", F.shiftright("p", 2)).join(full, ["k", "above"])
    cheaper = many[F.col("k")] * (ROW_COST + F.col("n")) < many[F.col("k") - 2] * (ROW_COST + F.col("all"))
    found = child.where(cheaper).orderBy(F.col("all").desc(), "k", "p").limit(DEEPER).select("k", "p").toPandas()
    used = [k for k in depths[at:] if k == depths[at] or (found["k"] == k).any()]
    used = depths[at : at + len(used)]  # the depths go on without a gap, else nobody gets to them
    return Plan(used, [tries(k) for k in used], [np.sort(found["p"][found["k"] == k].to_numpy(np.int64)) for k in used])


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the signatures a, as rows of four numbers, are near any of b."""
    hit = np.zeros(len(a), bool)
    step = max(1, min(64, (1 << 22) // max(len(a), 1)))
    for i in range(0, len(b), step):
        open_ = np.flatnonzero(~hit)
        if not len(open_):
            break
        apart = np.bitwise_count(a[open_][:, None, :] ^ b[i : i + step][None]).sum(2, dtype=np.int64)
        hit[open_[(apart <= NEAR).any(1)]] = True
    return hit


def spanning(sigs: np.ndarray, heads: np.ndarray, home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(member, first member of its part) for the members of parts of near signatures within nodes that
    start at heads, first members left out. Pairs of which neither is at home in the node may be left out."""
    n = len(sigs)
    home = np.ones(n, bool) if home is None else home
    lines = np.ascontiguousarray(sigs).view(np.uint64)
    label = np.arange(n)
    node = np.zeros(n, np.int64)
    node[heads] = 1
    node = np.cumsum(node)
    ends = np.r_[heads[1:], n]
    sizes = ends - heads
    small = np.repeat(sizes <= SMALL_NODE, sizes)
    left, right = [], []
    for step in range(1, SMALL_NODE):
        i = np.flatnonzero((node[:-step] == node[step:]) & small[:-step] & (home[:-step] | home[step:])) if step < n else node[:0]
        if not len(i):
            if step >= SMALL_NODE or step >= n or not (node[:-step] == node[step:]).any():
                break
            continue
        close = np.bitwise_count(lines[i] ^ lines[i + step]).sum(1, dtype=np.int64) <= NEAR
        left.append(i[close])
        right.append(i[close] + step)
    columns = np.ascontiguousarray(lines.T)
    for h, e in zip(*(x[(sizes > SMALL_NODE) & (sizes <= MIDDLE_NODE)].tolist() for x in (heads, ends))):
        for i in range(h, e, 64):
            j = min(i + 64, e)
            apart = np.zeros((j - i, e - i), np.uint16)
            for c in columns:
                apart += np.bitwise_count(c[i:j, None] ^ c[None, i:e])
            x, y = np.nonzero(apart <= NEAR)
            some = (y > x) & (home[i + x] | home[i + y])
            left.append(i + x[some])
            right.append(i + y[some])
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        while len(a):
            least = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
            label = label[label]
            if np.array_equal(before, label):
                break
    for h, e in zip(heads[sizes > MIDDLE_NODE], ends[sizes > MIDDLE_NODE]):
        rest = np.arange(h, e)
        while home[rest].any():
            part = rest[np.argmax(home[rest])]
            front, rest = np.array([part]), rest[rest != part]
            while len(front) and len(rest):
                own = home[front]
                hit = near(lines[rest], lines[front[own]])
                other = np.flatnonzero(~hit & home[rest])
                hit[other] = near(lines[rest[other]], lines[front[~own]])
                front, rest = rest[hit], rest[~hit]
                label[front] = part
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


def near_pairs(nodes: DataFrame, plan: Plan) -> DataFrame:
    """(a, b): edges between near signatures, enough to connect whatever meets in a node of the forest."""
    sent = nodes.sparkSession.sparkContext.broadcast(plan)

    def planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            sigs = rows_of(batch.column(0))
            level = own.levels(sigs)
            for i, (depth, forest) in enumerate(zip(own.depths, own.tries)):
                here = np.flatnonzero(level >= i)
                if not len(here):
                    break
                some, column_, home = sigs[here], batch.column(0).take(pa.array(here)), pa.array(level[here] == i)
                for t in range(forest):
                    name = mix(permuted(some, t, depth).view(np.uint64) ^ mix(np.array([t << 8 | depth], np.uint64)))
                    yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), home, column_], ["node", "home", "sig"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(node: np.ndarray, home: np.ndarray, sigs: np.ndarray) -> pa.RecordBatch:
            heads = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            b, a = spanning(sigs, heads, home)
            return pa.RecordBatch.from_arrays([binary(sigs[a]), binary(sigs[b])], ["a", "b"])

        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy()
            waiting.append((node, batch.column(1).to_numpy(zero_copy_only=False), rows_of(batch.column(2))))
            size += len(node)
            if size < 1 << 16 or node[0] == node[-1] and waiting[0][0][0] == node[0]:
                continue
            node, home, sigs = (np.concatenate(x) for x in zip(*waiting))
            done = int(np.searchsorted(node, node[-1]))
            waiting, size = [(node[done:].copy(), home[done:].copy(), sigs[done:].copy())], 0
            if done:
                yield edges(node[:done], home[:done], sigs[:done])
        if waiting:
            yield edges(*(np.concatenate(x) for x in zip(*waiting)))

    forest_rows = nodes.mapInArrow(planted, "node bigint, home boolean, sig binary").repartition(F.col("node")).sortWithinPartitions("node", "sig")
    return forest_rows.mapInArrow(compared, "a binary, b binary").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b), roots too; root is the least node connected with it.
    Alternates large and small stars until nothing changes."""
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.count_distinct("a")).first())
        if now == state or not now[0]:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def members(docs: DataFrame) -> DataFrame:
    """(doc_id, h, root, n, first_id, first_h) for each row in a group of two or more; h is a hash of the text."""
    rows = cut(docs.select(column(docs, "doc_id").alias("doc_id"), F.xxhash64(column(docs, "text")).alias("h"), signed(column(docs, "text")).alias("sig")).where("sig is not null"))
    nodes = cut(rows.select("sig").distinct())
    roots = components(near_pairs(nodes, planned(nodes)))
    rooted = rows.join(roots, rows["sig"] == roots["node"], "left").select("doc_id", "h", F.coalesce("root", "sig").alias("root"))
    rooted = cut(rooted)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("first")
    groups = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n"), first).where("n > 1")
    groups = groups.select("root", "n", F.col("first")["doc_id"].alias("first_id"), F.col("first")["h"].alias("first_h"))
    return rooted.join(groups, "root").select("doc_id", "h", "root", "n", "first_id", "first_h")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, group_id (the doc_id that stays), group_size and stays, for each row that has near copies."""
    found = members(docs)
    turn = F.row_number().over(Window.partitionBy("root", "doc_id", "h").orderBy("h"))
    stays = same(F.col("doc_id"), F.col("first_id")) & (F.col("h") == F.col("first_h")) & (F.col("turn") == 1)
    return found.withColumn("turn", turn).select("doc_id", F.col("first_id").alias("group_id"), F.col("n").alias("group_size"), stays.alias("stays"))


def thinned(docs: DataFrame) -> DataFrame:
    """docs with one row of each group."""
    found = cut(members(docs).groupBy("doc_id", "h", "first_id", "first_h").agg(F.count(F.lit(1)).alias("n")))
    first = same(F.col("doc_id"), F.col("first_id")) & (F.col("h") == F.col("first_h"))
    id_, h, key = fresh(docs, "copy_id", "copy_h", "text_h")
    keyed = docs.withColumn(key, F.xxhash64(column(docs, "text")))
    on = same(column(docs, "doc_id"), F.col(id_)) & (F.col(key) == F.col(h))
    gone = found.where(~first | (F.col("n") > 1)).select(F.col("doc_id").alias(id_), F.col("h").alias(h))
    alone = keyed.join(gone, on, "left_anti").drop(key)
    tied = found.where(first & (F.col("n") > 1)).select(F.col("doc_id").alias(id_), F.col("h").alias(h))
    there = keyed.join(tied, on).drop(key)
    row = F.struct(*(c.alias(f"c{i}") for i, c in enumerate(column(docs, c) for c in docs.columns)))
    one = there.groupBy(id_, h).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return alone.union(one.select(*(F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns))))
