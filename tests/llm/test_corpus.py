"""Quality, sharding and mixing against their SQL; near-duplicates and leaks against brute force; hard inputs."""

import os
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickframe.llm import decontam, mixing, quality, shard, simhash
from tickframe.llm.text import INK_BYTES, WORD_BYTES, Rolling, pieces, word_hashes, words

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
VOCABULARY = [a + b for a in "ba ce di fo gu ka le mi no pu ra se ti vo zu".split() for b in "n r st ll x".split()]


def prose(rng, n, vocabulary=VOCABULARY):
    return " ".join(rng.choice(vocabulary) + rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls in every column, empty, blank, very long and repeated texts, ties, and clashing extra columns."""
    rng = random.Random(5)
    long_ = prose(rng, 40_000)
    same = prose(rng, 60)
    rows = [
        (None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t\n ", "en", None, 4), (4, "é", None, "a", 1), (None, same, "en", "a", 5), (None, same, "en", "a", 5),
        (5, same, "en", "b", 5), (5, same, "en", "b", 5), (6, long_, "en", "b", 9), (7, "x" * 300_000, "en", "b", 9), (8, "word " * 500, "en", "a", 9), (9, "...", "en", "a", 3), (10, "\u0000 a \u0000", "en", "a", 3),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    extra = ["repetition", "Shard", "shard_key", "leaks", "copies", "rank", "s", "x", "e", "text_h", "copy_id", "again", "root", "key", "extra", "mass", "a.b", "part", "bucket"]
    return df.withColumns({c: F.lit(i) for i, c in enumerate(extra)})


@pytest.fixture(scope="module")
def docs(spark):
    """300 texts with near copies of up to 3 % of words, exact copies, and 3 items planted with edits."""
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(40, 200)) for _ in range(200)]
    for i in range(60):
        w = texts[i].split()
        for _ in range(max(1, len(w) * 3 // 100)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        texts.append(" ".join(w))
    texts += texts[:40]
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)], SCHEMA).cache()


def by_sql(sql, documents):
    con = duckdb.connect()
    con.register("documents", documents.toArrow())
    return con.execute(sql)


def agrees(df, sql, documents):
    found = by_sql(sql, documents)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    place = [names.index(c) for c in df.columns]
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in place)) for r in found.fetchall())


@pytest.mark.parametrize("table", [INK_BYTES, WORD_BYTES])
def test_words_and_hashes(table):
    texts = ["", "a b", None, "ab", "b", " Ünï côde! ", "a\nb", "x" * 50]
    data, offsets = next((d, o) for _, d, o in pieces(pa.array(texts)))
    start, end, owner = words(data, offsets, table)
    found = [(int(o), bytes(data[s:e]).decode()) for s, e, o in zip(start, end, owner)]
    plain = [(i, w) for i, t in enumerate(texts) for w in ("".join(c if table[c.encode()[0]] else " " for c in t or "")).split(" ") if w]
    assert found == plain
    codes = word_hashes(Rolling(), data, start, end)
    assert len({w for _, w in found}) == len(set(codes.tolist()))


def test_small_pieces_cover_everything():
    texts = pa.array(["abc", None, "", "defgh", "i"]).slice(1)
    got = [(i, bytes(d[o[k] : o[k + 1]])) for i, d, o in pieces(texts, 2) for k in range(len(o) - 1)]
    assert [t for _, t in got] == [b"", b"", b"defgh", b"i"]


def test_repetition_agrees_with_sql(spark):
    rng = random.Random(3)
    texts = ["", "a b c a b c a b c", "one line\none line\nother\n one  line ", "w " * 30, "é è é è é è", None]
    for _ in range(30):
        texts.append("\n".join(" ".join(rng.choice("a b c dd".split()) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 8))))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    agrees(quality.assess(df), quality.oracle(), df)


def test_repetition_keeps_prose_and_rejects_loops(spark, docs):
    assert quality.reject(docs).count() == docs.count()
    bad = spark.createDataFrame([(1, "again and again " * 40, "", "", 0), (2, "\n".join(["the same line of text"] * 9), "", "", 0)], SCHEMA)
    assert quality.reject(bad).count() == 0


@pytest.mark.parametrize("target, least", [(1 << 40, 1), (20_000, 1), (3_000, 1), (500, 1), (shard.TARGET, shard.SHARDS)])
def test_sharding_agrees_with_sql(docs, target, least):
    out, count = shard.assign(docs, target, least=least)
    agrees(out, shard.oracle(target, least), docs)
    target = shard.aim(docs.agg(F.sum(F.octet_length("text"))).first()[0], target, least)
    assert count >= 0.8 * least
    sizes = [r.b for r in out.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b")).collect()]
    assert len(sizes) <= count and max(sizes) <= max(1.25 * target, target + 2000)
    joined, again = shard.assign(docs, target, least=least, broadcast=-1)
    assert again == count and sorted(map(tuple, joined.select("doc_id", "shard").collect())) == sorted(map(tuple, out.select("doc_id", "shard").collect()))


def test_shards_are_partitions_in_key_order(docs):
    out = shard.sharded(docs, 5_000)
    parts = out.select("shard", F.spark_partition_id().alias("p")).distinct().collect()
    assert len({r.p for r in parts}) == len(parts) > 3
    keyed = out.select(shard.sort_key(docs).alias("k"), "shard").groupBy("shard").agg(F.min("k").alias("a"), F.max("k").alias("b")).orderBy("shard").collect()
    assert all(x.b < y.a for x, y in zip(keyed, keyed[1:]))


def test_many_shards_share_partitions_in_order(docs, tmp_path):
    out = shard.sharded(docs, 100, least=1)
    parts = out.select("shard", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i")).orderBy("i").collect()
    count = out.agg(F.max("shard")).first()[0] + 1
    assert len({(r.shard, r.p) for r in parts}) == len({r.shard for r in parts}) == count > shard.SPREAD**2
    assert len({r.p for r in parts}) < count and [r.shard for r in parts] == sorted(r.shard for r in parts)


def test_one_huge_key_does_not_widen_the_others(spark):
    df = spark.createDataFrame([(i, "x" * 50, "en", "s" * (2_000_000 if i == 3 else 1), 0) for i in range(2000)], SCHEMA)
    assert shard.assign(df, 1000, least=1)[0].agg(F.count_distinct("shard")).first()[0] > 50


def test_mixing_agrees_with_sql_and_has_its_size(docs):
    out = mixing.allocate(docs)
    agrees(out, mixing.oracle(), docs)
    assert out.agg(F.sum("copies")).first()[0] == docs.count()
    chosen = mixing.copied(docs, {"s0": 3, "s1": 1}, 250)[0].groupBy("source").agg(F.sum("copies").alias("n"))
    assert {r.source: r.n for r in chosen.collect()} == {"s0": 188, "s1": 62, "s2": 0}
    assert mixing.mixed(docs, {"s0": 3, "s1": 1}, 250).count() == 250


def test_pareto_inclusion_follows_the_shares(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, "x" * (3 if i % 2 else 200), "en", "s", 0) for i in range(400)], SCHEMA)
    shares = {r.x: r.part / r.mass for r in mixing.quotas(df, total=100).collect()}
    hits = {2: 0, 8: 0}
    for trial in range(8):
        for r in mixing.copied(df, total=100, seed=f"t{trial}{rng.random()}")[0].where("copies > 0").select(F.length("text").alias("n")).collect():
            hits[2 if r.n == 3 else 8] += 1
    assert hits[2] / (8 * 200) == pytest.approx(shares[2], abs=0.04) and hits[8] / (8 * 200) == pytest.approx(shares[8], abs=0.04)


def brute_groups(df):
    rows = df.select("doc_id", simhash.signed("text").alias("sig")).where("sig is not null").collect()
    ids, sigs = [r.doc_id for r in rows], np.frombuffer(b"".join(r.sig for r in rows), np.uint8).reshape(-1, 32).view(np.uint64)
    near = np.bitwise_count(sigs[:, None, :] ^ sigs[None]).sum(2) <= simhash.NEAR
    return ids, near


def test_near_duplicates_against_brute_force(docs):
    ids, near = brute_groups(docs)
    group = {r.doc_id: r.group_id for r in simhash.groups(docs).collect()}
    pairs = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(near, 1)))]
    assert len(pairs) >= 100
    found = sum(group.get(a, -1) == group.get(b, -2) for a, b in pairs) / len(pairs)
    assert found >= 0.9
    assert all(near[ids.index(a)].sum() > 1 for a in group)  # nobody without a near copy is in a group
    for i in range(60):
        assert group[i] == group[200 + i]


def test_one_of_each_group_stays(docs):
    groups = simhash.groups(docs).collect()
    assert sum(r.stays for r in groups) == len({r.group_id for r in groups})
    left = {r.doc_id for r in simhash.thinned(docs).select("doc_id").collect()}
    assert left == {r.doc_id for r in docs.collect()} - {r.doc_id for r in groups if not r.stays}


@pytest.mark.parametrize("middle", [32, 2048])
def test_forest_depth_and_full_nodes(middle, monkeypatch):
    monkeypatch.setattr(simhash, "MIDDLE_NODE", middle)
    assert simhash.tries(8) < simhash.tries(16) and 1 - (1 - simhash.agree(12)) ** simhash.tries(12) >= simhash.RECALL
    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, (3, 32), dtype=np.uint8)
    sigs = []
    for b in np.repeat(base, 120, axis=0):  # three clusters in one node, larger than what is compared pairwise
        flips = rng.choice(256, 10, replace=False)
        bits = np.unpackbits(b)
        bits[flips] ^= 1
        sigs.append(np.packbits(bits))
    sigs = np.array(sigs)[rng.permutation(360)]
    for heads in (np.array([0]), np.arange(0, 360, 20)):
        member, first = simhash.spanning(sigs, heads)
        label = np.arange(360)
        label[member] = first
        near = np.bitwise_count(sigs.view(np.uint64)[:, None] ^ sigs.view(np.uint64)[None]).sum(2) <= simhash.NEAR
        node = np.searchsorted(heads, np.arange(360), "right")
        for i, j in zip(*np.nonzero(near & (node[:, None] == node[None]))):
            assert label[i] == label[j]


def flipped(rng, sig, n):
    bits = np.unpackbits(sig)
    bits[rng.choice(256, n, replace=False)] ^= 1
    return np.packbits(bits)


def test_signatures_against_plain_votes():
    rng = random.Random(2)
    texts = ["", "one", "...", *(prose(rng, n) for n in (3, 40, 700))]
    data, offsets = next((d, o) for _, d, o in pieces(pa.array(texts)))
    which, rows = simhash.signatures(Rolling(), data, offsets)
    assert which.tolist() == [1, 3, 4, 5]
    for i, row in zip(which.tolist(), rows):
        d, o = next((d, o) for _, d, o in pieces(pa.array([texts[i]])))
        start, end, _ = words(d, o, WORD_BYTES)
        codes = sorted(set(word_hashes(Rolling(), d, start, end).tolist()))
        votes = [0] * 256
        for c in codes:
            for p, plane in enumerate(simhash._PLANES):
                value = int(simhash.mix(np.array([c + plane & (1 << 64) - 1], np.uint64))[0]).to_bytes(8, "little")
                for b in range(64):
                    votes[p * 64 + b] += 1 if value[b >> 3] >> (b & 7) & 1 else -1
        assert np.unpackbits(row).tolist() == [int(v > 0) for v in votes]


def test_depth_follows_density(spark, monkeypatch):
    """Dense places, in which most aren't near, are searched deeper; pairs are found there, elsewhere and between."""
    monkeypatch.setattr(simhash, "FULL", 48)
    rng = np.random.default_rng(8)
    base = rng.integers(0, 256, 32, dtype=np.uint8)
    sigs = [rng.integers(0, 256, 32, dtype=np.uint8) for _ in range(1500)] + [flipped(rng, base, int(n)) for n in rng.integers(24, 70, 2500)]
    sigs += [flipped(rng, sigs[i], int(rng.integers(1, 34))) for i in rng.choice(4000, 900, replace=False)]
    sigs = np.unique(np.array(sigs), axis=0)
    df = spark.createDataFrame([(s.tobytes(),) for s in sigs], "sig binary").repartition(3)
    plan = simhash.planned(df)
    level = plan.levels(sigs)
    assert len(plan.depths) > 1 and 0 < (level > 0).mean() < 1 and [simhash.tries(k) for k in plan.depths] == plan.tries
    root = {bytes(r.node): bytes(r.root) for r in simhash.components(simhash.near_pairs(df, plan)).collect()}
    lines = sigs.view(np.uint64)
    near = np.triu(np.bitwise_count(lines[:, None] ^ lines[None]).sum(2) <= simhash.NEAR, 1)
    for some in (near, near & (level[:, None] > 0) & (level[None] > 0), near & (level[:, None] != level[None])):
        pairs = np.argwhere(some)
        found = [root.get(sigs[a].tobytes(), 0) == root.get(sigs[b].tobytes(), 1) for a, b in pairs.tolist()]
        assert len(pairs) > 20 and np.mean(found) >= 0.9
    assert all(near[i].any() or near[:, i].any() for i in range(len(sigs)) if sigs[i].tobytes() in root)


def test_nodes_with_guests(monkeypatch):
    """Pairs of which one is at home are found in small and in large nodes."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 256, (6, 32), dtype=np.uint8)
    for n, middle in ((20, simhash.MIDDLE_NODE), (200, simhash.MIDDLE_NODE), (200, 32)):
        monkeypatch.setattr(simhash, "MIDDLE_NODE", middle)
        sigs = np.array([flipped(rng, base[i % 6], int(rng.integers(0, 30))) for i in range(n)])
        home = rng.random(n) < 0.3
        member, first = simhash.spanning(sigs, np.array([0]), home)
        label = np.arange(n)
        label[member] = first
        near = np.bitwise_count(sigs.view(np.uint64)[:, None] ^ sigs.view(np.uint64)[None]).sum(2) <= simhash.NEAR
        for i, j in np.argwhere(near & (home[:, None] | home[None])).tolist():
            assert label[i] == label[j]


def test_the_row_that_stays_does_not_hang_on_the_order(spark):
    rows = [(1, "the very same words here", "en", s, 0) for s in "dcba"] + [(2, "the very same words here", "en", "z", 0)]
    kept = [simhash.thinned(spark.createDataFrame(r, SCHEMA).repartition(3)).collect() for r in (rows, rows[::-1])]
    assert kept[0] == kept[1] and kept[0][0].source == "a" and len(kept[0]) == 1


def test_columns_that_differ_in_case_only(spark):
    df = spark.createDataFrame([(i, "some text of words", "en", "s", 0) for i in range(3)], SCHEMA).select("*", F.lit("other").alias("TEXT"), F.lit(7).alias("Doc_Id"))
    assert [r.doc_id for r in quality.assess(df).collect()] == [0, 1, 2] and quality.reject(df).columns == df.columns
    assert len(simhash.thinned(df).collect()) == 1 and mixing.mixed(df).columns == df.columns and mixing.allocate(df).count() == 3
    assert shard.assign(df)[0].columns == [*df.columns, "shard"] and len(shard.sharded(df).collect()) == 3
    bench = spark.createDataFrame([(1, "text of words")], "item_id bigint, text string")
    assert decontam.leaks(df, bench).count() == 3 and decontam.clean(df, bench).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(f"{i:03d}", f"{i + 1:03d}") for i in range(40)] + [("x", f"y{i}") for i in range(9)] + [("q", "q")]
    got = {bytes(r.node).decode(): bytes(r.root).decode() for r in simhash.components(spark.createDataFrame(edges, "a string, b string").select(F.col("a").cast("binary").alias("a"), F.col("b").cast("binary").alias("b"))).collect()}
    assert {got[f"{i:03d}"] for i in range(41)} == {"000"} and {got[f"y{i}"] for i in range(9)} == {"x"} and "q" not in got


def edited(rng, w, k):
    w = list(w)
    for _ in range(k):
        at = rng.randrange(len(w))
        match rng.randrange(3):
            case 0:
                w[at] = f"new{rng.randrange(99)}"
            case 1:
                del w[at]
            case _:
                w.insert(at, f"add{rng.randrange(99)}")
    return w


def brute_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_against_brute_force(spark):
    rng = random.Random(11)
    items = [prose(rng, n) for n in (1, 3, 5, 8, 15, 20, 33, 60)]
    texts = []
    for i in range(90):
        w = prose(rng, 70).split()
        if i % 3:
            item = items[i % 8].split()
            w[30:30] = edited(rng, item, rng.randint(0, decontam.budget(len(item)) + 2))
        texts.append(" ".join(x.title() if rng.random() < 0.2 else x + rng.choice(["", ".", ",\n"]) for x in w))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    benchmark = spark.createDataFrame([*enumerate(items), (98, "too few words"), (99, None), (None, "")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.leaks(df, benchmark).collect()}
    import re

    norm = [re.findall(r"[^\W_]+", t.lower()) for t in texts]
    expected = {(i, j): d for i, w in enumerate(norm) for j, item in enumerate(items) if (d := brute_distance(item.split(), w)) <= decontam.budget(len(item.split()))}
    assert len(expected) > 30
    assert set(got) <= set(expected) and all(got[k] == expected[k] for k in got)
    assert len(got) / len(expected) >= 0.9
    assert {r.doc_id for r in decontam.clean(df, benchmark).collect()} == set(range(90)) - {i for i, _ in got}


def test_short_items_and_scripts_without_blanks(spark):
    han = "深度学习模型在大规模语料上训练之后可以回答许多问题"
    texts = ["he wrote that time flies like an arrow does", "time flies like a bird", "前言。" + han + "。结尾", han[:8], "前言" + han[:12] + "的" + han[13:] + "完"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    benchmark = spark.createDataFrame([(1, "Time flies like an arrow"), (2, han), (3, "arrow"), (4, "...")], "item_id bigint, text string")
    assert sorted((r.doc_id, r.item_id, r.distance) for r in decontam.leaks(df, benchmark).collect()) == [(0, 1, 0), (0, 3, 0), (2, 2, 0), (4, 2, 1)]


def test_a_large_benchmark_goes_in_blocks(docs, spark, monkeypatch):
    some = docs.limit(5).select(F.col("doc_id").alias("item_id"), "text")
    whole = sorted(map(tuple, decontam.leaks(docs, some).collect()))
    monkeypatch.setattr(decontam, "BLOCK", 500)
    assert len(list(decontam.blocks(some))) > 2
    assert sorted(map(tuple, decontam.leaks(docs, some).collect())) == whole and whole
    assert decontam.clean(docs, some).count() == docs.count() - len({r[0] for r in whole})


def test_hard_inputs(spark, hard):
    n, benchmark = hard.count(), spark.createDataFrame([(1, "nothing of this is anywhere in these texts")], "item_id bigint, text string")
    assert quality.assess(hard).count() == n
    kept = quality.reject(hard)
    assert kept.columns == hard.columns and kept.count() == n - 1  # the loop of one word goes
    left = simhash.thinned(hard)
    assert left.columns == hard.columns
    # The four rows of one text leave one; rows without words stay.
    assert left.count() == n - 3 and left.where("doc_id = 5").count() == 1 and left.where("text is null").count() == 2
    clean = decontam.clean(hard, benchmark)
    assert clean.columns == hard.columns and clean.count() == n and decontam.leaks(hard, benchmark).count() == 0
    mixed = mixing.mixed(hard)
    assert mixed.columns == hard.columns and mixed.count() == n
    out = shard.sharded(hard, 100_000)
    assert out.columns[:-1] == hard.columns and out.columns[-1] == "shard_" and out.count() == n


def test_empty_tables(spark, hard):
    none, benchmark = hard.limit(0), spark.createDataFrame([], "item_id bigint, text string")
    for f in (quality.reject, quality.assess, simhash.thinned, simhash.groups, lambda d: decontam.clean(d, benchmark), lambda d: decontam.leaks(d, benchmark), mixing.mixed, mixing.allocate, shard.sharded):
        assert f(none).count() == 0
    assert decontam.clean(hard, benchmark).count() == hard.count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, stage(spark, at, DATA).cache()
        assert at.columns[:5] == docs.columns
        if name == "quality rules":
            keep = {r.doc_id for r in quality.assess(before).where("keep").collect()}
            assert {r.doc_id for r in at.collect()} == keep
        if name == "near duplicates":
            ids, near = brute_groups(at)
            assert len(ids) and near.sum() == len(ids)  # no near pair is left
        if name == "benchmark decontamination":
            leaked = {r.doc_id for r in decontam.leaks(before, benchmark).collect()}
            assert {r.doc_id for r in at.collect()} == {r.doc_id for r in before.collect()} - leaked
        if name == "mixing":
            agrees(at.groupBy("doc_id").count().select("doc_id", F.col("count").alias("copies")), f"select doc_id, copies from ({mixing.oracle()}) where copies > 0", before)
    assert at.columns[-1] == "shard"
    assert corpus_pipeline.run(spark, DATA).count() == at.count()
