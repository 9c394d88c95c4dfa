"""Definitions, changes, schema evolution, the change log with replay and streams."""

import math

import pytest

from tickframe.operators import dml, engines
from tickframe.plans.predicate import Compare, Literal, Name
from tickframe.sources.catalog import CatalogError, ColumnSpec, Files, Store
from tickframe.streaming import changelog
from tickframe.types import Native, coerce, declared, native

CLICK = Compare("=", Name("sym"), Literal("A"))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def columns(*pairs):
    return [ColumnSpec(n, f"Nullable({t})") for n, t in pairs]


def test_definitions(spark, root):
    s = Store(spark, root)
    s.create("db.t", columns(("a", "Int64"), ("b", "String")))
    for bad in ([], columns(("a", "Int64"), ("A", "String")), columns((" ", "Int64"))):
        with pytest.raises(CatalogError):
            s.create("u", bad)
    with pytest.raises(CatalogError):
        s.create("db.t", columns(("a", "Int64")))
    with pytest.raises(CatalogError):
        s.drop("T")
    s.rename("db.t", "t")
    dml.insert(s, "t", dml.values(s, ["a", "b"], [[1, "x"]]))
    s.add_column("t", ColumnSpec("lot", "Nullable(Int64)", default="100"))
    s.rename_column("t", "LOT", "lots")
    s.set_default("t", "lots", "7")
    dml.insert(s, "t", dml.values(s, ["a"], [[2]]))
    assert rows(s.df("t")) == [(1, "x", 100), (2, None, 7)]
    s.drop_column("t", "b")
    with pytest.raises(CatalogError):
        s.rename_column("t", "a", "lots")
    assert rows(Store(spark, root).df("t")) == [(1, 100), (2, 7)]
    s.drop("t")
    assert "t" not in Store(spark, root).tables


def test_insert_makes_what_is_missing(spark, root):
    s = Store(spark, root)
    dml.insert(s, "t", dml.values(s, ["sym", "price"], [[None, 1], ["A", None]]))
    dml.insert(s, "t", dml.values(s, ["sym", "price", "sym"], [["old", 2, "B"]]))
    assert rows(s.df("t")) == [("A", None), ("B", 2), (None, 1)]
    dml.insert(s, "t", dml.values(s, ["sym", "size"], [["C", 2.5]]))
    assert s.df("t").columns == ["sym", "price", "size"]
    assert s.suspect("t") == {"sym", "price", "size"}
    with pytest.raises(TypeError, match="mismatch"):
        dml.insert(s, "t", dml.values(s, ["price"], [["text"]]))
    assert s.df("t").count() == 4


def test_updates_and_deletes(spark, root):
    s = Store(spark, root)
    assert dml.update(s, "none", {"a": 1}) == 0 and dml.delete(s, "none") == 0
    dml.insert(s, "t", dml.values(s, ["sym", "price"], [["A", 1], ["B", 2], [None, 3]]))
    assert dml.update(s, "t", {"price": 9.7, "tag": "new"}, CLICK) == 1
    assert rows(s.df("t")) == [("A", 9, "new"), ("B", 2, None), (None, 3, None)]
    assert dml.delete(s, "t", Compare("!=", Name("sym"), Literal("A"))) == 2
    assert dml.delete(s, "t", Compare("<", Name("tag"), Literal(5))) == 0  # an error keeps the row
    assert dml.delete(s, "t") == 1 and s.df("t").count() == 0


def test_readers_keep_their_snapshot_and_writers_do_not_overtake(spark, root):
    s = Store(spark, root)
    dml.insert(s, "t", dml.values(s, ["a"], [[1]]))
    before, other = s.df("t"), Store(spark, root)
    dml.delete(s, "t")
    assert before.count() == 1
    with pytest.raises(CatalogError, match="another writer"):
        dml.insert(other, "t", dml.values(other, ["a"], [[2]]))


def test_coercion(spark):
    df = spark.createDataFrame([(x,) for x in (1.9, -1.9, math.nan, 1e30, -1e30, math.inf, None)], "x double")
    got = [r.v for r in df.select(coerce(df.x, Native.F64, Native.I64).alias("v")).collect()]
    assert got == [1, -1, 0, (1 << 63) - 1, -(1 << 63), (1 << 63) - 1, None]
    for a, b in ((Native.STRING, Native.I64), (Native.BOOL, Native.I64), (Native.F64, Native.TIMESTAMP), (Native.I64, Native.STRING)):
        with pytest.raises(TypeError):
            coerce(df.x, a, b)
    assert native("Decimal(10,2)") is Native.F64 and native("UUID") is Native.STRING and native("UInt64") is Native.I64
    with pytest.raises(ValueError):
        native("Int8")
    assert declared("Map(String, Array(Int32))").spark.simpleString() == "map<string,array<int>>"
    assert declared("Enum8('a' = 1, 'b' = 2)").allowed == ("a", "b")


def test_upsert_takes_nulls_as_equal(spark):
    old = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    new = spark.createDataFrame([(None, "c"), (2, "d")], "k int, v string")
    assert rows(dml.upsert(old, new, ["k"])) == [(1, "a"), (2, "d"), (None, "c")]


def changes(log):
    log.create("t", columns(("sym", "String"), ("price", "Float64")))
    log.insert("t", ["sym", "price"], [["A", 1.5], ["B", 2.0]])
    log.insert("t", ["sym", "price"], [["C", None]])
    log.update("t", {"price": 3.0}, CLICK)
    log.delete("t", Compare("=", Name("sym"), Literal("B")))
    log.alter("t", "add", column="lot", type="Nullable(Int64)", default="5")
    log.alter("t", "rename", column="lot", to="lots")


EXPECTED = [("A", 3.0, 5), ("C", None, 5)]


def test_log_and_replay(spark, root):
    log = changelog.Logged(spark, root)
    changes(log)
    assert rows(log.store.df("t")) == EXPECTED
    with pytest.raises(CatalogError):
        log.create("t", columns(("a", "Int64")))
    with pytest.raises(TypeError):
        log.insert("t", ["price"], [["x"]])
    assert log.log.last == 7  # what failed was never logged
    fresh = Store(spark, root + "-copy")
    assert changelog.replay(log.log, fresh) == 7 and rows(fresh.df("t")) == EXPECTED
    log.checkpoint()
    again = changelog.Logged(spark, root)
    assert again.insert("t", ["sym"], [["D"]]) == 8 and again.store.df("t").count() == 3


def test_replay_stops_at_damage(spark, root):
    log = changelog.ChangeLog(spark, root)
    for i in range(4):
        log.append("insert", "t", {"columns": ["a"], "rows": [[i]]})
    Files(spark, root).cut(f"log/{3:020d}.json", b'{"lsn": 3, "op"')
    store = Store(spark, root)
    assert changelog.replay(log, store) == 2 and rows(store.df("t")) == [(0,), (1,)]
    assert changelog.ChangeLog(spark, root).trim() == 2
    reopened = changelog.Logged(spark, root)
    assert reopened.insert("t", ["a"], [[9]]) == 3 and rows(reopened.store.df("t")) == [(0,), (1,), (9,)]


def test_stream_applies_each_change_once(spark, root, tmp_path):
    log = changelog.Logged(spark, root)
    changes(log)
    target, checkpoint = str(tmp_path / "target"), str(tmp_path / "checkpoint")
    changelog.follow(spark, root, target, checkpoint, files_per_batch=3).awaitTermination()
    assert rows(Store(spark, target).df("t")) == EXPECTED
    log.insert("t", ["sym", "price"], [["D", 4.0]])
    changelog.follow(spark, root, target, checkpoint).awaitTermination()
    changelog.follow(spark, root, target, str(tmp_path / "lost")).awaitTermination()  # delivered again
    assert rows(Store(spark, target).df("t")) == [*EXPECTED, ("D", 4.0, None)] or rows(Store(spark, target).df("t")) == [*EXPECTED, ("D", 4.0, 5)]


def test_statements_are_sent_at_least_once(spark, root, tmp_path):
    log = changelog.Logged(spark, root)
    changes(log)
    log.insert("t", ["sym", "price"], [["it's \\ x", None]])
    log.rename("t", "u")
    log.drop("u")
    place, sent = str(tmp_path / "place"), []

    def send(text):
        if len(sent) == 3 and not stopped:
            stopped.append(1)
            raise RuntimeError("the line is down")
        sent.append(text)

    stopped = []
    with pytest.raises(Exception, match="the line is down"):
        changelog.deliver(spark, root, send, place).awaitTermination()
    changelog.deliver(spark, root, send, place).awaitTermination()
    changelog.deliver(spark, root, send, place).awaitTermination()
    assert sent == [
        "CREATE TABLE IF NOT EXISTS t (`sym` Nullable(String), `price` Nullable(Float64)) ENGINE = MergeTree ORDER BY tuple()", "INSERT INTO t (`sym`, `price`) VALUES ('A', 1.5), ('B', 2.0), ('C', NULL)",
        "ALTER TABLE t UPDATE `price` = 3.0 WHERE `sym` = 'A'", "ALTER TABLE t DELETE WHERE `sym` = 'B'", "ALTER TABLE t ADD COLUMN IF NOT EXISTS `lot` Nullable(Int64) DEFAULT 5", "ALTER TABLE t RENAME COLUMN `lot` TO `lots`",
        "INSERT INTO t (`sym`, `price`) VALUES ('it\\'s \\\\ x', NULL)", "RENAME TABLE t TO u", "DROP TABLE IF EXISTS u",
    ]


def test_merging_tables(spark, root):
    df = spark.createDataFrame([(1, "v1", 1), (1, "v2", 2), (2, "a", 1)], "id int, value string, version int")
    assert rows(engines.replacing(df, ["id"], ["version"])) == [(1, "v2", 2), (2, "a", 1)]
    signed = spark.createDataFrame([(1, 1, "open", 1), (1, -1, "open", 2), (2, 1, "keep", 3)], "id int, sign int, value string, at int")
    assert rows(engines.collapsing(signed, ["id"], "sign", "at")) == [(2, "keep", 3)]
    s = Store(spark, root)
    dml.insert(s, "t", dml.values(s, ["a"], [[1]]))
    waiting = engines.Buffer(s, "t", rows=3, seconds=1e9)
    waiting.insert(dml.values(s, ["a"], [[2], [3]]))
    assert rows(waiting.df()) == [(1,), (2,), (3,)] and s.df("t").count() == 1
    waiting.insert(dml.values(s, ["a"], [[4]]))
    assert s.df("t").count() == 4 and rows(waiting.df()) == [(1,), (2,), (3,), (4,)]
