"""Scripts of the dialect: what each kind of table and expression shows."""

import os

import pytest
from pyspark.errors import PySparkException

from tickframe.plans.parser import SqlError, statements
from tickframe.session import Session, single
from tickframe.sources import formats
from tickframe.sources.catalog import CatalogError


@pytest.fixture
def s(spark, root):
    return Session(spark, root)


def shown(s, script):
    return "".join(s.run(script))


def test_ticks_from_creation_to_a_grouped_view(s):
    assert shown(s, "DROP TABLE IF EXISTS q; CREATE TABLE q (venue String, sym String, ts_micros Int64, body String, n UInt64) ENGINE = MixedMergeTree ORDER BY (venue, sym); SELECT 'ok' FORMAT TabSeparated") == "ok\n"
    s.run("INSERT INTO q (venue, sym, ts, n) VALUES ('x', 'IBM', toDateTime64('2024-03-01 09:30:00', 6), 1), ('x', 'IBM', toDateTime64('2024-03-01 09:30:00', 6), 1), ('y', 'SAP', toDateTime64('2024-03-01 09:30:02.5', 6), 7);")
    assert shown(s, "SELECT venue, count() AS c, min(ts_micros) AS a FROM q GROUP BY venue ORDER BY venue FORMAT TSVWithNames") == "venue\tc\ta\nx\t2\t1709285400000000\ny\t1\t1709285402500000\n"
    assert single(s.query("SELECT body FROM q WHERE n = 7")) == ""


def test_defaults_and_nulls(s):
    s.run("CREATE TABLE d (k UInt64, name String, note Nullable(String), made DateTime DEFAULT now(), qty UInt32 DEFAULT 4, twice UInt64 MATERIALIZED qty * 2) ENGINE = MergeTree ORDER BY k")
    s.run("INSERT INTO d (k, name, note) VALUES (1, 'it''s', NULL); INSERT INTO d (k, qty) VALUES (2, 9)")
    assert shown(s, "SELECT k, name, note, qty, twice FROM d ORDER BY k") == "1\tit's\t\\N\t4\t8\n2\t\t\\N\t9\t18\n"
    assert single(s.query("SELECT count(made) FROM d")) == 2
    s.run("ALTER TABLE d ADD COLUMN extra String DEFAULT 'none'; ALTER TABLE d RENAME COLUMN extra TO more; ALTER TABLE d DROP COLUMN note")
    assert shown(s, "SELECT k, more FROM d ORDER BY k") == "1\tnone\n2\tnone\n"
    with pytest.raises(PySparkException, match="not a UInt32"):
        s.run("INSERT INTO d (k, qty) VALUES (3, -1)")
    assert single(s.query("SELECT count() FROM d")) == 2


def test_merging_engines(s):
    s.run("CREATE TABLE st (g String, c AggregateFunction(count), t AggregateFunction(sum, Float64)) ENGINE = AggregatingMergeTree ORDER BY g")
    s.run("INSERT INTO st (g, c, t) VALUES ('m', countState(), sumState(1.5)), ('m', countState(), sumState(2.0))")
    assert shown(s, "SELECT g, countMerge(c) AS n, sumMerge(t) AS total FROM st GROUP BY g") == "m\t2\t3.5\n"
    s.run("CREATE TABLE b (k Int64) ENGINE = MergeTree ORDER BY k; CREATE TABLE bb AS b ENGINE = Buffer(currentDatabase(), 'b', 16, 10, 1000, 10000, 100000, 1000000, 10000000); INSERT INTO bb (k) VALUES (1), (2)")
    assert shown(s, "SELECT k FROM bb ORDER BY k") == "1\n2\n" and single(s.query("SELECT count() FROM b")) == 0
    s.run("CREATE TABLE old (k Int64, at DateTime) ENGINE = MergeTree ORDER BY k TTL at + INTERVAL 30 DAY; INSERT INTO old (k, at) VALUES (1, now() - INTERVAL 3 DAY), (2, now() - INTERVAL 31 DAY)")
    assert shown(s, "SELECT k FROM old") == "1\n"
    s.run("CREATE TABLE r (k Int64, v String, ver Int64) ENGINE = ReplacingMergeTree(ver) ORDER BY k; INSERT INTO r (k, v, ver) VALUES (1, 'a', 1), (1, 'b', 2)")
    assert shown(s, "SELECT k, argMax(v, ver) AS v FROM r GROUP BY k") == "1\tb\n"


def test_nested_values(s):
    s.run("CREATE TABLE n (k Int64, xs Array(Int32), m Map(String, String), p Tuple(String, UInt32), items Nested(name String, qty UInt32)) ENGINE = MergeTree ORDER BY k")
    s.run("INSERT INTO n (k, xs, m, p, items.name, items.qty) VALUES (1, [3, 4], map('a', 'b'), ('z', 5), ['u', 'v'], [1, 2])")
    assert shown(s, "SELECT xs, m, p FROM n") == "[3,4]\t{'a':'b'}\t('z',5)\n"
    assert shown(s, "SELECT arrayJoin(xs) AS x, tupleElement(p, 2) AS y FROM n ORDER BY x") == "3\t5\n4\t5\n"
    assert shown(s, "SELECT arrayJoin(items.name) AS a, arrayJoin(items.qty) AS q FROM n ORDER BY a, q") == "u\t1\nu\t2\nv\t1\nv\t2\n"
    assert single(s.query("""SELECT JSONExtractString('{"a":"x"}', 'a') || JSONExtractString('{}', 'a')""")) == "x"


def test_checked_types(s):
    s.run("CREATE TABLE c (e Enum8('on' = 1, 'off' = 2), ip IPv4, id UUID, d Decimal(18, 4)) ENGINE = MergeTree ORDER BY e")
    s.run("INSERT INTO c (e, ip, id, d) VALUES ('on', '10.1.2.3', generateUUIDv4(), 7.12345)")
    assert shown(s, "SELECT e, ip, round(d, 2) AS r FROM c") == "on\t10.1.2.3\t7.12\n"
    for bad in ("('maybe', '10.1.2.3')", "('on', '10.1.2.333')"):
        with pytest.raises(PySparkException, match="not a"):
            s.run(f"INSERT INTO c (e, ip) VALUES {bad}")


def test_queries(s):
    s.run("CREATE TABLE a (k Int64, g String, ts DateTime64(6)) ENGINE = MergeTree PARTITION BY toYYYYMM(ts) ORDER BY k SAMPLE BY cityHash64(k)")
    s.run("INSERT INTO a (k, g, ts) VALUES (1, 'p', '2024-05-01 00:00:00'), (2, 'p', '2024-06-01 00:00:00'), (3, 'q', '2024-06-02 00:00:00')")
    assert shown(s, "SELECT toYYYYMM(ts) AS m, count() AS c FROM a GROUP BY m ORDER BY m") == "202405\t1\n202406\t2\n"
    assert shown(s, "SELECT k, sum(k) OVER (PARTITION BY g ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM a ORDER BY k") == "1\t1\n2\t3\n3\t3\n"
    assert shown(s, "SELECT k FROM a WHERE k IN (SELECT k FROM a WHERE g = 'q') UNION ALL SELECT 9 ORDER BY k") == "3\n9\n"
    assert 0 <= single(s.query("SELECT count() FROM a SAMPLE 0.5")) <= 3
    parts = os.listdir(f"{s.store.root}/{s.store.table('a').pieces[0]['path']}")
    assert {p for p in parts if p.startswith("__part")} == {"__part=202405", "__part=202406"}
    s.run("CREATE VIEW v AS SELECT g, count() AS c FROM a GROUP BY g")
    assert shown(s, "SELECT g, c FROM v ORDER BY g FORMAT JSONEachRow") == '{"g":"p","c":2}\n{"g":"q","c":1}\n'
    s.run("CREATE TABLE copy AS SELECT k, g FROM a WHERE k > 1; DROP VIEW v")
    assert shown(s, "SELECT l.k, r.g FROM a AS l LEFT JOIN copy AS r ON l.k = r.k ORDER BY l.k") == "1\t\\N\n2\tp\n3\tq\n"
    assert shown(s, "SELECT DISTINCT g FROM a ORDER BY g LIMIT 1 OFFSET 1") == "q\n"


def test_changes(s):
    s.run("CREATE TABLE m (k Int64, v Nullable(String)) ENGINE = MergeTree ORDER BY k; INSERT INTO m (k, v) VALUES (1, 'a'), (2, NULL), (3, 'c')")
    assert s.execute("UPDATE m SET v = 'z' WHERE v != 'a'") == 2  # null differs
    assert s.execute("ALTER TABLE m UPDATE v = concat(v, '!') WHERE k = 3") == 1
    assert s.execute("ALTER TABLE m DELETE WHERE k = 1") == 1
    assert shown(s, "SELECT k, v FROM m ORDER BY k") == "2\tz\n3\tz!\n"
    assert s.execute("DELETE FROM m WHERE k = 2") == 1 and s.execute("TRUNCATE TABLE m") == 1
    s.run("RENAME TABLE m TO mm; DROP TABLE mm")
    with pytest.raises(CatalogError):
        s.run("DROP TABLE mm")
    for bad in ("VACUUM x", "ALTER TABLE mm FREEZE", "INSERT INTO mm VALUES (1)", "CREATE TABLE x"):
        with pytest.raises((SqlError, CatalogError)):
            s.run(bad)


def test_strict_queries_and_pipelines_over_tables(s):
    s.run("CREATE TABLE e (sym String, v Float64) ENGINE = MergeTree ORDER BY sym; INSERT INTO e (sym, v) VALUES ('A', 1.0), ('B', 2.0)")
    assert [r.v for r in s.strict("SELECT v FROM e WHERE sym = 'A'").collect()] == [1.0]
    assert "raise_error" not in s.strict("SELECT v FROM e WHERE v > 1.5")._jdf.queryExecution().toString()
    assert [r.sym for r in s.pipeline("from e | filter v > 1.5 | select {sym}").collect()] == ["B"]
    assert s.scalar("SELECT max(v) FROM e") == 2.0
    with pytest.raises(ValueError):
        s.scalar("SELECT v FROM e")


def test_statements_split_outside_quotes_and_comments():
    assert statements("a ';' b; -- c; d\n e /* ; */ f;;") == ["a ';' b", "e  f"]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb", None), (2, "c", 2.5)], "k bigint, s string, v double")
    assert formats.tsv(df) == "1\ta\\tb\t\\N\n2\tc\t2.5\n"
    assert formats.json_rows(df, quote_64=True) == '{"k":"1","s":"a\\tb","v":null}\n{"k":"2","s":"c","v":2.5}\n'
    path = str(tmp_path / "f")
    formats.write_delimited(df, path, sep="|")
    back = formats.read_delimited(spark, path, "J F", ["k", "s", "v"])
    assert sorted(map(tuple, back.collect())) == [(1, None), (2, 2.5)]
    formats.write_json(df, str(tmp_path / "j"))
    assert formats.read_json(spark, str(tmp_path / "j"), df.schema).count() == 2
    assert formats.read_lines(spark, str(tmp_path / "j")).count() == 2
    assert formats.read_bytes(spark, str(tmp_path / "j")).where("length > 0").count() >= 1


def test_final_merges_on_read(s):
    s.run("CREATE TABLE r (k Int64, v String, ver Int64) ENGINE = ReplacingMergeTree(ver) ORDER BY k; INSERT INTO r (k, v, ver) VALUES (1, 'a', 1), (2, 'x', 1); INSERT INTO r (k, v, ver) VALUES (1, 'b', 2)")
    assert shown(s, "SELECT k, v FROM r FINAL ORDER BY k") == "1\tb\n2\tx\n" and single(s.query("SELECT count() FROM r")) == 3
    assert shown(s, "SELECT a.k, b.v FROM r AS a FINAL JOIN r AS b FINAL ON a.k = b.k WHERE a.v = 'b'") == "1\tb\n"
    s.run("CREATE TABLE c (k Int64, sign Int8, v String) ENGINE = CollapsingMergeTree(sign) ORDER BY k; INSERT INTO c (k, sign, v) VALUES (1, 1, 'open'), (1, -1, 'open'), (2, 1, 'keep')")
    assert shown(s, "SELECT k, sign, v FROM c FINAL") == "2\t1\tkeep\n"
    s.run("CREATE TABLE g (k String, t AggregateFunction(sum, Float64)) ENGINE = AggregatingMergeTree ORDER BY k; INSERT INTO g (k, t) VALUES ('m', sumState(1.5)), ('m', sumState(2.0))")
    assert shown(s, "SELECT k, t FROM g FINAL") == "m\t3.5\n"
    s.run("OPTIMIZE TABLE r FINAL; OPTIMIZE TABLE c")
    assert single(s.query("SELECT count() FROM r")) == 2 and single(s.query("SELECT count() FROM c")) == 3
    s.run("CREATE TABLE n (k Int64) ENGINE = ReplacingMergeTree ORDER BY k; INSERT INTO n (k) VALUES (1)")
    with pytest.raises(CatalogError):
        s.query("SELECT k FROM n FINAL")


@pytest.mark.parametrize("where, rows", [("toYYYYMM(ts) = 202406", 2), ("ts >= '2024-06-01 12:00:00'", 1), ("ts BETWEEN toDateTime64('2024-05-01 00:00:00', 6) AND toDateTime64('2024-05-31 00:00:00', 6) AND k > 0", 1), ("k = 2 AND ts < '2024-05-02 00:00:00'", 0)])
def test_partitions_are_pruned(s, where, rows):
    s.run("CREATE TABLE a (k Int64, ts DateTime64(6)) ENGINE = MergeTree PARTITION BY toYYYYMM(ts) ORDER BY k; INSERT INTO a (k, ts) VALUES (1, '2024-05-01 00:00:00'), (2, '2024-06-01 00:00:00')")
    s.run("INSERT INTO a (k, ts) VALUES (3, '2024-06-02 00:00:00')")
    df = s.query(f"SELECT k, ts FROM a WHERE {where}")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == rows and "PartitionFilters: [isnotnull(__part" in plan and df.columns == ["k", "ts"]
    assert single(s.query(f"SELECT count() FROM a WHERE {where}")) == rows
    assert s.query("SELECT k FROM a WHERE ts > '2024-06-01 12:00:00' OR k = 1").count() == 2


def test_changes_rewrite_only_the_pieces_that_hold_matches(s):
    s.run("CREATE TABLE m (k Int64, v String) ENGINE = MergeTree ORDER BY k; INSERT INTO m (k, v) VALUES (1, 'a'), (2, 'b'); INSERT INTO m (k, v) VALUES (3, 'c'); INSERT INTO m (k, v) VALUES (4, 'd')")
    before = [p["path"] for p in s.store.table("m").pieces]
    assert s.execute("UPDATE m SET v = 'z' WHERE k = 3") == 1
    after = [p["path"] for p in s.store.table("m").pieces]
    assert set(before) - set(after) == {before[1]} and len(after) == 3
    assert s.execute("ALTER TABLE m DELETE WHERE k = 4") == 1 and len(s.store.table("m").pieces) == 2
    assert s.execute("DELETE FROM m WHERE k = 99") == 0 and shown(s, "SELECT k, v FROM m ORDER BY k") == "1\ta\n2\tb\n3\tz\n"
    s.run("OPTIMIZE TABLE m")
    assert len(s.store.table("m").pieces) == 1
    assert s.store.vacuum() == 5 and shown(s, "SELECT k, v FROM m ORDER BY k") == "1\ta\n2\tb\n3\tz\n" and Session(s.spark, s.store.root).store.df("m").count() == 3
