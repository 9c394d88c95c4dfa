"""Queries over what happens to tables: definitions, changes, formats, the change log, replay and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import dml, joins, ordered
from .plans.predicate import Compare, Literal, Name
from .queries import folder, query, store, t
from .session import Session
from .sources import formats
from .sources.catalog import ColumnSpec, Store
from .streaming import changelog

_FEW = "event_id, user_id, event_type, value from events where event_id < 600"


def few(spark, sf_dir):
    return t(spark, sf_dir, "events").where("event_id < 600").select("event_id", "user_id", "event_type", "value")


def loaded(spark, sf_dir, tail="ENGINE = MergeTree ORDER BY event_id") -> Session:
    """A session with the first events in a table e."""
    s = Session(spark, folder(spark))
    s.run(f"CREATE TABLE e (event_id Int64, user_id Int64, event_type String, value Float64) {tail}")
    dml.insert(s.store, "e", few(spark, sf_dir))
    return s


def names(s: Session):
    return s.spark.createDataFrame([(n,) for n in sorted(s.store.tables)], "name string")


# Definitions


@query(f"select event_type, count(*) as n, sum(event_id) as ids from (select {_FEW}) group by event_type")
def ctas_rename(spark, sf_dir):
    s = loaded(spark, sf_dir)
    s.run("CREATE TABLE copy AS SELECT event_id, event_type FROM e; RENAME TABLE copy TO kept")
    return s.query("SELECT event_type, count() AS n, sum(event_id) AS ids FROM kept GROUP BY event_type")


@query("select unnest(['e', 'second']) as name")
def table_discovery(spark, sf_dir):
    """What another session finds after creations, drops and a rename."""
    s = loaded(spark, sf_dir)
    s.run("CREATE TABLE first (k Int64) ENGINE = MergeTree ORDER BY k; CREATE TABLE gone (k Int64) ENGINE = MergeTree ORDER BY k")
    s.run("DROP TABLE gone; DROP TABLE IF EXISTS gone; RENAME TABLE first TO second")
    return names(Session(spark, s.store.root))


@query(f"select {_FEW}")
def store_reload(spark, sf_dir):
    return Store(spark, loaded(spark, sf_dir).store.root).df("e")


@query("select event_id, value as amount, 'none' as note from events where event_id < 600")
def alter_columns(spark, sf_dir):
    s = loaded(spark, sf_dir)
    s.run("ALTER TABLE e DROP COLUMN user_id; ALTER TABLE e RENAME COLUMN value TO amount; ALTER TABLE e ADD COLUMN note String DEFAULT 'none'; ALTER TABLE e DROP COLUMN event_type")
    return s.query("SELECT * FROM e")


@query("select event_id, cast(case when event_id < 600 then 1 else 5 end as bigint) as weight from events where event_id < 700")
def alter_default(spark, sf_dir):
    s = loaded(spark, sf_dir)
    s.run("ALTER TABLE e ADD COLUMN weight Int64 DEFAULT 1; ALTER TABLE e MODIFY COLUMN weight DEFAULT 5")
    dml.insert(s.store, "e", t(spark, sf_dir, "events").where("event_id between 600 and 699").select("event_id", "user_id", "event_type", "value"))
    return s.query("SELECT event_id, weight FROM e")


@query("select count(*) as n, true as recent from events where event_id < 600")
def default_now(spark, sf_dir):
    s = Session(spark, folder(spark))
    s.run("CREATE TABLE d (event_id Int64, made DateTime DEFAULT now()) ENGINE = MergeTree ORDER BY event_id")
    dml.insert(s.store, "d", few(spark, sf_dir).select("event_id"))
    return s.query("SELECT count() AS n, min(made) > now() - INTERVAL 1 DAY AS recent FROM d")


@query(f"select {_FEW}")
def buffer_clone(spark, sf_dir):
    """Rows that wait in a buffer that was cloned from the table, and rows of the table."""
    s = loaded(spark, sf_dir)
    s.run("DELETE FROM e WHERE event_id >= 500; CREATE TABLE waiting AS e ENGINE = Buffer(currentDatabase(), 'e', 16, 10, 100, 10000, 100000, 1000000, 10000000)")
    s.buffers["waiting"].insert(few(spark, sf_dir).where("event_id >= 500"))
    return s.query("SELECT event_id, user_id, event_type, value FROM waiting")


@query("select event_type, sum(event_id) as ids from events where event_id < 600 group by event_type having sum(event_id) > 1000")
def view_of_view(spark, sf_dir):
    s = loaded(spark, sf_dir)
    s.run("CREATE VIEW totals AS SELECT event_type, sum(event_id) AS ids FROM e GROUP BY event_type; CREATE VIEW large AS SELECT event_type, ids FROM totals WHERE ids > 1000; CREATE VIEW gone AS SELECT 1; DROP VIEW gone")
    return s.query("SELECT * FROM large")


# Changes


@query("select event_id from events where event_id between 600 and 699")
def truncate_and_refill(spark, sf_dir):
    s = loaded(spark, sf_dir)
    s.run("DELETE FROM e")
    dml.insert(s.store, "e", t(spark, sf_dir, "events").where("event_id between 600 and 699").select("event_id", "user_id", "event_type", "value"))
    return s.query("SELECT event_id FROM e")


@query("select event_id, 'all' as event_type from events where event_id < 600")
def boolean_predicates(spark, sf_dir):
    s = loaded(spark, sf_dir)
    dml.update(s.store, "e", {"event_type": "all"}, Literal(True))
    dml.delete(s.store, "e", Literal(False))
    return s.query("SELECT event_id, event_type FROM e")


@query("select event_id, case when event_type = 'click' then 0e0 else value end as value from events where event_id < 600 and user_id <> 5")
def changes_by_piece(spark, sf_dir):
    s = loaded(spark, sf_dir)
    s.run("UPDATE e SET value = 0.0 WHERE event_type = 'click'; DELETE FROM e WHERE user_id = 5; OPTIMIZE TABLE e")
    s.store.vacuum()
    return s.query("SELECT event_id, value FROM e")


# Merging on read, pruning


@query("select user_id, event_type, event_id from (select *, row_number() over (partition by user_id order by event_id desc) as rn from events) where rn = 1")
def replacing_final(spark, sf_dir):
    s = Session(spark, folder(spark))
    s.run("CREATE TABLE r (user_id Int64, event_type String, event_id Int64) ENGINE = ReplacingMergeTree(event_id) ORDER BY user_id")
    for half in ("event_id % 2 = 0", "event_id % 2 = 1"):
        dml.insert(s.store, "r", t(spark, sf_dir, "events").where(half).select("user_id", "event_type", "event_id"))
    return s.query("SELECT user_id, event_type, event_id FROM r FINAL")


@query("select event_id, cast(1 as tinyint) as sign from events where event_id < 600 and event_id % 3 <> 0")
def collapsing_final(spark, sf_dir):
    s = Session(spark, folder(spark))
    s.run("CREATE TABLE c (event_id Int64, sign Int8) ENGINE = CollapsingMergeTree(sign) ORDER BY event_id")
    for rows, sign in ((few(spark, sf_dir), 1), (few(spark, sf_dir).where("event_id % 3 = 0"), -1)):
        dml.insert(s.store, "c", rows.select("event_id", F.lit(sign).cast("tinyint").alias("sign")))
    return s.query("SELECT event_id, sign FROM c FINAL")


@query("select event_type as k, round(sum(value), 4) as total from events group by 1")
def aggregating_final(spark, sf_dir):
    s = Session(spark, folder(spark))
    s.run("CREATE TABLE g (k String, total AggregateFunction(sum, Float64)) ENGINE = AggregatingMergeTree ORDER BY k")
    for half in ("event_id % 2 = 0", "event_id % 2 = 1"):
        dml.insert(s.store, "g", t(spark, sf_dir, "events").where(half).groupBy(F.col("event_type").alias("k")).agg(F.sum("value").alias("total")))
    return s.query("SELECT k, round(total, 4) AS total FROM g FINAL")


@query("select l_orderkey, l_linenumber, l_shipdate from lineitem where l_shipdate >= timestamp '1997-03-10 00:00:00' and l_shipdate <= timestamp '1997-04-20 00:00:00'")
def partition_pruned(spark, sf_dir):
    s = Session(spark, folder(spark))
    s.run("CREATE TABLE l (l_orderkey Int64, l_linenumber Int32, l_shipdate DateTime64(6)) ENGINE = MergeTree PARTITION BY toYYYYMM(l_shipdate) ORDER BY l_orderkey")
    dml.insert(s.store, "l", t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"))
    return s.query("SELECT l_orderkey, l_linenumber, l_shipdate FROM l WHERE l_shipdate BETWEEN '1997-03-10 00:00:00' AND '1997-04-20 00:00:00'")


@query("select n_nationkey, n_name from nation where n_regionkey = 2")
def select_all_strict(spark, sf_dir):
    s = Session(spark, folder(spark))
    dml.insert(s.store, "nation", t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    s.run("DELETE FROM nation WHERE n_regionkey != 2; ALTER TABLE nation DROP COLUMN n_regionkey")
    return s.query("SELECT * FROM nation")


@query(
    "select date_trunc('hour', ts) as h, count(*) filter (event_type = 'click') as clicks, round(sum(value) filter (user_id < 50), 4) as low, round(quantile_cont(value, 0.9), 6) as q, "
    "sum(case when value < 50 then 1 when value < 100 then 2 else 3 end)::bigint as band, count(distinct user_id) as users from events where value > 10 group by 1"
)
def dialect_functions(spark, sf_dir):
    s = Session(spark, folder(spark))
    s.run("CREATE TABLE ev (ts DateTime64(6), user_id Int64, event_type String, value Float64) ENGINE = MergeTree ORDER BY ts")
    dml.insert(s.store, "ev", t(spark, sf_dir, "events").select("ts", "user_id", "event_type", "value"))
    return s.query(
        "SELECT toStartOfHour(ts) AS h, countIf(event_type = 'click') AS clicks, round(sumIf(value, user_id < 50), 4) AS low, round(quantile(0.9)(value), 6) AS q, "
        "sum(multiIf(value < 50, 1, value < 100, 2, 3)) AS band, uniqExact(user_id) AS users FROM ev PREWHERE value > 10 GROUP BY h"
    )


# Formats


@query("select n_nationkey, n_name, n_regionkey from nation")
def delimited_round_trip(spark, sf_dir):
    path = folder(spark)
    formats.write_delimited(t(spark, sf_dir, "nation"), path, sep="|")
    return formats.read_delimited(spark, path, "ISI", ["n_nationkey", "n_name", "n_regionkey"])


@query("select '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' as value from nation")
def text_lines(spark, sf_dir):
    path = folder(spark)
    formats.write_json(t(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path)
    return formats.read_lines(spark, path)


@query("select cast(sum(length('{\"n_name\":\"' || n_name || '\"}') + 1) as bigint) as bytes from nation")
def binary_read(spark, sf_dir):
    path = folder(spark)
    formats.write_json(t(spark, sf_dir, "nation").select("n_name"), path)
    return formats.read_bytes(spark, path).agg(F.sum("length").alias("bytes"))


@query("select n_nationkey as id, n_name as name, cast(null as varchar) as note from nation union all select r_regionkey, r_name, 'region' from region")
def many_parts(spark, sf_dir):
    """Files of different columns as one table."""
    a, b = folder(spark), folder(spark)
    t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).write.parquet(a)
    t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("region").alias("note")).write.parquet(b)
    return formats.read_parts(spark, [a, b]).select("id", "name", "note")


def _shown(s: Session, shape: str):
    text = s.run(f"SELECT event_id, event_type FROM e WHERE event_id < 40 ORDER BY event_id FORMAT {shape}")[0]
    return s.spark.createDataFrame([(text,)], "shown string")


_ROWS = "string_agg(event_id || chr(9) || event_type || chr(10), '' order by event_id) as shown from events where event_id < 40"


@query(f"select {_ROWS}")
def tab_separated(spark, sf_dir):
    return _shown(loaded(spark, sf_dir), "TabSeparated")


@query(f"select 'event_id' || chr(9) || 'event_type' || chr(10) || {_ROWS}")
def tab_separated_with_names(spark, sf_dir):
    return _shown(loaded(spark, sf_dir), "TSVWithNames")


@query("select max(value) as x from events where event_id < 600")
def single_scalar(spark, sf_dir):
    return spark.createDataFrame([(loaded(spark, sf_dir).scalar("SELECT max(value) FROM e"),)], "x double")


# The change log


_LOGGED = "select event_id, case when event_type = 'click' then 0e0 else value end as value, cast(7 as bigint) as lots from events where event_id < 240 and user_id <> 5"
_COLUMNS = ["event_id", "user_id", "event_type", "value"]


def logged(spark, sf_dir) -> changelog.Logged:
    """A logged store after inserts, an update, a delete and two changes of columns."""
    log = changelog.Logged(spark, folder(spark))
    log.create("e", [ColumnSpec(c, f"Nullable({k})") for c, k in zip(_COLUMNS, ("Int64", "Int64", "String", "Float64"))])
    rows = [list(r) for r in few(spark, sf_dir).where("event_id < 240").orderBy("event_id").collect()]
    for i in range(0, len(rows), 120):
        log.insert("e", _COLUMNS, rows[i : i + 120])
    log.update("e", {"value": 0.0}, Compare("=", Name("event_type"), Literal("click")))
    log.delete("e", Compare("=", Name("user_id"), Literal(5)))
    log.alter("e", "add", column="lot", type="Nullable(Int64)", default="7")
    log.alter("e", "rename", column="lot", to="lots")
    return log


@query(_LOGGED)
def log_replay(spark, sf_dir):
    """All of a log applied to an empty store."""
    copy = Store(spark, folder(spark))
    changelog.replay(logged(spark, sf_dir).log, copy)
    return copy.df("e").select("event_id", "value", "lots")


@query(f"select *, 8 as lsn from ({_LOGGED} union all select 100000000, 1e0, cast(null as bigint)) where event_id = 100000000 or event_id = 1")
def log_checkpoint_resume(spark, sf_dir):
    """After a checkpoint the log begins later, numbers go on, and a reopened store has everything."""
    log = logged(spark, sf_dir)
    log.checkpoint()
    again = changelog.Logged(spark, log.log.root)
    before = again.store.lsn
    after = again.insert("e", ["event_id", "value", "lots"], [[100000000, 1.0, None]])
    rows = changelog.Logged(spark, log.log.root).store.df("e").where("event_id in (1, 100000000)")
    return rows.select("event_id", "value", "lots", F.when(F.col("event_id") == 100000000, after).otherwise(before + 1).cast("int").alias("lsn"))


@query("select event_id from events where event_id < 120")
def replay_stops_at_damage(spark, sf_dir):
    log = logged(spark, sf_dir).log
    log.files.cut(f"log/{3:020d}.json", b'{"lsn": 3')
    copy = Store(spark, folder(spark))
    changelog.replay(log, copy)
    return copy.df("e").select("event_id")


@query(_LOGGED)
def stream_follow(spark, sf_dir):
    """The log followed as a stream in small batches until it has caught up, into another store."""
    source, target = logged(spark, sf_dir), folder(spark)
    changelog.follow(spark, source.log.root, target, folder(spark), files_per_batch=3).awaitTermination()
    return Store(spark, target).df("e").select("event_id", "value", "lots")


@query("select event_id, cast(case when event_id = 1 then 1 else null end as bigint) as seen from events where event_id < 240 and user_id <> 5 and event_id in (1, 2, 3)")
def stream_again(spark, sf_dir):
    """Delivered twice, from a lost checkpoint, and with a column that came later: each change counts once."""
    source, target, place = logged(spark, sf_dir), folder(spark), folder(spark)
    changelog.follow(spark, source.log.root, target, place).awaitTermination()
    source.alter("e", "add", column="seen", type="Nullable(Int64)", default=None)
    source.update("e", {"seen": 1}, Compare("=", Name("event_id"), Literal(1)))
    changelog.follow(spark, source.log.root, target, place).awaitTermination()
    changelog.follow(spark, source.log.root, target, folder(spark)).awaitTermination()
    return Store(spark, target).df("e").where("event_id in (1, 2, 3)").select("event_id", "seen")


@query(_LOGGED)
def bridge_statements(spark, sf_dir):
    """The log delivered as statements, which a session over another store carries out."""
    source, other = logged(spark, sf_dir), Session(spark, folder(spark))
    changelog.deliver(spark, source.log.root, other.execute, folder(spark), files_per_batch=3).awaitTermination()
    return other.query("SELECT event_id, value, lots FROM e")


@query("select event_type, count(*) as rows, min(epoch_us(ts)) as first, max(epoch_us(ts)) as last from events where event_id < 600 group by event_type")
def ticks_as_micros(spark, sf_dir):
    """Rows inserted as ts into a table that keeps microseconds, grouped and in order."""
    s = Session(spark, folder(spark))
    s.run("CREATE TABLE ticks (event_type String, ts_micros Int64) ENGINE = MixedMergeTree ORDER BY event_type")
    rows = t(spark, sf_dir, "events").where("event_id < 600").select("event_type", "ts")
    dml.insert(s.store, "ticks", s._aliased("ticks", rows), with_defaults=True)
    return s.query("SELECT event_type, count() AS rows, min(ts_micros) AS first, max(ts_micros) AS last FROM ticks GROUP BY event_type ORDER BY event_type")


# Large keys by parts of time


@query(
    "select e.event_id, arg_max(q.value, (q.ts, q.event_id)) as v from events e join events q on e.user_id = q.user_id and q.event_type = 'signup' and q.ts <= e.ts where e.event_type = 'error' group by 1"
)
def asof_by_day(spark, sf_dir):
    events = t(spark, sf_dir, "events")
    errors, signups = (events.where(F.col("event_type") == k).select("event_id", "user_id", "ts", "value") for k in ("error", "signup"))
    found = joins.as_of(errors.drop("value"), signups, ["user_id"], "ts", ["value"], "event_id", split=lambda x: F.date_trunc("day", x))
    return found.select("event_id", F.col("asof_value").alias("v"))


@query("select event_id, round(sum(value) over (partition by event_type order by ts, event_id rows unbounded preceding), 4) as running from events")
def running_sum_by_day(spark, sf_dir):
    events = t(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    return ordered.running_sum(events, F.col("value"), ["event_type"], ["ts", "event_id"], "running", F.date_trunc("day", F.col("ts"))).select("event_id", F.round("running", 4).alias("running"))
