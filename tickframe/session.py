"""Scripts of the SQL dialect over a store: definitions, changes, queries, output formats."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import dml, engines
from .plans import dialect, native, prql
from .plans.parser import Reader, SqlError, statements
from .sources.catalog import CatalogError, ColumnSpec, Store
from .sources.formats import rendered
from .types import declared, split_top

_TAIL = ("ENGINE", "ORDER BY", "PRIMARY KEY", "PARTITION BY", "SAMPLE BY", "TTL", "SETTINGS", "COMMENT")
_LITERAL = re.compile(r"(?:[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?|'(?:[^'\\]|\\.|'')*'|NULL|TRUE|FALSE)$", re.I)


def _tail(text: str) -> dict[str, str]:
    """The clauses after a table's columns, by name."""
    found = sorted((m.start(), k) for k in _TAIL for m in re.finditer(rf"\b{k.replace(' ', r'\s+')}\b", text, re.I))
    out = {}
    for (at, key), (end, _) in zip(found, [*found[1:], (len(text), "")]):
        body = re.sub(rf"^{key.replace(' ', r'\s+')}\s*=?\s*", "", text[at:end].strip(), flags=re.I)
        name = key.lower().replace(" ", "_")
        if name in ("order_by", "primary_key") and body.startswith("(") and body.endswith(")"):
            body = body[1:-1]
        out.setdefault(name, body.strip())
    return out


def _columns(text: str) -> list[ColumnSpec]:
    out = []
    for item in split_top(text):
        if re.match(r"(?:INDEX|CONSTRAINT|PROJECTION)\b", item, re.I):
            continue
        m = re.match(r"([`\"]?[\w.]+[`\"]?)\s+(.*)", item, re.S)
        if not m:
            raise SqlError(f"can't read the column {item}")
        name, rest = m.group(1).strip('`"'), m.group(2)
        clauses = re.split(r"\b(DEFAULT|MATERIALIZED|ALIAS|COMMENT|CODEC|NOT\s+NULL)\b", rest, flags=re.I)
        kind = clauses[0].strip()
        given = {k.upper().split()[0]: v.strip() for k, v in zip(clauses[1::2], clauses[2::2])}
        if kind.upper().endswith(" NULL"):
            kind = f"Nullable({kind[:-5].strip()})"
        t = declared(kind)
        if t.fields:
            inner = split_top(kind[kind.index("(") + 1 : kind.rindex(")")])
            out += [ColumnSpec(f"{name}.{i.split(None, 1)[0]}", f"Array({i.split(None, 1)[1]})") for i in inner]
            continue
        default, made = given.get("DEFAULT"), given.get("MATERIALIZED") or given.get("ALIAS")
        out.append(ColumnSpec(name, kind, default=dialect.expression(default) if default else None, materialized=dialect.expression(made) if made else None))
    return out


class Session:
    """One store and the views over it. `run` executes a script and returns what its queries show.

    aliases: inserted names that stand for a column under another name, with the conversion to it; ticks are
    often written as `ts` into a table that keeps `ts_micros`."""

    def __init__(self, spark: SparkSession, root: str, aliases: dict[str, tuple[str, Callable]] | None = None) -> None:
        self.spark, self.store = spark, Store(spark, root)
        self.views: dict[str, str] = {}
        self.buffers: dict[str, engines.Buffer] = {}
        self.aliases = aliases if aliases is not None else {"ts": ("ts_micros", lambda c: F.unix_micros(c.cast("timestamp")))}

    # Queries

    def df(self, name: str) -> DataFrame:
        """A table as its engine shows it: buffers with what waits, expiring tables without what has expired."""
        if name in self.buffers:
            return self.buffers[name].df()
        rows = self.store.df(name)
        ttl = self.store.table(name).properties.get("ttl")
        if ttl and (m := re.match(r"`?(\w+)`?\s*\+\s*INTERVAL\s+(\d+)\s+DAY", ttl, re.I)):
            rows = engines.unexpired(rows, m.group(1), int(m.group(2)), F.current_timestamp().cast("timestamp_ntz"))
        return rows

    def final(self, name: str) -> DataFrame:
        """A table with its rows merged as its engine merges them: the last version of a key, what signs leave, summed
        states. Tables that merge nothing are as they are."""
        rows, spec = self.df(name), self.store.table(name)
        engine = re.match(r"(\w*?)(Replacing|Collapsing|Aggregating)MergeTree\s*(?:\(\s*`?(\w*)`?\s*\))?", spec.properties.get("engine", ""))
        if not engine:
            return rows
        keys = [spec.column(k.strip().strip("`")).name for k in spec.properties.get("order_by", "").split(",") if k.strip()]
        if not keys:
            raise CatalogError(f"{name} has no key to merge by")
        kind, by = engine.group(2), engine.group(3)
        rest = [c for c in rows.columns if c not in keys]
        if kind == "Aggregating":
            states = {c.name for c in spec.columns if c.type.startswith(("AggregateFunction", "SimpleAggregateFunction"))}
            return rows.groupBy(*keys).agg(*((F.sum(c) if c in states else F.any_value(c)).alias(c) for c in rest)).select(*rows.columns)
        if not by:
            raise CatalogError(f"{name} has no column of versions, so no row of a key is the last")
        by = spec.column(by).name
        if kind == "Replacing":
            return engines.replacing(rows, keys, [by, *(c for c in rest if c != by)])
        last = rows.withColumn("__row", F.struct(*(c for c in rest if c != by)))
        merged = engines.collapsing(last, keys, by, "__row").withColumn(by, F.lit(1).cast(rows.schema[by].dataType))
        return merged.select(*rows.columns)

    def _registered(self, sql: str, text: str = "") -> None:
        words = set(re.findall(r"[\w.]+", sql))
        for _ in range(len(self.views) + 1):  # views of views
            words |= {w for v in self.views if v in words for w in re.findall(r"[\w.]+", self.views[v])}
        for name in self.store.tables:
            view = name.replace(".", "__")
            if name in words or view in words:
                rows = self.df(name)
                if (part := self._part(name, sql)) is not None:
                    rows = self.store.df(name, part)
                rows.createOrReplaceTempView(view)
            if f"{view}__final" in text or f"{view}__final" in words:
                self.final(name).createOrReplaceTempView(f"{view}__final")
        for name, text_ in self.views.items():
            if name in words:
                self.spark.sql(text_).createOrReplaceTempView(name)

    def _part(self, name: str, sql: str) -> Column | None:
        """What a query of this one table says of the value that it is partitioned by, so that folders are pruned: comparisons
        with literals of the partition's expression, or of the column under a function of it that never falls."""
        by = self.store.table(name).partition_by
        m = re.fullmatch(r"\s*SELECT\b(?:(?!\b(?:FROM|SELECT)\b).)*\bFROM\s+`?([\w.]+)`?\s+WHERE\s+((?:(?!\b(?:SELECT|UNION|JOIN|OR|NOT)\b).)*?)(?:\b(?:GROUP|ORDER|LIMIT|HAVING|FORMAT|SETTINGS)\b(?:(?!\b(?:SELECT|UNION|JOIN)\b).)*)?", sql, re.I | re.S)
        if not by or not m or m.group(1) != name or name in self.buffers or "ttl" in self.store.table(name).properties:
            return None
        of = re.fullmatch(r"(?:(toYYYYMM|toDate|toYear|toStartOfMonth)\s*\(\s*)?`?(\w+)`?\s*\)?", by)
        literal = r"(?:[-+]?\d+(?:\.\d+)?|'[^']*'|toDateTime64\('[^']*',\s*\d\)|toDateTime\('[^']*'\)|toDate\('[^']*'\))"
        out = None
        bounds = re.sub(rf"(\S+)\s+BETWEEN\s+({literal})\s+AND\s+({literal})", r"\1 >= \2 AND \1 <= \3", m.group(2), flags=re.I | re.S)
        for test in re.split(r"\bAND\b", bounds, flags=re.I):
            c = re.fullmatch(rf"\s*(.+?)\s*(<=|>=|=|<|>)\s*({literal})\s*", test, re.S)
            if not c:
                continue
            left, sign, value = c.groups()
            part, of_value = F.col("__part"), F.expr(dialect.expression(value))
            if re.sub(r"\s", "", left) == re.sub(r"\s", "", by) and not (of and not of.group(1)):
                found = {"=": part == of_value, "<": part < of_value, "<=": part <= of_value, ">": part > of_value, ">=": part >= of_value}[sign]
            elif of and left.strip("`") == of.group(2):
                kind = self.store.table(name).column(of.group(2)).kind.spark.simpleString()
                end = F.expr(dialect.expression(by.replace(of.group(2), f"cast({dialect.expression(value)} as {kind})")))
                found = part == end if sign == "=" else part <= end if "<" in sign else part >= end
            else:
                continue
            out = found if out is None else out & found
        return out

    def _translated(self, sql: str) -> tuple[str, str | None]:
        dotted = {c.name for t in self.store.tables.values() for c in t.columns if "." in c.name}
        text, shape = dialect.query(sql, dotted)
        for name in self.store.tables:
            if "." in name:
                text = dialect.outside_quotes(text, lambda p, name=name: re.sub(rf"(?<![\w.]){re.escape(name)}(?![\w])", name.replace(".", "__"), p))

        def key(m: re.Match) -> str:
            by = self.store.table(m.group(1)).properties.get("sample_by", "")
            inner = re.fullmatch(r"\w+\((.*)\)", by)
            return inner.group(1) if inner else by or self.store.table(m.group(1)).columns[0].name

        return re.sub(r"__SAMPLE_KEY_([\w.]+?)__\)", lambda m: key(m) + ")", text), shape

    def query(self, sql: str) -> DataFrame:
        text, _ = self._translated(sql)
        self._registered(sql, text)
        return self.spark.sql(text)

    def strict(self, sql: str) -> DataFrame:
        """A query of the strict subset, with its rules of comparison."""
        plan = native.parse_select(sql)
        return native.planned(plan, self.df(plan.table), self.store.suspect(plan.table))

    def pipeline(self, text: str) -> DataFrame:
        return prql.run(text, self.df, self.store.suspect)

    def scalar(self, sql: str) -> object:
        """The value of a query of one row and column."""
        return single(self.query(sql))

    # Scripts

    def run(self, script: str) -> list[str]:
        """What the queries of a script show, in their output formats."""
        out = []
        for statement in statements(script):
            shown = self.execute(statement)
            if isinstance(shown, DataFrame):
                out.append(rendered(shown, self._translated(statement)[1]))
        return out

    def execute(self, sql: str) -> DataFrame | int | None:
        """A DataFrame for a query, the number of rows for a change, nothing for a definition."""
        sql = sql.strip().rstrip(";").strip()
        head = re.match(r"\w+", sql)
        verb = head.group().upper() if head else ""
        do = {"CREATE": self._create, "DROP": self._drop, "INSERT": self._insert, "ALTER": self._alter, "RENAME": self._rename, "UPDATE": self._update, "DELETE": self._delete, "TRUNCATE": self._truncate, "OPTIMIZE": self._optimize}.get(verb)
        if do:
            return do(sql)
        if verb in ("SELECT", "WITH"):
            return self.query(sql)
        raise SqlError(f"unsupported statement {sql[:40]}")

    def _match(self, pattern: str, sql: str) -> re.Match:
        m = re.fullmatch(pattern, sql, re.I | re.S)
        if not m:
            raise SqlError(f"can't read {sql[:80]}")
        return m

    def _create(self, sql: str) -> None:
        if m := re.fullmatch(r"CREATE\s+(OR\s+REPLACE\s+)?VIEW\s+(IF\s+NOT\s+EXISTS\s+)?([\w.`]+)\s+AS\s+(.*)", sql, re.I | re.S):
            name = m.group(3).strip("`")
            if (name in self.views or name in self.store.tables) and not m.group(1):
                if m.group(2):
                    return
                raise CatalogError(f"{name} exists")
            text, _ = self._translated(m.group(4))
            self._registered(m.group(4))
            self.spark.sql(text).schema  # noqa: B018  fails here if it can't be bound
            self.views[name] = text
            return
        m = self._match(r"CREATE\s+TABLE\s+(IF\s+NOT\s+EXISTS\s+)?([\w.`]+)\s*(.*)", sql)
        again, name, rest = bool(m.group(1)), m.group(2).strip("`"), m.group(3).strip()
        if rest.upper().startswith("AS"):
            if s := re.match(r"AS\s+(SELECT|WITH)\b", rest, re.I):
                rows = self.query(rest[s.start(1) :])
                kinds = {"bigint": "Int64", "double": "Float64", "boolean": "Bool", "binary": "Bytes", "timestamp_ntz": "DateTime64(6)", "int": "Int32", "date": "Date"}
                self.store.create(name, [ColumnSpec(f.name, f"Nullable({kinds.get(f.dataType.simpleString(), 'String')})") for f in rows.schema], {}, again)
                dml.insert(self.store, name, rows)
                return
            s = re.match(r"AS\s+([\w.`]+)\s*(.*)", rest, re.I | re.S)
            assert s
            properties = _tail(s.group(2))
            source = s.group(1).strip("`")
            self.store.clone(name, source, properties)
            if b := re.match(r"Buffer\s*\(([^()]*(?:\(\))?[^()]*)\)", properties.get("engine", ""), re.I):
                args = [a.strip().strip("'") for a in split_top(b.group(1))]
                seconds, rows_ = float(args[4]) if len(args) > 4 else 1.0, int(args[6]) if len(args) > 6 else 1024
                self.buffers[name] = engines.Buffer(self.store, args[1] if len(args) > 1 else source, rows_, seconds)
            return
        if not rest.startswith("("):
            raise SqlError(f"can't read {sql[:80]}")
        end = dialect._closing(rest, 0)
        properties = _tail(rest[end + 1 :])
        self.store.create(name, _columns(rest[1:end]), properties, again)

    def _drop(self, sql: str) -> None:
        m = self._match(r"DROP\s+(TABLE|VIEW)\s+(IF\s+EXISTS\s+)?([\w.`]+)", sql)
        name = m.group(3).strip("`")
        if m.group(1).upper() == "VIEW":
            if name not in self.views and not m.group(2):
                raise CatalogError(f"no view {name}")
            self.views.pop(name, None)
        else:
            self.buffers.pop(name, None)
            self.store.drop(name, bool(m.group(2)))

    def _rename(self, sql: str) -> None:
        m = self._match(r"RENAME\s+TABLE\s+([\w.`]+)\s+TO\s+([\w.`]+)", sql)
        self.store.rename(m.group(1).strip("`"), m.group(2).strip("`"))

    def _aliased(self, name: str, rows: DataFrame) -> DataFrame:
        """rows under the table's names, aliases converted."""
        if name not in self.store.tables:
            return rows
        spec = self.store.table(name)
        for alias, (column, convert) in self.aliases.items():
            if alias in rows.columns and not spec.has(alias) and spec.has(column):
                rows = rows.withColumn(alias, convert(F.col(alias))).withColumnRenamed(alias, column)
        return rows

    def _insert(self, sql: str) -> None:
        m = self._match(r"INSERT\s+INTO\s+(?:TABLE\s+)?([\w.`]+)\s*(?:\(([^()]*)\))?\s*(VALUES|SELECT|WITH)\b(.*)", sql)
        name = m.group(1).strip("`")
        columns = [c.strip().strip('`"') for c in m.group(2).split(",")] if m.group(2) else None
        if m.group(3).upper() != "VALUES":
            rows = self.query(m.group(3) + m.group(4))
            columns = columns or [c.name for c in self.store.table(name).columns if c.materialized is None]
            if len(columns) != len(rows.columns):
                raise SqlError("the query has another number of columns")
            rows = rows.toDF(*columns)
        else:
            if columns is None:
                raise SqlError("an insert names its columns")
            given = [[v.strip() for v in split_top(t.strip()[1:-1])] for t in split_top(m.group(4))]
            if any(len(r) != len(columns) for r in given):
                raise SqlError("a row has as many values as there are columns")
            simple = all(_LITERAL.match(v) for r in given for v in r)
            try:
                rows = dml.values(self.store, columns, [[Reader(v).literal().value for v in r] for r in given]) if simple else None
            except TypeError:
                rows = None
            if rows is None:
                names = [f"`{c}`" for c in columns]
                rows = self.spark.sql(" UNION ALL ".join("SELECT " + ", ".join(f"{dialect.value(v)} AS {n}" for v, n in zip(r, names)) for r in given))
        rows = self._aliased(name, rows)
        if name in self.buffers:
            self.buffers[name].insert(rows, with_defaults=True)
        else:
            dml.insert(self.store, name, rows, with_defaults=True)

    def _alter(self, sql: str) -> int | None:
        m = self._match(r"ALTER\s+TABLE\s+([\w.`]+)\s+(.*)", sql)
        name, what = m.group(1).strip("`"), m.group(2).strip()
        if a := re.fullmatch(r"ADD\s+COLUMN\s+(IF\s+NOT\s+EXISTS\s+)?(.*)", what, re.I | re.S):
            for c in _columns(a.group(2)):
                self.store.add_column(name, c, bool(a.group(1)))
        elif a := re.fullmatch(r"DROP\s+COLUMN\s+(?:IF\s+EXISTS\s+)?([\w.`]+)", what, re.I):
            self.store.drop_column(name, a.group(1).strip("`"))
        elif a := re.fullmatch(r"RENAME\s+COLUMN\s+([\w.`]+)\s+TO\s+([\w.`]+)", what, re.I):
            self.store.rename_column(name, a.group(1).strip("`"), a.group(2).strip("`"))
        elif a := re.fullmatch(r"(?:ALTER|MODIFY)\s+COLUMN\s+([\w.`]+)\s+(?:SET\s+)?DEFAULT\s+(.*)", what, re.I | re.S):
            self.store.set_default(name, a.group(1).strip("`"), dialect.expression(a.group(2)))
        elif a := re.fullmatch(r"UPDATE\s+(.*?)\s+WHERE\s+(.*)", what, re.I | re.S):
            return self._mutate(name, a.group(1), a.group(2))
        elif a := re.fullmatch(r"DELETE\s+WHERE\s+(.*)", what, re.I | re.S):
            chosen = F.coalesce(F.expr(dialect.expression(a.group(1))).cast("boolean"), F.lit(False))
            return self.store.changed(name, chosen, lambda df: df.where(~chosen))
        else:
            raise SqlError(f"can't read {what[:60]}")
        return None

    def _mutate(self, name: str, assignments: str, where: str) -> int:
        """A mutation: expressions on the right, SQL's logic in the condition."""
        chosen = F.coalesce(F.expr(dialect.expression(where)).cast("boolean"), F.lit(False))
        spec = self.store.table(name)
        new = {}
        for part in split_top(assignments):
            column, _, text = part.partition("=")
            c = spec.column(column.strip().strip("`"))
            new[c.name] = F.when(chosen, c.kind.checked(F.expr(dialect.expression(text)).cast(c.kind.spark), c.name)).otherwise(F.col(f"`{c.name}`"))
        return self.store.changed(name, chosen, lambda df: df.withColumns(new))

    def _update(self, sql: str) -> int:
        m = self._match(r"UPDATE\s+([\w.`]+)\s+SET\s+(.*)", sql)
        r = Reader(m.group(2))
        assignments: dict[str, object] = {}
        while True:
            column = r.name()
            r.expect("=")
            value = r.literal()
            if value is None:
                raise SqlError("an update sets literals")
            assignments[column] = value.value
            if not r.accept(","):
                break
        where = r.predicate() if r.accept("WHERE") else None
        if not r.done:
            raise SqlError(f"can't read {sql[:80]}")
        return dml.update(self.store, m.group(1).strip("`"), assignments, where)

    def _delete(self, sql: str) -> int:
        m = self._match(r"DELETE\s+FROM\s+([\w.`]+)(?:\s+WHERE\s+(.*))?", sql)
        where = None
        if m.group(2):
            r = Reader(m.group(2))
            where = r.predicate()
            if not r.done:
                raise SqlError(f"can't read {m.group(2)}")
        return dml.delete(self.store, m.group(1).strip("`"), where)

    def _optimize(self, sql: str) -> None:
        """Merges a table for good."""
        m = self._match(r"OPTIMIZE\s+TABLE\s+([\w.`]+)(\s+FINAL)?", sql)
        name = m.group(1).strip("`")
        if name in self.buffers:
            self.buffers[name].flush()
        elif m.group(2):
            self.store.replace(name, self.final(name))
        else:
            self.store.compact(name)

    def _truncate(self, sql: str) -> int:
        m = self._match(r"TRUNCATE\s+TABLE\s+([\w.`]+)", sql)
        return dml.delete(self.store, m.group(1).strip("`"))


def single(df: DataFrame) -> object:
    """The value of one row and one column; an error for anything else."""
    rows = df.limit(2).collect()
    if len(rows) != 1 or len(rows[0]) != 1:
        raise ValueError("not a single value")
    return rows[0][0]
