"""Inserts, updates and deletes: new pieces, or a new snapshot of the table, committed at once.

Values are checked and coerced before anything is written, so a failing statement leaves no trace.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import predicate
from ..sources.catalog import ColumnSpec, Store, TableSpec
from ..types import Native, coerce, native_of, of_value

_DECLARED = {Native.I64: "Int64", Native.F64: "Float64", Native.BOOL: "Bool", Native.STRING: "String", Native.BYTES: "Bytes", Native.TIMESTAMP: "DateTime64(6)", Native.SYMBOL: "Symbol"}


def nullable(declared: str) -> str:
    return f"Nullable({declared})"


def _fitted(value: Column, kind: T.DataType, c: ColumnSpec) -> Column:
    source, target = native_of(kind), native_of(c.kind.spark)
    if isinstance(kind, T.NullType):
        return F.lit(None).cast(c.kind.spark)
    if source is None or target is None or Native.TIMESTAMP in (source, target) and source != target and not {source, target} <= {Native.TIMESTAMP, Native.STRING}:
        if source == Native.I64 and target == Native.TIMESTAMP:
            return F.timestamp_micros(value).cast("timestamp_ntz")
        if source == Native.TIMESTAMP and target in (Native.I64, Native.F64):
            return F.unix_micros(value.cast("timestamp")).cast(c.kind.spark)
        return value.cast(c.kind.spark)
    if isinstance(c.kind.spark, (T.DecimalType, T.DateType)) or Native.TIMESTAMP in (source, target):
        return value.cast(c.kind.spark)
    return coerce(value, source, target).cast(c.kind.spark)


def completed(store: Store, spec: TableSpec, rows: DataFrame, with_defaults: bool) -> DataFrame:
    """rows with every column of the table: given values fitted to their types, omitted ones by default.
    with_defaults: omitted columns that aren't nullable and have no default take their type's."""
    given = {f.name.lower(): f for f in rows.schema}
    values: dict[str, Column] = {}
    for c in spec.columns:
        f = given.get(c.name.lower())
        if f is not None and c.materialized is None:
            value = _fitted(F.col(f"`{f.name}`"), f.dataType, c)
        elif c.materialized is not None:
            value = F.expr(c.materialized).cast(c.kind.spark)
        elif c.default is not None:
            value = F.expr(c.default).cast(c.kind.spark)
        else:
            value = c.kind.default() if with_defaults else F.lit(None).cast(c.kind.spark)
        values[c.name] = c.kind.checked(value, c.name)
    plain = [c for c in spec.columns if c.materialized is None]
    out = rows.select(*(values[c.name].alias(c.name) for c in plain))
    computed = {c.name: values[c.name] for c in spec.columns if c.materialized is not None}
    return out.withColumns(computed).select(*(f"`{c.name}`" for c in spec.columns)) if computed else out


def evolved(store: Store, name: str, rows: DataFrame) -> TableSpec:
    """The table, made if it isn't there, with a column for each of rows."""
    if name not in store.tables:
        columns = [ColumnSpec(f.name, nullable(_DECLARED[native_of(f.dataType) or Native.STRING])) for f in rows.schema]
        store.create(name, columns, {"implicit": "1"})
    for f in rows.schema:
        if not store.table(name).has(f.name):
            store.add_column(name, ColumnSpec(f.name, nullable(_DECLARED[native_of(f.dataType) or Native.STRING])), commit=False)
    return store.table(name)


def insert(store: Store, name: str, rows: DataFrame, with_defaults: bool = False, lsn: int | None = None) -> None:
    """Appends rows; unknown tables and columns come into being."""
    spec = evolved(store, name, rows)
    store.append(name, completed(store, spec, rows, with_defaults), lsn)


def values(store: Store, columns: Sequence[str], rows: Sequence[Sequence[object]]) -> DataFrame:
    """Literal rows as a DataFrame. Of a column named twice the later counts; a column's type is that of its
    first value that isn't null; where there is none, nulls fit any type, and make a string column."""
    if not columns:
        raise ValueError("an insert names its columns")
    if any(len(r) != len(columns) for r in rows):
        raise ValueError("a row has as many values as there are columns")
    place = {c.lower(): i for i, c in enumerate(columns)}
    fields = []
    for i in sorted(place.values()):
        first = next((r[i] for r in rows if r[i] is not None), None)
        kind = of_value(first)
        spark = {Native.I64: T.LongType(), Native.F64: T.DoubleType(), Native.BOOL: T.BooleanType(), Native.BYTES: T.BinaryType()}.get(kind, T.StringType())
        fields.append(T.StructField(columns[i], spark if first is not None else T.NullType()))
        if any(r[i] is not None and of_value(r[i]) != kind for r in rows):
            raise TypeError(f"value type mismatch in {columns[i]}")
    return store.spark.createDataFrame([tuple(r[i] for i in sorted(place.values())) for r in rows], T.StructType(fields))


def update(store: Store, name: str, assignments: dict[str, object], where: predicate.Expr | None = None, lsn: int | None = None) -> int:
    """Sets literals where the predicate holds; how many rows that are. A missing table has no rows."""
    if name not in store.tables:
        return 0
    for column, value in assignments.items():
        if not store.table(name).has(column):
            store.add_column(name, ColumnSpec(column, nullable(_DECLARED[of_value(value)])), commit=False)
    spec = store.table(name)
    rows = store.df(name)
    chosen = predicate.compiled(where, rows.schema, predicate.Mode.UPDATE, store.suspect(name)) if where is not None else F.lit(True)
    new = {}
    for column, value in assignments.items():
        c = spec.column(column)
        literal = F.lit(value)
        fitted = c.kind.checked(_fitted(literal, T.NullType() if value is None else _spark_of(value), c), c.name)
        new[c.name] = F.when(chosen, fitted).otherwise(F.col(f"`{c.name}`"))
    computed = {c.name: F.expr(c.materialized).cast(c.kind.spark) for c in spec.columns if c.materialized is not None}
    return store.changed(name, chosen, lambda df: df.withColumns(new).withColumns(computed) if computed else df.withColumns(new), lsn)


def _spark_of(value: object) -> T.DataType:
    return {Native.I64: T.LongType(), Native.F64: T.DoubleType(), Native.BOOL: T.BooleanType(), Native.BYTES: T.BinaryType()}.get(of_value(value), T.StringType())


def delete(store: Store, name: str, where: predicate.Expr | None = None, lsn: int | None = None) -> int:
    """Drops the rows where the predicate holds, all of them without one; how many. A missing table has none."""
    if name not in store.tables:
        return 0
    rows = store.df(name)
    if where is None:
        gone = rows.count()
        store.replace(name, None, lsn)
        return gone
    chosen = predicate.compiled(where, rows.schema, predicate.Mode.DELETE, store.suspect(name))
    return store.changed(name, chosen, lambda df: df.where(~chosen), lsn)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old with the rows of new, which take the place of those with the same keys (null equals null)."""
    marked = new.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    on = None
    for k in keys:
        test = old[k].eqNullSafe(marked[f"__{k}"])
        on = test if on is None else on & test
    return old.join(marked, on, "left_anti").unionByName(new, allowMissingColumns=True)


def replaced_at(df: DataFrame, key: str, positions: DataFrame, column: str, value: Column) -> DataFrame:
    """df with value in the column where the key is among positions (a DataFrame of that key)."""
    marked = positions.select(F.col(key).alias("__at")).distinct().withColumn("__hit", F.lit(True))
    joined = df.join(marked, df[key] == F.col("__at"), "left")
    return joined.withColumn(column, F.when(F.col("__hit"), value).otherwise(F.col(column))).drop("__at", "__hit")
