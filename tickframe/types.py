"""Column types: the seven native ones, the wider set that the SQL dialect declares, and coercion on write."""

from __future__ import annotations

import enum
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Native(enum.IntEnum):
    I64 = 1
    F64 = 2
    BOOL = 3
    STRING = 4
    BYTES = 5
    TIMESTAMP = 6
    SYMBOL = 7


_PHYSICAL: dict[Native, T.DataType] = {
    Native.I64: T.LongType(),
    Native.F64: T.DoubleType(),
    Native.BOOL: T.BooleanType(),
    Native.STRING: T.StringType(),
    Native.BYTES: T.BinaryType(),
    Native.TIMESTAMP: T.LongType(),  # microseconds, without a zone
    Native.SYMBOL: T.StringType(),
}
_NATIVE_NAMES = {
    "int64": Native.I64, "bigint": Native.I64, "uint64": Native.I64,
    "float64": Native.F64, "double": Native.F64,
    "bool": Native.BOOL, "boolean": Native.BOOL,
    "string": Native.STRING, "text": Native.STRING, "varchar": Native.STRING,
    "bytes": Native.BYTES, "binary": Native.BYTES, "blob": Native.BYTES,
    "timestamp": Native.TIMESTAMP, "ts": Native.TIMESTAMP,
    "symbol": Native.SYMBOL,
}
_WIDE = {
    "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "bigint", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint",
    "float32": "float", "float64": "double", "bool": "boolean", "boolean": "boolean", "string": "string", "fixedstring": "string", "uuid": "string", "ipv4": "string",
    "ipv6": "string", "date": "date", "datetime": "timestamp_ntz", "datetime64": "timestamp_ntz", "json": "string", "bytes": "binary", "binary": "binary", "blob": "binary",
    "timestamp": "timestamp_ntz", "ts": "timestamp_ntz", "symbol": "string", "text": "string", "varchar": "string", "double": "double", "bigint": "bigint", "int": "int", "integer": "int",
}
_RANGES = {"uint8": (0, 255), "uint16": (0, 65535), "uint32": (0, 4294967295), "uint64": (0, (1 << 63) - 1)}
#: Patterns that checked strings must match, in the dialect of Java's regexes.
_CHECKS = {
    "ipv4": r"^((25[0-5]|2[0-4]\d|1?\d?\d)(\.(?!$)|$)){4}$",
    "uuid": r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
}


def split_top(text: str, sep: str = ",") -> list[str]:
    """Parts between separators that are outside of brackets and quotes."""
    parts, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == sep and not depth:
            parts.append(text[start:i].strip())
            start = i + 1
    parts.append(text[start:].strip())
    return [p for p in parts if p]


@dataclass(frozen=True)
class ColumnType:
    """A declared type: how Spark holds it, and what values may be written."""

    declared: str
    spark: T.DataType
    nullable: bool = False
    allowed: tuple[str, ...] = ()
    state: str = ""  # of a partial aggregate: its function
    low: int | None = None
    high: int | None = None
    pattern: str = ""
    fields: tuple[tuple[str, "ColumnType"], ...] = field(default=())  # of Nested

    def default(self) -> Column:
        """What an omitted value becomes in a column that isn't nullable."""
        kind = self.spark
        if self.nullable:
            return F.lit(None).cast(kind)
        if self.allowed:
            return F.lit(self.allowed[0])
        if isinstance(kind, T.StringType):
            return F.lit("")
        if isinstance(kind, T.NumericType):
            return F.lit(0).cast(kind)
        if isinstance(kind, T.BooleanType):
            return F.lit(False)
        if isinstance(kind, T.TimestampNTZType):
            return F.lit("1970-01-01 00:00:00").cast(kind)
        if isinstance(kind, T.ArrayType):
            return F.array().cast(kind)
        if isinstance(kind, T.MapType):
            return F.create_map().cast(kind)
        return F.lit(None).cast(kind)

    def checked(self, value: Column, name: str) -> Column:
        """value, or an error where the type doesn't admit it."""
        bad = None
        if self.allowed:
            bad = ~value.isin(*self.allowed)
        elif self.low is not None:
            bad = (value < self.low) | (value > self.high)
        elif self.pattern:
            bad = ~value.rlike(self.pattern) & (value != "")
        if bad is None:
            return value
        return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.concat(F.lit(f"{name}: not a {self.declared}: "), value.cast("string")))).otherwise(value)


def declared(text: str) -> ColumnType:
    """The type that a declaration names."""
    text = text.strip()
    m = re.fullmatch(r"(\w+)\s*(?:\((.*)\))?", text, re.S)
    if not m:
        raise ValueError(f"unsupported column type {text}")
    name, inner = m.group(1).lower(), m.group(2)
    args = split_top(inner) if inner else []
    if name == "nullable":
        t = declared(args[0])
        return ColumnType(text, t.spark, True, t.allowed, t.state, t.low, t.high, t.pattern)
    if name == "lowcardinality":
        t = declared(args[0])
        return ColumnType(text, t.spark, t.nullable)
    if name == "array":
        return ColumnType(text, T.ArrayType(declared(args[0]).spark))
    if name == "map":
        return ColumnType(text, T.MapType(declared(args[0]).spark, declared(args[1]).spark))
    if name == "tuple":
        return ColumnType(text, T.StructType([T.StructField(f"_{i}", declared(a.split()[-1] if re.match(r"\w+\s+\w", a) else a).spark) for i, a in enumerate(args, 1)]))
    if name == "nested":
        fields = tuple((a.split(None, 1)[0], declared(a.split(None, 1)[1])) for a in args)
        return ColumnType(text, T.StructType([T.StructField(n, T.ArrayType(t.spark)) for n, t in fields]), fields=fields)
    if name in ("enum8", "enum16", "enum"):
        return ColumnType(text, T.StringType(), allowed=tuple(re.findall(r"'((?:[^'\\]|\\.)*)'", inner or "")))
    if name in ("decimal", "numeric"):
        p, s = (int(a) for a in args) if len(args) == 2 else (int(args[0]) if args else 10, 0)
        return ColumnType(text, T.DecimalType(p, s))
    if name == "aggregatefunction":
        return ColumnType(text, T.LongType() if args[0].lower() == "count" else declared(args[-1]).spark, state=args[0].lower())
    if name not in _WIDE:
        raise ValueError(f"unsupported column type {text}")
    low, high = _RANGES.get(name, (None, None))
    kinds = {"smallint": T.ShortType, "int": T.IntegerType, "bigint": T.LongType, "tinyint": T.ByteType, "float": T.FloatType, "double": T.DoubleType, "boolean": T.BooleanType, "string": T.StringType, "date": T.DateType, "timestamp_ntz": T.TimestampNTZType, "binary": T.BinaryType}
    return ColumnType(text, kinds[_WIDE[name]](), low=low, high=high, pattern=_CHECKS.get(name, ""))


def native(text: str) -> Native:
    """The native type that a name stands for; lossy for decimals, as are UUID, IPv4 and dates."""
    base = re.sub(r"\(.*", "", text.strip()).strip().lower()
    if base in _NATIVE_NAMES:
        return _NATIVE_NAMES[base]
    if base in ("decimal", "numeric"):
        return Native.F64
    if base in ("date", "datetime", "datetime64"):
        return Native.TIMESTAMP
    if base in ("uuid", "ipv4"):
        return Native.STRING
    raise ValueError(f"unsupported column type {text}")


def physical(kind: Native) -> T.DataType:
    return _PHYSICAL[kind]


def native_of(kind: T.DataType) -> Native | None:
    """The native type that a Spark type corresponds to."""
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return Native.I64
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return Native.F64
    if isinstance(kind, T.BooleanType):
        return Native.BOOL
    if isinstance(kind, T.StringType):
        return Native.STRING
    if isinstance(kind, T.BinaryType):
        return Native.BYTES
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return Native.TIMESTAMP
    return None


def of_value(value: object) -> Native:
    """The native type inferred from a Python value; null counts as a string."""
    for python, kind in ((bool, Native.BOOL), (int, Native.I64), (float, Native.F64), (bytes, Native.BYTES)):
        if isinstance(value, python):
            return kind
    return Native.STRING


def saturated(x: Column) -> Column:
    """Double to bigint: towards zero, at the ends of the range if beyond, NaN to 0."""
    return (
        F.when(x.isNull(), None)
        .when(F.isnan(x), F.lit(0).cast("bigint"))
        .when(x >= 9.223372036854775807e18, F.lit((1 << 63) - 1))
        .when(x <= -9.223372036854775808e18, F.lit(-(1 << 63) + 1) - 1)
        .otherwise(x.cast("bigint"))
    )


def coerce(x: Column, source: Native, target: Native) -> Column:
    """x as it is stored in a column of the target type; raises if the types don't go together."""
    if source == target:
        return x
    numbers = {Native.I64, Native.F64, Native.TIMESTAMP}
    if source in numbers and target in numbers:
        if source == Native.F64:
            if target == Native.TIMESTAMP:
                raise TypeError("value type mismatch: F64 to TIMESTAMP")
            return saturated(x)
        return x.cast(_PHYSICAL[target])
    if {source, target} <= {Native.STRING, Native.SYMBOL}:
        return x
    if source == Native.STRING and target == Native.BYTES:
        return x.cast("binary")
    raise TypeError(f"value type mismatch: {source.name} to {target.name}")
