"""Text formats: tab-separated with and without names, JSON by row, and delimited files with a schema."""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _escaped(text: str) -> str:
    for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        text = text.replace(a, b)
    return text


def cell(value: object, quoted: bool = False) -> str:
    """A value in tab-separated text; quoted within arrays and the like."""
    if value is None:
        return "NULL" if quoted else "\\N"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)
    if isinstance(value, datetime.datetime):
        text = value.strftime("%Y-%m-%d %H:%M:%S") + (f".{value.microsecond:06d}" if value.microsecond else "")
        return f"'{text}'" if quoted else text
    if isinstance(value, decimal.Decimal):
        text = format(value, "f")
        return text.rstrip("0").rstrip(".") if "." in text else text
    if isinstance(value, tuple):
        return "(" + ",".join(cell(v, True) for v in value) + ")"
    if isinstance(value, list):
        return "[" + ",".join(cell(v, True) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{cell(k, True)}:{cell(v, True)}" for k, v in value.items()) + "}"
    text = _escaped(bytes(value).decode("utf-8", "replace") if isinstance(value, (bytes, bytearray)) else str(value))
    return "'" + text.replace("'", "\\'") + "'" if quoted else text


def tsv(df: DataFrame, names: bool = False) -> str:
    """The rows as text, for results that a person reads; `write_delimited` is for tables."""
    lines = ["\t".join(df.columns)] if names else []
    lines += ["\t".join(cell(v) for v in row) for row in df.toLocalIterator()]
    return "".join(line + "\n" for line in lines)


def json_column(df: DataFrame, quote_64: bool = False) -> Column:
    """Each row as a JSON object; quote_64 writes 64-bit integers as strings. Nulls are written."""
    shown = [F.col(f"`{f.name}`").cast("string").alias(f.name) if quote_64 and isinstance(f.dataType, T.LongType) else F.col(f"`{f.name}`") for f in df.schema]
    return F.to_json(F.struct(*shown), {"ignoreNullFields": "false"})


def json_rows(df: DataFrame, quote_64: bool = False) -> str:
    return "".join(r.j + "\n" for r in df.select(json_column(df, quote_64).alias("j")).toLocalIterator())


def rendered(df: DataFrame, shape: str | None) -> str:
    """df in an output format; TabSeparated if none is named."""
    match (shape or "TabSeparated").lower():
        case "tsv" | "tabseparated":
            return tsv(df)
        case "tsvwithnames" | "tabseparatedwithnames":
            return tsv(df, names=True)
        case "jsoneachrow":
            return json_rows(df)
        case other:
            raise ValueError(f"unknown format {other}")


def write_delimited(df: DataFrame, path: str, sep: str = "\t", header: bool = True, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("sep", sep).option("header", header).option("nullValue", "\\N").csv(path)


def write_json(df: DataFrame, path: str, quote_64: bool = False, mode: str = "errorifexists") -> None:
    df.select(json_column(df, quote_64).alias("value")).write.mode(mode).text(path)


#: Type letters of delimited files, by the first letter of what they stand for.
_LETTERS = {"B": T.BooleanType(), "H": T.ShortType(), "I": T.IntegerType(), "J": T.LongType(), "E": T.FloatType(), "F": T.DoubleType(), "S": T.StringType(), "*": T.StringType(), "D": T.DateType(), "Z": T.TimestampNTZType(), "P": T.TimestampNTZType(), "C": T.StringType()}


def read_delimited(spark: SparkSession, path: str | list[str], types: str, names: Iterable[str], sep: str = "|", header: bool = True) -> DataFrame:
    """Delimited files read by type letters; a blank letter leaves the column out. No pass to infer types."""
    fields = [(n, t) for n, t in zip(names, types)]
    schema = T.StructType([T.StructField(n, _LETTERS.get(t, T.StringType())) for n, t in fields])
    rows = spark.read.schema(schema).option("sep", sep).option("header", header).option("nullValue", "\\N").csv(path)
    return rows.select(*(n for n, t in fields if t != " "))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_parts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several Parquet folders as one table, columns by name."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


