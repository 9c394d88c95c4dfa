"""Pipelines of steps, one to a line or between bars: from, filter, select, derive, sort, take.

from, filter and select make up the strict subset, with its comparison rules; the other steps are Spark's.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..types import split_top
from .parser import Reader, SqlError
from .predicate import Mode, compiled


def steps(text: str) -> list[tuple[str, str]]:
    parts = [p.strip() for line in re.sub(r"#[^\n]*", "", text).split("\n") for p in _bars(line)]
    out = []
    for p in filter(None, parts):
        verb, _, rest = p.partition(" ")
        out.append((verb, rest.strip()))
    if not out or out[0][0] != "from" or not out[0][1]:
        raise SqlError("PRQL: a pipeline begins with from")
    for verb, rest in out:
        if verb not in ("from", "filter", "select", "derive", "sort", "take") or not rest:
            raise SqlError(f"PRQL: can't read the step {verb} {rest}".rstrip())
    if sum(v == "from" for v, _ in out) != 1:
        raise SqlError("PRQL: exactly one from is expected")
    return out


def _bars(line: str) -> list[str]:
    return split_top(line.replace("||", "\0"), "|") and [p.replace("\0", "||") for p in split_top(line.replace("||", "\0"), "|")]


def _items(text: str) -> list[str]:
    return split_top(text[1:-1] if text.startswith("{") and text.endswith("}") else text)


def run(text: str, table: Callable[[str], DataFrame], suspect: Callable[[str], set[str] | None] = lambda _: None) -> DataFrame:
    """The pipeline over tables that `table` finds by name."""
    df, doubts = None, None
    for verb, rest in steps(text):
        if verb == "from":
            df, doubts = table(rest.strip("`")), suspect(rest.strip("`"))
            continue
        assert df is not None
        if verb == "filter":
            try:
                r = Reader(re.sub(r'"([^"]*)"', lambda m: "'" + m.group(1).replace("'", "''") + "'", rest))
                e = r.predicate()
            except SqlError as error:
                raise SqlError(f"PRQL: {error}") from None
            if not r.done:
                raise SqlError(f"PRQL: can't read {rest}")
            df = df.where(compiled(e, df.schema, Mode.SELECT, doubts))
        elif verb in ("select", "derive"):
            named = [(m.group(1), m.group(2)) if (m := re.match(r"(\w+)\s*=(?!=)\s*(.+)", i, re.S)) else (i, i) for i in _items(rest)]
            if len({n.lower() for n, _ in named}) < len(named):
                raise SqlError("PRQL: duplicate column")
            columns = [F.expr(e).alias(n) for n, e in named]
            df = df.select(*columns) if verb == "select" else df.select("*", *columns)
        elif verb == "sort":
            df = df.orderBy(*(F.col(i.lstrip("-+").strip()).desc() if i.startswith("-") else F.col(i.lstrip("+").strip()).asc() for i in _items(rest)))
        else:
            if not (m := re.fullmatch(r"(?:(\d+)\.\.)?(\d+)", rest)):
                raise SqlError(f"PRQL: can't take {rest}")
            first = int(m.group(1) or 1)
            df = df.offset(first - 1).limit(int(m.group(2)) - first + 1)
    assert df is not None
    return df
