"""Predicates with two-valued logic as Column expressions.

Nulls are values: null = null holds, and != is exactly the opposite of =. Equality of values of different types
is false, never a coercion. Doubles are equal by their bits: NaN equals itself, 0.0 isn't -0.0. An ordering of
nulls, NaNs or different types is an error, which a query and an update raise and a delete takes as false. In
queries both sides of AND and OR are evaluated, in updates and deletes the right side only where it decides.

A node that can't fail compiles to a plain comparison, so that it still reaches the scan: columns are taken to
hold nulls or NaNs only if the schema allows nulls, or, where `suspect` is given, if it names them.
"""

from __future__ import annotations

import enum
from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import Native, native_of, of_value

ERROR = "values not comparable"


class Mode(enum.Enum):
    SELECT = "select"
    UPDATE = "update"
    DELETE = "delete"


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Compare:
    op: str
    left: "Expr"
    right: "Expr"


@dataclass(frozen=True)
class And:
    left: "Expr"
    right: "Expr"


@dataclass(frozen=True)
class Or:
    left: "Expr"
    right: "Expr"


@dataclass(frozen=True)
class Not:
    inner: "Expr"


Expr = Name | Literal | Compare | And | Or | Not


@dataclass(frozen=True)
class _Value:
    column: Column
    kind: Native
    null: bool  # it may be null
    always_null: bool = False
    nan: bool = False


class _Compiler:
    def __init__(self, schema: T.StructType, mode: Mode, suspect: Collection[str] | None) -> None:
        self.fields = {f.name.lower(): f for f in schema}
        self.mode = mode
        self.suspect = None if suspect is None else {c.lower() for c in suspect}

    def value(self, e: Expr) -> _Value:
        if isinstance(e, Name):
            f = self.fields.get(e.name.lower())
            if f is None:
                raise ValueError(f"unknown column {e.name}")
            kind = native_of(f.dataType)
            if kind is None:
                raise TypeError(f"column {e.name} can't be compared")
            doubtful = self.suspect is None or f.name.lower() in self.suspect
            return _Value(F.col("`" + f.name + "`"), kind, doubtful and f.nullable, nan=doubtful and kind == Native.F64)
        if isinstance(e, Literal):
            nan = isinstance(e.value, float) and e.value != e.value
            return _Value(F.lit(e.value), of_value(e.value), e.value is None, e.value is None, nan)
        raise TypeError("a comparison can't be compared")

    def same_kind(self, a: _Value, b: _Value) -> bool:
        text = {Native.STRING, Native.SYMBOL}
        return a.kind == b.kind or {a.kind, b.kind} <= text

    def equal(self, left: Expr, right: Expr) -> tuple[Column, bool]:
        if self.mode is not Mode.SELECT and any(isinstance(x, (Compare, And, Or, Not)) for x in (left, right)):
            sides = []
            for x in (left, right):
                if isinstance(x, Literal) and isinstance(x.value, bool):
                    sides.append((F.lit(x.value), False))
                elif isinstance(x, (Name, Literal)):
                    raise TypeError("did not resolve to bool")
                else:
                    sides.append(self.test(x))
            (a, fa), (b, fb) = sides
            return a == b, fa or fb  # null stands for an error and stays
        a, b = self.value(left), self.value(right)
        if a.always_null and b.always_null:
            return F.lit(True), False
        if a.always_null or b.always_null:
            return (b if a.always_null else a).column.isNull(), False
        if not self.same_kind(a, b):
            return (a.column.isNull() & b.column.isNull()) if a.null and b.null else F.lit(False), False
        if a.kind == Native.F64:
            if isinstance(left, Literal) or isinstance(right, Literal):
                value, side = (left.value, b) if isinstance(left, Literal) else (right.value, a)  # type: ignore[union-attr]
                if value != 0:  # no zero on one side: values decide
                    return a.column.eqNullSafe(b.column), False
                # Not as a conjunction with =, in which the optimizer would put the literal for the column.
                return side.column.cast("string").eqNullSafe(F.lit(repr(value))), False
            zeros = (a.column != 0) | (a.column.cast("string") == b.column.cast("string"))
            return a.column.eqNullSafe(b.column) & F.coalesce(zeros, F.lit(True)), False
        return a.column.eqNullSafe(b.column), False

    def ordered(self, op: str, left: Expr, right: Expr) -> tuple[Column, bool]:
        a, b = self.value(left), self.value(right)
        wrong = F.lit(None).cast("boolean")
        if a.always_null or b.always_null or not self.same_kind(a, b):
            return wrong, True
        result = {"<": a.column < b.column, "<=": a.column <= b.column, ">": a.column > b.column, ">=": a.column >= b.column}[op]
        numbers = [~F.isnan(x.column) for x in (a, b) if x.nan]
        if numbers:
            return F.when(numbers[0] if len(numbers) == 1 else numbers[0] & numbers[1], result), True
        return result, a.null or b.null  # null of itself where a side is null

    def test(self, e: Expr) -> tuple[Column, bool]:
        """The test, null where it fails with an error, and whether it ever may."""
        if isinstance(e, Compare):
            if e.op == "=":
                return self.equal(e.left, e.right)
            if e.op in ("!=", "<>"):
                c, fails = self.equal(e.left, e.right)
                return ~c, fails
            return self.ordered(e.op, e.left, e.right)
        if isinstance(e, Not):
            c, fails = self.test(e.inner)
            return ~c, fails
        if isinstance(e, (And, Or)):
            (a, fa), (b, fb) = self.test(e.left), self.test(e.right)
            both = a & b if isinstance(e, And) else a | b
            if not (fa or fb):
                return both, False
            if self.mode is Mode.SELECT:
                return F.when(a.isNotNull() & b.isNotNull(), both), True
            decides = ~a if isinstance(e, And) else a
            return F.when(a.isNull(), None).when(decides, F.lit(isinstance(e, Or))).otherwise(b), True
        if isinstance(e, Literal) and isinstance(e.value, bool) and self.mode is not Mode.SELECT:
            return F.lit(e.value), False
        raise TypeError("the filter did not resolve to bool")


def compiled(e: Expr, schema: T.StructType, mode: Mode = Mode.SELECT, suspect: Collection[str] | None = None) -> Column:
    """The Column that filters (or selects rows to change) by e on rows of this schema."""
    column, fails = _Compiler(schema, mode, suspect).test(e)
    if not fails:
        return column
    if mode is Mode.DELETE:
        return F.coalesce(column, F.lit(False))
    return F.when(column.isNull(), F.raise_error(F.lit(ERROR)).cast("boolean")).otherwise(column)
