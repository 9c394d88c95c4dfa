"""Scalar functions as Column expressions, all inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_NEXT, _SPAN = 6364136223846793005, 1 << 64
SEED = 0x123456789ABCDEF0


def xbar(width: float | int, x: Column) -> Column:
    """x rounded down to a multiple of width."""
    return F.floor(x / F.lit(width)) * F.lit(width)


def div(x: Column, y: Column | float) -> Column:
    return F.floor(x / y)


def yyyymm(ts: Column) -> Column:
    return (F.year(ts) * 100 + F.month(ts)).cast("int")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def after_micros(ts: Column, n: Column) -> Column:
    return F.timestamp_micros(micros(ts) + n).cast("timestamp_ntz")


def json_string(text: Column, key: str) -> Column:
    """The value of a key, empty if there is none."""
    return F.coalesce(F.get_json_object(text, f"$.{key}"), F.lit(""))


def lcg_index(step: Column, length: int, seed: int = SEED) -> Column:
    """A pseudo-random position below length for each step: the upper bits of a linear congruential generator
    modulo 2**64, in decimal arithmetic because 64-bit integers would overflow."""
    wide = F.lit(str(seed)).cast("decimal(38,0)") + F.lit(str(_NEXT)).cast("decimal(19,0)") * step.cast("decimal(10,0)")
    return F.floor(F.pmod(wide, F.lit(str(_SPAN)).cast("decimal(20,0)")) / F.lit(1 << 33)).cast("bigint") % length


def transform(x: Column, times: int = 1) -> Column:
    for _ in range(times):
        x = x * 1.0001 + 0.1
    return x


def normal_cdf(x: Column) -> Column:
    """Distribution function of the standard normal by a fifth-degree polynomial, to 7 digits."""
    a = F.abs(x)
    t = 1 / (1 + 0.2316419 * a)
    tail = (F.exp(-0.5 * a * a) / math.sqrt(2 * math.pi)) * t * (0.31938153 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(x < 0, tail).otherwise(1 - tail)


def normal_inverse(p: Column) -> Column:
    """Inverse of the standard normal distribution function by a rational approximation, to 4.5e-4."""
    tail = F.when(p < 0.5, p).otherwise(1 - p)
    t = F.sqrt(-2 * F.log(tail))
    z = t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))
    return F.when(p < 0.5, -z).otherwise(z)


def normal_sample(seed: int) -> Column:
    """Standard normal numbers by the Box-Muller transform of two uniform ones."""
    return F.sqrt(-2 * F.log(1 - F.rand(seed))) * F.cos(2 * math.pi * F.rand(seed + 1))


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def hex_digit_sum(x: Column) -> Column:
    """Sum of the hexadecimal digits of a whole number."""
    digits = F.filter(F.split(F.hex(x), ""), lambda d: d != "")
    return F.aggregate(F.transform(digits, lambda d: F.conv(d, 16, 10).cast("bigint")), F.lit(0).cast("bigint"), lambda a, b: a + b)


def reversed_lines(text: Column) -> Column:
    return F.array_join(F.reverse(F.split(text, "\n")), "\n")
