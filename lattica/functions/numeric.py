"""Array semantics as Column expressions: NaN, division, rounding and casts.

Spark's own rules differ from those of float arrays (NaN equals itself and is
the greatest value, integer division truncates, casts raise); everything that
depends on this is here.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Logical dtype -> Spark type; unsigned types are held one size up.
SPARK_TYPES = {
    "bool": "boolean", "float32": "float", "float64": "double", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint",
    "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)",
}
BITS = {"int8": 8, "int16": 16, "int32": 32, "int64": 64, "uint8": 8, "uint16": 16, "uint32": 32, "uint64": 64}


def either_nan(a: Column, b: Column) -> Column:
    return F.isnan(a.cast("double")) | F.isnan(b.cast("double"))


def compare(op: str, a: Column, b: Column) -> Column:
    """<, <=, >, >=, ==, != in which NaN is unlike everything."""
    test = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq, "!=": operator.eq}[op]
    ordered = ~either_nan(a, b) & test(a, b)
    return ~ordered if op == "!=" else ordered


def divide(a: Column, b: Column) -> Column:
    """Float division: x / 0 is an infinity, 0 / 0 is NaN."""
    a, b = a.cast("double"), b.cast("double")
    at_zero = F.when((a == 0) | F.isnan(a), F.lit(math.nan)).when(a > 0, F.lit(math.inf)).otherwise(F.lit(-math.inf))
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def floor_divide(a: Column, b: Column) -> Column:
    """Rounds towards minus infinity, as doubles."""
    return F.floor(divide(a, b)).cast("double")


def modulo(a: Column, b: Column) -> Column:
    """The remainder that has the sign of b."""
    return a.cast("double") - b.cast("double") * floor_divide(a, b)


def power(a: Column, b: Column) -> Column:
    return F.pow(a.cast("double"), b.cast("double"))


def round_half_even(a: Column, digits: int = 0) -> Column:
    return F.when(F.isnan(a) | (F.abs(a) >= 1e15), a).otherwise(F.bround(a.cast("decimal(38,15)"), digits).cast("double"))


def clip(a: Column, low: Column | None, high: Column | None) -> Column:
    """NaN stays NaN."""
    if low is None and high is None:
        raise ValueError("clip needs a bound")
    out = a
    if low is not None:
        out = F.when(out < low, low).otherwise(out)
    if high is not None:
        out = F.when(~F.isnan(out.cast("double")) & (out > high), high).otherwise(out)
    return out


def replace_beyond(a: Column, low: Column | None, high: Column | None) -> Column:
    """Values that aren't within a bound become that bound; so does NaN."""
    out = a
    if low is not None:
        out = F.when(compare(">=", out, low), out).otherwise(low)
    if high is not None:
        out = F.when(compare("<=", out, high), out).otherwise(high)
    return out


def as_dtype(a: Column, source: str, target: str) -> Column:
    """An array cast: floats are truncated, integers wrap; floats beyond 64 bits and NaN raise where an integer is asked for."""
    kind = SPARK_TYPES[target]
    if target == "bool":
        return a != F.lit(False) if source == "bool" else a.cast("double") != 0
    if target.startswith("float"):
        return a.cast("double").cast(kind)
    if source == "bool":
        return a.cast("int").cast(kind)
    whole = F.when(a >= 0, F.floor(a)).otherwise(F.ceil(a)) if source.startswith("float") else a
    if target == "int64" and source != "uint64":
        return whole.cast("bigint")
    size = 1 << BITS[target]
    wide = whole.cast("decimal(38,0)")
    wrapped = F.pmod(wide, F.lit(str(size)).cast("decimal(38,0)"))
    if not target.startswith("u"):
        half = F.lit(str(size // 2)).cast("decimal(38,0)")
        wrapped = F.when(wrapped >= half, wrapped - F.lit(str(size)).cast("decimal(38,0)")).otherwise(wrapped)
    return wrapped.cast(kind)


def widened(a: Column, dtype: str) -> Column:
    """An integer with room for its sums; products of up to 16 bits fit as well, others go through product()."""
    return a.cast("int").cast("decimal(38,0)" if BITS[dtype] == 64 else "bigint") if dtype == "bool" else a.cast("decimal(38,0)" if BITS[dtype] == 64 else "bigint")


def holds(dtype: str, value: int) -> bool:
    """Whether an integer dtype (or bool) holds a number."""
    if dtype == "bool":
        return value in (0, 1)
    low = 0 if dtype.startswith("u") else -(1 << BITS[dtype] - 1)
    return low <= value < low + (1 << BITS[dtype])


def wrapped(a: Column, dtype: str) -> Column:
    """An integer (a bigint, or a decimal for 64-bit types) as the type holds it: modulo two to its bits."""
    if BITS[dtype] == 64:
        return as_dtype(a, "uint64", dtype)
    size = 1 << BITS[dtype]
    if dtype.startswith("u"):
        return F.pmod(a, F.lit(size)).cast(SPARK_TYPES[dtype])
    return (F.pmod(a + size // 2, F.lit(size)) - size // 2).cast(SPARK_TYPES[dtype])


def product(a: Column, b: Column, dtype: str) -> Column:
    """a * b, wrapped. Of wide factors, a goes in two halves, so that no step exceeds its type."""
    if BITS[dtype] <= 16 or dtype == "int32":
        return wrapped(widened(a, dtype) * widened(b, dtype), dtype)
    big = lambda x: x.cast("decimal(38,0)")
    whole, half = F.lit(str(1 << BITS[dtype])).cast("decimal(38,0)"), F.lit(str(1 << 32)).cast("decimal(38,0)")
    x, y = F.pmod(big(a), whole), F.pmod(big(b), whole)
    low = F.pmod(x, half)
    high = F.floor((x - low) / half).cast("decimal(38,0)")
    # Both halves stay below 2 ** 97.
    upper = F.pmod((high.cast("decimal(11,0)") * y.cast("decimal(21,0)")).cast("decimal(38,0)"), whole)
    total = (F.pmod(upper, half) * half + low.cast("decimal(11,0)") * y.cast("decimal(21,0)")).cast("decimal(38,0)")
    return as_dtype(F.pmod(total, whole), "uint64", dtype)


def floor_parts(a: Column, b: Column, dtype: str) -> tuple[Column, Column]:
    """(a // b, a % b) of integers, rounding towards minus infinity, wrapped; both are 0 where b is 0."""
    a, b = widened(a, dtype), F.nullif(widened(b, dtype), F.lit(0))
    rest = (a % b + b) % b
    exact = F.floor((a - rest) / b) if BITS[dtype] == 64 else F.call_function("div", a - rest, b)
    kind = "decimal(38,0)" if BITS[dtype] == 64 else "bigint"
    return tuple(wrapped(F.coalesce(x.cast(kind), F.lit(0).cast(kind)), dtype) for x in (exact, rest))  # type: ignore[return-value]


def whole_power(a: Column, b: Column, dtype: str) -> Column:
    """a ** b of integers, wrapped, by squaring; a negative exponent fails the query."""
    kind = SPARK_TYPES[dtype]
    bits = F.sequence(F.lit(0), F.lit(BITS[dtype] - 1))
    start = F.struct(F.lit(1).cast(kind).alias("r"), a.cast(kind).alias("s"), b.cast("decimal(38,0)").alias("e"))

    def step(state: Column, _: Column) -> Column:
        odd = F.pmod(state["e"], F.lit(2)) == 1
        rest = F.floor(state["e"] / 2).cast("decimal(38,0)")
        return F.struct(
            F.when(odd, product(state["r"], state["s"], dtype)).otherwise(state["r"]).alias("r"),
            F.when(rest > 0, product(state["s"], state["s"], dtype)).otherwise(state["s"]).alias("s"), rest.alias("e"),
        )

    found = F.aggregate(bits, start, step, lambda state: state["r"])
    return F.when(b < 0, F.raise_error(F.lit("integers to negative integer powers")).cast(kind)).otherwise(found)


def present(a: Column) -> Column:
    """The value, or null where it is NaN: statistics skip NaN."""
    return F.nanvl(a.cast("double"), F.lit(None).cast("double"))


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str], others: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """left joined to right by columns that both have, which come once; in `keys`, null meets null."""
    renamed = right.withColumnsRenamed({k: f"_same_{k}" for k in keys}).withColumnsRenamed({c: f"_same_{c}" for c in others})
    tests = [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys] + [F.col(c) == F.col(f"_same_{c}") for c in others]
    condition = tests[0]
    for test in tests[1:]:
        condition = condition & test
    return left.join(renamed, condition, how).drop(*(f"_same_{c}" for c in (*keys, *others)))
