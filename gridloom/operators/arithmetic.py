"""Element-wise arithmetic, logic, comparison and mathematics: projections, after a join by place where there are two matrices.

A scalar is a number, or a list of up to 4 lanes, one for each channel; it is saturated to the matrix's depth before the operation.
"""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.matrix import DEPTHS, KEY, Mat, aligned, lane, require, same_kind, saturate, wrapped



def _special(name: str) -> Column:
    return F.lit(float(name))


def _lanes(scalar, meta) -> Column:
    values = list(scalar) if isinstance(scalar, (list, tuple)) else [scalar] * meta.channels
    require(meta.channels <= 4 or not isinstance(scalar, (list, tuple)), "BadArg", "a scalar has 4 lanes")
    return saturate(lane([*values, *[0.0] * meta.channels], meta.channels), meta.depth)


def _pairs(a, b) -> tuple[DataFrame, Column, Column, Mat]:
    """Rows with both operands, and the matrix whose type rules."""
    if isinstance(a, Mat) and isinstance(b, Mat):
        same_kind(a, b)
        return aligned(a, b), F.col("v"), F.col("w"), a
    if isinstance(a, Mat):
        return a.px, F.col("v"), _lanes(b, a.meta), a
    return b.px, _lanes(a, b.meta), F.col("v"), b


def _apply(a, b, f) -> Mat:
    df, x, y, m = _pairs(a, b)
    return Mat(df.select(*KEY, f(x, y, m.meta).alias("v")), m.meta)


def _exact(f):
    """An integer operation: clipped for 8 and 16 bits, wrapped for 32."""

    def run(x: Column, y: Column, meta) -> Column:
        if meta.is_float:
            return f(x, y).cast(DEPTHS[meta.depth][2])
        if meta.depth in ("32S", "32U"):
            big = "decimal(19,0)"
            return wrapped(f(x.cast(big), y.cast(big)), meta.depth)
        lo, hi, kind = DEPTHS[meta.depth]
        return F.least(F.greatest(f(x.cast("bigint"), y.cast("bigint")), F.lit(lo)), F.lit(hi)).cast(kind)

    return run


def add(a, b) -> Mat:
    return _apply(a, b, _exact(lambda x, y: x + y))


def subtract(a, b) -> Mat:
    return _apply(a, b, _exact(lambda x, y: x - y))


def multiply(a, b) -> Mat:
    return _apply(a, b, _exact(lambda x, y: x * y))


def _divided(x: Column, y: Column) -> Column:
    """IEEE division of doubles, which ANSI mode refuses by zero."""
    x, y = x.cast("double"), y.cast("double")
    return F.when(y != 0, x / F.when(y != 0, y)).when(F.isnan(x) | F.isnan(y) | (x == 0), _special("nan")).when(x > 0, _special("inf")).otherwise(_special("-inf"))


def divide(a, b) -> Mat:
    """Integers and 16F: 0 where the divisor is 0; other floats as IEEE has it."""

    def run(x, y, meta):
        q = _divided(x, y)
        if meta.depth in ("32F", "64F"):
            return q.cast(DEPTHS[meta.depth][2])
        return F.when(y == 0, F.lit(0).cast(DEPTHS[meta.depth][2])).otherwise(saturate(q, meta.depth))

    return _apply(a, b, run)


def add_weighted(a: Mat, alpha: float, b: Mat, beta: float) -> Mat:
    return _apply(a, b, lambda x, y, m: saturate(x.cast("double") * alpha + y.cast("double") * beta, m.depth))


def scale_add(a: Mat, alpha: float, b: Mat) -> Mat:
    return _apply(a, b, lambda x, y, m: saturate(x.cast("double") * alpha + y.cast("double"), m.depth))


def _holds(op: str, x: Column, y: Column) -> Column:
    x, y = x.cast("double"), y.cast("double")
    known = ~(F.isnan(x) | F.isnan(y))
    test = {"EQ": x == y, "GT": x > y, "GE": x >= y, "LT": x < y, "LE": x <= y, "NE": x != y}[op]
    return (known & test) if op != "NE" else (~known | test)


def compare(a, b, op: str) -> Mat:
    """255 where the relation holds, else 0, for each channel."""
    require(op in ("EQ", "GT", "GE", "LT", "LE", "NE"), "BadArg", f"no comparison {op}")
    if isinstance(a, Mat) and isinstance(b, Mat):
        require(a.meta.depth != "16F", "NotImplemented", "two matrices of 16F")
    out = _apply(a, b, lambda x, y, m: F.when(_holds(op, x, y), 255).otherwise(0))
    return Mat(out.px, replace(out.meta, depth="8U"))


def absdiff(a, b) -> Mat:
    def run(x, y, meta):
        if meta.depth == "32S":
            d = x.cast("bigint") - y.cast("bigint")
            return wrapped(F.abs(d), "32S")
        return F.abs(x.cast("double") - y.cast("double")).cast(DEPTHS[meta.depth][2]) if meta.is_float else saturate(F.abs(x - y), meta.depth)

    return _apply(a, b, run)


def _first_nan(x: Column, y: Column, meta, best: Column) -> Column:
    if not meta.is_float:
        return best
    if meta.depth == "64F":
        return F.when(F.isnan(x), y).when(F.isnan(y), x).otherwise(best)
    return F.when(F.isnan(x), x).when(F.isnan(y), y).otherwise(best)


def minimum(a, b) -> Mat:
    return _apply(a, b, lambda x, y, m: _first_nan(x, y, m, F.least(x, y)))


def maximum(a, b) -> Mat:
    return _apply(a, b, lambda x, y, m: _first_nan(x, y, m, F.greatest(x, y)))


def _bits(a, b, f, mask: Mat | None) -> Mat:
    m = a if isinstance(a, Mat) else b
    require(not m.meta.is_float, "NotImplemented", "floats by bit pattern: see packed.bitwise")
    out = _apply(a, b, lambda x, y, meta: f(x, y, meta).cast(DEPTHS[meta.depth][2]))
    return masked(out, mask) if mask else out


def masked(m: Mat, mask: Mat, old: Mat | None = None) -> Mat:
    """m where the mask (8U, one channel) is not 0; elsewhere the old matrix, or 0."""
    require(mask.meta.shape == m.meta.shape and (mask.meta.depth, mask.meta.channels) == ("8U", 1), "BadMask", "a mask is 8U, of one channel, of the same size")
    df = m.px.join(mask.px.select("mat_id", "y", "x", F.col("v").alias("mask")), ["mat_id", "y", "x"])
    if old is not None:
        df = df.join(old.px.select(*KEY, F.col("v").alias("old")), KEY)
    other = F.col("old") if old is not None else F.lit(0).cast(DEPTHS[m.meta.depth][2])
    return Mat(df.select(*KEY, F.when(F.col("mask") != 0, F.col("v")).otherwise(other).alias("v")), m.meta)


def bitwise_and(a, b, mask: Mat | None = None) -> Mat:
    return _bits(a, b, lambda x, y, m: x.bitwiseAND(y), mask)


def bitwise_or(a, b, mask: Mat | None = None) -> Mat:
    return _bits(a, b, lambda x, y, m: x.bitwiseOR(y), mask)


def bitwise_xor(a, b, mask: Mat | None = None) -> Mat:
    return _bits(a, b, lambda x, y, m: x.bitwiseXOR(y), mask)


def bitwise_not(a: Mat, mask: Mat | None = None) -> Mat:
    require(not a.meta.is_float, "NotImplemented", "floats by bit pattern: see packed.bitwise")
    lo, hi, kind = DEPTHS[a.meta.depth]
    out = Mat(a.px.select(*KEY, (F.lit(hi + lo) - F.col("v")).cast(kind).alias("v")), a.meta)
    return masked(out, mask) if mask else out


def in_range(a: Mat, lower, upper) -> Mat:
    """255 where all channels lie within the bounds, inclusive. Bounds of integers are not rounded."""
    if isinstance(lower, Mat):
        df, lo, hi = aligned(a, lower, upper), F.col("w"), F.col("w2")
    else:
        spread = lambda s: list(s) if isinstance(s, (list, tuple)) else [s] * a.meta.channels
        df, lo, hi = a.px, lane(spread(lower), a.meta.channels), lane(spread(upper), a.meta.channels)
        if a.meta.depth == "32F":
            lo, hi = lo.cast("float"), hi.cast("float")
    ok = _holds("GE", F.col("v"), lo) & _holds("LE", F.col("v"), hi)
    out = df.groupBy("mat_id", "y", "x").agg(F.when(F.bool_and(ok), 255).otherwise(0).alias("v")).select("mat_id", "y", "x", F.lit(0).alias("c"), "v")
    return Mat(out, replace(a.meta, depth="8U", channels=1))


def _mod(x: Column, y: Column) -> Column:
    """The sign of the divisor; 0 by 0."""
    safe = F.when(y != 0, y)
    return F.coalesce((x % safe + safe) % safe, F.lit(0))


def _fmod(x: Column, y: Column) -> Column:
    """The sign of the dividend; 0 by 0."""
    return F.coalesce(x % F.when(y != 0, y), F.lit(0))


def _shift(x: Column, y: Column, meta) -> Column:
    """Left by a positive count, right (logically) by a negative one; all bits out by the width or more."""
    lo, hi, kind = DEPTHS[meta.depth]
    span = hi - lo + 1
    width = span.bit_length() - 1
    bits = F.pmod(x.cast("bigint"), F.lit(span))
    power = lambda n: F.pow(F.lit(2.0), F.least(n, F.lit(width)).cast("double")).cast("bigint")
    left = F.pmod(bits.cast("decimal(38,0)") * power(y).cast("decimal(38,0)"), F.lit(span).cast("decimal(38,0)")).cast("bigint")
    right = F.floor(bits / power(-y)).cast("bigint")
    moved = F.when(F.abs(y) >= width, F.lit(0)).when(y > 0, left).otherwise(right)
    return (F.pmod(moved - lo, F.lit(span)) + lo).cast(kind)


def binary(op: str, a, b) -> Mat:
    """The operations by name; those that are not known, or not for the depth, raise NotImplemented."""
    m = a if isinstance(a, Mat) else b
    plain = {"ADD": add, "SUM": add, "SUB": subtract, "MUL": multiply, "DIV": divide, "MAX": maximum, "MIN": minimum}
    integral = {"AND": bitwise_and, "OR": bitwise_or, "XOR": bitwise_xor, "NOT": lambda a, b: _bits(a, b, lambda x, y, t: x.bitwiseAND(F.bitwise_not(y)), None)}
    if op in plain:
        return plain[op](a, b)
    if op in ("EQ", "GT", "GE", "LT", "LE"):
        return compare(a, b, op)
    if op in integral:
        require(not m.meta.is_float, "NotImplemented", f"{op} of floats")
        return integral[op](a, b)
    if op in ("MOD", "BITSHIFT"):
        require(not m.meta.is_float, "NotImplemented", f"{op} of floats")
        return _apply(a, b, lambda x, y, t: _mod(x, y).cast(DEPTHS[t.depth][2]) if op == "MOD" else _shift(x, y, t))
    double = {
        "FMOD": _fmod, "POW": F.pow, "ATAN2": F.atan2, "HYPOT": F.hypot, "MEAN": lambda x, y: (x + y) * 0.5,
    }
    require(op in double, "NotImplemented", f"no operation {op}")
    return _apply(a, b, lambda x, y, t: saturate(double[op](x.cast("double"), y.cast("double")), t.depth))


def convert_scale_abs(a: Mat, alpha: float = 1.0, beta: float = 0.0) -> Mat:
    """|v * alpha + beta| as 8U, halves to even; NaN is 0."""
    x = F.abs(F.col("v").cast("double") * alpha + beta)
    return Mat(a.px.select(*KEY, saturate(x, "8U", even=True).alias("v")), replace(a.meta, depth="8U"))


def _float_math(a: Mat, f) -> Mat:
    require(a.meta.depth in ("32F", "64F"), "UnsupportedFormat", "32F or 64F only")
    return a.with_v(f(F.col("v").cast("double")), sat=False)


def sqrt(a: Mat) -> Mat:
    return _float_math(a, F.sqrt)


def power(a: Mat, p: float) -> Mat:
    return _float_math(a, lambda v: F.pow(v, F.lit(float(p))))


def exp(a: Mat) -> Mat:
    return _float_math(a, F.exp)


def log(a: Mat) -> Mat:
    """0: minus infinity; below: NaN."""
    return _float_math(a, lambda v: F.when(v > 0, F.ln(v)).when(v == 0, _special("-inf")).otherwise(_special("nan")))


def check_range(a: Mat, low: float = -math.inf, high: float = math.inf, quiet: bool = True) -> DataFrame:
    """For each matrix: ok, and the first bad place by rows (x, y; -1 if none). The upper bound is exclusive."""
    v = F.col("v").cast("double")
    finite = ~F.isnan(v) & (F.abs(v) != _special("inf"))
    bad = ~finite | (v < low) | (v >= high) if low < high else F.lit(True)
    out = a.px.groupBy("mat_id").agg(F.min(F.when(bad, F.struct("y", "x"))).alias("p"))
    out = out.select("mat_id", F.col("p").isNull().alias("ok"), F.coalesce("p.x", F.lit(-1)).alias("x"), F.coalesce("p.y", F.lit(-1)).alias("y"))
    return out if quiet else out.withColumn("ok", F.when(F.col("ok"), True).otherwise(F.raise_error(F.lit("OutOfRange: a value is out of range")).cast("boolean")))


def patch_nans(a: Mat, value: float = 0.0) -> Mat:
    require(a.meta.depth == "32F", "UnsupportedFormat", "32F only")
    return a.with_v(F.nanvl(F.col("v"), F.lit(float(value)).cast("float")), sat=False)
