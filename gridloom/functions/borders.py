"""Border rules as Column expressions, and padding."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.matrix import KEY, Mat, lane, require, saturate

MODES = ("CONSTANT", "REPLICATE", "REFLECT", "REFLECT_101", "WRAP")


def border(p: Column, n: int, mode: str) -> Column:
    """The place inside 0 .. n - 1 that stands for place p; -1 for CONSTANT outside."""
    require(mode in MODES, "BadArg", f"no border {mode}")
    require(n > 0, "BadSize", "an empty axis has no border")
    if mode == "CONSTANT":
        return F.when((p >= 0) & (p < n), p).otherwise(-1)
    if mode == "REPLICATE":
        return F.least(F.greatest(p, F.lit(0)), F.lit(n - 1))
    if mode == "WRAP":
        return F.pmod(p, F.lit(n))
    if n == 1:
        return p * 0
    period = 2 * n if mode == "REFLECT" else 2 * n - 2
    q = F.pmod(p, F.lit(period))
    return F.least(q, F.lit(period - (1 if mode == "REFLECT" else 0)) - q)


def _axis(m: Mat, before: int, after: int, n: int, mode: str, name: str):
    """(place outside and inside, place inside that it shows): a table as long as the axis."""
    p = F.col("id").cast("int")
    return F.broadcast(m.spark.range(-before, n + after).select(p.alias("q"), border(p, n, mode).cast("int").alias(name)))


def pad(m: Mat, top: int, bottom: int, left: int, right: int, mode: str = "REFLECT_101", value=0, shift: bool = True) -> Mat:
    """A frame around each matrix. Without shift the coordinates stay, and those of the frame are negative or beyond the size."""
    require(min(top, bottom, left, right) >= 0, "BadArg", "a frame can't be negative")
    meta = m.meta
    rows = meta.rows + top + bottom
    cols = meta.cols + left + right
    if mode == "CONSTANT":
        lanes = list(value) if isinstance(value, (list, tuple)) else [value] * meta.channels
        span = lambda lo, hi: F.sequence(F.lit(lo), F.lit(hi)) if hi >= lo else F.array().cast("array<int>")
        sides = F.concat(span(-left, -1), span(meta.cols, meta.cols + right - 1))
        frame = m.px.select("mat_id").distinct().withColumn("y", F.explode(span(-top, meta.rows + bottom - 1)))
        frame = frame.withColumn("x", F.explode(F.when(F.col("y").between(0, meta.rows - 1), sides).otherwise(span(-left, meta.cols + right - 1))))
        frame = frame.withColumn("c", F.explode(span(0, meta.channels - 1))).withColumn("v", saturate(lane(lanes, meta.channels), meta.depth))
        px = m.px.unionByName(frame)
    else:
        ys, xs = _axis(m, top, bottom, meta.rows, mode, "y"), _axis(m, left, right, meta.cols, mode, "x")
        px = m.px.join(ys, "y").drop("y").withColumnRenamed("q", "y").join(xs, "x").drop("x").withColumnRenamed("q", "x").select(*KEY, "v")
    if shift:
        px = px.select("mat_id", (F.col("y") + top).alias("y"), (F.col("x") + left).alias("x"), "c", "v")
    return Mat(px, replace(meta, rows=rows, cols=cols))
