"""Image pyramids: a 5 x 5 binomial kernel at every second place, or between zeros."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from gridloom.functions.borders import border as border_of
from gridloom.matrix import Mat, require, saturate
from gridloom.operators.filters import framed, scattered, taps_of

BINOMIAL = np.outer([1, 4, 6, 4, 1], [1, 4, 6, 4, 1])


def pyr_down(m: Mat, border: str = "REFLECT_101") -> Mat:
    require(border != "CONSTANT", "BadArg", "no constant border")
    rows, cols = (m.meta.rows + 1) // 2, (m.meta.cols + 1) // 2
    taps = taps_of(BINOMIAL)
    sent = scattered(framed(m, taps, border), taps).where("oy % 2 = 0 and ox % 2 = 0").where(F.col("oy").between(0, 2 * rows - 2) & F.col("ox").between(0, 2 * cols - 2))
    out = sent.groupBy("mat_id", (F.col("oy") / 2).cast("int").alias("y_"), (F.col("ox") / 2).cast("int").alias("x_"), "c").agg(F.sum(F.col("w") * F.col("v")).alias("v"))
    return Mat(out.select("mat_id", F.col("y_").alias("y"), F.col("x_").alias("x"), "c", saturate(F.col("v") / 256, m.meta.depth, even=True).alias("v")), replace(m.meta, rows=rows, cols=cols))


def pyr_up(m: Mat) -> Mat:
    """Twice the size. For each axis a table says which places a row (or column) adds to, and by what weight."""
    spark = m.spark

    def axis(n: int, name: str):
        k = spark.range(2 * n).select(F.col("id").cast("int").alias(f"o{name}"), F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.lit(w).alias("w")) for q, w in zip(range(-2, 3), (1.0, 4.0, 6.0, 4.0, 1.0), strict=True)])).alias("t"))
        k = k.withColumn("e", border_of(F.col(f"o{name}") + F.col("t.q"), 2 * n, "REFLECT_101")).where("e % 2 = 0")
        return F.broadcast(k.groupBy(f"o{name}", (F.col("e") / 2).cast("int").alias(name)).agg(F.sum("t.w").alias(f"w{name}")))

    sent = m.px.join(axis(m.meta.rows, "y"), "y").join(axis(m.meta.cols, "x"), "x")
    out = sent.groupBy("mat_id", "oy", "ox", "c").agg(F.sum(F.col("wy") * F.col("wx") * F.col("v")).alias("v"))
    px = out.select("mat_id", F.col("oy").alias("y"), F.col("ox").alias("x"), "c", saturate(F.col("v") / 64, m.meta.depth, even=True).alias("v"))
    return Mat(px, replace(m.meta, rows=2 * m.meta.rows, cols=2 * m.meta.cols))


def build_pyramid(m: Mat, levels: int, border: str = "REFLECT_101") -> list[Mat]:
    out = [m.clone()]
    for _ in range(levels):
        out.append(pyr_down(out[-1], border))
    return out
