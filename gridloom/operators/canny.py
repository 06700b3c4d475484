"""Edges: derivatives, thinning across the gradient, and growth of strong edges over weak ones."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridloom.matrix import KEY, Mat, aligned, require, same_kind
from gridloom.operators.filters import scattered, sobel
from gridloom.shipping import ship


def _grown(table: pa.Table) -> pa.Table:
    """Of one matrix's thinned weak pixels, those whose 8-connected component holds a strong one."""
    y, x, strong = (table[c].to_numpy() for c in ("y", "x", "strong"))
    # places as sorted numbers; a front of them moves on, and each place is in it once
    wide = np.int64(x.max()) + 3
    order = np.argsort(key := y * wide + x)
    key, seen = key[order], strong[order].astype(bool)
    around = np.array([dy * wide + dx for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx])
    front = np.flatnonzero(seen)
    while len(front):
        near = (key[front][:, None] + around).ravel()
        at = np.minimum(np.searchsorted(key, near), len(key) - 1)
        front = np.unique(at[(key[at] == near) & ~seen[at]])
        seen[front] = True
    seen[order] = seen.copy()
    return table.filter(pa.array(seen)).select(["mat_id", "y", "x"])


def canny_gradients(dx: Mat, dy: Mat, low: float, high: float, l2: bool = False) -> Mat:
    """Of 16S derivatives. Growth follows paths of any length, so it works matrix by matrix on the few pixels that thinning leaves."""
    require(dx.meta.depth == dy.meta.depth == "16S" and dx.meta.channels == 1, "BadArg", "16S, of one channel")
    same_kind(dx, dy)
    low, high = min(low, high), max(low, high)
    g = aligned(dx, dy).withColumnsRenamed({"v": "gx", "w": "gy"})
    x, y = F.col("gx").cast("double"), F.col("gy").cast("double")
    size = F.sqrt(x * x + y * y).cast("float") if l2 else (F.abs(x) + F.abs(y)).cast("float")
    g = g.withColumn("a", size)
    around = [(v, h, 1.0) for v in (-1, 0, 1) for h in (-1, 0, 1)]
    here = (F.col("dy") == 0) & (F.col("dx") == 0)
    near = scattered(g, around).groupBy("mat_id", "oy", "ox").agg(
        F.max(F.when(here, F.struct("gx", "gy", "a"))).alias("g"), *[F.max(F.when((F.col("dy") == v) & (F.col("dx") == h), F.col("a"))).alias(f"n{v + 1}{h + 1}") for v, h, _ in around]
    )
    near = near.where(F.col("g").isNotNull()).where(F.col("g.a") > F.lit(low).cast("float"))
    at = lambda v, h: F.coalesce(f"n{v + 1}{h + 1}", F.lit(0.0).cast("float"))
    gx, gy, a = F.col("g.gx").cast("double"), F.col("g.gy").cast("double"), F.col("g.a")
    slope = F.when(gx != 0, gy / F.when(gx != 0, gx)).otherwise(F.when(gy >= 0, F.lit(1e308)).otherwise(F.lit(-1e308)))
    t1, t3 = math.tan(math.pi / 8), math.tan(3 * math.pi / 8)
    flat, fall, rise = F.abs(slope) < t1, (slope >= t1) & (slope <= t3), (slope >= -t3) & (slope <= -t1)
    b = F.when(flat, at(0, 1)).when(fall, at(1, 1)).when(rise, at(-1, 1)).otherwise(at(1, 0))
    c = F.when(flat, at(0, -1)).when(fall, at(-1, -1)).when(rise, at(1, -1)).otherwise(at(-1, 0))
    straight = ~(fall | rise)
    kept = near.where(((a > b) | ((a == b) & straight)) & (a > c))
    weak = kept.select("mat_id", F.col("oy").alias("y"), F.col("ox").alias("x"), (a > F.lit(high).cast("float")).alias("strong"))
    ship(dx.spark)
    edges = weak.groupBy("mat_id").applyInArrow(_grown, "mat_id string, y int, x int").withColumn("e", F.lit(255))
    px = dx.px.select(*KEY).join(edges, ["mat_id", "y", "x"], "left").select(*KEY, F.coalesce("e", F.lit(0)).alias("v"))
    return Mat(px, type(dx.meta)(dx.meta.rows, dx.meta.cols, 1, "8U"))


def canny(m: Mat, low: float, high: float, aperture: int = 3, l2: bool = False) -> Mat:
    require(m.meta.depth == "8U" and m.meta.channels == 1, "BadArg", "8U, of one channel")
    require(aperture in (3, 5), "BadSize", "3 or 5")
    d = [sobel(m, a, b, aperture, "16S", border="REPLICATE", isolated=True) for a, b in ((1, 0), (0, 1))]
    return canny_gradients(*d, low, high, l2)
