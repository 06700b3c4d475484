"""Geometric transforms: for each place of the result, the source places and weights it takes; pixels are joined to that table, which depends on sizes only.

A table of a bounded size is broadcast, so that pixels don't move before the aggregate; a larger one is joined by a shuffle.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import kernels
from gridloom.functions.borders import border as border_of
from gridloom.matrix import Mat, lane, require, saturate

#: Rows of the table of places.
BROADCAST_TAPS = 400_000


def grid(m: Mat, rows: int, cols: int) -> DataFrame:
    """oy, ox of every place."""
    i = F.col("id")
    return m.spark.range(rows * cols).select(F.floor(i / cols).cast("int").alias("oy"), (i % cols).cast("int").alias("ox"))


def _taken(m: Mat, taps: DataFrame, rows: int, cols: int, n_taps: int, mode: str, value, even: bool = False, depth: str | None = None) -> Mat:
    """taps: oy, ox, sy, sx (beyond the source: by the border's rule), w."""
    h, w = m.meta.shape
    y, x = border_of(F.col("sy"), h, mode), border_of(F.col("sx"), w, mode)
    outside = (y < 0) | (x < 0)
    taps = taps.select("oy", "ox", F.when(outside, -1).otherwise(y).cast("int").alias("y"), F.when(outside, -1).otherwise(x).cast("int").alias("x"), "w")
    px = m.px
    if mode == "CONSTANT":
        lanes = list(value) if isinstance(value, (list, tuple)) else [value] * m.meta.channels
        blank = px.where("y = 0 and x = 0").select("mat_id", F.lit(-1).alias("y"), F.lit(-1).alias("x"), "c", saturate(lane(lanes, m.meta.channels), m.meta.depth).alias("v"))
        px = px.unionByName(blank)
    if n_taps * rows * cols <= BROADCAST_TAPS:
        taps = F.broadcast(taps)
    joined = px.join(taps, ["y", "x"])
    to = depth or m.meta.depth
    if n_taps == 1:
        out = joined.select("mat_id", F.col("oy").alias("y"), F.col("ox").alias("x"), "c", "v")
    else:
        out = joined.groupBy("mat_id", "oy", "ox", "c").agg(F.sum(F.col("w") * F.col("v")).alias("s")).select("mat_id", F.col("oy").alias("y"), F.col("ox").alias("x"), "c", saturate(F.col("s"), to, even).alias("v"))
    return Mat(out, replace(m.meta, rows=rows, cols=cols, depth=to))


def _bilinear(places: DataFrame) -> DataFrame:
    """places: oy, ox, y0, x0 and fractions wy, wx, to four taps."""
    t = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    p = places.withColumn("t", t)
    part = lambda f, k: F.when(F.col(k) == 1, F.col(f)).otherwise(1 - F.col(f))
    return p.select("oy", "ox", (F.col("y0") + F.col("t.a")).cast("int").alias("sy"), (F.col("x0") + F.col("t.b")).cast("int").alias("sx"), (part("wy", "t.a") * part("wx", "t.b")).alias("w"))


def _target(n: int, size: int, factor: float) -> int:
    return size if size > 0 else int(np.floor(n * factor + 0.5))


def resize(m: Mat, rows: int = 0, cols: int = 0, fy: float = 0.0, fx: float = 0.0, interpolation: str = "LINEAR") -> Mat:
    """NEAREST, NEAREST_EXACT or LINEAR. At the upper and left edge LINEAR extrapolates: the place is clipped, its weight is not."""
    h, w = m.meta.shape
    rows, cols = _target(h, rows, fy), _target(w, cols, fx)
    require(rows > 0 and cols > 0, "BadSize", "a size or a factor")
    require(interpolation in ("NEAREST", "NEAREST_EXACT", "LINEAR"), "NotImplemented", f"no interpolation {interpolation}")
    g = grid(m, rows, cols)
    if interpolation == "LINEAR":
        if (h, w) == (2 * rows, 2 * cols) and m.meta.depth == "8U" and m.meta.channels == 1:
            out = m.px.groupBy("mat_id", F.floor(F.col("y") / 2).cast("int").alias("y_"), F.floor(F.col("x") / 2).cast("int").alias("x_"), "c").agg(F.shiftright(F.sum("v") + 2, 2).cast("int").alias("v"))
            return Mat(out.select("mat_id", F.col("y_").alias("y"), F.col("x_").alias("x"), "c", "v"), replace(m.meta, rows=rows, cols=cols))
        at = lambda o, n, to: (F.col(o) + 0.5) * (n / to) - 0.5
        low = lambda v, n: F.least(F.greatest(F.floor(v), F.lit(0)), F.lit(n - 1))
        y, x = at("oy", h, rows), at("ox", w, cols)
        places = g.select("oy", "ox", low(y, h).cast("int").alias("y0"), low(x, w).cast("int").alias("x0"), y.alias("y"), x.alias("x")).withColumns({"wy": F.col("y") - F.col("y0"), "wx": F.col("x") - F.col("x0")})
        return _taken(m, _bilinear(places), rows, cols, 4, "REPLICATE", 0)

    def pick(o: str, n: int, to: int) -> Column:
        if interpolation == "NEAREST":
            return F.floor(F.col(o) * n / to).cast("int")
        step = ((n << 16) + to // 2) // to
        return F.shiftright((F.col(o).cast("bigint") * step + (step // 2 - n % 2)), 16).cast("int")

    taps = g.select("oy", "ox", pick("oy", h, rows).alias("sy"), pick("ox", w, cols).alias("sx"), F.lit(1.0).alias("w"))
    return _taken(m, taps, rows, cols, 1, "REPLICATE", 0)


def _sampled(m: Mat, places: DataFrame, rows: int, cols: int, nearest: bool, mode: str, value, half_even: bool, steps: int) -> Mat:
    """places: oy, ox, sy, sx of doubles. half_even: how nearest rounds; steps: fractions are rounded to so many parts (0: not)."""
    if nearest:
        r = (lambda c: F.rint(c)) if half_even else (lambda c: F.floor(c + 0.5))
        taps = places.select("oy", "ox", r(F.col("sy")).cast("int").alias("sy"), r(F.col("sx")).cast("int").alias("sx"), F.lit(1.0).alias("w"))
        return _taken(m, taps, rows, cols, 1, mode, value)
    if steps:
        places = places.withColumns({k: F.rint(F.col(k) * steps) / steps for k in ("sy", "sx")})
    p = places.select("oy", "ox", F.floor("sy").cast("int").alias("y0"), F.floor("sx").cast("int").alias("x0"), "sy", "sx").withColumns({"wy": F.col("sy") - F.col("y0"), "wx": F.col("sx") - F.col("x0")})
    return _taken(m, _bilinear(p), rows, cols, 4, mode, value)


def warp_affine(m: Mat, matrix: np.ndarray, rows: int, cols: int, interpolation: str = "LINEAR", inverse: bool = False, border: str = "CONSTANT", value=0) -> Mat:
    """matrix: 2 x 3, from source to result, unless inverse."""
    require(border != "WRAP", "BadArg", "no wrapping border")
    a = np.asarray(matrix, dtype=float) if inverse else kernels.invert_affine(np.asarray(matrix, dtype=float))
    x, y = F.col("ox"), F.col("oy")
    places = grid(m, rows, cols).select("oy", "ox", (x * float(a[0, 0]) + y * float(a[0, 1]) + float(a[0, 2])).alias("sx"), (x * float(a[1, 0]) + y * float(a[1, 1]) + float(a[1, 2])).alias("sy"))
    return _sampled(m, places, rows, cols, interpolation == "NEAREST", border, value, False, 0)


def warp_perspective(m: Mat, matrix: np.ndarray, rows: int, cols: int, interpolation: str = "LINEAR", inverse: bool = False, border: str = "CONSTANT", value=0) -> Mat:
    a = np.asarray(matrix, dtype=float)
    if not inverse:
        a = np.linalg.inv(a) if np.linalg.det(a) else np.zeros((3, 3))
    x, y = F.col("ox"), F.col("oy")
    row = lambda i: x * float(a[i, 0]) + y * float(a[i, 1]) + float(a[i, 2])
    d = row(2)
    over = F.when(d != 0, 1 / F.when(d != 0, d)).otherwise(0.0)
    places = grid(m, rows, cols).select("oy", "ox", (row(0) * over).alias("sx"), (row(1) * over).alias("sy"))
    return _sampled(m, places, rows, cols, interpolation == "NEAREST", border, value, True, 32)


def remap(m: Mat, places: DataFrame, rows: int, cols: int, interpolation: str = "LINEAR", border: str = "CONSTANT", value=0) -> Mat:
    """places: y, x of the result, and sx, sy: where each takes its value."""
    p = places.select(F.col("y").alias("oy"), F.col("x").alias("ox"), F.col("sx").cast("double").alias("sx"), F.col("sy").cast("double").alias("sy"))
    return _sampled(m, p, rows, cols, interpolation == "NEAREST", border, value, True, 32)


def convert_maps(places: DataFrame, to: str = "fixed", nearest: bool = False) -> DataFrame:
    """Between float places (sx, sy) and fixed ones (ix, iy, and fx, fy in 32nds; nearest: without)."""
    if to == "float":
        part = lambda k: F.col(f"i{k}") + (F.col(f"f{k}") / 32.0 if f"f{k}" in places.columns else F.lit(0.0))
        return places.select("y", "x", part("x").alias("sx"), part("y").alias("sy"))
    if nearest:
        return places.select("y", "x", F.rint("sx").cast("int").alias("ix"), F.rint("sy").cast("int").alias("iy"))
    q = lambda k: F.rint(F.col(k).cast("double") * 32).cast("int")
    return places.select("y", "x", F.shiftright(q("sx"), 5).alias("ix"), F.shiftright(q("sy"), 5).alias("iy"), q("sx").bitwiseAND(F.lit(31)).alias("fx"), q("sy").bitwiseAND(F.lit(31)).alias("fy"))


def rect_sub_pix(m: Mat, rows: int, cols: int, center: tuple[float, float], depth: str | None = None) -> Mat:
    """A patch around a place between pixels."""
    cx, cy = center
    require(0 <= cx < m.meta.cols and 0 <= cy < m.meta.rows, "OutOfRange", "the centre lies outside")
    places = grid(m, rows, cols).select("oy", "ox", (F.col("ox") + (cx - (cols - 1) * 0.5)).alias("sx"), (F.col("oy") + (cy - (rows - 1) * 0.5)).alias("sy"))
    out = places.select("oy", "ox", F.floor("sy").cast("int").alias("y0"), F.floor("sx").cast("int").alias("x0"), "sy", "sx").withColumns({"wy": F.col("sy") - F.col("y0"), "wx": F.col("sx") - F.col("x0")})
    return _taken(m, _bilinear(out), rows, cols, 4, "REPLICATE", 0, depth=depth)
