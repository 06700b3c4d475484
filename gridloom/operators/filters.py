"""Neighbourhood operators. Each source pixel is sent to the places that it contributes to, and one aggregate adds up what arrives there; Spark combines before the shuffle.

A frame (see borders.pad) is made first, so no place needs to look for pixels outside. Separable kernels take two passes of k instead of one of k * k.
"""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import kernels
from gridloom.functions.borders import pad
from gridloom.matrix import KEY, Mat, Meta, require, saturate

Tap = tuple[int, int, float]


def taps_of(kernel: np.ndarray, anchor: tuple[int, int] = (-1, -1)) -> list[Tap]:
    """(dy, dx, weight): what a place adds up, by where it lies from there. Zero weights go, but for the anchor's own."""
    k = np.atleast_2d(np.asarray(kernel, dtype=float))
    ax, ay = (k.shape[1] // 2 if anchor[0] < 0 else anchor[0]), (k.shape[0] // 2 if anchor[1] < 0 else anchor[1])
    require(ax < k.shape[1] and ay < k.shape[0], "OutOfRange", "the anchor lies outside")
    return [(y - ay, x - ax, float(k[y, x])) for y in range(k.shape[0]) for x in range(k.shape[1]) if k[y, x] or (y, x) == (ay, ax)]


def scattered(px: DataFrame, taps: list[Tap]) -> DataFrame:
    """px with oy, ox (a place that the pixel contributes to), dy, dx and w."""
    each = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(float(w)).alias("w")) for dy, dx, w in taps]))
    return px.withColumn("t", each).select(*px.columns, (F.col("y") - F.col("t.dy")).alias("oy"), (F.col("x") - F.col("t.dx")).alias("ox"), "t.dy", "t.dx", "t.w")


def framed(m: Mat, taps: list[Tap], mode: str, isolated: bool = True, value=0) -> DataFrame:
    """px with the frame that the taps reach, at coordinates that keep their place. Without isolation a region of interest sees what it was cut from."""
    top, bottom = max(0, -min(t[0] for t in taps)), max(0, max(t[0] for t in taps))
    left, right = max(0, -min(t[1] for t in taps)), max(0, max(t[1] for t in taps))
    if m.parent is not None and not isolated:
        whole, y0, x0 = m.parent
        px = (whole.px if mode == "CONSTANT" else pad(whole, top, bottom, left, right, mode, shift=False).px).where(F.col("y").between(y0 - top, y0 + m.meta.rows - 1 + bottom) & F.col("x").between(x0 - left, x0 + m.meta.cols - 1 + right))
        return px.select("mat_id", (F.col("y") - y0).alias("y"), (F.col("x") - x0).alias("x"), "c", "v")
    return pad(m, top, bottom, left, right, mode, value, shift=False).px


def gathered(m: Mat, taps: list[Tap], mode: str, how: Column, isolated: bool = True, value=0) -> DataFrame:
    """KEY, v: the aggregate `how` over v and w of all taps of each place."""
    sent = scattered(framed(m, taps, mode, isolated, value), taps)
    inside = F.col("oy").between(0, m.meta.rows - 1) & F.col("ox").between(0, m.meta.cols - 1)
    return sent.where(inside).groupBy("mat_id", F.col("oy").alias("y_"), F.col("ox").alias("x_"), "c").agg(how.alias("v")).select("mat_id", F.col("y_").alias("y"), F.col("x_").alias("x"), "c", "v")


def _linear(m: Mat, taps: list[Tap], mode: str, isolated: bool = True) -> Mat:
    """Sums of weight times value, as 64F. A constant border adds nothing."""
    if mode == "CONSTANT":
        sent = scattered(m.px if m.parent is None or isolated else framed(m, taps, mode, False), taps)
        inside = F.col("oy").between(0, m.meta.rows - 1) & F.col("ox").between(0, m.meta.cols - 1)
        px = sent.where(inside).groupBy("mat_id", "oy", "ox", "c").agg(F.sum(F.col("w") * F.col("v")).alias("v")).select("mat_id", F.col("oy").alias("y"), F.col("ox").alias("x"), "c", "v")
    else:
        px = gathered(m, taps, mode, F.sum(F.col("w") * F.col("v")), isolated)
    return Mat(px, replace(m.meta, depth="64F"))


def filter2d(m: Mat, kernel: np.ndarray, depth: str | None = None, anchor: tuple[int, int] = (-1, -1), delta: float = 0.0, border: str = "REFLECT_101") -> Mat:
    """Correlation: the kernel is not turned."""
    return _linear(m, taps_of(kernel, anchor), border).with_v(F.col("v") + delta, depth or m.meta.depth)


def sep_filter2d(m: Mat, kx, ky, depth: str | None = None, anchor: tuple[int, int] = (-1, -1), delta: float = 0.0, border: str = "REFLECT_101") -> Mat:
    """Rows first, then columns."""
    rows = _linear(m, taps_of(np.atleast_2d(kx), (anchor[0], 0)), border)
    return _linear(rows, taps_of(np.atleast_2d(ky).T, (0, anchor[1])), border).with_v(F.col("v") + delta, depth or m.meta.depth)


def _box(m: Mat, width: int, height: int, anchor: tuple[int, int], border: str) -> Mat:
    require(width > 0 and height > 0, "BadSize", "sizes must be positive")
    one = _linear(m, taps_of(np.ones((1, width)), (anchor[0], 0)), border)
    return _linear(one, taps_of(np.ones((height, 1)), (0, anchor[1])), border)


def box_filter(m: Mat, width: int, height: int, depth: str | None = None, anchor: tuple[int, int] = (-1, -1), normalize: bool = True, border: str = "REFLECT_101") -> Mat:
    """Sums are exact; the mean is a product of 32 bit floats."""
    s = _box(m, width, height, anchor, border)
    v = F.col("v")
    if normalize:
        v = v.cast("float") * F.lit(float(np.float32(1.0 / (width * height)))).cast("float") if not m.meta.is_float else v / (width * height)
    return s.with_v(v, depth or m.meta.depth)


def blur(m: Mat, width: int, height: int, anchor: tuple[int, int] = (-1, -1), border: str = "REFLECT_101") -> Mat:
    return box_filter(m, width, height, None, anchor, True, border)


def sqr_box_filter(m: Mat, width: int, height: int, depth: str = "32F", anchor: tuple[int, int] = (-1, -1), normalize: bool = True, border: str = "REFLECT_101") -> Mat:
    v = F.col("v").cast("double")
    return _box(m.with_v(v * v, "64F", sat=False), width, height, anchor, border).with_v(F.col("v") / (width * height) if normalize else F.col("v"), depth)


def gaussian_blur(m: Mat, width: int, height: int, sigma_x: float, sigma_y: float = 0.0, border: str = "REFLECT_101") -> Mat:
    sigma_y = sigma_y if sigma_y > 0 else sigma_x
    width, height = kernels.blur_size(width, sigma_x), kernels.blur_size(height, sigma_y)
    require(width % 2 == 1 and height % 2 == 1, "BadSize", "odd sizes")
    return sep_filter2d(m, kernels.blur_gaussian(width, sigma_x), kernels.blur_gaussian(height, sigma_y), border=border)


def median_blur(m: Mat, size: int) -> Mat:
    require(size > 1 and size % 2 == 1, "BadSize", "an odd size above 1")
    require(not m.meta.is_float or size in (3, 5), "BadSize", "floats: 3 or 5")
    mid = F.element_at(F.array_sort(F.collect_list("v")), size * size // 2 + 1)
    return Mat(gathered(m, taps_of(np.ones((size, size))), "REPLICATE", mid), m.meta)


def bilateral_filter(m: Mat, d: int, sigma_color: float, sigma_space: float, border: str = "REFLECT_101") -> Mat:
    """A round neighbourhood, weighed by distance in space and in colour."""
    from gridloom.operators.color import narrow, wide

    require(m.meta.channels in (1, 3) and m.meta.depth in ("8U", "32F"), "BadArg", "8U or 32F, 1 or 3 channels")
    if sigma_color <= 1e-6 or sigma_space <= 1e-6:
        return m.clone()
    r = max(1, d // 2 if d > 0 else math.floor(sigma_space * 1.5 + 0.5))
    taps = [(y, x, math.exp(-0.5 * (y * y + x * x) / sigma_space**2)) for y in range(-r, r + 1) for x in range(-r, r + 1) if y * y + x * x <= r * r]
    n = m.meta.channels
    px = wide(Mat(m.px if border == "CONSTANT" else framed(m, taps, border), m.meta))
    names = [f"c{k}" for k in range(n)]
    sent = scattered(px, taps).where(F.col("oy").between(0, m.meta.rows - 1) & F.col("ox").between(0, m.meta.cols - 1))
    centre = F.max(F.when((F.col("dy") == 0) & (F.col("dx") == 0), F.struct(*names)))
    around = sent.groupBy("mat_id", "oy", "ox").agg(centre.alias("o"), F.array_sort(F.collect_list(F.struct("dy", "dx", "w", *names))).alias("near"))

    def weight(s: Column) -> Column:
        far = sum((F.abs(s[k].cast("double") - F.col(f"o.{k}").cast("double")) for k in names), F.lit(0.0))
        return s["w"] * F.exp(far * far * (-0.5 / sigma_color**2))

    parts = F.transform("near", lambda s: F.struct(weight(s).alias("w"), *[s[k].cast("double").alias(k) for k in names]))
    around = around.withColumn("parts", parts)
    total = F.aggregate("parts", F.lit(0.0), lambda a, s: a + s["w"])
    mean = lambda k: F.aggregate("parts", F.lit(0.0), lambda a, s: a + s["w"] * s[k]) / total
    out = [saturate(mean(k), m.meta.depth) for k in names]
    return narrow(around.select("mat_id", F.col("oy").alias("y"), F.col("ox").alias("x"), *[o.alias(k) for o, k in zip(out, names, strict=True)]), m.meta, *map(F.col, names))


def stack_blur(m: Mat, width: int, height: int) -> Mat:
    """Triangular weights."""
    require(width % 2 == 1 and height % 2 == 1, "BadSize", "odd sizes")
    ramp = lambda n: (n // 2 + 1 - abs(np.arange(n) - n // 2)) / (n // 2 + 1) ** 2
    return sep_filter2d(m, ramp(width), ramp(height), border="REPLICATE")


def sobel(m: Mat, dx: int, dy: int, size: int = 3, depth: str = "32F", scale: float = 1.0, delta: float = 0.0, border: str = "REFLECT_101", isolated: bool = False) -> Mat:
    require((dx, dy) in ((1, 0), (0, 1)) and size in (3, 5), "BadArg", "a first derivative, of size 3 or 5")
    require(depth in ("16S", "32F"), "BadArg", "16S or 32F")
    kx, ky = kernels.deriv_kernels(dx, dy, size)
    return _linear(m, taps_of(np.outer(ky, kx)), border, isolated).with_v(F.col("v") * scale + delta, depth)


def scharr(m: Mat, dx: int, dy: int, depth: str = "32F", scale: float = 1.0, delta: float = 0.0, border: str = "REFLECT_101", isolated: bool = False) -> Mat:
    kx, ky = kernels.deriv_kernels(dx, dy, -1)
    return _linear(m, taps_of(np.outer(ky, kx)), border, isolated).with_v(F.col("v") * scale + delta, depth)


def laplacian(m: Mat, size: int = 1, depth: str | None = None, scale: float = 1.0, delta: float = 0.0, border: str = "REFLECT_101", isolated: bool = False) -> Mat:
    require(size in (1, 3, 5), "BadSize", "1, 3 or 5")
    if size == 1:
        k = np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]])
    else:
        (ax, ay), (bx, by) = kernels.deriv_kernels(2, 0, size), kernels.deriv_kernels(0, 2, size)
        k = np.outer(ay, ax) + np.outer(by, bx)
    return _linear(m, taps_of(k), border, isolated).with_v(F.col("v") * scale + delta, depth or m.meta.depth)


def spatial_gradient(m: Mat, border: str = "REFLECT_101") -> tuple[Mat, Mat]:
    """16S derivatives across and down."""
    return sobel(m, 1, 0, 3, "16S", border=border), sobel(m, 0, 1, 3, "16S", border=border)


def integral(m: Mat, depth: str | None = None) -> Mat:
    """One row and one column larger: sums of all above and to the left. Two running sums, along rows and then along columns."""
    depth = depth or ("64F" if m.meta.is_float else "32S")
    kind = "double" if m.meta.is_float or depth == "64F" else "bigint"
    along = Window.partitionBy("mat_id", "y", "c").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("mat_id", "x", "c").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    px = m.px.withColumn("v", F.sum(F.col("v").cast(kind)).over(along))
    px = px.withColumn("v", F.sum("v").over(down)).select("mat_id", (F.col("y") + 1).alias("y"), (F.col("x") + 1).alias("x"), "c", "v")
    h, w, n = m.meta.rows, m.meta.cols, m.meta.channels
    edge = m.spark.range(h + w + 1).select(F.when(F.col("id") <= h, F.col("id")).otherwise(0).cast("int").alias("y"), F.when(F.col("id") > h, F.col("id") - h).otherwise(0).cast("int").alias("x"))
    edge = m.px.select("mat_id").distinct().crossJoin(F.broadcast(edge.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))))).withColumn("v", F.lit(0).cast(kind))
    out = Mat(px.unionByName(edge), Meta(h + 1, w + 1, n, depth))
    return out.with_v(F.col("v"), sat=False)
