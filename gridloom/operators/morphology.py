"""Erosion, dilation and what is made of them: least and largest values over a kernel's places."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridloom.matrix import KEY, Mat, require
from gridloom.operators.arithmetic import subtract
from gridloom.operators.filters import gathered, scattered, taps_of


def _extreme(m: Mat, kernel, anchor, iterations: int, border: str, value, largest: bool) -> Mat:
    require(m.meta.depth == "8U", "BadArg", "8U only")
    k = np.ones((3, 3)) if kernel is None else np.asarray(kernel)
    require(bool((k != 0).any()), "BadArg", "an empty kernel")
    taps = [t for t in taps_of(k, anchor) if t[2]]
    how = F.max("v") if largest else F.min("v")
    for _ in range(iterations):
        m = Mat(gathered(m, taps, border, how, value=value), m.meta)
    return m


def erode(m: Mat, kernel=None, anchor=(-1, -1), iterations: int = 1, border: str = "REFLECT_101", value=255) -> Mat:
    return _extreme(m, kernel, anchor, iterations, border, value, False)


def dilate(m: Mat, kernel=None, anchor=(-1, -1), iterations: int = 1, border: str = "REFLECT_101", value=0) -> Mat:
    return _extreme(m, kernel, anchor, iterations, border, value, True)


def hit_miss(m: Mat, kernel) -> Mat:
    """255 where places of 1 are not 0 and places of -1 are; places outside don't count. A kernel of zeros changes nothing."""
    require(m.meta.depth == "8U" and m.meta.channels == 1, "BadArg", "8U, of one channel")
    k = np.asarray(kernel)
    if not k.any():
        return m.clone()
    ay, ax = k.shape[0] // 2, k.shape[1] // 2
    taps = [(y - ay, x - ax, float(k[y, x])) for y in range(k.shape[0]) for x in range(k.shape[1]) if k[y, x]]
    sent = scattered(m.px, taps).groupBy("mat_id", F.col("oy").alias("y"), F.col("ox").alias("x")).agg(F.bool_and((F.col("v") != 0) == (F.col("w") > 0)).alias("ok"))
    px = m.px.select(*KEY).join(sent, ["mat_id", "y", "x"], "left").select(*KEY, F.when(F.coalesce("ok", F.lit(True)), 255).otherwise(0).alias("v"))
    return Mat(px, m.meta)


def morphology(m: Mat, op: str, kernel=None, anchor=(-1, -1), iterations: int = 1, border: str = "CONSTANT", value=0) -> Mat:
    """ERODE, DILATE, OPEN, CLOSE, GRADIENT, TOPHAT, BLACKHAT or HITMISS. The border differs from erode()'s and dilate()'s by default."""
    args = (kernel, anchor, iterations, border, value)
    if op == "HITMISS":
        return hit_miss(m, kernel)
    steps = {
        "ERODE": lambda: erode(m, *args), "DILATE": lambda: dilate(m, *args), "OPEN": lambda: dilate(erode(m, *args), *args), "CLOSE": lambda: erode(dilate(m, *args), *args),
        "GRADIENT": lambda: subtract(dilate(m, *args), erode(m, *args)), "TOPHAT": lambda: subtract(m, dilate(erode(m, *args), *args)),
        "BLACKHAT": lambda: subtract(erode(dilate(m, *args), *args), m),
    }
    require(op in steps, "BadArg", f"no operation {op}")
    return steps[op]()
