"""Thresholds, histograms, look-up tables, colour maps, accumulation and blending."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.matrix import KEY, Mat, aligned, require, saturate
from gridloom.operators.filters import box_filter, gaussian_blur
from gridloom.operators.reductions import _selected

TYPES = ("BINARY", "BINARY_INV", "TRUNC", "TOZERO", "TOZERO_INV")


def _thresholded(v: Column, t: Column, high: Column, kind: str) -> Column:
    require(kind in TYPES, "BadArg", f"no threshold {kind}")
    zero = F.lit(0)
    return {"BINARY": F.when(v > t, high).otherwise(zero), "BINARY_INV": F.when(v > t, zero).otherwise(high), "TRUNC": F.when(v > t, t).otherwise(v), "TOZERO": F.when(v > t, v).otherwise(zero), "TOZERO_INV": F.when(v > t, zero).otherwise(v)}[kind]


def histogram(m: Mat, mask: Mat | None = None) -> DataFrame:
    """mat_id, v, n of an 8U matrix of one channel."""
    require(m.meta.depth == "8U" and m.meta.channels == 1, "BadArg", "8U, of one channel")
    return _selected(m, mask).groupBy("mat_id", "v").agg(F.count("*").alias("n"))


def _per_matrix(m: Mat, found: DataFrame, default: float | None) -> DataFrame:
    return m.px.select("mat_id").distinct().join(found, "mat_id", "left").select("mat_id", F.coalesce("thresh", F.lit(default)).alias("thresh"))


def otsu(m: Mat, mask: Mat | None = None, unparted: float | None = 0.0) -> DataFrame:
    """mat_id, thresh: the first value that parts the histogram with the largest variance between the parts; unparted where all values are equal, or none is selected. At most 256 rows a matrix reach the running sums."""
    w = Window.partitionBy("mat_id").orderBy("v")
    h = histogram(m, mask)
    all_ = Window.partitionBy("mat_id")
    c = h.select("mat_id", "v", F.sum("n").over(w).alias("nb"), F.sum(F.col("n") * F.col("v")).over(w).alias("sb"), F.sum("n").over(all_).alias("n"), F.sum(F.col("n") * F.col("v")).over(all_).alias("s"))
    nf = (F.col("n") - F.col("nb")).cast("double")
    mb, mf = F.col("sb").cast("double") / F.col("nb"), (F.col("s") - F.col("sb")).cast("double") / F.when(nf > 0, nf)
    between = F.col("nb").cast("double") * nf * (mb - mf) * (mb - mf)
    best = c.where("n > nb").withColumn("between", between).groupBy("mat_id").agg(F.max_by("v", F.struct("between", -F.col("v"))).cast("double").alias("thresh"))
    return _per_matrix(m, best, unparted)


def triangle(m: Mat, mask: Mat | None = None) -> DataFrame:
    """mat_id, thresh: the value farthest from the line between the histogram's peak and its longer tail. An array of 256 counts a matrix."""
    h = histogram(m, mask).groupBy("mat_id").agg(F.map_from_entries(F.collect_list(F.struct("v", "n"))).alias("h"))
    h = h.withColumn("h", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.element_at(F.col("h"), i), F.lit(0))))
    full = F.filter(F.sequence(F.lit(0), F.lit(255)), lambda i: F.get(F.col("h"), i) > 0)
    h = h.withColumns({"left": F.greatest(F.array_min(full) - 1, F.lit(0)), "right": F.least(F.array_max(full) + 1, F.lit(255)), "top": F.array_max("h"), "peak": (F.array_position("h", F.array_max("h")) - 1).cast("int")})
    # the right tail is the longer one: look at it mirrored
    turned = F.col("peak") - F.col("left") < F.col("right") - F.col("peak")
    h = h.withColumn("turned", turned).withColumns({"g": F.when(turned, F.reverse("h")).otherwise(F.col("h")), "lo": F.when(turned, 255 - F.col("right")).otherwise(F.col("left")), "at": F.when(turned, 255 - F.col("peak")).otherwise(F.col("peak"))})
    far = lambda i: F.col("top") * i + (F.col("lo") - F.col("at")) * F.get(F.col("g"), i)
    places = F.when(F.col("lo") < F.col("at"), F.sequence(F.col("lo") + 1, F.col("at"))).otherwise(F.array().cast("array<int>"))
    best = F.aggregate(places, F.struct(F.lit(0).cast("bigint").alias("d"), F.col("lo").alias("i")), lambda a, i: F.when(far(i) > a["d"], F.struct(far(i).cast("bigint").alias("d"), i.alias("i"))).otherwise(a))
    h = h.withColumn("t", best["i"] - 1)
    return _per_matrix(m, h.select("mat_id", F.when(F.col("turned"), 255 - F.col("t")).otherwise(F.col("t")).cast("double").alias("thresh")), -1.0)


def used_threshold(m: Mat, thresh: float, auto: str | None = None, mask: Mat | None = None, unparted: float | None = 0.0) -> DataFrame:
    """mat_id, thresh as threshold() takes it; this alone is a dry run."""
    if auto:
        require(auto in ("OTSU", "TRIANGLE"), "BadArg", f"no method {auto}")
        return otsu(m, mask, unparted) if auto == "OTSU" else triangle(m, mask)
    t = float(math.floor(thresh)) if m.meta.depth == "8U" else float(thresh)
    return m.px.select("mat_id").distinct().withColumn("thresh", F.lit(t))


def threshold(m: Mat, thresh: float, high: float, kind: str = "BINARY", auto: str | None = None, mask: Mat | None = None, old: Mat | None = None, unparted: float | None = 0.0) -> Mat:
    """Values above thresh. Of 8U, thresh is floored and high saturated; auto: OTSU or TRIANGLE choose thresh for each matrix. mask: other places keep old, which must be given. unparted: as otsu() takes it; nothing is above a null."""
    require(mask is None or (old is not None and old.meta == m.meta), "BadArg", "what is not selected must exist, in the same type")
    top = saturate(F.lit(float(high)), m.meta.depth)
    if auto:
        used = used_threshold(m, thresh, auto, mask, unparted)
        df = m.px.join(F.broadcast(used) if mask is None else used, "mat_id")
        t = F.col("thresh")
    else:
        df, t = m.px, F.lit(float(math.floor(thresh)) if m.meta.depth == "8U" else float(thresh))
    out = Mat(df.select(*KEY, saturate(_thresholded(F.col("v"), t, top, kind), m.meta.depth).alias("v")), m.meta)
    if mask is None:
        return out
    from gridloom.operators.arithmetic import masked

    return masked(out, mask, old)


def adaptive_threshold(m: Mat, high: float, method: str = "MEAN", kind: str = "BINARY", block: int = 3, c: float = 0.0) -> Mat:
    require(m.meta.depth == "8U" and m.meta.channels == 1, "BadArg", "8U, of one channel")
    require(block > 1 and block % 2 == 1, "BadSize", "an odd size above 1")
    require(kind in ("BINARY", "BINARY_INV") and method in ("MEAN", "GAUSSIAN"), "BadFlag", "BINARY or BINARY_INV, MEAN or GAUSSIAN")
    if high < 0:
        return m.with_v(F.lit(0.0))
    local = box_filter(m, block, block, border="REPLICATE") if method == "MEAN" else gaussian_blur(m, block, block, 0.0, 0.0, "REPLICATE")
    delta = math.ceil(c) if kind == "BINARY" else math.floor(c)
    above = (F.col("v") - F.col("w")) > -delta
    top = saturate(F.lit(float(high)), "8U")
    return Mat(aligned(m, local).select(*KEY, (F.when(above, top).otherwise(0) if kind == "BINARY" else F.when(above, 0).otherwise(top)).alias("v")), m.meta)


def equalize_hist(m: Mat) -> Mat:
    h = histogram(m)
    w = Window.partitionBy("mat_id")
    h = h.withColumns({"upto": F.sum("n").over(w.orderBy("v")), "all": F.sum("n").over(w), "first": F.min_by("n", "v").over(w), "v0": F.min("v").over(w)})
    scale = F.lit(255.0).cast("float") / F.when(F.col("all") > F.col("first"), F.col("all") - F.col("first")).cast("float")
    to = F.when(F.col("all") == F.col("first"), F.col("v0")).otherwise(F.least(F.rint((F.col("upto") - F.col("first")).cast("float") * scale.cast("float")), F.lit(255.0)).cast("int"))
    table = h.select("mat_id", "v", to.alias("to"))
    return Mat(m.px.join(table, ["mat_id", "v"]).select(*KEY, F.col("to").alias("v")), m.meta)


def lut(m: Mat, table: np.ndarray, depth: str) -> Mat:
    """table: 256 values, or 256 x channels; a literal of the plan."""
    require(m.meta.depth == "8U", "BadArg", "8U only")
    t = np.asarray(table).reshape(256, -1)
    require(t.shape[1] in (1, m.meta.channels), "BadArg", "one channel, or as many as the source")
    at = F.col("v") * t.shape[1] + (F.col("c") if t.shape[1] > 1 else 0) + 1
    return m.with_v(F.element_at(F.array(*[F.lit(x) for x in t.ravel().astype(float).tolist()]), at), depth)


#: For each colour map the blue, green and red of t = v / 255.
COLOR_MAPS = {
    "AUTUMN": lambda t: (t * 0, t, t * 0 + 1.0),
    "JET": lambda t: (1.5 - F.abs(4.0 * t - 1.0), 1.5 - F.abs(4.0 * t - 2.0), 1.5 - F.abs(4.0 * t - 3.0)),
    "WINTER": lambda t: (1.0 - 0.5 * t, t, t * 0),
    "COOL": lambda t: (t * 0 + 1.0, 1.0 - t, t),
    "HOT": lambda t: (4.0 * t - 3.0, (8.0 / 3.0) * t - 1.0, (8.0 / 3.0) * t),
}


def apply_color_map(m: Mat, name: str) -> Mat:
    require(m.meta.depth == "8U" and m.meta.channels == 1, "BadArg", "8U, of one channel")
    require(name in COLOR_MAPS, "BadArg", f"no colour map {name}")
    parts = COLOR_MAPS[name](F.col("v").cast("double") / 255.0)
    colours = F.array(*[saturate(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)) * 255.0, "8U") for p in parts])
    return Mat(m.px.select("mat_id", "y", "x", F.posexplode(colours).alias("c", "v")), replace(m.meta, channels=3))


def apply_user_color_map(m: Mat, table: np.ndarray) -> Mat:
    """table: 256 x 1 or 256 x 3, 8U."""
    require(m.meta.depth == "8U" and m.meta.channels == 1, "BadArg", "8U, of one channel")
    t = np.asarray(table).reshape(256, -1)
    require(t.shape[1] in (1, 3), "BadArg", "one or three channels")
    entries = F.array(*[F.array(*[F.lit(int(x)) for x in row]) for row in t])
    return Mat(m.px.select("mat_id", "y", "x", F.posexplode(F.element_at(entries, F.col("v") + 1)).alias("c", "v")), replace(m.meta, channels=t.shape[1]))


def _accumulated(dst: Mat, f, *sources: Mat, mask: Mat | None = None) -> Mat:
    require(dst.meta.depth == "32F", "BadArg", "the sum is 32F")
    require(all(s.meta.shape == dst.meta.shape and s.meta.channels == dst.meta.channels for s in sources), "UnmatchedSizes", "sizes differ")
    d = lambda k: F.col(k).cast("double")
    df = aligned(dst, *sources)
    out = Mat(df.select(*KEY, f(d("v"), d("w"), d("w2") if len(sources) > 1 else None).cast("float").alias("v")), dst.meta)
    if mask is None:
        return out
    from gridloom.operators.arithmetic import masked

    return masked(out, mask, dst)


def accumulate(src: Mat, dst: Mat, mask: Mat | None = None) -> Mat:
    return _accumulated(dst, lambda s, a, b: s + a, src, mask=mask)


def accumulate_square(src: Mat, dst: Mat, mask: Mat | None = None) -> Mat:
    return _accumulated(dst, lambda s, a, b: s + a * a, src, mask=mask)


def accumulate_product(one: Mat, two: Mat, dst: Mat, mask: Mat | None = None) -> Mat:
    return _accumulated(dst, lambda s, a, b: s + a * b, one, two, mask=mask)


def accumulate_weighted(src: Mat, dst: Mat, alpha: float, mask: Mat | None = None) -> Mat:
    return _accumulated(dst, lambda s, a, b: s * (1 - alpha) + a * alpha, src, mask=mask)


def accumulated_frames(frames: DataFrame, how: str = "sum", alpha: float = 0.1) -> DataFrame:
    """frames: frame_id, y, x, c, v. A whole sequence at once: y, x, c, v. sum and square combine before the shuffle; weighted folds each place's frames in order."""
    key = ["y", "x", "c"]
    v = F.col("v").cast("double")
    if how == "weighted":
        seq = frames.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("frame_id", v.alias("v")))).alias("s"))
        return seq.select(*key, F.aggregate("s", F.lit(0.0), lambda a, x: a * (1 - alpha) + x["v"] * alpha).alias("v"))
    require(how in ("sum", "square"), "BadArg", f"no accumulation {how}")
    return frames.groupBy(*key).agg(F.sum(v if how == "sum" else v * v).alias("v"))


def blend_linear(a: Mat, b: Mat, wa: Mat, wb: Mat) -> Mat:
    """(a * wa + b * wb) / (wa + wb + 1e-5); 8U rounds halves to even. Weights are 32F, of one channel."""
    require(a.meta == b.meta, "UnmatchedFormats", "the matrices differ")
    w = lambda m, k: m.px.select("mat_id", "y", "x", F.col("v").cast("double").alias(k))
    df = aligned(a, b).withColumnsRenamed({"w": "b"}).join(w(wa, "wa"), ["mat_id", "y", "x"]).join(w(wb, "wb"), ["mat_id", "y", "x"])
    v = (F.col("v") * F.col("wa") + F.col("b") * F.col("wb")) / (F.col("wa") + F.col("wb") + 1e-5)
    return Mat(df.select(*KEY, saturate(v, a.meta.depth, even=True).alias("v")), a.meta)
