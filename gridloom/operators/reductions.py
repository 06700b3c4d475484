"""Reductions and statistics: aggregations by matrix, by channel or by axis, combined before any shuffle."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.matrix import DEPTHS, KEY, Mat, aligned, require, same_kind, saturate


def _selected(m: Mat, mask: Mat | None) -> DataFrame:
    if mask is None:
        return m.px
    require(mask.meta.shape == m.meta.shape and (mask.meta.depth, mask.meta.channels) == ("8U", 1), "BadMask", "a mask is 8U, of one channel, of the same size")
    return m.px.join(mask.px.where("v <> 0").select("mat_id", "y", "x"), ["mat_id", "y", "x"], "left_semi")


def _all_channels(m: Mat, found: DataFrame, **columns: Column) -> DataFrame:
    """A row for each matrix and channel, also where nothing was selected."""
    ids = m.px.select("mat_id", "c").distinct()
    return ids.join(found, ["mat_id", "c"], "left").select("mat_id", "c", *[F.coalesce(v, F.lit(0.0)).alias(k) for k, v in columns.items()])


def _number(m: Mat) -> Column:
    """Integers add up exactly."""
    return F.col("v").cast("double" if m.meta.is_float else "bigint")


def total(m: Mat) -> DataFrame:
    """mat_id, c, s: the sum of each channel."""
    require(m.meta.channels <= 4, "BadArg", "up to 4 channels")
    return m.px.groupBy("mat_id", "c").agg(F.sum(_number(m)).cast("double").alias("s"))


def mean(m: Mat, mask: Mat | None = None) -> DataFrame:
    """mat_id, c, mean; 0 where nothing is selected."""
    found = _selected(m, mask).groupBy("mat_id", "c").agg((F.sum(_number(m)).cast("double") / F.count("*")).alias("mean"))
    return _all_channels(m, found, mean=F.col("mean")) if mask else found


def mean_std(m: Mat, mask: Mat | None = None) -> DataFrame:
    """mat_id, c, mean, std (of the population)."""
    v = F.col("v").cast("double")
    found = _selected(m, mask).groupBy("mat_id", "c").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    return _all_channels(m, found, mean=F.col("mean"), std=F.col("std")) if mask else found


def _norm(v: Column, kind: str, integer: bool) -> Column:
    v = v.cast("bigint" if integer else "double")
    n = {"INF": F.max(F.abs(v)).cast("double"), "L1": F.sum(F.abs(v)).cast("double"), "L2": F.sqrt(F.sum(v * v).cast("double"))}.get(kind)
    require(n is not None, "BadArg", f"no norm {kind}")
    n = F.coalesce(n, F.lit(0.0))
    return n if integer else F.when(F.bool_or(F.isnan(v)), F.lit(float("nan"))).otherwise(n)


def norm(m: Mat, kind: str = "L2", other: Mat | None = None, mask: Mat | None = None) -> DataFrame:
    """mat_id, norm: over all channels, of m or of m - other."""
    if other is None:
        return _selected(m, mask).groupBy("mat_id").agg(_norm(F.col("v"), kind, not m.meta.is_float).alias("norm"))
    same_kind(m, other)
    d = Mat(aligned(m, other).select(*KEY, (F.col("v").cast("double") - F.col("w").cast("double")).alias("v")), replace(m.meta, depth="64F"))
    return _selected(d, mask).groupBy("mat_id").agg(_norm(F.col("v"), kind, False).alias("norm"))


def _single(m: Mat) -> None:
    require(m.meta.channels == 1, "BadNumChannels", "one channel only")


def count_non_zero(m: Mat) -> DataFrame:
    _single(m)
    return m.px.groupBy("mat_id").agg(F.count_if(F.col("v") != 0).alias("n"))


def has_non_zero(m: Mat) -> DataFrame:
    _single(m)
    return m.px.groupBy("mat_id").agg(F.bool_or(F.col("v") != 0).alias("any"))


def find_non_zero(m: Mat) -> DataFrame:
    """mat_id, i, x, y: places by rows. The order number comes from a count of each row's places before it, not from a sort of all."""
    _single(m)
    found = m.px.where("v <> 0").groupBy("mat_id", "y").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    from pyspark.sql import Window

    before = F.coalesce(F.sum(F.size("xs")).over(Window.partitionBy("mat_id").orderBy("y").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.withColumn("before", before).select("mat_id", "y", "before", F.posexplode("xs").alias("k", "x")).select("mat_id", (F.col("before") + F.col("k")).alias("i"), "x", "y")


def min_max(m: Mat, mask: Mat | None = None, places: bool = True) -> DataFrame:
    """mat_id, lo, hi and the first place by rows of either (lo_x, lo_y, hi_x, hi_y). NaN is passed over; nothing selected: 0 and -1."""
    require(m.meta.channels == 1 or not (places or mask), "BadNumChannels", "places and masks need one channel")
    v = F.col("v").cast("double")
    rows = _selected(m, mask).where(~F.isnan(v))
    found = rows.groupBy("mat_id").agg(F.min(F.struct(v.alias("v"), "y", "x")).alias("lo"), F.max(F.struct(v.alias("v"), (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))).alias("hi"))
    out = m.px.select("mat_id").distinct().join(found, "mat_id", "left").select(
        "mat_id", F.coalesce("lo.v", F.lit(0.0)).alias("lo"), F.coalesce("hi.v", F.lit(0.0)).alias("hi"), F.coalesce("lo.x", F.lit(-1)).alias("lo_x"), F.coalesce("lo.y", F.lit(-1)).alias("lo_y"),
        F.coalesce(-F.col("hi.x"), F.lit(-1)).alias("hi_x"), F.coalesce(-F.col("hi.y"), F.lit(-1)).alias("hi_y"),
    )
    return out if places else out.select("mat_id", "lo", "hi")


def reduce(m: Mat, dim: int, how: str, depth: str | None = None) -> Mat:
    """dim 0: to one row; 1: to one column. SUM, AVG, MAX, MIN or SUM2; the result has the source's depth unless told otherwise, so sums of 8U saturate."""
    require(dim in (0, 1), "BadArg", "dim is 0 or 1")
    v = _number(m)
    f = {"SUM": F.sum(v), "AVG": F.sum(v).cast("double") / F.count("*"), "MAX": F.max(v), "MIN": F.min(v), "SUM2": F.sum(v * v)}.get(how)
    require(f is not None, "BadArg", f"no reduction {how}")
    keep, gone = ("x", "y") if dim == 0 else ("y", "x")
    to = depth or m.meta.depth
    px = m.px.groupBy("mat_id", keep, "c").agg(f.alias("v")).withColumn(gone, F.lit(0)).select(*KEY, saturate(F.col("v"), to).alias("v"))
    return Mat(px, replace(m.meta, depth=to, **({"rows": 1} if dim == 0 else {"cols": 1})))


def _arg(m: Mat, axis: int, last: bool, largest: bool) -> Mat:
    _single(m)
    keep, gone = ("x", "y") if axis == 0 else ("y", "x")
    at = F.col(gone)
    # of equal values the first place, or the last
    rank = F.struct(F.col("v"), (at if (largest and last) or (not largest and not last) else -at).alias("k"))
    best = (F.max_by if largest else F.min_by)(at, rank)
    px = m.px.groupBy("mat_id", keep).agg(best.alias("v")).select("mat_id", *[(F.col(k) if k == keep else F.lit(0)).alias(k) for k in ("y", "x")], F.lit(0).alias("c"), F.col("v").cast("int").alias("v"))
    return Mat(px, replace(m.meta, depth="32S", **({"rows": 1} if axis == 0 else {"cols": 1})))


def arg_min(m: Mat, axis: int, last: bool = False) -> Mat:
    return _arg(m, axis, last, largest=False)


def arg_max(m: Mat, axis: int, last: bool = False) -> Mat:
    return _arg(m, axis, last, largest=True)


def normalize(m: Mat, alpha: float = 1.0, beta: float = 0.0, kind: str = "L2", depth: str | None = None, mask: Mat | None = None) -> Mat:
    """MINMAX: to alpha .. beta (a constant matrix to the lower of them); INF, L1, L2: to norm alpha (0 stays 0). Not selected: 0. Each matrix's few numbers are joined back to its pixels."""
    v = F.col("v").cast("double")
    to = depth or m.meta.depth
    rows = _selected(m, mask)
    if kind == "MINMAX":
        lo, hi = min(alpha, beta), max(alpha, beta)
        s = rows.groupBy("mat_id").agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
        wide = F.col("hi") - F.col("lo")
        scale = F.when(wide > 0, (hi - lo) / F.when(wide > 0, wide)).otherwise(0.0)
        out = v * scale + (lo - F.col("lo") * scale)
    else:
        s = rows.groupBy("mat_id").agg(_norm(F.col("v"), kind, not m.meta.is_float).alias("n"))
        out = v * F.when(F.col("n") > 0, alpha / F.when(F.col("n") > 0, F.col("n"))).otherwise(0.0)
    done = rows.join(s, "mat_id").select(*KEY, saturate(out, to).alias("v"))
    if mask is not None:
        done = m.px.select(*KEY).join(done, KEY, "left").select(*KEY, F.coalesce("v", F.lit(0).cast(DEPTHS[to][2])).alias("v"))
    return Mat(done, replace(m.meta, depth=to))
