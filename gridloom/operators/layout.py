"""Layout, channel routing and concatenation: projections of coordinates, and unions of disjoint ones. Nothing here shuffles, but for masks and lookups."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.borders import border, pad
from gridloom.matrix import DEPTHS, KEY, Mat, require
from gridloom.operators.arithmetic import masked

border_interpolate = border


def copy_make_border(m: Mat, top: int, bottom: int, left: int, right: int, mode: str = "CONSTANT", value=0) -> Mat:
    return pad(m, top, bottom, left, right, mode, value)


def copy_to(m: Mat, mask: Mat, old: Mat | None = None) -> Mat:
    """m where the mask is not 0; elsewhere old, if it is of the same type and size, or 0."""
    return masked(m, mask, old if old is not None and old.meta == m.meta else None)


def _one_kind(mats: list[Mat], shape: bool = True) -> None:
    require(bool(mats), "BadArg", "no matrix is given")
    require(len({m.meta.depth for m in mats}) == 1, "UnmatchedFormats", "depths differ")
    require(not shape or len({m.meta.shape for m in mats}) == 1, "UnmatchedSizes", "sizes differ")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mix_channels(sources: list[Mat], targets: list[tuple[int, str]], pairs: list[tuple[int, int]]) -> list[Mat]:
    """targets: (channels, depth) of each result. pairs: flat channel from, flat channel to; from < 0 fills with 0, as are channels that no pair names."""
    _one_kind(sources)
    first = [(i, c) for i, s in enumerate(sources) for c in range(s.meta.channels)]
    last = [(i, c) for i, (n, _) in enumerate(targets) for c in range(n)]
    require(all(a < len(first) and 0 <= b < len(last) for a, b in pairs), "OutOfRange", "no such channel")
    route = {b: a for a, b in pairs}
    out: list[list[DataFrame]] = [[] for _ in targets]
    blank = sources[0].px.where("c = 0")
    for b, (i, c) in enumerate(last):
        a = route.get(b, -1)
        part = blank.select("mat_id", "y", "x", F.lit(c).alias("c"), F.lit(0).cast(DEPTHS[targets[i][1]][2]).alias("v"))
        if a >= 0:
            s, k = first[a]
            require(sources[s].meta.depth == targets[i][1], "UnmatchedFormats", "depths differ")
            part = sources[s].px.where(F.col("c") == k).select("mat_id", "y", "x", F.lit(c).alias("c"), "v")
        out[i].append(part)
    return [Mat(_union(p), replace(sources[0].meta, channels=n, depth=d)) for p, (n, d) in zip(out, targets, strict=True)]


def extract_channel(m: Mat, c: int) -> Mat:
    require(0 <= c < m.meta.channels, "OutOfRange", "no such channel")
    return Mat(m.px.where(F.col("c") == c).withColumn("c", F.lit(0)).select(*KEY, "v"), replace(m.meta, channels=1))


def insert_channel(one: Mat, m: Mat, c: int) -> Mat:
    _one_kind([one, m])
    require(one.meta.channels == 1 and 0 <= c < m.meta.channels, "OutOfRange", "no such channel")
    return Mat(m.px.where(F.col("c") != c).unionByName(one.px.withColumn("c", F.lit(c))), m.meta)


def merge(mats: list[Mat]) -> Mat:
    _one_kind(mats)
    parts, n = [], 0
    for m in mats:
        parts.append(m.px.select("mat_id", "y", "x", (F.col("c") + n).alias("c"), "v"))
        n += m.meta.channels
    return Mat(_union(parts), replace(mats[0].meta, channels=n))


def split(m: Mat) -> list[Mat]:
    return [extract_channel(m, c) for c in range(m.meta.channels)]


def flip(m: Mat, code: int) -> Mat:
    """0: upside down; above 0: left and right; below: both."""
    y, x = F.lit(m.meta.rows - 1) - F.col("y"), F.lit(m.meta.cols - 1) - F.col("x")
    return m.moved(**({"y": y} if code == 0 else {"x": x} if code > 0 else {"y": y, "x": x}))


def rotate(m: Mat, turns: str) -> Mat:
    """90_CW, 180 or 90_CCW."""
    h, w = m.meta.shape
    turned = replace(m.meta, rows=w, cols=h)
    if turns == "180":
        return flip(m, -1)
    require(turns in ("90_CW", "90_CCW"), "BadArg", f"no turn {turns}")
    return m.moved(turned, y=F.col("x"), x=F.lit(h - 1) - F.col("y")) if turns == "90_CW" else m.moved(turned, y=F.lit(w - 1) - F.col("x"), x=F.col("y"))


def repeat(m: Mat, ny: int, nx: int) -> Mat:
    require(ny > 0 and nx > 0, "BadArg", "at least once")
    h, w = m.meta.shape
    px = m.px.withColumn("ty", F.explode(F.sequence(F.lit(0), F.lit(ny - 1)))).withColumn("tx", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))))
    return Mat(px.select("mat_id", (F.col("y") + F.col("ty") * h).alias("y"), (F.col("x") + F.col("tx") * w).alias("x"), "c", "v"), replace(m.meta, rows=h * ny, cols=w * nx))


def _concat(mats: list[Mat], axis: str) -> Mat:
    _one_kind(mats, shape=False)
    other = "rows" if axis == "x" else "cols"
    require(len({(getattr(m.meta, other), m.meta.channels) for m in mats}) == 1, "UnmatchedSizes", "sizes differ")
    parts, n = [], 0
    for m in mats:
        parts.append(m.px.select(*[(F.col(k) + n).alias(k) if k == axis else F.col(k) for k in KEY], "v"))
        n += m.meta.cols if axis == "x" else m.meta.rows
    return Mat(_union(parts), replace(mats[0].meta, **{"cols" if axis == "x" else "rows": n}))


def hconcat(mats: list[Mat]) -> Mat:
    return _concat(mats, "x")


def vconcat(mats: list[Mat]) -> Mat:
    return _concat(mats, "y")


def broadcast_to(m: Mat, rows: int, cols: int) -> Mat:
    """Axes of extent 1 are repeated."""
    h, w = m.meta.shape
    require(h in (1, rows) and w in (1, cols), "UnmatchedSizes", "only axes of extent 1 can be repeated")
    return repeat(m, rows if h == 1 else 1, cols if w == 1 else 1)


def transpose(m: Mat) -> Mat:
    return m.moved(replace(m.meta, rows=m.meta.cols, cols=m.meta.rows), y=F.col("x"), x=F.col("y"))


def swap(a: Mat, b: Mat) -> tuple[Mat, Mat]:
    return b, a


# any number of axes: idx array<int>, v


def _axes(i: int, n: int) -> int:
    require(-n <= i < n, "OutOfRange", "no such axis")
    return i % n


def flip_nd(df: DataFrame, shape: tuple[int, ...], axis: int) -> DataFrame:
    k = _axes(axis, len(shape))
    at: list[Column] = [F.lit(n - 1) - F.col("idx")[i] if i == k else F.col("idx")[i] for i, n in enumerate(shape)]
    return df.withColumn("idx", F.array(*at))


def transpose_nd(df: DataFrame, shape: tuple[int, ...], order: list[int]) -> DataFrame:
    require(sorted(order) == list(range(len(shape))), "BadArg", "not an order of the axes")
    return df.withColumn("idx", F.array(*[F.col("idx")[i] for i in order]))


def broadcast_nd(df: DataFrame, shape: tuple[int, ...], to: tuple[int, ...]) -> DataFrame:
    """Trailing axes are matched; those of extent 1, and those in front, are repeated."""
    lead = len(to) - len(shape)
    require(lead >= 0 and all(s in (1, t) for s, t in zip(shape, to[lead:], strict=True)), "UnmatchedSizes", "shapes don't match")
    out, at = df, []
    for i, t in enumerate(to):
        if i >= lead and shape[i - lead] == t:
            at.append(F.col("idx")[i - lead])
        else:
            out = out.withColumn(f"k{i}", F.explode(F.sequence(F.lit(0), F.lit(t - 1))))
            at.append(F.col(f"k{i}"))
    return out.select(*[c for c in df.columns if c != "idx"], F.array(*at).alias("idx"))
