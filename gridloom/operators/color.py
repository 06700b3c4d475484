"""Colour conversion: a pixel's channels side by side, arithmetic, and channels back in rows.

wide() gathers a pixel's channels with one aggregate; sums that need no rounding in between are aggregated directly.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.matrix import DEPTHS, Mat, Meta, require, saturate

PIXEL = ["mat_id", "y", "x"]


def wide(m: Mat) -> DataFrame:
    """mat_id, y, x, c0, c1, ..."""
    return m.px.groupBy(*PIXEL).agg(*[F.max(F.when(F.col("c") == k, F.col("v"))).alias(f"c{k}") for k in range(m.meta.channels)])


def narrow(df: DataFrame, meta: Meta, *values: Column, keep: tuple[str, ...] = ("mat_id", "y", "x")) -> Mat:
    """A row for each channel; values are cast, not rounded."""
    v = F.array(*[v.cast(DEPTHS[meta.depth][2]) for v in values])
    return Mat(df.select(*keep, F.posexplode(v).alias("c", "v")).select("mat_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "c", "v"), meta)


def _check(m: Mat, channels: tuple[int, ...], depths: tuple[str, ...] = ("8U", "32F")) -> None:
    require(m.meta.channels in channels and m.meta.depth in depths, "BadArg", f"a source of {channels} channels, {depths}")


def to_gray(m: Mat, rgb: bool = False) -> Mat:
    """8U: 16 bit fixed point; 32F: weights. A fourth channel is ignored."""
    _check(m, (3, 4))
    order = (19595, 38470, 7471) if rgb else (7471, 38470, 19595)
    part = F.element_at(F.array(*map(F.lit, (*order, 0))), F.col("c") + 1)
    if m.meta.depth == "8U":
        v = F.shiftright(F.sum(part * F.col("v")) + 32768, 16).cast("int")
    else:
        weights = (0.299, 0.587, 0.114) if rgb else (0.114, 0.587, 0.299)
        v = F.sum(F.element_at(F.array(*[F.lit(w) for w in (*weights, 0.0)]), F.col("c") + 1) * F.col("v").cast("double")).cast("float")
    return Mat(m.px.groupBy(*PIXEL).agg(v.alias("v")).select(*PIXEL, F.lit(0).alias("c"), "v"), replace(m.meta, channels=1))


def _alpha(m: Mat) -> Column:
    return F.lit(255 if m.meta.depth == "8U" else 1.0).cast(DEPTHS[m.meta.depth][2])


def from_gray(m: Mat, channels: int = 3) -> Mat:
    _check(m, (1,))
    px = m.px.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(channels - 1)))).withColumn("v", F.when(F.col("c") == 3, _alpha(m)).otherwise(F.col("v")))
    return Mat(px, replace(m.meta, channels=channels))


def swap_rb(m: Mat) -> Mat:
    _check(m, (3, 4))
    return m.moved(c=F.when(F.col("c") < 3, 2 - F.col("c")).otherwise(F.col("c")))


def add_alpha(m: Mat, swap: bool = False) -> Mat:
    _check(m, (3,))
    alpha = m.px.where("c = 0").select(*PIXEL, F.lit(3).alias("c"), _alpha(m).alias("v"))
    return Mat((swap_rb(m) if swap else m).px.unionByName(alpha), replace(m.meta, channels=4))


def drop_alpha(m: Mat, swap: bool = False) -> Mat:
    _check(m, (4,))
    return Mat((swap_rb(m) if swap else m).px.where("c < 3"), replace(m.meta, channels=3))


def to_yuv(m: Mat, rgb: bool = False) -> Mat:
    """Full range."""
    _check(m, (3,))
    f = lambda k: F.col(f"c{k}").cast("double")
    r, g, b = (f(0), f(1), f(2)) if rgb else (f(2), f(1), f(0))
    delta = 128.0 if m.meta.depth == "8U" else 0.5
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return narrow(wide(m), m.meta, *[saturate(v, m.meta.depth) for v in (y, 0.492 * (b - y) + delta, 0.877 * (r - y) + delta)])


def from_yuv(m: Mat, rgb: bool = False) -> Mat:
    _check(m, (3,))
    delta = 128.0 if m.meta.depth == "8U" else 0.5
    y, u, v = F.col("c0").cast("double"), F.col("c1").cast("double") - delta, F.col("c2").cast("double") - delta
    out = [saturate(x, m.meta.depth) for x in (y + 2.032 * u, y - 0.395 * u - 0.581 * v, y + 1.140 * v)]
    return narrow(wide(m), m.meta, *(out[::-1] if rgb else out))


# limited range, 8 bits


def decoded(y: Column, u: Column, v: Column, rgb: bool) -> list[Column]:
    """Blue, green, red of a pixel, or the other way round."""
    c, d, e = F.greatest(y - 16, F.lit(0)), u - 128, v - 128
    clip = lambda x: F.least(F.greatest(F.shiftright(x + 128, 8), F.lit(0)), F.lit(255))
    out = [clip(298 * c + 516 * d), clip(298 * c - 100 * d - 208 * e), clip(298 * c + 409 * e)]
    return out[::-1] if rgb else out


def encoded(b: Column, g: Column, r: Column) -> list[Column]:
    """Y, U, V of a pixel."""
    clip = lambda x: F.least(F.greatest(x, F.lit(0)), F.lit(255))
    y = F.shiftright(66 * r + 129 * g + 25 * b + 128, 8) + 16
    u = F.shiftright(-38 * r - 74 * g + 112 * b + 128, 8) + 128
    v = F.shiftright(112 * r - 94 * g - 18 * b + 128, 8) + 128
    return [clip(y), clip(u), clip(v)]


#: For each format how many pixels share a chroma sample across and down, and how the samples lie: after the luma plane in pairs ("pairs") or planes ("planes"), or packed with it.
FORMATS = {
    "NV12": (2, 2, "pairs", "UV"), "NV21": (2, 2, "pairs", "VU"), "I420": (2, 2, "planes", "UV"), "YV12": (2, 2, "planes", "VU"), "NV16": (2, 1, "pairs", "UV"), "NV61": (2, 1, "pairs", "VU"),
    "NV24": (1, 1, "pairs", "UV"), "NV42": (1, 1, "pairs", "VU"), "I444": (1, 1, "planes", "UV"), "YV24": (1, 1, "planes", "VU"), "YUY2": (2, 1, "packed", "UV"), "UYVY": (2, 1, "packed", "UV"),
}


def _size(form: str, rows: int, cols: int) -> tuple[int, int, int]:
    """Rows and columns of the plane that holds a picture, and its channels."""
    sx, sy, kind, _ = FORMATS[form]
    require(rows % sy == 0 and cols % sx == 0, "BadSize", "even sizes")
    if kind == "packed":
        return rows, cols, 2
    return rows + 2 * rows // (sx * sy), cols, 1


def _chroma_place(form: str, rows: int, cols: int, which: Column, cy: Column, cx: Column) -> tuple[Column, Column]:
    """Row and column of a chroma sample (which: 0 U, 1 V) below the luma plane."""
    sx, sy, kind, order = FORMATS[form]
    w, n = cols // sx, (rows // sy) * (cols // sx)
    second = which if order == "UV" else 1 - which
    i = (cy * w + cx) * 2 + second if kind == "pairs" else second * n + cy * w + cx
    return F.lit(rows) + F.floor(i / cols).cast("int"), F.pmod(i, F.lit(cols)).cast("int")


def decode_yuv(m: Mat, form: str, rgb: bool = False) -> Mat:
    """From one of FORMATS to 3 channels, 8U. Each sample is sent to the pixels that it serves, and a pixel's three are gathered by one aggregate; no join."""
    sx, sy, kind, order = FORMATS[form]
    require(m.meta.depth == "8U" and m.meta.channels == (2 if kind == "packed" else 1), "BadArg", "8U, of one channel, or two if packed")
    if kind == "packed":
        rows, cols = m.meta.shape
        luma = 0 if form == "YUY2" else 1
        which = F.when(F.col("c") == luma, 0).when(F.col("x") % 2 == 0, 1).otherwise(2)
        sent = m.px.select("mat_id", "y", which.alias("k"), "v", F.explode(F.when(F.col("c") == luma, F.array("x")).otherwise(F.array(F.col("x") - F.col("x") % 2, F.col("x") - F.col("x") % 2 + 1))).alias("x"))
    else:
        parts = 1 + 2 / (sx * sy)
        rows, cols = round(m.meta.rows / parts), m.meta.cols
        require(_size(form, rows, cols)[0] == m.meta.rows, "BadSize", "not the rows of this format")
        w, n = cols // sx, (rows // sy) * (cols // sx)
        i = (F.col("y") - rows) * cols + F.col("x")
        second = F.pmod(i, F.lit(2)) if kind == "pairs" else F.floor(i / n)
        j = F.floor(i / 2) if kind == "pairs" else F.pmod(i, F.lit(n))
        k = 1 + (second if order == "UV" else 1 - second)
        cy, cx = F.floor(j / w).cast("int"), F.pmod(j, F.lit(w)).cast("int")
        places = F.array(*[F.struct((cy * sy + a).alias("y"), (cx * sx + b).alias("x")) for a in range(sy) for b in range(sx)])
        inside = F.col("y") < rows
        sent = m.px.select("mat_id", F.when(inside, 0).otherwise(k).cast("int").alias("k"), "v", F.explode(F.when(inside, F.array(F.struct("y", "x"))).otherwise(places)).alias("p"))
        sent = sent.select("mat_id", "p.y", "p.x", "k", "v")
    pixel = sent.groupBy(*PIXEL).agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"c{k}") for k in range(3)])
    return narrow(pixel, Meta(rows, cols, 3), *decoded(F.col("c0"), F.col("c1"), F.col("c2"), rgb))


def decode_two_planes(y: Mat, uv: Mat, order: str = "UV", rgb: bool = False) -> Mat:
    """A luma plane, and a half-size plane of two channels: NV12, or NV21 by order VU."""
    require(y.meta.depth == uv.meta.depth == "8U" and y.meta.channels == 1 and uv.meta.channels == 2, "BadArg", "8U of one channel, and of two")
    require(y.meta.rows == 2 * uv.meta.rows and y.meta.cols == 2 * uv.meta.cols, "BadSize", "the second plane is half as large")
    spread = F.array(*[F.struct((F.col("y") * 2 + a).alias("y"), (F.col("x") * 2 + b).alias("x")) for a in (0, 1) for b in (0, 1)])
    k = F.col("c") + 1 if order == "UV" else 2 - F.col("c")
    sent = uv.px.select("mat_id", k.alias("k"), "v", F.explode(spread).alias("p")).select("mat_id", "p.y", "p.x", "k", "v").unionByName(y.px.select("mat_id", "y", "x", F.lit(0).alias("k"), "v"))
    pixel = sent.groupBy(*PIXEL).agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"c{k}") for k in range(3)])
    return narrow(pixel, Meta(y.meta.rows, y.meta.cols, 3), *decoded(F.col("c0"), F.col("c1"), F.col("c2"), rgb))


def encode_yuv(m: Mat, form: str, rgb: bool = False) -> Mat:
    """To one of FORMATS. Chroma comes from the mean colour, rounded, of the pixels that share a sample."""
    _check(m, (3,), ("8U",))
    sx, sy, kind, order = FORMATS[form]
    rows, cols = m.meta.shape
    out_rows, out_cols, channels = _size(form, rows, cols)
    px = wide(m)
    b, g, r = ("c2", "c1", "c0") if rgb else ("c0", "c1", "c2")
    n = sx * sy
    shift = {1: 0, 2: 1, 4: 2}[n]
    mean = lambda k: F.shiftright(F.sum(k) + n // 2, shift).cast("int") if n > 1 else F.max(k)
    luma = px.select(*PIXEL, encoded(F.col(b), F.col(g), F.col(r))[0].alias("v"))
    cells = px.groupBy("mat_id", F.floor(F.col("y") / sy).cast("int").alias("cy"), F.floor(F.col("x") / sx).cast("int").alias("cx")).agg(mean(b).alias("b"), mean(g).alias("g"), mean(r).alias("r"))
    _, u, v = encoded(F.col("b"), F.col("g"), F.col("r"))
    samples = cells.select("mat_id", "cy", "cx", F.posexplode(F.array(u, v)).alias("which", "v"))
    meta = Meta(out_rows, out_cols, channels)
    if kind == "packed":
        at, other = (0, 1) if form == "YUY2" else (1, 0)
        low = samples.select("mat_id", F.col("cy").alias("y"), (F.col("cx") * 2 + F.col("which")).alias("x"), F.lit(other).alias("c"), "v")
        return Mat(luma.select(*PIXEL, F.lit(at).alias("c"), "v").unionByName(low), meta)
    y, x = _chroma_place(form, rows, cols, F.col("which"), F.col("cy"), F.col("cx"))
    low = samples.select("mat_id", y.alias("y"), x.alias("x"), F.lit(0).alias("c"), "v")
    return Mat(luma.select(*PIXEL, F.lit(0).alias("c"), "v").unionByName(low), meta)


def demosaic(m: Mat, pattern: str) -> Mat:
    """Bayer patterns BG, GB, RG, GR (as named by the second row's second and third pixel), to blue, green, red: the mean, halves to even, of the neighbours of a colour; the outer ring is copied from inside."""
    from gridloom.operators.filters import scattered

    require(pattern in ("BG", "GB", "RG", "GR"), "BadFlag", f"no pattern {pattern}")
    _check(m, (1,), ("8U",))
    rows, cols = m.meta.shape
    meta = replace(m.meta, channels=3)
    if rows <= 2 or cols <= 2:
        return narrow(m.px, meta, *[F.lit(0)] * 3)
    red_y, red_x = {"BG": (0, 0), "GB": (0, 1), "RG": (1, 1), "GR": (1, 0)}[pattern]
    of = lambda y, x: F.when((y % 2 == red_y) & (x % 2 == red_x), 2).when((y % 2 != red_y) & (x % 2 != red_x), 0).otherwise(1)
    sent = scattered(m.px.withColumn("k", of(F.col("y"), F.col("x"))), [(dy, dx, 1.0) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    inner = sent.where(F.col("oy").between(1, rows - 2) & F.col("ox").between(1, cols - 2))
    own = (F.col("y") == F.col("oy")) & (F.col("x") == F.col("ox"))
    pixel = inner.groupBy("mat_id", "oy", "ox").agg(
        *[F.coalesce(F.max(F.when(own & (F.col("k") == k), F.col("v"))), F.rint(F.avg(F.when(~own & (F.col("k") == k), F.col("v")))).cast("int")).alias(f"c{k}") for k in range(3)]
    )
    # a pixel next to the frame also stands on it
    reach = lambda p, n: F.concat(F.array(p), F.when(p == 1, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), F.when(p == n - 2, F.array(F.lit(n - 1))).otherwise(F.array().cast("array<int>")))
    framed = pixel.withColumn("y", F.explode(reach(F.col("oy"), rows))).withColumn("x", F.explode(reach(F.col("ox"), cols)))
    return narrow(framed, meta, *[F.col(f"c{k}") for k in range(3)])


def convert(m: Mat, code: str) -> Mat:
    """By the code's name, as BGR2GRAY, YUV2RGB_NV12, BGR2YUV_YUY2 or BayerBG2BGR."""
    if code.startswith("Bayer") and code[7:] in ("2BGR", "2RGB"):
        # the RGB names are the BGR ones of the pattern with red and blue exchanged
        name = code[5:7]
        out = demosaic(m, name)
        return swap_rb(out) if code.endswith("RGB") else out
    head, _, form = code.partition("_")
    source, _, target = head.partition("2")
    if form:
        require(form in FORMATS, "NotImplemented", f"no conversion {code}")
        if source == "YUV" and target in ("BGR", "RGB"):
            return decode_yuv(m, form, target == "RGB")
        require(target == "YUV" and source in ("BGR", "RGB"), "NotImplemented", f"no conversion {code}")
        return encode_yuv(m, form, source == "RGB")
    colours = ("BGR", "RGB", "BGRA", "RGBA")
    if target == "GRAY" and source in colours:
        require(m.meta.channels == len(source), "BadArg", f"{len(source)} channels")
        return to_gray(m, source.startswith("RGB"))
    if source == "GRAY" and target in colours:
        return from_gray(m, len(target))
    if target == "YUV" and source in ("BGR", "RGB"):
        return to_yuv(m, source == "RGB")
    if source == "YUV" and target in ("BGR", "RGB"):
        return from_yuv(m, target == "RGB")
    require(source in colours and target in colours and source != target, "NotImplemented", f"no conversion {code}")
    require(m.meta.channels == len(source), "BadArg", f"{len(source)} channels")
    swap = source[:3] != target[:3]
    if len(source) == len(target):
        return swap_rb(m)
    return add_alpha(m, swap) if len(target) == 4 else drop_alpha(m, swap)
