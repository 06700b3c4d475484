"""Queries of colour, intensity, filters, morphology, pyramids, edges, geometry, sources and streams."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from gridloom.functions import kernels as kn
from gridloom.matrix import Mat, Meta
from gridloom.operators import canny as cn
from gridloom.operators import color as co
from gridloom.operators import filters as fi
from gridloom.operators import geometry as ge
from gridloom.operators import intensity as it
from gridloom.operators import layout as lo
from gridloom.operators import morphology as mo
from gridloom.operators import pyramid as py
from gridloom.plans.fixtures import daily, gray, heat, p1, pattern, ship
from gridloom.plans.registry import query

SAT8 = "least(greatest(round(({})::double), 0), 255)::int"
WIDE = "w as (select y, x, max(v) filter (c = 0) b, max(v) filter (c = 1) g, max(v) filter (c = 2) r from ship group by y, x)"


def _clip(e: str) -> str:
    return f"least(greatest({e}, 0), 255)"


def _channels(*values: str, source: str = "w") -> str:
    return " union all ".join(f"select y::int y, x::int x, {c} c, ({v})::int v from {source}" for c, v in enumerate(values))


# colour

query("ship_bgr2gray", lambda s, d: co.convert(ship(s, d), "BGR2GRAY"), "select y, x, 0 c, ((7471 * b + 38470 * g + 19595 * r + 32768) >> 16)::int v from w", WIDE)
query("ship_rgb2gray", lambda s, d: co.convert(ship(s, d), "RGB2GRAY"), "select y, x, 0 c, ((19595 * b + 38470 * g + 7471 * r + 32768) >> 16)::int v from w", WIDE)
query("bgra2gray", lambda s, d: co.convert(co.convert(ship(s, d), "BGR2BGRA"), "BGRA2GRAY"), "select y, x, 0 c, ((7471 * b + 38470 * g + 19595 * r + 32768) >> 16)::int v from w", WIDE)
query("rgba2gray", lambda s, d: co.convert(co.convert(ship(s, d), "BGR2RGBA"), "RGBA2GRAY"), "select y, x, 0 c, ((7471 * b + 38470 * g + 19595 * r + 32768) >> 16)::int v from w", WIDE)
query("gray2bgr", lambda s, d: co.convert(heat(s, d), "GRAY2BGR"), "select y, x, k::int c, v from heat, range(0, 3) t(k)")
query("gray2bgra", lambda s, d: co.convert(heat(s, d), "GRAY2BGRA"), "select y, x, k::int c, case when k = 3 then 255 else v end v from heat, range(0, 4) t(k)")
query("ship_bgr2rgb", lambda s, d: co.convert(ship(s, d), "BGR2RGB"), "select y, x, 2 - c c, v from ship")
query("ship_bgr2bgra", lambda s, d: co.convert(ship(s, d), "BGR2BGRA"), "select y, x, c, v from ship union all select y, x, 3, 255 from ship where c = 0")
query("ship_bgr2rgba", lambda s, d: co.convert(ship(s, d), "BGR2RGBA"), "select y, x, 2 - c c, v from ship union all select y, x, 3, 255 from ship where c = 0")
query("ship_bgra2rgb", lambda s, d: co.convert(co.convert(ship(s, d), "BGR2BGRA"), "BGRA2RGB"), "select y, x, 2 - c c, v from ship")
query("ship_bgra2rgba", lambda s, d: co.convert(co.convert(ship(s, d), "BGR2BGRA"), "BGRA2RGBA"), "select y, x, 2 - c c, v from ship union all select y, x, 3, 255 from ship where c = 0")
_Y = "(0.299::double * r + 0.587::double * g + 0.114::double * b)"
query("ship_bgr2yuv", lambda s, d: co.convert(ship(s, d), "BGR2YUV"), _channels(SAT8.format(_Y), SAT8.format(f"0.492::double * (b - {_Y}) + 128"), SAT8.format(f"0.877::double * (r - {_Y}) + 128")), WIDE)
query("ship_yuv2bgr", lambda s, d: co.convert(ship(s, d), "YUV2BGR"), _channels(SAT8.format("b + 2.032::double * (g - 128)"), SAT8.format("b - 0.395::double * (g - 128) - 0.581::double * (r - 128)"), SAT8.format("b + 1.14::double * (r - 128)")), WIDE)


def _decode(y: str, u: str, v: str) -> list[str]:
    c, d, e = f"greatest({y} - 16, 0)", f"({u} - 128)", f"({v} - 128)"
    return [_clip(f"(298 * {c} + 516 * {d} + 128) >> 8"), _clip(f"(298 * {c} - 100 * {d} - 208 * {e} + 128) >> 8"), _clip(f"(298 * {c} + 409 * {e} + 128) >> 8")]


def _encode(b: str, g: str, r: str) -> list[str]:
    return [_clip(f"((66 * {r} + 129 * {g} + 25 * {b} + 128) >> 8) + 16"), _clip(f"((-38 * {r} - 74 * {g} + 112 * {b} + 128) >> 8) + 128"), _clip(f"((112 * {r} - 94 * {g} - 18 * {b} + 128) >> 8) + 128")]


# where the samples of a 64 x 48 plane lie, by format: its rows of luma, and the linear place of U and V below them
_LAY = {
    "NV12": (42, 2, 2, "(y // 2 * 24 + x // 2) * 2", "(y // 2 * 24 + x // 2) * 2 + 1"), "NV21": (42, 2, 2, "(y // 2 * 24 + x // 2) * 2 + 1", "(y // 2 * 24 + x // 2) * 2"),
    "I420": (42, 2, 2, "y // 2 * 24 + x // 2", "21 * 24 + y // 2 * 24 + x // 2"), "YV12": (42, 2, 2, "21 * 24 + y // 2 * 24 + x // 2", "y // 2 * 24 + x // 2"),
    "NV16": (32, 2, 1, "(y * 24 + x // 2) * 2", "(y * 24 + x // 2) * 2 + 1"), "NV61": (32, 2, 1, "(y * 24 + x // 2) * 2 + 1", "(y * 24 + x // 2) * 2"),
    "NV24": (21, 1, 1, "(y * 48 + x) * 2", "(y * 48 + x) * 2 + 1"), "NV42": (21, 1, 1, "(y * 48 + x) * 2 + 1", "(y * 48 + x) * 2"),
    "I444": (21, 1, 1, "y * 48 + x", "21 * 48 + y * 48 + x"), "YV24": (21, 1, 1, "21 * 48 + y * 48 + x", "y * 48 + x"),
}
for _form, (_rows, _sx, _sy, _u, _v) in _LAY.items():
    _plane = _rows + 2 * _rows // (_sx * _sy)
    query(
        f"yuv2bgr_{_form.lower()}", lambda s, d, f=_form, p=_plane: co.convert(heat(s, d).roi(0, p, 0, 48).clone(), f"YUV2BGR_{f}"),
        _channels(*_decode("l", "u", "v")), f"p as (select y * 48 + x i, v from heat where y < {_plane})",
        f"w as (select a.y, a.x, l.v l, u.v u, v.v v from (select y, x from range(0, {_rows}) q(y), range(0, 48) r(x)) a join p l on l.i = y * 48 + x join p u on u.i = {_rows} * 48 + {_u} join p v on v.i = {_rows} * 48 + {_v})",
    )
    _n = _sx * _sy
    _w = WIDE.replace("from ship", "from (select y, x, c, v from ship where y < 64 and x < 48)") + f", m as (select y // {_sy} cy, x // {_sx} cx, " + ", ".join(f"((sum({k}) + {_n // 2}) // {_n})::int {k}" for k in "bgr") + " from w group by 1, 2)"
    _place = lambda e: e.replace("21 * 24", f"{64 // _sy} * 24").replace("21 * 48", "64 * 48").replace("y // 2", "cy").replace("x // 2", "cx")
    _pu, _pv = _place(_u), _place(_v)
    if _sy == 1:
        _pu, _pv = (e.replace("y *", "cy *").replace("ccy", "cy").replace("+ x", "+ cx").replace("ccx", "cx") for e in (_pu, _pv))
    _e = _encode("b", "g", "r")
    query(
        f"bgr2yuv_{_form.lower()}", lambda s, d, f=_form: co.convert(ship(s, d).roi(0, 64, 0, 48).clone(), f"BGR2YUV_{f}"),
        f"select y, x, 0 c, ({_e[0]})::int v from w union all select (64 + ({_pu}) // 48)::int, (({_pu}) % 48)::int, 0, ({_e[1]})::int from m union all select (64 + ({_pv}) // 48)::int, (({_pv}) % 48)::int, 0, ({_e[2]})::int from m", _w,
    )
for _form, _l in (("YUY2", 0), ("UYVY", 1)):
    query(
        f"yuv2rgb_{_form.lower()}", lambda s, d, f=_form: co.convert(Mat(ship(s, d).px.where("c < 2"), Meta(64, 64, 2)), f"YUV2RGB_{f}"), _channels(*_decode("l", "u", "v")[::-1]),
        f"w as (select l.y, l.x, l.v l, u.v u, v.v v from ship l join ship u on u.y = l.y and u.x = l.x // 2 * 2 and u.c = {1 - _l} join ship v on v.y = l.y and v.x = l.x // 2 * 2 + 1 and v.c = {1 - _l} where l.c = {_l})",
    )
    _e = _encode("b", "g", "r")
    query(
        f"bgr2yuv_{_form.lower()}", lambda s, d, f=_form: co.convert(ship(s, d), f"BGR2YUV_{f}"),
        f"select y, x, {_l} c, ({_e[0]})::int v from w union all select y, (cx * 2)::int, {1 - _l}, ({_e[1]})::int from m union all select y, (cx * 2 + 1)::int, {1 - _l}, ({_e[2]})::int from m",
        WIDE, "m as (select y, x // 2 cx, ((sum(b) + 1) // 2)::int b, ((sum(g) + 1) // 2)::int g, ((sum(r) + 1) // 2)::int r from w group by 1, 2)",
    )
query(
    "cvt_two_plane", lambda s, d: co.decode_two_planes(gray(s, d), Mat(pattern(s).px.where("c < 2 and y < 16 and x < 24"), Meta(16, 24, 2))), _channels(*_decode("l", "u", "v")),
    "w as (select g.y, g.x, g.v l, u.v u, v.v v from gray g join pattern u on u.y = g.y // 2 and u.x = g.x // 2 and u.c = 0 join pattern v on v.y = g.y // 2 and v.x = g.x // 2 and v.c = 1)",
)
for _p, (_ry, _rx) in {"BG": (0, 0), "GB": (0, 1), "RG": (1, 1), "GR": (1, 0)}.items():
    query(
        f"demosaic_{_p.lower()}", lambda s, d, p=_p: co.convert(heat(s, d), f"Bayer{p}2BGR"),
        """select g.y::int y, g.x::int x, k::int c, coalesce(max(n.v) filter (n.y = sy and n.x = sx and n.k = t.k), round_even(avg(n.v) filter (n.k = t.k), 0))::int v
        from (select y, x, least(greatest(y, 1), 62) sy, least(greatest(x, 1), 46) sx from range(0, 64) a(y), range(0, 48) b(x)) g cross join range(0, 3) t(k) join k n on abs(n.y - sy) <= 1 and abs(n.x - sx) <= 1
        group by g.y, g.x, t.k""".replace("k::int c", "t.k::int c"),
        f"k as (select y, x, v, case when y % 2 = {_ry} and x % 2 = {_rx} then 2 when y % 2 <> {_ry} and x % 2 <> {_rx} then 0 else 1 end k from heat)",
    )

# thresholds, histograms, tables

for _k, _sql in (("BINARY", "case when v > 96 then 200 else 0 end"), ("BINARY_INV", "case when v > 96 then 0 else 200 end"), ("TRUNC", "least(v, 96)"), ("TOZERO", "case when v > 96 then v else 0 end"), ("TOZERO_INV", "case when v > 96 then 0 else v end")):
    query(f"heat_threshold_{_k.lower()}", lambda s, d, k=_k: it.threshold(heat(s, d), 96.7, 200, k), f"select y, x, c, ({_sql})::int v from heat")
_OTSU = "h as (select v, count(*) n from heat group by v), o as (select v, sum(n) over (order by v) nb, sum(n * v) over (order by v) sb, sum(n) over () n, sum(n * v) over () s from h), t as (select arg_max(v, (b, -v)) t from (select v, nb::double * (n - nb)::double * (sb::double / nb - (s - sb)::double / (n - nb)) * (sb::double / nb - (s - sb)::double / (n - nb)) b from o where n > nb))"
query("heat_otsu", lambda s, d: it.otsu(heat(s, d), unparted=None).select("thresh"), "select t::double thresh from t", _OTSU)
query("heat_threshold_otsu", lambda s, d: it.threshold(heat(s, d), 0, 255, auto="OTSU", unparted=None), "select y, x, c, case when v > t then 255 else 0 end v from heat, t", _OTSU)
query(
    "heat_triangle", lambda s, d: it.triangle(heat(s, d)).select("thresh"),
    "select case when f then 255 - (t - 1) else t - 1 end::double thresh from (select any_value(f) f, coalesce(arg_max(i, (top * i + (lo - pk) * n, -i)) filter (i > lo and i <= pk and top * i + (lo - pk) * n > 0), any_value(lo)) t from m)",
    "h as (select i, count(heat.v) n from range(0, 256) r(i) left join heat on heat.v = i group by i)",
    "b as (select greatest(min(i) filter (n > 0) - 1, 0) l, least(max(i) filter (n > 0) + 1, 255) r, max(n) top, arg_max(i, (n, -i)) p from h)",
    "m as (select case when p - l < r - p then 255 - i else i end i, n, top, p - l < r - p f, case when p - l < r - p then 255 - r else l end lo, case when p - l < r - p then 255 - p else p end pk from h, b)",
)
query("threshold_masked", lambda s, d: it.threshold(p1(s, d), 100, 255, mask=gray(s, d), old=p1(s, d)), "select p.y, p.x, p.c, case when g.v = 0 then p.v when p.v > 100 then 255 else 0 end v from p1 p join gray g using (y, x)")
query("threshold_dry_run", lambda s, d: it.used_threshold(heat(s, d), 96.7).select("thresh"), "select 96::double thresh")


def _border(p: str, n: int, mode: str) -> str:
    if mode == "REPLICATE":
        return f"least(greatest({p}, 0), {n - 1})"
    q = f"((({p}) + {2 * n - 2}) % {2 * n - 2})"
    return f"least({q}, {2 * n - 2} - {q})"


def conv(taps, mode: str, how: str = "sum(t.w * s.v)", source: str = "heat", rows: int = 64, cols: int = 48) -> str:
    """y, x, c, v: an aggregate over the taps (dy, dx, w) of each place, by gathering."""
    values = ", ".join(f"({a}, {b}, {w!r}::double)" for a, b, w in taps)
    at = f"s.y = {_border('o.y + t.dy', rows, mode)} and s.x = {_border('o.x + t.dx', cols, mode)}" if mode != "CONSTANT" else "s.y = o.y + t.dy and s.x = o.x + t.dx"
    return f"select o.y, o.x, o.c, {how} v from {source} o cross join (values {values}) t(dy, dx, w) join {source} s on {at} and s.c = o.c group by o.y, o.x, o.c"


def _taps(k) -> list:
    return fi.taps_of(np.asarray(k, dtype=float))


ONES3, ONES5 = _taps(np.ones((3, 3))), _taps(np.ones((5, 5)))
_MEAN3 = "least(round((v::float * (1.0 / 9)::float)::double), 255)::int"
query("adaptive_threshold_mean", lambda s, d: it.adaptive_threshold(heat(s, d), 255, "MEAN", "BINARY", 3, 2.5), f"select h.y, h.x, h.c, case when h.v - {_MEAN3.replace('v::', 's.v::')} > -3 then 255 else 0 end v from heat h join s using (y, x)", f"s as ({conv(ONES3, 'REPLICATE')})")
query("adaptive_threshold_gaussian", lambda s, d: it.adaptive_threshold(heat(s, d), 255, "GAUSSIAN", "BINARY_INV", 3, 2.5), "select h.y, h.x, h.c, case when h.v - least(round(s.v), 255)::int > -2 then 0 else 255 end v from heat h join s using (y, x)", f"s as ({conv(_taps(np.outer(kn.blur_gaussian(3, 0), kn.blur_gaussian(3, 0))), 'REPLICATE')})")
query("heat_equalize_hist", lambda s, d: it.equalize_hist(heat(s, d)), "select heat.y, heat.x, heat.c, t.t v from heat join t using (v)", "h as (select v, count(*) n from heat group by v)", "t as (select v, least(round_even(((sum(n) over (order by v) - first(n) over (order by v))::float * (255::float / (sum(n) over () - first(n) over (order by v))::float))::double, 0), 255)::int t from h)")
query("histogram", lambda s, d: it.histogram(heat(s, d)).select("v", "n"), "select v, count(*) n from heat group by v")
query("heat_lut_invert", lambda s, d: it.lut(heat(s, d), 255 - np.arange(256), "8U"), "select y, x, c, 255 - v v from heat")
query("lut_16s_channels", lambda s, d: it.lut(pattern(s), np.stack([np.arange(256) * k - 300 for k in (1, 2, 3)], axis=1), "16S"), "select y, x, c, (v * (c + 1) - 300)::int v from pattern")
_T = "(v / 255.0::double)"
for _name, _bgr in (
    ("AUTUMN", ("0", _T, "1")), ("JET", (f"1.5 - abs(4 * {_T} - 1)", f"1.5 - abs(4 * {_T} - 2)", f"1.5 - abs(4 * {_T} - 3)")), ("WINTER", (f"1 - 0.5 * {_T}", _T, "0")), ("COOL", ("1", f"1 - {_T}", _T)),
    ("HOT", (f"4 * {_T} - 3", f"(8.0::double / 3) * {_T} - 1", f"(8.0::double / 3) * {_T}")),
):
    query(f"heat_colormap_{_name.lower()}", lambda s, d, n=_name: it.apply_color_map(heat(s, d), n), _channels(*[f"round(least(greatest(({e})::double, 0), 1) * 255)" for e in _bgr], source="heat"))
query("colormap_user", lambda s, d: it.apply_user_color_map(heat(s, d), np.stack([np.arange(256), 255 - np.arange(256), np.arange(256) // 2], axis=1)), _channels("v", "255 - v", "v // 2", source="heat"))

# accumulation and blending

_ACC = "select g.y, g.x, g.c, {}::double v from gray g join p1 p using (y, x)"
_dst = lambda s, d: p1(s, d).convert_to("32F")
query("accumulate", lambda s, d: it.accumulate(gray(s, d), _dst(s, d)), _ACC.format("(p.v + g.v)"))
query("accumulate_masked", lambda s, d: it.accumulate(p1(s, d), _dst(s, d), gray(s, d)), _ACC.format("(case when g.v <> 0 then 2 * p.v else p.v end)"))
query("accumulate_square", lambda s, d: it.accumulate_square(gray(s, d), _dst(s, d)), _ACC.format("(p.v + g.v * g.v)"))
query("accumulate_product", lambda s, d: it.accumulate_product(gray(s, d), p1(s, d), _dst(s, d)), _ACC.format("(p.v + g.v * p.v)"))
query("accumulate_weighted", lambda s, d: it.accumulate_weighted(gray(s, d), _dst(s, d), 0.25), _ACC.format("(p.v * 0.75::double + g.v * 0.25::double)"))
query("accumulate_daily", lambda s, d: it.accumulated_frames(daily(s, d)), "select y, x, c, sum(v)::double v from daily group by y, x, c")
query("accumulate_square_daily", lambda s, d: it.accumulated_frames(daily(s, d), "square"), "select y, x, c, sum(v * v)::double v from daily group by y, x, c")
query("accumulate_weighted_daily", lambda s, d: it.accumulated_frames(daily(s, d), "weighted", 0.2).withColumn("v", F.round("v", 6)), "select y, x, c, round(sum(v * 0.2::double * pow(0.8::double, 7 - f)), 6) v from daily group by y, x, c")
_wt = lambda m, e: Mat(m.px.selectExpr("mat_id", "y", "x", "c", f"cast({e} as float) v"), Meta(m.meta.rows, m.meta.cols, 1, "32F"))
query("blend_linear", lambda s, d: it.blend_linear(p1(s, d), gray(s, d), _wt(p1(s, d), "x / 47.0D"), _wt(p1(s, d), "1 - x / 47.0D")), "select p.y, p.x, p.c, least(round_even((p.v * a + g.v * b) / (a + b + 1e-5), 0), 255)::int v from (select *, (x / 47.0::double)::float::double a, (1 - x / 47.0::double)::float::double b from p1) p join gray g using (y, x)")

# filters

K = np.array([[0, -1, 0], [-1, 5, -1], [0, -1, 0]])
for _m in ("REFLECT_101", "REPLICATE", "CONSTANT"):
    query(f"box3x3_{_m.lower()}", lambda s, d, m=_m: fi.box_filter(heat(s, d), 3, 3, border=m), f"select y, x, c, {_MEAN3} v from ({conv(ONES3, _m)})")
    query(f"filter2d_sharpen_{_m.lower()}", lambda s, d, m=_m: fi.filter2d(heat(s, d), K, border=m), f"select y, x, c, {SAT8.format('v')} v from ({conv(_taps(K), _m)})")
query("box_sum", lambda s, d: fi.box_filter(heat(s, d), 5, 5, "32S", normalize=False), f"select y, x, c, v::int v from ({conv(ONES5, 'REFLECT_101')})")
query("blur5", lambda s, d: fi.blur(ship(s, d), 5, 5), f"select y, x, c, least(round((v::float * (1.0 / 25)::float)::double), 255)::int v from ({conv(ONES5, 'REFLECT_101', source='ship', cols=64)})")
query("sqr_box", lambda s, d: fi.sqr_box_filter(heat(s, d), 3, 3, "64F"), f"select y, x, c, round(v / 9, 4) v from ({conv(ONES3, 'REFLECT_101', 'sum(s.v * s.v)::double')})")
query("sep_filter2d", lambda s, d: fi.sep_filter2d(heat(s, d), [1, 2, 1], [-1, 0, 1], "16S", delta=3), f"select y, x, c, (v + 3)::int v from ({conv(_taps(np.outer([-1, 0, 1], [1, 2, 1])), 'REFLECT_101')})")
query("gauss3x3", lambda s, d: fi.gaussian_blur(heat(s, d), 3, 3, 0.0).with_v(F.col("v")), f"select y, x, c, {SAT8.format('v')} v from ({conv(_taps(np.outer(kn.blur_gaussian(3, 0), kn.blur_gaussian(3, 0))), 'REFLECT_101')})")
query("gauss_sigma", lambda s, d: fi.gaussian_blur(heat(s, d).convert_to("64F"), 0, 0, 1.0), f"select y, x, c, round(v, 4) v from ({conv(_taps(np.outer(kn.blur_gaussian(7, 1.0), kn.blur_gaussian(7, 1.0))), 'REFLECT_101')})")
query("median3", lambda s, d: fi.median_blur(heat(s, d), 3), conv(ONES3, "REPLICATE", "list_sort(list(s.v))[5]"))
query("median5", lambda s, d: fi.median_blur(heat(s, d), 5), conv(ONES5, "REPLICATE", "list_sort(list(s.v))[13]"))
_BI = [(y, x, math.exp(-0.5 * (y * y + x * x) / 4.0)) for y in range(-2, 3) for x in range(-2, 3) if y * y + x * x <= 4]
_bw = "t.w * exp(-0.5 * (s.v - o.v) * (s.v - o.v) / 900.0::double)"
query("bilateral", lambda s, d: fi.bilateral_filter(heat(s, d), 5, 30.0, 2.0), f"select y, x, c, {SAT8.format('v')} v from ({conv(_BI, 'REFLECT_101', f'sum({_bw} * s.v) / sum({_bw})')})")
query("stackblur5", lambda s, d: fi.stack_blur(heat(s, d), 5, 5), f"select y, x, c, {SAT8.format('v / 81')} v from ({conv(_taps(np.outer([1, 2, 3, 2, 1], [1, 2, 3, 2, 1])), 'REPLICATE')})")
for _name, _f, _k in (
    ("sobel_dx", lambda m: fi.sobel(m, 1, 0), np.outer([1, 2, 1], [-1, 0, 1])), ("sobel_dy5", lambda m: fi.sobel(m, 0, 1, 5), np.outer([-1, -2, 0, 2, 1], [1, 4, 6, 4, 1])),
    ("scharr_dy", lambda m: fi.scharr(m, 0, 1), np.outer([-1, 0, 1], [3, 10, 3])), ("laplacian", lambda m: fi.laplacian(m, 1, "32F"), np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]])),
    ("laplacian3", lambda m: fi.laplacian(m, 3, "32F"), np.array([[2, 0, 2], [0, -8, 0], [2, 0, 2]])),
):
    query(_name, lambda s, d, f=_f: f(heat(s, d)), conv(_taps(_k), "REFLECT_101"))
query("sobel_dx_16s_scaled", lambda s, d: fi.sobel(heat(s, d), 1, 0, 3, "16S", 0.5, 10), f"select y, x, c, round(v * 0.5 + 10)::int v from ({conv(_taps(np.outer([1, 2, 1], [-1, 0, 1])), 'REFLECT_101')})")
query("sobel_roi_sees_parent", lambda s, d: fi.sobel(heat(s, d).roi(8, 24, 8, 40), 1, 0, 3, "16S"), f"select (y - 8)::int y, (x - 8)::int x, c, v::int v from ({conv(_taps(np.outer([1, 2, 1], [-1, 0, 1])), 'REFLECT_101')}) where y between 8 and 23 and x between 8 and 39")
query("spatial_gradient", lambda s, d: fi.spatial_gradient(heat(s, d))[1], f"select y, x, c, v::int v from ({conv(_taps(np.outer([-1, 0, 1], [1, 2, 1])), 'REFLECT_101')})")
query("integral", lambda s, d: fi.integral(heat(s, d)), "select a.y::int y, b.x::int x, 0 c, coalesce((select sum(v) from heat h where h.y < a.y and h.x < b.x), 0)::int v from range(0, 65) a(y), range(0, 49) b(x)")

# edges

_G = f"gx as ({conv(_taps(np.outer([1, 2, 1], [-1, 0, 1])), 'REPLICATE')}), gy as ({conv(_taps(np.outer([-1, 0, 1], [1, 2, 1])), 'REPLICATE')})"
_CANNY = (
    _G,
    "g as (select gx.y, gx.x, gx.v gx, gy.v gy, abs(gx.v) + abs(gy.v) a, case when gx.v <> 0 then gy.v / gx.v when gy.v >= 0 then 1e308 else -1e308 end t from gx join gy using (y, x))",
    "k as (select *, case when abs(t) < tan(pi() / 8) then 0 when t between tan(pi() / 8) and tan(3 * pi() / 8) then 1 when t between -tan(3 * pi() / 8) and -tan(pi() / 8) then 2 else 3 end s from g)",
    "n as (select k.y, k.x, k.a, k.s, coalesce(b.a, 0) b, coalesce(e.a, 0) e from k left join g b on b.y = k.y + case s when 0 then 0 when 2 then -1 else 1 end and b.x = k.x + case s when 3 then 0 else 1 end left join g e on e.y = k.y - case s when 0 then 0 when 2 then -1 else 1 end and e.x = k.x - case s when 3 then 0 else 1 end)",
    "weak as (select y, x, a from n where a > 200 and (a > b or (a = b and s in (0, 3))) and a > e)",
    "grown as (select y, x from weak where a > 400 union select w.y, w.x from grown q join weak w on abs(w.y - q.y) <= 1 and abs(w.x - q.x) <= 1)",
)
query("canny", lambda s, d: cn.canny(heat(s, d), 400, 200), "select h.y, h.x, h.c, case when q.y is null then 0 else 255 end v from heat h left join grown q on q.y = h.y and q.x = h.x", *_CANNY)
_EDGES = "select h.y, h.x, h.c, case when q.y is null then 0 else 255 end v from heat h left join grown q on q.y = h.y and q.x = h.x"
_L2 = [t.replace("abs(gx.v) + abs(gy.v) a", "sqrt(gx.v * gx.v + gy.v * gy.v)::float a").replace("a > 200", "a > 150").replace("a > 400", "a > 300").replace("coalesce(b.a, 0) b, coalesce(e.a, 0) e", "coalesce(b.a, 0)::float b, coalesce(e.a, 0)::float e") for t in _CANNY]
query("canny_l2", lambda s, d: cn.canny(heat(s, d), 300, 150, 3, True), _EDGES, *_L2)
query("canny_of_derivatives", lambda s, d: cn.canny_gradients(*(fi.sobel(heat(s, d), a, b, 3, "16S", border="REPLICATE") for a, b in ((1, 0), (0, 1))), 400, 200), _EDGES, *_CANNY)

# morphology

BIN = "b as (select y, x, c, case when v > 48 then 255 else 0 end v from heat)"
bins = lambda s, d: it.threshold(heat(s, d), 48, 255)
CROSS = kn.structuring_element("CROSS", 3, 3)
_ct = [t for t in _taps(CROSS) if t[2]]
query("erode3", lambda s, d: mo.erode(heat(s, d)), conv(ONES3, "REFLECT_101", "min(s.v)"))
query("dilate3", lambda s, d: mo.dilate(heat(s, d)), conv(ONES3, "REFLECT_101", "max(s.v)"))
query("erode_cross_twice", lambda s, d: mo.erode(heat(s, d), CROSS, iterations=2), conv(_ct, "REFLECT_101", "min(s.v)", "e1"), f"e1 as ({conv(_ct, 'REFLECT_101', 'min(s.v)')})")
# a constant border of 0: what lies outside counts for the least value, and never for the largest
_min0 = "case when count(*) < 9 then 0 else min(s.v) end"
_E, _D = f"e as ({conv(ONES3, 'CONSTANT', _min0, 'b')})", f"d as ({conv(ONES3, 'CONSTANT', 'max(s.v)', 'b')})"
_ED, _DE = f"o as ({conv(ONES3, 'CONSTANT', 'max(s.v)', 'e')})", f"k as ({conv(ONES3, 'CONSTANT', _min0, 'd')})"
for _op, _sql, _more in (
    ("ERODE", "select y, x, c, v from e", (_E,)), ("DILATE", "select y, x, c, v from d", (_D,)), ("OPEN", "select y, x, c, v from o", (_E, _ED)), ("CLOSE", "select y, x, c, v from k", (_D, _DE)),
    ("GRADIENT", "select e.y, e.x, e.c, greatest(d.v - e.v, 0) v from e join d using (y, x)", (_E, _D)), ("TOPHAT", "select b.y, b.x, b.c, greatest(b.v - o.v, 0) v from b join o using (y, x)", (_E, _ED)),
    ("BLACKHAT", "select b.y, b.x, b.c, greatest(k.v - b.v, 0) v from b join k using (y, x)", (_D, _DE)),
):
    query(f"morph_{_op.lower()}", lambda s, d, o=_op: mo.morphology(bins(s, d), o), _sql, BIN, *_more)
HM = np.array([[0, 1, 0], [-1, 1, 1], [-1, -1, 0]])
_hm = [t for t in _taps(HM) if t[2]]
query("hitmiss", lambda s, d: mo.morphology(bins(s, d), "HITMISS", HM), f"select y, x, c, case when v then 255 else 0 end v from ({conv(_hm, 'CONSTANT', 'bool_and((s.v <> 0) = (t.w > 0))', 'b')})", BIN)

# pyramids and geometry

query("pyrdown", lambda s, d: py.pyr_down(heat(s, d)), f"select (y // 2)::int y, (x // 2)::int x, c, least(round_even(v / 256, 0), 255)::int v from ({conv(_taps(py.BINOMIAL), 'REFLECT_101')}) where y % 2 = 0 and x % 2 = 0")
query(
    "pyrup", lambda s, d: py.pyr_up(heat(s, d)),
    "select o.y, o.x, 0 c, least(round_even(sum(t.w * s.v) / 64, 0), 255)::int v from o cross join t join heat s on s.y * 2 = " + _border("o.y + t.dy", 128, "REFLECT_101") + " and s.x * 2 = " + _border("o.x + t.dx", 96, "REFLECT_101") + " group by o.y, o.x",
    "o as (select y::int y, x::int x from range(0, 128) a(y), range(0, 96) b(x))", "t as (select * from (values " + ", ".join(f"({a}, {b}, {w!r}::double)" for a, b, w in _taps(py.BINOMIAL)) + ") t(dy, dx, w))",
)
query("build_pyramid_level2", lambda s, d: py.build_pyramid(heat(s, d), 2)[2], f"select (y // 2)::int y, (x // 2)::int x, c, least(round_even(v / 256, 0), 255)::int v from ({conv(_taps(py.BINOMIAL), 'REFLECT_101', source='l1', rows=32, cols=24)}) where y % 2 = 0 and x % 2 = 0", f"l1 as (select (y // 2)::int y, (x // 2)::int x, c, least(round_even(v / 256, 0), 255)::int v from ({conv(_taps(py.BINOMIAL), 'REFLECT_101')}) where y % 2 = 0 and x % 2 = 0)")
query("resize_nearest", lambda s, d: ge.resize(heat(s, d), 100, 70, interpolation="NEAREST"), "select a.y::int y, b.x::int x, h.c, h.v from range(0, 100) a(y), range(0, 70) b(x), heat h where h.y = a.y * 64 // 100 and h.x = b.x * 48 // 70")
query("resize_nearest_exact", lambda s, d: ge.resize(heat(s, d), 100, 70, interpolation="NEAREST_EXACT"), "select a.y::int y, b.x::int x, h.c, h.v from range(0, 100) a(y), range(0, 70) b(x), heat h where h.y = (a.y * 41943 + 20971) >> 16 and h.x = (b.x * 44939 + 22469) >> 16")


def bilinear(places: str, rows: int = 64, cols: int = 48, outside: str | None = None) -> str:
    """places: y, x, sy, sx of doubles, y0, x0 whole. outside: the value there; else the border is replicated."""
    w = "(case when a = 1 then sy - y0 else 1 - (sy - y0) end) * (case when b = 1 then sx - x0 else 1 - (sx - x0) end)"
    at = f"h.y = least(greatest(y0 + a, 0), {rows - 1}) and h.x = least(greatest(x0 + b, 0), {cols - 1})" if outside is None else "h.y = y0 + a and h.x = x0 + b"
    return f"select p.y::int y, p.x::int x, 0 c, {SAT8.format(f'sum({w} * coalesce(h.v, {outside or 0}))')} v from ({places}) p cross join range(0, 2) q(a) cross join range(0, 2) r(b) left join heat h on {at} group by p.y, p.x"


query(
    "resize_linear", lambda s, d: ge.resize(heat(s, d), 96, 72),
    bilinear("select *, least(greatest(floor(sy), 0), 63)::int y0, least(greatest(floor(sx), 0), 47)::int x0 from (select y, x, (y + 0.5::double) * (64 / 96.0::double) - 0.5 sy, (x + 0.5::double) * (48 / 72.0::double) - 0.5 sx from range(0, 96) a(y), range(0, 72) b(x))"),
)
query("resize_half", lambda s, d: ge.resize(heat(s, d), 32, 24), "select (y // 2)::int y, (x // 2)::int x, 0 c, ((sum(v) + 2) // 4)::int v from heat group by 1, 2")
M = np.array([[0.5, 0.25, 3.0], [-0.25, 0.75, 5.0]])
_AFF = "select y, x, x * 0.5::double + y * 0.25::double + 3 sx, x * -0.25::double + y * 0.75::double + 5 sy from range(0, 40) a(y), range(0, 50) b(x)"
query("warp_affine_nearest", lambda s, d: ge.warp_affine(heat(s, d), M, 40, 50, "NEAREST", True, value=7), f"select p.y::int y, p.x::int x, 0 c, coalesce(h.v, 7)::int v from ({_AFF}) p left join heat h on h.y = floor(sy + 0.5) and h.x = floor(sx + 0.5)")
query("warp_affine_linear", lambda s, d: ge.warp_affine(heat(s, d), M, 40, 50, inverse=True, value=7), bilinear(f"select *, floor(sy)::int y0, floor(sx)::int x0 from ({_AFF})", outside="7"))
query("warp_affine_forward", lambda s, d: ge.warp_affine(heat(s, d), np.array([[2.0, 0, 4], [0, 2.0, 6]]), 40, 50, border="REPLICATE"), bilinear("select *, floor(sy)::int y0, floor(sx)::int x0 from (select y, x, x * 0.5::double - 2 sx, y * 0.5::double - 3 sy from range(0, 40) a(y), range(0, 50) b(x))"))
Q = np.array([[0.5, 0.25, 3.0], [-0.25, 0.75, 5.0], [0.0, 0.0078125, 1.0]])
_PER = "select y, x, (x * 0.5::double + y * 0.25::double + 3) * (1 / (x * 0.0::double + y * 0.0078125::double + 1)) sx, (x * -0.25::double + y * 0.75::double + 5) * (1 / (x * 0.0::double + y * 0.0078125::double + 1)) sy from range(0, 40) a(y), range(0, 50) b(x)"
_Q32 = "select y, x, round_even(sx * 32, 0) / 32 sx, round_even(sy * 32, 0) / 32 sy from ({})"
query("warp_perspective_nearest", lambda s, d: ge.warp_perspective(heat(s, d), Q, 40, 50, "NEAREST", True), f"select p.y::int y, p.x::int x, 0 c, coalesce(h.v, 0)::int v from ({_PER}) p left join heat h on h.y = round_even(sy, 0) and h.x = round_even(sx, 0)")
query("warp_perspective", lambda s, d: ge.warp_perspective(heat(s, d), Q, 40, 50, inverse=True), bilinear(f"select *, floor(sy)::int y0, floor(sx)::int x0 from ({_Q32.format(_PER)})", outside="0"))
maps = lambda s: s.range(2000).selectExpr("cast(id div 50 as int) y", "cast(id % 50 as int) x").selectExpr("y", "x", "x * 0.7D + (y % 5) * 0.3D sx", "y * 1.3D - (x % 3) * 0.45D sy")
_MAPS = "select y, x, x * 0.7::double + (y % 5) * 0.3::double sx, y * 1.3::double - (x % 3) * 0.45::double sy from range(0, 40) a(y), range(0, 50) b(x)"
query("remap", lambda s, d: ge.remap(heat(s, d), maps(s), 40, 50, border="REPLICATE"), bilinear(f"select *, floor(sy)::int y0, floor(sx)::int x0 from ({_Q32.format(_MAPS)})"))
query("remap_nearest", lambda s, d: ge.remap(heat(s, d), maps(s), 40, 50, "NEAREST"), f"select p.y::int y, p.x::int x, 0 c, coalesce(h.v, 0)::int v from ({_MAPS}) p left join heat h on h.y = round_even(sy, 0) and h.x = round_even(sx, 0)")
query("convert_maps", lambda s, d: ge.convert_maps(maps(s)), f"select y::int y, x::int x, floor(sx)::int ix, floor(sy)::int iy, ((sx - floor(sx)) * 32)::int fx, ((sy - floor(sy)) * 32)::int fy from ({_Q32.format(_MAPS)})")
query("convert_maps_nearest", lambda s, d: ge.convert_maps(maps(s), nearest=True), f"select y::int y, x::int x, round_even(sx, 0)::int ix, round_even(sy, 0)::int iy from ({_MAPS})")
query("rect_sub_pix", lambda s, d: ge.rect_sub_pix(heat(s, d), 9, 11, (10.3, 4.6)), bilinear("select *, floor(sy)::int y0, floor(sx)::int x0 from (select y, x, y + (4.6::double - 4) sy, x + (10.3::double - 5) sx from range(0, 9) a(y), range(0, 11) b(x))"))
query("resize_gray_threshold", lambda s, d: it.threshold(co.convert(ge.resize(ship(s, d), 32, 32), "BGR2GRAY"), 96, 255), "select y, x, 0 c, case when ((7471 * b + 38470 * g + 19595 * r + 32768) >> 16) > 96 then 255 else 0 end v from m", WIDE, "m as (select (y // 2)::int y, (x // 2)::int x, ((sum(b) + 2) // 4)::int b, ((sum(g) + 2) // 4)::int g, ((sum(r) + 2) // 4)::int r from w group by 1, 2)")
query("channel_wise_pipeline", lambda s, d: it.threshold(co.convert(ge.resize(ship(s, d), 48, 64, interpolation="NEAREST"), "BGR2GRAY"), 96, 255), "select a.y::int y, w.x, 0 c, case when ((7471 * b + 38470 * g + 19595 * r + 32768) >> 16) > 96 then 255 else 0 end v from range(0, 48) a(y) join w on w.y = a.y * 64 // 48", WIDE)
query("flip_of_filtered", lambda s, d: lo.flip(fi.median_blur(heat(s, d), 3), 1), f"select y, (47 - x)::int x, c, v from ({conv(ONES3, 'REPLICATE', 'list_sort(list(s.v))[5]')})")
