"""Queries of the matrix core: element-wise, reductions, layout, products and kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridloom.functions import kernels as kn
from gridloom.matrix import Mat, Meta
from gridloom.operators import arithmetic as ar
from gridloom.operators import layout as lo
from gridloom.operators import linalg as la
from gridloom.operators import reductions as re_
from gridloom.plans.fixtures import emb, gray, heat, p1, pattern, ship
from gridloom.plans.registry import query

SAT8 = "least(greatest(round(({})::double), 0), 255)::int"
PAIR = "select p.y, p.x, p.c, {} v from p1 p join gray g using (y, x)"


def _pair(name, op, sql):
    query(name, lambda s, d: op(p1(s, d), gray(s, d)), PAIR.format(sql))


_pair("arith_add_sat", ar.add, "least(p.v + g.v, 255)::int")
_pair("arith_sub_sat", ar.subtract, "greatest(p.v - g.v, 0)::int")
_pair("arith_mul_sat", ar.multiply, "least(p.v * g.v, 255)::int")
_pair("arith_div_round", ar.divide, "case when g.v = 0 then 0 else round(p.v::double / g.v)::int end")
_pair("arith_add_weighted", lambda a, b: ar.add_weighted(a, 0.75, b, 0.5), SAT8.format("p.v * 0.75::double + g.v * 0.5::double"))
_pair("arith_scale_add", lambda a, b: ar.scale_add(a, 0.5, b), SAT8.format("p.v * 0.5::double + g.v"))
_pair("arith_absdiff", ar.absdiff, "abs(p.v - g.v)::int")
_pair("arith_min", ar.minimum, "least(p.v, g.v)::int")
_pair("arith_max", ar.maximum, "greatest(p.v, g.v)::int")
for _op, _sym in (("eq", "="), ("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<="), ("ne", "<>")):
    _pair(f"arith_compare_{_op}", lambda a, b, o=_op: ar.compare(a, b, o.upper()), f"case when p.v {_sym} g.v then 255 else 0 end")
_pair("bit_and", ar.bitwise_and, "(p.v & g.v)::int")
_pair("bit_or", ar.bitwise_or, "(p.v | g.v)::int")
_pair("bit_xor", ar.bitwise_xor, "xor(p.v, g.v)::int")
_pair("bit_and_masked", lambda a, b: ar.bitwise_and(a, b, b), "case when g.v <> 0 then p.v & g.v else 0 end::int")
query("bit_not", lambda s, d: ar.bitwise_not(pattern(s)), "select y, x, c, 255 - v v from pattern")
_pair("binary_mod", lambda a, b: ar.binary("MOD", a, b), "case when g.v = 0 then 0 else p.v % g.v end::int")
_pair("binary_mean", lambda a, b: ar.binary("MEAN", a, b), SAT8.format("(p.v + g.v) * 0.5"))
_pair("binary_hypot", lambda a, b: ar.binary("HYPOT", a, b), SAT8.format("sqrt((p.v * p.v + g.v * g.v)::double)"))
_pair("binary_andnot", lambda a, b: ar.binary("NOT", a, b), "(p.v & (255 - g.v))::int")
_pair("binary_pow", lambda a, b: ar.binary("POW", ar.binary("MOD", a, 7), ar.binary("MOD", b, 3)), SAT8.format("pow((p.v % 7)::double, (g.v % 3)::double)"))
_pair("binary_atan2", lambda a, b: ar.binary("ATAN2", a, b), SAT8.format("atan2(p.v::double, g.v::double)"))


def centred(s):
    """The pattern's first channel less 128, as 16S."""
    return ar.subtract(p1(s, None).convert_to("16S"), 128)


query("binary_mod_signed", lambda s, d: ar.binary("MOD", centred(s), -7), "select y, x, c, case when (v - 128) % 7 > 0 then (v - 128) % 7 - 7 else (v - 128) % 7 end::int v from p1")
query("binary_fmod", lambda s, d: ar.binary("FMOD", centred(s), 7), "select y, x, c, ((v - 128) % 7)::int v from p1")
query("binary_bitshift", lambda s, d: ar.binary("BITSHIFT", p1(s, d), Mat(p1(s, d).px.selectExpr("mat_id", "y", "x", "c", "cast(x % 7 as int) v"), Meta(32, 48))), "select y, x, c, ((v::bigint << (x % 7)) & 255)::int v from p1")
query("scalar_add_lanes", lambda s, d: pattern(s) + [10, 20.5, 300], "select y, x, c, least(v + case c when 0 then 10 when 1 then 21 else 255 end, 255)::int v from pattern")
query("scalar_rsub", lambda s, d: 200 - pattern(s), "select y, x, c, greatest(200 - v, 0)::int v from pattern")
query("scalar_mul_rounds_scalar", lambda s, d: pattern(s) * 0.5, "select y, x, c, v from pattern")
query("scalar_div", lambda s, d: pattern(s) / 3, "select y, x, c, round(v / 3.0::double)::int v from pattern")
query("expr_chain", lambda s, d: (p1(s, d) + gray(s, d)) / 2 - 10, PAIR.format("greatest(round(least(p.v + g.v, 255) / 2.0::double) - 10, 0)::int"))
query("expr_negate", lambda s, d: -centred(s), "select y, x, c, (128 - v)::int v from p1")
query("expr_compare_scalar", lambda s, d: pattern(s) > 300, "select y, x, c, 0 v from pattern")
query("in_range", lambda s, d: ar.in_range(ship(s, d), [10.5, 0, 0], [200, 128, 255]), "select y, x, 0 c, case when bool_and(case c when 0 then v between 10.5 and 200 when 1 then v between 0 and 128 else true end) then 255 else 0 end v from ship group by y, x")
query("convert_scale_abs", lambda s, d: ar.convert_scale_abs(centred(s), 1.5, 0.5), "select y, x, c, least(round_even(abs((v - 128) * 1.5 + 0.5)::double, 0), 255)::int v from p1")
query("convert_to_8s", lambda s, d: pattern(s).convert_to("8S"), "select y, x, c, least(v, 127)::int v from pattern")
query("reinterpret_8s", lambda s, d: pattern(s).reinterpret_sign(), "select y, x, c, case when v > 127 then v - 256 else v end::int v from pattern")
for _name, _f, _sql in (
    ("sqrt", lambda m: ar.sqrt(m), "case when v < 0 then 'nan'::double else sqrt(v::double) end"),
    ("exp", lambda m: ar.exp(m), "exp(v::double)"),
    ("pow2", lambda m: ar.power(m, 2), "pow(v::double, 2)"),
):
    query(f"math_{_name}", lambda s, d, f=_f: f(Mat(emb(s, d).px.selectExpr("mat_id", "y", "x", "c", "cast(abs(v) as double) v"), Meta(500, 64, 1, "64F"))), f"select y, x, c, round({_sql.replace('v::double', 'abs(v)::double').replace('v < 0', 'false')}, 4) v from emb")
query("math_log", lambda s, d: ar.log(gray(s, d).convert_to("64F")), "select y, x, c, case when v > 0 then round(ln(v::double), 4) else '-inf'::double end v from gray")
query("check_range", lambda s, d: ar.check_range(heat(s, d), 0, 160).drop("mat_id"), "select not bool_or(v >= 160) ok, coalesce(min(case when v >= 160 then y * 48 + x end) % 48, -1)::int x, coalesce(min(case when v >= 160 then y * 48 + x end) // 48, -1)::int y from heat")
query("patch_nans", lambda s, d: ar.patch_nans(Mat(emb(s, d).px.selectExpr("mat_id", "y", "x", "c", "cast(if(x % 9 = 0, double('NaN'), v) as float) v"), Meta(500, 64, 1, "32F")), 1.5), "select y, x, c, round((case when x % 9 = 0 then 1.5 else v end)::double, 4) v from emb")

# reductions

ROW = "select {} from {}"
query("sum", lambda s, d: re_.total(ship(s, d)).select("c", "s"), "select c, sum(v)::double s from ship group by c")
query("mean", lambda s, d: re_.mean(ship(s, d)).select("c", F.round("mean", 6).alias("mean")), "select c, round(avg(v), 6) mean from ship group by c")
query("mean_masked", lambda s, d: re_.mean(p1(s, d), gray(s, d)).select("c", F.round("mean", 6).alias("mean")), "select p.c, round(avg(p.v), 6) mean from p1 p join gray g using (y, x) where g.v <> 0 group by p.c")
query("mean_std", lambda s, d: re_.mean_std(ship(s, d)).select("c", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std")), "select c, round(avg(v), 6) mean, round(stddev_pop(v), 6) std from ship group by c")
for _k, _sql in (("INF", "max(abs(v))::double"), ("L1", "sum(abs(v))::double"), ("L2", "sqrt(sum(v * v)::double)")):
    query(f"norm_{_k.lower()}", lambda s, d, k=_k: re_.norm(ship(s, d), k).select(F.round("norm", 6).alias("norm")), f"select round({_sql}, 6) norm from ship")
    query(f"norm_diff_{_k.lower()}", lambda s, d, k=_k: re_.norm(p1(s, d), k, gray(s, d)).select(F.round("norm", 6).alias("norm")), f"select round({_sql}, 6) norm from (select p.v - g.v v from p1 p join gray g using (y, x))")
query("count_non_zero", lambda s, d: re_.count_non_zero(heat(s, d)).select("n"), "select count(*) filter (v <> 0) n from heat")
query("has_non_zero", lambda s, d: re_.has_non_zero(heat(s, d)).select("any"), 'select bool_or(v <> 0) "any" from heat')
query("find_non_zero", lambda s, d: re_.find_non_zero(heat(s, d)).select("i", "x", "y"), "select row_number() over (order by y, x) - 1 i, x, y from heat where v <> 0")
query(
    "min_max_loc", lambda s, d: re_.min_max(heat(s, d)).drop("mat_id"),
    """select lo::double lo, hi::double hi, (a % 48)::int lo_x, (a // 48)::int lo_y, (b % 48)::int hi_x, (b // 48)::int hi_y from (select min(v) lo, max(v) hi, min(y * 48 + x) filter (v = (select min(v) from heat)) a,
    min(y * 48 + x) filter (v = (select max(v) from heat)) b from heat)""",
)
query("min_max_idx_channels", lambda s, d: re_.min_max(ship(s, d), places=False).drop("mat_id"), "select min(v)::double lo, max(v)::double hi from ship")
for _how, _sql in (("sum", "least(sum(v), 255)"), ("avg", "round(avg(v))"), ("max", "max(v)"), ("min", "min(v)"), ("sum2", "least(sum(v * v), 255)")):
    query(f"reduce_rows_{_how}", lambda s, d, h=_how: re_.reduce(ship(s, d), 0, h.upper()), f"select 0 y, x, c, ({_sql})::int v from ship group by x, c")
    query(f"reduce_cols_{_how}", lambda s, d, h=_how: re_.reduce(heat(s, d), 1, h.upper(), "32S"), f"select y, 0 x, c, ({_sql.replace('least(', '(').replace(', 255)', ')')})::int v from heat group by y, c")
for _how, _agg in (("max", "max"), ("min", "min")):
    for _last, _pick in ((False, "min"), (True, "max")):
        query(
            f"reduce_arg{_how}{'_last' if _last else ''}", lambda s, d, h=_how, last=_last: getattr(re_, f"arg_{h}")(heat(s, d), 1, last),
            f"select h.y, 0 x, 0 c, {_pick}(h.x)::int v from heat h join (select y, {_agg}(v) b from heat group by y) m on h.y = m.y and h.v = m.b group by h.y",
        )
query("normalize_minmax", lambda s, d: re_.normalize(heat(s, d), 0, 200, "MINMAX"), "select y, x, c, round(v * (200.0::double / (select max(v) - min(v) from heat)) - (select min(v) from heat) * (200.0::double / (select max(v) - min(v) from heat)))::int v from heat")
query("normalize_l2", lambda s, d: re_.normalize(heat(s, d), 1, 0, "L2", "64F"), "select y, x, c, round(v * (1 / sqrt((select sum(v * v) from heat)::double)), 4) v from heat")
query("normalize_l1_masked", lambda s, d: re_.normalize(p1(s, d), 100, 0, "L1", "64F", gray(s, d)), "select p.y, p.x, p.c, case when g.v <> 0 then round(p.v * (100 / (select sum(a.v) from p1 a join gray b using (y, x) where b.v <> 0)::double), 4) else 0 end v from p1 p join gray g using (y, x)")

# layout and containers

P = "select y, x, c, v from pattern"
query("flip_vertical", lambda s, d: lo.flip(pattern(s), 0), "select (31 - y)::int y, x, c, v from pattern")
query("flip_horizontal", lambda s, d: lo.flip(pattern(s), 1), "select y, (47 - x)::int x, c, v from pattern")
query("flip_both", lambda s, d: lo.flip(pattern(s), -1), "select (31 - y)::int y, (47 - x)::int x, c, v from pattern")
query("rotate_90_cw", lambda s, d: lo.rotate(pattern(s), "90_CW"), "select x y, (31 - y)::int x, c, v from pattern")
query("rotate_180", lambda s, d: lo.rotate(pattern(s), "180"), "select (31 - y)::int y, (47 - x)::int x, c, v from pattern")
query("rotate_90_ccw", lambda s, d: lo.rotate(pattern(s), "90_CCW"), "select (47 - x)::int y, y x, c, v from pattern")
query("transpose", lambda s, d: lo.transpose(pattern(s)), "select x y, y x, c, v from pattern")
query("repeat", lambda s, d: lo.repeat(pattern(s), 2, 3), "select (y + 32 * a)::int y, (x + 48 * b)::int x, c, v from pattern, range(0, 2) q(a), range(0, 3) r(b)")
query("hconcat", lambda s, d: lo.hconcat([p1(s, d), gray(s, d)]), "select y, x, c, v from p1 union all select y, (x + 48)::int, c, v from gray")
query("vconcat", lambda s, d: lo.vconcat([p1(s, d), gray(s, d)]), "select y, x, c, v from p1 union all select (y + 32)::int, x, c, v from gray")
query("roi", lambda s, d: pattern(s).roi(4, 20, 8, 40), "select (y - 4)::int y, (x - 8)::int x, c, v from pattern where y between 4 and 19 and x between 8 and 39")
query("row_range", lambda s, d: pattern(s).row_range(3, 9), "select (y - 3)::int y, x, c, v from pattern where y between 3 and 8")
query("col_range", lambda s, d: pattern(s).col_range(3, 9), "select y, (x - 3)::int x, c, v from pattern where x between 3 and 8")
query("reshape", lambda s, d: pattern(s).reshape(64, 72, 1), "select ((y * 144 + x * 3 + c) // 72)::int y, ((y * 144 + x * 3 + c) % 72)::int x, 0 c, v from pattern")
query("broadcast", lambda s, d: lo.broadcast_to(pattern(s).row_range(5, 6), 10, 48), "select a::int y, x, c, v from pattern, range(0, 10) q(a) where y = 5")
query("clone", lambda s, d: pattern(s).clone(), P)
query("copy_to", lambda s, d: pattern(s).copy_to(), P)
query("at", lambda s, d: pattern(s).at(7, 9, 2).select("v"), "select v from pattern where y = 7 and x = 9 and c = 2")
query("set_to", lambda s, d: pattern(s).set_to([1.4, 2.6, 300]), "select y, x, c, case c when 0 then 1 when 1 then 3 else 255 end v from pattern")
query("mat_full", lambda s, d: Mat.full(s, Meta(5, 7, 2, "16S"), [3, -40000]), "select y::int y, x::int x, c::int c, case c when 0 then 3 else -32768 end v from range(0, 5) a(y), range(0, 7) b(x), range(0, 2) d(c)")
query("mat_facts", lambda s, d: pattern(s).facts(), "select 32 rows, 48 cols, 3 channels, '8U' depth, 3 elem_size, 1 elem_size1, 1536 total, 144 step, false empty")
query("from_rows", lambda s, d: Mat.from_rows(s.read.parquet(f"{d}/nation.parquet"), Meta(5, 25, 1, "32S"), "n_regionkey", "n_nationkey", v="n_nationkey"), "select y::int y, x::int x, 0 c, coalesce(n_nationkey, 0)::int v from range(0, 5) a(y) cross join range(0, 25) b(x) left join nation on n_regionkey = y and n_nationkey = x")
query("swapped", lambda s, d: lo.swap(p1(s, d), gray(s, d))[0], "select y, x, c, v from gray")
query("copy_masked", lambda s, d: lo.copy_to(p1(s, d), gray(s, d)), PAIR.format("case when g.v <> 0 then p.v else 0 end::int"))
query("split_third", lambda s, d: lo.split(pattern(s))[2], "select y, x, 0 c, v from pattern where c = 2")
query("merge_round_trip", lambda s, d: lo.merge(lo.split(ship(s, d))), "select y, x, c, v from ship")
query("merge_mixed", lambda s, d: lo.merge([pattern(s), gray(s, d)]), "select y, x, c, v from pattern union all select y, x, 3, v from gray")
query("extract_channel", lambda s, d: lo.extract_channel(ship(s, d), 1), "select y, x, 0 c, v from ship where c = 1")
query("insert_channel", lambda s, d: lo.insert_channel(gray(s, d), pattern(s), 1), "select y, x, c, v from pattern where c <> 1 union all select y, x, 1, v from gray")
query("mix_channels", lambda s, d: lo.mix_channels([pattern(s), gray(s, d)], [(3, "8U")], [(2, 0), (3, 1), (-1, 2)])[0], "select y, x, 0 c, v from pattern where c = 2 union all select y, x, 1, v from gray union all select y, x, 2, 0 from gray")
for _mode, _y, _x in (
    ("REPLICATE", "least(greatest(y - 3, 0), 31)", "least(greatest(x - 4, 0), 47)"),
    ("REFLECT", "least((y - 3 + 64) % 64, 63 - (y - 3 + 64) % 64)", "least((x - 4 + 96) % 96, 95 - (x - 4 + 96) % 96)"),
    ("REFLECT_101", "least((y - 3 + 62) % 62, 62 - (y - 3 + 62) % 62)", "least((x - 4 + 94) % 94, 94 - (x - 4 + 94) % 94)"),
    ("WRAP", "(y - 3 + 32) % 32", "(x - 4 + 48) % 48"),
):
    query(f"copy_make_border_{_mode.lower()}", lambda s, d, m=_mode: lo.copy_make_border(pattern(s), 3, 2, 4, 5, m), f"select g.y::int y, g.x::int x, p.c, p.v from (select y, x, {_y} sy, {_x} sx from range(0, 37) a(y), range(0, 57) b(x)) g join pattern p on p.y = g.sy and p.x = g.sx")
query("copy_make_border_constant", lambda s, d: lo.copy_make_border(pattern(s), 3, 2, 4, 5, "CONSTANT", [9, 8, 7]), "select y::int y, x::int x, c::int c, coalesce(p.v, 9 - c)::int v from range(0, 37) a(y) cross join range(0, 57) b(x) cross join range(0, 3) e(c) left join pattern p on p.y = a.y - 3 and p.x = b.x - 4 and p.c = e.c".replace("select y::int y, x::int x, c::int c", "select a.y::int y, b.x::int x, e.c::int c").replace("9 - c", "9 - e.c"))
query("border_interpolate", lambda s, d: s.range(-12, 20).select(F.col("id").cast("int").alias("p"), *[lo.border_interpolate(F.col("id").cast("int"), 5, m).cast("int").alias(m.lower()) for m in ("CONSTANT", "REPLICATE", "REFLECT", "REFLECT_101", "WRAP")]), "select p::int p, case when p between 0 and 4 then p else -1 end::int constant, least(greatest(p, 0), 4)::int replicate, least((p + 20) % 10, 9 - (p + 20) % 10)::int reflect, least((p + 16) % 8, 8 - (p + 16) % 8)::int reflect_101, ((p + 15) % 5)::int wrap from range(-12, 20) t(p)")
_ND = "from range(0, 3) a(i), range(0, 4) b(j), range(0, 5) e(k)"
nd = lambda s: s.range(60).selectExpr("array(cast(id div 20 as int), cast(id div 5 % 4 as int), cast(id % 5 as int)) idx", "cast(id * 7 % 23 as int) v")
_flat = lambda df, n=3: df.select(*[F.col("idx")[i].alias(f"i{i}") for i in range(n)], "v")
query("flip_nd", lambda s, d: _flat(lo.flip_nd(nd(s), (3, 4, 5), -2)), f"select i::int i0, (3 - j)::int i1, k::int i2, ((i * 20 + j * 5 + k) * 7 % 23)::int v {_ND}")
query("transpose_nd", lambda s, d: _flat(lo.transpose_nd(nd(s), (3, 4, 5), [2, 0, 1])), f"select k::int i0, i::int i1, j::int i2, ((i * 20 + j * 5 + k) * 7 % 23)::int v {_ND}")
query("broadcast_nd", lambda s, d: _flat(lo.broadcast_nd(nd(s).where("idx[1] = 0").select(F.array(F.col("idx")[0], F.lit(0), F.col("idx")[2]).alias("idx"), "v"), (3, 1, 5), (2, 3, 4, 5)), 4), "select h::int i0, i::int i1, j::int i2, k::int i3, ((i * 20 + k) * 7 % 23)::int v from range(0, 2) z(h), range(0, 3) a(i), range(0, 4) b(j), range(0, 5) e(k)")

# products

query("gemm_gram_columns", lambda s, d: la.gemm(emb(s, d), emb(s, d), trans_a=True).px.select("y", "x", F.round(F.col("v").cast("double"), 3).alias("v")), "select a.x y, b.x, round(sum(a.v::double * b.v::double)::float::double, 3) v from emb a join emb b on a.y = b.y group by a.x, b.x")
query("gemm_nn", lambda s, d: la.gemm(p1(s, d), lo.transpose(gray(s, d))).px.select("y", "x", F.col("v").cast("double").alias("v")), "select p.y, g.y x, sum(p.v * g.v)::double v from p1 p join gray g on p.x = g.x group by p.y, g.y")
query("gemm_ta", lambda s, d: la.gemm(p1(s, d), gray(s, d), trans_a=True).px.select("y", "x", F.col("v").cast("double").alias("v")), "select p.x y, g.x, sum(p.v * g.v)::double v from p1 p join gray g on p.y = g.y group by p.x, g.x")
query("gemm_int8_scaled", lambda s, d: la.gemm(gray(s, d), ar.subtract(p1(s, d).convert_to("16S"), 128).convert_to("8S"), trans_b=True, scales=s.range(32).selectExpr("cast(id as int) j", "(id + 1) / 64.0D s")).px.select("y", "x", F.round(F.col("v").cast("double"), 2).alias("v")), "select g.y, p.y x, round((sum(g.v * (p.v - 128)) * ((p.y + 1) / 64.0::double))::float::double, 2) v from gray g join p1 p on g.x = p.x group by g.y, p.y")
query("gemm_batched", lambda s, d: _flat(la.gemm_batched(nd(s), s.range(15).selectExpr("array(cast(id div 3 as int), cast(id % 3 as int)) idx", "cast(id as int) v"), (3,), ())), f"select i::int i0, j::int i1, n::int i2, sum(((i * 20 + j * 5 + k) * 7 % 23) * (k * 3 + n))::double v {_ND}, range(0, 3) f(n) group by 1, 2, 3")
query("gemm_shape", lambda s, d: s.range(1).select(F.array(*map(F.lit, la.gemm_shape((2, 1, 4, 6), (3, 6, 5)))).alias("shape")).selectExpr("concat_ws('x', transform(shape, x -> string(x))) shape"), "select '2x3x4x5' shape")
query("argmax_tokens", lambda s, d: la.argmax_tokens(emb(s, d)).select("y", "token"), "select y, arg_min(x, (-v, x))::int token from (select y, x, v::double v from emb) group by y")
query("softmax_rows", lambda s, d: la.softmax(emb(s, d)), "select y, x, c, round((exp(v::double - m) / sum(exp(v::double - m)) over (partition by y))::float::double, 4) v from (select *, max(v::double) over (partition by y) m from emb)")
query("silu", lambda s, d: la.silu(emb(s, d)), "select y, x, c, round((v::double / (1 + exp(-v::double)))::float::double, 4) v from emb")
query("rmsnorm_rows", lambda s, d: la.rmsnorm(emb(s, d)), "select y, x, c, round((v::double / sqrt(avg(v::double * v::double) over (partition by y) + 1e-6))::float::double, 4) v from emb")

# kernels


def _table(spark, a: np.ndarray):
    a = np.atleast_2d(a)
    rows = [(y, x, round(float(a[y, x]), 6) + 0.0) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "y int, x int, v double")


def _values(rows: list[list[float]]) -> str:
    return "select y::int y, x::int x, v::double v from (values " + ", ".join(f"({y}, {x}, {v})" for y, r in enumerate(rows) for x, v in enumerate(r)) + ") t(y, x, v)"


query("structuring_cross", lambda s, d: _table(s, kn.structuring_element("CROSS", 5, 3)), _values([[0, 0, 1, 0, 0], [1, 1, 1, 1, 1], [0, 0, 1, 0, 0]]))
query("structuring_ellipse", lambda s, d: _table(s, kn.structuring_element("ELLIPSE", 5, 5)), _values([[0, 0, 1, 0, 0], [1, 1, 1, 1, 1], [1, 1, 1, 1, 1], [1, 1, 1, 1, 1], [0, 0, 1, 0, 0]]))
query("structuring_diamond", lambda s, d: _table(s, kn.structuring_element("DIAMOND", 5, 5)), "select y::int y, x::int x, case when abs(y - 2) + abs(x - 2) <= 2 then 1 else 0 end::double v from range(0, 5) a(y), range(0, 5) b(x)")
query("structuring_rect", lambda s, d: _table(s, kn.structuring_element("RECT", 3, 2)), "select y::int y, x::int x, 1::double v from range(0, 2) a(y), range(0, 3) b(x)")
query("gaussian_kernel", lambda s, d: _table(s, kn.gaussian_kernel(11, 2.0)), "select 0 y, i::int x, round(exp(-(i - 5) * (i - 5) / 8.0::double) / sum(exp(-(i - 5) * (i - 5) / 8.0::double)) over (), 6) v from range(0, 11) t(i)")
query("gaussian_kernel_small", lambda s, d: _table(s, kn.gaussian_kernel(5)), _values([[0.0625, 0.25, 0.375, 0.25, 0.0625]]))
query("deriv_kernels", lambda s, d: _table(s, np.stack(kn.deriv_kernels(1, 2, 5))), _values([[-1, -2, 0, 2, 1], [1, 0, -2, 0, 1]]))
query("gabor_kernel", lambda s, d: _table(s, kn.gabor_kernel(5, 5, 2.0, 0.5, 3.0, 0.8)), "select (2 - b)::int y, (2 - a)::int x, round(exp(-0.5 * pow((a * cos(0.5) + b * sin(0.5)) / 2, 2) - 0.5 * pow((-a * sin(0.5) + b * cos(0.5)) / 2.5, 2)) * cos(2 * pi() / 3 * (a * cos(0.5) + b * sin(0.5)) + pi() / 2), 6) + 0.0 v from range(-2, 3) p(a), range(-2, 3) q(b)")
query("hanning_window", lambda s, d: _table(s, kn.hanning_window(6, 4)), "select y::int y, x::int x, round(sqrt(0.5 * (1 - cos(2 * pi() * x / 5)) * 0.5 * (1 - cos(2 * pi() * y / 3))), 6) v from range(0, 4) a(y), range(0, 6) b(x)")
query("rotation_matrix", lambda s, d: _table(s, kn.rotation_matrix((10, 20), 30, 2)), "select * from (values (0, 0, round(sqrt(3), 6)), (0, 1, 1.0), (0, 2, round((1 - sqrt(3)) * 10 - 20, 6)), (1, 0, -1.0), (1, 1, round(sqrt(3), 6)), (1, 2, round(10 + (1 - sqrt(3)) * 20, 6))) t(y, x, v)")
query("affine_transform", lambda s, d: _table(s, kn.affine_transform([(0, 0), (1, 0), (0, 1)], [(1, 2), (4, 2), (1, 7)])), _values([[3, 0, 1], [0, 5, 2]]))
query("perspective_transform", lambda s, d: _table(s, kn.perspective_transform([(0, 0), (1, 0), (1, 1), (0, 1)], [(2, 3), (6, 3), (6, 9), (2, 9)])), _values([[4, 0, 2], [0, 6, 3], [0, 0, 1]]))
query("invert_affine", lambda s, d: _table(s, kn.invert_affine(np.array([[2.0, 0, 3], [0, 4, 5]]))), _values([[0.5, 0, -1.5], [0, 0.25, -1.25]]))
