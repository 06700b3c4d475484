"""Some of each family of queries against their SQL; the rest differ in parameters only."""

import pytest
from helpers import SF, same

from gridloom.plans import registry

NAMES = """arith_add_sat arith_div_round arith_compare_gt binary_mod_signed binary_bitshift scalar_add_lanes expr_chain in_range convert_scale_abs math_log check_range
mean_masked norm_diff_l2 find_non_zero min_max_loc reduce_rows_sum reduce_argmax_last normalize_l1_masked rotate_90_cw reshape mix_channels copy_make_border_reflect transpose_nd gemm_int8_scaled argmax_tokens
structuring_ellipse gabor_kernel ship_bgr2yuv yuv2bgr_nv12 bgr2yuv_yv12 yuv2rgb_uyvy demosaic_gb heat_otsu heat_triangle adaptive_threshold_mean heat_equalize_hist heat_colormap_jet accumulate_weighted_daily blend_linear
box3x3_constant filter2d_sharpen_reflect_101 median3 bilateral sobel_roi_sees_parent integral canny morph_tophat hitmiss pyrdown pyrup resize_linear warp_affine_linear warp_perspective remap rect_sub_pix
swapped convert_fp16_bits image_pnm adaptive_threshold_gaussian canny_l2 canny_of_derivatives resize_gray_threshold""".split()


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    same(registry.QUERIES[name](spark, SF), duck, registry.SQL[name])


def test_gram_of_all_rows(spark, duck):
    same(registry.QUERIES["gemm_gram_columns"](spark, SF), duck, registry.SQL["gemm_gram_columns"])


@pytest.fixture(scope="module")
def flat(tmp_path_factory):
    """Tables whose heat map has one value: every cell saturated, and no events at all."""
    import duckdb

    found = []
    for name, n in (("full", 16), ("none", 0)):
        found.append(tmp_path_factory.mktemp(name))
        duckdb.sql(f"copy (select u user_id, make_timestamp(2024, 1, 1, h // 2, h % 2 * 30, 0) ts from range(64) a(u), range(48) b(h), range({n}) c(k)) to '{found[-1]}/events.parquet' (format parquet)")
    return found


def _same_over(spark, name, dirs):
    import duckdb

    for d in dirs:
        con = duckdb.connect()
        con.sql(f"create view events as from '{d}/events.parquet'")
        same(registry.QUERIES[name](spark, str(d)), con, registry.SQL[name])


def test_otsu_of_one_value(spark, flat):
    _same_over(spark, "heat_otsu", flat)


def test_threshold_otsu_of_one_value(spark, flat):
    _same_over(spark, "heat_threshold_otsu", flat)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
