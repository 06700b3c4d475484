"""Rules of the matrix type, and quirks, against values worked out by hand or with numpy."""

import numpy as np
import pytest

from gridloom.functions import kernels
from gridloom.matrix import Mat, MatError, Meta, total
from gridloom.operators import arithmetic as ar
from gridloom.operators import filters, geometry, intensity, layout, linalg, morphology, reductions


def lcg(rows, cols, channels=1, seed=1):
    """Bytes of the linear congruential generator."""
    s, out = seed, []
    for _ in range(rows * cols * channels):
        s = (s * 1664525 + 1013904223) % 2**32
        out.append((s >> 16) & 255)
    return np.array(out, dtype=np.uint8).reshape(rows, cols, channels)


def mat(spark, a, depth=None):
    return Mat.from_numpy(spark, np.asarray(a), depth)


def test_round_trip_and_facts(spark):
    a = lcg(5, 7, 3)
    m = mat(spark, a)
    assert (m.to_numpy() == a).all() and m.is_complete()
    assert m.facts().first().asDict() == {"rows": 5, "cols": 7, "channels": 3, "depth": "8U", "elem_size": 3, "elem_size1": 1, "total": 35, "step": 21, "empty": False}
    assert m.shape_string() == "[3,5,7]" and total((2, 3, 4), 1) == 12


def test_saturation_rounds_away_from_zero(spark):
    m = mat(spark, np.array([[0.5, 1.5, 2.5, -0.5, 300.2, np.nan]]), "64F")
    assert m.convert_to("8U").to_numpy().ravel().tolist() == [1, 2, 3, 0, 255, 0]
    assert ar.convert_scale_abs(m).to_numpy().ravel().tolist() == [0, 2, 2, 0, 255, 0]


def test_integers_wrap_or_clip(spark):
    big = mat(spark, np.array([[2**31 - 1, -(2**31)]], dtype=np.int32))
    assert (big + 1).to_numpy().ravel().tolist() == [-(2**31), -(2**31) + 1]
    assert ar.multiply(big, big).to_numpy().ravel().tolist() == [1, 0]
    small = mat(spark, np.array([[250, 3]], dtype=np.uint8))
    assert (small + 10).to_numpy().ravel().tolist() == [255, 13] and (5 - small).to_numpy().ravel().tolist() == [0, 2]


def test_division(spark):
    a, b = np.array([[7, 5, 9]], dtype=np.uint8), np.array([[2, 0, 4]], dtype=np.uint8)
    assert ar.divide(mat(spark, a), mat(spark, b)).to_numpy().ravel().tolist() == [4, 0, 2]
    f = ar.divide(mat(spark, np.array([[1.0, -1.0, 0.0]]), "64F"), mat(spark, np.zeros((1, 3)), "64F")).to_numpy().ravel()
    assert f[0] == np.inf and f[1] == -np.inf and np.isnan(f[2])


def test_nan_rules(spark):
    a, b = mat(spark, np.array([[np.nan, 1.0, 2.0]]), "32F"), mat(spark, np.array([[1.0, np.nan, 1.0]]), "32F")
    assert np.isnan(ar.minimum(a, b).to_numpy().ravel()[:2]).all() and np.isnan(ar.maximum(a, b).to_numpy().ravel()[:2]).all()
    assert ar.compare(a, b, "EQ").to_numpy().ravel().tolist() == [0, 0, 0] and ar.compare(a, b, "NE").to_numpy().ravel().tolist() == [255, 255, 255]
    assert np.isnan(reductions.norm(a, "L2").first().norm)
    r = reductions.min_max(a).first()
    assert (r.lo, r.hi, r.lo_x, r.hi_x) == (1.0, 2.0, 1, 2)
    assert ar.patch_nans(a, 9).to_numpy().ravel().tolist() == [9, 1, 2]


def test_shift_and_modulo(spark):
    a = mat(spark, np.array([[-128, -7, 7, 100]], dtype=np.int8))
    assert ar.binary("MOD", a, -3).to_numpy().ravel().tolist() == [-2, -1, -2, -2]
    assert ar.binary("FMOD", a, 3).to_numpy().ravel().tolist() == [-2, -1, 1, 1]
    assert ar.binary("BITSHIFT", a, 1).to_numpy().ravel().tolist() == [0, -14, 14, -56]
    assert ar.binary("BITSHIFT", a, -1).to_numpy().ravel().tolist() == [64, 124, 3, 50]
    assert ar.binary("BITSHIFT", a, 8).to_numpy().ravel().tolist() == [0, 0, 0, 0]


def test_check_range(spark):
    m = mat(spark, np.array([[1, 2], [3, 4]], dtype=np.uint8))
    assert ar.check_range(m, 0, 5).first().ok and ar.check_range(m, 0, 4).first()[1:] == (False, 1, 1)
    assert ar.check_range(m, 5, 5).first()[1:] == (False, 0, 0)
    with pytest.raises(Exception, match="OutOfRange"):
        ar.check_range(m, 0, 2, quiet=False).collect()


def test_empty_selection(spark):
    m, none = mat(spark, lcg(3, 4)), Mat.zeros(spark, Meta(3, 4))
    assert reductions.mean(m, none).first()["mean"] == 0
    assert reductions.min_max(m, none).first()[1:] == (0.0, 0.0, -1, -1, -1, -1)
    assert reductions.find_non_zero(none).count() == 0
    assert reductions.normalize(none, 1, 0, "L2", "64F").to_numpy().max() == 0


@pytest.mark.parametrize("mode", ["REPLICATE", "REFLECT", "REFLECT_101", "WRAP"])
def test_borders(spark, mode):
    a = lcg(3, 4)[:, :, 0]
    want = np.pad(a, ((2, 1), (2, 2)), mode={"REPLICATE": "edge", "REFLECT": "symmetric", "REFLECT_101": "reflect", "WRAP": "wrap"}[mode])
    assert (layout.copy_make_border(mat(spark, a), 2, 1, 2, 2, mode).to_numpy()[:, :, 0] == want).all()


def test_one_pixel_and_one_row(spark):
    one = mat(spark, np.array([[7]], dtype=np.uint8))
    assert filters.box_filter(one, 3, 3).to_numpy().item() == 7 and filters.median_blur(one, 3).to_numpy().item() == 7
    row = mat(spark, lcg(1, 9))
    assert filters.gaussian_blur(row, 3, 3, 1.0).meta.shape == (1, 9) and morphology.erode(row).to_numpy().shape == (1, 9, 1)


def test_linear_resize_extrapolates_at_the_edge(spark):
    m = mat(spark, np.array([[100, 120]], dtype=np.uint8))
    assert geometry.resize(m, 1, 4).to_numpy().ravel().tolist() == [95, 105, 115, 120]


def test_morphology_borders_differ(spark):
    m = Mat.full(spark, Meta(4, 4), 255)
    assert morphology.erode(m).to_numpy().min() == 255
    assert morphology.morphology(m, "ERODE").to_numpy().sum() == 4 * 255
    assert (morphology.morphology(m, "HITMISS", np.zeros((3, 3))).to_numpy() == 255).all()


def test_otsu_of_two_values_and_of_nothing(spark):
    m = mat(spark, np.array([[10, 10, 200]], dtype=np.uint8))
    assert intensity.otsu(m).first().thresh == 10.0
    assert intensity.otsu(m, Mat.zeros(spark, Meta(1, 3))).first().thresh == 0.0


def test_otsu_of_one_value(spark):
    m = Mat.full(spark, Meta(2, 3), 255)
    assert intensity.otsu(m).first().thresh == 0.0 and intensity.otsu(m, unparted=None).first().thresh is None
    for unparted, kind, v in ((0.0, "BINARY", 200), (None, "BINARY", 0), (None, "BINARY_INV", 200), (None, "TRUNC", 255), (None, "TOZERO", 0), (None, "TOZERO_INV", 255)):
        assert (intensity.threshold(m, 0, 200, kind, auto="OTSU", unparted=unparted).to_numpy() == v).all()


def test_many_matrices_at_once(spark):
    a, b = lcg(6, 5, seed=1), lcg(6, 5, seed=2)
    m = Mat(Mat.from_numpy(spark, a, mat_id="a").px.unionByName(Mat.from_numpy(spark, b, mat_id="b").px), Meta(6, 5))
    blurred = filters.box_filter(m, 3, 3)
    for k, x in (("a", a), ("b", b)):
        assert (blurred.to_numpy(k) == filters.box_filter(Mat.from_numpy(spark, x), 3, 3).to_numpy()).all()
    assert {r.mat_id: r.n for r in reductions.count_non_zero(m).collect()} == {"a": int((a > 0).sum()), "b": int((b > 0).sum())}


def test_gemm(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(4, 6)), rng.normal(size=(6, 3))
    got = linalg.gemm(mat(spark, a, "32F"), mat(spark, b, "32F")).to_numpy()[:, :, 0]
    assert np.allclose(got, a @ b, atol=1e-4)


def test_kernels():
    assert kernels.gaussian_kernel(3).tolist() == [0.25, 0.5, 0.25] and abs(kernels.gaussian_kernel(11).sum() - 1) < 1e-12
    assert [k.tolist() for k in kernels.deriv_kernels(1, 0, 3)] == [[-1, 0, 1], [1, 2, 1]]
    m = kernels.affine_transform([(0, 0), (1, 0), (0, 1)], [(5, 6), (6, 6), (5, 8)])
    assert np.allclose(m, [[1, 0, 5], [0, 2, 6]]) and np.allclose(kernels.invert_affine(m), [[1, 0, -5], [0, 0.5, -3]])
    assert (kernels.invert_affine(np.zeros((2, 3))) == 0).all()


@pytest.mark.parametrize(
    "call",
    [
        lambda m: m.reshape(2, 2), lambda m: m.roi(0, 9, 0, 1), lambda m: m.at(9, 0), lambda m: ar.add(m, m.roi(0, 1, 0, 2)), lambda m: ar.sqrt(m), lambda m: ar.binary("NOPE", m, m),
        lambda m: Mat.full(m.spark, Meta(1, 1, 1, "64U")), lambda m: filters.median_blur(m, 2), lambda m: filters.sobel(m, 1, 1), lambda m: intensity.apply_color_map(m, "BONE"),
        lambda m: linalg.gemm(m, m), lambda m: kernels.affine_transform([(0, 0), (1, 1), (2, 2)], [(0, 0), (1, 0), (0, 1)]), lambda m: reductions.reduce(m, 2, "SUM"), lambda m: layout.rotate(m, "45"),
    ],
)
def test_wrong_calls_are_refused_when_the_plan_is_made(spark, call):
    with pytest.raises(MatError):
        call(Mat.zeros(spark, Meta(2, 3)))
