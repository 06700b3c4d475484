"""The packed steps against the px operators."""

import numpy as np
import pytest
from test_matrix import lcg

from gridloom.matrix import Mat
from gridloom.operators import canny, color, filters, geometry, intensity, layout, morphology, pyramid
from gridloom.operators import image_kernels as ik

GRAY, COLOR = lcg(14, 18), lcg(14, 18, 3)
SMOOTH = (np.add.outer(np.arange(14) ** 2, 9 * np.arange(18)) % 200).astype(np.uint8)[:, :, None]
TURN = np.array([[0.9, -0.25, 1.5], [0.25, 1.125, -2.0]])


@pytest.mark.parametrize(
    ("step", "px", "image"),
    [
        (ik.box(3, 3), lambda m: filters.box_filter(m, 3, 3), COLOR), (ik.gaussian(5, 1.1), lambda m: filters.gaussian_blur(m, 5, 5, 1.1), GRAY), (ik.sobel(1, 0), lambda m: filters.sobel(m, 1, 0, 3, "16S"), GRAY),
        (ik.laplacian(), lambda m: filters.laplacian(m, 1, "16S"), GRAY), (ik.median(3), lambda m: filters.median_blur(m, 3), GRAY), (ik.median(5), lambda m: filters.median_blur(m, 5), GRAY),
        (ik.erode(), morphology.erode, GRAY), (ik.dilate(5), lambda m: morphology.dilate(m, np.ones((5, 5))), GRAY), (ik.threshold(99.5, 200), lambda m: intensity.threshold(m, 99.5, 200), GRAY),
        (ik.otsu(), lambda m: intensity.threshold(m, 0, 255, auto="OTSU"), GRAY), (ik.to_gray(), color.to_gray, COLOR), (ik.lut(255 - np.arange(256)), lambda m: intensity.lut(m, 255 - np.arange(256), "8U"), GRAY),
        (ik.equalize(), intensity.equalize_hist, GRAY), (ik.flip(1), lambda m: layout.flip(m, 1), COLOR), (ik.rotate_90_cw(), lambda m: layout.rotate(m, "90_CW"), COLOR), (ik.transpose(), layout.transpose, COLOR),
        (ik.swap_rb(), color.swap_rb, COLOR), (ik.integral(), filters.integral, GRAY), (ik.resize_linear(20, 31), lambda m: geometry.resize(m, 20, 31), GRAY), (ik.resize_linear(7, 9), lambda m: geometry.resize(m, 7, 9), GRAY),
        (ik.pyr_down(), pyramid.pyr_down, GRAY), (ik.pyr_down(), pyramid.pyr_down, COLOR), (ik.pyr_up(), pyramid.pyr_up, COLOR), (ik.stack_blur(5), lambda m: filters.stack_blur(m, 5, 5), COLOR),
        (ik.adaptive_threshold(200, "MEAN", "BINARY", 3, 2.5), lambda m: intensity.adaptive_threshold(m, 200, "MEAN", "BINARY", 3, 2.5), GRAY),
        (ik.adaptive_threshold(255, "GAUSSIAN", "BINARY_INV", 5, -1.5), lambda m: intensity.adaptive_threshold(m, 255, "GAUSSIAN", "BINARY_INV", 5, -1.5), GRAY),
        *[(ik.morphology(op), lambda m, op=op: morphology.morphology(m, op), COLOR) for op in ("OPEN", "CLOSE", "GRADIENT", "TOPHAT", "BLACKHAT")],
        (ik.bilateral(5, 60, 2), lambda m: filters.bilateral_filter(m, 5, 60, 2), COLOR), (ik.bilateral(3, 25, 1.5, "CONSTANT"), lambda m: filters.bilateral_filter(m, 3, 25, 1.5, "CONSTANT"), GRAY),
        (ik.canny(300, 150), lambda m: canny.canny(m, 300, 150), SMOOTH), (ik.canny(100, 400, 5, True), lambda m: canny.canny(m, 100, 400, 5, True), SMOOTH),
        (ik.warp_affine(TURN, 16, 15), lambda m: geometry.warp_affine(m, TURN, 16, 15), COLOR), (ik.warp_affine(TURN, 12, 20, True, "REPLICATE"), lambda m: geometry.warp_affine(m, TURN, 12, 20, inverse=True, border="REPLICATE"), GRAY),
        (ik.warp_affine(TURN, 9, 9, value=77), lambda m: geometry.warp_affine(m, TURN, 9, 9, value=77), GRAY),
    ],
)
def test_step(spark, step, px, image):
    got, depth = step(image, "8U")
    want = px(Mat.from_numpy(spark, image))
    assert depth == want.meta.depth and (np.atleast_3d(got) == want.to_numpy()).all()


@pytest.mark.parametrize("n", [1, 3, 5, 9, 25, 49])
def test_middle(n):
    planes = list(np.random.default_rng(n).integers(0, 30, (n, 200), dtype=np.uint8))
    assert (ik._middle(planes) == np.median(planes, axis=0)).all()


def test_halves_round_to_even():
    v = np.arange(65281, dtype=np.uint16)
    assert (ik._shifted(v, 8) == np.rint(v / 256)).all() and (ik._shifted(v[:16321], 6) == np.rint(v[:16321] / 64)).all()


def test_growth_along_a_long_path():
    weak = np.zeros((9, 40), dtype=bool)
    weak[::2] = True
    weak[1::4, -1] = weak[3::4, 0] = True
    strong = np.zeros_like(weak)
    assert not ik.grown(strong, weak).any()
    strong[8, 39] = True
    assert (ik.grown(strong, weak) == weak).all()
    weak[1, -1] = False
    assert (ik.grown(strong, weak)[1:] == weak[1:]).all() and ik.grown(strong, weak)[0].tolist() == [False] * 40
