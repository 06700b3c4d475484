"""Kernels and small transforms, made on the driver: a few numbers each."""

from __future__ import annotations

import math

import numpy as np

from gridloom.matrix import MatError, require


def structuring_element(shape: str, width: int, height: int, anchor: tuple[int, int] = (-1, -1)) -> np.ndarray:
    """RECT, CROSS, ELLIPSE or DIAMOND of 0 and 1."""
    require(width > 0 and height > 0, "BadSize", "sizes must be positive")
    require(shape in ("RECT", "CROSS", "ELLIPSE", "DIAMOND"), "BadArg", f"no shape {shape}")
    ax, ay = (width // 2 if anchor[0] < 0 else anchor[0]), (height // 2 if anchor[1] < 0 else anchor[1])
    require(ax < width and ay < height, "OutOfRange", "the anchor lies outside")
    y, x = np.mgrid[:height, :width]
    ry, cx = height // 2, width // 2
    if shape == "RECT" or (width, height) == (1, 1):
        return np.ones((height, width), dtype=np.uint8)
    if shape == "CROSS":
        return ((y == ay) | (x == ax)).astype(np.uint8)
    if shape == "DIAMOND":
        return (abs(y - ry) + abs(x - cx) <= ry).astype(np.uint8)
    dy = abs(np.arange(height) - ry)
    half = np.array([math.floor(cx * math.sqrt(max(0, ry * ry - d * d) / (ry * ry) if ry else 0.0) + 0.5) if d <= ry else -1 for d in dy.tolist()])
    return (abs(x - cx) <= half[:, None]).astype(np.uint8)


#: Gaussian kernels of sizes 1 to 9 where no sigma is given.
SMALL_GAUSSIAN = {
    1: [1.0],
    3: [0.25, 0.5, 0.25],
    5: [0.0625, 0.25, 0.375, 0.25, 0.0625],
    7: [0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125],
    9: [0.015625, 0.05078125, 0.1171875, 0.19921875, 0.234375, 0.19921875, 0.1171875, 0.05078125, 0.015625],
}


def _bell(size: int, sigma: float) -> np.ndarray:
    x = np.arange(size) - (size - 1) / 2
    w = np.exp(-0.5 * (x / sigma) ** 2)
    return w / w.sum()


def gaussian_kernel(size: int, sigma: float = 0.0) -> np.ndarray:
    require(size > 0 and size % 2 == 1, "BadSize", "an odd size")
    if sigma <= 0 and size in SMALL_GAUSSIAN:
        return np.array(SMALL_GAUSSIAN[size])
    return _bell(size, sigma if sigma > 0 else 0.15 * size + 0.35)


def blur_gaussian(size: int, sigma: float) -> np.ndarray:
    """The kernel that the Gaussian blur takes: its rule for a missing sigma differs from gaussian_kernel's."""
    return _bell(size, sigma if sigma > 0 else 0.3 * ((size - 1) * 0.5 - 1) + 0.8)


def blur_size(size: int, sigma: float) -> int:
    """The size that a blur of this sigma takes where none is given."""
    return size if size > 0 else max(3, math.floor(6 * sigma + 1 + 0.5) | 1)


def _difference(size: int, order: int) -> np.ndarray:
    require(1 <= size <= 31 and size % 2 == 1 and order < max(size, 3), "BadArg", "an odd size above the order")
    if size == 1:
        size = 3 if order else 1
        base = [np.array([1.0]), np.array([-1.0, 0.0, 1.0]), np.array([1.0, -2.0, 1.0])]
        return base[order]
    k = np.array([1.0])
    for _ in range(size - order - 1):
        k = np.convolve(k, [1.0, 1.0])
    for _ in range(order):
        k = np.convolve(k, [-1.0, 1.0])
    return k


def deriv_kernels(dx: int, dy: int, size: int, normalize: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Row and column kernels of a derivative; size <= 0: Scharr's."""
    require(dx >= 0 and dy >= 0 and dx + dy > 0, "BadArg", "an order above 0")
    if size <= 0:
        require(dx + dy == 1, "BadArg", "first derivatives only")
        smooth, step = np.array([3.0, 10.0, 3.0]) / (32 if normalize else 1), np.array([-1.0, 0.0, 1.0])
        return (step, smooth) if dx else (smooth, step)
    kx, ky = _difference(size, dx), _difference(size, dy)
    if normalize:
        kx, ky = kx * 2.0 ** -(len(kx) - dx - 1), ky * 2.0 ** -(len(ky) - dy - 1)
    return kx, ky


def gabor_kernel(width: int, height: int, sigma: float, theta: float, lambd: float, gamma: float, psi: float = math.pi / 2) -> np.ndarray:
    require(sigma > 0 and lambd != 0 and gamma != 0, "BadArg", "sigma, lambda and gamma")
    sx, sy, c, s = sigma, sigma / gamma, math.cos(theta), math.sin(theta)
    reach = lambda a, b: math.floor(max(abs(3 * sx * a), abs(3 * sy * b)) + 0.5)
    xm, ym = (width // 2 if width > 0 else reach(c, s)), (height // 2 if height > 0 else reach(s, c))
    y, x = np.mgrid[ym : -ym - 1 : -1, xm : -xm - 1 : -1]
    u, v = x * c + y * s, -x * s + y * c
    return np.exp(-0.5 * (u / sx) ** 2 - 0.5 * (v / sy) ** 2) * np.cos(2 * math.pi / lambd * u + psi)


def hanning_window(width: int, height: int) -> np.ndarray:
    require(width > 1 and height > 1, "BadSize", "sizes above 1")
    wave = lambda n: 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / (n - 1)))
    return np.sqrt(np.outer(wave(height), wave(width)))


def rotation_matrix(center: tuple[float, float], degrees: float, scale: float) -> np.ndarray:
    a, b = scale * math.cos(math.radians(degrees)), scale * math.sin(math.radians(degrees))
    x, y = center
    return np.array([[a, b, (1 - a) * x - b * y], [-b, a, b * x + (1 - a) * y]])


def _solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if abs(np.linalg.det(a)) < 1e-12 * max(1.0, float(np.abs(a).max())) ** len(a):
        raise MatError("BadArg", "the points are degenerate")
    return np.linalg.solve(a, b)


def affine_transform(src: list[tuple[float, float]], dst: list[tuple[float, float]]) -> np.ndarray:
    """2 x 3, from 3 pairs of points."""
    require(len(src) == len(dst) == 3, "BadArg", "3 pairs of points")
    return _solved(np.array([[x, y, 1.0] for x, y in src]), np.array(dst, dtype=float)).T


def perspective_transform(src: list[tuple[float, float]], dst: list[tuple[float, float]]) -> np.ndarray:
    """3 x 3, from 4 pairs of points."""
    require(len(src) == len(dst) == 4, "BadArg", "4 pairs of points")
    rows = [[x, y, 1, 0, 0, 0, -x * u, -y * u] for (x, y), (u, _) in zip(src, dst, strict=True)] + [[0, 0, 0, x, y, 1, -x * v, -y * v] for (x, y), (_, v) in zip(src, dst, strict=True)]
    return np.append(_solved(np.array(rows, dtype=float), np.array([u for u, _ in dst] + [v for _, v in dst], dtype=float)), 1.0).reshape(3, 3)


def invert_affine(m: np.ndarray) -> np.ndarray:
    """Zeros for a singular one."""
    d = m[0, 0] * m[1, 1] - m[0, 1] * m[1, 0]
    if d == 0:
        return np.zeros((2, 3))
    a = np.array([[m[1, 1], -m[0, 1]], [-m[1, 0], m[0, 0]]]) / d
    return np.hstack([a, -a @ m[:, 2:3]])
