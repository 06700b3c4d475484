"""Steps for packed.map_mats: the same results as the px operators, on whole arrays. For many images at once: no scalar becomes a row, and nothing is shuffled.

Each function returns a step (array, depth) to (array, depth).
"""

from __future__ import annotations

import numpy as np

from gridloom.functions import kernels

_PAD = {"REPLICATE": "edge", "REFLECT": "symmetric", "REFLECT_101": "reflect", "WRAP": "wrap"}
_LIMITS = {"8U": (0, 255), "8S": (-128, 127), "16U": (0, 65535), "16S": (-32768, 32767)}


def saturated(v: np.ndarray, depth: str, even: bool = False) -> np.ndarray:
    """Rounded half away from zero (or to even) and clipped."""
    if depth not in _LIMITS:
        return v
    r = np.rint(v) if even else np.trunc(v + np.copysign(np.float32(0.5), v))
    return np.clip(r, *_LIMITS[depth])


def _cast(v: np.ndarray, depth: str) -> np.ndarray:
    return v.astype({"8U": "u1", "8S": "i1", "16U": "u2", "16S": "i2", "32F": "f4", "64F": "f8", "32S": "i4"}[depth])


def padded(a: np.ndarray, top: int, bottom: int, left: int, right: int, border: str) -> np.ndarray:
    width = ((top, bottom), (left, right), (0, 0))
    return np.pad(a, width) if border == "CONSTANT" else np.pad(a, width, mode=_PAD[border])


def _separable(a: np.ndarray, kx, ky, border: str, kind) -> np.ndarray:
    """Rows, then columns: a sum of shifted slices."""
    h, w = a.shape[:2]
    rx, ry = len(kx) // 2, len(ky) // 2
    p = padded(a.astype(kind), ry, ry, rx, rx, border)
    row = _summed([p[:, i : i + w] for i in range(len(kx))], kx, kind)
    return _summed([row[i : i + h] for i in range(len(ky))], ky, kind)


def _summed(parts: list[np.ndarray], weights, kind) -> np.ndarray:
    """The weighted sum, in the parts' order and type; a weight of 1 costs no product."""
    out = None
    for part, k in zip(parts, weights, strict=True):
        if k:
            x = part if k == 1 else part * kind(k)
            out = x.copy() if out is None and k == 1 else x if out is None else np.add(out, x, out=out)
    return out if out is not None else np.zeros_like(parts[0])


def box(width: int, height: int, border: str = "REFLECT_101"):
    # of bytes there are few sums: their rounded means are a table
    sums = np.arange(width * height * 255 + 1)
    means = saturated(sums.astype(np.float32) * np.float32(1 / (width * height)), "8U").astype(np.uint8)

    def step(a, depth):
        if depth == "8U" and len(sums) <= 1 << 16:
            return np.take(means, _separable(a, np.ones(width), np.ones(height), border, np.uint16)), depth
        s = _separable(a, np.ones(width), np.ones(height), border, np.int32 if depth == "8U" else np.float64)
        mean = s.astype(np.float32) * np.float32(1 / (width * height)) if depth == "8U" else s / (width * height)
        return _cast(saturated(mean, depth), depth), depth

    return step


def gaussian(size: int, sigma: float, border: str = "REFLECT_101"):
    k = kernels.blur_gaussian(kernels.blur_size(size, sigma), sigma)
    return lambda a, depth: (_cast(saturated(_separable(a, k, k, border, np.float64), depth), depth), depth)


def sobel(dx: int, dy: int, size: int = 3, to: str = "16S", border: str = "REFLECT_101"):
    kx, ky = kernels.deriv_kernels(dx, dy, size)
    narrow = 255 * np.abs(kx).sum() * np.abs(ky).sum() < 1 << 15

    def step(a, depth):
        if depth == "8U" and narrow and to == "16S":
            return _separable(a, kx, ky, border, np.int16), to
        return _cast(saturated(_separable(a, kx, ky, border, np.int32 if depth == "8U" else np.float64), to), to), to

    return step


def laplacian(to: str = "16S", border: str = "REFLECT_101"):
    def step(a, depth):
        p = padded(a.astype(np.int32 if depth == "8U" else np.float64), 1, 1, 1, 1, border)
        return _cast(saturated(p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1], to), to), to

    return step


def _middle(planes: list[np.ndarray]) -> np.ndarray:
    """The median of each place's values, whose number is odd. Of more than half of them the least and the largest are not it: both go, and a value not seen yet comes in."""
    m = len(planes) // 2 + 2
    own, rest = planes[:m], planes[m:]
    while len(own) > 1:
        n = len(own)
        low = [np.minimum(own[i], own[n - 1 - i]) for i in range(n // 2)] + own[n // 2 : n // 2 + n % 2]
        high = [np.maximum(own[i], own[n - 1 - i]) for i in range(n // 2)] + own[n // 2 : n // 2 + n % 2]
        least, largest = low[0], high[0]
        kept_low, kept_high = [], []
        for x in low[1 : n // 2]:
            kept_low.append(np.maximum(least, x))
            least = np.minimum(least, x)
        for x in high[1 : n // 2]:
            kept_high.append(np.minimum(largest, x))
            largest = np.maximum(largest, x)
        if n % 2:
            x = own[n // 2]
            # one value for three: what is neither the least nor the largest stays
            x, least = np.maximum(x, least), np.minimum(x, least)
            x, largest = np.minimum(x, largest), np.maximum(x, largest)
            kept_low.append(x)
        own = kept_low + kept_high + rest[:1]
        rest = rest[1:]
    return own[0]


def median(size: int):
    def step(a, depth):
        h, w = a.shape[:2]
        p = padded(a, size // 2, size // 2, size // 2, size // 2, "REPLICATE")
        planes = [p[i : i + h, j : j + w] for i in range(size) for j in range(size)]
        if depth in _LIMITS:
            return _middle(planes), depth
        n = size * size // 2
        return np.partition(np.stack(planes), n, axis=0)[n], depth

    return step


def _extreme(size: int, f, border: str):
    def step(a, depth):
        h, w = a.shape[:2]
        r = size // 2
        p = padded(a, r, r, r, r, border)
        row = p[:, :w]
        for i in range(1, size):
            row = f(row, p[:, i : i + w])
        out = row[:h]
        for i in range(1, size):
            out = f(out, row[i : i + h])
        return out, depth

    return step


def erode(size: int = 3, border: str = "REFLECT_101"):
    return _extreme(size, np.minimum, border)


def dilate(size: int = 3, border: str = "REFLECT_101"):
    return _extreme(size, np.maximum, border)


def threshold(thresh: float, high: int):
    t = np.floor(thresh)
    return lambda a, depth: (np.where(a > t, np.uint8(high), np.uint8(0)), depth)


def otsu(high: int = 255):
    def step(a, depth):
        n = np.bincount(a.ravel(), minlength=256).astype(float)
        nb, sb = np.cumsum(n), np.cumsum(n * np.arange(256))
        nf = nb[-1] - nb
        with np.errstate(all="ignore"):
            between = np.where((nb > 0) & (nf > 0), nb * nf * (sb / nb - (sb[-1] - sb) / nf) ** 2, -1)
        return np.where(a > int(between.argmax()), np.uint8(high), np.uint8(0)), depth

    return step


def to_gray(rgb: bool = False):
    w = (19595, 38470, 7471) if rgb else (7471, 38470, 19595)
    return lambda a, depth: (((a[:, :, :1].astype(np.int32) * w[0] + a[:, :, 1:2].astype(np.int32) * w[1] + a[:, :, 2:3].astype(np.int32) * w[2] + 32768) >> 16).astype(np.uint8), depth)


def lut(table: np.ndarray):
    t = np.asarray(table, dtype=np.uint8).tobytes()
    return lambda a, depth: (_looked_up(a, t), depth)


def _looked_up(a: np.ndarray, table: bytes) -> np.ndarray:
    """A table over bytes, by the interpreter's own translation, which needs no index array."""
    return np.frombuffer(a.tobytes().translate(table), dtype=np.uint8).reshape(a.shape)


def equalize():
    def step(a, depth):
        n = np.bincount(a.ravel(), minlength=256)
        first = int(np.flatnonzero(n)[0])
        if n[first] == a.size:
            return a, depth
        up = (np.cumsum(n) - n[first]).astype(np.float32) * (np.float32(255) / np.float32(a.size - n[first]))
        return _looked_up(a, np.clip(np.rint(up), 0, 255).astype(np.uint8).tobytes()), depth

    return step


def flip(code: int):
    return lambda a, depth: (a[::-1] if code == 0 else a[:, ::-1] if code > 0 else a[::-1, ::-1], depth)


def rotate_90_cw():
    return lambda a, depth: (np.rot90(a, -1), depth)


def transpose():
    return lambda a, depth: (a.transpose(1, 0, 2), depth)


def swap_rb():
    return lambda a, depth: (a[:, :, [2, 1, 0, *range(3, a.shape[2])]], depth)


def integral():
    return lambda a, depth: (np.pad(np.cumsum(np.cumsum(a, axis=0, dtype=np.int32), axis=1, dtype=np.int32), ((1, 0), (1, 0), (0, 0))), "32S")


def resize_linear(rows: int, cols: int):
    def axis(n, to):
        at = (np.arange(to) + 0.5) * (n / to) - 0.5
        low = np.clip(np.floor(at), 0, n - 1).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    def step(a, depth):
        if a.shape == (2 * rows, 2 * cols, 1) and depth == "8U":
            s = a.astype(np.int32).reshape(rows, 2, cols, 2).sum(axis=(1, 3))
            return ((s + 2) >> 2).astype(np.uint8)[:, :, None], depth
        (y0, y1, wy), (x0, x1, wx) = axis(a.shape[0], rows), axis(a.shape[1], cols)
        f = a.astype(np.float64)
        top = f[:, x0] + (f[:, x1] - f[:, x0]) * wx[None, :, None]
        return _cast(saturated(top[y0] + (top[y1] - top[y0]) * wy[:, None, None], depth), depth), depth

    return step


def _shifted(v: np.ndarray, bits: int) -> np.ndarray:
    """v / 2 ** bits, rounded to even."""
    return (v + v.dtype.type((1 << bits - 1) - 1) + (v >> bits & 1)) >> bits


def pyr_down(border: str = "REFLECT_101"):
    k = (1, 4, 6, 4, 1)

    def step(a, depth):
        h, w = a.shape[:2]
        if depth != "8U":
            return _cast(saturated(_separable(a, k, k, border, np.float64)[::2, ::2] / 256, depth, even=True), depth), depth
        # only places that stay are made; sums of bytes fit 16 bits
        p = padded(a, 2, 2, 2, 2, border).astype(np.uint16)
        row = _summed([p[:, i : i + w : 2] for i in range(5)], k, np.uint16)
        return _shifted(_summed([row[i : i + h : 2] for i in range(5)], k, np.uint16), 8).astype(np.uint8), depth

    return step


def pyr_up():
    """Zeros stand between the source's places, so even places see three of them, odd ones two."""

    def twice(v, axis):
        v = np.moveaxis(v, axis, 0)
        n = len(v)
        p = np.concatenate((v[min(1, n - 1)][None], v, v[-1:]))
        out = np.empty((2 * n, *v.shape[1:]), dtype=v.dtype)
        out[::2] = p[:-2] + 6 * p[1:-1] + p[2:]
        out[1::2] = 4 * (p[1:-1] + p[2:])
        return np.moveaxis(out, 0, axis)

    def step(a, depth):
        s = twice(twice(a.astype(np.uint16 if depth == "8U" else np.float64), 1), 0)
        return (_shifted(s, 6).astype(np.uint8) if depth == "8U" else _cast(saturated(s / 64, depth, even=True), depth)), depth

    return step


def stack_blur(size: int):
    ramp = (size // 2 + 1 - abs(np.arange(size) - size // 2)) / (size // 2 + 1) ** 2
    return lambda a, depth: (_cast(saturated(_separable(a, ramp, ramp, "REPLICATE", np.float64), depth), depth), depth)


def adaptive_threshold(high: int, method: str = "MEAN", kind: str = "BINARY", block: int = 3, c: float = 0.0):
    local = box(block, block, "REPLICATE") if method == "MEAN" else gaussian(block, 0.0, "REPLICATE")
    delta = np.ceil(c) if kind == "BINARY" else np.floor(c)
    yes, no = (high, 0) if kind == "BINARY" else (0, high)
    return lambda a, depth: (np.where(a.astype(np.int16) - local(a, depth)[0] > -delta, np.uint8(yes), np.uint8(no)), depth)


def morphology(op: str, size: int = 3, border: str = "CONSTANT"):
    """OPEN, CLOSE, GRADIENT, TOPHAT or BLACKHAT by a square; beyond a constant border lie zeros."""
    low, high = erode(size, border), dilate(size, border)
    opened, closed = (lambda a, d: high(*low(a, d))), (lambda a, d: low(*high(a, d)))

    def less(a, b, depth):
        # neither term exceeds the type, and their difference saturates
        return _cast(saturated(a.astype(np.float64) - b, depth), depth)

    steps = {
        "OPEN": opened, "CLOSE": closed, "GRADIENT": lambda a, d: (less(high(a, d)[0], low(a, d)[0], d), d),
        "TOPHAT": lambda a, d: (less(a, opened(a, d)[0], d), d), "BLACKHAT": lambda a, d: (less(closed(a, d)[0], a, d), d),
    }
    return steps[op]


def bilateral(d: int, sigma_color: float, sigma_space: float, border: str = "REFLECT_101"):
    """For 8U: differences of colour are few, so their weights are a table. Beyond a constant border nothing weighs."""
    r = max(1, d // 2 if d > 0 else int(np.floor(sigma_space * 1.5 + 0.5)))
    taps = [(y, x, np.exp(-0.5 * (y * y + x * x) / sigma_space**2)) for y in range(-r, r + 1) for x in range(-r, r + 1) if y * y + x * x <= r * r]

    def step(a, depth):
        h, w, n = a.shape
        near = np.exp(np.arange(255 * n + 1, dtype=float) ** 2 * (-0.5 / sigma_color**2))
        p, inside = padded(a.astype(np.int16), r, r, r, r, border), padded(np.ones((h, w, 1)), r, r, r, r, border)
        mid, total, out = p[r : r + h, r : r + w], np.zeros((h, w)), np.zeros((h, w, n))
        for y, x, far in taps:
            part = p[r + y : r + y + h, r + x : r + x + w]
            weight = near[np.abs(part - mid).sum(axis=2)] * far
            if border == "CONSTANT":
                weight *= inside[r + y : r + y + h, r + x : r + x + w, 0]
            total += weight
            out += weight[:, :, None] * part
        return _cast(saturated(out / total[:, :, None], depth), depth), depth

    return step


def grown(strong: np.ndarray, weak: np.ndarray) -> np.ndarray:
    """The weak places whose 8-connected component holds a strong one. A front moves on; each place is in it once."""
    left, out = np.pad(weak | strong, 1), np.zeros((weak.shape[0] + 2, weak.shape[1] + 2), dtype=bool)
    wide = left.shape[1]
    around = np.array([dy * wide + dx for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx])
    open_, reached = left.ravel(), out.ravel()
    front = np.flatnonzero(np.pad(strong, 1))
    while len(front):
        reached[front], open_[front] = True, False
        near = (front[:, None] + around).ravel()
        front = np.unique(near[open_[near]])
    return out[1:-1, 1:-1]


def canny(low: float, high: float, aperture: int = 3, l2: bool = False):
    dx, dy = (sobel(a, b, aperture, "16S", "REPLICATE") for a, b in ((1, 0), (0, 1)))
    low, high = np.float32(min(low, high)), np.float32(max(low, high))
    t1, t3 = np.tan(np.pi / 8), np.tan(3 * np.pi / 8)

    def step(a, depth):
        x, y = (d(a, depth)[0][:, :, 0].astype(np.float64) for d in (dx, dy))
        size = (np.sqrt(x * x + y * y) if l2 else np.abs(x) + np.abs(y)).astype(np.float32)
        # only places above the lower bound are looked at
        i, j = np.nonzero(size > low)
        p, own, gx, gy = np.pad(size, 1), size[i, j], x[i, j], y[i, j]
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = np.where(gx != 0, gy / gx, np.where(gy >= 0, 1e308, -1e308))
        flat, fall, rise = np.abs(slope) < t1, (slope >= t1) & (slope <= t3), (slope >= -t3) & (slope <= -t1)
        v = np.select([flat, fall, rise], [0, 1, -1], 1)
        h = np.select([flat, fall, rise], [1, 1, 1], 0)
        b, c = p[i + 1 + v, j + 1 + h], p[i + 1 - v, j + 1 - h]
        kept = ((own > b) | ((own == b) & ~(fall | rise))) & (own > c)
        weak, strong = np.zeros(size.shape, dtype=bool), np.zeros(size.shape, dtype=bool)
        weak[i[kept], j[kept]] = True
        strong[i[kept], j[kept]] = own[kept] > high
        return np.where(grown(strong, weak), np.uint8(255), np.uint8(0))[:, :, None], "8U"

    return step


def warp_affine(matrix: np.ndarray, rows: int, cols: int, inverse: bool = False, border: str = "CONSTANT", value: float = 0):
    """Linear; matrix: 2 x 3, from source to result, unless inverse. Beyond the source lies the value, or its edge (REPLICATE)."""
    m = np.asarray(matrix, dtype=float) if inverse else kernels.invert_affine(np.asarray(matrix, dtype=float))
    y, x = np.mgrid[:rows, :cols]
    sx, sy = x * m[0, 0] + y * m[0, 1] + m[0, 2], x * m[1, 0] + y * m[1, 1] + m[1, 2]
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    wx, wy = (sx - x0)[:, :, None], (sy - y0)[:, :, None]

    def step(a, depth):
        h, w, n = a.shape
        if border == "CONSTANT":
            f = np.pad(a, ((1, 1), (1, 1), (0, 0)), constant_values=_cast(saturated(np.float64(value), depth), depth))
            at = lambda q, k: np.clip(q, -1, k) + 1
        else:
            f = a
            at = lambda q, k: np.clip(q, 0, k - 1)
        flat, wide = f.reshape(-1, n), f.shape[1]
        left, right = at(x0, w), at(x0 + 1, w)
        top, below = at(y0, h) * wide, at(y0 + 1, h) * wide
        out = flat[top + left] * ((1 - wy) * (1 - wx)) + flat[top + right] * ((1 - wy) * wx) + flat[below + left] * (wy * (1 - wx)) + flat[below + right] * (wy * wx)
        return _cast(saturated(out, depth), depth), depth

    return step
