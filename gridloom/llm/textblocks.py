"""Word and n-gram hashing over Arrow text columns, whole blocks of documents at a time.

Everything here works on the UTF-8 bytes as Arrow holds them, without a Python object for each word.
Hashes select candidates only; each operator confirms on words, or on 128 bits, but for the sets of shingles of operator 4, which are sets of 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Words longer than this are hashed by BLAKE2b: the power table ends here.
LONG_WORD = 1 << 16
PIECE = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_tables: dict[str, np.ndarray] = {}


def byte_class(words: str) -> np.ndarray:
    """Which bytes belong to words: 'space' (ASCII white space separates) or 'alnum' (0-9, a-z, A-Z and all bytes from 0x80)."""
    table = np.zeros(256, dtype=bool)
    if words == "space":
        table[:] = True
        table[[0x20, *range(0x09, 0x0E)]] = False
    else:
        table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = True
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SPACE_WORDS, ALNUM_WORDS = byte_class("space"), byte_class("alnum")
LOWER_BYTES = LOWER.tobytes()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits, in place."""
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _tables:
        n = PIECE + LONG_WORD + 1
        for name, base in (("p", _BASE), ("i", pow(_BASE, -1, 1 << 64))):
            t = np.ones(n, dtype=U64)
            np.multiply.accumulate(np.full(n - 1, base, dtype=U64), out=t[1:])
            _tables[name] = t
    return _tables["p"], _tables["i"]


class Block:
    """Some whole documents: bytes, and where each document begins and ends in them."""

    def __init__(self, first: int, buf: np.ndarray, offsets: np.ndarray):
        self.first, self.buf, self.offsets = first, buf, offsets
        self.n_docs = len(offsets) - 1

    def text(self, i: int) -> bytes:
        return self.buf[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def words(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words, and the bounds of each document's words."""
        m = table[self.buf]
        if not m.any():
            empty = np.zeros(0, dtype=np.int64)
            return empty, empty, np.zeros(self.n_docs + 1, dtype=np.int64)
        cuts = self.offsets[(self.offsets > 0) & (self.offsets < len(m))]
        s = m.copy()
        s[1:] &= ~m[:-1]
        s[cuts] |= m[cuts]
        e = m.copy()
        e[:-1] &= ~m[1:]
        e[cuts - 1] |= m[cuts - 1]
        starts, ends = np.flatnonzero(s), np.flatnonzero(e) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def blocks(column: pa.Array, max_bytes: int = PIECE) -> Iterator[Block]:
    """The column's texts (null: empty), in blocks of whole documents of about max_bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, side="right")) - 1)
        yield Block(i, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64 bits for each word: a polynomial of its bytes by prefix sums, then mixed."""
    power, inverse = _powers()
    out = np.empty(len(starts), dtype=U64)
    if not len(starts):
        return out
    long = np.flatnonzero(ends - starts > LONG_WORD)
    bounds = [0]
    while bounds[-1] < len(starts):
        i = bounds[-1]
        bounds.append(max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, side="right"))))
    for i, j in zip(bounds, bounds[1:], strict=False):
        at, upto = starts[i], ends[j - 1]
        if upto - at > PIECE + LONG_WORD:
            continue  # one long word
        x = buf[at:upto]
        x = (LOWER[x] if lower else x).astype(U64)
        x += U64(1)
        x *= power[: len(x)]
        total = np.zeros(len(x) + 1, dtype=U64)
        np.cumsum(x, out=total[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        h = (total[e] - total[s]) * inverse[s]
        h ^= (e - s).astype(U64) * U64(0xD6E8FEB86659FD93)
        out[i:j] = h
    for k in long:
        word = buf[starts[k] : ends[k]].tobytes()
        out[k] = int.from_bytes(hashlib.blake2b(word.translate(LOWER_BYTES) if lower else word, digest_size=8).digest(), "little")
    return mix(out)


def grams(x: np.ndarray, k: int, seed: int = _BASE) -> np.ndarray:
    """64 bits for each run of k words; runs that cross documents are made too, valid() tells them."""
    n = max(0, len(x) - k + 1)
    h = np.zeros(n, dtype=U64)
    base = U64(seed | 1)
    for q in range(k):
        h *= base
        h += x[q : q + n]
    return mix(h)


def valid(bounds: np.ndarray, k: int) -> np.ndarray:
    """For each run of k words of a block, whether it lies in one document."""
    n = max(0, int(bounds[-1]) - k + 1)
    ok = np.ones(n + k, dtype=bool)
    for back in range(1, k):
        cut = bounds[1:-1] - back
        ok[cut[cut >= 0]] = False
    return ok[:n]


def doc_of(bounds: np.ndarray) -> np.ndarray:
    """The document of each word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def sliding(x: np.ndarray, w: int, least: bool = True) -> np.ndarray:
    """Least (or largest) of each w consecutive values, by doubling."""
    f = np.minimum if least else np.maximum
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    m, span = x, 1
    while span * 2 <= w:
        m = f(m[:-span], m[span:])
        span *= 2
    return f(m[:n], m[w - span : w - span + n])


def minimizers(g: np.ndarray, ok_window: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """g: hashes of runs of k words; a window is w of them. The least hash of each window, and where a run is the least of some valid window."""
    m = sliding(g, w)
    if not len(m):
        return m, np.zeros(len(g), dtype=bool)
    shown = np.where(ok_window, m, U64(0))
    edge = np.zeros(w - 1, dtype=U64)
    back = sliding(np.concatenate((edge, shown, edge)), w, least=False)
    return m, (back == g) & (back > 0)


def digest(data: bytes, bits: int = 128) -> bytes:
    return hashlib.blake2b(data, digest_size=bits // 8).digest()
