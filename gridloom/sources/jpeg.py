"""Baseline JPEG, encoded with numpy: blocks of 8 x 8, no chroma subsampling, the tables of the standard's annex K."""

from __future__ import annotations

import struct

import numpy as np

# Quantisation of luma and chroma, and the Huffman code lengths and symbols, of ITU T.81 annex K.
LUMA = "16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62 18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99"
CHROMA = "17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99" + " 99" * 32
DC_LENGTHS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
DC_SYMBOLS = bytes(range(12))


def _zigzag() -> np.ndarray:
    return np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8) if (i // 8 + i % 8) % 2 else (i % 8))))


ZIGZAG = _zigzag()
#: Run and size symbols of AC coefficients, all 8 bits long: a plain code that any decoder reads.
AC_SYMBOLS = bytes([0x00, 0xF0, *(r * 16 + s for s in range(1, 11) for r in range(16))])
AC_LENGTHS = bytes([0, 0, 0, 0, 0, 0, 0, len(AC_SYMBOLS)] + [0] * 8)


def _codes(lengths: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    out, code, k = {}, 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[symbols[k]] = (code, n)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _tables(quality: int) -> list[np.ndarray]:
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    return [np.clip((np.array(t.split(), dtype=float) * scale + 50) // 100, 1, 255) for t in (LUMA, CHROMA)]


def encode(image: np.ndarray, quality: int = 95) -> bytes:
    """image: 8 bits, gray or RGB order; alpha is dropped."""
    h, w, n = image.shape
    if n < 3:
        planes = [image[:, :, 0].astype(float) - 128]
    else:
        r, g, b = (image[:, :, k].astype(float) for k in range(3))
        planes = [0.299 * r + 0.587 * g + 0.114 * b - 128, -0.168736 * r - 0.331264 * g + 0.5 * b, 0.5 * r - 0.418688 * g - 0.081312 * b]
    quant = _tables(quality)
    k = np.arange(8)
    dct = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None]
    blocks = []
    for i, p in enumerate(planes):
        p = np.pad(p, ((0, -h % 8), (0, -w % 8)), mode="edge")
        b = p.reshape(p.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
        f = (dct @ b @ dct.T).reshape(-1, 64) / quant[min(i, 1)]
        blocks.append(np.clip(np.rint(f), -1023, 1023).astype(int)[:, ZIGZAG])
    dc, ac = _codes(DC_LENGTHS, DC_SYMBOLS), _codes(AC_LENGTHS, AC_SYMBOLS)
    bits: list[str] = []

    def put(code: tuple[int, int]) -> None:
        bits.append(format(code[0], f"0{code[1]}b"))

    def amount(v: int, size: int) -> None:
        if size:
            bits.append(format(v if v > 0 else v + (1 << size) - 1, f"0{size}b"))

    last = [0] * len(blocks)
    for j in range(len(blocks[0])):
        for i, plane in enumerate(blocks):
            row = plane[j].tolist()
            d = row[0] - last[i]
            last[i] = row[0]
            put(dc[abs(d).bit_length()])
            amount(d, abs(d).bit_length())
            zeros = 0
            for v in row[1:]:
                if v == 0:
                    zeros += 1
                    continue
                while zeros > 15:
                    put(ac[0xF0])
                    zeros -= 16
                put(ac[zeros * 16 + abs(v).bit_length()])
                amount(v, abs(v).bit_length())
                zeros = 0
            if zeros:
                put(ac[0])
    stream = "".join(bits)
    stream += "1" * (-len(stream) % 8)
    data = int(stream, 2).to_bytes(len(stream) // 8, "big").replace(b"\xff", b"\xff\x00")
    part = lambda mark, body: b"\xff" + bytes([mark]) + struct.pack(">H", len(body) + 2) + body
    out = b"\xff\xd8" + part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    for i in range(min(2, len(planes))):
        out += part(0xDB, bytes([i]) + bytes(quant[i].astype(np.uint8)[ZIGZAG]))
    out += part(0xC0, struct.pack(">BHHB", 8, h, w, len(planes)) + b"".join(bytes([i + 1, 0x11, min(i, 1)]) for i in range(len(planes))))
    out += part(0xC4, b"\0" + DC_LENGTHS + DC_SYMBOLS) + part(0xC4, b"\x10" + AC_LENGTHS + AC_SYMBOLS)
    out += part(0xDA, bytes([len(planes)]) + b"".join(bytes([i + 1, 0]) for i in range(len(planes))) + b"\0\x3f\0")
    return out + data + b"\xff\xd9"
