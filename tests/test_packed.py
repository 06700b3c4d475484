import numpy as np
import pytest
from test_matrix import lcg

from gridloom.matrix import Mat, Meta
from gridloom.operators import packed as pk
from gridloom.sources import images, jpeg


def test_pack_and_unpack(spark):
    a = lcg(5, 4, 3)
    m = Mat.from_numpy(spark, a)
    assert (pk.unpack(pk.pack(m), m.meta).to_numpy() == a).all()


def test_bits_of_floats(spark):
    a, b = np.array([[1.5, -2.25]], dtype=np.float32), np.array([[3.0, 0.5]], dtype=np.float32)
    pa, pb = pk.pack(Mat.from_numpy(spark, a)), pk.pack(Mat.from_numpy(spark, b))
    got = pk.unpack(pk.bitwise(pa, pb, "XOR"), Meta(1, 2, 1, "32F")).to_numpy().ravel()
    assert (got.view(np.uint32) == (a.view(np.uint32) ^ b.view(np.uint32)).ravel()).all()
    twice = pk.unpack(pk.bitwise_not(pk.bitwise_not(pa)), Meta(1, 2, 1, "32F")).to_numpy().ravel()
    assert twice.tolist() == a.ravel().tolist()


def test_half_floats(spark):
    a = np.array([[1.0, 0.1, 65504.0, 1e-7]], dtype=np.float32)
    half = pk.convert_fp16(pk.pack(Mat.from_numpy(spark, a)))
    back = pk.unpack(pk.convert_fp16(half), Meta(1, 4, 1, "32F")).to_numpy().ravel()
    assert back.tolist() == a.astype(np.float16).astype(np.float32).ravel().tolist()
    cut = pk.floor_half(np.array([1.0009, -1.0009, 1e-7, 7e4], dtype=np.float32))
    assert cut.tolist() == [1.0, -1.0, np.float32(5.9604645e-08).item(), np.inf]


def test_reinterpret(spark):
    a = lcg(2, 3, 4)
    got = pk.unpack(pk.reinterpret(pk.pack(Mat.from_numpy(spark, a)), "32S", 1), Meta(2, 3, 1, "32S")).to_numpy()
    assert (got.view("u1").reshape(2, 3, 4) == a).all()


def test_stripes(spark):
    a = lcg(7, 4)
    p = pk.pack(Mat.from_numpy(spark, a))
    out = pk.parallel_for(p, lambda rows, lo, hi: rows + np.arange(lo, hi, dtype=np.uint8)[:, None, None], 3)
    assert (pk.unpack(out, Meta(7, 4)).to_numpy() == a + np.arange(7, dtype=np.uint8)[:, None, None]).all()


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_files_round_trip(spark, tmp_path, channels):
    a = lcg(6, 9, channels)
    p = pk.pack(Mat.from_numpy(spark, a, mat_id="x"))
    for form in ("png", "bmp"):
        rows = images.imwrite(p, f"file://{tmp_path}/{form}", form).collect()
        assert [r.ok for r in rows] == [True]
        got = pk.as_array(images.imread(spark, f"file://{rows[0].path}", images.UNCHANGED).first().asDict())
        assert (got == (a if form == "png" or channels > 1 else np.repeat(a, 3, axis=2))).all()
    assert [r.ok for r in images.imwrite(p, f"file://{tmp_path}/no", "tiff").collect()] == [False]


def test_jpeg_is_read_by_spark(spark, tmp_path):
    y, x = np.mgrid[:20, :30]
    a = np.stack([y * 8, x * 7, (x + y) * 4], axis=2).astype(np.uint8)
    (tmp_path / "a.jpg").write_bytes(jpeg.encode(a))
    (tmp_path / "b.jpg").write_bytes(b"not a picture")
    rows = {r.mat_id[-5:]: pk.as_array(r.asDict()) for r in images.imread(spark, f"file://{tmp_path}/").collect()}
    assert np.abs(rows["a.jpg"][:, :, ::-1].astype(int) - a).max() <= 6 and rows["b.jpg"].size == 0


def test_pnm_and_broken_files(spark, tmp_path):
    (tmp_path / "a.ppm").write_bytes(b"P6\n# c\n2 1\n255\n" + bytes([1, 2, 3, 4, 5, 6]))
    (tmp_path / "b.png").write_bytes(b"\x89PNG\r\n\x1a\nbroken")
    rows = {r.mat_id[-5:]: pk.as_array(r.asDict()) for r in images.imread(spark, [f"file://{tmp_path}/a.ppm", f"file://{tmp_path}/b.png"]).collect()}
    assert rows["a.ppm"].tolist() == [[[3, 2, 1], [6, 5, 4]]] and rows["b.png"].size == 0
