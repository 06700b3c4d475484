"""Queries through the packed form: bytes, half floats, stripes, files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridloom.matrix import Mat, Meta
from gridloom.operators import packed as pk
from gridloom.plans.fixtures import emb, gray, heat, p1, pattern
from gridloom.plans.registry import query
from gridloom.sources import images


def _float(m: Mat) -> Mat:
    return m.convert_to("32F")


query("packed_round_trip", lambda s, d: pk.unpack(pk.pack(pattern(s)), Meta(32, 48, 3)), "select y, x, c, v from pattern")
query("bit_xor_floats_twice", lambda s, d: pk.unpack(pk.bitwise(pk.bitwise(pk.pack(_float(p1(s, d))), pk.pack(_float(gray(s, d))), "XOR"), pk.pack(_float(gray(s, d))), "XOR"), Meta(32, 48, 1, "32F")), "select y, x, c, v::double v from p1")
query("bit_not_floats_twice", lambda s, d: pk.unpack(pk.bitwise_not(pk.bitwise_not(pk.pack(_float(p1(s, d))))), Meta(32, 48, 1, "32F")), "select y, x, c, v::double v from p1")
query("convert_fp16_round_trip", lambda s, d: pk.unpack(pk.convert_fp16(pk.convert_fp16(pk.pack(_float(p1(s, d))))), Meta(32, 48, 1, "32F")), "select y, x, c, v::double v from p1")
_HALF = "case when abs(v) < 0.00006103515625 then round_even(abs(v)::double * 16777216, 0) else (floor(log2(abs(v)::double)) + 15) * 1024 + round_even(abs(v)::double / pow(2, floor(log2(abs(v)::double))) * 1024, 0) - 1024 end"
query("convert_fp16_bits", lambda s, d: pk.unpack(pk.convert_fp16(pk.pack(emb(s, d))), Meta(emb(s, d).meta.rows, 64, 1, "16S")), f"select y, x, c, ({_HALF} - case when v < 0 then 32768 else 0 end)::int v from emb")
query("align_precision_fp16", lambda s, d: pk.unpack(pk.align_precision(pk.pack(Mat(p1(s, d).px.selectExpr("mat_id", "y", "x", "c", "cast(v + 0.0001D as float) v"), Meta(32, 48, 1, "32F"))), "FP16"), Meta(32, 48, 1, "32F")).px.where("v >= 1").select("y", "x", F.col("v").cast("double").alias("v")), "select y, x, v::double v from p1 where v >= 1")
query("reinterpret_32s", lambda s, d: pk.unpack(pk.reinterpret(pk.pack(Mat(pattern(s).px.unionByName(gray(s, d).px.withColumn("c", F.lit(3))), Meta(32, 48, 4))), "32S", 1), Meta(32, 48, 1, "32S")), "select y, x, 0 c, (sum(w)::bigint - case when sum(w) >= 2147483648 then 4294967296 else 0 end)::int v from (select y, x, v::bigint << (8 * c) w from pattern union all select y, x, v::bigint << 24 from gray) group by y, x")
query("parallel_for_rows", lambda s, d: pk.unpack(pk.parallel_for(pk.pack(heat(s, d)), lambda rows, lo, hi: np.minimum(rows.astype(int) + np.arange(lo, hi)[:, None, None], 255), 5), Meta(64, 48)), "select y, x, c, least(v + y, 255)::int v from heat")
query("map_mats", lambda s, d: pk.unpack(pk.map_mats(pk.pack(heat(s, d)), lambda a, k: (a[::-1], k), lambda a, k: (255 - a, k)), Meta(64, 48)), "select (63 - y)::int y, x, c, (255 - v)::int v from heat")


def _files(form: str):
    def run(spark, sf_dir):
        # a portable pixmap is a header and the bytes
        m = pk.pack(pattern(spark)) if form != "ppm" else pk.map_mats(pk.pack(pattern(spark)), lambda a, depth: (a[:, :, ::-1], depth))
        packed = m.withColumn("content", F.concat(F.encode(F.lit("P6\n# all rows\n48 32\n255\n"), "UTF-8"), "data")) if form == "ppm" else images.encoded(m, form)
        decode = {"png": images.decode_png, "bmp": images.decode_bmp, "ppm": images.decode_pnm}[form]

        def back(batches):
            import pyarrow as pa

            for batch in batches:
                for row in batch.to_pylist():
                    a = images.as_asked(decode(row["content"]), images.COLOR)
                    yield pa.RecordBatch.from_pylist([pk.as_row(row["mat_id"], a, "8U")], schema=pk._ARROW)

        return pk.unpack(packed.mapInArrow(back, pk.SCHEMA), Meta(32, 48, 3))

    return run


query("image_png", _files("png"), "select y, x, c, v from pattern")
query("image_bmp", _files("bmp"), "select y, x, c, v from pattern")
query("image_pnm", _files("ppm"), "select y, x, c, v from pattern")
