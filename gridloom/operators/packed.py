"""The packed form: one row for each matrix, its bytes in one column. Bit patterns and half floats need it; a chain of steps over many matrices runs in one pass, without a shuffle.

packed: mat_id string, rows int, cols int, channels int, depth string, data binary (row-major, channels interleaved, little-endian).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.matrix import DEPTHS, NUMPY, Mat, Meta, require
from gridloom.shipping import ship

SCHEMA = "mat_id string, rows int, cols int, channels int, depth string, data binary"
#: Bytes of matrices in one record batch of results.
BATCH_BYTES = 4 << 20
_ARROW = pa.schema([("mat_id", pa.string()), ("rows", pa.int32()), ("cols", pa.int32()), ("channels", pa.int32()), ("depth", pa.string()), ("data", pa.binary())])


def as_array(row: dict) -> np.ndarray:
    return np.frombuffer(row["data"], dtype=NUMPY[row["depth"]]).reshape(row["rows"], row["cols"], row["channels"])


def as_row(mat_id: str, a: np.ndarray, depth: str) -> dict:
    a = np.atleast_3d(a)
    return {"mat_id": mat_id, "rows": a.shape[0], "cols": a.shape[1], "channels": a.shape[2], "depth": depth, "data": np.ascontiguousarray(a, dtype=NUMPY[depth]).tobytes()}


def arrays(batch: pa.RecordBatch, prefix: str = ""):
    """(mat_id, array, depth) of each row, on the bytes as Arrow holds them: nothing is copied."""
    col = lambda c: batch[prefix + c] if prefix + c in batch.schema.names else batch[c]
    data = col("data")
    _, offsets, values = data.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if pa.types.is_large_binary(data.type) else np.int32)[data.offset : data.offset + len(data) + 1].tolist()
    facts = zip(*(col(c).to_pylist() for c in ("mat_id", "rows", "cols", "channels", "depth")), strict=True)
    for i, (mat_id, rows, cols, channels, depth) in enumerate(facts):
        kind = np.dtype(NUMPY[depth])
        a = np.frombuffer(values, dtype=kind, count=(at[i + 1] - at[i]) // kind.itemsize, offset=at[i]) if at[i + 1] > at[i] else np.zeros(0, dtype=kind)
        yield mat_id, a.reshape(rows, cols, channels), depth


def gathered(found, more: tuple = ()):
    """Record batches of about BATCH_BYTES, or of one matrix that is larger, from (mat_id, array, depth, *values of more)."""
    schema = pa.schema([*_ARROW, *more])

    def batch(rows: list) -> pa.RecordBatch:
        flat = [np.ascontiguousarray(np.atleast_3d(a), dtype=NUMPY[depth]) for _, a, depth, *_ in rows]
        offsets = np.concatenate(([0], np.cumsum([a.nbytes for a in flat]))).astype(np.int32)
        data = flat[0].tobytes() if len(flat) == 1 else np.concatenate([a.reshape(-1).view(np.uint8) for a in flat])
        binary = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        sizes = [pa.array([a.shape[k] for a in flat], pa.int32()) for k in range(3)]
        own = [pa.array([r[3 + k] for r in rows], t) for k, (_, t) in enumerate(more)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *sizes, pa.array([r[2] for r in rows], pa.string()), binary, *own], schema=schema)

    rows, size = [], 0
    for r in found:
        if rows and size + r[1].nbytes > BATCH_BYTES:
            yield batch(rows)
            rows, size = [], 0
        rows.append(r)
        size += r[1].nbytes
    if rows:
        yield batch(rows)


def map_mats(packed: DataFrame, *steps: Callable[[np.ndarray, str], tuple[np.ndarray, str]]) -> DataFrame:
    """steps: (array, depth) to (array, depth), one after the other for each matrix, all in one pass."""
    ship(packed.sparkSession)

    def run(batches):
        def found():
            for batch in batches:
                for mat_id, a, depth in arrays(batch):
                    for step in steps:
                        a, depth = step(a, depth)
                    yield mat_id, a, depth

        return gathered(found())

    return packed.mapInArrow(run, SCHEMA)


def zip_mats(a: DataFrame, b: DataFrame, step: Callable[[np.ndarray, np.ndarray, str], tuple[np.ndarray, str]]) -> DataFrame:
    """Matrices of equal mat_id, side by side: one row each is joined, not one for each scalar."""
    ship(a.sparkSession)
    other = b.select("mat_id", *[F.col(c).alias(f"b_{c}") for c in ("rows", "cols", "channels", "depth", "data")])

    def run(batches):
        return gathered((mat_id, *step(x, y, depth)) for batch in batches for (mat_id, x, depth), (_, y, _) in zip(arrays(batch), arrays(batch, "b_"), strict=True))

    return a.join(other, "mat_id").mapInArrow(run, SCHEMA)


def pack(m: Mat) -> DataFrame:
    """One shuffle by matrix; from then on there is none."""
    ship(m.spark)
    meta = m.meta

    def run(table: pa.Table) -> pa.Table:
        y, x, c, v = (table[k].to_numpy() for k in ("y", "x", "c", "v"))
        a = np.zeros((meta.rows, meta.cols, meta.channels), dtype=NUMPY[meta.depth])
        a[y, x, c] = v
        return pa.Table.from_pylist([as_row(table["mat_id"][0].as_py(), a, meta.depth)], schema=_ARROW)

    return m.px.groupBy("mat_id").applyInArrow(run, SCHEMA)


def unpack(packed: DataFrame, meta: Meta) -> Mat:
    """meta: of every matrix in it."""
    ship(packed.sparkSession)
    kind = {"int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}[DEPTHS[meta.depth][2]]

    def run(batches):
        for batch in batches:
            for mat_id, a, depth in arrays(batch):
                y, x, c = (i.ravel().astype(np.int32) for i in np.indices(a.shape))
                v = pa.array(a.ravel().astype(np.float32) if depth == "16F" else a.ravel().astype(a.dtype.newbyteorder("="))).cast(kind)
                yield pa.RecordBatch.from_arrays([pa.array([mat_id] * a.size), pa.array(y), pa.array(x), pa.array(c), v], names=["mat_id", "y", "x", "c", "v"])

    return Mat(packed.mapInArrow(run, f"mat_id string, y int, x int, c int, v {DEPTHS[meta.depth][2]}"), meta)


def _raw(a: np.ndarray) -> np.ndarray:
    return a.view(f"u{a.dtype.itemsize}")


def bitwise(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """AND, OR or XOR of the raw bytes, floats too."""
    f = {"AND": np.bitwise_and, "OR": np.bitwise_or, "XOR": np.bitwise_xor}.get(op)
    require(f is not None, "BadArg", f"no operation {op}")
    return zip_mats(a, b, lambda x, y, depth: (f(_raw(x), _raw(y)).view(x.dtype), depth))


def bitwise_not(a: DataFrame) -> DataFrame:
    return map_mats(a, lambda x, depth: (np.invert(_raw(x)).view(x.dtype), depth))


def reinterpret(a: DataFrame, depth: str, channels: int) -> DataFrame:
    """The same bytes as elements of another type of the same size."""

    def step(x: np.ndarray, old: str):
        require(x.dtype.itemsize * x.shape[2] == np.dtype(NUMPY[depth]).itemsize * channels, "BadSize", "an element's size must stay")
        return np.ascontiguousarray(x).view(NUMPY[depth]).reshape(x.shape[0], x.shape[1], channels), depth

    return map_mats(a, step)


def convert_fp16(a: DataFrame) -> DataFrame:
    """32F to the bits of half floats, as 16S; 16S (such bits) and 16F to 32F."""

    def step(x: np.ndarray, depth: str):
        if depth == "32F":
            return x.astype(np.float16).view("<i2"), "16S"
        require(depth in ("16S", "16F"), "BadArg", "32F, 16S or 16F")
        return x.view("<f2").astype(np.float32), "32F"

    return map_mats(a, step)


def floor_half(x: np.ndarray) -> np.ndarray:
    """Through a half float whose surplus bits are cut off, not rounded."""
    bits = x.astype(np.float32).view(np.uint32)
    cut = (bits & np.uint32(0xFFFFE000)).view(np.float32)
    small = np.abs(x) < 2.0**-14
    steps = np.trunc(x.astype(np.float64) * 2.0**24) / 2.0**24
    out = np.where(small, steps, cut).astype(np.float32)
    return np.where(np.abs(x) >= 65536.0, np.copysign(np.float32(np.inf), x), out).astype(np.float32)


def align_precision(a: DataFrame, precision: str) -> DataFrame:
    """FP32: as it is, half floats widened. FP16 and INT8: 32F through a cut-off half float."""
    require(precision in ("FP32", "FP16", "INT8"), "BadArg", f"no precision {precision}")

    def step(x: np.ndarray, depth: str):
        if precision == "FP32":
            return (x.astype(np.float32), "32F") if depth == "16F" else (x, depth)
        return (floor_half(x), "32F") if depth == "32F" else (x, depth)

    return map_mats(a, step)


def parallel_for(packed: DataFrame, body: Callable[[np.ndarray, int, int], np.ndarray], stripes: int) -> DataFrame:
    """body: (rows of a matrix, first row, last row) to as many rows; matrices are cut into stripes that run as separate rows of the relation, and put together by one shuffle.
    A stripe carries its own bytes only: the cut is a slice of the binary column."""
    ship(packed.sparkSession)
    size = F.element_at(F.create_map(*[F.lit(x) for d, t in NUMPY.items() for x in (d, np.dtype(t).itemsize)]), F.col("depth"))
    n = F.least(F.lit(stripes), F.greatest("rows", F.lit(1)))
    line = F.col("cols") * F.col("channels") * size
    cut = packed.withColumn("n", n).withColumn("stripe", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("lo", F.expr("rows * stripe div n").cast("int")).withColumn("hi", F.expr("rows * (stripe + 1) div n").cast("int"))
    cut = cut.withColumn("data", F.substring(F.col("data"), F.col("lo") * line + 1, (F.col("hi") - F.col("lo")) * line)).withColumn("rows", F.col("hi") - F.col("lo")).drop("hi", "n").repartition(F.col("mat_id"), F.col("stripe"))

    def run(batches):
        def found():
            for batch in batches:
                for (mat_id, a, depth), stripe, lo in zip(arrays(batch), batch["stripe"].to_pylist(), batch["lo"].to_pylist(), strict=True):
                    yield mat_id, body(a, lo, lo + len(a)), depth, stripe

        return gathered(found(), (("stripe", pa.int32()),))

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["stripe"])
        whole = np.concatenate([as_array(r) for r in rows])
        return pa.Table.from_pylist([as_row(rows[0]["mat_id"], whole, rows[0]["depth"])], schema=_ARROW)

    return cut.mapInArrow(run, f"{SCHEMA}, stripe int").groupBy("mat_id").applyInArrow(join, SCHEMA)


def meta_as(meta: Meta, depth: str, channels: int | None = None) -> Meta:
    return replace(meta, depth=depth, channels=channels or meta.channels)
