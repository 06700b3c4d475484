"""Matrices as DataFrames: one row for each scalar, with driver-side facts about shape and depth.

px: mat_id string, y int, x int, c int, v. A px relation may hold any number of matrices of one shape and depth; mat_id tells them apart. Every coordinate is present exactly once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: For each depth the least and largest integer, and the Spark type that holds it. Spark has no unsigned types: the next larger one does.
DEPTHS: dict[str, tuple[int | None, int | None, str]] = {
    "8U": (0, 255, "int"),
    "8S": (-128, 127, "int"),
    "16U": (0, 65535, "int"),
    "16S": (-32768, 32767, "int"),
    "32S": (-(2**31), 2**31 - 1, "int"),
    "32U": (0, 2**32 - 1, "bigint"),
    "16F": (None, None, "float"),
    "32F": (None, None, "float"),
    "64F": (None, None, "double"),
}
NUMPY = {"8U": "u1", "8S": "i1", "16U": "<u2", "16S": "<i2", "32S": "<i4", "32U": "<u4", "16F": "<f2", "32F": "<f4", "64F": "<f8"}
KEY = ["mat_id", "y", "x", "c"]
MAX_CHANNELS = 128


class MatError(ValueError):
    """A call that the arguments' shape or type doesn't allow; raised when the plan is made."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def require(ok: bool, code: str, message: str) -> None:
    if not ok:
        raise MatError(code, message)


@dataclass(frozen=True)
class Meta:
    rows: int
    cols: int
    channels: int = 1
    depth: str = "8U"

    def __post_init__(self):
        require(self.depth in DEPTHS, "NotImplemented", f"no matrix has depth {self.depth}")
        require(1 <= self.channels <= MAX_CHANNELS, "BadArg", f"1 to {MAX_CHANNELS} channels")
        require(self.rows >= 0 and self.cols >= 0, "BadSize", "sizes can't be negative")

    @property
    def total(self) -> int:
        return self.rows * self.cols

    @property
    def elem_size1(self) -> int:
        return np.dtype(NUMPY[self.depth]).itemsize

    @property
    def elem_size(self) -> int:
        return self.elem_size1 * self.channels

    @property
    def shape(self) -> tuple[int, int]:
        return self.rows, self.cols

    @property
    def is_float(self) -> bool:
        return self.depth.endswith("F")


class Mat:
    """A px relation and its facts. Immutable: each operator gives a new one."""

    def __init__(self, px: DataFrame, meta: Meta, parent: tuple[Mat, int, int] | None = None):
        self.px, self.meta, self.parent = px, meta, parent

    @property
    def spark(self) -> SparkSession:
        return self.px.sparkSession

    # construction

    @staticmethod
    def full(spark: SparkSession, meta: Meta, value=0, mat_id: str = "m") -> Mat:
        """Every scalar the same value, or one value for each channel; saturated to the depth."""
        values = list(value) if isinstance(value, (list, tuple)) else [value] * meta.channels
        require(len(values) >= meta.channels, "BadArg", "a value for each channel")
        lanes = F.array(*[saturate(F.lit(float(v)), meta.depth) for v in values[: meta.channels]])
        n = meta.total * meta.channels
        i = F.col("id")
        px = spark.range(n).select(
            F.lit(mat_id).alias("mat_id"), F.floor(i / (meta.cols * meta.channels or 1)).cast("int").alias("y"), (F.floor(i / meta.channels) % (meta.cols or 1)).cast("int").alias("x"),
            (i % meta.channels).cast("int").alias("c"),
        ).withColumn("v", F.element_at(lanes, F.col("c") + 1))
        return Mat(px, meta)

    @staticmethod
    def zeros(spark: SparkSession, meta: Meta, mat_id: str = "m") -> Mat:
        return Mat.full(spark, meta, 0, mat_id)

    @staticmethod
    def from_numpy(spark: SparkSession, array: np.ndarray, depth: str | None = None, mat_id: str = "m") -> Mat:
        """From an array (rows, cols[, channels]) of the driver."""
        a = np.atleast_3d(array)
        depth = depth or next(d for d, t in NUMPY.items() if np.dtype(t) == a.dtype.newbyteorder("<") or np.dtype(t) == a.dtype)
        y, x, c = np.indices(a.shape)
        import pandas as pd

        pdf = pd.DataFrame({"mat_id": mat_id, "y": y.ravel(), "x": x.ravel(), "c": c.ravel(), "v": a.ravel().astype("f8" if depth.endswith("F") else "i8")})
        kinds = f"mat_id string, y int, x int, c int, v {DEPTHS[depth][2]}"
        return Mat(spark.createDataFrame(pdf, "mat_id string, y long, x long, c long, v " + ("double" if depth.endswith("F") else "long")).select(*[F.col(k.split()[0]).cast(k.split()[1]) for k in kinds.split(", ")]), Meta(a.shape[0], a.shape[1], a.shape[2], depth))

    @staticmethod
    def from_rows(rows: DataFrame, meta: Meta, y="y", x="x", c=None, v="v", mat_id=None) -> Mat:
        """From a relation of coordinates and values, for example a Parquet table; coordinates that are missing become 0."""
        one = rows.select(
            (F.col(mat_id).cast("string") if mat_id else F.lit("m")).alias("mat_id"), F.col(y).cast("int").alias("y"), F.col(x).cast("int").alias("x"),
            (F.col(c).cast("int") if c else F.lit(0)).alias("c"), saturate(F.col(v), meta.depth).alias("v"),
        )
        grid = one.select("mat_id").distinct()
        for name, n in (("y", meta.rows), ("x", meta.cols), ("c", meta.channels)):
            grid = grid.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        return Mat(grid.join(one, KEY, "left").select(*KEY, F.coalesce("v", saturate(F.lit(0.0), meta.depth)).alias("v")), meta)

    # values

    def with_v(self, v: Column, depth: str | None = None, sat: bool = True) -> Mat:
        """A projection: v saturated to the depth (or cast, if it is known to fit)."""
        depth = depth or self.meta.depth
        return Mat(self.px.select(*KEY, (saturate(v, depth) if sat else v.cast(DEPTHS[depth][2])).alias("v")), replace(self.meta, depth=depth))

    def moved(self, meta: Meta | None = None, parent=None, **coordinates: Column) -> Mat:
        """A projection of coordinates; none of the values change."""
        px = self.px.select(*[coordinates[k].cast("int").alias(k) if k in coordinates else F.col(k) for k in KEY], "v")
        return Mat(px, meta or self.meta, parent)

    def clone(self) -> Mat:
        return Mat(self.px, self.meta)

    def copy_to(self, other: Mat | None = None) -> Mat:
        """A copy; a non-empty target must have the same depth and channels."""
        if other is not None and other.meta.total:
            require((other.meta.depth, other.meta.channels) == (self.meta.depth, self.meta.channels), "BadType", "the target is of another type")
        return self.clone()

    def convert_to(self, depth: str, channels: int | None = None) -> Mat:
        require(channels in (None, self.meta.channels), "BadArg", "the number of channels can't change")
        return self.with_v(F.col("v"), depth)

    def set_to(self, value) -> Mat:
        values = list(value) if isinstance(value, (list, tuple)) else None
        require(values is None or self.meta.channels <= 4, "BadArg", "a scalar has 4 lanes")
        return self.with_v(lane(values, self.meta.channels) if values else F.lit(float(value)))

    def reshape(self, rows: int, cols: int, channels: int | None = None) -> Mat:
        """Row-major reinterpretation."""
        m, cn = self.meta, channels or self.meta.channels
        require(rows * cols * cn == m.total * m.channels, "BadSize", "the total must stay")
        require(self.parent is None, "NotImplemented", "a region of interest is not continuous")
        i = (F.col("y").cast("long") * m.cols + F.col("x")) * m.channels + F.col("c")
        return self.moved(replace(m, rows=rows, cols=cols, channels=cn), y=F.floor(i / (cols * cn)), x=F.floor(i / cn) % cols, c=i % cn)

    def reinterpret_sign(self) -> Mat:
        """8U as 8S or the other way: the same bits."""
        to = {"8U": "8S", "8S": "8U", "16U": "16S", "16S": "16U"}.get(self.meta.depth)
        require(to is not None, "BadArg", "only 8 and 16 bit integers")
        lo, hi, _ = DEPTHS[to]
        return self.with_v(F.pmod(F.col("v") - lo, F.lit(hi - lo + 1)) + lo, to, sat=False)

    def roi(self, y0: int, y1: int, x0: int, x1: int) -> Mat:
        """Rows y0 to y1, columns x0 to x1, ends exclusive; it remembers what it was cut from."""
        m = self.meta
        require(0 <= y0 <= y1 <= m.rows and 0 <= x0 <= x1 <= m.cols, "OutOfRange", "the region lies outside")
        px = self.px.where(F.col("y").between(y0, y1 - 1) & F.col("x").between(x0, x1 - 1)).select("mat_id", (F.col("y") - y0).alias("y"), (F.col("x") - x0).alias("x"), "c", "v")
        return Mat(px, replace(m, rows=y1 - y0, cols=x1 - x0), (self, y0, x0))

    def row_range(self, a: int, b: int) -> Mat:
        return self.roi(a, b, 0, self.meta.cols)

    def col_range(self, a: int, b: int) -> Mat:
        return self.roi(0, self.meta.rows, a, b)

    def at(self, y: int, x: int, c: int = 0) -> DataFrame:
        m = self.meta
        require(0 <= y < m.rows and 0 <= x < m.cols and 0 <= c < m.channels, "OutOfRange", "no such place")
        return self.px.where((F.col("y") == y) & (F.col("x") == x) & (F.col("c") == c)).select("mat_id", "v")

    def facts(self) -> DataFrame:
        """rows, cols, channels, depth, element sizes, total and step."""
        m = self.meta
        return self.spark.range(1).select(
            F.lit(m.rows).alias("rows"), F.lit(m.cols).alias("cols"), F.lit(m.channels).alias("channels"), F.lit(m.depth).alias("depth"), F.lit(m.elem_size).alias("elem_size"),
            F.lit(m.elem_size1).alias("elem_size1"), F.lit(m.total).alias("total"), F.lit(m.elem_size * m.cols).alias("step"), F.lit(m.total == 0).alias("empty"),
        )

    def shape_string(self) -> str:
        m = self.meta
        return f"[{m.channels},{m.rows},{m.cols}]" if m.channels > 1 else f"[{m.rows},{m.cols}]"

    def is_complete(self) -> bool:
        """Whether each matrix has every coordinate once."""
        n = self.px.groupBy("mat_id").agg(F.count("*").alias("n"), F.count_distinct("y", "x", "c").alias("d"))
        want = self.meta.total * self.meta.channels
        return not n.where((F.col("n") != want) | (F.col("d") != want)).limit(1).count()

    def to_numpy(self, mat_id: str | None = None) -> np.ndarray:
        """One matrix on the driver; for tests and small results."""
        px = self.px.where(F.col("mat_id") == mat_id) if mat_id else self.px
        out = np.zeros((self.meta.rows, self.meta.cols, self.meta.channels), dtype=NUMPY[self.meta.depth])
        p = px.select("y", "x", "c", "v").toPandas()
        out[p.y, p.x, p.c] = p.v
        return out

    def map_pixels(self, f, depth: str | None = None) -> Mat:
        """f: Column of a value to Column; saturated to the depth."""
        return self.with_v(f(F.col("v")), depth)

    # expressions

    def _binary(self, name: str, other, swap: bool = False) -> Mat:
        from gridloom.operators import arithmetic

        return getattr(arithmetic, name)(other, self) if swap else getattr(arithmetic, name)(self, other)

    def __add__(self, other):
        return self._binary("add", other)

    def __radd__(self, other):
        return self._binary("add", other)

    def __sub__(self, other):
        return self._binary("subtract", other)

    def __rsub__(self, other):
        return self._binary("subtract", other, swap=True)

    def __mul__(self, other):
        return self._binary("multiply", other)

    def __rmul__(self, other):
        return self._binary("multiply", other)

    def __truediv__(self, other):
        return self._binary("divide", other)

    def __rtruediv__(self, other):
        return self._binary("divide", other, swap=True)

    def __neg__(self):
        return self._binary("subtract", [0.0] * max(4, self.meta.channels), swap=True) if self.meta.channels <= 4 else self.with_v(-F.col("v"))

    def _compare(self, op: str, other):
        from gridloom.operators import arithmetic

        return arithmetic.compare(self, other, op)

    def __gt__(self, other):
        return self._compare("GT", other)

    def __ge__(self, other):
        return self._compare("GE", other)

    def __lt__(self, other):
        return self._compare("LT", other)

    def __le__(self, other):
        return self._compare("LE", other)

    def eq(self, other):
        return self._compare("EQ", other)

    def ne(self, other):
        return self._compare("NE", other)


def total(shape: tuple[int, ...], start: int = 0, end: int | None = None) -> int:
    """The product of a slice of extents."""
    return math.prod(shape[start:end])


def lane(values: list, channels: int) -> Column:
    """The value for each row's channel."""
    return F.element_at(F.array(*[F.lit(float(v)) for v in list(values)[:channels]]), F.col("c") + 1)


def away(v: Column) -> Column:
    """Rounded, halves away from zero."""
    return F.round(v.cast("double"), 0)


def saturate(v: Column, depth: str, even: bool = False) -> Column:
    """A value as the depth holds it: rounded half away from zero (or half to even), then clipped. NaN becomes 0. Not for 32 bit overflow, see wrapped()."""
    lo, hi, kind = DEPTHS[depth]
    if lo is None:
        return v.cast(kind)
    d = v.cast("double")
    r = F.rint(d) if even else F.round(d, 0)
    return F.when(F.isnan(d), F.lit(0)).otherwise(F.least(F.greatest(r, F.lit(float(lo))), F.lit(float(hi))).cast("bigint")).cast(kind)


def wrapped(v: Column, depth: str) -> Column:
    """An exact integer as 32 bits hold it, wrapping around."""
    lo, hi, kind = DEPTHS[depth]
    span = hi - lo + 1
    return (F.pmod(v.cast("decimal(38,0)") - F.lit(lo).cast("decimal(38,0)"), F.lit(span).cast("decimal(38,0)")) + F.lit(lo).cast("decimal(38,0)")).cast(kind)


def same_kind(a: Mat, b: Mat) -> None:
    require(a.meta.shape == b.meta.shape, "UnmatchedSizes", f"{a.meta.shape} and {b.meta.shape}")
    require((a.meta.depth, a.meta.channels) == (b.meta.depth, b.meta.channels), "UnmatchedFormats", f"{a.meta} and {b.meta}")


def aligned(a: Mat, b: Mat, *more: Mat) -> DataFrame:
    """Rows of equal place: KEY, v, w (and w2, ...). Matrices are matched by mat_id, unless one side has a single matrix of its own name (see named())."""
    out = a.px.join(b.px.withColumnRenamed("v", "w"), KEY)
    for i, m in enumerate(more, 2):
        out = out.join(m.px.withColumnRenamed("v", f"w{i}"), KEY)
    return out


def named(m: Mat, mat_id: str) -> Mat:
    return Mat(m.px.withColumn("mat_id", F.lit(mat_id)), m.meta, m.parent)
