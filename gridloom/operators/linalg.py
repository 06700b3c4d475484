"""Products of matrices as join and aggregate, and helpers of inference."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.matrix import Mat, require

#: A matrix of up to so many scalars goes to every executor; a larger one is joined by a shuffle of its inner index.
BROADCAST_SCALARS = 1_000_000


def gemm_shape(a: tuple[int, ...], b: tuple[int, ...], trans_a: bool = False, trans_b: bool = False) -> tuple[int, ...]:
    """The product's shape; leading axes are matched as in NumPy."""
    require(len(a) >= 2 and len(b) >= 2, "BadArg", "two axes at least")
    m, k = (a[-1], a[-2]) if trans_a else a[-2:]
    k2, n = (b[-1], b[-2]) if trans_b else b[-2:]
    require(k == k2, "BadArg", "inner sizes differ")
    lead = []
    longest = max(len(a), len(b)) - 2
    for x, y in zip([1] * (longest - len(a) + 2) + list(a[:-2]), [1] * (longest - len(b) + 2) + list(b[:-2]), strict=True):
        require(x == y or 1 in (x, y), "BadArg", "leading sizes differ")
        lead.append(max(x, y))
    return (*lead, m, n)


def pack_b(b: Mat, trans_b: bool = False) -> DataFrame:
    """k, j, w: the right operand, ready for joins; of a bounded size it is marked for broadcast."""
    k, j = ("x", "y") if trans_b else ("y", "x")
    out = b.px.select(F.col("mat_id").alias("b_id"), F.col(k).alias("k"), F.col(j).alias("j"), F.col("v").cast("double").alias("w"))
    return F.broadcast(out) if b.meta.total <= BROADCAST_SCALARS else out


def gemm(a: Mat, b: Mat, trans_a: bool = False, trans_b: bool = False, scales: DataFrame | None = None) -> Mat:
    """Rows of each matrix of a, by the (single) matrix b. Partial sums are combined before the shuffle. scales (j, s): for 8S weights, one factor for each output column."""
    rows, cols = gemm_shape(a.meta.shape, b.meta.shape, trans_a, trans_b)
    require(a.meta.channels == b.meta.channels == 1, "BadArg", "one channel")
    require(scales is None or trans_b, "NotImplemented", "scaled weights come transposed")
    i, k = ("x", "y") if trans_a else ("y", "x")
    left = a.px.select("mat_id", F.col(i).alias("i"), F.col(k).alias("k"), F.col("v").cast("double").alias("v"))
    out = left.join(pack_b(b, trans_b), "k").groupBy("mat_id", "i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    if scales is not None and b.meta.depth == "8S":
        out = out.join(F.broadcast(scales), "j").withColumn("v", F.col("v") * F.col("s"))
    return Mat(out.select("mat_id", F.col("i").alias("y"), F.col("j").alias("x"), F.lit(0).alias("c"), F.col("v").cast("float").alias("v")), replace(a.meta, rows=rows, cols=cols, depth="32F"))


def gemm_batched(a: DataFrame, b: DataFrame, a_lead: tuple[int, ...], b_lead: tuple[int, ...]) -> DataFrame:
    """idx array<int>, v on both sides; leading axes of extent 1 match any. Returns idx, v."""
    n = max(len(a_lead), len(b_lead))
    pa, pb = [1] * (n - len(a_lead)) + list(a_lead), [1] * (n - len(b_lead)) + list(b_lead)

    def side(df, own, lead, own_len, row, col):
        at = [F.col("idx")[i - (n - own_len)] if i >= n - own_len else F.lit(0) for i in range(n)]
        return df.select(*[at[i].alias(f"{own}{i}") for i in range(n)], F.col("idx")[own_len].alias(row), F.col("idx")[own_len + 1].alias(col), F.col("v").cast("double").alias(f"v{own}"))

    left, right = side(a, "a", pa, len(a_lead), "i", "k"), side(b, "b", pb, len(b_lead), "k", "j")
    joined = left.join(right, [left["k"] == right["k"], *[left[f"a{i}"] == right[f"b{i}"] for i in range(n) if pa[i] == pb[i]]])
    lead = [F.col(f"a{i}") if pa[i] >= pb[i] else F.col(f"b{i}") for i in range(n)]
    return joined.groupBy(F.array(*lead, F.col("i"), F.col("j")).alias("idx")).agg(F.sum(F.col("va") * F.col("vb")).alias("v"))


def argmax_tokens(logits: Mat) -> DataFrame:
    """mat_id, y, token: of each row the first largest column."""
    return logits.px.groupBy("mat_id", "y").agg(F.max_by("x", F.struct("v", -F.col("x"))).alias("token"))


def softmax(m: Mat) -> Mat:
    """Of each row."""
    w = Window.partitionBy("mat_id", "y", "c")
    e = m.px.withColumn("e", F.exp(F.col("v").cast("double") - F.max(F.col("v").cast("double")).over(w)))
    return Mat(e.select("mat_id", "y", "x", "c", (F.col("e") / F.sum("e").over(w)).cast("float").alias("v")), replace(m.meta, depth="32F"))


def silu(m: Mat) -> Mat:
    v = F.col("v").cast("double")
    return m.with_v(v / (1 + F.exp(-v)), "32F", sat=False)


def rmsnorm(m: Mat, eps: float = 1e-6) -> Mat:
    w = Window.partitionBy("mat_id", "y", "c")
    v = F.col("v").cast("double")
    return Mat(m.px.select("mat_id", "y", "x", "c", (v / F.sqrt(F.avg(v * v).over(w) + eps)).cast("float").alias("v")), replace(m.meta, depth="32F"))
