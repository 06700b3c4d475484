"""What the operators share: column selection, tables in the shared folder, connected components."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.shipping import ship

#: Rows of a file, where few are known to come.
ROWS_A_FILE = 100_000
#: Bytes of one Arrow batch of whole rows, beyond its first row: what a Python worker holds at once.
BATCH_BYTES = 4 << 20

_mine: dict[str, SparkSession] = {}
_kept: dict = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a new one if driver and executors are one process (tests); on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


@atexit.register
def _clear() -> None:
    for path, spark in _mine.items():
        with contextlib.suppress(Exception):
            drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts lineage, survives lost executors and goes when the session ends. most: a bound of its narrow rows, where it is known; a
    file then holds ROWS_A_FILE of them, rather than each of many tasks writing one of a few rows."""
    spark = df.sparkSession
    if most is not None:
        df = df.coalesce(1 + most // ROWS_A_FILE)
    path = f"{shared_dir(spark)}/gridloom-{uuid.uuid4().hex}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    _mine[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that stored() has made, and that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_table", None):
            drop(t.sparkSession, path)
            _mine.pop(path, None)


@contextlib.contextmanager
def scratch(*kept: DataFrame):
    """Deletes, at its end, the tables that stored() has made inside, but for those appended to the list it gives: nothing made inside may be read later."""
    before, spared = set(_mine), list(kept)
    try:
        yield spared
    finally:
        keep = before | {getattr(t, "_table", None) for t in spared}
        for path in [p for p in _mine if p not in keep]:
            with contextlib.suppress(Exception):
                drop(_mine.pop(path), path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have (names differ by case in no column of Spark's)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches end by bytes, not by 10,000 rows of any length, unless the session has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, str(BATCH_BYTES))


def rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: str | Column) -> DataFrame:
    """doc_id, text and what is named in more; all other columns are dropped, so their names can't clash. Null text: empty. Ids are integers: the id is cast to long."""
    ship(df.sparkSession)
    bound_batches(df.sparkSession)
    extra = [(F.col(f"`{c}`") if isinstance(c, str) else c).alias(name) for name, c in more.items()]
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), *extra)


def once(kind, shared):
    """In a worker: what kind makes of a broadcast's value, kept over tasks. One thing at a time, so that workers that Spark uses again don't pile up tables."""
    key = (kind, shared.id if hasattr(shared, "id") else id(shared))
    if key not in _kept:
        _kept.clear()
        _kept[key] = kind(shared.value)
    return _kept[key]


def forget() -> None:
    """In a worker: frees what another operator keeps there. Called where a stage begins that keeps nothing."""
    _kept.clear()


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """The rows that no model may learn from: crc32 of the id as text, modulo 4, is 2. A null id is held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Least label of each connected component.

    nodes: v, label (struct of id and v), unique in v: of each node by itself, or as an earlier call gave them for other links. links: a, b, of v's type. Returns v, label.
    Each round every label that still has a link points to its least neighbour. Of a tree of such pointers only the two labels at its top choose each other, and the lesser of
    them is the least of the tree, so it becomes the root; pointers are doubled until all lead to roots, and links are rewritten between roots. Each tree holds two labels or more,
    so the open labels at least halve: log2(n) rounds of log2(depth) doublings whatever the order of labels, each a smaller table in the shared folder.
    """
    end = lambda v, x: nodes.select(F.col("v").alias(v), F.col("label").alias(x))
    pairs = links.join(end("a", "x"), "a").join(end("b", "y"), "b").select("x", "y").where("x <> y").distinct()
    open_ = stored(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))), "links", 2 * links.count())
    hops = []
    while n := open_.count():
        now = stored(open_.groupBy("x").agg(F.min("y").alias("up")), "hooks", n)
        first = moved = True
        while moved:
            above = now.select(F.col("x").alias("up"), F.col("up").alias("top"))
            # a label's second ancestor is never greater than itself, so after the first step all but roots point to a lesser label
            new = stored(now.join(above, "up").select("x", F.col("up").alias("was"), (F.least("up", "top") if first else F.col("top")).alias("up")), "hooks", n)
            moved = first or new.where(F.col("was") != F.col("up")).limit(1).count()
            release(now)
            now, first = new, False
        hops.append(now.select("x", "up"))
        root = lambda c, r, now=now: now.select(F.col("x").alias(c), F.col("up").alias(r))
        new = stored(open_.join(root("x", "rx"), "x").join(root("y", "ry"), "y").where("rx <> ry").select(F.col("rx").alias("x"), F.col("ry").alias("y")).distinct(), "links", n)
        release(open_)
        open_ = new
    least = None
    for hop in reversed(hops):
        least = hop if least is None else hop.join(least.select(F.col("x").alias("up"), F.col("up").alias("top")), "up", "left").select("x", F.coalesce("top", "up").alias("up"))
    release(open_)
    if least is None:
        return nodes.select("v", "label")
    return nodes.select("v", "label").join(least.select(F.col("x").alias("label"), "up"), "label", "left").select("v", F.coalesce("up", "label").alias("label"))
