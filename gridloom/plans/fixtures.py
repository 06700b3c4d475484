"""Deterministic matrices made from the tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.matrix import Mat, Meta


def _px(df: DataFrame) -> DataFrame:
    return df.selectExpr("'m' as mat_id", "cast(y as int) y", "cast(x as int) x", "cast(ch as int) c", "v")


def pattern(spark: SparkSession, rows: int = 32, cols: int = 48, channels: int = 3) -> Mat:
    """A closed-form byte pattern."""
    df = spark.range(rows * cols * channels).selectExpr(f"id div {cols * channels} y", f"(id div {channels}) % {cols} x", f"id % {channels} ch")
    return Mat(_px(df.selectExpr("y", "x", "ch", "cast((37 * y + 19 * x + 53 * ch) % 256 as int) v")), Meta(rows, cols, channels))


def heat(spark: SparkSession, sf_dir: str, rows: int = 64) -> Mat:
    """Events by user and half-hour of the day, 64 x 48, 8U."""
    n = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(f"cast(user_id % {rows} as int) y", "cast(hour(ts) * 2 + minute(ts) div 30 as int) x").groupBy("y", "x").count()
    grid = spark.range(rows * 48).selectExpr("cast(id div 48 as int) y", "cast(id % 48 as int) x")
    return Mat(_px(grid.join(n, ["y", "x"], "left").selectExpr("y", "x", "0 ch", "cast(least(coalesce(count, 0) * 16, 255) as int) v")), Meta(rows, 48))


def ship(spark: SparkSession, sf_dir: str) -> Mat:
    """Quantity by supplier and part, the return flags A, N and R as channels, 64 x 64, 8U."""
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "cast(l_suppkey % 64 as int) y", "cast(l_partkey % 64 as int) x", "case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end ch", "cast(l_quantity as bigint) q"
    ).groupBy("y", "x", "ch").sum("q")
    grid = spark.range(64 * 64 * 3).selectExpr("cast(id div 192 as int) y", "cast(id div 3 % 64 as int) x", "cast(id % 3 as int) ch")
    return Mat(_px(grid.join(n, ["y", "x", "ch"], "left").selectExpr("y", "x", "ch", "cast(least(coalesce(`sum(q)`, 0), 255) as int) v")), Meta(64, 64, 3))


def emb(spark: SparkSession, sf_dir: str) -> Mat:
    """Embeddings as a matrix of 32F, one row each."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return Mat(_px(t.selectExpr("cast(vec_id as int) y", "posexplode(embedding) as (x, v)").selectExpr("y", "x", "0 ch", "v")), Meta(t.count(), 64, 1, "32F"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames: events of each day of the week by user and hour, 16 x 24: frame_id, y, x, c, v."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("dayofweek(ts) frame_id", "cast(user_id % 16 as int) y", "hour(ts) x").groupBy("frame_id", "y", "x").count()
    grid = spark.range(7 * 16 * 24).selectExpr("cast(id div 384 + 1 as int) frame_id", "cast(id div 24 % 16 as int) y", "cast(id % 24 as int) x")
    return grid.join(t, ["frame_id", "y", "x"], "left").selectExpr("frame_id", "y", "x", "0 c", "cast(coalesce(count, 0) as int) v")


#: The same relations for the SQL side: y, x, c, v.
SQL = {
    "pattern": "select y::int y, x::int x, c::int c, ((37 * y + 19 * x + 53 * c) % 256)::int v from range(0, 32) a(y), range(0, 48) b(x), range(0, 3) d(c)",
    "heat": """select g.y, g.x, 0 c, least(coalesce(n.n, 0) * 16, 255)::int v from (select y::int y, x::int x from range(0, 64) a(y), range(0, 48) b(x)) g
        left join (select (user_id % 64)::int y, (hour(ts) * 2 + minute(ts) // 30)::int x, count(*) n from events group by 1, 2) n on g.y = n.y and g.x = n.x""",
    "ship": """select g.y, g.x, g.c, least(coalesce(q, 0), 255)::int v from (select y::int y, x::int x, c::int c from range(0, 64) a(y), range(0, 64) b(x), range(0, 3) d(c)) g
        left join (select (l_suppkey % 64)::int y, (l_partkey % 64)::int x, case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end c, sum(l_quantity::bigint) q from lineitem group by 1, 2, 3) n
        on g.y = n.y and g.x = n.x and g.c = n.c""",
    "emb": "select vec_id::int y, (i - 1)::int x, 0 c, embedding[i] v from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) i from embeddings)",
    "daily": """select g.f, g.y, g.x, 0 c, coalesce(n.n, 0)::int v from (select f::int f, y::int y, x::int x from range(1, 8) e(f), range(0, 16) a(y), range(0, 24) b(x)) g
        left join (select (dayofweek(ts) + 1)::int f, (user_id % 16)::int y, hour(ts)::int x, count(*) n from events group by 1, 2, 3) n on g.f = n.f and g.y = n.y and g.x = n.x""",
}
SQL["gray"] = SQL["heat"].replace("range(0, 64) a", "range(0, 32) a").replace("user_id % 64", "user_id % 32")
SQL["p1"] = f"select y, x, c, v from ({SQL['pattern']}) where c = 0"


def gray(spark: SparkSession, sf_dir: str) -> Mat:
    """A heat map of all events that is as large as the pattern."""
    return heat(spark, sf_dir, 32)


def p1(spark: SparkSession, sf_dir: str) -> Mat:
    """The pattern's first channel."""
    from gridloom.operators.layout import extract_channel

    return extract_channel(pattern(spark), 0)
