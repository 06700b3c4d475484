"""Queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.matrix import Mat
from gridloom.plans import fixtures

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, run: Callable, sql: str | None = None, *more: str) -> None:
    """run: (spark, sf_dir) to a DataFrame, or to a Mat, whose y, x, c, v are taken (floats rounded to 4 places). sql may name the fixtures as tables, and `more`: tables as `name as (...)`."""

    def done(spark, sf_dir) -> DataFrame:
        out = run(spark, sf_dir)
        return px(out) if isinstance(out, Mat) else out

    QUERIES[name] = done
    if sql is not None:
        used = [f for f in fixtures.SQL if any(re.search(rf"\b{f}\b", s) for s in (sql, *more))]
        tables = [*(f"{f} as ({fixtures.SQL[f]})" for f in used), *more]
        SQL[name] = (f"with recursive {', '.join(tables)} " if tables else "") + sql


def px(m: Mat) -> DataFrame:
    v = F.round(F.col("v").cast("double"), 4) + 0.0 if m.meta.is_float else F.col("v").cast("int" if m.meta.depth != "32U" else "bigint")
    return m.px.select("y", "x", "c", v.alias("v"))


def flagship(spark, sf_dir: str) -> DataFrame:
    """Smooth the heat map, take what is above 8, and list the places."""
    from gridloom.operators import filters, intensity, reductions

    m = filters.box_filter(fixtures.heat(spark, sf_dir), 3, 3, border="REPLICATE")
    return reductions.find_non_zero(intensity.threshold(m, 8, 255)).select("i", "x", "y")


def load() -> None:
    from gridloom.plans import queries_core, queries_images, queries_packed  # noqa: F401


load()
