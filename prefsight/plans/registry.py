"""Registry of named queries: a Spark builder plus (optionally) DuckDB oracle SQL.

Every registered query reads the mounted tables of one scale factor (or views
Spark derives from them) and returns a DataFrame; doubles are rounded to 6
decimals on both sides because float sums depend on partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from prefsight.plans.sql_views import with_views
from prefsight.sources.tables import Tables


@dataclass
class QuerySpec:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None
    doc: str = ""
    tags: tuple = field(default_factory=tuple)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_doubles(self.build(Tables(spark, sf_dir)))


REGISTRY: dict[str, QuerySpec] = {}


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def oracle(body: str, rnd=(), extra_ctes=None) -> str:
    """Wrap an oracle body: prefix view CTEs and round the listed double columns."""
    if rnd:
        repl = ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in rnd)
        sql = f"SELECT * REPLACE ({repl}) FROM (\n{body.strip()}\n) AS q"
    elif body.strip().upper().startswith("WITH"):
        sql = f"SELECT * FROM (\n{body.strip()}\n) AS q"
    else:
        sql = body
    return with_views(sql, extra_ctes)


def query(name: str, sql: str | None = None, rnd=(), doc: str = "", tags=(), extra_ctes=None):
    """Decorator registering ``fn(tables) -> DataFrame`` under ``name``."""
    def deco(fn):
        REGISTRY[name] = QuerySpec(name, fn, None if sql is None else oracle(sql, rnd, extra_ctes),
                                   doc or (fn.__doc__ or "").strip(), tuple(tags))
        return fn
    return deco


def load_all() -> dict[str, QuerySpec]:
    """Import every query module (registration happens at import)."""
    from prefsight.plans import (  # noqa: F401
        q_active,
        q_compare,
        q_convert,
        q_ensemble,
        q_evaluate,
        q_landscape,
        q_margins,
        q_policy,
        q_readiness,
        q_scoring,
        q_sources,
        q_streaming,
        q_text,
        q_train,
    )
    return REGISTRY
