"""Registry of runnable audit jobs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Job:
    name: str
    covers: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Job] = {}


def job(name: str, covers: str, sql: str | None = None):
    """Register ``(spark, folder) -> DataFrame`` under a name, with its SQL equivalent."""

    def add(run):
        if name in REGISTRY:
            raise ValueError(f"job {name} is registered twice")
        REGISTRY[name] = Job(name, covers, run, sql)
        return run

    return add


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round every double column, so that results do not depend on summation order."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(F.col(c), digits) for c in doubles})
