"""Collects the registered queries of all operator modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft import registry
from weft.operators import aggregations, joins, metrics, projections, sampling, scalars, text, windows  # noqa: F401  importing a module registers its queries
from weft.plans import flagship as _flagship
from weft.sources import readers, sinks  # noqa: F401
from weft.streaming import operators as _streaming  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagship.user_sequence_build(spark, sf_dir)


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracles() -> dict[str, str]:
    return dict(registry.ORACLES)
