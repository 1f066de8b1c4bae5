"""Score thresholds and review zones per language, as data."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Policy(NamedTuple):
    lang: str
    threshold: float
    low: float
    high: float


# Threshold and inclusive review zone of each scored language.
POLICIES = (
    Policy("c", 0.6, 0.52, 0.68),
    Policy("cpp", 0.1, 0.02, 0.18),
    Policy("java", 0.05, 0.011, 0.089),
)

POLICY_SCHEMA = "lang string, threshold double, low double, high double"


def policy_table(spark: SparkSession, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    return spark.createDataFrame(list(policies), POLICY_SCHEMA)
