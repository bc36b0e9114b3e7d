"""The registered queries of the library and, for each, the SQL that it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import contracts, graphs, labels, logs, more, quotas, records, routes, runs, schedule, scores, traces, tracks


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return scores.QUERIES | logs.QUERIES | labels.QUERIES | records.QUERIES | more.QUERIES | traces.QUERIES | runs.QUERIES | graphs.QUERIES | routes.QUERIES | tracks.QUERIES | quotas.QUERIES | contracts.QUERIES | schedule.QUERIES


def oracle_sql() -> dict[str, str]:
    return scores.ORACLES | logs.ORACLES | labels.ORACLES | records.ORACLES | more.ORACLES | traces.ORACLES | runs.ORACLES | graphs.ORACLES | routes.ORACLES | tracks.ORACLES | quotas.ORACLES | contracts.ORACLES | schedule.ORACLES
