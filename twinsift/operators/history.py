"""Report history as frames: (id, baseline, candidate, verdict, finished_at, labels, similarity, unchanged, path_rate)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest(reports: DataFrame, n: int) -> DataFrame:
    return reports.orderBy(F.desc("finished_at"), F.desc("id")).limit(n)


def of_pair(reports: DataFrame, baseline: str, candidate: str, include_red: bool, n: int) -> DataFrame:
    """The newest reports of a pair; RED ones only if asked for."""
    rows = reports.filter((F.col("baseline") == baseline) & (F.col("candidate") == candidate))
    return newest(rows if include_red else rows.filter("verdict <> 'RED'"), n)


def of_labels(reports: DataFrame, labels: dict[str, str], n: int) -> DataFrame:
    for k, v in labels.items():
        reports = reports.filter(F.col("labels")[k] == v)
    return newest(reports, n)


def learned_bands(history: DataFrame, metrics: dict[str, bool], least: int = 5, green: float = 2.0, yellow: float = 3.0, spread: float = 0.005) -> DataFrame:
    """(metric, n, green, yellow) of metrics (name -> higher is better) with at least `least` values: mean -+ sigmas of at least `spread`."""
    rows = history.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(up).alias("up"), F.col(m).alias("x")) for m, up in metrics.items()])).alias("r")).select("r.*").filter("x IS NOT NULL")
    s = rows.groupBy("metric", "up").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.greatest(F.coalesce(F.stddev_samp("x"), F.lit(0.0)), F.lit(spread)).alias("s")).filter(F.col("n") >= least)
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    at = lambda k: clamp(F.when(F.col("up"), F.col("m") - k * F.col("s")).otherwise(F.col("m") + k * F.col("s")))
    bound: Column = F.when(F.col("up"), F.least(at(green), at(yellow))).otherwise(F.greatest(at(green), at(yellow)))
    return s.select("metric", "n", at(green).alias("green"), bound.alias("yellow"))
