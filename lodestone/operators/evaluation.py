"""Retrieval evaluation: recall, reciprocal rank, summaries, regressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def case_metrics(gold: DataFrame, cited: DataFrame) -> DataFrame:
    """gold(case_id, id) x cited(case_id, id, rank0) -> recall, rr (0 if nothing was found) and passed per case."""
    j = gold.select("case_id", "id").distinct().join(cited.select("case_id", "id", "rank0"), ["case_id", "id"], "left").groupBy("case_id").agg(F.count("*").alias("wanted"), F.count("rank0").alias("found"), F.min("rank0").alias("first"))
    return j.select("case_id", (F.col("found") / F.col("wanted")).alias("recall"), F.coalesce(1 / (F.col("first") + 1), F.lit(0.0)).alias("rr"), (F.col("found") > 0).alias("passed"))


def summary(cases: DataFrame) -> DataFrame:
    """One row; percentiles interpolate."""
    return cases.agg(
        F.count("*").alias("n"), F.count_if("passed").alias("passed"), F.round(F.avg("recall"), 3).alias("recall"), F.round(F.avg("rr"), 3).alias("mrr"),
        F.round(F.percentile("latency", F.lit(0.5)), 3).alias("p50"), F.round(F.percentile("latency", F.lit(0.95)), 3).alias("p95"),
    )


def regressions(before: DataFrame, now: DataFrame) -> DataFrame:
    """Cases that passed before and fail now, with the change of their recall."""
    b = before.select("case_id", F.col("passed").alias("was"), F.col("recall").alias("r0"))
    return b.join(now, "case_id").where("was and not passed").select("case_id", (F.col("recall") - F.col("r0")).alias("recall_change"))
