"""Findings and verdicts: what every check returns.

A verdict's status is ``pass``, ``fail``, ``unusable`` (could not be measured) or ``conflict``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FINDING = "check string, target string, rule string, severity string, subject string, row_no bigint, message string"
SHOWN = 20


def findings(df: DataFrame, check: str, target, rule, subject, message, severity="high", row_no=None) -> DataFrame:
    """Rows of ``df`` as findings; arguments are columns, or constants."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(
        F.lit(check).alias("check"),
        as_column(target).alias("target"),
        as_column(rule).alias("rule"),
        as_column(severity).alias("severity"),
        as_column(subject).cast("string").alias("subject"),
        as_column(row_no).cast("long").alias("row_no"),
        as_column(message).alias("message"),
    )


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def verdicts(found: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target of ``targets``: its status and number of problems; collected, not first-error."""
    counted = found.groupBy("target").agg(F.count(F.lit(1)).alias("problems"), F.max(F.col("severity") == "unusable").alias("broken"))
    status = F.when(F.col("broken"), "unusable").when(F.col("problems") > 0, "fail").otherwise("pass")
    return targets.join(counted, "target", "left").select("target", F.coalesce(status, F.lit("pass")).alias("status"), F.coalesce("problems", F.lit(0)).alias("problems"))


def shown(found: DataFrame, by: list[str], order: list, limit: int = SHOWN) -> DataFrame:
    """The first ``limit`` rows of each group in order, and how many more there are."""
    window = Window.partitionBy(*by)
    return found.withColumn("place", F.row_number().over(window.orderBy(*order))).withColumn("more", F.greatest(F.lit(0), F.count(F.lit(1)).over(window) - limit)).filter(F.col("place") <= limit)
