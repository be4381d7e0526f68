"""Fixes (type, file, confidence): their order and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Confidences, highest first.
CONFIDENCES = ("exact", "high", "medium", "low")


def confidence_rank(confidence: Column) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in CONFIDENCES]), confidence)


def in_order(fixes: DataFrame) -> DataFrame:
    """Fixes of the highest confidence first, then by file as people sort names; equal ones in input order (seq)."""
    return fixes.orderBy(confidence_rank(F.col("confidence")), F.collate("file", "UNICODE"), "seq")


def summary(fixes: DataFrame) -> DataFrame:
    """(kind, key, n): the total, counts by confidence (0 as well) and type, and how many are exact or high."""
    by = fixes.groupBy("confidence", "type").agg(F.count(F.lit(1)).alias("n"))
    one = by.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        *[F.coalesce(F.sum(F.when(F.col("confidence") == c, F.col("n"))), F.lit(0)).alias(c) for c in CONFIDENCES],
    )
    rows = [F.struct(F.lit("total").alias("kind"), F.lit("all").alias("key"), F.col("total").alias("n"))]
    rows += [F.struct(F.lit("confidence").alias("kind"), F.lit(c).alias("key"), F.col(c).alias("n")) for c in CONFIDENCES]
    rows += [F.struct(F.lit("total").alias("kind"), F.lit("high confidence").alias("key"), (F.col("exact") + F.col("high")).alias("n"))]
    of_type = by.groupBy("type").agg(F.sum("n").alias("n")).select(F.lit("type").alias("kind"), F.col("type").alias("key"), "n")
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*").union(of_type)
