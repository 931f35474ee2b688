"""Column functions for rates, intervals and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = (0.0, 0.5, 1.0)
Z95 = 1.96


def rate(successes: Column, n: Column) -> Column:
    """successes / n, null for n of 0."""
    return F.when(n > 0, successes / n)


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson's score interval, clamped to 0 and 1, null for n of 0."""
    p = successes / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), middle - half)), F.when(n > 0, F.least(F.lit(1.0), middle + half))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall))


def snapped(score: Column) -> Column:
    """The nearest of 0, 0.5 and 1, the lower one on ties."""
    return F.when(score <= 0.25, 0.0).when(score <= 0.75, 0.5).otherwise(1.0)


def confusion(df: DataFrame, human: str, judge: str) -> DataFrame:
    """Counts ``(human, j0, j05, j1)`` of snapped labels, one row per human label that occurs."""
    pairs = df.select(snapped(F.col(human)).alias("human"), snapped(F.col(judge)).alias("judge"))
    return pairs.groupBy("human").agg(*[F.count_if(F.col("judge") == v).alias(n) for v, n in zip(LABELS, ("j0", "j05", "j1"))])


def weighted_kappa(df: DataFrame, human: str, judge: str) -> DataFrame:
    """Linear-weighted kappa in one row ``(n, kappa)``; 1 where no disagreement is to be expected, null without rows.

    One aggregation: expected disagreement follows from the label sums of either side, so no join of marginals is needed.
    """
    h, j = snapped(F.col(human)), snapped(F.col(judge))
    counts = df.select(h.alias("h"), j.alias("j")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.abs(F.col("h") - F.col("j"))).alias("disagreement"),
        *[F.count_if(F.col(side) == v).cast("double").alias(f"{side}{i}") for side in "hj" for i, v in enumerate(LABELS)],
    )
    expected = sum((F.col(f"h{a}") * F.col(f"j{b}") * abs(LABELS[a] - LABELS[b]) for a in range(3) for b in range(3) if a != b), F.lit(0.0))
    n = F.col("n").cast("double")
    return counts.select("n", F.when(F.col("n") == 0, None).when(expected == 0, 1.0).otherwise(1 - (F.col("disagreement") / n) / (expected / (n * n))).alias("kappa"))


def percentiles(df: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles, mean and count per group."""
    return df.groupBy(*by).agg(
        *[F.percentile(value, F.lit(p)).alias(name) for name, p in points.items()], F.avg(value).alias("mean"), F.count(value).alias("n")
    )
