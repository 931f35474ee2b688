"""Relational operators: first per key, upsert, positional and range joins, quotas, caps, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key by ``order``. Spark keeps one row a key on the map side (a group limit), so hot keys shrink before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*_cols(order))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*_cols(order))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` and those rows of ``old`` whose key is not among them."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def priority_union(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All of ``first``, and ``second`` for keys that ``first`` lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), list(keys), "left_anti"))


def positional_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: Sequence[str | Column], right_order: Sequence[str | Column]) -> DataFrame:
    """Pairs the n-th row of a key on one side with its n-th row on the other. Columns of the sides must differ, but for the keys."""
    a = left.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*_cols(left_order))))
    b = right.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*_cols(right_order))))
    return a.join(b, [*keys, "_n"]).withColumnRenamed("_n", "ordinal")


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether closed intervals share a point."""
    return (a_start <= b_end) & (b_start <= a_end)


def range_join_first(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str], right_order: Sequence[str | Column], bucket: int | None = None) -> DataFrame:
    """For each row of ``left`` the first row of ``right`` with its key whose span overlaps; rows without one stay, with nulls.

    With ``bucket`` both sides are dealt into bins of that width along the span first, so that keys with long timelines
    are joined bin by bin instead of each row against each.
    """
    cond = overlaps(F.col(left_span[0]), F.col(left_span[1]), F.col(right_span[0]), F.col(right_span[1]))
    on = list(keys)
    a, b = left, right
    if bucket:
        bins = lambda s: F.explode(F.sequence(F.floor(F.col(s[0]) / bucket), F.floor(F.col(s[1]) / bucket)))
        valid = lambda s: F.col(s[0]) <= F.col(s[1])
        a, b = a.where(valid(left_span)).withColumn("_bin", bins(left_span)), b.where(valid(right_span)).withColumn("_bin", bins(right_span))
        on.append("_bin")
    hit = a.join(b, on).where(cond)
    w = Window.partitionBy(*keys, *left_id).orderBy(*_cols(right_order))
    first = hit.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    extra = [c for c in right.columns if c not in keys]
    return left.join(first.select(*keys, *left_id, *extra), [*keys, *left_id], "left")


def nearest_below(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: Sequence[str], at: str, position: str, value: str) -> DataFrame:
    """For each row of ``left`` the ``value`` of the row of ``right`` with the greatest ``position`` at or below ``at``.

    One sort of both sides by key and position and a running last value; no row meets more than its neighbours.
    """
    l = left.select(*keys, F.col(at).alias("_p"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    r = right.select(*keys, F.col(position).alias("_p"), F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    w = Window.partitionBy(*keys).orderBy("_p", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = l.unionByName(r).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return out.select("_row.*", F.col("_v").alias(value))


def sections_from_markers(markers: DataFrame, keys: Sequence[str], start: str, order: Sequence[str | Column], total: str) -> DataFrame:
    """Start markers as closed ranges ``(range_start, range_end)``: each ends before the next one, or at the last page ``total - 1``.

    Two markers on one page make ranges that share it. A row with null in all other columns covers the pages before the first marker.
    """
    w = Window.partitionBy(*keys).orderBy(*_cols(order))
    nxt = F.lead(start).over(w)
    body = markers.withColumn("range_start", F.col(start)).withColumn("range_end", F.greatest(F.col(start), F.coalesce(nxt, F.col(total)) - 1))
    gap = markers.groupBy(*keys).agg(F.min(start).alias("range_end")).where("range_end > 0").select(*keys, F.lit(0).cast(markers.schema[start].dataType).alias("range_start"), (F.col("range_end") - 1).alias("range_end"))
    return body.unionByName(gap, allowMissingColumns=True)


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: str, position: str) -> DataFrame:
    """Runs of equal ``value`` (null equals null) along ``order``: ``keys, run, value, run_start, run_end, n``."""
    w = Window.partitionBy(*keys).orderBy(*_cols(order))
    new = F.when(F.row_number().over(w) == 1, 1).when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    run = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = df.withColumn("_new", new).withColumn("run", run)
    return marked.groupBy(*keys, "run").agg(F.any_value(value).alias(value), F.min(position).alias("run_start"), F.max(position).alias("run_end"), F.count(F.lit(1)).alias("n"))


def propagate_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: str, to: str) -> DataFrame:
    """Adds ``to``: the last ``value`` that was not null up to each row."""
    w = Window.partitionBy(*keys).orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(to, F.last(value, ignorenulls=True).over(w))


def mark_superseded(df: DataFrame, keys: Sequence[str], version: str, to: str = "superseded") -> DataFrame:
    """Adds ``to``: whether ``version`` is below the greatest of its key; false for null."""
    return df.withColumn(to, F.coalesce(F.col(version) < F.max(version).over(Window.partitionBy(*keys)), F.lit(False)))


def histogram(df: DataFrame, value: str, width: int) -> DataFrame:
    """Rows per bucket ``[bucket, bucket + width)``; empty buckets are left out."""
    return df.where(F.col(value).isNotNull()).groupBy((F.floor(F.col(value) / width) * width).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def largest_remainder(df: DataFrame, keys: Sequence[str], target: int) -> DataFrame:
    """Proportional quota per stratum: floor of the share, and one more for the largest remainders, ties by key.

    Works on one row a stratum; the target is capped at the number of rows.
    """
    strata = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    want = F.least(F.lit(target).cast("long"), F.sum("n").over(everything))
    q = strata.withColumn("raw", F.col("n") / F.sum("n").over(everything) * want).withColumn("want", want).withColumn("base", F.floor("raw"))
    short = F.col("want") - F.sum("base").over(everything)
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("raw") - F.col("base")), *keys))
    return q.withColumn("short", short).withColumn("rank", rank).select(*keys, "n", (F.col("base") + F.when(F.col("rank") <= F.col("short"), 1).otherwise(0)).cast("long").alias("quota"))


def seeded_order(seed: int, *ids: Column) -> Column:
    """A repeatable pseudo-random order: the SHA-256 of seed and id, as hex."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[i.cast("string") for i in ids]), 256)


def stratified_sample(df: DataFrame, stratum: str, ids: Sequence[str], n: int, seed: int) -> DataFrame:
    """``n`` rows of each stratum in seeded order."""
    return first_n(df, [stratum], [seeded_order(seed, *_cols(ids)), *_cols(ids)], n)


def round_robin_cap(df: DataFrame, bucket: str, ids: Sequence[str], limit: int, seed: int) -> DataFrame:
    """Takes rows in turn from every bucket, in seeded order inside it, until ``limit`` rows are taken; ``turn`` tells the round.

    No bucket can give more than ``limit`` rows, so each is cut to that before the one sort.
    """
    w = Window.partitionBy(bucket).orderBy(seeded_order(seed, *_cols(ids)), *ids)
    return df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= limit).orderBy("turn", bucket).limit(limit)


def pivot_counts(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Counts per ``row`` with one column for each of ``values``, which are fixed so that no extra job looks them up."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def mode_first(df: DataFrame, keys: Sequence[str], value: str, position: str) -> DataFrame:
    """The most frequent ``value`` per key; ties go to the one met first."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("n", (-F.col("first")).alias("f"))).alias(value))


def three_state(applicable: Column, failed: Column, graded: Column) -> Column:
    """not_applicable, retrieval_failed or what ``graded`` says, in that order."""
    return F.when(~applicable, "not_applicable").when(failed, "retrieval_failed").otherwise(graded)
