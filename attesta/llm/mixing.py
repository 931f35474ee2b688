"""Mixing sources to target weights along a time-varying curriculum. DataFrame functions only.

Every source has a weight schedule: a piecewise linear rate over training time 0 to 1. Its integral up to a time is
the share of the source's words that training has asked for by then. A document's words lie at a known interval of
its source's word stream, so the inverse of the integral gives the time, and times the mix's length the training
position, at which the document is needed. Documents are range-sorted by that position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST_REPEATS = (5, 2, 1), 3
#: Schedules by weight rank: (time, rate) knots. Heavy sources start strong and fade, light ones grow.
SCHEDULES = (((0.0, 1.4), (0.5, 1.0), (1.0, 0.6)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.4), (0.5, 0.8), (1.0, 2.0)))
#: Hex digits of the hash that name a slice, and what is added to the id before it is hashed.
SLICE_DIGITS, SALT = 3, ":17"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """``totals (source, source_size)`` with ``rank, weight, target``.

    Sources in order of code point, null last, weigh ``weights`` in turn. The targets sum to all words; none exceeds
    ``most`` times its source, and what is cut off is shared by weight among the rest. That water level is found at
    once: in rising order of cap / weight, the capped sources are those whose ratio is at most the level that would
    hold if they were the first one not capped.
    """
    byrank = Window.orderBy(F.col("source").asc_nulls_last())
    k = len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank"), F.lit(k)) + 1).cast("int"))
    t = totals.withColumn("rank", F.row_number().over(byrank) - 1).withColumn("weight", w)
    t = t.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    prior = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = t.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(prior), F.lit(0.0))) / F.sum("weight").over(rest))
    t = t.withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    level = F.min(F.when(~F.col("capped"), F.struct("rank_in_order", "level"))).over(everything)["level"]
    t = t.withColumn("rank_in_order", F.row_number().over(order)).withColumn("final", level)
    return t.select("source", "source_size", "rank", "weight", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("final") * F.col("weight")).alias("target")).withColumn("mix_words", F.sum("source_size").over(everything).cast("double"))


def integrated(knots) -> list[tuple[float, float, float, float]]:
    """(time, rate, slope, share so far) of each piece, scaled so that the whole integral is 1."""
    whole = sum((t1 - t0) * (r0 + r1) / 2 for (t0, r0), (t1, r1) in zip(knots, knots[1:]))
    out, share = [], 0.0
    for (t0, r0), (t1, r1) in zip(knots, knots[1:]):
        if t1 <= t0 or r0 < 0 or r1 < 0 or whole <= 0:
            raise ValueError("a schedule needs rising times, rates of 0 or more and a positive integral")
        out.append((t0, r0 / whole, (r1 - r0) / whole / (t1 - t0), share))
        share += (t1 - t0) * (r0 + r1) / 2 / whole
    return out


def time_of(share: Column, knots) -> Column:
    """The time by which a schedule has asked for ``share`` of its words: the root of the piece's quadratic."""
    found = None
    for t0, rate, slope, before in integrated(knots):
        need = F.greatest(share - before, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(rate * rate) + 2 * slope * need, F.lit(0.0)))
        at = F.lit(t0) + F.when(need <= 0, 0.0).otherwise(2 * need / (F.lit(rate) + root))
        found = at if found is None else F.when(share >= before, at).otherwise(found)
    return F.least(F.greatest(found, F.lit(0.0)), F.lit(1.0))


def time_sql(share: str, knots) -> str:
    """``time_of`` as an SQL expression of the same operations."""
    found = "NULL"
    for t0, rate, slope, before in integrated(knots):
        need = f"greatest({share} - {before!r}::DOUBLE, 0::DOUBLE)"
        root = f"sqrt(greatest({rate * rate!r}::DOUBLE + {2 * slope!r}::DOUBLE * {need}, 0::DOUBLE))"
        at = f"({t0!r}::DOUBLE + CASE WHEN {need} <= 0 THEN 0::DOUBLE ELSE 2::DOUBLE * {need} / ({rate!r}::DOUBLE + {root}) END)"
        found = at if found == "NULL" else f"CASE WHEN {share} >= {before!r}::DOUBLE THEN {at} ELSE {found} END"
    return f"least(greatest({found}, 0::DOUBLE), 1::DOUBLE)"


def mix_sql(weights=WEIGHTS, most: int = MOST_REPEATS, schedules=SCHEDULES) -> str:
    """SQL for ``doc_id, size, source_size, target, taken, position`` of the mix of ``documents``."""
    times = " ".join(f"WHEN rank % {len(schedules)} = {i} THEN {time_sql('share', k)}" for i, k in enumerate(schedules))
    reads = " + ".join(f"greatest(0, least(size, wanted - start - {i} * source_size))" for i in range(most))
    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, left(sha256(coalesce(doc_id::VARCHAR, '') || '{SALT}'), 16) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, [{", ".join(f"{x}::DOUBLE" for x in weights)}][rank % {len(weights)} + 1] AS weight, source_size * {most}::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE AS total FROM s),
l AS (SELECT *, row_number() OVER o AS place,
  (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
  / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w WINDOW o AS (ORDER BY cap / weight, rank)),
c AS (SELECT *, cap <= level * weight AS capped FROM l),
t AS (SELECT *, CASE WHEN capped THEN cap ELSE (SELECT arg_min(level, place) FROM c WHERE NOT capped) * weight END AS target FROM c),
x AS (SELECT doc_id, size, source_size, target, total, rank, round(target)::BIGINT AS wanted,
  (sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
y AS (SELECT *, ({reads})::BIGINT AS taken, CASE WHEN wanted > 0 THEN start / wanted ELSE 0 END::DOUBLE AS share FROM x)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN total * CASE {times} END END AS position FROM y"""


def mixed(docs: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS, schedules=SCHEDULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """What the mix takes of every row of ``docs (doc_id, text, source)``.

    Returns ``doc_id, size, source_size, target, taken, position, copies`` and the columns in ``keep``. Size is the number of words, 0 for null. A source's documents, in
    order of a hash, form a stream of words that is read over and over (``most`` times at most) until the target,
    rounded, is reached; ``taken`` counts the words read from the document, so the last one may be cut at a word.
    Taken words sum to the rounded target in every source, and no document gives more than ``most`` times its
    words. ``position`` (0 to the mix's words) is where training first needs the document, null if it takes
    nothing; ``copies`` has words and position of each reading. Null sources are one source, the last. Ties of the hash go by doc_id, size and checksum of the text, so
    reruns agree. A table without words gives targets and taken words of 0.

    Sums run over slices of the hash order: a source is summed per slice, map-side first, and rows are ordered only
    within a slice, so that a source with a third of all rows is spread over 4096 groups.
    """
    key = F.substring(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(SALT)), 256), 1, 16)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNull().alias("none"), word_count(F.col("text")).alias("size"), key.alias("h"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("crc"), *[F.col(c).alias(f"kept_{c}") for c in keep],
    ).withColumn("slice", F.conv(F.substring("h", 1, SLICE_DIGITS), 16, 10).cast("int"))
    slices = rows.groupBy("none", "src", "slice").agg(F.sum("size").alias("words"))
    totals = slices.groupBy("none", "src").agg(F.sum("words").alias("source_size"))
    targets = source_targets(totals.withColumn("source", F.when(~F.col("none"), F.col("src"))), weights, most)
    targets = targets.withColumn("none", F.col("source").isNull()).withColumn("src", F.coalesce("source", F.lit(""))).drop("source")
    before = Window.partitionBy("none", "src").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.withColumn("ahead", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words").join(targets, ["none", "src"])
    inner = Window.partitionBy("none", "src", "slice").orderBy("h", "doc_id", "size", "crc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the window deals rows by source and slice, and the join meets them where they are
    at = rows.withColumn("upto", F.sum("size").over(inner)).join(offsets, ["none", "src", "slice"])
    at = at.withColumn("start", F.col("ahead") + F.col("upto") - F.col("size")).withColumn("wanted", F.round("target").cast("long"))
    reads = F.transform(
        F.sequence(F.lit(0), F.lit(most - 1)),
        lambda i: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("wanted") - F.col("start") - i * F.col("source_size"))),
    )
    at = at.withColumn("reads", reads).withColumn("taken", F.aggregate("reads", F.lit(0).cast("long"), lambda acc, x: acc + x))

    def position(i):
        share = F.when(F.col("wanted") > 0, (F.col("start") + i * F.col("source_size")) / F.col("wanted")).otherwise(F.lit(0.0))
        time = F.lit(0.0)
        for k, knots in enumerate(schedules):
            time = F.when(F.pmod(F.col("rank"), F.lit(len(schedules))) == k, time_of(share, knots)).otherwise(time)
        return F.col("mix_words") * time

    copies = F.array(*[F.struct(F.col("reads")[i].alias("words"), position(i).alias("position")) for i in range(most)])
    return at.select(
        "doc_id", "size", "source_size", "target", "taken", F.when(F.col("taken") > 0, position(0)).alias("position"),
        F.filter(copies, lambda c: c["words"] > 0).alias("copies"), *[F.col(f"kept_{c}").alias(c) for c in keep],
    )


def ordered_for_training(mix: DataFrame) -> DataFrame:
    """``mix`` range-sorted by training position; documents that the mix doesn't take come last."""
    return mix.orderBy(F.col("position").asc_nulls_last(), "doc_id")
