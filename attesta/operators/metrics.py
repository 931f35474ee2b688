"""Evaluation: retrieval metrics, correctness, refusals, discrepancy scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as T

KS = (1, 5, 10, 20)


def recall_at(retrieved: Column, gold: Column, k: int) -> Column:
    """Share of the gold set among the first k; 0 without gold."""
    hits = F.size(F.array_intersect(F.slice(retrieved, 1, k), gold))
    n = F.size(F.array_distinct(gold))
    return F.when(n > 0, hits / n).otherwise(0.0)


def _hits(retrieved: Column, gold: Column, k: int) -> Column:
    return F.filter(F.slice(retrieved, 1, k), lambda x: F.array_contains(gold, x))


def precision_at(retrieved: Column, gold: Column, k: int) -> Column:
    """Positions among the first k that hold gold, over k even if fewer came back."""
    return F.size(_hits(retrieved, gold, k)) / F.lit(float(k))


def reciprocal_rank(retrieved: Column, gold: Column) -> Column:
    at = F.array_position(F.transform(retrieved, lambda x: F.array_contains(gold, x)), True)
    return F.when(at > 0, 1.0 / at).otherwise(0.0)


def ndcg_at(retrieved: Column, gold: Column, k: int) -> Column:
    """Binary gains by position; the ideal has min(gold, k) hits in front; 0 without gold."""
    gains = F.transform(F.slice(retrieved, 1, k), lambda x, i: F.when(F.array_contains(gold, x), 1 / F.log2(i + 2.0)).otherwise(0.0))
    dcg = F.aggregate(gains, F.lit(0.0), lambda acc, x: acc + x)
    n = F.least(F.size(F.array_distinct(gold)), F.lit(k))
    ideal = F.aggregate(F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: 1 / F.log2(i + 1.0))).otherwise(F.array().cast("array<double>")), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(ideal > 0, dcg / ideal).otherwise(0.0)


def score_retrieval(runs: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Means over questions ``(retrieved, gold)``, both arrays of ids, in one row."""
    r, g = F.col("retrieved"), F.col("gold")
    cols = [f(r, g, k).alias(f"{name}_{k}") for name, f in (("recall", recall_at), ("precision", precision_at)) for k in ks]
    per = runs.select(*cols, reciprocal_rank(r, g).alias("mrr"), ndcg_at(r, g, 10).alias("ndcg_10"))
    return per.agg(F.count(F.lit(1)).alias("questions"), *[F.avg(c).alias(c) for c in per.columns])


def score_ranked(hits: DataFrame, gold: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """The means of ``score_retrieval`` from rows: ``hits (query_id, rank, hit)`` and ``gold (query_id, n_gold)``.

    Needs no array of gold ids, so the gold set of a question can be as large as the corpus. Ids are taken to be distinct within a question.
    """
    h = F.col("hit")
    per = hits.groupBy("query_id").agg(
        *[F.count_if(h & (F.col("rank") <= k)).alias(f"h{k}") for k in ks],
        F.coalesce(1.0 / F.min(F.when(h, F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.sum(F.when(h & (F.col("rank") <= 10), 1 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("dcg"),
    )
    rows = gold.join(per, "query_id", "left").na.fill(0)
    n = F.least(F.col("n_gold"), F.lit(10)).cast("int")
    ideal = F.aggregate(F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: 1 / F.log2(i + 1.0))).otherwise(F.array().cast("array<double>")), F.lit(0.0), lambda acc, x: acc + x)
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return rows.agg(
        F.count(F.lit(1)).alias("questions"),
        *[F.avg(share(F.col(f"h{k}"), F.col("n_gold"))).alias(f"recall_{k}") for k in ks],
        *[F.avg(F.col(f"h{k}") / float(k)).alias(f"precision_{k}") for k in ks],
        F.avg("mrr").alias("mrr"),
        F.avg(F.coalesce(F.col("dcg") / F.nullif(ideal, F.lit(0.0)), F.lit(0.0))).alias("ndcg_10"),
    )


def exact_match(generated: Column, gold: Column) -> Column:
    """A gold text with durations matches if one of them is in the answer; another one by standing in it as a whole token."""
    want = T.durations_in_months(gold)
    return F.when(F.size(want) > 0, F.arrays_overlap(want, T.durations_in_months(generated))).otherwise(T.contains_whole_token(T.normalize_text(gold), T.normalize_text(generated)))


def parse_score(response: Column) -> Column:
    """0, 0.5 or 1 after ``SCORE:``, null without one."""
    return F.nullif(F.regexp_extract(response, r"(?i)SCORE:\s*(0\.5|0|1)(?:\.0)?", 1), F.lit("")).cast("double")


def claims(response: Column) -> Column:
    """Lines of a list of claims, without list markers and blank ones."""
    lines = F.transform(F.split(response, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]\s+|\d+[.)]\s+)", "")))
    return F.filter(lines, lambda x: x != "")


def faithfulness(graded: DataFrame, keys: list[str]) -> DataFrame:
    """Grounded claims over claims per answer, from ``(keys, claim, grounded)``; a null claim stands for none, and scores 0."""
    return graded.groupBy(*keys).agg(F.count("claim").alias("claims"), F.coalesce(F.count_if(F.col("grounded")) / F.nullif(F.count("claim"), F.lit(0)), F.lit(0.0)).alias("score"))


def refusal_metrics(adversarial: DataFrame, answerable: DataFrame) -> DataFrame:
    """Share of refusals where refusing is right, and where it is not, from tables with ``response_text``."""
    a = adversarial.agg(F.avg(T.is_refusal(F.col("response_text")).cast("double")).alias("refusal_accuracy"), F.count(F.lit(1)).alias("n_adversarial"))
    b = answerable.agg(F.avg(T.is_refusal(F.col("response_text")).cast("double")).alias("over_refusal_rate"), F.count(F.lit(1)).alias("n_answerable"))
    return a.join(b, F.lit(True))  # one row each


def outcome_bucket(gold: Column, predicted: Column, failed: Column, found: Column) -> Column:
    """not_applicable, retrieval_failed, ambiguous, or tp, fp, fn, tn with divergence as positive."""
    return (
        F.when(~found, "not_applicable")
        .when(F.coalesce(failed, F.lit(False)) | predicted.isNull(), "retrieval_failed")
        .when((gold == "ambiguous") | (predicted == "ambiguous"), "ambiguous")
        .when((gold == "divergence") & (predicted == "divergence"), "tp")
        .when(predicted == "divergence", "fp")
        .when(gold == "divergence", "fn")
        .otherwise("tn")
    )


def prf(buckets: DataFrame, group: str, bucket: str = "bucket") -> DataFrame:
    """Per group, and for all as ``pooled``: counts, precision and recall with Wilson intervals, F1."""
    counts = buckets.rollup(group).agg(
        *[F.count_if(F.col(bucket) == b).alias(b) for b in ("tp", "fp", "fn", "tn", "ambiguous", "retrieval_failed", "not_applicable")], F.grouping(group).alias("_all")
    )
    p_n, r_n = F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")
    p, r = stats.rate(F.col("tp"), p_n), stats.rate(F.col("tp"), r_n)
    (p_lo, p_hi), (r_lo, r_hi) = stats.wilson(F.col("tp"), p_n), stats.wilson(F.col("tp"), r_n)
    return counts.select(
        F.when(F.col("_all") == 1, "pooled").otherwise(F.coalesce(F.col(group).cast("string"), F.lit("null"))).alias(group), "tp", "fp", "fn", "tn", "ambiguous", "retrieval_failed", "not_applicable",
        p.alias("precision"), p_lo.alias("precision_low"), p_hi.alias("precision_high"), r.alias("recall"), r_lo.alias("recall_low"), r_hi.alias("recall_high"), stats.f1(p, r).alias("f1"),
    )


def score_discrepancies(gold: DataFrame, reports: DataFrame) -> DataFrame:
    """``prf`` of gold ``(nct_id, pair, verdict)`` against predictions ``(nct_id, pair, verdict, retrieval_failed, position)``; of repeated predictions the last counts."""
    last = reports.groupBy("nct_id", "pair").agg(F.max_by(F.struct("verdict", "retrieval_failed"), "position").alias("p"))
    joined = gold.join(last, ["nct_id", "pair"], "left")
    return prf(joined.withColumn("bucket", outcome_bucket(F.col("verdict"), F.col("p.verdict"), F.col("p.retrieval_failed"), F.col("p").isNotNull())), "pair")


def stage_latency(steps: DataFrame, low: int, high: int) -> DataFrame:
    """p50, p95, mean and count of latency per stage, for query ids in a closed range."""
    return stats.percentiles(steps.where(F.col("query_id").between(low, high)), ["stage"], "latency_ms", {"p50": 0.5, "p95": 0.95})
