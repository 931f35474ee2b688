"""Comparing what sources say: normal outcomes, the cascade of comparisons, verdicts per pair of sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

PAIRS = ("first_posted_vs_current", "current_vs_protocol", "registry_vs_results")
# What verdict texts call the two sides of a pair.
SIDES = {
    "first_posted_vs_current": ("current registry", "first-posted registry"),
    "current_vs_protocol": ("current registry", "protocol document"),
    "registry_vs_results": ("registry", "results-reported"),
}


def normal_outcome(measure: Column, time_frame: Column) -> Column:
    """``(construct, timeframe, raw_text)``: normal text of the measure, months of the time frame or else of the measure."""
    return F.struct(
        T.normalize_text(measure).alias("construct"),
        F.coalesce(T.timeframe_in_months(time_frame), T.timeframe_in_months(measure)).alias("timeframe"),
        measure.alias("raw_text"),
    )


def cascade(a: Column, b: Column) -> Column:
    """``(verdict, method)`` of two texts where rules decide; method ``judge`` with a null verdict otherwise.

    Equal normal texts match. Texts that are equal without their durations are decided by the durations: a match if
    both have the same single one, else left to the judge.
    """
    same = T.normalize_text(a) == T.normalize_text(b)
    rest = T.normalize_text(T.strip_durations(a)) == T.normalize_text(T.strip_durations(b))
    ta, tb = T.timeframe_in_months(a), T.timeframe_in_months(b)
    verdict = F.when(same, "match").when(rest & (ta == tb), "match")
    method = F.when(same, "identical_text").when(rest & (ta == tb), "timeframe_deterministic").otherwise("judge")
    return F.struct(verdict.alias("verdict"), method.alias("method"))


def parse_verdict(response: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(response, r"(?i)VERDICT:\s*(match|divergence|ambiguous)", 1)), F.lit(""))


def compared(pairs: DataFrame, judge: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """``pairs (keys, text_a, text_b)`` with ``verdict`` and ``method``; only pairs that rules leave open go to ``judge``.

    The judge adds ``response`` to the rows it is given; a response without a verdict counts as ambiguous.
    """
    ruled = pairs.withColumn("_c", cascade(F.col("text_a"), F.col("text_b"))).withColumn("verdict", F.col("_c.verdict")).withColumn("method", F.col("_c.method")).drop("_c")
    judged = judge(ruled.where("method = 'judge'").select(*keys, "text_a", "text_b")).select(*keys, F.coalesce(parse_verdict(F.col("response")), F.lit("ambiguous")).alias("_v"))
    return ruled.join(judged, keys, "left").withColumn("verdict", F.coalesce("verdict", "_v")).drop("_v")


def source_pairs(sources: DataFrame) -> DataFrame:
    """Three rows per trial of ``cross_source``: ``nct_id, pair, state, text_a, text_b, citations``.

    state is not_applicable, retrieval_failed or graded. The registry side of the last pair is the current text, or the
    first-posted one where that is null or empty; it cites the current id if there is one.
    """
    first, current, protocol, results = (F.col(c) for c in ("registered_first", "registered_current", "protocol_leg", "results_reported"))
    registry = F.when(F.coalesce(current, F.lit("")) != "", current).otherwise(first)
    cite = lambda **kv: F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k), F.col(v).cast("string")) for k, v in kv.items()]), lambda e: F.lit(True)))
    rows = [
        F.struct(F.lit(PAIRS[0]).alias("pair"), F.when(first.isNull() | current.isNull(), "not_applicable").otherwise("graded").alias("state"), first.alias("text_a"), current.alias("text_b"),
                 cite(registered_first_outcome_id="registered_first_outcome_id", registered_current_outcome_id="registered_current_outcome_id").alias("citations")),
        F.struct(F.lit(PAIRS[1]).alias("pair"), F.when(current.isNull(), "not_applicable").when(protocol.isNull(), "retrieval_failed").otherwise("graded").alias("state"), current.alias("text_a"), protocol.alias("text_b"),
                 cite(registered_current_outcome_id="registered_current_outcome_id", protocol_chunk_id="protocol_chunk_id").alias("citations")),
        F.struct(F.lit(PAIRS[2]).alias("pair"), F.when(results.isNull() | registry.isNull(), "not_applicable").otherwise("graded").alias("state"), registry.alias("text_a"), results.alias("text_b"),
                 cite(registered_first_outcome_id="registered_first_outcome_id", registry_outcome_id="_registry_id", results_reported_outcome_id="results_reported_outcome_id").alias("citations")),
    ]
    with_id = sources.withColumn("_registry_id", F.coalesce("registered_current_outcome_id", "registered_first_outcome_id"))
    return with_id.select("nct_id", F.inline(F.array(*rows)))


def verdict_text(pair: Column, verdict: Column, failed: Column) -> Column:
    """A neutral sentence for a verdict; null where there is nothing to say."""
    side = lambda i: F.element_at(F.create_map(*[F.lit(x) for p, s in SIDES.items() for x in (p, s[i])]), pair)
    a, b = side(0), side(1)
    return (
        F.when(failed, F.concat(b, F.lit(" primary outcome could not be retrieved for this trial -- no comparison was made.")))
        .when(verdict == "match", F.concat(a, F.lit(" primary outcome matches "), b, F.lit(" primary outcome.")))
        .when(verdict == "divergence", F.concat(a, F.lit(" primary outcome differs from "), b, F.lit(" primary outcome.")))
        .when(verdict == "ambiguous", F.concat(a, F.lit(" primary outcome could not be confidently compared to "), b, F.lit(" primary outcome -- flagged for human review.")))
    )


def detect(sources: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``nct_id, pair, state, verdict, retrieval_failed, method, citations, text`` for every applicable or not applicable pair."""
    pairs = source_pairs(sources)
    graded = compared(pairs.where("state = 'graded'").select("nct_id", "pair", "text_a", "text_b"), judge, ["nct_id", "pair"]).select("nct_id", "pair", "verdict", "method")
    out = pairs.join(graded, ["nct_id", "pair"], "left").withColumn("retrieval_failed", F.col("state") == "retrieval_failed")
    return out.select("nct_id", "pair", "state", "verdict", "retrieval_failed", "method", "citations", verdict_text(F.col("pair"), F.col("verdict"), F.col("retrieval_failed")).alias("text"))


def evaluate_normalization(pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accuracy, confusion (label by verdict) and counts per method of graded phrase pairs ``(label, verdict, method)``."""
    kinds = ["match", "divergence", "ambiguous"]
    return (
        pairs.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("verdict")).cast("double")).alias("accuracy")),
        pairs.groupBy("label").pivot("verdict", kinds).count().na.fill(0),
        pairs.groupBy("method").count(),
    )
