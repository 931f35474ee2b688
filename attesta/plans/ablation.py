"""The retrieval ladder, rung by rung, on one set of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import models
from ..functions import text as T
from ..operators import metrics, retrieval
from ..operators.trace import TraceStore, new_id
from . import generation
from .answering import excerpts

RUNGS = ("dense", "lexical", "hybrid", "hybrid_prefiltered", "reranked")


def rung(name: str, chunks: DataFrame, index: DataFrame, questions: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, chunk_id, rank`` of a rung for ``questions (query_id, query_text, query_vector, nct_id)``.

    The prefiltered rungs let a question meet only the chunks of its trial; all questions are one search.
    """
    if name == "dense":
        return retrieval.dense_search(chunks, questions, k).select("query_id", "chunk_id", "rank")
    if name == "lexical":
        return retrieval.lexical_search(index, questions, k).select("query_id", "chunk_id", "rank")
    if name == "hybrid":
        return retrieval.hybrid_search(chunks, index, questions, k).select("query_id", "chunk_id", "rank")
    fused = retrieval.hybrid_search(chunks, index, questions, retrieval.CANDIDATES, match="nct_id")
    if name == "hybrid_prefiltered":
        return fused.where(F.col("rank") <= k).select("query_id", "chunk_id", "rank")
    if name == "reranked":
        return retrieval.rerank(retrieval.fetch(chunks, fused), questions, models.overlap_score).select("query_id", "chunk_id", "rank")
    raise ValueError(f"no rung {name}")


def run(chunks: DataFrame, index: DataFrame, questions: DataFrame, gold: DataFrame, rungs: tuple[str, ...] = RUNGS) -> DataFrame:
    """One row of means per rung; ``gold (query_id, chunk_id)``."""
    n = questions.select("query_id").join(gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold")), "query_id", "left").na.fill(0)
    out = None
    for name in rungs:
        hits = rung(name, chunks, index, questions).join(gold.withColumn("hit", F.lit(True)), ["query_id", "chunk_id"], "left").na.fill(False, ["hit"])
        row = metrics.score_ranked(hits, n).withColumn("rung", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def traced_rung(name: str, chunks: DataFrame, index: DataFrame, questions: DataFrame, store: TraceStore, k: int = 20) -> DataFrame:
    """``rung`` with its stages in the trace; ``query_id, chunk_id, rank``."""
    if name == "dense":
        found = generation.traced_stage(store, "dense", questions, retrieval.dense_search(chunks, questions, k))
    elif name == "lexical":
        found = generation.traced_stage(store, "bm25", questions, retrieval.lexical_search(index, questions, k))
    elif name in RUNGS:
        match = None if name == "hybrid" else "nct_id"
        found = generation.traced_ladder(chunks, index, questions, store, models.overlap_score if name == "reranked" else None, retrieval.TOP if name == "reranked" else k, match=match)
    else:
        raise ValueError(f"no rung {name}")
    return found.select("query_id", "chunk_id", "rank")


def answer_scores(questions: DataFrame, answers: DataFrame, texts: DataFrame, store: TraceStore, digest: str, generate: generation.Generator) -> DataFrame:
    """One row ``correctness_t1, correctness_t2, faithfulness`` of answers to ``questions (query_id, query_text, gold_answer, notes)``.

    Questions with a gold answer are matched, those with notes are judged; refusals don't count in the faithfulness. Null where nothing counts.
    """
    a = questions.join(answers, "query_id")
    t1 = a.where("gold_answer is not null").agg(F.avg(metrics.exact_match(F.col("response_text"), F.col("gold_answer")).cast("double")).alias("correctness_t1"))
    judged = generation.judged_correctness(a.where("gold_answer is null and notes is not null").select("query_id", F.col("query_text").alias("question_text"), F.col("response_text").alias("answer"), "notes"), store, digest, generate)
    said = a.where(~T.is_refusal(F.col("response_text"))).join(texts, "query_id").select("query_id", F.col("response_text").alias("answer"), "texts")
    faith = generation.faithfulness(said, store, digest, generate)
    one = F.lit(True)  # one row each
    return t1.join(judged.agg(F.avg("score").alias("correctness_t2")), one).join(faith.agg(F.avg("score").alias("faithfulness")), one)


def run_traced(chunks: DataFrame, index: DataFrame, questions: DataFrame, gold: DataFrame, store: TraceStore, rungs: tuple[str, ...] = RUNGS, digest: str | None = None, generate: generation.Generator | None = None) -> tuple[DataFrame, DataFrame]:
    """Means per rung, as ``run`` gives them, and ``rung, stage, p50, p95, mean, n`` of the latencies in the trace.

    Every rung logs its questions under ids of its own, so the trace tells the rungs apart. With a generator, questions
    are also answered and ``answer_scores`` added to the means.
    """
    scores = latency = None
    for name in rungs:
        base = new_id()
        numbered = questions.withColumn("_old", F.col("query_id")).withColumn("query_id", F.lit(base) + F.row_number().over(Window.orderBy("query_id")))  # a question set of some hundreds
        q = generation._kept(numbered, store)
        store.append("query", q.select("query_id", F.col("query_text").alias("text"), F.lit(name).alias("tier"), F.current_timestamp().alias("created_at")))
        found = traced_rung(name, chunks, index, q, store)
        mine = q.select("query_id", F.col("_old")).join(gold.withColumnRenamed("query_id", "_old"), "_old").drop("_old")
        n = q.select("query_id").join(mine.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold")), "query_id", "left").na.fill(0)
        hits = found.join(mine.withColumn("hit", F.lit(True)), ["query_id", "chunk_id"], "left").na.fill(False, ["hit"])
        row = metrics.score_ranked(hits, n).withColumn("rung", F.lit(name))
        if generate is not None:
            texts = excerpts(retrieval.fetch(chunks, found))
            answered = generation.generate_answers(q, texts, store, digest, generate)
            row = row.join(answer_scores(q, answered, texts, store, digest, generate), F.lit(True))
        top = q.agg(F.max("query_id")).first()[0] or base
        times = metrics.stage_latency(store.table("retrieval_step"), base, top).withColumn("rung", F.lit(name))
        row, times = generation._kept(row, store), generation._kept(times, store)
        scores = row if scores is None else scores.unionByName(row)
        latency = times if latency is None else latency.unionByName(times)
    return scores, latency
