"""Answering a question with citations, and reporting differences between a trial's sources."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models
from ..functions import text as T
from ..operators import compare, retrieval
from ..operators.trace import TraceStore
from . import generation

DIGEST = "stand-in"


def excerpts(ranked: DataFrame) -> DataFrame:
    """``query_id, ids, texts`` of ranked chunks, in rank order; a question has few by construction."""
    l = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text"))).alias("l"))
    return l.select("query_id", F.transform("l", lambda x: x["chunk_id"]).alias("ids"), F.transform("l", lambda x: x["text"]).alias("texts"))


def answers(queries: DataFrame, ranked: DataFrame, generate: Callable[[Column, Column], Column] = models.extractive_answer) -> DataFrame:
    """``query_id, response_text, cited_chunk_ids, is_refusal`` for a batch of questions; without excerpts the model is asked all the same."""
    j = queries.select("query_id", "query_text").join(excerpts(ranked), "query_id", "left")
    j = j.withColumn("ids", F.coalesce("ids", F.array().cast("array<string>"))).withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))
    j = j.withColumn("response_text", generate(F.col("query_text"), F.col("texts")))
    refused = T.is_refusal(F.col("response_text"))
    cited = F.when(refused, F.array().cast("array<string>")).otherwise(T.citations(F.col("response_text"), F.col("ids")))
    return j.select("query_id", "response_text", cited.alias("cited_chunk_ids"), refused.alias("is_refusal"))


def retrieve(chunks: DataFrame, index: DataFrame, queries: DataFrame, filters: retrieval.QueryFilters | None = None, reranked: bool = True, k: int = retrieval.TOP) -> DataFrame:
    """The full ladder: filter, dense and lexical candidates, fusion, and reranking; ``query_id, chunk_id, rank, text``."""
    fused = retrieval.hybrid_search(chunks, index, queries, retrieval.CANDIDATES if reranked else k, filters)
    texts = retrieval.fetch(chunks, fused)
    return retrieval.rerank(texts, queries, models.overlap_score, k) if reranked else texts


def answer(spark: SparkSession, chunks: DataFrame, index: DataFrame, question: str, nct_id: str | None = None, store: TraceStore | None = None, embed: Callable[[Column], Column] = models.hash_embedding, generate: Callable[[Column, Column], Column] = models.extractive_answer, tier: str | None = None, outcomes: DataFrame | None = None) -> Iterator[dict]:
    """Events of one answer: token events, then one with the citations.

    With a store, every stage is traced and the answer is taken from the cache if the model gave it before; a cached
    answer is one token event, a new one has one for each word. Tier ``T3`` answers across sources: excerpts are the
    protocol's best chunk and the registry's ``outcomes``, first-posted and current, instead of a ranking.
    """
    filters = retrieval.parse_query(question, nct_id)
    qid = store.log_query(question, tier) if store else 0
    q = spark.range(1).select(F.lit(qid).alias("query_id"), F.lit(question).alias("query_text")).withColumn("query_vector", embed(F.col("query_text")))
    if tier == "T3" and nct_id is not None and outcomes is not None:
        filters = next(f for leg, _, f in retrieval.decompose(question, nct_id) if leg == "protocol")
    if store:
        ranked = generation.traced_ladder(chunks, index, q, store, models.overlap_score, filters=filters)
    else:
        ranked = retrieve(chunks, index, q, filters)
    if tier == "T3" and nct_id is not None and outcomes is not None:
        ranked = source_excerpts(spark, nct_id, ranked, outcomes, qid)
    if store:
        row = generation.generate_answers(q, excerpts(ranked), store, DIGEST, generation.column_generator(models.prompted(generate))).first()
    else:
        row = answers(q, ranked, generate).first()
    cached = bool(store) and row["from_cache"]
    for piece in [row["response_text"]] if cached else row["response_text"].split():
        yield {"type": "token", "text": piece}
    done = {"type": "done", "response_text": row["response_text"], "cited_chunk_ids": row["cited_chunk_ids"], "is_refusal": row["is_refusal"]}
    yield done | ({"query_id": qid, "generation_id": row["generation_id"], "from_cache": cached} if store else {})


def source_excerpts(spark: SparkSession, nct_id: str, ranked: DataFrame, outcomes: DataFrame, query_id: int) -> DataFrame:
    """The three legs of a question across sources as a ranking ``query_id, chunk_id, rank, text``; legs without a text are left out."""
    best = ranked.where("rank = 1").select(F.lit(nct_id).alias("nct_id"), "chunk_id", "text", "rank")
    row = retrieval.cross_source(spark.range(1).select(F.lit(nct_id).alias("nct_id")), outcomes, best)
    legs = [("protocol_leg", F.col("protocol_chunk_id")), ("registered_first", F.lit(f"{nct_id}:registered_first")), ("registered_current", F.lit(f"{nct_id}:registered_current"))]
    rows = row.select(F.posexplode(F.filter(F.array(*[F.struct(c.alias("chunk_id"), F.col(leg).alias("text")) for leg, c in legs]), lambda x: x["text"].isNotNull())).alias("pos", "x"))
    return rows.select(F.lit(query_id).alias("query_id"), F.col("x.chunk_id").alias("chunk_id"), (F.col("pos") + 1).alias("rank"), F.col("x.text").alias("text"))


def sse(event: dict) -> str:
    return f"data: {json.dumps(event)}\n\n"


def discrepancies(trials: DataFrame, outcomes: DataFrame, chunks: DataFrame, judge: Callable[[DataFrame], DataFrame] = models.rule_judge) -> DataFrame:
    """``compare.detect`` for all trials at once; the protocol's side is the first chunk of its objectives."""
    objectives = chunks.where("doc_type = 'protocol' AND section = 'objectives'").select("nct_id", "chunk_id", "text", F.col("chunk_index").alias("rank"))
    return compare.detect(retrieval.cross_source(trials, outcomes, objectives), judge)


def healthy(spark: SparkSession) -> bool:
    return spark.sql("SELECT 1 AS one").first()["one"] == 1
