"""Model calls for whole batches of prompts, cached and logged in the trace, and the judges made of them.

A generator takes rows ``(prompt_hash, prompt)`` and adds ``response, tokens_in, tokens_out, wall_clock_ms``. A prompt
that the model answered before, by the digests of model and prompt, is not asked again, nor is one that stands in a
batch twice; every call is logged all the same, in one append a batch.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics, retrieval
from ..operators.compare import parse_verdict
from ..operators.trace import TraceStore, new_id, prompt_hash

Generator = Callable[[DataFrame], DataFrame]

# What models are asked, and the reminder after a response that can't be read.
AGAIN = "\n\n(Your previous response didn't match the required format. Please respond in exactly the format requested.)"
ANSWER = (
    "Answer the question using only the excerpts below. Each excerpt is numbered and begins with a contextual header identifying its trial, document type, and section.\n\n"
    "{excerpts}\n\nQuestion: {question}\n\n"
    "Cite the excerpt number(s) that support your answer inline using bracket notation, e.g. [1] or [2][3]. If the excerpts do not contain the answer, respond with exactly: " + T.REFUSAL
)
CORRECTNESS = (
    "You are grading a clinical-trial question-answering system for FACTUAL CORRECTNESS. Grade the substance of the ANSWER, not its exact wording -- different phrasing, units, or extra correct "
    "detail beyond what was asked must NOT lower the score. Before citing any omission or error, re-read the ANSWER text below and confirm the issue is really there.\n\n"
    "Score on a scale of 0, 0.5, or 1:\n"
    "1 = every fact the question asks for is present and accurate, with no material omission (a multi-part question needs every part correct).\n"
    "0.5 = the core idea, or most parts of a multi-part question, is right, but one sub-part, qualifying condition, or specific detail is missing or wrong.\n"
    "0 = the answer contradicts the REFERENCE NOTES, states an unrelated or fabricated fact, or refuses to answer when the notes show the answer is available.\n\n"
    "QUESTION: {question}\n\nANSWER: {answer}\n\nREFERENCE NOTES: {notes}\n\n"
    "Respond in exactly this format:\nSCORE: <0, 0.5, or 1>\nJUSTIFICATION: <one sentence; if the score is below 1, quote the exact part of the ANSWER that is missing or wrong>"
)
CLAIMS = (
    "Split the following ANSWER into a list of atomic factual claims -- each claim should be a single, independently-verifiable statement. Respond with exactly one claim per line, with no "
    "numbering, bullets, or extra commentary. If the answer contains no factual claims (e.g. it is a refusal), respond with nothing.\n\nANSWER: {answer}"
)
GROUNDED = "Given the EXCERPTS below, is the CLAIM directly supported by them? Respond with exactly one word: YES or NO.\n\nEXCERPTS:\n{excerpts}\n\nCLAIM: {claim}"
OUTCOMES = (
    "You are comparing two clinical-trial primary-outcome text blocks -- OUTCOME A (one source's stated primary outcome) and OUTCOME B (another source's) -- to determine whether they describe "
    "the same measurement. Classify per this rubric:\n\n"
    'MATCH: Same clinical construct, same population, same timeframe (or a timeframe difference attributable only to unit/format, e.g. "24 months" vs. "2 years") -- semantically equivalent '
    "phrasing is a match, not a divergence.\n"
    "DIVERGENCE: Different clinical construct (e.g., overall survival -> progression-free survival), different comparator arm, a materially different population, or a different "
    "primary-vs-secondary designation for the same measure.\n"
    "AMBIGUOUS: Wording changed enough that automatic normalization can't confidently classify it either way, multiple primary outcomes present in one source and not the other (partial "
    "overlap), or the protocol section couldn't be reliably retrieved (retrieval failure, not evidence of divergence -- do not default retrieval failure to divergence).\n\n"
    "OUTCOME A: {a}\n\nOUTCOME B: {b}\n\nRespond in exactly this format:\nVERDICT: <match, divergence, or ambiguous>\nJUSTIFICATION: <one sentence>"
)


def filled(template: str, **values: Column) -> Column:
    """The template with columns in place of its ``{names}``; what the columns hold is not read as a template."""
    parts, rest = [], template
    while rest:
        at = {rest.find("{" + k + "}"): k for k in values if "{" + k + "}" in rest}
        if not at:
            parts.append(F.lit(rest))
            break
        first = min(at)
        parts += [F.lit(rest[:first]), F.coalesce(values[at[first]], F.lit(""))]
        rest = rest[first + len(at[first]) + 2 :]
    return F.concat(*parts)


def numbered(texts: Column) -> Column:
    """Excerpts under their numbers, from 1."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]\n"), t)), "\n\n")


def answer_prompt(question: Column, texts: Column) -> Column:
    return filled(ANSWER, excerpts=numbered(texts), question=question)


def column_generator(respond: Callable[[Column], Column]) -> Generator:
    """A generator of a column function of the prompt; white-space tokens are counted."""

    def generate(prompts: DataFrame) -> DataFrame:
        rows = prompts.withColumn("response", respond(F.col("prompt")))
        return rows.withColumn("tokens_in", T.token_count(F.col("prompt"))).withColumn("tokens_out", T.token_count(F.col("response"))).withColumn("wall_clock_ms", F.lit(0.0))

    return generate


def worker_generator(make: Callable[[], object]) -> Generator:
    """A generator of an object with ``generate(prompt) -> dict`` that every Python worker makes once; it gets Arrow batches."""

    def generate(prompts: DataFrame) -> DataFrame:
        def run(batches):
            held = make()
            for rows in batches:
                found = []
                for p in rows["prompt"]:
                    began = time.perf_counter()
                    r = held.generate(p)
                    found.append((r["response"], r.get("tokens_in", 0), r.get("tokens_out", 0), (time.perf_counter() - began) * 1000))
                rows["response"], rows["tokens_in"], rows["tokens_out"], rows["wall_clock_ms"] = zip(*found) if found else ([], [], [], [])
                yield rows

        return prompts.mapInPandas(run, "prompt_hash string, prompt string, response string, tokens_in long, tokens_out long, wall_clock_ms double")

    return generate


def _kept(df: DataFrame, store: TraceStore) -> DataFrame:
    """``df`` as a written table beside the trace: models are not asked again when it is read again."""
    path = f"{store.path}/_batches/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return store.spark.read.schema(df.schema).parquet(path)


def cached_generate(prompts: DataFrame, store: TraceStore, digest: str, generate: Generator) -> DataFrame:
    """``prompts (query_id, prompt, ...)`` with ``response_text, generation_id, from_cache``; other columns stay.

    What is reused is logged too, with the tokens it once cost and no time. Null prompts are empty ones.
    """
    keyed = prompts.withColumn("prompt", F.coalesce("prompt", F.lit(""))).withColumn("prompt_hash", prompt_hash(F.lit(digest), F.col("prompt")))
    costs = store.table("cost_record").select("generation_id", "tokens_in", "tokens_out")
    known = store.table("generation").where(F.col("model_digest") == digest).join(costs, "generation_id", "left").groupBy("prompt_hash")
    known = known.agg(F.max_by(F.struct("response_text", "tokens_in", "tokens_out"), "generation_id").alias("k"))
    new = keyed.select("prompt_hash", "prompt").dropDuplicates(["prompt_hash"]).join(known, "prompt_hash", "left_anti")
    fresh = _kept(generate(new).select("prompt_hash", "response", "tokens_in", "tokens_out", "wall_clock_ms"), store)
    first = F.row_number().over(Window.partitionBy("prompt_hash").orderBy("query_id")) == 1
    bucket = F.pmod(F.xxhash64("prompt_hash"), F.lit(64))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("query_id", "prompt_hash"))
    rows = keyed.join(known, "prompt_hash", "left").join(fresh, "prompt_hash", "left").withColumn("from_cache", F.col("k").isNotNull() | ~first)
    rows = rows.withColumn("_bucket", bucket).withColumn("generation_id", F.lit(new_id()) + place * 64 + F.col("_bucket")).withColumn("response_text", F.coalesce("k.response_text", "response"))
    free = F.when(F.col("from_cache"), 0.0).otherwise(F.col("wall_clock_ms"))
    rows = rows.withColumn("tokens_in", F.coalesce("tokens_in", "k.tokens_in", F.lit(0))).withColumn("tokens_out", F.coalesce("tokens_out", "k.tokens_out", F.lit(0))).withColumn("wall_clock_ms", free)
    rows = _kept(rows.drop("k", "response", "_bucket"), store)
    log = rows.select("generation_id", "query_id", F.lit(digest).alias("model_digest"), "prompt_hash", "response_text", F.col("wall_clock_ms").alias("latency_ms"), (F.col("tokens_in") + F.col("tokens_out")).alias("token_count"), F.current_timestamp().alias("created_at"))
    store.append("generation", log)
    store.append("cost_record", rows.select("generation_id", "tokens_in", "tokens_out", "wall_clock_ms", "from_cache"))
    return rows.drop("prompt", "prompt_hash", "tokens_in", "tokens_out", "wall_clock_ms")


def asked_twice(prompts: DataFrame, readable: Callable[[Column], Column], store: TraceStore, digest: str, generate: Generator) -> DataFrame:
    """``cached_generate``; prompts whose response can't be read are asked once more, with a reminder of the format."""
    once = cached_generate(prompts, store, digest, generate)
    bad = readable(F.col("response_text")).isNull()
    again = prompts.join(once.where(bad).select("query_id"), "query_id", "left_semi")
    if again.isEmpty():
        return once
    return once.where(~bad).unionByName(cached_generate(again.withColumn("prompt", F.concat("prompt", F.lit(AGAIN))), store, digest, generate))


def generate_answers(queries: DataFrame, excerpts: DataFrame, store: TraceStore, digest: str, generate: Generator) -> DataFrame:
    """``query_id, response_text, cited_chunk_ids, is_refusal, generation_id, from_cache`` for queries and ``excerpts (query_id, ids, texts)``."""
    none = F.array().cast("array<string>")
    j = queries.select("query_id", "query_text").join(excerpts, "query_id", "left").withColumn("ids", F.coalesce("ids", none)).withColumn("texts", F.coalesce("texts", none))
    rows = cached_generate(j.select("query_id", "ids", answer_prompt(F.col("query_text"), F.col("texts")).alias("prompt")), store, digest, generate)
    refused = T.is_refusal(F.col("response_text"))
    return rows.select("query_id", "response_text", F.when(refused, none).otherwise(T.citations(F.col("response_text"), F.col("ids"))).alias("cited_chunk_ids"), refused.alias("is_refusal"), "generation_id", "from_cache")


def judged_correctness(answers: DataFrame, store: TraceStore, digest: str, generate: Generator) -> DataFrame:
    """``query_id, score, response_text`` of ``answers (query_id, question_text, answer, notes)``; score is null where neither response can be read."""
    prompts = answers.select("query_id", filled(CORRECTNESS, question=F.col("question_text"), answer=F.col("answer"), notes=F.col("notes")).alias("prompt"))
    rows = asked_twice(prompts, metrics.parse_score, store, digest, generate)
    return rows.select("query_id", metrics.parse_score(F.col("response_text")).alias("score"), "response_text")


def faithfulness(answers: DataFrame, store: TraceStore, digest: str, generate: Generator) -> DataFrame:
    """``query_id, claims, score``: of the claims of ``answers (query_id, answer, texts)`` those that the excerpts support.

    The model splits each answer, then says of each claim whether it is supported. An answer without claims scores 0.
    """
    split = cached_generate(answers.select("query_id", "texts", filled(CLAIMS, answer=F.col("answer")).alias("prompt")), store, digest, generate)
    each = split.select("query_id", "texts", F.explode_outer(metrics.claims(F.col("response_text"))).alias("claim"))
    asked = each.where("claim is not null").select("query_id", "claim", filled(GROUNDED, excerpts=numbered(F.col("texts")), claim=F.col("claim")).alias("prompt"))
    said = cached_generate(asked, store, digest, generate).select("query_id", "claim", F.startswith(F.upper(F.trim("response_text")), F.lit("YES")).alias("grounded"))
    none = each.where("claim is null").select("query_id", "claim", F.lit(None).cast("boolean").alias("grounded"))
    return metrics.faithfulness(said.unionByName(none), ["query_id"])


def outcome_judge(store: TraceStore, digest: str, generate: Generator) -> Callable[[DataFrame], DataFrame]:
    """A judge for ``compare.compared``; each of its pairs is logged as a query, and responses that can't be read are asked again once."""

    def judge(rows: DataFrame) -> DataFrame:
        named = _kept(rows.withColumn("query_id", F.lit(new_id()) + F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 40))), store)
        store.append("query", named.select("query_id", F.lit("outcome pair").alias("text"), F.lit("normalization").alias("tier"), F.current_timestamp().alias("created_at")))
        prompts = named.withColumn("prompt", filled(OUTCOMES, a=F.col("text_a"), b=F.col("text_b")))
        return asked_twice(prompts, parse_verdict, store, digest, generate).withColumnRenamed("response_text", "response").drop("query_id", "generation_id", "from_cache")

    return judge


def traced_stage(store: TraceStore, stage: str, questions: DataFrame, found: DataFrame, filters: str = "none") -> DataFrame:
    """Runs a stage of retrieval for a batch of questions, logs a step and its hits for each, and returns its rows as a written table.

    The questions share the stage, so each has its share of the stage's time.
    """
    began = time.perf_counter()
    rows = _kept(found, store)
    took, n = (time.perf_counter() - began) * 1000, max(1, questions.count())
    place = F.row_number().over(Window.partitionBy(F.pmod("query_id", F.lit(64))).orderBy("query_id"))
    steps = questions.select("query_id").distinct().withColumn("step_id", F.lit(new_id()) + place * 64 + F.pmod("query_id", F.lit(64)))
    steps = _kept(steps, store)
    store.append("retrieval_step", steps.select("step_id", "query_id", F.lit(stage).alias("stage"), F.lit(took / n).alias("latency_ms"), F.lit(filters).alias("filters_applied"), F.current_timestamp().alias("created_at")))
    have = rows.columns
    if "chunk_id" in have and "rank" in have:
        text = lambda c: (F.col(c) if c in have else F.lit(None)).cast("string").alias(c)
        score = F.col("score") if "score" in have else 1 - F.col("distance") if "distance" in have else F.lit(None)
        store.append("chunk_hit", rows.join(steps, "query_id").select("step_id", F.col("chunk_id").cast("string").alias("chunk_id"), (F.col("rank") - 1).cast("int").alias("rank"), score.cast("double").alias("score"), *map(text, ("nct_id", "doc_type", "section", "page_range"))))
    return rows


def traced_ladder(chunks: DataFrame, index: DataFrame, questions: DataFrame, store: TraceStore, score: Callable[[Column, Column], Column] | None = None, k: int = retrieval.TOP, filters: retrieval.QueryFilters | None = None, match: str | None = None) -> DataFrame:
    """``query_id, chunk_id, rank, text`` by the whole ladder, with a step in the trace for prefilter, dense, bm25, rrf and, with a ``score``, rerank."""
    shown = filters.describe() if filters else f"{match} of the question" if match else "none"
    items = chunks if filters is None else chunks.where(filters.condition())
    if filters is not None:
        index = index.join(items.select("chunk_id"), "chunk_id", "left_semi")
    if match and match not in index.columns:
        index = index.join(items.select("chunk_id", match), "chunk_id")
    traced_stage(store, "prefilter", questions, questions.select("query_id"), shown)
    dense = traced_stage(store, "dense", questions, retrieval.dense_search(items, questions, retrieval.CANDIDATES, match=match), shown)
    lexical = traced_stage(store, "bm25", questions, retrieval.lexical_search(index, questions, retrieval.CANDIDATES, match=match), shown)
    fused = retrieval.reciprocal_rank_fusion([dense, lexical]).where(F.col("rank") <= (retrieval.CANDIDATES if score else k))
    fused = traced_stage(store, "rrf", questions, fused, shown)
    texts = fused.select("query_id", "chunk_id", "rank").join(chunks.select("chunk_id", "text"), "chunk_id")
    return traced_stage(store, "rerank", questions, retrieval.rerank(texts, questions, score, k), shown) if score else texts
