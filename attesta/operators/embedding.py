"""Embedding with a cache, and loading chunks with their vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CHUNK_TYPES
from .relational import upsert


def chunk_id(nct_id: Column, doc_label: Column, index: Column) -> Column:
    return F.concat_ws(":", nct_id, doc_label, index.cast("string"))


def cache_key(revision: str, id_: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(revision), id_, text), 256)


def valid_chunks(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks that hold to the schema, and the others with ``error``."""
    error = (
        F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty text")
        .when(F.col("chunk_index").isNull() | (F.col("chunk_index") < 0), "chunk_index below 0")
        .when(F.col("page_start") > F.col("page_end"), "page range out of order")
        .when(~F.coalesce(F.col("chunk_type").isin(*CHUNK_TYPES), F.lit(False)), "unknown chunk_type")
    )
    marked = chunks.withColumn("error", error)
    return marked.where("error is null").drop("error"), marked.where("error is not null")


def embedded(chunks: DataFrame, cache: DataFrame | None, embed: Callable[[Column], Column], revision: str) -> DataFrame:
    """``chunk_id, cache_key, embedding, from_cache``: vectors from the cache where revision, id and text are as they were, else from the model.

    Only misses reach the model. Of repeated cache keys any one counts, as they stand for the same text.
    """
    keyed = chunks.where(F.trim("text") != "").select("chunk_id", "text", cache_key(revision, F.col("chunk_id"), F.col("text")).alias("cache_key"))
    if cache is None:
        return keyed.select("chunk_id", "cache_key", embed(F.col("text")).alias("embedding"), F.lit(False).alias("from_cache"))
    known = cache.select("cache_key", "embedding").dropDuplicates(["cache_key"])
    hits = keyed.join(known, "cache_key").select("chunk_id", "cache_key", "embedding", F.lit(True).alias("from_cache"))
    misses = keyed.join(known, "cache_key", "left_anti").select("chunk_id", "cache_key", embed(F.col("text")).alias("embedding"), F.lit(False).alias("from_cache"))
    return hits.unionByName(misses)


def loaded(old: DataFrame | None, chunks: DataFrame, embeddings: DataFrame, trials: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunk table after loading, and one row of counts; chunks of unknown trials are skipped, those without a vector keep null."""
    with_vectors = chunks.join(embeddings.select("chunk_id", "embedding"), "chunk_id", "left").withColumn("page_range", F.concat_ws("-", F.col("page_start").cast("string"), F.col("page_end").cast("string")))
    known = with_vectors.join(trials.select("nct_id").distinct(), "nct_id", "left_semi")
    counts = with_vectors.join(trials.select("nct_id", F.lit(True).alias("_known")).distinct(), "nct_id", "left").agg(
        F.count_if(F.col("_known")).alias("loaded"), F.count_if(F.col("_known") & F.col("embedding").isNull()).alias("missing_embedding"), F.count_if(F.col("_known").isNull()).alias("skipped")
    )
    return (known if old is None else upsert(old, known, ["chunk_id"])), counts
