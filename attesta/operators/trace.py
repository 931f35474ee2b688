"""The trace of queries: append-only Parquet tables, and probes of what was generated before."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TRACE


def prompt_hash(digest: Column, prompt: Column) -> Column:
    return F.sha2(F.concat_ws(":", digest, prompt), 256)


def new_id() -> int:
    """A positive id that rises with time and is unlikely to be given twice, without asking a counter."""
    return (time.time_ns() // 1_000_000 << 20) | (uuid.uuid4().int & 0xFFFFF)


class TraceStore:
    """Writes the five trace tables under ``path``; every write appends files and ids need no lock."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        reader = self.spark.read.schema(TRACE[name])
        try:
            return reader.parquet(f"{self.path}/{name}")
        except Exception as e:  # nothing was written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], TRACE[name])

    def append(self, name: str, rows: list[tuple] | DataFrame) -> None:
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, TRACE[name])
        df.write.mode("append").parquet(f"{self.path}/{name}")

    def _now(self):
        import datetime

        return datetime.datetime.now()

    def log_query(self, text: str, tier: str | None = None) -> int:
        id_ = new_id()
        self.append("query", [(id_, text, tier, self._now())])
        return id_

    def log_retrieval_step(self, query_id: int, stage: str, latency_ms: float, filters: str = "none") -> int:
        id_ = new_id()
        self.append("retrieval_step", [(id_, query_id, stage, float(latency_ms), filters, self._now())])
        return id_

    def log_hits(self, step_id: int, hits: DataFrame) -> None:
        """Hits ``(chunk_id, rank, score, ...)`` of a step; ranks in the trace start at 0."""
        have = set(hits.columns)
        cols = {c: F.col(c) if c in have else F.lit(None) for c in ("chunk_id", "score", "nct_id", "doc_type", "section", "page_range")}
        df = hits.select(F.lit(step_id).alias("step_id"), cols["chunk_id"].cast("string").alias("chunk_id"), (F.col("rank") - 1).cast("int").alias("rank"), cols["score"].cast("double").alias("score"), *[cols[c].cast("string").alias(c) for c in ("nct_id", "doc_type", "section", "page_range")])
        self.append("chunk_hit", df)

    def log_generation(self, query_id: int, digest: str, hash_: str, response: str, latency_ms: float, tokens: int, tokens_in: int, from_cache: bool) -> int:
        id_ = new_id()
        self.append("generation", [(id_, query_id, digest, hash_, response, float(latency_ms), tokens, self._now())])
        self.append("cost_record", [(id_, tokens_in, tokens, float(latency_ms), from_cache)])
        return id_

    def find_generation(self, digest: str, hash_: str) -> dict[str, Any] | None:
        """The latest generation of a prompt by a model, with its cost."""
        g = self.table("generation").where((F.col("model_digest") == digest) & (F.col("prompt_hash") == hash_)).orderBy(F.desc("generation_id")).limit(1)
        row = g.join(self.table("cost_record"), "generation_id", "left").first()
        return row.asDict() if row else None

    def usage(self) -> DataFrame:
        """Tokens per model that were really generated; answers from the cache do not count again."""
        return self.table("generation").join(self.table("cost_record"), "generation_id").where("NOT from_cache").groupBy("model_digest").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))

    @contextmanager
    def step(self, query_id: int, stage: str, filters: str = "none") -> Iterator[dict]:
        """Times a stage and logs it, with the hits put into the yielded dict, also when it fails."""
        held: dict = {"hits": None}
        began = time.perf_counter()
        try:
            yield held
        finally:
            id_ = self.log_retrieval_step(query_id, stage, (time.perf_counter() - began) * 1000, filters)
            if held["hits"] is not None:
                self.log_hits(id_, held["hits"])
