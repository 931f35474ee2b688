"""Models behind plain protocols, with repeatable stand-ins that need no weights.

A real model is passed in as the same kind of callable; it is loaded once per worker by ``per_worker``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

DIMENSION = 64
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


class Embedder(Protocol):
    def encode(self, texts: list[str]) -> list[list[float]]: ...


class Generator(Protocol):
    def generate(self, prompt: str) -> str: ...


_HELD: dict[str, Any] = {}


def per_worker(name: str, make: Callable[[], Any]) -> Any:
    """The object ``make`` gives, made once in each Python worker."""
    if name not in _HELD:
        _HELD[name] = make()
    return _HELD[name]


def embed_with(make: Callable[[], Embedder], name: str = "embedder") -> Callable[[Column], Column]:
    """An Arrow-batched embedding function of a model that every worker loads once."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held: Any = None
        for texts in batches:
            held = held or make()
            yield pd.Series([list(map(float, v)) for v in held.encode(texts.fillna("").tolist())])

    return embed


def hash_embedding(text: Column, dimension: int = DIMENSION) -> Column:
    """A stand-in embedding: counts of hashed tokens, signed by the hash. Runs as column functions."""
    h = F.transform(T.tokens(F.lower(text)), lambda t: F.xxhash64(t))
    at = lambda i: F.aggregate(F.filter(h, lambda x: F.pmod(x, F.lit(dimension)) == i), F.lit(0.0), lambda acc, x: acc + F.when(x >= 0, 1.0).otherwise(-1.0))
    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: at(i).cast("float"))


def overlap_score(query: Column, text: Column) -> Column:
    """A stand-in reranker: the share of the query's words that the text holds."""
    q, t = F.array_distinct(T.tokens(T.normalize_text(query))), T.tokens(T.normalize_text(text))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(0.0)


def rule_judge(rows: DataFrame) -> DataFrame:
    """A stand-in judge of outcome pairs: token overlap, at 0.8 or more a match, under 0.4 a divergence, else ambiguous."""
    a, b = (F.array_distinct(T.tokens(T.normalize_text(F.col(c)))) for c in ("text_a", "text_b"))
    share = F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    return rows.withColumn("response", F.concat(F.lit("VERDICT: "), F.when(share >= 0.8, "match").when(share < 0.4, "divergence").otherwise("ambiguous")))


def extractive_answer(question: Column, texts: Column) -> Column:
    """A stand-in generator: cites the excerpt that holds most of the question's words, or refuses."""
    scores = F.transform(texts, lambda t: overlap_score(question, t))
    best = F.array_max(scores)
    at = F.array_position(scores, best)
    body = T.snippet(F.element_at(texts, at.cast("int")), 200)
    return F.when((F.size(texts) > 0) & (best >= 0.5), F.concat(body, F.lit(" ["), at.cast("string"), F.lit("]"))).otherwise(T.REFUSAL)


def prompted(respond: Callable[[Column, Column], Column] = extractive_answer) -> Callable[[Column], Column]:
    """``respond(question, texts)`` as a function of an answer's prompt, from which question and excerpts are read back."""

    def of_prompt(prompt: Column) -> Column:
        texts = F.regexp_extract_all(prompt, F.lit(r"(?s)(?<=\n\n)\[\d+\]\n(.*?)(?=\n\n\[\d+\]\n|\n\nQuestion: )"), F.lit(1))
        return respond(F.regexp_extract(prompt, r"(?s)\n\nQuestion: (.*?)\n\nCite the excerpt", 1), texts)

    return of_prompt


class DigestMismatch(ValueError):
    """A model is not the one that was pinned."""


def verify_digest(found: str, expected: str) -> None:
    """Raises if two digests differ, with or without their ``sha256:`` prefix."""
    if found.removeprefix("sha256:") != expected.removeprefix("sha256:"):
        raise DigestMismatch(f"expected {expected}, found {found}")
