"""Retrieval: filters, dense and lexical search, rank fusion, the hybrid ladder, reranking, fetching."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import text as T
from ..functions.vectors import cosine_distance

RRF_K, CANDIDATES, TOP = 60, 50, 8
# How a query names a trial, a version and a kind of document.
NCT_ID, VERSION = re.compile(r"NCT\d{8}", re.I), re.compile(r"(?:amendment|version)\s+(\d+(?:\.\d+)?)", re.I)
DOC_TYPES = (("statistical analysis plan", "sap"), ("sap", "sap"), ("protocol", "protocol"))
# English words that a full-text query leaves out (the common short list).
STOP_WORDS = (
    "a", "about", "after", "all", "an", "and", "any", "are", "as", "at", "be", "been", "before", "but", "by", "can", "did", "do", "does", "for", "from", "had", "has",
    "have", "how", "i", "if", "in", "into", "is", "it", "its", "no", "not", "of", "on", "or", "so", "some", "such", "than", "that", "the", "their", "then", "there",
    "these", "they", "this", "to", "was", "were", "what", "when", "where", "which", "who", "will", "with",
)


@dataclass(frozen=True)
class QueryFilters:
    """Equality filters; those that are None do not filter."""

    nct_id: str | None = None
    doc_type: str | None = None
    doc_version: float | None = None
    section: str | None = None

    def condition(self) -> Column:
        """The conjunction as a column; Parquet scans take it as pushed filters."""
        return T.all_of([F.col(k) == v for k, v in self.__dict__.items() if v is not None])

    def describe(self) -> str:
        return ", ".join(f"{k}={v}" for k, v in self.__dict__.items() if v is not None) or "none"


def parse_query(query: str, nct_id: str | None = None) -> QueryFilters:
    """Filters that a question's words ask for; the caller's ``nct_id`` goes before the question's."""
    found, version, low = NCT_ID.search(query), VERSION.search(query), query.lower()
    kind = next((d for word, d in DOC_TYPES if word in low), None)
    return QueryFilters(nct_id if nct_id is not None else found.group(0).upper() if found else None, kind, float(version.group(1)) if version else None)


#: Queries of one matrix that is sent to the executors, and of one slice of it that is multiplied with a batch of items.
QUERY_ROWS, SLICE = 20_000, 512


def dense_search(items: DataFrame, queries: DataFrame, k: int, id_: str = "chunk_id", vector: str = "embedding", filters: QueryFilters | None = None, match: str | None = None) -> DataFrame:
    """The ``k`` nearest items of every query ``(query_id, query_vector)`` by cosine distance: ``query_id, id, distance, rank``.

    Exact, in double precision. Items without a vector are left out; ties go by id; pairs of unequal length, with a
    zero vector or a component that is null or not finite have no distance. The queries are a stated set: they go out in
    matrices of ``QUERY_ROWS``, one after the other whatever their number, items stream past each in batches, and a task
    hands on k rows a query and ties of the last. With ``match``, a column of both sides, a query only meets the items
    that have its value there; null meets null.
    """
    items = items.where(F.col(vector).isNotNull())
    if filters is not None:
        items = items.where(filters.condition())
    key = F.col(match).cast("string") if match else F.lit(None).cast("string")
    items = items.select(F.col(id_).alias("_id"), F.col(vector).cast("array<double>").alias("_v"), key.alias("_m"))
    side = queries.where(F.col("query_vector").isNotNull()).select("query_id", F.col("query_vector").cast("array<double>").alias("_q"), key.alias("_k"))
    parts = max(1, -(-side.count() // QUERY_ROWS))
    blocks = [side.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) for i in range(parts)] if parts > 1 else [side]
    scored = None
    for block in blocks:
        found = _matrix_top(items, block.toArrow(), k, side.schema["query_id"].dataType)
        scored = found if scored is None else scored.unionByName(found)
    w = Window.partitionBy("query_id").orderBy("distance", "_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumnRenamed("_id", id_)


def _rows_of(lists: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Those lists that have ``size`` finite components, not all 0: their places and unit vectors."""
    cuts = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(np.diff(cuts) == size)
    x = flat[cuts[rows][:, None] + np.arange(size)] if len(rows) else np.zeros((0, size))
    fit = np.isfinite(x).all(1) & (x != 0).any(1)
    x = x[fit]
    return rows[fit], x / np.sqrt((x * x).sum(1))[:, None]


def _matrix_top(items: DataFrame, queries: pa.Table, k: int, query_type) -> DataFrame:
    """Per task the k nearest items of every query, and those as near as the k-th, as ``query_id, _id, distance``."""
    queries = queries.combine_chunks()
    vectors = queries.column("_q").chunk(0) if queries.num_rows else pa.array([], pa.list_(pa.float64()))
    marks = queries.column("_k").to_pylist()
    codes = {m: i for i, m in enumerate(dict.fromkeys(marks))}
    groups = {}
    for n in np.unique(np.diff(vectors.offsets.to_numpy())).tolist() if len(vectors) else ():
        at, unit = _rows_of(vectors, n)
        if n and len(at):
            groups[n] = queries.column("query_id").take(pa.array(at)).combine_chunks(), unit, np.array([codes[marks[i]] for i in at.tolist()])
    shared = items.sparkSession.sparkContext.broadcast((groups, codes))  # about QUERY_ROWS vectors at most
    schema = StructType([StructField("query_id", query_type), StructField("_id", items.schema["_id"].dataType), StructField("distance", DoubleType())])
    arrow = to_arrow_schema(schema)

    def nearest(query, distance):
        """Places of the k least distances of each query and of those equal to the k-th."""
        order = np.lexsort((distance, query))
        q, d = query[order], distance[order]
        first = np.searchsorted(q, q, "left")
        last = np.minimum(first + k - 1, np.searchsorted(q, q, "right") - 1)
        return order[d <= d[last]]

    def run(batches):
        groups, codes = shared.value
        held: dict = {n: ([], [], []) for n in groups}

        def packed(n):
            q, d, ids = (held[n][0], held[n][1], held[n][2])
            if not q:
                return None
            q, d, ids = np.concatenate(q), np.concatenate(d), pa.concat_arrays(ids)
            best = nearest(q, d)
            return q[best], d[best], ids.take(pa.array(best))

        for batch in batches:
            mark = np.array([codes.get(m, -1) for m in batch.column("_m").to_pylist()])
            for n, (names, matrix, keys) in groups.items():
                rows, x = _rows_of(batch.column("_v"), n)
                for a in range(0, len(matrix) if len(rows) else 0, SLICE):
                    d = 1 - x @ matrix[a : a + SLICE].T
                    d[mark[rows][:, None] != keys[a : a + SLICE]] = np.inf
                    if len(rows) > k:
                        near = d <= np.partition(d, k - 1, axis=0)[k - 1]
                        item, query = np.nonzero(near & np.isfinite(d))
                    else:
                        item, query = np.nonzero(np.isfinite(d))
                    held[n][0].append(query + a)
                    held[n][1].append(d[item, query])
                    held[n][2].append(batch.column("_id").take(pa.array(rows[item])))
                if sum(map(len, held[n][0])) > 4 * k * len(matrix) + 100_000:
                    held[n] = tuple([c] for c in packed(n))
        for n, (names, _, _) in groups.items():
            best = packed(n)
            if best is not None:
                for a in range(0, len(best[0]), 50_000):
                    q, d, ids = (c[a : a + 50_000] for c in best)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), ids, pa.array(d)], schema=arrow)

    return items.mapInArrow(run, schema)


def stem(word: Column) -> Column:
    """A light English stem: plural, past and -ing endings and -ly are cut where enough of the word stays."""
    s = F.regexp_replace(word, r"(?<=[a-z]{3})(sses)$", "ss")
    s = F.regexp_replace(s, r"(?<=[a-z]{2})ies$", "y")
    s = F.regexp_replace(s, r"(?<=[a-z]{2}[^s])s$", "")
    s = F.regexp_replace(s, r"(?<=[a-z]{3})(ing|ed|ly)$", "")
    return s


WORD = r"(?U)[\p{L}\p{N}_]+"


def lexemes(items: DataFrame, id_: list[str], text: str, stems: bool = True) -> DataFrame:
    """One row ``(id, position, term)`` per word of a text; stop words have none but count in the positions, from 1."""
    words = items.select(*id_, F.posexplode(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))).alias("position", "term"))
    kept = words.where(~F.col("term").isin(*STOP_WORDS)).withColumn("position", F.col("position") + 1)
    return kept.withColumn("term", stem(F.col("term"))) if stems else kept


def token_table(items: DataFrame, id_: str, text: str, stems: bool = True, terms: DataFrame | None = None) -> DataFrame:
    """``id, term, positions``: the inverted index as a table, to be written sorted by term; with ``terms (term)``, only for these.

    Words that nobody asks for go before anything is grouped, so with ``terms`` only their rows are shuffled.
    """
    found = lexemes(items, [id_], text, stems)
    if terms is not None:
        found = found.join(terms.select("term").distinct(), "term", "left_semi")
    return found.groupBy(id_, "term").agg(F.array_sort(F.collect_list("position")).alias("positions"))


def query_terms(queries: DataFrame, stems: bool = True, also: tuple[str, ...] = ()) -> DataFrame:
    """Distinct ``(query_id, term)`` of ``queries (query_id, query_text)``, with the columns in ``also``."""
    return lexemes(queries, ["query_id", *also], "query_text", stems).select("query_id", *also, "term").distinct()


def cover_density(positions: Column) -> Column:
    """Cover density of ``array<array<int>>``, one array of positions per query term: 0.1 per minimal cover, over the words in it that are not query terms, plus 1.

    One sweep over all positions in order. The cover that ends at a position starts at the earliest of the terms' last
    places up to it; it is minimal if no cover that ended before starts there. The state holds the place in the sweep
    at which each term was last seen.
    """
    tagged = F.flatten(F.transform(positions, lambda p, t: F.transform(p, lambda x: F.struct(x.alias("at"), t.alias("term")))))
    start = F.struct(
        F.transform(positions, lambda p: F.lit(-1)).alias("last"), F.lit(-1).alias("before"), F.lit(0).alias("i"), F.lit(0.0).cast("double").alias("score"),
        F.transform(positions, lambda p: F.lit(0)).alias("where"),
    )

    def step(acc, e):
        last = F.transform(acc["last"], lambda x, t: F.when(t == e["term"], acc["i"]).otherwise(x))
        where = F.transform(acc["where"], lambda x, t: F.when(t == e["term"], e["at"]).otherwise(x))
        first, begin = F.array_min(last), F.array_min(where)
        # words of the cover that are no query terms
        other = (e["at"] - begin + 1) - (acc["i"] - first + 1)
        more = F.when((first >= 0) & (first > acc["before"]), F.lit(0.1).cast("double") / (1 + other)).otherwise(F.lit(0.0).cast("double"))
        return F.struct(last.alias("last"), F.greatest(acc["before"], first).alias("before"), (acc["i"] + 1).alias("i"), (acc["score"] + more).alias("score"), where.alias("where"))

    return F.aggregate(F.array_sort(tagged), start, step, lambda acc: acc["score"])


def full_matches(index: DataFrame, terms: DataFrame, id_: str = "chunk_id", match: str | None = None) -> DataFrame:
    """Items with every term of a query, from distinct ``terms (query_id, term)``: ``query_id, id, positions`` with one array a term.

    Candidates of a query are the items with its rarest term; only for them are the other terms looked up.
    """
    also = [match] if match else []
    common = index.groupBy("term").agg(F.count(F.lit(1)).alias("items"))
    rarest = terms.join(common, "term", "left").groupBy("query_id", *also).agg(
        F.min_by("term", F.struct(F.coalesce("items", F.lit(0)), "term")).alias("term"), F.count(F.lit(1)).alias("need")
    )
    candidates = index.select(id_, "term", *also).join(rarest, ["term", *also]).select("query_id", id_, "need")
    wanted = candidates.join(terms.select("query_id", "term"), "query_id")
    hits = index.select(id_, "term", "positions").join(wanted, [id_, "term"])
    found = hits.groupBy("query_id", id_).agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need"), F.collect_list("positions").alias("positions"))
    return found.where("n = need").select("query_id", id_, "positions")


def lexical_search(index: DataFrame, queries: DataFrame, k: int, id_: str = "chunk_id", stems: bool = True, match: str | None = None) -> DataFrame:
    """Items with every term of a query ``(query_id, query_text)``, by cover density: ``query_id, id, score, rank``.

    ``index`` is a ``token_table``. A query without a term finds nothing; ties go by id. With ``match``, a column of both
    sides, a query only meets the items that have its value there.
    """
    found = full_matches(index, query_terms(queries, stems, (match,) if match else ()), id_, match)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), id_)
    scored = found.select("query_id", id_, F.bround(cover_density(F.col("positions")), 9).alias("score"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def reciprocal_rank_fusion(rankings: Iterable[DataFrame], id_: str = "chunk_id", k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) over rankings ``(query_id, id, rank)`` with ranks from 1: ``query_id, id, score, rank``.

    Union and one map-side sum in place of a full outer join. Ties keep the order of first sight: the earlier ranking, then the rank in it.
    """
    parts = [r.select("query_id", id_, "rank", F.lit(i).alias("_list")) for i, r in enumerate(rankings)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    fused = rows.groupBy("query_id", id_).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("_list", "rank")).alias("_first"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.bround("score", 12)), "_first", id_)
    return fused.withColumn("rank", F.row_number().over(w)).drop("_first")


def hybrid_search(items: DataFrame, index: DataFrame, queries: DataFrame, k: int, filters: QueryFilters | None = None, candidates: int = CANDIDATES, id_: str = "chunk_id", match: str | None = None) -> DataFrame:
    """Dense and lexical candidates of the filtered items, fused, cut to ``k``.

    ``filters`` are one condition for all queries; ``match`` names a column of items and queries that has to agree, such as the trial, so
    that a batch of questions on many trials is one search.
    """
    if filters is not None and filters != QueryFilters():
        items = items.where(filters.condition())
        index = index.join(items.select(id_), id_, "left_semi")
    if match and match not in index.columns:
        index = index.join(items.select(id_, match), id_)
    parts = [dense_search(items, queries, candidates, id_, match=match), lexical_search(index, queries, candidates, id_, match=match)]
    fused = reciprocal_rank_fusion(parts, id_)
    return fused.where(F.col("rank") <= k)


def fetch(items: DataFrame, ranked: DataFrame, id_: str = "chunk_id", text: str = "text") -> DataFrame:
    """Texts of ranked ids, in rank order within a query; ids that do not exist are dropped."""
    return ranked.select("query_id", id_, "rank").join(items.select(id_, text), id_).orderBy("query_id", "rank")


def rerank(candidates: DataFrame, queries: DataFrame, score: Callable[[Column, Column], Column], top: int = TOP, id_: str = "chunk_id") -> DataFrame:
    """The ``top`` candidates ``(query_id, id, rank, text)`` by ``score(query_text, text)``; ties keep the earlier rank."""
    scored = candidates.join(queries.select("query_id", "query_text"), "query_id").withColumn("score", score(F.col("query_text"), F.col("text")))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank", id_)
    return scored.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= top).select("query_id", id_, "score", F.col("new_rank").alias("rank"), "text")


LEGS = ("protocol", "registered_first", "registered_current")


def decompose(query: str, nct_id: str) -> list[tuple[str, str | None, QueryFilters | None]]:
    """Legs of a question across sources: one retrieval in the protocol's objectives, two look-ups without a query."""
    return [("protocol", query, QueryFilters(nct_id, "protocol", None, "objectives")), *((leg, None, None) for leg in LEGS[1:])]


def cross_source(trials: DataFrame, outcomes: DataFrame, protocol: DataFrame) -> DataFrame:
    """One row per trial: protocol text and first primary outcome of either registry source, with ids; null where absent.

    ``protocol`` holds ``(nct_id, chunk_id, text, rank)``.
    """
    first = outcomes.where("type = 'PRIMARY'").groupBy("nct_id").agg(
        *[F.min_by(F.struct("measure", "time_frame", "outcome_id"), F.when(F.col("source") == s, F.col("outcome_id"))).alias(s) for s in ("registered_first", "registered_current", "results_reported")],
        *[F.count_if(F.col("source") == s).alias(f"n_{s}") for s in ("registered_first", "registered_current", "results_reported")],
    )
    best = protocol.groupBy("nct_id").agg(F.min_by(F.struct("chunk_id", "text"), "rank").alias("leg"))
    row = trials.select("nct_id").join(first, "nct_id", "left").join(best, "nct_id", "left")
    cols = [F.col("leg.text").alias("protocol_leg"), F.col("leg.chunk_id").alias("protocol_chunk_id")]
    for s in ("registered_first", "registered_current", "results_reported"):
        there = F.col(f"n_{s}") > 0
        cols += [F.when(there, F.col(f"{s}.measure")).alias(s), F.when(there, F.col(f"{s}.time_frame")).alias(f"{s}_time_frame"), F.when(there, F.col(f"{s}.outcome_id")).alias(f"{s}_outcome_id")]
    return row.select("nct_id", *cols)
