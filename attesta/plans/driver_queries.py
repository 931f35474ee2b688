"""Queries over the driver's tables, each with its SQL where SQL can express it.

The tables hold no registry data, so every operator runs on an analogue; queries cover whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as T
from ..functions.vectors import cosine_distance  # noqa: F401  (part of the public surface)
from ..operators import chunking, compare, embedding, metrics, relational, retrieval

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_COS = "list_cosine_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _queries(e: DataFrame, every: int = 20) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20."""
    return e.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("label").alias("q_label"))


def _dense(spark, sf_dir, k: int) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return retrieval.dense_search(e, _queries(e), k, "vec_id")


@query(f"""
SELECT query_id, vec_id, round(d, 6) AS distance, rank::INT AS rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id, {_COS} AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS}, e.vec_id) AS rank
  FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= 10""")
def dense_topk(spark, sf_dir):
    """Ten nearest vectors of each query vector."""
    return _dense(spark, sf_dir, 10).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


@query(f"""
SELECT query_id, vec_id, round(d, 6) AS distance, rank::INT AS rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id, {_COS} AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS}, e.vec_id) AS rank
  FROM embeddings e JOIN embeddings q ON e.label = q.label WHERE q.vec_id % 20 = 0) WHERE rank <= 10""")
def dense_prefilter_topk(spark, sf_dir):
    """Ten nearest vectors among those with the query's label."""
    e = table(spark, sf_dir, "embeddings")
    q = _queries(e).withColumnRenamed("q_label", "label")
    return retrieval.dense_search(e, q, 10, "vec_id", match="label").select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


@query(f"""
WITH r AS (SELECT * FROM (
  SELECT q.vec_id AS query_id, e.vec_id, e.label = q.label AS hit, q.label AS ql,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS}, e.vec_id) AS rank
  FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= 20),
g AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
m AS (SELECT query_id, any_value(n) AS n,
  count(*) FILTER (hit AND rank <= 1) AS h1, count(*) FILTER (hit AND rank <= 5) AS h5, count(*) FILTER (hit AND rank <= 10) AS h10, count(*) FILTER (hit) AS h20,
  coalesce(1.0 / min(rank) FILTER (hit), 0) AS rr, coalesce(sum(1 / log2(rank + 1)) FILTER (hit AND rank <= 10), 0) AS dcg
  FROM r JOIN g ON g.label = r.ql GROUP BY query_id)
SELECT count(*)::BIGINT AS questions, round(avg(h1 / n), 6) AS recall_1, round(avg(h5 / n), 6) AS recall_5, round(avg(h10 / n), 6) AS recall_10, round(avg(h20 / n), 6) AS recall_20,
  round(avg(h1 / 1.0), 6) AS precision_1, round(avg(h5 / 5.0), 6) AS precision_5, round(avg(h10 / 10.0), 6) AS precision_10, round(avg(h20 / 20.0), 6) AS precision_20,
  round(avg(rr), 6) AS mrr, round(avg(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 1 + least(n, 10)) t(i))), 6) AS ndcg_10 FROM m""")
def retrieval_metrics(spark, sf_dir):
    """Recall, precision, MRR and nDCG of dense search; gold are the vectors of the query's label."""
    e = table(spark, sf_dir, "embeddings")
    labels = e.select("vec_id", "label")
    found = _dense(spark, sf_dir, 20).join(labels, "vec_id").join(_queries(e).select("query_id", "q_label"), "query_id")
    gold = _queries(e).join(labels.groupBy("label").agg(F.count(F.lit(1)).alias("n_gold")), F.col("q_label") == F.col("label")).select("query_id", "n_gold")
    scored = metrics.score_ranked(found.select("query_id", "rank", (F.col("label") == F.col("q_label")).alias("hit")), gold)
    return scored.select("questions", *[F.round(c, 6).alias(c) for c in scored.columns if c != "questions"])


def _stem_sql(w: str) -> str:
    """The light stemmer in SQL; look-behinds become groups that are put back."""
    for pattern, new in (("([a-z]{3})sses$", r"\1ss"), ("([a-z]{2})ies$", r"\1y"), ("([a-z]{2}[^s])s$", r"\1"), ("([a-z]{3})(ing|ed|ly)$", r"\1")):
        w = f"regexp_replace({w}, '{pattern}', '{new}')"
    return w


_STOPS = ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS)


def _lexical_sql(texts: str, queries: str, extra: str = "") -> str:
    """CTEs ``h`` (hits of documents with all terms) and ``s`` (scores by cover density), of ``texts (id, text)`` and ``queries (query_id, text)``.

    A hit is the last of its term up to the next one; the cover that starts there ends where all earlier hits are no
    longer the last of theirs and every term was seen, if that is before the hit's own next one.
    """
    words = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
    return rf"""
dw AS (SELECT id, unnest({words}) AS w, generate_subscripts({words}, 1) AS pos FROM ({texts})),
qw AS (SELECT query_id, unnest({words}) AS w FROM ({queries})),
dt AS (SELECT id, pos, {_stem_sql('w')} AS term FROM dw WHERE w NOT IN ({_STOPS})),
qt AS (SELECT DISTINCT query_id, {_stem_sql('w')} AS term FROM qw WHERE w NOT IN ({_STOPS})),
need AS (SELECT query_id, count(*) AS need FROM qt GROUP BY 1),
full_ AS (SELECT query_id, id FROM dt JOIN qt USING (term) {extra} GROUP BY query_id, id HAVING count(DISTINCT term) = (SELECT need FROM need n WHERE n.query_id = qt.query_id)),
h AS (SELECT f.query_id, f.id, term, pos, row_number() OVER (PARTITION BY f.query_id, f.id ORDER BY pos) AS i,
  lead(pos) OVER (PARTITION BY f.query_id, f.id, term ORDER BY pos) AS nxt, min(pos) OVER (PARTITION BY f.query_id, f.id, term) AS seen FROM full_ f JOIN qt ON qt.query_id = f.query_id JOIN dt USING (id, term)),
c AS (SELECT *, greatest(pos, max(seen) OVER (PARTITION BY query_id, id), coalesce(max(coalesce(nxt, 1000000000)) OVER (PARTITION BY query_id, id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS e FROM h),
s AS (SELECT c.query_id, c.id, round_even(sum(0.1::DOUBLE / (1 + (e - c.pos + 1) - (h.i - c.i + 1))), 9) AS score FROM c JOIN h ON h.query_id = c.query_id AND h.id = c.id AND h.pos = e WHERE e < coalesce(c.nxt, 1000000000) GROUP BY 1, 2)"""


def _items_as_queries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


@query(r"""
WITH q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM benchmark),
w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term, generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), 1) AS pos FROM documents),
k AS (SELECT * FROM q WHERE term NOT IN (""" + _STOPS + r""")),
h AS (SELECT query_id, doc_id, term, count(*) AS n, min(pos) AS first FROM w JOIN k USING (term) GROUP BY ALL),
need AS (SELECT query_id, count(*) AS need FROM k GROUP BY query_id)
SELECT query_id, doc_id, sum(n)::BIGINT AS matches, min(first)::INT AS first_position
FROM h JOIN need USING (query_id) GROUP BY query_id, doc_id, need HAVING count(*) = need""")
def lexical_match(spark, sf_dir):
    """Documents that hold every word of a benchmark item, with number and first position of the matches; no stemming."""
    q = _items_as_queries(spark, sf_dir)
    terms = retrieval.query_terms(q, stems=False)
    index = retrieval.token_table(table(spark, sf_dir, "documents"), "doc_id", "text", stems=False, terms=terms)
    return retrieval.full_matches(index, terms, "doc_id").select(
        "query_id", "doc_id", F.aggregate("positions", F.lit(0).cast("long"), lambda acc, p: acc + F.size(p)).alias("matches"), F.array_min(F.transform("positions", F.array_min)).alias("first_position")
    )


@query("WITH " + _lexical_sql("SELECT doc_id AS id, text FROM documents", "SELECT item_id AS query_id, text FROM benchmark") + """
SELECT query_id, id AS doc_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""")
def lexical_cover_rank(spark, sf_dir):
    """Documents with all terms of a benchmark item, by cover density, ten for each item."""
    q = _items_as_queries(spark, sf_dir)
    index = retrieval.token_table(table(spark, sf_dir, "documents"), "doc_id", "text", terms=retrieval.query_terms(q))
    return retrieval.lexical_search(index, q, 10, "doc_id")


@query(f"""
WITH d AS (SELECT q.vec_id AS query_id, e.vec_id, 0 AS l, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS}, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0),
p AS (SELECT q.vec_id AS query_id, e.vec_id, 1 AS l, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS}, e.vec_id) AS rank FROM embeddings e JOIN embeddings q ON e.label = q.label WHERE q.vec_id % 20 = 0),
u AS (SELECT * FROM d WHERE rank <= 50 UNION ALL SELECT * FROM p WHERE rank <= 50),
f AS (SELECT query_id, vec_id, sum(1.0::DOUBLE / (60 + rank)) AS s, min(l * 1000 + rank) AS first FROM u GROUP BY query_id, vec_id)
SELECT query_id, vec_id, round(s, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round_even(s, 12) DESC, first, vec_id)::INT AS rank FROM f""")
def rrf_fuse(spark, sf_dir):
    """Fuses, for each query of the stated set, its fifty nearest vectors and its fifty nearest of its label."""
    e = table(spark, sf_dir, "embeddings")
    q = _queries(e).withColumnRenamed("q_label", "label")
    lists = [retrieval.dense_search(e, q, 50, "vec_id", match=m) for m in (None, "label")]
    return retrieval.reciprocal_rank_fusion(lists, "vec_id").select("query_id", "vec_id", F.round("score", 9).alias("score"), "rank")


#: What a vector asks the texts: the last two words of its document.
_ASKED = r"(?U)[\p{L}\p{N}_]+[^\p{L}\p{N}_]+[\p{L}\p{N}_]+[^\p{L}\p{N}_]*$"


def _chunks(spark, sf_dir) -> DataFrame:
    """Vectors with the documents of their ids, as chunks."""
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    return e.join(d.select(F.col("doc_id").alias("vec_id"), "text"), "vec_id").select(F.col("vec_id").alias("chunk_id"), "label", "embedding", "text")


def _asked(chunks: DataFrame) -> DataFrame:
    asked = F.regexp_extract("text", _ASKED, 0).alias("query_text")
    return chunks.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vector"), "label", asked)


_HYBRID = f"""
WITH ch AS (SELECT vec_id, label, embedding, text FROM embeddings JOIN documents ON doc_id = vec_id),
qs AS (SELECT vec_id AS query_id, regexp_extract(text, '{_ASKED[4:]}') AS text FROM ch WHERE vec_id % 20 = 0),
{_lexical_sql("SELECT vec_id AS id, text FROM ch", "SELECT * FROM qs", "JOIN ch ON ch.vec_id = dt.id JOIN ch AS qc ON qc.vec_id = qt.query_id AND qc.label = ch.label")},
d AS (SELECT q.vec_id AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS}, e.vec_id) AS rank FROM ch e JOIN ch q ON e.label = q.label WHERE q.vec_id % 20 = 0),
x AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s),
u AS (SELECT query_id, id, rank, 0 AS l FROM d WHERE rank <= 50 UNION ALL SELECT query_id, id, rank, 1 FROM x WHERE rank <= 50),
f AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS v, min(l * 1000 + rank) AS first FROM u GROUP BY query_id, id)
SELECT query_id, id AS chunk_id, round(v, 9) AS score, rank::INT AS rank FROM (SELECT query_id, id, v, row_number() OVER (PARTITION BY query_id ORDER BY round_even(v, 12) DESC, first, id) AS rank FROM f) WHERE rank <= 20"""


@query(_HYBRID)
def hybrid_ladder(spark, sf_dir):
    """Hybrid search for every query of the stated set: chunks of the query's label, dense and lexical candidates, fusion."""
    chunks = _chunks(spark, sf_dir)
    q = _asked(chunks)
    index = retrieval.token_table(chunks, "chunk_id", "text", terms=retrieval.query_terms(q))
    found = retrieval.hybrid_search(chunks, index, q, 20, match="label")
    return found.select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


@query(r"""
SELECT sha256(norm) AS text_key, count(*)::BIGINT AS n, min(doc_id) AS first_id FROM (
  SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')) AS norm FROM documents)
GROUP BY norm HAVING count(*) > 1""")
def normalize_text_dups(spark, sf_dir):
    """Groups of documents whose normal texts are equal; the key travels as a digest, not as the text."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_text(F.col("text")), 256).alias("text_key"))
    return d.groupBy("text_key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def _duration_text():
    unit = F.element_at(F.array(*[F.lit(u) for u in ("days", "weeks", "months", "years")]), F.col("p_size") % 4 + 1)
    return F.concat(F.lit("Overall survival at "), F.col("p_size").cast("string"), F.lit(" "), unit, F.lit("; again at "), F.col("p_size").cast("string"), F.lit(" "), unit)


_MONTHS = "round_even(p_size * [12.0::DOUBLE / 365, 12.0::DOUBLE / 52, 1.0::DOUBLE, 12.0::DOUBLE][p_size % 4 + 1], 2)"


@query(f"SELECT p_partkey, {_MONTHS} AS months, 1::INT AS n FROM part")
def duration_normalize(spark, sf_dir):
    """Durations in texts made from part sizes, as months."""
    p = table(spark, sf_dir, "part").withColumn("text", _duration_text())
    d = T.durations_in_months(F.col("text"))
    return p.select("p_partkey", T.timeframe_in_months(F.col("text")).alias("months"), F.size(d).alias("n"))


@query(r"""
WITH l AS (SELECT doc_id, lang || ' ' || source || ' doc' AS hay, CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN left(source, 2) WHEN 2 THEN source || ' doc' ELSE '' END AS needle FROM documents)
SELECT doc_id, CASE WHEN hay IS NULL OR needle IS NULL THEN coalesce(needle = '', false) AND false WHEN needle = '' THEN false ELSE contains(' ' || hay || ' ', ' ' || needle || ' ') END AS hit FROM l WHERE hay IS NOT NULL AND needle IS NOT NULL""")
def whole_token(spark, sf_dir):
    """Whether a document's language, the start of its source, its last two words or nothing stand in its label as a whole token."""
    hay, i = F.concat_ws(" ", "lang", "source", F.lit("doc")), F.col("doc_id") % 4
    needle = F.when(i == 0, F.col("lang")).when(i == 1, F.substring("source", 1, 2)).when(i == 2, F.concat("source", F.lit(" doc"))).otherwise("")
    d = table(spark, sf_dir, "documents").where("lang is not null and source is not null")
    return d.select("doc_id", T.contains_whole_token(needle, hay).alias("hit"))


@query(r"""
WITH t AS (SELECT p_partkey AS k, p_brand, p_type, 'Survival at ' || p_size || ' ' || ['days', 'weeks', 'months', 'years'][p_size % 4 + 1] AS x, """ + _MONTHS + r""" AS m FROM part),
o AS (SELECT a.k, a.x AS xa, b.x AS xb, a.m AS ma, b.m AS mb FROM t a JOIN t b ON b.k = a.k + 1)
SELECT CASE WHEN lower(xa) = lower(xb) THEN 'identical_text' WHEN ma = mb THEN 'timeframe_deterministic' ELSE 'judge' END AS method, count(*)::BIGINT AS n FROM o GROUP BY 1""")
def compare_cascade(spark, sf_dir):
    """Which rule decides neighbouring parts' texts: equal text, equal duration, or the judge."""
    unit = F.element_at(F.array(*[F.lit(u) for u in ("days", "weeks", "months", "years")]), F.col("p_size") % 4 + 1)
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("Survival at "), F.col("p_size").cast("string"), F.lit(" "), unit).alias("x"))
    pairs = t.join(t.select((F.col("k") - 1).alias("k"), F.col("x").alias("y")), "k")
    return pairs.groupBy(compare.cascade(F.col("x"), F.col("y"))["method"].alias("method")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH o AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1)
SELECT CASE WHEN o_custkey IS NULL THEN 'not_applicable' WHEN c_acctbal < 0 THEN 'retrieval_failed' WHEN s > 300000 THEN 'match' ELSE 'divergence' END AS state, count(*)::BIGINT AS n
FROM customer LEFT JOIN o ON o_custkey = c_custkey GROUP BY 1""")
def three_state_pairs(spark, sf_dir):
    """Customers by state: no orders, unusable balance, or graded by their orders' sum."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"))
    c = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    state = relational.three_state(F.col("o_custkey").isNotNull(), F.col("c_acctbal") < 0, F.when(F.col("s") > 300000, "match").otherwise("divergence"))
    return c.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey")
def distinct_on_first(spark, sf_dir):
    """The first order of every customer."""
    return relational.distinct_on(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("""
WITH a AS (SELECT l_orderkey AS k, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem),
b AS (SELECT o_custkey AS k, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT k, n::INT AS ordinal, l_partkey, o_orderkey FROM a JOIN b USING (k, n)""")
def positional_join(spark, sf_dir):
    """Pairs the n-th line of an order with the n-th order of the customer of that number."""
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return relational.positional_join(a, b, ["k"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], ["o_orderkey"]).select("k", "ordinal", "l_partkey", "o_orderkey")


@query("SELECT DISTINCT ON (user_id) user_id, event_id, event_type, value FROM events ORDER BY user_id, ts DESC, event_id DESC")
def upsert_latest(spark, sf_dir):
    """The last state of every user: the second half of the events written over the first."""
    e = table(spark, sf_dir, "events")
    last = lambda df: relational.distinct_on(df, ["user_id"], [F.desc("ts"), F.desc("event_id")])
    middle = e.agg(F.percentile_approx("ts", 0.5).alias("m"))
    split = e.join(F.broadcast(middle), F.lit(True))  # one row
    old, new = split.where("ts <= m").drop("m"), split.where("ts > m").drop("m")
    return relational.upsert(last(old), last(new), ["user_id"]).select("user_id", "event_id", "event_type", "value")


@query("""
WITH m AS (SELECT user_id, event_id AS start, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events WHERE event_type = 'signup'),
t AS (SELECT user_id, max(event_id) + 1 AS total FROM events GROUP BY 1),
g AS (SELECT user_id, min(start) AS s FROM m GROUP BY 1)
SELECT user_id, start AS range_start, greatest(start, coalesce(nxt, total) - 1) AS range_end FROM m JOIN t USING (user_id)
UNION ALL SELECT user_id, 0, s - 1 FROM g WHERE s > 0""")
def sections_lead(spark, sf_dir):
    """Signups as section markers of a user's events."""
    e = table(spark, sf_dir, "events")
    total = e.groupBy("user_id").agg((F.max("event_id") + 1).alias("total"))
    m = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("start"), "ts").join(total, "user_id")
    return relational.sections_from_markers(m, ["user_id"], "start", ["ts", "start"], "total").select("user_id", "range_start", "range_end")


@query("""
WITH a AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a)
SELECT user_id, run::BIGINT AS run, any_value(event_type) AS event_type, min(event_id) AS run_start, max(event_id) AS run_end, count(*)::BIGINT AS n FROM b GROUP BY user_id, run""")
def runlength_islands(spark, sf_dir):
    """Runs of one event type per user."""
    return relational.islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", "event_id")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events""")
def propagate_last(spark, sf_dir):
    """The value of each user's last purchase so far."""
    e = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_type") == "purchase", F.col("value")))
    return relational.propagate_last(e, ["user_id"], ["ts", "event_id"], "v", "last_purchase").select("event_id", "last_purchase")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber < max(l_linenumber) OVER (PARTITION BY l_orderkey) AS superseded FROM lineitem")
def superseded_flag(spark, sf_dir):
    return relational.mark_superseded(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber", "l_partkey", "superseded")


@query("""
WITH b AS (SELECT user_id AS k, event_type, min(event_id) // 10 AS s, max(event_id) // 10 AS e FROM events GROUP BY 1, 2),
o AS (SELECT o_orderkey, o_custkey AS k, o_orderkey % 1000 AS a, o_orderkey % 1000 + 5 AS z FROM orders),
h AS (SELECT o_orderkey, event_type, row_number() OVER (PARTITION BY o_orderkey ORDER BY s, event_type) AS rn FROM o JOIN b ON o.k = b.k AND a <= e AND s <= z)
SELECT o.o_orderkey, h.event_type FROM o LEFT JOIN h ON h.o_orderkey = o.o_orderkey AND rn = 1""")
def range_join_first(spark, sf_dir):
    """For each order the first event span of the user of that number that overlaps the order's span."""
    b = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("k"), "event_type").agg(F.floor(F.min("event_id") / 10).alias("s"), F.floor(F.max("event_id") / 10).alias("e"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 1000).alias("a"), (F.col("o_orderkey") % 1000 + 5).alias("z"))
    return relational.range_join_first(o, b, ["k"], ["o_orderkey"], ("a", "z"), ("s", "e"), ["s", "event_type"], bucket=250).select("o_orderkey", "event_type")


@query("""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, w, unnest(range(0, len(w), 512)) AS s FROM t)
SELECT doc_id, (s // 512)::INT AS chunk_index, len(w[s + 1:s + 512])::BIGINT AS n_tokens, sha256(array_to_string(w[s + 1:s + 512], ' ')) AS text_key FROM c""")
def naive_chunk(spark, sf_dir):
    """Windows of 512 tokens of every document."""
    return chunking.naive_chunks(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "chunk_index", "n_tokens", F.sha2("text", 256).alias("text_key"))


@query("""
WITH RECURSIVE l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents),
b AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM l),
c AS (SELECT doc_id, i, len(list_filter(regexp_split_to_array(trim(line), '\\s+'), lambda x: x <> '')) AS n FROM b),
f(doc_id, i, grp, used) AS (SELECT doc_id, i, 0, n FROM c WHERE i = 1
  UNION ALL SELECT c.doc_id, c.i, CASE WHEN f.used + c.n > 100 THEN f.grp + 1 ELSE f.grp END, CASE WHEN f.used + c.n > 100 THEN c.n ELSE f.used + c.n END FROM f JOIN c ON c.doc_id = f.doc_id AND c.i = f.i + 1)
SELECT f.doc_id, grp::INT AS chunk_index, sum(c.n)::BIGINT AS n_tokens, count(*)::BIGINT AS n_lines FROM f JOIN c USING (doc_id, i) GROUP BY 1, 2""")
def greedy_chunk(spark, sf_dir):
    """Lines of every document packed into chunks of at most 100 tokens."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    out = chunking.greedy_chunks(table(spark, sf_dir, "documents"), "doc_id", lines, 100)
    return out.select("doc_id", "chunk_index", "n_tokens", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))


def _label_sql() -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(h, '(?i){p}') THEN '{label}'" for label, p in T.SECTION_LABELS) + " ELSE 'unclassified' END"


_HEADS = "['Synopsis', 'Study Rationale', 'Objectives', 'Trial Design', 'Inclusion Criteria', 'Study Drug', 'Visit Schedule', 'Sample Size', 'Informed Consent', 'Record Retention', 'Appendix']"


@query(f"""
WITH x AS (SELECT page_id AS id, {_HEADS}[page_id % 11 + 1] || ' of ' || url AS h FROM pages UNION ALL SELECT doc_id, {_HEADS}[doc_id % 11 + 1] || ' ' || source FROM documents)
SELECT {_label_sql()} AS label, count(*)::BIGINT AS n FROM x GROUP BY 1""")
def section_label_case(spark, sf_dir):
    """Section labels of headings made from pages and documents."""
    heads = F.array(*[F.lit(h) for h in ("Synopsis", "Study Rationale", "Objectives", "Trial Design", "Inclusion Criteria", "Study Drug", "Visit Schedule", "Sample Size", "Informed Consent", "Record Retention", "Appendix")])
    pick = lambda c: F.element_at(heads, (F.col(c) % 11 + 1).cast("int"))
    a = table(spark, sf_dir, "pages").select(F.concat(pick("page_id"), F.lit(" of "), "url").alias("h"))
    b = table(spark, sf_dir, "documents").select(F.concat(pick("doc_id"), F.lit(" "), "source").alias("h"))
    return a.unionByName(b).groupBy(F.coalesce(T.section_label(F.col("h")), F.lit(T.UNCLASSIFIED)).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH s AS (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL),
q AS (SELECT *, n / sum(n) OVER () * least(200, sum(n) OVER ()) AS raw, least(200, sum(n) OVER ()) AS want FROM s),
b AS (SELECT *, floor(raw) AS base, row_number() OVER (ORDER BY raw - floor(raw) DESC, c_mktsegment, c_nationkey) AS rk FROM q)
SELECT c_mktsegment, c_nationkey, n::BIGINT AS n, (base + CASE WHEN rk <= want - sum(base) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM b""")
def largest_remainder(spark, sf_dir):
    """Quotas of 200 customers over segments and nations."""
    return relational.largest_remainder(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"], 200)


@query("""
SELECT c_mktsegment, c_custkey, turn::INT AS turn FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('7:' || c_custkey), c_custkey) AS turn FROM customer)
ORDER BY turn, c_mktsegment LIMIT 100""")
def round_robin_cap(spark, sf_dir):
    """A hundred customers, taken from the segments in turn."""
    return relational.round_robin_cap(table(spark, sf_dir, "customer"), "c_mktsegment", ["c_custkey"], 100, 7).select("c_mktsegment", "c_custkey", "turn")


@query("""
WITH x AS (SELECT quality * 0.5 + toxic * 0.5 AS h, CASE WHEN doc_id % 3 = 0 THEN 0.0 WHEN doc_id % 3 = 1 THEN 0.5 ELSE 1.0 END AS j FROM labels),
a AS (SELECT h, count(*) AS n FROM x GROUP BY 1), b AS (SELECT j, count(*) AS n FROM x GROUP BY 1)
SELECT (SELECT count(*) FROM x)::BIGINT AS n, round(1 - (SELECT avg(abs(h - j)) FROM x)::DOUBLE / ((SELECT sum(abs(h - j) * a.n * b.n) FROM a, b) / power((SELECT count(*) FROM x), 2))::DOUBLE, 6) AS kappa""")
def confusion_kappa(spark, sf_dir):
    """Linear-weighted kappa of two made-up raters."""
    x = table(spark, sf_dir, "labels").select((F.col("quality") * 0.5 + F.col("toxic") * 0.5).alias("h"), ((F.col("doc_id") % 3) * 0.5).alias("j"))
    return stats.weighted_kappa(x, "h", "j").select("n", F.round("kappa", 6).alias("kappa"))




@query("""
WITH x AS (SELECT source, quality = 1 AS g, n_chars > 1500 AS p FROM labels JOIN documents USING (doc_id)),
c AS (SELECT coalesce(source, 'pooled') AS source, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) FILTER (NOT g AND NOT p) AS tn FROM x GROUP BY ROLLUP (source)),
r AS (SELECT *, tp / nullif(tp + fp, 0) AS pr, tp / nullif(tp + fn, 0) AS re, (tp + fp)::DOUBLE AS np, (tp + fn)::DOUBLE AS nr FROM c)
SELECT source, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(pr, 6) AS precision, round(re, 6) AS recall,
 round(CASE WHEN np > 0 THEN greatest(0, (pr + 1.9208 / np - 1.96 * sqrt(pr * (1 - pr) / np + 0.9604 / np / np)) / (1 + 3.8416 / np)) END, 6) AS precision_low,
 round(CASE WHEN nr > 0 THEN least(1, (re + 1.9208 / nr + 1.96 * sqrt(re * (1 - re) / nr + 0.9604 / nr / nr)) / (1 + 3.8416 / nr)) END, 6) AS recall_high,
 round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) END, 6) AS f1 FROM r""")
def prf_wilson(spark, sf_dir):
    """Precision, recall and F1 of "long means good" per source and pooled, with interval ends."""
    x = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    g, p = F.when(F.col("quality") == 1, "divergence").otherwise("match"), F.when(F.col("n_chars") > 1500, "divergence").otherwise("match")
    out = metrics.prf(x.withColumn("bucket", metrics.outcome_bucket(g, p, F.lit(False), F.lit(True))), "source")
    return out.select("source", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "precision_low", "recall_high", "f1")])


@query("SELECT event_type AS stage, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean, count(value)::BIGINT AS n FROM events GROUP BY 1")
def stage_percentiles(spark, sf_dir):
    out = stats.percentiles(table(spark, sf_dir, "events").withColumnRenamed("event_type", "stage"), ["stage"], "value", {"p50": 0.5, "p95": 0.95})
    return out.select("stage", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "mean")], "n")


@query("SELECT (n_chars // 500 * 500)::BIGINT AS bucket, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def histogram(spark, sf_dir):
    return relational.histogram(table(spark, sf_dir, "documents"), "n_chars", 500)


@query("""
WITH x AS (SELECT lang, count(*) AS docs, count(*) FILTER (n_chars >= 1000) AS long_docs, count(*) FILTER (toxic = 1) AS toxic_docs, count(toxic) AS labelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang)
SELECT lang, docs::BIGINT AS docs, long_docs::BIGINT AS long_docs, toxic_docs::BIGINT AS toxic_docs, round_even(100.0::DOUBLE * long_docs / docs, 1) AS long_pct,
 CASE WHEN toxic_docs = 0 THEN 'none' WHEN toxic_docs = labelled THEN 'all' ELSE 'some' END AS class FROM x""")
def doc_mix_report(spark, sf_dir):
    """Conditional counts and a class of three values per language."""
    x = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    g = x.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("n_chars") >= 1000).alias("long_docs"), F.count_if(F.col("toxic") == 1).alias("toxic_docs"), F.count("toxic").alias("labelled"))
    return g.select("lang", "docs", "long_docs", "toxic_docs", F.bround(F.lit(100.0) * F.col("long_docs") / F.col("docs"), 1).alias("long_pct"),
                    F.when(F.col("toxic_docs") == 0, "none").when(F.col("toxic_docs") == F.col("labelled"), "all").otherwise("some").alias("class"))


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k, coalesce((props::JSON->>'missing'), 'UNKNOWN') AS missing FROM events")
def json_props(spark, sf_dir):
    p = F.from_json("props", "k long, missing string")
    return table(spark, sf_dir, "events").select("event_id", p["k"].alias("k"), F.coalesce(p["missing"], F.lit("UNKNOWN")).alias("missing"))


@query(r"SELECT role, count(*)::BIGINT AS n, round(avg(CASE WHEN trim(regexp_replace(x, '^\s+|\s+$', '', 'g')) = 'NOT_ANSWERABLE' THEN 1.0 ELSE 0.0 END), 6) AS refusal_rate FROM (SELECT role, CASE WHEN turn % 3 = 0 THEN ' NOT_ANSWERABLE ' ELSE text END AS x FROM conversations) GROUP BY role")
def refusal_rate(spark, sf_dir):
    """Share of exact refusals per role, with every third turn made one."""
    c = table(spark, sf_dir, "conversations").withColumn("x", F.when(F.col("turn") % 3 == 0, " NOT_ANSWERABLE ").otherwise(F.col("text")))
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(T.is_refusal(F.col("x")).cast("double")), 6).alias("refusal_rate"))


@query("""
SELECT doc_id, sha256('rev1' || doc_id || text) AS cache_key, doc_id % 2 = 0 AS from_cache FROM documents WHERE trim(text, ' ') <> ''""")
def cache_key(spark, sf_dir):
    """Documents embedded with a cache that holds the even ones."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    key = embedding.cache_key("rev1", F.col("chunk_id"), F.col("text"))
    cache = d.where("cast(chunk_id as long) % 2 = 0").select(key.alias("cache_key"), F.array(F.lit(0.0).cast("float")).alias("embedding"))
    found = embedding.embedded(d, cache, lambda t: F.array(F.length(t).cast("float")), "rev1")
    return found.select(F.col("chunk_id").cast("long").alias("doc_id"), "cache_key", "from_cache")


@query("SELECT c_mktsegment, c_custkey FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('42:' || c_custkey), c_custkey) AS rn FROM customer) WHERE rn <= 8")
def stratified_sample(spark, sf_dir):
    return relational.stratified_sample(table(spark, sf_dir, "customer"), "c_mktsegment", ["c_custkey"], 8, 42).select("c_mktsegment", "c_custkey")


@query("""
SELECT event_id, (SELECT max(b.event_id) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'signup' AND b.event_id <= a.event_id) AS signup_id FROM events a WHERE event_type = 'purchase'""")
def nearest_below(spark, sf_dir):
    """For each purchase the nearest signup before it by the same user."""
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("user_id", "event_id")
    right = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("at"), F.col("event_id").alias("signup_id"))
    return relational.nearest_below(left, right, ["user_id"], ["event_id"], "event_id", "at", "signup_id").select("event_id", "signup_id")


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2)
SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS rn FROM c) WHERE rn = 1""")
def mode_first(spark, sf_dir):
    """The most frequent event type of each user, the earlier one on ties."""
    return relational.mode_first(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query("""
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS "F", count(*) FILTER (o_orderstatus = 'O')::BIGINT AS "O", count(*) FILTER (o_orderstatus = 'P')::BIGINT AS "P" FROM orders GROUP BY 1""")
def pivot_counts(spark, sf_dir):
    return relational.pivot_counts(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("""
SELECT c_custkey AS key, 'registry' AS source FROM customer WHERE c_acctbal > 5000
UNION ALL SELECT DISTINCT o_custkey, 'orders' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)""")
def priority_union(spark, sf_dir):
    """Customers with a high balance, else those with an order."""
    a = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("key"), F.lit("registry").alias("source"))
    b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.lit("orders").alias("source")).distinct()
    return relational.priority_union(a, b, ["key"])
