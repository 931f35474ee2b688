"""Toxicity by maximum-scoring segments over token log-odds.

Tokens score their log-odds under toxic against clean documents with an informative Dirichlet prior (Monroe, Colaresi
and Quinn, "Fightin' Words", 2008), less a constant cost. A linear-time scan (Ruzzo and Tompa, 1999) finds all maximal
scoring segments of a document. Extreme-value statistics of segment scores in clean text (Karlin and Altschul, 1990)
tell which passages are significant, and a logistic function turns their sum and the best one into a probability.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, written
from .langid import held_out

#: Bound of the labelled rows that the model is learned from (its units follow from them), and the prior as a share of all counts.
SAMPLE_ROWS, PRIOR = 20_000, 0.05
#: Cost of a token; least z of a unit; prefixes that stand in for unknown words; E-value of a significant passage.
COST, LEAST_Z, PREFIXES, SIGNIFICANT = 0.7, 3.0, (5, 4), 0.05
THRESHOLD = 0.3
BINS = np.arange(-8, 8.25, 0.25)
_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def units(word: str) -> list[str]:
    """The word, and for longer words its prefixes, marked by a star: the most specific one that the model knows counts."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


class Weights(dict):
    """Log-odds of words by the model's units; words looked up are remembered, up to a bound."""

    def __init__(self, model: dict[str, float]):
        super().__init__()
        self.model = model

    def __missing__(self, word):
        if len(self) > 300_000:
            self.clear()
        value = 0.0
        for u in units(word):
            if u in self.model:
                value = self.model[u]
                break
        self[word] = value
        return value


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)`` of a sequence, in linear time; end is exclusive."""
    total = np.cumsum(scores)
    stack: list[list] = []  # start, end, sum before it, sum after it, the nearest earlier one with a lesser sum before it
    for i in np.flatnonzero(scores > 0).tolist():
        right = float(total[i])
        left = right - float(scores[i])
        new = [i, i + 1, left, right, -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            new[4] = j
            if j < 0 or stack[j][3] >= new[3]:
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3], -1]
            del stack[j:]
    return [(s, e, r - l) for s, e, l, r, _ in stack]


def learned_units(pairs: list[tuple[str, int, int]], n1: int, n0: int) -> dict[str, float]:
    """Log-odds of units ``(unit, toxic count, clean count)``, for those with a z of ``LEAST_Z`` or more, whatever the mix of labels.

    Other words that hide under a known prefix get 0, so that the prefix doesn't speak for them.
    """
    whole = n1 + n0
    prior = PRIOR * whole
    model: dict[str, float] = {}
    rest = []
    for unit, y1, y0 in pairs:
        a = prior * (y1 + y0) / max(whole, 1)
        d = math.log((y1 + a) / (n1 + prior - y1 - a)) - math.log((y0 + a) / (n0 + prior - y0 - a))
        if abs(d) / math.sqrt(1 / (y1 + a) + 1 / (y0 + a)) >= LEAST_Z:
            model[unit] = d
        else:
            rest.append(unit)
    for unit in rest:
        if not unit.endswith("*") and any(u in model for u in units(unit)[1:]):
            model[unit] = 0.0
    return model


def decay(share: np.ndarray, values: np.ndarray) -> float:
    """The positive root of sum(share * exp(root * value)) = 1, by bisection; 1 where there is none."""
    f = lambda x: float((share * np.exp(x * values)).sum()) - 1
    if not ((values > 0) & (share > 0)).any() or float((share * values).sum()) >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def evidence(found: list[float], n: int, lam: float, log_k: float) -> list[float]:
    """Extreme-value features of a document: best normalised score, sum of the significant ones, their log count."""
    size = math.log(max(n, 1))
    e = [lam * s - log_k - size for s in found]
    best = max(e, default=-log_k - size)
    good = [x for x in e if math.exp(-min(x, 50)) <= SIGNIFICANT]
    return [max(-10.0, min(best, 30.0)), min(sum(good), 60.0) / 4, math.log1p(len(good))]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, the last one the intercept, by Newton's method."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Weights of units, decay and size constant of clean segment scores, and the logistic function's weights."""

    def __init__(self, weights: dict[str, float], lam: float = 1.0, log_k: float = 0.0, final=(0.0, 0.0, 0.0, 0.0)):
        self.weights, self.lam, self.log_k, self.final = weights, lam, log_k, [float(x) for x in final]
        self._lookup: Weights | None = None

    def scan(self, text: str | None) -> tuple[int, np.ndarray, list[tuple[int, int, float]]]:
        if self._lookup is None:
            self._lookup = Weights(self.weights)
        words = tokens(text)
        values = np.array(list(map(self._lookup.__getitem__, words)), dtype=float)
        met: dict[str, int] = {}
        for i in np.flatnonzero(values > 0).tolist():  # words come in bursts: the n-th time says an n-th
            n = met[words[i]] = met.get(words[i], 0) + 1
            values[i] /= n
        return len(words), values, segments(values - COST) if len(words) else []

    def score(self, n: int, found: list[tuple[int, int, float]]) -> float:
        x = [*evidence([s for _, _, s in found], n, self.lam, self.log_k), 1.0]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(x, self.final))))))

    def passages(self, n: int, found: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
        """The significant ones, as word spans with their normalised scores."""
        out = []
        for s, e, v in found:
            z = self.lam * v - self.log_k - math.log(max(n, 1))
            if math.exp(-min(z, 50)) <= SIGNIFICANT:
                out.append((s, e, z))
        return out

    def __getstate__(self):
        return self.__dict__ | {"_lookup": None}


def _unit_counts(batches):
    schema = pa.schema([("unit", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            for u in {u for w in set(tokens(text)) for u in units(w)}:
                counts.setdefault(u, [0, 0])[0 if y else 1] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], schema=schema
        )


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """Texts ``(text, toxic)`` of about ``most`` labelled rows at most that aren't held out, by hash of doc_id.

    Copies of a text are no independent witnesses: of texts that agree in the least hash of their three-word shingles, as
    copies and most near copies do, one is taken, a toxic one if there is one, of those the last in code point order.
    """
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id").cast("long")))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    share = most / max(1, rows.count())
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.join(F.broadcast(rows), "doc_id")  # at most about ``most`` rows of two numbers
    words = F.split(F.lower("text"), r"\s+")
    later = lambda k: F.slice(words, k + 1, 1 << 30)
    shingles = F.zip_with(F.zip_with(words, later(1), lambda a, b: F.xxhash64(a, b)), later(2), lambda a, b: F.xxhash64(a, b))
    return found.groupBy(F.array_min(shingles).alias("h")).agg(F.max_by("text", F.struct("toxic", "text")).alias("text"), F.max("toxic").alias("toxic")).drop("h")


def fitted(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Model:
    """Learns from the labelled rows of ``docs`` that aren't held out. Without toxic or clean rows the score is their share."""
    spark = docs.sparkSession
    bound_batches(spark)
    sample, _ = written(labelled_sample(docs, labels, most), "toxicity-sample")
    counts = sample.mapInArrow(_unit_counts, "unit string, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts, _ = written(counts, "toxicity-units")
    n1, n0 = counts.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("clean"), F.lit(0))).first()
    frequent = counts.where("toxic + clean >= 5")
    # only units that lean to one side, and the words under a toxic prefix, can matter
    lean = (F.col("toxic") + 0.5) / (F.col("clean") + 0.5) * F.lit((n0 + 1) / (n1 + 1))
    leaning = frequent.where((lean > 2) | (lean < 0.5))
    rows = [tuple(r) for r in leaning.collect()]  # at most a fifth of the sample's words
    toxic_prefixes = [u for u, d in learned_units(rows, n1, n0).items() if u.endswith("*") and d > COST]
    if toxic_prefixes:
        near = F.lit(False)
        for n in PREFIXES:
            ends = [u[:-1] for u in toxic_prefixes if len(u) == n + 1]
            near = near | F.substring("unit", 1, n).isin(ends) if ends else near
        rows += [tuple(r) for r in frequent.where((lean <= 2) & (lean >= 0.5) & ~F.endswith("unit", F.lit("*")) & near).collect()]
    model = Model(learned_units(sorted(rows), n1, n0))
    shared = spark.sparkContext.broadcast(model)  # units of the bounded sample

    def scan(batches):
        m = shared.value
        for batch in batches:
            out = []
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                n, values, found = m.scan(text)
                hist = np.histogram(np.clip(values - COST, -8, 8), BINS)[0] if not y else []
                out.append((int(bool(y)), n, [s for _, _, s in found], [int(x) for x in hist]))
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.float64())), pa.array(cols[3], pa.list_(pa.int64()))], names=["y", "n", "found", "hist"]
            )

    rows = sample.mapInArrow(scan, "y long, n long, found array<double>, hist array<long>").collect()  # bounded by ``most``
    rows.sort(key=lambda r: (r["y"], r["n"], r["found"]))
    clean = [r for r in rows if not r["y"]]
    if not clean or len(clean) == len(rows):
        share = min(max((len(rows) - len(clean)) / max(len(rows), 1), 1e-6), 1 - 1e-6)
        model.final = [0.0, 0.0, 0.0, math.log(share / (1 - share))]
        return model
    hist = sum((np.array(r["hist"]) for r in clean if r["hist"]), np.zeros(len(BINS) - 1))
    model.lam = decay(hist / max(hist.sum(), 1), (BINS[1:] + BINS[:-1]) / 2)
    tops = [(max(r["found"]), r["n"]) for r in clean if r["found"]]
    if tops:  # the mean of a Gumbel variable lies 0.5772 above its mode
        model.log_k = float(np.mean([model.lam * s - math.log(n) for s, n in tops])) - 0.5772
    x = np.array([evidence(r["found"], r["n"], model.lam, model.log_k) for r in rows])
    model.final = [float(v) for v in logistic(x, np.array([r["y"] for r in rows], float))]
    return model


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, score, predicted, passages`` and the columns in ``keep`` for every row of ``docs (doc_id, text)``.

    score is the probability of label 1; predicted is 1 from ``THRESHOLD`` on; passages lists the significant
    segments of the whole text as ``(start, end, score)`` in words. Null and empty texts are scored as texts without
    words. Equal texts score alike.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches):
        m = shared.value
        for batch in batches:
            scores, spans = [], []
            for text in batch.column("text").to_pylist():
                n, _, found = m.scan(text)
                scores.append(m.score(n, found))
                spans.append([{"start": s, "end": e, "score": z} for s, e, z in m.passages(n, found)])
            cols = [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(spans, pa.list_(span))]
            yield pa.RecordBatch.from_arrays(cols + [batch.column(c) for c in keep], names=["doc_id", "score", "predicted", "passages", *keep])

    wanted = list(dict.fromkeys(["doc_id", "text", *keep]))
    schema = ", ".join(["doc_id long", "score double", "predicted int", "passages array<struct<start:int,end:int,score:double>>", *[f"`{c}` {kinds[c]}" for c in keep]])
    return docs.withColumn("doc_id", F.col("doc_id").cast("long")).select(*wanted).mapInArrow(run, schema)
