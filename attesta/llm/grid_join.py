"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with a cosine of at least ``cosine`` lie within epsilon = sqrt(2 - 2 cosine) of each other, and their
projections on any orthonormal directions do too. Vectors are projected on the leading principal directions,
sorted by the epsilon grid's cells there (Boehm et al., "Epsilon grid order", 2001) and cut into intervals. A
tree of intervals is joined with itself from the root: pairs of intervals whose bounding boxes are further apart
than epsilon are skipped, others are split, down to blocks, which are split further inside one task before vectors
are compared in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, components, written

COSINE, DIRECTIONS, LEAF, FAN = 0.9, 8, 128, 8
#: Bytes of a block in single precision: a block meets all blocks near it, so fewer, larger ones travel less.
BLOCK_BYTES = 2 << 20
#: Vectors that the principal directions are fitted on, at most about; any directions give right results.
SAMPLE_ROWS = 20_000
#: Slack for rounding when boxes are compared; vectors themselves are compared by the cosine alone.
SLACK = 1e-6


def usable(v):
    """Not null, not all zero, and every component finite."""
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists(v, lambda x: x != 0)


def principal(distinct: DataFrame, directions: int, most: int = SAMPLE_ROWS) -> tuple[int, np.ndarray]:
    """Greatest dimension, and the leading principal directions (dimension x directions) of a sample of unit vectors."""
    n, dim = distinct.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return 0, np.zeros((0, 0))
    share = min(1.0, most / n)
    rows = distinct.where(F.pmod(F.xxhash64("vid"), F.lit(1 << 20)) < int(math.ceil(share * (1 << 20)))).select("v").orderBy("vid").toArrow().column("v").to_pylist()
    x = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        x[i, : len(r)] = np.array(r, float)
    x = _unit(x)
    x -= x.mean(0) if len(x) else 0
    _, vectors = np.linalg.eigh(x.T @ x)
    return dim, vectors[:, ::-1][:, : min(directions, dim)].copy()


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def gridded(distinct: DataFrame, axes: np.ndarray, epsilon: float) -> DataFrame:
    """Adds ``cells``: the dimension and the grid cells of the unit vector's projections, the sort key."""
    schema = pa.schema([("vid", pa.int64()), ("n", pa.int64()), ("v", pa.list_(pa.float64())), ("cells", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            rows = batch.column("v").to_pylist()
            x = np.zeros((len(rows), len(axes)))
            for i, r in enumerate(rows):
                x[i, : len(r)] = r
            cells = np.floor(_unit(x) @ axes / epsilon).astype(np.int32) if rows else np.zeros((0, 1), np.int32)
            cells = np.hstack([np.array([[len(r)] for r in rows], np.int32).reshape(-1, 1), cells])
            yield pa.RecordBatch.from_arrays([batch.column("vid"), batch.column("n"), batch.column("v"), pa.array(list(cells), pa.list_(pa.int32()))], schema=schema)

    return distinct.select("vid", "n", "v").mapInArrow(run, "vid long, n long, v array<double>, cells array<int>")


def blocked(cells: DataFrame, axes: np.ndarray, block: int | None = None) -> DataFrame:
    """Cuts the sorted sequence into blocks of ``block`` rows, or ``BLOCK_BYTES``: ``part, at, vids, counts, data, lo, hi``; a block's rows share a dimension."""
    schema = pa.schema([
        ("part", pa.int32()), ("at", pa.int32()), ("dim", pa.int32()), ("vids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("single", pa.bool_()), ("data", pa.binary()),
        ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())),
    ])

    def run(batches):
        part, at, held = TaskContext.get().partitionId(), 0, []

        def made(rows):
            dim = len(rows[0][2])
            raw = np.array([r[2] for r in rows], float)
            with np.errstate(over="ignore"):
                small = raw.astype(np.float32)
            p = _unit(raw) @ axes[:dim]
            raw = small if (small == raw).all() else raw
            return pa.RecordBatch.from_pydict(
                {"part": [part], "at": [at], "dim": [dim], "vids": [[r[0] for r in rows]], "counts": [[r[1] for r in rows]], "single": [raw.dtype == np.float32], "data": [raw.tobytes()], "lo": [p.min(0).tolist()], "hi": [p.max(0).tolist()]}, schema=schema
            )

        for batch in batches:
            for row in zip(batch.column("vid").to_pylist(), batch.column("n").to_pylist(), batch.column("v").to_pylist()):
                if held and (len(held) == (block or max(LEAF, BLOCK_BYTES // (4 * len(row[2])))) or len(held[0][2]) != len(row[2])):
                    yield made(held)
                    at, held = at + 1, []
                held.append(row)
        if held:
            yield made(held)

    rows = cells.repartitionByRange("cells", "vid").sortWithinPartitions("cells", "vid").select("vid", "n", "v")
    return rows.mapInArrow(run, "part int, at int, dim int, vids array<long>, counts array<long>, single boolean, data binary, lo array<double>, hi array<double>")


def _gap2(a, b):
    """Squared distance between the bounding boxes of two nodes."""
    over, under = F.zip_with(a["lo"], b["hi"], lambda x, y: x - y), F.zip_with(b["lo"], a["hi"], lambda x, y: x - y)
    gap = F.zip_with(over, under, lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(gap, F.lit(0.0), lambda acc, g: acc + g * g)


def block_pairs(nodes: DataFrame, epsilon: float, fan: int = FAN) -> DataFrame:
    """Pairs ``(a, b)``, a <= b, of blocks ``(id, lo, hi)`` that may hold close vectors.

    Blocks, numbered in grid order, are the leaves of a tree with ``fan`` children a node. From the root pair down,
    each pair of nodes within epsilon is replaced by the pairs of its children: work follows the pairs that are left.
    """
    spark = nodes.sparkSession
    levels = [nodes.select("id", "lo", "hi", "dim")]
    count = nodes.count()
    size = F.size("lo")
    while count > 1:
        up = levels[-1].withColumn("id", F.floor(F.col("id") / fan).cast("long"))
        wide = up.groupBy("id").agg(F.min("dim").alias("dim"), *[F.array(*[f(F.get(c, F.lit(i))) for i in range(DIRECTIONS)]).alias(c) for c, f in (("lo", F.min), ("hi", F.max))])
        levels.append(wide.select("id", *[F.filter(c, lambda x: x.isNotNull()).alias(c) for c in ("lo", "hi")], "dim"))
        count = -(-count // fan)
    box = F.struct("id", "lo", "hi")
    limit = (epsilon + SLACK) ** 2
    pairs = levels[-1].select(F.col("id").alias("a"), F.col("id").alias("b"))
    for level in levels[-2::-1]:
        child = level.select(F.floor(F.col("id") / fan).cast("long").alias("up"), box.alias("box"))
        left, right = child.select(F.col("up").alias("a"), F.col("box").alias("x")), child.select(F.col("up").alias("b"), F.col("box").alias("y"))
        found = pairs.join(left, "a").join(right, "b").where("x.id <= y.id").where(_gap2(F.col("x"), F.col("y")) <= limit)
        pairs, _ = written(found.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")), "interval-pairs")
    return pairs


def _close(x, y, px, py, epsilon, same, visit):
    """Visits the leaf pairs (start, end, start, end) within epsilon, halving the longer interval of each pair."""
    stack = [(0, len(x), 0, len(y))]
    while stack:
        a, b, c, d = stack.pop()
        if same and c < a:
            continue
        gap = np.maximum(0, np.maximum(px[a:b].min(0) - py[c:d].max(0), py[c:d].min(0) - px[a:b].max(0)))
        if (gap * gap).sum() > (epsilon + SLACK) ** 2:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            visit(a, b, c, d)
        elif same and a == c and b == d:
            m = (a + b) // 2
            stack += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
        elif b - a >= d - c:
            m = (a + b) // 2
            stack += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            stack += [(a, b, c, m), (a, b, m, d)]


def joined_blocks(pairs: DataFrame, blocks: DataFrame, axes: np.ndarray, cosine: float, epsilon: float) -> DataFrame:
    """``vid, links, other`` of block pairs: links sums the copies of close vectors; other is a vid it hangs together with.

    A block pair gives two rows a vector at most, however many of its vectors are close: a count, and links enough
    to keep connected what is connected.
    """
    schema = pa.schema([("vid", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def vectors(data, single, dim):
        return _unit(np.frombuffer(data, np.float32 if single else np.float64).reshape(-1, dim).astype(float))

    def run(batches):
        for batch in batches:
            for row in range(len(batch)):
                get = lambda c: batch.column(c)[row].as_py()
                ids, jds = get("vids"), get("vids2")
                dim = get("dim")
                if dim != get("dim2"):
                    continue
                same = get("a") == get("b")
                x = vectors(get("data"), get("single"), dim)
                y = x if same else vectors(get("data2"), get("single2"), dim)
                n, m = np.array(get("counts")), np.array(get("counts2"))
                left, right = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
                group = np.arange(len(x) + (0 if same else len(y)))
                shift = 0 if same else len(x)

                def visit(a, b, c, d):
                    close = x[a:b] @ y[c:d].T >= cosine
                    if same and a == c:
                        np.fill_diagonal(close, False)
                    if not close.any():
                        return
                    left[a:b] += close @ m[c:d]
                    if not same:
                        right[c:d] += n[a:b] @ close
                    elif a != c:
                        left[c:d] += n[a:b] @ close
                    for i in np.flatnonzero(close.any(1)).tolist():
                        tops = np.unique(np.append(group[shift + c : shift + d][close[i]], group[a + i]))
                        if len(tops) > 1:
                            group[np.isin(group, tops)] = tops[0]

                _close(x, y, x @ axes[:dim], y @ axes[:dim], epsilon, same, visit)
                names = ids if same else ids + jds
                out = [(names[i], int(k), None) for i, k in enumerate(left.tolist() + ([] if same else right.tolist())) if k]
                out += [(names[i], 0, names[g]) for i, g in enumerate(group.tolist()) if g != i]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    a = blocks.select(F.col("id").alias("a"), "dim", "vids", "counts", "single", "data")
    b = blocks.select(F.col("id").alias("b"), F.col("dim").alias("dim2"), F.col("vids").alias("vids2"), F.col("counts").alias("counts2"), F.col("single").alias("single2"), F.col("data").alias("data2"))
    return pairs.join(a, "a").join(b, "b").mapInArrow(run, "vid long, links long, other long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, block: int | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors (vec_id, embedding)``.

    Two rows are linked if the cosine of their vectors, in double precision, is at least ``cosine`` (over 0).
    n_links counts a row's linked rows; component_id is the least vec_id it reaches by links, itself included; kept
    marks the row with that vec_id. Vectors that are null, zero or hold a null or non-finite component link with
    nothing, nor do rows without a vec_id; vectors of different dimension don't link. Equal vectors are joined once and counted by their
    number, so a vector with a third of all rows costs what one vector costs. A repeated vec_id counts as rows of its own. Other columns are
    not read.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be over 0 and at most 1")
    epsilon = math.sqrt(max(0.0, 2 - 2 * cosine))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fit = F.coalesce(usable(F.col("v")), F.lit(False)) & F.col("vec_id").isNotNull()
    good = rows.where(fit)
    distinct, _ = written(good.groupBy("v").agg(F.min("vec_id").alias("vid"), F.count(F.lit(1)).alias("n")), "vectors")
    dim, axes = principal(distinct, DIRECTIONS)
    if not dim:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    blocks, _ = written(blocked(gridded(distinct, axes, max(epsilon, 1e-3)), axes, block), "blocks")
    per_part = blocks.groupBy("part").agg(F.count(F.lit(1)).alias("k"))
    ahead = per_part.withColumn("base", F.coalesce(F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "base")
    blocks = blocks.join(F.broadcast(ahead), "part").withColumn("id", F.col("base") + F.col("at"))  # one row a partition
    pairs = block_pairs(blocks.select("id", "lo", "hi", "dim"), epsilon)
    found, _ = written(joined_blocks(pairs.repartition(F.col("a"), F.col("b")), blocks, axes, cosine, epsilon), "vector-links")
    comp = components(found.where("other is not null"), "vid", "other")
    counts = found.groupBy("vid").agg(F.sum("links").alias("links"))
    per = (
        distinct.join(counts, "vid", "left")
        .join(comp.withColumnRenamed("node", "vid"), "vid", "left")
        .select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "vid").alias("component_id"))
    )
    linked = good.join(per, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
