"""Shared folder, written tables, bounded Arrow batches and connected components."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The folder that holds the package; Python workers look for it there too.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Rows and bytes of one Arrow batch sent to Python: texts can be very long, so both are bounded.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset (tests, local mode) one under the warehouse."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/attesta-{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str, batch_rows: int | None = None) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, read back: lineage is cut and a lost executor costs nothing.

    ``batch_rows`` lowers the rows of an Arrow batch for this table alone, where rows are long.
    """
    spark = df.sparkSession
    path, key = new_path(spark, name), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if batch_rows is not None and not 0 < int(before) <= batch_rows:
        spark.conf.set(key, str(batch_rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path), path


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lowers the session's Arrow batch limits to the library's; limits already lower stay. Workers also learn where this package lies."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (env.get("PYTHONPATH"), ROOT)))


#: Edges of one task of a round of ``components``.
EDGES_PER_TASK = 50_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list, as ``(node, component)`` with the component's least node.

    Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and Beyond",
    2014). Each round is joins and map-side combined minima, and its result is a written table; the joins of edges with
    minima have one row a node on one side, so a node with very many links is split where the planner splits skewed
    partitions. Only two numbers a round reach the driver, taken while its edges are written, and few edges are left to
    few tasks. Nodes without a link are not returned; null ends and self-links are ignored; repeated links count once.
    """
    spark = edges.sparkSession
    x, y = F.col(a), F.col(b)
    e = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    mark, path = None, None
    while True:
        seen = Observation()
        old = path
        e, path = written(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "edges")
        if old:
            drop_path(spark, old)
        now = seen.get["n"], seen.get["h"]
        if now == mark or now[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        mark = now
        tasks = -(-now[0] // EDGES_PER_TASK)
        e = e.coalesce(tasks)
        both = e.union(e.select(F.col("v"), F.col("u")).toDF("u", "v")).coalesce(tasks)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").coalesce(tasks)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.toDF("u", "v")).coalesce(tasks)
        e = small.distinct().coalesce(tasks)
