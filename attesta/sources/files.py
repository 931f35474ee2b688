"""File sources and sinks: registry archive, permissive JSON lines, manifests, dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import HISTORY, RECORD, VERSION0

_ID = r"/([^/]+)/[^/]+$"


def current_records(spark: SparkSession, archive: str) -> DataFrame:
    """Current records of an archive ``<trial>/current.json``; one file is one record, whatever its line breaks."""
    return spark.read.schema(RECORD).json(f"{archive.rstrip('/')}/*/current.json", multiLine=True)


def version_records(spark: SparkSession, archive: str, version: int = 0) -> DataFrame:
    """Records as of a version, ``<trial>/versions/<n>.json``; trials without the file have no row."""
    return spark.read.schema(VERSION0).json(f"{archive.rstrip('/')}/*/versions/{version}.json", multiLine=True)


def histories(spark: SparkSession, archive: str) -> DataFrame:
    """Revision indexes ``<trial>/history.json`` as ``(nct_id, changes)``; the trial is the folder's name."""
    df = spark.read.schema(HISTORY).json(f"{archive.rstrip('/')}/*/history.json", multiLine=True)
    return df.select(F.regexp_extract(F.col("_metadata.file_path"), _ID, 1).alias("nct_id"), "changes")


def json_lines(spark: SparkSession, paths: str | list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines, and the lines that are none as ``(path, line)``; both read with one schema, in permissive mode.

    A line that isn't an object of the schema goes to the second frame; blank lines to neither.
    """
    raw = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line")).where(F.trim("line") != "")
    parsed = raw.withColumn("row", F.from_json("line", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.where("row._corrupt is null").select("row.*").drop("_corrupt"), parsed.where("row._corrupt is not null").select("path", "line")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_dead_letters(df: DataFrame, path: str) -> None:
    """Errors as tab-separated lines."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def manifest(spark: SparkSession, pattern: str) -> DataFrame:
    """``path, sha256, bytes, modified`` of files, in order of path: a function of what is there. Contents are hashed on the executors."""
    f = spark.read.format("binaryFile").load(pattern)
    return f.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")).orderBy("path")


def missing(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Expected files ``(nct_id, file)`` that are not there yet: what a repeated archive run still has to fetch."""
    return expected.join(found, ["nct_id", "file"], "left_anti")


def expected_files(trials: DataFrame) -> DataFrame:
    return trials.select("nct_id", F.explode(F.array(*[F.lit(x) for x in ("current.json", "history.json", "versions/0.json")])).alias("file"))


def changed(files: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Files whose keys (path, digest, options) were not worked on yet."""
    return files.join(done.select(*keys).distinct(), keys, "left_anti")


def write_manifest_json(df: DataFrame, path: str) -> None:
    """A small frame as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path, ignoreNullFields=False)
