"""The stages of the corpus pipeline, each made of one operator of this folder.

Each takes ``(spark, docs, sf_dir)``; docs has the columns of ``documents``, and all stages but the last return them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, minhash, mixing, sentencepieces, toxicity
from .queries import PIECE_BPE, tokenizer_path

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. The model learns from the table ``labels``."""
    model = toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs, model, keep=DOCUMENTS[1:]).where("predicted = 0").select(*DOCUMENTS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, as no language can be told; ``lang`` of all others is what is predicted."""
    found = langid.identify(docs, keep=("text", "source", "n_chars")).where(F.col("lang_pred") != langid.UNDETERMINED)
    return found.withColumnRenamed("lang_pred", "lang").select(*DOCUMENTS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the least doc_id, null last; of rows of one doc_id and one text, one.

    Rows without text are only copies of each other where they have one doc_id.
    """
    heads = minhash.classed(docs).where("node = component").select("node").distinct()
    kept = docs.withColumn("_node", minhash.node_id(F.col("doc_id").cast("long"), F.col("text"))).join(heads, F.col("_node") == F.col("node"), "left_semi")
    kept = kept.dropDuplicates(["_node"]).select(*DOCUMENTS)
    return kept.unionByName(docs.where("text is null").dropDuplicates(["doc_id"]).select(*DOCUMENTS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each reading that the mix takes, in training order; a reading cut at the target keeps its first words."""
    mix = mixing.mixed(docs, keep=("text", "lang", "source", "n_chars"))
    rows = mix.select("doc_id", "text", "lang", "source", "n_chars", "size", F.explode("copies").alias("copy"))
    words = F.col("copy")["words"]
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(mixing.WORD), F.lit(0)), F.lit(1), words.cast("int")), " ")
    text = F.when(words == F.col("size"), F.col("text")).otherwise(cut)
    rows = rows.withColumn("position", F.col("copy")["position"]).withColumn("cut", text)
    rows = rows.withColumn("n_chars", F.when(words == F.col("size"), F.col("n_chars")).otherwise(F.length("cut").cast("long")))
    return rows.orderBy("position", "doc_id").select("doc_id", F.col("cut").alias("text"), "lang", "source", "n_chars")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every row."""
    return sentencepieces.encoded(docs, tokenizer_path(PIECE_BPE), keep=("lang", "source"))
