"""Queries op1 to op10 over the driver's tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, chat, grid_join, langid, minhash, mixing, sentencepieces, sharding, token_files, toxicity

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, sorted by training position."""
    mix = mixing.mixed(_table(spark, sf_dir, "documents"))
    return mixing.ordered_for_training(mix).select("doc_id", "size", "source_size", "target", "taken", "position")


def op3_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fitted(docs, _table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select("doc_id", F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def op4_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation's rendered form; each row of the table is one event."""
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    odd = F.lit("<|im_end|><|im_start|>assistant ok")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), odd.alias("text"))
    return chat.digests(chat.rendered(chat.folded(chat.events_of_turns(rows.unionByName(more)))))


def op5_suffix_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document."""
    return sentencepieces.encoded(_table(spark, sf_dir, "documents"), tokenizer_path(PIECE_BPE))


def op6_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs).select("doc_id", F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place of every document."""
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op8_zstd_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, read back from token files."""
    return token_files.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE)).drop("part")


def op9_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return grid_join.near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's waveform and features."""
    return audio.round_trip(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_order_minhash, op2_curriculum_mix, op3_toxic_segments, op4_chat_events, op5_suffix_pieces, op6_cross_parsing, op7_virtual_slots, op8_zstd_tokens, op9_grid_order_join,
        op10_audio_features,
    )
}

_CHAT_SQL = r"""
WITH u AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (
  SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS etext,
         replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\' || chr(10)) AS erole FROM u
)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(24 + length(erole) + length(etext))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLE_SQL: dict[str, str] = {"op2_curriculum_mix": mixing.mix_sql(), "op4_chat_events": _CHAT_SQL}
