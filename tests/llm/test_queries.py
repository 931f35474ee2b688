"""Registered queries on the smallest tables: SQL where there is some, contracts otherwise."""

import duckdb
import pytest

from attesta.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf), c.sql(queries.ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda names, data: sorted(str([r[list(names).index(k)] for k in cols]) for r in data)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


CONTRACTS = {
    "op1_order_minhash": {"doc_id": "bigint", "class_id": "bigint", "kept": "boolean"},
    "op2_curriculum_mix": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op3_toxic_segments": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4_chat_events": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op5_suffix_pieces": {"doc_id": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op6_cross_parsing": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op7_virtual_slots": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op8_zstd_tokens": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op9_grid_order_join": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op10_audio_features": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_columns(spark, sf, name):
    assert CONTRACTS[name].items() <= dict(queries.QUERIES[name](spark, sf).dtypes).items()


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        rows = out.collect()
        assert rows and {r.doc_id for r in rows} <= ids
        docs = spark.createDataFrame(rows, docs.schema)
    last = p.STAGES[-1][1](spark, docs, sf)
    assert last.count() == docs.count() and last.where("NOT round_trip").count() == 0
