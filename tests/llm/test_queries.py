"""The queries themselves: against their SQL where there is some, and their columns."""

import os

import duckdb
import pytest

import __spark_entry__
from glintframe.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op2_prefix_targets": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op3_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op4_byte_shards": "doc_id size text_crc32 law shard slot grown_shard",
    "op5_ngram_join": "doc_id n_shingles component_id",
    "op6_divergence_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op7_text_density": "page_id url text n_chars",
    "op8_pivotal_mix": "doc_id size source_size target taken",
    "op9_toxicity": "doc_id held_out score predicted",
    "op10_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op11_source_divergence": "lang source part item value rank",
    "op12_whitening": "vec_id component n deviation whitened explained identity_error",
    "op13_token_files": "doc_id start n_tokens ids_crc32",
}


def test_all_are_registered():
    assert set(COLUMNS) == set(queries.queries()) and set(COLUMNS) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(queries.SQL) <= set(COLUMNS)


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    out = queries.queries()[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(out.columns)
    got = [tuple(r[c] for c in sorted(out.columns)) for r in out.collect()]
    if name not in queries.SQL:
        assert got
        return
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        assert os.path.exists(f"{SF}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    told = con.execute(queries.SQL[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == sorted(out.columns)
    want = [tuple(r[names.index(c)] for c in sorted(names)) for r in told.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_toxicity_never_learns_from_held_out_rows(spark, tmp_path):
    """Changing held-out labels changes nothing."""
    from pyspark.sql import functions as F

    (tmp_path / "sf").mkdir()
    os.symlink(f"{SF}/documents.parquet", tmp_path / "sf" / "documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    turned = spark.read.parquet(f"{SF}/labels.parquet").withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    turned.write.parquet(str(tmp_path / "sf" / "labels.parquet"))
    a, b = ({r.doc_id: r.score for r in queries.op9_toxicity(spark, d).collect()} for d in (SF, str(tmp_path / "sf")))
    assert a == b
