"""The registered queries over sf0.001: shapes of the contracts, and brute force where SQL can't say it."""

import zlib

import numpy as np
import pytest

from pointloom.llm import registry, tokens, work

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op3_": {"doc_id": "bigint"},
    "op4_": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op5_": {"doc_id": "bigint"},
    "op6_": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op7_": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op8_": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op9_": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op10_": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
}


@pytest.mark.parametrize("prefix", COLUMNS)
def test_columns(spark, prefix):
    name = next(q for q in registry.queries() if q.startswith(prefix))
    kinds = dict(registry.queries()[name](spark, DATA).dtypes)
    assert {k: kinds.get(k) for k in COLUMNS[prefix]} == COLUMNS[prefix]


def test_one_row_for_each_document(spark):
    n = work.read(spark, DATA, "documents").count()
    for q in ("op1_toxic_spans", "op4_near_duplicates", "op5_extendible_shards", "op6_language_id", "op8_decontamination", "op10_huffman_ids"):
        assert registry.queries()[q](spark, DATA).count() == n, q


def test_held_out(spark):
    for q, mod, rest in (("op1_toxic_spans", 5, 0), ("op6_language_id", 4, 2)):
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) for r in registry.queries()[q](spark, DATA).collect())


def test_huffman_starts(spark):
    from tokenizers import Tokenizer

    docs = sorted((r.doc_id, r.text or "") for r in work.read(spark, DATA, "documents").collect())
    t, at, want = Tokenizer.from_file(tokens.vocabulary_path()), 0, set()
    for (d, _), e in zip(docs, t.encode_batch([x for _, x in docs], add_special_tokens=False), strict=True):
        ids = np.array([*e.ids, 1], "<u4")
        want.add((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert {tuple(r) for r in registry.queries()["op10_huffman_ids"](spark, DATA).collect()} == want


def test_toxicity_on_documents_held_out(spark):
    """At sf0.01 few toxic documents are labelled: those that hold a marker are caught, others are left alone, held out or not."""
    data = "/root/testdata/sf0.01"
    got = registry.queries()["op1_toxic_spans"](spark, data).join(work.read(spark, data, "labels").where("toxic is not null").select("doc_id", "toxic"), "doc_id").toPandas()
    clean, marked = got[got["toxic"] == 0], got[(got["toxic"] == 1) & (got["n_spans"] > 0)]
    assert (clean[clean["held_out"]]["predicted"] == 0).all() and (clean["predicted"] == 0).mean() > 0.99
    assert len(marked[marked["held_out"]]) >= 4 and (marked["predicted"] == 1).mean() >= 0.95


def test_language_accuracy(spark):
    got = registry.queries()["op6_language_id"](spark, DATA).where("held_out").join(work.read(spark, DATA, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.95


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    import glob
    import os

    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = registry.queries()[name](spark, DATA).toPandas(), c.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).itertuples(index=False)))
    assert rows(got) == rows(want)
