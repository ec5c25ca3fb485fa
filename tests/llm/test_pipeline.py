"""The pipeline's stages on a small table: columns kept, decisions in effect, odd rows survived."""

import hashlib

import corpus_pipeline
import numpy as np
from tests.conftest import SF


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, SF)
        assert made.columns == docs.columns, name
        if name != "mixing":
            assert made.count() <= docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in out:
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        assert r["n_tokens"] == len(np.frombuffer(r["ids"], "<u4"))


def test_stages_on_odd_rows_and_none(spark):
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "the and of that is", "en", "s", 18), (2, "the and of that is", "en", "s", 18), (3, "the and " * 5000, "en", None, 40000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, SF)
        assert frame.columns == docs.columns
        coded = corpus_pipeline.STAGES[-1][1](spark, frame, SF)
        assert coded.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and coded.count() == frame.count()


def test_last_stage_on_odd_rows_with_clashing_columns(spark):
    rows = [(1, None, "x"), (None, "", "x"), (2, "twice", "x"), (2, "twice", "x"), (3, "long " * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = corpus_pipeline.encode(spark, docs, SF).collect()
    want = sorted((str(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), r["decoded_sha256"]) for r in got) == want
    assert all((r["n_tokens"] == 0) == (not len(r["ids"])) for r in got)
