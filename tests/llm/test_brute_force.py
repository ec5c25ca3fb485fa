"""Language identification, toxicity and the pipeline against plain versions of themselves."""

import collections
import itertools

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from covary.llm import bpe, langid, mixing, toxicity
from covary.llm.lm import fold
from covary.llm.store import materialize
from tests.conftest import SF
from tests.llm import brute

ODD = [None, "", "12 !", "İstanbul ǅ ßß", "Übergröße naïve \x00 x", "zq", "thé and", "日本語 and the", "w0rd w0rd"]


def test_language_by_dictionaries(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.union(spark.createDataFrame([(10_000 + i, t, None) for i, t in enumerate(ODD)], docs.schema))
    train = docs.filter(fold("doc_id", 4) != 2)
    got = langid.predict(docs, langid.fit(train)).collect()
    want = brute.languages([(r["text"], r["lang"]) for r in train.collect()], [r["text"] for r in got])
    assert [r["lang_pred"] for r in got] == [x for x, _ in want]
    assert [r["score"] for r in got] == pytest.approx([x for _, x in want], abs=1e-6)
    assert langid.predict(docs.limit(0), langid.fit(train)).count() == 0
    twice = langid.predict(docs.union(docs), langid.fit(train)).groupBy("doc_id", "lang_pred", "score").count().collect()
    assert {r["count"] for r in twice} == {2}


def _parts(docs, labels):
    """(text, toxic) of the documents that give the lexicon and of those that give the curve."""
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(3))
    rows = docs.join(labels.filter("toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")), "doc_id").select("text", "toxic", (part > 0).alias("lexicon")).collect()
    return [[(r["text"], r["toxic"]) for r in rows if r["lexicon"] == x] for x in (True, False)]


def test_toxicity_by_dictionaries(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    want = brute.toxic_scores([r["text"] for r in got], *_parts(docs, labels))
    assert [r["score"] for r in got] == pytest.approx(want, abs=1e-6)
    assert 0 < sum(x >= 0.5 for x in want) < len(want) / 2


def test_readings_are_the_likeliest_of_all(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.char_model(docs)
    assert model == pytest.approx(brute.character_model([r["text"] for r in docs.collect()]), abs=1e-5)

    def value(readings):
        p, q, total = 0, 0, 0.0
        for letters, cost in readings:
            total -= cost
            for c in letters:
                r = 0 if c == " " else toxicity._INDEX.get(c, toxicity._SIZE - 1)
                total += float(model[p, q, r]) + toxicity.LETTER_COST
                p, q = q, r
        return total + float(model[p, q, 0])

    for span in ("m0r0n", "1d10t", "i d i o t", "s c.u_m", "looo0oser", "@$$", "aaa", "1|1|"):
        every = list(itertools.product(*toxicity.lattice(span)))
        best = max(map(value, every))
        made = toxicity.restore(span, model)
        assert max(value(x) for x in every if "".join(a for a, _ in x) == made) == pytest.approx(best)


def test_pipeline_stage_by_stage(spark):
    docs = start = spark.read.parquet(f"{SF}/documents.parquet")
    inputs, rows = {}, None
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = rows = {r["doc_id"]: r for r in docs.collect()} if name != "byte-level BPE" else docs.collect()
        docs = materialize(stage(spark, docs, SF), "stage")
        inputs[name, "after"] = docs.collect()
    after = {name: inputs[name, "after"] for name, _ in corpus_pipeline.STAGES}

    ids = list(inputs["toxicity"])
    scores = brute.toxic_scores([inputs["toxicity"][i]["text"] for i in ids], *_parts(start, spark.read.parquet(f"{SF}/labels.parquet")))
    assert {r["doc_id"] for r in after["toxicity"]} == {i for i, s in zip(ids, scores, strict=True) if s < corpus_pipeline.TOXIC}

    mine = inputs["language"]
    said = brute.languages([(r["text"], r["lang"]) for r in mine.values()], [r["text"] for r in mine.values()])
    assert {r["doc_id"] for r in after["language"]} == {i for i, (x, s) in zip(mine, said, strict=True) if x != langid.UNKNOWN and s >= corpus_pipeline.UNSURE}

    label = brute.near_groups([(i, r["text"]) for i, r in inputs["near duplicates"].items()], 80)
    assert {r["doc_id"] for r in after["near duplicates"]} == {i for i, x in label.items() if i == x}

    mine = inputs["mixing"]
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(list(mine.values()), start.schema).toPandas())
    want = {i: n for i, n in con.sql(f"SELECT doc_id, taken FROM ({mixing.OP9_SQL})").fetchall() if n}
    got, words = collections.Counter(), lambda t: t.split()  # the texts hold no other white space
    for r in after["mixing"]:
        got[r["doc_id"]] += len(words(r["text"]))
        assert r["text"] == mine[r["doc_id"]]["text"] or set(words(r["text"])) <= set(words(mine[r["doc_id"]]["text"]))
        assert r["n_chars"] == len(r["text"]) and (r["lang"], r["source"]) == (mine[r["doc_id"]]["lang"], mine[r["doc_id"]]["source"])
    assert {i: n for i, n in got.items() if n} == want

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    expected = collections.Counter((r["doc_id"], tuple(enc.encode_ordinary(r["text"]))) for r in inputs["byte-level BPE"])
    assert collections.Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in after["byte-level BPE"]) == expected
