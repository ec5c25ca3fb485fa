"""Language identification, word first: a known word scores by its log frequency in each language, an unseen one by its character
n-grams, from the longest on until a length has known ones.

The model is fitted on at most about SAMPLE training documents, those whose hash of the id falls below a share (all, if there are
fewer); it keeps every word and n-gram that these hold TWICE or more. Prediction reads nothing but the text.

Cases: a null text or one without a letter is 'und' with score 0; rows without a language teach nothing; a model without languages
says 'und' of everything; repeated rows and null ids are rows like others; very long texts are scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covary.llm.letters import Words, add_columns, lookup
from covary.llm.lm import fold
from covary.llm.store import columns, gives_back
from covary.llm.words import slices, spread

SAMPLE = 6000
TWICE = 2  # what the sample holds less often says nothing
LONGEST = 5
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    hashes: list[np.ndarray]  # words, then n-grams of 1 .. LONGEST, each sorted
    scores: list[np.ndarray]  # log probability of each in every language


def _windows(words: Words, some: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the n-grams of the words, which word each is of); a word has one edge before and one behind it."""
    counts = np.maximum(words.lengths[some] + 3 - n, 0)
    at = spread(words.starts[some] - 1, counts)
    return words.hashes(at, np.full(len(at), n), salt=n), np.repeat(np.arange(len(some)), counts)


def _count(languages: list[str]):
    def run(batches):
        for batch in batches:
            for start, stop in slices(batch.column("text")):
                words = Words(batch.column("text").slice(start, stop - start))
                speak = np.array([languages.index(x) for x in batch.column("lang").slice(start, stop - start).to_pylist()])
                unique, first, inverse = words.unique()
                for k, language in enumerate(languages):
                    mine = np.bincount(inverse[speak[words.texts] == k], minlength=len(unique))
                    some = np.flatnonzero(mine)
                    if not len(some):
                        continue
                    for n in range(LONGEST + 1):
                        if n:
                            grams, of = _windows(words, first[some], n)
                            hashes, place = np.unique(grams, return_inverse=True)
                            times = np.bincount(place, mine[some][of]).astype(np.int64)
                        else:
                            hashes, times = unique[some], mine[some]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), n, np.int32)), pa.array(hashes.view(np.int64)), pa.array(np.full(len(hashes), k, np.int32)), pa.array(times)], ["size", "hash", "language", "n"])

    return run


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Learns from the rows that have a language."""
    rows = train.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null and text is not null")
    found = rows.groupBy("lang").count().orderBy("lang").collect()  # a row per language
    languages, total = [r["lang"] for r in found], sum(r["count"] for r in found)
    if total > sample:
        rows = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < int((1 << 20) * sample / total))
    counts = rows.select("text", "lang").mapInArrow(gives_back(_count(languages)), "size int, hash bigint, language int, n bigint")
    by_gram = counts.groupBy("size", "hash").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("language") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(len(languages))]).filter(F.col("n") >= TWICE)
    found = columns(by_gram.drop("n"))  # of a bounded sample
    hashes, scores = [], []
    for n in range(LONGEST + 1):
        own = np.flatnonzero(found["size"] == n)
        keys = found["hash"][own].view(np.uint64)
        order = np.argsort(keys)
        seen = np.stack([found[f"n{k}"][own][order] for k in range(len(languages))], 1) + 0.5 if languages else np.zeros((len(own), 0))
        hashes.append(keys[order])
        scores.append(np.log(seen / seen.sum(0)) if len(seen) else seen)
    return Model(languages, hashes, scores)


def evidence(model: Model, words: Words, places: np.ndarray) -> np.ndarray:
    """Log probability of each word (given by a place) in every language; words without any known n-gram say nothing."""
    k = len(model.languages)
    out = np.zeros((len(places), k))
    at = lookup(model.hashes[0], words.hashes(words.starts[places], words.lengths[places]))
    out[at >= 0] = model.scores[0][at[at >= 0]]
    left = np.flatnonzero(at < 0)
    for n in range(LONGEST, 0, -1):
        if not len(left):
            break
        grams, of = _windows(words, places[left], n)
        at = lookup(model.hashes[n], grams)
        known = at >= 0
        hits = np.bincount(of[known], minlength=len(left))
        some = hits > 0
        for j in range(k):
            out[left[some], j] = np.bincount(of[known], model.scores[n][at[known], j], len(left))[some] / hits[some]
        left = left[~some]
    return out


def predict(df: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """df with the likeliest language and its posterior, languages alike before the text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def compute(texts):
        model = shared.value
        for column in texts:
            names, scores = [], []
            for start, stop in slices(column):
                words = Words(column.slice(start, stop - start))
                _, first, inverse = words.unique()
                said = evidence(model, words, first)
                n, k = stop - start, len(model.languages)
                total = np.stack([np.bincount(words.texts, said[inverse, j], n) for j in range(k)], 1) if k else np.zeros((n, 0))
                some = (np.bincount(words.texts, minlength=n) > 0) & (k > 0)
                best = total.argmax(1) if k else np.zeros(n, int)
                top = np.exp(total - total.max(1, keepdims=True)) if k else total
                posterior = top.max(1) / top.sum(1) if k else np.zeros(n)
                names += [model.languages[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist(), strict=True)]
                scores.append(np.where(some, posterior, 0.0))
            yield names, np.concatenate(scores) if scores else np.zeros(0)

    return add_columns(df, text_col, compute, [(pred_col, T.StringType(), pa.string()), (score_col, T.DoubleType(), pa.float64())])


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = fold("doc_id", 4) == 2
    model = fit(docs.filter(~held_out))
    return predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
