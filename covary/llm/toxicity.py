"""Toxicity with noisy-channel deobfuscation.

Suspect spans (letters mixed with look-alike signs, single letters set apart, letters repeated three times and more) are lattices of
characters: each sign may stand for the letters it looks like, a separator may be dropped or kept, a run may be one letter or two.
Viterbi finds the likeliest reading under a character trigram model, whose counts come from all documents, and a channel cost per
change. The words of the text and of the restored spans are then scored by a lexicon of words and word beginnings, and a logistic
curve over what a document has of it gives the score.

The lexicon and the curve are fitted on at most about SAMPLE labelled documents: those whose hash of the id falls below a share;
two thirds of them, by another hash, give the lexicon, the others the curve. Scores read nothing but the text.

Cases: null and empty texts and texts without letters have nothing of the lexicon and get the curve's score for that; of several
labels of one document the highest counts, null labels none; without labels of both kinds every score is the share of toxic ones
(0 without labels); repeated rows and very long texts are scored like others.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covary.llm.letters import Words, add_columns, lookup
from covary.llm.lm import fold
from covary.llm.store import bounded_batches, columns, gives_back
from covary.llm.words import slices

SAMPLE = 20_000
LEAST, LIKELIER = 3, 0.7  # toxic documents with an entry of the lexicon, at least, and its log ratio
BEGINNINGS = (4, 6)
STRONG = 3.0

# Letters that signs are written for
LOOKS = {"0": "o", "1": "il", "!": "i", "|": "il", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "+": "t", "8": "b", "9": "g", "6": "g", "2": "z", "(": "c"}
ALPHABET = "abcdefghijklmnopqrstuvwxyzàâäáçèéêëîïíñôöóùûüúß"
_SIGNS = re.escape("".join(LOOKS))
_LETTERS = "a-zà-öø-ÿ"
SUSPECT = re.compile(
    rf"(?<![{_LETTERS}0-9])(?:[{_LETTERS}{_SIGNS}](?:[ ._*-]+[{_LETTERS}{_SIGNS}](?![{_LETTERS}0-9])){{2,}})"
    # both begin where their run of letters or signs does, so that a run is tried once and not from each of its places
    rf"|(?<![{_LETTERS}{_SIGNS}])[{_LETTERS}{_SIGNS}]*(?:[{_LETTERS}][{_SIGNS}]+[{_LETTERS}]|([{_LETTERS}])\1\1)[{_LETTERS}{_SIGNS}]*"
    rf"|(?<![{_SIGNS}])[{_SIGNS}]+[{_LETTERS}]{{2,}}"
)
SIGN_COST, DROP_COST, KEEP_COST, RUN_COST, LETTER_COST = 1.0, 0.3, 2.0, 0.7, 0.05
_SIZE = len(ALPHABET) + 2  # an edge, the letters, any other letter
_INDEX = {c: i + 1 for i, c in enumerate(ALPHABET)}


def _symbols(low: np.ndarray) -> np.ndarray:
    table = np.full(0x250, _SIZE - 1, np.int64)
    table[0] = 0
    for c, i in _INDEX.items():
        table[ord(c)] = i
    return np.where(low < 0x250, table[np.minimum(low, 0x24F)], _SIZE - 1)


def _trigrams(batches):
    total = np.zeros(_SIZE**3, np.int64)
    for batch in batches:
        for start, stop in slices(batch.column("text")):
            words = Words(batch.column("text").slice(start, stop - start))
            s = _symbols(words.low)
            use, third = (s[1:-1] > 0) | (s[:-2] > 0), s[2:].copy()
            third[words.at[1:] - 1] = 0  # behind a text's end, whatever text is next in the batch
            total += np.bincount((s[:-2] * _SIZE + s[1:-1])[use] * _SIZE + third[use], minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["at", "n"])


def char_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probability of a character after two others, over the words of all documents (a table of fixed size)."""
    got = columns(docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(gives_back(_trigrams), "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")))
    n = np.zeros(_SIZE**3)
    n[got["at"]] = got["n"]
    n = n.reshape(_SIZE, _SIZE, _SIZE)
    pair = n.sum(0) + 0.1
    pair /= pair.sum(1, keepdims=True)
    return np.log((n + 5 * pair[None]) / (n.sum(2, keepdims=True) + 5)).astype(np.float32)


def lattice(span: str) -> list[list[tuple[str, float]]]:
    """Each position's readings (letters, cost): the sign's letters, nothing or a space for a separator, one or two of a run."""
    out: list[list[tuple[str, float]]] = []
    for m in re.finditer(r"(.)\1*", span, re.DOTALL):
        c, n = m[1], len(m[0])
        if c.isalpha():
            out.append([(c * n, 0.0)] if n == 1 else [(c, RUN_COST), (c * 2, 0.0 if n == 2 else RUN_COST)])
        elif c in LOOKS:
            out.append([(x * k, SIGN_COST) for x in LOOKS[c] for k in ((1,) if n == 1 else (1, 2))])
        else:
            out.append([("", DROP_COST), (" ", KEEP_COST)])
    return out


def restore(span: str, model: np.ndarray) -> str:
    """The likeliest reading: Viterbi over the lattice, a state being the last two characters."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for readings in lattice(span):
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (value, path) in states.items():
            for letters, cost in readings:
                p, q, total = a, b, value - cost
                for c in letters:
                    r = 0 if c == " " else _INDEX.get(c, _SIZE - 1)
                    total += float(model[p, q, r]) + LETTER_COST
                    p, q = q, r
                if (p, q) not in after or total > after[p, q][0]:
                    after[p, q] = (total, (path, letters))
        states = after
    _, path = max(((value + float(model[a, b, 0]), path) for (a, b), (value, path) in states.items()), key=lambda x: x[0])
    out = []
    while path is not None:
        path, letters = path
        out.append(letters)
    return "".join(reversed(out))


def reader(model: np.ndarray):
    """restore, with readings of spans of ordinary length kept."""
    short = lru_cache(1 << 15)(lambda span: restore(span, model))
    return lambda span: short(span) if len(span) <= 64 else restore(span, model)


def restored_words(text: str, read) -> list[str]:
    """The words of the suspect spans' readings that the text does not have as they stand."""
    out = []
    for m in SUSPECT.finditer(text.lower()):
        span = m[0].rstrip("!|$+( ._*-")
        made = read(span)
        if made != span:
            out += made.split()
    return out


@dataclass
class Model:
    characters: np.ndarray
    hashes: np.ndarray
    weights: np.ndarray
    curve: np.ndarray  # of (1, most, strong words, mean)


def _features(words: Words, places: np.ndarray) -> list[np.ndarray]:
    """Hashes of the words and of their beginnings (0 where a word is no longer than that)."""
    starts, lengths = words.starts[places], words.lengths[places]
    out = [words.hashes(starts, lengths)]
    for k in BEGINNINGS:
        some = np.flatnonzero(lengths > k)
        made = np.zeros(len(places), np.uint64)
        made[some] = words.hashes(starts[some], np.full(len(some), k), salt=k)
        out.append(made)
    return out


def _with_restored(column: pa.Array, read) -> pa.Array:
    """The texts, each with the words of its restored spans behind it."""
    out = []
    for text in column.to_pylist():
        more = restored_words(text, read) if text else []
        out.append(f"{text}\n{' '.join(more)}" if more else text)
    return pa.array(out, pa.string())


def _count(characters):
    def run(batches):
        read = reader(characters.value)
        for batch in batches:
            for start, stop in slices(batch.column("text")):
                words = Words(_with_restored(batch.column("text").slice(start, stop - start), read))
                toxic = np.asarray(batch.column("toxic").slice(start, stop - start)).astype(np.int64)
                _, first, inverse = words.unique()
                pairs = np.unique(words.texts * len(first) + inverse)
                texts, word = pairs // max(1, len(first)), pairs % max(1, len(first))
                for hashes in _features(words, first):
                    own = np.unique(np.stack([texts.astype(np.uint64), hashes[word]]), axis=1) if len(word) else np.zeros((2, 0), np.uint64)
                    keys, place = np.unique(own[1], return_inverse=True)
                    mine = toxic[own[0].astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(place, mine, len(keys)).astype(np.int64)), pa.array(np.bincount(place, 1 - mine, len(keys)).astype(np.int64))], ["hash", "toxic", "clean"])

    return run


def _measure(shared):
    """(most, strong words, mean weight above 0) of every text, by the lexicon."""

    def compute(texts):
        model = shared.value
        read = reader(model.characters)
        for column in texts:
            parts = []
            for start, stop in slices(column):
                words = Words(_with_restored(column.slice(start, stop - start), read))
                _, first, inverse = words.unique()
                weight = np.zeros(len(first))
                for hashes in _features(words, first):
                    at = lookup(model.hashes, hashes)
                    weight = np.maximum(weight, np.where(at >= 0, model.weights[at] if len(model.weights) else 0.0, 0.0))
                own = weight[inverse]
                most, n = np.zeros(words.n), np.bincount(words.texts, minlength=words.n)
                np.maximum.at(most, words.texts, own)
                strong = np.bincount(words.texts, own > STRONG, words.n)
                parts.append((most, np.log1p(strong), np.bincount(words.texts, own, words.n) / np.maximum(n, 1)))
            yield [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0)] * 3

    return compute


_FIELDS = ["most", "strong", "mean"]


def _columns(prefix: str):
    return [(prefix + x, T.DoubleType(), pa.float64()) for x in _FIELDS]


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton's method on a few columns."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learns from the labelled rows; the character model from all rows of docs."""
    spark = bounded_batches(docs.sparkSession)
    characters = char_model(docs, text_col)
    known = labels.select(F.col(id_col).alias("_labelled"), F.col(label_col).alias("toxic")).filter("_labelled is not null and toxic is not null").groupBy("_labelled").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    total = known.count()
    if total > sample:
        known = known.filter(F.pmod(F.xxhash64(F.lit("sample"), "_labelled"), F.lit(1 << 20)) < int((1 << 20) * sample / total))
    rows = docs.select(F.col(id_col).alias("_labelled"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "_labelled")  # at most about `sample` labels
    part = F.pmod(F.xxhash64(F.lit("part"), "_labelled"), F.lit(3))
    shared = spark.sparkContext.broadcast(characters)
    lexicon, rest = rows.filter(part > 0), rows.filter(part == 0)
    n = {r["toxic"]: r["count"] for r in lexicon.groupBy("toxic").count().collect()}  # a row per label
    p, q = n.get(1, 0), n.get(0, 0)
    empty = np.zeros(0, np.uint64), np.zeros(0)
    if not p or not q:
        share = (p + 0.0) / max(1, p + q)
        return Model(characters, *empty, np.array([np.log(max(share, 1e-12) / max(1 - share, 1e-12)), 0, 0, 0]))
    counts = lexicon.select("text", "toxic").mapInArrow(gives_back(_count(shared)), "hash bigint, toxic bigint, clean bigint").groupBy("hash").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    weight = F.log((F.col("a") + 0.5) / (p + 1)) - F.log((F.col("b") + 0.5) / (q + 1))
    found = columns(counts.filter((F.col("hash") != 0) & (F.col("a") >= LEAST)).withColumn("weight", weight).filter(F.col("weight") > LIKELIER).select("hash", "weight"))  # of a bounded sample
    hashes = found["hash"].view(np.uint64)
    order = np.argsort(hashes)
    model = Model(characters, hashes[order], found["weight"][order], np.zeros(4))
    measured = columns(add_columns(rest.select("text", "toxic"), "text", _measure(spark.sparkContext.broadcast(model)), _columns("")).select("toxic", *_FIELDS))
    if len(np.unique(measured["toxic"])) < 2:  # nothing to fit the curve on
        model.curve = np.array([-4.0, 2.0, 0.0, 0.0])
    else:
        model.curve = _curve(np.stack([measured[x] for x in _FIELDS], 1), measured["toxic"].astype(float))
    return model


def score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """df with the score (0 to 1) of every row's text."""
    measure, curve = _measure(df.sparkSession.sparkContext.broadcast(model)), model.curve

    def compute(texts):
        for x in measure(texts):
            yield [1 / (1 + np.exp(-np.clip(curve[0] + sum(b * v for b, v in zip(curve[1:], x, strict=True)), -700, 700)))]

    return add_columns(df, text_col, compute, [(score_col, T.DoubleType(), pa.float64())])


def held_out(id_col: str) -> Column:
    return fold(id_col, 5) == 0


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels.filter(~held_out("doc_id")))
    out = score(docs.select("doc_id", "text", held_out("doc_id").alias("held_out")), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
