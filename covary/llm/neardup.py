"""Near-duplicate documents by min-max hashing of word shingles, confirmed on full shingle sets.

Under each of PERMUTATIONS hash functions a document keeps both the least and the greatest value of its shingles, so that N
functions give 2N nearly independent values, each equal for two documents with a chance of their similarity. bands of 7 values
(6 below a similarity of 0.85) make buckets: at a similarity of 0.85 all 40 bands miss with a chance of 2e-7, at 0.8 all 46 with 9e-7.

Documents with equal sets are one class from the start. Within a bucket classes are first compared with one leader, the class that
shares most bucket places with others; buckets with classes that are still apart after that are compared in blocks, all with all. A pair is a link if and only if its full sets say so. Links end in connected components.

Cases: a null or empty text, or one without words, has the empty set and is linked with nothing; a text of fewer than k words is one
shingle; repeated rows (also of one id) each get a row; null ids are in no component (null, kept); other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covary.llm.components import components
from covary.llm.store import bounded_batches, discard, gives_back, materialize
from covary.llm.words import U, mix, slices, text_bytes, word_hashes

K = 5
PERMUTATIONS = 140
SHARE, OF = 85, 100
BLOCK = 256
SLICE = 1 << 18  # bytes of text that are hashed at once

_rng = np.random.default_rng(11)
_FACTORS = (_rng.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_SHIFTS = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)[:, None]
_ORDER = _rng.integers(0, 2**63, 64, dtype=np.uint64) * U(2) + U(1)


def shingle_sets(column: pa.Array, k: int = K) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    data, at = text_bytes(column)
    hashes, texts, _, _ = word_hashes(data, at)
    bounds = np.searchsorted(texts, np.arange(len(column) + 1))
    if len(hashes) >= k:
        rolled = sum((hashes[j : len(hashes) - k + 1 + j] * _ORDER[j] for j in range(1, k)), hashes[: len(hashes) - k + 1] * _ORDER[0])
        rolled = mix(rolled)
    out = []
    for i in range(len(column)):
        low, high = bounds[i], bounds[i + 1]
        if high - low >= k:
            out.append(np.unique(rolled[low : high - k + 1]))
        elif high > low:
            out.append(mix(np.array([(hashes[low:high] * _ORDER[: high - low]).sum() + U(high - low)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def min_max(shingles: np.ndarray) -> np.ndarray:
    """The least and the greatest value of a set under each permutation, PERMUTATIONS of each."""
    low = np.full(PERMUTATIONS, 2**32 - 1, np.uint32)
    high = np.zeros(PERMUTATIONS, np.uint32)
    short = (shingles >> U(32)).astype(np.uint32)
    for i in range(0, len(short), 2048):
        values = short[None, i : i + 2048] * _FACTORS + _SHIFTS
        values ^= values >> np.uint32(15)
        values *= np.uint32(0x2C1B3C6D)
        np.minimum(low, values.min(1), out=low)
        np.maximum(high, values.max(1), out=high)
    return np.concatenate([low, high])


def layout(share: int, of: int) -> tuple[int, int]:
    """(bands, values of each) for a threshold."""
    rows = 7 if share * 20 >= 17 * of else 6
    return 2 * PERMUTATIONS // rows, rows


def band_keys(signature: np.ndarray, n: int, rows: int) -> np.ndarray:
    values = signature[: n * rows].reshape(n, rows).astype(np.uint64)
    return mix((values * _ORDER[:rows]).sum(1) + np.arange(1, n + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


def _signatures(n: int, rows: int):
    def run(batches):
        for batch in batches:
            for start, stop in slices(batch.column("text"), SLICE):
                sets = shingle_sets(batch.column("text").slice(start, stop - start))
                keys = [(int(x.sum() >> U(1)), int((mix(x ^ U(0x5851F42D4C957F2D))).sum() >> U(1))) if len(x) else (0, 0) for x in sets]
                found = np.array([band_keys(min_max(x), n, rows) if len(x) else np.zeros(n, np.uint64) for x in sets]).reshape(len(sets), n)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(start, stop - start),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([k[0] for k in keys], pa.int64()),
                        pa.array([k[1] for k in keys], pa.int64()),
                        pa.FixedSizeListArray.from_arrays(pa.array(found.ravel().view(np.int64)), n).cast(pa.list_(pa.int64())),
                    ],
                    ["id", "n", "k1", "k2", "bands"],
                )

    return run


def _confirm(share: int, of: int):
    def run(batches):
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = shingle_sets(part.column("text_a"))
                leaders = part.column("text_b").to_pylist()
                if len(known) > 512:
                    known.clear()
                new = [x for x in dict.fromkeys(leaders) if x not in known]
                known.update(zip(new, shingle_sets(pa.array(new, pa.string())), strict=True))
                linked = []
                for x, text in zip(sets, leaders, strict=True):
                    other = known[text]
                    both = len(np.intersect1d(x, other, assume_unique=True))
                    linked.append(of * both >= share * (len(x) + len(other) - both))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(linked)], ["a", "b", "linked"])

    return run


def confirm(pairs: DataFrame, texts: DataFrame, share: int, of: int) -> DataFrame:
    """(a, b, linked) of the pairs by their full sets. texts: (id, text). An id with several texts is linked if one of them is."""
    used = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    kept = materialize(texts.join(used.hint("merge"), "id", "left_semi"), "pair-texts")
    left = pairs.hint("merge").join(kept.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.hint("merge").join(kept.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    kind = pairs.schema["a"].dataType.simpleString()
    found = both.mapInArrow(gives_back(_confirm(share, of)), f"a {kind}, b {kind}, linked boolean")
    out = materialize(found.groupBy("a", "b").agg(F.max("linked").alias("linked")), "confirmed")
    discard(pairs.sparkSession, kept._covary_path)
    return out


def _cross(share: int, of: int):
    """A link for each two labels that have one within a block of texts or between two."""

    def run(table: pa.Table) -> pa.Table:
        reps, labels, sides = (table[c].to_numpy() for c in ("rep", "label", "side"))
        sets = [x for chunk in table["text"].chunks for x in shingle_sets(chunk)]
        first = np.flatnonzero(sides == 0)
        second = np.flatnonzero(sides == 1) if (sides == 1).any() else first
        sizes = np.array([len(x) for x in sets])
        here, there = (np.unique(np.concatenate([sets[i] for i in side])) for side in (first, second))
        common = np.intersect1d(here, there, assume_unique=True)
        both = np.zeros((len(first), len(second)), np.float32)
        for i in range(0, len(common), 8192):  # exact counts: whole numbers below 2^24
            part = common[i : i + 8192]
            both += _incidence([sets[j] for j in first], part) @ _incidence([sets[j] for j in second], part).T
        total = sizes[first][:, None] + sizes[second][None, :] - both
        linked = (of * both.astype(np.float64) >= share * total.astype(np.float64)) & (labels[first][:, None] != labels[second][None, :])
        found = {(max(labels[first[i]], labels[second[j]]), min(labels[first[i]], labels[second[j]])) for i, j in zip(*np.nonzero(linked), strict=True)}
        return pa.table({"a": pa.array([x for x, _ in found], table["label"].type), "b": pa.array([x for _, x in found], table["label"].type)})

    return run


def _incidence(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(columns)), np.float32)
    for row, x in enumerate(sets):
        at = np.minimum(np.searchsorted(columns, x), len(columns) - 1)
        out[row, at[columns[at] == x]] = 1
    return out


def _blocks(own: DataFrame, rows: DataFrame, share: int, of: int) -> DataFrame:
    """Links (a, b) between labels of the same bucket. own: (bucket, rep, label, blocks).

    A bucket's classes are dealt to blocks of about BLOCK; each two blocks are compared in a task of their own by a product of
    their incidence matrices, so that no pair is ever a row.
    """
    block = F.pmod(F.xxhash64(F.lit("block"), "rep"), F.col("blocks")).cast("int")
    dealt = own.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "rep", "label")
    texts = rows.join(own.select(F.col("rep").alias("id")).distinct().hint("merge"), "id", "left_semi")
    both = dealt.hint("merge").join(texts.withColumnRenamed("id", "rep"), "rep")
    kind = own.schema["rep"].dataType.simpleString()
    return both.groupBy("bucket", "x", "y").applyInArrow(_cross(share, of), f"a {kind}, b {kind}").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE, of: int = OF) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: documents are linked if of * |A & B| >= share * |A | B|.

    The bands are laid out for share / of of 0.8 and more; below that they would miss links.
    """
    if share * 10 < 8 * of:
        raise ValueError("the bands miss links below a similarity of 0.8")
    spark = bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    made = materialize(rows.mapInArrow(gives_back(_signatures(*layout(share, of))), f"id {kind}, n bigint, k1 bigint, k2 bigint, bands array<bigint>"), "signatures")
    some = made.filter("n > 0 and id is not null")
    classes = materialize(some.groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands")), "classes")

    places = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    shared = places.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    places = materialize(places.hint("merge").join(shared, "bucket"), "places")
    weight = places.groupBy(F.col("rep").alias("r")).agg(F.sum(F.col("m") - 1).alias("weight"))
    weighed = places.hint("merge").join(weight, F.col("rep") == F.col("r"))
    leader = weighed.groupBy("bucket").agg(F.min_by(F.struct(F.col("rep").alias("b"), F.col("n").alias("nb")), F.struct(-F.col("weight"), F.col("rep"))).alias("l")).select("bucket", "l.b", "l.nb")
    fits = lambda x, y: F.least(x, y) * of >= F.greatest(x, y) * share
    pairs = places.hint("merge").join(leader, "bucket").filter((F.col("rep") != F.col("b")) & fits(F.col("n"), F.col("nb"))).select(F.col("rep").alias("a"), "b").distinct()
    first = confirm(materialize(pairs, "pairs"), rows, share, of)
    links = first.filter("linked").select("a", "b")
    labels = components(links)

    own = materialize(places.hint("merge").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("label")), "labelled")
    open_ = own.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("rep")).alias("who"))
    # of two places the pair is known; of buckets with the same classes one is enough
    open_ = open_.filter("low <> high and m > 2").groupBy("who", "m").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    met = materialize(_blocks(own.join(open_, "bucket"), rows, share, of), "met")
    if met.limit(1).count():
        labels = components(links.union(met))
    labels = materialize(labels, "labels")

    reps = classes.select("k1", "k2", F.col("n").alias("size"), "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", "size", F.coalesce("component", "rep").alias("component_id"))
    same = (made["k1"] == reps["k1"]) & (made["k2"] == reps["k2"]) & (made["n"] == reps["size"]) & made["id"].isNotNull()
    out = made.drop("bands").hint("merge").join(reps, same, "left")
    component = F.coalesce("component_id", "id")
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))



def op6_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE unnest(list_transform(range(greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) END AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.doc_id),
m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""
