"""Approximate nearest neighbours: a forest of random-projection trees per shard, searched through one shared priority queue, then exact reranking.

Rows are dealt to shards by a hash; a shard's trees are built from all its rows, so every row is in every tree of its shard. A node
projects its rows on a random direction, the difference of two of them, and splits them at the median; equal rows stay in one leaf.
A query's nodes of all trees wait in one queue, ordered by the worst margin on their path; leaves are opened in that order until
the wanted share of the shard's rows is seen, and those rows are ranked by their exact distances.

The share is measured on the table itself: SAMPLE rows (those of the least hashes, a documented bound) are compared with all rows
of all shards, the trees are walked until each of their k nearest rows turns up, and the share at which RECALL of these were seen
is taken for all queries. Clustered vectors need a small share; evenly spread ones of many dimensions need a large one.

Cases: vectors that are null, empty, zero or hold null or non-finite components and rows without id take no part; vectors of
another length than the query's have no distance to it; rows of the query's own id are no candidates; an id that is repeated among
queries asks once, with the least of its vectors; rows that repeat an id are candidates each; equal distances go to the smaller id;
fewer than k candidates give fewer rows; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covary.llm.blocks import deal, finite, first, load, matrix, pairs, rows_per_block
from covary.llm.store import discard, materialize, place_file, read_file, shared_dir

SHARD = 16384
TREES = 16
LEAF = 32
QUERIES = 4096
K = 10
RECALL = 0.98
SAMPLE = 128
CHUNK = 128  # queries whose margins are held at once


def _split(vectors: np.ndarray, rows: np.ndarray, rng: np.random.Generator):
    """A unit direction, the offset of the median along it and which rows lie below; None if all rows are equal."""
    for attempt in range(3):
        a, b = rng.integers(0, len(rows), 2)
        way = vectors[rows[a]] - vectors[rows[b]] if attempt < 2 else rng.normal(size=vectors.shape[1])
        length = np.linalg.norm(way)
        if length > 0 and np.isfinite(length):
            way = (way / length).astype(np.float32)
            along = vectors[rows] @ way
            if along.max() > along.min():
                offset = float(np.median(along))
                below = along < offset
                return way, offset, below if below.any() else along <= offset
    return None


class Forest:
    """Trees over rows of vectors: inner nodes have planes, offsets and two kids each; a kid below 0 is leaf ~kid, a span of `order`."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 0):
        rng, n = np.random.default_rng(seed), len(vectors)
        order = np.tile(np.arange(n, dtype=np.int32), (trees, 1))
        planes, offsets, kids, spans, roots = [], [], [], [], []
        for tree in range(trees):
            stack = [(0, n, -1, 0)]
            while stack:
                start, stop, parent, side = stack.pop()
                rows = order[tree, start:stop]
                split = _split(vectors, rows, rng) if stop - start > leaf else None
                if split is None:
                    node = ~len(spans)
                    spans.append((tree * n + start, tree * n + stop))
                else:
                    node, (way, offset, below) = len(planes), split
                    planes.append(way)
                    offsets.append(offset)
                    kids.append([0, 0])
                    middle = start + int(below.sum())
                    order[tree, start:stop] = np.concatenate([rows[below], rows[~below]])
                    stack += [(start, middle, node, 0), (middle, stop, node, 1)]
                if parent < 0:
                    roots.append(node)
                else:
                    kids[parent][side] = node
        self.planes = np.array(planes, np.float32).reshape(len(planes), vectors.shape[1])
        self.offsets, self.kids, self.spans = np.array(offsets), np.array(kids, np.int32).reshape(-1, 2), np.array(spans, np.int64)
        self.roots, self.order, self.links = np.array(roots, np.int32), order.ravel(), kids

    NAMES = ("planes", "offsets", "kids", "spans", "roots", "order")

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{c: getattr(self, c) for c in self.NAMES})
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Forest:
        got, self = np.load(io.BytesIO(data)), cls.__new__(cls)
        for c in cls.NAMES:
            setattr(self, c, got[c])
        self.links = self.kids.tolist()
        return self

    def margins(self, queries: np.ndarray) -> np.ndarray:
        return queries @ self.planes.T - self.offsets

    def leaves(self, margins: np.ndarray):
        """Leaves of all trees, those of the smallest worst margin first."""
        margins, kids = margins.tolist(), self.links
        queue = [(-np.inf, int(root)) for root in self.roots]
        heapq.heapify(queue)
        while queue:
            worst, node = heapq.heappop(queue)
            if node < 0:
                start, stop = self.spans[~node]
                yield self.order[start:stop]
            else:
                below, above = kids[node]
                heapq.heappush(queue, (max(worst, margins[node]), below))
                heapq.heappush(queue, (max(worst, -margins[node]), above))

    def candidates(self, margins: np.ndarray, n: int, wanted: int) -> np.ndarray:
        """The rows of the first leaves that hold `wanted` rows together."""
        seen, got, count = np.zeros(n, bool), [], 0
        for leaf in self.leaves(margins):
            new = leaf[~seen[leaf]]
            seen[new] = True
            got.append(new)
            count += len(new)
            if count >= wanted:
                break
        return np.concatenate(got)

    def depths(self, margins: np.ndarray, n: int, rows: np.ndarray) -> np.ndarray:
        """How many of the n rows are seen when each of `rows` is."""
        seen, out, count, left = np.zeros(n, bool), np.full(len(rows), n), 0, len(rows)
        for leaf in self.leaves(margins):
            new = leaf[~seen[leaf]]
            seen[new] = True
            count += len(new)
            turned = seen[rows] & (out == n)
            out[turned] = count
            left -= int(turned.sum())
            if left <= 0 or count == n:
                break
        return out


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((vectors - query) ** 2).sum(1))


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("depth", pa.float64())])
_FORM = "query_id bigint, vec_id bigint, score double, depth double"


def _visit(uri: str, asked: str, k: int, share: float | None):
    """(width, block, run, part) in order -> each query's k nearest over a run of shards. share 1: of all rows; None: of all rows, with the share at which each turns up."""

    def run(batches):
        mine, best, queries, ids = None, {}, None, None

        def rows():
            out = [(int(ids[q]), *x) for q, found in best.items() for x in found]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 4, _FOUND, strict=True)], schema=_FOUND)

        for batch in batches:
            for width, block, number, part in zip(*(batch.column(c).to_pylist() for c in ("width", "block", "run", "part")), strict=True):
                if mine != (width, block, number):
                    if mine is not None:
                        yield rows()
                    if mine is None or mine[:2] != (width, block):
                        table = load(uri, asked, width, block)
                        queries, ids = matrix(table["vector"]), table["id"].to_numpy()
                    mine, best = (width, block, number), {}
                shard = load(uri, "shard", width, part)
                vectors, names = matrix(shard["vector"]), shard["id"].to_numpy()
                forest = Forest.unpacked(read_file(uri, f"forest-{width}-{part}")) if share is None or share < 1 else None
                n = len(names)
                for start in range(0, len(queries), CHUNK):
                    margins = forest.margins(queries[start : start + CHUNK]) if forest else None
                    for q in range(start, min(start + CHUNK, len(queries))):
                        near = np.arange(n) if share is None or share >= 1 else forest.candidates(margins[q - start], n, int(np.ceil(share * n)))
                        near = near[names[near] != ids[q]]
                        far = distances(vectors[near], queries[q])
                        top = first(far, names[near], k)
                        depth = forest.depths(margins[q - start], n, near[top]) / n if share is None else np.zeros(len(top))
                        found = best.get(q, []) + list(zip(names[near[top]].tolist(), far[top].tolist(), depth.tolist(), strict=True))
                        best[q] = sorted(found, key=lambda x: (x[1], x[0]))[:k]
        if mine is not None:
            yield rows()

    return run


def _nearest(found: DataFrame, k: int) -> DataFrame:
    """Each query's k nearest of k a run."""
    down = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(down)).filter(F.col("rank") <= k)


def nearest(
    vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", share: float | None = None,
    recall: float = RECALL, sample: int = SAMPLE, shard: int = SHARD, trees: int = TREES, leaf: int = LEAF, queries: int = QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): every query's k nearest rows by Euclidean distance, as found. share: of each shard's rows that is ranked, by default as measured for `recall`; 1 gives exact results."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), finite(F.col(vector_col)).alias("vector"), is_query.alias("asks"))
    rows = rows.filter("id is not null and vector is not null").filter(F.exists("vector", lambda x: x != 0))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q"), F.max(F.size("vector")).alias("width")).first()
    uri, partitions = shared_dir(spark, "forest"), int(spark.conf.get("spark.sql.shuffle.partitions"))

    def plant(table: pa.Table, width: int, block: int) -> None:
        forest = Forest(matrix(table["vector"]), trees, leaf, seed=block)
        place_file(uri, f"forest-{width}-{block}", lambda sink: sink.write(forest.packed()))

    count = -(-size["n"] // rows_per_block(shard, size["width"]))
    shards = deal(rows.select("id", "vector"), uri, "shard", count, plant if share is None or share < 1 else None)

    def visit(asked: DataFrame, name: str, share: float | None, run: Column) -> DataFrame:
        return materialize(_nearest(pairs(asked, shards, run, partitions).mapInArrow(_visit(uri, name, k, share), _FORM), k), "found")

    if share is None:
        few = rows.select("id", "vector").orderBy(F.xxhash64("id", "vector"), "id").limit(sample).groupBy("id").agg(F.min("vector").alias("vector"))
        sampled = visit(deal(few, uri, "sample", 1), "sample", None, F.col("part"))  # each shard may have a task of its own
        depths = [r["depth"] for r in sampled.select("depth").collect()]  # sample * k numbers
        share = float(np.quantile(depths, recall, method="higher")) if depths else 1.0
    asked = rows.filter("asks").groupBy("id").agg(F.min("vector").alias("vector"))
    asked = deal(asked, uri, "queries", -(-size["q"] // rows_per_block(queries, size["width"])))
    out = visit(asked, "queries", share, F.pmod(F.col("part"), F.lit(max(1, round(count**0.5))))).select("query_id", "rank", "vec_id", "score")
    discard(spark, uri)
    return out


def op13_projection_forest(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
