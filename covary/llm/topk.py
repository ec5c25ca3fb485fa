"""Exact top-k inner products: a KD-tree per shard, searched best first with the kth score handed from shard to shard.

Vectors are dealt to shards of about SHARD rows by a hash. A shard's tree splits at medians of the widest dimension down to
leaves of LEAF vectors, and every node keeps the tight box of its vectors. For a query, the greatest inner product that a box allows
bounds its node; nodes are visited best first until the best bound is below the kth score known. A first pass searches each query
in one shard and hands that kth score to the search of all others, and each shard's search goes on with what it has found.

Every shard's tree is built once and kept as a file of the shared folder, as are blocks of queries with the kth scores known; a task
reads a tree and a block by name, so that no vector goes through a shuffle more than once. What a search gives is k rows a query at most.

Cases: vectors that are null or hold null or non-finite components take no part, neither do rows without id; vectors of another
length than the query's have no score with it; equal scores go to the smaller id; rows that repeat an id are candidates each, but
not for queries of that id, which asks once, with the least of its vectors; fewer than k candidates give fewer rows; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covary.llm.store import discard, materialize, place_file, read_file, shared_dir

SHARD = 8192
LEAF = 128
QUERIES = 2048
SCALE = 256


class Tree:
    """Vectors (as float64 integers) in leaf order, and per node: box, range of rows, children."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(vectors))
        self.low, self.high, self.span, self.children = [], [], [], []
        stack = [(0, len(vectors), -1, 0)]
        while stack:
            start, stop, parent, side = stack.pop()
            mine = vectors[order[start:stop]]
            node = len(self.span)
            self.low.append(mine.min(0))
            self.high.append(mine.max(0))
            self.span.append((start, stop))
            self.children.append([-1, -1])
            if parent >= 0:
                self.children[parent][side] = node
            widest = int(np.argmax(self.high[node] - self.low[node]))
            if stop - start > leaf and self.high[node][widest] > self.low[node][widest]:
                middle = (stop - start) // 2
                order[start:stop] = order[start:stop][np.argpartition(mine[:, widest], middle)]
                stack += [(start, start + middle, node, 0), (start + middle, stop, node, 1)]
        self.vectors, self.ids = vectors[order], ids[order]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The greatest inner product that each node's box allows each query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, bounds: np.ndarray, own: int, k: int, least: float) -> list[tuple[float, int]]:
        """The k best (score, -id) with a score of at least `least`, best first; rows of the query's own id are left out."""
        best: list[tuple[float, int]] = []
        nodes = [(-bounds[0], 0)]
        while nodes:
            bound, node = heapq.heappop(nodes)
            floor = max(least, best[0][0]) if len(best) == k else least
            if -bound < floor:
                break
            children = self.children[node]
            if children[0] >= 0:
                for child in children:
                    if bounds[child] >= floor:
                        heapq.heappush(nodes, (-bounds[child], child))
                continue
            start, stop = self.span[node]
            scores = self.vectors[start:stop] @ query
            for i in np.flatnonzero(scores >= floor):
                found = (float(scores[i]), -int(self.ids[start + i]))
                if -found[1] == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
        return sorted(best, reverse=True)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _pack(uri: str, name: str, **arrays) -> None:
    out = io.BytesIO()
    np.savez(out, **arrays)
    place_file(uri, name, lambda sink: sink.write(out.getvalue()))


def _unpack(uri: str, name: str):
    return np.load(io.BytesIO(read_file(uri, name)))


def _plant(uri: str):
    """A shard's tree, written as a file; returns the shard."""

    def run(table: pa.Table) -> pa.Table:
        tree = Tree(_matrix(table["vector"]), table["id"].to_numpy())
        width, shard = table["width"][0].as_py(), table["shard"][0].as_py()
        _pack(uri, f"tree-{width}-{shard}", vectors=tree.vectors, ids=tree.ids, low=tree.low, high=tree.high, span=tree.span, children=tree.children)
        return table.select(["width", "shard"]).slice(0, 1)

    return run


def _tree(uri: str, width: int, shard: int) -> Tree:
    got, tree = _unpack(uri, f"tree-{width}-{shard}"), Tree.__new__(Tree)
    tree.vectors, tree.ids, tree.low, tree.high = (got[c] for c in ("vectors", "ids", "low", "high"))
    tree.span, tree.children = got["span"].tolist(), got["children"].tolist()
    return tree


def _ask(uri: str):
    """A block of queries, written as a file; returns the block."""

    def run(table: pa.Table) -> pa.Table:
        width, block = table["width"][0].as_py(), table["block"][0].as_py()
        _pack(uri, f"queries-{width}-{block}", vectors=_matrix(table["asked"]), ids=table["asker"].to_numpy())
        return table.select(["width", "block"]).slice(0, 1)

    return run


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _search(uri: str, k: int, first: bool):
    """(width, block, shard) -> what the block's queries find in the shard; the first search of a block leaves its kth scores as a file."""

    def run(batches):
        name, tree = None, None
        for batch in batches:
            for width, block, shard in zip(*(batch.column(c).to_pylist() for c in ("width", "block", "shard")), strict=True):
                if name != (width, shard):  # rows come in order of shards
                    name, tree = (width, shard), _tree(uri, width, shard)
                asked = _unpack(uri, f"queries-{width}-{block}")
                queries, owners = asked["vectors"], asked["ids"]
                least = np.full(len(owners), -np.inf) if first else _unpack(uri, f"least-{width}-{block}")["least"]
                out = [[], [], []]
                for i in range(0, len(queries), 256):
                    bounds = tree.bounds(queries[i : i + 256])
                    for q in range(i, i + len(bounds)):
                        found = tree.search(queries[q], bounds[q - i], int(owners[q]), k, least[q])
                        out[0] += [int(owners[q])] * len(found)
                        out[1] += [-v for _, v in found]
                        out[2] += [int(s) for s, _ in found]
                        if first and len(found) == k:
                            least[q] = found[-1][0]
                if first:
                    _pack(uri, f"least-{width}-{block}", least=least)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], schema=_FOUND)

    return run


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component as double, null if the vector or a component is null or not finite."""
    d = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(d, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    return F.when(~bad, F.transform(d, lambda x: F.floor(x * scale).cast("double")))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shard: int = SHARD, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score), once per query id: every query's k greatest integer inner products with rows of other ids."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), whole(F.col(vector_col), scale).alias("vector"), is_query.alias("asks")).filter("id is not null and vector is not null and size(vector) > 0")
    counts = rows.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).collect()  # a row per length of vector
    widest = max(((r["n"], r["q"]) for r in counts), default=(1, 1))
    shards, blocks = -(-widest[0] // shard), max(1, -(-widest[1] // queries))
    width = F.size("vector").alias("width")
    candidates = rows.select("id", "vector", width, F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"))
    asked = rows.filter("asks").groupBy("id").agg(F.min("vector").alias("vector")).select(F.col("id").alias("asker"), F.col("vector").alias("asked"), width, F.pmod(F.xxhash64(F.lit("q"), "id"), F.lit(blocks)).cast("int").alias("block"))
    uri = shared_dir(spark, "topk")
    form, n = "query_id bigint, vec_id bigint, score bigint", int(spark.conf.get("spark.sql.shuffle.partitions"))
    trees = materialize(candidates.groupBy("width", "shard").applyInArrow(_plant(uri), "width int, shard int"), "shards")
    asked = materialize(asked.groupBy("width", "block").applyInArrow(_ask(uri), "width int, block int"), "blocks")
    # a few numbers a pair of block and shard; the vectors are read by name
    met = asked.join(trees, "width").withColumn("home", F.min_by("shard", F.pmod(F.col("shard") - F.col("block"), F.lit(shards))).over(Window.partitionBy("width", "block")))

    def search(pairs: DataFrame, first: bool) -> DataFrame:
        ordered = pairs.select("width", "block", "shard").repartition(n, "width", "block", "shard").sortWithinPartitions("width", "shard", "block")
        return materialize(ordered.mapInArrow(_search(uri, k, first), form), "found")

    # first each block in one shard, which gives every query a kth score to start from
    found = search(met.filter("shard = home"), True)
    if shards > 1:
        found = found.union(search(met.filter("shard <> home"), False))
    discard(spark, uri)
    # each query's k best of at most k per shard, in two levels, so that no group grows with the shards
    entry, top = F.struct((-F.col("score")).alias("s"), "vec_id"), lambda x: F.slice(F.array_sort(x), 1, k)
    part = found.groupBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, int(shards**0.5)))).alias("part")).agg(top(F.collect_list(entry)).alias("best"))
    best = part.groupBy("query_id").agg(top(F.flatten(F.collect_list("best"))).alias("best"))
    out = best.select("query_id", F.posexplode("best").alias("pos", "b"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "b.vec_id", (-F.col("b.s")).alias("score"))


def op4_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
