"""All pairs of vectors with a cosine of at least a threshold, by dual traversal of cover trees.

Equal vectors are one class with a multiplicity. Classes are dealt to cells around pivots: the nested levels of a cover with halving
radii over a bounded sample (SAMPLE vectors; one pivot for each PART vectors, as far as the sample goes), every vector to its nearest.
A cell's vectors make parts of about PART rows, and each part a cover tree, whose nodes' children cover them with half their radius;
it is built once and kept as a file of the shared folder. Two parts meet only if their cells' pivots and radii allow the threshold;
a task reads the two trees and traverses them together: node pairs whose centres are further apart than both covering radii and the
threshold distance are dropped, pairs that lie within it entirely are linked whole, others go down to their children, and leaves
that are left are compared by cosine in double precision. So the links found are exactly those that a comparison of all pairs finds.
Centres of all children of two nodes are compared at once; where vectors are spread evenly in many dimensions, that is most of the
work, as no two of them share a node small enough to drop others.

Cases: a vector that is null, empty, zero, or holds null or non-finite components links with nothing (n_links 0, kept); vectors of
different lengths do not link; equal vectors link with each other; a null id links by its vector and has no component of its own;
repeated rows are vectors of their own; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covary.llm.components import components
from covary.llm.store import discard, materialize, place_file, read_file, shared_dir

PART = 4096
SAMPLE = 4096
LEAF = 8
TIGHT = 0.1  # a leaf of several points is no wider
SLACK = 1e-6  # above the error of distances, sqrt(2 - 2 cos): that of a cosine, some 1e-14, is at most 2e-7 behind the root


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def cover(points: np.ndarray, some: np.ndarray, radius: float, centres: list[int]) -> tuple[list[int], np.ndarray]:
    """(centres, the centre's number for each of some): centres are added until each point is within the radius of one."""
    own = np.full(len(some), -1)
    for i, c in enumerate(centres):
        near = distances(points[c : c + 1], points[some])[0] <= radius
        own[near & (own < 0)] = i
    centres = list(centres)
    while True:
        left = np.flatnonzero(own < 0)
        if not len(left):
            return centres, own
        few = left[:64]  # the next centres are among these
        d = distances(points[some[few]], points[some[left]])
        for i, x in enumerate(few):
            if own[x] < 0:
                near = left[(d[i] <= radius) & (own[left] < 0)]
                own[near] = len(centres)
                own[x] = len(centres)
                centres.append(int(some[x]))


class CoverTree:
    """Nodes with a centre, the greatest distance of their points from it, children, and the points of leaves."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.centre, self.radius, self.children, self.members = [], [], [], []
        if len(points):
            self._add(np.arange(len(points)), 0, 2.0)

    def _add(self, some: np.ndarray, centre: int, reach: float) -> int:
        todo = [(some, centre, reach, -1)]
        while todo:
            some, centre, reach, parent = todo.pop()
            far = float(distances(self.points[centre : centre + 1], self.points[some]).max())
            if parent >= 0 and len(some) <= LEAF and far > TIGHT:
                # a wide leaf drops nothing: its few points are leaves by themselves
                for point in some.tolist():
                    self.children[parent].append(len(self.centre))
                    self.centre.append(point)
                    self.radius.append(0.0)
                    self.children.append([])
                    self.members.append(np.array([point]))
                continue
            node = len(self.centre)
            self.centre.append(centre)
            self.radius.append(far)
            self.children.append([])
            self.members.append(None)
            if parent >= 0:
                self.children[parent].append(node)
            if len(some) <= LEAF or far < 1e-7:
                self.members[node] = some
                continue
            while reach / 2 >= far:
                reach /= 2
            centres, own = cover(self.points, some, reach / 2, [centre])
            order = np.argsort(own, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
                todo.append((some[part], centres[own[part[0]]], reach / 2, node))
        return 0


def links(a: CoverTree, b: CoverTree, raw_a: np.ndarray, raw_b: np.ndarray, threshold: float, tally: dict | None = None):
    """Blocks (rows of a, rows of b, linked) that hold every pair with a cosine of the threshold or more.

    linked is None where all rows of a are linked with all of b, a matrix, or, of one dimension, says so of row i of a and row i of b.
    tally counts the pairs of centres compared, of nodes dropped and of vectors compared.
    """
    if not a.centre or not b.centre:
        return
    tally = {} if tally is None else tally
    limit = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    norm_a, norm_b = np.linalg.norm(raw_a, axis=1), np.linalg.norm(raw_b, axis=1)
    ra, rb = np.array(a.radius), np.array(b.radius)
    ca, cb = np.array(a.centre), np.array(b.centre)
    single_a, single_b = (np.array([m is not None and len(m) == 1 for m in t.members]) for t in (a, b))

    def count(what, n):
        tally[what] = tally.get(what, 0) + int(n)

    def rows(tree, node):
        out, todo = [], [node]
        while todo:
            x = todo.pop()
            if tree.members[x] is not None:
                out.append(tree.members[x])
            todo += tree.children[x]
        return np.concatenate(out)

    def compare(x, y):
        count("vectors", len(x) * len(y))
        found = (raw_a[x] @ raw_b[y].T) / (norm_a[x][:, None] * norm_b[y][None, :]) >= threshold
        if found.any():
            yield x, y, found

    def compare_each(x, y):
        count("vectors", len(x))
        for i in range(0, len(x), 65_536):
            p, q = x[i : i + 65_536], y[i : i + 65_536]
            found = np.einsum("ij,ij->i", raw_a[p], raw_b[q]) / (norm_a[p] * norm_b[q]) >= threshold
            if found.any():
                yield p[found], q[found], np.ones(int(found.sum()), bool)

    todo = [(0, 0)]
    while todo:
        x, y = todo.pop()
        # a leaf stands for itself, another node for its children
        left = np.array(a.children[x] or [x])
        right = np.array(b.children[y] or [y])
        for i in range(0, len(left), 1024):
            some = left[i : i + 1024]
            d = distances(a.points[ca[some]], b.points[cb[right]])
            both = ra[some][:, None] + rb[right][None, :]
            p, q = np.nonzero(d <= limit + both + SLACK)
            count("centres", d.size)
            count("dropped", d.size - len(p))
            u, v, near = some[p], right[q], d[p, q] + both[p, q] <= limit - SLACK
            alone = single_a[u] & single_b[v]
            yield from compare_each(ca[u[alone]], cb[v[alone]])
            for m, n, inside in zip(u[~alone].tolist(), v[~alone].tolist(), near[~alone].tolist(), strict=True):
                if inside:
                    yield rows(a, m), rows(b, n), None
                elif a.members[m] is not None and b.members[n] is not None:
                    yield from compare(a.members[m], b.members[n])
                else:
                    todo.append((m, n))


def _pack(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _name(width, cell, part) -> str:
    return f"{width}-{cell}-{part}.tree"


def _grow(uri: str):
    """A part's cover tree and vectors, written as a file; returns the part."""

    def run(table: pa.Table) -> pa.Table:
        raw = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        tree = CoverTree(unit(raw.astype(np.float64)))
        members = [m if m is not None else np.zeros(0, int) for m in tree.members]
        parents = np.full(len(members), -1)
        for node, below in enumerate(tree.children):
            parents[below] = node
        blob = _pack(ids=table["rep"].to_numpy(), times=table["times"].to_numpy(), raw=raw, centre=tree.centre, radius=tree.radius, parent=parents, members=np.concatenate(members), sizes=[len(m) for m in members])
        part = table.select(["width", "cell", "part"]).slice(0, 1)
        place_file(uri, _name(*(part[c][0].as_py() for c in part.column_names)), lambda sink: sink.write(blob))
        return part

    return run


def _load(blob: bytes):
    got = np.load(io.BytesIO(blob))
    raw = got["raw"].astype(np.float64)
    tree = CoverTree(np.zeros((0, 1)))
    tree.points, tree.centre, tree.radius = unit(raw), got["centre"].tolist(), got["radius"].tolist()
    tree.children = [[] for _ in tree.centre]
    for node, parent in enumerate(got["parent"].tolist()):
        if parent >= 0:
            tree.children[parent].append(node)
    tree.members = [m if len(m) else None for m in np.split(got["members"], np.cumsum(got["sizes"])[:-1])]
    return tree, raw, got["ids"], got["times"]


def _meet(uri: str, threshold: float):
    """Pairs of parts (or one, with itself) -> rows (a, b null, links of a) and edges (a, b, null) that connect what is linked."""

    def met(one, other, same):
        (a, raw_a, ids_a, times_a), (b, raw_b, ids_b, times_b) = one, other
        na, nb, edges = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64), set()
        for x, y, found in links(a, b, raw_a, raw_b, threshold):
            if found is None:
                na[x] += times_b[y].sum()
                nb[y] += times_a[x].sum()
                joined = [(x[:1].repeat(len(y)), y), (x, y[:1].repeat(len(x)))]
            elif found.ndim == 1:
                np.add.at(na, x, times_b[y])
                np.add.at(nb, y, times_a[x])
                joined = [(x, y)]
            else:
                na[x] += found @ times_b[y]
                nb[y] += found.T @ times_a[x]
                i, j = np.nonzero(found)
                joined = [(x[i], y[j])] if len(i) <= 4 * sum(found.shape) else [(x[k], y[m]) for k, m in _forest(found)]
            for p, q in joined:
                p, q = ids_a[p], ids_b[q]
                apart = p != q
                edges.update(zip(p[apart].tolist(), q[apart].tolist(), strict=True))
        if same:  # every pair was met from both sides, and each class with itself
            na -= times_a
            ids_b, nb = ids_b[:0], nb[:0]
        nodes, n = np.concatenate([ids_a, ids_b]), np.concatenate([na, nb])
        nodes, n = nodes[n > 0], n[n > 0]
        return pa.RecordBatch.from_arrays(
            [pa.array([*nodes.tolist(), *(p for p, _ in edges)], pa.int64()), pa.array([None] * len(nodes) + [q for _, q in edges], pa.int64()), pa.array([*n.tolist(), *([None] * len(edges))], pa.int64())],
            ["a", "b", "n"],
        )

    def run(batches):
        name, one = None, None
        for batch in batches:
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                if x != name:  # rows come in order of x
                    name, one = x, _load(read_file(uri, x))
                yield met(one, one if y == x else _load(read_file(uri, y)), x == y)

    return run


def _adjacent(shared, limit: float):
    """Cells -> the names of parts of theirs and of the same or later cells that may hold linked vectors."""

    def run(batches):
        pivots, cells = shared.value
        for batch in batches:
            for width, cell in zip(batch.column("width").to_pylist(), batch.column("cell").to_pylist(), strict=True):
                number, parts, radius = cells[width]
                at = int(np.searchsorted(number, cell))
                d = distances(pivots[width][cell][None], pivots[width][number[at:]])[0]
                x, y = [], []
                for k in np.flatnonzero(d <= radius[at] + radius[at:] + limit + SLACK).tolist():
                    for i in range(parts[at]):
                        for j in range(i if k == 0 else 0, parts[at + k]):
                            x.append(_name(width, cell, i))
                            y.append(_name(width, number[at + k], j))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()), pa.array(y, pa.string())], ["x", "y"])

    return run


def _forest(found: np.ndarray):
    """Edges that connect what a matrix of links connects, by breadth first search over whole rows and columns."""
    left = found.any(1)
    while left.any():
        root = int(np.argmax(left))
        rows = np.zeros(len(found), bool)
        rows[root], columns = True, found[root].copy()
        while True:
            more = found[:, columns].any(1)
            if (more == rows).all():
                break
            rows, columns = more, found[more].any(0)
        first = int(np.argmax(columns))
        yield np.flatnonzero(rows), np.full(int(rows.sum()), first)
        yield np.full(int(columns.sum()), root), np.flatnonzero(columns)
        left &= ~rows


def _assign(pivots):
    def run(batches):
        tops = pivots.value
        for batch in batches:
            width = batch.column("width").to_numpy()
            cell, far = np.zeros(len(width), np.int32), np.zeros(len(width))
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                points = unit(batch.column("vector").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1))
                d = distances(points, tops[int(w)])
                cell[at], far[at] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], [*batch.schema.names, "cell", "far"])

    return run


def pair_links(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", part: int = PART) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    v = F.col("vector")
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True))) & F.exists(v, lambda x: x != 0)
    rows = materialize(vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector")).withColumn("good", F.coalesce(good, F.lit(False))).withColumn("key", F.when(F.col("good"), F.sha2(F.to_json(F.struct("vector")).cast("binary"), 256))), "vectors")
    classes = rows.filter("good").groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("times"), F.first("vector").alias("vector"))
    # a class is a node under a number of its own, as ids may be null or repeated
    classes = classes.select("key", "least", F.xxhash64("key").alias("rep"), "times", F.size("vector").alias("width"), "vector")
    classes = materialize(classes, "classes")

    sizes = {r["width"]: r["n"] for r in classes.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per length of vector
    total = sum(sizes.values())
    share = F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(1 << 20)) < int(max(1, (1 << 20) * min(1.0, SAMPLE / max(1, total))))
    sample = classes.filter(share).select("width", "vector").limit(2 * SAMPLE).collect()
    tops = {}
    for w, n in sizes.items():
        points = [r["vector"] for r in sample if r["width"] == w] or [r["vector"] for r in classes.filter(F.col("width") == w).limit(1).collect()]
        points, want = unit(np.array(points, np.float64)), min(len(points), -(-n // part))
        centres, radius = [0], 2.0
        while len(centres) < want and radius > 1e-3:
            radius /= 2
            centres, _ = cover(points, np.arange(len(points)), radius, centres)
        tops[w] = points[centres[:want]]
    sc = spark.sparkContext
    placed = materialize(classes.select("rep", "times", "width", "vector").mapInArrow(_assign(sc.broadcast(tops)), f"rep bigint, times bigint, width int, vector array<{kind}>, cell int, far double"), "cells")
    cells = placed.groupBy("width", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
    cells = cells.orderBy("width", "cell").toPandas()  # at most 2 SAMPLE rows for each length
    if not len(cells):
        return rows.select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    cells["parts"] = -(-cells["n"] // part)
    of_width = {int(w): (x["cell"].to_numpy(), x["parts"].to_numpy(), x["radius"].to_numpy()) for w, x in cells.groupby("width")}
    limit = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    uri = shared_dir(spark, "trees")
    own = spark.createDataFrame(cells[["width", "cell", "parts"]], "width int, cell int, parts int")
    dealt = placed.join(F.broadcast(own), ["width", "cell"]).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "rep"), F.col("parts")).cast("int"))
    grown = materialize(dealt.select("width", "cell", "part", "rep", "times", "vector").groupBy("width", "cell", "part").applyInArrow(_grow(uri), "width int, cell int, part int"), "parts")
    names = grown.select(F.concat_ws("", F.concat_ws("-", "width", "cell", "part"), F.lit(".tree")).alias("name"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = own.repartition(n, "width", "cell").mapInArrow(_adjacent(sc.broadcast((tops, of_width)), limit), "x string, y string")
    for side in ("x", "y"):  # a hash may leave a part empty
        pairs = pairs.join(names.withColumnRenamed("name", side), side, "left_semi")
    pairs = pairs.select("x", "y").repartition(n, "x", "y").sortWithinPartitions("x", "y")
    found = materialize(pairs.mapInArrow(_meet(uri, threshold), "a bigint, b bigint, n bigint"), "links")
    discard(spark, uri)

    counts = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    labels = components(found.filter("b is not null").select("a", "b"))
    roots = classes.join(labels.withColumnRenamed("node", "rep"), "rep").groupBy("component").agg(F.min("least").alias("root"))
    known = classes.select("key", "rep", "times", "least").join(counts, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left").join(roots, "component", "left")
    known = known.select(F.col("key").alias("k"), (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("root", "least").alias("root"))
    out = rows.select("id", "key").join(known, F.col("key") == F.col("k"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return pair_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


OP8_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS m FROM v),
e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM n x, n y WHERE x.vec_id <> y.vec_id AND list_inner_product(x.e, y.e) / (x.m * y.m) >= 0.9),
r AS (SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.vec_id),
m AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY 1),
c AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN c USING (vec_id)
"""
