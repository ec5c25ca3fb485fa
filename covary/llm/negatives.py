"""Hard negatives: for each anchor and positive, the rows of other labels that score just below the positive; exact, by slots.

An anchor's positives are its k best rows of the same label; each gives a window of scores, from low / of of the positive's score up
to that score. Windows of one anchor overlap, so their upper limits cut the scores into disjoint slots: slot j holds the scores
up to the jth limit and above the next one. A row of another label falls into one slot, a slot keeps its k best rows, in tasks
first and then over all tasks, and a window's answer is the first k of its own slot and all lower ones, merged from the lowest
slot upwards, as far as its lower limit reaches. No window is searched by itself.

Candidates lie in blocks (`blocks.py`); a task holds a block of anchors and passes over a run of candidate blocks, first for
positives, then for slots. Its results are k rows an anchor, or k a slot, whatever the candidates' number or labels.

Cases: vectors that are null, empty or hold null or non-finite components, rows of null label and rows without id take no part; vectors
of another length than the anchor's have no score with it; a row of the anchor's own id is neither positive nor negative;
an id that is repeated among anchors asks once, with the least of its (label, vector); rows that repeat an id are candidates
each; equal scores go to the smaller id; a positive of a score below 0 has an empty window (its lower limit is the higher one);
anchors without positives and positives without negatives give no rows; an empty table gives none; other columns are not read.
Components are whole numbers after scaling; scores beyond 64 bits are held at their ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covary.llm.blocks import codes, deal, first, inner, load, matrix, pairs, rows_per_block
from covary.llm.store import discard, place_file, read_file, materialize, shared_dir
from covary.llm.topk import whole

SCALE = 256
POSITIVES = 5
K = 5
LOW, OF = 80, 100
CANDIDATES = 8192
ANCHORS = 4096
CHUNK = 256  # anchors whose scores are held at once

_FOUND = pa.schema([("width", pa.int32()), ("block", pa.int32()), ("at", pa.int32()), ("slot", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])
_FORM = "width int, block int, at int, slot int, id bigint, score bigint"
_KEY = ["width", "block", "at"]


class Kept:
    """The k best (score, id) of each (anchor, slot) so far."""

    def __init__(self, k: int):
        self.k, self.best = k, {}

    def add(self, at: int, slot: int, scores: np.ndarray, ids: np.ndarray) -> None:
        old = self.best.get((at, slot))
        if old is not None:
            scores, ids = np.concatenate([old[0], scores]), np.concatenate([old[1], ids])
        near = first(-scores, ids, self.k)
        self.best[at, slot] = scores[near], ids[near]

    def least(self, at: int, slot: int) -> int | None:
        """The score below which nothing is kept any more."""
        old = self.best.get((at, slot))
        return int(old[0][-1]) if old is not None and len(old[0]) == self.k else None

    def rows(self, width: int, block: int) -> pa.RecordBatch:
        out = [(width, block, at, slot, int(i), int(s)) for (at, slot), (scores, ids) in self.best.items() for s, i in zip(scores, ids, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 6, _FOUND, strict=True)], schema=_FOUND)


def _over_runs(uri: str, k: int, choose):
    """(width, block, run, part) in order -> the best of each (anchor, slot) of a block over a run; choose(kept, anchors, part, limits) takes a part in."""

    def run(batches):
        mine, kept, anchors, limits = None, None, None, None
        for batch in batches:
            for width, block, number, part in zip(*(batch.column(c).to_pylist() for c in ("width", "block", "run", "part")), strict=True):
                if mine != (width, block, number):
                    if kept is not None:
                        yield kept.rows(*mine[:2])
                    if mine is None or mine[:2] != (width, block):
                        anchors = load(uri, "anchors", width, block)
                        limits = choose.limits(uri, width, block, len(anchors))
                    mine, kept = (width, block, number), Kept(k)
                choose(kept, anchors, load(uri, "rows", width, part), limits)
        if kept is not None:
            yield kept.rows(*mine[:2])

    return run


def _scored(anchors: pa.Table, part: pa.Table):
    """(anchor's place, its scores with the part's rows, rows of its label, rows that are not its own) for each anchor."""
    ids, asks, vectors, asked = part["id"].to_numpy(), anchors["id"].to_numpy(), matrix(part["vector"]), matrix(anchors["vector"])
    theirs, own = codes(part["label"], anchors["label"])
    for start in range(0, len(asks), CHUNK):
        for i, scores in enumerate(inner(asked[start : start + CHUNK], vectors), start):
            yield i, scores, theirs == own[i], ids != asks[i]


class Positives:
    """Takes rows of the anchor's label; all are of slot 0."""

    def limits(self, uri, width, block, n):
        return None

    def __call__(self, kept: Kept, anchors: pa.Table, part: pa.Table, limits) -> None:
        ids = part["id"].to_numpy()
        for at, scores, same, other in _scored(anchors, part):
            floor = kept.least(at, 0)
            near = np.flatnonzero(same & other if floor is None else same & other & (scores >= floor))
            if len(near):
                kept.add(at, 0, scores[near], ids[near])


class Slots:
    """Takes rows of other labels, each into the slot of the anchor's limits in which its score lies."""

    def __init__(self, low: int, of: int):
        self.low, self.of = low, of

    def limits(self, uri, width, block, n):
        got = pa.ipc.open_file(read_file(uri, f"limits-{width}-{block}")).read_all()
        out = [np.zeros(0, np.int64)] * n
        for at, scores in zip(got["at"].to_pylist(), got["limits"].to_pylist(), strict=True):
            out[at] = np.array(scores, np.int64)
        return out

    def __call__(self, kept: Kept, anchors: pa.Table, part: pa.Table, limits) -> None:
        ids = part["id"].to_numpy()
        for at, scores, same, other in _scored(anchors, part):
            upper = limits[at][limits[at] >= 0]  # greatest first; the others' windows are empty
            if not len(upper):
                continue
            lowest = -(-self.low * int(upper[-1]) // self.of)
            near = np.flatnonzero((scores <= upper[0]) & (scores >= lowest) & ~same & other)
            if not len(near):
                continue
            slot = len(upper) - np.searchsorted(upper[::-1], scores[near], "left")  # limits that are not below the score
            for s in np.unique(slot):
                mine = near[slot == s]
                floor = kept.least(at, int(s))
                mine = mine if floor is None else mine[scores[mine] >= floor]
                if len(mine):
                    kept.add(at, int(s), scores[mine], ids[mine])


def _write_limits(uri: str):
    def run(table: pa.Table) -> pa.Table:
        width, block = table["width"][0].as_py(), table["block"][0].as_py()
        mine = table.select(["at", "limits"])

        def write(sink):
            with pa.ipc.new_file(sink, mine.schema) as out:
                out.write_table(mine)

        place_file(uri, f"limits-{width}-{block}", write)
        return table.select(["width", "block"]).slice(0, 1)

    return run


def _best(k: int) -> Column:
    """Of (score, id) of a group: the k best, each as (less = -score, id), best first."""
    return F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "id"))), 1, k)


def _suffixes(k: int, low: int, of: int) -> Column:
    """Per positive, from the last to the first: the k best of its own slot and all lower ones, then those that its lower limit allows."""
    empty = "cast(array() as array<struct<less: bigint, id: bigint>>)"
    merged = f"slice(array_sort(concat(a.best, flatten(transform(filter(slots, s -> s.slot = j), s -> s.best)))), 1, {k})"
    fold = f"""aggregate(reverse(sequence(1, size(positives))), named_struct('best', {empty}, 'each', cast(array() as array<array<struct<less: bigint, id: bigint>>>)),
      (a, j) -> named_struct('best', {merged}, 'each', concat(array({merged}), a.each)), a -> a.each)"""
    # low * positive <= of * negative, in decimals
    wide = lambda x: x.cast("decimal(20, 0)")
    return F.zip_with("positives", F.expr(fold), lambda p, best: F.struct(p["id"].alias("id"), p["less"].alias("less"), F.filter(best, lambda n: wide(-p["less"]) * low <= wide(-n["less"]) * of).alias("negatives")))


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding",
    positives: int = POSITIVES, k: int = K, low: int = LOW, of: int = OF, scale: int = SCALE, candidates: int = CANDIDATES, anchors: int = ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), whole(F.col(vector_col), scale).alias("vector"), label.cast("string").alias("label"), is_anchor.alias("asks"))
    rows = rows.filter("id is not null and label is not null and vector is not null and size(vector) > 0")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("a"), F.max(F.size("vector")).alias("width")).first()
    uri, partitions = shared_dir(spark, "negatives"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = rows.filter("asks").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("x")).select("id", "x.vector", "x.label")
    asked = deal(asked, uri, "anchors", -(-size["a"] // rows_per_block(anchors, size["width"])))
    blocks = -(-size["n"] // rows_per_block(candidates, size["width"]))
    parts = deal(rows.select("id", "vector", "label"), uri, "rows", blocks)
    met = pairs(asked, parts, F.pmod(F.col("part"), F.lit(max(1, round(blocks**0.5)))), partitions)
    run = lambda choose: materialize(met.mapInArrow(_over_runs(uri, max(k, positives), choose), _FORM), "found")
    best = run(Positives()).groupBy(*_KEY).agg(_best(positives).alias("positives"))
    best = materialize(best, "positives")
    limits = best.select(*_KEY, F.transform("positives", lambda p: -p["less"]).alias("limits"))
    materialize(limits.groupBy("width", "block").applyInArrow(_write_limits(uri), "width int, block int"), "limits")
    met = met.join(best.select("width", "block").distinct(), ["width", "block"], "left_semi")  # blocks without positives have no limits
    met = met.repartition(partitions, "width", "block", "run").sortWithinPartitions("width", "block", "run", "part")
    slots = run(Slots(low, of)).groupBy(*_KEY, "slot").agg(_best(k).alias("best")).groupBy(*_KEY).agg(F.collect_list(F.struct("slot", "best")).alias("slots"))
    found = best.join(slots, _KEY).select(*_KEY, F.posexplode(_suffixes(k, low, of)).alias("p", "positive"))
    found = found.select(*_KEY, "positive.id", "positive.less", F.posexplode("positive.negatives").alias("i", "negative"))
    names = asked.select("width", "block").distinct()
    owners = names.mapInArrow(_owners(uri), "width int, block int, at int, anchor_id bigint")
    out = found.join(owners, _KEY).select(
        "anchor_id", F.col("id").alias("positive_id"), (F.col("i") + 1).cast("int").alias("rank"), F.col("negative.id").alias("negative_id"),
        (-F.col("less")).alias("positive_score"), (-F.col("negative.less")).alias("negative_score"),
    )
    out = materialize(out, "negatives")
    discard(spark, uri)
    return out


def _owners(uri: str):
    """(width, block) -> the id of each anchor of the block."""

    def run(batches):
        for batch in batches:
            for width, block in zip(batch.column("width").to_pylist(), batch.column("block").to_pylist(), strict=True):
                ids = load(uri, "anchors", width, block)["id"].combine_chunks()
                same = lambda x: pa.array(np.full(len(ids), x, np.int32))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(width), same(block), pa.array(np.arange(len(ids), dtype=np.int32)), ids], ["width", "block", "at", "anchor_id"])

    return run


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label)


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, c.vec_id AS c, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score FROM v a, v c WHERE a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT a, c, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, c) <= 5)
SELECT p.a AS anchor_id, p.c AS positive_id, row_number() OVER (PARTITION BY p.a, p.c ORDER BY n.score DESC, n.c)::INTEGER AS rank, n.c AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score QUALIFY rank <= 5
"""
