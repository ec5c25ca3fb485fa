"""Blocks of vectors as Arrow files of the shared folder, read by name in tasks, so that no vector is shuffled more than once.

Rows are dealt to blocks by a hash of their whole content, which a task that runs again repeats. Vectors that are null, empty, or
hold null or non-finite components, and rows without id, are in no block; vectors of different lengths never share one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covary.llm.store import materialize, place_file, read_file

COMPONENTS = 1 << 22  # of a block at most, about: 32 MB


def finite(vector: Column) -> Column:
    """The vector as doubles, null if it is null or empty or a component is null or not finite."""
    d = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(d, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    return F.when(~bad & (F.size(d) > 0), d)


def rows_per_block(wanted: int, width: int | None) -> int:
    """wanted rows, or as many as COMPONENTS allow."""
    return max(1, min(wanted, COMPONENTS // max(1, width or 1)))


def deal(rows: DataFrame, uri: str, name: str, blocks: int, build=None) -> DataFrame:
    """(width, block, n) of the blocks written. rows: id, vector and other columns, all kept in the files; build(table, width, block) may write more."""

    def place(table: pa.Table) -> pa.Table:
        width, block = table["width"][0].as_py(), table["block"][0].as_py()
        table = table.drop_columns(["width", "block"]).combine_chunks()
        flat = pa.FixedSizeListArray.from_arrays(table["vector"].combine_chunks().flatten(), width)
        order = np.lexsort((*matrix(flat).T[::-1], table["id"].to_numpy()))  # the same in every run
        table = table.set_column(table.column_names.index("vector"), "vector", flat).take(pa.array(order)).combine_chunks()

        def write(sink):
            with pa.ipc.new_file(sink, table.schema) as out:
                out.write_table(table)

        place_file(uri, f"{name}-{width}-{block}", write)
        if build:
            build(table, width, block)
        return pa.table({"width": pa.array([width], pa.int32()), "block": pa.array([block], pa.int32()), "n": pa.array([len(table)], pa.int64())})

    width, at = F.size("vector").alias("width"), F.pmod(F.xxhash64(*rows.columns), F.lit(max(1, blocks))).cast("int").alias("block")
    return materialize(rows.select("*", width, at).groupBy("width", "block").applyInArrow(place, "width int, block int, n bigint"), name)


def load(uri: str, name: str, width: int, block: int) -> pa.Table:
    return pa.ipc.open_file(read_file(uri, f"{name}-{width}-{block}")).read_all()


def matrix(column) -> np.ndarray:
    """A fixed-size list column as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), column.type.list_size)


def pairs(left: DataFrame, right: DataFrame, run: Column, partitions: int) -> DataFrame:
    """(width, block, run, part) for each block of left and each of right (as part) of its width: the parts of a run come one after another in a task."""
    met = left.select("width", "block").join(right.select("width", F.col("block").alias("part")), "width").withColumn("run", run)
    return met.repartition(partitions, "width", "block", "run").sortWithinPartitions("width", "block", "run", "part")


def codes(labels, among) -> tuple[np.ndarray, np.ndarray]:
    """Equal numbers for equal labels of two string columns; what only the first has is -1."""
    among = among.combine_chunks() if isinstance(among, pa.ChunkedArray) else among
    known = pc.unique(among)
    number = lambda x: pc.index_in(x, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
    labels = labels.combine_chunks() if isinstance(labels, pa.ChunkedArray) else labels
    return number(labels), number(among)


_LEAST, _MOST = -(2**63) + 1, 2**63 - 1


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole doubles, as 64-bit integers (beyond their range, its ends)."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, _LEAST, _MOST).astype(np.int64)


def first(keys: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k least keys, least first, ties to the smaller id."""
    if len(keys) > 4 * k:
        near = np.flatnonzero(keys <= np.partition(keys, k - 1)[k - 1])
        return near[np.lexsort((ids[near], keys[near]))[:k]]
    return np.lexsort((ids, keys))[:k]
