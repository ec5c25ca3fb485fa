"""Lower-cased letter words of Arrow text columns as code points, and columns added to a table by text."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from covary.llm.store import bounded_batches, gives_back
from covary.llm.words import STEP, U, mix, spread, text_bytes


@cache
def _lower() -> np.ndarray:
    """Each code point's lower-case letter, 0 where it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


class Words:
    """The words (runs of letters) of a slice of texts; code points are 0 between words."""

    def __init__(self, column: pa.Array):
        data, at = text_bytes(column)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        at = heads[at]
        # a zero before, between and behind texts
        self.low = np.zeros(len(points) + len(at) + 1, np.uint32)
        where = np.arange(len(points)) + np.repeat(np.arange(1, len(at)), np.diff(at))
        self.low[where] = _lower()[points]
        self.at = at + np.arange(len(at))
        inside = self.low > 0
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.starts, ends = edge[::2], edge[1::2]
        self.lengths = ends - self.starts
        self.texts = np.searchsorted(self.at, self.starts - 1, "right") - 1
        self.n = len(column)

    def hashes(self, starts: np.ndarray, lengths: np.ndarray, salt: int = 0) -> np.ndarray:
        """Hashes of the runs of code points; equal runs with equal salt have equal hashes."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        every = spread(starts, lengths)
        first = np.cumsum(lengths) - lengths
        within = np.arange(len(every)) - np.repeat(first, lengths)
        values = mix(self.low[every].astype(np.uint64) ^ within.astype(np.uint64) * STEP)
        return mix(np.add.reduceat(values, first) ^ (lengths.astype(np.uint64) * U(0xD6E8FEB86659FD93) + U(salt)))

    def unique(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each distinct word, one place of it, distinct word of every word)."""
        return np.unique(self.hashes(self.starts, self.lengths), return_index=True, return_inverse=True)


def lookup(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places in a sorted table, -1 for those that are not there."""
    if not len(table):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    return np.where(table[at] == hashes, at, -1)


def add_columns(df: DataFrame, text_col: str, compute, fields: list[tuple[str, T.DataType, pa.DataType]]) -> DataFrame:
    """df with columns computed from its text, batch by batch; columns of the same names are replaced.

    compute takes an iterator of string arrays and gives, for each, the new arrays in order.
    """
    names = {n.lower() for n, *_ in fields}
    kept = [c for c in df.columns if c.lower() not in names]
    bounded_batches(df.sparkSession)
    # the text goes to the worker once, also where it stays a column
    stays = text_col in kept and df.schema[text_col].dataType == T.StringType()
    place = kept.index(text_col) if stays else len(kept)
    source = df.select(*[df[c] for c in kept], *([] if stays else [df[text_col].cast("string").alias("_text_of_row")]))
    schema = T.StructType([*[df.schema[c] for c in kept], *[T.StructField(n, t) for n, t, _ in fields]])

    def run(batches):
        held = []

        def texts():
            for batch in batches:
                held.append(batch)
                yield batch.column(place)

        for made in compute(texts()):
            batch = held.pop()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *[pa.array(x, t) for x, (_, _, t) in zip(made, fields, strict=True)]], [f.name for f in schema])

    return source.mapInArrow(gives_back(run), schema)
