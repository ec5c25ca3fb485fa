"""Token ids in Arrow files of fixed-size-list batches, for zero-copy random access to sequences of equal length.

A shard is one range of documents in ascending id order: their ids end to end, cut into sequences of `length` (the last one
padded, its mask 0 there), written as an Arrow IPC file whose batches hold `ids` (fixed_size_list of uint16 or uint32) and
`mask` (fixed_size_list of uint8), and beside it an index file with each document's start within the shard and its tokens.
The manifest has a row per shard. A memory-mapped file gives any sequence as a view: sequence i is row i % rows of batch i // rows.

Files have deterministic names and are renamed into place, so a task that runs again leaves the same file.

Cases: a null or empty text has only the end id; rows with a repeated id are kept, next to each other; null ids come first;
an empty table gives no shard; other columns of the input are not read.
"""

from __future__ import annotations

import os
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covary.llm.store import bounded_batches, place_file, shared_dir
from covary.llm.words import slices, spread, text_bytes, word_hashes

LENGTH = 2048
ROWS = 256
CACHED_WORDS = 1 << 20
_AFTER = np.zeros(256, bool)
_AFTER[list(b".,;:!?*%$&#|")] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _added(path: str) -> list[bytes]:
    """The strings of added tokens, which the tokenizer finds in a text before it cuts words."""
    return [t.content.encode() for t in _tokenizer(path).get_added_tokens_decoder().values()]


class _Pieces:
    """Ids of pieces of text that the tokenizer encodes on their own: found once, kept in growing arrays."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.clear()

    def clear(self):
        self.hashes = np.zeros(0, np.uint64)
        self.starts, self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def of(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ids, numbers of ids) of the pieces."""
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > CACHED_WORDS:
            self.clear()
        at = np.searchsorted(self.hashes, unique)
        known = np.zeros(len(unique), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == unique[inside]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            pieces = [raw[s : s + n].decode() for s, n in zip(starts[first[new]].tolist(), lengths[first[new]].tolist(), strict=True)]
            counts, ids = [], []
            for i in range(0, len(pieces), 4096):
                for x in self.tokenizer.encode_batch_fast(pieces[i : i + 4096], add_special_tokens=False):
                    got = x.ids
                    counts.append(len(got))
                    ids += got
            counts = np.array(counts, np.int64)
            begin = len(self.ids) + np.cumsum(counts) - counts
            self.ids = np.concatenate([self.ids, np.array(ids, np.uint32)])
            order = np.argsort(np.concatenate([self.hashes, unique[new]]), kind="stable")
            self.hashes = np.concatenate([self.hashes, unique[new]])[order]
            self.starts = np.concatenate([self.starts, begin])[order]
            self.lengths = np.concatenate([self.lengths, counts])[order]
            at = np.searchsorted(self.hashes, unique)
        at = at[inverse]
        return self.starts[at], self.lengths[at]


@cache
def _pieces(path: str) -> _Pieces:
    return _Pieces(path)


def _with_special(column: pa.Array, special: np.ndarray, tokenizer_path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """encode_texts where some texts are encoded whole."""
    every = np.arange(len(column))
    ids, per = encode_texts(column.filter(pa.array(~special)), tokenizer_path, end_id)
    plain = np.split(ids, np.cumsum(per)[:-1]) if len(per) else []
    parts = dict(zip(every[~special].tolist(), plain, strict=True))
    for i in every[special].tolist():
        got = _tokenizer(tokenizer_path).encode(column[i].as_py(), add_special_tokens=False).ids
        parts[i] = np.array([*got, end_id], np.uint32)
    ordered = [parts[i] for i in every.tolist()]
    return np.concatenate(ordered), np.array([len(x) for x in ordered], np.int64)


def encode_texts(column: pa.Array, tokenizer_path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts end to end, each with end_id behind it; their numbers).

    The tokenizer drops white space and never joins across it, nor across a letter and the punctuation behind it,
    so the pieces between encode on their own; each distinct piece is encoded once. A text that holds the string of an added token
    is encoded whole by the tokenizer.
    """
    special = np.zeros(len(column), bool)
    for token in _added(tokenizer_path):
        special |= np.asarray(pc.match_substring(column.fill_null(""), token.decode()))
    if special.any():
        return _with_special(column, special, tokenizer_path, end_id)
    data, at = text_bytes(column)
    cut = np.zeros(len(data), bool)
    cut[1:] = _AFTER[data[1:]] & _LETTER[data[:-1]]
    hashes, texts, starts, lengths = word_hashes(data, at, lower=False, cut=cut)
    cached = _pieces(tokenizer_path)
    where, counts = cached.of(data, hashes, starts, lengths)
    n = len(column)
    per = np.bincount(texts, counts, n).astype(np.int64) + 1 if n else np.zeros(0, np.int64)
    ends = np.cumsum(per)
    out = np.full(int(per.sum()), end_id, np.uint32)
    body = np.ones(len(out), bool)
    body[ends - 1] = False
    out[body] = cached.ids[spread(where, counts)]
    return out, per


def _write(uri: str, tokenizer_path: str, end_id: int, length: int, rows: int, small: bool, kind: pa.DataType):
    schema = pa.schema([("ids", pa.list_(pa.uint16() if small else pa.uint32(), length)), ("mask", pa.list_(pa.uint8(), length))])

    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        owners, sizes = [], []
        name = f"shard-{shard:06d}.arrow"

        def sequences(sink):
            rest = np.zeros(0, np.uint16 if small else np.uint32)
            with pa.ipc.new_file(sink, schema) as out:

                def put(ids, used):
                    mask = (np.arange(len(ids)) < used).astype(np.uint8)
                    out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids), length), pa.FixedSizeListArray.from_arrays(pa.array(mask), length)], schema=schema))

                for batch in batches:
                    text = batch.column("text")
                    for start, stop in slices(text):
                        ids, per = encode_texts(text.slice(start, stop - start), tokenizer_path, end_id)
                        owners.append(batch.column("id").slice(start, stop - start))
                        sizes.append(per)
                        rest = np.concatenate([rest, ids.astype(rest.dtype)])
                        whole = len(rest) // (length * rows) * length * rows
                        for i in range(0, whole, length * rows):
                            put(rest[i : i + length * rows], length * rows)
                        rest = rest[whole:]
                if len(rest):
                    used = len(rest)
                    put(np.concatenate([rest, np.zeros(-used % length, rest.dtype)]), used)

        first = next(batches, None)
        if first is None:
            return
        rest_of, batches_in = batches, [first]

        def chain():
            yield from batches_in
            yield from rest_of

        batches = chain()
        place_file(uri, name, sequences)
        sizes = np.concatenate(sizes)
        start = np.cumsum(sizes) - sizes
        index = pa.record_batch([pa.concat_arrays(owners), pa.array(start), pa.array(sizes)], ["id", "start", "n_tokens"])

        def entries(sink):
            with pa.ipc.new_file(sink, index.schema) as out:
                out.write_batch(index)

        place_file(uri, name + ".index", entries)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name]), pa.array([len(sizes)], pa.int64()), pa.array([int(sizes.sum())], pa.int64())], ["shard", "file", "n_docs", "n_tokens"])

    return run


def write_tokens(df: DataFrame, uri: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, rows: int = ROWS, shards: int | None = None) -> DataFrame:
    """Writes shards under uri and returns the manifest (shard, file, n_docs, n_tokens, base: tokens of the shards before)."""
    spark = bounded_batches(df.sparkSession)
    kind = df.schema[id_col].dataType
    small = _tokenizer(tokenizer_path).get_vocab_size() <= 1 << 16 and end_id < 1 << 16
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).repartitionByRange(shards, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.length("text"), "text")
    out = ranged.mapInArrow(_write(uri, tokenizer_path, end_id, length, rows, small, kind), "shard int, file string, n_docs bigint, n_tokens bigint")
    manifest = spark.createDataFrame(out.toArrow())  # a row per shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class Shard:
    """A shard's file: sequences by number, and any run of ids, as views of the mapped file where it is local."""

    def __init__(self, uri: str, name: str):
        fs, root = pafs.FileSystem.from_uri(uri)
        local = isinstance(fs, pafs.LocalFileSystem)
        self.source = pa.memory_map(f"{root}/{name}") if local else fs.open_input_file(f"{root}/{name}")
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.n_batches = self.reader.num_record_batches
        self.rows = self.reader.get_batch(0).num_rows if self.n_batches else 1
        index = fs.open_input_file(f"{root}/{name}.index")
        self.index = pa.ipc.open_file(index).read_all()

    def batch(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        got = self.reader.get_batch(i)
        return got.column("ids").flatten().to_numpy(zero_copy_only=True), got.column("mask").flatten().to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of one sequence."""
        (ids, mask), row = self.batch(i // self.rows), i % self.rows
        here = slice(row * self.length, (row + 1) * self.length)
        return ids[here], mask[here]

    def ids(self, start: int, n: int) -> np.ndarray:
        step = self.rows * self.length
        parts = [self.batch(b)[0][max(0, start - b * step) : start + n - b * step] for b in range(start // step, (start + n - 1) // step + 1)] if n else []
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, np.uint32)])


def read_tokens(manifest: DataFrame, uri: str, id_type: str = "bigint") -> DataFrame:
    """Per document, from the files: (doc_id, start over all shards, n_tokens, ids_crc32 of the ids as little-endian uint32)."""

    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                shard = Shard(uri, name)
                starts, sizes = (shard.index[c].to_numpy() for c in ("start", "n_tokens"))
                for i in range(0, len(starts), 4096):
                    part = range(i, min(i + 4096, len(starts)))
                    sums = [zlib.crc32(shard.ids(int(starts[j]), int(sizes[j])).astype("<u4")) for j in part]
                    owners = shard.index["id"].slice(i, len(part)).combine_chunks()
                    yield pa.RecordBatch.from_arrays([owners, pa.array(starts[i : i + len(part)] + base), pa.array(sizes[i : i + len(part)]), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("file", "base", "shard")
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(n, "shard").select("file", "base").mapInArrow(run, f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def op1_token_files(spark, sf_dir: str) -> DataFrame:
    """Writes the token files of all documents and reads every document back from them."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    uri = shared_dir(spark, "tokens")
    manifest = write_tokens(docs, uri, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_tokens(manifest, uri, docs.schema["doc_id"].dataType.simpleString())
