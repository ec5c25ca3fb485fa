"""Byte-level BPE over rank files: the words of a block of documents are folded once each with Spark's higher-order functions.

`aggregate` folds ranked merges over a word's byte array, finding a pair by one read of a table of ranks. That table is built in a task and
comes to the folds as a column of their blocks, so that no plan holds it. The words of a sample of about SAMPLE documents are folded once and sent to all tasks (COMMON words at most). Encoding itself runs without a shuffle: a text is split
by the pattern in the JVM; a task gathers blocks of documents and folds each of their other words once; a block's documents are then
put together from the words' ids. Which words the sample holds decides who folds them, never the result. Memory is bounded by
BLOCK_BYTES of text, COMMON and TASK_WORDS words, never by the vocabulary of the corpus. A word over FOLD_BYTES bytes, for which a
fold is quadratic, is merged by a heap in the task, to the same ids.

Cases: a null or empty text has no ids and decodes to no bytes; rows with a null or repeated id are encoded one by one;
other columns of the input are not read; an empty table gives an empty table; ids outside the rank file do not decode (error).
"""

from __future__ import annotations

import base64
import heapq
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covary.llm.store import bounded_batches, columns, give_back, gives_back
from covary.llm.words import span_hashes, spread

BLOCK_BYTES = 1 << 19
FOLD_BYTES = 256
SAMPLE = 8_000
COMMON = 1 << 20
_NO_RANK = 1 << 30  # above every rank
_LAST = _NO_RANK << 20
_MASK = (1 << 20) - 1
_TRIED = 1024  # places at once
TASK_WORDS = 1 << 18
_SPACES = r"\t-\r \x85\xa0  -     　"


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@cache
def pair_ranks(path: str) -> dict[tuple[int, int], int]:
    """(left id, right id) -> id of the two joined, for every way in which a piece of the file splits in two."""
    ranks = load_ranks(path)
    out = {}
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is not None and right is not None:
                out[left, right] = rank
    return out


def java_pattern(pattern: str) -> str:
    """The pattern with white space spelled out, as Java's own classes hold only ASCII."""
    return pattern.replace(r"[^\s", f"[^{_SPACES}").replace(r"\s", f"[{_SPACES}]").replace(r"\S", f"[^{_SPACES}]")


def displaced(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(place of each left id, slots): the slot of a pair is its left id's place plus its right id, and holds the pair's rank above its left id, -1 where none is.

    Rows of left ids lie over each other (row displacement), the fullest first, each at a place where its slots are free, so that one
    read finds any pair: a slot that another left id has filled shows that one's.
    """
    rows = {}
    for (left, right), rank in pair_ranks(path).items():
        rows.setdefault(left, []).append((right, rank))
    pair_ranks.cache_clear()  # only workers look up pairs themselves
    most, ids = max((r for row in rows.values() for r, _ in row), default=0), max(load_ranks(path).values()) + 1
    place, slots, at, kind = np.zeros(ids, np.int64), np.full(most + _TRIED, -1, np.int64), 0, 0
    for left, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        right, rank = np.array(sorted(row), np.int64).T
        if kind != (kind := len(row).bit_length()):  # smaller rows fit into what larger ones left free
            at = 0
        while True:
            if at + _TRIED + most >= len(slots):
                slots = np.concatenate([slots, np.full(len(slots), -1, np.int64)])
            free = np.arange(at, at + _TRIED)
            for some in range(0, len(right), 16):
                free = free[(slots[free[:, None] + right[some : some + 16]] < 0).all(1)]
            if len(free):
                break
            at += _TRIED
        at = int(free[0])
        slots[at + right], place[left] = rank << 20 | left, at
    return place, slots[: np.flatnonzero(slots >= 0).max(initial=-1) + 1]


_tables: dict[str, np.ndarray] = {}


def rank_table(spark: SparkSession, path: str) -> np.ndarray:
    """The places of left ids, counted from the start of this array, and the slots behind them. Built in a task: the driver gets 3 MB and no pair."""

    def run(batches):
        for _ in batches:
            place, slots = displaced(path)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([place + len(place), slots]))], ["slot"])

    if path not in _tables:
        _tables[path] = columns(spark.range(0, 1, 1, 1).mapInArrow(gives_back(run), "slot bigint"))["slot"]
    return _tables[path]


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_merges(pieces: Column, table: Column) -> Column:
    """Merges the leftmost pair of lowest rank until none is left.

    The state holds, for each piece, the rank of the pair that it begins above the piece's own id: equal values are equal pairs,
    so the least value is the pair of lowest rank and its first place the leftmost one.
    """

    def begin(left, right):
        """left with the rank of the pair above it."""
        found = F.get(table, (F.get(table, left.cast("int")) + right).cast("int"))
        return F.when(own(found) == left, found).otherwise(left + F.lit(_LAST))

    def own(value):
        return value.bitwiseAND(F.lit(_MASK))

    def merge(state, low, at):
        new, after = F.shiftright(low, 20), F.get(state, at + 1)
        here = F.when(after.isNull(), new + _LAST).otherwise(begin(new, own(after)))
        left = F.filter(state, lambda x, i: i != at)  # without the right one of the two pieces
        return F.transform(left, lambda x, i: F.when(i == at - 1, here).when(i == at - 2, begin(own(x), new)).otherwise(x))

    def step(state, _):
        return _let(F.array_min(state), lambda low: F.when(low >= _LAST, state).otherwise(_let(F.array_position(state, low).cast("int"), lambda at: merge(state, low, at))))

    wide = F.transform(pieces, lambda x: x.cast("bigint"))
    start = F.transform(wide, lambda x, i: F.when(i + 1 < F.size(pieces), begin(x, F.get(pieces, i + 1).cast("bigint"))).otherwise(x + _LAST))
    return F.when(F.size(pieces) < 2, pieces).otherwise(F.aggregate(F.sequence(F.lit(2), F.size(pieces)), start, step, lambda s: F.transform(s, lambda x: own(x).cast("int"))))


def merge_long(pieces: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """The same result in n log n: a heap of candidate merges over a linked list."""
    n = len(pieces)
    ids, after, before = list(pieces), [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(pairs[k], i, k) for i in range(n - 1) if (k := (ids[i], ids[i + 1])) in pairs]
    heapq.heapify(heap)
    while heap:
        rank, i, (left, right) = heapq.heappop(heap)
        j = after[i]
        if ids[i] != left or j < 0 or ids[j] != right:
            continue
        ids[i], ids[j], after[i] = rank, -1, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and (k := (ids[a], ids[b])) in pairs:
                heapq.heappush(heap, (pairs[k], a, k))
    return [x for x in ids if x >= 0]


class Common:
    """Words that are folded beforehand, found by their bytes."""

    def __init__(self, words: pa.Array):
        data, at = _bytes_of(words)
        hashes = span_hashes(data, at[:-1], np.diff(at))
        self.order = np.argsort(hashes)
        self.hashes, self.words = hashes[self.order], words.take(pa.array(self.order))

    def find(self, words: pa.Array) -> np.ndarray:
        """The place of each word, -1 for others; equal hashes are confirmed by the words themselves."""
        if not len(self.hashes) or not len(words):
            return np.full(len(words), -1)
        data, at = _bytes_of(words)
        hashes = span_hashes(data, at[:-1], np.diff(at))
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        same = np.asarray(pc.equal(self.words.take(pa.array(place)), words))
        return np.where(same, place, -1)


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    return np.frombuffer(words.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def _one_row(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _byte_ranks(ranks_path: str) -> np.ndarray:
    return np.array([load_ranks(ranks_path)[bytes([b])] for b in range(256)], np.int32)


def _in_bytes(words: pa.Array, byte_rank: np.ndarray) -> pa.ListArray:
    """Each word as the ids of its bytes."""
    data, at = _bytes_of(words)
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(byte_rank[data]))


def _vocabularies(ranks_path: str, table):
    """Batches of words -> a row per batch: the words, the ids of their bytes, the table of ranks."""

    def run(batches):
        byte_rank, ranks = _byte_ranks(ranks_path), _one_row(pa.array(table.value))
        for batch in batches:
            if batch.num_rows:
                words = batch.column("word")
                yield pa.RecordBatch.from_arrays([_one_row(words), _one_row(_in_bytes(words, byte_rank)), ranks], ["words", "vocabulary", "ranks"])

    return run


def fold_vocabulary(blocks: DataFrame) -> DataFrame:
    """Blocks with the words of their vocabulary merged by their column ranks, which is left out. A word over FOLD_BYTES gets a -1 and stays as it is."""
    fold = _let(F.col("ranks"), lambda t: F.transform("vocabulary", lambda w: F.when(F.size(w) > FOLD_BYTES, F.concat(F.array(F.lit(-1)), w)).otherwise(fold_merges(w, t))))
    return blocks.withColumn("vocabulary", fold).drop("ranks")


def _blocks(ranks_path: str, pattern: str, block_bytes: int, task_words: int, common, table):
    """Documents with their words -> a row per block: ids, each document's words, their places in the task's vocabulary, what the block adds to that, and the table of ranks.

    The places of common words are those in their table, those of a task's other words come behind them.
    """

    def run(batches):
        table_of = common.value
        ahead = len(table_of.hashes)
        byte_rank, ranks = _byte_ranks(ranks_path), _one_row(pa.array(table.value))
        parse = regex.compile(pattern)
        kept, size, known = [], 0, {}

        def block():
            held = pa.Table.from_batches(kept).combine_chunks()
            words = pa.concat_arrays([x.flatten() for x in held["words"].chunks] or [pa.array([], pa.string())])
            coded = words.dictionary_encode()
            restart = len(known) > task_words
            if restart:
                known.clear()
            before = len(known) + ahead
            places = table_of.find(coded.dictionary)
            rest = np.flatnonzero(places < 0)
            others = coded.dictionary.take(pa.array(rest)).to_pylist()
            places[rest] = [known.setdefault(w, len(known) + ahead) for w in others]
            vocabulary = coded.dictionary.take(pa.array(np.flatnonzero(places >= before))).cast(pa.binary())
            counts = np.diff(np.concatenate([[0], *[np.asarray(x.value_lengths().fill_null(0)) for x in held["words"].chunks]]).cumsum())
            ids = held["id"].combine_chunks()
            ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
            return pa.RecordBatch.from_arrays(
                [
                    _one_row(ids),
                    pa.array([counts.astype("<i4").tobytes()], pa.binary()),
                    pa.array([places[np.asarray(coded.indices)].astype("<i4").tobytes()], pa.binary()),
                    pa.array([restart]),
                    _one_row(_in_bytes(vocabulary, byte_rank)),
                    ranks,
                ],
                ["ids", "counts", "codes", "restart", "vocabulary", "ranks"],
            )

        for batch in batches:
            odd = [i for i, x in enumerate(batch.column("odd")) if x.is_valid]
            if odd:  # letters newer than the JVM's tables
                split = batch.column("words").to_pylist()
                for i in odd:
                    split[i] = parse.findall(batch.column("odd")[i].as_py())
                batch = batch.set_column(batch.schema.get_field_index("words"), "words", pa.array(split, pa.list_(pa.string())))
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                kept.append(part.select(["id", "words"]))
                size += len(part.column("words").flatten()) * 6 + part.num_rows * 8
                if size >= block_bytes:
                    yield block()
                    kept, size = [], 0
        if kept:
            yield block()

    return run


class _Row:
    """Numbers behind given ones, in an array that doubles where it is full; the given one is never written to."""

    def __init__(self, given: np.ndarray):
        self.room, self.n = given, len(given)

    def add(self, more: np.ndarray) -> np.ndarray:
        """All numbers so far."""
        n = self.n + len(more)
        if n > len(self.room):
            room = np.empty(max(n, 2 * self.n), self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : n] = more
        self.n = n
        return self.room[:n]


def _expand(ranks_path: str, common):
    def run(batches):
        pairs, (common_ids, common_lengths) = None, common.value
        common_at = np.concatenate([[0], np.cumsum(common_lengths)])
        all_ids, all_at = _Row(common_ids), _Row(common_at)
        for batch in batches:
            for r in range(batch.num_rows):
                counts = np.frombuffer(batch.column("counts")[r].as_py(), "<i4").astype(np.int64)
                codes = np.frombuffer(batch.column("codes")[r].as_py(), "<i4")
                folded = batch.column("vocabulary")[r].values
                at = np.asarray(folded.offsets).astype(np.int64)
                ids = np.asarray(folded.flatten())
                at = at - at[0]
                negative = np.flatnonzero(ids < 0)
                if len(negative):  # left for this task: -1, then the bytes of a long word
                    pairs = pairs or pair_ranks(ranks_path)
                    parts = [ids[at[i] : at[i + 1]] for i in range(len(at) - 1)]
                    for i in np.searchsorted(at, negative, "right") - 1:
                        parts[i] = np.array(merge_long(parts[i][1:].tolist(), pairs), np.int32)
                    at = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
                    ids = np.concatenate(parts)
                if batch.column("restart")[r].as_py():
                    all_ids, all_at = _Row(common_ids), _Row(common_at)
                at = all_at.add(at[1:] + all_ids.n)
                ids = all_ids.add(ids)
                bounds = np.concatenate([[0], np.cumsum(counts)])
                owners = batch.column("ids")[r].values
                for start in range(0, len(counts), 512):
                    stop = min(start + 512, len(counts))
                    own = codes[bounds[start] : bounds[stop]]
                    lengths = at[own + 1] - at[own]
                    flat = ids[spread(at[own], lengths)].astype("<u4")
                    ends = np.concatenate([[0], np.cumsum(lengths)])[bounds[start : stop + 1] - bounds[start]] * 4
                    packed = pa.Array.from_buffers(pa.binary(), stop - start, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])
                    yield pa.RecordBatch.from_arrays([owners.slice(start, stop - start), packed], ["id", "ids"])

    return run


def common_words(df: DataFrame, table, ranks_path: str, pattern: str, id_col: str, text_col: str) -> tuple[Common, tuple[np.ndarray, np.ndarray]]:
    """The words of a sample of documents, and in their order all their ids end to end with the number of each word's. table: the broadcast table of ranks."""
    total = df.count()
    share = int((1 << 20) * min(1.0, SAMPLE / max(1, total)))
    some = df.filter(F.pmod(F.xxhash64(F.lit("words"), id_col), F.lit(1 << 20)) < share)
    words = some.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(java_pattern(pattern)), F.lit(0))).alias("word"))
    words = words.filter(F.octet_length("word").between(1, 64)).distinct().limit(COMMON)
    got = fold_vocabulary(words.mapInArrow(gives_back(_vocabularies(ranks_path, table)), "words array<string>, vocabulary array<array<int>>, ranks array<bigint>")).toArrow()
    if not got.num_rows:
        return Common(pa.array([], pa.string())), (np.zeros(0, np.int32), np.zeros(0, np.int64))
    column, ids = (pa.concat_arrays([x.flatten() for x in got[c].chunks]) for c in ("words", "vocabulary"))
    found = Common(column.cast(pa.string()))
    ids = ids.take(pa.array(found.order))
    del got, column
    give_back()
    return found, (ids.flatten().to_numpy().astype(np.int32), ids.value_lengths().to_numpy().astype(np.int64))


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, decoded: bool = False, task_words: int = TASK_WORDS) -> DataFrame:
    """(id_col, ids binary): each row's token ids as little-endian unsigned 32-bit integers. See the module for cases.

    With decoded, the ids are decoded at once, by the same Python worker, into a further column (see decode).
    """
    kind = df.schema[id_col].dataType.simpleString()
    sc = bounded_batches(df.sparkSession).sparkContext
    text = F.coalesce(F.col(text_col), F.lit(""))
    odd = text.rlike(r"\p{Cn}")
    table = sc.broadcast(rank_table(df.sparkSession, ranks_path))
    found, common_ids = common_words(df, table, ranks_path, pattern, id_col, text_col)
    words = df.select(
        F.col(id_col).alias("id"),
        F.when(odd, text).alias("odd"),
        F.when(odd, F.array().cast("array<string>")).otherwise(F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(0))).alias("words"),
    )
    blocks = words.mapInArrow(gives_back(_blocks(ranks_path, pattern, block_bytes, task_words, sc.broadcast(found), table)), f"ids array<{kind}>, counts binary, codes binary, restart boolean, vocabulary array<array<int>>, ranks array<bigint>")
    expand, back = _expand(ranks_path, sc.broadcast(common_ids)), _decode(ranks_path)
    folded = fold_vocabulary(blocks)
    out = folded.mapInArrow(gives_back(lambda batches: back(expand(batches))), f"id {kind}, ids binary, decoded binary") if decoded else folded.mapInArrow(gives_back(expand), f"id {kind}, ids binary")
    return out.withColumnRenamed("id", id_col)


def unpack(ids: Column) -> Column:
    """Packed ids as array<bigint>."""
    return F.transform(
        F.sequence(F.lit(0), F.octet_length(ids) / 4 - 1),
        lambda i: F.conv(F.hex(F.reverse(F.substring(ids, (i * 4 + 1).cast("int"), F.lit(4)))), 16, 10).cast("bigint"),
    )


def _decode(ranks_path: str):
    def run(batches):
        ranks = load_ranks(ranks_path)
        pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        at = np.concatenate([[0], np.cumsum([len(x) for x in pieces])])
        body = np.frombuffer(b"".join(pieces), np.uint8)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                packed = part.column("ids").fill_null(b"")
                ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
                ids = np.frombuffer(packed.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view("<u4").astype(np.int64)
                lengths = at[ids + 1] - at[ids]
                data = body[spread(at[ids], lengths)]
                bounds = np.concatenate([[0], np.cumsum(lengths)])[(ends - ends[0]) // 4]
                text = pa.Array.from_buffers(pa.large_binary(), len(packed), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in part.schema.names], text], [*part.schema.names, "decoded"])

    return run


def decode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, ids, decoded binary): the pieces of the ids, one after another; null ids decode to no bytes."""
    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(_decode(ranks_path), f"id {kind}, ids binary, decoded binary")
    return out.withColumnsRenamed({"id": id_col, "ids": ids_col})


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, SHA-256 of its packed ids and of the decoded bytes."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.PATTERN, decoded=True).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
