"""Language-model scores by a Brown class bigram: exchange clustering, class transitions and word emissions.

Words are lower-cased (A-Z) runs of non-space; a text ends with an end token, which is also its left context. Statistics come from
every training document. Exchange clustering puts the SEED most frequent words into CLASSES classes, one word after another: a word
moves to the class that raises the likelihood of the class bigram most, and the counts of classes move with it, so that the likelihood
never falls. One task does that, as the seed's bigrams are at most SEED squared. Then WIDE sweeps give every other training word the
class of the greatest gain over all its neighbours, in buckets of words side by side, each with its own copy of the classes' counts
that it keeps up to date as it moves its words. As neighbours, the FREQUENT most frequent words stand in their classes of the sweep
before, words beyond them (and in the first sweep all words outside the seed) in classes by their last letters. An unseen word takes
the class of most training words with its last letters. Then

    P(text) = product of P(class | class before) * P(word | class),

with transitions drawn towards the classes' shares and add-one emissions that leave one unseen word of each class a share.

Words are counted under 64-bit hashes. Counts and classes of the FREQUENT most frequent words (a bounded table) are broadcast; all
others meet theirs in a shuffle join, so that no table in a task grows with the corpus.

Cases: a null or empty text is one end token; a null id is in the training fold (its text form counts as empty); repeated rows are
scored each by itself; very long texts are scored whole; without training documents every word is unseen and N is 0; other columns
are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covary.llm.store import bounded_batches, discard, materialize
from covary.llm.words import U, slices, text_bytes, word_hashes

FREQUENT = 1 << 19
SEED = 2048  # words
CLASSES = 48
RARE = 16
SWEEPS = 4
WIDE = 2
PER_BUCKET = 16_000  # words
TOKENS = 1 << 20  # held at a time
_END = CLASSES
_M = CLASSES + 1  # classes and the end token
_K = _M + RARE  # with the classes by letters
_SELF = 2 * _K  # codes of contexts: class after, _K + class before, the word itself after
_OTHER = 255


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def _words(column: pa.Array):
    """(keys, text of each) by slices of the column: a key is a hash of the word whose lowest bits are its class by letters."""
    for start, stop in slices(column):
        data, at = text_bytes(column.slice(start, stop - start))
        hashes, texts, starts, lengths = word_hashes(data, at)
        last = data[starts + lengths - 1].astype(np.uint64) | U(32)
        before = np.where(lengths > 1, data[starts + lengths - 2].astype(np.uint64) | U(32), U(0))
        yield start, stop, hashes & ~U(RARE - 1) | (last * U(31) + before * U(17)) % U(RARE), texts


def _letters(keys: np.ndarray) -> np.ndarray:
    return (keys & U(RARE - 1)).astype(np.int64)


def _count(batches):
    held, size = [], 0

    def counted():
        unique, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(n)], ["hash", "n"])

    for batch in batches:
        for _, _, keys, _ in _words(batch.column("text")):
            held.append(keys)
            size += len(keys)
            if size >= TOKENS:
                yield counted()
                held, size = [], 0
    if held:
        yield counted()


class Frequent:
    """Sorted keys of the frequent words with their counts, and the class of each (-1: by its last letters)."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, classes: np.ndarray):
        self.hashes, self.counts, self.classes = hashes, counts, classes
        self.first = None

    def _index(self) -> None:
        """Where the keys of each beginning start; made where it is used."""
        bits = max(1, len(self.hashes)).bit_length()
        self.shift = U(64 - bits)
        first = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift)
        self.first = np.append(first, len(self.hashes)).astype(np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places, -1 for words that are not there: keys of equal first bits, hardly ever more than a few, are tried in turn."""
        if self.first is None:
            self._index()
        top = (hashes >> self.shift).astype(np.int64)
        at, stop = self.first[top], self.first[top + 1]
        out, left = np.full(len(hashes), -1), np.flatnonzero(at < stop)
        at, stop, sought = at[left], stop[left], hashes[left]
        while len(left):
            hit = self.hashes[at] == sought
            out[left[hit]] = at[hit]
            at += 1
            more = ~hit & (at < stop)
            left, at, stop, sought = left[more], at[more], stop[more], sought[more]
        return out


def _bigrams(frequent, size):
    """Counts of neighbours of which one is in the seed; classes hold the seed's ranks here. Words outside it are `size`, the end token size + 1."""

    def run(batches):
        table = frequent.value
        for batch in batches:
            for start, stop, hashes, texts in _words(batch.column("text")):
                at = table.find(hashes)
                rank = np.where(at >= 0, table.classes[at], -1) if len(table.classes) else at
                rank = np.where(rank >= 0, rank, size).astype(np.int64)
                _, before, own = _with_ends(rank, texts, stop - start, size + 1)
                some = (own != before) & ((own < size) | (before < size)) | (own < size) & (own == before)
                pairs, n = np.unique(before[some] * (size + 2) + own[some], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((pairs // (size + 2)).astype(np.int32)), pa.array((pairs % (size + 2)).astype(np.int32)), pa.array(n)], ["v", "w", "n"])

    return run


def _with_ends(own: np.ndarray, texts: np.ndarray, n: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, class before, class) of words and end tokens, given the words' classes and texts."""
    bounds = np.searchsorted(texts, np.arange(n + 1))
    every = np.insert(own, bounds[1:], end)
    return np.repeat(np.arange(n), np.diff(bounds) + 1), np.concatenate([[end], every[:-1]])[: len(every)], every


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_classes(own: np.ndarray, after: np.ndarray, before: np.ndarray, itself: np.ndarray, table: np.ndarray, free: int) -> tuple[np.ndarray, np.ndarray]:
    """(class below free, gain over its own, inf if that is none of them) of words with the given class counts of their neighbours, a row each, others than itself."""
    every = np.arange(len(own))
    inside = np.flatnonzero(own < free)
    value = np.zeros((len(own), free))
    for counts, others, m in ((after, before, table), (before, after, table.T)):
        w, j = np.nonzero(counts)
        n = counts[w, j]
        cell = m[:free].T.astype(float)  # a class's count with each context
        small = np.arange(1.0, 9.0)
        steps = _xlogx(cell[None] + small[:, None, None]) - _xlogx(cell)[None]  # what small counts add, for all words
        direct = (n > len(small)) | (j == own[w])
        gain = np.empty((len(w), free))
        looked, worked = np.flatnonzero(~direct), np.flatnonzero(direct)
        gain[looked] = steps[n[looked].astype(int) - 1, j[looked]]
        mine = looked[own[w[looked]] < free]
        at = cell[j[mine], own[w[mine]]]
        gain[mine, own[w[mine]]] = _xlogx(at) - _xlogx(at - n[mine])
        rest, more = cell[j[worked]], n[worked][:, None]
        mine = np.flatnonzero(own[w[worked]] < free)
        rest[mine, own[w[worked[mine]]]] -= more[mine, 0]
        same = np.flatnonzero(j[worked] == own[w[worked]])
        rest[same] -= others[w[worked[same]], :free]
        gain[worked] = _xlogx(rest + more) - _xlogx(rest)
        corner = np.flatnonzero(j < free)
        gain[corner, j[corner]] = 0
        if len(w):
            heads = np.flatnonzero(np.diff(w, prepend=-1))
            value[w[heads]] += np.add.reduceat(gain, heads)
        # the class gains the word as first of its followers, and as second of those before it
        total = counts.sum(1) + itself
        sums = m.sum(1)[:free].astype(float)
        kinds, which = np.unique(total, return_inverse=True)
        lost = (_xlogx(sums[None] + kinds[:, None]) - _xlogx(sums)[None])[which]
        lost[inside, own[inside]] = _xlogx(sums[own[inside]]) - _xlogx(sums[own[inside]] - total[inside])
        value -= lost
    added = after[:, :free] + before[:, :free] + itself[:, None]
    w, c = np.nonzero(added)
    n, corner = added[w, c], np.diag(table)[c]
    value[w, c] += np.where(own[w] == c, _xlogx(corner) - _xlogx(corner - n), _xlogx(corner + n) - _xlogx(corner))
    best = value.argmax(1)
    stay = np.full(len(own), -np.inf)
    stay[inside] = value[inside, own[inside]]
    return best, value[every, best] - stay


def likelihood(table: np.ndarray) -> float:
    """Of the class bigram, without the part that no classes change."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(0)).sum() - _xlogx(table.sum(1)).sum())


def move(table: np.ndarray, old: np.ndarray, new: np.ndarray, after: np.ndarray, before: np.ndarray, itself: np.ndarray) -> None:
    """Moves words, a row each, from their old to their new classes in the table of class bigrams."""
    some = np.flatnonzero(old != new)
    row, change = np.arange(len(some)), np.zeros((len(some), len(table)))
    change[row, old[some]], change[row, new[some]] = -1, 1
    table += change.T @ after[some] + (change.T @ before[some]).T
    corner = np.arange(len(table))
    table[corner, corner] += change.T @ itself[some]


def exchange(v: np.ndarray, w: np.ndarray, n: np.ndarray, size: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> tuple[np.ndarray, list[float]]:
    """(class of every word below size, likelihood at first and after every sweep) from bigrams (v, w) and their counts n.

    Words from size on stand in fixed classes of their own. Words move one after another, the most frequent first.
    """
    others = int(max(v.max(initial=size), w.max(initial=size))) + 1 - size
    of = np.concatenate([np.arange(size) % classes, classes + np.arange(others)])
    table = np.zeros((classes + others, classes + others))
    np.add.at(table, (of[v], of[w]), n)
    sides = []
    for x, y in ((v, w), (w, v)):  # followers of each word, words before each
        order = np.argsort(x, kind="stable")
        sides.append((np.searchsorted(x[order], np.arange(size + 1)), y[order], n[order].astype(float)))
    said = [likelihood(table)]
    for _ in range(sweeps):
        moved = 0
        for word in range(size):
            counts, itself = [], 0.0
            for bounds, near, times in sides:
                near, times = near[bounds[word] : bounds[word + 1]], times[bounds[word] : bounds[word + 1]]
                itself = float(times[near == word].sum())
                counts.append(np.bincount(of[near], np.where(near == word, 0.0, times), classes + others)[None])
            own = of[word : word + 1].copy()
            best, gain = best_classes(own, *counts, np.array([itself]), table, classes)
            if gain[0] > 1e-9:
                move(table, own, best, *counts, np.array([itself]))
                of[word] = best[0]
                moved += 1
        said.append(likelihood(table))
        if not moved:
            break
    return of[:size], said


def _exchanged(size: int):
    def run(batches):
        got = pa.Table.from_batches(list(batches), pa.schema([("v", pa.int32()), ("w", pa.int32()), ("n", pa.int64())]))
        own, _ = exchange(*(got[c].to_numpy().astype(np.int64) for c in ("v", "w", "n")), size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(own.astype(np.int32))], ["word", "class"])

    return run


_CONTEXTS = "hash bigint, codes binary, counts binary, at array<int>, n array<bigint>"


def _contexts(frequent):
    """Per word of a task, how often each class stands beside it: packed codes, with counts of at most 255 each; last, the task's counts of class bigrams."""

    def packed(table, held):
        keys, at, after, before = map(np.concatenate, zip(*held, strict=True))
        rare = np.flatnonzero(at < 0)
        others, which = np.unique(keys[rare], return_inverse=True)
        at[rare] = len(table.hashes) + which
        both = np.concatenate([at << 8 | after, (at << 8 | before)[before != _OTHER]])
        both, n = np.unique(both, return_counts=True)
        times = -(-n // 255)
        both, last = np.repeat(both, times), np.cumsum(times) - 1
        part = np.full(len(both), 255, np.uint8)
        part[last] = n - (times - 1) * 255
        heads = np.flatnonzero(np.diff(both >> 8, prepend=-1))
        word, bounds = both[heads] >> 8, np.append(heads, len(both))
        there = word < len(table.hashes)
        hashes = np.empty(len(word), np.uint64)
        hashes[there], hashes[~there] = table.hashes[word[there]], others[word[~there] - len(table.hashes)]
        none = pa.nulls(len(word), pa.list_(pa.int32())), pa.nulls(len(word), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), _binary((both & 255).astype(np.uint8), bounds), _binary(part, bounds), *none], ["hash", "codes", "counts", "at", "n"])

    def run(batches):
        table, held, size = frequent.value, [], 0
        total = np.zeros(_K * _K, np.int64)
        for batch in batches:
            for start, stop, keys, texts in _words(batch.column("text")):
                if not len(keys):
                    total[_END * _K + _END] += stop - start
                    continue
                at = table.find(keys)
                own = np.where(at >= 0, table.classes[at], -1) if len(table.classes) else at
                own = np.where(own >= 0, own, _M + _letters(keys))
                _, before_, own_ = _with_ends(own, texts, stop - start, _END)
                total += np.bincount(before_ * _K + own_, minlength=_K * _K)
                after, before = np.full(len(own), _END), np.full(len(own), _K + _END)
                near = np.flatnonzero(texts[1:] == texts[:-1])
                after[near], before[near + 1] = own[near + 1], _K + own[near]
                twice = near[keys[near] == keys[near + 1]]
                after[twice], before[twice + 1] = _SELF, _OTHER
                held.append((keys, at, after, before))
                size += len(keys)
                if size >= TOKENS:
                    yield packed(table, held)
                    held, size = [], 0
        if held:
            yield packed(table, held)
        some = np.flatnonzero(total)
        one = pa.array([0, len(some)], pa.int32())
        lists = pa.ListArray.from_arrays(one, pa.array(some.astype(np.int32))), pa.ListArray.from_arrays(one, pa.array(total[some]))
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), *lists], ["hash", "codes", "counts", "at", "n"])

    return run


def _placed(shared):
    """The words of a bucket in their best classes; those of the seed stay."""

    def run(group: pa.Table) -> pa.Table:
        frequent, seeded, table = shared.value
        hashes, word = np.unique(group["hash"].to_numpy().view(np.uint64), return_inverse=True)
        total, row = np.zeros(len(hashes) * (_SELF + 1)), 0
        for codes, counts in zip(group["codes"].chunks, group["counts"].chunks, strict=True):
            data, at = text_bytes(codes)
            times, _ = text_bytes(counts)
            mine = np.repeat(word[row : row + len(codes)], np.diff(at))
            np.add.at(total, mine * (_SELF + 1) + data, times.astype(float))
            row += len(codes)
        total = total.reshape(len(hashes), _SELF + 1)
        at = frequent.find(hashes)
        known = np.where(at >= 0, frequent.classes[at], -1) if len(frequent.classes) else at
        own = np.where(known >= 0, known, _M + _letters(hashes))
        fixed = (at >= 0) & seeded[at] if len(seeded) else np.zeros(len(hashes), bool)
        to, table = own.copy(), table.copy()
        times = total.sum(1)
        order = np.flatnonzero(~fixed)
        order = order[np.argsort(-times[order], kind="stable")]
        most, i = max(1.0, times.sum() / 256), 0
        while i < len(order):  # a word of weight by itself, lighter ones together, against counts that have all moves before
            j = i + max(1, min(1000, int(np.searchsorted(np.cumsum(times[order[i : i + 1000]]), most, "right"))))
            some = order[i:j]
            after, before, itself = (x.astype(float) for x in (total[some, :_K], total[some, _K:_SELF], total[some, _SELF]))
            best, gain = best_classes(own[some], after, before, itself, table, CLASSES)
            to[some] = np.where(gain > 1e-9, best, own[some])
            move(table, own[some], to[some], after, before, itself)
            i = j
        return pa.table({"hash": hashes.view(np.int64), "class": pa.array(to, pa.int32())})

    return run


def wide_sweep(train: DataFrame, frequent: Frequent, seeded: np.ndarray, n_words: int, n_tokens: int) -> DataFrame:
    """(hash, class) of every training word in its best class over all its neighbours. seeded: which of the frequent words stay."""
    sc = train.sparkSession.sparkContext
    shared = sc.broadcast(frequent)
    found = materialize(train.mapInArrow(_contexts(shared), _CONTEXTS), "contexts")
    got = found.filter("at is not null").select(F.explode(F.arrays_zip("at", "n")).alias("x")).groupBy("x.at").agg(F.sum("x.n").alias("n")).toPandas()  # at most _K squared rows
    table = np.zeros(_K * _K)
    table[got["at"]] = got["n"]
    buckets = max(1, n_words // PER_BUCKET, n_tokens // 4_000_000)
    groups = found.filter("hash is not null").select("hash", "codes", "counts").groupBy(F.pmod(F.xxhash64("hash"), F.lit(buckets)).alias("bucket"))
    model = sc.broadcast((frequent, seeded, table.reshape(_K, _K)))
    moved = materialize(groups.applyInArrow(_placed(model), "hash bigint, class int"), "classes")
    discard(train.sparkSession, found._covary_path)
    shared.destroy()
    model.destroy()
    return moved


def _binary(parts: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """parts[bounds[i] : bounds[i + 1]] as the bytes of value i."""
    at = (bounds * parts.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(parts))])


def _encode(frequent):
    """Per row: the classes of its words (_OTHER outside the table), the other words with their numbers, and which of these stands at each such place."""

    def run(batches):
        table = frequent.value
        log_counts = np.log10(table.counts + 1.0)
        for batch in batches:
            for start, stop, hashes, texts in _words(batch.column("text")):
                n = stop - start
                at = table.find(hashes)
                there = at >= 0
                own = np.where(there, table.classes[at], _OTHER) if len(table.classes) else np.full(len(at), _OTHER)
                word = np.where(there, log_counts[at], 0.0) if len(log_counts) else np.zeros(len(at))
                every = np.arange(n + 1)
                other = np.flatnonzero(~there)
                order = other[np.lexsort((hashes[other], texts[other]))]
                new = np.ones(len(order), bool)
                new[1:] = (texts[order][1:] != texts[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
                heads = np.flatnonzero(new)
                times = np.diff(np.append(heads, len(order)))
                bounds = np.searchsorted(texts[order][heads], every).astype(np.int32)
                which = np.zeros(len(own), np.int32)
                which[order] = np.cumsum(new) - 1
                which = which[other] - bounds[texts[other]]
                words = pa.StructArray.from_arrays([pa.array(hashes[order][heads].view(np.int64)), pa.array(times.astype(np.int32))], ["hash", "times"])
                part = batch.slice(start, n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("row"), part.column("held_out"), pa.array(np.bincount(texts, there, n).astype(np.int64)), pa.array(np.bincount(texts, word, n)), _binary(own.astype(np.uint8), np.searchsorted(texts, every)), _binary(which, np.searchsorted(texts[other], every)), _binary(_letters(hashes[order][heads]).astype(np.uint8), bounds), pa.ListArray.from_arrays(pa.array(bounds), words)],
                    ["id", "row", "held_out", "known", "plain", "classes", "which", "rare", "others"],
                )

    return run


def _filled(unseen: np.ndarray):
    """The classes of all words of each row, given those of its other words that training has; unseen: by letters."""

    def run(batches):
        for batch in batches:
            got, at = text_bytes(batch.column("classes"))
            got = got.copy()
            which, places = text_bytes(batch.column("which"))
            rare, firsts = text_bytes(batch.column("rare"))
            classes = unseen[rare]
            found = batch.column("found")
            rows = np.repeat(np.arange(len(batch)), found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            flat = found.flatten()
            classes[firsts[rows] + flat.field("k").to_numpy()] = flat.field("class").to_numpy()
            got[got == _OTHER] = classes[which.view(np.int32) + np.repeat(firsts[:-1], np.diff(places) // 4)] if len(which) else 0
            names = [x for x in batch.schema.names if x not in ("classes", "which", "rare", "found")]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), _binary(got, at)], [*names, "classes"])

    return run


def _sequence(column: pa.Array):
    """(text, class before, class) over words and end tokens."""
    data, at = text_bytes(column)
    n = len(at) - 1
    return _with_ends(data.astype(np.int64), np.repeat(np.arange(n), np.diff(at)), n, _END)


def _transitions(batches):
    total = np.zeros(_M * _M, np.int64)
    for batch in batches:
        _, before, own = _sequence(batch.column("classes"))
        total += np.bincount(before * _M + own, minlength=_M * _M)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["at", "n"])


def _score(model):
    def run(batches):
        transition, emission = model.value
        for batch in batches:
            texts, before, own = _sequence(batch.column("classes"))
            score = np.bincount(texts, transition[before, own] + emission[own], len(batch)) + batch.column("plain").to_numpy()
            names = [x for x in batch.schema.names if x != "classes"]
            tokens = np.bincount(texts, minlength=len(batch)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(tokens), pa.array(score)], [*names, "n_tokens", "score"])

    return run


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row, learning where held_out is false."""
    spark = bounded_batches(docs.sparkSession)
    sc = spark.sparkContext
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), held_out.alias("held_out"))
    train = rows.filter(~F.col("held_out")).select("text")

    counts = materialize(train.mapInArrow(_count, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n")), "counts")
    letters = F.col("hash").bitwiseAND(F.lit(RARE - 1)).cast("int").alias("rare")
    n_train = train.count()
    bucket = F.floor(F.log2("n") * 8).cast("int")
    levels = counts.groupBy(bucket.alias("level")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).toPandas()  # at most 512 rows
    tokens, distinct = int(levels["n"].sum()) + n_train, int(levels["words"].sum()) + (n_train > 0)
    by_level = levels.groupby("level")["words"].sum().sort_index(ascending=False).cumsum()
    allowed = by_level[by_level <= FREQUENT].index
    least = int(allowed.min()) if len(allowed) else 1 << 20
    top = counts.filter(bucket >= least).select("hash", "n").toArrow()
    hashes, numbers = top["hash"].to_numpy().view(np.uint64), top["n"].to_numpy()
    by_hash = np.argsort(hashes)
    hashes, numbers = hashes[by_hash], numbers[by_hash]
    del top, by_hash
    order = np.lexsort((hashes, -numbers))[:SEED]
    ranks = np.full(len(hashes), -1, np.int32)
    ranks[order] = np.arange(len(order))

    classes, seeded = np.full(len(hashes), -1, np.int32), ranks >= 0
    words = counts.select("hash", "n", (bucket >= least).alias("frequent"))
    if len(order):
        shared = sc.broadcast(Frequent(hashes, numbers, ranks))
        pairs = train.mapInArrow(_bigrams(shared, len(order)), "v int, w int, n bigint").groupBy("v", "w").agg(F.sum("n").alias("n"))
        clustered = pairs.repartition(1).mapInArrow(_exchanged(len(order)), "word int, class int").toPandas()  # a row per word of the seed
        shared.destroy()
        classes[order[clustered["word"]]] = clustered["class"]
        for _ in range(WIDE):
            moved = wide_sweep(train, Frequent(hashes, numbers, classes), seeded, distinct, tokens)
            placed = materialize(words.join(moved.hint("merge"), "hash"), "words")
            got = placed.filter("frequent").select("hash", "class").toArrow()
            classes = classes.copy()
            classes[np.searchsorted(hashes, got["hash"].to_numpy().view(np.uint64))] = got["class"].to_numpy()
        words = placed
    else:
        words = words.withColumn("class", F.lit(0))
    table = sc.broadcast(Frequent(hashes, numbers, classes))

    by_class = words.groupBy(letters, "class").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).toPandas()  # at most RARE x CLASSES rows
    size, kinds, shape = np.zeros(_M), np.zeros(_M), np.zeros((RARE, CLASSES))
    np.add.at(size, by_class["class"].to_numpy(int), by_class["n"].to_numpy(float))
    np.add.at(kinds, by_class["class"].to_numpy(int), by_class["words"].to_numpy(float))
    shape[by_class["rare"].to_numpy(int), by_class["class"].to_numpy(int)] = by_class["words"]
    unseen = np.where(shape.any(1), shape.argmax(1), shape.sum(0).argmax()).astype(np.uint8)

    encoded = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        _encode(table), f"id {docs.schema[id_col].dataType.simpleString()}, row bigint, held_out boolean, known bigint, plain double, classes binary, which binary, rare binary, others array<struct<hash:bigint,times:int>>"
    )
    encoded = materialize(encoded, "encoded")
    others = encoded.select("row", F.posexplode("others").alias("k", "o")).select("row", "k", "o.hash", "o.times")
    met = others.join(words.filter("not frequent").select("hash", "n", "class").hint("merge"), "hash")
    met = met.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("times").alias("found_n"), F.collect_list(F.struct("k", "class")).alias("found"))
    joined = encoded.drop("others").join(met.hint("merge"), "row", "left").select(
        "id", "held_out", (F.col("known") + F.coalesce("found_n", F.lit(0))).alias("known"), (F.col("plain") + F.coalesce("more", F.lit(0.0))).alias("plain"), "classes", "which", "rare", "found"
    )
    kept = "id {}, held_out boolean, known bigint, plain double".format(docs.schema[id_col].dataType.simpleString())
    filled = materialize(joined.mapInArrow(_filled(unseen), kept + ", classes binary"), "classes")
    discard(spark, encoded._covary_path)

    got = filled.filter("not held_out").select("classes").mapInArrow(_transitions, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros(_M * _M)
    seen[got["at"]] = got["n"]
    seen = seen.reshape(_M, _M)
    share = (seen.sum(0) + 1) / (seen.sum() + _M)
    transition = np.log10((seen + _M * share) / (seen.sum(1, keepdims=True) + _M))
    emission = -np.log10(size + kinds + 1)  # subtracted from log10(count + 1)
    emission[_END] = 0
    all_words = math.log10(tokens + distinct + 1)
    end = math.log10((n_train + 1) / (tokens + distinct + 1))
    scored = filled.mapInArrow(_score(sc.broadcast((transition, emission))), kept + ", n_tokens bigint, score double")
    return scored.select(
        "id",
        "held_out",
        "n_tokens",
        (F.col("known") + int(n_train > 0)).cast("bigint").alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("plain") - (F.col("n_tokens") - 1) * F.lit(all_words) + F.lit(end)).alias("base_score"),
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def op10_lm_scores(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs, fold("doc_id", 7) == 2).withColumnRenamed("id", "doc_id")
