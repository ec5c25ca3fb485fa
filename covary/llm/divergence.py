"""How a source's words differ from those of its language and of the language's other sources: exact count-cell ranking.

A term is a run of letters (bytes of ASCII that are none end it, all else belongs to it). Tasks count terms by 64-bit hashes, and compare
every occurrence with the term that its hash stands for; a slice of text in which two terms share a hash is counted by the terms themselves. Per language the V terms of at least
LEAST_DOCS documents are kept. With count c of N kept occurrences, p = 1 + floor(SCALE * (c + 2) / (N + 2 * V)); the divergence
of p and q is floor((p - q)^2 / (p + q)). All of it is integer arithmetic, decimals where 64 bits do not suffice.

Terms against the language: a term's divergence depends only on its counts in the group and in the language. Terms are grouped
into cells by these two counts, each cell is evaluated once with its multiplicity, cells of equal value merge, and values are
ranked by the multiplicities before them. Only the cells within the first ranks are expanded to terms, in UTF-8 order.

Sources against each other: the terms of a language are dealt to blocks and its sources to tiles. A task has one block for two tiles,
evaluates each cell of two sources' p once with its multiplicity and returns a sum for each pair of sources. A row goes to as many
tasks as its language has tiles, and no term meets pairs of its sources outside such a task.

Cases: null text, language and source are read as ''; a group without terms takes part with counts of 0; a language without kept
terms gives values of 0 in `pair` and no rows in `term`; a language of one source gives no rows in `pair`; rows that repeat an id
are documents each; ids are not read; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covary.llm.store import bounded_batches, gives_back, materialize
from covary.llm.words import LOWER, slices, spread, text_bytes, word_hashes

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
BLOCK = 2048  # terms
TILE = 64  # sources
HELD = 1 << 19  # counts that a task holds before it hands them on

_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_P = f"1 + (cast({{c}} + 2 as decimal(20, 0)) * cast({SCALE} as decimal(10, 0))) div cast({{n}} + 2 * v as decimal(20, 0))"
_F = "((p - q) * (p - q)) div (p + q)"


def _summed(columns: list[np.ndarray], keys: int) -> list[np.ndarray]:
    """Rows of equal first `keys` columns as one, the other columns summed."""
    order = np.lexsort(columns[:keys])
    columns = [c[order] for c in columns]
    first = np.ones(len(order), bool)
    first[1:] = np.any([c[1:] != c[:-1] for c in columns[:keys]], 0)
    at = np.flatnonzero(first)
    return [c[at] for c in columns[:keys]] + [np.add.reduceat(c, at) if len(at) else c for c in columns[keys:]]


class _Counts:
    """Occurrences and documents of (group, term) of a task's rows, handed on as Arrow batches."""

    def __init__(self):
        self.groups, self.parts, self.terms, self.size, self.seen = {}, [], [], 0, 0

    def add(self, groups: np.ndarray, column: pa.Array) -> bool:
        """Counts the texts of a slice, whose rows are of the given groups; False if two of its terms share a hash."""
        data, at = text_bytes(column)
        hashes, texts, starts, lengths = word_hashes(data, at, space=_OUTSIDE)
        if not len(hashes):
            return True
        kinds, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        like = starts[first][which]
        if (lengths != lengths[first][which]).any() or (LOWER[data[spread(starts, lengths)]] != LOWER[data[spread(like, lengths)]]).any():
            return False
        body = LOWER[data[spread(starts[first], lengths[first])]]
        ends = np.append(0, np.cumsum(lengths[first])).astype(np.int32)
        self.terms.append((kinds, pa.StringArray.from_buffers(len(kinds), pa.py_buffer(ends), pa.py_buffer(body))))
        # words come in order of texts: a text's words are told apart by its number before the term's
        key, c = np.unique(texts * len(kinds) + which, return_counts=True)
        key, c, d = _summed([groups[key // len(kinds)] * len(kinds) + key % len(kinds), c, np.ones(len(key), np.int64)], 1)
        self.parts.append((key // len(kinds), key % len(kinds) + self.seen, c, d))
        self.size, self.seen = self.size + len(key), self.seen + len(kinds)
        return True

    def rows(self) -> pa.RecordBatch:
        group, term, c, d = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else [np.zeros(0, np.int64)] * 4
        terms = pa.concat_arrays([t for _, t in self.terms]) if self.terms else pa.array([], pa.string())
        if len(self.terms) > 1:
            _, first, which = np.unique(np.concatenate([k for k, _ in self.terms]), return_index=True, return_inverse=True)
            if pc.all(pc.equal(terms, terms.take(pa.array(first[which])))).as_py():  # else terms of one hash differ, and slices stay apart
                group, term, c, d = _summed([group, first[which][term], c, d], 2)
        names = [pa.array([g[i] for g in self.groups] or [""], pa.string()).take(pa.array(group)) for i in (0, 1)]
        out = pa.RecordBatch.from_arrays([*names, terms.take(pa.array(term)), pa.array(c), pa.array(d)], ["lang", "source", "term", "c", "d"])
        self.parts, self.terms, self.size, self.seen = [], [], 0, 0
        return out


def _plain(lang: str, source: str, text: str) -> list[tuple]:
    """A text's counts by the terms themselves."""
    terms = Counter(re.findall(TERM.encode(), text.encode().lower()))
    return [(lang, source, t.decode(), c, 1) for t, c in terms.items()]


def _count(batches):
    counts = _Counts()
    for batch in batches:
        pairs = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
        groups = np.array([counts.groups.setdefault(p, len(counts.groups)) for p in pairs], np.int64)
        text = batch.column("text")
        for start, stop in slices(text):
            if not counts.add(groups[start:stop], text.slice(start, stop - start)):
                rows = [r for i in range(start, stop) for r in _plain(*pairs[i], text[i].as_py())]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["lang", "source", "term", "c", "d"])
            if counts.size > HELD:
                yield counts.rows()
    yield counts.rows()


def term_counts(docs: DataFrame, least: int = LEAST_DOCS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, c, all, one) of the kept terms: occurrences in the group and in the language; one is 1 in one row of each (lang, term)."""
    bounded_batches(docs.sparkSession)
    empty = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    rows = docs.select(empty(lang_col, "lang"), empty(source_col, "source"), empty(text_col, "text"))
    counts = rows.mapInArrow(gives_back(_count), "lang string, source string, term string, c bigint, d bigint").groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    same = Window.partitionBy("lang", "term")
    return (
        counts.withColumn("all", F.sum("c").over(same)).withColumn("docs", F.sum("d").over(same)).withColumn("least", F.min("source").over(same))
        .filter(F.col("docs") >= least).select("lang", "source", "term", "c", "all", (F.col("source") == F.col("least")).cast("int").alias("one"))
    )


def groups(docs: DataFrame, kept: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, n, v, n_all) of every group of docs: kept occurrences in it, kept terms and occurrences of its language."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = kept.groupBy("lang", "source").agg(F.sum("c").alias("n"), F.sum("one").alias("v"))
    none = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("v"))
    every = none.unionAll(own).groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    whole = every.groupBy("lang").agg(F.sum("v").alias("v"), F.sum("n").alias("n_all"), F.count("source").alias("sources"))
    return every.drop("v").join(whole, "lang")


def top_terms(kept: DataFrame, known: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a group uses more than its language, of the greatest divergence."""
    cells = kept.groupBy("lang", "source", "c", "all").agg(F.count(F.lit(1)).alias("m")).join(known, ["lang", "source"])
    cells = cells.withColumn("p", F.expr(_P.format(c="c", n="n"))).withColumn("q", F.expr(_P.format(c="all", n="n_all"))).filter("p > q").withColumn("value", F.expr(_F))
    cells = cells.select("lang", "source", "c", "all", "value", "m")
    values = cells.groupBy("lang", "source", "value").agg(F.sum("m").alias("m"))
    down = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    # each value has a term at least, so values behind the first `top` are out of reach
    first = values.withColumn("i", F.row_number().over(down)).filter(F.col("i") <= top)
    first = first.withColumn("before", F.coalesce(F.sum("m").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter(F.col("before") < top)
    reached = cells.join(first.select("lang", "source", "value", "before"), ["lang", "source", "value"]).drop("m")
    terms = kept.select("lang", "source", "c", "all", "term").join(reached, ["lang", "source", "c", "all"])
    ties = Window.partitionBy("lang", "source", "value").orderBy("term")
    ranked = terms.withColumn("i", F.row_number().over(ties)).filter(F.col("i") <= top).withColumn("rank", (F.col("before") + F.col("i")).cast("int"))
    return ranked.filter(F.col("rank") <= top).select("lang", "source", F.col("term").alias("item"), "value", "rank")


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


_SUMS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _pair_sums(table: pa.Table) -> pa.Table:
    """Sums over a block's terms for each pair of sources of two tiles, as what they are above the cell of two counts of 0.

    A source's row without a term has its p at a count of 0; in it, v is the multiplicity that its language has in that cell to begin with.
    """
    a, b = table["a"][0].as_py(), table["b"][0].as_py()
    known = table["term"].is_valid().to_numpy()
    sources = table["source"].combine_chunks().dictionary_encode()
    names, which = sources.dictionary, sources.indices.to_numpy()
    tile, p = table["tile"].to_numpy(), table["p"].to_numpy()
    zero, of = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    zero[which[~known]], of[which] = p[~known], tile
    terms = table["term"].combine_chunks().filter(pa.array(known)).dictionary_encode()
    here = np.repeat(zero[:, None], len(terms.dictionary), 1)
    here[which[known], terms.indices.to_numpy()] = p[known]
    every = int(table["v"].to_numpy()[~known].max())
    coded = [np.unique(row, return_inverse=True) for row in here]
    out = ([], [], [])
    for i in np.flatnonzero(of == a):
        for j in np.flatnonzero((of == b) & ((of > a) | (np.arange(len(of)) > i))):
            (x, at_x), (y, at_y) = coded[i], coded[j]
            if len(x) * len(y) <= len(at_x):  # fewer cells than terms
                m = np.bincount(at_x * len(y) + at_y, minlength=len(x) * len(y))
                total = int(m @ _divergence(x[:, None], y[None, :]).ravel())
            else:
                total = int(_divergence(here[i], here[j]).sum())
            total += (every - len(at_x)) * int(_divergence(zero[i], zero[j]))
            for column, value in zip(out, (i, j, total), strict=True):
                column.append(value)
    left, right = (names.take(pa.array(x, pa.int32())) for x in out[:2])
    value = pa.array(out[2], pa.int64())
    lang = pa.array([table["lang"][0].as_py()] * (2 * len(value)), pa.string())
    return pa.table([lang, pa.concat_arrays([left, right]), pa.concat_arrays([right, left]), pa.concat_arrays([value, value])], schema=_SUMS)


def source_pairs(kept: DataFrame, known: DataFrame, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, source, item, value, rank): every other source of a group's language by its divergence, summed over the kept terms."""
    dealt = known.select(
        "lang", "source", "n", "v", F.greatest(F.lit(1), F.ceil(F.col("v") / block)).alias("blocks"), F.ceil(F.col("sources") / tile).alias("tiles"),
        F.pmod(F.xxhash64("source"), F.ceil(F.col("sources") / tile)).alias("tile"),
    )
    used = kept.join(dealt, ["lang", "source"]).select("lang", "source", "term", F.expr(_P.format(c="c", n="n")).alias("p"), F.pmod(F.xxhash64("term"), "blocks").alias("block"), F.lit(0).cast("bigint").alias("v"), "tile", "tiles")
    unused = dealt.select("lang", "source", F.lit(None).cast("string").alias("term"), F.when(F.col("v") > 0, F.expr(_P.format(c="0", n="n"))).otherwise(1).alias("p"), "v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "tile", "tiles")
    unused = unused.withColumn("v", F.when(F.col("block") == 0, F.col("v")).otherwise(0))
    met = used.unionByName(unused).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.select("lang", "source", "term", "p", "v", "block", "tile", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"))
    sums = met.groupBy("lang", "block", "a", "b").applyInArrow(_pair_sums, "lang string, source string, item string, value bigint")
    value = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    down = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return value.withColumn("rank", F.row_number().over(down))


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` ranks all other sources, part `term` the first terms."""
    kept = materialize(term_counts(docs, least), "terms")
    known = materialize(groups(docs, kept), "groups")
    pairs = source_pairs(kept, known, block, tile).withColumn("part", F.lit("pair"))
    return pairs.unionByName(top_terms(kept, known, top).withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS w FROM documents),
c AS (SELECT lang, source, term, count(*) AS c, count(DISTINCT r) AS d FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
k AS (SELECT *, sum(c) OVER (PARTITION BY lang, term) AS cc FROM c QUALIFY sum(d) OVER (PARTITION BY lang, term) >= {LEAST_DOCS}),
t AS (SELECT DISTINCT lang, term, cc FROM k),
l AS (SELECT lang, count(*) AS v, sum(cc) AS nn FROM t GROUP BY lang),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(nn, 0) AS nn, coalesce((SELECT sum(c) FROM k WHERE k.lang = x.lang AND k.source = x.source), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN l USING (lang)),
e AS (SELECT g.lang, g.source, t.term, coalesce(k.c, 0) AS c, 1 + ({SCALE}::HUGEINT * (coalesce(k.c, 0) + 2)) // (n + 2 * v) AS p, 1 + ({SCALE}::HUGEINT * (t.cc + 2)) // (nn + 2 * v) AS q
  FROM g JOIN t USING (lang) LEFT JOIN k ON k.lang = g.lang AND k.source = g.source AND k.term = t.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM e a JOIN e b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM e WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms QUALIFY rank <= {TOP}
"""
