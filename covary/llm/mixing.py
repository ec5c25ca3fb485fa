"""Mixing sources to target weights: blocks of words, multinomial draws per output shard, and pseudorandom block order.

The words of a source's documents, laid end to end, are cut into blocks of BLOCK words. A source's target fixes how many block
slots it fills: rounds over all its blocks, then a last round over its full blocks that takes only what is left of the target. Each
output shard draws how many of its slots every source gets: multinomial draws by what the sources have left, down a tree of shard
ranges, so that a shard's counts need no other shard and all slots are dealt. A source's slots go through a pseudorandom permutation of its block numbers,
one per round over its blocks, and blocks are joined by (source, number). All draws are keyed by SEED: reruns agree.

The order of a source's documents is by a hash of the id, in 4096 groups, so that running sums need no task per source.

Cases: a null text has no words; a null source is a source of its own, the last; documents without words take nothing; repeated
rows are documents of their own; a null id is ordered first; an empty table gives an empty table; other columns are not read.
The table of sources (one row each) is the only thing that passes through the driver; its rows are checked against MAX_SOURCES.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covary.llm.store import fresh, materialize

BLOCK = 128
SHARD_SLOTS = 4096
ROUNDS = 12
SEED = 7
WEIGHTS = (5, 2, 1)
TOTAL = 1.5
MOST = 2.0
MAX_SOURCES = 1_000_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, source_size) -> with target: `total` of all words shared by weight, none above `most` of its size.

    Sharing the excess again and again ends where every source has the lesser of its limit and one level times its weight:
    sources are ordered by limit over weight, and the level is found where those below are full.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("i", F.row_number().over(by_name) - 1)
    w = w.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int")).cast("double"))
    everything = Window.partitionBy()
    ahead = Window.orderBy("ratio", "i").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("ratio", most * F.col("source_size") / F.col("weight"))
    w = w.withColumn("full", F.coalesce(F.sum("source_size").over(ahead), F.lit(0)) * most).withColumn("gone", F.coalesce(F.sum("weight").over(ahead), F.lit(0.0)))
    w = w.withColumn("all_words", F.sum("source_size").over(everything) * total).withColumn("all_weight", F.sum("weight").over(everything))
    level = (F.col("all_words") - F.col("full")) / (F.col("all_weight") - F.col("gone"))
    w = w.withColumn("level", F.when(level <= F.col("ratio"), level))
    # the first source, in that order, that the level does not fill fixes the level of all behind it
    w = w.withColumn("level", F.min_by("level", F.when(F.col("level").isNotNull(), F.struct("ratio", "i"))).over(everything))
    return w.select("source", "source_size", F.when(F.col("ratio") < F.col("level"), most * F.col("source_size")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def place_words(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, hash, source, size, group, row, start): start counts the source's words before the document."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
    rows = materialize(rows.withColumn("group", F.substring(F.coalesce(F.md5(F.col("id").cast("string").cast("binary")), F.lit("")), 1, 3)), "sizes")
    within = Window.partitionBy("source", "group").orderBy(F.col("id").asc_nulls_first(), "size", "hash")
    running = rows.withColumn("row", F.row_number().over(within)).withColumn("inner", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    groups = rows.groupBy("source", "group").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(F.col("source").alias("s"), F.col("group").alias("g"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    joined = running.join(groups, F.col("source").eqNullSafe(F.col("s")) & (F.col("group") == F.col("g")))
    return joined.select("id", "hash", "source", "size", "group", "row", (F.col("base") + F.col("inner")).alias("start"))


def source_key(source: Column) -> Column:
    return F.coalesce(F.hex(source.cast("binary")), F.lit("-"))


def permute(df: DataFrame, x: str, n: str, key: Column, rounds: int = ROUNDS) -> DataFrame:
    """Replaces x by a keyed permutation of 0 .. n-1, for any n: in each round x may swap with its mirror image, as a hash of the two says."""
    for r in range(rounds):
        shift = F.conv(F.substring(F.md5(F.concat_ws(":", key, F.lit(str(r))).cast("binary")), 1, 8), 16, 10).cast("bigint") % F.col(n)
        df = df.withColumn("_other", (shift + F.col(n) - F.col(x)) % F.col(n))
        swap = F.substring(F.md5(F.concat_ws(":", key, F.lit(str(r)), F.greatest(x, "_other").cast("string")).cast("binary")), 1, 1) < "8"
        df = df.withColumn(x, F.when(swap, F.col("_other")).otherwise(F.col(x)))
    return df.drop("_other")


def split_slots(counts: list[int], shard: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of every source in this shard, those in the shards before), by halving the range of shards."""
    left_of, held = np.zeros(len(counts), np.int64), np.array(counts, np.int64)
    low, high = 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        n = min((middle - low) * SHARD_SLOTS, int(held.sum()))
        part = _draw(np.random.default_rng([SEED, low, high]), held, n)
        if shard < middle:
            held, high = part, middle
        else:
            left_of, held, low = left_of + part, held - part, middle
    return held, left_of


def _draw(rng, counts: np.ndarray, n: int) -> np.ndarray:
    """n slots over the sources: a multinomial draw by what each has left, mended where that is less than it drew."""
    part = np.minimum(rng.multinomial(n, counts / max(1, counts.sum())), counts)
    for i in np.argsort(part - counts, kind="stable"):
        part[i] += min(n - int(part.sum()), int(counts[i] - part[i]))
    return part


def slots(sources: list, spark, block: int = BLOCK) -> DataFrame:
    """(key, shard, slot, round, index, words): every slot of the mix, the block that it takes and how many of its words."""
    table = []
    for r in sources:  # a row per source
        want, size = int(np.floor(r["target"] + 0.5)), r["source_size"]
        if want:
            blocks = -(-size // block)
            rounds, rest = divmod(want, size)
            table.append((r["key"], size, blocks, rounds, rest, rounds * blocks + -(-rest // block)))
    counts = [t[5] for t in table]
    shards = -(-sum(counts) // SHARD_SLOTS)

    def run(batches):
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                got, before = split_slots(counts, shard, shards)
                some = np.flatnonzero(got)
                known = [pa.array([table[i][k] for i in some], pa.string() if k == 0 else pa.int64()) for k in range(5)]
                yield pa.RecordBatch.from_arrays([*known, pa.array([shard] * len(some), pa.int64()), pa.array(before[some]), pa.array(got[some])], ["key", "size", "blocks", "rounds", "rest", "shard", "first", "n"])

    n = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    drawn = spark.range(0, shards, 1, n).mapInArrow(run, "key string, size bigint, blocks bigint, rounds bigint, rest bigint, shard bigint, first bigint, n bigint")
    out = drawn.withColumn("slot", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)))
    out = out.withColumn("round", F.expr("slot div blocks")).withColumn("place", F.col("slot") % F.col("blocks"))
    last, full = F.col("round") == F.col("rounds"), F.expr(f"size div {block}")
    out = out.withColumn("among", F.when(last, full).otherwise(F.col("blocks"))).withColumn("index", F.col("place"))
    # the source's short last block comes last in the last round and stays where it is
    out = out.withColumn("among", F.when(F.col("place") < F.col("among"), F.col("among")).otherwise(F.lit(1)))
    stays = last & (F.col("place") >= full)
    out = permute(out.withColumn("index", F.when(stays, F.lit(0)).otherwise(F.col("place"))), "index", "among", F.concat_ws(":", F.lit(str(SEED)), "key", F.col("round").cast("string")))
    out = out.withColumn("index", F.when(stays, F.col("place")).otherwise(F.col("index")))
    words = F.when(last, F.least(F.lit(block), F.col("rest") - F.col("place") * block)).otherwise(F.least(F.lit(block), F.col("size") - F.col("index") * block))
    return out.select("key", "shard", "slot", "round", "index", words.alias("words"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, total: float = TOTAL, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """A row per document: (id, hash of its text, source, size, source_size, target, taken, rounds, spans).

    rounds says how often the whole document is taken; spans array<struct<round, shard, first, words>> has every run of its
    words that a slot takes, rounds over the whole source included.
    """
    spark = docs.sparkSession
    placed = materialize(place_words(docs, id_col, text_col, source_col).withColumn("key", source_key(F.col("source"))), "placed")
    found = targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, total, most).withColumn("key", source_key(F.col("source"))).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: r["key"])
    # written out, as a filter pushed through the permutation would repeat its rounds' expressions without end
    taken = materialize(slots(found, spark, block), "slots").select("key", "shard", "round", F.col("index").alias("b"), F.col("words").alias("w"))
    pieces = placed.filter("size > 0").withColumn("b", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
    low = F.greatest(F.col("start"), F.col("b") * block)
    high = F.least(F.col("start") + F.col("size"), F.col("b") * block + F.col("w"))
    hit = pieces.select("key", "b", "group", "row", "start", "size").join(taken, ["key", "b"]).withColumn("n", high - low).filter("n > 0")
    hit = hit.groupBy("key", "group", "row").agg(F.sum("n").alias("taken"), F.collect_list(F.struct("round", "shard", (low - F.col("start")).alias("first"), F.col("n").alias("words"))).alias("spans"))
    known = spark.createDataFrame([(r["key"], r["source_size"], r["target"], int(np.floor(r["target"] + 0.5)) // r["source_size"] if r["source_size"] else 0) for r in found], "key string, source_size bigint, target double, rounds bigint")
    out = placed.join(hit, ["key", "group", "row"], "left").join(known, "key")
    return out.select("id", "hash", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "rounds", "spans")


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as documents, with the columns of docs: a document once for every whole round, and the words of its last round's spans."""
    mixed = mix(docs, id_col, text_col, source_col, **options)
    names = {c: fresh(docs.columns, c) for c in ("hash", "copy", "rounds", "spans", "part")}
    rows = docs.withColumn(names["hash"], F.xxhash64(text_col))
    same = Window.partitionBy(F.col(id_col), F.col(names["hash"])).orderBy(F.xxhash64(*docs.columns))
    rows = rows.withColumn(names["copy"], F.row_number().over(same))  # equal rows share a mix by number
    theirs = mixed.withColumn("copy", F.row_number().over(Window.partitionBy("id", "hash").orderBy("taken", "rounds")))
    theirs = theirs.select(F.col("id").alias("_mixed_id"), F.col("hash").alias("_mixed_hash"), F.col("copy").alias("_mixed_copy"), F.col("rounds").alias(names["rounds"]), F.filter("spans", lambda x: x["round"] == F.col("rounds")).alias(names["spans"]))
    both = rows.join(theirs, F.col(id_col).eqNullSafe(F.col("_mixed_id")) & (F.col(names["hash"]) == F.col("_mixed_hash")) & (F.col(names["copy"]) == F.col("_mixed_copy")))
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    spans = F.array_sort(names["spans"], lambda a, b: (a["first"] - b["first"]).cast("int"))
    part = F.when(F.size(names["spans"]) > 0, F.array_join(F.transform(spans, lambda x: F.array_join(F.slice(words, (x["first"] + 1).cast("int"), x["words"].cast("int")), " ")), " "))
    texts = F.concat(F.array_repeat(F.col(text_col), F.col(names["rounds"]).cast("int")), F.filter(F.array(part), lambda t: t.isNotNull()))
    return both.withColumn(names["part"], F.explode(texts)).withColumn(text_col, F.col(names["part"])).select(docs.columns)


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """Per document: its size, its source's size and target, and the words that the mix takes of it."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def _op9_sql() -> str:
    rounds = "p0 AS (SELECT *, place AS x FROM places)"
    for r in range(ROUNDS):
        rounds += f""",
s{r} AS (SELECT *, (('0x' || substr(md5({SEED} || ':' || key || ':' || rounds || ':{r}'), 1, 8))::BIGINT % among + among - x) % among AS o FROM p{r}),
p{r + 1} AS (SELECT key, rounds, rest, among, place, CASE WHEN substr(md5({SEED} || ':' || key || ':' || rounds || ':{r}:' || greatest(x, o)), 1, 1) < '8' THEN o ELSE x END AS x FROM s{r})"""
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(hex(source), '-') AS key, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, substr(md5(doc_id::VARCHAR), 1, 3) AS g FROM documents),
placed AS (SELECT *, (sum(size) OVER (PARTITION BY key ORDER BY g, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start FROM d),
z AS (SELECT key, source, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
i AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM z),
w AS (SELECT *, [{", ".join(f"{x}::DOUBLE" for x in WEIGHTS)}][(i % {len(WEIGHTS)} + 1)::INT] AS weight FROM i),
r AS (SELECT *, {MOST} * source_size / weight AS ratio FROM w),
a AS (SELECT *, {MOST} * coalesce(sum(source_size) OVER b, 0) AS f, coalesce(sum(weight) OVER b, 0) AS gone, {TOTAL} * sum(source_size) OVER () AS all_words, sum(weight) OVER () AS all_weight
  FROM r WINDOW b AS (ORDER BY ratio, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (all_words - f) / (all_weight - gone) AS lv FROM a),
v AS (SELECT lv AS level FROM l WHERE lv <= ratio ORDER BY ratio, i LIMIT 1),
t AS (SELECT key, source_size, CASE WHEN ratio < level THEN {MOST} * source_size ELSE level * weight END AS target FROM l, v),
q AS (SELECT *, floor(target + 0.5)::BIGINT AS want FROM t),
e AS (SELECT *, CASE WHEN source_size > 0 THEN want // source_size ELSE 0 END AS rounds, CASE WHEN source_size > 0 THEN want % source_size ELSE 0 END AS rest FROM q),
places AS (SELECT key, rounds, rest, source_size // {BLOCK} AS among, unnest(range(least(source_size // {BLOCK}, (rest + {BLOCK - 1}) // {BLOCK}))) AS place FROM e),
{rounds},
part AS (SELECT key, x * {BLOCK} AS low, x * {BLOCK} + least({BLOCK}, rest - place * {BLOCK}) AS high FROM p{ROUNDS}
  UNION ALL SELECT key, source_size // {BLOCK} * {BLOCK}, rest FROM e WHERE rest > source_size // {BLOCK} * {BLOCK}),
pieces AS (SELECT key, g, doc_id, size, start, unnest(range(start // {BLOCK}, (start + size - 1) // {BLOCK} + 1)) AS b FROM placed WHERE size > 0),
hit AS (SELECT c.key, c.start, sum(greatest(0, least(c.start + c.size, p.high) - greatest(c.start, p.low))) AS n FROM pieces c JOIN part p ON c.key = p.key AND c.b = p.low // {BLOCK} GROUP BY ALL)
SELECT doc_id, size, e.source_size, target, (rounds * size + CASE WHEN size > 0 THEN coalesce(n, 0) ELSE 0 END)::BIGINT AS taken
FROM placed JOIN e USING (key) LEFT JOIN hit ON hit.key = placed.key AND hit.start = placed.start
"""


OP9_SQL = _op9_sql()
