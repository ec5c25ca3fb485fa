"""Source divergence, hard negatives and the projection forest against plain Python, on odd rows, ties, repeats and empty tables."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from covary.llm import divergence, forest, negatives
from covary.llm.queries import ORACLES, QUERIES
from tests.conftest import SF


def plain_audit(rows, least=10, top=10):
    """rows: (text, lang, source)."""
    docs = [((t or ""), (lg or ""), (s or "")) for t, lg, s in rows]
    uses, holds, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        uses[lang, source].update(terms)
        holds[lang].update(set(terms))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in holds[lang].items() if n >= least]
        count = {s: Counter({t: uses[lang, s][t] for t in kept}) for s in sources}
        whole = Counter({t: sum(count[s][t] for s in sources) for t in kept})
        p_of = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))  # noqa: B023, E731
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = {s: {t: p_of(count[s], t) for t in kept} for s in sources}
        q = {t: p_of(whole, t) for t in kept}
        for s in sources:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            term = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if count[s][t] > 0 and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(pair))]
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(term)[:top])]
    return sorted(out)


def audited(df, **options):
    return sorted(tuple(r) for r in divergence.audit(df, **options).collect())


@pytest.fixture(scope="module")
def articles():
    rng = np.random.default_rng(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["ÉTÉ", "été", "日本", "Straße", "\U0001f600x", "￮x", "AB", "ab"]
    rows = []
    for i in range(400):
        lang, source = ("en", "fr", None)[i % 7 % 3], f"s{i % 11}" if i % 13 else None
        n = int(rng.integers(0, 40))
        rows.append((" ".join(rng.choice(words, n)) + ",x_y-Z9q" * (i % 3), lang, source))
    rows += [(None, "en", "s1"), ("", "xx", "only"), (None, "yy", "a"), ("lonely words", "yy", "b"), ("1 2 3 __", "en", "no terms"), (None, None, None)]
    rows += [("same same text", "en", "copies")] * 15 + [("long " * 40_000 + "tail", "en", "s2")]
    return rows


def test_divergence_equals_the_plain_audit(spark, articles):
    df = spark.createDataFrame([(i % 50, t, lg, s, 1, "clash") for i, (t, lg, s) in enumerate(articles)], "doc_id long, text string, lang string, source string, value int, term string").repartition(5)
    want = plain_audit(articles)
    assert any(r[2] == "term" for r in want) and any(r[4] == 0 and r[0] == "yy" for r in want)
    assert audited(df) == want
    assert audited(df, block=16, tile=3) == want  # many blocks and tiles
    assert audited(df.limit(0)) == []


def test_divergence_of_few_ranks_and_ties(spark):
    # all terms of a group in one cell: the whole rank list is one tie, in UTF-8 order
    rows = [(" ".join(f"t{chr(97 + k)}" for k in range(20)) + " zß z\U0001f600 z￮", "en", "a")] * 10 + [("common tb tc", "en", "b")] * 12
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    got = audited(df)
    assert got == plain_audit(rows)
    assert [r[3] for r in sorted((r for r in got if r[1] == "a" and r[2] == "term"), key=lambda r: r[5])] == sorted({"ta", *(f"t{chr(97 + k)}" for k in range(3, 20))}, key=str.encode)[:10]


def test_divergence_of_counts_beyond_64_bits_of_products(spark):
    known = spark.createDataFrame([("en", "a", 9 * 10**18 // 4, 2, 9 * 10**18 // 2, 1)], "lang string, source string, n long, v long, n_all long, sources long")
    kept = spark.createDataFrame([("en", "a", "x", 2 * 10**18, 2 * 10**18 + 5, 1), ("en", "a", "y", 25 * 10**16, 2 * 10**18, 1)], "lang string, source string, term string, c long, all long, one int")
    got = divergence.top_terms(kept, known).collect()
    p, q = (1 + 10**9 * (c + 2) // (n + 4) for c, n in ((2 * 10**18, 9 * 10**18 // 4), (2 * 10**18 + 5, 9 * 10**18 // 2)))
    assert [(r["item"], r["value"], r["rank"]) for r in got] == [("x", (p - q) ** 2 // (p + q), 1)]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(9, 6))
    rows = [(i, (centres[i % 9] + rng.normal(size=6) * 0.2).astype(np.float32).tolist(), i % 4) for i in range(400)]
    rows += [(400 + i, rows[5][1], i % 3) for i in range(60)]  # one vector many times
    rows += [(500, None, 1), (510, [0.0] * 6, 2), (520, [1.0] * 5 + [float("nan")], 1), (530, [1.0, None], 1), (540, [], 1), (550, [1.0, 2.0], None), (560, [1.0, 2.0], 0), (561, [3.0, 2.0], 0), (562, [2.0, 2.0], 1)]
    rows += [(10, rows[3][1], 1), (20, rows[20][1], 0), (21, rows[21][1], 1), (21, rows[22][1], 3), (None, rows[2][1], 1)]
    rows += [(600, [-9.0, 0.0, 0.0, 0.0, 0.0, 0.0], 2), (601, [9.0, 1e-3, 0.0, 0.0, 0.0, 0.0], 2)]
    return rows, spark.createDataFrame([(*r, 1.0, 7) for r in rows], "vec_id long, embedding array<float>, label int, score double, query_id int").repartition(3)


def plain_negatives(rows, step, positives=5, k=5):
    good = [(i, [int(np.floor(256 * float(x))) for x in v], lb) for i, v, lb in rows if i is not None and lb is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    asks = {}
    for i, v, lb in good:
        if i % step == 0:
            asks[i] = min(asks.get(i, (str(lb), v)), (str(lb), v))
    out = []
    for a, (label, v) in asks.items():
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, str(lb) == label) for i, w, lb in good if i != a and len(w) == len(v)]
        for s, p, _ in sorted(x for x in scored if x[2])[:positives]:
            hits = sorted(x for x in scored if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s)[:k]
            out += [(a, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(hits)]
    return sorted(out)


@pytest.mark.parametrize("candidates, anchors", [(8192, 4096), (37, 5)])
def test_hard_negatives_equal_the_plain_search(points, candidates, anchors):
    rows, df = points
    want = plain_negatives(rows, 10)
    got = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label"), candidates=candidates, anchors=anchors)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 200
    assert {r[0] for r in want} >= {400, 560}


def test_hard_negatives_of_odd_tables(points):
    _, df = points
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0, F.col("label")).count() == 0
    assert negatives.hard_negatives(df, F.lit(False), F.col("label")).count() == 0
    assert negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, F.lit("one")).count() == 0  # no negatives
    assert negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("vec_id")).select("positive_id").distinct().count() <= 2  # only repeated ids have positives


def test_exact_products_beyond_doubles():
    from covary.llm.blocks import inner

    a, b = np.array([[2.0**40 + 1, 3.0], [-(2.0**62), 0.0]]), np.array([[2.0**20 + 1, -7.0], [2.0**62, 1.0]])
    assert inner(a, b).tolist() == [[(2**40 + 1) * (2**20 + 1) - 21, 2**63 - 1], [-(2**63) + 1, -(2**63) + 1]]


def plain_nearest(rows, step, k):
    good = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    asks = {}
    for i, v in good:
        if i % step == 0:
            asks[i] = min(asks.get(i, v.tolist()), v.tolist())
    out = []
    for q, v in asks.items():
        far = sorted((float(np.sqrt(((w - np.array(v)) ** 2).sum())), i) for i, w in good if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(far)]
    return sorted(out)


def test_forest_finds_exactly_where_it_ranks_all_rows(points):
    rows, df = points
    want = plain_nearest(rows, 10, 10)
    for options in ({"share": 1.0}, {"share": 1.0, "shard": 40, "queries": 7}, {"shard": 60, "leaf": 8, "recall": 1.0, "sample": 500}):
        got = sorted(tuple(r) for r in forest.nearest(df, F.col("vec_id") % 10 == 0, **options).collect())
        assert [r[:3] for r in got] == [r[:3] for r in want]
        np.testing.assert_allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-12)
    assert forest.nearest(df.limit(0), F.lit(True)).count() == 0
    assert forest.nearest(df, F.lit(False)).count() == 0


def test_forest_opens_few_leaves_of_clustered_vectors_and_all_leaves_once():
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(100, 32)), 40, 0) + rng.normal(size=(4000, 32)) * 0.05
    trees = forest.Forest(x, trees=8, leaf=32)
    same = forest.Forest.unpacked(trees.packed())
    margins = same.margins(x[:50])
    hits = 0
    for q in range(50):
        got = same.candidates(margins[q], len(x), 200)
        assert len(got) == len(set(got.tolist())) < 400
        hits += len(set(np.argsort(forest.distances(x, x[q]))[:10]) & set(got.tolist()))
        assert sorted(same.candidates(margins[q], len(x), len(x)).tolist()) == list(range(len(x)))
    assert hits >= 0.95 * 500
    assert len(forest.Forest(np.ones((500, 3))).spans) == forest.TREES  # equal rows stay in one leaf


def test_recall_of_the_query_against_all_rows(spark):
    for sf in (SF, "/root/testdata/sf0.1"):
        df = spark.read.parquet(f"{sf}/embeddings.parquet")
        found = {(r["query_id"], r["vec_id"]) for r in QUERIES["op13_projection_forest"](spark, sf).collect()}
        want = {(r["query_id"], r["vec_id"]) for r in forest.nearest(df, F.col("vec_id") % 100 == 0, share=1.0).collect()}
        assert len(found) == len(want) and len(found & want) >= 0.9 * len(want)


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_hard_negatives"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    found = con.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(map(tuple, QUERIES[name](spark, SF).select(columns).collect())) == sorted(found.fetchall())
