"""The ten operators on small tables with nulls, empty and long texts, ties, repeated rows, clashing columns; against brute force."""

import base64
import hashlib
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from covary.llm import bpe, components, langid, lm, mixing, neardup, tokens, topk, toxicity, vecdup, warc
from tests.conftest import SF

BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", "  ", "a" * 300, "It's  a\n\n test, isn't 'LL'S it?", "日本語 😀😀  x y", "x" * 3000 + " y" * 50, "Ωmega  naïve\tcafé", "12345 67a8", " \r\n\t "]


@pytest.fixture
def docs(spark):
    rows = [(i, t, "en", "s", 7, "clash") for i, t in enumerate(TEXTS)] + [(2, "  ", "en", "s", 7, "clash"), (None, "no id", None, None, 7, "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, ids int, hash string")


def test_bpe_round_trip(docs):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(BPE), special_tokens={})
    apart = bpe.decode(bpe.encode(docs, BPE, public_tokenizers.PATTERN), BPE).collect()
    assert len(apart) == len(TEXTS) + 2
    want = {(i, t or "") for i, t in enumerate(TEXTS)} | {(2, "  "), (None, "no id")}
    for r in apart:
        text = bytes(r["decoded"]).decode()
        assert (r["doc_id"], text) in want
        assert np.frombuffer(r["ids"], "<u4").tolist() == enc.encode_ordinary(text)
    together = bpe.encode(docs, BPE, public_tokenizers.PATTERN, decoded=True).collect()
    assert sorted(map(str, together)) == sorted(map(str, apart))
    assert bpe.encode(docs.limit(0), BPE, public_tokenizers.PATTERN).count() == 0


def test_bpe_vocabulary_of_a_task_starts_anew(spark):
    """Blocks of a few texts and a vocabulary of 40 words: words come back after they were dropped, with long ones among them."""
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(BPE), special_tokens={})
    letters = "abcdefghijklmnopqrst"
    number = lambda n: letters[n // 20] + letters[n % 20]
    texts = [" ".join(number((i * 37 + j * j) % 211) + "qz" * (150 if j == i % 7 else 33) for j in range(9)) for i in range(1500)]  # all too long for the sample's words
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = bpe.encode(df, BPE, public_tokenizers.PATTERN, block_bytes=4096, task_words=40).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in got} == dict(enumerate(enc.encode_ordinary_batch(texts)))


def test_bpe_one_read_finds_any_pair_and_no_other():
    place, slots = bpe.displaced(BPE)
    pairs = bpe.pair_ranks(BPE)
    left, right = np.array(list(pairs)).T
    assert (slots[place[left] + right] == (np.array(list(pairs.values())) << 20 | left)).all()
    a, b = np.random.default_rng(5).integers(0, len(place), (2, 200_000))
    at = place[a] + b
    hit = (at < len(slots)) & (slots[np.minimum(at, len(slots) - 1)] & 0xFFFFF == a)
    assert hit.tolist() == [k in pairs for k in zip(a.tolist(), b.tolist(), strict=True)]


def test_bpe_plans_hold_no_table_of_pairs(docs):
    """Plans, and what the driver keeps of them, must not grow with the rank file."""
    made = bpe.encode(docs, BPE, public_tokenizers.PATTERN, decoded=True)
    plans = made._jdf.queryExecution()
    assert all(len(p.toString()) < 20_000 for p in (plans.analyzed(), plans.optimizedPlan(), plans.executedPlan()))


def test_models_reach_the_driver_as_arrow_columns_not_as_rows(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")

    def refuse(self):
        raise AssertionError("every row becomes an object of the driver")

    monkeypatch.setattr(type(docs), "toPandas", refuse)
    model = langid.fit(docs)
    assert model.languages and all(len(h) and h.tolist() == sorted(set(h.tolist())) and s.shape == (len(h), len(model.languages)) for h, s in zip(model.hashes, model.scores, strict=True))
    assert len(toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet")).hashes)


def test_bpe_long_words_merge_like_the_fold():
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(BPE), special_tokens={})
    ranks = bpe.load_ranks(BPE)
    for word in ("a" * 700, "abcab" * 90, "thethertion" * 40):
        assert bpe.merge_long([ranks[bytes([b])] for b in word.encode()], bpe.pair_ranks(BPE)) == enc.encode_ordinary(word)


def test_token_files(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    uri = f"file:///tmp/spark-tokens-{uuid.uuid4().hex}"
    manifest = tokens.write_tokens(docs, uri, path, end_id=2, length=16, rows=4, shards=3)
    rows = sorted(tokens.read_tokens(manifest, uri).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 0, 1, 2, 2, *range(3, len(TEXTS))]
    start = 0
    for r in rows:
        text = "no id" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids))
        start += len(ids)
    shard = tokens.Shard(uri, manifest.first()["file"])
    ids, mask = shard.sequence(0)
    assert len(ids) == len(mask) == 16 and not ids.flags.owndata
    assert tokens.read_tokens(tokens.write_tokens(docs.limit(0), uri + "e", path, end_id=2), uri + "e").count() == 0


def test_warc(spark):
    rows = [(5, "u", "same"), (3, "u", "same"), (None, "u\r\nx", "same"), (3, "u", "same"), (9, None, None), (10, "x", ""), (11, "y", "z\x1f\x8b\x08é" * 50_000)]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    uri = f"file:///tmp/spark-warc-{uuid.uuid4().hex}"
    manifest = warc.write_warc(pages, uri)
    want = sorted(str((k, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), {5: 3, None: 3, 10: 9}.get(k))) for k, _, h in rows)
    for split in (64, 1000, 1 << 23):
        got = warc.read_warc(manifest, uri, split).collect()
        assert sorted(str((int(r["key"]) if r["key"] else None, r["payload_bytes"], r["payload_digest"], int(r["refers_to"]) if r["refers_to"] else None)) for r in got) == want
        assert all((r["record_type"] == "revisit") == (r["refers_to"] is not None) for r in got)
    assert warc.write_warc(pages.limit(0), uri + "e").count() == 0


def test_warc_reads_one_very_long_record_in_linear_time():
    import io
    import time

    took = []
    for n in (8, 32):
        body = np.random.default_rng(n).integers(0, 256, n << 20, dtype=np.uint8).tobytes()  # does not shrink
        file = warc.record("1", "u", body, "D", None) + warc.record("2", "u", b"x", "D", None)
        began = time.process_time()
        got = [warc.parse(r) for r in warc.members(io.BytesIO(file), 0, len(file))]
        took.append(time.process_time() - began)
        assert [r[0] for r in got] == ["1", "2"] and got[0][-1] == body
        assert [warc.parse(r)[0] for r in warc.members(io.BytesIO(file), 1, len(file))] == ["2"]
    assert took[1] < 10 * took[0] + 0.5


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(12):
        centre = rng.normal(size=8)
        rows += [(centre + rng.normal(size=8) * rng.choice([0.0, 0.1, 0.4])).astype(np.float32).tolist() for _ in range(20)]
    rows += [None, [0.0] * 8, [1.0] * 7 + [float("nan")], [1.0, None], [], [1.0, 2.0]]
    return rows, spark.createDataFrame([(i, v, "x") for i, v in enumerate(rows)], "vec_id long, embedding array<float>, score string")


def test_top_k(vectors):
    rows, df = vectors
    whole = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (i for i in whole if i % 10 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[c], strict=True)), c) for c in whole if c != q and len(whole[c]) == len(whole[q]))[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    for shard, block in ((8192, 2048), (37, 5)):
        got = topk.top_k(df, F.col("vec_id") % 10 == 0, shard=shard, queries=block).collect()
        assert sorted(tuple(r) for r in got) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_vector_links(vectors):
    rows, df = vectors
    good = np.array(rows[:240], np.float64)
    unit = good / np.linalg.norm(good, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    label = np.arange(240)
    while True:
        made = np.array([label[near[i]].min() for i in range(240)])
        if (made == label).all():
            break
        label = made
    want = [(i, int(near[i].sum() - 1), int(label[i]), bool(label[i] == i)) for i in range(240)] + [(i, 0, i, True) for i in range(240, 246)]
    assert sorted(tuple(r) for r in vecdup.pair_links(df, part=60).collect()) == want
    assert vecdup.pair_links(df.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 30)] + [(7, 7)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(100, 141), 100), **dict.fromkeys(range(1, 30), 1)}


def test_near_duplicates(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(4000)]
    base = [list(rng.choice(words, 120)) for _ in range(25)]
    texts = []
    for b in base:
        texts.append(" ".join(b))
        for k in (0, 1, 2, 3, 5):
            changed = list(b)
            for at in rng.choice(120, k, replace=False):
                changed[at] = "changed"
            texts.append("  ".join(changed).upper())
    texts += [None, "", " \t", "One two", "one  TWO", "one"]
    df = spark.createDataFrame([(i, t, "b") for i, t in enumerate(texts)], "doc_id long, text string, bands string")

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    want = [(i, len(sets[i]), label[i], label[i] == i) for i in range(len(texts))]
    assert sorted(tuple(r) for r in neardup.near_duplicates(df).collect()) == want
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_of_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(4, "a b"), (4, "a b"), (5, "A  b"), (None, "a b")], "doc_id long, text string")
    got = sorted(map(str, (tuple(r) for r in neardup.near_duplicates(df).collect())))
    assert got == sorted(map(str, [(4, 1, 4, True), (4, 1, 4, True), (5, 1, 4, False), (None, 1, None, True)]))


def test_language(spark):
    train = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(train.filter(lm.fold("doc_id", 4) != 2))
    held = langid.predict(train.filter(lm.fold("doc_id", 4) == 2), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !", "x"), (4, "the " * 50_000, "x")], "doc_id long, text string, score string")
    got = {r["doc_id"]: (r["lang_pred"], 0 <= r["score"] <= 1) for r in langid.predict(odd, model).collect()}
    assert got == {1: ("und", True), 2: ("und", True), 3: ("und", True), 4: ("en", True)}
    assert {r["lang_pred"] for r in langid.predict(odd, langid.fit(train.limit(0))).collect()} == {"und"}


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    read = lambda s: toxicity.restore(s, model.characters)
    assert [read(s) for s in ("m0r0n", "1d10t", "l0$er", "i d i o t", "scuuuum")] == ["moron", "idiot", "loser", "idiot", "scum"]
    assert toxicity.restored_words("the moron of 12 and a b", read) == []
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "and the of what " * 20), (4, "and the of what " * 20 + " 1d10t m0r0n worthless l0ser")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(odd, model).collect()}
    assert max(got[1], got[2], got[3]) < 0.5 <= got[4]
    none = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert all(r["score"] < 0.01 for r in toxicity.score(odd, none).collect())


def test_language_model(spark):
    import collections
    import math

    docs = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", "a b a", "A b c", "a  b", "zz b a", "new word"] * 4)] + [(0, None)], "doc_id long, text string")
    held = F.col("text").contains("new")
    rows = lm.score_texts(docs, F.coalesce(held, F.lit(False))).collect()
    tok = lambda t: (t or "").lower().split() + ["\n"]
    texts = [t for t in ["", "", "a b a", "A b c", "a  b", "zz b a"] * 4] + [""]
    c = collections.Counter(w for t in texts for w in tok(t))
    n, v = sum(c.values()), len(c)
    base = {t: sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t)) for t in [*texts, "new word"]}
    assert len(rows) == 29 and {r["train_tokens"] for r in rows} == {n}
    assert sorted(round(r["base_score"], 9) for r in rows) == sorted(round(base[t], 9) for t in [*texts, *["new word"] * 4])
    assert all(r["n_known"] == (1 if r["held_out"] else r["n_tokens"]) and r["score"] < 0 for r in rows)
    assert lm.score_texts(docs.limit(0), F.lit(False)).count() == 0


def test_best_classes_raise_the_likelihood_most():
    import numpy as np

    rng = np.random.default_rng(3)
    pairs = rng.integers(0, 4, (12, 12)) * rng.integers(0, 2, (12, 12))
    of = rng.integers(0, 5, 12)
    def table(of):
        m = np.zeros((5, 5))
        np.add.at(m, (of[:, None], of[None, :]), pairs)
        return m
    def likelihood(of):
        f = lambda v: np.where(v > 0, v * np.log(np.maximum(v, 1)), 0).sum()
        m = table(of)
        return f(m) - f(m.sum(0)) - f(m.sum(1))
    hot = np.eye(5)[of]
    itself = np.diag(pairs).astype(float)
    off = pairs - np.diag(np.diag(pairs))
    best, gain = lm.best_classes(of, off @ hot, off.T @ hot, itself, table(of), 3)
    for v in range(12):
        got = [likelihood(np.where(np.arange(12) == v, c, of)) for c in range(3)]
        assert got[best[v]] == pytest.approx(max(got)) and (gain[v] == np.inf if of[v] >= 3 else gain[v] == pytest.approx(max(got) - likelihood(of)))


def test_language_model_places_words_outside_the_seed_and_the_table(spark, monkeypatch):
    """Rare words that stand in one context are of one class whatever their letters, with or without a broadcast table."""
    import random

    random.seed(2)
    noun, verb = [random.choice("abcdefgh") + random.choice("stuvwxyz") + str(i) for i in range(60)], [random.choice("stuvwxyz") + random.choice("abcdefgh") + "q" * (i % 7) + str(i) for i in range(60)]
    texts = [f"the {random.choice(noun)} can {random.choice(verb)} now" for _ in range(400)] + ["the n1 can v1 now", "the v1 can n1 now"]
    noun, verb = noun[0], verb[0]
    texts = [*texts, f"the {noun} can {verb} now", f"the {verb} can {noun} now", f"{noun} {noun} {verb}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = F.col("doc_id") >= 402
    monkeypatch.setattr(lm, "SEED", 3)
    scores = []
    for frequent in (1 << 18, 8):
        monkeypatch.setattr(lm, "FREQUENT", frequent)
        got = {r["id"]: r for r in lm.score_texts(docs, held).collect()}
        assert len(got) == len(texts) and got[402]["n_known"] == 6
        scores.append(got[402]["score"] - got[403]["score"])
    assert scores[0] > 2 and scores[1] > 0.5


def test_mixing(spark):
    import random

    random.seed(1)
    rows = [(i, " ".join("w" for _ in range(random.choice([0, 1, 50, 900]))), random.choice(["a", "b", "c", None])) for i in range(150)] + [(7, None, "a"), (7, None, "a"), (None, "x y", "b")]
    df = spark.createDataFrame([(*r, "h") for r in rows], "doc_id long, text string, source string, hash string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
    for mine in by.values():
        assert sum(r["size"] for r in mine) == mine[0]["source_size"]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 1
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted(str(tuple(r)[:7]) for r in again) == sorted(str(tuple(r)[:7]) for r in got)
    texts = mixing.mixed_texts(df)
    assert texts.columns == df.columns
    assert texts.agg(F.sum(mixing.n_words(F.col("text")))).first()[0] == sum(r["taken"] for r in got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        df = spark.range(n).select(F.col("id").alias("x"), F.lit(n).cast("bigint").alias("n"))
        assert sorted(r["x"] for r in mixing.permute(df, "x", "n", F.lit("k")).collect()) == list(range(n))


def test_words_of_thue_and_morse_stay_apart(spark):
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(4096))
    b = a.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert {r["component_id"] for r in neardup.near_duplicates(df).collect()} == {1, 2}
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    uri = f"file:///tmp/spark-tokens-{uuid.uuid4().hex}"
    got = tokens.read_tokens(tokens.write_tokens(df, uri, path, end_id=2), uri).collect()
    want = {i: zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4")) for i, x in ((1, a), (2, b))}
    assert {r["doc_id"]: r["ids_crc32"] for r in got} == want
    words = langid.Words(__import__("pyarrow").array([a, b]))
    assert len(words.unique()[0]) == 2


def test_token_files_find_added_tokens_as_the_library_does(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = ["<|startoftext|> hi", "a<|endoftext|>b", "plain", "<|endof text|>", None, "x" * 10 + "<|startoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    uri = f"file:///tmp/spark-tokens-{uuid.uuid4().hex}"
    got = tokens.read_tokens(tokens.write_tokens(df, uri, path, end_id=2), uri).collect()
    want = {i: zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")) for i, x in enumerate(texts)}
    assert {r["doc_id"]: r["ids_crc32"] for r in got} == want


def test_toxicity_of_very_long_words_and_odd_tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = [(1, "ab" * 500_000, "x"), (2, "a1" * 20_000, "x"), (3, "1" * 1_000_000, "x"), (4, "a " * 200_000, "x"), (5, "same text", "x"), (5, "same text", "x"), (None, None, None)]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, score string"), model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs.limit(3), toxicity.fit(docs.limit(0), labels.limit(0))).collect())


def test_exchange_never_lowers_the_likelihood_and_finds_planted_classes():
    rng = np.random.default_rng(8)
    of = rng.integers(0, 4, 60)
    follow = np.array([[0.1, 0.8, 0.05, 0.05], [0.05, 0.05, 0.85, 0.05], [0.1, 0.1, 0.1, 0.7], [0.85, 0.05, 0.05, 0.05]])
    chain, state = [0], int(of[0])
    for _ in range(30_000):
        state = int(rng.choice(4, p=follow[state]))
        chain.append(int(rng.choice(np.flatnonzero(of == state))))
    pairs, n = np.unique(np.array(chain[:-1]) * 60 + np.array(chain[1:]), return_counts=True)
    found, said = lm.exchange(pairs // 60, pairs % 60, n, 60, classes=4, sweeps=8)
    assert all(b >= a - 1e-6 for a, b in zip(said, said[1:], strict=False))
    table = np.zeros((5, 5))
    np.add.at(table, (found[pairs // 60], found[pairs % 60]), n)
    assert said[-1] == pytest.approx(lm.likelihood(table))
    planted = np.zeros((5, 5))
    np.add.at(planted, (of[pairs // 60], of[pairs % 60]), n)
    assert said[-1] >= lm.likelihood(planted) - 0.02 * abs(lm.likelihood(planted))


def test_scores_are_those_of_the_class_bigram(spark):
    """The score against its definition, with the classes that the model itself gives to words of one class each."""
    import collections
    import math

    texts = ["a b", "b a a", "A", "", None, "a c"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["score"] for r in lm.score_texts(docs, F.lit(False)).collect()}
    tok = [(t or "").lower().split() for t in texts]
    count = collections.Counter(w for t in tok for w in t)
    n = [w for w, _ in sorted(count.items(), key=lambda x: -x[1])]
    best = None
    for mask in range(3 ** len(n)):  # every way of putting the words into classes: one gives all the scores
        of, m = {}, mask
        for w in n:
            of[w], m = m % 3, m // 3
        size, kinds, seen = collections.Counter(), collections.Counter(), collections.Counter()
        for w, c in count.items():
            size[of[w]] += c
            kinds[of[w]] += 1
        for t in tok:
            seq = ["end", *(of[w] for w in t), "end"]
            seen.update(zip(seq, seq[1:], strict=False))
        first, second = collections.Counter(), collections.Counter()
        for (a, b), c in seen.items():
            first[a] += c
            second[b] += c
        m_ = lm.CLASSES + 1
        total = sum(seen.values())

        def score(t):
            seq, out = ["end", *(of[w] for w in t), "end"], 0.0
            for a, b in zip(seq, seq[1:], strict=False):
                share = (second[b] + 1) / (total + m_)
                out += math.log10((seen[a, b] + m_ * share) / (first[a] + m_))
            return out + sum(math.log10((count[w] + 1) / (size[of[w]] + kinds[of[w]] + 1)) for w in t)

        off = max(abs(score(t) - got[i]) for i, t in enumerate(tok))
        best = off if best is None else min(best, off)
    assert best < 1e-9


def test_cover_trees_drop_most_pairs_of_clustered_vectors():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    points = np.concatenate([c + 0.05 * rng.normal(size=(100, 16)) for c in centres])
    unit = vecdup.unit(points)
    tree, tally = vecdup.CoverTree(unit), {}
    linked = np.zeros((2000, 2000), bool)
    for x, y, found in vecdup.links(tree, tree, points, points, 0.9, tally):
        if found is None:
            linked[np.ix_(x, y)] = True
        elif found.ndim == 1:
            linked[x, y] = True
        else:
            linked[np.ix_(x, y)] |= found
    assert (linked == (unit @ unit.T >= 0.9)).all()
    assert tally["centres"] + tally["vectors"] < 0.05 * 2000**2 and tally["dropped"] > 0.5 * tally["centres"]


def test_vectors_of_null_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [1.0, 0.01]), (2, [1.0, 0.0]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(str, (tuple(r) for r in vecdup.pair_links(df).collect())))
    assert len(got) == 5 and "(1, 0, 1, True)" in got and "(2, 2, 1, False)" in got
    top = topk.top_k(df, F.col("vec_id") % 2 == 1, k=2).collect()
    assert {(r["query_id"], r["rank"]) for r in top} <= {(1, 1), (1, 2)} and all(r["vec_id"] == 2 for r in top)
