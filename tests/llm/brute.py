"""Language identification, toxicity and near duplicates once more in plain Python, with dictionaries and loops, for small tables."""

import collections
import math

import numpy as np

from covary.llm import langid, toxicity


def letter_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c.isalpha():
            word += c.lower() if len(c.lower()) == 1 else c
        elif word:
            out.append(word)
            word = ""
    return out


def grams(word, n):
    edged = f"\0{word}\0"
    return [edged[i : i + n] for i in range(len(edged) - n + 1)]


def languages(train, texts):
    """(language, score) of each text; train: (text, lang)."""
    names = sorted({lang for text, lang in train if lang is not None and text is not None})
    seen = [collections.defaultdict(lambda: [0] * len(names)) for _ in range(langid.LONGEST + 1)]
    for text, lang in train:
        if lang is None or text is None:
            continue
        k = names.index(lang)
        for word, times in collections.Counter(letter_words(text)).items():
            seen[0][word][k] += times
            for n in range(1, langid.LONGEST + 1):
                for gram in grams(word, n):
                    seen[n][gram][k] += times
    scores = []
    for table in seen:
        table = {g: c for g, c in table.items() if sum(c) >= langid.TWICE}
        total = [sum(c[k] + 0.5 for c in table.values()) for k in range(len(names))]
        scores.append({g: [math.log((c[k] + 0.5) / total[k]) for k in range(len(names))] for g, c in table.items()})

    def evidence(word):
        if word in scores[0]:
            return scores[0][word]
        for n in range(langid.LONGEST, 0, -1):
            known = [scores[n][g] for g in grams(word, n) if g in scores[n]]
            if known:
                return [sum(x[k] for x in known) / len(known) for k in range(len(names))]
        return [0.0] * len(names)

    out = []
    for text in texts:
        words = letter_words(text)
        if not words or not names:
            out.append((langid.UNKNOWN, 0.0))
            continue
        total = [0.0] * len(names)
        for word, times in collections.Counter(words).items():
            total = [a + times * b for a, b in zip(total, evidence(word), strict=True)]
        best = max(total)
        out.append((names[total.index(best)], 1 / sum(math.exp(x - best) for x in total)))
    return out


def character_model(texts):
    size = len(toxicity.ALPHABET) + 2
    count = np.zeros((size, size, size))
    for text in texts:
        letters = [0]
        for c in text or "":
            low = c.lower() if len(c.lower()) == 1 else c
            letters.append(0 if not c.isalpha() else toxicity.ALPHABET.index(low) + 1 if low in toxicity.ALPHABET else size - 1)
        letters += [0, 0]
        for x in zip(letters, letters[1:], letters[2:], strict=False):
            count[x] += 1
    count[0, 0] = 0
    pair = count.sum(0) + 0.1
    pair /= pair.sum(1, keepdims=True)
    return np.log((count + 5 * pair[None]) / (count.sum(2, keepdims=True) + 5))


def features(words):
    return {(0, w) for w in words} | {(k, w[:k]) for k in toxicity.BEGINNINGS for w in words if len(w) > k}


def toxic_scores(texts, lexicon, rest):
    """A score for each text; lexicon and rest: (text, toxic) of the two parts of the labelled documents."""
    model = character_model(texts).astype(np.float32)
    read = toxicity.reader(model)

    def words(text):
        return letter_words(" ".join([text or "", *toxicity.restored_words(text or "", read)]))

    counts = collections.defaultdict(lambda: [0, 0])
    for text, toxic in lexicon:
        for x in features(words(text)):
            counts[x][toxic] += 1
    of = collections.Counter(toxic for _, toxic in lexicon)
    weights = {x: math.log((a + 0.5) / (of[1] + 1)) - math.log((b + 0.5) / (of[0] + 1)) for x, (b, a) in counts.items() if a >= toxicity.LEAST}
    weights = {x: w for x, w in weights.items() if w > toxicity.LIKELIER}

    def measure(text):
        own = [max((weights.get(x, 0.0) for x in features([w])), default=0.0) for w in words(text)]
        return [max(own, default=0.0), math.log1p(sum(w > toxicity.STRONG for w in own)), sum(own) / max(1, len(own))]

    x, y = np.array([[1.0, *measure(t)] for t, _ in rest]), np.array([float(z) for _, z in rest])
    b = np.zeros(4)
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ b))
        b += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(4), x.T @ (y - p) - 1e-2 * b)
    return [1 / (1 + math.exp(-float(np.array([1.0, *measure(t)]) @ b))) for t in texts]


def shingles(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\v\f\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_groups(rows, share):
    """id -> smallest id reachable; rows: (id, text)."""
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    both = collections.Counter((a, b) for ids in holders.values() for x, a in enumerate(ids) for b in ids[:x])
    for (a, b), n in both.items():
        if 100 * n >= share * (len(sets[a]) + len(sets[b]) - n) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = {i: low if x == high else x for i, x in label.items()}
    return label
