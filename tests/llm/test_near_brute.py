"""Near-duplicate classes against all pairs compared exactly, with groups of near copies below and above the bound."""

import collections
import random

import numpy as np

from fieldweave.llm import probminhash as P
from fieldweave.llm.shingles import shingles


def plain_jp(a: collections.Counter, b: collections.Counter) -> float:
    """Probability Jaccard by its definition."""
    if not a or not b:
        return float(a == b)
    x, y = ({k: 1 + np.log(n) for k, n in c.items()} for c in (a, b))
    every = set(x) | set(y)
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in every) for d in set(x) & set(y))


def counted(text):
    words = (text or "").lower().split()
    n = min(5, len(words))
    return collections.Counter(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) if words else collections.Counter()


def corpus():
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(400)]
    base = [rng.choices(pool, k=rng.randrange(30, 80)) for _ in range(6)]
    texts = [None, "", "short text", "Short  TEXT"]
    for b, edits in zip(base, (0, 1, 2, 3, 4, 9)):
        for _ in range(22):
            words = list(b)
            for _ in range(rng.randrange(0, edits + 1)):
                words[rng.randrange(len(words))] = rng.choice(pool)
            texts.append(" ".join(words))
    return list(enumerate(texts)) + [(40, texts[40]), (None, texts[41])]


def test_probability_jaccard_by_definition():
    rows = [t for _, t in corpus()]
    for a, b in zip(rows[4:60:3], rows[5:61:3]):
        own = []
        for t in (a, b):
            h, n = shingles(t, 5)
            own.append((h, P.WEIGHTS["log"](n)))
        assert abs(P.probability_jaccard(*own) - plain_jp(counted(a), counted(b))) < 1e-9


def test_signature_agreement_estimates_similarity():
    rows = [t for _, t in corpus()]
    for a, b in zip(rows[50:130:8], rows[51:131:8]):
        own = []
        for t in (a, b):
            h, n = shingles(t, 5)
            own.append((h, P.WEIGHTS["log"](n)))
        s = P.signature(own, 4000)
        assert abs((s[0] == s[1]).mean() - P.probability_jaccard(*own)) < 0.04


def test_classes_equal_all_pairs(spark, monkeypatch):
    rows = corpus()
    grams = {i: counted(t) for i, t in rows if i is not None}
    ids = sorted(grams)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = below = 0
    for i in ids:
        for j in ids:
            if i < j:
                s = plain_jp(grams[i], grams[j])
                below += 0.6 <= s < 0.8
                if s >= 0.8:
                    links += 1
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    assert links > 100 and below > 100
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, band string").repartition(4)
    for members in (512, 8):
        monkeypatch.setattr(P, "MEMBERS", members)
        got = [(r["doc_id"], r["class_id"], r["kept"]) for r in P.near_duplicates(table).collect()]
        assert sorted(got, key=str) == sorted([(i, None if i is None else find(i), i is None or find(i) == i) for i, _ in rows], key=str)
