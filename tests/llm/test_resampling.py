"""Importance resampling: the radix sort against sorting, the scores against a plain loop."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from fieldweave.llm import radix, resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def small_letters(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def brute(rows, target, longest, buckets, percent, least, seed=2024):
    def grams(text):
        words = WORD.findall(small_letters(text or ""))
        return words, [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (collections.Counter(bucket(f) for text in side for f in grams(text)[1]) for side in ([r[1] for r in rows], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for i, text in rows:
        words, own = grams(text)
        weight = math.floor(sum(gain(bucket(f)) for f in own) / len(own)) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= least and r[0] is not None), key=lambda r: (-r[4], r[0]))
    ranked = [(*r, k + 1 if k < percent * len(fit) // 100 else None) for k, r in enumerate(fit)]
    return ranked + [(*r, None) for r in out if r[1] < least or r[0] is None]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    pool = ["Apple", "pear", "Éclair", "日本", "x1", "under_score", "İzmir", "the", "nul\x00l", "dash-ed"]
    out = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    return out + [(400, None), (401, ""), (402, "the " * 50_000), (7, out[7][1]), (7, out[7][1]), (None, "the pear " * 20), (-5, "apple " * 30), (1 << 40, "x1 " * 30)]


@pytest.mark.parametrize("longest, buckets, percent, least", [(1, 10_000, 10, 20), (2, 64, 55, 5), (3, 7, 100, 0)])
def test_ranks_brute(spark, rows, longest, buckets, percent, least):
    target = [(1, "apple pear éclair the"), (2, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "x", 2) for i, t in rows], "doc_id long, text string, score string, n int").repartition(4)
    other = spark.createDataFrame(target, "item_id long, text string")
    got = resampling.importance_ranks(docs, other, longest=longest, buckets=buckets, percent=percent, min_words=least, bits=11, block=32)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows, [t for _, t in target], longest, buckets, percent, least), key=key)


def test_radix_sort(spark):
    rng = random.Random(9)
    for values in ([], [(3, 3)] * 100, [(rng.randrange(-9, 9), rng.randrange(1 << 40)) for _ in range(700)] + [(-(1 << 62), 1), (1 << 62, 2), (0, -4)]):
        table = spark.createDataFrame(values, "a long, b long").repartition(5)
        got = radix.radix_ranks(table, [("a", True), ("b", False)], bits=13, block=16).collect()
        assert sorted(r["rank"] for r in got) == list(range(1, len(values) + 1))
        assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["rank"])] == sorted(values, key=lambda v: (-v[0], v[1]))
    with pytest.raises(ValueError):
        radix.radix_ranks(spark.range(3).selectExpr("id", "string(id) AS x"), [("id", False)])


def test_radix_sort_is_stable(spark):
    table = spark.createDataFrame([(i % 3, i) for i in range(500)], "a long, i long").coalesce(1)
    got = sorted(radix.radix_ranks(table, [("a", False)], bits=1, block=8).collect(), key=lambda r: r["rank"])
    assert [r["i"] for r in got] == [i for a in range(3) for i in range(500) if i % 3 == a]


def test_drawn_documents_and_empty_tables(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows if i is not None and i != 7], "doc_id long, text string, rank string")
    target = docs.select("text").limit(5)
    ranks = resampling.importance_ranks(docs, target)
    drawn = resampling.draw_documents(docs, target)
    assert drawn.columns == docs.columns and {r["doc_id"] for r in drawn.collect()} == {r["doc_id"] for r in ranks.collect() if r["rank"]}
    assert resampling.importance_ranks(docs.limit(0), target).count() == 0
    assert resampling.importance_ranks(docs, target.limit(0)).count() == docs.count()
