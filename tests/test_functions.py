import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.functions import keys as K, scalars as S
from fieldweave.functions.fingerprint import set_fingerprint
from fieldweave.functions.pvalues import chi2_1_upper, correlation_p, normal_two_sided, rank_sum_counts, rank_sum_exact, t_two_sided


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in zip(values, ["string"] * len(values))))
    return df.select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("name", [
    "1201_LeafPhotoA_2025-09-08 10_44_12.793-05_00_3.png", "1201_LeafPhotoA_2025-09-08 10_44_12.793-05_00_leaf.png",
    "a/b/1201_LeafPhotoA_2025-09-08 10_44_12.793-05_00.JPG", "1201_LeafPhotoA_2025-09-08 10_44_12.793",
])
def test_image_key(spark, name):
    assert one(spark, K.image_key(F.col("p")), p=name) == "1201_LeafPhotoA_2025-09-08 10_44_12.793"


def test_coalesced_key_skips_unusable(spark):
    df = spark.createDataFrame([(None, "x/b_1.png"), ("nan", "c.png"), ("a_2.png", "z.png")], "a string, b string")
    assert [r[0] for r in df.select(K.coalesced_key(F.col("a"), F.col("b"))).collect()] == ["b", "c", "a"]


def test_labels(spark):
    df = spark.createDataFrame([("PI 5",), (" bor der ",), (None,), ("nan",), ("Mixed",)], "g string")
    assert [r[0] for r in df.select(K.is_placeholder(F.col("g"))).collect()] == [False, True, True, True, True]
    df = spark.createDataFrame([("PI 5",), ("  ",), (None,), ("mixed",), ("toExclude1",)], "g string")
    assert [r[0] for r in df.select(K.is_ungenotyped(F.col("g"))).collect()] == [False, True, True, True, True]


def test_natural_order(spark):
    df = spark.createDataFrame([("IC10",), ("IC2",), ("IC0",), ("PC1",)], "t string")
    assert [r[0] for r in df.orderBy(*K.natural_order(F.col("t"))).collect()] == ["IC0", "IC2", "IC10", "PC1"]


def test_dosage_codes(spark):
    calls = ["0/0", "0|1", "1/0", "1|1:30", "./.", "0/2"]
    df = spark.createDataFrame([(c,) for c in calls], "g string")
    assert [r[0] for r in df.select(S.dosage(F.col("g"))).collect()] == [0, 1, 1, 2, None, None]


def test_logits(spark):
    df = spark.createDataFrame([(0.0,), (25.0,), (100.0,)], "p double")
    got = [r[0] for r in df.select(S.percent_logit(F.col("p"))).collect()]
    assert got[0] is None and got[2] is None and got[1] == pytest.approx(math.log(1 / 3))
    got = [r[0] for r in df.select(S.clipped_logit(F.col("p") / 100)).collect()]
    assert got[0] == pytest.approx(math.log(5e-5 / (1 - 5e-5))) and got[2] == pytest.approx(-got[0])


def test_to_number_is_lenient(spark):
    df = spark.createDataFrame([("1.5",), (" 2 ",), ("n/a",), ("NaN",), ("inf",)], "v string")
    assert [r[0] for r in df.select(S.to_number(F.col("v"))).collect()] == [1.5, 2.0, None, None, None]


def test_tail_probabilities():
    # known quantiles: t(10) 97.5 % = 2.228139, chi2(1) 95 % = 3.841459, z 97.5 % = 1.959964
    assert t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert chi2_1_upper(3.841458820694124) == pytest.approx(0.05, abs=1e-12)
    assert normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert t_two_sided(1.0, 1) == pytest.approx(0.5)  # Cauchy


def test_tails_keep_relative_accuracy_far_out():
    """Closed forms for 1, 2, 3 and 4 degrees of freedom, the normal limit for very many, monotone between."""
    t = np.array([1e-6, 0.3, 0.99, 1.01, 3.0, 40.0, 1e4, 1e7])
    assert t_two_sided(t, 1) == pytest.approx(2 / np.pi * np.arctan(1 / t), rel=1e-12)
    x = t * t / 2
    assert t_two_sided(t, 2) == pytest.approx(1 / (np.sqrt(1 + x) * (np.sqrt(1 + x) + np.sqrt(x))), rel=1e-12)
    near = t[:5]
    angle = near / np.sqrt(3)
    assert t_two_sided(near, 3) == pytest.approx(1 - 2 / np.pi * (angle / (1 + angle**2) + np.arctan(angle)), rel=1e-9)
    s = near / np.sqrt(4 + near**2)
    assert t_two_sided(near, 4) == pytest.approx(1 - s * (1 + (1 - s * s) / 2), rel=1e-10)
    import math

    z = np.array([0.0, 0.2, 1.0, 5.0, 12.0, 30.0])
    normal = np.array([math.erfc(v / math.sqrt(2)) for v in z])
    assert normal_two_sided(z) == pytest.approx(normal, rel=1e-12) and t_two_sided(z[:4], 1e12) == pytest.approx(normal[:4], rel=1e-9)
    for v in (0.5, 3.0, 8.0):  # first-order expansion in 1 / df about the normal tail
        density = math.exp(-v * v / 2) / math.sqrt(2 * math.pi)
        want = math.erfc(v / math.sqrt(2)) + density * (v**3 + v) / (2 * 1e9)
        assert t_two_sided(v, 1e9) == pytest.approx(want, rel=1e-9)
    assert (np.diff(t_two_sided(4.0, np.array([3.0, 5, 10, 31, 33, 100, 1e4, 1e8, 1e12]))) < 0).all()
    assert np.isnan(t_two_sided(1.0, 0)) and t_two_sided(np.inf, 5) == 0 and np.isnan(t_two_sided(np.nan, 5))


def test_rank_sum_counts_match_enumeration():
    import itertools

    for m, n in ((1, 1), (1, 6), (3, 4), (5, 5), (4, 6), (2, 8)):
        n_orders = np.zeros(m * n + 1)
        for c in itertools.combinations(range(m + n), m):
            n_orders[sum(c) - m * (m - 1) // 2] += 1
        assert np.allclose(rank_sum_counts(m, n), n_orders / n_orders.sum())
        for u in range(m * n + 1):
            low, high = n_orders[: u + 1].sum(), n_orders[u:].sum()
            assert rank_sum_exact(u, n, m) == pytest.approx(min(1, 2 * min(low, high) / n_orders.sum()))
    assert 0 < rank_sum_exact(0, 49, 49) < 1e-27


def test_rank_sum_says_when_it_is_exact(spark):
    from fieldweave.operators.correlate import rank_sum

    rows = [("small", g, float(v)) for g, v in zip("aabbbab", (1, 2, 3, 5, 4, 9, 7))] + [("tied", g, float(v)) for g, v in zip("aabbb", (1, 2, 2, 5, 4))]
    rows += [("large", "ab"[i % 2], float(i * 37 % 101)) for i in range(100)]
    got = {r["k"]: r for r in rank_sum(spark.createDataFrame(rows, "k string, g string, v double"), ["k"], "g", "v", "a", "b").collect()}
    assert (got["small"]["exact"], got["tied"]["exact"], got["large"]["exact"]) == (True, False, False)
    assert got["small"]["p_value"] == pytest.approx(rank_sum_exact(got["small"]["u"], 3, 4)) and 0 < got["tied"]["p_value"] <= 1


def test_correlation_p_edges(spark):
    df = spark.createDataFrame([(0.5, 20), (1.0, 5), (0.3, 2)], "r double, n int")
    p = [r[0] for r in df.select(correlation_p(F.col("r"), F.col("n"))).collect()]
    assert p[0] == pytest.approx(0.0247, abs=1e-3) and p[1] == 0.0 and p[2] is None


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([("x",), ("y",), ("z",)], "s string")
    b = spark.createDataFrame([("z",), ("x",), ("y",)], "s string").repartition(3)
    c = spark.createDataFrame([("z",), ("x",), ("w",)], "s string")
    get = lambda d: d.agg(set_fingerprint(F.col("s"))).first()[0]
    assert get(a) == get(b) != get(c)
