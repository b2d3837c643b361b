import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldweave.operators import ranking as K, testing as TS


@pytest.fixture(scope="module", autouse=True)
def low_threshold(spark):
    """A bucket takes 100 rows, so that groups are split."""
    spark.conf.set("spark.fieldweave.bucketRows", "100")
    yield
    spark.conf.unset("spark.fieldweave.bucketRows")


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, and one value a third of them; NaN and null values occur."""
    rng = np.random.RandomState(0)
    big = np.round(rng.gamma(1.0, 3.0, 6000), 2)
    big[:2000] = 1.5
    pdf = pd.DataFrame({"g": ["hot"] * 6000 + ["a"] * 40 + ["b"] * 3, "v": np.r_[big, rng.normal(size=40), [1.0, 1.0, 2.0]]})
    pdf["id"] = np.arange(len(pdf))
    pdf.loc[[10, 6005], "v"] = np.nan
    return pdf, spark.createDataFrame(pdf).repartition(6).cache()


def test_average_rank_matches_brute_force(skewed):
    pdf, df = skewed
    got = K.with_average_rank(df, ["g"], "v", "r").toPandas().set_index("id")["r"]
    clean = pdf[pdf["v"].notna()]
    want = clean.groupby("g")["v"].rank(method="average")
    assert len(got) == len(pdf) and np.allclose(got.loc[want.index].to_numpy(), want.to_numpy())
    assert got.loc[[10, 6005]].isna().all()


def test_quantiles_match_numpy(skewed):
    pdf, df = skewed
    probs = {"q0": 0.0, "q1": 0.01, "q5": 0.5, "q9": 0.97, "q10": 1.0}
    got = K.exact_quantiles(df, ["g"], "v", probs).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        for name, q in probs.items():
            assert got.loc[g, name] == pytest.approx(np.nanquantile(part["v"], q))


def test_hot_group_is_spread_over_buckets(skewed):
    _, df = skewed
    r = K.value_ranks(df, ["g"], "v")
    per = r.where("g = 'hot'").groupBy(K.BUCKET).count().toPandas()
    assert r.where("g = 'a'").select(K.BUCKET).distinct().count() == 1
    assert len(per) >= 5 and per["count"].max() < 0.6 * per["count"].sum()


def test_bh_golden(spark):
    df = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, 0.002), (4, None)], "i int, p_value double").withColumn("trait", F.lit("t"))
    got = {r["i"]: r["q_value"] for r in TS.bh_qvalues(df, ["trait"]).collect()}
    assert [got[i] for i in range(4)] == pytest.approx([0.02, 0.04, 0.04, 0.008]) and got[4] is None
    got = {r["i"]: r["q_value"] for r in TS.bh_qvalues_bounded(df, ["trait"], "p_value").collect()}
    assert [got[i] for i in range(4)] == pytest.approx([0.02, 0.04, 0.04, 0.008]) and got[4] is None


def test_bh_random(spark):
    rng = np.random.RandomState(3)
    p = np.round(rng.uniform(size=3000) ** 2, 3) + 1e-6
    df = spark.createDataFrame(pd.DataFrame({"trait": "t", "i": np.arange(3000), "p_value": p}))
    got = TS.bh_qvalues(df, ["trait"]).toPandas().sort_values("i")["q_value"].to_numpy()
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((p[order] * 3000 / np.arange(1, 3001))[::-1])[::-1]
    want = np.empty(3000)
    want[order] = np.minimum(q, 1)
    assert np.allclose(got, want)


def test_expected_quantiles_cut_long_ties(spark):
    df = spark.createDataFrame([("t", 0.5)] * 23 + [("t", 0.1)] * 4, "trait string, p double")
    got = TS.expected_quantiles(df, ["trait"], "p", piece=5).toPandas().sort_values("i")
    assert got["i"].tolist() == list(range(1, 28))
    assert np.allclose(got["observed"], [1.0] * 4 + [-np.log10(0.5)] * 23)
    assert np.allclose(got["expected"], -np.log10((np.arange(1, 28) - 0.5) / 27))


def test_top_k_and_first_per_key(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("a", 2, "z"), ("b", 5, "w")], "k string, o int, v string")
    assert {(r["k"], r["v"]) for r in K.first_per_key(df, ["k"], ["o"]).collect()} == {("a", "y"), ("b", "w")}
    top = K.top_k(df, ["k"], [F.col("o").desc()], 2).collect()
    assert {(r["k"], r["v"], r["rank"]) for r in top} == {("a", "x", 1), ("a", "z", 2), ("b", "w", 1)}


def test_buckets_follow_the_values_of_a_group(spark):
    """The number of buckets grows with a group's own values, whatever its share of the table; ranks stay exact."""
    rng = np.random.RandomState(7)
    sizes = {"a": 99, "b": 101, "c": 950, "d": 5000}
    pdf = pd.concat([pd.DataFrame({"g": g, "v": np.r_[rng.normal(size=n - 3), np.inf, -np.inf, 0.0]}) for g, n in sizes.items()])
    df = spark.createDataFrame(pdf).repartition(7)
    per = K.value_ranks(df, ["g"], "v").groupBy("g", K.BUCKET).agg(F.sum("n").alias("n")).toPandas().groupby("g")["n"].agg(["count", "max"])
    assert per.loc["a", "count"] <= 2 and 6 <= per.loc["c", "count"] <= 14 and 35 <= per.loc["d", "count"] <= 65
    assert (per["max"] <= 300).all()
    got = K.with_average_rank(df, ["g"], "v", "r").toPandas()
    assert np.allclose(got["r"], got.groupby("g")["v"].rank())


def test_ranks_read_their_input_twice(spark, tmp_path):
    """One scan for splitters, one for values and bucket totals; a rank correlation of vectors takes six at most."""
    from fieldweave.operators.correlate import spearman_by_dimension

    rng = np.random.RandomState(1)
    df = spark.createDataFrame([(float(v), [float(x) for x in rng.normal(size=3)]) for v in rng.normal(size=400)], "y double, f array<double>")
    df.write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))

    def scans(out):
        out.write.format("noop").mode("overwrite").save()
        out.collect()
        final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        return final.count("FileScan")

    assert scans(K.value_ranks(table, [], "y")) <= 2
    assert scans(spearman_by_dimension(table.withColumn("s", F.col("y") > 9), ["s"], "f", "y")) <= 6


def test_bh_cutoffs_match_the_rule(spark):
    """Signal, none, all equal, zeros, ties at the cut-off and missing p, against sorting."""
    rng = np.random.RandomState(11)
    groups = {
        "signal": np.r_[rng.uniform(size=900), 10 ** -rng.uniform(2, 12, size=100)], "none": rng.uniform(0.3, 1, size=400), "equal": np.full(50, 0.04), "zeros": np.r_[np.zeros(5), rng.uniform(size=60)],
        "ties": np.round(rng.uniform(size=500) ** 3, 2), "one": np.array([0.05]), "dense": np.sort(rng.uniform(size=2000)) * 0.06,
    }
    rows = [(g, float(v)) for g, p in groups.items() for v in p] + [("signal", None), ("none", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "trait string, p_value double").repartition(5)
    for alpha in (0.05, 0.5, 0.01):
        got = {r["trait"]: r for r in TS.bh_cutoffs(df, ["trait"], alpha=alpha).collect()}
        assert set(got) == set(groups)
        for g, p in groups.items():
            s = np.sort(p)
            ok = np.flatnonzero(s <= alpha * np.arange(1, len(s) + 1) / len(s))
            cut = s[ok[-1]] if len(ok) else None
            assert got[g]["n_tested"] == len(s) and got[g]["cutoff"] == cut and got[g]["n_passing"] == (int((s <= cut).sum()) if len(ok) else 0), (g, alpha)
