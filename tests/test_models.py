import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldweave.operators import association as A, kinship as K, mixed_models as B, mixed_scan as M


def test_blue_uses_plot_means(spark):
    rows = [("E", "G1", 1, 10.0)] * 10 + [("E", "G1", 2, 0.0), ("E", "G2", 3, 0.0), ("E", "G2", 4, 0.0)]
    df = spark.createDataFrame(rows, "environment string, genotype string, plot int, IC0 double")
    plots, cov = B.model_plots(df, ["IC0"], ["environment", "genotype", "plot"], winsor=0.0)
    got = {r["genotype"]: r["blue"] for r in B.fit_blues(plots, ["IC0"], covariates=cov).collect()}
    assert got == pytest.approx({"G1": 5.0, "G2": 0.0})


@pytest.fixture(scope="module")
def field(spark):
    rng = np.random.RandomState(0)
    n = 240
    pdf = pd.DataFrame({"genotype": [f"g{i}" for i in rng.randint(0, 40, n)], "row": rng.randint(0, 8, n), "col": rng.randint(0, 6, n), "x": rng.normal(size=n)})
    ge, re_, ce = rng.normal(0, 1.5, 40), rng.normal(0, 1.0, 8), rng.normal(0, 0.5, 6)
    pdf["y"] = ge[[int(g[1:]) for g in pdf["genotype"]]] + re_[pdf["row"]] + ce[pdf["col"]] + 0.7 * pdf["x"] + rng.normal(size=n)
    pdf["y2"] = rng.normal(size=n) + re_[pdf["row"]]
    return pdf, spark.createDataFrame(pdf).repartition(5).cache()


def dense_reml(y, x, zs, ratios):
    """REML deviance by the textbook formula with the full covariance matrix."""
    n = len(y)
    v = np.eye(n) + sum(t * z @ z.T for t, z in zip(ratios, zs))
    vi = np.linalg.inv(v)
    xvx = x.T @ vi @ x
    b = np.linalg.pinv(xvx) @ x.T @ vi @ y
    e = y - x @ b
    nu = n - np.linalg.matrix_rank(x)
    val = np.linalg.eigvalsh(xvx)
    return nu * np.log(e @ vi @ e) + np.linalg.slogdet(v)[1] + np.log(val[val > 1e-9]).sum(), e @ vi @ e / nu, b


def simplex_minimum(fn, start, step=0.5, limit=4000):
    """Nelder-Mead, to have an optimum that the library did not find."""
    k = len(start)
    pts = [start.astype(float)] + [start + step * np.eye(k)[i] for i in range(k)]
    val = [fn(p) for p in pts]
    for _ in range(limit):
        order = np.argsort(val)
        pts, val = [pts[i] for i in order], [val[i] for i in order]
        if max(np.abs(p - pts[0]).max() for p in pts) < 1e-7:
            break
        mid = np.mean(pts[:-1], axis=0)
        tries = [mid + c * (mid - pts[-1]) for c in (1.0, 2.0, 0.5, -0.5)]
        got = [fn(p) for p in tries]
        best = int(np.argmin(got))
        if got[best] < val[-1]:
            pts[-1], val[-1] = tries[best], got[best]
        else:
            pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
            val = [val[0]] + [fn(p) for p in pts[1:]]
    at = int(np.argmin(val))
    return pts[at], val[at]


def onehot(s):
    return pd.get_dummies(s).to_numpy(float)


def test_variance_components_reach_the_dense_optimum(field):
    pdf, df = field
    got = B.variance_components(df, ["y", "y2"], covariates=["x"], factors=["row", "col"]).toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf["x"]])
    zs = [onehot(pdf[c]) for c in ("genotype", "row", "col")]
    for trait in ("y", "y2"):
        v = got[got["trait"] == trait].set_index("source")["vcov"]
        ratios = np.array([v["genotype"], v["row"], v["col"]]) / v["Residual"]
        dev, sig, _ = dense_reml(pdf[trait].to_numpy(), x, zs, ratios)
        assert sig == pytest.approx(v["Residual"], rel=1e-4)
        for i in range(3):
            for f in (0.9, 1.1):
                near = ratios.copy()
                near[i] = near[i] * f + (0.01 if ratios[i] == 0 else 0)
                assert dense_reml(pdf[trait].to_numpy(), x, zs, near)[0] >= dev - 1e-6


def test_blues_match_dense_mixed_model(field):
    pdf, df = field
    got = B.fit_blues(df, ["y"], covariates=["x"], factors=["row", "col"]).toPandas().set_index("genotype")["blue"]
    names = sorted(pdf["genotype"].unique())
    x = np.column_stack([onehot(pdf["genotype"]), pdf["x"]])
    zs = [onehot(pdf["row"]), onehot(pdf["col"])]
    best = simplex_minimum(lambda z: dense_reml(pdf["y"].to_numpy(), x, zs, z * z)[0], np.array([0.7, 0.7]))[0]
    _, _, b = dense_reml(pdf["y"].to_numpy(), x, zs, best**2)
    want = b[:-1] + b[-1] * pdf["x"].mean()
    assert np.allclose(got.loc[names].to_numpy(), want, atol=1e-3)


def test_balanced_anova_closed_form(spark):
    rng = np.random.RandomState(3)
    y = rng.normal(size=(30, 4)) + rng.normal(0, 1.2, size=(30, 1))
    df = spark.createDataFrame([(f"g{i}", float(v)) for i, row in enumerate(y) for v in row], "genotype string, y double")
    got = {r["source"]: r["vcov"] for r in B.variance_components(df, ["y"]).collect()}
    mse = ((y - y.mean(1, keepdims=True)) ** 2).sum() / 90
    msg = 4 * ((y.mean(1) - y.mean()) ** 2).sum() / 29
    assert got["Residual"] == pytest.approx(mse, rel=1e-6) and got["genotype"] == pytest.approx((msg - mse) / 4, rel=1e-5)
    h = B.line_mean_h2(B.variance_components(df, ["y"]), df).first()
    assert h["h2"] == pytest.approx(1 - mse / msg, rel=1e-3) and h["hr"] == 4.0


def test_variance_components_across_environments(spark):
    rng = np.random.RandomState(4)
    rows = []
    for g in range(60):
        a = rng.normal(0, 1.5)
        for e in range(3):
            b = rng.normal(0, 1.0)
            rows += [(f"g{g}", f"e{e}", float(a + b + e + rng.normal())) for _ in range(rng.randint(1, 4))]
    pdf = pd.DataFrame(rows, columns=["genotype", "environment", "y"])
    vc = B.variance_components_across(spark.createDataFrame(pdf), ["y"]).toPandas()
    assert vc["converged"].all()
    vc = vc.set_index("source")["vcov"]
    x = np.ones((len(pdf), 1))
    zs = [onehot(pdf["genotype"]), onehot(pdf["genotype"] + pdf["environment"]), onehot(pdf["environment"])]
    ratios = vc.loc[["genotype", "genotype_x_environment", "environment"]].to_numpy() / vc["Residual"]
    dev, _, _ = dense_reml(pdf["y"].to_numpy(), x, zs, ratios)
    best = simplex_minimum(lambda z: dense_reml(pdf["y"].to_numpy(), x, zs, z * z)[0], np.sqrt(ratios) + 0.05)[1]
    assert dev == pytest.approx(best, abs=1e-5)


def test_every_environment_is_a_model_of_its_own(spark):
    """Levels, covariates and flags of one environment do not touch another; a failed trait gives one error row."""
    rng = np.random.RandomState(6)
    rows = []
    for e, (n, rows_in) in enumerate([(200, 7), (150, 1), (90, 4)]):
        g, r, x = rng.randint(0, 25, n), rng.randint(0, rows_in, n), rng.normal(size=n)
        y = rng.normal(0, 1.3, 25)[g] + rng.normal(0, 0.9, rows_in)[r] + 0.5 * x + rng.normal(size=n)
        rows += [(f"e{e}", f"g{i}", f"e{e}_{j}", float(v), float(w), 1.0 if e == 1 else float(w), float(rng.normal())) for i, j, v, w in zip(g, r, x, y)]
    pdf = pd.DataFrame(rows, columns=["environment", "genotype", "row", "x", "y", "flat", "noise"])
    df = spark.createDataFrame(pdf).repartition(4)
    traits = ["y", "flat", "noise"]
    vc = B.variance_components(df, traits, covariates=["x"], factors=["row"], env="environment").toPandas()
    blues = B.fit_blues(df, traits, covariates=["x"], factors=["row"], env="environment").toPandas()
    assert set(vc[vc["error"].notna()][["environment", "trait"]].itertuples(index=False, name=None)) == {("e1", "flat")}
    assert blues[blues["blue"].isna()].groupby(["environment", "trait"]).size().index.tolist() == [("e1", "flat")]
    for e, part in df.toPandas().groupby("environment"):
        alone = spark.createDataFrame(part)
        own = B.variance_components(alone, ["y", "noise"], covariates=["x"], factors=["row"]).toPandas().set_index(["trait", "source"])["vcov"]
        got = vc[(vc["environment"] == e) & (vc["trait"] != "flat")].set_index(["trait", "source"])["vcov"]
        assert got.index.sort_values().tolist() == own.index.sort_values().tolist() and np.allclose(got.loc[own.index], own, rtol=1e-6, atol=1e-9)
        x = np.column_stack([np.ones(len(part)), part["x"]])
        zs = [onehot(part["genotype"])] + ([onehot(part["row"])] if part["row"].nunique() > 1 else [])
        for trait in ("y", "noise"):
            v = got[trait]
            ratios = np.array([v["genotype"], *([v["row"]] if "row" in v else [])]) / v["Residual"]
            dev, sig, _ = dense_reml(part[trait].to_numpy(), x, zs, ratios)
            best = simplex_minimum(lambda z: dense_reml(part[trait].to_numpy(), x, zs, z * z)[0], np.full(len(zs), 0.6))[1]
            assert sig == pytest.approx(v["Residual"], rel=1e-6) and dev == pytest.approx(best, abs=1e-5)
    assert vc[vc["trait"] != "flat"]["converged"].all()
    noise = vc[(vc["trait"] == "noise") & (vc["source"] == "genotype")]
    assert all(noise[noise["vcov"] < 1e-9]["singular"])


def test_redundant_columns_and_unequal_cells_across(spark):
    """Covariates that depend on each other, unbalanced genotype x environment cells, against the dense model."""
    rng = np.random.RandomState(8)
    rows = [(f"g{g}", f"e{e}", float(x), float(2 * x), float(a + b + 0.3 * x + rng.normal()))
            for g in range(40) for a in [rng.normal(0, 1.2)] for e in range(1 + g % 3) for b in [rng.normal(0, 0.8)] for x in rng.normal(size=1 + (g * 7 + e) % 4)]
    pdf = pd.DataFrame(rows, columns=["genotype", "environment", "x", "twice", "y"])
    vc = B.variance_components_across(spark.createDataFrame(pdf), ["y"], covariates=["x", "twice"]).toPandas().set_index("source")
    assert vc["converged"].all() and vc["n_plots"].iloc[0] == len(pdf) and vc["n_genotypes"].iloc[0] == 40
    x = np.column_stack([np.ones(len(pdf)), pdf["x"]])
    zs = [onehot(pdf["genotype"]), onehot(pdf["genotype"] + pdf["environment"]), onehot(pdf["environment"])]
    ratios = vc["vcov"].loc[["genotype", "genotype_x_environment", "environment"]].to_numpy() / vc["vcov"]["Residual"]
    best = simplex_minimum(lambda z: dense_reml(pdf["y"].to_numpy(), x, zs, z * z)[0], np.sqrt(ratios) + 0.05)[1]
    assert dense_reml(pdf["y"].to_numpy(), x, zs, ratios)[0] == pytest.approx(best, abs=1e-5)


# ---------------------------------------------------------------- kinship and scans
@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.RandomState(5)
    n, m = 60, 90
    base = rng.binomial(2, 0.3, size=(6, m))
    g = np.clip(base[rng.randint(0, 6, n)] + rng.binomial(1, 0.15, size=(n, m)) - rng.binomial(1, 0.15, size=(n, m)), 0, 2).astype(float)
    samples = [f"s{i:02d}" for i in range(n)]
    long = [(f"m{j}", j % 3 + 1, j * 1000, samples[i], int(g[i, j])) for i in range(n) for j in range(m) if not (i == 3 and j == 5)]
    df = spark.createDataFrame(long, "marker string, chrom int, pos long, sample string, dosage int")
    g[3, 5] = np.delete(g[:, 5], 3).mean()
    return samples, g, K.marker_vectors(df, K.sample_list(df)).cache(), df


def vanraden(g):
    p = g.mean(0) / 2
    z = g - 2 * p
    return z @ z.T / (2 * p * (1 - p)).sum()


def test_kinship_and_subsets(panel):
    _, g, v, _ = panel
    products = K.raw_products(v)
    assert np.allclose(K.kinship_from_products(sum(products.values())), vanraden(g))
    keep = np.arange(0, 60, 2)
    chrom = np.arange(90) % 3 + 1
    assert np.allclose(K.kinship_from_products(K.loco_products(products)["2"], keep), vanraden(g[keep][:, chrom != 2]))


def dense_lrt(y, w, x, k):
    d, u = np.linalg.eigh(k)
    d = np.clip(d, 0, None)
    best = []
    for design in (w, np.column_stack([w, x])):
        top, arg = -np.inf, None
        for lam in np.exp(np.linspace(np.log(1e-5), np.log(1e5), 4001)):
            s = 1 / (1 + lam * d)
            a, b = u.T @ design, u.T @ y
            beta = np.linalg.solve(a.T * s @ a, a.T * s @ b)
            rss = (s * (b - a @ beta) ** 2).sum()
            ll = -0.5 * len(y) * np.log(rss / len(y)) - 0.5 * np.log1p(lam * d).sum()
            if ll > top:
                top, arg = ll, beta
        best.append((top, arg))
    return 2 * (best[1][0] - best[0][0]), best[1][1][-1]


def test_mixed_scan_matches_dense_search(panel):
    samples, g, v, _ = panel
    rng = np.random.RandomState(6)
    y = (0.8 * g[:, 7] + vanraden(g) @ rng.normal(size=60) + rng.normal(size=60))[:, None]
    loco = K.loco_products(K.raw_products(v))
    w = M.design(60, covariates=rng.normal(size=(60, 1)))
    got = M.scan(v, y, ["t"], w, loco=loco).toPandas().set_index("marker")
    assert len(got) == 90
    chrom = np.arange(90) % 3 + 1
    for j in (5, 7, 20, 43):
        lrt, beta = dense_lrt(y[:, 0], w, g[:, j], vanraden(g[:, chrom != chrom[j]]))
        assert got.loc[f"m{j}", "effect"] == pytest.approx(beta, rel=5e-3, abs=1e-3)
        assert -np.log10(got.loc[f"m{j}", "p_value"]) == pytest.approx(-np.log10(M.chi2_1_upper(lrt)), rel=2e-3, abs=1e-3)
    few = M.scan(v, y, ["t"], w, loco=loco, p_max=0.05).toPandas()
    assert set(few["marker"]) == set(got.index[got["p_value"] <= 0.05])


def test_identity_kinship_is_least_squares(panel):
    _, g, v, _ = panel
    rng = np.random.RandomState(7)
    y = rng.normal(size=(60, 1))
    plain = M.scan(v, y, ["t"], M.design(60)).toPandas().set_index("marker")
    x = np.column_stack([np.ones(60), g[:, 7]])
    b, rss, *_ = np.linalg.lstsq(x, y[:, 0], rcond=None)
    assert plain.loc["m7", "effect"] == pytest.approx(b[1])
    rss0 = ((y - y.mean()) ** 2).sum()
    assert plain.loc["m7", "p_value"] == pytest.approx(M.chi2_1_upper(60 * np.log(rss0 / rss[0])))


def test_one_marker_over_strata(panel, spark):
    """Each stratum against the dense model of its own samples: components of all markers, kinship of the other
    chromosomes; rules count the samples that are tested; sets are factorised apart from one another."""
    samples, g, v, df = panel
    rng = np.random.RandomState(8)
    rows = [(t, s, float(rng.normal()), None if t == "gap" and i < 15 else float(rng.normal())) for t in ("a", "a2", "b", "few", "gap") for i, s in enumerate(samples) if not (t == "b" and i % 3 == 0) and not (t == "few" and i > 10)]
    cells = spark.createDataFrame(rows, "trait string, sample string, y double, o double").join(df.where("marker = 'm7'").select("sample", "dosage"), "sample")
    products = K.raw_products(v)
    every, others = sum(products.values()), K.loco_products(products)["2"]
    chrom = np.arange(90) % 3 + 1
    for covariates, expected in (([], 60), (["o"], 45)):
        got = M.one_marker_tests(cells, ["trait"], samples, every, others, n_pcs=2, min_homozygotes=1, covariates=covariates, strata_per_task=1).toPandas().set_index("trait")
        assert got.loc["few", "status"] == "skipped" and got.loc["few", "skip_reason"] == "n_observations < 30"
        assert got.loc["gap", "n_observations"] == expected
        for name in ("a", "a2", "b", "gap"):
            own = [(samples.index(s), y, o) for t, s, y, o in rows if t == name and not (covariates and o is None)]
            keep, y = np.array([r[0] for r in own]), np.array([r[1] for r in own])
            k, full = vanraden(g[keep][:, chrom != 2]), vanraden(g[keep])
            lrt, beta = dense_lrt(y, M.design(len(y), K.components_of(full, 2), np.array([[r[2]] for r in own]) if covariates else None), g[keep, 7], k)
            assert got.loc[name, "status"] == "tested" and got.loc[name, "effect"] == pytest.approx(beta, rel=5e-3, abs=1e-3)
            assert got.loc[name, "p_value"] == pytest.approx(M.chi2_1_upper(lrt), rel=1e-2)
    plain = M.one_marker_tests(cells, ["trait"], samples, None, None, n_pcs=0, min_homozygotes=1).toPandas().set_index("trait")
    y = np.array([r[2] for r in rows if r[0] == "a"])
    b = np.linalg.lstsq(np.column_stack([np.ones(60), g[:, 7]]), y, rcond=None)[0]
    assert plain.loc["a", "effect"] == pytest.approx(b[1])


def test_array_products_match_pairwise_complete_loops(panel, spark):
    """Masked matrix products against numpy on the complete pairs, with missing calls and phenotypes."""
    samples, g, v, df = panel
    rng = np.random.RandomState(12)
    y = rng.normal(1e6, 3.0, size=(60, 3))
    y[rng.random(y.shape) < 0.2] = np.nan
    got = A.marker_trait_effects(v, y, ["t0", "t1", "t2"]).toPandas().set_index(["trait", "marker"])
    assert len(got) == 270
    raw = g.copy()
    raw[3, 5] = np.nan
    for j in (0, 5, 41):
        for t in range(3):
            ok = np.isfinite(raw[:, j]) & np.isfinite(y[:, t])
            x, z = np.column_stack([np.ones(ok.sum()), raw[ok, j]]), y[ok, t]
            b, rss, *_ = np.linalg.lstsq(x, z - z.mean(), rcond=None)
            row = got.loc[(f"t{t}", f"m{j}")]
            se = np.sqrt(rss[0] / (ok.sum() - 2) * np.linalg.inv(x.T @ x)[1, 1])
            assert row["n"] == ok.sum() and (row["effect"], row["se"]) == pytest.approx((b[1], se), rel=1e-6) and row["r2"] == pytest.approx(np.corrcoef(raw[ok, j], z)[0, 1] ** 2)
    for impute in (True, False):
        want = A.linkage(df, "m5", min_calls=50, impute=impute).toPandas().set_index("marker")
        have = A.linkage_vectors(v, "m5", min_calls=50, impute=impute).toPandas().set_index("marker")
        assert have.loc[want.index, "n_calls"].tolist() == want["n_calls"].tolist() and np.allclose(have.loc[want.index, "r2"], want["r2"])
    with pytest.raises(ValueError, match="unknown"):
        A.linkage_vectors(v, "none")


def test_find_marker_labels(spark):
    m = spark.createDataFrame([("a", "1", 5, "A", "G"), ("b", "1", 5, "A", "T"), ("c", "scaf_7", 9, "C", "T"), ("1:5", "2", 1, "A", "C")], "marker string, chrom string, pos long, ref string, alt string")
    found = lambda label: A.find_marker(m, label).first()["marker"]
    assert [found(x) for x in ("a", "1:5:A:T", "1_5_A_G", "scaf_7:9", "scaf_7_9_C_T", "1:5")] == ["a", "b", "a", "c", "c", "1:5"]
    for label in ("1_5", "3:4", "zz", "1:5:A:C"):
        with pytest.raises(ValueError):
            A.find_marker(m, label)


def test_incomplete_samples(panel):
    y = np.array([[1.0], [np.nan], [2.0]])
    with pytest.raises(ValueError, match="incomplete"):
        M.complete(["a", "b", "c"], y)
    assert M.complete(["a", "b", "c"], y, drop=True).tolist() == [0, 2]


def test_linkage_imputes_means(panel):
    _, g, _, df = panel
    ld = A.linkage(df, "m7", min_calls=50).toPandas().set_index("marker")["r2"]
    for j in (5, 20):
        assert ld[f"m{j}"] == pytest.approx(np.corrcoef(g[:, j], g[:, 7])[0, 1] ** 2)
    ld = A.linkage(df, "m5", min_calls=50).toPandas().set_index("marker")["r2"]
    assert ld["m20"] == pytest.approx(np.corrcoef(g[:, 20], g[:, 5])[0, 1] ** 2)


def test_ols_effects(spark):
    rng = np.random.RandomState(9)
    x = rng.normal(size=(80, 2))
    y = x @ [1.0, 2.0] + rng.normal(size=80)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "y": y, "u": x[:, 0], "v": x[:, 1]}))
    got = A.ols_effects(df, ["k"], "y", ["u", "v"]).first()
    xx = np.column_stack([np.ones(80), x])
    b, rss, *_ = np.linalg.lstsq(xx, y, rcond=None)
    se = np.sqrt(rss[0] / 77 * np.linalg.inv(xx.T @ xx)[1, 1])
    assert (got["effect"], got["se"]) == pytest.approx((b[1], se))


def test_effective_tests(spark):
    rng = np.random.RandomState(10)
    base = rng.normal(size=(20, 50))
    rows = [(f"m{i}_{c}", 1, i * 10 + c, base[i].tolist()) for i in range(20) for c in range(2)] + [("flat", 1, 999, [1.0] * 50)]
    df = spark.createDataFrame(rows, "marker string, chrom int, pos long, dosage array<double>")
    me = A.effective_tests(df, block=100).first()
    x = np.corrcoef(np.repeat(base, 2, axis=0))
    e = np.clip(np.linalg.eigvalsh(x), 0, None)
    want = (e >= 1).sum() + (e - np.floor(e)).sum()
    assert me["n_markers"] == 41 and me["effective_tests"] == pytest.approx(want, abs=1e-4)
    t = A.scan_threshold(spark.createDataFrame([(1, 4446367.0)], "chrom int, effective_tests double")).first()
    assert t["threshold"] == pytest.approx(1.1245135635452496e-08)
