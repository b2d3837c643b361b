import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldweave.operators import components as P, correlate as C, crossproducts as X, geometry as G, prediction as M


def vectors(spark, x, **cols):
    pdf = pd.DataFrame({"id": np.arange(len(x)), "features": [list(map(float, r)) for r in x], **cols})
    return spark.createDataFrame(pdf).repartition(4)


def test_gram_by_group(spark):
    x = np.random.RandomState(0).normal(size=(200, 5))
    g = np.array(["a", "b"])[np.arange(200) % 2]
    got = X.gram_matrices(vectors(spark, x, g=g), "features", by="g", hold=1)
    for k in "ab":
        assert np.allclose(got[k], x[g == k].T @ x[g == k])
    with pytest.raises(ValueError, match="limit"):
        X.gram_matrices(vectors(spark, x), "features", limit=4)


def test_spearman_with_ties(spark):
    rng = np.random.RandomState(1)
    pdf = pd.DataFrame({"x": rng.randint(0, 6, 300).astype(float), "y": rng.randint(0, 9, 300).astype(float)})
    pdf["y"] += (pdf["x"] > 3) * 2
    got = C.spearman(spark.createDataFrame(pdf), [], "x", "y").first()
    want = np.corrcoef(pdf["x"].rank(), pdf["y"].rank())[0, 1]
    assert got["r"] == pytest.approx(want) and got["n"] == 300


def test_spearman_without_variance(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "x double, y double")
    assert C.spearman(df, [], "x", "y").first()["r"] is None


def test_rank_partial_two_covariates(spark):
    rng = np.random.RandomState(2)
    z = rng.normal(size=(400, 2))
    pdf = pd.DataFrame({"k": "a", "x": z[:, 0] + rng.normal(size=400), "y": z @ [1, 1] + rng.normal(size=400), "z1": z[:, 0], "z2": z[:, 1]})
    got = C.rank_partial(spark.createDataFrame(pdf), ["k"], "x", "y", ["z1", "z2"]).first()
    r = pdf[["x", "y", "z1", "z2"]].rank().to_numpy()
    zz = np.column_stack([np.ones(400), r[:, 2:]])
    e = r[:, :2] - zz @ np.linalg.lstsq(zz, r[:, :2], rcond=None)[0]
    assert got["partial_r"] == pytest.approx(np.corrcoef(e.T)[0, 1])


def test_rank_sum(spark):
    rng = np.random.RandomState(3)
    a, b = np.round(rng.normal(size=60), 1), np.round(rng.normal(0.5, size=80), 1)
    df = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b], "g string, v double")
    got = C.rank_sum(df, [], "g", "v", "a", "b").first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert got["u"] == pytest.approx(u) and 0 < got["p_value"] < 1


def test_pca_properties(spark):
    rng = np.random.RandomState(4)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6))
    df = vectors(spark, x)
    fit = P.fit_pca(df, "features", 6)
    z = (x - x.mean(0)) / x.std(0)
    want = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    assert np.allclose(fit.variance, want)
    assert np.allclose(fit.components @ fit.components.T, np.eye(6), atol=1e-9)
    s = P.pca_scores(df, "features", fit).toPandas().sort_values("id")
    s = np.vstack(s["scores"])
    assert np.allclose(s @ fit.components, z, atol=1e-8)
    assert fit.total_variance == pytest.approx(6 * 300 / 299)


def test_ica_recovers_planted_sources(spark):
    rng = np.random.RandomState(5)
    src = np.column_stack([rng.exponential(size=3000), rng.uniform(-1, 1, 3000), rng.laplace(size=3000)])
    df = vectors(spark, src @ rng.normal(size=(3, 3)) + 4)
    fit = P.fit_ica(df, "features", 3, 3, tol=1e-5, max_iter=200)
    assert fit.converged
    s = np.vstack(P.ica_scores(df, "features", fit).toPandas().sort_values("id")["scores"])
    c = np.abs(np.corrcoef(s.T, src.T)[:3, 3:])
    assert np.all(c.max(1) > 0.98) and len(set(c.argmax(1))) == 3
    assert np.allclose(np.cov(s.T), np.eye(3), atol=0.02)
    assert np.all(((s - s.mean(0)) ** 3).mean(0) >= 0)


def test_blocks_are_permuted_column_by_column(spark):
    """Without a shuffle of columns the products are X'X; with it every column keeps its spread and loses its partners."""
    rng = np.random.RandomState(7)
    x = rng.normal(size=(500, 1)) + 0.3 * rng.normal(size=(500, 4))
    blocks = P.dealt_blocks(vectors(spark, x), "id", "features", 4, 3)
    assert np.allclose(np.vstack(blocks.orderBy("block", "place").toPandas()["features"]).sum(0), x.sum(0))
    mean, sd, eye = x.mean(0), x.std(0, ddof=1), np.eye(4)
    plain = P.permuted_products(blocks, "features", mean, sd, [eye], 1, False)[0]
    assert np.allclose(plain / 499, np.corrcoef(x.T))
    a, b = P.permuted_products(blocks, "features", mean, sd, [eye, eye], 1, True)
    off = ~np.eye(4, dtype=bool)
    assert np.allclose(np.diag(a), 499) and np.allclose(np.diag(b), 499) and np.abs(a[off]).max() < 0.25 * 499 and not np.allclose(a, b)
    again = P.permuted_products(blocks.repartition(3, "block").sortWithinPartitions("block", "place"), "features", mean, sd, [eye, eye], 1, True)
    assert np.allclose(again[0], a) and np.allclose(again[1], b)


def test_range_finder_matches_dense_eigenvalues(spark):
    """Fewer directions than dimensions: the leading eigenvalues still come out; many blocks add up."""
    rng = np.random.RandomState(9)
    x = rng.normal(size=(900, 5)) @ rng.normal(size=(5, 60)) + 0.5 * rng.normal(size=(900, 60))
    df, old = vectors(spark, x), P.BLOCK_BYTES
    try:
        P.BLOCK_BYTES = 8 * 60 * 100
        blocks = P.dealt_blocks(df, "id", "features", 60, 0)
        assert blocks.select("block").distinct().count() == 9
        got = P.leading_eigenvalues(blocks, "features", x.mean(0), x.std(0, ddof=1), 900, 5, 1, 0, False)[0]
    finally:
        P.BLOCK_BYTES = old
    assert np.allclose(got, np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1][:5], rtol=1e-6)


def test_parallel_analysis_finds_planted_rank(spark):
    rng = np.random.RandomState(6)
    x = rng.normal(size=(400, 2)) @ rng.normal(size=(2, 8)) * 2 + rng.normal(size=(400, 8))
    h = P.parallel_analysis(vectors(spark, x), "id", "features").toPandas().sort_values("pc")
    assert h["retained"].tolist() == [True, True] + [False] * 6
    assert np.allclose(h["observed"], np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1])
    fit = np.arange(400) < 300
    h = P.parallel_analysis(vectors(spark, x, is_fit=fit.tolist()), "id", "features", fit="is_fit").toPandas().sort_values("pc")
    assert np.allclose(h["observed"], np.sort(np.linalg.eigvalsh(np.corrcoef(x[fit].T)))[::-1])


def test_leading_run_stops_at_first_failure(spark):
    df = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True)], "pc int, ok boolean")
    assert [r["retained"] for r in P.leading_run(df, "pc", "ok").orderBy("pc").collect()] == [True, True, False, False]


def test_leaf_geometry_golden(spark):
    pts = spark.createDataFrame([(1, float(x), float(y)) for y in range(90, 110) for x in range(50, 250)], "image int, x double, y double")
    a = G.leaf_axes(pts).first()
    assert (a["angle"], a["length"], a["width"]) == pytest.approx((0.0, 199.0, 19.0), abs=1e-9)
    w = G.crop_windows(pts, G.leaf_axes(pts), 50.0, 10.0, 25.0, 300.0, 200.0).orderBy("k").collect()
    assert len(w) == 6 and w[0]["center_x"] == pytest.approx(75.0) and w[0]["in_bounds"]


def test_ridge_matches_direct_fit(spark):
    rng = np.random.RandomState(8)
    x = rng.normal(size=(300, 4))
    y = x @ [3, 0.0, 1, 0] + rng.normal(size=300)
    df = vectors(spark, x, y=y, g=[f"g{i % 30}" for i in range(300)])
    got = M.ridge_curve(df, "features", "y", "g", [1, 4], repeats=2, folds=3, penalties=[1.0]).toPandas()
    from fieldweave.operators.transforms import hashed_folds

    rows = hashed_folds(df, "g", 3, 2).toPandas()
    scores = []
    for _, part in rows.groupby("repeat"):
        rss, ys = 0.0, part["y"].to_numpy()
        for f in range(3):
            tr, te = part[part["fold"] != f], part[part["fold"] == f]
            xt, xe = np.vstack(tr["features"]), np.vstack(te["features"])
            m = xt.mean(0)
            b = np.linalg.solve((xt - m).T @ (xt - m) + np.eye(4), (xt - m).T @ (tr["y"] - tr["y"].mean()))
            rss += ((te["y"] - tr["y"].mean() - (xe - m) @ b) ** 2).sum()
        scores.append(1 - rss / ((ys - ys.mean()) ** 2).sum())
    assert got.set_index("k").loc[4, "mean_r2"] == pytest.approx(np.mean(scores))
    assert got.set_index("k").loc[1, "mean_r2"] < got.set_index("k").loc[4, "mean_r2"]


def test_ridge_penalty_is_that_of_leaving_rows_out(spark):
    rng = np.random.RandomState(18)
    x = rng.normal(size=(60, 5))
    y = x @ [2, -1, 0.5, 0, 0] + 3 * rng.normal(size=60)
    df = vectors(spark, x, y=y, g=[f"g{i % 12}" for i in range(60)])
    got = M.ridge_curve(df, "features", "y", "g", [1, 3, 5], repeats=2, folds=3).toPandas().set_index("k")
    order = [int(d) for d in np.argsort([-abs(np.corrcoef(np.argsort(np.argsort(x[:, j])), np.argsort(np.argsort(y)))[0, 1]) for j in range(5)], kind="stable")]
    for k in (1, 3, 5):
        errors = []
        for pen in M.PENALTIES:
            e = 0.0
            for i in range(60):
                keep = np.arange(60) != i
                a, b = x[keep][:, order[:k]], y[keep]
                m = a.mean(0)
                beta = np.linalg.solve((a - m).T @ (a - m) + pen * np.eye(k), (a - m).T @ (b - b.mean()))
                e += (y[i] - b.mean() - (x[i, order[:k]] - m) @ beta) ** 2
            errors.append(e)
        assert got.loc[k, "penalty"] == pytest.approx(M.PENALTIES[int(np.argmin(errors))])


def test_leaf_axis_points_the_same_way_whatever_its_slope(spark):
    """The larger entry of either axis is positive, at -70 degrees as at 70; windows start at that end."""
    rows = []
    for image, angle in enumerate((-70, 70, 110, -20, 20)):
        c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
        rows += [(image, 500 + u * c - v * s, 500 + u * s + v * c) for u in range(-100, 101, 4) for v in (-9, 0, 9)]
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, x, y in rows], "image int, x double, y double")
    axes = G.leaf_axes(pts)
    a = axes.toPandas().set_index("image").sort_index()
    assert np.allclose(a["axis_y"][:3], np.abs(np.sin(np.radians([70, 70, 70])))) and np.allclose(a["axis_x"][:3], [-np.cos(np.radians(70)), np.cos(np.radians(70)), -np.cos(np.radians(70))])
    assert (a["axis_x"][3:] > 0.9).all() and (a["perp_y"][3:] > 0.9).all() and (a["perp_x"][:3] > 0.9).all()
    assert np.allclose(a["angle"], [110, 70, 110, 160, 20]) and np.allclose(a["length"], 200) and np.allclose(a["width"], 18)
    w = G.crop_windows(pts, axes, 50.0, 10.0, 25.0, 1000.0, 1000.0).where("k = 0").toPandas().set_index("image").sort_index()
    assert (w["center_y"][:3] < 430).all() and (w["center_x"][3:] < 430).all()


def test_forest_keeps_groups_whole(spark):
    rng = np.random.RandomState(9)
    x = rng.normal(size=(200, 3))
    df = vectors(spark, x, y=x[:, 0] * 5, g=[f"g{i % 20}" for i in range(200)])
    pred, imp = M.forest_cross_validation(df, "features", "y", "g", outer=2, inner=2, tries=2, grid={"numTrees": [10], "maxDepth": [5, 10], "bootstrap": [True, False]})
    p = pred.toPandas()
    assert len(p) == 200 and p.groupby("g")["fold"].nunique().max() == 1
    assert np.corrcoef(p["y"], p["prediction"])[0, 1] > 0.7
    top = imp.groupBy("feature").agg(F.avg("importance").alias("m")).orderBy(F.desc("m")).first()
    assert top["feature"] == 0


def test_stacked_regressions_match_lstsq(spark):
    """Every matrix of a stack on its own, dependent columns left out, null and constant groups apart."""
    from fieldweave.operators import association as A, correlate as C

    rng = np.random.RandomState(14)
    frames = []
    for g, kind in enumerate(["plain", "plain", "twice", "flat", "few"]):
        n = 3 if kind == "few" else 40
        x, z = rng.normal(size=n), rng.normal(size=n)
        z = 2 * x if kind == "twice" else z
        y = np.zeros(n) if kind == "flat" else 1.5 * x - z + rng.normal(size=n)
        frames.append(pd.DataFrame({"g": f"{g}{kind}", "y": y, "x": x, "z": z, "id": np.arange(n)}))
    pdf = pd.concat(frames)
    df = spark.createDataFrame(pdf)
    res = C.residuals(df, ["g"], "y", ["x", "z"]).toPandas()
    for g, part in res.groupby("g"):
        design = np.column_stack([np.ones(len(part)), part["x"], part["z"]])
        want = part["y"] - design @ np.linalg.lstsq(design, part["y"], rcond=None)[0]
        assert np.allclose(part["residual"], want, atol=1e-8)
    ols = {r["g"]: r for r in A.ols_effects(df, ["g"], "y", ["x", "z"]).collect()}
    one = pdf[pdf["g"] == "0plain"]
    b = np.linalg.lstsq(np.column_stack([np.ones(40), one["x"], one["z"]]), one["y"], rcond=None)[0]
    assert ols["0plain"]["effect"] == pytest.approx(b[1]) and ols["2twice"]["effect"] is None and ols["4few"]["effect"] is None and ols["3flat"]["r2"] is None
    part = {r["g"]: r["partial_r"] for r in C.rank_partial(df, ["g"], "x", "y", ["z"]).collect()}
    rank = one[["x", "y", "z"]].rank()
    e = [rank[c] - np.polyval(np.polyfit(rank["z"], rank[c], 1), rank["z"]) for c in "xy"]
    assert part["0plain"] == pytest.approx(np.corrcoef(*e)[0, 1]) and part["3flat"] is None and part["2twice"] is None


def test_set_join_is_exact(spark):
    """Prefix and length filters lose nothing: against all pairs, at several thresholds, with hot and rare members."""
    from fieldweave.operators import hotspots as H

    rng = np.random.RandomState(15)
    sets = {f"s{i:03d}": sorted({"hot"} | {f"m{int(v)}" for v in rng.zipf(1.4, size=rng.randint(1, 9)) % 30}) if i % 3 else [f"r{i % 5}", f"m{i % 4}"] for i in range(120)}
    df = spark.createDataFrame([(k, v) for k, v in sets.items()] + [("empty", [])], "name string, members array<string>")
    for least in (0.1, 0.5, 2 / 3, 0.8, 1.0):
        want = {(a, b) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) >= least * len(set(sets[a]) | set(sets[b])) - 1e-12}
        got = [(r["set_a"], r["set_b"]) for r in H.set_join(df, least, "name").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_tiles_add_up_within_a_byte_bound(spark):
    """64 groups and tiles of 3 columns, few of them held at once, give the products of every group."""
    from fieldweave.operators import correlate as C, crossproducts as X, kinship as K

    rng = np.random.RandomState(16)
    x = rng.normal(size=(640, 8))
    g = [f"g{i % 64}" for i in range(640)]
    df = vectors(spark, x, g=g).repartition(3)
    cells = X.tile_entries(X.gram_tiles(df, "features", by="g", tile=3, open_bytes=4 * 9 * 8)).toPandas()
    assert len(cells) == 64 * 36 and not cells.duplicated(["grp", "i", "j"]).any()
    for name in ("g0", "g17", "g63"):
        part = x[[v == name for v in g]]
        own = cells[cells["grp"] == name]
        assert np.allclose(own["v"], (part.T @ part)[own["i"], own["j"]])
    flat = np.column_stack([x, np.ones(640)])
    r = C.correlation_matrix(vectors(spark, flat), "features", tile=4).toPandas()
    want = np.corrcoef(x.T)
    assert len(r) == 36 and r[r["j"] == 8]["r"].isna().all() and np.allclose(r[r["j"] < 8]["r"], [want[i, j] for i, j in zip(r["i"], r["j"]) if j < 8])
    m = rng.binomial(2, 0.4, size=(50, 7)).astype(float)
    m[3, 2] = np.nan
    panel = spark.createDataFrame([(f"m{i}", 1, i, [None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(m)], "marker string, chrom int, pos long, dosage array<double>")
    names = [f"s{i}" for i in range(7)]
    k = K.kinship_pairs(panel, names, tile=3).toPandas()
    full = K.kinship_from_products(sum(K.raw_products(panel).values()))
    assert len(k) == 28 and np.allclose(k["kinship"], [full[int(a[1:]), int(b[1:])] for a, b in zip(k["sample_a"], k["sample_b"])])
