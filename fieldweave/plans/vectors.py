"""Correlations, components and prediction over vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A, components as P, correlate as C, prediction as M, transforms as T
from ..session import cut_lineage
from . import roles as R
from .registry import q, query, r

_IMG = f"(SELECT image_no, dim, avg(value) AS value FROM {R.CROPS_LONG} l GROUP BY image_no, dim)"
_JOINED = f"(SELECT i.dim, i.value, s.environment, s.score, i.image_no FROM {_IMG} i JOIN {R.SCORES} s USING (image_no))"
_SCOPED = f"(SELECT 'pooled' AS scope, dim, value, score FROM {_JOINED} a UNION ALL SELECT environment, dim, value, score FROM {_JOINED} b)"


def scored_images(t):
    return A.image_means(R.crops(t), "image_no").join(R.scores(t), "image_no")


def _rank_corr_sql(src: str, keys: str) -> str:
    return f"""(SELECT {keys}, count(*) AS n, corr(rx, ry) AS r FROM (SELECT {keys},
      rank() OVER (PARTITION BY {keys} ORDER BY value) + (count(*) OVER (PARTITION BY {keys}, value) - 1) / 2.0 AS rx,
      rank() OVER (PARTITION BY {keys} ORDER BY score) + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0 AS ry FROM {src} z) y GROUP BY {keys})"""


@query("score_correlation")
def score_correlation(t):
    """Flagship: pooled and per-environment rank correlation of every dimension, with p and q."""
    c = C.score_correlation(scored_images(t), "environment", "features", "score")
    return c.select("scope", "dim", "n", r("r").alias("r"), r("p_value", 6).alias("p_value"), r("q_value", 6).alias("q_value"))


@query("spearman_by_dimension", f"""SELECT scope, dim::INT AS dim, n, {q("r")} AS r FROM {_rank_corr_sql(_SCOPED, "scope, dim")} x""")
def spearman_by_dimension(t):
    c = C.spearman_by_dimension(C.scoped(scored_images(t), "environment"), ["scope"], "features", "score")
    return c.select("scope", "dim", "n", r("r").alias("r"))


@query("pearson_by_dimension", f"""SELECT scope, dim::INT AS dim, count(*) AS n, {q("corr(value, score)")} AS r FROM {_SCOPED} s GROUP BY scope, dim""")
def pearson_by_dimension(t):
    c = C.pearson_by_dimension(C.scoped(scored_images(t), "environment"), ["scope"], "features", "score")
    return c.select("scope", "dim", "n", r("r").alias("r"))


@query("correlation_matrix", f"""SELECT a.dim::INT AS i, b.dim::INT AS j, {q("corr(a.value, b.value)")} AS r FROM {R.CROPS_LONG} a JOIN {R.CROPS_LONG} b ON a.vec_id = b.vec_id AND a.dim < b.dim GROUP BY 1, 2""")
def correlation_matrix(t):
    return C.correlation_matrix(R.crops(t), "features").withColumn("r", r("r"))


_RK = f"(SELECT vec_id, dim, rank() OVER (PARTITION BY dim ORDER BY value) + (count(*) OVER (PARTITION BY dim, value) - 1) / 2.0 AS value FROM {R.CROPS_LONG} l)"


@query("rank_correlation_matrix", f"""SELECT a.dim::INT AS i, b.dim::INT AS j, {q("corr(a.value, b.value)")} AS r FROM {_RK} a JOIN {_RK} b ON a.vec_id = b.vec_id AND a.dim < b.dim GROUP BY 1, 2""")
def rank_correlation_matrix(t):
    return C.correlation_matrix(C.rank_vectors(R.crops(t), "vec_id", "features"), "ranks").withColumn("r", r("r"))


@query("rater_agreement", f"""SELECT environment, n, {q("r")} AS r, {q("r * r")} AS r2 FROM {_rank_corr_sql(f"(SELECT environment, price AS value, area AS score FROM {R.PLOTS} p)", "environment")} x""")
def rater_agreement(t):
    s = C.spearman(R.plots(t), ["environment"], "price", "area")
    return s.select("environment", "n", r("r").alias("r"), r(F.col("r") * F.col("r")).alias("r2"))


def _rk(c: str) -> str:
    return f"rank() OVER (PARTITION BY environment ORDER BY {c}) + (count(*) OVER (PARTITION BY environment, {c}) - 1) / 2.0 AS {c}_rank"


_RANKED = f"(SELECT environment, {_rk('price')}, {_rk('discount')}, {_rk('area')} FROM {R.PLOT_MEANS} m)"
_CORRS = f"(SELECT environment, count(*) AS n, corr(price_rank, discount_rank) AS r, corr(price_rank, area_rank) AS ra, corr(discount_rank, area_rank) AS rb FROM {_RANKED} k GROUP BY environment)"


def means(t):
    return A.plot_means(R.plots(t), R.PLOT_KEYS, ["price", "discount", "tax", "area"])


@query("rank_partial", f"""SELECT environment, n, {q("r")} AS r, {q("(r - ra * rb) / sqrt((1 - ra * ra) * (1 - rb * rb))")} AS partial_r FROM {_CORRS} c""")
def rank_partial(t):
    p = C.rank_partial(means(t), ["environment"], "price", "discount", ["area"])
    return p.select("environment", "n", r("r").alias("r"), r("partial_r").alias("partial_r"))


_RANKED2 = f"(SELECT environment, {_rk('price')}, {_rk('discount')}, {_rk('area')}, {_rk('tax')} FROM {R.PLOT_MEANS} m)"


@query("rank_partial_two_covariates", f"""WITH c AS (SELECT environment, count(*) AS n, corr(price_rank, discount_rank) AS r, corr(price_rank, area_rank) AS xa, corr(discount_rank, area_rank) AS ya,
    corr(price_rank, tax_rank) AS xt, corr(discount_rank, tax_rank) AS yt, corr(area_rank, tax_rank) AS zt FROM {_RANKED2} k GROUP BY environment),
  g AS (SELECT environment, n, r, (r - xa * ya) / sqrt((1 - xa * xa) * (1 - ya * ya)) AS xy, (xt - xa * zt) / sqrt((1 - xa * xa) * (1 - zt * zt)) AS xg, (yt - ya * zt) / sqrt((1 - ya * ya) * (1 - zt * zt)) AS yg FROM c)
  SELECT environment, n, {q("r")} AS r, {q("(xy - xg * yg) / sqrt((1 - xg * xg) * (1 - yg * yg))")} AS partial_r FROM g""")
def rank_partial_two(t):
    """Given two covariates: one after the other by the recursion of partial correlations."""
    p = C.rank_partial(means(t), ["environment"], "price", "discount", ["area", "tax"])
    return p.select("environment", "n", r("r").alias("r"), r("partial_r").alias("partial_r"))


@query("rank_partial_p")
def rank_partial_p(t):
    p = C.rank_partial(means(t), ["environment"], "price", "discount", ["area", "tax"])
    return p.select("environment", r("p_value", 6).alias("p_value"), r("partial_p", 6).alias("partial_p"))


@query("rank_structure", f"""SELECT environment, n, {q("ra * ra")} AS r2_x, {q("rb * rb")} AS r2_y, {q("1 - abs((r - ra * rb) / sqrt((1 - ra * ra) * (1 - rb * rb))) / abs(r)", 3)} AS share_removed, {q("ra")} AS r_x_area FROM {_CORRS} c""")
def rank_structure(t):
    s = C.rank_structure(means(t), ["environment"], "price", "discount", ["area"])
    return s.select("environment", "n", r("r2_x").alias("r2_x"), r("r2_y").alias("r2_y"), r("share_removed", 3).alias("share_removed"), r("r_x_area").alias("r_x_area"))


@query("geometry_r2", f"""SELECT dim::INT AS dim, {q("power(corr(value, score), 2)")} AS r2 FROM {_JOINED} j GROUP BY dim""")
def geometry_r2(t):
    return C.dimension_r2(scored_images(t), "features", ["score"]).withColumn("r2", r("r2"))


@query("geometry_r2_two_covariates", f"""WITH c AS (SELECT dim, corr(value, score) AS a, corr(value, image_no % 7) AS b, corr(score, image_no % 7) AS s FROM {_JOINED} j GROUP BY dim)
  SELECT dim::INT AS dim, {q("(a * a + b * b - 2 * a * b * s) / (1 - s * s)")} AS r2 FROM c""")
def geometry_r2_two(t):
    return C.dimension_r2(scored_images(t).withColumn("second", F.col("image_no") % 7), "features", ["score", "second"]).withColumn("r2", r("r2"))


@query("variance_accounted", f"""SELECT genotype AS component, {q("sum(loading * loading * variance)", 6)} AS variance FROM (SELECT genotype, dim, avg(value) AS loading FROM {R.CROPS_LONG} l GROUP BY 1, 2) a
  JOIN (SELECT dim, var_samp(value) AS variance FROM {R.CROPS_LONG} l GROUP BY dim) v USING (dim) GROUP BY genotype""")
def variance_accounted(t):
    long = R.features_long(R.crops(t), "genotype")
    load = long.groupBy(F.col("genotype").alias("component"), "dim").agg(F.avg("value").alias("loading"))
    var = long.groupBy("dim").agg(F.var_samp("value").alias("variance"))
    return C.variance_accounted(load, var).withColumn("variance", r("variance", 6))


_WX = f"""(SELECT environment, device, price, rank() OVER (PARTITION BY environment ORDER BY price) + (count(*) OVER (PARTITION BY environment, price) - 1) / 2.0 AS rk FROM {R.PLOTS} p)"""


@query("rank_sum", f"""SELECT environment, count(*) FILTER (WHERE device = 0) AS n_a, count(*) FILTER (WHERE device = 1) AS n_b,
  {q("sum(rk) FILTER (WHERE device = 0) - count(*) FILTER (WHERE device = 0) * (count(*) FILTER (WHERE device = 0) + 1) / 2", 1)} AS u FROM {_WX} w GROUP BY environment""")
def rank_sum(t):
    return C.rank_sum(R.plots(t), ["environment"], "device", "price", 0, 1).select("environment", "n_a", "n_b", r("u", 1).alias("u"))


@query("rank_sum_p")
def rank_sum_p(t):
    return C.rank_sum(R.plots(t), ["environment"], "device", "price", 0, 1).select("environment", r("z").alias("z"), r("p_value", 6).alias("p_value"))


@query("regression_line", f"""SELECT genotype, count(*) AS n, {q("regr_slope(price, area)", 3)} AS slope, {q("regr_intercept(price, area)", 2)} AS intercept FROM {R.PLOTS} p GROUP BY genotype""")
def regression_line(t):
    return C.regression_line(R.plots(t), ["genotype"], "price", "area").select("genotype", "n", r("slope", 3).alias("slope"), r("intercept", 2).alias("intercept"))


@query("structure_adjusted", f"""WITH f AS (SELECT environment, regr_slope(price, area) AS b, regr_intercept(price, area) AS a FROM {R.PLOT_MEANS} m GROUP BY environment),
  e AS (SELECT environment, genotype, plot, price - a - b * area AS e FROM {R.PLOT_MEANS} m JOIN f USING (environment))
  SELECT environment, genotype, plot, {q("(e - avg(e) OVER w) / stddev_pop(e) OVER w")} AS z FROM e WINDOW w AS (PARTITION BY environment)""")
def structure_adjusted(t):
    e = C.residuals(means(t), ["environment"], "price", ["area"])
    return T.zscore(e, ["environment"], "residual", "z").select("environment", "genotype", "plot", r("z").alias("z"))


@query("regression_metrics", f"""WITH s AS {_rank_corr_sql(f"(SELECT environment, price AS value, area * 2000 AS score FROM {R.PLOTS} p)", "environment")}
  SELECT environment, count(*) AS n, {q("corr(price, area * 2000)")} AS pearson, {q("any_value(s.r)")} AS spearman, {q("power(corr(price, area * 2000), 2)")} AS pearson_r2, {q("power(any_value(s.r), 2)")} AS spearman_r2,
  {q("sqrt(avg(power(price - area * 2000, 2)))", 2)} AS rmse, {q("avg(abs(price - area * 2000))", 2)} AS mae FROM {R.PLOTS} p JOIN s USING (environment) GROUP BY environment""")
def regression_metrics(t):
    m = C.regression_metrics(R.plots(t).withColumn("pred", F.col("area") * 2000), ["environment"], "price", "pred")
    return m.select("environment", "n", *[r(c).alias(c) for c in ("pearson", "spearman", "pearson_r2", "spearman_r2")], r("rmse", 2).alias("rmse"), r("mae", 2).alias("mae"))


@query("prediction_rollup", f"""WITH i AS (SELECT genotype, image_no, avg(features[1]::DOUBLE) AS pred FROM {R.CROPS} c GROUP BY genotype, image_no)
  SELECT genotype, {q("avg(pred)", 6)} AS pred, count(*) AS n_images FROM i GROUP BY genotype""")
def prediction_rollup(t):
    crops = R.crops(t).withColumn("pred", F.col("features")[0].cast("double"))
    return M.roll_up(crops, "image_no", "genotype", "pred").select("genotype", r("pred", 6).alias("pred"), "n_images")


# ---------------------------------------------------------------- components
@query("pca_variance")
def pca_variance(t):
    f = T.with_fit_flag(R.crops(t), "genotype", 0.1, 0)
    c = P.variance_curve(P.fit_pca(f, "features", 64, fit="is_fit"), t.spark)
    return c.select("pc", r("explained_variance_ratio", 5).alias("explained_variance_ratio"), r("cumulative", 5).alias("cumulative"))


@query("pca_scores")
def pca_scores(t):
    f = T.with_fit_flag(R.crops(t), "genotype", 0.1, 0)
    s = P.pca_scores(f, "features", P.fit_pca(f, "features", 10, fit="is_fit"))
    return s.select("vec_id", "is_fit", F.posexplode("scores").alias("pc", "v")).select("vec_id", "is_fit", "pc", r("v").alias("score"))


@query("oriented_pc1")
def oriented_pc1(t):
    long = R.phenotypes(t).where("trait LIKE '%\\_A'")
    wide = cut_lineage(long.groupBy("sample").pivot("trait", ["price_A", "discount_A", "tax_A", "area_A"]).agg(F.max("value")).dropna())
    v = wide.withColumn("features", F.array("price_A", "discount_A", "tax_A", "area_A"))
    return P.oriented_first_component(v, "features", "price_A").select("sample", r("pc1").alias("pc1"))


@query("ica_scores")
def ica_scores(t):
    f = T.with_fit_flag(R.crops(t), "genotype", 0.1, 0)
    s = P.ica_scores(f, "features", P.fit_ica(f, "features", n_white=8, n_components=8, fit="is_fit", max_iter=25))
    return s.select("vec_id", "is_fit", F.posexplode("scores").alias("ic", "v")).select("vec_id", "is_fit", "ic", r("v").alias("score"))


@query("parallel_analysis")
def parallel_analysis(t):
    f = T.with_fit_flag(R.crops(t), "genotype", 0.1, 0)
    h = P.parallel_analysis(f, "vec_id", "features", fit="is_fit")
    return h.select("pc", r("observed").alias("observed"), r("null_percentile").alias("null_percentile"), "above_null", "retained")


_EIG = f"(SELECT (row_number() OVER (ORDER BY v DESC, dim))::INT AS pc, v FROM (SELECT dim, var_samp(value) * 100 AS v FROM {R.CROPS_LONG} l GROUP BY dim) x)"


@query("component_counts", f"""WITH e AS {_EIG}, n AS (SELECT count(*) AS n FROM embeddings), t AS (SELECT pc, v, (SELECT max(pc) FROM e) AS p, avg(v) OVER w AS a, avg(ln(v)) OVER w AS g FROM e WINDOW w AS (ORDER BY pc ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  s AS (SELECT pc - 1 AS k, p, n * (p - pc + 1) * (ln(a) - g) AS llf, (pc - 1) * (2 * p - (pc - 1)) AS nfree, n FROM t, n)
  SELECT (SELECT count(*) FROM e WHERE v > 1) AS kaiser, (SELECT arg_min(k, 2 * llf + 2 * nfree) FROM s)::INT AS aic, (SELECT arg_min(k, llf + 0.5 * nfree * ln(n)) FROM s)::INT AS mdl,
  (SELECT arg_max(e.pc, abs((l.v - f.v) * (e.pc - 1) - (l.pc - 1) * e.v + (l.pc - 1) * f.v)) FROM e, (SELECT * FROM e ORDER BY pc LIMIT 1) f, (SELECT * FROM e ORDER BY pc DESC LIMIT 1) l)::INT AS elbow""")
def component_counts(t):
    v = R.features_long(R.crops(t), "vec_id").groupBy("dim").agg((F.var_samp("value") * 100).alias("v"))
    n = t.embeddings.agg(F.count(F.lit(1)).alias("n"))
    return P.component_counts(P.ordered_eigenvalues(v, "v", "dim"), n)


@query("leading_run", f"""WITH e AS {_EIG} SELECT pc, {q("v")} AS v, pc < coalesce((SELECT min(pc) FROM e WHERE v <= 1.56), 1000) AS retained FROM e""")
def leading_run(t):
    v = R.features_long(R.crops(t), "vec_id").groupBy("dim").agg((F.var_samp("value") * 100).alias("v"))
    e = P.ordered_eigenvalues(v, "v", "dim").withColumn("keep", F.col("v") > 1.56)
    return P.leading_run(e, "pc", "keep").select("pc", r("v").alias("v"), "retained")


# ---------------------------------------------------------------- prediction
def labelled_images(t):
    """Scored images with the line of the image (its customer's nation here) as the fold group."""
    line = t.customer.select(F.col("c_custkey").alias("image_no"), F.concat(F.lit("L"), "c_nationkey").alias("genotype"))
    return scored_images(t).join(line, "image_no")


@query("ridge_curve")
def ridge_curve(t):
    df = labelled_images(t).select("features", "score", "genotype")
    c = M.ridge_curve(df, "features", "score", "genotype", counts=list(range(1, 65)))
    return c.select("k", "penalty", r("mean_r2").alias("mean_r2"), r("sd_r2").alias("sd_r2"))


@query("forest_cv")
def forest_cv(t):
    df = labelled_images(t).select("image_no", "features", "score", "genotype")
    preds, _ = M.forest_cross_validation(df, "features", "score", "genotype", outer=2, inner=2, tries=2, seed=0, grid=M.FOREST_GRID | {"numTrees": [10, 20]})
    return preds.select("image_no", "fold", r("prediction", 2).alias("prediction"))
