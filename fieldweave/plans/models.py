"""Plot models: design table, BLUEs, variance components, heritability."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mixed_models as B
from . import roles as R
from .registry import q, query, r

TRAITS = ["price", "discount", "tax"]
FACTORS = ["row", "col", "device"]


# Plot means of every environment, each winsorized and scaled inside its own.
_WINS = f"""(SELECT m.* REPLACE (least(greatest(price, lo), hi) AS price) FROM {R.PLOT_MEANS} m JOIN
  (SELECT environment, quantile_cont(price, 0.01) AS lo, quantile_cont(price, 0.99) AS hi FROM {R.PLOT_MEANS} y GROUP BY environment) e USING (environment))"""


@query("model_plots", f"""SELECT environment, genotype, plot, {q("price", 3)} AS price, {q("(area - avg(area) OVER w) / stddev_pop(area) OVER w")} AS area_scaled
  FROM {_WINS} w WINDOW w AS (PARTITION BY environment)""")
def model_plots(t):
    m, _ = B.model_plots(R.plots(t), ["price"], R.PLOT_KEYS, area="area")
    return m.select("environment", "genotype", "plot", r("price", 3).alias("price"), r("area_scaled").alias("area_scaled"))


@query("model_plots_across", f"""SELECT genotype, plot, environment, genotype || ':' || environment AS genotype_x_environment,
  {q("CASE WHEN environment = 'N' THEN (area - avg(area) OVER w) / stddev_samp(area) OVER w ELSE 0 END")} AS area_N FROM {R.PLOT_MEANS} m
  WHERE genotype IN (SELECT genotype FROM {R.PLOTS} p GROUP BY genotype HAVING count(DISTINCT environment) >= 2) WINDOW w AS (PARTITION BY environment)""")
def model_plots_across(t):
    m, _ = B.model_plots(R.plots(t), ["price"], R.PLOT_KEYS, area="area", across=True)
    return m.select("genotype", "plot", "environment", "genotype_x_environment", r("area_N").alias("area_N"))


_Z = "(SELECT environment, genotype, price, (area - avg(area) OVER w) / stddev_pop(area) OVER w AS x FROM " + _WINS + " w WINDOW w AS (PARTITION BY environment))"


@query("blues_least_squares", f"""WITH z AS {_Z}, g AS (SELECT environment, genotype, avg(price) AS y, avg(x) AS x FROM z GROUP BY environment, genotype),
  b AS (SELECT environment, sum((z.price - g.y) * (z.x - g.x)) / sum(power(z.x - g.x, 2)) AS b FROM z JOIN g USING (environment, genotype) GROUP BY environment),
  m AS (SELECT environment, avg(x) AS m FROM z GROUP BY environment)
  SELECT environment, genotype, {q("y - b * (x - m)", 2)} AS blue FROM g JOIN b USING (environment) JOIN m USING (environment)""")
def blues_least_squares(t):
    m, cov = B.model_plots(R.plots(t), ["price"], R.PLOT_KEYS, area="area")
    return B.fit_blues(m, ["price"], covariates=cov, env="environment").select("environment", "genotype", r("blue", 2).alias("blue"))


@query("blues")
def blues(t):
    m, cov = B.model_plots(R.plots(t), TRAITS, R.PLOT_KEYS, area="area")
    return B.fit_blues(m, TRAITS, covariates=cov, factors=FACTORS, env="environment").select("environment", "genotype", "trait", r("blue").alias("blue"))


def vc_each(t):
    m, cov = B.model_plots(R.plots(t), TRAITS, R.PLOT_KEYS, area="area")
    return m, B.variance_components(m, TRAITS, covariates=cov, factors=FACTORS, env="environment")


@query("variance_components")
def variance_components(t):
    _, vc = vc_each(t)
    return B.variance_shares(vc, ("environment",)).select("environment", "trait", "source", r("proportion_variance").alias("proportion_variance"), "boundary", "converged", "singular")


@query("heritability")
def heritability(t):
    m, vc = vc_each(t)
    return B.line_mean_h2(vc, m, by="environment").select("environment", "trait", "n_plots", "n_genotypes", r("hr", 3).alias("hr"), r("h2").alias("h2"), "reliable")


@query("heritability_across")
def heritability_across(t):
    m, cov = B.model_plots(R.plots(t), TRAITS, R.PLOT_KEYS, area="area", across=True)
    vc = B.variance_components_across(m, TRAITS, covariates=cov, factors=["row", "device"])
    return B.line_mean_h2(vc, m, env="environment").select("trait", "n_plots", "n_genotypes", r("he", 3).alias("he"), r("hr", 3).alias("hr"), r("h2").alias("h2"), "converged", "reliable")


# Every customer segment an environment, every fifth nation a genotype with its first plots, as many in each: the
# closed ANOVA form of a balanced one-way layout.
_BALANCED = """(SELECT environment, genotype, y FROM (SELECT environment, genotype, y, row_number() OVER (PARTITION BY environment, genotype ORDER BY k) AS place,
    min(n) OVER (PARTITION BY environment) AS least FROM (SELECT c_mktsegment AS environment, 'N' || c_nationkey % 5 AS genotype, c_acctbal + 400 * (c_nationkey % 5) AS y, c_custkey AS k,
    count(*) OVER (PARTITION BY c_mktsegment, c_nationkey % 5) AS n FROM customer) x) z WHERE place <= least)"""


def balanced(t):
    from pyspark.sql import Window as W

    c = t.customer.select(F.col("c_mktsegment").alias("environment"), F.concat(F.lit("N"), F.col("c_nationkey") % 5).alias("genotype"), (F.col("c_acctbal") + 400 * (F.col("c_nationkey") % 5)).alias("y"), F.col("c_custkey").alias("k"))
    n = c.groupBy("environment", "genotype").agg(F.count(F.lit(1)).alias("n")).groupBy("environment").agg(F.min("n").alias("least"))
    place = F.row_number().over(W.partitionBy("environment", "genotype").orderBy("k"))
    return c.withColumn("place", place).join(n, "environment").where("place <= least").select("environment", "genotype", "y")


@query("balanced_components", f"""WITH g AS (SELECT environment, genotype, avg(y) AS m, count(*) AS n, sum(y * y) - count(*) * avg(y) * avg(y) AS ss FROM {_BALANCED} b GROUP BY environment, genotype),
  e AS (SELECT environment, any_value(n) AS n, count(*) AS g, sum(ss) / sum(n - 1) AS mse, any_value(n) * var_samp(m) AS msg, sum(ss) AS ss, sum(n) AS total FROM g GROUP BY environment),
  v AS (SELECT *, msg > mse AS inside, CASE WHEN msg > mse THEN mse ELSE (ss + msg * (g - 1)) / (total - 1) END AS ve FROM e)
  SELECT environment, g AS n_genotypes, total::BIGINT AS n_plots, {q("CASE WHEN inside THEN (msg - mse) / n ELSE 0 END", 0)} AS vg, {q("ve", 0)} AS ve,
    {q("CASE WHEN inside THEN (msg - mse) / n / ((msg - mse) / n + ve / n) ELSE 0 END", 3)} AS h2, NOT inside AS singular, true AS converged FROM v""")
def balanced_components(t):
    """Components and heritability of a balanced layout in every environment, whose REML form is closed."""
    b = balanced(t)
    h = B.line_mean_h2(B.variance_components(b, ["y"], env="environment"), b, by="environment")
    return h.select("environment", "n_genotypes", "n_plots", r("vg", 0).alias("vg"), r("ve", 0).alias("ve"), r("h2", 3).alias("h2"), "singular", "converged")


_VC = """(SELECT 'price' AS trait, l_returnflag AS src, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY l_returnflag
  UNION ALL SELECT 'tax', l_returnflag, var_samp(l_tax) FROM lineitem GROUP BY l_returnflag)"""


def toy_vc(t):
    """Variances of three line statuses standing in as components."""
    p = t.lineitem.groupBy("l_returnflag").agg(F.var_samp("l_extendedprice").alias("price"), F.var_samp("l_tax").alias("tax"))
    long = p.unpivot("l_returnflag", ["price", "tax"], "trait", "vcov")
    src = F.when(F.col("l_returnflag") == "A", "genotype").when(F.col("l_returnflag") == "N", "genotype_x_environment").otherwise("Residual")
    return long.select("trait", src.alias("source"), "vcov", F.lit(True).alias("converged"), F.lit(None).cast("string").alias("error"))


@query("variance_shares", f"""SELECT trait, CASE src WHEN 'A' THEN 'genotype' WHEN 'N' THEN 'genotype_x_environment' ELSE 'Residual' END AS source, {q("v / sum(v) OVER (PARTITION BY trait)")} AS proportion_variance FROM {_VC} x""")
def variance_shares(t):
    return B.variance_shares(toy_vc(t)).select("trait", "source", r("proportion_variance").alias("proportion_variance"))


@query("line_mean_h2", f"""WITH v AS (SELECT trait, max(v) FILTER (WHERE src = 'A') AS vg, max(v) FILTER (WHERE src = 'N') AS vge, max(v) FILTER (WHERE src = 'R') AS ve FROM {_VC} x GROUP BY trait),
  e AS (SELECT count(*) / sum(1.0 / n) AS he FROM (SELECT count(DISTINCT environment) AS n FROM {R.PLOT_MEANS} m GROUP BY genotype) y), h AS (SELECT count(*) / sum(1.0 / n) AS hr FROM (SELECT count(*) AS n FROM {R.PLOT_MEANS} m GROUP BY genotype, environment) y)
  SELECT trait, {q("he")} AS he, {q("hr")} AS hr, {q("vg / (vg + vge / he + ve / (he * hr))")} AS h2 FROM v, e, h""")
def line_mean_h2(t):
    from ..operators.aggregates import plot_means

    m = plot_means(R.plots(t), R.PLOT_KEYS, ["price"])
    h = B.line_mean_h2(toy_vc(t), m, env="environment")
    return h.select("trait", r("he").alias("he"), r("hr").alias("hr"), r("h2").alias("h2"))


@query("covariate_blues", f"""SELECT environment, genotype, {q("avg(area)")} AS area_blue, {q("any_value(s_acctbal)", 2)} AS days_blue FROM {R.PLOT_MEANS} m JOIN supplier ON genotype = 'S' || s_suppkey GROUP BY environment, genotype""")
def covariate_blues(t):
    m, _ = B.model_plots(R.plots(t), ["area"], R.PLOT_KEYS, winsor=0.0)
    other = t.supplier.select(F.concat(F.lit("S"), "s_suppkey").alias("genotype"), F.col("s_acctbal").alias("days_blue"))
    c = B.covariate_blues(m, "area", [], other, env="environment")
    return c.select("environment", "genotype", r("area_blue").alias("area_blue"), r("days_blue", 2).alias("days_blue"))
