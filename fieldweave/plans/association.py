"""Kinship, scans, single-marker tests, conditioning and linkage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A, association as X, kinship as K, mixed_scan as M
from ..session import cut_lineage
from ..sources import genome as SG
from . import roles as R
from .registry import q, query, r
from .tables import _ANN, variant_annotations


def panel(t):
    """(samples, marker vectors); a sample without a line for a marker is reference homozygote."""
    calls = R.calls(t)
    samples = K.sample_list(R._lines(t))
    return samples, cut_lineage(K.marker_vectors(calls, samples, absent=0.0))


def long_dosage(samples, vectors):
    names = F.array(*[F.lit(s) for s in samples])
    return vectors.select("marker", "chrom", "pos", F.posexplode("dosage").alias("i", "dosage")).select(
        "marker", "chrom", "pos", names[F.col("i")].alias("sample"), F.col("dosage").cast("int").alias("dosage"))


@query("dosage_matrix", f"SELECT marker, chrom, pos, sample, dosage FROM {R.DOSAGE} d")
def dosage_matrix(t):
    return long_dosage(*panel(t))


_KIN = f"""WITH d AS (SELECT marker, chrom, sample, dosage - avg(dosage) OVER (PARTITION BY marker) AS z, avg(dosage) OVER (PARTITION BY marker) / 2 AS p FROM {R.DOSAGE} x)"""


@query("kinship", f"""{_KIN}, s AS (SELECT sum(2 * p * (1 - p)) / count(DISTINCT sample) AS w FROM d)
  SELECT a.sample AS sample_a, b.sample AS sample_b, {q("sum(a.z * b.z) / any_value(w)")} AS kinship FROM d a JOIN d b ON a.marker = b.marker AND a.sample <= b.sample, s GROUP BY 1, 2""")
def kinship(t):
    samples, v = panel(t)
    return K.kinship_pairs(v, samples).withColumn("kinship", r("kinship"))


@query("kinship_without_chromosome", f"""{_KIN}, s AS (SELECT sum(2 * p * (1 - p)) / count(DISTINCT sample) AS w FROM d WHERE chrom <> 2)
  SELECT a.sample AS sample_a, b.sample AS sample_b, {q("sum(a.z * b.z) / any_value(w)")} AS kinship FROM (SELECT * FROM d WHERE chrom <> 2) a JOIN d b ON a.marker = b.marker AND a.sample <= b.sample, s GROUP BY 1, 2""")
def kinship_loco(t):
    samples, v = panel(t)
    return K.kinship_pairs(v.where("chrom <> 2"), samples).withColumn("kinship", r("kinship"))


@query("genotype_components")
def genotype_components(t):
    samples, v = panel(t)
    pcs = K.components_of(K.kinship_from_products(sum(K.raw_products(v).values())), 5)
    rows = [(s, j + 1, float(pcs[i, j])) for i, s in enumerate(samples) for j in range(5)]
    return t.spark.createDataFrame(rows, "sample string, pc int, value double").withColumn("value", r("value"))


TRAITS = [f"{m}_{e}" for m in ("price", "discount", "tax", "area") for e in ("A", "N", "R")]


def dosage_of(t, *markers):
    """Dosage of a few markers in every sample, without the panel."""
    every = R._lines(t).select("sample").distinct().withColumn("marker", F.explode(F.array(*[F.lit(m) for m in markers])))
    own = R.calls(t).where(F.col("marker").isin(*markers)).select("sample", "marker", "dosage")
    return every.join(own, ["sample", "marker"], "left").withColumn("dosage", F.coalesce("dosage", F.lit(0)))


def scan_inputs(t, traits=TRAITS):
    samples, v = panel(t)
    pheno = R.phenotypes(t)
    y = M.trait_matrix(pheno, samples, list(traits))
    keep = M.complete(samples, y, drop=True)
    return samples, v, y[keep], keep


_PX = f"""(SELECT p.trait, d.marker, d.chrom, d.pos, d.sample, p.value AS y, d.dosage::DOUBLE AS x FROM {R.PHENO} p JOIN {R.DOSAGE} d USING (sample))"""


@query("scan_without_kinship", f"""SELECT trait, marker, chrom, pos, {q("regr_slope(y, x)")} AS effect, {q("sqrt((regr_syy(y, x) - power(regr_sxy(y, x), 2) / regr_sxx(y, x)) / (count(*) - 2) / regr_sxx(y, x))")} AS se
  FROM {_PX} z GROUP BY ALL HAVING var_pop(x) > 0""")
def scan_without_kinship(t):
    samples, v, y, keep = scan_inputs(t)
    s = M.scan(v, y, TRAITS, M.design(len(y)), keep)
    return s.where("effect IS NOT NULL").select("trait", "marker", "chrom", "pos", r("effect").alias("effect"), r("se").alias("se"))


def mixed(t, traits, **kw):
    samples, v, y, keep = scan_inputs(t, traits)
    products = K.raw_products(v)
    pcs = K.components_of(K.kinship_from_products(sum(products.values()), keep), 3)
    return samples, v, M.scan(v, y, list(traits), M.design(len(y), pcs), keep, K.loco_products(products), **kw)


@query("mixed_scan")
def mixed_scan(t):
    _, _, s = mixed(t, TRAITS)
    return s.select("trait", "marker", r("effect").alias("effect"), r("se").alias("se"), r("p_value", 6).alias("p_value"))


@query("region_scan")
def region_scan(t):
    samples, v, y, keep = scan_inputs(t)
    products = K.raw_products(v)
    pcs = K.components_of(K.kinship_from_products(sum(products.values()), keep), 3)
    region = v.where("chrom = 2 AND pos BETWEEN 1 AND 20000000")
    s = M.scan(region, y, TRAITS, M.design(len(y), pcs), keep, K.loco_products(products))
    return s.select("trait", "marker", "pos", r("effect").alias("effect"), r("p_value", 6).alias("p_value"))


@query("covariate_matrix", f"""SELECT sample, {q("(value - avg(value) OVER ()) / stddev_pop(value) OVER ()")} AS covariate, dosage FROM {R.PHENO} p JOIN {R.DOSAGE} d USING (sample) WHERE trait = 'area_A' AND marker = 'M7'""")
def covariate_matrix(t):
    from ..operators.transforms import zscore

    d = dosage_of(t, "M7").select("sample", "dosage")
    c = zscore(R.phenotypes(t).where("trait = 'area_A'").join(d, "sample"), [], "value", "covariate")
    return c.select("sample", r("covariate").alias("covariate"), "dosage")


@query("effective_tests")
def effective_tests(t):
    _, v = panel(t)
    return X.effective_tests(v, 200).withColumn("effective_tests", r("effective_tests", 3))


@query("scan_threshold")
def scan_threshold(t):
    _, v = panel(t)
    return X.scan_threshold(X.effective_tests(v, 200)).select(r("effective_tests", 3).alias("effective_tests"), r("threshold", 9).alias("threshold"))


# ---------------------------------------------------------------- single marker, strata
_CELLS = f"""(SELECT trait, sample, value AS y, dosage FROM {R.PHENO} p JOIN (SELECT sample, dosage FROM {R.DOSAGE} d WHERE marker = 'M7') m USING (sample))"""


def one_marker_cells(t):
    return R.phenotypes(t).select("trait", "sample", F.col("value").alias("y")).join(dosage_of(t, "M7").select("sample", "dosage"), "sample")


def products_for(t, chrom="3"):
    """(samples, product sums of all markers, those outside the chromosome)."""
    samples, v = panel(t)
    products = K.raw_products(v)
    return samples, sum(products.values()), K.loco_products(products)[chrom]


@query("single_marker_rules", f"""WITH s AS (SELECT trait, count(*) AS n_observations, count(*) FILTER (WHERE dosage = 0) AS n_ref_homozygote, count(*) FILTER (WHERE dosage = 1) AS n_heterozygote,
  count(*) FILTER (WHERE dosage = 2) AS n_alt_homozygote, avg(y) AS m, stddev_pop(y) AS sd FROM {_CELLS} c GROUP BY trait)
  SELECT trait, n_observations, n_ref_homozygote, n_heterozygote, n_alt_homozygote, {q("m")} AS phenotype_mean, {q("sd")} AS phenotype_sd,
  CASE WHEN n_observations < 30 THEN 'n_observations < 30' WHEN n_ref_homozygote < 3 THEN 'n_ref_homozygote < 3' WHEN n_alt_homozygote < 3 THEN 'n_alt_homozygote < 3' WHEN NOT sd > 0 THEN 'phenotype has zero/non-finite variance' END AS skip_reason,
  CASE WHEN n_observations < 30 OR n_ref_homozygote < 3 OR n_alt_homozygote < 3 OR NOT sd > 0 THEN 'skipped' ELSE 'queued' END AS status FROM s""")
def single_marker_rules(t):
    cells = one_marker_cells(t)
    s = M.one_marker_rules(cells, ["trait"])
    return s.withColumns({"phenotype_mean": r("phenotype_mean"), "phenotype_sd": r("phenotype_sd")})


@query("phenome_scan")
def phenome_scan(t):
    s = M.one_marker_tests(one_marker_cells(t), ["trait"], *products_for(t), n_pcs=3, min_homozygotes=1)
    return s.select("trait", "n_observations", "status", "skip_reason", r("effect").alias("effect"), r("se").alias("se"), r("p_value", 6).alias("p_value"), r("standardized_effect").alias("standardized_effect"))


def strata_cells(t):
    """One marker in every environment of a phenotype, and in the samples common to all of them ("common", rows of one environment)."""
    cells = one_marker_cells(t).withColumns({"metric": F.regexp_extract("trait", "^(.*)_", 1), "environment": F.regexp_extract("trait", "_([^_]*)$", 1)})
    shared = cells.groupBy("metric", "sample").agg(F.count_distinct("environment").alias("n")).where("n = 3").select("metric", "sample")
    common = cells.where("environment = 'N'").join(shared, ["metric", "sample"]).withColumn("environment", F.lit("common"))
    return cells.unionByName(common.select(cells.columns)).select("metric", "environment", "sample", "y", "dosage")


_STRATA = f"""(WITH c AS (SELECT split_part(trait, '_', 1) AS metric, split_part(trait, '_', 2) AS environment, sample, y, dosage FROM {_CELLS} x)
  SELECT * FROM c UNION ALL SELECT metric, 'common', sample, y, dosage FROM c WHERE environment = 'N' AND (metric, sample) IN (SELECT (metric, sample) FROM c GROUP BY metric, sample HAVING count(DISTINCT environment) = 3))"""


@query("stratified_marker_counts", f"""SELECT metric, environment, count(*) AS n_observations, count(*) FILTER (WHERE dosage = 0) AS n_ref_homozygote, count(*) FILTER (WHERE dosage = 2) AS n_alt_homozygote, {q("avg(y)")} AS phenotype_mean,
  CASE WHEN count(*) < 30 OR count(*) FILTER (WHERE dosage = 0) < 1 OR count(*) FILTER (WHERE dosage = 2) < 1 OR NOT stddev_pop(y) > 0 THEN 'skipped' ELSE 'tested' END AS status FROM {_STRATA} s GROUP BY metric, environment""")
def stratified_marker_counts(t):
    """Sample counts and status of a tested marker, environment by environment and for the common samples."""
    s = stratified(t)
    return s.select("metric", "environment", "n_observations", "n_ref_homozygote", "n_alt_homozygote", r("phenotype_mean").alias("phenotype_mean"), "status")


def stratified(t):
    return M.one_marker_tests(strata_cells(t), ["metric", "environment"], *products_for(t), n_pcs=3, min_homozygotes=1)


@query("stratified_marker_test")
def stratified_marker_test(t):
    s = stratified(t)
    return s.select("metric", "environment", "n_observations", "status", "direction", r("effect").alias("effect"), r("p_value", 6).alias("p_value"), r("homozygote_contrast").alias("homozygote_contrast"))


_SM = f"""(SELECT trait, marker, regr_slope(y, x) AS effect, power(corr(y, x), 2) AS r2, count(*) AS n FROM {_PX} z GROUP BY trait, marker HAVING var_pop(x) > 0)"""


def least_squares(t):
    """Every marker against every trait, from the panel's arrays."""
    samples, v = panel(t)
    return X.marker_trait_effects(v, M.trait_matrix(R.phenotypes(t), samples, TRAITS), TRAITS).where("effect IS NOT NULL")


@query("marker_effects", f"SELECT trait, marker, n, {q('effect')} AS effect, {q('r2')} AS r2 FROM {_SM} s")
def marker_effects(t):
    return least_squares(t).select("trait", "marker", "n", r("effect").alias("effect"), r("r2").alias("r2"))


@query("disease_screen", f"""SELECT marker, {q("max(r2)")} AS best_r2, arg_max(trait, r2) AS best_trait FROM {_SM} s GROUP BY marker""")
def disease_screen(t):
    e = least_squares(t)
    best = e.groupBy("marker").agg(F.max("r2").alias("best_r2"), F.min_by("trait", F.struct(-F.col("r2"), "trait")).alias("best_trait"))
    return best.select("marker", r("best_r2").alias("best_r2"), "best_trait")


# Student's t tail in closed form: a finite sum of powers of cos^2 for any whole number of degrees of freedom.
_LS = f"""(WITH s AS (SELECT trait, marker, count(*) - 2 AS df, regr_slope(y, x) AS effect, sqrt(regr_sxx(y, x) * (count(*) - 2) / (regr_syy(y, x) - power(regr_sxy(y, x), 2) / regr_sxx(y, x))) * regr_slope(y, x) AS t
    FROM {_PX} z GROUP BY trait, marker HAVING var_pop(x) > 0),
  a AS (SELECT *, atan(abs(t) / sqrt(df)) AS th FROM s)
  SELECT trait, marker, effect, 1 - CASE WHEN df % 2 = 1 THEN 2 / pi() * (th + sin(th) * cos(th) * list_sum(list_transform(range(0, (df - 1) // 2), lambda j: exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)) * power(cos(th), 2 * j))))
    ELSE sin(th) * list_sum(list_transform(range(0, df // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)) * power(cos(th), 2 * j))) END AS p FROM a)"""
_BH = f"""(SELECT *, max(CASE WHEN p <= 0.9 * i / m THEN i END) OVER (PARTITION BY trait) AS k, max(CASE WHEN p <= 0.9 * i / m THEN p END) OVER (PARTITION BY trait) AS cutoff FROM
  (SELECT *, rank() OVER (PARTITION BY trait ORDER BY p) + count(*) OVER (PARTITION BY trait, p) - 1 AS i, count(*) OVER (PARTITION BY trait) AS m FROM {_LS} l) z)"""


def scanned(t):
    from ..operators import testing as TS

    return TS.scan_report(least_squares(t), 0.001, 0.9, 5)


@query("scan_summary", f"""SELECT trait, count(*) AS n_tested, {q("min(p)", 6)} AS min_p, count(*) FILTER (WHERE p <= 0.001) AS n_significant, {q("any_value(cutoff)", 6)} AS bh_cutoff, coalesce(any_value(k), 0)::BIGINT AS n_bh FROM {_BH} b GROUP BY trait""")
def scan_summary(t):
    """From the panel to tests to cut-offs to counts, per trait."""
    s = scanned(t)[0]
    return s.select("trait", "n_tested", r("min_p", 6).alias("min_p"), "n_significant", r("bh_cutoff", 6).alias("bh_cutoff"), "n_bh")


@query("scan_hits", f"""SELECT trait, marker, {q("effect")} AS effect, {q("p", 6)} AS p_value, p <= 0.001 AS passes_threshold, coalesce(p <= cutoff, false) AS passes_bh FROM {_BH} b WHERE p <= 0.001 OR p <= cutoff""")
def scan_hits(t):
    h = scanned(t)[1]
    return h.select("trait", "marker", r("effect").alias("effect"), r("p_value", 6).alias("p_value"), "passes_threshold", "passes_bh")


@query("scan_top", f"""SELECT trait, marker, {q("p", 6)} AS p_value, rank FROM (SELECT *, row_number() OVER (PARTITION BY trait ORDER BY p, marker)::INT AS rank FROM {_LS} l) z WHERE rank <= 5""")
def scan_top(t):
    return scanned(t)[2].select("trait", "marker", r("p_value", 6).alias("p_value"), "rank")


@query("screen_verdicts")
def screen_verdicts(t):
    """The screen in its mixed-model form: components of all markers, kinship without the marker's chromosome."""
    _, _, s = mixed(t, TRAITS)
    return X.screen_verdict(s.where("p_value IS NOT NULL"), 1e-2).select("marker", r("min_p", 6).alias("min_p"), "best_trait", "related")


_TWO = f"""(SELECT p.trait, p.sample, p.value AS y, a.dosage::DOUBLE AS m, b.dosage::DOUBLE AS o FROM {R.PHENO} p JOIN (SELECT sample, dosage FROM {R.DOSAGE} x WHERE marker = 'M7') a USING (sample) JOIN (SELECT sample, dosage FROM {R.DOSAGE} y WHERE marker = 'M12') b USING (sample))"""


@query("conditional_effects", f"""SELECT trait, count(*) AS n, {q("covar_pop(y, m) / var_pop(m)")} AS effect_alone, {q("(covar_pop(y, m) * var_pop(o) - covar_pop(y, o) * covar_pop(m, o)) / (var_pop(m) * var_pop(o) - power(covar_pop(m, o), 2))")} AS effect_given,
  {q("(covar_pop(y, o) * var_pop(m) - covar_pop(y, m) * covar_pop(m, o)) / (var_pop(m) * var_pop(o) - power(covar_pop(m, o), 2))")} AS other_given FROM {_TWO} t GROUP BY trait""")
def conditional_effects(t):
    d = dosage_of(t, "M7", "M12")
    two = d.groupBy("sample").agg(F.max(F.when(F.col("marker") == "M7", F.col("dosage"))).alias("m"), F.max(F.when(F.col("marker") == "M12", F.col("dosage"))).alias("o"))
    cells = R.phenotypes(t).join(two, "sample")
    e = X.conditional_effects(cells.withColumns({"m": F.col("m").cast("double"), "o": F.col("o").cast("double")}), ["trait"], "value", "m", "o")
    return e.select("trait", "n", *[r(c).alias(c) for c in ("effect_alone", "effect_given", "other_given")])


@query("trait_conditioned_effects", f"""SELECT trait, count(*) AS n, {q("(covar_pop(y, m) * var_pop(o) - covar_pop(y, o) * covar_pop(m, o)) / (var_pop(m) * var_pop(o) - power(covar_pop(m, o), 2))")} AS effect_given
  FROM (SELECT t.trait, t.y, t.m, c.value AS o FROM {_TWO} t JOIN (SELECT sample, value FROM {R.PHENO} q WHERE trait = 'area_A') c USING (sample) WHERE t.trait <> 'area_A') z GROUP BY trait""")
def trait_conditioned(t):
    cov = R.phenotypes(t).where("trait = 'area_A'").select("sample", F.col("value").alias("o"))
    c = one_marker_cells(t).where("trait <> 'area_A'").join(cov, "sample").withColumn("m", F.col("dosage").cast("double"))
    return X.ols_effects(c, ["trait"], "y", ["m", "o"]).select("trait", "n", r("effect").alias("effect_given"))


@query("conditional_mixed_effects")
def conditional_mixed_effects(t):
    """A marker alone and given another marker, both in the mixed model."""
    other = dosage_of(t, "M12").select("sample", F.col("dosage").cast("double").alias("o"))
    cells, sums = one_marker_cells(t).join(other, "sample"), products_for(t)
    alone = M.one_marker_tests(cells, ["trait"], *sums, n_pcs=3, min_homozygotes=1).select("trait", "n_observations", r("effect").alias("effect_alone"), r("p_value", 6).alias("p_alone"))
    given = M.one_marker_tests(cells, ["trait"], *sums, n_pcs=3, min_homozygotes=1, covariates=["o"]).select("trait", r("effect").alias("effect_given"), r("p_value", 6).alias("p_given"))
    return alone.join(given, "trait")


# ---------------------------------------------------------------- expression, profiles, linkage
_TPM = f"(SELECT 'g' || (l_partkey % 20) AS gene, sample, avg(l_extendedprice) / 1000 AS tpm FROM {R._LINES} x GROUP BY 1, 2)"


def expression(t):
    return R._lines(t, "l_partkey", "l_extendedprice").groupBy(F.concat(F.lit("g"), F.col("l_partkey") % 20).alias("gene"), "sample").agg(
        (F.avg("l_extendedprice") / 1000).alias("tpm"))


def _eqtl(t, scale):
    d = dosage_of(t, "M7").select("sample", F.col("dosage").cast("double").alias("x"))
    y = F.col("tpm") if scale == "raw" else S.log2_plus_one(F.col("tpm"))
    return X.ols_effects(expression(t).withColumn("y", y).join(d, "sample"), ["gene"], "y", ["x"], min_n=40)


@query("expression_sweep", f"""SELECT gene, count(*) AS n, {q("regr_slope(log2(tpm + 1), dosage)")} AS effect FROM {_TPM} e JOIN (SELECT sample, dosage FROM {R.DOSAGE} d WHERE marker = 'M7') m USING (sample) GROUP BY gene HAVING count(*) >= 40""")
def expression_sweep(t):
    return _eqtl(t, "log2").select("gene", "n", r("effect").alias("effect"))


@query("expression_sweep_raw", f"""SELECT gene, count(*) AS n, {q("regr_slope(tpm, dosage)")} AS effect FROM {_TPM} e JOIN (SELECT sample, dosage FROM {R.DOSAGE} d WHERE marker = 'M7') m USING (sample) GROUP BY gene HAVING count(*) >= 40""")
def expression_sweep_raw(t):
    return _eqtl(t, "raw").select("gene", "n", r("effect").alias("effect"))


@query("expression_mixed_sweep")
def expression_mixed_sweep(t):
    """Every gene's expression, on the log and the raw scale, against one marker in the mixed model."""
    e = expression(t).select("gene", "sample", F.explode(F.create_map(F.lit("log2"), S.log2_plus_one(F.col("tpm")), F.lit("raw"), F.col("tpm"))).alias("scale", "y"))
    cells = e.join(dosage_of(t, "M7").select("sample", "dosage"), "sample")
    s = M.one_marker_tests(cells, ["gene", "scale"], *products_for(t), n_pcs=3, min_samples=40, min_homozygotes=1)
    return s.select("gene", "scale", "n_observations", "status", r("effect").alias("effect"), r("p_value", 6).alias("p_value"))


@query("gene_test_table", f"""SELECT gene, {q("regr_slope(log2(tpm + 1), dosage)")} AS log2_effect, {q("regr_slope(tpm, dosage)")} AS raw_effect, count(*) AS log2_n, count(*) AS raw_n FROM {_TPM} e JOIN (SELECT sample, dosage FROM {R.DOSAGE} d WHERE marker = 'M7') m USING (sample) GROUP BY gene HAVING count(*) >= 40""")
def gene_test_table(t):
    g = X.test_table({"log2": _eqtl(t, "log2"), "raw": _eqtl(t, "raw")}, "gene", ["effect", "n"])
    return g.withColumns({"log2_effect": r("log2_effect"), "raw_effect": r("raw_effect")})


@query("profile_scan")
def profile_scan(t):
    """Order profile of every sample (mean price per line number), z-scored per bin, alone and given a marker."""
    samples, v = panel(t)
    p = R._lines(t, "l_linenumber", "l_extendedprice").groupBy("sample", F.concat(F.lit("b"), "l_linenumber").alias("trait")).agg(F.avg("l_extendedprice").alias("value"))
    bins = sorted(row[0] for row in p.select("trait").distinct().collect())  # bins of one profile
    y = M.trait_matrix(p, samples, bins)
    keep = M.complete(samples, y, drop=True)
    y = M.zscored(y[keep])
    given = M.trait_matrix(dosage_of(t, "M12").select("sample", F.lit("d").alias("trait"), F.col("dosage").cast("double").alias("value")), samples, ["d"])[keep]
    lead = v.where("chrom = 3 AND pos BETWEEN 1 AND 10000000")
    products = K.raw_products(v)
    pcs, loco = K.components_of(K.kinship_from_products(sum(products.values()), keep), 3), K.loco_products(products)
    plain = M.scan(lead, y, bins, M.design(len(keep), pcs), keep, loco).withColumn("model", F.lit("plain"))
    cond = M.scan(lead, y, bins, M.design(len(keep), pcs, given), keep, loco).withColumn("model", F.lit("conditioned"))
    b = X.bonferroni(plain.unionByName(cond), len(bins))
    return b.select("model", "trait", "marker", r("effect", 4).alias("effect"), r("p_value", 6).alias("p_value"), "passes")


_LD = f"""(SELECT marker, chrom, pos, n_calls, r2 FROM (SELECT a.marker, a.chrom, a.pos, count(*) AS n_calls, CASE WHEN var_pop(a.dosage) > 0 THEN power(corr(a.dosage, l.dosage), 2) END AS r2
  FROM {R.DOSAGE} a JOIN (SELECT sample, dosage FROM {R.DOSAGE} d WHERE marker = 'M7') l USING (sample) GROUP BY 1, 2, 3) z WHERE n_calls >= 50)"""


@query("linkage", f"SELECT marker, chrom, pos, n_calls, {q('r2')} AS r2 FROM {_LD} l")
def linkage(t):
    return X.linkage_vectors(panel(t)[1], "M7").withColumn("r2", r("r2"))


@query("linkage_observed_pairs", f"""SELECT marker, count(*) AS n_calls, CASE WHEN var_pop(a.dosage) FILTER (WHERE l.dosage IS NOT NULL) > 0 AND var_pop(l.dosage) > 0 THEN {q("power(covar_pop(a.dosage, l.dosage), 2) / (var_pop(a.dosage) FILTER (WHERE l.dosage IS NOT NULL) * var_pop(l.dosage))")} END AS r2
  FROM {R.CALLS} a LEFT JOIN (SELECT sample, dosage FROM {R.CALLS} d WHERE marker = 'M7') l USING (sample) GROUP BY marker HAVING count(*) >= 10""")
def linkage_observed(t):
    observed = K.marker_vectors(R.calls(t), K.sample_list(R._lines(t)))
    return X.linkage_vectors(observed, "M7", min_calls=10, impute=False).select("marker", "n_calls", r("r2").alias("r2"))


@query("linkage_blocks", f"""SELECT t AS threshold, chrom, min(pos) AS "start", max(pos) AS "end", count(*) AS n_markers FROM {_LD} l, (SELECT unnest([0.8::DOUBLE, 0.05::DOUBLE, 0.02::DOUBLE]) AS t) x WHERE r2 > t GROUP BY 1, 2""")
def linkage_blocks(t):
    return X.block_extent(X.linkage_vectors(panel(t)[1], "M7"), [0.8, 0.05, 0.02])


@query("impact_tests", f"""SELECT a.marker, split_part(genes, ',', 1) AS gene, s.trait, {q("s.effect")} AS effect, {q("l.r2")} AS r2_lead FROM {_ANN} a JOIN {_SM} s USING (marker) LEFT JOIN {_LD} l USING (marker)
  WHERE a.chrom = 3 AND a.pos BETWEEN 1 AND 20000000 AND regexp_matches(impacts, 'HIGH|MODERATE')""")
def impact_tests(t):
    v = SG.impact_variants(variant_annotations(t), 3, 1, 20_000_000).select("marker", "gene")
    samples, vectors = panel(t)
    e = X.marker_trait_effects(vectors.join(v.select("marker").distinct(), "marker", "left_semi"), M.trait_matrix(R.phenotypes(t), samples, TRAITS), TRAITS)
    out = X.impact_tests(v, e.where("effect IS NOT NULL").select("trait", "marker", "effect"), X.linkage_vectors(vectors, "M7"))
    return out.select("marker", "gene", "trait", r("effect").alias("effect"), r("r2").alias("r2_lead"))
