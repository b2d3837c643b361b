"""Aggregations, grouped transforms and genomic windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A, hotspots as H, transforms as T
from ..operators.onerow import attach_row
from . import roles as R
from .registry import q, query, r
from .tables import _ANNOTATED, _EXPR, _PEAKS, annotated, expression_matrix, peaks

# ---------------------------------------------------------------- crops, plots, genotypes
@query("image_means", f"""SELECT image_no, dim::INT AS dim, {q("avg(value)", 5)} AS mean, count(*) AS n_crops FROM {R.CROPS_LONG} l GROUP BY image_no, dim""")
def image_means(t):
    m = A.image_means(R.crops(t), "image_no")
    return m.select("image_no", "n_crops", F.posexplode("features").alias("dim", "v")).select("image_no", "dim", r("v", 5).alias("mean"), "n_crops")


@query("plot_means", f"""SELECT environment, genotype, plot, "row", col, device, {q("price", 3)} AS price, {q("discount")} AS discount, {q("area")} AS area FROM {R.PLOT_MEANS} m""")
def plot_means(t):
    m = A.plot_means(R.plots(t), R.PLOT_KEYS, ["price", "discount", "tax", "area"])
    return m.select(*R.PLOT_KEYS, r("price", 3).alias("price"), r("discount").alias("discount"), r("area").alias("area"))


@query("genotype_environment_means", f"""SELECT trait || '__' || env AS combo, genotype, {q("avg(value)")} AS phenotype FROM {R.OBS} o GROUP BY trait, env, genotype""")
def genotype_environment_means(t):
    o = R.observations(t)
    return o.groupBy("trait", "env", "genotype").agg(F.avg("value").alias("v")).select(F.concat_ws("__", "trait", "env").alias("combo"), "genotype", r("v").alias("phenotype"))


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("phenotype_table", f"""SELECT genotype, {", ".join(f"{q(f'avg(value) FILTER (WHERE trait = {chr(39)}{c}{chr(39)})')} AS {c}" for c in _TYPES)} FROM {R.OBS} o GROUP BY genotype""")
def phenotype_table(t):
    wide = R.observations(t).groupBy("genotype").pivot("trait", _TYPES).agg(F.avg("value"))
    return wide.select("genotype", *[r(c).alias(c) for c in _TYPES])


@query("genotype_summary", f"""SELECT genotype, {q("avg(price)", 2)} AS mean, {q("median(price)", 3)} AS median, {q("stddev_samp(price)", 2)} AS sd,
  {q("stddev_samp(price) / avg(price)")} AS cv, count(*) AS n FROM {R.PLOTS} p GROUP BY genotype""")
def genotype_summary(t):
    g = A.genotype_summary(R.plots(t), ["genotype"], "price")
    return g.select("genotype", r("mean", 2).alias("mean"), r("median", 3).alias("median"), r("sd", 2).alias("sd"), r("cv").alias("cv"), "n")


@query("plot_span", f"""SELECT environment, plot, min(area) AS low, max(area) AS high, max(area) - min(area) AS span FROM {R.PLOTS} p GROUP BY environment, plot""")
def plot_span(t):
    return A.value_span(R.plots(t), ["environment", "plot"], "area")


@query("pooled_fraction", f"""WITH c AS (SELECT env, genotype, avg(value) FILTER (WHERE trait = 'purchase') AS purchase, avg(value) FILTER (WHERE trait = 'click') AS click FROM {R.OBS} o GROUP BY env, genotype),
  d AS (SELECT *, purchase - click AS rest, (purchase - click) / nullif(purchase, 0) AS f FROM c WHERE purchase IS NOT NULL AND click IS NOT NULL)
  SELECT genotype, {q("avg(purchase)")} AS purchase, {q("avg(click)")} AS click, {q("avg(rest)")} AS rest, {q("avg(f)", 3)} AS rest_frac FROM d GROUP BY genotype""")
def pooled_fraction(t):
    p = A.pooled_fraction(R.observations(t), "purchase", "click")
    return p.select("genotype", r("purchase").alias("purchase"), r("click").alias("click"), r("rest").alias("rest"), r("rest_frac", 3).alias("rest_frac"))


@query("expression_means", f"""SELECT e.gene, g.genotype, {q("avg(log2(e.tpm + 1))")} AS level FROM {_EXPR} e JOIN (SELECT DISTINCT p_brand AS sample, 'L' || (length(p_brand) + substr(p_brand, 7)::INT % 8) AS genotype FROM part) g USING (sample) GROUP BY e.gene, g.genotype""")
def expression_means(t):
    from ..sources.genome import expression_long

    smap = t.part.select(F.col("p_brand").alias("sample")).distinct().withColumn(
        "genotype", F.concat(F.lit("L"), F.length("sample") + F.substring("sample", 7, 9).cast("int") % 8))
    e = expression_long(expression_matrix(t)).dropna().join(smap, "sample")
    return e.groupBy("gene", "genotype").agg(r(F.avg(S.log2_plus_one(F.col("tpm")))).alias("level"))


_AUDIT = """(SELECT d.doc_id, CASE WHEN d.lang = 'en' THEN 'east' ELSE d.lang END AS environment, coalesce(l.toxic = 1, FALSE) AS excluded,
  d.n_chars < 60 AS ungenotyped, p.page_id IS NOT NULL OR l.quality = 1 AS embedded, d.source = 'src1' AS explained_failure
  FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id
  LEFT JOIN pages p ON p.page_id = d.doc_id)"""


def audit_images(t):
    lab = t.labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    pages = t.pages.select(F.col("page_id").alias("doc_id"), F.lit(True).alias("has_page"))
    d = t.documents.select("doc_id", "lang", "source", "n_chars").join(lab, "doc_id", "left").join(pages, "doc_id", "left")
    false = F.lit(False)
    return d.select(
        "doc_id", F.when(F.col("lang") == "en", "east").otherwise(F.col("lang")).alias("environment"),
        F.coalesce(F.col("toxic") == 1, false).alias("excluded"), (F.col("n_chars") < 60).alias("ungenotyped"),
        (F.coalesce("has_page", false) | F.coalesce(F.col("quality") == 1, false)).alias("embedded"), (F.col("source") == "src1").alias("explained_failure"),
    )


_E = "NOT excluded AND NOT ungenotyped"


@query("coverage_audit", f"""SELECT coalesce(environment, 'TOTAL') AS environment, count(*) AS metadata_total, count(*) FILTER (WHERE excluded) AS excluded,
  count(*) FILTER (WHERE ungenotyped AND NOT excluded) AS ungenotyped, count(*) FILTER (WHERE {_E}) AS expected,
  count(*) FILTER (WHERE {_E} AND coalesce(embedded, FALSE)) AS embedded, count(*) FILTER (WHERE {_E} AND NOT coalesce(embedded, FALSE) AND explained_failure) AS missing_failed,
  count(*) FILTER (WHERE {_E} AND NOT coalesce(embedded, FALSE) AND NOT explained_failure) AS missing_unexplained FROM {_AUDIT} a GROUP BY ROLLUP (environment)""")
def coverage_audit(t):
    return A.coverage_audit(audit_images(t), "environment")


@query("unexplained_missing", f"SELECT doc_id, environment FROM {_AUDIT} a WHERE {_E} AND NOT coalesce(embedded, FALSE) AND NOT explained_failure")
def unexplained_missing(t):
    return A.unexplained_missing(audit_images(t)).select("doc_id", "environment")


@query("allele_counts", f"""SELECT marker, count(*) AS n_marker_nonmissing, count(*) FILTER (WHERE dosage = 0) AS n_ref_homozygote,
  count(*) FILTER (WHERE dosage = 1) AS n_heterozygote, count(*) FILTER (WHERE dosage = 2) AS n_alt_homozygote FROM {R.CALLS} c GROUP BY marker""")
def allele_counts(t):
    return A.allele_counts(R.calls(t), ["marker"])


@query("allele_mean_se", f"""SELECT environment, allele, {q("avg(price)", 2)} AS mean, {q("stddev_samp(price) / sqrt(count(price))", 3)} AS se, count(price) AS n
  FROM (SELECT *, device % 3 AS allele FROM {R.PLOTS} p) x GROUP BY environment, allele""")
def allele_mean_se(t):
    m = A.mean_se(R.plots(t).withColumn("allele", F.col("device") % 3), ["environment", "allele"], "price")
    return m.select("environment", "allele", r("mean", 2).alias("mean"), r("se", 3).alias("se"), "n")


_BLUEISH = f"""(SELECT environment, genotype, avg(price) AS value FROM {R.PLOTS} p GROUP BY environment, genotype)"""


@query("allele_medians_by_category", f"""WITH b AS {_BLUEISH}, s AS (SELECT genotype FROM b WHERE environment = 'A' INTERSECT SELECT genotype FROM b WHERE environment IN ('N', 'R')),
  x AS (SELECT environment AS category, genotype, value FROM b UNION ALL SELECT 'shared', genotype, value FROM b WHERE environment = 'A' AND genotype IN (SELECT genotype FROM s)),
  y AS (SELECT category, CASE WHEN s_acctbal > 5000 THEN 'ALT' ELSE 'REF' END AS allele, value FROM x JOIN supplier ON genotype = 'S' || s_suppkey)
  SELECT category, allele, {q("median(value)", 2)} AS median, count(*) AS n, CASE WHEN count(*) > 1 THEN {q("stddev_samp(value) / sqrt(count(*))", 2)} ELSE 0.0::DOUBLE END AS se FROM y GROUP BY category, allele""")
def allele_medians_by_category(t):
    b = R.plots(t).groupBy("environment", "genotype").agg(F.avg("price").alias("value"))
    shared = b.where("environment = 'A'").select("genotype").intersect(b.where("environment IN ('N', 'R')").select("genotype"))
    x = b.withColumnRenamed("environment", "category").unionByName(
        b.where("environment = 'A'").join(shared, "genotype", "left_semi").select(F.lit("shared").alias("category"), "genotype", "value"))
    allele = t.supplier.select(F.concat(F.lit("S"), "s_suppkey").alias("genotype"), F.when(F.col("s_acctbal") > 5000, "ALT").otherwise("REF").alias("allele"))
    g = A.genotype_summary(x.join(allele, "genotype"), ["category", "allele"], "value")
    se = F.when(F.col("n") > 1, r(F.col("sd") / F.sqrt("n"), 2)).otherwise(0.0)
    return g.select("category", "allele", r("median", 2).alias("median"), "n", se.alias("se"))


# ---------------------------------------------------------------- variance tables
_PARTS = """(SELECT 'T' || l_suppkey AS trait, l_shipmode_src AS source, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY l_suppkey) AS proportion_variance
  FROM (SELECT l_suppkey, CASE l_linenumber WHEN 1 THEN 'genotype' WHEN 2 THEN 'row' WHEN 3 THEN 'column' WHEN 4 THEN 'block' WHEN 5 THEN 'device' WHEN 6 THEN 'Residual' ELSE 'elsewhere' END AS l_shipmode_src FROM lineitem) z
  GROUP BY l_suppkey, l_shipmode_src)"""
# Categories of variance sources.
CATEGORIES = {"genotype": "Genotype", "row": "Spatial", "column": "Spatial", "block": "Spatial", "device": "Device", "Residual": "Residual"}


def variance_parts(t):
    names = F.array(*[F.lit(s) for s in ("genotype", "row", "column", "block", "device", "Residual")])
    src = F.coalesce(F.get(names, F.col("l_linenumber") - 1), F.lit("elsewhere"))
    c = t.lineitem.groupBy("l_suppkey", src.alias("source")).agg(F.count(F.lit(1)).alias("n"))
    tot = c.groupBy("l_suppkey").agg(F.sum("n").alias("tot"))
    return c.join(tot, "l_suppkey").select(F.concat(F.lit("T"), "l_suppkey").alias("trait"), "source", (F.col("n") / F.col("tot")).alias("proportion_variance"))


@query("variance_by_category", f"""SELECT trait, CASE WHEN source IN ('row', 'column', 'block') THEN 'Spatial' WHEN source = 'genotype' THEN 'Genotype' WHEN source = 'device' THEN 'Device'
  WHEN source = 'Residual' THEN 'Residual' ELSE 'Other' END AS category, {q("sum(proportion_variance)")} AS proportion_variance FROM {_PARTS} v GROUP BY 1, 2""")
def variance_by_category(t):
    return A.variance_by_category(variance_parts(t), CATEGORIES).withColumn("proportion_variance", r("proportion_variance"))


_HEAT = ["A", "N", "R"]


@query("heat_matrix", f"""SELECT genotype, {", ".join(f"{q(f'avg(price) FILTER (WHERE environment = {chr(39)}{e}{chr(39)})', 2)} AS {e}" for e in _HEAT)} FROM {R.PLOTS} p GROUP BY genotype""")
def heat_matrix(t):
    return R.plots(t).groupBy("genotype").pivot("environment", _HEAT).agg(F.avg("price")).select("genotype", *[r(e, 2).alias(e) for e in _HEAT])


@query("threshold_counts", f"""SELECT t AS threshold, (SELECT count(*) FROM {R.ASSOC} a WHERE p_value >= t) AS n_at_or_above FROM (SELECT (i * 0.0025)::DOUBLE AS t FROM range(300) g(i)) x""")
def threshold_counts(t):
    return A.threshold_counts(R.associations(t), "p_value", [round(i * 0.0025, 4) for i in range(300)])


@query("harmonic_replication", f"""SELECT environment, {q("count(*) / sum(1.0 / n)")} AS hmean FROM (SELECT environment, genotype, count(*) AS n FROM {R.PLOTS} p GROUP BY environment, genotype) x GROUP BY environment""")
def harmonic_replication(t):
    n = R.plots(t).groupBy("environment", "genotype").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("environment").agg(r(A.harmonic_mean("n")).alias("hmean"))


@query("profile_means", f"""SELECT genotype, dim::INT AS bin, {q("avg(value)", 5)} AS mean, {q("stddev_samp(value) / sqrt(count(*))", 5)} AS se, count(*) AS n FROM {R.CROPS_LONG} l GROUP BY genotype, dim""")
def profile_means(t):
    m = A.profile_means(R.crops(t), ["genotype"], "features")
    return m.select("genotype", "bin", r("mean", 5).alias("mean"), r("se", 5).alias("se"), "n")


@query("pooled_tokens", f"""SELECT genotype, dim::INT AS dim, {q("avg(value)", 5)} AS embedding_mean, {q("stddev_samp(value)", 5)} AS embedding_std FROM {R.CROPS_LONG} l GROUP BY genotype, dim""")
def pooled_tokens(t):
    p = A.pooled_tokens(R.crops(t), ["genotype"], "features")
    z = p.select("genotype", F.posexplode(F.arrays_zip("embedding_mean", "embedding_std")).alias("dim", "z"))
    return z.select("genotype", "dim", r("z.embedding_mean", 5).alias("embedding_mean"), r("z.embedding_std", 5).alias("embedding_std"))


@query("percent_below_index", f"""SELECT image, {q("100 * avg(((2 * g - r - b) / nullif(r + g + b, 0) < 0.2)::INT)", 3)} AS percent FROM {R.POINTS} p GROUP BY image""")
def percent_below_index(t):
    p = A.percent_below(R.points(t), ["image"], S.excess_green(F.col("r"), F.col("g"), F.col("b")), 0.2)
    return p.withColumn("percent", r("percent", 3))


@query("five_numbers", f"""SELECT environment, min(price) AS minimum, {q("quantile_cont(price, 0.25)", 3)} AS q1, {q("median(price)", 3)} AS median, {q("quantile_cont(price, 0.75)", 3)} AS q3, max(price) AS maximum FROM {R.PLOTS} p GROUP BY environment""")
def five_numbers(t):
    f = A.five_numbers(R.plots(t), ["environment"], "price")
    return f.select("environment", "minimum", *[r(c, 3).alias(c) for c in ("q1", "median", "q3")], "maximum")


@query("histogram", f"""SELECT trait, least(floor(p_value / (1.0::DOUBLE / 30)), 29)::INT AS bin, count(*) AS n FROM {R.ASSOC} a WHERE p_value BETWEEN 0 AND 1 GROUP BY 1, 2""")
def histogram(t):
    return A.histogram(R.associations(t), "p_value", 0.0, 1.0, 30, ["trait"])


@query("fold_accuracy", f"""SELECT l_returnflag AS model, l_linestatus AS predictors, {q("avg(r)", 5)} AS mean, {q("stddev_samp(r) / sqrt(count(*))", 5)} AS se, count(*) AS n
  FROM (SELECT l_returnflag, l_linestatus, l_linenumber, avg(l_discount) AS r FROM lineitem GROUP BY ALL) x GROUP BY 1, 2""")
def fold_accuracy(t):
    f = t.lineitem.groupBy(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("predictors"), "l_linenumber").agg(F.avg("l_discount").alias("v"))
    m = A.mean_se(f, ["model", "predictors"], "v")
    return m.select("model", "predictors", r("mean", 5).alias("mean"), r("se", 5).alias("se"), "n")


_REP = f"""(SELECT s_nationkey % 3 AS cls, genotype, avg(price) AS trait, avg(tax) AS level FROM {R.PLOTS} p JOIN supplier ON genotype = 'S' || s_suppkey GROUP BY 1, 2)"""


@query("representative_group", f"""WITH g AS {_REP}, e AS (SELECT quantile_cont(level, 0.4) AS edge FROM g), m AS (SELECT cls, median(trait) AS med FROM g GROUP BY cls)
  SELECT cls, arg_min(genotype, abs(trait - med)) AS genotype, {q("arg_min(trait, abs(trait - med))", 2)} AS trait FROM g JOIN m USING (cls), e WHERE level <= edge GROUP BY cls""")
def representative_group(t):
    cls = t.supplier.select(F.concat(F.lit("S"), "s_suppkey").alias("genotype"), (F.col("s_nationkey") % 3).alias("cls"))
    g = R.plots(t).groupBy("genotype").agg(F.avg("price").alias("trait"), F.avg("tax").alias("level")).join(cls, "genotype")
    return A.representative_group(g, "cls", "genotype", "trait", "level").select("cls", "genotype", r("trait", 2).alias("trait"))


@query("files_per_group", f"""SELECT DISTINCT genotype, image_id || '.png' AS file FROM {R.CROPS} c""")
def files_per_group(t):
    return R.crops(t).select("genotype", F.concat("image_id", F.lit(".png")).alias("file")).distinct().orderBy("genotype", "file")


@query("genotype_contrast", f"""SELECT genotype, {q("avg(price / 1000 - area)")} AS contrast, count(*) AS n_leaves FROM {R.PLOTS} p GROUP BY genotype""")
def genotype_contrast(t):
    return R.plots(t).groupBy("genotype").agg(r(F.avg(F.col("price") / 1000 - F.col("area"))).alias("contrast"), F.count(F.lit(1)).alias("n_leaves"))


# ---------------------------------------------------------------- windows and peaks
W_BP = 100_000
_HITS = f"(SELECT * FROM {R.ASSOC} a WHERE p_value < 0.05)"


def hits(t):
    return R.associations(t).where("p_value < 0.05")


_FIXED = f"(SELECT chrom, pos // {W_BP} AS \"window\", count(DISTINCT trait) AS n_traits FROM {_HITS} h GROUP BY 1, 2)"


@query("fixed_windows", f'SELECT chrom, "window", n_traits, "window" * {W_BP} AS window_start FROM {_FIXED} f')
def fixed_windows(t):
    return H.fixed_windows(hits(t), W_BP)


_LENGTHS = f"(SELECT chrom, max(pos) + 30000 AS max_bp FROM {R.MARKERS} m GROUP BY chrom)"


def lengths(t):
    return R.markers(t).groupBy("chrom").agg((F.max("pos") + 30000).alias("max_bp"))


@query("sliding_windows", f"""WITH g AS (SELECT chrom, max_bp, unnest(range(0, (max_bp - 1) // 20000 + 1)) AS "window" FROM {_LENGTHS} l),
  h AS (SELECT chrom, trait, unnest(range(greatest((pos - 100000 + 20000) // 20000, 0), pos // 20000 + 1)) AS "window" FROM {_HITS} h WHERE pos >= 80000
    UNION ALL SELECT chrom, trait, unnest(range(0, pos // 20000 + 1)) FROM {_HITS} h WHERE pos < 80000),
  c AS (SELECT chrom, "window", count(DISTINCT trait) AS n FROM h GROUP BY 1, 2)
  SELECT g.chrom, g."window", g."window" * 20000 AS window_start, least(g."window" * 20000 + 99999, max_bp) AS window_end, coalesce(n, 0) AS n_traits FROM g LEFT JOIN c ON g.chrom = c.chrom AND g."window" = c."window" """)
def sliding_windows(t):
    return H.sliding_windows(hits(t), lengths(t))


_FLAG = 3
_MERGED = f"""(SELECT chrom, min(s) AS "start", max(s) + {W_BP} - 1 AS "end", max(n_traits) AS max_traits, count(*) AS n_windows FROM (
  SELECT *, sum(brk) OVER (PARTITION BY chrom ORDER BY s) AS island FROM (SELECT chrom, "window" * {W_BP} AS s, n_traits,
  CASE WHEN "window" * {W_BP} - lag("window" * {W_BP} + {W_BP} - 1) OVER (PARTITION BY chrom ORDER BY "window") > 200000 THEN 1 ELSE 0 END AS brk
  FROM {_FIXED} f WHERE n_traits >= {_FLAG}) x) y GROUP BY chrom, island)"""


def merged(t):
    return H.merge_windows(H.fixed_windows(hits(t), W_BP), W_BP, min_traits=_FLAG)


@query("hotspot_peaks", f"""SELECT m.chrom, m."start", m."end", max_traits, n_windows, arg_min(pos, (p_value, pos)) AS top_marker_pos, {q("min(p_value)", 6)} AS top_marker_p
  FROM {_MERGED} m JOIN {_HITS} h ON h.chrom = m.chrom AND h.pos BETWEEN m."start" AND m."end" GROUP BY ALL""")
def hotspot_peaks(t):
    return H.with_top_marker(merged(t), hits(t)).withColumn("top_marker_p", r("top_marker_p", 6))


_FIXED_B = f"(SELECT chrom, pos // {W_BP} AS \"window\", count(DISTINCT trait) AS n_traits FROM {R.ASSOC} h WHERE p_value BETWEEN 0.05 AND 0.09 GROUP BY 1, 2)"


def windows_b(t):
    return H.fixed_windows(R.associations(t).where("p_value BETWEEN 0.05 AND 0.09"), W_BP)


@query("paired_windows", f"""SELECT coalesce(a.chrom, b.chrom) AS chrom, coalesce(a."window", b."window") AS "window", coalesce(a.n_traits, 0) AS n_a, coalesce(b.n_traits, 0) AS n_b
  FROM {_FIXED} a FULL JOIN {_FIXED_B} b ON a.chrom = b.chrom AND a."window" = b."window" """)
def paired_windows(t):
    return H.paired_windows(H.fixed_windows(hits(t), W_BP), windows_b(t))


@query("other_model_maximum", f"""SELECT m.chrom, m."start", max_traits, coalesce(max(b.n_traits), 0) AS max_b FROM {_MERGED} m LEFT JOIN {_FIXED_B} b
  ON b.chrom = m.chrom AND b."window" * {W_BP} BETWEEN m."start" AND m."end" GROUP BY ALL""")
def other_model_maximum(t):
    return H.other_model_maximum(merged(t), windows_b(t)).select("chrom", "start", "max_traits", "max_b")


@query("window_labels", f"""SELECT f.chrom, f."window", min(peak) AS peak FROM {_FIXED} f LEFT JOIN {_PEAKS} k ON k.chrom = f.chrom AND f."window" * {W_BP} BETWEEN k."start" AND k."end" GROUP BY 1, 2""")
def window_labels(t):
    return H.label_windows(H.fixed_windows(hits(t), W_BP), peaks(t)).select("chrom", "window", "peak")


@query("hit_summary", f"""SELECT (SELECT count(*) FROM {_HITS} h) AS n_hits, (SELECT count(DISTINCT trait) FROM {_HITS} h) AS n_traits, (SELECT max(n_traits) FROM {_FIXED} f) AS busiest""")
def hit_summary(t):
    h = hits(t)
    a = h.agg(F.count(F.lit(1)).alias("n_hits"), F.count_distinct("trait").alias("n_traits"))
    return attach_row(a, H.fixed_windows(h, W_BP).agg(F.max("n_traits").alias("busiest")))


@query("trait_summary", f"""SELECT trait, count(*) AS n_tested, {q("min(p_value)", 8)} AS min_p, count(*) FILTER (WHERE p_value <= 0.001) AS n_significant, 0.001::DOUBLE AS threshold FROM {R.ASSOC} a GROUP BY trait""")
def trait_summary(t):
    from ..operators.testing import trait_summary as ts

    return ts(R.associations(t), 0.001).withColumn("min_p", r("min_p", 8))


# ---------------------------------------------------------------- peak sets per trait
_BIGPEAKS = """(SELECT 'P' || r_regionkey AS peak, (r_regionkey + 1)::INT AS chrom, r_regionkey * 1000000 AS "start", r_regionkey * 1000000 + 700000 AS "end" FROM region)"""


def big_peaks(t):
    k = F.col("r_regionkey").cast("long")
    return t.region.select(F.concat(F.lit("P"), "r_regionkey").alias("peak"), (k + 1).cast("int").alias("chrom"), (k * 1_000_000).alias("start"), (k * 1_000_000 + 700_000).alias("end"))


_PAIRS = f"""(SELECT DISTINCT trait, peak FROM {_HITS} h JOIN {_BIGPEAKS} k ON k.chrom = h.chrom AND h.pos BETWEEN k."start" AND k."end")"""
_SETS = f"(SELECT trait, count(*) AS n_peaks, string_agg(peak, ',' ORDER BY peak) AS peaks FROM {_PAIRS} p GROUP BY trait)"


def pairs(t):
    return H.trait_sets(hits(t), big_peaks(t))


@query("peaks_per_trait", f"SELECT * FROM {_SETS} s")
def peaks_per_trait(t):
    return H.sets_per_trait(pairs(t))


_P = ["P0", "P1", "P2", "P3", "P4"]


@query("presence_matrix", f"""SELECT trait, {", ".join(f"count(*) FILTER (WHERE peak = '{p}') AS {p}" for p in _P)} FROM {_PAIRS} p GROUP BY trait""")
def presence_matrix(t):
    return pairs(t).groupBy("trait").pivot("peak", _P).agg(F.count(F.lit(1))).fillna(0)


@query("identical_sets", f"SELECT peaks, count(*) AS n_traits, min(trait) AS first_trait FROM {_SETS} s GROUP BY peaks")
def identical_sets(t):
    return H.identical_sets(pairs(t))


@query("set_distances", f"""WITH s AS (SELECT DISTINCT peaks, string_split(peaks, ',') AS l FROM {_SETS} z)
  SELECT a.peaks AS set_a, b.peaks AS set_b, {q("1 - len(list_intersect(a.l, b.l)) / (len(a.l) + len(b.l) - len(list_intersect(a.l, b.l)))")} AS distance FROM s a JOIN s b ON a.peaks < b.peaks""")
def set_distances(t):
    return H.set_distances(pairs(t)).withColumn("distance", r("distance"))


@query("similar_sets", f"""WITH s AS (SELECT trait, string_split(peaks, ',') AS l FROM {_SETS} z), p AS (SELECT a.trait AS set_a, b.trait AS set_b, len(list_intersect(a.l, b.l)) AS shared, len(a.l) + len(b.l) AS n FROM s a JOIN s b ON a.trait < b.trait)
  SELECT set_a, set_b, shared::INT AS shared, {q("shared / (n - shared)")} AS similarity FROM p WHERE shared >= 0.6 * (n - shared)""")
def similar_sets(t):
    """Traits whose peak sets are alike to 0.6 or more."""
    sets = H.sets_per_trait(pairs(t)).select("trait", F.split("peaks", ",").alias("members"))
    return H.set_join(sets, 0.6, "trait").withColumn("similarity", r("similarity"))


# ---------------------------------------------------------------- grouped transforms
@query("winsorize", f"""WITH e AS (SELECT environment, quantile_cont(price, 0.05) AS lo, quantile_cont(price, 0.95) AS hi FROM {R.PLOTS} p GROUP BY environment)
  SELECT environment, genotype, {q("avg(least(greatest(price, lo), hi))", 2)} AS mean FROM {R.PLOTS} p JOIN e USING (environment) GROUP BY environment, genotype""")
def winsorize(t):
    w = T.winsorize(R.plots(t), ["environment"], "price", 0.05)
    return w.groupBy("environment", "genotype").agg(r(F.avg("price"), 2).alias("mean"))


@query("zscore", f"""SELECT image_no, environment, {q("(score - avg(score) OVER w) / nullif(stddev_pop(score) OVER w, 0)")} AS z FROM {R.SCORES} s WINDOW w AS (PARTITION BY environment)""")
def zscore(t):
    return T.zscore(R.scores(t), ["environment"], "score", "z").select("image_no", "environment", r("z").alias("z"))


@query("nested_zscores", f"""WITH z AS (SELECT environment, genotype, plot, (area - avg(area) OVER w) / stddev_samp(area) OVER w AS z FROM {R.PLOT_MEANS} p WINDOW w AS (PARTITION BY environment))
  SELECT genotype, plot, environment, {", ".join(f"{q(f'CASE WHEN environment = {chr(39)}{e}{chr(39)} THEN z ELSE 0 END')} AS area_{e}" for e in _HEAT)} FROM z""")
def nested_zscores(t):
    z = T.nested_zscores(A.plot_means(R.plots(t), R.PLOT_KEYS, ["area"]), "environment", "area", _HEAT, "area")
    return z.select("genotype", "plot", "environment", *[r(f"area_{e}").alias(f"area_{e}") for e in _HEAT])


@query("standardize_on_fit", f"""WITH s AS (SELECT dim, avg(value) AS m, stddev_pop(value) AS sd FROM {R.CROPS_LONG} l WHERE genotype NOT IN ('G3', 'G7') GROUP BY dim)
  SELECT vec_id, dim::INT AS dim, {q("(value - m) / sd")} AS z FROM {R.CROPS_LONG} l JOIN s USING (dim)""")
def standardize_on_fit(t):
    df = R.crops(t).withColumn("fit", ~F.col("genotype").isin("G3", "G7"))
    z = T.standardize_on_fit(df, "features", "fit", "z")
    return R.features_long(z, "vec_id", vec="z").select("vec_id", "dim", r("value").alias("z"))


@query("group_holdout")
def group_holdout(t):
    f = T.with_fit_flag(R.crops(t), "genotype", 0.2, 0)
    return f.groupBy("genotype").agg(F.min("is_fit").alias("is_fit"), F.count(F.lit(1)).alias("n"))


@query("group_kfold")
def group_kfold(t):
    return T.group_kfold(R.crops(t), "genotype", 3).groupBy("fold").agg(F.count_distinct("genotype").alias("n_groups"), F.count(F.lit(1)).alias("n"))


@query("hashed_folds")
def hashed_folds(t):
    return T.hashed_folds(R.plots(t).select("genotype"), "genotype", 5, 2).groupBy("repeat", "fold").agg(F.count_distinct("genotype").alias("n_groups"), F.count(F.lit(1)).alias("n"))
