"""Sources, schema rules, filters, joins and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K, scalars as S
from ..functions.fingerprint import list_digest, set_fingerprint
from ..operators import joins as J, schema as SC
from ..operators.ranking import value_ranks
from ..session import scratch_folder
from ..sources import files as SF, genome as SG, vectors as SV
from . import roles as R
from .registry import q, query, r

# ---------------------------------------------------------------- sources
WIDE = [f"embedding_mean_{i}" for i in range(64)]


def wide_crops(t):
    return SV.spread_features(R.crops(t).drop("image_no", "image_id"), WIDE)


@query("vector_table", f"""SELECT vec_id, crop_index, genotype, {q("list_sum(features)", 3)} AS total,
  {q("features[1]", 5)} AS first_value, {q("features[64]", 5)} AS last_value, 64 AS n_features FROM {R.CROPS} c""")
def vector_table(t):
    df = SV.assemble_features(wide_crops(t), r"^embedding_mean_\d+$")
    d = F.transform("features", lambda x: x.cast("double"))
    return df.select(
        "vec_id", "crop_index", "genotype", r(F.aggregate(d, F.lit(0.0), lambda a, x: a + x), 3).alias("total"),
        r(F.col("features")[0], 5).alias("first_value"), r(F.col("features")[63], 5).alias("last_value"),
        F.size("features").alias("n_features"),
    )


@query("source_schema_union", f"""SELECT image_path, crop_index, genotype, NULL::VARCHAR AS device FROM {R.CROPS} c
  UNION ALL SELECT image_path, crop_index, NULL AS genotype, 'D' || (image_no % 3) AS device FROM {R.CROPS} c""")
def source_schema_union(t):
    c = R.crops(t)
    one = c.select("image_path", "crop_index", "genotype")
    two = c.select("image_path", F.concat(F.lit("D"), F.col("image_no") % 3).alias("device"))
    return SV.union_source_schemas(one, two).select("image_path", "crop_index", "genotype", "device")


@query("region_markers", f"""SELECT marker, pos, ref, alt FROM {R.MARKERS} m WHERE chrom = 2 AND pos BETWEEN 100000 AND 9000000""")
def region_markers(t):
    return R.markers(t).where((F.col("chrom") == 2) & F.col("pos").between(100_000, 9_000_000)).select("marker", "pos", "ref", "alt")


_RAW_OBS = """(SELECT event_type AS canonical_name, CASE WHEN event_id % 19 = 0 THEN NULL ELSE 'E' || (user_id % 5) END AS env_id,
  'U ' || user_id AS genotype, CASE WHEN event_id % 17 = 0 THEN 'n/a' ELSE value::VARCHAR END AS value FROM events)"""


def raw_observations(t):
    e = F.col("event_id")
    return t.events.select(
        F.col("event_type").alias("canonical_name"),
        F.when(e % 19 != 0, F.concat(F.lit("E"), F.col("user_id") % 5)).alias("env_id"),
        F.concat(F.lit("U "), "user_id").alias("genotype"),
        F.when(e % 17 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("value"),
    )


@query("clean_observations", f"""SELECT canonical_name, env_id, replace(genotype, ' ', '') AS genotype, {q("TRY_CAST(value AS DOUBLE)", 3)} AS value
  FROM {_RAW_OBS} o WHERE env_id IS NOT NULL AND TRY_CAST(value AS DOUBLE) IS NOT NULL""")
def clean_observations(t):
    return SF.clean_observations(raw_observations(t)).withColumn("value", r("value", 3))


_EXPR = """(SELECT p_size::VARCHAR AS gene, p_brand AS sample, avg(p_retailprice) AS tpm FROM part GROUP BY p_size, p_brand)"""
BRANDS = [f"Brand#{i}" for i in range(1, 26)]


def expression_matrix(t):
    p = t.part.select(F.col("p_size").cast("string").alias("gene"), "p_brand", "p_retailprice")
    return p.groupBy("gene").pivot("p_brand", BRANDS).agg(F.avg("p_retailprice"))


@query("expression_subset", f"""SELECT gene, sample, {q("tpm")} AS tpm FROM {_EXPR} e WHERE gene IN ('3', '7', '11', '42')""")
def expression_subset(t):
    long = SG.expression_long(expression_matrix(t), ["3", "7", "11", "42"])
    return long.where(F.col("tpm").isNotNull()).withColumn("tpm", r("tpm"))


_ANN = f"""(SELECT m.chrom, m.pos, m.marker, CASE p_size % 4 WHEN 0 THEN 'HIGH,LOW' WHEN 1 THEN 'MODERATE' WHEN 2 THEN 'LOW' ELSE 'MODIFIER' END AS impacts,
  'g' || p_size || ',g' || (p_size + 1) AS genes, 'p.' || p_type || p_size || ',p.x' AS hgvs_p
  FROM part JOIN {R.MARKERS} m ON m.marker = 'M' || p_partkey)"""


def variant_annotations(t):
    m = R._marker_cols("p_partkey")
    s = F.col("p_size")
    impacts = F.when(s % 4 == 0, "HIGH,LOW").when(s % 4 == 1, "MODERATE").when(s % 4 == 2, "LOW").otherwise("MODIFIER")
    return t.part.select(
        m[1], m[2], m[0], impacts.alias("impacts"), F.concat(F.lit("g"), s, F.lit(",g"), s + 1).alias("genes"),
        F.concat(F.lit("p."), "p_type", s, F.lit(",p.x")).alias("hgvs_p"),
    )


@query("impact_variants", f"""SELECT marker, pos, impacts, split_part(genes, ',', 1) AS gene, split_part(hgvs_p, ',', 1) AS protein_change
  FROM {_ANN} a WHERE chrom = 3 AND pos BETWEEN 1 AND 20000000 AND regexp_matches(impacts, 'HIGH|MODERATE')""")
def impact_variants(t):
    return SG.impact_variants(variant_annotations(t), 3, 1, 20_000_000).select("marker", "pos", "impacts", "gene", "protein_change")


@query("exclusion_keys", "SELECT DISTINCT doc_id || '_LeafA' AS image_key FROM labels WHERE toxic = 1")
def exclusion_keys(t):
    ids = t.labels.where("toxic = 1").select(F.concat(F.lit(" "), "doc_id", F.lit("_LeafA-05_00_2.png ")).alias("image_id"))
    return SF.exclusion_keys(ids)


@query("genotype_list", "SELECT DISTINCT regexp_replace(p_name, '\\s+', '', 'g') AS genotype FROM part")
def genotype_list(t):
    return SF.id_list(t.part.select(F.col("p_name").alias("genotype")), "genotype")


_NSAMPLES = f"(SELECT DISTINCT sample FROM {R._LINES} z)"


@query("genotype_calls_from_text", f"""SELECT marker, chrom::VARCHAR AS chrom, pos, sample, dosage FROM (
  SELECT 'M' || l_partkey AS marker, l_partkey % 5 + 1 AS chrom, (l_partkey * 7919) % {R.GENOME_BP} + 1 AS pos,
    'N' || l_linenumber AS sample, least(count(*), 2)::TINYINT AS dosage FROM lineitem GROUP BY l_partkey, l_linenumber) c""")
def genotype_calls_from_text(t):
    """Call lines written as text by Spark, then read back; line number plays the sample."""
    names = [f"N{i}" for i in range(1, 8)]
    n = lambda i: F.count_if(F.col("l_linenumber") == i)
    gt = lambda i: F.when(n(i) == 0, "./.").when(n(i) == 1, "0/1").otherwise("1|1:9")
    k = F.col("l_partkey")
    lines = t.lineitem.groupBy("l_partkey").agg(*[gt(i).alias(f"s{i}") for i in range(1, 8)]).select(
        F.concat_ws("\t", k % 5 + 1, (k * 7919) % R.GENOME_BP + 1, F.concat(F.lit("M"), k), F.lit("A"), F.lit("T"),
                    F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), *[F.col(f"s{i}") for i in range(1, 8)]).alias("value")
    )
    return SG.calls_from_lines(lines, names).where("dosage IS NOT NULL").select("marker", "chrom", "pos", "sample", "dosage")


def gene_model_lines(t):
    """One gene, two transcripts and two coding parts per part row, as GFF3 text."""
    k, z = F.col("p_partkey"), F.col("p_size")
    at = (k * 7919) % R.GENOME_BP + 1
    row = lambda kind, lo, hi, attr: F.concat_ws("\t", k % 5 + 1, F.lit("src"), F.lit(kind), lo, hi, F.lit("."), F.lit("+"), F.lit("."), attr)
    gid = F.concat(F.lit("G"), k)
    return t.part.select(
        F.explode(
            F.array(
                row("gene", at, at + z * 100, F.concat(F.lit("ID="), gid, F.lit(";Name="), "p_type")),
                row("mRNA", at + 10, at + z * 100, F.concat(F.lit("ID="), gid, F.lit(".2;Parent="), gid)),
                row("mRNA", at, at + z * 90, F.concat(F.lit("ID="), gid, F.lit(".1;Parent="), gid)),
                row("CDS", at + 5, at + z * 50, F.concat(F.lit("ID="), gid, F.lit(".c1;Parent="), gid, F.lit(".1"))),
                row("CDS", at + 15, at + z * 60, F.concat(F.lit("ID="), gid, F.lit(".c2;Parent="), gid, F.lit(".2"))),
            )
        ).alias("value")
    )


@query("gene_models", f"""SELECT (p_partkey % 5 + 1)::VARCHAR AS chrom, 'G' || p_partkey AS gene, p_type AS name,
  (p_partkey * 7919) % {R.GENOME_BP} + 1 AS "start", (p_partkey * 7919) % {R.GENOME_BP} + 1 + p_size * 100 AS "end" FROM part""")
def gene_models(t):
    m = SG.gene_models_from_lines(gene_model_lines(t)).where("kind = 'gene'")
    return m.select("chrom", F.col("id").alias("gene"), "name", "start", "end")


@query("gene_parts", f"""SELECT 'G' || p_partkey AS gene, 'G' || p_partkey || '.1' AS mrna, 'CDS' AS kind,
  (p_partkey * 7919) % {R.GENOME_BP} + 6 AS "start", (p_partkey * 7919) % {R.GENOME_BP} + 1 + p_size * 50 AS "end" FROM part""")
def gene_parts(t):
    return J.gene_parts(SG.gene_models_from_lines(gene_model_lines(t))).drop("strand")


@query("genes_in_region", f"""SELECT 'G' || p_partkey AS gene, (p_partkey * 7919) % {R.GENOME_BP} + 1 AS "start" FROM part
  WHERE p_partkey % 5 + 1 = 4 AND NOT ((p_partkey * 7919) % {R.GENOME_BP} + 1 + p_size * 100 < 2000000 OR (p_partkey * 7919) % {R.GENOME_BP} + 1 > 8000000)""")
def genes_in_region(t):
    g = SG.gene_models_from_lines(gene_model_lines(t)).where("kind = 'gene' AND chrom = '4'")
    return g.where(J.overlaps(F.col("start"), F.col("end"), 2_000_000, 8_000_000)).select(F.col("id").alias("gene"), "start")


# ---------------------------------------------------------------- schema rules and filters
_PICK = [i for i in range(64) if str(i)[0] in "12"]


@query("feature_subset", f"""SELECT genotype, dim, {q("avg(value)", 5)} AS mean FROM {R.CROPS_LONG} l
  WHERE substr(dim::VARCHAR, 1, 1) IN ('1', '2') GROUP BY genotype, dim""")
def feature_subset(t):
    df = wide_crops(t)
    cols = SC.matching_columns(df, r"^embedding_mean_[12]\d?$")
    means = df.groupBy("genotype").agg(*[F.avg(c).alias(c) for c in cols])
    long = means.unpivot("genotype", cols, "name", "mean")
    return long.select("genotype", F.regexp_extract("name", r"(\d+)$", 1).cast("bigint").alias("dim"), r("mean", 5).alias("mean"))


_LABELLED = """(SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN ' bor der' WHEN 1 THEN NULL WHEN 2 THEN 'Mixed' WHEN 3 THEN 'SamplesToExclude'
  ELSE 'PI ' || c_nationkey END AS label FROM customer)"""


def labelled(t):
    k = F.col("c_custkey")
    label = (
        F.when(k % 9 == 0, " bor der").when(k % 9 == 1, None).when(k % 9 == 2, "Mixed").when(k % 9 == 3, "SamplesToExclude")
        .otherwise(F.concat(F.lit("PI "), "c_nationkey"))
    )
    return t.customer.select("c_custkey", label.alias("label"))


@query("valid_groups", f"""SELECT c_custkey, replace(label, ' ', '') AS genotype FROM {_LABELLED} x WHERE label IS NOT NULL
  AND upper(replace(label, ' ', '')) NOT IN ('BORDER','FILL','CHECK','MIXED','GENOTYPE','NAN','NA','')""")
def valid_groups(t):
    return labelled(t).where(~K.is_placeholder(F.col("label"))).select("c_custkey", K.compact_label(F.col("label")).alias("genotype"))


@query("ungenotyped", f"""SELECT label, (label IS NULL OR lower(trim(label)) IN ('', 'mixed') OR lower(label) LIKE '%exclude%') AS ungenotyped,
  count(*) AS n FROM {_LABELLED} x GROUP BY 1, 2""")
def ungenotyped(t):
    return labelled(t).groupBy("label", K.is_ungenotyped(F.col("label")).alias("ungenotyped")).agg(F.count(F.lit(1)).alias("n"))


@query("complete_rows", f"""SELECT environment, count(*) AS n, {q("avg(price)", 3)} AS mean FROM {R.PLOTS} p
  WHERE nullif(area, 13) IS NOT NULL AND nullif(tax, 0.05) IS NOT NULL GROUP BY environment""")
def complete_rows(t):
    p = R.plots(t).withColumns({"area": F.nullif("area", F.lit(13.0)), "tax": F.nullif("tax", F.lit(0.05))})
    return p.dropna(subset=["genotype", "row", "area", "tax", "price"]).groupBy("environment").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("price"), 3).alias("mean")
    )


@query("complete_vectors", f"""SELECT genotype, count(*) AS n FROM {R.CROPS} c WHERE list_min(features) > -0.3 GROUP BY genotype""")
def complete_vectors(t):
    c = R.crops(t).withColumn("features", F.transform("features", lambda x: F.when(x > -0.3, x)))
    return c.where(~F.exists("features", lambda x: x.isNull() | F.isnan(x))).groupBy("genotype").agg(F.count(F.lit(1)).alias("n"))


@query("environment_filter", """SELECT l_suppkey, count(*) AS n FROM lineitem
  WHERE coalesce(CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_returnflag END, l_linestatus) = 'A' GROUP BY l_suppkey""")
def environment_filter(t):
    df = t.lineitem.select("l_suppkey", F.when(F.col("l_linestatus") != "O", F.col("l_returnflag")).alias("environment"), F.col("l_linestatus").alias("env"))
    return df.where(F.coalesce("environment", "env") == "A").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("connected_groups", """SELECT conv_id, turn FROM conversations WHERE conv_id IN
  (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(DISTINCT role) >= 2)""")
def connected_groups(t):
    c = t.conversations
    keep = c.groupBy("conv_id").agg(F.count_distinct("role").alias("n")).where("n >= 2").select("conv_id")
    return c.join(keep, "conv_id", "left_semi").select("conv_id", "turn")


@query("varying_factors", f"""SELECT factor, n_levels FROM (SELECT 'environment' AS factor, count(DISTINCT environment) AS n_levels FROM {R.PLOTS} p
  UNION ALL SELECT 'row', count(DISTINCT "row") FROM {R.PLOTS} p UNION ALL SELECT 'device', count(DISTINCT device) FROM {R.PLOTS} p
  UNION ALL SELECT 'genotype', count(DISTINCT genotype) FROM {R.PLOTS} p UNION ALL SELECT 'constant', 1) f WHERE n_levels > 1""")
def varying_factors(t):
    return SC.varying_factors(R.plots(t).withColumn("constant", F.lit("x")), ["environment", "row", "device", "genotype", "constant"])


@query("complete_samples", f"""SELECT sample, bool_and(value > 0.0395) AS complete, count(*) AS n_traits FROM {R.PHENO} p WHERE trait LIKE 'tax%' GROUP BY sample""")
def complete_samples(t):
    p = R.phenotypes(t).where(F.col("trait").startswith("tax")).withColumn("ok", F.when(F.col("value") > 0.0395, F.col("value")))
    return p.groupBy("sample").agg((F.count("ok") == F.count(F.lit(1))).alias("complete"), F.count(F.lit(1)).alias("n_traits"))


@query("range_check", f"""SELECT image, n_pixels, CASE WHEN n_pixels < 590 THEN 'mask below minimum' WHEN n_pixels > 620 THEN 'mask above maximum' ELSE 'ok' END AS status
  FROM (SELECT image, count(*) AS n_pixels FROM {R.POINTS} p GROUP BY image) x""")
def range_check(t):
    n = F.col("n_pixels")
    return R.points(t).groupBy("image").agg(F.count(F.lit(1)).alias("n_pixels")).withColumn(
        "status", F.when(n < 590, "mask below minimum").when(n > 620, "mask above maximum").otherwise("ok")
    )


@query("find_marker", f"SELECT marker, chrom, pos, ref, alt FROM {R.MARKERS} m WHERE chrom = 3 AND pos = 55434")
def find_marker(t):
    from ..operators.association import find_marker as find

    return find(R.markers(t), "3:55434")


@query("traits_with_hits", f"""SELECT trait, count(*) AS n_rows FROM {R.ASSOC} a WHERE trait IN
  (SELECT trait FROM {R.ASSOC} b GROUP BY trait HAVING min(p_value) <= 0.0005) GROUP BY trait""")
def traits_with_hits(t):
    a = R.associations(t)
    keep = a.groupBy("trait").agg(F.min("p_value").alias("m")).where("m <= 0.0005")
    return a.join(keep, "trait", "left_semi").groupBy("trait").agg(F.count(F.lit(1)).alias("n_rows"))


@query("significance_tiers", f"""SELECT CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*' ELSE 'ns' END AS stars,
  CASE WHEN effect > 0.5 THEN 'high' WHEN effect > 0.0301 THEN 'mid' ELSE 'low' END AS tier, count(*) AS n FROM {R.ASSOC} a GROUP BY 1, 2""")
def significance_tiers(t):
    return R.associations(t).groupBy(
        S.significance_stars(F.col("p_value")).alias("stars"), S.ld_tier(F.col("effect"), 0.5, 0.0301).alias("tier")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("provenance_rollup", """SELECT l_suppkey, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN max(l_linestatus) ELSE 'mixed' END AS l_linestatus,
  CASE WHEN count(DISTINCT l_linenumber) = 1 THEN max(l_linenumber)::VARCHAR ELSE 'mixed' END AS l_linenumber FROM lineitem GROUP BY l_suppkey""")
def provenance_rollup(t):
    return SC.rolled_up_provenance(t.lineitem, ["l_suppkey"], ["l_linestatus", "l_linenumber"])


# ---------------------------------------------------------------- joins
_DESIGN = """(SELECT c_custkey || '_LeafA' AS image_key, c_mktsegment AS environment, (c_custkey % 40)::INT AS plot,
  CASE c_custkey % 11 WHEN 0 THEN 'Border' ELSE 'PI ' || c_nationkey END AS genotype FROM customer)"""


def design(t):
    k = F.col("c_custkey")
    side = t.customer.select(
        F.concat(F.lit("set/"), k, F.lit("_LeafA.png")).alias("image_id"), F.col("c_mktsegment").alias("environment"),
        (k % 40).cast("int").alias("plot"), F.when(k % 11 == 0, "Border").otherwise(F.concat(F.lit("PI "), "c_nationkey")).alias("genotype"),
    )
    return J.one_per_image(side, ["environment", "plot", "genotype"], ["plot"])


_DISEASE = """(SELECT o_custkey || '_LeafA' AS image_key, arg_min(o_totalprice, o_orderkey) / 4000 AS pct FROM orders GROUP BY o_custkey)"""


def disease(t):
    side = t.orders.select(
        F.concat("o_custkey", F.lit("_LeafA-05_00.jpg")).alias("image_id"), (F.col("o_totalprice") / 4000).alias("pct"), "o_orderkey"
    )
    return J.one_per_image(side, ["pct"], ["o_orderkey"])


_HUMAN = """(SELECT doc_id || '_LeafA' AS image_key, (quality + toxic)::DOUBLE AS human_score FROM labels)"""


def human(t):
    side = t.labels.select(F.concat("doc_id", F.lit("_LeafA")).alias("image_id"), (F.col("quality") + F.col("toxic")).cast("double").alias("human_score"), "doc_id")
    return J.one_per_image(side, ["human_score"], ["doc_id"])


_ANNOTATED = f"""(SELECT vec_id, environment, plot, replace(d.genotype, ' ', '') AS genotype, pct,
  CASE WHEN pct > 0 AND pct < 100 THEN ln(pct / (100 - pct)) END AS disease_logit, human_score
  FROM {R.CROPS} c LEFT JOIN {_DESIGN} d ON d.image_key = c.image_id LEFT JOIN {_DISEASE} e ON e.image_key = c.image_id
  LEFT JOIN {_HUMAN} h ON h.image_key = c.image_id WHERE d.genotype IS NOT NULL AND d.genotype <> 'Border')"""


def annotated(t):
    return J.annotate(R.crops(t).drop("genotype", "features"), design(t), disease(t), human(t))


@query("annotate", f"""SELECT vec_id, environment, plot, genotype, {q("pct")} AS pct, {q("disease_logit")} AS disease_logit, human_score FROM {_ANNOTATED} a""")
def annotate(t):
    return annotated(t).select("vec_id", "environment", "plot", "genotype", r("pct").alias("pct"), r("disease_logit").alias("disease_logit"), "human_score")


@query("reannotate", f"""SELECT environment, count(*) AS n, count(human_score) AS n_scored FROM {_ANNOTATED} a GROUP BY environment""")
def reannotate(t):
    old = R.crops(t).drop("features").withColumns({"environment": F.lit("stale"), "pct": F.lit(1.0)})
    df = J.reannotate(old, ["environment", "pct", "genotype"], design(t), disease(t), human(t))
    return df.groupBy("environment").agg(F.count(F.lit(1)).alias("n"), F.count("human_score").alias("n_scored"))


@query("annotation_coverage", f"""SELECT environment, count(*) AS n_rows, {q("avg((pct IS NOT NULL)::INT)")} AS pct_share,
  {q("avg((human_score IS NOT NULL)::INT)")} AS human_score_share FROM {_ANNOTATED} a GROUP BY environment""")
def annotation_coverage(t):
    c = J.coverage(annotated(t), ["pct", "human_score"], ["environment"])
    return c.select("environment", "n_rows", r("pct_share").alias("pct_share"), r("human_score_share").alias("human_score_share"))


@query("exclude_images", f"SELECT vec_id, image_id FROM {R.CROPS} c WHERE image_no NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def exclude_images(t):
    bad = SF.exclusion_keys(t.labels.where("toxic = 1").select(F.concat("doc_id", F.lit("_LeafA")).alias("image_id")))
    return J.exclude_keys(J.keyed(R.crops(t), "image_path"), bad).select("vec_id", "image_id")


@query("coalesced_key", """SELECT page_id, regexp_replace(regexp_extract(CASE WHEN page_id % 3 = 0 THEN url ELSE 'shots/p' || page_id || '_7.png' END, '[^/]*$'), '_[0-9]+\\.png$', '') AS key
  FROM pages WHERE NOT (page_id % 3 = 0 AND url LIKE '%/')""")
def coalesced_key(t):
    p = t.pages.select(
        "page_id", F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("shots/p"), "page_id", F.lit("_7.png"))).alias("a"),
        F.when(F.col("page_id") % 3 == 0, F.col("url")).alias("b"),
    )
    return p.select("page_id", K.coalesced_key(F.col("a"), F.col("b")).alias("key")).where("key IS NOT NULL")


@query("prefer_metadata", """SELECT o_orderkey, coalesce(CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END, o_orderpriority) AS field
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def prefer_metadata(t):
    left = t.orders.select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("field"))
    right = t.customer.select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("field"))
    return J.prefer_right(left, right, "k", ["field"]).select("o_orderkey", "field")


@query("unmatched_by_environment", """SELECT lang, count(*) FILTER (WHERE l.doc_id IS NULL) AS n_unmatched, count(*) AS n_rows,
  count(*) FILTER (WHERE l.doc_id IS NULL) = count(*) AS fully_lost FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY lang""")
def unmatched_by_environment(t):
    return J.unmatched_report(t.documents.select("doc_id", "lang"), t.labels, "doc_id", "lang")


@query("collapse_unique", """SELECT o_custkey, max(o_orderstatus) AS o_orderstatus, count(DISTINCT o_orderstatus) > 1 AS conflicting FROM orders GROUP BY o_custkey""")
def collapse_unique(t):
    return J.collapse_unique(t.orders, ["o_custkey"], "o_orderstatus")


@query("align_samples", f"""SELECT s.sample, {q("p.value")} AS value FROM {_NSAMPLES} s LEFT JOIN (SELECT * FROM {R.PHENO} x WHERE trait = 'price_A') p ON p.sample = s.sample""")
def align_samples(t):
    samples = R._lines(t).select("sample").distinct()
    p = R.phenotypes(t).where("trait = 'price_A'").select("sample", "value")
    return J.align_to_samples(samples, p).select("sample", r("value").alias("value"))


@query("image_target_join", f"""SELECT image_no, genotype, environment, {q("score", 3)} AS score, n_crops FROM
  (SELECT image_no, min(genotype) AS genotype, count(*) AS n_crops FROM {R.CROPS} c GROUP BY image_no) i JOIN {R.SCORES} s USING (image_no)""")
def image_target_join(t):
    images = R.crops(t).groupBy("image_no").agg(F.min("genotype").alias("genotype"), F.count(F.lit(1)).alias("n_crops"))
    return images.join(R.scores(t), "image_no").select("image_no", "genotype", "environment", r("score", 3).alias("score"), "n_crops")


@query("one_to_one_check", """SELECT coalesce(a.k, b.k) AS k, coalesce(n_left, 0) AS n_left, coalesce(n_right, 0) AS n_right FROM
  (SELECT c_custkey AS k, count(*) AS n_left FROM customer GROUP BY 1) a FULL JOIN (SELECT o_custkey + 10 AS k, count(*) AS n_right FROM orders GROUP BY 1) b ON a.k = b.k""")
def one_to_one_check(t):
    return J.one_to_one_full(t.customer.select(F.col("c_custkey").alias("k")), t.orders.select((F.col("o_custkey") + 10).alias("k")), ["k"])


@query("scores_with_calls", f"""SELECT sample, trait, {q("value")} AS value, c.dosage FROM {R.PHENO} p LEFT JOIN (SELECT sample, dosage FROM {R.CALLS} z WHERE marker = 'M7') c USING (sample)""")
def scores_with_calls(t):
    one = R.calls(t).where("marker = 'M7'").select("sample", "dosage")
    return R.phenotypes(t).join(one, "sample", "left").select("sample", "trait", r("value").alias("value"), "dosage")


_PEAKS = f"""(SELECT 'P' || s_suppkey AS peak, (s_suppkey % 5 + 1)::INT AS chrom, (s_suppkey * 15485863) % {R.GENOME_BP} AS "start",
  (s_suppkey * 15485863) % {R.GENOME_BP} + 400000 AS "end" FROM supplier)"""


def peaks(t):
    s = (F.col("s_suppkey") * 15485863) % R.GENOME_BP
    return t.supplier.select(
        F.concat(F.lit("P"), "s_suppkey").alias("peak"), (F.col("s_suppkey") % 5 + 1).cast("int").alias("chrom"), s.alias("start"), (s + 400_000).alias("end")
    )


@query("hits_in_peaks", f"""SELECT peak, a.chrom, count(*) AS n_hits, count(DISTINCT trait) AS n_traits FROM {R.ASSOC} a JOIN {_PEAKS} k
  ON a.chrom = k.chrom AND a.pos BETWEEN k."start" AND k."end" WHERE p_value < 0.05 GROUP BY peak, a.chrom""")
def hits_in_peaks(t):
    hits = J.in_intervals(R.associations(t).where("p_value < 0.05"), peaks(t))
    return hits.groupBy("peak", "chrom").agg(F.count(F.lit(1)).alias("n_hits"), F.count_distinct("trait").alias("n_traits"))


@query("markers_near_leads", f"""SELECT k.peak, m.marker, m.pos, m.pos - k."start" AS distance FROM {R.MARKERS} m JOIN {_PEAKS} k
  ON m.chrom = k.chrom AND m.pos BETWEEN greatest(k."start" - 250000, 0) AND k."start" + 250000""")
def markers_near_leads(t):
    leads = peaks(t).select("peak", "chrom", F.col("start").alias("lead_pos"))
    return J.around_leads(R.markers(t), leads, 250_000).select("peak", "marker", "pos", "distance")


@query("common_stratum", f"""WITH c AS (SELECT genotype FROM (SELECT user_id AS genotype, event_type FROM events WHERE event_type IN ('view', 'click', 'error')) z
  GROUP BY genotype HAVING count(DISTINCT event_type) = 3), l AS (SELECT event_type AS env, user_id, value FROM events
  UNION ALL SELECT 'common', user_id, value FROM events WHERE event_type = 'view' AND user_id IN (SELECT genotype FROM c))
  SELECT env, count(*) AS n, {q("avg(value)")} AS mean FROM l GROUP BY env""")
def common_stratum(t):
    e = t.events.select(F.col("user_id").alias("genotype"), F.col("event_type").alias("env"), "value")
    common = J.common_groups(e, "genotype", "env", ["view", "click", "error"])
    both = J.with_common_stratum(e, common, "genotype", "env", "view", "common")
    return both.groupBy("env").agg(F.count(F.lit(1)).alias("n"), r(F.avg("value")).alias("mean"))


# ---------------------------------------------------------------- scalar functions
@query("image_key", "SELECT vec_id, (vec_id // 2) || '_LeafA' AS image_key FROM embeddings")
def image_key(t):
    return R.crops(t).select("vec_id", K.image_key(F.regexp_replace("image_path", r"-05_00_(\d)\.png$", "-05_00_leaf.PNG")).alias("image_key"))


@query("composite_labels", """SELECT l_orderkey, l_suppkey || ':' || l_returnflag AS gxe, l_returnflag || '_' || l_linenumber AS env_row,
  l_linestatus || '__' || l_returnflag AS trait_env, count(*) AS n FROM lineitem GROUP BY ALL""")
def composite_labels(t):
    c = F.col
    return t.lineitem.groupBy(
        "l_orderkey", K.interaction_label(c("l_suppkey"), c("l_returnflag")).alias("gxe"), K.nested_label(c("l_returnflag"), c("l_linenumber")).alias("env_row"),
        K.trait_env_label(c("l_linestatus"), c("l_returnflag")).alias("trait_env"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("percent_logit", f"""SELECT o_orderkey, CASE WHEN p > 0 AND p < 100 THEN {q("ln(p / (100 - p))")} END AS logit FROM (SELECT o_orderkey, o_totalprice / 4000 AS p FROM orders) x""")
def percent_logit(t):
    return t.orders.select("o_orderkey", r(S.percent_logit(F.col("o_totalprice") / 4000)).alias("logit"))


@query("clipped_logit", f"""WITH x AS (SELECT l_returnflag, l_discount * CASE WHEN l_returnflag = 'A' THEN 1000 ELSE 10 END AS v FROM lineitem),
  y AS (SELECT l_returnflag, least(greatest(CASE WHEN max(v) OVER (PARTITION BY l_returnflag) > 1 THEN v / 100 ELSE v END, 5e-5), 1.0 - 5e-5)::DOUBLE AS p FROM x)
  SELECT l_returnflag, count(*) AS n, {q("avg(ln(p / (1 - p)))")} AS mean_logit FROM y GROUP BY l_returnflag""")
def clipped_logit(t):
    from ..operators.transforms import auto_clipped_logit

    v = F.col("l_discount") * F.when(F.col("l_returnflag") == "A", 1000).otherwise(10)
    df = auto_clipped_logit(t.lineitem.select("l_returnflag", v.alias("v")), ["l_returnflag"], "v", "logit")
    return df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), r(F.avg("logit")).alias("mean_logit"))


@query("log_scales", f"""SELECT trait, marker, {q("log2(p_value + 1)")} AS log2p, {q("-log10(greatest(p_value, 4.9e-324))")} AS mlog10p FROM {R.ASSOC} a""")
def log_scales(t):
    p = F.col("p_value")
    return R.associations(t).select("trait", "marker", r(S.log2_plus_one(p)).alias("log2p"), r(S.minus_log10(p)).alias("mlog10p"))


@query("minor_alleles", f"""SELECT marker, sum(dosage)::BIGINT AS n_alt, (2 * count(*) - sum(dosage))::BIGINT AS n_ref,
  CASE WHEN sum(dosage) <= count(*) THEN 'ALT' ELSE 'REF' END AS minor FROM {R.CALLS} c GROUP BY marker""")
def minor_alleles(t):
    from ..operators.association import minor_alleles as ma

    return ma(R.calls(t))


@query("marker_labels", f"""SELECT marker, chrom || ':' || pos || ':' || ref || ':' || alt AS label, chrom AS chrom_back, pos AS pos_back, ref AS ref_back, alt AS alt_back FROM {R.MARKERS} m""")
def marker_labels(t):
    m = R.markers(t).withColumn("label", K.marker_label(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")))
    return m.select("marker", "label", *[c.alias(f"{n}_back") for n, c in K.split_marker(F.col("label")).items()])


@query("natural_order", f"""SELECT trait, row_number() OVER (ORDER BY regexp_extract(trait, '[0-9]+$')::INT)::INT AS position FROM (SELECT DISTINCT trait FROM {R.ASSOC} a) x""")
def natural_order(t):
    from pyspark.sql import Window as W

    stem, number = K.natural_order(F.col("trait"))
    names = R.associations(t).select("trait").distinct().withColumns({"stem": stem, "number": F.coalesce(number, F.lit(-1))})
    sizes = names.groupBy("stem").agg(F.count(F.lit(1)).alias("n"))  # a row for each kind of trait, such as PC or IC
    before = sizes.select("stem", (F.sum("n").over(W.orderBy("stem")) - F.col("n")).alias("before"))
    ranks = value_ranks(names, ["stem"], "number").select("stem", "number", "below")
    placed = names.join(before, "stem").join(ranks, ["stem", "number"])
    return placed.select("trait", (F.col("before") + F.col("below") + 1).cast("int").alias("position"))


@query("effect_scales", f"""WITH s AS (SELECT trait, stddev_pop(effect) AS sd FROM {R.ASSOC} a GROUP BY trait)
  SELECT trait, marker, {q("effect / sd")} AS standardized, {q("2 * effect / sd")} AS homozygote_contrast,
  CASE WHEN effect / sd > 0 THEN 'increases' WHEN effect / sd < 0 THEN 'decreases' ELSE 'none' END AS direction FROM {R.ASSOC} a JOIN s USING (trait)""")
def effect_scales(t):
    a = R.associations(t)
    sd = a.groupBy("trait").agg(F.stddev_pop("effect").alias("sd"))
    z = F.col("effect") / F.col("sd")
    return a.join(sd, "trait").select("trait", "marker", r(z).alias("standardized"), r(2 * z).alias("homozygote_contrast"), S.effect_direction(z).alias("direction"))


@query("excess_green", f"""SELECT image, count(*) AS n, {q("avg((2 * g - r - b) / nullif(r + g + b, 0))")} AS mean_exg FROM {R.POINTS} p GROUP BY image""")
def excess_green(t):
    e = S.excess_green(F.col("r"), F.col("g"), F.col("b"))
    return R.points(t).groupBy("image").agg(F.count(F.lit(1)).alias("n"), r(F.avg(e)).alias("mean_exg"))


@query("sample_fingerprint", """SELECT event_type, count(*)::VARCHAR || '-' || sum(('0x' || substr(sha256(u), 1, 13))::BIGINT)::VARCHAR || '-' ||
  sum(('0x' || substr(sha256(u), 14, 13))::BIGINT)::VARCHAR AS fingerprint FROM (SELECT DISTINCT event_type, user_id::VARCHAR AS u FROM events) x GROUP BY event_type""")
def sample_fingerprint(t):
    return t.events.select("event_type", "user_id").distinct().groupBy("event_type").agg(set_fingerprint(F.col("user_id")).alias("fingerprint"))


@query("sample_list_digest", """SELECT c_mktsegment AS segment, count(*) AS n_samples, sha256(string_agg(c_nationkey::VARCHAR, chr(10) ORDER BY c_nationkey)) AS digest
  FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer) x GROUP BY c_mktsegment""")
def sample_list_digest(t):
    lines = t.customer.select(F.col("c_mktsegment").alias("segment"), "c_nationkey").distinct()
    return lines.groupBy("segment").agg(F.count(F.lit(1)).alias("n_samples"), list_digest(F.col("c_nationkey"), F.col("c_nationkey")).alias("digest"))


@query("correlation_p_values")
def correlation_p_values(t):
    from ..functions.pvalues import chi2_p, correlation_p, normal_p, student_t_p

    a = R.associations(t).groupBy("trait").agg(F.count(F.lit(1)).alias("n"), F.corr("p_value", "effect").alias("r"))
    tt = F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))
    return a.select("trait", "n", r("r").alias("r"), r(correlation_p(F.col("r"), F.col("n")), 6).alias("p_corr"),
                    r(student_t_p(tt, F.col("n") - 2), 6).alias("p_t"), r(normal_p(tt), 6).alias("p_normal"), r(chi2_p(tt * tt), 6).alias("p_chi2"))


# ------------------------------------------------------------------ round trips and schema rules
@query("rewritten_vectors", f"""SELECT vec_id, image_id, len(features) AS dims, {q("features[1]")} AS first FROM {R.CROPS} c""")
def rewritten_vectors(t):
    """Vectors written, written again from themselves, and read back."""
    path = scratch_folder(t.spark, "vectors")
    SV.write_vectors(R.crops(t).select("vec_id", "image_id", "features"), path)
    SV.write_vectors(SV.read_vectors(t.spark, path), path, keep_backup=False)
    back = SV.read_vectors(t.spark, path)
    return back.select("vec_id", "image_id", F.size("features").cast("long").alias("dims"), r(F.col("features")[0]).alias("first"))


@query("saved_table", f"""SELECT trait, pos::INT AS pos, {q("p_value::FLOAT", 6)} AS p_value FROM {R.ASSOC} a WHERE chrom = 2""")
def saved_table(t):
    path = scratch_folder(t.spark, "region")
    SF.save_table(R.associations(t).where("chrom = 2").select("trait", "pos", "p_value"), path, SF.REGION_COLUMNS, ["trait"])
    return SF.load_table(t.spark, path, SF.REGION_COLUMNS).select("trait", "pos", r("p_value", 6).alias("p_value"))


@query("saved_results", f"""SELECT trait, count(*) AS n, {q("min(p_value)", 8)} AS min_p FROM {R.ASSOC} a GROUP BY trait""")
def saved_results(t):
    """A summary saved with the record of its run, and read back; an empty result leaves no folder."""
    path = scratch_folder(t.spark, "run")
    a = R.associations(t)
    summary = a.groupBy("trait").agg(F.count(F.lit(1)).alias("n"), F.min("p_value").alias("min_p"))
    SF.save_results(t.spark, path, {"summary": summary, "significant": a.where("p_value < 0")}, {"threshold": 0})
    back = t.spark.read.option("header", True).csv(f"{path}/summary")
    return back.select("trait", F.col("n").cast("long").alias("n"), r(F.col("min_p").cast("double"), 8).alias("min_p"))


@query("listed_images", """SELECT DISTINCT 'dir/' || (vec_id // 2) || '_LeafA-05_00_' || (vec_id % 2) || '.png' AS path, (vec_id // 2) || '_LeafA' AS image_key FROM embeddings""")
def listed_images(t):
    rows = R.crops(t).select("image_path").unionAll(R.crops(t).select(F.regexp_replace("image_path", "png$", "txt")))
    return SF.listed_images(rows, "image_path", "/base").select(F.replace("path", F.lit("/base/"), F.lit("")).alias("path"), "image_key")


@query("column_roles", """SELECT 'c_acctbal' AS name, 'feature' AS role, count(c_acctbal) AS n FROM customer UNION ALL SELECT 'c_custkey', 'feature', count(c_custkey) FROM customer
  UNION ALL SELECT 'c_mktsegment', 'metadata', count(c_mktsegment) FROM customer UNION ALL SELECT 'c_nationkey', 'metadata', count(c_nationkey) FROM customer""")
def column_roles(t):
    """Which wanted columns are metadata and which are features, and how many values each holds."""
    wanted = t.customer.select(SC.named_traits(t.customer, ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment", "c_custkey"]))
    meta, features = SC.split_columns(wanted, r"c_(acct|cust)")
    counts = wanted.agg(*[F.count(c).alias(c) for c in wanted.columns]).unpivot([], wanted.columns, "name", "n")
    return counts.select("name", F.when(F.col("name").isin(features), "feature").otherwise("metadata").alias("role"), "n")


@query("checked_provenance", """SELECT label % 3 AS part, count(*) AS n, 'genotype' AS fit_split_column FROM embeddings GROUP BY 1""")
def checked_provenance(t):
    """Component scores whose provenance columns are checked before they are used."""
    scores = t.embeddings.select("label", F.col("embedding")[0].alias("PC1"), F.lit("genotype").alias("fit_split_column"), F.lit(0.1).alias("fit_test_frac"),
                                 F.lit("fit").alias("fit_split_role"), F.lit(1).alias("n_fit_rows"), F.lit("skew").alias("ica_sign_source"))
    SC.assert_provenance(scores)
    return scores.groupBy((F.col("label") % 3).alias("part"), "fit_split_column").agg(F.count("PC1").alias("n")).select("part", "n", "fit_split_column")
