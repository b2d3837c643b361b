"""Multiple testing, ranks, top-k, layouts, runs and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import cut_lineage
from ..operators import hotspots as H, ranking as K, testing as TS
from . import roles as R
from .aggregates import _FIXED, _FIXED_B, _LENGTHS, W_BP, hits, lengths, windows_b
from .registry import q, query, r


@query("bh_qvalues", f"""WITH i AS (SELECT *, row_number() OVER (PARTITION BY trait ORDER BY p_value) AS i, count(*) OVER (PARTITION BY trait) AS m FROM {R.ASSOC} a)
  SELECT trait, marker, {q("least(1, min(p_value * m / i) OVER (PARTITION BY trait ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))", 6)} AS q_value FROM i""")
def bh_qvalues(t):
    return TS.bh_qvalues(cut_lineage(R.associations(t)), ["trait"]).select("trait", "marker", r("q_value", 6).alias("q_value"))


@query("average_rank", f"""SELECT vec_id, environment, image_no, rank() OVER w + (count(*) OVER (PARTITION BY environment, area) - 1) / 2.0::DOUBLE AS area_rank FROM
  (SELECT l_orderkey AS vec_id, l_linenumber AS image_no, l_returnflag AS environment, l_quantity AS area FROM lineitem) x WINDOW w AS (PARTITION BY environment ORDER BY area)""")
def average_rank(t):
    df = t.lineitem.select(F.col("l_orderkey").alias("vec_id"), F.col("l_linenumber").alias("image_no"), F.col("l_returnflag").alias("environment"), F.col("l_quantity").alias("area"))
    return K.with_average_rank(df, ["environment"], "area", "area_rank").select("vec_id", "environment", "image_no", "area_rank")


@query("top_markers", f"""SELECT trait, marker, {q("p_value", 8)} AS p_value, rank FROM (SELECT *, row_number() OVER (PARTITION BY trait ORDER BY p_value, marker)::INT AS rank FROM {R.ASSOC} a) x WHERE rank <= 20""")
def top_markers(t):
    return TS.top_markers(R.associations(t), 20).select("trait", "marker", r("p_value", 8).alias("p_value"), "rank")


_ONE = f"(SELECT vec_id, image_no, value FROM {R.CROPS_LONG} l WHERE dim = 5)"


@query("extreme_images", f"""WITH h AS (SELECT image_no, vec_id, value FROM (SELECT *, row_number() OVER (PARTITION BY image_no ORDER BY value DESC, vec_id) AS k FROM {_ONE} o) x WHERE k = 1 ORDER BY value DESC, vec_id LIMIT 12),
  l AS (SELECT image_no, vec_id, value FROM (SELECT *, row_number() OVER (PARTITION BY image_no ORDER BY value, vec_id) AS k FROM {_ONE} o) x WHERE k = 1 ORDER BY value, vec_id LIMIT 12)
  SELECT image_no, vec_id, {q("value", 6)} AS value, 'high' AS side FROM h UNION ALL SELECT image_no, vec_id, {q("value", 6)}, 'low' FROM l""")
def extreme_images(t):
    one = R.crops(t).select("vec_id", "image_no", F.col("features")[5].cast("double").alias("value"))
    return TS.extreme_images(one, "image_no", "vec_id", "value", 12).withColumn("value", r("value", 6))


@query("genome_offsets", f"""SELECT chrom, max_bp, bp_add, (bp_add + lead(bp_add, 1, bp_add + max_bp) OVER (ORDER BY chrom)) / 2 AS center FROM (
  SELECT chrom, max_bp, coalesce(sum(max_bp + 1000000) OVER (ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bp_add FROM {_LENGTHS} l) x""")
def genome_offsets(t):
    return H.genome_offsets(lengths(t), 1_000_000)


_LAYOUT = f"""(SELECT chrom, span_bp, "offset", "offset" + span_bp // 2 AS center FROM (SELECT chrom, span_bp,
  coalesce(sum(span_bp + 5000000) OVER (ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM (
  SELECT chrom, (max("window") + 1) * {W_BP} AS span_bp FROM (SELECT chrom, "window" FROM {_FIXED} a UNION ALL SELECT chrom, "window" FROM {_FIXED_B} b) u GROUP BY chrom) v) w)"""


@query("shared_layout", f"SELECT * FROM {_LAYOUT} y")
def shared_layout(t):
    return H.shared_layout([H.fixed_windows(hits(t), W_BP), windows_b(t)], W_BP)


@query("genome_positions", f"""SELECT f.chrom, f."window", f.n_traits, y."offset" + f."window" * {W_BP} + {W_BP // 2} AS genome_pos FROM {_FIXED} f JOIN {_LAYOUT} y USING (chrom)""")
def genome_positions(t):
    a = H.fixed_windows(hits(t), W_BP)
    return H.genome_positions(a, H.shared_layout([a, windows_b(t)], W_BP), W_BP).drop("window_start")


@query("label_runs", """WITH x AS (SELECT p_partkey AS pos, p_type AS label, p_partkey - row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS g FROM part)
  SELECT label, min(pos) AS "start", max(pos) AS "end", (min(pos) + max(pos)) / 2 AS mid FROM x GROUP BY label, g""")
def label_runs(t):
    return H.label_runs(t.part.select(F.col("p_partkey").alias("pos"), F.col("p_type").alias("label")), "pos", "label")


@query("importance_summary", f"""SELECT *, row_number() OVER (ORDER BY mean DESC, feature)::INT AS rank FROM (SELECT p_brand AS feature, {q("avg(v)")} AS mean, {q("stddev_samp(v)")} AS sd, {q("min(v)")} AS low, {q("max(v)")} AS high
  FROM (SELECT p_brand, p_size % 5 AS fold, avg(p_retailprice) AS v FROM part GROUP BY 1, 2) x GROUP BY p_brand) y""")
def importance_summary(t):
    from ..operators.prediction import importance_summary as imp

    f = t.part.groupBy(F.col("p_brand").alias("feature"), (F.col("p_size") % 5).alias("fold")).agg(F.avg("p_retailprice").alias("importance"))
    return imp(f)


@query("status_order", """SELECT o_orderkey, rank() OVER (ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END NULLS LAST) AS position FROM orders""")
def status_order(t):
    from ..operators.association import status_positions

    o = t.orders.select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("p"))
    return status_positions(o, "o_orderstatus", ["F", "O"], "p").select("o_orderkey", "position")


@query("qq_pairs", f"""SELECT trait, row_number() OVER w AS i, {q("-log10(p_value)")} AS observed, {q("-log10((row_number() OVER w - 0.5) / count(*) OVER (PARTITION BY trait))")} AS expected FROM {R.ASSOC} a WINDOW w AS (PARTITION BY trait ORDER BY p_value)""")
def qq_pairs(t):
    e = TS.expected_quantiles(R.associations(t), ["trait"])
    return e.select("trait", "i", r("observed").alias("observed"), r("expected").alias("expected"))


@query("merge_tables", """SELECT vec_id, image, 'a' AS part FROM (SELECT vec_id, vec_id // 2 AS image FROM embeddings) x UNION ALL SELECT vec_id + 1000000000, vec_id // 2, 'b' FROM embeddings""")
def merge_tables(t):
    from ..sources.vectors import merge_vector_tables

    a = t.embeddings.select("vec_id", F.expr("vec_id div 2").alias("image"), F.lit("a").alias("part"))
    b = a.select((F.col("vec_id") + 1_000_000_000).alias("vec_id"), "image", F.lit("b").alias("part"), F.lit(0).alias("extra"))
    return merge_vector_tables(a, b, "vec_id")


@query("common_genotypes", """SELECT user_id FROM events WHERE event_type = 'view' INTERSECT SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'signup'""")
def common_genotypes(t):
    from ..operators.joins import common_groups

    return common_groups(t.events, "user_id", "event_type", ["view", "error", "signup"])


@query("missing_ids", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def missing_ids(t):
    return t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query("significant_markers", f"SELECT trait, marker, {q('p_value', 8)} AS p_value FROM {R.ASSOC} a WHERE p_value <= 0.002")
def significant_markers(t):
    return TS.significant(R.associations(t), 0.002).select("trait", "marker", r("p_value", 8).alias("p_value"))
