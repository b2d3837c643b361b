"""Multiple testing: q-values, thresholds, summaries, expected quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut_lineage
from .ranking import BUCKET, running_extreme_from_above, top_k, value_ranks


def bh_qvalues(df: DataFrame, keys: list[str], p: str = "p_value", out: str = "q_value") -> DataFrame:
    """Benjamini-Hochberg q-values within each group; missing p stays missing.

    Works on distinct p-values, bucket by bucket, so one group may hold most of the table; the
    ranked values are read twice (bucket minima, then rows) and hence checkpointed.
    """
    r = value_ranks(df, keys, p).withColumn("__c", F.col(p) * F.col("total") / (F.col("below") + F.col("n")))
    r = cut_lineage(r.select(*keys, BUCKET, p, "__c"))
    qv = running_extreme_from_above(r, keys, p, "__c", "__q")
    side = qv.select(*keys, p, F.least(F.col("__q"), F.lit(1.0)).alias(out))
    return df.join(side, [*keys, p], "left")


def bh_qvalues_bounded(df: DataFrame, keys: list[str], p: str, out: str = "q_value") -> DataFrame:
    """The same q-values by a plain window, for tables whose groups are bounded by the number of
    vector dimensions (one row per dimension), never for marker tables."""
    usable = F.col(p).isNotNull() & ~F.isnan(p)
    w = W.partitionBy(*keys, usable)
    m = F.count(F.lit(1)).over(w)
    step = df.withColumn("__c", F.when(usable, F.col(p) * m / F.row_number().over(w.orderBy(p))))
    tail = w.orderBy(F.col(p).desc()).rangeBetween(W.unboundedPreceding, 0)
    return step.withColumn(out, F.when(usable, F.least(F.min("__c").over(tail), F.lit(1.0)))).drop("__c")


def bh_cutoffs(df: DataFrame, keys: list[str], p: str = "p_value", alpha: float = 0.05, per_decade: int = 64) -> DataFrame:
    """(keys, n_tested, cutoff, n_passing): the largest p that the Benjamini-Hochberg rule accepts at ``alpha``.

    A histogram of p on a log scale, which adds up in the map tasks, says where the cut-off can be: a bucket
    whose largest p passes at its own rank passes whole, one whose smallest p fails at its largest rank holds
    none. Only the values of buckets in between, beyond the last that passes whole, are ranked. ``cutoff`` is
    null where nothing passes. Null and NaN p are not tested.
    """
    usable = df.where(F.col(p).isNotNull() & ~F.isnan(p)).select(*keys, p)
    usable = usable.withColumn("__b", F.when(F.col(p) > 0, F.floor(-F.log10(p) * per_decade)).otherwise(F.lit(1 << 20)).cast("int"))
    cells = usable.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"), F.min(p).alias("__lo"), F.max(p).alias("__hi"))
    downward = W.partitionBy(*keys).orderBy(F.desc("__b"))  # a group has at most some thousand buckets
    cells = cells.withColumns({"__c": F.sum("__n").over(downward), "__m": F.sum("__n").over(W.partitionBy(*keys))})
    bound = F.lit(float(alpha)) * F.col("__c") / F.col("__m")
    cells = cut_lineage(cells.withColumns({"__sure": F.col("__hi") <= bound, "__may": F.col("__lo") <= bound}))
    whole = lambda c: F.when(F.col("__sure"), F.col(c))
    sure = cells.groupBy(*keys).agg(F.max("__m").alias("n_tested"), F.max(whole("__hi")).alias("__p0"), F.max(whole("__c")).alias("__k0"), F.min(whole("__b")).alias("__edge"))
    between = cells.join(sure.select(*keys, "__edge"), keys).where(F.col("__may") & ~F.col("__sure") & (F.col("__edge").isNull() | (F.col("__b") < F.col("__edge"))))
    between = between.select(*keys, "__b", (F.col("__c") - F.col("__n")).alias("__before"), "__m")
    ranked = value_ranks(usable.join(between.select(*keys, "__b"), [*keys, "__b"], "left_semi"), [*keys, "__b"], p)
    place = F.col("__before") + F.col("below") + F.col("n")
    found = ranked.join(between, [*keys, "__b"]).where(F.col(p) <= F.lit(float(alpha)) * place / F.col("__m"))
    found = found.groupBy(*keys).agg(F.max(p).alias("__p1"), F.max(place).alias("__k1"))
    out = sure.join(found, keys, "left")
    return out.select(*keys, "n_tested", F.coalesce("__p1", "__p0").alias("cutoff"), F.coalesce("__k1", "__k0", F.lit(0)).cast("long").alias("n_passing"))


def scan_report(scan: DataFrame, threshold: float, alpha: float = 0.05, k: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary per trait, markers that pass, best k markers per trait) of a scan, which is stored once.

    Markers pass by ``threshold`` or by the Benjamini-Hochberg rule at ``alpha`` within their trait.
    """
    scan = cut_lineage(scan.where(F.col("p_value").isNotNull()))
    cut = bh_cutoffs(scan, ["trait"], "p_value", alpha)
    summary = trait_summary(scan, threshold).join(cut.select("trait", F.col("cutoff").alias("bh_cutoff"), F.col("n_passing").alias("n_bh")), "trait")
    hits = scan.join(cut.select("trait", "cutoff"), "trait").withColumns({
        "passes_threshold": F.col("p_value") <= threshold, "passes_bh": F.coalesce(F.col("p_value") <= F.col("cutoff"), F.lit(False)),
    }).where("passes_threshold OR passes_bh").drop("cutoff")
    return summary, hits, top_markers(scan, k)


def expected_quantiles(df: DataFrame, keys: list[str], p: str = "p_value", piece: int = 65_536) -> DataFrame:
    """(observed, expected) -log10 pairs per group; tied p-values take consecutive ranks.

    A long tie is cut into pieces of ranks before the shuffle, so that no row and no task has to
    unfold it whole.
    """
    r = value_ranks(df, keys, p)
    cut = r.select(*keys, p, "total", "below", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / piece))).alias("__piece"))
    cut = cut.repartition(*keys, p, "__piece")
    first = F.col("below") + F.col("__piece") * piece + 1
    last = F.least(F.col("below") + (F.col("__piece") + 1) * piece, F.col("below") + F.col("n"))
    rows = cut.select(*keys, p, "total", F.explode(F.sequence(first, last)).alias("i"))
    return rows.select(
        *keys, "i", (-F.log10(p)).alias("observed"), (-F.log10((F.col("i") - 0.5) / F.col("total"))).alias("expected")
    )


def trait_summary(df: DataFrame, threshold: float) -> DataFrame:
    return df.groupBy("trait").agg(
        F.count("p_value").alias("n_tested"), F.min("p_value").alias("min_p"),
        F.count_if(F.col("p_value") <= threshold).alias("n_significant"), F.lit(threshold).alias("threshold"),
    )


def significant(df: DataFrame, threshold: float) -> DataFrame:
    return df.where(F.col("p_value") <= threshold)


def top_markers(df: DataFrame, k: int) -> DataFrame:
    return top_k(df, ["trait"], [F.col("p_value").asc_nulls_last(), F.col("marker").asc()], k)


def extreme_images(df: DataFrame, image: str, row_id: str, value: str, n: int) -> DataFrame:
    """n highest and n lowest rows, at most one per image."""
    out = None
    for end, pick, sort in (("high", F.max_by, F.desc), ("low", F.min_by, F.asc)):
        tie = F.struct(F.col(value), -F.col(row_id)) if end == "high" else F.struct(F.col(value), F.col(row_id))
        best = df.where(F.col(value).isNotNull()).groupBy(image).agg(pick(F.struct(row_id, value), tie).alias("r"))
        rows = best.select(image, f"r.{row_id}", f"r.{value}").withColumn("side", F.lit(end))
        rows = rows.orderBy(sort(value), F.asc(row_id)).limit(n)
        out = rows if out is None else out.unionByName(rows)
    return out
