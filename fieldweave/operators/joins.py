"""Joins of crops, designs, scores, markers and intervals.

Sides are never broadcast by hint: Spark broadcasts what it measures to be small and shuffles the
rest, and adaptive execution splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keys import compact_label, image_key, is_placeholder
from ..functions.scalars import percent_logit, to_number
from .ranking import first_per_key


def keyed(df: DataFrame, column: str, out: str = "image_key") -> DataFrame:
    return df.withColumn(out, image_key(F.col(column)))


def one_per_image(df: DataFrame, columns: list[str], order: list[str], id_col: str = "image_id") -> DataFrame:
    """First row per image key by an explicit order, keeping only ``columns``."""
    side = keyed(df, id_col).select("image_key", *dict.fromkeys([*columns, *order]))
    return first_per_key(side, ["image_key"], order).select("image_key", *columns)


def annotate(
    crops: DataFrame,
    design: DataFrame,
    disease: DataFrame,
    human: DataFrame,
    path_col: str = "image_path",
    drop_placeholders: bool = True,
) -> DataFrame:
    """Crops with design fields, disease percentage and its logit, and the sparse human score.

    Each right side is one row per image key already; labels lose inner blanks, and crops whose
    line is missing or a placeholder are dropped.
    """
    df = keyed(crops, path_col).join(design, "image_key", "left")
    if drop_placeholders:
        df = df.where(~is_placeholder(F.col("genotype")))
    df = df.join(disease.withColumn("pct", to_number(F.col("pct"))), "image_key", "left")
    df = df.join(human.where(F.col("human_score").isNotNull()), "image_key", "left")
    return df.withColumns(
        {"disease_logit": percent_logit(F.col("pct")), "genotype": compact_label(F.col("genotype"))}
    )


def reannotate(df: DataFrame, stale: list[str], *sides: DataFrame, **kw) -> DataFrame:
    return annotate(df.drop(*stale), *sides, **kw)


def coverage(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Share of rows with a value, per column."""
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.avg(F.col(c).isNotNull().cast("double")).alias(f"{c}_share") for c in columns]
    )


def exclude_keys(df: DataFrame, excluded: DataFrame, key: str = "image_key") -> DataFrame:
    return df.join(excluded.select(key), key, "left_anti")


def prefer_right(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Left join where the right side's value wins and the left value fills its gaps."""
    side = right.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    joined = left.join(side, key, "left")
    for f in fields:
        own = F.col(f) if f in left.columns else F.lit(None)
        joined = joined.withColumn(f, F.coalesce(F.col(f"__{f}"), own))
    return joined.drop(*[f"__{f}" for f in fields])


def unmatched_report(left: DataFrame, right: DataFrame, key: str, env: str) -> DataFrame:
    """Rows without a partner per source environment, and whether the environment is lost whole."""
    hit = right.select(key).distinct().withColumn("__hit", F.lit(1))
    return (
        left.join(hit, key, "left")
        .groupBy(env)
        .agg(F.count_if(F.col("__hit").isNull()).alias("n_unmatched"), F.count(F.lit(1)).alias("n_rows"))
        .withColumn("fully_lost", F.col("n_unmatched") == F.col("n_rows"))
    )


def collapse_unique(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One value per key with a conflict flag; ``require_unique`` turns flags into an error."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.max(value).alias(value), (F.count_distinct(value) > 1).alias("conflicting")
    )


def require_unique(collapsed: DataFrame) -> DataFrame:
    bad = collapsed.where("conflicting").limit(5).collect()
    if bad:
        raise ValueError(f"conflicting values for one key, for example {bad}")
    return collapsed.drop("conflicting")


def align_to_samples(samples: DataFrame, pheno: DataFrame, key: str = "sample") -> DataFrame:
    """Every sample in list order with its phenotype, null where there is none."""
    return samples.join(pheno, key, "left")


def one_to_one_full(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join that reports key counts on both sides, so a broken 1:1 rule is visible."""
    lw = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_left"))
    rw = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_right"))
    return lw.join(rw, keys, "full").withColumns(
        {"n_left": F.coalesce("n_left", F.lit(0)), "n_right": F.coalesce("n_right", F.lit(0))}
    )


def in_intervals(
    points: DataFrame, intervals: DataFrame, pos: str = "pos", start: str = "start", end: str = "end",
    bin_size: int = 1_000_000, how: str = "inner",
) -> DataFrame:
    """Points inside closed intervals of the same chromosome, as an equi-join on (chrom, bin).

    Intervals are repeated once per bin they touch, so both sides shuffle on a key that spreads
    one hot chromosome over many tasks.
    """
    b = F.lit(bin_size)
    binned = intervals.withColumn(
        "__bin", F.explode(F.sequence(F.floor(F.col(start) / b), F.floor(F.col(end) / b)))
    )
    side = points.withColumn("__bin", F.floor(F.col(pos) / b))
    cond = [side["chrom"] == binned["chrom"], side["__bin"] == binned["__bin"], side[pos].between(binned[start], binned[end])]
    return side.join(binned, cond, how).drop(binned["chrom"]).drop("__bin")


def around_leads(markers: DataFrame, leads: DataFrame, width: int, bin_size: int | None = None) -> DataFrame:
    """Markers within +-width of each lead position, with the signed distance."""
    spans = leads.withColumns(
        {"start": F.greatest(F.col("lead_pos") - width, F.lit(0)), "end": F.col("lead_pos") + width}
    )
    hit = in_intervals(markers, spans, bin_size=bin_size or max(width, 1))
    return hit.withColumn("distance", F.col("pos") - F.col("lead_pos")).drop("start", "end")


def overlaps(start: Column, end: Column, lo, hi) -> Column:
    return ~((end < lo) | (start > hi))


def gene_parts(models: DataFrame, kinds: tuple[str, ...] = ("CDS", "five_prime_UTR", "three_prime_UTR")) -> DataFrame:
    """Segments of the first transcript of every gene: gene -> first mRNA -> coding and UTR parts."""
    genes = models.where("kind = 'gene'").select(F.col("id").alias("gene"), "strand")
    first = (
        models.where("kind = 'mRNA'")
        .groupBy(F.col("parent").alias("gene"))
        .agg(F.min_by("id", F.struct("start", "id")).alias("mrna"))
    )
    parts = models.where(F.col("kind").isin(*kinds)).select(F.col("parent").alias("mrna"), "kind", "start", "end")
    return genes.join(first, "gene").join(parts, "mrna").select("gene", "mrna", "strand", "kind", "start", "end")


def common_groups(df: DataFrame, group: str, within: str, levels: list[str]) -> DataFrame:
    """Groups seen at every one of the given levels."""
    return (
        df.where(F.col(within).isin(levels))
        .groupBy(group)
        .agg(F.count_distinct(within).alias("__n"))
        .where(F.col("__n") == len(set(levels)))
        .select(group)
    )


def with_common_stratum(df: DataFrame, common: DataFrame, group: str, within: str, level: str, label: str) -> DataFrame:
    """The table plus a relabelled copy of one level restricted to the common groups."""
    extra = df.where(F.col(within) == level).join(common, group, "left_semi").withColumn(within, F.lit(label))
    return df.unionByName(extra)
