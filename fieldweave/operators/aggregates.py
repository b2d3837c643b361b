"""Aggregations over crops, plots, genotypes, images and alleles. All combine map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .crossproducts import vector_means
from .onerow import attach_row
from .ranking import exact_quantiles


def image_means(crops: DataFrame, key: str, vec: str = "features", path: str = "image_path") -> DataFrame:
    """Element-wise mean vector per image, its crop count and its first path."""
    return vector_means(crops, [key], vec, F.count(F.lit(1)).alias("n_crops"), F.min(path).alias(path))


def plot_means(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Mean per plot over rows complete in the keys and the trait columns."""
    return df.dropna(subset=[*keys, *values]).groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def std_error(value: str) -> Column:
    """Standard error over the non-null values."""
    return F.stddev_samp(value) / F.sqrt(F.count(value))


def mean_se(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), std_error(value).alias("se"), F.count(value).alias("n")
    )


def genotype_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, exact median, SD and coefficient of variation per group."""
    basic = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    median = exact_quantiles(df, keys, value, {"median": 0.5})
    return basic.join(median, keys, "left").withColumn("cv", F.try_divide("sd", F.col("mean")))


def value_span(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min(value).alias("low"), F.max(value).alias("high"), (F.max(value) - F.min(value)).alias("span")
    )


def pooled_fraction(obs: DataFrame, whole: str, part: str) -> DataFrame:
    """Per genotype over environments: mean of whole, part, difference and difference / whole."""
    cell = obs.where(F.col("trait").isin(whole, part)).groupBy("env", "genotype").pivot("trait", [whole, part]).agg(F.avg("value"))
    cell = cell.dropna(subset=[whole, part]).withColumn("rest", F.col(whole) - F.col(part))
    cell = cell.withColumn("rest_frac", F.try_divide("rest", F.col(whole)))
    return cell.groupBy("genotype").agg(*[F.avg(c).alias(c) for c in (whole, part, "rest", "rest_frac")])


def coverage_audit(images: DataFrame, env: str) -> DataFrame:
    """Coverage counts per environment plus a TOTAL row.

    ``images`` is one row per image with the boolean columns excluded, ungenotyped, embedded and
    explained_failure.
    """
    ex, un, em, ok = (F.coalesce(F.col(c), F.lit(False)) for c in ("excluded", "ungenotyped", "embedded", "explained_failure"))
    expected = ~ex & ~un
    return (
        images.where(F.col(env).isNotNull())
        .rollup(env)
        .agg(
            F.count(F.lit(1)).alias("metadata_total"),
            F.count_if(ex).alias("excluded"),
            F.count_if(un & ~ex).alias("ungenotyped"),
            F.count_if(expected).alias("expected"),
            F.count_if(expected & em).alias("embedded"),
            F.count_if(expected & ~em & ok).alias("missing_failed"),
            F.count_if(expected & ~em & ~ok).alias("missing_unexplained"),
        )
        .withColumn(env, F.coalesce(env, F.lit("TOTAL")))
    )


def unexplained_missing(images: DataFrame) -> DataFrame:
    return images.where("NOT excluded AND NOT ungenotyped AND NOT embedded AND NOT coalesce(explained_failure, false)")


def require_covered(images: DataFrame) -> None:
    """Gate: fail when an expected image is neither embedded nor explained."""
    if unexplained_missing(images).limit(1).count():
        raise ValueError("expected images lack an embedding and a logged failure")


def allele_counts(calls: DataFrame, keys: list[str], dosage: str = "dosage") -> DataFrame:
    d = F.col(dosage)
    return calls.groupBy(*keys).agg(
        F.count(d).alias("n_marker_nonmissing"),
        F.count_if(d == 0).alias("n_ref_homozygote"),
        F.count_if(d == 1).alias("n_heterozygote"),
        F.count_if(d == 2).alias("n_alt_homozygote"),
    )


def variance_by_category(parts: DataFrame, categories: dict[str, str]) -> DataFrame:
    """Sum of variance proportions per trait and category; unknown sources count as 'Other'."""
    label = F.coalesce(*[F.when(F.col("source") == s, c) for s, c in categories.items()], F.lit("Other"))
    clean = parts.where(F.col("source").isNotNull() & (F.col("source") != "nan") & F.col("proportion_variance").isNotNull())
    return clean.groupBy("trait", label.alias("category")).agg(F.sum("proportion_variance").alias("proportion_variance"))


def threshold_counts(df: DataFrame, value: str, thresholds: list[float]) -> DataFrame:
    """Rows at or above each threshold: each value counts once into its step, then steps add up.

    One pass and one small table of len(thresholds) rows, not rows x thresholds.
    """
    from pyspark.sql import Window as W

    cuts = sorted(set(thresholds))
    arr = F.array(*[F.lit(c) for c in cuts])
    step = F.size(F.filter(arr, lambda c: c <= F.col(value)))
    per = df.where(F.col(value).isNotNull()).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("m"))
    grid = df.sparkSession.createDataFrame([(i + 1, float(c)) for i, c in enumerate(cuts)], "step int, threshold double")
    above = F.coalesce(F.sum("m").over(W.orderBy(F.col("step").desc())), F.lit(0))
    return grid.join(per, "step", "left").select("threshold", above.alias("n_at_or_above"))


def harmonic_mean(n: str) -> Column:
    ok = F.when(F.col(n) > 0, F.col(n))
    return F.count(ok) / F.sum(1 / ok)


def profile_means(df: DataFrame, keys: list[str], profile: str = "profile") -> DataFrame:
    """Mean, SE and n per group and bin of an array column."""
    return mean_se(df.select(*keys, F.posexplode(profile).alias("bin", "value")), [*keys, "bin"], "value")


def pooled_tokens(tokens: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """Channel mean and sample SD of token vectors per image, as two arrays."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    s = tokens.groupBy(*keys).agg(Summarizer.metrics("mean", "std").summary(array_to_vector(vec)).alias("s"))
    return s.select(*keys, vector_to_array("s.mean").alias("embedding_mean"), vector_to_array("s.std").alias("embedding_std"))


def percent_below(df: DataFrame, keys: list[str], value: Column, threshold: float) -> DataFrame:
    v = df.withColumn("__v", value)
    return v.groupBy(*keys).agg((100 * F.avg(F.when(F.col("__v").isNotNull(), (F.col("__v") < threshold).cast("double")))).alias("percent"))


def five_numbers(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    qs = {"minimum": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "maximum": 1.0}
    return exact_quantiles(df, keys, value, qs)


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int, keys: list[str] | None = None) -> DataFrame:
    """Counts in equal bins of [lo, hi]; the top edge belongs to the last bin."""
    b = F.least(F.floor((F.col(value) - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    inside = df.where(F.col(value).between(lo, hi))
    return inside.groupBy(*(keys or []), b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def representative_group(df: DataFrame, cls: str, group: str, trait: str, level: str, low_share: float = 0.4) -> DataFrame:
    """Per class, among groups at or below the ``low_share`` quantile of ``level``, the one whose
    trait is nearest to the class median."""
    edge = exact_quantiles(df.withColumn("__one", F.lit(1)), ["__one"], level, {"__edge": low_share}).agg(F.max("__edge").alias("__edge"))
    med = exact_quantiles(df, [cls], trait, {"__med": 0.5})
    near = attach_row(df, edge).where(F.col(level) <= F.col("__edge")).join(med, cls)
    dist = F.abs(F.col(trait) - F.col("__med"))
    return near.groupBy(cls).agg(
        F.min_by(F.struct(group, trait, level), F.struct(dist, F.col(group))).alias("r")
    ).select(cls, f"r.{group}", f"r.{trait}", f"r.{level}")
