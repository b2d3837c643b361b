"""Genotype means (BLUEs), variance components and heritability by REML, for all environments at once.

Genotypes, and genotype x environment cells across environments, are unbounded factors and are absorbed,
never listed; see :mod:`reml` for the sums that take their place. Environments are keys of those sums, so
one plan fits every environment and trait, each in a task of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .aggregates import harmonic_mean, plot_means
from .crossproducts import array_matrix
from .onerow import attach_row
from .reml import design, fit_models, keyed_sums
from .transforms import nested_zscores, winsorize_columns, zscore

LEVEL_LIMIT = 4_000
COEFFICIENT_BYTES = 256 << 20


# ---------------------------------------------------------------- design table
def model_plots(
    crops: DataFrame, traits: list[str], keys: list[str], env: str = "environment", genotype: str = "genotype",
    area: str | None = None, winsor: float = 0.01, across: bool = False,
) -> tuple[DataFrame, list[str]]:
    """Plot means ready for a model, and the names of the area covariates.

    For models within environments, winsorizing and the z-score of the area go by environment. Across
    environments only genotypes seen in at least two are kept, winsorizing goes over all plots, labels of
    genotype x environment are added and the area is z-scored inside each environment, one column per
    environment. The table is stored, for every step of a model reads it again.
    """
    df = crops
    if across:
        n = df.groupBy(genotype).agg(F.count_distinct(env).alias("__n")).where("__n >= 2").select(genotype)
        df = df.join(n, genotype, "left_semi")
    usable = df.dropna(subset=[*keys, *traits])
    values = [*traits, *([area] if area else [])]
    means = usable.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values]) if area else plot_means(df, keys, traits)
    within = [] if across or env not in keys else [env]
    means = winsorize_columns(cut_lineage(means), traits, winsor, within)
    if across:
        means = means.withColumn("genotype_x_environment", F.concat_ws(":", genotype, env))
    if area is None:
        return cut_lineage(means) if winsor > 0 or across else means, []
    if across:
        levels = [r[0] for r in means.select(env).distinct().orderBy(env).limit(LEVEL_LIMIT + 1).collect()]
        if len(levels) > LEVEL_LIMIT:
            raise ValueError(f"more than {LEVEL_LIMIT} environments")
        return cut_lineage(nested_zscores(means, env, area, levels, "area")), [f"area_{lv}" for lv in levels]
    return cut_lineage(zscore(means, within, area, "area_scaled")), ["area_scaled"]


# ---------------------------------------------------------------- BLUEs
def fit_blues(
    plots: DataFrame, traits: list[str], genotype: str = "genotype", covariates: list[str] | None = None, factors: list[str] | None = None, env: str | None = None,
) -> DataFrame:
    """(env, genotype, trait, blue): genotype fixed, the factors random, covariates at their plot mean.

    With ``env`` every environment is a model of its own, else all plots are one and there is no such
    column. Without a varying factor this is ordinary least squares. A trait that cannot be fitted in an
    environment (fewer than two genotypes, no variation) has null BLUEs there. The BLUEs are a map over
    genotype sums; what it broadcasts is the coefficient table, whose size is checked.
    """
    covariates, factors = covariates or [], factors or []
    d = design(plots, traits, covariates, factors, [genotype], intercept=False, key=env)
    sums, cells = keyed_sums(d, [genotype], [genotype], between=False)
    fits = fit_models(d, sums, (), ())
    nc, k = len(covariates), len(traits)
    mean = cells.groupBy("__key").agg(
        F.array(*[F.sum(F.get("s", F.lit(i))) / F.sum("n_rows") for i in range(nc)]).cast("array<double>").alias("mean"), F.count(F.lit(1)).alias("g"))
    size = d.layout.agg(F.sum(F.col("n_base") * k * 8)).first()[0] or 0
    if size > COEFFICIENT_BYTES:
        raise ValueError(f"{size} bytes of coefficients; fit fewer traits at a time")
    known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for r in fits.join(mean, "__key").select("__key", "trait", "coef", "error", "mean", "g").toLocalIterator():
        table, marginal = known.setdefault(r["__key"], ({}, {}))
        fitted = r["error"] is None and r["g"] > 1
        table[r["trait"]] = r["coef"] if fitted else None
        marginal[r["trait"]] = float(np.dot(r["coef"][:nc], r["mean"])) if fitted else None
    packed = {}
    for name, (table, marginal) in known.items():
        width = max((len(c) for c in table.values() if c is not None), default=0)
        packed[name] = (
            np.array([table[t] if table[t] is not None else [np.nan] * width for t in traits]).reshape(k, width),
            np.array([np.nan if marginal[t] is None else marginal[t] for t in traits]),
        )
    shared = plots.sparkSession.sparkContext.broadcast(packed)

    def means(batches):
        for b in batches:
            names = np.array(b.column(0).to_pylist(), dtype=object)
            for name in set(names.tolist()):
                part = b.take(pa.array(np.flatnonzero(names == name)))
                table, marginal = shared.value[name]
                v, n = array_matrix(part.column(2)), part.column(3).to_numpy().astype(float)
                width = v.shape[1] - k
                coef = table if table.shape[1] == width else np.full((k, width), np.nan)
                blue = ((v[:, width:] - v[:, :width] @ coef.T) / n[:, None] + marginal).reshape(-1)
                rows = pa.array(np.repeat(np.arange(part.num_rows), k))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(1).take(rows), pa.array(traits * part.num_rows), pa.array(blue, mask=np.isnan(blue))],
                    names=["environment", "genotype", "trait", "blue"],
                )

    out = cells.select("__key", F.col(genotype).cast("string").alias("genotype"), "s", "n_rows")
    out = out.mapInArrow(means, "environment string, genotype string, trait string, blue double")
    return out.withColumnRenamed("environment", env) if env else out.drop("environment")


# ---------------------------------------------------------------- variance components
def _components(fits: DataFrame, env: str | None) -> DataFrame:
    """One row for each term of every fit; a failed fit gives one error row without a term."""
    out = fits.select(
        F.col("__key").alias(env or "__key"), "trait", F.explode_outer("sources").alias("x"), "converged", "singular", "error", F.col("n").cast("long").alias("n_plots"), F.col("n_units").cast("long").alias("n_genotypes"),
    )
    out = out.select(*([env] if env else []), "trait", "x.source", "x.vcov", "converged", "singular", "error", "n_plots", "n_genotypes")
    return cut_lineage(out)


def variance_components(
    plots: DataFrame, traits: list[str], genotype: str = "genotype", covariates: list[str] | None = None, factors: list[str] | None = None, env: str | None = None,
) -> DataFrame:
    """(env, trait, source, vcov, converged, singular, error, n_plots, n_genotypes) with genotype and the factors random.

    With ``env`` every environment is a model of its own, else all plots are one and there is no such
    column. A trait that fails gives one error row. ``singular``: some random term has a standard
    deviation of less than 1e-4 of the residual's.
    """
    d = design(plots, traits, covariates or [], factors or [], [genotype], intercept=True, key=env)
    sums, _ = keyed_sums(d, [genotype], [genotype], between=True)
    return _components(fit_models(d, sums, ("unit",), ("genotype",)), env)


def variance_components_across(
    plots: DataFrame, traits: list[str], genotype: str = "genotype", env: str = "environment", covariates: list[str] | None = None, factors: list[str] | None = None,
) -> DataFrame:
    """The same over all environments, with genotype, genotype x environment and environment random."""
    with_env = plots.withColumn("__env", F.col(env))
    d = design(with_env, traits, covariates or [], [env, *(factors or [])], [genotype, "__env"], intercept=True)
    sums, _ = keyed_sums(d, [genotype], [genotype, "__env"], between=True)
    return _components(fit_models(d, sums, ("unit", "cell"), ("genotype", "genotype_x_environment")), None)


# ---------------------------------------------------------------- heritability
def variance_shares(vc: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Proportion of each source, with boundary, convergence and singularity flags; keyed by ``keys`` and trait."""
    by = [*keys, "trait"]
    tot = vc.where("source IS NOT NULL").groupBy(*by).agg(F.sum("vcov").alias("total"))
    edge = (F.col("vcov") <= F.greatest(F.col("total"), F.lit(1.0)) * 1e-6) & (F.col("source") != "Residual")
    flags = [c for c in ("converged", "singular") if c in vc.columns]
    return vc.join(tot, by).select(*by, "source", "vcov", F.try_divide("vcov", "total").alias("proportion_variance"), edge.alias("boundary"), *flags)


def line_mean_h2(vc: DataFrame, plots: DataFrame, genotype: str = "genotype", env: str | None = None, by: str | None = None) -> DataFrame:
    """Line-mean heritability per trait from variance components and harmonic replication.

    ``env`` names the environments of a model across them; ``by`` those of models inside each, and then
    every row belongs to one of them.
    """
    keys = [by] if by else []
    of = lambda source: F.max(F.when(F.col("source") == source, F.col("vcov")))
    singular = F.coalesce(F.max("singular"), F.lit(False)) if "singular" in vc.columns else F.lit(False)
    v = vc.groupBy(*keys, "trait").agg(
        of("genotype").alias("vg"), of("genotype_x_environment").alias("vge"), of("Residual").alias("ve"), F.min("converged").alias("converged"),
        singular.alias("singular"), F.max("error").alias("error"),
    )
    if env is None:
        reps = plots.groupBy(*keys, genotype).agg(F.count(F.lit(1)).alias("n")).groupBy(*keys)
        reps = reps.agg(harmonic_mean("n").alias("hr"), F.sum("n").alias("n_plots"), F.count(F.lit(1)).alias("n_genotypes")).withColumn("he", F.lit(1.0))
    else:
        he = plots.groupBy(genotype).agg(F.count_distinct(env).alias("n"), F.count(F.lit(1)).alias("m"))
        he = he.agg(harmonic_mean("n").alias("he"), F.sum("m").alias("n_plots"), F.count(F.lit(1)).alias("n_genotypes"))
        hr = plots.groupBy(genotype, env).agg(F.count(F.lit(1)).alias("n")).agg(harmonic_mean("n").alias("hr"))
        reps = attach_row(he, hr)
    j = v.join(reps, keys, "left") if keys else attach_row(v, reps)
    phen = F.col("vg") + F.coalesce("vge", F.lit(0.0)) / F.col("he") + F.col("ve") / (F.col("he") * F.col("hr"))
    total = F.col("vg") + F.coalesce("vge", F.lit(0.0)) + F.col("ve")
    edge = F.col("vg") <= 1e-6 * F.greatest(total, F.lit(1.0))
    return j.select(
        *keys, "trait", "vg", "vge", "ve", "he", "hr", "n_plots", "n_genotypes", phen.alias("phenotypic_variance"), F.when(phen > 0, F.col("vg") / phen).alias("h2"),
        edge.alias("genotype_boundary"), "converged", "singular", (F.col("converged") & ~edge & ~F.col("singular")).alias("reliable"), "error",
    )


def covariate_blues(plots: DataFrame, area: str, factors: list[str], other: DataFrame, genotype: str = "genotype", env: str | None = None) -> DataFrame:
    """BLUE of the raw area (no area covariate), with a second covariate joined by genotype."""
    b = fit_blues(plots, [area], genotype, [], factors, env)
    return b.select(*([env] if env else []), "genotype", F.col("blue").alias(f"{area}_blue")).join(other, "genotype", "left")
