"""Correlations, partial rank correlations, rank-sum tests and simple regressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.pvalues import correlation_p, normal_p, rank_sum_p
from ..session import cut_lineage
from .crossproducts import TILE, gram_matrices, gram_tiles, tile_entries, with_one
from .ranking import average_rank, value_ranks, with_average_rank, with_average_ranks
from .testing import bh_qvalues_bounded


def centred_rank() -> Column:
    """Average rank minus its mean, from value_ranks columns; keeps rank sums small."""
    return F.col("below") + (F.col("n") - F.col("total")) / 2.0


def safe_corr(x: str, y: str) -> Column:
    """Pearson r, null without variance (Spark's corr divides by zero under ANSI rules)."""
    varies = (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def pearson_by_dimension(df: DataFrame, keys: list[str], vec: str, target: str) -> DataFrame:
    """(keys, dim, n, r): each vector dimension against a target."""
    long = df.where(F.col(target).isNotNull()).select(*keys, target, F.posexplode(vec).alias("dim", "x"))
    long = long.withColumn("x", F.col("x").cast("double")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    stats = long.groupBy(*keys, "dim").agg(F.count("x").alias("n"), safe_corr("x", target).alias("r"))
    return stats.withColumn("r", F.when(F.col("n") >= 3, F.col("r")))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, n, r): rank correlation over complete pairs.

    The rank of y is attached to rows; the rank of x is constant over rows that tie in x, so sums
    of y ranks per distinct x are enough and x is never joined back.
    """
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    ry = value_ranks(pairs, keys, "__y").select(*keys, "__y", centred_rank().alias("__ry"))
    ranked = pairs.join(ry, [*keys, "__y"]) if keys else pairs.join(ry, "__y")
    return _spearman_from(ranked, keys, pairs)


def _spearman_from(ranked: DataFrame, keys: list[str], base: DataFrame) -> DataFrame:
    """Rows with ``__x`` and a centred rank ``__ry`` to (keys, n, r); ``base`` is the same before ranking."""
    vx = value_ranks(ranked, keys, "__x", [F.sum("__ry").alias("__sy"), F.sum(F.col("__ry") * F.col("__ry")).alias("__syy")], base)
    rx = centred_rank()
    s = vx.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum(rx * F.col("__sy")).alias("sxy"), F.sum(F.col("n") * rx * rx).alias("sxx"), F.sum("__syy").alias("syy")
    )
    ok = (F.col("n") >= 3) & (F.col("sxx") > 0) & (F.col("syy") > 0)
    return s.select(*keys, "n", F.when(ok, F.try_divide("sxy", F.sqrt("sxx") * F.sqrt("syy"))).alias("r"))


def spearman_by_dimension(df: DataFrame, keys: list[str], vec: str, target: str) -> DataFrame:
    """(keys, dim, n, r) for vectors without missing entries (see complete-vector filter).

    The target is ranked once per row before the vectors are unpacked.
    """
    rows = df.where(F.col(target).isNotNull()).withColumn("__y", F.col(target).cast("double"))
    ry = value_ranks(rows.select(*keys, "__y"), keys, "__y").select(*keys, "__y", centred_rank().alias("__ry"))
    ranked = rows.join(ry, [*keys, "__y"])
    unpack = lambda d, *keep: d.select(*keys, *keep, F.posexplode(vec).alias("dim", "__x")).withColumn("__x", F.col("__x").cast("double"))
    return _spearman_from(unpack(ranked, "__ry"), [*keys, "dim"], unpack(rows))


def scoped(df: DataFrame, env: str, pooled: str = "pooled") -> DataFrame:
    """Every row twice: once in the pooled scope, once in its environment's."""
    return df.withColumn("scope", F.explode(F.array(F.lit(pooled), F.col(env))))


def score_correlation(df: DataFrame, env: str, vec: str, target: str, min_env: int = 3, method: str = "spearman") -> DataFrame:
    """Pooled and per-environment correlation of every dimension with a score.

    q-values are given for the pooled scope; environments with fewer than ``min_env`` rows are
    left out.
    """
    both = scoped(cut_lineage(df.select(env, vec, target)), env)
    fn = spearman_by_dimension if method == "spearman" else pearson_by_dimension
    c = fn(both, ["scope"], vec, target).where((F.col("scope") == "pooled") | (F.col("n") >= min_env))
    c = c.withColumn("p_value", correlation_p(F.col("r"), F.col("n")))
    withq = bh_qvalues_bounded(c.withColumn("__pp", F.when(F.col("scope") == "pooled", F.col("p_value"))), ["scope"], "__pp", "q_value")
    return withq.select("scope", "dim", "n", "r", "p_value", "q_value")


# ---------------------------------------------------------------- matrices
def correlation_matrix(df: DataFrame, vec: str, tile: int = TILE) -> DataFrame:
    """(i, j, r) for i < j from one cross-product pass; products and results stay in Spark. Null without variance."""
    cells = tile_entries(cut_lineage(gram_tiles(df, vec, prepare=with_one, tile=tile))).drop("grp")
    n = cells.where("i = 0 AND j = 0").select("v").scalar()
    sums = cells.where("i = 0 AND j > 0").select(F.col("j").alias("d"), F.col("v").alias("s"))
    own = cells.where("i = j AND i > 0").select(F.col("i").alias("d"), F.col("v").alias("q")).join(sums, "d")
    own = own.select("d", (F.col("s") / n).alias("m"), F.sqrt(F.greatest(F.col("q") / n - (F.col("s") / n) * (F.col("s") / n), F.lit(0.0))).alias("sd"))
    side = lambda x: own.select(F.col("d").alias(x), F.col("m").alias(f"m{x}"), F.col("sd").alias(f"s{x}"))
    pairs = cells.where("i > 0 AND i < j").join(side("i"), "i").join(side("j"), "j")
    r = (F.col("v") / n - F.col("mi") * F.col("mj")) / (F.col("si") * F.col("sj"))
    return pairs.select((F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), F.when((F.col("si") > 0) & (F.col("sj") > 0), r).alias("r"))


def rank_vectors(df: DataFrame, row_id: str, vec: str, out: str = "ranks") -> DataFrame:
    """Replace every vector entry by its average rank within its dimension."""
    long = df.select(row_id, F.posexplode(vec).alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    ranked = with_average_rank(long, ["dim"], "v", "rk")
    packed = F.transform(F.array_sort(F.collect_list(F.struct("dim", "rk"))), lambda s: s["rk"])
    return ranked.groupBy(row_id).agg(packed.alias(out))


# ---------------------------------------------------------------- partial correlation
def stacked(flat: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(rows that hold a matrix, those matrices): flat covariance matrices of one size as an (m, k, k) array."""
    rows = np.flatnonzero([v is not None for v in flat])
    if not len(rows):
        return rows, np.zeros((0, 1, 1))
    m = np.array([[np.nan if x is None else x for x in flat.iloc[i]] for i in rows], dtype=float)
    k = int(round(m.shape[1] ** 0.5))
    return rows, m.reshape(len(rows), k, k)


def swept(c: np.ndarray, columns: range) -> tuple[np.ndarray, np.ndarray]:
    """Regress all variables of a stack of covariance matrices on ``columns``, pivot by pivot.

    Returns the swept stack (residual covariances, slopes in the rows of the pivots, minus the inverse among
    them) and which pivots were independent of those before; a dependent one is left out of its matrix.
    """
    a, used = c.copy(), np.zeros((len(c), len(columns)), bool)
    own = np.diagonal(c, axis1=1, axis2=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        for i, j in enumerate(columns):
            pivot = a[:, j, j]
            ok = (pivot > 1e-10 * own[:, j]) & (own[:, j] > 0)
            row = a[:, j, :] / np.where(ok, pivot, 1.0)[:, None]
            new = a - a[:, :, j, None] * row[:, None, :]
            new[:, j, :], new[:, :, j] = row, row
            new[:, j, j] = -1.0 / np.where(ok, pivot, 1.0)
            a = np.where(ok[:, None, None], new, a)
            used[:, i] = ok
    return a, used


def _spread(values: np.ndarray, rows: np.ndarray, n: int) -> pd.Series:
    out = np.full(n, np.nan)
    out[rows] = values
    return pd.Series(out).where(~np.isnan(out), None)


@F.pandas_udf(DoubleType())
def _partial_r(mats: pd.Series) -> pd.Series:
    """Partial correlation of the first two variables given the rest, from a flat covariance matrix."""
    rows, c = stacked(mats)
    if not len(rows):
        return pd.Series([None] * len(mats), dtype="float64")
    a, _ = swept(c, range(2, c.shape[1]))
    d = a[:, 0, 0] * a[:, 1, 1]
    ok = d > 1e-12 * np.maximum(c[:, 0, 0] * c[:, 1, 1], 1e-300)
    return _spread(np.where(ok, a[:, 0, 1] / np.sqrt(np.where(ok, d, 1.0)), np.nan), rows, len(mats))


@F.pandas_udf(DoubleType())
def _r_squared(mats: pd.Series) -> pd.Series:
    """R2 of the first variable on the rest, from a flat covariance matrix."""
    rows, c = stacked(mats)
    if not len(rows):
        return pd.Series([None] * len(mats), dtype="float64")
    a, _ = swept(c, range(1, c.shape[1]))
    ok = c[:, 0, 0] > 0
    return _spread(np.where(ok, 1 - a[:, 0, 0] / np.where(ok, c[:, 0, 0], 1.0), np.nan), rows, len(mats))


def covariance_array(columns: list[str]) -> Column:
    """Flat population covariance matrix of the columns, one aggregate pass; mirrored entries are the
    same expression, which Spark computes once."""
    at = {c: i for i, c in enumerate(columns)}
    return F.array(*[F.covar_pop(*sorted((a, b), key=at.get)) for a in columns for b in columns])


def ranked_columns(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    base = cut_lineage(df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).dropna())
    return with_average_ranks(base, keys, {c: f"{c}_rank" for c in columns})


def rank_partial(df: DataFrame, keys: list[str], x: str, y: str, covariates: list[str], min_n: int = 3) -> DataFrame:
    """Spearman r, partial r of ranks given rank covariates, and p-values, per group."""
    cols = [x, y, *covariates]
    ranked = ranked_columns(df, keys, cols)
    rc = [f"{c}_rank" for c in cols]
    agg = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), safe_corr(rc[0], rc[1]).alias("r"), covariance_array(rc).alias("__c")
    ).where(F.col("n") >= min_n)
    out = agg.withColumn("partial_r", _partial_r("__c")).drop("__c")
    return out.withColumns({"p_value": correlation_p(F.col("r"), F.col("n")), "partial_p": correlation_p(F.col("partial_r"), F.col("n"))})


def rank_structure(df: DataFrame, keys: list[str], x: str, y: str, covariates: list[str]) -> DataFrame:
    """How much of x and y the covariates explain on ranks, and how much of r they take away."""
    cols = [x, y, *covariates]
    ranked = ranked_columns(df, keys, cols)
    rc = [f"{c}_rank" for c in cols]
    agg = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), safe_corr(rc[0], rc[1]).alias("r"), covariance_array(rc).alias("__c"),
        covariance_array([rc[0], *rc[2:]]).alias("__cx"), covariance_array([rc[1], *rc[2:]]).alias("__cy"),
        *[safe_corr(rc[0], z).alias(f"r_x_{c}") for z, c in zip(rc[2:], covariates)],
    )
    out = agg.withColumns({"partial_r": _partial_r("__c"), "r2_x": _r_squared("__cx"), "r2_y": _r_squared("__cy")})
    out = out.withColumn("share_removed", 1 - F.try_divide(F.abs("partial_r"), F.abs("r")))
    return out.drop("__c", "__cx", "__cy")


# ---------------------------------------------------------------- regression
@F.pandas_udf(StructType([StructField("intercept", DoubleType()), StructField("slopes", ArrayType(DoubleType()))]))
def _solve_ols(means: pd.Series, cov: pd.Series) -> pd.DataFrame:
    rows, c = stacked(cov)
    out = pd.DataFrame({"intercept": pd.Series([None] * len(means), dtype="float64"), "slopes": pd.Series([None] * len(means), dtype=object)})
    if len(rows):
        k = c.shape[1]
        m = np.array([means.iloc[i] for i in rows], dtype=float)
        a, used = swept(c, range(1, k))
        slopes = np.where(used, a[:, 0, 1:], 0.0)
        out.loc[rows, "intercept"] = m[:, 0] - (slopes * m[:, 1:]).sum(1)
        for i, s in zip(rows, slopes.tolist()):
            out.at[i, "slopes"] = s
    return out


def residuals(df: DataFrame, keys: list[str], y: str, covariates: list[str], out: str = "residual") -> DataFrame:
    """Residual of y after least squares on the covariates, per group; the fit is aggregated, the
    residual is a row expression."""
    cols = [y, *covariates]
    fit = df.dropna(subset=cols).groupBy(*keys).agg(F.array(*[F.avg(c) for c in cols]).alias("__m"), covariance_array(cols).alias("__c"))
    fit = fit.select(*keys, _solve_ols("__m", "__c").alias("__f"))
    hat = F.col("__f.intercept")
    for i, c in enumerate(covariates):
        hat = hat + F.col("__f.slopes")[i] * F.col(c)
    return df.join(fit, keys, "left").withColumn(out, F.col(y) - hat).drop("__f")


def regression_line(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    ok = F.stddev_pop(x) > 0
    return df.dropna(subset=[x, y]).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.when(ok, F.regr_slope(y, x)).alias("slope"), F.when(ok, F.regr_intercept(y, x)).alias("intercept")
    )


def dimension_r2(df: DataFrame, vec: str, covariates: list[str]) -> DataFrame:
    """(dim, r2) of each vector dimension regressed on several covariates: one cross-product pass."""
    packed = df.dropna(subset=covariates).select(
        F.concat(F.array(*[F.col(c).cast("double") for c in covariates]), F.transform(vec, lambda v: v.cast("double"))).alias("v")
    )
    g = gram_matrices(packed, "v", prepare=with_one)[""]
    n, mean = g[0, 0], g[0, 1:] / g[0, 0]
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    k = len(covariates)
    b = np.linalg.pinv(cov[:k, :k]) @ cov[:k, k:]
    r2 = (b * cov[:k, k:]).sum(0) / np.diag(cov)[k:]
    return df.sparkSession.createDataFrame(pd.DataFrame({"dim": np.arange(len(r2), dtype="int32"), "r2": r2}))


def variance_accounted(loadings: DataFrame, variances: DataFrame) -> DataFrame:
    """Per component: sum over dimensions of squared loading times dimension variance."""
    return loadings.join(variances, "dim").groupBy("component").agg(
        F.sum(F.col("loading") * F.col("loading") * F.col("variance")).alias("variance")
    )


# ---------------------------------------------------------------- tests and metrics
def rank_sum(df: DataFrame, keys: list[str], group: str, value: str, a, b) -> DataFrame:
    """Wilcoxon rank-sum of group a against b: U of a and a two-sided p.

    With fewer than 50 values on both sides and no ties p is exact, by counting orders; else it is the
    normal one with tie and continuity correction (``exact`` says which).
    """
    two = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull())
    v = value_ranks(two, keys, value, [F.count_if(F.col(group) == a).alias("__na")])
    n = F.col("n")
    s = v.groupBy(*keys).agg(
        F.sum("__na").alias("n_a"), F.max("total").alias("nn"), F.sum(F.col("__na") * average_rank()).alias("ra"),
        F.sum((n * n * n - n).cast("double")).alias("ties"),
    )
    na, nn = F.col("n_a"), F.col("nn")
    nb = nn - na
    u = F.col("ra") - na * (na + 1) / 2.0
    var = na * nb / 12.0 * ((nn + 1) - F.try_divide(F.col("ties"), nn * (nn - 1)))
    dev = u - na * nb / 2.0
    z = F.when(var > 0, F.try_divide(dev - F.signum(dev) * 0.5, F.sqrt(var)))
    exact = (na < 50) & (nb < 50) & (na > 0) & (nb > 0) & (F.col("ties") == 0)
    out = s.select(*keys, "n_a", nb.alias("n_b"), u.alias("u"), z.alias("z"), exact.alias("exact"))
    counted = rank_sum_p(F.when(F.col("exact"), F.col("u")), F.col("n_a"), F.col("n_b"))
    return out.withColumn("p_value", F.coalesce(counted, normal_p(F.col("z"))))


def regression_metrics(df: DataFrame, keys: list[str], truth: str, pred: str) -> DataFrame:
    """Pearson, Spearman, their squares, RMSE, MAE and p-values."""
    err = F.col(truth) - F.col(pred)
    base = df.dropna(subset=[truth, pred]).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), safe_corr(truth, pred).alias("pearson"),
        F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"),
    )
    rho = spearman(df, keys, truth, pred).select(*keys, F.col("r").alias("spearman"))
    out = base.join(rho, keys)
    return out.withColumns({
        "pearson_r2": F.col("pearson") * F.col("pearson"), "spearman_r2": F.col("spearman") * F.col("spearman"),
        "pearson_p": correlation_p(F.col("pearson"), F.col("n")), "spearman_p": correlation_p(F.col("spearman"), F.col("n")),
    })
