"""Principal and independent components, parallel analysis and component-count rules.

Fits need one cross-product pass (plus one short pass per ICA iteration); only k x k matrices,
k = number of dimensions, reach the driver. Scores are a map over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..session import cut_lineage
from .crossproducts import array_matrix, gram_matrices, list_column, with_one
from .onerow import attach_row


def with_array(df: DataFrame, vec: str, fn: Callable[[np.ndarray], np.ndarray], out: str) -> DataFrame:
    """Append ``out = fn(matrix of vec)`` batch by batch; all other columns pass through."""
    at = df.columns.index(vec)
    schema = StructType([*df.schema.fields, StructField(out, ArrayType(DoubleType()), True)])

    def run(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            y = fn(array_matrix(b.column(at)))
            yield pa.RecordBatch.from_arrays([*b.columns, list_column(y)], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema)


@dataclass(frozen=True)
class PcaFit:
    mean: np.ndarray
    sd: np.ndarray
    components: np.ndarray  # k x dims, rows are unit vectors
    variance: np.ndarray  # eigenvalues, n - 1 denominator
    total_variance: float
    n: int


def fit_pca(df: DataFrame, vec: str, k: int, fit: str | None = None, scale: bool = True) -> PcaFit:
    """PCA of the (standardised) fit rows from the Gram matrix of [1, x]."""
    rows = df.where(F.col(fit)) if fit else df
    g = gram_matrices(rows, vec, prepare=with_one)[""]
    n = g[0, 0]
    mean = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.clip(np.diag(cov), 0, None)) if scale else np.ones(len(mean))
    sd = np.where(sd > 0, sd, 1.0)
    cov = cov / np.outer(sd, sd) * n / (n - 1)
    val, vecs = np.linalg.eigh(cov)
    order = np.argsort(val)[::-1][: min(k, len(val), int(n))]
    comp = vecs[:, order].T
    lead = comp[np.arange(len(comp)), np.abs(comp).argmax(1)]
    return PcaFit(mean, sd, comp * np.sign(lead)[:, None], np.clip(val[order], 0, None), float(val.sum()), int(n))


def pca_scores(df: DataFrame, vec: str, fit: PcaFit, out: str = "scores", whiten: bool = False) -> DataFrame:
    proj = fit.components.T / fit.sd[:, None]
    if whiten:
        proj = proj / np.sqrt(fit.variance)
    mean = fit.mean
    return with_array(df, vec, lambda x: (x - mean) @ proj, out)


def variance_curve(fit: PcaFit, spark: SparkSession) -> DataFrame:
    ratio = fit.variance / fit.total_variance
    table = pd.DataFrame({"pc": np.arange(1, len(ratio) + 1, dtype="int32"), "explained_variance_ratio": ratio})
    w = W.orderBy("pc").rowsBetween(W.unboundedPreceding, 0)
    return spark.createDataFrame(table).withColumn("cumulative", F.sum("explained_variance_ratio").over(w))


def oriented_first_component(df: DataFrame, vec: str, reference: str, out: str = "pc1") -> DataFrame:
    """First component score, its sign chosen to correlate positively with a reference column."""
    fit = fit_pca(df, vec, 1)
    scored = pca_scores(df, vec, fit, "__s").withColumn(out, F.col("__s")[0]).drop("__s")
    sign = scored.agg(F.signum(F.covar_pop(out, reference)).alias("s")).first()["s"]
    return scored.withColumn(out, F.col(out) * F.lit(-1.0 if sign is not None and sign < 0 else 1.0))


# ---------------------------------------------------------------- ICA
@dataclass(frozen=True)
class IcaFit:
    pca: PcaFit
    unmixing: np.ndarray  # components x whitened dims, sign already applied
    iterations: int
    converged: bool


def _decorrelate(w: np.ndarray) -> np.ndarray:
    s, u = np.linalg.eigh(w @ w.T)
    return (u / np.sqrt(np.clip(s, 1e-300, None))) @ u.T @ w


def _summed(df: DataFrame, vec: str, fn: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over batches of a small matrix computed from each batch, as in gram_rows."""

    def fold(batches):
        total = None
        for b in batches:
            if b.num_rows:
                m = fn(array_matrix(b.column(0)))
                total = m if total is None else total + m
        if total is not None:
            k = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), list_column(total)], names=["i", "row"])

    part = df.select(vec).mapInArrow(fold, "i int, row array<double>")
    rows = part.groupBy("i").agg(Summarizer.sum(array_to_vector("row")).alias("s")).select("i", vector_to_array("s").alias("row"))
    table = rows.toArrow()
    return array_matrix(table.column(1))[np.argsort(table.column(0).to_numpy())]


def fit_ica(
    df: DataFrame, vec: str, n_white: int, n_components: int, fit: str | None = None,
    tol: float = 1e-3, max_iter: int = 2000, seed: int = 0,
) -> IcaFit:
    """Symmetric FastICA with the logcosh contrast (Hyvarinen 1999) on whitened fit rows.

    Each iteration is one pass of partial sums of tanh(Wx)x' and 1 - tanh(Wx)^2; the k x k update
    happens on the driver. Signs make the skewness of the fit rows' scores positive.
    """
    pca = fit_pca(df, vec, n_white, fit)
    k = min(n_components, len(pca.variance))
    rows = df.where(F.col(fit)) if fit else df
    white = pca_scores(rows.select(vec), vec, pca, "__w", whiten=True).select(F.slice("__w", 1, k).alias("__w"))
    white = white.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        w = _decorrelate(np.random.RandomState(seed).normal(size=(k, k)))
        done = False
        step = 0
        while step < max_iter and not done:
            step += 1

            def contrast(x: np.ndarray, w=w) -> np.ndarray:
                g = np.tanh(x @ w.T)
                return np.column_stack([g.T @ x, (1.0 - g * g).sum(0), np.full(w.shape[0], float(len(x)))])

            s = _summed(white, "__w", contrast)
            n = s[0, -1]
            new = _decorrelate(s[:, :k] / n - (s[:, k] / n)[:, None] * w)
            done = bool(np.max(np.abs(np.abs(np.einsum("ij,ij->i", new, w)) - 1.0)) < tol)
            w = new
        final = w
        m = _summed(white, "__w", lambda x: np.vstack([(x @ final.T).sum(0), ((x @ final.T) ** 2).sum(0), ((x @ final.T) ** 3).sum(0), np.full(k, float(len(x)))]))
    finally:
        white.unpersist()
    n = m[3]
    mu = m[0] / n
    third = m[2] / n - 3 * mu * m[1] / n + 2 * mu**3
    sign = np.where(third < 0, -1.0, 1.0)
    return IcaFit(pca, w * sign[:, None], step, done)


def ica_scores(df: DataFrame, vec: str, fit: IcaFit, out: str = "scores") -> DataFrame:
    k = fit.unmixing.shape[1]
    p = fit.pca
    proj = (p.components.T / p.sd[:, None] / np.sqrt(p.variance))[:, :k] @ fit.unmixing.T
    mean = p.mean
    return with_array(df, vec, lambda x: (x - mean) @ proj, out)


# ---------------------------------------------------------------- component counts
BLOCK_BYTES = 64 << 20  # rows a task holds as one matrix


def dealt_blocks(df: DataFrame, row_id: str, vec: str, dims: int, seed: int) -> DataFrame:
    """(block, place, vec): rows dealt out by a hash of their id, about BLOCK_BYTES of numbers a block, in a fixed order.

    Rows that share an id share a block; the order inside a block is that of a second hash, so every run
    and every retry sees the same blocks.
    """
    rows = max(64, BLOCK_BYTES // (8 * max(dims, 1)))
    number = df.agg(F.greatest(F.ceil(F.count(F.lit(1)) / rows), F.lit(1)).alias("n")).first()["n"]
    keyed = df.select(
        F.pmod(F.xxhash64(F.lit(seed), row_id), F.lit(number)).cast("int").alias("block"), F.xxhash64(F.lit(seed + 1), row_id).alias("place"), vec)
    return keyed.repartition(min(int(number), 100_000), "block").sortWithinPartitions("block", "place", vec)


def permuted_products(
    blocks: DataFrame, vec: str, mean: np.ndarray, sd: np.ndarray, bases: list[np.ndarray], seed: int, permute: bool,
) -> list[np.ndarray]:
    """X'X q over all rows for every replicate's basis q, X standardised; dims x width numbers each.

    With ``permute`` replicate r shuffles every column on its own inside each block before the product. Rows
    are dealt to blocks at random, so what a block's shuffle leaves of a covariance is the share one over
    its number of rows. Nothing is unfolded and no row moves again, whatever the number of replicates.
    """
    shared = blocks.sparkSession.sparkContext.broadcast((mean, sd, bases))
    dims = len(mean)

    def fold(batches):
        mean, sd, bases = shared.value
        sums = [np.zeros((dims, q.shape[1])) for q in bases]
        held: list[np.ndarray] = []
        current = None

        def close() -> None:
            if held:
                x = (np.vstack(held) - mean) / sd
                for r, q in enumerate(bases):
                    z = np.random.default_rng([seed, r, current]).permuted(x, axis=0) if permute else x
                    sums[r] += z.T @ (z @ q)

        for b in batches:
            block, x = b.column(0).to_numpy(), array_matrix(b.column(1)) if b.num_rows else None
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for i, j in zip(cuts, cuts[1:]):
                if j > i:
                    if current is not None and block[i] != current:
                        close()
                        held = []
                    current = int(block[i])
                    held.append(x[i:j])
        close()
        if current is not None:
            for r, s in enumerate(sums):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(dims, r, np.int32)), pa.array(np.arange(dims, dtype=np.int32)), list_column(s)], names=["rep", "i", "row"])

    part = blocks.select("block", vec).mapInArrow(fold, "rep int, i int, row array<double>")
    summed = part.groupBy("rep", "i").agg(Summarizer.sum(array_to_vector("row")).alias("s")).select("rep", "i", vector_to_array("s").alias("row"))
    out = [np.zeros((dims, q.shape[1])) for q in bases]
    for b in summed.toArrow().to_batches():  # replicates x dims rows of the basis' width
        if b.num_rows:
            m = array_matrix(b.column(2))
            for r, i, row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), m):
                out[r][i] = row
    return out


def leading_eigenvalues(
    blocks: DataFrame, vec: str, mean: np.ndarray, sd: np.ndarray, n: int, k: int, replicates: int, seed: int, permute: bool, passes: int = 4, oversample: int = 10,
) -> np.ndarray:
    """replicates x k leading eigenvalues of the (permuted) correlation matrices, by randomized subspace iteration.

    A random basis of k + oversample directions is multiplied by X'X and made orthonormal, ``passes`` times,
    and the eigenvalues are those of the last product within the basis (Halko, Martinsson & Tropp 2011).
    One pass serves all replicates. Where the basis spans all dimensions, one pass is exact.
    """
    dims = len(mean)
    width = min(dims, k + oversample)
    rng = np.random.RandomState(seed)
    bases = [np.linalg.qr(rng.normal(size=(dims, width)))[0] for _ in range(replicates)]
    for _ in range(1 if width == dims else passes):
        sums = permuted_products(blocks, vec, mean, sd, bases, seed, permute)
        small = [q.T @ s for q, s in zip(bases, sums)]
        bases = [np.linalg.qr(s)[0] for s in sums] if width < dims else bases
    return np.array([np.sort(np.linalg.eigvalsh((m + m.T) / 2))[::-1][:k] for m in small]) / (n - 1)


def parallel_analysis(
    df: DataFrame, row_id: str, vec: str, replicates: int = 15, percentile: float = 95.0, max_pcs: int = 300, seed: int = 0, fit: str | None = None,
) -> DataFrame:
    """Horn's parallel analysis of the fit rows: observed against permuted eigenvalues of the correlation matrix.

    (pc, observed, null_percentile, null_mean, above_null, retained). The blocks are checkpointed once and
    read by every pass.
    """
    rows = df.where(F.col(fit)) if fit else df
    stats = rows.select(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.transform(vec, lambda x: x.cast("double")))).alias("s")).select("s.*").first()
    n = int(stats["count"])
    mean, var = stats["mean"].toArray(), stats["variance"].toArray()
    sd = np.where(var > 0, np.sqrt(var), 1.0)
    k = min(max_pcs, len(mean), n)
    blocks = cut_lineage(dealt_blocks(rows, row_id, vec, len(mean), seed))
    observed = leading_eigenvalues(blocks, vec, mean, sd, n, k, 1, seed, permute=False)[0]
    table = leading_eigenvalues(blocks, vec, mean, sd, n, k, replicates, seed, permute=True)
    edge = np.percentile(table, percentile, axis=0)
    out = df.sparkSession.createDataFrame(pd.DataFrame({
        "pc": np.arange(1, k + 1, dtype="int32"), "observed": observed, "null_percentile": edge, "null_mean": table.mean(0), "above_null": observed > edge,
    }))
    return leading_run(out, "pc", "above_null")


def leading_run(df: DataFrame, order: str, flag: str, out: str = "retained") -> DataFrame:
    """Flag the leading run of true rows; the first failure is one aggregate."""
    first = df.agg(F.min(F.when(~F.col(flag), F.col(order))).alias("__first"))
    joined = attach_row(df, first)
    return joined.withColumn(out, F.col("__first").isNull() | (F.col(order) < F.col("__first"))).drop("__first")


def ordered_eigenvalues(df: DataFrame, value: str, tie: str) -> DataFrame:
    """(pc, v) numbered by falling value; the table has one row per dimension."""
    return df.select(F.row_number().over(W.orderBy(F.desc(value), tie)).alias("pc"), F.col(value).alias("v"))


def component_counts(eigenvalues: DataFrame, rows: DataFrame) -> DataFrame:
    """Kaiser, Wax-Kailath AIC and MDL, and chord-distance elbow from the (pc, v) table.

    ``rows`` is the one-row table (n) of the number of observations.
    """
    tail = W.orderBy("pc").rowsBetween(0, W.unboundedFollowing)
    whole = W.orderBy("pc").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    e = eigenvalues.select(
        "pc", "v", F.avg("v").over(tail).alias("a"), F.avg(F.log("v")).over(tail).alias("g"), F.max("pc").over(whole).alias("p"),
        F.first("v").over(whole).alias("v1"), F.last("v").over(whole).alias("vp"),
    )
    e = attach_row(e, rows)
    k, p, n = F.col("pc") - 1, F.col("p"), F.col("n")
    llf = n * (p - k) * (F.log("a") - F.col("g"))
    nfree = k * (2 * p - k)
    chord = F.abs((F.col("vp") - F.col("v1")) * k - (p - 1) * F.col("v") + (p - 1) * F.col("v1"))
    return e.agg(
        F.count_if(F.col("v") > 1).alias("kaiser"), F.min_by(k, 2 * llf + 2 * nfree).alias("aic"),
        F.min_by(k, llf + 0.5 * nfree * F.log(n)).alias("mdl"), F.max_by("pc", chord).alias("elbow"),
    )
