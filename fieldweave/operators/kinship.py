"""Marker vectors, kinship and genotype components.

The marker dimension is unbounded and stays in Spark; the sample dimension is a checked list
(default limit 10,000), because kinship is samples x samples. One pass over the markers sums the raw
products of [1, g] per chromosome; kinship of any sample subset, with or without a chromosome, and
its allele-frequency centring follow from those sums (VanRaden 2008; leave-one-chromosome-out as in
Yang et al. 2014), because centring by marker mean is a double centring of the raw product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .crossproducts import TILE, gram_matrices, gram_tiles, list_column, pieces, tile_entries

SAMPLE_LIMIT = 10_000


def sample_list(df: DataFrame, column: str = "sample", limit: int = SAMPLE_LIMIT) -> list[str]:
    """Sorted distinct samples; refuses more than ``limit``."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} samples")
    return sorted(r[0] for r in rows)


def marker_vectors(calls: DataFrame, samples: list[str], absent: float = float("nan")) -> DataFrame:
    """(marker, chrom, pos, dosage): one array per marker in sample order.

    ``absent`` fills samples without a call row (NaN = missing, 0 = reference). A marker's list is
    bounded by the sample list.
    """
    n = len(samples)
    index = calls.sparkSession.createDataFrame(pd.DataFrame({"sample": samples, "__i": np.arange(n, dtype="int32")}))
    sparse = calls.join(index, "sample").groupBy("marker", "chrom", "pos").agg(
        F.collect_list(F.struct(F.col("__i").alias("i"), F.col("dosage").cast("double").alias("d"))).alias("cells")
    ).select("marker", "chrom", "pos", F.col("cells.i").alias("i"), F.col("cells.d").alias("d"))

    def densify(batches):
        for b in pieces(batches):
            at, val = b.column(3), b.column(4)
            rows = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(at.offsets)))
            m = np.full((b.num_rows, n), absent)
            d = val.flatten()
            m[rows, at.flatten().to_numpy()] = np.asarray(d.fill_null(float("nan")).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), list_column(m)], names=["marker", "chrom", "pos", "dosage"])

    kind = dict(calls.dtypes)
    return sparse.mapInArrow(densify, f"marker string, chrom {kind['chrom']}, pos {kind['pos']}, dosage array<double>")


def mean_imputed(x: np.ndarray) -> np.ndarray:
    """Missing entries to the marker mean (0 for a marker without calls)."""
    miss = np.isnan(x)
    if not miss.any():
        return x
    seen = (~miss).sum(1)
    mean = np.where(seen > 0, np.where(miss, 0.0, x).sum(1) / np.maximum(seen, 1), 0.0)
    return np.where(miss, mean[:, None], x)


def raw_products(markers: DataFrame, limit: int = SAMPLE_LIMIT) -> dict[str, np.ndarray]:
    """Per chromosome: sum over markers of [1, g]'[1, g], g mean-imputed."""
    prep = lambda x: np.column_stack([np.ones(len(x)), mean_imputed(x)])
    return gram_matrices(markers, "dosage", by="chrom", prepare=prep, limit=limit)


def kinship_from_products(g: np.ndarray, subset: np.ndarray | None = None) -> np.ndarray:
    """VanRaden kinship of the given samples from a raw product sum."""
    idx = np.arange(1, len(g)) if subset is None else np.asarray(subset) + 1
    n = len(idx)
    sub = g[np.ix_(idx, idx)]
    row = sub.mean(1)
    centred = sub - row[:, None] - row[None, :] + sub.mean()
    scale = g[0, idx].sum() / n - sub.sum() / (2.0 * n * n)
    return centred / scale if scale > 0 else np.zeros_like(centred)


def loco_products(products: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    total = sum(products.values())
    return {c: total - g for c, g in products.items()}


def kinship_pairs(markers: DataFrame, samples: list[str], tile: int = TILE) -> DataFrame:
    """(sample_a, sample_b, kinship) for pairs in order of the sample list, a sample with itself among them.

    VanRaden kinship as in :func:`kinship_from_products`, but by tiles: products, centring and result stay
    in Spark, so the number of samples may go beyond what a driver's matrix takes.
    """
    prep = lambda x: np.column_stack([np.ones(len(x)), mean_imputed(x)])
    cells = cut_lineage(gram_tiles(markers, "dosage", prepare=prep, tile=tile))
    cells = tile_entries(cells).drop("grp")
    inner = cells.where("i > 0")
    ways = inner.select("i", "v").unionAll(inner.where("i < j").select(F.col("j").alias("i"), "v"))
    n = len(samples)
    row = ways.groupBy("i").agg((F.sum("v") / n).alias("m"))
    mean = row.agg(F.avg("m")).scalar()
    scale = cells.where("i = 0 AND j > 0").agg(F.sum("v") / n).scalar() - mean / 2.0
    names = markers.sparkSession.createDataFrame(pd.DataFrame({"k": np.arange(1, n + 1, dtype="int32"), "sample": samples}))
    side = lambda k, x: row.join(names, row["i"] == names["k"]).select(F.col("i").alias(k), F.col("m").alias(f"m_{x}"), F.col("sample").alias(f"sample_{x}"))
    out = inner.join(side("i", "a"), "i").join(side("j", "b"), "j")
    centred = F.col("v") - F.col("m_a") - F.col("m_b") + mean
    return out.select("sample_a", "sample_b", F.when(scale > 0, centred / scale).otherwise(0.0).alias("kinship"))


def components_of(k: np.ndarray, n: int) -> np.ndarray:
    """Leading eigenvectors of a kinship matrix, largest entry positive."""
    val, vec = np.linalg.eigh(k)
    top = vec[:, np.argsort(val)[::-1][:n]]
    return top * np.sign(top[np.abs(top).argmax(0), np.arange(top.shape[1])])
