"""Cross-product sums of array columns: the one pass behind PCA, kinship and mixed models.

Each task folds its Arrow batches into products and emits their rows; Spark adds them up by row number
with a map-side combine. ``gram_tiles`` keeps the products in tiles, of which a task holds a bounded number
of bytes, and leaves the result in Spark, so neither a task nor the driver ever has all k x k numbers. For
algebra that needs a whole matrix, ``gram_matrices`` brings one to the driver; k (dimensions, samples
or design columns, never rows) is checked first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

MAX_DIM = 10_000
TILE = 1024
OPEN_BYTES = 256 << 20  # products a task holds before it hands some on
PIECE_ROWS = 1024  # long vectors that a task works on together


def array_matrix(column: pa.Array) -> np.ndarray:
    """List column to a rows x k float64 matrix; missing entries become NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten()
    if flat.null_count:
        flat = flat.cast(pa.float64()).fill_null(float("nan"))
    values = np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64)
    if n == 0:
        return values.reshape(0, 0)
    if values.size % n:
        raise ValueError("array rows have unequal lengths")
    return values.reshape(n, -1)


def list_column(m: np.ndarray) -> pa.Array:
    m = np.ascontiguousarray(m, dtype=np.float64)
    offsets = np.arange(0, m.size + 1, m.shape[1] if m.ndim == 2 and m.shape[1] else 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(m.reshape(-1)))


def pieces(batches: Iterator[pa.RecordBatch], rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into at most ``rows`` rows, for work whose matrices are many times its input."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def with_one(x: np.ndarray) -> np.ndarray:
    """Batch matrix with a leading column of ones."""
    return np.column_stack([np.ones(len(x)), x])


def gram_tiles(
    df: DataFrame, vec: str, by: str | None = None, prepare: Callable[[np.ndarray], np.ndarray] | None = None, tile: int = TILE, open_bytes: int = OPEN_BYTES,
) -> DataFrame:
    """(grp, i, j0, row): ``row[p] = sum over rows of v[i] * v[j0 + p]`` for the tiles on and above the diagonal.

    ``prepare`` maps a batch matrix before the product. Tiles beyond ``open_bytes`` a task are emitted early
    and added up later; their number is no limit.
    """
    src = df.select(*([F.col(by).cast("string").alias("grp")] if by else [F.lit("").alias("grp")]), vec)

    def emit(key: tuple[str, int, int], m: np.ndarray) -> pa.RecordBatch:
        name, i, j = key
        n = len(m)
        return pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(i, i + n, dtype=np.int32)), pa.array(np.full(n, j, np.int32)), list_column(m)], names=["grp", "i", "j0", "row"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int, int], np.ndarray] = {}
        size = 0
        for batch in pieces(batches):
            x = array_matrix(batch.column(1))
            x = x if prepare is None else prepare(x)
            names, codes = np.unique(np.asarray(batch.column(0).fill_null("").to_pylist(), dtype=str), return_inverse=True)
            for g, name in enumerate(names.tolist()):
                part = x if len(names) == 1 else x[codes == g]
                for i in range(0, x.shape[1], tile):
                    for j in range(i, x.shape[1], tile):
                        m = part[:, i:i + tile].T @ part[:, j:j + tile]
                        key = name, i, j
                        if key in held:
                            held[key] += m
                        else:
                            held[key] = m
                            size += m.nbytes
                        while size > open_bytes and len(held) > 1:
                            old = next(iter(held))
                            size -= held[old].nbytes
                            yield emit(old, held.pop(old))
        for key, m in held.items():
            yield emit(key, m)

    summed = src.mapInArrow(fold, "grp string, i int, j0 int, row array<double>").groupBy("grp", "i", "j0").agg(Summarizer.sum(array_to_vector("row")).alias("s"))
    return summed.select("grp", "i", "j0", vector_to_array("s").alias("row"))


def tile_entries(tiles: DataFrame) -> DataFrame:
    """(grp, i, j, v) with i <= j of tiles."""
    out = tiles.select("grp", "i", "j0", F.posexplode("row").alias("p", "v")).select("grp", "i", (F.col("j0") + F.col("p")).alias("j"), "v")
    return out.where("i <= j")


def gram_rows(
    df: DataFrame,
    vec: str,
    by: str | None = None,
    prepare: Callable[[np.ndarray], np.ndarray] | None = None,
    hold: int = 64,
) -> DataFrame:
    """Rows ``(by, i, row)`` with ``row[j] = sum over rows of v[i] * v[j]``, per value of ``by``.

    ``prepare`` maps a batch matrix before the product (centring, imputing, adding a constant
    column). At most ``hold`` matrices are open per task; older ones are emitted and summed later.
    """
    src = df.select(*([F.col(by).cast("string").alias("grp")] if by else [F.lit("").alias("grp")]), vec)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_sums: dict[str, np.ndarray] = {}

        def emit(key: str, m: np.ndarray) -> pa.RecordBatch:
            k = m.shape[0]
            return pa.RecordBatch.from_arrays(
                [pa.array([key] * k), pa.array(np.arange(k, dtype=np.int32)), list_column(m)],
                names=["grp", "i", "row"],
            )

        for batch in pieces(batches):
            x = array_matrix(batch.column(1))
            if prepare is not None:
                x = prepare(x)
            groups = np.asarray(batch.column(0).fill_null("").to_pylist(), dtype=object)
            names, codes = np.unique(groups.astype(str), return_inverse=True)
            for g, name in enumerate(names):
                part = x if len(names) == 1 else x[codes == g]
                m = part.T @ part
                if name in open_sums:
                    open_sums[name] += m
                else:
                    if len(open_sums) >= hold:
                        old = next(iter(open_sums))
                        yield emit(old, open_sums.pop(old))
                    open_sums[name] = m
        for name, m in open_sums.items():
            yield emit(name, m)

    partial = src.mapInArrow(fold, "grp string, i int, row array<double>")
    summed = partial.groupBy("grp", "i").agg(Summarizer.sum(array_to_vector("row")).alias("s"))
    return summed.select("grp", "i", vector_to_array("s").alias("row"))


def gram_matrices(
    df: DataFrame, vec: str, by: str | None = None, prepare: Callable[[np.ndarray], np.ndarray] | None = None,
    hold: int = 64, limit: int = MAX_DIM,
) -> dict[str, np.ndarray]:
    """Finished Gram matrices on the driver, keyed by group; refuses vectors longer than ``limit``.

    The length is read from one row first; unequal lengths fail inside the tasks.
    """
    first = df.select(F.size(vec).alias("k")).first()
    if first is None:
        return {}
    if first["k"] > limit:
        raise ValueError(f"{first['k']} dimensions exceed the limit of {limit}")
    out: dict[str, dict[int, np.ndarray]] = {}
    for r in gram_rows(df, vec, by, prepare, hold).toArrow().to_batches():
        if r.num_rows == 0:
            continue
        m = array_matrix(r.column(2))
        for j, (g, i) in enumerate(zip(r.column(0).to_pylist(), r.column(1).to_pylist())):
            out.setdefault(g, {})[i] = m[j]
    return {g: np.vstack([d[i] for i in range(len(d))]) for g, d in out.items()}


def vector_sums(df: DataFrame, keys: Sequence[str], vec: str, out: str = "sums") -> DataFrame:
    """Element-wise sum of an array column per group, combined map-side in the JVM."""
    return (
        df.groupBy(*keys)
        .agg(Summarizer.sum(array_to_vector(vec)).alias("__s"), F.count(F.lit(1)).alias("n_rows"))
        .select(*keys, vector_to_array("__s").alias(out), "n_rows")
    )


def vector_means(df: DataFrame, keys: Sequence[str], vec: str, *extra) -> DataFrame:
    """Element-wise mean of an array column per group, combined map-side in the JVM."""
    return (
        df.groupBy(*keys)
        .agg(Summarizer.mean(array_to_vector(vec)).alias("__m"), *extra)
        .withColumn(vec, vector_to_array("__m"))
        .drop("__m")
    )
