"""Embedding near-duplicates by a pivot-permutation index.

A bounded sample of vectors serves as pivots. Each vector is described by its nearest pivots in
order; inverted lists hold, for every label and pivot, the vectors that have it among the first
``head``. Two vectors are compared exactly if their ``prefix`` nearest pivots share ``shared`` or
more: two such sets of equal size must meet in what remains of both once the ``shared`` - 1
farthest of a common order are left out, so only that part is posted (``head`` = prefix - shared
+ 1, in the order of pivot numbers). A pair is counted in the list of the first pivot that both
posted, hence once. Lists are cut into blocks and pairs of blocks are compared as matrices, so no
list is ever one task's and no pair is ever a row: a block pair gives the links of each vector and
a spanning forest of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from fieldweave.llm.common import ship, stored
from fieldweave.llm.components import connected


def unit_rows(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """Which vectors can be compared (finite, not zero, no nulls), and their unit forms."""
    out: list[np.ndarray | None] = []
    for v in batch.column(name):
        x = v.values if v.is_valid else None
        if x is None or not len(x) or x.null_count:
            out.append(None)
            continue
        x = x.to_numpy(zero_copy_only=False).astype(np.float64)
        with np.errstate(all="ignore"):
            top = np.abs(x).max()
            norm = np.linalg.norm(x / top) if np.isfinite(top) and top > 0 else 0.0
            out.append(x / top / norm if norm > 0 else None)
    return np.array([x is not None for x in out]), out


def nearest(unit: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of the ``prefix`` nearest pivots of each vector, nearest first."""
    near = unit @ pivots.T
    prefix = min(prefix, len(pivots))
    best = np.argpartition(-near, prefix - 1, axis=1)[:, :prefix]
    return np.take_along_axis(best, np.argsort(-np.take_along_axis(near, best, axis=1), axis=1, kind="stable"), axis=1).astype(np.int32)


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of a square or rectangular 0/1 matrix whose two sides are different nodes."""
    rows, cols = links.shape
    todo_r, todo_c = np.ones(rows, bool), np.ones(cols, bool)
    edges: list[tuple[int, int]] = []
    for r in range(rows):
        if not todo_r[r]:
            continue
        todo_r[r], front = False, [r]
        while front:
            i = front.pop()
            new = np.flatnonzero(links[i] & todo_c)
            todo_c[new] = False
            for j in new.tolist():
                edges.append((i, j))
                back = np.flatnonzero(links[:, j] & todo_r)
                todo_r[back] = False
                edges += [(b, j) for b in back.tolist()]
                front += back.tolist()
    return edges


def _matrix(column: pa.ChunkedArray, dim: int, kind: str) -> np.ndarray:
    rows = np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(np.float64)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _lists(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def compare_blocks(table: pa.Table, kind: str, least: float, pivots: int, prefix: int, shared: int) -> pa.Table:
    """Degrees (a, null, n) and forest edges (a, b, null) of one pair of blocks of one inverted list."""
    key = {c: table.column(c)[0].as_py() for c in ("dim", "pivot", "i", "j")}
    unit, near = _matrix(table.column("raw"), key["dim"], kind), _lists(table.column("near"))
    ids, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
    at = table.column("at").to_numpy()
    left, right = np.flatnonzero(at == key["i"]), np.flatnonzero(at == key["j"])
    head = np.sort(near, axis=1)[:, :near.shape[1] - min(shared, near.shape[1]) + 1]
    sets = np.zeros((len(ids), pivots), np.float32)
    np.put_along_axis(sets, near.astype(np.int64), 1, axis=1)
    found = (sets[left] @ sets[right].T >= min(shared, near.shape[1])) & (unit[left] @ unit[right].T >= least)
    if key["i"] == key["j"]:
        found &= ids[left][:, None] < ids[right][None, :]
    earlier = np.zeros((len(ids), pivots), np.float32)  # pivots posted before this list's: such pairs belong to another list
    np.put_along_axis(earlier, head.astype(np.int64), 1, axis=1)
    earlier[:, key["pivot"]:] = 0
    found &= earlier[left] @ earlier[right].T < 0.5
    n = np.zeros(len(ids), np.int64)
    n[left] += found @ copies[right]
    n[right] += found.T @ copies[left]
    some = np.flatnonzero(n)
    edges = np.array(forest(found), np.int64).reshape(-1, 2)
    a, b = ids[left][edges[:, 0]], ids[right][edges[:, 1]]
    none = lambda k: pa.nulls(k, pa.int64())
    return pa.table({"a": pa.concat_arrays([pa.array(ids[some]), pa.array(a)]), "b": pa.concat_arrays([none(len(some)), pa.array(b)]), "n": pa.concat_arrays([pa.array(n[some]), none(len(a))])})


def described(vectors: DataFrame, kind: str, pivots: int, prefix: int, seed: int) -> DataFrame:
    """Adds ``near``, the nearest pivots of each distinct vector, numbered from the rarest to the commonest."""
    common = vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).first()
    sample = vectors.where(F.col("dim") == (common[0] if common else 0)).select("raw").orderBy(F.xxhash64("raw", F.lit(seed)), "raw").limit(pivots).collect()
    dim = common[0] if common else 0
    chosen = _matrix(pa.chunked_array([[r[0] for r in sample]], pa.binary()), dim, kind) if sample else np.empty((0, 0))
    at = vectors.sparkSession.sparkContext.broadcast(chosen)  # at most ``pivots`` vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, out = batch.column("dim").to_numpy(), [None] * batch.num_rows
            for d in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == d)
                points = at.value if d == dim else np.random.default_rng(seed).standard_normal((pivots, d))
                for i, x in zip(mine, nearest(_matrix(pa.chunked_array([batch.column("raw").take(pa.array(mine))]), d, kind), points, prefix)):
                    out[i] = x
            yield batch.append_column("near", pa.array(out, pa.list_(pa.int32())))

    schema = T.StructType(vectors.schema.fields + [T.StructField("near", T.ArrayType(T.IntegerType()))])
    out = stored(vectors.mapInArrow(run, schema), "near")
    counts = {r[0]: r[1] for r in out.select(F.explode("near").alias("p")).groupBy("p").agg(F.count(F.lit(1))).collect()}  # at most ``pivots`` rows
    order = sorted(range(pivots), key=lambda p: (counts.get(p, 0), p))
    rank = F.array(*(F.lit(order.index(p)) for p in range(pivots)))
    return out.withColumn("near", F.transform("near", lambda x: F.get(rank, x)))


def vector_links(vectors: DataFrame, kind: str, least: float, pivots: int, prefix: int, shared: int, block: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Links of distinct vectors (rep, copies, label, dim, raw): degrees (id, n) and joining edges (a, b)."""
    rows = described(vectors, kind, pivots, prefix, seed)
    head = F.greatest(F.lit(1), F.size("near") - shared + 1)
    posts = rows.withColumn("pivot", F.explode(F.slice(F.array_sort("near"), F.lit(1), head)))
    sizes = posts.groupBy("label", "dim", "pivot").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    posts = posts.join(sizes, ["label", "dim", "pivot"])
    blocks = F.ceil(F.col("n") / block).cast("int")
    posts = posts.withColumn("blocks", blocks).withColumn("at", F.pmod(F.xxhash64("rep", F.lit(seed)), F.col("blocks")).cast("int"))
    posts = posts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    posts = posts.withColumn("i", F.least("at", "other")).withColumn("j", F.greatest("at", "other"))
    ship(vectors.sparkSession)
    run = lambda table: compare_blocks(table, kind, least, pivots, prefix, shared)
    out = posts.select("label", "dim", "pivot", "i", "j", "at", "rep", "copies", "raw", "near").groupBy("label", "dim", "pivot", "i", "j").applyInArrow(run, "a long, b long, n long")
    out = stored(out, "vector_links")
    return out.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n")), out.where("b IS NOT NULL").select("a", "b")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.93,
                 pivots: int = 256, prefix: int = 10, shared: int = 2, block: int = 512, seed: int = 7) -> DataFrame:
    """(id, n_links, component_id, kept): near-duplicate vectors among those of one label, one row per input row.

    Null, empty or zero vectors, vectors with null or non-finite components, and rows without a label
    link with nothing, nor do vectors of different lengths. Ids are integers and name vectors: rows
    that repeat an id are one vector (that of the least label and bytes). A row without an id has
    no links, a null component and is kept. An empty table gives no rows; other columns are not read.
    Equal vectors are compared as one, so a group of copies of any size is a single point.
    """
    kind = "<f4" if isinstance(vectors.schema[vec_col].dataType.elementType, T.FloatType) else "<f8"
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, unit = unit_rows(batch, "v")
            at = np.flatnonzero(good)
            raw = [(batch.column("v")[i].values.to_numpy(zero_copy_only=False) if kind == "<f4" else unit[i]).astype(kind) + 0 for i in at.tolist()]
            where = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(where), batch.column("label").take(where), pa.array([len(x) for x in raw], pa.int32()), pa.array([x.tobytes() for x in raw], pa.binary())], ["id", "label", "dim", "raw"])

    ship(vectors.sparkSession)
    good = plain.where("id IS NOT NULL AND label IS NOT NULL").mapInArrow(run, "id long, label string, dim int, raw binary")
    good = good.groupBy("id").agg(F.min(F.struct("label", "dim", "raw")).alias("x")).select("id", "x.*")
    named = stored(good.withColumn("same", F.sha2(F.concat("raw", F.encode("label", "UTF-8")), 256)), "vectors")
    first = named.groupBy("same").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    distinct = stored(named.join(first, named["id"] == first["rep"], "left_semi").join(first.select("rep", "copies"), F.col("id") == F.col("rep")).select("rep", "copies", "label", "dim", "raw"), "distinct")
    degrees, edges = vector_links(distinct, kind, least, pivots, prefix, shared, block, seed)
    whole = connected(edges)
    per = first.join(degrees, first["rep"] == degrees["id"], "left").drop("id").join(whole, F.col("rep") == whole["id"], "left")
    per = per.select("same", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    out = named.select("id", "same").join(per, "same").select(F.col("id").alias("__id"), "n_links", "c")
    out = plain.select("id").join(out, F.col("id") == F.col("__id"), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
