"""What several operators share: code shipping, shared folders, batch mapping, ordered neighbours."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

ROWS = 250  # rows handled at once, as Python objects
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application (they import it by name)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp()).resolve() / "fieldweave.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``, or under the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_fields(schema: T.StructType, **added: T.DataType) -> T.StructType:
    """Schema with the given fields; a field of that name is replaced where it stands."""
    fields = [T.StructField(f.name, added.get(f.name, f.dataType)) for f in schema.fields]
    have = {f.name for f in schema.fields}
    return T.StructType(fields + [T.StructField(n, t) for n, t in added.items() if n not in have])


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``ROWS`` rows, so that what is made of their texts is small, whatever a batch holds."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def map_columns(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, list]], drop: tuple[str, ...] = (), **added: T.DataType) -> DataFrame:
    """Apply ``fn`` to slices of every Arrow batch; it returns the new columns, the others pass through.

    A new column replaces an input column of the same name.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    schema = with_fields(df.drop(*drop).schema, **added)
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            new = fn(part)
            cols = [pa.array(new[f.name], f.type) if f.name in new else part.column(f.name).cast(f.type) for f in target]
            yield pa.RecordBatch.from_arrays(cols, schema=target)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A string column as Python strings, null as the empty string."""
    return [x or "" for x in batch.column(name).to_pylist()]


def lowest(*cols: str):
    return F.least(*(F.col(c) for c in cols))


def discard(df: DataFrame) -> None:
    """Delete the folder of a table made by ``stored`` once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


FILTER_BITS, FILTER_SLICES = 1 << 26, 64


def bitmap(rows: DataFrame, spots: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> np.ndarray:
    """A filter of ``bits`` bits (a power of two) with those set that ``spots`` names for the rows.

    Tasks set bits of their own, slices of them are merged in Spark, and only the merged slices come to the driver.
    """
    each = bits // FILTER_SLICES

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = np.unique(spots(batch))
            np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        cut = own.reshape(FILTER_SLICES, each // 8)
        some = np.flatnonzero(cut.any(axis=1))
        yield pa.RecordBatch.from_pydict({"slice": pa.array(some.astype(np.int32)), "bits": pa.array([zlib.compress(cut[i].tobytes(), 1) for i in some], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        whole = np.zeros(each // 8, np.uint8)
        for part in table.column("bits").to_pylist():
            whole |= np.frombuffer(zlib.decompress(part), np.uint8)
        return pa.table({"slice": table.column("slice").slice(0, 1), "bits": pa.array([zlib.compress(whole.tobytes(), 1)], pa.binary())})

    ship(rows.sparkSession)
    out = np.zeros((FILTER_SLICES, each // 8), np.uint8)
    parts = rows.mapInArrow(build, "slice int, bits binary").groupBy("slice").applyInArrow(merge, "slice int, bits binary")
    for r in parts.collect():  # at most FILTER_SLICES rows, ``bits`` bits in all
        out[r["slice"]] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return out.ravel()


def _spot(id_of: Column) -> Column:
    return F.pmod(F.xxhash64(id_of), F.lit(FILTER_BITS)).cast("int")


def flagged(rows: DataFrame, ids: DataFrame, id_of: Column) -> DataFrame:
    """The rows with ``__listed``: whether ``id_of`` may occur in the column id of ``ids``; surely not where it is false.

    A filter of hashed ids goes to every task as a table of its words of 64 bits, of which there are at most
    ``FILTER_BITS`` / 64; Spark builds it and looks it up, so no row goes through Python for it.
    """
    spots = ids.select(_spot(F.col("id")).alias("s"))
    words = spots.groupBy(F.expr("shiftright(s, 6)").alias("__word")).agg(F.expr("bit_or(shiftleft(1L, s & 63))").alias("__bits"))
    found = rows.withColumn("__spot", _spot(id_of)).join(F.broadcast(words), F.expr("shiftright(__spot, 6) = __word"), "left")
    return found.withColumn("__listed", id_of.isNotNull() & F.expr("coalesce(bit_get(__bits, __spot & 63) = 1, false)")).drop("__spot", "__word", "__bits")


def rows_with_ids(rows: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows whose bigint id occurs in ``ids``, without a shuffle of the others.

    What passes the filter of ``flagged``, the wanted rows and few more, is joined exactly. Rows without an id
    are left out.
    """
    wanted = ids.select(F.col(id_col).alias("id"))
    passed = flagged(rows, wanted, F.col(id_col)).where("__listed").drop("__listed")
    return passed.join(ids.select(id_col).distinct(), id_col, "left_semi")


def split_by_ids(rows: DataFrame, ids: DataFrame, id_of: Column) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``id_of`` may occur in the column id of ``ids``, rows where it surely does not or is null)."""
    found = flagged(rows, ids, id_of)
    return found.where("__listed").drop("__listed"), found.where("NOT __listed").drop("__listed")
