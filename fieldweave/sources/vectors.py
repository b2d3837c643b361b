"""Reading and writing vector tables: metadata columns plus one ``features`` array."""

from __future__ import annotations

import re
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.schema import split_columns
from ..functions.scalars import finite


def assemble_features(df: DataFrame, pattern: str, out: str = "features") -> DataFrame:
    """Pack the columns whose names match into one float array; metadata columns come first."""
    meta, feats = split_columns(df, pattern)
    if not feats:
        raise ValueError(f"no feature column matches {pattern!r}")
    packed = F.array(*[finite(F.col(f"`{c}`")).cast("float") for c in feats])
    return df.select(*meta, packed.alias(out))


def spread_features(df: DataFrame, names: list[str], vec: str = "features") -> DataFrame:
    """Array column back to named columns, in the given order."""
    meta = [c for c in df.columns if c != vec]
    return df.select(*meta, *[F.col(vec)[i].alias(n) for i, n in enumerate(names)])


def read_vectors(
    spark: SparkSession, path: str, pattern: str = r"^(embedding_(mean|std)_\d+|PC\d+|IC\d+)$", fmt: str = "parquet"
) -> DataFrame:
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", True)
    df = reader.load(path)
    if "features" in df.columns:
        return df
    return assemble_features(df, pattern)


def write_vectors(df: DataFrame, path: str, vec: str = "features", keep_backup: bool = True) -> str | None:
    """Write metadata first and features last, to a new folder that then takes the place of ``path``.

    The old folder, if any, is kept under a time-stamped name, so a table may be rewritten from
    itself. Returns the backup folder.
    """
    meta = [c for c in df.columns if c != vec]
    stage = f"{path.rstrip('/')}__new_{int(time.time() * 1000)}"
    df.select(*meta, vec).write.parquet(stage)
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    hadoop_path = jvm.org.apache.hadoop.fs.Path
    target = hadoop_path(path)
    fs = target.getFileSystem(conf)
    backup = None
    if fs.exists(target):
        backup = f"{path.rstrip('/')}__backup_{int(time.time() * 1000)}"
        fs.rename(target, hadoop_path(backup))
    fs.rename(hadoop_path(stage), target)
    if backup and not keep_backup:
        fs.delete(hadoop_path(backup), True)
        backup = None
    return backup


def crop_index_from_name(path):
    return F.nullif(F.regexp_extract(path, r"(?i)_(\d+)\.(?:png|npz)$", 1), F.lit("")).cast("int")


def union_source_schemas(*tables: DataFrame, path_col: str = "image_path") -> DataFrame:
    """Stack tables of different schemas; absent columns are null, crop index falls back to the file name."""
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    given = F.col("crop_index") if "crop_index" in df.columns else F.lit(None).cast("int")
    return df.withColumn("crop_index", F.coalesce(given, crop_index_from_name(F.col(path_col))))


def merge_vector_tables(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Append ``extra`` to ``base``: same features in the same order, no shared key.

    Metadata columns only in ``extra`` are dropped, missing ones are an error. The overlap test is
    one semi join whose result is limited to a single row.
    """
    missing = [c for c in base.columns if c not in extra.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    is_feature = re.compile(r"^(embedding_(mean|std)_\d+|PC\d+|IC\d+)$").match
    if [c for c in base.columns if is_feature(c)] != [c for c in extra.columns if is_feature(c)]:
        raise ValueError("feature columns differ in name or order")
    if extra.join(base.select(key), key, "left_semi").limit(1).count():
        raise ValueError(f"tables share values of {key}")
    return base.unionByName(extra.select(*base.columns))
