"""Small text sources: file inventories, id lists, trait observations, result tables, sinks."""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.keys import compact_label, image_key
from ..functions.scalars import to_number


def file_inventory(spark: SparkSession, folder: str, glob: str = "*.{png,jpg,jpeg,tif,tiff}") -> DataFrame:
    """Path, size and key of every matching file below ``folder``; file contents are not read."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    )
    return files.select("path", "length", "modificationTime", image_key(F.col("path")).alias("image_key"))


# The image types that inputs are searched for.
IMAGE_TYPES = ["png", "jpg", "jpeg", "tif", "tiff"]


def listed_images(rows: DataFrame, column: str, base: str) -> DataFrame:
    """(path, image_key) of the images that a list names, each once; relative names are below ``base``.

    Blank names and names of other file types are left out; nothing is opened.
    """
    if column not in rows.columns:
        raise ValueError(f"the list lacks column {column!r}")
    name = F.trim(F.col(column).cast("string"))
    rooted = F.when(name.rlike("^(/|[A-Za-z][A-Za-z0-9+.-]*:)"), name).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), name))
    kind = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    out = rows.where(F.col(column).isNotNull() & kind.isin(IMAGE_TYPES)).select(rooted.alias("path")).distinct()
    return out.withColumn("image_key", image_key(F.col("path")))


def image_inputs(spark: SparkSession, source: str, column: str = "image_path") -> DataFrame:
    """(path, image_key) of a folder, a glob, one image or a CSV list of images (relative names next to the list)."""
    if source.lower().endswith(".csv"):
        return listed_images(spark.read.option("header", True).csv(source), column, source.rsplit("/", 1)[0] if "/" in source else ".")
    glob = "*.{" + ",".join(t for k in IMAGE_TYPES for t in (k, k.upper())) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    if not any(c in source for c in "*?[]"):
        files = files.option("recursiveFileLookup", "true")
    return files.load(source).select("path", image_key(F.col("path")).alias("image_key"))


def exclusion_keys(ids: DataFrame) -> DataFrame:
    """Distinct image keys of a list: the ``image_id`` column if there is one, else the first."""
    col = "image_id" if "image_id" in ids.columns else ids.columns[0]
    text = F.trim(F.col(col).cast("string"))
    return ids.where(F.col(col).isNotNull() & (text != "")).select(image_key(text).alias("image_key")).distinct()


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".csv"):
        return exclusion_keys(spark.read.option("header", True).csv(path))
    return exclusion_keys(spark.read.text(path))


def id_list(ids: DataFrame, column: str | None = None) -> DataFrame:
    """Distinct non-blank labels of a list, inner blanks removed."""
    col = column if column in ids.columns else ids.columns[0]
    label = compact_label(F.col(col))
    return ids.select(label.alias("genotype")).where(F.col("genotype").isNotNull() & (F.col("genotype") != "")).distinct()


def clean_observations(raw: DataFrame) -> DataFrame:
    """(canonical_name, env_id, genotype, value) with lenient numbers; incomplete rows dropped."""
    return raw.select(
        "canonical_name", "env_id", compact_label(F.col("genotype")).alias("genotype"), to_number(F.col("value")).alias("value")
    ).dropna()


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    return clean_observations(spark.read.option("sep", "\t").option("header", True).csv(path))


REGION_COLUMNS = {"trait": "string", "pos": "int", "p_value": "float"}
PROFILE_COLUMNS = {"genotype": "string", "group": "string", "profile": "array<float>"}


def save_table(df: DataFrame, path: str, required: dict[str, str], partition_by: list[str] | None = None) -> None:
    """Parquet write after a required-column check; required columns get their declared type."""
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"table lacks required columns: {absent}")
    for name, kind in required.items():
        df = df.withColumn(name, F.col(name).cast(kind))
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def load_table(spark: SparkSession, path: str, required: dict[str, str]) -> DataFrame:
    df = spark.read.parquet(path)
    kinds = dict(df.dtypes)
    wrong = [c for c, kind in required.items() if kinds.get(c) != kind]
    if wrong:
        raise ValueError(f"columns absent or of the wrong type: {wrong}")
    return df


def table_digest(df: DataFrame) -> str:
    """Digest of a table's rows in any order: their number and the sums of two halves of their hashes."""
    rows = F.xxhash64(*[F.col(c).cast("string") for c in sorted(df.columns)])
    again = F.xxhash64(F.lit(1), *[F.col(c).cast("string") for c in sorted(df.columns)])
    r = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(h.cast("decimal(38,0)")).alias(k) for k, h in (("a", rows), ("b", again))]).first()
    return hashlib.sha256(f"{r['n']}/{r['a']}/{r['b']}".encode()).hexdigest()


def save_results(spark: SparkSession, folder: str, results: dict[str, DataFrame | None], params: dict) -> dict:
    """One CSV folder per result and one JSON line about the run, which is also returned.

    The line holds the parameters, Spark's version and, for each result, its columns, rows, digest and
    seconds. A result that is None or has no rows is not written, and what an earlier run left under its name
    is removed, so that the folder never mixes runs.
    """
    jvm = spark.sparkContext._jvm
    meta: dict = {"params": params, "spark_version": spark.version, "results": {}}
    for name, df in results.items():
        began, path = time.time(), f"{folder}/{name}"
        if df is not None and not df.isEmpty():
            df.write.mode("overwrite").option("header", True).csv(path)
            saved = spark.read.option("header", True).csv(path)
            meta["results"][name] = {"columns": df.columns, "rows": saved.count(), "digest": table_digest(saved), "seconds": round(time.time() - began, 3)}
        else:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    line = spark.createDataFrame([(json.dumps(meta, sort_keys=True, default=str),)], "value string")
    line.coalesce(1).write.mode("overwrite").text(f"{folder}/run_metadata")
    return meta
