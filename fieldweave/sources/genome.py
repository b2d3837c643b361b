"""Text genome formats as Spark jobs over lines: genotype calls, gene models, annotations, expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import dosage

FIXED_FIELDS = 9


def sample_names(lines: DataFrame) -> list[str]:
    """Sample ids of the ``#CHROM`` header line (bounded by the panel size)."""
    head = lines.where(F.col("value").startswith("#CHROM")).first()
    if head is None:
        raise ValueError("no #CHROM header line")
    return head["value"].rstrip("\n").split("\t")[FIXED_FIELDS:]


def calls_from_lines(lines: DataFrame, samples: list[str], region: tuple[str, int, int] | None = None) -> DataFrame:
    """Genotype lines to ``(marker, chrom, pos, ref, alt, sample, dosage)``.

    The region test runs on the split fields before the per-sample explode.
    """
    f = F.split("value", "\t")
    rec = lines.where(~F.col("value").startswith("#") & (F.col("value") != "")).select(
        f[0].alias("chrom"),
        f[1].cast("long").alias("pos"),
        f[2].alias("id"),
        f[3].alias("ref"),
        f[4].alias("alt"),
        F.slice(f, FIXED_FIELDS + 1, len(samples)).alias("gts"),
    )
    if region is not None:
        chrom, lo, hi = region
        rec = rec.where((F.col("chrom") == str(chrom)) & F.col("pos").between(lo, hi))
    marker = F.when(F.col("id").isin(".", ""), F.concat_ws(":", "chrom", "pos", "ref", "alt")).otherwise(F.col("id"))
    names = F.array(*[F.lit(s) for s in samples])
    long = rec.select(marker.alias("marker"), "chrom", "pos", "ref", "alt", F.posexplode("gts").alias("k", "gt"))
    return long.select("marker", "chrom", "pos", "ref", "alt", names[F.col("k")].alias("sample"), dosage(F.col("gt")).alias("dosage"))


def read_calls(spark: SparkSession, path: str, region: tuple[str, int, int] | None = None) -> DataFrame:
    lines = spark.read.text(path)
    return calls_from_lines(lines, sample_names(lines), region)


def _attribute(col: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(col, rf"(?:^|;){name}=([^;]*)", 1), F.lit(""))


def gene_models_from_lines(lines: DataFrame) -> DataFrame:
    """GFF3 lines to ``(chrom, kind, start, end, strand, id, parent, name)``."""
    f = F.split("value", "\t")
    return lines.where(~F.col("value").startswith("#") & (F.size(f) >= 9)).select(
        f[0].alias("chrom"),
        f[2].alias("kind"),
        f[3].cast("long").alias("start"),
        f[4].cast("long").alias("end"),
        f[6].alias("strand"),
        _attribute(f[8], "ID").alias("id"),
        _attribute(f[8], "Parent").alias("parent"),
        _attribute(f[8], "Name").alias("name"),
    )


def read_gene_models(spark: SparkSession, path: str) -> DataFrame:
    return gene_models_from_lines(spark.read.text(path))


def impact_variants(ann: DataFrame, chrom, lo: int, hi: int, impacts: str = "HIGH|MODERATE") -> DataFrame:
    """Variants of the given impact in a region with their first gene and protein change."""
    return ann.where(
        (F.col("chrom") == chrom) & F.col("pos").between(lo, hi) & F.col("impacts").rlike(impacts)
    ).withColumns({"gene": F.split("genes", "[,;]")[0], "protein_change": F.split("hgvs_p", "[,;]")[0]})


def expression_long(matrix: DataFrame, genes: list[str] | None = None, gene_col: str = "gene") -> DataFrame:
    """Gene x sample matrix to ``(gene, sample, tpm)``; the gene list is pushed to the scan."""
    if genes is not None:
        matrix = matrix.where(F.col(gene_col).isin(genes))
    samples = [c for c in matrix.columns if c != gene_col]
    return matrix.unpivot([gene_col], samples, "sample", "tpm")
