"""Label and key expressions. Every function maps Column(s) to a Column and stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Suffixes an image file name may carry, removed in this order.
IMAGE_SUFFIXES = [
    r"(?i)_\d+\.(png|npz)$",
    r"(?i)_leaf\.(png|npz)$",
    r"(?i)\.(jpg|jpeg|png|tif|tiff)$",
    r"-05_00$",
]
# Labels that stand for "no genotype".
PLACEHOLDER_LABELS = ["BORDER", "FILL", "CHECK", "MIXED", "GENOTYPE", "NAN", "NA", ""]


def image_key(path: Column) -> Column:
    """Canonical image id of a crop or image path: base name without its known suffixes."""
    base = F.regexp_extract(path.cast("string"), r"([^/]*)$", 1)
    return reduce(lambda c, pat: F.regexp_replace(c, pat, ""), IMAGE_SUFFIXES, base)


def coalesced_key(*paths: Column) -> Column:
    """First usable key over several path columns, row by row (null, empty and 'nan' skipped)."""
    def usable(p: Column) -> Column:
        k = image_key(p)
        return F.when(p.isNotNull() & ~k.isin("", "nan"), k)
    return F.coalesce(*[usable(p) for p in paths])


def compact_label(label: Column) -> Column:
    return F.regexp_replace(label.cast("string"), r"\s+", "")


def is_placeholder(label: Column) -> Column:
    """True for a missing label and for the placeholder vocabulary."""
    return label.isNull() | F.upper(compact_label(label)).isin(PLACEHOLDER_LABELS)


def is_ungenotyped(label: Column) -> Column:
    """True where an image carries no single marker-mappable line (missing, bulk or excluded)."""
    low = F.lower(F.trim(label.cast("string")))
    return label.isNull() | low.isin("", "mixed") | low.contains("exclude")


def interaction_label(left: Column, right: Column) -> Column:
    return F.concat_ws(":", left, right)


def nested_label(env: Column, level: Column) -> Column:
    return F.concat_ws("_", env, level)


def trait_env_label(trait: Column, env: Column) -> Column:
    return F.concat_ws("__", trait, env)


def marker_label(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    return F.concat_ws(":", chrom, pos, ref, alt)


def split_marker(label: Column) -> dict[str, Column]:
    part = lambda i: F.split_part(label, F.lit(":"), F.lit(i))
    return {
        "chrom": F.regexp_replace(part(1), "(?i)^chr", "").cast("int"),
        "pos": part(2).cast("long"),
        "ref": F.nullif(part(3), F.lit("")),
        "alt": F.nullif(part(4), F.lit("")),
    }


def natural_order(name: Column) -> list[Column]:
    """Sort key that puts IC2 before IC10: text stem, then the last number."""
    return [
        F.regexp_replace(name, r"\d+$", ""),
        F.nullif(F.regexp_extract(name, r"(\d+)$", 1), F.lit("")).cast("long"),
    ]
