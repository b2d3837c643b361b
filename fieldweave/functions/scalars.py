"""Scalar expressions over scores, p-values, genotype calls and pixels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SMALLEST_DOUBLE = 4.9e-324


def finite(x: Column) -> Column:
    """NULL for NaN and infinities, which stand for missing values in the source files."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def to_number(text: Column) -> Column:
    """Lenient text-to-double: anything unparsable becomes NULL."""
    return finite(F.trim(text.cast("string")).try_cast("double"))


def percent_logit(pct: Column) -> Column:
    """ln(p / (100 - p)) without clipping; NULL at and beyond 0 and 100."""
    return F.when((pct > 0) & (pct < 100), F.log(pct / (100 - pct)))


def clipped_logit(proportion: Column, eps: float = 5e-5) -> Column:
    p = F.least(F.greatest(proportion, F.lit(eps)), F.lit(1.0 - eps))
    return F.log(p / (1 - p))


def log2_plus_one(x: Column) -> Column:
    return F.log2(x + 1)


def minus_log10(p: Column) -> Column:
    return -F.log10(F.greatest(p, F.lit(SMALLEST_DOUBLE)))


def dosage(call: Column) -> Column:
    """ALT allele count of a diploid call, phased or not; anything else is missing."""
    gt = F.split_part(call, F.lit(":"), F.lit(1))
    return (
        F.when(gt.isin("0/0", "0|0"), 0)
        .when(gt.isin("0/1", "1/0", "0|1", "1|0"), 1)
        .when(gt.isin("1/1", "1|1"), 2)
        .cast("tinyint")
    )


def effect_direction(standardized: Column) -> Column:
    return F.when(standardized > 0, "increases").when(standardized < 0, "decreases").otherwise("none")


def excess_green(r: Column, g: Column, b: Column) -> Column:
    """(2g - r - b) on channel shares; NULL for a black pixel."""
    return F.try_divide(2 * g - r - b, F.nullif(r + g + b, F.lit(0.0)))


def significance_stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def ld_tier(r2: Column, high: float = 0.5, mid: float = 0.3) -> Column:
    return F.when(r2 > high, "high").when(r2 > mid, "mid").otherwise("low")
