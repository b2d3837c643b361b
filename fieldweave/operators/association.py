"""Marker-level tables: lookup, allele counts, linkage, single-marker tests and their rules."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.pvalues import student_t_p
from .correlate import covariance_array, stacked, swept
from .crossproducts import array_matrix, pieces
from .kinship import mean_imputed
from .onerow import attach_row
from .ranking import value_ranks


def find_marker(markers: DataFrame, label: str) -> DataFrame:
    """The one marker with this id, else the one at CHROM:POS[:REF:ALT]; anything but one is an error.

    A place reads like the labels of :func:`functions.keys.split_marker`: the last parts are position and
    alleles, so chromosome names may hold underscores. One pass finds hits of both kinds.
    """
    place = re.fullmatch(r"(.+?)[:_](\d+)(?:[:_]([ACGTN*]+)[:_]([ACGTN*]+))?", label, re.IGNORECASE)
    there = F.lit(False)
    if place:
        chrom, pos, ref, alt = place.groups()
        there = (F.col("chrom").cast("string") == chrom) & (F.col("pos") == int(pos))
        if ref:
            there = there & (F.col("ref") == ref) & (F.col("alt") == alt)
    named = F.col("marker") == label
    hits = markers.where(named | there).withColumn("__named", F.coalesce(named, F.lit(False)))
    n = hits.agg(F.count_if("__named").alias("a"), F.count(F.lit(1)).alias("b")).first()
    found = n["a"] or n["b"]
    if found != 1:
        raise ValueError(f"marker {label!r} is {'ambiguous' if found else 'unknown'}")
    return (hits.where("__named") if n["a"] else hits).drop("__named")


def minor_alleles(calls: DataFrame) -> DataFrame:
    alt, n = F.sum("dosage"), F.count("dosage")
    return calls.groupBy("marker").agg(
        alt.alias("n_alt"), (2 * n - alt).alias("n_ref"), F.when(alt <= n, "ALT").otherwise("REF").alias("minor")
    )


def status_order(status: Column, first: list[str], p: Column, *ties: str) -> list[Column]:
    """Sort key of result tables: status in the given order, then p (missing last), then labels."""
    return [status_place(status, first).asc(), p.asc_nulls_last(), *[F.col(c).asc() for c in ties]]


def status_place(status: Column, first: list[str]) -> Column:
    return F.coalesce(*[F.when(status == s, i) for i, s in enumerate(first)], F.lit(len(first)))


def status_positions(df: DataFrame, status: str, first: list[str], p: str) -> DataFrame:
    """Position of every row in the status-ordered result (ties share the smaller position), without
    a global sort: ranks inside each status plus the sizes of the statuses before it."""
    placed = df.withColumn("__place", status_place(F.col(status), first))
    sizes = placed.groupBy("__place").agg(F.count(F.lit(1)).alias("__n"), F.count(p).alias("__with_p"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__place", "__with_p", before.alias("__before"))
    ranks = value_ranks(placed, ["__place"], p).select("__place", p, "below")
    j = placed.join(sizes, "__place").join(ranks, ["__place", p], "left")
    pos = F.col("__before") + F.coalesce("below", "__with_p") + 1
    return j.withColumn("position", pos).drop("__place", "__n", "__with_p", "__before", "below")


# ---------------------------------------------------------------- linkage
def linkage(calls: DataFrame, lead: str, min_calls: int = 50, impute: bool = True) -> DataFrame:
    """r2 of every marker with a lead marker over samples.

    With ``impute``, a missing dosage counts as its marker's mean (the mean of the observed calls),
    so means stay, products with a missing partner vanish and only the divisor changes; the sums
    are therefore taken over observed pairs and nothing is filled in row by row.
    """
    d = F.col("dosage").cast("double")
    ld = calls.where(F.col("marker") == lead).select("sample", d.alias("__l"))
    seen = ld.where(F.col("__l").isNotNull())
    st = seen.agg(F.avg("__l").alias("__lm"), F.sum((F.col("__l")) * F.col("__l")).alias("__ll"), F.count(F.lit(1)).alias("__ln"))
    pairs = calls.select("marker", "chrom", "pos", "sample", d.alias("x")).where("x IS NOT NULL").join(seen, "sample", "left")
    both = F.when(F.col("__l").isNotNull(), F.col("x"))
    s = pairs.groupBy("marker", "chrom", "pos").agg(
        F.count("x").alias("n_calls"), F.avg("x").alias("xm"), F.var_pop("x").alias("xv"),
        F.count("__l").alias("n"), F.sum(both * F.col("__l")).alias("sxl"), F.sum(both).alias("sx"), F.sum("__l").alias("sl"),
        F.covar_pop(both, F.col("__l")).alias("c"), F.var_pop(both).alias("vx"), F.var_pop("__l").alias("vl"),
    ).where(F.col("n_calls") >= min_calls)
    if impute:
        s = attach_row(s, st)
        cross = F.col("sxl") - F.col("xm") * F.col("sl") - F.col("__lm") * F.col("sx") + F.col("n") * F.col("xm") * F.col("__lm")
        sxx = F.col("xv") * F.col("n_calls")
        sll = F.col("__ll") - F.col("__ln") * F.col("__lm") * F.col("__lm")
        r2 = F.when((sxx > 0) & (sll > 0), F.try_divide(cross * cross, sxx * sll))
    else:
        r2 = F.when((F.col("vx") > 0) & (F.col("vl") > 0), F.try_divide(F.col("c") * F.col("c"), F.col("vx") * F.col("vl")))
    return s.select("marker", "chrom", "pos", "n_calls", r2.alias("r2"))


def _cross_sums(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """(n, sx, sy, sxx, syy, sxy) over the pairs complete in a marker row of x and a column of y: six matrix products."""
    mx, my = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
    x0, y0 = np.where(mx > 0, x, 0.0), np.where(my > 0, y, 0.0)
    return mx @ my, x0 @ my, mx @ y0, (x0 * x0) @ my, mx @ (y0 * y0), x0 @ y0


def _moments(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """(n, sxx, syy, sxy), the last three about the means of the complete pairs; tiny spreads count as none."""
    n, sx, sy, sxx, syy, sxy = _cross_sums(x, y)
    m = np.maximum(n, 1)
    cxx, cyy = sxx - sx * sx / m, syy - sy * sy / m
    return n, np.where(cxx > 1e-10 * np.maximum(sxx, 1e-300), cxx, 0.0), np.where(cyy > 1e-12 * np.maximum(syy, 1e-300), cyy, 0.0), sxy - sx * sy / m


def linkage_vectors(markers: DataFrame, lead: str, min_calls: int = 50, impute: bool = True) -> DataFrame:
    """(marker, chrom, pos, n_calls, r2) with a lead marker, from dosage arrays (NaN or null missing).

    With ``impute`` a missing dosage counts as its marker's mean. The lead's array, one number a sample,
    travels to the tasks; the panel is read once and never unfolded.
    """
    own = markers.where(F.col("marker") == lead).select("dosage").first()
    if own is None:
        raise ValueError(f"marker {lead!r} is unknown")
    y = np.array([np.nan if v is None else v for v in own[0]], float)[:, None]
    if impute:
        y = mean_imputed(y.T).T
    kind = dict(markers.dtypes)

    def run(batches):
        for b in pieces(batches):
            x = array_matrix(b.column(3))
            calls = (~np.isnan(x)).sum(1)
            n, sxx, syy, sxy = (v[:, 0] for v in _moments(mean_imputed(x) if impute else x, y))
            ok = (sxx > 0) & (syy > 0)
            r2 = np.where(ok, sxy * sxy / np.where(ok, sxx * syy, 1.0), np.nan)
            keep = pa.array(np.flatnonzero(calls >= min_calls))
            cols = [b.column(0), b.column(1), b.column(2), pa.array(calls.astype(np.int64)), pa.array(r2, mask=~ok)]
            yield pa.RecordBatch.from_arrays([c.take(keep) for c in cols], names=["marker", "chrom", "pos", "n_calls", "r2"])

    return markers.select("marker", "chrom", "pos", "dosage").mapInArrow(run, f"marker string, chrom {kind['chrom']}, pos {kind['pos']}, n_calls long, r2 double")


def marker_trait_effects(markers: DataFrame, y: np.ndarray, traits: list[str], min_n: int = 3) -> DataFrame:
    """(trait, marker, chrom, pos, n, effect, se, t, r2, p_value): every marker against every trait by least squares.

    ``y`` is samples x traits (NaN missing) in the order of the dosage arrays; each pair uses the samples
    complete in both. A piece of a batch of markers takes six matrix products for all traits together. Pairs without
    spread in the dosage, or with fewer than three samples, have null effects.
    """
    shared = markers.sparkSession.sparkContext.broadcast(y - np.nanmean(np.where(np.isnan(y).all(0), 0.0, y), axis=0))  # samples x traits
    kind = dict(markers.dtypes)

    def run(batches):
        for b in pieces(batches):
            n, sxx, syy, sxy = _moments(array_matrix(b.column(3)), shared.value)
            ok = (sxx > 0) & (n > 2)
            slope = np.where(ok, sxy / np.where(sxx > 0, sxx, 1.0), np.nan)
            rss = np.maximum(syy - slope * sxy, 0.0)
            se = np.sqrt(rss / np.maximum(n - 2, 1) / np.where(sxx > 0, sxx, 1.0))
            at, t = np.nonzero(n >= min_n)
            rows = pa.array(at)
            num = lambda v, good: pa.array(v[at, t], mask=~good[at, t])
            with np.errstate(divide="ignore", invalid="ignore"):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(traits, pa.string()).take(pa.array(t)), b.column(0).take(rows), b.column(1).take(rows), b.column(2).take(rows), pa.array(n[at, t].astype(np.int64)),
                     num(slope, ok), num(se, ok), num(slope / se, ok & (se > 0)), num(1 - rss / syy, ok & (syy > 0)), pa.array(n[at, t] - 2.0)],
                    names=["trait", "marker", "chrom", "pos", "n", "effect", "se", "t", "r2", "df"],
                )

    out = markers.select("marker", "chrom", "pos", "dosage").mapInArrow(
        run, f"trait string, marker string, chrom {kind['chrom']}, pos {kind['pos']}, n long, effect double, se double, t double, r2 double, df double")
    return out.withColumn("p_value", student_t_p(F.col("t"), F.col("df"))).drop("df")


def block_extent(ld: DataFrame, thresholds: list[float]) -> DataFrame:
    """Span and marker count of the block around a lead at each r2 threshold."""
    cuts = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    hit = ld.select("chrom", "pos", "r2", cuts.alias("threshold")).where(F.col("r2") > F.col("threshold"))
    return hit.groupBy("threshold", "chrom").agg(
        F.min("pos").alias("start"), F.max("pos").alias("end"), F.count(F.lit(1)).alias("n_markers")
    )


# ---------------------------------------------------------------- least squares from sums
@F.pandas_udf(StructType([StructField(c, DoubleType()) for c in ("effect", "se", "t", "df", "r2")]))
def _ols_first(n: pd.Series, cov: pd.Series) -> pd.DataFrame:
    """Effect of the first predictor from n and the flat covariance of (y, x, covariates...)."""
    rows, c = stacked(cov)
    out = np.full((len(n), 5), np.nan)
    if len(rows):
        k = c.shape[1]
        df = n.to_numpy(float)[rows] - k
        a, used = swept(c, range(1, k))
        ok = (df > 0) & used.all(1) & np.isfinite(c).all((1, 2))
        rss = np.maximum(a[:, 0, 0], 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            se = np.sqrt(rss * -a[:, 1, 1] / df)
            got = np.column_stack([a[:, 0, 1], se, np.where(se > 0, a[:, 0, 1] / se, np.nan), df, np.where(c[:, 0, 0] > 0, 1 - rss / c[:, 0, 0], np.nan)])
        out[rows] = np.where(ok[:, None], got, np.nan)
    table = pd.DataFrame(out, columns=["effect", "se", "t", "df", "r2"])
    return table.astype(object).where(table.notna(), None)


def ols_effects(df: DataFrame, keys: list[str], y: str, predictors: list[str], min_n: int = 3) -> DataFrame:
    """Per group: least-squares effect of the first predictor given the others, with t-test p.

    The aggregate holds a (k + 1) x (k + 1) covariance per group and combines map-side; the solve
    runs on those small rows.
    """
    cols = [y, *predictors]
    s = df.dropna(subset=cols).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), covariance_array(cols).alias("__c")).where(F.col("n") >= min_n)
    f = s.withColumn("__f", _ols_first(F.col("n").cast("double"), "__c"))
    return f.select(*keys, "n", "__f.effect", "__f.se", "__f.t", "__f.r2", student_t_p(F.col("__f.t"), F.col("__f.df")).alias("p_value"))


def conditional_effects(cells: DataFrame, keys: list[str], y: str, marker: str, other: str) -> DataFrame:
    """Effect of a marker alone, given the other predictor, and of the other given the marker."""
    alone = ols_effects(cells, keys, y, [marker]).select(*keys, "n", F.col("effect").alias("effect_alone"), F.col("p_value").alias("p_alone"))
    given = ols_effects(cells, keys, y, [marker, other]).select(*keys, F.col("effect").alias("effect_given"), F.col("p_value").alias("p_given"))
    back = ols_effects(cells, keys, y, [other, marker]).select(*keys, F.col("effect").alias("other_given"), F.col("p_value").alias("p_other_given"))
    return alone.join(given, keys).join(back, keys)


def screen_verdict(tests: DataFrame, p: float = 1e-3) -> DataFrame:
    """Per marker: smallest p over the screened traits and a Y/N verdict."""
    return tests.groupBy("marker").agg(
        F.min("p_value").alias("min_p"), F.min_by("trait", F.struct("p_value", "trait")).alias("best_trait")
    ).withColumn("related", F.when(F.col("min_p") < p, "Y").otherwise("N"))


def bonferroni(tests: DataFrame, n_tests: int, alpha: float = 0.05) -> DataFrame:
    return tests.withColumn("passes", F.col("p_value") < alpha / n_tests)


def test_table(results: dict[str, DataFrame], key: str, columns: list[str]) -> DataFrame:
    """Long results of several tests side by side, one row per key."""
    out = None
    for name, df in results.items():
        part = df.select(key, *[F.col(c).alias(f"{name}_{c}") for c in columns])
        out = part if out is None else out.join(part, key, "full")
    return out


def impact_tests(variants: DataFrame, tests: DataFrame, ld: DataFrame) -> DataFrame:
    """Impact variants with their association per trait and r2 to the lead."""
    return variants.join(tests, "marker").join(ld.select("marker", "r2"), "marker", "left")


# ---------------------------------------------------------------- effective tests
def effective_tests(markers: DataFrame, block: int = 500) -> DataFrame:
    """Effective number of independent markers per chromosome (Li & Ji 2005).

    Markers are cut into blocks of ``block`` consecutive positions by their exact rank, so one
    chromosome may hold any share of them. Each block contributes the eigenvalues of its marker
    correlation: I(e >= 1) + (e - floor(e)). A hashed tie-break keeps markers at one position in
    bounded blocks too.
    """
    keyed = markers.withColumn("__at", F.col("pos").cast("double") + F.pmod(F.xxhash64("marker"), F.lit(1 << 20)) / float(1 << 21))
    ranks = value_ranks(keyed.select("chrom", "__at"), ["chrom"], "__at").select("chrom", "__at", F.floor(F.col("below") / block).alias("__blk"))
    rows = keyed.join(ranks, ["chrom", "__at"]).select("chrom", "__blk", "dosage")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        x = mean_imputed(np.vstack([np.asarray(v, dtype=float) for v in pdf["dosage"]]))
        x = x - x.mean(1, keepdims=True)
        sd = np.sqrt((x * x).sum(1))
        x = x[sd > 1e-12] / sd[sd > 1e-12][:, None]
        if len(x) == 0:
            me = 0.0
        else:
            small = x.T @ x if x.shape[1] < len(x) else x @ x.T
            e = np.clip(np.linalg.eigvalsh(small), 0.0, None)
            e = np.where(np.abs(e - np.round(e)) < 1e-9, np.round(e), e)
            me = float((e >= 1).sum() + (e - np.floor(e)).sum())
        return pd.DataFrame({"chrom": [pdf["chrom"].iloc[0]], "blk": [int(pdf["__blk"].iloc[0])], "n": [len(pdf)], "me": [me]})

    kind = dict(markers.dtypes)["chrom"]
    per = rows.groupBy("chrom", "__blk").applyInPandas(solve, f"chrom {kind}, blk bigint, n bigint, me double")
    return per.groupBy("chrom").agg(F.sum("n").alias("n_markers"), F.sum("me").alias("effective_tests"))


def scan_threshold(effective: DataFrame, alpha: float = 0.05) -> DataFrame:
    return effective.agg(F.sum("effective_tests").alias("effective_tests")).withColumn("threshold", F.lit(alpha) / F.col("effective_tests"))
