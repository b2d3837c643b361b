"""Genomic windows, hotspot peaks and genome layouts from marker hits.

Window tables are bounded by genome length / step per chromosome, whatever the number of hits, so
the per-chromosome windows below run on counted windows, never on hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .joins import in_intervals
from .onerow import attach_row


def fixed_windows(hits: DataFrame, width: int) -> DataFrame:
    """Distinct traits with a hit per fixed window."""
    win = F.floor(F.col("pos") / width)
    return (
        hits.groupBy("chrom", win.alias("window"))
        .agg(F.count_distinct("trait").alias("n_traits"))
        .withColumn("window_start", F.col("window") * width)
    )


def sliding_windows(hits: DataFrame, lengths: DataFrame, width: int = 100_000, step: int = 20_000) -> DataFrame:
    """Distinct traits per sliding window, zero-filled; the last windows end at the chromosome end.

    ``lengths`` is (chrom, max_bp). A hit is copied into the width/step windows that cover it.
    """
    grid = (
        lengths.where("max_bp > 0")
        .select("chrom", "max_bp", F.explode(F.sequence(F.lit(0), F.floor((F.col("max_bp") - 1) / step))).alias("window"))
        .select(
            "chrom", "window", (F.col("window") * step).alias("window_start"),
            F.least(F.col("window") * step + width - 1, F.col("max_bp")).alias("window_end"),
        )
    )
    first = F.greatest(F.ceil((F.col("pos") - width + 1) / step), F.lit(0))
    last = F.floor(F.col("pos") / step)
    counted = (
        hits.select("chrom", "trait", F.explode(F.sequence(first, last)).alias("window"))
        .groupBy("chrom", "window")
        .agg(F.count_distinct("trait").alias("n"))
    )
    return grid.join(counted, ["chrom", "window"], "left").withColumn("n_traits", F.coalesce("n", F.lit(0))).drop("n")


def merge_windows(windows: DataFrame, width: int, min_traits: int = 10, gap: int = 200_000) -> DataFrame:
    """Flagged windows merged into peaks: a new peak starts where the next window's start is more
    than ``gap`` beyond the previous window's end."""
    by_pos = W.partitionBy("chrom").orderBy("window_start")
    flagged = windows.where(F.col("n_traits") >= min_traits).withColumn("window_end", F.col("window_start") + width - 1)
    breaks = flagged.withColumn("brk", (F.col("window_start") - F.lag("window_end").over(by_pos) > gap).cast("int"))
    island = breaks.withColumn("island", F.sum(F.coalesce("brk", F.lit(0))).over(by_pos.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy("chrom", "island").agg(
        F.min("window_start").alias("start"), F.max("window_end").alias("end"), F.max("n_traits").alias("max_traits"),
        F.count(F.lit(1)).alias("n_windows"),
    ).drop("island")


def with_top_marker(peaks: DataFrame, hits: DataFrame) -> DataFrame:
    """Best marker (smallest p, then position) inside each peak."""
    inside = in_intervals(hits.select("chrom", "pos", "p_value"), peaks.select("chrom", "start", "end"))
    top = inside.groupBy("chrom", "start").agg(
        F.min_by("pos", F.struct("p_value", "pos")).alias("top_marker_pos"), F.min("p_value").alias("top_marker_p")
    )
    return peaks.join(top, ["chrom", "start"], "left")


def paired_windows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Window counts of two models side by side."""
    left = a.select("chrom", "window", F.col("n_traits").alias("n_a"))
    right = b.select("chrom", "window", F.col("n_traits").alias("n_b"))
    zero = F.lit(0)
    return left.join(right, ["chrom", "window"], "full").withColumns({"n_a": F.coalesce("n_a", zero), "n_b": F.coalesce("n_b", zero)})


def other_model_maximum(peaks: DataFrame, windows_b: DataFrame) -> DataFrame:
    """Largest window count of the other model inside each peak, 0 where it has none."""
    pts = windows_b.select("chrom", F.col("window_start").alias("pos"), F.col("n_traits").alias("n_b"))
    best = in_intervals(pts, peaks.select("chrom", "start", "end")).groupBy("chrom", "start").agg(F.max("n_b").alias("max_b"))
    return peaks.join(best, ["chrom", "start"], "left").withColumn("max_b", F.coalesce("max_b", F.lit(0)))


def label_windows(windows: DataFrame, peaks: DataFrame) -> DataFrame:
    """Peak label of every window that starts inside a peak, null elsewhere."""
    pts = windows.select("chrom", "window", F.col("window_start").alias("pos"))
    hit = in_intervals(pts, peaks).groupBy("chrom", "window").agg(F.min("peak").alias("peak"))
    return windows.join(hit, ["chrom", "window"], "left")


def genome_offsets(lengths: DataFrame, gap: int) -> DataFrame:
    """Cumulative start of each chromosome on one axis and the tick position between starts."""
    w = W.orderBy("chrom")
    off = F.sum(F.col("max_bp") + gap).over(w.rowsBetween(W.unboundedPreceding, -1))
    df = lengths.select("chrom", "max_bp", F.coalesce(off, F.lit(0)).alias("bp_add"))
    nxt = F.coalesce(F.lead("bp_add").over(w), F.col("bp_add") + F.col("max_bp"))
    return df.withColumn("center", (F.col("bp_add") + nxt) / 2)


def shared_layout(windows: list[DataFrame], width: int, gap: int = 5_000_000) -> DataFrame:
    """Offsets and centres from observed windows, each chromosome as wide as its widest model."""
    union = windows[0].select("chrom", "window")
    for other in windows[1:]:
        union = union.unionByName(other.select("chrom", "window"))
    span = union.groupBy("chrom").agg(((F.max("window") + 1) * width).alias("span_bp"))
    before = W.orderBy("chrom").rowsBetween(W.unboundedPreceding, -1)
    off = F.coalesce(F.sum(F.col("span_bp") + gap).over(before), F.lit(0))
    return span.withColumn("offset", off).withColumn("center", F.col("offset") + F.floor(F.col("span_bp") / 2))


def genome_positions(windows: DataFrame, layout: DataFrame, width: int) -> DataFrame:
    joined = windows.join(layout.select("chrom", "offset"), "chrom")
    return joined.withColumn("genome_pos", F.col("offset") + F.col("window") * width + width // 2).drop("offset")


def trait_sets(hits: DataFrame, peaks: DataFrame) -> DataFrame:
    """Distinct (trait, peak) pairs: which trait has a hit in which peak."""
    return in_intervals(hits, peaks).select("trait", "peak").distinct()


def sets_per_trait(pairs: DataFrame) -> DataFrame:
    """Number and ordered list of peaks per trait (a list is bounded by the number of peaks)."""
    return pairs.groupBy("trait").agg(
        F.count(F.lit(1)).alias("n_peaks"), F.array_join(F.array_sort(F.collect_set("peak")), ",").alias("peaks")
    )


def identical_sets(pairs: DataFrame) -> DataFrame:
    """Trait groups that share exactly the same peaks."""
    return sets_per_trait(pairs).groupBy("peaks").agg(F.count(F.lit(1)).alias("n_traits"), F.min("trait").alias("first_trait"))


def set_join(sets: DataFrame, least: float, name: str = "peaks", members: str = "members") -> DataFrame:
    """(set_a, set_b, shared, similarity): pairs of sets whose Jaccard similarity is at least ``least`` > 0, exactly.

    ``sets`` has one row a set: a name and its distinct members. Members are put in order of how many sets
    hold them, rarest first. Two sets of that similarity share a member within their first
    n - ceil(least n) + 1 (Chaudhuri et al. 2006), so only those prefixes are joined, sets of too
    different sizes are dropped at once, and a pair is kept at the first prefix member it shares. Sets without
    members have no pairs.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    listed = sets.select(F.col(name).alias("s"), F.explode(F.array_distinct(members)).alias("m"))
    common = listed.groupBy("m").agg(F.count(F.lit(1)).alias("f"))
    ordered = listed.join(common, "m").groupBy("s").agg(F.sort_array(F.collect_list(F.struct("f", "m"))).alias("o"))
    ordered = ordered.select("s", F.col("o.m").alias("o"), F.size("o").alias("n"))
    first = F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1
    prefix = ordered.withColumn("p", F.slice("o", F.lit(1), first))
    side = lambda x: prefix.select(F.explode("p").alias("m"), *[F.col(c).alias(f"{c}_{x}") for c in ("s", "o", "p", "n")])
    near = (F.col("n_a") >= F.col("n_b") * least - 1e-9) & (F.col("n_b") >= F.col("n_a") * least - 1e-9)
    pairs = side("a").join(side("b"), "m").where((F.col("s_a") < F.col("s_b")) & near)
    pairs = pairs.where(F.get(F.array_intersect("p_a", "p_b"), F.lit(0)) == F.col("m"))
    shared = F.size(F.array_intersect("o_a", "o_b"))
    out = pairs.select(F.col("s_a").alias("set_a"), F.col("s_b").alias("set_b"), shared.alias("shared"), (shared / (F.col("n_a") + F.col("n_b") - shared)).alias("similarity"))
    return out.where(F.col("similarity") >= least - 1e-12)


def set_distances(pairs: DataFrame) -> DataFrame:
    """Binary (Jaccard) distance between the distinct peak sets of traits, every pair of sets once.

    Traits with identical sets are at distance 0 and share a row. Distances below 1 come from the set
    join; the report then lists the disjoint pairs too, at distance 1, by numbering the sets and letting
    each one name those after it: as many rows as the matrix has.
    """
    sets = sets_per_trait(pairs).select("peaks").distinct().withColumn("members", F.split("peaks", ","))
    touching = set_join(sets, 1e-9).select("set_a", "set_b", (1 - F.col("similarity")).alias("distance"))
    numbered = sets.select("peaks", (F.row_number().over(W.orderBy("peaks")) - 1).alias("i"), F.count(F.lit(1)).over(W.partitionBy()).alias("total"))
    after = numbered.where("i < total - 1").select(F.col("peaks").alias("set_a"), F.explode(F.sequence(F.col("i") + 1, (F.col("total") - 1).cast("int"))).alias("i"))
    every = after.join(numbered.select(F.col("peaks").alias("set_b"), "i"), "i").select("set_a", "set_b")
    return every.join(touching, ["set_a", "set_b"], "left").withColumn("distance", F.coalesce("distance", F.lit(1.0)))


def label_runs(df: DataFrame, order: str, label: str, slice_size: int = 1_000_000) -> DataFrame:
    """Runs of equal labels along a dense position: start, end and middle of each run.

    A run starts where the label differs from its left neighbour (joined on position - 1) and ends
    before the next start. Next starts are looked up inside slices of positions; only the first start
    of every slice is compared across slices, so no task holds more than a slice.
    """
    prev = df.select((F.col(order) + 1).alias(order), F.col(label).alias("__prev"))
    starts = (
        df.join(prev, order, "left").where(F.col("__prev").isNull() | (F.col("__prev") != F.col(label)))
        .select(F.col(label), F.col(order).alias("start"), F.floor(F.col(order) / slice_size).alias("__slice"))
    )
    later = W.orderBy(F.col("__slice").desc()).rowsBetween(W.unboundedPreceding, -1)
    firsts = starts.groupBy("__slice").agg(F.min("start").alias("f")).select("__slice", F.min("f").over(later).alias("__after"))
    inside = F.lead("start").over(W.partitionBy("__slice").orderBy("start"))
    runs = starts.withColumn("__next", inside).join(firsts, "__slice")
    runs = attach_row(runs, df.agg(F.max(order).alias("__last")))
    end = F.coalesce(F.col("__next") - 1, F.col("__after") - 1, F.col("__last"))
    return runs.select(label, "start", end.alias("end"), ((F.col("start") + end) / 2).alias("mid"))
