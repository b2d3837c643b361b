"""Leaf geometry from point tables (image, x, y): axes, crop windows, cross profiles.

Everything is a grouped aggregate and a row expression; an image's points are never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def leaf_axes(points: DataFrame, image: str = "image") -> DataFrame:
    """Centre, principal axis, angle, extents, length and width of every image.

    The axis is the leading eigenvector of the 2 x 2 covariance in closed form; if the extent across
    it is larger, the two axes change places. Of either axis the entry that is larger in size is positive, so
    that windows always step from the same end.
    """
    mom = points.groupBy(image).agg(
        F.count(F.lit(1)).alias("n_points"), F.avg("x").alias("cx"), F.avg("y").alias("cy"),
        F.var_pop("x").alias("sxx"), F.var_pop("y").alias("syy"), F.covar_pop("x", "y").alias("sxy"),
    )
    theta = F.atan2(2 * F.col("sxy"), F.col("sxx") - F.col("syy")) / 2
    ax, ay = F.cos(theta), F.sin(theta)
    pinned = lambda x, y: F.when(F.when(F.abs(x) >= F.abs(y), x).otherwise(y) < 0, -1.0).otherwise(1.0)
    turned = mom.select(image, "n_points", "cx", "cy", ax.alias("ax"), ay.alias("ay"), pinned(ax, ay).alias("s"), pinned(-ay, ax).alias("t"))
    c = F.col
    axes = turned.select(image, "n_points", "cx", "cy", (c("ax") * c("s")).alias("ax"), (c("ay") * c("s")).alias("ay"), (-c("ay") * c("t")).alias("px"), (c("ax") * c("t")).alias("py"))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    along, across = dx * F.col("ax") + dy * F.col("ay"), dx * F.col("px") + dy * F.col("py")
    span = points.select(image, "x", "y").join(axes, image).groupBy(image, "n_points", "cx", "cy", "ax", "ay", "px", "py").agg(
        F.min(along).alias("a0"), F.max(along).alias("a1"), F.min(across).alias("b0"), F.max(across).alias("b1")
    )
    swap = (F.col("b1") - F.col("b0")) > (F.col("a1") - F.col("a0"))
    pick = lambda yes, no: F.when(swap, yes).otherwise(no)
    out = span.select(
        image, "n_points", "cx", "cy",
        pick(c("px"), c("ax")).alias("axis_x"), pick(c("py"), c("ay")).alias("axis_y"),
        pick(c("ax"), c("px")).alias("perp_x"), pick(c("ay"), c("py")).alias("perp_y"),
        pick(c("b0"), c("a0")).alias("min_proj"), pick(c("b1"), c("a1")).alias("max_proj"),
        pick(c("a0"), c("b0")).alias("min_perp"), pick(c("a1"), c("b1")).alias("max_perp"),
    )
    degrees = F.pmod(F.degrees(F.atan2("axis_y", "axis_x")) + 360.0, F.lit(180.0))
    return out.withColumns({
        "angle": degrees, "length": c("max_proj") - c("min_proj"), "width": c("max_perp") - c("min_perp"),
    })


def projections(points: DataFrame, axes: DataFrame, image: str = "image") -> DataFrame:
    """Points with their coordinates along and across the leaf axis."""
    keep = axes.select(image, "cx", "cy", "axis_x", "axis_y", "perp_x", "perp_y", "min_proj", "max_proj", "min_perp", "max_perp")
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    return points.join(keep, image).withColumns(
        {"along": dx * F.col("axis_x") + dy * F.col("axis_y"), "across": dx * F.col("perp_x") + dy * F.col("perp_y")}
    )


def crop_windows(
    points: DataFrame, axes: DataFrame, size_x: float, size_y: float, step: float, image_width: float, image_height: float,
    image: str = "image",
) -> DataFrame:
    """Crop windows stepped along the axis: centre, corners, in-bounds flag.

    A point is copied into the windows that cover it (closed at both ends); each window's centre is
    shifted across the axis by the mean offset of its points.
    """
    p = projections(points, axes, image)
    rel = F.col("along") - F.col("min_proj")
    last = F.floor((F.col("max_proj") - F.col("min_proj") - size_x) / step)
    lo = F.greatest(F.ceil((rel - size_x) / step), F.lit(0))
    hi = F.least(F.floor(rel / step), last)
    covered = p.where(last >= 0).withColumns({"lo": lo, "hi": hi}).where("lo <= hi")
    groups = [image, "k", "cx", "cy", "axis_x", "axis_y", "perp_x", "perp_y", "min_proj"]
    win = covered.select(*[g for g in groups if g != "k"], F.explode(F.sequence("lo", "hi")).alias("k"), "across").groupBy(*groups).agg(
        F.avg("across").alias("off"), F.count(F.lit(1)).alias("n_points")
    )
    at = F.col("min_proj") + F.col("k") * step
    mid = at + size_x / 2
    win = win.withColumns({
        "center_x": F.col("cx") + mid * F.col("axis_x") + F.col("off") * F.col("perp_x"),
        "center_y": F.col("cy") + mid * F.col("axis_y") + F.col("off") * F.col("perp_y"),
        "window_min": at, "window_max": at + size_x,
    })
    corners = {}
    for i, (sx, sy) in enumerate([(-1, -1), (1, -1), (1, 1), (-1, 1)]):
        hx, hy = sx * size_x / 2, sy * size_y / 2
        corners[f"corner_{i}_x"] = F.col("center_x") + hx * F.col("axis_x") + hy * F.col("perp_x")
        corners[f"corner_{i}_y"] = F.col("center_y") + hx * F.col("axis_y") + hy * F.col("perp_y")
    win = win.withColumns(corners)
    inside = F.lit(True)
    for i in range(4):
        inside = inside & (F.col(f"corner_{i}_x") >= 0) & (F.col(f"corner_{i}_x") < image_width) & (F.col(f"corner_{i}_y") >= 0) & (F.col(f"corner_{i}_y") < image_height)
    return win.withColumn("in_bounds", inside).select(
        image, "k", "n_points", "window_min", "window_max", "center_x", "center_y", *corners, "in_bounds"
    )


def cross_profile(points: DataFrame, axes: DataFrame, value: Column, bins: int = 100, image: str = "image") -> DataFrame:
    """Mean value per bin across the leaf; empty bins are interpolated linearly between their
    neighbours and take the nearest one at the ends. A profile has exactly ``bins`` rows."""
    p = projections(points, axes, image).withColumn("__v", value)
    share = F.try_divide(F.col("across") - F.col("min_perp"), F.col("max_perp") - F.col("min_perp"))
    binned = p.withColumn("bin", F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")).groupBy(image, "bin").agg(F.avg("__v").alias("m"))
    grid = axes.select(image, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = grid.join(binned, [image, "bin"], "left")
    seen = F.when(F.col("m").isNotNull(), F.struct("bin", "m"))
    before = W.partitionBy(image).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy(image).orderBy("bin").rowsBetween(0, W.unboundedFollowing)
    f = full.withColumns({"l": F.last(seen, ignorenulls=True).over(before), "r": F.first(seen, ignorenulls=True).over(after)})
    gap = F.col("r.bin") - F.col("l.bin")
    mixed = F.col("l.m") + (F.col("r.m") - F.col("l.m")) * F.try_divide(F.col("bin") - F.col("l.bin"), gap)
    filled = F.when(F.col("l").isNull(), F.col("r.m")).when(F.col("r").isNull(), F.col("l.m")).when(gap == 0, F.col("m")).otherwise(mixed)
    return f.select(image, "bin", filled.alias("value"), F.col("m").isNull().alias("interpolated"))


