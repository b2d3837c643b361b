"""Ranks, quantiles and running minima over groups of any size.

A plain window over ``PARTITION BY group`` puts a whole group into one task. Here every group is cut
into as many value buckets as its distinct values ask for, about one per ``spark.fieldweave.bucketRows``
of them (default 1,000,000). The splitters are a hashed sample of the distinct values, every sixteenth of
it in order, so their number follows the values of a group and nothing else. Rows meet only inside one
bucket, equal values are counted before the shuffle, and a short per-bucket table carries the offsets
across buckets. Splitters only decide where a value is processed, never its rank, so results are exact;
being hashed, they come out alike whenever a lost task is run again. There are about as many as the
table has distinct values per bucketRows, which is why they may be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BUCKET = "__bucket"
SAMPLED = 16  # values of the sample for each bucket


def splitters(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, __cuts), sorted, of the groups that need more than one bucket; one scan, a small shuffle."""
    rows = int(df.sparkSession.conf.get("spark.fieldweave.bucketRows", "1000000"))
    sample = df.where(F.pmod(F.xxhash64(value), F.lit(max(1, rows // SAMPLED))) == 0)
    per = sample.groupBy(*keys).agg(F.sort_array(F.collect_set(value)).alias("__s")).where(F.size("__s") > SAMPLED)
    return per.select(*keys, F.filter("__s", lambda x, i: (i + 1) % SAMPLED == 0).alias("__cuts"))


def _cuts_below(cuts: Column, value: Column) -> Column:
    """How many of the sorted cuts are smaller, by halving."""
    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = F.get(cuts, middle) < value
        return F.when(s["lo"] < s["hi"], F.struct(F.when(right, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(right, s["hi"]).otherwise(middle).alias("hi"))).otherwise(s)

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(cuts) + 1)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi")), halve)["lo"]


def with_value_bucket(df: DataFrame, cuts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Add the bucket ordinal of ``value`` within ``keys``: monotone in value, 0 where a group has one bucket.

    The splitters are broadcast (see the module text for their number), so rows stay where they are and the
    next shuffle spreads them by bucket, not by group.
    """
    if keys:
        joined = df.join(F.broadcast(cuts), list(keys), "left")
    else:
        joined = df.withColumn("__cuts", cuts.select("__cuts").scalar())
    return joined.withColumn(BUCKET, F.coalesce(_cuts_below(F.col("__cuts"), F.col(value)), F.lit(0))).drop("__cuts")


def value_ranks(
    df: DataFrame, keys: Sequence[str], value: str, extra: Sequence[Column] = (), base: DataFrame | None = None
) -> DataFrame:
    """One row per distinct non-null value of each group.

    Columns: keys, value, ``n`` (ties), ``below`` (rows with a smaller value), ``total`` (rows in
    the group), the bucket ordinal, and any ``extra`` aggregates over the tied rows.

    One scan finds the splitters, one the values; bucket totals come from the same shuffle as the values.
    ``base`` may name a cheaper table with the same groups and values (before a join that only adds
    columns); splitters and bucket totals then come from it and ``df`` is read once.
    """
    keys = list(keys)
    known = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    for k in keys:
        known = known & F.col(k).isNotNull()
    usable = lambda d: d.where(known)
    counted = usable(base if base is not None else df).select(*keys, value)
    cuts = splitters(counted, keys, value)
    vals = (
        with_value_bucket(usable(df), cuts, keys, value)
        .groupBy(*keys, BUCKET, value)
        .agg(F.count(F.lit(1)).alias("n"), *extra)
    )
    if base is None and not extra:
        per_bucket = vals.groupBy(*keys, BUCKET).agg(F.sum("n").alias("__bn"))
    else:
        per_bucket = with_value_bucket(counted, cuts, keys, value).groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("__bn"))
    running = W.partitionBy(*keys).orderBy(BUCKET)
    offsets = per_bucket.select(
        *keys,
        BUCKET,
        (F.sum("__bn").over(running) - F.col("__bn")).alias("__off"),
        F.sum("__bn").over(W.partitionBy(*keys)).alias("total"),
    )
    inside = W.partitionBy(*keys, BUCKET).orderBy(value)
    cumulative = F.sum("n").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow))
    return (
        vals.join(offsets, [*keys, BUCKET])
        .withColumn("below", F.col("__off") + cumulative - F.col("n"))
        .drop("__off")
    )


def average_rank() -> Column:
    """Average rank from the columns of :func:`value_ranks`."""
    return F.col("below") + (F.col("n") + 1) / 2.0


def with_average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Attach the average rank to every row; a hot tied value is left to AQE's skew join."""
    return with_average_ranks(df, keys, {value: out})


def with_average_ranks(df: DataFrame, keys: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Attach the average rank of several columns. Each is ranked from ``df`` itself, never from an
    already ranked table, so the work grows with the number of columns and no faster."""
    out = df
    for value, name in columns.items():
        ranks = value_ranks(df.select(*keys, value), keys, value).select(*keys, value, average_rank().alias(name))
        out = out.join(ranks, [*keys, value], "left")
    return out


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Linear-interpolation quantiles per group, one output column per entry of ``probs``."""
    r = value_ranks(df, keys, value)
    aggs = []
    for name, q in probs.items():
        at = (F.col("total") - 1) * F.lit(float(q))
        hit = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("n"))
        lo = F.max(F.when(hit(F.floor(at)), F.col(value)))
        hi = F.max(F.when(hit(F.ceil(at)), F.col(value)))
        frac = F.max(at - F.floor(at))
        aggs.append((lo + frac * (hi - lo)).alias(name))
    return r.groupBy(*keys).agg(*aggs)


def running_extreme_from_above(df: DataFrame, keys: Sequence[str], order: str, x: str, out: str) -> DataFrame:
    """Minimum of ``x`` over the current and all larger ``order`` values, on value_ranks output."""
    keys = list(keys)
    per_bucket = df.groupBy(*keys, BUCKET).agg(F.min(x).alias("__bmin"))
    later = W.partitionBy(*keys).orderBy(F.col(BUCKET).desc()).rowsBetween(W.unboundedPreceding, -1)
    per_bucket = per_bucket.select(*keys, BUCKET, F.min("__bmin").over(later).alias("__later"))
    inside = (
        W.partitionBy(*keys, BUCKET)
        .orderBy(F.col(order).desc())
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        df.join(per_bucket, [*keys, BUCKET])
        .withColumn(out, F.least(F.col("__later"), F.min(x).over(inside)))
        .drop("__later")
    )


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """First k rows per group; Spark's group-limit rule trims every partition before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the smallest by ``order``: a mergeable min over structs, no window."""
    rest = [c for c in df.columns if c not in keys]
    lead = [c for c in order if c in rest]
    packed = F.struct(*lead, *[c for c in rest if c not in lead])
    return (
        df.groupBy(*keys)
        .agg(F.min_by(packed, F.struct(*[F.col(o) for o in order])).alias("__row"))
        .select(*keys, *[F.col("__row")[c].alias(c) for c in rest])
    )
