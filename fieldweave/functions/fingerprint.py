"""Fingerprints of id sets, built by a mergeable aggregate so no group is ever collected."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def list_digest(member: Column, order: Column) -> Column:
    """SHA-256 of the ids joined by line feeds, in the given order (ties by id).

    For sample lists, whose length is bounded; :func:`set_fingerprint` is for sets of any size.
    """
    ordered = F.sort_array(F.collect_list(F.struct(order.alias("o"), member.cast("string").alias("m"))))
    return F.sha2(F.array_join(F.transform(ordered, lambda x: x["m"]), "\n"), 256)


def set_fingerprint(member: Column) -> Column:
    """Order-free digest of a set of distinct ids: count plus sums of two SHA-256 slices.

    Equal sets give equal digests; the sums run on 52-bit slices in DECIMAL(38,0), so they
    merge map-side and cannot overflow below 2^70 members.
    """
    h = F.sha2(member.cast("string"), 256)
    slice_sum = lambda at: F.sum(F.conv(F.substring(h, at, 13), 16, 10).cast("decimal(18,0)"))
    return F.concat_ws(
        "-", F.count(F.lit(1)).cast("string"), slice_sum(1).cast("string"), slice_sum(14).cast("string")
    )
