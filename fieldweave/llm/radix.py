"""Distributed least-significant-digit radix sort of narrow rows of integers.

Rows are packed into blocks of arrays. One pass sorts by one digit of the composite key, stably:

1. every block counts its digits;
2. prefix sums, digit by digit and block by block within a digit, say where each block's rows of each
   digit start in the order of the whole table;
3. every block deals its rows out as runs of consecutive destinations, and a new block gathers the
   runs of its own stretch of destinations and lays them down at their places.

Blocks are stretches of positions, not of values, so that a digit all rows share spreads like any
other. Every pass is written to the shared folder, and the one before it deleted. The driver holds
the totals of one pass: at most ``2 ** bits`` numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fieldweave.llm.common import discard, ship, stored

BITS = 11
BLOCK = 1 << 16


def _numbers(column: pa.Array, at: int) -> np.ndarray:
    return np.frombuffer(column[at].as_buffer(), np.int64)


def _packed(names: Sequence[str]) -> str:
    return "block long, " + ", ".join(f"`{n}` binary" for n in names)


def pack_rows(rows: DataFrame, block: int) -> DataFrame:
    """Blocks of at most ``block`` rows each, in the order of the input's partitions."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[list[np.ndarray]] = [[] for _ in names]

        def made(upto: int) -> pa.RecordBatch:
            nonlocal number
            out = [pa.array([number], pa.int64())]
            for parts in held:
                whole = np.concatenate(parts)
                out.append(pa.array([whole[:upto].tobytes()], pa.binary()))
                parts[:] = [whole[upto:]]
            number += 1
            return pa.RecordBatch.from_arrays(out, names=["block", *names])

        for batch in batches:
            for parts, name in zip(held, names):
                parts.append(batch.column(name).to_numpy(zero_copy_only=False))
            while sum(map(len, held[0])) >= block:
                yield made(block)
        if sum(map(len, held[0])):
            yield made(block)

    return rows.mapInArrow(run, _packed(names))


def _one_pass(blocks: DataFrame, names: Sequence[str], key: str, base: int, falling: bool, shift: int, width: int, block: int) -> DataFrame:
    """Blocks in the stable order of one digit: ``width`` bits from ``shift`` of the key's distance to ``base``."""
    digit_of = lambda x: (((base - x if falling else x - base).view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.uint16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, number in enumerate(batch.column("block").to_pylist()):
                n = np.bincount(digit_of(_numbers(batch.column(key), i)))
                digit = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(digit), number)), "digit": pa.array(digit.astype(np.int32)), "n": pa.array(n[digit])})

    counts = blocks.select("block", key).mapInArrow(count, "block long, digit int, n long")
    totals = counts.groupBy("digit").agg(F.sum("n").alias("n")).toPandas()  # at most 2 ** width rows
    first = np.zeros(1 << width, np.int64)
    first[totals["digit"]] = totals["n"]
    first = blocks.sparkSession.sparkContext.broadcast(np.cumsum(first) - first)
    before = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts = starts.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("digit", "before"))).alias("starts"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start = batch.column("starts")[i].values
                digits = start.field("digit").to_numpy()
                own = digit_of(_numbers(batch.column(key), i))
                order = np.argsort(own, kind="stable")
                edge = np.searchsorted(own[order], digits)
                size = np.diff(edge, append=len(own))
                to = np.arange(len(own)) + np.repeat(first.value[digits] + start.field("before").to_numpy() - edge, size)
                cut = np.flatnonzero(np.diff(to // block, prepend=-1) | (np.diff(to, prepend=-2) != 1))
                ends = np.append(cut[1:], len(own))
                moved = [_numbers(batch.column(n), i)[order] for n in names]
                cols = [pa.array([m[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()) for m in moved]
                yield pa.RecordBatch.from_arrays([pa.array(to[cut] // block), pa.array(to[cut] % block), *cols], names=["block", "at", *names])

    def gather(table: pa.Table) -> pa.Table:
        at = table.column("at").to_numpy()
        order = np.argsort(at)
        cols = [b"".join([table.column(n)[i].as_py() for i in order.tolist()]) for n in names]
        return pa.table([pa.array([table.column("block")[0].as_py()], pa.int64()), *(pa.array([c], pa.binary()) for c in cols)], names=["block", *names])

    dealt = blocks.join(starts, "block").mapInArrow(deal, _packed(names).replace("block long", "block long, at long"))
    return dealt.groupBy("block").applyInArrow(gather, _packed(names))


def radix_ranks(rows: DataFrame, keys: Sequence[tuple[str, bool]], rank: str = "rank", bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """Rows of bigint columns without nulls, with their place (bigint from 1) in the order of ``keys``.

    ``keys`` are (column, falling), the most important first. Rows equal in all keys get different
    places that follow the order in which the input was read. A column named ``rank`` is replaced.
    ``rows`` is read twice and should be a stored table. An empty table gives an empty table.
    """
    rows = rows.drop(rank)
    if any(kind != "bigint" for _, kind in rows.dtypes):
        raise ValueError("radix_ranks sorts tables of bigint columns")
    ship(rows.sparkSession)
    names = rows.columns
    span = rows.agg(*(f(k).alias(f"{f.__name__}{i}") for i, (k, _) in enumerate(keys) for f in (F.min, F.max))).first()
    blocks = stored(pack_rows(rows, block), "radix")
    for i, (key, falling) in reversed(list(enumerate(keys))):
        low, high = span[f"min{i}"], span[f"max{i}"]
        need = (high - low).bit_length() if low is not None else 0
        passes = -(-need // bits)
        width = -(-need // passes) if passes else 0
        for p in range(passes):
            old, blocks = blocks, stored(_one_pass(blocks, names, key, high if falling else low, falling, p * width, width, block), "radix")
            discard(old)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, number in enumerate(batch.column("block").to_pylist()):
                cols = [_numbers(batch.column(n), i) for n in names]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(np.arange(len(cols[0])) + number * block + 1)], names=[*names, rank])

    if not any(span[f"min{i}"] != span[f"max{i}"] for i in range(len(keys))):
        blocks = _renumbered(blocks, names, block)
    return blocks.mapInArrow(unpack, ", ".join(f"`{n}` long" for n in [*names, rank]))


def _renumbered(blocks: DataFrame, names: Sequence[str], block: int) -> DataFrame:
    """Blocks of full stretches, for a table whose keys are all equal: a pass over a digit that is always 0."""
    return _one_pass(blocks, names, names[0], 0, False, 63, 0, block)
