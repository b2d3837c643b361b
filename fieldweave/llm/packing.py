"""Packing token sequences: Martello-Toth reduction, then best fit decreasing, on a size histogram.

How documents can be packed depends only on how many pieces there are of each length, and there
are at most ``capacity`` lengths. That histogram is all the driver sees. The reduction fixes sets
that dominate every other set with the same largest piece; best fit decreasing places the rest,
one whole class of equal bins at a time, so the plan is a list of patterns whose number depends on
the capacity, not on the documents. Each piece finds its place from its rank among the pieces of
its length; ranks come from salted counts, so one very common length is spread over many tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from fieldweave.llm.common import ship, stored, texts

RANK_ROWS = 50_000  # pieces ranked in one window, on average


def reduce_dominant(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fix sets of up to three pieces that dominate all others; (patterns with counts, what is left).

    A set dominates another if the other's pieces can be dealt into its pieces without any overflowing.
    With j a piece and k the largest that still fits beside it, {j, k} dominates every set that holds j
    if k fills the bin, or if no two pieces fit together into what j leaves, or if no three do and the
    fullest two are together no larger than k; {j} alone if nothing fits. If no three fit and b is the
    largest beside j and k, {j, k, b} dominates if of every two that fit, and are together larger than
    k, the smaller is no larger than b. Then some best packing contains the set, so it is fixed and
    the pieces leave the instance.
    """
    left = {s: n for s, n in counts.items() if n}
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(sizes: tuple[int, ...], n: int) -> None:
        fixed.append((sizes, n))
        for s in sizes:
            left[s] -= n
            if not left[s]:
                del left[s]

    def times(sizes: tuple[int, ...]) -> int:
        return min(left[s] // sizes.count(s) for s in sizes)

    def dominant(j: int) -> tuple[int, ...]:
        """The set with j that dominates all others, or no piece if none is known."""
        room = capacity - j
        fit = sorted(s for s, n in left.items() if s <= room and (s != j or n > 1))
        if not fit:
            return (j,)
        have = {s: left[s] - (s == j) for s in fit}
        k = fit[-1]
        if k == room:
            return j, k
        if sum([s for s in fit[:3] for _ in range(min(3, have[s]))][:3]) <= room and sum(have[s] for s in fit[:3]) >= 3:
            return ()
        two = small = 0  # the fullest two that fit; the largest smaller one of two that are more than k
        for a in fit:
            b = fit[bisect_right(fit, room - a) - 1] if fit[0] <= room - a else 0
            if b < a:
                break
            if b > a or have[a] > 1:
                two = max(two, a + b)
                small = a if a + b > k else small
        if two <= k:
            return j, k
        third = max((s for s in fit if s <= room - k and (s != k or have[k] > 1)), default=0)
        return (j, k, third) if third and small <= third else ()

    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while j in left and (sizes := dominant(j)):
                take(sizes, times(sizes))
                changed = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing over classes of equal bins; (pattern, number of bins)."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for s in sorted(counts, reverse=True):
        todo = counts[s]
        for room in range(s, capacity + 1):
            if not todo:
                break
            classes, open_bins[room] = open_bins[room], []
            each = room // s
            while classes:
                pattern, n = classes.pop()
                full = min(n, todo // each)
                part = (todo - full * each) if full < n else 0
                for bins, copies in ((full, each), (1 if part else 0, part)):
                    if bins:
                        open_bins[room - copies * s].append((pattern + (s,) * copies, bins))
                        todo -= bins * copies
                if n - full - bool(part):
                    open_bins[room].append((pattern, n - full - bool(part)))
        each = capacity // s
        if todo // each:
            open_bins[capacity - each * s].append(((s,) * each, todo // each))
        if todo % each:
            open_bins[capacity - todo % each * s].append(((s,) * (todo % each), 1))
    return [p for room in sorted(open_bins) for p in open_bins[room]]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of the reduction and best fit of the rest, or of best fit alone where that needs fewer bins."""
    fixed, left = reduce_dominant(counts, capacity)
    return min(fixed + best_fit(left, capacity), best_fit(counts, capacity), key=lambda patterns: sum(n for _, n in patterns))


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, copies in a bin, first sequence, offset) in rank order."""
    out: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, n in patterns:
        offset = 0
        for s in sorted(set(pattern), reverse=True):
            copies = pattern.count(s)
            out[s].append((used[s], copies, sequence, offset))
            used[s] += copies * n
            offset += copies * s
        sequence += n
    return {s: np.array(rows, np.int64) for s, rows in out.items()}


def pieces(docs: DataFrame, id_col: str, text_col: str, model: str, end_id: int, capacity: int, ids: bool) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every document, longer ones cut at the front."""
    spark = docs.sparkSession
    ship(spark)
    loaded = spark.sparkContext.broadcast(model)  # the vocabulary, of fixed size
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fieldweave.llm.bpe import ByteBpe

        bpe = ByteBpe.of(loaded.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                rows: list[tuple] = []
                for i, data in zip(part.column(id_col).to_pylist(), bpe.encode(texts(part, text_col))):
                    data += end
                    n = len(data) // 4
                    start, length, piece = 0, n % capacity or min(n, capacity), 0
                    while start < n:
                        own = data[4 * start:4 * (start + length)]
                        rows.append((i, piece, start, length, zlib.crc32(own), np.frombuffer(own, "<u4") if ids else None))
                        start, length, piece = start + length, capacity, piece + 1
                cols = list(zip(*rows))
                kinds = [part.schema.field(id_col).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in list(zip(cols, kinds))[:5 + ids]], [id_col, "piece", "start", "length", "ids_crc32", "ids"][:5 + ids])

    kind = docs.schema[id_col].dataType
    fields = [(id_col, kind), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    fields += [("ids", T.ArrayType(T.IntegerType()))] if ids else []
    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([T.StructField(*f) for f in fields]))


def pack(cut: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces with a ``length`` of 1 .. capacity."""
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    table = places(plan(histogram, capacity))
    salts = 1 + sum(histogram.values()) // RANK_ROWS
    keys = [c for c in cut.columns if c not in ("length", "ids")]
    salted = cut.withColumn("__salt", F.pmod(F.xxhash64(*keys), F.lit(salts)))
    sizes = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stored(sizes.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")), "ranks")
    own = Window.partitionBy("length", "__salt").orderBy(*keys)
    ranked = salted.withColumn("__rank", F.row_number().over(own) - 1).join(F.broadcast(sizes) if salts <= 16 else sizes, ["length", "__salt"])
    ranked = ranked.withColumn("__rank", (F.col("__rank") + F.col("__before")).cast("long")).drop("__salt", "__before")
    at = cut.sparkSession.sparkContext.broadcast(table)  # patterns: bounded by the capacity
    columns = cut.columns
    schema = T.StructType(cut.schema.fields + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for s in np.unique(length).tolist():
                mine = np.flatnonzero(length == s)
                first, copies, base, start = at.value[s].T
                row = np.searchsorted(first, rank[mine], side="right") - 1
                number = rank[mine] - first[row]
                sequence[mine] = base[row] + number // copies[row]
                offset[mine] = start[row] + number % copies[row] * s
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(sequence), pa.array(offset)], names=columns + ["sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids on request).

    Every document is its token ids and ``end_id``; only one longer than ``capacity`` is cut, into
    full pieces after a first one that may be shorter. Null text counts as empty (one piece of the
    end id). Rows without or with a repeated id are packed like any others; columns besides id and
    text are not read. An empty table gives no rows.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        model = f.read()
    return pack(stored(pieces(docs, id_col, text_col, model, end_id, capacity, ids), "pieces"), capacity)


def packing_report(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
