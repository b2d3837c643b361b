"""Document fingerprints by winnowing.

Every ``size``-gram of code points has a rolling hash; of each window of ``window`` consecutive
grams the least hash is chosen, the rightmost of equal ones, with its position. Two texts that share
a passage of ``size + window - 1`` code points or more share a chosen hash. The fingerprint is the
set of chosen hashes, as 8 hexadecimal digits each in ascending order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from fieldweave.llm.common import ship, texts
from fieldweave.llm.shingles import BASE, mix, powers

SIZE, WINDOW = 8, 8  # a half kept unchanged is sure to be seen from 15 code points on
ROWS = 250  # rows of a result batch, as fingerprints are longer than their texts
_U = np.uint64
_INVERSE = pow(BASE, -1, 1 << 64)


def gram_hashes(text: str, size: int) -> np.ndarray:
    """Rolling polynomial hash of each gram, 32 bits; a text shorter than a gram is one gram."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.empty(0, np.uint32)
    size = min(size, len(points))
    sums = np.concatenate((np.zeros(1, _U), np.cumsum((points.astype(_U) + _U(1)) * powers(BASE, len(points)), dtype=_U)))
    rolled = (sums[size:] - sums[:-size]) * powers(_INVERSE, len(sums) - size)
    return (mix(rolled + _U(size)) >> _U(32)).astype(np.uint32)


def winnow(text: str, size: int = SIZE, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes and their positions (first code point of the gram), ascending by position.

    A text of fewer grams than a window is one window; the empty text has none.
    """
    least = gram_hashes(text, size)
    at = np.arange(len(least))
    window, have = min(window, len(least)), 1
    hashes = least
    while have < window:  # windows of ``have`` grams overlap or adjoin to windows of ``have + step``
        step = min(have, window - have)
        right = least[step:] <= least[:-step]
        least, at = np.where(right, least[step:], least[:-step]), np.where(right, at[step:], at[:-step])
        have += step
    at = np.unique(at)
    return hashes[at], at


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two ascending sets of hashes, 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - both
    return both / every if every else 1.0


def as_text(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, window: int = WINDOW) -> DataFrame:
    """(id, fingerprint, hashes, positions), one row per input row.

    ``hashes`` (bigint) and ``positions`` list every choice in text order. Null text counts as empty:
    an empty fingerprint and no positions. Ids may be null or repeated; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [winnow(t, size, window) for t in texts(batch, text_col)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array([as_text(np.unique(h)) for h, _ in found], pa.string()), pa.array([h.astype(np.int64) for h, _ in found], pa.list_(pa.int64())),
                                              pa.array([p for _, p in found], pa.list_(pa.int64()))], [id_col, "fingerprint", "hashes", "positions"])

    ship(docs.sparkSession)
    many = T.ArrayType(T.LongType())
    schema = T.StructType([docs.schema[id_col], T.StructField("fingerprint", T.StringType()), T.StructField("hashes", many), T.StructField("positions", many)])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def neighbour_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, window: int = WINDOW, parts: int | None = None) -> DataFrame:
    """Fingerprint of each text and of its edited form, and their likeness to each other and to the next text.

    The edited form replaces the last floor(n/2) code points by as many first ones of the next text
    (ascending integer id, after the last the first; rows that repeat an id go by the bytes of their text; a single row
    is its own next). Null text counts as empty; rows without an id come first. An empty table gives
    no rows; columns besides id and text are not read. Ids are dealt into ranges, and the first row
    of a range goes to the range before it too, so each text crosses one shuffle and no range is whole.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = -(1 << 63)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("rank"))
    cuts = sorted(set(int(x) for x in plain.select("rank").approxQuantile("rank", [i / parts for i in range(1, parts)], 0.2 / parts)))
    plain = plain.withColumn("range", _range_of(cuts))
    heads = plain.groupBy("range").agg(F.min("rank").alias("head")).orderBy("range").collect()  # at most ``parts`` rows
    before = {r["head"]: heads[i - 1]["range"] for i, r in enumerate(heads)}
    first = heads[0]["head"] if heads else 0
    extra = plain.where(F.col("rank").isin(list(before)))
    to = F.create_map(*(x for k, v in before.items() for x in (F.lit(k).cast("long"), F.lit(v)))) if before else F.create_map().cast("map<bigint,int>")
    extra = extra.withColumn("range", to[F.col("rank")]).withColumn("turn", F.when(F.col("rank") == first, 2).otherwise(1))
    dealt = plain.withColumn("turn", F.lit(0)).unionByName(extra).repartition(parts, "range").sortWithinPartitions("range", "turn", "rank", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints: dict[str, tuple[np.ndarray, str]] = {}

        def printed(text: str) -> tuple[np.ndarray, str]:
            if text not in prints:
                if len(prints) > 1:
                    del prints[next(iter(prints))]
                own = np.unique(winnow(text, size, window)[0])
                prints[text] = own, as_text(own)
            return prints[text]

        def pair(row: tuple, after: str) -> tuple:
            i, text = row[0], row[1]
            own, shown = printed(text)
            half = len(text) // 2
            edited = text[:len(text) - half] + after[:half]
            new = own if edited == text else np.unique(winnow(edited, size, window)[0])
            then = printed(after)[0]
            return i, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), shown, as_text(new), likeness(own, new), likeness(own, then)

        held = None
        for batch in batches:
            out = []
            for i, text, spot, turn in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "range", "turn"))):
                if held is not None and held[2] == spot:
                    out.append(pair(held, text))
                    held = None
                if turn == 0:
                    held = (i, text, spot)
                if len(out) == ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), KINDS)], NAMES)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), KINDS)], NAMES)

    out = dealt.select("id", "text", "range", "turn").mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)


NAMES = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _range_of(cuts: list[int]):
    """How many of the ascending cuts are at or below ``rank``, by a balanced tree of comparisons."""
    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("rank") < F.lit(cuts[mid]).cast("long"), tree(lo, mid)).otherwise(tree(mid + 1, hi))
    return tree(0, len(cuts))
