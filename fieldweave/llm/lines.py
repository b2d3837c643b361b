"""Line dedup: two Bloom filters pick suspected repeats; only those are shuffled and confirmed.

A first pass over the text marks, per task, the hashes of lines seen in one document and in two
documents in two bitmaps of one fixed size. The bitmaps are merged slice by slice: what two tasks
have both seen once is seen twice. The merged twice-filter (its size is the parameter ``bits``, so
the broadcast is bounded whatever the corpus) has no false negatives. A second pass sends only
lines that it suspects to an exact count, in which false suspicions fall out again. A filter too
small for a corpus costs shuffle, never correctness.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from fieldweave.llm.common import map_columns, ship, slices, split_by_ids, stored, texts

BLANKS = " \t\n\v\f\r"  # fixed values: the characters stripped from both ends of a line
SLICES = 64
LONG, INT, STRING = T.LongType(), T.IntegerType(), T.StringType()


def line_key(line: str, min_chars: int) -> bytes | None:
    """Stripped line with A-Z lowered, or None if shorter than ``min_chars`` code points."""
    line = line.strip(BLANKS)
    return line.encode("utf-8", "surrogatepass").lower() if len(line) >= min_chars else None


def doc_keys(text: str, min_chars: int) -> set[bytes]:
    return {k for line in text.split("\n") if (k := line_key(line, min_chars)) is not None}


def slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bit numbers of each 64-bit hash."""
    low = hashes & np.uint64(0xFFFFFFFF)
    high = hashes >> np.uint64(32)
    return (low % np.uint64(bits)).astype(np.int64), ((high * np.uint64(0x9E3779B1) + low) % np.uint64(bits)).astype(np.int64)


def _bit(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1


def _mark(bitmap: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))


def suspected(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    a, b = slots(hashes, len(bitmap) * 8)
    return (_bit(bitmap, a) & _bit(bitmap, b)).astype(bool)


def twice_filter(docs: DataFrame, text_col: str, min_chars: int, bits: int) -> np.ndarray:
    """Bitmap that holds every line key found in two documents or more (and some others)."""
    size = bits // 8

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for batch in slices(batches):
            found = [xxhash.xxh3_64_intdigest(k) for text in texts(batch, text_col) for k in doc_keys(text, min_chars)]
            hashes, count = np.unique(np.array(found, np.uint64), return_counts=True)
            again = suspected(once, hashes) | (count > 1)
            for bitmap, part in ((once, hashes), (twice, hashes[again])):
                for at in slots(part, bits):
                    _mark(bitmap, at)
        each = size // SLICES
        rows = [(i, *(zlib.compress(b[i * each:(i + 1) * each], 1) for b in (once, twice))) for i in range(SLICES)]
        yield pa.RecordBatch.from_pydict({"slice": pa.array([r[0] for r in rows], pa.int32()), "once": [r[1] for r in rows], "twice": [r[2] for r in rows]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, None, None
        done = lambda: pa.RecordBatch.from_pydict({"slice": pa.array([at], pa.int32()), "twice": [zlib.compress(twice.tobytes(), 1)]})
        for batch in batches:
            for row in batch.to_pylist():
                a, b = (np.frombuffer(zlib.decompress(row[c]), np.uint8) for c in ("once", "twice"))
                if row["slice"] == at:
                    twice |= b | (once & a)
                    once |= a
                else:
                    if at is not None:
                        yield done()
                    at, once, twice = row["slice"], a.copy(), b.copy()
        if at is not None:
            yield done()

    ship(docs.sparkSession)
    parts = docs.select(text_col).mapInArrow(build, "slice int, once binary, twice binary")
    merged = parts.repartition(SLICES, "slice").sortWithinPartitions("slice").mapInArrow(merge, "slice int, twice binary")
    out = np.zeros(size, np.uint8)
    for row in merged.collect():  # SLICES rows, ``bits`` bits in all
        each = size // SLICES
        out[row["slice"] * each:(row["slice"] + 1) * each] = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
    return out


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, min_docs: int, min_chars: int, bits: int) -> DataFrame:
    """(id, key): line keys that a document must lose, one row each."""
    twice = docs.sparkSession.sparkContext.broadcast(twice_filter(docs, text_col, min_chars, bits))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = twice.value
        for batch in slices(batches):
            ids, keys = [], []
            for i, text in zip(batch.column(id_col).to_pylist(), texts(batch, text_col)):
                ks = list(doc_keys(text, min_chars))
                if ks and i is not None:
                    hit = suspected(bitmap, np.array([xxhash.xxh3_64_intdigest(k) for k in ks], np.uint64))
                    ids += [i] * int(hit.sum())
                    keys += [digest(ks[j]) for j in np.flatnonzero(hit)]
            yield pa.RecordBatch.from_pydict({id_col: pa.array(ids, batch.schema.field(id_col).type), "key": pa.array(keys, pa.binary())})

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("key", T.BinaryType())])
    held = stored(docs.select(id_col, text_col).mapInArrow(suspects, schema).distinct(), "lines")
    drop = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(id_col).alias("keep")).where(F.col("n") >= min_docs)
    return held.join(drop, "key").where(F.col(id_col) != F.col("keep")).select(id_col, "key")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_chars: int = 20, bits: int = 1 << 26) -> DataFrame:
    """Documents without lines that ``min_docs`` documents share, except in the largest id holding them.

    Adds n_lines (before) and n_dropped (bigint). Lines compare stripped of blanks and with A-Z
    lowered; keys shorter than ``min_chars`` code points always stay. Null text counts as empty and
    has one line; a row without id loses nothing and counts as no document; rows that repeat an id
    are one document, each row is returned. An empty table gives an empty table. Input columns
    named n_lines or n_dropped are replaced. ``bits`` (a multiple of 512) is the size of each filter.
    """
    lose = repeated_lines(docs, id_col, text_col, min_docs, min_chars, bits)
    lose = stored(lose.groupBy(F.col(id_col).alias("__id")).agg(F.collect_list("key").alias("__lose")), "lose")
    some, others = split_by_ids(docs, lose.withColumnRenamed("__id", "id"), docs[id_col])  # only texts that may lose lines are shuffled
    some = some.join(lose, some[id_col] == lose["__id"], "left").drop("__id")
    both = some.unionByName(others.withColumn("__lose", F.lit(None).cast(lose.schema["__lose"].dataType)))

    def clean(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {text_col: [], "n_lines": [], "n_dropped": []}
        for text, keys in zip(texts(batch, text_col), batch.column("__lose").to_pylist()):
            lines = text.split("\n")
            gone = set(keys or ())
            kept = [x for x in lines if (k := line_key(x, min_chars)) is None or digest(k) not in gone] if gone else lines
            out[text_col].append("\n".join(kept))
            out["n_lines"].append(len(lines))
            out["n_dropped"].append(len(lines) - len(kept))
        return out

    return map_columns(both, clean, drop=("__lose",), **{text_col: STRING, "n_lines": LONG, "n_dropped": LONG})


def line_report(docs: DataFrame) -> DataFrame:
    """Digest of the operator's result for each document."""
    out = drop_repeated_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), repeated AS (
  SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT keyed.*, repeated.k IS NOT NULL AND doc_id <> keep AS gone FROM keyed LEFT JOIN repeated ON keyed.k = repeated.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
