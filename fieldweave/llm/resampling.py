"""Importance resampling towards a target text: hashed n-grams, log-ratio gains, Gumbel scores, radix ranks.

Every feature falls into one of a fixed number of buckets; the counts of the documents and of the target
give each bucket a gain, an array that scores whole batches. Drawing without replacement in proportion
to exp(weight) is taking the highest sums of weight and Gumbel noise, which hashes of the ids supply;
ranks come from a distributed radix sort over (score falling, id rising).
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from fieldweave.llm.common import ship, stored, texts
from fieldweave.llm.radix import BITS, BLOCK, radix_ranks

SLICE = 256  # texts whose features are held at once
CACHE = 500_000  # features a worker remembers
#: Digits, small letters and all bytes of other characters stand; A-Z becomes small, the rest separates.
_WORD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


class Buckets(dict):
    """Bucket of a feature, remembered."""

    def __init__(self, size: int):
        self.size = size

    def __missing__(self, feature: bytes) -> int:
        at = self[feature] = zlib.crc32(feature) % self.size
        return at


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD).split()


def features(found: list[bytes], longest: int) -> list[bytes]:
    """All runs of 1 to ``longest`` consecutive words."""
    out = found
    for n in range(2, longest + 1):
        out = out + [b" ".join(found[i:i + n]) for i in range(len(found) - n + 1)]
    return out


def bucket_counts(docs: DataFrame, text_col: str, longest: int, buckets: int) -> np.ndarray:
    """Features of all texts in each bucket, repeats counted; each task sends at most one number a bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros(buckets, np.int64), Buckets(buckets)
        for batch in batches:
            for text in texts(batch, text_col):
                own = features(words(text), longest)
                total += np.bincount(np.fromiter(map(known.__getitem__, own), np.int64, len(own)), minlength=buckets)
            if len(known) > CACHE:
                known.clear()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})

    ship(docs.sparkSession)
    summed = docs.select(text_col).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)  # ``buckets`` numbers, whatever the corpus
    out[summed["bucket"]] = summed["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the smoothed log ratio of each bucket's shares in target and source."""
    size, big_s, big_t = len(source), float(source.sum()), float(target.sum())
    ratio = lambda s, t: (t + 1.0) * (big_s + size) / ((s + 1.0) * (big_t + size))
    return np.array([math.floor(1000.0 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(seed: int, key: str) -> int:
    """Floored thousandths of a Gumbel draw fixed by seed and id."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296.0)))


def score_documents(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, longest: int, seed: int) -> DataFrame:
    """(id, n_words, n_features, weight, score), all bigint but the id, one row a document."""
    array = docs.sparkSession.sparkContext.broadcast(gain)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(len(array.value))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = [words(t) for t in texts(part, text_col)]
                own = [features(w, longest) for w in found]
                n = np.array([len(f) for f in own], np.int64)
                each = np.fromiter((known[f] for fs in own for f in fs), np.int64, int(n.sum()))
                sums = np.concatenate([[0], np.cumsum(array.value[each])])
                ends = np.cumsum(n)
                weight = (sums[ends] - sums[ends - n]) // np.maximum(n, 1)
                ids = part.column(id_col)
                draw = np.array([noise(seed, "" if i is None else str(i)) for i in ids.to_pylist()], np.int64)
                cols = [np.array([len(w) for w in found], np.int64), n, weight, weight + draw]
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, cols)], names=names)
                if len(known) > CACHE:
                    known.clear()

    names = [id_col, "n_words", "n_features", "weight", "score"]
    schema = T.StructType([T.StructField(id_col, kind)] + [T.StructField(n, T.LongType()) for n in names[1:]])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def importance_ranks(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", longest: int = 1,
    buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024, bits: int = BITS, block: int = BLOCK,
) -> DataFrame:
    """One row a document: id, n_words, n_features, weight, score, rank (bigint, null unless drawn).

    Of the documents with at least ``min_words`` words the ``percent`` per cent (rounded down) with the
    highest scores are drawn, ties to the smaller id; ids are bigint. Null and empty texts have no features
    and weight 0. A row without an id is scored like an empty id and never drawn, nor counted among those
    to draw from. Rows that repeat an id are documents of their own; those equal in score and id are
    ranked one after the other. Whole texts of both tables count; an empty target leaves the gains to the documents' counts alone. Other
    columns are not read, whatever their names. An empty table gives an empty table.
    """
    gain = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_text_col, longest, buckets))
    scored = stored(score_documents(docs, gain, id_col, text_col, longest, seed), "scores")
    fit = (F.col("n_words") >= min_words) & F.col(id_col).isNotNull()
    drawn = percent * scored.where(fit).count() // 100
    ranked = radix_ranks(scored.where(fit), [("score", True), (id_col, False)], bits=bits, block=block)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.where(F.coalesce(~fit, F.lit(True))).withColumn("rank", F.lit(None).cast("long")))


def draw_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The drawn documents with all their columns, one row each for ids that do not repeat, without an order."""
    ranks = importance_ranks(docs, target, id_col=id_col, **settings).where(F.col("rank").isNotNull())
    return docs.join(ranks.select(id_col), id_col, "left_semi")


def resampling_report(docs: DataFrame, target: DataFrame) -> DataFrame:
    return importance_ranks(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


SQL = r"""
WITH table256 AS (
  SELECT list(c ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), d AS (
  SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), dw AS (SELECT row_no, unnest(words) AS w FROM d),
bw AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), known AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(w) + 1), lambda i: ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::BIGINT)),
         lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)), table256
), source AS (SELECT bucket, count(*) AS n FROM dw JOIN known USING (w) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS n FROM bw JOIN known USING (w) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM dw) AS big_s, (SELECT count(*) FROM bw) AS big_t),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (big_s + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * (big_t + 10000)::DOUBLE)))::BIGINT AS g
  FROM (SELECT DISTINCT bucket FROM known) k LEFT JOIN source s USING (bucket) LEFT JOIN target t USING (bucket), totals
), weights AS (
  SELECT d.row_no, doc_id, len(words)::BIGINT AS n_features, coalesce(floor(sum(g)::DOUBLE / len(words)), 0)::BIGINT AS weight
  FROM d LEFT JOIN dw ON d.row_no = dw.row_no LEFT JOIN known USING (w) LEFT JOIN gain USING (bucket) GROUP BY d.row_no, doc_id, words
), scored AS (
  SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weights
), fit AS (
  SELECT row_no, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20 AND doc_id IS NOT NULL
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END::BIGINT AS rank
FROM scored LEFT JOIN fit USING (row_no)
"""
