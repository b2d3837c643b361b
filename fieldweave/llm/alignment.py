"""Token alignment of two tokenizers by sparse incidence matrices.

Both tokenizers cut the same bytes, so a token is the row of a token x byte incidence matrix with a one
for each of its bytes. With the two matrices A and B in compressed rows, Gustavson's row product A·Bᵀ
gives the pairs of tokens that overlap and by how many bytes; the pairs whose ranges end together are
its links. The ends that both share cut the bytes into groups, and the product of the token x group
matrices gives the pairs within one group. A batch of texts is one block-diagonal matrix, as every text
ends in both.

What the corpus gives is one count for each linked pair of ids. Two tokens that end together are suffixes of
each other, so there are at most as many pairs as the tokens of both vocabularies have suffixes (see
``pair_bound``), whatever the corpus: a table of some megabytes, which is checked and broadcast.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fieldweave.llm.bpe import ByteBpe
from fieldweave.llm.common import ship, stored, texts

SLICE = 256  # rows handled at once
BATCH_BYTES = 1 << 19  # bytes of text aligned at once; a longer text is a batch of its own


# ---------------------------------------------------------------- matrices in compressed rows
@dataclass(frozen=True)
class Rows:
    """Row i holds values[start[i]:start[i + 1]] in the columns cols[start[i]:start[i + 1]]."""

    start: np.ndarray
    cols: np.ndarray
    values: np.ndarray
    width: int

    def transposed(self) -> Rows:
        """A counting sort by column, stable in the rows."""
        n = np.bincount(self.cols, minlength=self.width)
        order = np.argsort(self.cols, kind="stable")
        row = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
        return Rows(np.concatenate([[0], np.cumsum(n)]), row[order], self.values[order], len(self.start) - 1)


def spans(ends: np.ndarray) -> Rows:
    """Token x byte incidence of tokens that follow one another and end at ``ends``."""
    n = int(ends[-1]) if len(ends) else 0
    return Rows(np.concatenate([[0], ends]), np.arange(n), np.ones(n, np.int32), n)


def membership(groups: np.ndarray, width: int) -> Rows:
    """Token x group incidence: one group for each token."""
    return Rows(np.arange(len(groups) + 1), groups, np.ones(len(groups), np.int32), width)


def product(a: Rows, b: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gustavson's product of rows: (row, column, value) of a·b, in order of rows, then columns.

    Each entry (i, k) of ``a`` brings row k of ``b``, scaled; what meets in a column of row i is added.
    """
    size = np.diff(b.start)[a.cols]
    entry = np.repeat(np.arange(len(a.cols)), size)
    at = np.arange(len(entry)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(b.start[a.cols], size)
    key = np.repeat(np.arange(len(a.start) - 1), np.diff(a.start))[entry] * b.width + b.cols[at]
    value = a.values[entry] * b.values[at]
    if len(key) and (np.diff(key) < 0).any():
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first] // b.width, key[first] % b.width, np.add.reduceat(value, first) if len(first) else value


# ---------------------------------------------------------------- tokens and their bytes
class Tokenizers:
    """Ids and token bytes of a byte-level BPE file (A) and a SentencePiece file (B)."""

    _loaded: dict[int, Tokenizers] = {}

    def __init__(self, model_a: str, model_b: bytes):
        import sentencepiece

        self.a = ByteBpe.of(model_a, special_is_text=True)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        self.bytes_a = [b""] * (max(self.a.ranks.values()) + 1)
        for token, i in self.a.ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(t) for t in b], np.int64) for b in (self.bytes_a, self.bytes_b))
        self.inside_a, self.last_a, self.inside_b, self.last_b = (
            np.array([f"{i}{sign}" for i in range(len(b))], object) for b, sign in ((self.bytes_a, ","), (self.bytes_a, "|"), (self.bytes_b, ","), (self.bytes_b, ";"))
        )

    @classmethod
    def of(cls, model_a: str, model_b: bytes) -> Tokenizers:
        key = hash((model_a, model_b))
        if key not in cls._loaded:
            cls._loaded[key] = cls(model_a, model_b)
        return cls._loaded[key]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode("utf-8")

    def encode(self, batch: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and B of each text; none at all where the text is empty or one of them does not give back its bytes."""
        none = np.zeros(0, np.int64)
        out = []
        for text, b in zip(batch, self.b.encode(batch, num_threads=1) if batch else []):
            whole = " " + text
            a = self.a.ids(whole) if text else []
            same = text and b"".join([self.bytes_a[i] for i in a]) == (data := whole.encode("utf-8")) and b"".join([self.bytes_b[i] for i in b]) == data
            out.append((np.array(a, np.int64), np.array(b, np.int64)) if same else (none, none))
        return out

    def pair_kind(self) -> str:
        """The type that holds a pair of ids as one number, a's id times B's size plus b's."""
        return "<u4" if len(self.bytes_a) * len(self.bytes_b) < 1 << 32 else "<u8"

    def pair_bound(self) -> int:
        """The most pairs of ids that can ever end together: each is a token and a suffix of it."""
        most = [max(Counter(x).values()) for x in (self.bytes_a, self.bytes_b)]
        return int(self.size_a.sum()) * most[1] + int(self.size_b.sum()) * most[0]


@dataclass(frozen=True)
class Aligned:
    """A batch of texts: all tokens one after the other, ``edge_*`` where each text's begin."""

    a: np.ndarray
    b: np.ndarray
    edge_a: np.ndarray
    edge_b: np.ndarray
    edge_links: np.ndarray
    group_a: np.ndarray  # group of each token, counted over the batch
    group_b: np.ndarray
    link_a: np.ndarray  # places of the linked tokens
    link_b: np.ndarray
    shared: np.ndarray  # bytes that the linked tokens share

    def group_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of all pairs of tokens in one group."""
        n = len(self.link_a)
        return product(membership(self.group_a, n), membership(self.group_b, n).transposed())[:2]


def align(batch: list[str], both: Tokenizers, overlaps: bool = False) -> Aligned:
    """Links of tokens that end together, or of all that overlap."""
    ids = both.encode(batch)
    a, b = (np.concatenate([x[side] for x in ids]) if ids else np.zeros(0, np.int64) for side in (0, 1))
    edge_a, edge_b = (np.concatenate([[0], np.cumsum([len(x[side]) for x in ids])]).astype(np.int64) for side in (0, 1))
    ends_a, ends_b = np.cumsum(both.size_a[a]), np.cumsum(both.size_b[b])
    link_a, link_b, shared = product(spans(ends_a), spans(ends_b).transposed())
    together = ends_a[link_a] == ends_b[link_b]
    cuts = ends_a[link_a[together]]
    if not overlaps:
        link_a, link_b, shared = link_a[together], link_b[together], shared[together]
    edge_links = np.searchsorted(link_a, edge_a)
    return Aligned(a, b, edge_a, edge_b, edge_links, np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b), link_a, link_b, shared)


def batches_of(batch: pa.RecordBatch, text_col: str) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of stretches of at most SLICE rows and BATCH_BYTES characters (or one row)."""
    for at in range(0, batch.num_rows, SLICE):
        first, held, size = at, [], 0
        for row, text in enumerate(texts(batch.slice(at, SLICE), text_col), at):
            if held and size + len(text) > BATCH_BYTES:
                yield first, held
                first, held, size = row, [], 0
            held.append(text)
            size += len(text)
        yield first, held


def _models(spark: SparkSession, path_a: str, path_b: str):
    ship(spark)
    with open(path_a, encoding="utf-8") as a, open(path_b, "rb") as b:
        return spark.sparkContext.broadcast((a.read(), b.read()))  # two vocabularies, of fixed size


def _lists(values: np.ndarray, edges: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, kind))


def align_tokens(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", links: str = "end") -> DataFrame:
    """One row a document: id, a_ids, b_ids, a_groups, b_groups, link_a, link_b (arrays of int).

    Groups are numbered from 0 in each document. ``links`` are pairs of places (from 0) of an A and a B
    token that end at the same byte ("end"), share bytes ("overlap") or lie in the same group ("group").
    Null and empty texts, and texts that a tokenizer does not give back byte by byte after a space in
    front, have no tokens: empty arrays. Texts are aligned whole. Rows without or with a repeated id are
    aligned like any others; other columns are not read, whatever their names. An empty table gives an
    empty table.
    """
    if links not in ("end", "overlap", "group"):
        raise ValueError("links are end, overlap or group")
    models = _models(docs.sparkSession, path_a, path_b)
    names = ["a_ids", "b_ids", "a_groups", "b_groups", "link_a", "link_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Tokenizers.of(*models.value)
        for batch in batches:
            for first, part in batches_of(batch, text_col):
                x = align(part, both)
                ends = x.edge_links
                if links == "overlap":
                    more = align(part, both, overlaps=True)
                    pairs, edges = (more.link_a, more.link_b), more.edge_links
                elif links == "group":
                    pairs = x.group_pairs()
                    edges = np.searchsorted(pairs[0], x.edge_a)
                else:
                    pairs, edges = (x.link_a, x.link_b), x.edge_links
                size_a, size_b, size_l = np.diff(x.edge_a), np.diff(x.edge_b), np.diff(edges)
                cols = [
                    (x.a, x.edge_a), (x.b, x.edge_b),
                    (x.group_a - np.repeat(ends[:-1], size_a), x.edge_a), (x.group_b - np.repeat(ends[:-1], size_b), x.edge_b),
                    (pairs[0] - np.repeat(x.edge_a[:-1], size_l), edges), (pairs[1] - np.repeat(x.edge_b[:-1], size_l), edges),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(id_col).slice(first, len(part)), *(_lists(v, e, pa.int32()) for v, e in cols)], names=[id_col, *names])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)] + [T.StructField(n, T.ArrayType(T.IntegerType())) for n in names])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def digests(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, pairs) of each document; pairs are packed numbers (``pair_kind``)."""
    models = _models(docs.sparkSession, path_a, path_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Tokenizers.of(*models.value)
        for batch in batches:
            for first, part in batches_of(batch, text_col):
                x = align(part, both)
                n_groups = len(x.link_a)
                in_a, in_b = np.bincount(x.group_a, minlength=n_groups), np.bincount(x.group_b, minlength=n_groups)
                before_a, before_b = np.cumsum(in_a), np.cumsum(in_b) - in_b
                shown = np.empty(len(x.a) + len(x.b), object)  # "id," or, last in its group, "id|" and "id;"
                last = np.diff(x.group_a, append=n_groups) > 0
                shown[np.arange(len(x.a)) + before_b[x.group_a]] = np.where(last, both.last_a[x.a], both.inside_a[x.a])
                last = np.diff(x.group_b, append=n_groups) > 0
                shown[np.arange(len(x.b)) + before_a[x.group_b]] = np.where(last, both.last_b[x.b], both.inside_b[x.b])
                edges = (x.edge_a + x.edge_b).tolist()
                shown = shown.tolist()
                digest = ["".join(shown[i:j])[:-1] for i, j in zip(edges, edges[1:])]
                digest = [hashlib.sha256(d.encode()).hexdigest() if d else "" for d in digest]
                packed = (x.a[x.link_a] * len(both.bytes_b) + x.b[x.link_b]).astype(kind := both.pair_kind()).tobytes()
                cuts = (x.edge_links * np.dtype(kind).itemsize).tolist()
                pairs = [packed[i:j] for i, j in zip(cuts, cuts[1:])]
                counts = [np.diff(e).astype(np.int64) for e in (x.edge_a, x.edge_b, x.edge_links, x.edge_links)]
                cols = [*map(pa.array, counts), pa.array(digest, pa.string()), pa.array(pairs, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(id_col).slice(first, len(part)), *cols], names=[id_col, *names])

    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"]
    kinds = [T.LongType()] * 4 + [T.StringType(), T.BinaryType()]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(n, k) for n, k in zip(names, kinds))])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _pairs(batch: pa.RecordBatch, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("pairs").to_pylist()), kind)


def pair_counts(aligned: DataFrame, kind: str) -> DataFrame:
    """(pair, n): how many links of the corpus hold each pair; every task adds up its own first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for part in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            own, n = np.unique(_pairs(part, kind), return_counts=True)
            pairs, at = np.unique(np.concatenate([pairs, own.astype(np.int64)]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(pairs)).astype(np.int64)  # exact below 2^53
        yield pa.RecordBatch.from_pydict({"pair": pa.array(pairs), "n": pa.array(counts)})

    return aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def link_statistics(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_a, n_b, n_groups, n_links, n_best, count_sum (bigint), groups_sha256.

    An id pair's count is the number of links in all documents that hold it; a link is best if no pair
    with its B id has a higher count. Texts without tokens (see ``align_tokens``) have zeros and ''. Rows
    that repeat an id are documents of their own and all count.
    """
    with open(path_a, encoding="utf-8") as a, open(path_b, "rb") as b:
        both = Tokenizers.of(a.read(), b.read())
    aligned = stored(digests(docs, path_a, path_b, id_col, text_col), "aligned")
    kind = both.pair_kind()
    table = pair_counts(aligned, kind).toArrow()  # bounded by the vocabularies
    if table.num_rows > both.pair_bound():
        raise RuntimeError("more id pairs than the vocabularies allow")
    order = np.argsort(table.column("pair").to_numpy())
    pairs, counts = table.column("pair").to_numpy()[order], table.column("n").to_numpy()[order]
    highest = np.zeros(len(both.bytes_b), np.int64)
    np.maximum.at(highest, pairs % len(both.bytes_b), counts)
    best = counts == highest[pairs % len(both.bytes_b)]
    known = docs.sparkSession.sparkContext.broadcast((pairs, counts, best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = known.value
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            at = np.searchsorted(pairs, _pairs(batch, kind).astype(np.int64))
            sums = [np.concatenate([[0], np.cumsum(x[at], dtype=np.int64)]) for x in (best, counts)]
            edges = np.concatenate([[0], np.cumsum(batch.column("n_links").to_numpy())])
            cols = [batch.column(n) for n in names[:5]] + [pa.array(np.diff(s[edges])) for s in sums] + [batch.column("groups_sha256")]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    kinds = [docs.schema[id_col].dataType, *[T.LongType()] * 6, T.StringType()]
    return aligned.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]))


def alignment_report(docs: DataFrame) -> DataFrame:
    """Links and groups of every whole text under the 50k byte-level file (A) and the 32k SentencePiece file (B)."""
    import public_tokenizers

    return link_statistics(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
