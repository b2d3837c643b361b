"""Repeated substrings by a distributed merge sort that exchanges front-coded suffix runs.

Which suffixes are sorted: of every ``length``-byte string the least hash of its k-grams (leftmost
on ties) is its anchor. Equal strings have equal anchors at equal places, so a string can only be
repeated if its anchor's k-gram is, and neighbouring starts share their anchor. One suffix is
therefore sorted for each run of starts whose anchor occurs twice or more; it begins at the anchor
and carries the bytes in front of it as its left context.

How they are sorted: each map task sorts its suffixes, writes them front-coded (common prefix with
the one before, remaining bytes) and sends the runs to the tasks that the anchors' hashes name. A
loser tree there merges the runs; it keeps the common prefix of every loser with the last winner,
so bytes known to be equal are never compared again, and its output is the suffix order with its
common-prefix array. A start d bytes before the anchor is repeated if two suffixes share at least
length - d bytes to the right and d bytes to the left; both are read from common-prefix arrays.

An anchor with very many occurrences does not go to one task: its suffixes are collapsed by content
and their strings counted by hash, which spreads and pre-aggregates (``hot`` names the size).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from fieldweave.llm.common import bitmap, discard, map_columns, ship, slices, split_by_ids, stored, texts
from fieldweave.llm.shingles import mix, powers

GRAM = 48
PART_BYTES, RUN_BYTES = 8 << 20, 16 << 20  # of suffixes in one merge, and in one run; a worker's objects take several times that
_U = np.uint64
_BASE = 0xC2B2AE3D27D4EB4F
MOST_BITS = 1 << 28  # of the filter of repeated anchors
_SPOTS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)  # fixed values: its hash functions


def anchors(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, anchor position, anchor hash) of the runs of starts of one text."""
    n = len(raw) - length + 1
    gram = min(GRAM, length)
    if n < 1:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.int64),)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum((raw.astype(_U) + _U(1)) * powers(_BASE, len(raw)), dtype=_U)))
    count = len(raw) - gram + 1
    grams = mix((sums[gram:] - sums[:-gram]) * powers(pow(_BASE, -1, 1 << 64), count))
    least = (grams & ~_U(0x7FFFFFFF)) | np.arange(count, dtype=_U)  # high bits of the hash, then the place
    width, have = length - gram + 1, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if width > have:
        least = np.minimum(least[:n], least[width - have:width - have + n])
    at = (least & _U(0x7FFFFFFF)).astype(np.int64)
    lo = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
    hi = np.concatenate((lo[1:] - 1, [n - 1]))
    return lo, hi, at[lo], grams[at[lo]].view(np.int64)


def shared(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    end = min(len(a), len(b))
    if a[known:end] == b[known:end]:
        return end
    step = 8
    while a[known:known + step] == b[known:known + step]:
        known += step
        step *= 2
    high = min(known + step, end)
    while high - known > 1:
        mid = (known + high) // 2
        if a[known:mid] == b[known:mid]:
            known = mid
        else:
            high = mid
    return known


def front_code(strings: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Common prefix with the string before, and the rest, of strings in order."""
    lcp = np.zeros(len(strings), np.uint16)
    tails = strings[:1]
    for i in range(1, len(strings)):
        lcp[i] = k = shared(strings[i - 1], strings[i], 0)
        tails.append(strings[i][k:])
    return lcp, tails


class LoserTree:
    """Merges sorted runs of (strings, common prefixes); yields (run, index, common prefix with the last)."""

    def __init__(self, runs: list[tuple[list[bytes], list[int]]]):
        self.runs = runs
        self.at = [0] * len(runs)
        self.known = [0] * len(runs)  # common prefix of each run's head with the last winner
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.tree = [-1] * self.size

    def _less(self, x: int, y: int) -> bool:
        """Whether the head of x goes first; leaves in ``known`` the loser's prefix with the winner."""
        if y < 0 or y >= len(self.runs) or self.at[y] >= len(self.runs[y][0]):
            return True
        if x < 0 or x >= len(self.runs) or self.at[x] >= len(self.runs[x][0]):
            return False
        kx, ky = self.known[x], self.known[y]
        if kx != ky:  # the head that shares more with the last winner is the smaller one
            return kx > ky
        a, b = self.runs[x][0][self.at[x]], self.runs[y][0][self.at[y]]
        k = shared(a, b, kx)
        first = k == len(a) or (k < len(b) and a[k] < b[k])
        self.known[y if first else x] = k
        return first

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        winners = list(range(self.size))
        level = self.size
        while level > 1:
            level //= 2
            nxt = []
            for i in range(level):
                x, y = winners[2 * i], winners[2 * i + 1]
                win = x if self._less(x, y) else y
                self.tree[level + i] = y if win == x else x
                nxt.append(win)
            winners = nxt
        win = winners[0]
        while win < len(self.runs) and self.at[win] < len(self.runs[win][0]):
            i = self.at[win]
            yield win, i, self.known[win]
            self.at[win] = i + 1
            if i + 1 < len(self.runs[win][0]):
                self.known[win] = self.runs[win][1][i + 1]
            node = (self.size + win) // 2
            while node:
                other = self.tree[node]
                if other >= 0 and not self._less(win, other):
                    self.tree[node], win = win, other
                node //= 2


def covered(right_lcp: np.ndarray, left: list[bytes], least: np.ndarray, most: np.ndarray, several: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, d) whose string, d bytes before the anchor, is found elsewhere too.

    ``right_lcp`` is the common-prefix array of the suffixes in order; ``least`` and ``most`` bound
    each one's d; ``several`` marks suffixes that stand for more than one place.
    """
    n = len(left)
    back = sorted(range(n), key=lambda i: left[i][::-1])
    turned = [left[i][::-1] for i in back]
    left_lcp = front_code(turned)[0].astype(np.int64)
    back = np.array(back, np.int64)
    found = [np.empty((2, 0), np.int64)]
    cls = np.empty(n, np.int64)
    for d in range(int(least.min()), int(most.max()) + 1):
        own = np.flatnonzero((least <= d) & (d <= most))
        if not len(own):
            continue
        cls[back] = np.cumsum(left_lcp < d) if d else 0
        key = np.cumsum(right_lcp < length - d)[own] * (n + 1) + cls[own]
        order = np.argsort(key, kind="stable")
        same = np.diff(key[order]) == 0
        dup = np.zeros(len(own), bool)
        dup[order[1:][same]] = True
        dup[order[:-1][same]] = True
        own = own[dup | several[own]]
        found.append(np.stack((own, np.full(len(own), d))))
    return tuple(np.concatenate(found, axis=1))


def _pack(strings: list[bytes]) -> tuple[bytes, bytes]:
    return np.array([len(s) for s in strings], np.uint16).tobytes(), b"".join(strings)


def _unpack(sizes: bytes, data: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(sizes, np.uint16), dtype=np.int64).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


RUN = "part int, lcp binary, sizes binary, tails binary, left_sizes binary, left binary, places binary, ids binary, starts binary"


def anchor_spots(h: np.ndarray, bits: int) -> np.ndarray:
    """Places of anchor hashes in a filter of ``bits`` bits, a row for each of its hash functions."""
    return np.stack([(h.view(_U) * _U(c)) >> _U(65 - bits.bit_length()) for c in _SPOTS]).astype(np.int64)


def repeated_anchors(again: DataFrame, count: int) -> np.ndarray:
    """Filter of the hashes ``h``: 32 bits for each of ``count`` up to 32 MB, so that few others pass it."""
    bits = min(MOST_BITS, 1 << max(16, (32 * count).bit_length()))
    return bitmap(again.select("h"), lambda batch: anchor_spots(batch.column("h").to_numpy(), bits).ravel(), bits)


def wanted_runs(batches: Iterator[pa.RecordBatch], length: int, want: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, bytes, Iterator[tuple[int, int, int, int]]]]:
    """(id, bytes, runs) of each text; runs are those of ``anchors`` whose hash is wanted."""
    for batch in slices(batches):
        for i, text in zip(batch.column("id").to_pylist(), texts(batch)):
            raw = text.encode("utf-8", "surrogatepass")
            found = anchors(np.frombuffer(raw, np.uint8), length)
            good = np.flatnonzero(want(found[3]))
            yield i, raw, zip(*(f[good].tolist() for f in found))


def suffix_runs(batches: Iterator[pa.RecordBatch], parts: int, length: int, want: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Sort the suffixes of a task's documents; a row is one front-coded run for one merge task."""
    held: dict[int, dict[tuple[bytes, bytes], list[tuple[int, int]]]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for part, suffixes in held.items():
            order = sorted(suffixes)
            lcp, tails = front_code([right for right, _ in order])
            sizes, data = _pack(tails)
            left_sizes, left = _pack([x for _, x in order])
            places = [suffixes[x] for x in order]
            flat = [p for ps in places for p in ps]
            row = [part, lcp.tobytes(), sizes, data, left_sizes, left, np.array([len(p) for p in places], np.int32).tobytes(), np.array([i for i, _ in flat], np.int64).tobytes(), np.array([s for _, s in flat], np.int64).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32())] + [pa.array([x], pa.binary()) for x in row[1:]], names=[f.split()[0] for f in RUN.split(", ")])
        held.clear()

    size = 0
    for i, raw, runs in wanted_runs(batches, length, want):
        for a, b, c, x in runs:
            held.setdefault(x % parts, {}).setdefault((raw[c:b + length], raw[a:c]), []).append((i, a))
            size += b + length - a
        if size > RUN_BYTES:
            yield from flush()
            size = 0
    yield from flush()


def merge_runs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Merge the runs of each part and give the repeated stretches (id, a, b) of its suffixes."""

    def merge(rows: list[dict]) -> pa.RecordBatch:
        runs, lefts, places, ids, starts = [], [], [], [], []
        for row in rows:
            lcp, strings, last = np.frombuffer(row["lcp"], np.uint16).tolist(), [], b""
            for k, tail in zip(lcp, _unpack(row["sizes"], row["tails"])):
                last = last[:k] + tail
                strings.append(last)
            runs.append((strings, lcp))
            lefts.append(_unpack(row["left_sizes"], row["left"]))
            ends = np.cumsum(np.frombuffer(row["places"], np.int32), dtype=np.int64)
            places.append(list(zip([0, *ends.tolist()], ends.tolist())))
            ids.append(np.frombuffer(row["ids"], np.int64))
            starts.append(np.frombuffer(row["starts"], np.int64))
        order = list(LoserTree(runs))
        lcp = np.array([k for _, _, k in order], np.int64)
        left = [lefts[r][i] for r, i, _ in order]
        depth = np.array([len(x) for x in left], np.int64)
        least = length - np.array([len(runs[r][0][i]) for r, i, _ in order], np.int64)  # right = last start + length - anchor
        spans = [places[r][i] for r, i, _ in order]
        several = np.array([b - a > 1 for a, b in spans])
        who, d = covered(lcp, left, least, depth, several, length)
        sort = np.lexsort((-d, who))
        who, offset = who[sort], depth[who[sort]] - d[sort]
        cut = np.flatnonzero((np.diff(who) != 0) | (np.diff(offset) != 1)) + 1
        heads, tails = np.concatenate(([0], cut)).astype(np.int64), np.concatenate((cut, [len(who)])) - 1
        out: list[list[np.ndarray]] = [[], [], []]
        for a, b in zip(heads.tolist(), tails.tolist()) if len(who) else ():
            r, (x, y) = order[who[a]][0], spans[who[a]]
            at = starts[r][x:y]
            out[0].append(ids[r][x:y])
            out[1].append(at + offset[a])
            out[2].append(at + offset[b] + length)
        cols = [np.concatenate(c) if c else np.empty(0, np.int64) for c in out]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["id", "a", "b"])

    rows: list[dict] = []
    for batch in batches:  # sorted by part
        for row in batch.to_pylist():
            if rows and rows[0]["part"] != row["part"]:
                yield merge(rows)
                rows = []
            rows.append(row)
    if rows:
        yield merge(rows)


def hot_repeats(docs: DataFrame, length: int, want: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(id, a, b) of repeated stretches around anchors with very many places, by counting strings."""

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, tuple[bytes, list[int], list[int]]] = {}
            for i, raw, runs in wanted_runs([batch], length, want):
                for a, b, c, _ in runs:
                    data = raw[a:b + length]
                    key = hashlib.blake2b((c - a).to_bytes(4, "little") + data, digest_size=16).digest()
                    _, ids, starts = seen.setdefault(key, (data, [], []))
                    ids.append(i)
                    starts.append(a)
            vals = list(seen.values())
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([v[0] for v in vals], pa.binary()), pa.array([v[1] for v in vals], pa.list_(pa.int64())), pa.array([v[2] for v in vals], pa.list_(pa.int64()))], names=["what", "data", "ids", "starts"])

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for what, data, n in zip(*(batch.column(c).to_pylist() for c in ("what", "data", "n"))):
                count = len(data) - length + 1
                keys = [hashlib.blake2b(data[i:i + length], digest_size=16).digest() for i in range(count)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([what] * count, pa.binary()), pa.array(range(count), pa.int64()), pa.array([n] * count, pa.int64())], names=["key", "what", "off", "n"])

    rows = stored(docs.mapInArrow(collapse, "what binary, data binary, ids array<long>, starts array<long>"), "hot")
    kinds = rows.groupBy("what").agg(F.sum(F.size("ids")).alias("n"), F.max("data").alias("data"))
    starts = stored(kinds.mapInArrow(strings, "key binary, what binary, off long, n long"), "strings")
    again = stored(starts.groupBy("key").agg(F.sum("n").alias("m")).where("m > 1").select("key"), "again")
    offs = starts.join(again, "key", "left_semi").groupBy("what").agg(F.collect_list("off").alias("offs"))
    each = rows.select("what", F.explode(F.arrays_zip("ids", "starts")).alias("p")).join(offs, "what")
    each = each.select(F.col("p.ids").alias("id"), F.col("p.starts").alias("s"), F.explode("offs").alias("off"))
    return each.select("id", (F.col("s") + F.col("off")).alias("a"), (F.col("s") + F.col("off") + length).alias("b"))


def repeated_stretches(docs: DataFrame, length: int, hot: int) -> DataFrame:
    """(id, a, b): byte ranges of ``docs`` (id, text) covered by strings found elsewhere.

    Texts are not shuffled: a filter of the anchors found twice or more goes to every task, which sends the
    suffixes of what passes. An anchor found once that passes costs its suffix and finds no equal.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [anchors(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8), length) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[3] for f in found] or [np.empty(0, np.int64)]))], names=["h"])

    spark = docs.sparkSession
    ship(spark)
    again = stored(docs.mapInArrow(find, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "anchors")
    count, places, most = again.agg(F.count(F.lit(1)), F.sum("n"), F.max("n")).first()
    usual = length + (length - min(GRAM, length)) // 2  # bytes of a suffix with its left context
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + (places or 0) * usual // PART_BYTES)
    many = np.array([r["h"] for r in again.where(F.col("n") > hot).select("h").collect()] if (most or 0) > hot else [], np.int64)  # at most places / hot
    shared = spark.sparkContext.broadcast((repeated_anchors(again, count), np.sort(many)))
    discard(again)

    def hot_ones(h: np.ndarray) -> np.ndarray:
        return np.isin(h, shared.value[1])

    def cold_ones(h: np.ndarray) -> np.ndarray:
        bits = shared.value[0]
        spots = anchor_spots(h, len(bits) * 8)
        return ((bits[spots >> 3] >> (spots & 7)) & 1).all(axis=0) & ~hot_ones(h)

    sent = docs.mapInArrow(lambda b: suffix_runs(b, parts, length, cold_ones), RUN)
    out = sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(lambda b: merge_runs(b, length), "id long, a long, b long")
    return out.unionAll(hot_repeats(docs, length, hot_ones)) if len(many) else out


def drop_repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, hot: int = 20_000) -> DataFrame:
    """Documents without the bytes covered by a ``length``-byte string that also starts elsewhere.

    Texts are UTF-8 bytes; matches never cross documents, overlaps within one document count, and
    all places lose their bytes. Adds n_bytes, n_removed, n_spans (bigint) and kept (binary); the
    text column becomes the kept bytes as UTF-8, where a character cut in two becomes U+FFFD. Null
    text counts as empty. Ids are integers and name documents: rows that repeat an id must repeat
    its text and are found elsewhere, in each other; a row without an id is compared with nothing. An empty table gives an
    empty table; input columns named like the added ones are replaced.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spans = repeated_stretches(plain.where("id IS NOT NULL"), length, hot)
    spans = stored(spans.groupBy("id").agg(F.collect_list(F.struct("a", "b")).alias("__spans")), "spans")
    some, others = split_by_ids(docs, spans, F.col(id_col).cast("long"))
    own = spans.withColumnRenamed("id", "__own")
    some = some.join(own, F.col(id_col).cast("long") == F.col("__own"), "left").drop("__own")
    both = some.unionByName(others.withColumn("__spans", F.lit(None).cast(own.schema["__spans"].dataType)))

    def cut(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {text_col: [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for text, spans in zip(texts(batch, text_col), batch.column("__spans")):
            raw = text.encode("utf-8", "surrogatepass")
            edge = np.zeros(len(raw) + 1, np.int32)
            if spans.is_valid:
                np.add.at(edge, spans.values.field(0).to_numpy(), 1)
                np.add.at(edge, spans.values.field(1).to_numpy(), -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            for name, value in ((text_col, kept.decode("utf-8", "replace")), ("n_bytes", len(raw)), ("n_removed", len(raw) - len(kept)), ("n_spans", int(gone[:1].sum() + (np.diff(gone.astype(np.int8)) > 0).sum())), ("kept", kept)):
                out[name].append(value)
        return out

    return map_columns(both, cut, drop=("__spans",), **{text_col: T.StringType(), "n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "kept": T.BinaryType()})


def substring_report(docs: DataFrame) -> DataFrame:
    """Digest of the operator's result for each document."""
    out = drop_repeated_substrings(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
