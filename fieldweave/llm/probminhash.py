"""Near-duplicate documents by ProbMinHash: Poisson arrivals of weighted shingles, bands, verification.

Every distinct shingle d of weight w(d) sends points of a Poisson process of rate w(d) to random
components; a component keeps the shingle that arrives first. Two documents agree in a component
with the probability Jaccard of their weights,
J_P = sum over shared d of 1 / sum over e of max(a(e)/a(d), b(e)/b(d)). A document stops as soon as
no later arrival can win. Weights are 1 + ln(count) ("log"), the counts, or 1 ("set", for which J_P
is the plain Jaccard). Bands of the signature name buckets; documents of a bucket are verified
against its smallest member first. Members that are not connected by then are compared block against block,
by matrices of their sketches and then by their texts, so a large group of copies costs one pair a member,
one of near copies no row a pair, and no link is lost.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from fieldweave.llm.common import discard, rows_with_ids, ship, slices, stored, texts
from fieldweave.llm.components import connected
from fieldweave.llm.shingles import mix, shingles

BANDS, ROWS = 40, 6  # misses a pair of similarity 0.8 with probability (1 - 0.8**6)**40 = 5e-6
MEMBERS = 512  # members of a bucket in one block
_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)
WEIGHTS = {"log": lambda n: 1 + np.log(n), "count": lambda n: n.astype(float), "set": lambda n: np.ones(len(n))}


def _arrivals(seeds: np.ndarray, first: int, count: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaps (unit rate) and components of arrivals first .. first+count-1 of each seed, reproducible alone."""
    x = mix(seeds[:, None] + np.arange(first + 1, first + count + 1, dtype=_U)[None, :] * _GOLDEN)
    gaps = -np.log(((x >> _U(24)).astype(float) + 0.5) * 2.0**-40)
    return gaps, (((x & _U(0xFFFFFF)) * _U(m)) >> _U(24)).astype(np.int64)


def signature(docs: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """For each (hashes, weights) the shingle that arrives first in each of ``m`` components, a row each.

    Documents without shingles keep zeros.
    """
    sizes = np.array([len(h) for h, _ in docs])
    owner = np.repeat(np.arange(len(docs)) * m, sizes)
    active, rates = np.concatenate([h for h, _ in docs]), np.concatenate([w for _, w in docs])
    best, winner, at = np.full(len(docs) * m, np.inf), np.zeros(len(docs) * m, _U), np.zeros(len(active))
    filled = sizes > 0
    done, block = 0, max(1, int(1.1 * m * np.log(m) * filled.sum() / max(1, len(active))))
    while len(active):
        gaps, comps = _arrivals(active, done, block, m)
        times = at[:, None] + np.cumsum(gaps, axis=1) / rates[:, None]
        flat, comp = times.ravel(), (comps + owner[:, None]).ravel()
        np.minimum.at(best, comp, flat)
        won = np.flatnonzero(best[comp] == flat)
        winner[comp[won]] = active[won // block]
        at = times[:, -1]
        going = np.flatnonzero(at < best.reshape(-1, m).max(axis=1)[owner // m])
        active, rates, at, owner = active[going], rates[going], at[going], owner[going]
        done += block
        block = max(1, min(block, 20_000 // max(1, len(active))))
    return winner.reshape(-1, m)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact J_P of two (ascending hashes, weights); 1 for two empty sets."""
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return float(len(ha) == len(hb))
    every = np.union1d(ha, hb)
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, ha)], y[np.searchsorted(every, hb)] = wa, wb
    with np.errstate(divide="ignore"):
        ratio = np.where(y > 0, x / np.where(y > 0, y, 1), np.inf)
    order = np.argsort(ratio)
    ratio, x, y = ratio[order], x[order], y[order]
    from_here = np.searchsorted(ratio, ratio, side="left")  # of equal ratios either term serves
    above = np.concatenate((np.cumsum(x[::-1])[::-1], [0.0]))[from_here]
    below = np.concatenate(([0.0], np.cumsum(y)))[from_here]
    shared = (x > 0) & (y > 0)
    return float(np.sum(1 / (above[shared] / x[shared] + below[shared] / y[shared])))


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, weight: str) -> DataFrame:
    """(id, same, bands, sketch): shingle-multiset digest, band hashes, low byte of every component."""
    m = BANDS * ROWS
    salt = np.arange(1, BANDS + 1, dtype=_U) * _GOLDEN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            same, bands, sketch = [], [None] * batch.num_rows, [None] * batch.num_rows
            weighed = []
            for text in texts(batch, text_col):
                hashes, counts = shingles(text, size)
                same.append(hashlib.blake2b(hashes.tobytes() + counts.astype(np.int64).tobytes(), digest_size=16).digest())
                weighed.append((hashes, WEIGHTS[weight](counts)))
            order = sorted(range(len(weighed)), key=lambda i: len(weighed[i][0]))  # neighbours need like numbers of arrivals
            for at in range(0, len(order), 32):
                part = order[at:at + 32]
                won = signature([weighed[i] for i in part], m)
                key = np.repeat(salt[None, :], len(part), axis=0)
                for j in range(ROWS):
                    key = mix(key * _U(0xD6E8FEB86659FD93) + won[:, j::ROWS])
                for i, k, w in zip(part, key.view(np.int64), won.astype(np.uint8)):
                    bands[i] = k if len(weighed[i][0]) else k[:0]
                    sketch[i] = w.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(id_col).cast(pa.int64()), pa.array(same, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], ["id", "same", "bands", "sketch"])

    ship(docs.sparkSession)
    return docs.where(F.col(id_col).isNotNull()).select(id_col, text_col).mapInArrow(run, "id long, same binary, bands array<long>, sketch binary")


def enough(least: float) -> float:
    """Share of equal sketch bytes that a pair of similarity ``least`` falls short of with probability 1e-9."""
    return least - 6 * (least * (1 - least) / (BANDS * ROWS)) ** 0.5


def alike_stars(stars: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sketches agree well enough to be compared."""
    side = lambda x: sketches.select(F.col("id").alias(x), F.col("sketch").alias(f"s{x}"))
    need = enough(least)

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in ("sa", "sb"))
                yield batch.filter(pa.array((x == y).mean(axis=1) >= need)).select(["a", "b"])

    return stars.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(alike, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, size: int, weight: str, least: float) -> DataFrame:
    """Pairs (a, b) whose exact J_P is ``least`` or more."""
    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, tuple] = OrderedDict()

        def weighed(i: int, text: str) -> tuple[np.ndarray, np.ndarray]:
            key = hash((i, text))
            if key not in kept:
                hashes, counts = shingles(text, size)
                kept[key] = hashes, WEIGHTS[weight](counts)
                if len(kept) > 200:
                    kept.popitem(last=False)
            return kept[key]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            link = [probability_jaccard(weighed(i, x), weighed(j, y)) >= least for i, x, j, y in zip(a, texts(batch, "ta"), b, texts(batch, "tb"))]
            yield batch.filter(pa.array(link, pa.bool_())).select(["a", "b"])

    near = stored(pairs, "pairs")
    wanted = near.select(F.col("a").alias("id")).unionAll(near.select("b")).distinct()
    found = stored(rows_with_ids(docs, wanted), "texts")
    text = lambda x: found.select(F.col("id").alias(x), F.col("text").alias(f"t{x}"))
    out = stored(near.join(text("a"), "a").join(text("b"), "b").select("a", "b", "ta", "tb").mapInArrow(exact, "a long, b long").distinct(), "links")
    discard(near)
    discard(found)
    return out


def matches(table: pa.Table, need: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of a rare member and any member of a block: of different components, sketches alike, and
    this bucket the first that the two share."""
    column = lambda c: table.column(c).to_numpy()
    ids, comps, rare = column("id"), column("c"), column("rare")
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    band, top = table.column("band")[0].as_py(), table.column("top")[0].as_py()
    left, right = np.flatnonzero(rare), np.flatnonzero(~rare)
    same = np.zeros((len(left), len(right)), np.int16)
    for j in range(sketch.shape[1]):
        same += sketch[left, j][:, None] == sketch[right, j][None, :]
    once = (comps[right] == top)[None, :] | (ids[left][:, None] < ids[right][None, :])
    x, y = np.nonzero((same >= need * sketch.shape[1]) & (comps[left][:, None] != comps[right][None, :]) & once)
    x, y = left[x], right[y]
    first = (bands[x] == bands[y]).argmax(axis=1) == band
    return x[first], y[first]


def block_links(table: pa.Table, need: float, least: float, size: int, weight: str) -> pa.Table:
    """Pairs of a block (members with their texts) whose exact J_P is ``least`` or more; each text is shingled once."""
    x, y = matches(table, need)
    weighed = []
    for text in texts(table):
        hashes, counts = shingles(text, size)
        weighed.append((hashes, WEIGHTS[weight](counts)))
    link = np.array([probability_jaccard(weighed[i], weighed[j]) >= least for i, j in zip(x.tolist(), y.tolist())], bool)
    ids = table.column("id").to_numpy()
    a, b = ids[x[link]], ids[y[link]]
    return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})


def unconnected_links(buckets: DataFrame, component: DataFrame, sketches: DataFrame, docs: DataFrame, size: int, weight: str, least: float) -> DataFrame:
    """Links (a, b) between members of one bucket that lie in different components.

    Each such pair has a member outside the bucket's commonest component, so those members are compared
    with the whole bucket, block by block: first as matrices of sketches, which leaves the members that have
    any alike, then by their texts. No pair is a row before it is a link, and a bucket of one component
    costs nothing.
    """
    rows = buckets.join(component, "id", "left").select("key", "band", "id", F.coalesce("component", "id").alias("c"))
    mixed = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    rows = stored(rows.join(mixed, "key", "left_semi"), "mixed")
    top = rows.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("top"), F.sum("n").alias("n"), F.max("n").alias("most"))
    parts = lambda n: F.ceil(n / MEMBERS).cast("int")
    dealt = rows.join(top, "key").withColumns({"parts": parts(F.col("n")), "rares": parts(F.col("n") - F.col("most")), "h": F.xxhash64("id", F.lit(7))})
    every = dealt.withColumns({"rare": F.lit(False), "j": F.pmod("h", F.col("parts")).cast("int"), "i": F.explode(F.sequence(F.lit(0), F.col("rares") - 1))})
    rare = dealt.where("c != top").withColumns({"rare": F.lit(True), "i": F.pmod("h", F.col("rares")).cast("int"), "j": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))})
    blocks = every.unionByName(rare).select("key", "i", "j", "band", "top", "rare", "id", "c").join(sketches, "id")
    need = enough(least)

    def alike(table: pa.Table) -> pa.Table:
        return table.take(pa.array(np.unique(np.concatenate(matches(table, need)))))

    near = stored(blocks.groupBy("key", "i", "j").applyInArrow(alike, blocks.schema), "blocks")
    discard(rows)
    found = near.join(rows_with_ids(docs, near).dropDuplicates(["id"]), "id")
    links = stored(found.groupBy("key", "i", "j").applyInArrow(lambda table: block_links(table, need, least, size, weight), "a long, b long").distinct(), "links")
    discard(near)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8, weight: str = "log") -> DataFrame:
    """(id, class_id, kept): one row per input row; the class is the least id reachable over links.

    Texts link if the probability Jaccard of their weighted ``size``-word shingles is ``least`` or
    more; words are lower case and split at white space, a text of fewer words is one shingle, and
    texts without words (null, empty) form one class. Ids are integers; rows that repeat an id are
    one document; a row without an id has a null class and is kept. An empty table gives none.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = plain.where("id IS NOT NULL")
    sigs = stored(signatures(known, "id", "text", size, weight), "signatures")
    first = sigs.groupBy("same").agg(F.min("id").alias("rep"))
    chosen = stored(sigs.join(first.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"]).select("id", "bands", "sketch"), "chosen")
    buckets = chosen.select("id", F.posexplode("bands").alias("band", "key"))
    heads = buckets.groupBy("key").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "head")
    buckets = stored(buckets.join(heads, "key"), "buckets")
    stars = stored(buckets.where("id != head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    check = lambda pairs: verified(pairs, known, size, weight, least)
    links = check(alike_stars(stars, chosen, least))
    rest = unconnected_links(buckets.select("key", "band", "id"), connected(links), chosen, known, size, weight, least)
    classes = connected(links.unionAll(rest))
    named = first.join(classes, first["rep"] == classes["id"], "left").select("same", F.coalesce("component", "rep").alias("class_id"))
    out = sigs.select("id", "same").join(named, "same").select(F.col("id").alias(id_col), "class_id")
    out = out.unionAll(plain.where("id IS NULL").select(F.col("id").alias(id_col), F.lit(None).cast("long").alias("class_id")))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("class_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with one of each near-duplicate class, that of the least id."""
    gone = near_duplicates(docs, id_col, text_col, **options).where(~F.col("kept")).select(F.col(id_col).cast(docs.schema[id_col].dataType).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
