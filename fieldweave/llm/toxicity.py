"""Toxic spans and document scores from a linear-chain conditional random field.

Documents carry the labels, so tokens are labelled first: words and within-word character n-grams
that a number of toxic training documents hold and next to no clean one does mark the tokens of toxic
documents. The field has two states (clean, toxic); a token's emission is the sum of hashed weights of
its word and its character n-grams, chained by a transition matrix over a sentence. It is fitted by
gradient ascent on the exact conditional likelihood; a chain has at most ``CHAIN`` words. Forward-backward marginals give the offending
offsets and, through a logistic curve of the largest and the summed marginal, the document's score.

The fit reads a bounded sample of labelled rows (``sample`` rows of at most ``sample_chars`` code points);
scoring reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from fieldweave.llm.common import map_columns, texts
from fieldweave.llm.shingles import BASE, mix, powers

BITS, WIDE = 18, 24
BREAKS = ".!?\n"
CHAIN = 512  # words of one chain at most; a longer sentence goes on in the next chain
CHUNK = 1 << 19  # code points that are tagged together
LEAST_DOCS, LEAST_SHARE = 5, 0.95  # what marks a feature as toxic: documents that hold it, share of toxic ones
_U = np.uint64


@cache
def word_points() -> np.ndarray:
    """Which code points belong to words: letters, digits and the underscore."""
    return np.array([c.isalnum() or c == "_" for c in map(chr, range(0x110000))])


def lowered(text: str) -> str:
    """Lower case of the same number of code points."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c in text for x in (c.lower(),))


@dataclass
class Tokens:
    """Words of some texts in order: owning text, place in it, hash; sizes of the chains they form."""

    points: np.ndarray
    at: np.ndarray
    owner: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    sizes: np.ndarray

    def grams(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``which``, wide hash slot) of the words and their character n-grams of 3 to 5, boundaries marked."""
        size = self.end[which] - self.start[which] + 2
        word = np.repeat(np.arange(len(size), dtype=np.int32), size)
        left = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
        char = self.points[np.clip(self.at[which][word] + left - 1, 0, len(self.points) - 1)].astype(_U) + _U(3)
        rest = size[word] - left
        char[left == 0], char[rest == 1] = 1, 2
        row, slot, h = [np.arange(len(size), dtype=np.int32)], [self.hash[which]], char
        for n in range(2, 6):
            h = h[:-1] * _U(BASE) + char[n - 1:]
            if n > 2:
                own = rest[:len(h)] >= n
                row.append(word[:len(h)][own])
                slot.append(mix(h[own]))
        return np.concatenate(row), (np.concatenate(slot) & _U((1 << WIDE) - 1)).astype(np.int32)


def tokens(batch: list[str]) -> Tokens:
    points = np.frombuffer("".join(lowered(t) + "\n" for t in batch).encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = np.flatnonzero(np.diff(word_points()[points], prepend=False, append=False))
    at, stop = edge[::2], edge[1::2]
    first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in batch])))
    owner = np.searchsorted(first, at, side="right") - 1
    sums = np.concatenate((np.zeros(1, _U), np.cumsum((points.astype(_U) + _U(1)) * powers(BASE, len(points)), dtype=_U)))
    key = mix((sums[stop] - sums[at]) * powers(pow(BASE, -1, 1 << 64), len(points))[at])
    fresh = np.flatnonzero(np.diff(np.cumsum(np.isin(points, [ord(c) for c in BREAKS]))[at], prepend=-1))
    left = np.arange(len(at)) - np.repeat(fresh, np.diff(np.append(fresh, len(at))))
    sizes = np.diff(np.append(np.flatnonzero(left % CHAIN == 0), len(at)))
    return Tokens(points, at, owner, at - first[owner], stop - first[owner], key, sizes)


class Chains:
    """Sequences laid out by step: all first tokens, longest sequence first, then all second ones, and so on."""

    def __init__(self, sizes: np.ndarray):
        order = np.argsort(-sizes, kind="stable")
        rank = np.empty(len(sizes), np.int64)
        rank[order] = np.arange(len(sizes))
        alive = np.searchsorted(-sizes[order], -np.arange(1, (sizes.max() if len(sizes) else 0) + 1), side="right")
        edge = np.concatenate(([0], np.cumsum(alive)))
        seq = np.repeat(np.arange(len(sizes)), sizes)
        #: where each token lies; the sequence of what lies there; where the token before it lies (from the second step on)
        self.place = edge[np.arange(len(seq)) - (np.cumsum(sizes) - sizes)[seq]] + rank[seq]
        self.seq = np.empty(len(seq), np.int64)
        self.seq[self.place] = seq
        self.first = int(alive[0]) if len(alive) else 0
        self.before = np.arange(self.first, len(seq)) - np.repeat(alive[:-1], alive[1:])
        self.edge = edge.tolist()

    def run(self, emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward odds of the toxic state, and its posterior, in this layout.

        ``emit`` are weights of the toxic state (the clean one has 1), ``move`` the transition weights.
        """
        (m00, m01), (m10, m11) = move.tolist()
        steps = list(zip(self.edge, self.edge[1:], self.edge[2:]))
        fore, back = emit.copy(), np.ones(len(emit))
        for a, b, c in steps:
            r = fore[a:a + c - b]
            fore[b:c] *= (m01 + m11 * r) / (m00 + m10 * r)
        for a, b, c in reversed(steps):
            x = emit[b:c] * back[b:c]
            back[a:a + c - b] = (m10 + m11 * x) / (m00 + m01 * x)
        odds = fore * back
        return fore, back, odds / (1 + odds)

    def pairs(self, emit: np.ndarray, move: np.ndarray, fore: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Expected number of each transition."""
        r, x = fore[self.before], (emit * back)[self.first:]
        each = np.stack((np.full(len(r), move[0, 0]), move[0, 1] * x, move[1, 0] * r, move[1, 1] * r * x))
        return (each / each.sum(axis=0)).sum(axis=1).reshape(2, 2)


def marginals(scores: np.ndarray, sizes: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the toxic state for flattened sequences, log partition per sequence, expected transitions.

    ``scores`` are emissions of the toxic state (the clean one has 0), ``sizes`` the sequence lengths,
    ``step`` the logarithms of the 2 x 2 transition weights. All sequences advance together.
    """
    chains, move = Chains(sizes), np.exp(step)
    emit = np.empty(len(scores))
    emit[chains.place] = np.exp(np.clip(scores, -30, 30))
    fore, back, post = chains.run(emit, move)
    scale, r = 1 + emit, fore[chains.before]
    scale[chains.first:] = (move[0, 0] + r * move[1, 0] + emit[chains.first:] * (move[0, 1] + r * move[1, 1])) / (1 + r)
    return post[chains.place], np.bincount(chains.seq, np.log(scale), len(sizes)), chains.pairs(emit, move, fore, back)


def parts(text: str) -> Iterator[tuple[int, str]]:
    """Pieces of a text of at most CHUNK code points with their places, cut between words where there is such a place."""
    at, word = 0, word_points()
    while len(text) - at > CHUNK:
        cut = at + CHUNK
        while cut > at and word[ord(text[cut - 1])] and word[ord(text[cut])]:
            cut -= 1
        cut = cut if cut > at else at + CHUNK
        yield at, text[at:cut]
        at = cut
    yield at, text[at:]


@dataclass
class Field:
    """Fitted weights: emissions by hashed feature, bias, transitions, and the document curve."""

    weights: np.ndarray
    bias: float
    step: np.ndarray
    curve: np.ndarray

    def token_scores(self, t: Tokens) -> np.ndarray:
        _, which, kind = np.unique(t.hash, return_index=True, return_inverse=True)
        row, slot = t.grams(which)
        return (np.bincount(row, self.weights[slot & ((1 << BITS) - 1)], len(which)) + self.bias)[kind]

    def tag(self, batch: list[str], span_at: float) -> list[tuple[float, list[tuple[int, int]]]]:
        """Score and toxic spans (start, end in code points) of each text."""
        top, total = np.zeros(len(batch)), np.zeros(len(batch))
        spans: list[list[tuple[int, int]]] = [[] for _ in batch]
        held: list[tuple[int, int, str]] = []
        size = 0
        for i, text in enumerate(batch):
            for at, part in parts(text):
                if held and size + len(part) > CHUNK:
                    self._tag(held, top, total, spans, span_at)
                    held, size = [], 0
                held.append((i, at, part))
                size += len(part)
        self._tag(held, top, total, spans, span_at)
        return list(zip(self.document(top, total), spans))

    def _tag(self, held: list[tuple[int, int, str]], top: np.ndarray, total: np.ndarray, spans: list, span_at: float) -> None:
        t = tokens([part for _, _, part in held])
        post = marginals(self.token_scores(t), t.sizes, self.step)[0]
        doc, at = np.array([i for i, _, _ in held] or [0])[t.owner], np.array([at for _, at, _ in held] or [0])[t.owner]
        np.maximum.at(top, doc, post)
        total += np.bincount(doc, post, len(total))
        hit = np.flatnonzero(post >= span_at)
        fresh = np.zeros(len(post), bool)
        fresh[np.cumsum(t.sizes) - t.sizes] = True
        head = np.diff(hit, prepend=-2) > 1
        head |= fresh[hit]
        last = np.append(head[1:], True)[:len(hit)]
        ends = (t.end + at)[hit[last]].tolist()
        for i, a, b in zip(doc[hit[head]].tolist(), (t.start + at)[hit[head]].tolist(), ends):
            spans[i].append((a, b))

    def document(self, top: np.ndarray, total: np.ndarray) -> list[float]:
        x = np.clip(curve_inputs(top, total) @ self.curve, -30, 30)
        return (1 / (1 + np.exp(-x))).tolist()


def curve_inputs(top: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.stack((np.ones(len(top)), top, np.log1p(total)), axis=1)


def marking_slots(docs: list[np.ndarray], labels: list[int], edge: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Which wide slots mark toxic documents; ``docs`` are their words, whose slots lie between two of ``edge``."""
    every, toxic = np.zeros(1 << WIDE, np.uint16), np.zeros(1 << WIDE, np.uint16)
    for words, label in zip(docs, labels):
        size = edge[words + 1] - edge[words]
        held = np.unique(slot[np.arange(size.sum()) + np.repeat(edge[words] - np.cumsum(size) + size, size)])
        every[held] += 1
        toxic[held] += bool(label)
    marks, often = np.zeros(1 << WIDE, bool), np.flatnonzero(toxic >= LEAST_DOCS)
    marks[often] = toxic[often] >= LEAST_SHARE * every[often]
    return marks


def vocabulary(batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word number of each token, chain sizes, owning text of each token; (word, wide slot) of the words' grams, by word."""
    keys, sizes, owners, words, rows, slots = [], [], [], np.empty(0, _U), [], []
    for at in range(0, len(batch), 256):
        t = tokens(batch[at:at + 256])
        keys.append(t.hash)
        sizes.append(t.sizes)
        owners.append(t.owner + at)
        found, which = np.unique(t.hash, return_index=True)
        new = ~np.isin(found, words)
        row, slot = t.grams(which[new])
        rows.append(row + len(words))
        slots.append(slot)
        words = np.concatenate((words, found[new]))
    order = np.argsort(words)
    rank = np.empty(len(words), np.int32)
    rank[order] = np.arange(len(words))
    row = rank[np.concatenate(rows)]
    by_word = np.argsort(row, kind="stable")
    kind = np.searchsorted(words[order], np.concatenate(keys))
    return kind, np.concatenate(sizes), np.concatenate(owners), row[by_word], np.concatenate(slots)[by_word]


def fit_field(rows: list[tuple[str, int]], rounds: int = 60, rate: float = 0.3, ridge: float = 1e-5) -> Field:
    """Field fitted to (text, label) rows; without rows, or with one label only, scores are the label's share."""
    share = (sum(y for _, y in rows) + 0.5) / (len(rows) + 1)
    flat = Field(np.zeros(1 << BITS, np.float32), -8.0, np.zeros((2, 2)), np.array([np.log(share / (1 - share)), 0.0, 0.0]))
    if len({y for _, y in rows}) < 2:
        return flat
    kind, sizes, owner, row, slot = vocabulary([text for text, _ in rows])
    if not len(kind):
        return flat
    count = int(row[-1]) + 1
    edge = np.searchsorted(row, np.arange(count + 1))
    once = sorted({text: i for i, (text, _) in enumerate(rows)}.values())  # equal texts count once
    cut = np.searchsorted(owner, np.arange(len(rows) + 1))
    marks = marking_slots([np.unique(kind[cut[i]:cut[i + 1]]) for i in once], [rows[i][1] for i in once], edge, slot)
    marked = np.bincount(row, marks[slot], count) > 0
    if not marked.any():
        return flat
    slot = slot & ((1 << BITS) - 1)
    chains = Chains(sizes)
    by_step = np.argsort(chains.place)
    kind, owner = kind[by_step], owner[by_step]
    gold = (marked[kind] & np.array([bool(y) for _, y in rows])[owner]).astype(float)
    was, now = gold[chains.before], gold[chains.first:]
    seen = np.array([[((1 - was) * (1 - now)).sum(), ((1 - was) * now).sum()], [(was * (1 - now)).sum(), (was * now).sum()]])
    w, bias, step = np.zeros(1 << BITS), -3.0, np.zeros((2, 2))
    gw, gb, gs = np.full(1 << BITS, 1e-8), 1e-8, np.full((2, 2), 1e-8)

    def posterior() -> tuple[np.ndarray, np.ndarray]:
        emit, move = np.exp(np.clip(np.bincount(row, w[slot], count) + bias, -30, 30))[kind], np.exp(step)
        fore, back, post = chains.run(emit, move)
        return post, chains.pairs(emit, move, fore, back)

    for _ in range(rounds):  # AdaGrad on the exact gradient: observed less expected counts
        post, pairs = posterior()
        off = np.bincount(kind, gold - post, count)
        dw, db, ds = np.bincount(slot, off[row], 1 << BITS) - ridge * len(kind) * w, off.sum(), seen - pairs
        gw, gb, gs = gw + dw * dw, gb + db * db, gs + ds * ds
        w, bias, step = w + rate * dw / np.sqrt(gw), bias + rate * db / gb**0.5, step + rate * ds / np.sqrt(gs)
    field = Field(w.astype(np.float32), float(bias), step, flat.curve)
    post, _ = posterior()
    top = np.zeros(len(rows))
    np.maximum.at(top, owner, post)
    x, y = curve_inputs(top, np.bincount(owner, post, len(rows))), np.array([label for _, label in rows], float)
    beta = flat.curve.copy()
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(3), x.T @ (y - p) - beta * [0, 1, 1])
    field.curve = beta
    return field


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 2500, sample_chars: int = 4000) -> Field:
    """Field from the labelled rows that are not held out: the ``sample`` ones of least hashed id."""
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__y"))
    short = docs.where(F.length(text_col) <= sample_chars)
    near = short.select(id_col).join(marked, short[id_col] == marked["__id"])
    chosen = near.orderBy(F.xxhash64(id_col), id_col).select("__id", "__y").limit(sample).distinct()  # ids first, so that no task sends texts it may not need
    rows = short.select(id_col, text_col).join(F.broadcast(chosen), short[id_col] == chosen["__id"])
    rows = rows.orderBy(F.xxhash64(id_col), id_col, text_col).select(text_col, "__y").limit(sample).collect()
    return fit_field([(r[0], r[1]) for r in rows])


def score_documents(docs: DataFrame, field: Field, text_col: str = "text", cut: float = 0.3, span_at: float = 0.5) -> DataFrame:
    """Adds score (0 to 1), predicted (1 if score >= ``cut``) and toxic_spans (start, end in code points).

    Every text is read whole; null and empty texts have the score of no toxic token and no spans.
    Rows are kept as they are, repeated ones too; input columns named like the added ones are replaced.
    An empty table gives an empty table.
    """
    at = docs.sparkSession.sparkContext.broadcast(field)  # 2**18 weights

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {"score": [], "predicted": [], "toxic_spans": []}
        for score, spans in at.value.tag(texts(batch, text_col), span_at):
            out["score"].append(score)
            out["predicted"].append(int(score >= cut))
            out["toxic_spans"].append([{"start": a, "end": b} for a, b in spans])
        return out

    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    return map_columns(docs, run, score=T.DoubleType(), predicted=T.IntegerType(), toxic_spans=T.ArrayType(span))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    out = score_documents(docs, fit(docs, labels))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", F.size("toxic_spans").alias("n_spans"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the field does not reject, with their own columns."""
    docs = docs.select(*(F.col(c).alias(f"__in_{c}") if c in ("score", "predicted", "toxic_spans") else F.col(c) for c in docs.columns))
    out = score_documents(docs, fit(docs, labels, id_col, text_col), text_col).where("predicted = 0").drop("score", "predicted", "toxic_spans")
    return out.select(*(F.col(c).alias(c.removeprefix("__in_")) for c in out.columns))
