"""Token alignment against the tokenizers' own libraries and a plain double loop."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fieldweave.llm import alignment, bpe

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", "plain words here", "a  b", " ▁x", "</s> <|endoftext|>", "café 日本 \U0001f642", "x\x00y", "\n\n", "tab\tand\r\n", "word " * 40_000, " 　", "it's 2024!"]


@pytest.fixture(scope="module")
def both():
    with open(A, encoding="utf-8") as a, open(B, "rb") as b:
        return alignment.Tokenizers.of(a.read(), b.read())


def brute(texts):
    """Per text: A ids, B ids, groups, links by places; by the files' own libraries and loops over offsets."""
    slow = Tokenizer.from_file(A)
    slow.encode_special_tokens = True
    own = sentencepiece.SentencePieceProcessor(model_file=B)
    back = {bpe.byte_level(chr(c)): chr(c) for c in [*range(33, 127), *range(161, 173), *range(174, 256), *range(256, 324)]}
    back = {c: b for b, c in back.items()}
    out = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        ids = slow.encode(" " + (text or ""), add_special_tokens=False).ids, own.encode(text or "")
        parts = [bytes(back[c] for c in slow.id_to_token(i)) for i in ids[0]], [
            bytes([int(own.id_to_piece(i)[3:5], 16)]) if own.is_byte(i) else own.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
        if not text or any(b"".join(p) != whole for p in parts):
            out.append(([], [], [], []))
            continue
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        shared = sorted(set(ends[0]) & set(ends[1]))
        number, groups = set(shared), [([], []) for _ in shared]
        for side in (0, 1):
            g = 0
            for i, e in zip(ids[side], ends[side]):
                groups[g][side].append(i)
                g += e in number
        places = [{e: i for i, e in enumerate(x)} for x in ends]
        out.append((*ids, groups, [(places[0][e], places[1][e]) for e in shared]))
    return out


def test_product_matches_dense():
    rng = np.random.default_rng(5)
    dense = lambda m, n: (rng.random((m, n)) < 0.3) * rng.integers(1, 5, (m, n))

    def rows(x):
        i, j = np.nonzero(x)
        return alignment.Rows(np.concatenate([[0], np.cumsum(np.bincount(i, minlength=len(x)))]), j, x[i, j], x.shape[1])

    for _ in range(20):
        a, b = dense(7, 9), dense(9, 5)
        i, j, v = alignment.product(rows(a), rows(b))
        got = np.zeros((7, 5), int)
        got[i, j] = v
        assert (got == a @ b).all() and len(v) == np.count_nonzero(a @ b)
        t = rows(a).transposed()
        assert (t.start == rows(a.T).start).all() and (t.cols == rows(a.T).cols).all() and (t.values == rows(a.T).values).all()


def test_ids_are_those_of_the_file(both):
    rng = random.Random(2)
    pool = [" ", "  ", "\n", "\t", "a", "'s", "12", "é", "日", " ", "　", "\U0001f642", "\x00", "\r\n", "<|endoftext|>", "ſ", "\x85", "Wort", "ñ"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 30))) for _ in range(3_000)] + ["ab" * 60_000, " " * 120_000 + "x"]
    plain = bpe.ByteBpe.of(open(A, encoding="utf-8").read())
    own = Tokenizer.from_file(A)
    assert plain.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in own.encode_batch(texts, add_special_tokens=False)]
    slow = Tokenizer.from_file(A)
    slow.encode_special_tokens = True
    assert [both.a.ids(" " + t) for t in texts] == [e.ids for e in slow.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_links_groups_and_counts(spark, both):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").orderBy("doc_id").limit(40).collect()]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(3, ODD[2]), (3, ODD[2]), (None, ODD[3])]
    want = brute([t for _, t in rows])
    table = spark.createDataFrame([(i, t, "n_a", 1.0) for i, t in rows], "doc_id long, text string, pairs string, n_best double")
    counts = collections.Counter((a[i], b[j]) for a, b, _, links in want for i, j in links)
    top = collections.defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    expect = []
    for (doc, _), (a, b, groups, links) in zip(rows, want):
        own = [(a[i], b[j]) for i, j in links]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        expect.append((doc, len(a), len(b), len(groups), len(own), sum(counts[p] == top[p[1]] for p in own), sum(counts[p] for p in own), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    got = [tuple(r) for r in alignment.link_statistics(table.repartition(3), A, B).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(expect, key=key)
    assert len(counts) <= both.pair_bound()


def test_full_output_of_all_kinds(spark):
    rows = [(i, t) for i, t in enumerate(ODD) if len(t or "") < 1000] + [(50, "unbelievable antidisestablishmentarianism ñandú " * 3)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = dict(zip((i for i, _ in rows), brute([t for _, t in rows])))
    got = {kind: {r["doc_id"]: r for r in alignment.align_tokens(table, A, B, links=kind).collect()} for kind in ("end", "overlap", "group")}
    for doc, (a, b, groups, links) in want.items():
        r = got["end"][doc]
        assert (r["a_ids"], r["b_ids"]) == (list(a), list(b)) and list(zip(r["link_a"], r["link_b"])) == links
        assert [([i for i, k in zip(a, r["a_groups"]) if k == g], [i for i, k in zip(b, r["b_groups"]) if k == g]) for g in range(len(groups))] == groups
        inside = got["group"][doc]
        assert set(zip(inside["link_a"], inside["link_b"])) == {(i, j) for i, g in enumerate(r["a_groups"]) for j, h in enumerate(r["b_groups"]) if g == h}
        over = set(zip(got["overlap"][doc]["link_a"], got["overlap"][doc]["link_b"]))
        assert set(links) <= over <= set(zip(inside["link_a"], inside["link_b"]))
    assert alignment.align_tokens(table.limit(0), A, B).count() == 0 and alignment.link_statistics(table.limit(0), A, B).count() == 0
