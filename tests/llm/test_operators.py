"""The training-text operators against brute force, on edge cases and on the smallest tables."""

import collections
import hashlib
import html as htmllib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.llm import lines, mincut, packing, pieces, pivots, probminhash, queries, suffixes, toxicity, warc, winnowing

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000


def docs_of(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + extra)


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls, empties, a very long text, ties and repeated rows, with columns whose names clash."""
    texts = [None, "", "same text of five words or more", "same text of five words or more", LONG, "a\n\nb", "ß   \U0001f600 x"]
    rows = [(i, t, "x", 1.5) for i, t in enumerate(texts)] + [(3, texts[3], "x", 1.5), (None, "no id", None, None)]
    return docs_of(spark, rows, ", score string, kept double")


# toxicity

def brute_marginals(scores, step):
    total, post = 0.0, np.zeros(len(scores))
    for states in itertools.product((0, 1), repeat=len(scores)):
        w = np.exp(sum(s * y for s, y in zip(scores, states)) + sum(step[a, b] for a, b in zip(states, states[1:])))
        total += w
        post += w * np.array(states)
    return post / total, np.log(total)


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    step, sizes = rng.normal(size=(2, 2)), np.array([3, 1, 6, 4])
    scores = rng.normal(size=sizes.sum()) * 2
    post, logs, _ = toxicity.marginals(scores, sizes, step)
    at = 0
    for size, got in zip(sizes, logs):
        want, z = brute_marginals(scores[at:at + size], step)
        assert np.allclose(post[at:at + size], want) and np.isclose(got, z)
        at += size


def test_toxic_spans_and_edges(spark, odd_docs):
    rng = random.Random(3)
    clean = lambda: [rng.choice("the and river stone green walks over home light".split()) for _ in range(12)]
    rows = []
    for i in range(200):
        words = clean()
        if i % 4 == 0:
            words[rng.randrange(12)] = "wretch"
        rows.append((" ".join(words), int(i % 4 == 0)))
    field = toxicity.fit_field(rows)
    (hot, spans), (cold, none) = field.tag(["the green wretch walks", "the green stone walks"], 0.5)
    assert hot > 0.7 and spans == [(10, 16)] and cold < 0.3 and none == []
    out = toxicity.score_documents(odd_docs, field)
    got = out.collect()
    assert len(got) == 9 and all(0 <= r["score"] <= 1 for r in got) and dict(out.dtypes)["score"] == "double"
    assert toxicity.score_documents(odd_docs.limit(0), field).count() == 0
    assert toxicity.fit_field([]).tag([""], 0.5)[0][1] == []


def test_toxicity_query_learns(spark):
    out = queries.QUERIES["op1_toxicity"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert out[out.toxic == 1].predicted.mean() > 0.8 and out[out.toxic == 0].predicted.mean() < 0.05
    assert (out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4) == 2).all()


# pieces

@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return pieces.Pieces(pieces.read_model(public_tokenizers.path("piece_bpe_32k.model")))


def test_viterbi_is_optimal(vocabulary):
    score = dict((p, s) for p, (_, _, s) in vocabulary.automaton.items())

    def best(text):
        top = [0.0] + [-np.inf] * len(text)
        for j in range(1, len(text) + 1):
            for i in range(j):
                s = score.get(text[i:j], vocabulary.floor if j == i + 1 else -np.inf)
                top[j] = max(top[j], top[i] + s)
        return top[-1]

    ids = {i: s for _, (_, i, s) in vocabulary.automaton.items()}
    for text in ("hest, of the", "ariear enestion.", "  two  spaces\n\nlines", "überhaupt ça"):
        got = vocabulary.encode(text).tolist()
        known = [i for i in got if i in ids]
        if len(known) == len(got):
            assert np.isclose(sum(ids[i] for i in got), best(vocabulary.normalise(text)))
        assert vocabulary.decode(got) == text


def test_pieces_edges(spark, odd_docs, vocabulary):
    out = queries.QUERIES["op2_pieces"](spark, SF).agg(F.count("*").alias("n"), F.sum(F.col("round_trip").cast("int")).alias("r")).first()
    assert out["n"] == out["r"] == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = pieces.pieces_report(odd_docs).collect()
    assert len(rows) == 9 and all(r["round_trip"] for r in rows)
    assert vocabulary.encode("日\U0001f600").tolist() and vocabulary.decode(vocabulary.encode("日\U0001f600").tolist()) == "日\U0001f600"
    assert pieces.pieces_report(odd_docs.limit(0)).count() == 0


def test_ids_are_those_of_the_library():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    ours, library = pieces.Pieces.of(pieces.read_model(path)), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t or "" for t, in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id LIMIT 300").fetchall()]
    rng = random.Random(11)
    texts += ["", " ", "   ", "a  b\n\n c\t", "aaaa" * 500, "日😀 ß", LONG[:5000], "esored", "▁ x▁▁y"]
    texts += ["".join(rng.choice("aeinrst \né▁日") for _ in range(rng.randrange(40))) for _ in range(2000)]
    for text in texts:
        assert ours.encode(text).tolist() == library.encode(text)


def test_stretches_in_use_outlive_a_full_cache(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(pieces, "CACHE", 3)
    own = pieces.Merges(pieces.read_model(public_tokenizers.path("piece_bpe_32k.model")))
    plain, seen = own.segment, []
    own.segment = lambda word: seen.append(word) or plain(word)
    for text in ("the cat and dogs run", "the x1 x2 x3 x4", "the y1 y2 y3 y4"):
        own.encode(text)
    assert seen.count("▁the") == 1


# WARC

def test_warc_matches_sql_and_index(spark):
    same = "<p>" + "x" * 120 + "</p>"
    rows = [(9, "http://www.a.org/1", same), (4, "http://a.org/2?q=1", same), (5, None, same), (6, "b", "short"), (7, "b", "short"), (8, "http://c.d\nx/", None), (10, "é", "é" * 60), (11, "z", "é" * 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_bytes", F.lit("clash"))
    got = {r["page_id"]: r for r in warc.archive_report(pages).collect()}
    assert {i: r["refers_to"] for i, r in got.items()} == {9: 4, 4: None, 5: 4, 6: None, 7: None, 8: None, 10: None, 11: 10}
    assert all(got[i]["payload_digest"] == hashlib.sha256((h or "").encode()).hexdigest() and got[i]["payload_bytes"] == len((h or "").encode()) for i, _, h in rows)
    assert got[9]["record_type"] == "revisit" and got[8]["record_type"] == "response"
    archives = warc.write_archives(pages)
    index = warc.build_index(spark, archives)
    wanted = spark.createDataFrame([(warc.url_key("https://A.org/2?q=1"), 4), ("nowhere", 4)], "key string, page_id long")
    read = warc.range_read(spark, archives, warc.look_up(spark, index, wanted)).collect()
    assert len(read) == 1 and bytes(read[0]["payload"]).decode() == same and read[0]["headers"]["WARC-Type"] == "response"
    assert warc.archive_report(pages.limit(0)).count() == 0
    assert warc.url_key("http://www.Example.com:80/a b") == "com,example:80)/a%20b"


def test_candidate_blocks():
    first, last = ["a", "c", "c", "f"], ["c", "c", "d", "g"]
    for key in "abcdefgh":
        assert list(warc.candidate_blocks(first, last, key)) == [i for i in range(4) if first[i] <= key <= last[i]]


# vectors

def brute_vectors(rows, least=0.93):
    def unit(v):
        if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        return np.array(v, float) / np.linalg.norm(np.array(v, float))
    units = {i: (unit(v), label) for i, v, label in rows}
    links = {(a, b) for a, b in itertools.permutations(units, 2) if units[a][1] is not None and units[a][1] == units[b][1] and units[a][0] is not None and units[b][0] is not None and len(units[a][0]) == len(units[b][0]) and units[a][0] @ units[b][0] >= least}
    part = {i: i for i in units}
    for _ in units:
        for a, b in links:
            part[a] = part[b] = min(part[a], part[b])
    return {i: (sum(a == i for a, _ in links), part[i]) for i in units}


def test_vector_links_recall(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(40):
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 12)):
            rows.append((len(rows), (centre + 0.12 * rng.normal(size=16)).astype(np.float32).tolist(), int(c % 3)))
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(60)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [float("nan")] * 16, 1), (2004, rows[1][1], None), (2005, [1.0, 0.0], 1), (2006, [2.0, 0.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("clash"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pivots.near_vectors(table, block=16, pivots=32).collect()}
    want = brute_vectors(rows)
    assert got.keys() == want.keys() and all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.97 * len(want)
    assert got[2005] == (1, 2005) and got[2006] == (1, 2005) and got[2002] == (0, 2002)
    assert pivots.near_vectors(table.limit(0)).count() == 0
    twice = pivots.near_vectors(table.unionAll(table.where("vec_id < 5")), pivots=32).where("vec_id = 0").collect()
    assert len(twice) == 2 and twice[0] == twice[1]


# near duplicates, substrings, packing, lines

def test_near_duplicates_edges(spark, odd_docs):
    rng = random.Random(2)
    words = [f"w{rng.randrange(9999)}" for _ in range(300)]
    near = words[:150] + ["changed"] + words[151:]
    other = [f"v{rng.randrange(9999)}" for _ in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(other)), (4, " ".join(words)), (5, None), (6, "")]
    got = {r["doc_id"]: r["class_id"] for r in probminhash.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 5}
    assert probminhash.near_duplicates(odd_docs).count() == 9 and probminhash.near_duplicates(odd_docs.limit(0)).count() == 0


def brute_substrings(texts, length):
    raw = [t.encode() for t in texts]
    starts = collections.Counter(r[i:i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if starts[r[i:i + length]] > 1:
                gone[i:i + length] = True
        out.append(bytes(np.frombuffer(r, np.uint8)[~gone]))
    return out


def test_substrings_brute(spark, odd_docs):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    shared, rows = [text(60), text(45)], []
    for i in range(25):
        rows.append((i, text(rng.randrange(80)) + rng.choice(shared) + text(rng.randrange(30)) + (rng.choice(shared)[5:] if i % 3 else "") + "ab" * (40 if i % 7 == 0 else 0)))
    want = brute_substrings([t for _, t in rows], 40)
    for hot in (20_000, 3):
        got = {r["doc_id"]: bytes(r["kept"]) for r in suffixes.drop_repeated_substrings(docs_of(spark, rows), length=40, hot=hot).collect()}
        assert [got[i] for i, _ in rows] == want
    assert suffixes.drop_repeated_substrings(odd_docs).count() == 9 and suffixes.drop_repeated_substrings(odd_docs.limit(0)).count() == 0


def test_substrings_without_shuffled_texts(spark, monkeypatch):
    """Documents are not dealt by id to find repeats; a filter that lets everything pass changes nothing; rows that repeat an id find each other."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    common = text(60)
    rows = [(i, text(rng.randrange(90)) + (common if i % 2 else "") + text(rng.randrange(90))) for i in range(20)]
    rows += rows[:7]
    want = brute_substrings([t for _, t in rows], 40)
    docs = docs_of(spark, rows + [(None, common)]).repartition(3)
    for bits, hot in ((1 << 28, 20_000), (1 << 9, 20_000), (1 << 9, 3)):
        monkeypatch.setattr(suffixes, "MOST_BITS", bits)
        got = [(r["doc_id"], bytes(r["kept"])) for r in suffixes.drop_repeated_substrings(docs, length=40, hot=hot).collect()]
        assert sorted(x for x in got if x[0] is not None) == sorted((i, w) for (i, _), w in zip(rows, want))
        assert [x for x in got if x[0] is None] == [(None, common.encode())]
    plan = suffixes.repeated_stretches(docs_of(spark, rows).selectExpr("doc_id AS id", "text"), 40, 20_000)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" not in plan and "hashpartitioning(part" in plan


def test_packing_is_whole(spark, odd_docs):
    import public_tokenizers

    out = packing.pack_documents(odd_docs, public_tokenizers.path("byte_bpe_50k.json")).toPandas()
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length).tolist()[:-1]] and g.length.sum() <= 1024
    assert packing.pack_documents(odd_docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("counts", [{600: 3, 424: 2, 300: 5, 100: 7}, {1024: 2, 1: 9, 1023: 4, 512: 3}])
def test_dominance_keeps_every_piece(counts):
    fixed, left = packing.reduce_dominant(dict(counts), 1024)
    done = collections.Counter()
    for sizes, n in fixed + packing.best_fit(left, 1024):
        assert sum(sizes) <= 1024
        for s in sizes:
            done[s] += n
    assert done == counts


def fewest_bins(sizes, capacity):
    """Exact, by branch and bound over the bins that the next largest piece may go to."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def deal(i, rooms):
        if len(rooms) >= best[0] and i < len(sizes) or len(rooms) > best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for room in sorted({r for r in rooms if r >= sizes[i]}):
            at = rooms.index(room)
            deal(i + 1, rooms[:at] + (room - sizes[i],) + rooms[at + 1:])
        deal(i + 1, rooms + (capacity - sizes[i],))

    deal(0, ())
    return best[0]


def test_reduction_keeps_the_optimum():
    rng, triples = random.Random(9), 0
    for _ in range(1500):
        capacity = rng.randrange(10, 60)
        sizes = [rng.randrange(1, capacity + 1) if rng.random() < 0.5 else rng.randrange(1, capacity // 3 + 1) for _ in range(rng.randrange(1, 11))]
        fixed, left = packing.reduce_dominant(dict(collections.Counter(sizes)), capacity)
        rest = [s for s, n in left.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + (fewest_bins(rest, capacity) if rest else 0) == fewest_bins(sizes, capacity), (capacity, sizes)
        triples += any(len(p) == 3 for p, _ in fixed)
    assert triples


def test_reduction_is_no_worse_than_best_fit():
    bins = lambda patterns: sum(n for _, n in patterns)
    assert bins(packing.plan({900: 1000, 462: 2000, 100: 1000, 40: 3000}, 1024)) == 2000
    rng = random.Random(10)
    for _ in range(200):
        counts = {rng.randrange(1, 1025): rng.randrange(1, 500) for _ in range(rng.randrange(1, 30))}
        got = packing.plan(counts, 1024)
        assert bins(got) <= bins(packing.best_fit(counts, 1024)) and all(sum(p) <= 1024 for p, _ in got)
        done = collections.Counter()
        for p, n in got:
            for s in p:
                done[s] += n
        assert done == counts


def test_line_edges(spark, odd_docs):
    line = "A line of twenty characters and more"
    rows = [(1, line + "\nown"), (2, f" {line.upper()}\t"), (3, f"x\n{line}\n{line}"), (4, "short\nshort"), (5, None)]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in lines.drop_repeated_lines(docs_of(spark, rows)).collect()}
    assert got == {1: ("own", 2, 1), 2: ("", 1, 1), 3: (f"x\n{line}\n{line}", 3, 0), 4: ("short\nshort", 2, 0), 5: ("", 1, 0)}
    assert lines.drop_repeated_lines(odd_docs).count() == 9 and lines.drop_repeated_lines(odd_docs.limit(0)).count() == 0


# fingerprints

def brute_winnow(text, size, window):
    h = winnowing.gram_hashes(text, size).tolist()
    window = min(window, len(h))
    return sorted({max((p for p in range(i, i + window) if h[p] == min(h[i:i + window]))) for i in range(len(h) - window + 1)}) if h else []


def test_winnow_brute():
    rng = random.Random(6)
    for n in (0, 1, 5, 6, 30, 200):
        text = "".join(rng.choice("ab") for _ in range(n))
        for size, window in ((5, 7), (3, 8), (4, 1)):
            assert winnowing.winnow(text, size, window)[1].tolist() == brute_winnow(text, size, window)


def test_winnow_guarantee():
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common = text(winnowing.SIZE + winnowing.WINDOW - 1)
    a, b = (set(winnowing.winnow(text(300) + common + text(200))[0].tolist()) for _ in range(2))
    assert a & b


def test_neighbours_brute(spark, odd_docs):
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = {r["doc_id"]: r for r in winnowing.neighbour_likeness(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert len(got) == len(rows)
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        own, new, then = (np.unique(winnowing.winnow(t)[0]) for t in (text, edited, after))
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == winnowing.as_text(own) and np.isclose(r["near_edited"], winnowing.likeness(own, new)) and np.isclose(r["near_next"], winnowing.likeness(own, then))
    assert winnowing.neighbour_likeness(odd_docs).count() == 9 and winnowing.neighbour_likeness(odd_docs.limit(0)).count() == 0
    assert winnowing.neighbour_likeness(docs_of(spark, [(1, "abc")])).first()["near_next"] == 1.0
    assert winnowing.fingerprints(odd_docs).count() == 9


def test_short_edited_texts_are_seen():
    texts = [t or "" for t, in duckdb.sql("SELECT text FROM '/root/testdata/sf0.1/documents.parquet' ORDER BY doc_id").fetchall()]
    grams = lambda t, window: np.unique(winnowing.winnow(t, winnowing.SIZE, window)[0])
    off = []
    for text, after in zip(texts, texts[1:] + texts[:1]):
        if 20 <= len(text) <= 165:
            edited = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
            got, whole = (winnowing.likeness(grams(text, w), grams(edited, w)) for w in (winnowing.WINDOW, 1))
            assert got > 0 or len(text) < 30
            off.append((len(text), got, abs(got - whole)))
    assert len(off) > 200 and np.mean([x[1] == 0 for x in off]) < 0.1 and np.mean([x[2] for x in off]) < 0.07


# main text

def test_cut_is_minimal():
    rng = np.random.default_rng(8)
    for _ in range(40):
        n = int(rng.integers(1, 8))
        odds = rng.normal(size=n).tolist()
        edges = [(a, b, float(rng.random())) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        cost = lambda side: sum(max(x, 0) if not s else max(-x, 0) for x, s in zip(odds, side)) + sum(w for a, b, w in edges if side[a] != side[b])
        least = min(cost(s) for s in itertools.product((False, True), repeat=n))
        assert np.isclose(cost(mincut.source_side(n, odds, edges)), least)


def test_main_text():
    page = """<html><head><title>T</title><script>x</p></script></head><body><header>Site</header><nav><ul><li><a href=x>Home</a></ul></nav>
    <div class="cookie-notice">We use cookies. Accept.</div><article><h1>A &amp; B</h1><p>First   line<br>goes <b>on</b>.<p>Second &lt;one&gt;.<form>Search<input></form></article>
    <section id="comments"><p>Reader says a lot. Really a lot of words here.</p></section><aside>Also read</aside><footer>&copy; me</footer></body></html>"""
    assert mincut.main_text(page) == "A & B\nFirst line goes on.\nSecond <one>."
    assert mincut.main_text("") == "" and mincut.main_text("<p>" * 3000) == ""
    assert mincut.main_text("<article><p>" + "Word here. " * 20_000).count("Word") == 20_000


@pytest.mark.parametrize("name", ["wrapper with-sidebar", "no-footer", "layout-has-nav", "sidebar", "page header"])
@pytest.mark.parametrize("element", ["article", "main"])
def test_names_do_not_lose_the_article(name, element):
    body = f"<{element}><div class='article-header'><h1>Headline</h1></div><p>First line goes on.</p><div class='comments'><p>Reader says.</p></div></{element}>"
    page = f"<html><body><div class='{name}'>{body}<form><p>Search. Here. Now. And more.</p></form></div></body></html>"
    assert mincut.main_text(page) == "Headline\nFirst line goes on."


def test_names_without_article():
    text = "This is a sentence of some length, and it goes on for a while. " * 5
    for name in ("with-sidebar", "no-footer", "sidebar"):
        assert mincut.main_text(f"<body><div class='wrapper {name}'><p>{text}</p><p>{text}</p></div>") == f"{text.strip()}\n{text.strip()}"
    assert mincut.main_text("<body><div class='sidebar'><p>Also read this. And this.</p></div>") == ""
    assert mincut.main_text("<body><div id='comments'><article class='comment'><p>I say so. Yes.</p></article></div>") == ""
    assert mincut.main_text("<body><aside><article><p>An advertisement. Buy it. Now. Here.</p></article></aside>") == ""


@pytest.mark.parametrize("head", ["<head><title>T</title>", "<head><meta charset=x><title>T</title><style>a{}</style><noscript><p>N. N. N.</p></noscript>", "<head><head><title>T</title></head>"])
@pytest.mark.parametrize("body", ["<body>", "", "<svg><title>S</title></svg>"])
def test_head_ends_by_itself(head, body):
    assert mincut.main_text(f"<!doctype html><html>{head}{body}<article><h1>A</h1><p>Text here. More.</p></article></html>") == "A\nText here. More."
    assert mincut.main_text("<head><title>T</title>Plain text of the page. It goes on. And on.") == "Plain text of the page. It goes on. And on."


def test_main_text_of_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in queries.QUERIES["op9_main_text"](spark, SF).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)
        blocks = [re.sub(r"\s+", " ", htmllib.unescape(re.sub(r"</?b>|<br>", " " if "<br>" in b else "", b))).strip() for b in re.split(r"</?(?:p|h1)>", body[1])] if body else []
        assert re.sub(r"\s+", " ", got[r["page_id"]]) == re.sub(r"\s+", " ", "\n".join(b for b in blocks if b))
    odd = spark.createDataFrame([(1, "u", None, "c"), (1, "u", None, "c"), (None, None, "", "c")], "page_id long, url string, html string, text string")
    assert [r["n_chars"] for r in mincut.extract_text(odd).collect()] == [0, 0, 0] and mincut.extract_text(odd.limit(0)).count() == 0


# queries and pipeline

@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(queries.SQL[name])
    cols = list(want.columns)
    got = sorted((tuple(r) for r in queries.QUERIES[name](spark, SF).select(*cols).collect()), key=repr)
    assert got == sorted(want.fetchall(), key=repr)


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    out = pipeline.run(spark, SF)
    assert out.count() > 0 and pipeline.STAGES[0][0] == "toxicity"
    for name, stage in pipeline.STAGES[1:-1]:
        assert stage(spark, docs.limit(0), SF).columns == columns
        got = stage(spark, docs, SF)
        assert got.columns == columns and 0 < got.count() <= docs.count()
