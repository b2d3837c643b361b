"""What a task holds and what is shuffled: suffixes sent in bounded runs, texts that lose nothing stay where they are."""

import numpy as np
import pyarrow as pa

from fieldweave.llm import common as C, lines as L, suffixes as S


def test_suffix_runs_are_sent_in_pieces():
    """8 MB of text are some 28 MB of suffixes, which no worker holds at once."""
    rng = np.random.RandomState(4)
    texts = [bytes(rng.randint(97, 123, 200_000, np.uint8)).decode() for _ in range(40)]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(40), pa.int64()), "text": texts})
    rows = list(S.suffix_runs(iter([batch]), 1, 200, lambda h: np.ones(len(h), bool)))
    sizes = [len(r.column("sizes")[0].as_py()) // 2 for r in rows]
    assert len(rows) > 1 and max(sizes) < 0.8 * sum(sizes)
    starts = np.concatenate([np.frombuffer(r.column("starts")[0].as_py(), np.int64) for r in rows])
    assert len(starts) == sum(len(S.anchors(np.frombuffer(t.encode(), np.uint8), 200)[0]) for t in texts)


def test_only_texts_that_lose_lines_are_shuffled(spark, monkeypatch):
    line = "a line that several documents share"
    rows = [(i, f"{line}\nown {i}") for i in range(4)] + [(i, f"a text of its own, number {i}") for i in range(4, 40)]
    rows += [(None, f"{line}\nwithout an id"), (50, None), (1, f"{line}\nown 1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    real, sent = L.split_by_ids, []
    monkeypatch.setattr(L, "split_by_ids", lambda *a: sent.append(real(*a)) or sent[-1])
    got = sorted((r["doc_id"] is None, r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in L.drop_repeated_lines(docs).collect() if r["doc_id"] is not None)
    want = [(i, f"own {i}", 2, 1) for i in (0, 1, 1, 2)] + [(3, f"{line}\nown 3", 2, 0)] + [(i, t, 1, 0) for i, t in rows[4:40]] + [(50, "", 1, 0)]
    assert [g[1:] for g in got] == want
    some, others = sent[0]
    assert some.count() < 10 and some.count() + others.count() == len(rows)


def test_a_task_needs_one_python_worker(spark):
    """A second Python step in a task takes a second worker, which then stays in memory and takes turns with the first."""
    rows = [(i, f"a line that several documents share\nown {i}\n{'the same long passage of text ' * 10}") for i in range(4)] + [(None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for out in (L.drop_repeated_lines(docs), S.drop_repeated_substrings(docs)):
        plan = out._jdf.queryExecution().executedPlan().toString().split("AdaptiveSparkPlan")[1]
        assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan
    found = C.rows_with_ids(docs, spark.createDataFrame([(1,), (1,), (9,), (None,)], "doc_id long"), "doc_id")
    assert found.collect() == docs.where("doc_id = 1").collect()
    assert "InArrow" not in found._jdf.queryExecution().executedPlan().toString()


def test_texts_of_a_batch_are_taken_in_pieces(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(1000), pa.int64()), "text": ["ab" * 150] * 1000})
    real, sizes = S.texts, []
    monkeypatch.setattr(S, "texts", lambda b: sizes.append(b.num_rows) or real(b))
    assert len(list(S.wanted_runs(iter([batch]), 200, lambda h: np.ones(len(h), bool)))) == 1000
    assert sum(sizes) == 1000 and max(sizes) <= C.ROWS
