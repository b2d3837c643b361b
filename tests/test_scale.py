"""Work that must not be repeated or grow with the batch: scans, stored tables, pieces of long vectors."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from fieldweave.operators import association as A, kinship as K, mixed_models as B, mixed_scan as M
from fieldweave.operators.crossproducts import PIECE_ROWS, pieces
from fieldweave.plans import roles as R, vectors as V
from fieldweave.plans.registry import Tables


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_marker_tests_find_their_maximum_in_few_evaluations(monkeypatch):
    """The refined variance ratio is at the likelihood's maximum, and takes a few passes over markers x samples, not 24."""
    rng = np.random.RandomState(3)
    n, m = 70, 150
    g = rng.binomial(2, 0.3, size=(200, n)).astype(float)
    k = np.cov(g.T)
    w = np.column_stack([np.ones(n), rng.normal(size=(n, 2))])
    y = np.column_stack([np.linalg.cholesky(k + 1e-6 * np.eye(n)) @ rng.normal(size=n) * a + rng.normal(size=n) for a in (0.0, 1.0, 4.0)])
    basis = M.make_basis(k, y, w)
    x = rng.binomial(2, 0.3, size=(m, n)).astype(float) @ basis.u
    real, calls = M._profile, []
    monkeypatch.setattr(M, "_profile", lambda *a: calls.append(1) or real(*a))
    for t in range(3):
        del calls[:]
        beta, se, p = M.score(basis, x, t)
        assert len(calls) <= 4  # three more where some ratio is at an end of its range
        lams = np.exp(np.linspace(np.log(M.GRID[0]), np.log(M.GRID[-1]), 1601))
        dense = np.stack([real(np.full(m, lam), basis.d, basis.w, basis.y[:, t], x)[0] for lam in lams])
        best = lams[dense.argmax(0)]
        assert M.chi2_1_upper(2 * (dense.max(0) - basis.null_ll[t])) == pytest.approx(p, rel=2e-2, abs=2e-3)
        _, rxx, rxy, _ = real(best, basis.d, basis.w, basis.y[:, t], x)
        assert beta == pytest.approx(rxy / rxx, rel=2e-2, abs=2e-3)


def test_pieces_cut_batches():
    batch = pa.RecordBatch.from_arrays([pa.array(range(2 * PIECE_ROWS + 1))], names=["a"])
    got = list(pieces([batch, batch.slice(0, 0)]))
    assert [b.num_rows for b in got] == [PIECE_ROWS, PIECE_ROWS, 1]
    assert [v for b in got for v in b.column(0).to_pylist()] == list(range(2 * PIECE_ROWS + 1))


def test_marker_effects_work_on_pieces(spark, monkeypatch):
    """A task never masks and multiplies more than a piece of its batch."""
    rng = np.random.RandomState(4)
    g = rng.binomial(2, 0.4, size=(2500, 12)).astype(float)
    v = spark.createDataFrame(pd.DataFrame({"marker": [f"m{i}" for i in range(2500)], "chrom": 1, "pos": np.arange(2500), "dosage": list(g)})).coalesce(1)
    real = A._moments

    def checked(x, y):
        if len(x) > PIECE_ROWS:
            raise ValueError("whole batch at once")
        return real(x, y)

    monkeypatch.setattr(A, "_moments", checked)
    y = rng.normal(size=(12, 2))
    got = A.marker_trait_effects(v, y, ["a", "b"]).toPandas().set_index(["trait", "marker"])
    assert len(got) == 5000
    for j in (0, 1023, 1024, 2499):
        assert got.loc[("b", f"m{j}"), "effect"] == pytest.approx(np.polyfit(g[j], y[:, 1], 1)[0])


@pytest.fixture()
def small_tables(spark, tmp_path):
    rng = np.random.RandomState(5)
    customer = pd.DataFrame({"c_custkey": range(60), "c_nationkey": np.arange(60) % 6, "c_mktsegment": np.where(np.arange(60) % 2, "A", "B")})
    orders = pd.DataFrame({"o_orderkey": range(300), "o_custkey": rng.randint(0, 60, 300)})
    lines = pd.DataFrame({
        "l_orderkey": rng.randint(0, 300, 2000), "l_partkey": rng.randint(0, 20, 2000), "l_returnflag": rng.choice(["A", "N", "R"], 2000),
        "l_extendedprice": rng.normal(100, 9, 2000), "l_discount": rng.random(2000), "l_tax": rng.random(2000), "l_quantity": rng.randint(1, 50, 2000).astype(float),
    })
    for name, table in (("customer", customer), ("orders", orders), ("lineitem", lines)):
        spark.createDataFrame(table).write.parquet(str(tmp_path / f"{name}.parquet"))
    return Tables(spark, str(tmp_path)), customer, orders, lines


def test_lines_are_joined_last(small_tables):
    t, customer, orders, lines = small_tables
    got = R._lines(t, "l_partkey")
    plan = plan_of(got).splitlines()
    depth = lambda column: next(len(x) - len(x.lstrip(" :+-")) for x in plan if "Relation" in x and column in x)
    assert depth("l_orderkey") < depth("o_custkey")
    want = lines.merge(orders, left_on="l_orderkey", right_on="o_orderkey").merge(customer, left_on="o_custkey", right_on="c_custkey")
    want["sample"] = "L" + want["c_nationkey"].astype(str) + "_" + want["c_mktsegment"]
    assert sorted(map(tuple, got.collect())) == sorted(want[["sample", "l_partkey"]].itertuples(index=False, name=None))


def test_oriented_component_reads_its_tables_once(small_tables):
    t, *_ = small_tables
    got = V.oriented_pc1(t)
    assert "Relation" not in plan_of(got)
    assert got.count() == 6


def test_model_plots_are_stored(spark):
    """Winsorizing and scaling are not repeated by every step of a model."""
    rng = np.random.RandomState(6)
    pdf = pd.DataFrame({"environment": rng.choice(["a", "b"], 600), "genotype": rng.choice([f"g{i}" for i in range(20)], 600), "plot": rng.randint(0, 40, 600), "y": rng.normal(size=600), "area": rng.random(600)})
    plots, names = B.model_plots(spark.createDataFrame(pdf), ["y"], ["environment", "genotype", "plot"], area="area")
    assert names == ["area_scaled"] and "Join" not in plan_of(plots) and "Aggregate" not in plan_of(plots)


def test_long_and_short_vectors_sum_alike(spark, monkeypatch):
    from fieldweave.operators import reml

    rng = np.random.RandomState(7)
    pdf = pd.DataFrame({"environment": rng.choice(["a", "b"], 500), "genotype": rng.choice([f"g{i}" for i in range(15)], 500), "row": rng.randint(0, 4, 500), "x": rng.normal(size=500)})
    pdf["y"] = pdf["x"] + pdf["row"] + rng.normal(size=500)
    pdf.loc[pdf["environment"] == "b", "row"] %= 2
    df = spark.createDataFrame(pdf)
    fit = lambda: B.variance_components(df, ["y"], covariates=["x"], factors=["row"], env="environment").toPandas().sort_values(["environment", "source"])["vcov"].to_numpy()
    plain = fit()
    monkeypatch.setattr(reml, "PLAIN_COLUMNS", 0)
    monkeypatch.setattr(reml, "SHORT_ROWS", 0)
    assert fit() == pytest.approx(plain, rel=1e-9)


def test_short_stretches_merge_as_long_ones():
    """Both ways of merging give the ids of the same merges, unknown characters and ties included."""
    import random

    import public_tokenizers
    from fieldweave.llm import pieces as P

    model = P.Pieces.of(P.read_model(public_tokenizers.path("piece_bpe_32k.model")))
    draw = random.Random(8)
    for _ in range(2000):
        text = "".join(draw.choice("aaeenrstthé漢😀\n▁12N") for _ in range(draw.randint(0, P.SHORT)))
        assert model.short(text) == model.long(text) == model.segment(text)


def test_forests_fit_on_few_partitions(spark, monkeypatch):
    """Every level of a forest sends all its nodes from each partition, so what a shuffle or a scan cut small is put together."""
    from fieldweave.operators import prediction as P

    rng = np.random.RandomState(15)
    x = rng.normal(size=(240, 2))
    df = spark.createDataFrame(pd.DataFrame({"features": x.tolist(), "y": x[:, 0], "g": [f"g{i % 24}" for i in range(240)]})).repartition(40)
    real, parts = P.RandomForestRegressor.fit, []
    monkeypatch.setattr(P.RandomForestRegressor, "fit", lambda self, rows, *a: parts.append((rows.rdd.getNumPartitions(), rows.count())) or real(self, rows, *a))
    grid = {"numTrees": [3], "maxDepth": [2, 3]}
    run = lambda: P.forest_cross_validation(df, "features", "y", "g", outer=2, inner=2, tries=2, grid=grid)[0]
    assert run().count() == 240
    assert sorted(parts) == [(1, 60)] * 8 + [(1, 120)] * 2  # two folds, each with two settings on two inner folds and a last fit
    del parts[:]
    monkeypatch.setattr(P, "ROWS_PER_PART", 50)
    assert run().count() == 240 and {n for n, _ in parts} == {3}
    monkeypatch.setattr(P, "ROWS_PER_PART", 1)
    assert P.few_parts(df, 240).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
