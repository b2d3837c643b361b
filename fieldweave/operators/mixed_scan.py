"""Mixed-model marker tests: likelihood-ratio scan of markers x traits, and one marker x many traits.

Model per marker: y = W a + x b + u + e with u ~ N(0, s2 * lambda * K), tested by the ML likelihood
ratio with one degree of freedom (Zhou & Stephens 2012). In the eigenbasis of K the covariance is
diagonal, so a batch of markers is scored with matrix products. The eigenbases, samples x samples
per chromosome and hence bounded by the sample limit, travel as one broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.pvalues import chi2_1_upper
from .crossproducts import array_matrix, pieces
from .kinship import components_of, kinship_from_products, loco_products, mean_imputed

GRID = np.logspace(-5, 5, 41)
STEPS, REACH = 4, 6  # nodes to a step of the grid; nodes on either side of a place that its value is read from
STEP = (np.log(GRID[1]) - np.log(GRID[0])) / STEPS
NODES = np.log(GRID[0]) + STEP * np.arange(-REACH, STEPS * (len(GRID) - 1) + REACH + 1)
SLOPE = np.linalg.inv(np.vander(np.arange(-REACH, REACH + 1.0)))[:-1] * np.arange(2 * REACH, 0, -1)[:, None]
GOLD = (np.sqrt(5.0) - 1) / 2
BROADCAST_LIMIT = 4 << 30


@dataclass
class Basis:
    """Eigenvalues, rotation and rotated traits and covariates of one chromosome."""

    d: np.ndarray
    u: np.ndarray | None
    y: np.ndarray  # n x traits
    w: np.ndarray  # n x covariates
    null_lambda: np.ndarray
    null_ll: np.ndarray


def _profile(lam: np.ndarray, d: np.ndarray, w: np.ndarray, y: np.ndarray, x: np.ndarray | None):
    """ML log-likelihood at one lambda per marker (or per trait when x is None).

    lam has m entries; returns (ll, rxx, rxy, rss), each of length m. With x None, y may have m
    columns, one per lambda.
    """
    n, c = w.shape
    v = 1.0 / (1.0 + lam[:, None] * d[None, :])  # m x n
    a = np.einsum("mn,ni,nj->mij", v, w, w, optimize=True)
    yy = y[None, :] if y.ndim == 1 else y.T
    wy = np.einsum("mn,ni->mi", v * yy, w)
    sol = np.linalg.solve(a, wy[..., None])[..., 0]
    ryy = (v * yy * yy).sum(1) - (wy * sol).sum(1)
    if x is None:
        rss, rxx, rxy = ryy, None, None
    else:
        vx = v * x
        wx = vx @ w
        solx = np.linalg.solve(a, wx[..., None])[..., 0]
        rxx = (vx * x).sum(1) - (wx * solx).sum(1)
        rxy = (vx * yy).sum(1) - (wx * sol).sum(1)
        ok = rxx > 1e-10 * np.maximum((vx * x).sum(1), 1e-300)
        rxx = np.where(ok, rxx, np.nan)
        rss = ryy - np.where(ok, rxy * rxy / rxx, 0.0)
    rss = np.maximum(rss, 1e-300)
    ll = -0.5 * n * np.log(rss / n) - 0.5 * np.log1p(lam[:, None] * d[None, :]).sum(1)
    return ll, rxx, rxy, rss


def at_nodes(basis: Basis) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, their rotated covariates, log-determinants) at every node: what no marker or trait enters.

    The covariates are turned so that their weighted products are the identity, which leaves squares to subtract.
    """
    scaled = np.exp(NODES)[:, None] * basis.d
    v = 1.0 / (1.0 + scaled)
    val, vec = np.linalg.eigh(np.einsum("kn,ni,nj->kij", v, basis.w, basis.w, optimize=True))
    root = vec * np.where(val > 1e-15 * val[:, -1:], 1.0 / np.sqrt(np.maximum(val, 1e-300)), 0.0)[:, None, :]
    return v, v[:, :, None] * (basis.w @ root), np.log1p(scaled).sum(1)


def spread_at_nodes(nodes: tuple, x: np.ndarray) -> np.ndarray:
    """Weighted squares of marker rows beyond the covariates at every node; no trait enters."""
    v, turned, _ = nodes
    out = (x * x) @ v.T
    for c in range(turned.shape[2]):
        out -= (x @ turned[:, :, c].T) ** 2
    return out


def _best_log_ratio(nodes: tuple, y: np.ndarray, x: np.ndarray, rxx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log variance ratio of the greatest likelihood of each marker row, within a step of its best grid value, and
    -1 or 1 where that is the lower or upper end of the range, else 0.

    Plain matrix products give the likelihood at every node. As a function of log lambda it is analytic, with no
    pole nearer than pi / 2, so the polynomial through the 13 nodes around the best one is the function to about
    1e-9, and its maximum costs no further products.
    """
    v, turned, logdet = nodes
    n, m = len(y), len(x)
    wy = np.einsum("knc,n->kc", turned, y)
    ryy = (v @ (y * y)) - (wy * wy).sum(1)
    rxy = x @ (v * y - np.einsum("knc,kc->kn", turned, wy)).T

    def ll(xx, xy, yy, logs):
        ok = xx > 1e-10
        rss = yy - np.where(ok, xy * xy / np.where(ok, xx, 1.0), 0.0)
        return -0.5 * n * np.log(np.maximum(rss, 1e-300) / n) - 0.5 * logs

    grid = slice(REACH, len(NODES) - REACH, STEPS)
    best = REACH + STEPS * ll(rxx[:, grid], rxy[:, grid], ryy[grid], logdet[grid]).argmax(1)
    first, last = REACH, len(NODES) - 1 - REACH
    low, high = np.maximum(best - STEPS, first), np.minimum(best + STEPS, last)
    width = 2 * (STEPS + REACH) + 1
    start = np.clip(best - STEPS - REACH, 0, len(NODES) - width)
    seen = start[:, None] + np.arange(width)
    around = ll(np.take_along_axis(rxx, seen, 1), np.take_along_axis(rxy, seen, 1), ryy[seen], logdet[seen])
    near = start + np.where((seen >= low[:, None]) & (seen <= high[:, None]), around, -np.inf).argmax(1)
    own = np.take_along_axis(around, (near - start)[:, None] + np.arange(-REACH, REACH + 1), 1)
    slope = (own - own[:, REACH:REACH + 1]) @ SLOPE.T  # coefficients of the derivative, highest power first
    bend = slope[:, :-1] * np.arange(2 * REACH - 1, 0, -1)
    a, b = np.maximum(low - near, -1).astype(float), np.minimum(high - near, 1).astype(float)
    at = (a + b) / 2
    for _ in range(30):
        f, g = _horner(slope, at), _horner(bend, at)
        a, b = np.where(f > 0, at, a), np.where(f > 0, b, at)
        with np.errstate(divide="ignore", invalid="ignore"):
            step = at - f / g
        at = np.where((step > a) & (step < b), step, (a + b) / 2)
    out = NODES[near] + STEP * at
    return out, (out >= NODES[last] - 1e-6).astype(int) - (out <= NODES[first] + 1e-6)


def _horner(c: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = c[:, 0].copy()
    for j in range(1, c.shape[1]):
        out *= x
        out += c[:, j]
    return out


def _bracket(fn, lo: np.ndarray, hi: np.ndarray, steps: int = 18) -> tuple[np.ndarray, np.ndarray]:
    """Vectorised golden-section search of the maximum of fn over log lambda: its last bracket."""
    a, b = lo.copy(), hi.copy()
    c, e = b - GOLD * (b - a), a + GOLD * (b - a)
    fc, fe = fn(c), fn(e)
    for _ in range(steps):
        left = fc >= fe
        b, a = np.where(left, e, b), np.where(left, a, c)
        c2, e2 = b - GOLD * (b - a), a + GOLD * (b - a)
        probe = np.where(left, c2, e2)
        f = fn(probe)
        fc, fe = np.where(left, f, fe), np.where(left, fc, f)
        c, e = c2, e2
    return a, b


def _closed(fn, a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Top of the parabola through a last bracket, kept between lo and hi."""
    mid = (a + b) / 2
    h = np.maximum((b - a) / 2, 1e-4)
    down, at, up = fn(mid - h), fn(mid), fn(mid + h)
    bend = down - 2 * at + up
    shift = np.where(bend < 0, 0.5 * h * (down - up) / np.where(bend < 0, bend, -1.0), 0.0)
    return np.clip(mid + np.clip(shift, -h, h), lo, hi)


def _golden(fn, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return _closed(fn, *_bracket(fn, lo, hi), lo, hi)


def _at_ends(fn, which: np.ndarray) -> np.ndarray:
    """Where the golden-section search of the null fit stops if fn falls (-1) or rises (1) up to an end of the range."""
    lg = np.log(GRID)
    lo, hi = np.where(which < 0, lg[0], lg[-2]), np.where(which < 0, lg[1], lg[-1])
    return _closed(fn, *_bracket(lambda z: which * z, lo, hi), lo, hi)


def _null_fit(d, w, y) -> tuple[np.ndarray, np.ndarray]:
    """ML lambda and log-likelihood per trait without a marker."""
    t = y.shape[1]
    ll = np.stack([_profile(np.full(t, lam), d, w, y, None)[0] for lam in GRID])
    best = ll.argmax(0)
    lg = np.log(GRID)
    x = _golden(lambda z: _profile(np.exp(z), d, w, y, None)[0], lg[np.maximum(best - 1, 0)], lg[np.minimum(best + 1, len(GRID) - 1)])
    return np.exp(x), _profile(np.exp(x), d, w, y, None)[0]


def rotated_basis(d: np.ndarray, u: np.ndarray | None, ry: np.ndarray, rw: np.ndarray) -> Basis:
    """Null fits of rotated traits and covariates under given eigenvalues."""
    if u is None:
        return Basis(d, u, ry, rw, np.zeros(ry.shape[1]), _profile(np.zeros(ry.shape[1]), d, rw, ry, None)[0])
    lam, ll = _null_fit(d, rw, ry)
    return Basis(d, u, ry, rw, lam, ll)


def make_basis(k: np.ndarray | None, y: np.ndarray, w: np.ndarray) -> Basis:
    if k is None:
        return rotated_basis(np.zeros(len(y)), None, y, w)
    d, u = np.linalg.eigh(k)
    return rotated_basis(np.clip(d, 0.0, None), u, u.T @ y, u.T @ w)


def score(basis: Basis, x: np.ndarray, trait: int, nodes: tuple | None = None, rxx: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(effect, se, p) of a batch of rotated marker rows for one trait, each at its own variance ratio.

    ``nodes`` and ``rxx`` are those of :func:`at_nodes` and :func:`spread_at_nodes`, where several traits share them.
    """
    d, w, y = basis.d, basis.w, basis.y[:, trait]
    n, c = w.shape
    lam = np.zeros(len(x))
    if basis.u is not None:
        nodes = at_nodes(basis) if nodes is None else nodes
        rxx = spread_at_nodes(nodes, x) if rxx is None else rxx
        log, end = _best_log_ratio(nodes, y, x, rxx)
        if end.any():
            rows = np.flatnonzero(end)
            log[rows] = _at_ends(lambda q: _profile(np.exp(q), d, w, y, x[rows])[0], end[rows])
        lam = np.exp(log)
    ll, rxx, rxy, rss = _profile(lam, d, w, y, x)
    lrt = 2 * (ll - basis.null_ll[trait])
    beta = rxy / rxx
    se = np.sqrt(rss / (n - c - 1) / rxx)
    p = np.where(np.isfinite(beta), chi2_1_upper(lrt), np.nan)
    return beta, se, p


def trait_matrix(pheno: DataFrame, samples: list[str], traits: list[str]) -> np.ndarray:
    """Samples x traits; both lists are bounded, so the matrix is."""
    rows = pheno.where(F.col("trait").isin(traits)).groupBy("sample", "trait").agg(F.avg("value").alias("value")).toPandas()
    wide = rows.pivot(index="sample", columns="trait", values="value")
    return wide.reindex(index=samples, columns=traits).to_numpy(float)


def complete(samples: list[str], *tables: np.ndarray, drop: bool = False) -> np.ndarray:
    """Indices of samples without missing values; an error unless dropping is allowed."""
    ok = np.all([np.isfinite(t).all(1) for t in tables], axis=0)
    if not drop and not ok.all():
        bad = [s for s, k in zip(samples, ok) if not k]
        raise ValueError(f"{len(bad)} samples are incomplete, for example {bad[:3]}")
    return np.flatnonzero(ok)


def zscored(c: np.ndarray) -> np.ndarray:
    sd = c.std(0)
    return (c - c.mean(0)) / np.where(sd > 0, sd, 1.0)


def design(n: int, pcs: np.ndarray | None = None, covariates: np.ndarray | None = None) -> np.ndarray:
    """Intercept, components and z-scored covariates."""
    parts = [np.ones((n, 1))]
    if pcs is not None:
        parts.append(pcs)
    if covariates is not None:
        parts.append(zscored(covariates))
    return np.column_stack(parts)


def scan(
    markers: DataFrame, y: np.ndarray, traits: list[str], w: np.ndarray, keep: np.ndarray | None = None,
    loco: dict[str, np.ndarray] | None = None, p_max: float = 1.0,
) -> DataFrame:
    """(trait, marker, chrom, pos, effect, se, p_value) of every marker and trait with p <= p_max.

    ``loco`` maps a chromosome to the raw product sums of all others; None tests without kinship.
    ``keep`` selects samples (indices into the dosage arrays); y and w have one row per kept sample.
    """
    n_all = len(y) if keep is None else None
    idx = np.arange(n_all) if keep is None else np.asarray(keep)
    if loco is None:
        bases: dict[str, Basis] = {"": make_basis(None, y, w)}
    else:
        if len(loco) * len(idx) ** 2 * 8 > BROADCAST_LIMIT:
            raise ValueError("eigenbases exceed the broadcast limit; scan fewer chromosomes at a time")
        bases = {c: make_basis(kinship_from_products(g, idx), y, w) for c, g in loco.items()}
    # plain arrays: broadcasts are pickled by reference, and executors may lack this package
    plain = {c: (b.d, b.u, b.y, b.w, b.null_lambda, b.null_ll) for c, b in bases.items()}
    shared = markers.sparkSession.sparkContext.broadcast(plain)
    kind = dict(markers.dtypes)

    def run(batches):
        table = {c: Basis(*parts) for c, parts in shared.value.items()}
        known: dict[str, tuple] = {}
        for b in pieces(batches):
            x_all = mean_imputed(array_matrix(b.column(3)))[:, idx]
            chroms = np.asarray([str(v) for v in b.column(1).to_pylist()])
            found = np.empty((3, len(traits), b.num_rows))
            for c in np.unique(chroms):
                at = np.flatnonzero(chroms == c)
                basis = table[""] if "" in table else table[c]
                nodes = rxx = None
                x = x_all[at]
                if basis.u is not None:
                    x = x @ basis.u
                    nodes = known[c] = known.get(c) or at_nodes(basis)
                    rxx = spread_at_nodes(nodes, x)
                for t in range(len(traits)):
                    found[:, t, at] = score(basis, x, t, nodes, rxx)
            t, hit = np.nonzero(found[2] <= p_max) if p_max < 1.0 else np.nonzero(np.ones(found.shape[1:], bool))
            if len(hit) == 0:
                continue
            take = pa.array(hit)
            yield pa.RecordBatch.from_arrays(
                [pa.array(traits, pa.string()).take(pa.array(t)), *(b.column(j).take(take) for j in range(3)), *(pa.array(v[t, hit], from_pandas=True) for v in found)],
                names=["trait", "marker", "chrom", "pos", "effect", "se", "p_value"],
            )

    return markers.select("marker", "chrom", "pos", "dosage").mapInArrow(
        run, f"trait string, marker string, chrom {kind['chrom']}, pos {kind['pos']}, effect double, se double, p_value double"
    )


# ---------------------------------------------------------------- one marker, many traits
def one_marker_rules(cells: DataFrame, keys: list[str], min_samples: int = 30, min_homozygotes: int = 3) -> DataFrame:
    """Counts, phenotype moments, status and skip reason per stratum.

    ``cells`` has one row per (keys, sample) with y and dosage; pairs lacking either are ignored.
    """
    c = cells.where(F.col("y").isNotNull() & F.col("dosage").isNotNull())
    d = F.col("dosage")
    s = c.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_observations"), F.count_if(d == 0).alias("n_ref_homozygote"), F.count_if(d == 1).alias("n_heterozygote"),
        F.count_if(d == 2).alias("n_alt_homozygote"), F.avg("y").alias("phenotype_mean"), F.stddev_pop("y").alias("phenotype_sd"),
    )
    reason = (
        F.when(F.col("n_observations") < min_samples, f"n_observations < {min_samples}")
        .when(F.col("n_ref_homozygote") < min_homozygotes, f"n_ref_homozygote < {min_homozygotes}")
        .when(F.col("n_alt_homozygote") < min_homozygotes, f"n_alt_homozygote < {min_homozygotes}")
        .when(~(F.col("phenotype_sd") > 0), "phenotype has zero/non-finite variance")
    )
    return s.withColumn("skip_reason", reason).withColumn("status", F.when(F.col("skip_reason").isNull(), "queued").otherwise("skipped"))


def set_basis(idx: np.ndarray, every: np.ndarray | None, others: np.ndarray | None, n_pcs: int):
    """(eigenvalues, eigenvectors, components) of a sample set: kinship without the marker's chromosome,
    components of the kinship of all markers."""
    if others is None:
        return np.zeros(len(idx)), None, None
    d, u = np.linalg.eigh(kinship_from_products(others, idx))
    pcs = components_of(kinship_from_products(others if every is None else every, idx), n_pcs) if n_pcs else None
    return np.clip(d, 0.0, None), u, pcs


def one_marker_tests(
    cells: DataFrame, keys: list[str], samples: list[str], every: np.ndarray | None, others: np.ndarray | None, n_pcs: int = 5,
    min_samples: int = 30, min_homozygotes: int = 3, covariates: list[str] | None = None, strata_per_task: int = 4096,
) -> DataFrame:
    """Test one marker in every stratum (trait, location, gene ...), each on its own sample subset.

    ``every`` and ``others`` are the raw product sums of all markers and of those outside the marker's
    chromosome: genotype components come from the first, the covariance from the second; None tests
    without kinship. Rules and tests see the same samples: those with y, a dosage and all covariates.

    A stratum becomes one row of arrays in sample order. Strata with the same samples meet under the
    digest of that set; each such group factorises once, for up to ``strata_per_task`` strata, and rotates
    and fits them in batches.
    """
    covariates = covariates or []
    seen = F.col("y").isNotNull() & F.col("dosage").isNotNull()
    for c in covariates:
        seen = seen & F.col(c).isNotNull()
    label = F.concat_ws("\u0001", *[F.col(k).cast("string") for k in keys])
    usable = cells.where(seen)
    rules = one_marker_rules(usable, keys, min_samples, min_homozygotes)
    order = cells.sparkSession.createDataFrame(pd.DataFrame({"sample": samples, "__i": np.arange(len(samples), dtype="int32")}))
    row = F.struct(F.col("__i").alias("i"), *[F.col(c).cast("double").alias(f"v{j}") for j, c in enumerate(["y", "dosage", *covariates])])
    packed = usable.withColumn("__s", label).join(order, "sample").groupBy("__s").agg(F.sort_array(F.collect_list(row)).alias("r"))
    queued = rules.where("status = 'queued'").select(label.alias("__s"))
    strata = packed.join(queued, "__s").select("__s", F.col("r.i").alias("i"), *[F.col(f"r.v{j}").alias(f"v{j}") for j in range(2 + len(covariates))])
    strata = strata.withColumn("__set", F.sha2(F.array_join(F.col("i").cast("array<string>"), ","), 256))
    sizes = strata.groupBy("__set").agg(F.ceil(F.count(F.lit(1)) / strata_per_task).alias("__parts"))
    strata = strata.join(sizes, "__set").withColumn("__salt", F.pmod(F.xxhash64("__s"), F.col("__parts")))
    shared = cells.sparkSession.sparkContext.broadcast((every, others))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = None
        for pdf in batches:
            for at in range(0, len(pdf), 128):
                part = pdf.iloc[at:at + 128]
                rows: list[tuple] = []
                try:
                    if found is None:
                        found = set_basis(np.asarray(part["i"].iloc[0]), *shared.value, n_pcs)
                    d, u, pcs = found
                    turn = (lambda m: m) if u is None else (lambda m: u.T @ m)
                    y, x = (np.stack(part[c].to_list(), axis=1) for c in ("v0", "v1"))
                    if not covariates:
                        w = turn(design(len(y), pcs))
                        blocks = [(w, range(y.shape[1]))]
                    else:
                        z = [np.stack(part[f"v{j + 2}"].to_list(), axis=1) for j in range(len(covariates))]
                        blocks = [(turn(design(len(y), pcs, np.column_stack([c[:, t] for c in z]))), [t]) for t in range(y.shape[1])]
                    ry, rx = turn(y), turn(x)
                    for w, own in blocks:
                        b = rotated_basis(d, u, ry[:, list(own)], w)
                        for k, t in enumerate(own):
                            beta, se, p = score(b, rx[:, t][None, :], k)
                            rows.append((part["__s"].iloc[t], float(beta[0]), float(se[0]), float(p[0]), "tested", None))
                except np.linalg.LinAlgError as exc:
                    done = {r[0] for r in rows}
                    rows += [(s, np.nan, np.nan, np.nan, "error", str(exc)) for s in part["__s"] if s not in done]
                yield pd.DataFrame(rows, columns=["__s", "effect", "se", "p_value", "st", "why"])

    tested = strata.groupBy("__set", "__salt").applyInPandas(solve, "__s string, effect double, se double, p_value double, st string, why string")
    out = rules.withColumn("__s", label).join(tested, "__s", "left")
    z = F.col("effect") / F.col("phenotype_sd")
    return out.withColumns({
        "status": F.coalesce("st", "status"), "skip_reason": F.coalesce("why", "skip_reason"),
        "standardized_effect": z, "homozygote_contrast": 2 * z,
        "direction": F.when(z > 0, "increases").when(z < 0, "decreases").when(z == 0, "none"),
    }).drop("__s", "st", "why")


__all__ = ["scan", "one_marker_tests", "one_marker_rules", "trait_matrix", "design", "complete", "loco_products", "make_basis", "rotated_basis", "set_basis", "score"]
