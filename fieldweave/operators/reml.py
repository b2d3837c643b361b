"""Average-information REML from keyed sums of products.

A model is ``y = X b + Z u + (unit) + (unit x cell) + e``: fixed columns, bounded random factors and two
unbounded random factors, units (genotypes) and the cells inside them (genotype x environment), either of
which may be left out. Nothing here lists units. Plots split into two orthogonal parts: what varies inside a
cell, where the covariance is residual, and the cell means, where it depends only on how many plots each
cell of the unit has. So a model needs

* ``within``: products of the columns [X, Z, y] after subtracting cell means, and its degrees of freedom;
* for every pattern of plot counts that a unit can have, the products of the (scaled) cell sums.

One pass over the plots and one over the cells give these sums for every key (environment), with all traits
side by side; what depends on no trait is summed once. Each (key, slice of traits) is then solved in a task.

The likelihood, its gradient and the average information (Gilmour, Thompson & Cullis 1995) are evaluated
from the sums; steps are halved until the likelihood rises, a component that would turn negative stops at 0
and stays there while its gradient points outward.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut_lineage
from .crossproducts import array_matrix, list_column, pieces, vector_sums

WITHIN = "within"
OPEN_BYTES = 256 << 20  # products a task holds before it hands some on
TRAITS_AT_ONCE = 16
SHORT_ROWS = 100_000  # a table of factor levels that tasks may hold whole
PLAIN_COLUMNS = 100  # longest vector that is summed column by column
SINGULAR = 1e-4  # smallest relative standard deviation of a random term that counts as more than none


# ---------------------------------------------------------------- one model
@dataclass
class Sums:
    """Products of [base columns, y] of one model."""

    within: np.ndarray  # (k + 1, k + 1)
    free: float  # plots less cells
    counts: np.ndarray  # (patterns, m): plots of each cell, 0 where a unit has fewer cells
    units: np.ndarray  # (patterns,)
    between: np.ndarray  # (patterns, m, m, k + 1, k + 1): products of cell sums over the roots of their counts
    n_fixed: int
    sizes: list[int] = field(default_factory=list)  # levels of each bounded random factor

    @property
    def n(self) -> float:
        return self.free + float(self.units @ (self.counts > 0).sum(1)) if len(self.units) else self.free


@dataclass
class Fit:
    theta: np.ndarray  # absorbed terms, bounded factors, residual
    coef: np.ndarray  # of every base column; 0 for fixed columns that depend on others
    loglik: float
    converged: bool
    singular: bool
    steps: int


def independent(gram: np.ndarray) -> np.ndarray:
    """Columns that do not depend on earlier ones, from their products."""
    left, keep = gram.astype(float).copy(), []
    own = np.diag(gram).copy()
    for j in range(len(gram)):
        if left[j, j] > 1e-9 * own[j] and own[j] > 0:
            keep.append(j)
            left = left - np.outer(left[:, j], left[j]) / left[j, j]
    return np.array(keep, dtype=int)


class Model:
    """Likelihood, gradient and average information at given variances."""

    def __init__(self, sums: Sums, absorbed: Sequence[str]):
        self.sums, self.absorbed = sums, tuple(absorbed)
        self.k = len(sums.within) - 1
        self.root = np.sqrt(sums.counts)
        self.mask = sums.counts > 0
        self.flat = sums.between.reshape(-1, (self.k + 1) ** 2)
        m = self.root.shape[1]
        forms = {"unit": self.root[:, :, None] * self.root[:, None, :], "cell": sums.counts[:, :, None] * np.eye(m)}
        self.forms = [forms[a] for a in self.absorbed] + [self.mask[:, :, None] * np.eye(m)]
        self.edges = sums.n_fixed + np.concatenate([[0], np.cumsum(sums.sizes)]).astype(int)
        self.slots = [slice(a, b) for a, b in zip(self.edges, self.edges[1:])]
        self.terms = len(self.absorbed) + len(self.slots) + 1

    def at(self, theta: np.ndarray, derivatives: bool = True):
        s, n_abs, k = self.sums, len(self.absorbed), self.k
        e = theta[-1]
        own = [*range(n_abs), self.terms - 1]  # places of the terms in ``forms``
        eye = np.eye(self.root.shape[1])
        cov = e * eye + sum(theta[i] * v for i, v in enumerate(self.forms[:-1])) + np.zeros_like(self.forms[-1])
        inv = np.linalg.inv(cov)
        pad = (~self.mask).sum(1)
        logdet = s.free * np.log(e) + float(s.units @ (np.linalg.slogdet(cov)[1] - pad * np.log(e)))
        turned = [inv @ v @ inv for v in self.forms] if derivatives else []
        mats = np.stack([x.reshape(-1) for x in (inv, *turned)]) @ self.flat if len(self.flat) else np.zeros((1 + len(turned), (k + 1) ** 2))
        mats = mats.reshape(-1, k + 1, k + 1)
        base = mats[0] + s.within / e
        scale = np.concatenate([np.ones(s.n_fixed), *(np.full(n, np.sqrt(theta[n_abs + f])) for f, n in enumerate(s.sizes))])
        c = scale[:, None] * base[:k, :k] * scale + np.diag((np.arange(k) >= s.n_fixed).astype(float))
        chol = np.linalg.cholesky(c) if k else np.zeros((0, 0))
        half = np.linalg.solve(chol, np.diag(scale)) if k else np.zeros((0, 0))
        p = half.T @ half  # the inverse of the mixed-model equations, scaled back
        coef = p @ base[:k, k]
        ypy = float(base[k, k] - base[k, :k] @ coef)
        loglik = -0.5 * (logdet + 2 * np.log(np.diag(chol)).sum() + ypy)
        if not derivatives:
            return loglik, coef
        z = np.append(-coef, 1.0)
        d = mats[1:].copy()
        d[-1] += s.within / e**2
        trace, quad, rhs = np.zeros(self.terms), np.zeros(self.terms), np.zeros((self.terms, k))
        for j, t in enumerate(own):
            trace[t] = float(s.units @ np.einsum("pab,pba->p", inv, self.forms[j])) if len(s.units) else 0.0
            trace[t] -= float((p * d[j][:k, :k]).sum())
            quad[t] = z @ d[j] @ z
            rhs[t] = d[j][:k] @ z
        trace[-1] += s.free / e
        score = base[:k] @ z  # Z' P y in the slots of random factors
        picked = np.zeros((self.terms, k))
        for f, at in enumerate(self.slots):
            t = n_abs + f
            trace[t] = float(np.trace(base[at, at]) - (p * (base[:k, at] @ base[at, :k])).sum())
            quad[t] = float(score[at] @ score[at])
            picked[t, at] = score[at]
            rhs[t] = base[:k, at] @ score[at]
        inner = picked @ base[:k, :k] @ picked.T + rhs @ picked.T * np.isin(np.arange(self.terms), own)[:, None]
        seen = np.einsum("pabij,i,j->pab", s.between, z, z) if len(s.units) else np.zeros((0, *eye.shape))
        for j, t in enumerate(own):
            for i, u in enumerate(own):
                inner[t, u] = float(((turned[j] @ self.forms[i] @ inv) * seen).sum()) if len(seen) else 0.0
                if t == u == self.terms - 1:
                    inner[t, u] += z @ s.within @ z / e**3
            for f in range(len(self.slots)):
                inner[n_abs + f, t] = inner[t, n_abs + f]
        info = 0.5 * (inner - rhs @ p @ rhs.T)
        return loglik, coef, 0.5 * (quad - trace), (info + info.T) / 2


def solve_reml(sums: Sums, absorbed: Sequence[str], limit: int = 200, tol: float = 1e-13) -> Fit:
    """REML estimates to a tolerance. Raises LinAlgError where the model cannot be fitted."""
    k = len(sums.within) - 1
    total = sums.within + (sums.between[:, range(m := sums.between.shape[1]), range(m)].sum((0, 1)) if len(sums.units) else 0.0)
    keep = np.concatenate([independent(total[: sums.n_fixed, : sums.n_fixed]), np.arange(sums.n_fixed, k)]).astype(int)
    n_fixed = len(keep) - (k - sums.n_fixed)
    fixed, at = keep[:n_fixed], np.append(keep, k)
    rest = float(total[k, k] - (total[k, fixed] @ np.linalg.solve(total[np.ix_(fixed, fixed)], total[fixed, k]) if n_fixed else 0.0))
    if sums.n - n_fixed < 1 or rest <= 1e-12 * max(total[k, k], 0.0) or rest <= 0:
        raise np.linalg.LinAlgError("the trait does not vary beyond its fixed effects")
    unit = np.append(np.ones(len(keep)), np.sqrt((sums.n - n_fixed) / rest))  # y in units of its spread
    both = unit[:, None] * unit
    small = Sums(sums.within[np.ix_(at, at)] * both, sums.free, sums.counts, sums.units, sums.between[..., at[:, None], at] * both, n_fixed, sums.sizes)
    model = Model(small, absorbed)
    theta = np.full(model.terms, 1.0 / model.terms)
    found = model.at(theta)
    ok = False
    for steps in range(1, limit + 1):
        loglik, _, grad, info = found
        free = (theta > 0) | (grad > 0)
        step = np.zeros(model.terms)
        try:
            step[free] = np.linalg.solve(info[np.ix_(free, free)], grad[free])
        except np.linalg.LinAlgError:
            step[free] = grad[free] * theta[free].clip(1e-3) ** 2
        if grad @ step <= 0:
            step = np.where(free, grad * theta.clip(1e-3) ** 2, 0.0)
        if grad @ step < tol:
            ok = True
            break
        size, moved = 1.0, False
        for _ in range(40):
            new = theta + size * step
            new = np.where(new < 1e-10, 0.0, new)
            new[-1] = max(new[-1], 1e-8)
            if model.at(new, derivatives=False)[0] >= loglik - 1e-13 * abs(loglik):
                moved = True
                break
            size /= 2
        if not moved:  # the gain to come is below what the likelihood can show
            ok = bool(grad @ step < 1e-9)
            break
        theta, found = new, model.at(new)
        if grad @ step < 1e-10 and abs(found[0] - loglik) <= 1e-13 * abs(loglik):
            ok = True
            break
    coef = np.zeros(k)
    coef[keep] = found[1] / unit[-1]
    share = np.sqrt(theta[:-1] / theta[-1])
    return Fit(theta / unit[-1] ** 2, coef, float(found[0]), ok, bool((share < SINGULAR).any()), steps)


# ---------------------------------------------------------------- columns of a model
@dataclass(frozen=True)
class Design:
    """Plots under a string ``key``. A plot is short for the vector [fixed columns, indicators of factor levels, traits]."""

    rows: DataFrame  # key, unit columns, cell columns, n_base, x (fixed columns), y (traits), at (places of its indicators)
    layout: DataFrame  # key, factors (array of struct of name and number of levels), n_base
    traits: list[str]
    n_fixed: int


def design(
    plots: DataFrame, traits: Sequence[str], covariates: Sequence[str], factors: Sequence[str], keep: Sequence[str], intercept: bool, key: str | None = None,
) -> Design:
    """Complete plots of every key; a factor with one level in a key is left out there.

    Levels are numbered in Spark, key by key, and reach the plots by joins; the vectors of one key have
    one length. Only tasks that multiply them spell the indicators out.
    """
    named = plots.withColumn("__key", F.col(key).cast("string") if key else F.lit("all"))
    rows = named.dropna(subset=["__key", *keep, *traits, *covariates, *factors]).select(
        "__key", *keep, *[F.col(f).cast("string").alias(f"__f{i}") for i, f in enumerate(factors)],
        F.array(*([F.lit(1.0)] if intercept else []), *[F.col(c).cast("double") for c in covariates]).cast("array<double>").alias("__x"),
        F.array(*[F.col(t).cast("double") for t in traits]).alias("__y"),
    )
    n_fixed = len(covariates) + intercept
    keys = rows.select("__key").distinct()
    if factors:
        listed = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"__f{i}").alias("l")) for i in range(len(factors))])).alias("x")
        met = rows.select("__key", *[f"__f{i}" for i in range(len(factors))]).distinct()
        levels = met.select("__key", listed).select("__key", "x.f", "x.l").distinct()
        levels = levels.withColumn("__n", F.count("l").over(W.partitionBy("__key", "f"))).where("__n > 1")
        levels = cut_lineage(levels.withColumn("__at", F.row_number().over(W.partitionBy("__key").orderBy("f", "l")) + (n_fixed - 1)))
        sizes = levels.groupBy("__key", "f").agg(F.count("l").cast("int").alias("n")).groupBy("__key").agg(F.sort_array(F.collect_list(F.struct("f", "n"))).alias("s"))
        names = F.array(*[F.lit(f) for f in factors])
        sizes = sizes.select("__key", F.transform("s", lambda x: F.struct(F.get(names, x["f"]).alias("f"), x["n"].alias("n"))).alias("factors"))
        layout = keys.join(sizes, "__key", "left").withColumn("factors", F.coalesce("factors", F.expr("cast(array() as array<struct<f: string, n: int>>)")))
    else:
        layout = keys.withColumn("factors", F.expr("cast(array() as array<struct<f: string, n: int>>)"))
    layout = layout.withColumn("n_base", F.aggregate("factors", F.lit(n_fixed), lambda a, x: a + x["n"]))
    layout = cut_lineage(layout)
    rows = rows.join(_short(layout.select("__key", "n_base")), "__key")
    for i in range(len(factors)):
        own = levels.where(F.col("f") == i).select("__key", F.col("l").alias(f"__f{i}"), F.col("__at").alias(f"__p{i}"))
        rows = rows.join(_short(own), ["__key", f"__f{i}"], "left")
    at = F.array_compact(F.array(*[f"__p{i}" for i in range(len(factors))])) if factors else F.array()
    return Design(rows.select("__key", *keep, "n_base", F.col("__x").alias("x"), F.col("__y").alias("y"), at.cast("array<int>").alias("at")), layout, list(traits), n_fixed)


def _short(df: DataFrame) -> DataFrame:
    """A stored table, marked to be sent to all tasks if it is short enough; else the join deals both sides out."""
    return F.broadcast(df) if df.count() <= SHORT_ROWS else df


# ---------------------------------------------------------------- keyed sums
def _spelled(part: pa.RecordBatch, n_base: int, n_traits: int) -> np.ndarray:
    """Vectors of plots given as fixed columns, places of indicators and traits (columns 2 to 4)."""
    n = part.num_rows
    out = np.zeros((n, n_base + n_traits))
    x, at = part.column(2), part.column(4)
    if len(x.flatten()):
        fixed = array_matrix(x)
        out[:, :fixed.shape[1]] = fixed
    out[np.repeat(np.arange(n), np.diff(np.asarray(at.offsets))), at.flatten().to_numpy(zero_copy_only=False)] = 1.0
    out[:, n_base:] = array_matrix(part.column(3))
    return out


def _by_name(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, str], pa.RecordBatch]]:
    """Rows of a batch by their first two columns."""
    codes, words = [], []
    for column in batch.columns[:2]:
        d = column.dictionary_encode()
        codes.append(d.indices.to_numpy())
        words.append(d.dictionary.to_pylist())
    place = codes[0].astype(np.int64) * len(words[1]) + codes[1]
    for p in np.unique(place):
        at = np.flatnonzero(place == p)
        yield (words[0][p // len(words[1])], words[1][p % len(words[1])]), batch if len(at) == batch.num_rows else batch.take(pa.array(at))


def _fold(n_traits: int, plots: bool):
    """Sums products of batches, at most OPEN_BYTES of them open: of plots (key, pattern, x, y, at, n_base), or of
    cells and units (key, pattern, m, n_base, sign, v)."""
    def emit(name: tuple[str, str], held: np.ndarray) -> pa.RecordBatch:
        m, _, height, width = held.shape
        a, b, i = (x.reshape(-1) for x in np.meshgrid(np.arange(m), np.arange(m), np.arange(height), indexing="ij"))
        cols = [pa.array([name[0]] * len(a)), pa.array([name[1]] * len(a)), *(pa.array(x.astype(np.int32)) for x in (a, b, i)), list_column(held.reshape(-1, width))]
        return pa.RecordBatch.from_arrays(cols, names=["__key", "pattern", "a", "b", "i", "row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], np.ndarray] = {}
        size = 0
        for batch in pieces(batches, 4096):
            for name, part in _by_name(batch):
                if plots:
                    m, n_base, sign = 1, part.column(5)[0].as_py(), np.ones(part.num_rows)
                    v = _spelled(part, n_base, n_traits)[:, None, :]
                else:
                    m, n_base = part.column(2)[0].as_py(), part.column(3)[0].as_py()
                    sign = part.column(4).to_numpy(zero_copy_only=False)
                    v = array_matrix(part.column(5)).reshape(part.num_rows, m, n_base + n_traits)
                out = np.zeros((m, m, n_base + 2, n_base + n_traits))
                for a in range(m):
                    for b in range(m):
                        left = v[:, a] * sign[:, None]
                        out[a, b, :n_base] = left[:, :n_base].T @ v[:, b]
                        out[a, b, n_base, n_base:] = (left[:, n_base:] * v[:, b, n_base:]).sum(0)
                out[:, :, n_base + 1, 0] = sign.sum()
                if name in held:
                    held[name] += out
                else:
                    held[name] = out
                    size += out.nbytes
                while size > OPEN_BYTES and len(held) > 1:
                    old = next(iter(held))
                    size -= held[old].nbytes
                    yield emit(old, held.pop(old))
        for name, out in held.items():
            yield emit(name, out)

    return run


def _cell_sums(d: Design, by: Sequence[str]) -> DataFrame:
    """(key, n_base, cell columns, s, n_rows): vector sums of every cell.

    Vectors of a usual length are summed column by column, which the engine compiles; longer ones as vectors.
    """
    widest = d.layout.agg(F.max("n_base")).first()[0] or d.n_fixed
    keys = ["__key", "n_base", *by]
    n, t = d.n_fixed, len(d.traits)
    if widest + t <= PLAIN_COLUMNS:
        sums = [F.sum(F.get("x", F.lit(i))).alias(f"__s{i}") for i in range(n)]
        sums += [F.count_if(F.array_contains("at", F.lit(i))).cast("double").alias(f"__s{i}") for i in range(n, widest)]
        sums += [F.sum(F.get("y", F.lit(i))).alias(f"__t{i}") for i in range(t)]
        cells = d.rows.groupBy(*keys).agg(*sums, F.count(F.lit(1)).alias("n_rows"))
        base = F.array(*[f"__s{i}" for i in range(widest)]).cast("array<double>")
        return cells.select(*keys, F.concat(F.slice(base, F.lit(1), F.col("n_base")), F.array(*[f"__t{i}" for i in range(t)])).alias("s"), "n_rows")
    ones = F.expr(f"CASE WHEN n_base > {n} THEN transform(sequence({n}, n_base - 1), i -> CASE WHEN array_contains(at, i) THEN 1D ELSE 0D END) ELSE cast(array() as array<double>) END")
    return vector_sums(d.rows.select(*keys, F.concat("x", ones, "y").alias("v")), keys, "v", "s")


def keyed_sums(d: Design, unit: Sequence[str], cell: Sequence[str], between: bool) -> tuple[DataFrame, DataFrame]:
    """(sums, cells): rows of products for every key and pattern, and the cell sums they came from.

    ``cell`` extends ``unit``; a unit has at most as many cells as there are environments.
    """
    t = len(d.traits)
    cells = cut_lineage(_cell_sums(d, cell))
    scaled = cells.select("__key", *cell, "n_base", "n_rows", F.transform("s", lambda x: x / F.sqrt("n_rows")).alias("v"))
    shape = lambda df, pattern, m, sign: df.select("__key", pattern.alias("pattern"), m.cast("int").alias("m"), "n_base", F.lit(sign).alias("sign"), "v")
    parts = shape(scaled, F.lit(WITHIN), F.lit(1), -1.0)
    if between and list(unit) == list(cell):
        parts = parts.unionByName(shape(scaled, F.col("n_rows").cast("string"), F.lit(1), 1.0))
    elif between:
        whole = scaled.groupBy("__key", "n_base", *unit).agg(F.sort_array(F.collect_list(F.struct("n_rows", "v"))).alias("c"))
        whole = whole.select("__key", "n_base", F.array_join(F.col("c.n_rows").cast("array<string>"), ",").alias("p"), F.size("c").alias("m"), F.flatten("c.v").alias("v"))
        parts = parts.unionByName(shape(whole, F.col("p"), F.col("m"), 1.0))
    kinds = "__key string, pattern string, a int, b int, i int, row array<double>"
    plots = d.rows.select("__key", F.lit(WITHIN).alias("pattern"), "x", "y", "at", "n_base")
    rows = plots.mapInArrow(_fold(t, True), kinds).unionByName(parts.mapInArrow(_fold(t, False), kinds))
    summed = rows.groupBy("__key", "pattern", "a", "b", "i").agg(Summarizer.sum(array_to_vector("row")).alias("row"))
    return summed.withColumn("row", vector_to_array("row")), cells


def _sums_of(table: pd.DataFrame, n_base: int, n_fixed: int, sizes: list[int]):
    """A function from the place of a trait in the slice to its Sums."""
    stored: dict[str, dict[tuple[int, int, int], np.ndarray]] = {}
    for pattern, a, b, i, row in zip(table["pattern"], table["a"], table["b"], table["i"], table["row"]):
        stored.setdefault(pattern, {})[a, b, i] = np.asarray(row)

    def block(rows: dict, a: int, b: int, t: int) -> np.ndarray:
        out = np.empty((n_base + 1, n_base + 1))
        for i in range(n_base):
            out[i, :n_base] = rows[a, b, i][:n_base]
            out[i, n_base] = rows[a, b, i][n_base + t]
            out[n_base, i] = rows[b, a, i][n_base + t]
        out[n_base, n_base] = rows[a, b, n_base][n_base + t]
        return out

    patterns = sorted(p for p in stored if p != WITHIN)
    counts = [[float(x) for x in p.split(",")] for p in patterns]
    m = max(map(len, counts), default=1)

    def of(t: int) -> Sums:
        between = np.zeros((len(patterns), m, m, n_base + 1, n_base + 1))
        for j, p in enumerate(patterns):
            for a in range(len(counts[j])):
                for b in range(len(counts[j])):
                    between[j, a, b] = block(stored[p], a, b, t)
        padded = np.array([c + [0.0] * (m - len(c)) for c in counts]).reshape(len(patterns), m)
        units = np.array([stored[p][0, 0, n_base + 1][0] for p in patterns])
        return Sums(block(stored[WITHIN], 0, 0, t), float(stored[WITHIN][0, 0, n_base + 1][0]), padded, units, between, n_fixed, sizes)

    return of


FITS = "__key string, trait string, sources array<struct<source: string, vcov: double>>, coef array<double>, n double, n_units double, converged boolean, singular boolean, error string"


def fit_models(d: Design, sums: DataFrame, absorbed: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """One row for each key and trait: variances, coefficients of the base columns, flags, or an error.

    ``labels`` name the absorbed terms ("unit", "cell") in the result.
    """
    traits, n_fixed = d.traits, d.n_fixed
    many = -(-len(traits) // TRAITS_AT_ONCE)
    own = F.concat(F.slice("row", 1, F.col("n_base")), F.slice("row", F.col("n_base") + 1 + F.col("part") * TRAITS_AT_ONCE, F.lit(TRAITS_AT_ONCE)))
    dealt = sums.join(d.layout, "__key").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    dealt = dealt.select("__key", "part", "n_base", F.to_json("factors").alias("factors"), "pattern", "a", "b", "i", own.alias("row"))

    def solve(table: pd.DataFrame) -> pd.DataFrame:
        import json

        key, part, n_base = table["__key"].iloc[0], int(table["part"].iloc[0]), int(table["n_base"].iloc[0])
        factors = json.loads(table["factors"].iloc[0])
        of = _sums_of(table, n_base, n_fixed, [f["n"] for f in factors])
        names = [*labels, *(f["f"] for f in factors), "Residual"]
        out = []
        for t, trait in enumerate(traits[part * TRAITS_AT_ONCE:(part + 1) * TRAITS_AT_ONCE]):
            s = of(t)
            n, n_units = s.n, float(s.units.sum())
            try:
                if absorbed and n_units < 2:
                    raise np.linalg.LinAlgError("not enough genotypes")
                fit = solve_reml(s, absorbed)
                out.append((key, trait, [{"source": x, "vcov": float(v)} for x, v in zip(names, fit.theta)], fit.coef.tolist(), n, n_units, fit.converged, fit.singular, None))
            except np.linalg.LinAlgError as exc:
                out.append((key, trait, [], [], n, n_units, False, False, str(exc)))
        return pd.DataFrame(out, columns=["__key", "trait", "sources", "coef", "n", "n_units", "converged", "singular", "error"])

    return dealt.groupBy("__key", "part").applyInPandas(solve, FITS)
