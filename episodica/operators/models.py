"""Models that are no relational algebra: Arrow folds over bounded groups, and fits whose moments Spark sums up.

Grouped functions get one episode, or sums of a group; fits over all rows gather sums of fixed size.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship


def effective_rank(m: np.ndarray) -> tuple[float, float]:
    """Exponential of the entropy of the normalised singular values; stable rank."""
    return ranks_of(np.linalg.svd(m, compute_uv=False))


def ranks_of(s: np.ndarray) -> tuple[float, float]:
    """Effective and stable rank from singular values, largest first."""
    p = s / max(s.sum(), 1e-300)
    return float(np.exp(-(p * np.log(np.maximum(p, 1e-12))).sum())), float((s**2).sum() / max(s[0] ** 2, 1e-300))


def group_ranks(df: DataFrame, group: str, vector: str, held: int = 1000) -> DataFrame:
    """Ranks of the matrix of all of a group's vectors, from its sum of outer products: partial sums of fixed size from each task."""
    ship(df.sparkSession)

    def add(frames):
        sums: dict = {}

        def flush():
            yield pd.DataFrame({"g": list(sums), "n": [n for n, _ in sums.values()], "o": [o.ravel().tolist() for _, o in sums.values()]})
            sums.clear()

        for f in frames:
            for g, part in f.groupby(group, dropna=False, sort=False):
                x = np.stack(part[vector].map(np.asarray))
                n, o = sums.get(g, (0, 0.0))
                sums[g] = (n + len(x), o + x.T @ x)
            if len(sums) > held:
                yield from flush()
        if sums:
            yield from flush()

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        n, d = int(pdf.n.iloc[0]), math.isqrt(len(pdf))
        o = pdf.sort_values("i")["v"].to_numpy().reshape(d, d)
        s = np.sqrt(np.maximum(np.linalg.eigvalsh(o)[::-1], 0.0))[: min(n, d)]  # the others are zero but for rounding
        return pd.DataFrame([(key[0], n, *ranks_of(s))], columns=["g", "n", "effective", "stable"])

    kind = df.schema[group].dataType.simpleString()
    parts = df.select(group, vector).where(F.col(vector).isNotNull()).mapInPandas(add, f"g {kind}, n long, o array<double>")
    tall = parts.select("g", "n", F.posexplode("o").alias("i", "v")).groupBy("g", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    return tall.groupBy("g").applyInPandas(run, f"g {kind}, n int, effective double, stable double").withColumnRenamed("g", group)


def moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sum and sum of outer products of a vector column: partial sums of fixed size from each task."""
    ship(df.sparkSession)

    def run(frames):
        n, s, o = 0, None, None
        for f in frames:
            if len(f):
                x = np.stack(f[vector].map(np.asarray))
                s = x.sum(0) if s is None else s + x.sum(0)
                o = x.T @ x if o is None else o + x.T @ x
                n += len(x)
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "o": [o.ravel().tolist()]})

    parts = df.select(vector).where(F.col(vector).isNotNull()).mapInPandas(run, "n long, s array<double>, o array<double>")
    tall = parts.select(F.lit(0).alias("w"), F.posexplode("s").alias("i", "v")).unionByName(parts.select(F.lit(1).alias("w"), F.posexplode("o").alias("i", "v"))).unionByName(parts.select(F.lit(2).alias("w"), F.lit(0).alias("i"), F.col("n").cast("double").alias("v")))
    rows = tall.groupBy("w", "i").agg(F.sum("v").alias("v")).collect()  # dimensions and their square
    d = 1 + max((r["i"] for r in rows if r["w"] == 0), default=-1)
    s, o, n = np.zeros(d), np.zeros(d * d), 0
    for r in rows:
        if r["w"] == 0:
            s[r["i"]] = r["v"]
        elif r["w"] == 1:
            o[r["i"]] = r["v"]
        else:
            n = int(r["v"])
    return n, s, o.reshape(d, d)


def shrunk_precision(n: int, s: np.ndarray, o: np.ndarray, shrink: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Mean and inverse of the covariance shrunk towards its mean variance."""
    mean = s / n
    cov = o / n - np.outer(mean, mean)
    target = np.eye(len(s)) * np.trace(cov) / len(s)
    return mean, np.linalg.inv((1 - shrink) * cov + shrink * target)


def mahalanobis(df: DataFrame, ident: str, vector: str, shrink: float | None = None) -> DataFrame:
    """Squared Mahalanobis distance over the dimension, from the mean of all rows; the covariance is shrunk by a share, or as Ledoit and Wolf find it."""
    if shrink is None:
        from .phases import keyed_moments, shrunk

        dims = df.select(F.max(F.size(vector))).head()[0]
        mean, precision, _ = shrunk(np.array(keyed_moments(df, [], vector, dims).head()["m"]), dims)
    else:
        mean, precision = shrunk_precision(*moments(df, vector), shrink)

    def run(frames):
        for f in frames:
            x = np.stack(f[vector].map(np.asarray)) - mean if len(f) else np.zeros((0, len(mean)))
            yield pd.DataFrame({"id": f[ident], "distance": np.einsum("ij,jk,ik->i", x, precision, x) / len(mean)})

    kind = df.schema[ident].dataType.simpleString()
    return df.select(ident, vector).mapInPandas(run, f"id {kind}, distance double").withColumnRenamed("id", ident)


def principal_components(df: DataFrame, vector: str, share: float = 0.9, most: int = 24) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, whitening matrix and variances of the leading components that hold a share of the variance."""
    n, s, o = moments(df, vector)
    mean = s / n
    values, vectors = np.linalg.eigh(o / n - np.outer(mean, mean))
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, int(np.searchsorted(np.cumsum(values) / values.sum(), share)) + 1)
    vectors = vectors[:, :k] * np.sign(vectors[np.abs(vectors[:, :k]).argmax(0), range(k)])  # signs fixed by the largest entry
    return mean, vectors / np.sqrt(np.maximum(values[:k], 1e-12)), values[:k]


def ridge_var(df: DataFrame, ep: str, q: str, x: str, order: int, ridge: float) -> list[float]:
    """Coefficients (intercept first) of a ridge autoregression; the normal equations are one aggregate row."""
    from pyspark.sql import Window

    w = Window.partitionBy(ep).orderBy(q)
    rows = df.select(F.lit(1.0).alias("c0"), *[F.lag(x, k).over(w).alias(f"c{k}") for k in range(1, order + 1)], F.col(x).alias("y")).dropna()
    names = [f"c{k}" for k in range(order + 1)]
    r = rows.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a in names for b in [*names, "y"]]).first()
    a = np.array([[r[f"{i}_{j}"] or 0.0 for j in names] for i in names]) + np.diag([0.0] + [ridge] * order)
    return np.linalg.solve(a + 1e-12 * np.eye(len(names)), np.array([r[f"{i}_y"] or 0.0 for i in names])).tolist()


def dtw_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Monotone match of a onto b: each step of a moves on by none, one or two in b, from b's start."""
    cost = np.abs(b - a[0]).astype(float)
    cost[1:] = np.inf
    for v in a[1:]:
        best = np.minimum(cost, np.minimum(np.append(np.inf, cost[:-1]), np.append([np.inf, np.inf], cost[:-2])[: len(cost)]))
        cost = best + np.abs(b - v)
    return float(np.min(cost)) / len(a)


def template_match(df: DataFrame, ep: str, q: str, x: str, template: list[float]) -> DataFrame:
    """(ep, distance) of each episode's monotone match to a template."""
    ship(df.sparkSession)
    target = np.array(template)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], dtw_distance(pdf.sort_values(q)[x].to_numpy(float), target))], columns=["g", "distance"])

    kind = df.schema[ep].dataType.simpleString()
    return df.select(ep, q, x).groupBy(ep).applyInPandas(run, f"g {kind}, distance double").withColumnRenamed("g", ep)


class DurationChain:
    """A semi-Markov chain as one Markov chain over cells (state, age), read in log space.

    A cell ends with its hazard and hands its mass to the first ages of the next states; else it moves one age on, and
    the last age keeps what stays.
    """

    def __init__(self, transition, emission, hazard):
        self.states, self.ages = hazard.shape
        cells = np.arange(self.states * self.ages).reshape(hazard.shape)
        self.step = np.zeros((cells.size, cells.size))
        np.add.at(self.step, (cells, np.minimum(cells + 1, cells[:, -1:])), 1 - hazard)
        for state in range(self.states):
            self.step[np.ix_(cells[state], cells[:, 0])] += np.outer(hazard[state], transition[state])
        with np.errstate(divide="ignore"):
            self.log_step, self.log_emission = np.log(self.step), np.repeat(np.log(emission), self.ages, axis=0)
        self.start = np.full(cells.size, -np.inf)
        self.start[cells[:, 0]] = -math.log(self.states)

    def read(self, words: list[int | None]) -> tuple[np.ndarray, float]:
        """Belief over the cells after the words, and the log probability of the known ones; None is a step that tells nothing."""
        log, evidence = self.start, 0.0
        for t, word in enumerate(words):
            if t:
                log = np.logaddexp.reduce(log[:, None] + self.log_step, axis=0)
            if word is not None:
                log = log + self.log_emission[:, word]
                total = np.logaddexp.reduce(log)
                evidence, log = evidence + total, log - total
        return np.exp(log), float(evidence)

    def ahead(self, belief: np.ndarray, steps: int) -> np.ndarray:
        """Probability of each state some steps on."""
        return (belief @ np.linalg.matrix_power(self.step, steps)).reshape(self.states, self.ages).sum(1)


def duration_filter(df: DataFrame, ep: str, q: str, word: str, names: list[str], transition, emission, hazard, ahead: int = 3) -> DataFrame:
    """(ep, state, age, evidence, forecast): likeliest state, mean age and log evidence at each episode's end, and the likeliest state some steps on.

    Words that are null or have no name tell nothing.
    """
    ship(df.sparkSession)
    chain = DurationChain(*(np.asarray(x, float) for x in (transition, emission, hazard)))
    index = {w: i for i, w in enumerate(names)}

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        belief, evidence = chain.read([index.get(w) for w in pdf.sort_values(q)[word]])
        cells = belief.reshape(chain.states, chain.ages)
        out = (key[0], int(cells.sum(1).argmax()), float(cells.sum(0) @ np.arange(chain.ages)), evidence, int(chain.ahead(belief, ahead).argmax()))
        return pd.DataFrame([out], columns=["g", "state", "age", "evidence", "forecast"])

    kind = df.schema[ep].dataType.simpleString()
    return df.select(ep, q, word).groupBy(ep).applyInPandas(run, f"g {kind}, state int, age double, evidence double, forecast int").withColumnRenamed("g", ep)


def compressed_length(df: DataFrame, ident: str, vector: str, level: int = 9) -> DataFrame:
    """Raw DEFLATE length over size of the vector's 8-bit levels."""
    ship(df.sparkSession)

    @F.pandas_udf("double")
    def ratio(v: pd.Series) -> pd.Series:
        def one(x) -> float:
            raw = np.round(np.clip(np.asarray(x), 0, 1) * 255).astype(np.uint8).tobytes()
            z = zlib.compressobj(level, zlib.DEFLATED, -15)
            return len(z.compress(raw) + z.flush()) / max(1, len(raw))

        return v.map(one)

    return df.select(ident, ratio(vector).alias("ratio"))


#: Grid points in a kernel's width, how many of them a value reaches on either side, those of a cell of values and of a block of weights.
GRID, REACH, CELL, BLOCK = 3, 19, 16, 64
WINDOW = CELL + 2 * REACH + 1  # grid points that the values of a cell reach; less than a block, so that only neighbouring blocks meet
FEATURE = math.sqrt(1 / (GRID * math.sqrt(math.pi / 2)))


def grid_ridge(cells: dict, lam: float):
    """Weights w of (G + lam I) w = r over the grid, where cells holds each cell's part of G and r: a function from a cell to its window of w.

    Blocks are eliminated from left to right, so memory and time grow with the occupied part of the grid alone.
    """
    own, side, right = {}, {}, {}
    for cell, (g, r) in cells.items():
        k, at = divmod(cell * CELL - REACH, BLOCK)
        two, v = np.zeros((2 * BLOCK, 2 * BLOCK)), np.zeros(2 * BLOCK)
        two[at : at + WINDOW, at : at + WINDOW], v[at : at + WINDOW] = g, r
        side[k] = side.get(k, 0) + two[:BLOCK, BLOCK:]
        for j, part in ((k, slice(0, BLOCK)), (k + 1, slice(BLOCK, None))):
            own[j] = own.get(j, lam * np.eye(BLOCK)) + two[part, part]
            right[j] = right.get(j, 0) + v[part]
    order = sorted(own)
    for k in order:
        if k - 1 in side:
            carry = np.linalg.solve(own[k - 1], np.column_stack((side[k - 1], right[k - 1])))
            own[k] = own[k] - side[k - 1].T @ carry[:, :-1]
            right[k] = right[k] - side[k - 1].T @ carry[:, -1]
    w: dict = {}
    for k in reversed(order):
        w[k] = np.linalg.solve(own[k], right[k] - side[k] @ w[k + 1] if k in side else right[k])
    none = np.zeros(BLOCK)

    def window(cell: int) -> np.ndarray:
        k, at = divmod(cell * CELL - REACH, BLOCK)
        return np.concatenate((w.get(k, none), w.get(k + 1, none)))[at : at + WINDOW]

    return window


def kernel_ridge_loco(df: DataFrame, group: str, fold: str, x: str, y: str, lam: float = 1.0, width: float = 1.0) -> DataFrame:
    """Predictions of each fold from the group's other folds, by kernel ridge on a scalar.

    No kernel matrix is formed. A Gaussian kernel is the integral of two narrower ones around a point between, and its
    sum over a grid of a third of the width is that integral to 5e-20 of itself; so the kernel is the product of
    features, one for each grid point, and the dual solution is that of a ridge over them. A cell of values reaches
    WINDOW grid points: each group, fold and cell adds up sums of that size, row by row, and a group solves its folds
    from these. A fold that is trained on a missing value (null, infinite, or beyond 1e12 widths) gets NULL, as does a
    row without a fold or value.
    """
    from itertools import groupby

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(df.sparkSession)
    kg, kf = df.schema[group].dataType.simpleString(), df.schema[fold].dataType.simpleString()
    kinds = StructType.fromDDL(f"g {kg}, fold {kf}, cell long, n long, bad long, s double, p array<double>, r array<double>, o array<double>")
    schema = to_arrow_schema(kinds)

    def add(batches):
        held, sums = None, None

        def row():
            n, bad, s, p, r, o = sums
            return pa.record_batch([pa.array([v], f.type) for v, f in zip((*held, n, bad, s, p.tolist(), r.tolist(), o.ravel().tolist()), schema)], schema=schema)

        for b in batches:
            u, t, wrong = (b.column(n).to_numpy(zero_copy_only=False) for n in ("u", "y", "wrong"))
            at = 0
            for key, rows in groupby(zip(*(b.column(n).to_pylist() for n in ("g", "fold", "cell")))):
                low, at = at, at + sum(1 for _ in rows)
                if key != held:
                    if held is not None:
                        yield row()
                    held, sums = key, [0, 0, 0.0, np.zeros(WINDOW), np.zeros(WINDOW), np.zeros((WINDOW, WINDOW))]
                good = ~wrong[low:at].astype(bool)
                v, z = u[low:at][good], t[low:at][good]
                f = FEATURE * np.exp(-((v[:, None] - (key[2] * CELL - REACH + np.arange(WINDOW)) / GRID) ** 2))
                for i, part in enumerate((len(v), at - low - len(v), z.sum(), f.sum(0), z @ f, f.T @ f)):
                    sums[i] = sums[i] + part
        if held is not None:
            yield row()

    def solve(key, pdf: pd.DataFrame) -> pd.DataFrame:
        folds: dict = {}
        for f, cell, n, bad, s, p, r, o in zip(*(pdf[c] for c in ("fold", "cell", "n", "bad", "s", "p", "r", "o"))):
            of = folds.setdefault(None if pd.isna(f) else f, [0, 0, 0.0, {}])
            for i, part in enumerate((n, bad, s)):
                of[i] += part
            if n:
                was = of[3].get(cell, (0, 0, 0))
                of[3][cell] = tuple(a + b for a, b in zip(was, (np.asarray(p), np.asarray(r), np.asarray(o).reshape(WINDOW, WINDOW))))
        out = []
        for f in folds:
            others = [of for other, of in folds.items() if other != f]
            n = sum(of[0] for of in others)
            if f is None or not n or any(of[1] for of in others):
                continue
            mean, cells = sum(of[2] for of in others) / n, {}
            for of in others:
                for cell, (p, r, o) in of[3].items():
                    g, v = cells.get(cell, (0, 0))
                    cells[cell] = (g + o, v + r - mean * p)
            window = grid_ridge(cells, lam)
            near = {c + d for c in cells for d in range(-(WINDOW // CELL), WINDOW // CELL + 1)}
            out += [(key[0], f, None, mean, None), *((key[0], f, c, mean, window(c).tolist()) for c in near)]
        return pd.DataFrame(out, columns=["g", "fold", "cell", "mean", "w"]).astype({"cell": "Int64"})

    u = F.col("x") / width
    fine = F.col("x").isNotNull() & (F.abs(u) < 1e12)
    rows = df.select(F.col(group).alias("g"), F.col(fold).alias("fold"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).withColumn("cell", F.when(fine, F.floor(u * GRID / CELL)))
    taught = rows.select("g", "fold", F.coalesce("cell", F.lit(0)).alias("cell"), F.coalesce(u, F.lit(0.0)).alias("u"), F.coalesce("y", F.lit(0.0)).alias("y"), (~F.coalesce(fine & (F.abs("y") < float("inf")), F.lit(False))).alias("wrong"))
    sums = taught.repartition("g", "fold", "cell").sortWithinPartitions("g", "fold", "cell").mapInArrow(add, kinds)
    fits = sums.groupBy("g").applyInPandas(solve, f"g {kg}, fold {kf}, cell long, mean double, w array<double>")
    fits = fits.select(F.col("g").alias("_g"), F.col("fold").alias("_fold"), F.col("cell").alias("_cell"), "mean", "w")
    same = F.col("g").eqNullSafe(F.col("_g")) & (F.col("fold") == F.col("_fold"))
    means = rows.join(fits.where("_cell is null").drop("_cell", "w"), same, "left").drop("_g", "_fold")
    near = means.join(fits.where("_cell is not null").drop("mean"), same & (F.col("cell") == F.col("_cell")), "left")
    part = F.transform("w", lambda w, i: w * FEATURE * F.exp(-F.pow(u - (F.col("cell") * CELL - REACH + i) / F.lit(float(GRID)), F.lit(2))))
    value = F.when(F.col("x").isNotNull() & ~F.isnan("x"), F.col("mean") + F.coalesce(F.aggregate(part, F.lit(0.0), lambda a, t: a + t), F.lit(0.0)))
    return near.select(F.col("g").alias(group), F.col("fold").alias(fold), F.col("x").alias(x), F.col("y").alias(y), value.alias("predicted"))
