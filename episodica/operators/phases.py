"""Models of healthy behaviour by task and phase, with back-off from a cell to its task to all rows.

Everything is fitted from moments that add up: rows, sums, products, and the two fourth-order sums of the shrinkage. A task
adds up those of its own rows by cell; a task's model comes from the sums of its cells, the overall one from all. Models
are worked out where their moments are; rows meet them by join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship
from . import windows as W
from .maxt import added, arrow


def keyed_moments(df: DataFrame, keys: list[str], vector: str, dims: int, held: int = 2_000) -> DataFrame:
    """(keys, m): for each key rows, sum of |x|^2 and |x|^4, sum of x, of |x|^2 x, and of products. Rows without a whole vector are left out."""
    ship(df.sparkSession)
    whole = (F.size(vector) == dims) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    rows = df.where(whole).select(*keys, F.col(vector).cast("array<double>").alias("_v"))
    schema = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), "m array<double>"])
    own = arrow(df.select(*keys).schema) if keys else []

    def emit(sums: dict):
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in sums], own[i]) for i in range(len(keys))), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=[*keys, "m"])

    def run(batches):
        sums: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(len(keys)).flatten().to_numpy().reshape(-1, dims)
            where: dict = {}
            for i, key in enumerate(zip(*(b.column(k).to_pylist() for k in range(len(keys)))) if keys else [()] * b.num_rows):
                where.setdefault(key, []).append(i)
            for key, at in where.items():
                v = x[at]
                a = (v * v).sum(1)
                m = np.concatenate(([len(v), a.sum(), (a * a).sum()], v.sum(0), a @ v, (v.T @ v).ravel()))
                if key in sums:
                    sums[key] += m
                else:
                    if len(sums) >= held:
                        yield from emit(sums)
                        sums = {}
                    sums[key] = m
        if sums:
            yield from emit(sums)

    return added(rows.mapInArrow(run, schema), keys, ["m"]) if keys else added(rows.mapInArrow(run, schema).withColumn("_all", F.lit(0)), ["_all"], ["m"])  # a row for each task


def parts_of(m: np.ndarray, dims: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(rows, mean, covariance) of moments."""
    n, mean = m[0], m[3 : 3 + dims] / m[0]
    return n, mean, m[3 + 2 * dims :].reshape(dims, dims) / n - np.outer(mean, mean)


def shrunk(m: np.ndarray, dims: int, centred: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """(mean, precision, shrinkage) by Ledoit and Wolf, from moments; centred: the mean is known to be zero."""
    n, mean, cov = parts_of(m, dims)
    if centred:
        cov, mean = cov + np.outer(mean, mean), np.zeros(dims)
    a, a2, s, ax, c = m[1], m[2], m[3 : 3 + dims], m[3 + dims : 3 + 2 * dims], mean @ mean
    products = m[3 + 2 * dims :].reshape(dims, dims)
    fourth = a2 + 4 * mean @ products @ mean + n * c * c - 4 * mean @ ax + 2 * c * a - 4 * c * mean @ s  # sum of |x - mean|^4
    mu, squares = np.trace(cov) / dims, (cov**2).sum()
    beta, delta = (fourth / n - squares) / (dims * n), (squares - 2 * mu * np.trace(cov) + dims * mu * mu) / dims
    beta = min(max(beta, 0.0), delta)
    share = 0.0 if beta <= 0 else beta / delta
    return mean, np.linalg.pinv((1 - share) * cov + share * mu * np.eye(dims), hermitian=True), share


def worked(moments: DataFrame, keys: list[str], out: str, work) -> DataFrame:
    """(keys, out columns) by a function of each key's moments, on the executors."""
    names = [c.split()[0] for c in out.split(", ")]
    kinds = ", ".join([*(f"{k} {moments.schema[k].dataType.simpleString()}" for k in keys), out])

    def run(batches):
        for b in batches:
            rows = [work(np.array(m)) for m in b.column(len(keys)).to_pylist()]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keys))), *(pa.array(list(c), pa.float64() if isinstance((c or (0.0,))[0], float) else pa.list_(pa.float64())) for c in columns)], names=[*keys, *names])

    return moments.select(*keys, "m").mapInArrow(run, kinds)


def levels(cells: DataFrame, task: str, cell: str | None) -> list[tuple[list[str], DataFrame]]:
    """Moments of cells, of tasks and of all rows; those of the wider levels are sums of the narrower ones."""
    tasks = added(cells, [task], ["m"]) if cell else cells
    every = added(tasks.withColumn("_all", F.lit(0)), ["_all"], ["m"])
    return [*([([task, cell], cells)] if cell else []), ([task], tasks), ([], every)]


def backed_off(df: DataFrame, models: list[tuple[list[str], DataFrame]], least: int, names: list[str]) -> DataFrame:
    """df with the model columns of the narrowest level that has enough rows (n), and that level's name."""
    out, kept = df, df.columns
    for k, (keys, model) in enumerate(models):
        model = (model.where(F.col("n") >= least) if k + 1 < len(models) else model).withColumnsRenamed({c: f"{c}_{k}" for c in [*names, "n"]})
        model = model.drop("_all")
        out = out.join(model, keys, "left") if keys else out.crossJoin(F.broadcast(model))  # one row
    found = [F.col(f"n_{k}").isNotNull() for k in range(len(models))]
    label = ("all",) if len(models) == 1 else ("task", "all") if len(models) == 2 else ("cell", "task", "all")

    def first(values: list[Column]) -> Column:
        c = F.when(found[0], values[0])
        for f, v in zip(found[1:], values[1:]):
            c = c.when(f, v)
        return c

    return out.select(*kept, *[first([F.col(f"{n}_{k}") for k in range(len(models))]).alias(n) for n in names], first([F.lit(x) for x in label]).alias("level"))


def phase_ridge(df: DataFrame, fit: Column, task: str, vector: str, progress: str, dims: int, alpha: float = 10.0, least: int = 64) -> DataFrame:
    """df with phase: progress (0 to 1) as a ridge of the task predicts it from the vector, or the ridge of all rows for tasks of few rows."""

    def ridge(m: np.ndarray) -> tuple:
        n, mean, cov = parts_of(m, dims + 1)
        w = np.linalg.solve(n * cov[:-1, :-1] + alpha * np.eye(dims), n * cov[:-1, -1])
        return float(n), w.tolist(), float(mean[-1] - w @ mean[:-1])

    joint = df.where(fit).select(task, F.concat(F.col(vector), F.array(F.col(progress).cast("double"))).alias("_z"))
    cells = keyed_moments(joint, [task], "_z", dims + 1)
    models = [(keys, worked(m, keys, "n double, w array<double>, b double", ridge)) for keys, m in levels(cells, task, None)]
    out = backed_off(df, models, least, ["w", "b"])
    raw = F.aggregate(F.zip_with(vector, "w", lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x) + F.col("b")
    return out.withColumn("phase", F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))).drop("w", "b", "level")


def phase_bin(phase: str, bins: int) -> Column:
    return F.least(F.greatest(F.floor(F.col(phase) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")


def form(difference: Column, precision: str, dims: int) -> Column:
    """Quadratic form of a difference with a flat matrix."""
    row = lambda i: F.aggregate(F.zip_with(F.slice(precision, i * dims + 1, dims), difference, lambda p, x: p * x), F.lit(0.0), lambda s, x: s + x)
    return sum((F.get(difference, F.lit(i)) * row(i) for i in range(dims)), F.lit(0.0))


def dynamics_density(df: DataFrame, fit: Column, task: str, vector: str, phase: str, dims: int, bins: int = 5, least: int = 64) -> DataFrame:
    """df with score: squared Mahalanobis distance over the dimension, from the healthy rows of the same task and phase bin, with shrunk covariances."""

    def gauss(m: np.ndarray) -> tuple:
        mean, precision, _ = shrunk(m, dims)
        return float(m[0]), mean.tolist(), precision.ravel().tolist()

    rows = df.withColumn("_bin", phase_bin(phase, bins))
    cells = keyed_moments(rows.where(fit), [task, "_bin"], vector, dims)
    models = [(keys, worked(m, keys, "n double, mean array<double>, precision array<double>", gauss)) for keys, m in levels(cells, task, "_bin")]
    out = backed_off(rows, models, least, ["mean", "precision"])
    away = F.zip_with(vector, "mean", lambda x, m: x - m)
    return out.withColumn("_d", away).withColumn("score", form(F.col("_d"), "precision", dims) / dims).drop("_d", "mean", "precision", "_bin")


def phase_percentile(df: DataFrame, fit: Column, task: str, x: str, phase: str, bins: int = 5, least: int = 64, name: str = "percentile") -> DataFrame:
    """df with the percentile of x among the healthy rows of its task and phase bin, of its task, or of all; support counts decide.

    A task without healthy rows takes all rows' reference.
    """
    rows = df.withColumn("_bin", phase_bin(phase, bins)).withColumn("_ref", F.coalesce(fit, F.lit(False)))
    rows = W.midranks(rows, x, "_ref", {"_p_cell": (task, "_bin"), "_p_task": (task,), "_p_all": ()})
    count = lambda *keys: F.count_if("_ref").over(Window.partitionBy(*keys))
    rows = rows.withColumn("_n_cell", count(task, "_bin")).withColumn("_n_task", count(task))
    value = F.when(F.col("_n_cell") >= least, F.col("_p_cell")).when(F.col("_n_task") > 0, F.col("_p_task")).otherwise(F.col("_p_all"))
    return rows.withColumn(name, F.when(F.col(x).isNotNull(), value)).select(*df.columns, name)


#: Edges of percentile levels and of phase velocities.
LEVELS, VELOCITIES = (0.8, 0.9, 0.95, 0.98), (-0.02, 0.02)


def healthy_return(df: DataFrame, s: W.Series, fit: Column, percentile: str, phase: str, horizon: int = 3, back: float = 0.8, dwell: float = 0.9, least: int = 32, alpha: float = 2.0) -> DataFrame:
    """df with dwell, state (level, dwell and velocity bins) and chance: how often healthy steps in such a state came back under a percentile within the horizon.

    Counts back off from the whole state to level and dwell, to the level, to all; steps nearer to the end than the horizon count nowhere.
    """
    p = F.col(percentile)
    rows = W.run_length(df, s, F.coalesce(p >= dwell, F.lit(False)), "dwell")
    velocity = F.coalesce(F.col(phase) - F.lag(phase).over(s.by), F.lit(0.0))
    bins = lambda x, edges: sum((F.when(x >= e, 1).otherwise(0) for e in edges), F.lit(0))
    rows = rows.withColumns({"level": bins(p, LEVELS), "dwell_bin": F.least(F.col("dwell"), F.lit(3)), "velocity_bin": bins(velocity, VELOCITIES)})
    future = [F.lead(p, k).over(s.by) for k in range(1, horizon + 1)]
    there = F.lead(F.lit(1), horizon).over(s.by).isNotNull()
    returned = F.greatest(*[F.coalesce((f < back).cast("int"), F.lit(0)) for f in future])
    rows = rows.withColumn("_returned", returned).withColumn("_counts", there & fit)
    keys, out = ["level", "dwell_bin", "velocity_bin"], rows
    counted = rows.where("_counts").groupBy(*keys).agg(F.count("*").alias("_t"), F.sum("_returned").alias("_r")).collect()  # at most 60 rows
    table = rows.sparkSession.createDataFrame([(*map(int, r[:3]), r["_t"], r["_r"]) for r in counted], "level int, dwell_bin int, velocity_bin int, _t long, _r long")
    for k in (3, 2, 1):
        model = table.groupBy(*keys[:k]).agg(F.sum("_t").alias(f"_t{k}"), F.sum("_r").alias(f"_r{k}"))
        out = out.join(F.broadcast(model), keys[:k], "left")
    every = table.agg(F.coalesce(F.sum("_t"), F.lit(0)).alias("_t0"), F.coalesce(F.sum("_r"), F.lit(0)).alias("_r0"))
    out = out.crossJoin(F.broadcast(every))  # one row
    chance = lambda k: (F.col(f"_r{k}") + alpha) / (F.col(f"_t{k}") + 2 * alpha)
    pick = F.when(F.col("_t3") >= least, chance(3)).when(F.col("_t2") >= least, chance(2)).when(F.col("_t1") >= least, chance(1)).otherwise(chance(0))
    return out.withColumn("chance", pick).select(*df.columns, "dwell", *keys, "chance")


def anchor_template(df: DataFrame, s: W.Series, onset: str, fit: Column, vector: str, dims: int, offsets=(-3, -2, -1, 0, 1, 2, 3), least: int = 4) -> DataFrame:
    """df with score: less the least squared Mahalanobis distance (over the dimension) to a prototype, the mean vector at an offset from the onset.

    Offsets with fewer vectors than least have no prototype; residuals from the prototypes of all offsets share one shrunk
    covariance. Episodes without an onset (negative or NULL) fit nothing.
    """
    near = df.where(fit & (F.col(onset) >= 0)).withColumn("_o", F.col(s.q) - F.col(onset)).where(F.col("_o").isin(list(offsets)))
    means = near.groupBy("_o").agg(F.count("*").alias("_n"), *[F.avg(F.get(vector, F.lit(i))).alias(f"_m{i}") for i in range(dims)]).where(F.col("_n") >= least)
    found = means.orderBy("_o").collect()  # a row for each offset
    if not found:
        raise ValueError("no offset has enough vectors")
    prototypes = means.select("_o", F.array(*[f"_m{i}" for i in range(dims)]).alias("_p"))
    rest = near.join(F.broadcast(prototypes), "_o").select(F.zip_with(vector, "_p", lambda x, m: x - m).alias("_r"))
    m = np.array(keyed_moments(rest, [], "_r", dims).head()["m"])
    _, precision, _ = shrunk(m, dims, centred=True)
    flat = F.lit(precision.ravel().tolist())
    rows, gaps = df.withColumn("_precision", flat), []
    for k, r in enumerate(found):
        rows = rows.withColumn(f"_d{k}", F.zip_with(vector, F.lit([r[f"_m{i}"] for i in range(dims)]), lambda x, m: x - m))
        gaps.append(form(F.col(f"_d{k}"), "_precision", dims) / dims)
    nearest = F.least(*gaps) if len(gaps) > 1 else gaps[0]
    return rows.withColumn("score", -nearest).select(*df.columns, "score")
