"""Family-wise permutation tests whose draws are vectors: rows are never copied for a draw.

A draw's labels and signs follow from a hash of (seed, draw, unit), so any task can make those of its own rows. Under a
shuffle within a group the units of the lowest hashes are the positive ones, as many as the group has; a group's limits,
one for each draw, are all that its rows need. Each task adds up vectors with a place for each draw, and vectors of equal
keys are added on their way: what is shuffled are keys times tasks, whatever the number of draws.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..runtime import ship
from .stats import average_rank

#: Fixed values of the hash: a linear congruence, then its fifth power, which is one to one below the modulus.
MODULUS, STEP, TERM = 2_147_483_647, 48_271, 69_621
#: Keys that a task holds before it hands their vectors on.
HELD = 2_000
#: Values of the matrices (rows by draws) that a task works on at once.
CELLS = 1 << 21


def arrow(schema: StructType) -> list[pa.DataType]:
    """Arrow types of a schema's columns: numbers and texts of keys keep their own."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return [f.type for f in to_arrow_schema(schema)]


def hashed(seed: int, draws: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Hashes of units (rows) in draws (columns), different for different units below the modulus."""
    h = (12345 * STEP + seed % MODULUS * TERM + 11) % MODULUS
    d = (h * STEP + draws % MODULUS * TERM + 11) % MODULUS
    x = ((d * STEP)[None, :] + (units % MODULUS * TERM)[:, None] + 11) % MODULUS
    two = x * x % MODULUS
    return two * two % MODULUS * x % MODULUS


def added(df: DataFrame, keys: list[str], vectors: list[str]) -> DataFrame:
    """Sums of list columns (of one length) by key: partial sums in each task, then one merge of sorted rows."""
    ship(df.sparkSession)
    schema = df.select(*keys, *vectors).schema
    kinds = arrow(schema)

    def emit(sums: dict):
        if sums:
            names, values = list(sums), list(sums.values())
            columns = [pa.array([k[i] for k in names], kinds[i]) for i in range(len(keys))] + [pa.array([v[i] for v in values], pa.list_(pa.float64())) for i in range(len(vectors))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, *vectors])

    def run(batches, sorted_rows: bool):
        sums: dict = {}
        for b in batches:
            rows = list(zip(*(b.column(k).to_pylist() for k in keys)))
            parts = [b.column(v).flatten().to_numpy().reshape(b.num_rows, -1) if b.num_rows else [] for v in vectors]
            for i, key in enumerate(rows):
                if key not in sums:
                    if len(sums) >= (1 if sorted_rows else HELD):
                        yield from emit(sums)
                        sums = {}
                    sums[key] = [p[i].copy() for p in parts]
                else:
                    for s, p in zip(sums[key], parts):
                        s += p[i]
        yield from emit(sums)

    once = df.select(*keys, *vectors).mapInArrow(lambda b: run(b, False), schema)
    return once.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda b: run(b, True), schema)


def shuffle_limits(units: DataFrame, unit: str, label: str, group: str, n: int, seed: int) -> DataFrame:
    """(group, limits): for each draw the hash up to which a group's units are positive. A group's ids are held by one task, 8 bytes each."""
    ship(units.sparkSession)
    draws, own_kind = np.arange(1, n + 1), arrow(units.select(group).schema)[0]

    def limits(ids: list[np.ndarray], positives: int) -> list[int]:
        every = np.concatenate(ids)
        if not positives:
            return [-1] * n
        out, step = [], max(1, CELLS // len(every))
        for low in range(0, n, step):
            h = hashed(seed, draws[low : low + step], every)
            out += np.partition(h, positives - 1, axis=0)[positives - 1].tolist()
        return out

    def run(batches):
        held, ids, positives = None, [], 0
        for b in batches:
            groups, own, y = b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2).to_numpy()
            edges = [0, *(i for i in range(1, len(groups)) if groups[i] != groups[i - 1]), len(groups)]
            for low, high in zip(edges, edges[1:]):
                if high == low:
                    continue
                if ids and groups[low] != held:
                    yield pa.record_batch([pa.array([held], own_kind), pa.array([limits(ids, positives)])], names=["g", "limits"])
                    ids, positives = [], 0
                held = groups[low]
                ids.append(own[low:high])
                positives += int(y[low:high].sum())
        if ids:
            yield pa.record_batch([pa.array([held], own_kind), pa.array([limits(ids, positives)])], names=["g", "limits"])

    kind = units.schema[group].dataType.simpleString()
    rows = units.select(F.col(group).alias("g"), F.col(unit).cast("long").alias("u"), F.col(label).cast("int").alias("y")).distinct()
    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(run, f"g {kind}, limits array<long>")


def _p_values(stats: DataFrame, keys: list[str], distance: Callable[[Column], Column]) -> DataFrame:
    """(keys, observed, p): stats hold a vector of a cell's statistic, the observed one first; cells are few."""
    cells = stats.where(F.get("stat", F.lit(0)).isNotNull())
    each = stats.select(*keys, F.posexplode("stat").alias("draw", "s")).where("draw > 0 AND s IS NOT NULL")
    top = each.groupBy("draw").agg(F.max(distance(F.col("s"))).alias("t")).agg(F.collect_list("t").alias("tops"))  # one row of n numbers
    seen = F.get("stat", F.lit(0))
    beyond = F.size(F.filter("tops", lambda t: t >= distance(F.col("observed")) - 1e-12))
    return cells.select(*keys, seen.alias("observed")).crossJoin(F.broadcast(top)).select(*keys, "observed", ((beyond + 1) / (F.size("tops") + 1)).alias("p"))


def label_maxt(rows: DataFrame, unit: str, label: str, group: str, cell: str, stratum: str, value: str, n: int, seed: int = 7) -> DataFrame:
    """(cell, observed AUC pooled over strata by pairs, p against the largest deviation of any cell), labels shuffled among the units of a group.

    rows: a unit (a whole number), its 0/1 label and group, and a value of some cell in some stratum. NULL values are left out.
    """
    rows = rows.where(F.col(value).isNotNull())
    limits = shuffle_limits(rows, unit, label, group, n, seed).select(F.col("g").alias("_g"), "limits")
    ranked = rows.select(F.col(group).alias("_g"), F.col(unit).cast("long").alias("_u"), F.col(label).cast("int").alias("_y"), F.col(cell).alias("_c"), F.col(stratum).alias("_s"), average_rank(value, cell, stratum).alias("_r"))
    mixed = ranked.unionByName(limits, allowMissingColumns=True)
    mixed = mixed.repartition("_g").sortWithinPartitions("_g", F.col("limits").isNull()).select("_g", "_u", "_y", "_c", "_s", "_r", "limits")
    kinds = f"_c {rows.schema[cell].dataType.simpleString()}, _s {rows.schema[stratum].dataType.simpleString()}, ranks array<double>, positives array<double>, n array<double>"
    draws, own = np.arange(1, n + 1), arrow(rows.select(cell, stratum).schema)

    def run(batches):
        edge = None
        for b in batches:
            names = [b.column(k).to_pylist() for k in (3, 4)]
            unit_ids, y, rank, bounds = (b.column(k) for k in (1, 2, 5, 6))
            at, spans = 0, []
            for i in [*np.flatnonzero(bounds.is_valid().to_numpy(zero_copy_only=False)).tolist(), b.num_rows]:
                spans.append((at, i))
                at = i
            for low, high in spans:
                if low < high and bounds[low].is_valid:
                    edge, low = np.array(bounds[low].as_py()), low + 1
                if low == high:
                    continue
                step = max(1, CELLS // (n + 1))
                for a in range(low, high, step):
                    z = min(high, a + step)
                    drawn = hashed(seed, draws, unit_ids.slice(a, z - a).to_numpy()) <= edge
                    labels = np.concatenate((y.slice(a, z - a).to_numpy()[:, None], drawn), 1).astype(float)
                    r = rank.slice(a, z - a).to_numpy()
                    where: dict = {}
                    for i, key in enumerate(zip(names[0][a:z], names[1][a:z])):
                        where.setdefault(key, []).append(i)
                    columns = [[r[i] @ labels[i] for i in where.values()], [labels[i].sum(0) for i in where.values()], [[float(len(i))] for i in where.values()]]
                    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in where], own[0]), pa.array([k[1] for k in where], own[1]), *(pa.array(c, pa.list_(pa.float64())) for c in columns)], names=["_c", "_s", "ranks", "positives", "n"])

    ship(rows.sparkSession)
    strata = added(mixed.mapInArrow(run, kinds), ["_c", "_s"], ["ranks", "positives", "n"])
    size = F.get("n", F.lit(0))
    wins = F.zip_with("ranks", "positives", lambda r, k: r - k * (k + 1) / 2)
    pairs = F.transform("positives", lambda k: k * (size - k))
    cells = added(strata.select("_c", wins.alias("wins"), pairs.alias("pairs")), ["_c"], ["wins", "pairs"])
    stats = cells.select(F.col("_c").alias(cell), F.zip_with("wins", "pairs", lambda w, k: F.when(k > 0, w / k)).alias("stat"))
    return _p_values(stats, [cell], lambda s: F.abs(s - 0.5))


def sign_flip_maxt(effects: DataFrame, value: str, group: str, cell: str, n: int, seed: int = 7, weight: str | None = None, studentised: bool = True) -> DataFrame:
    """(cell, observed statistic, p against the largest of any cell), a group's signs flipped in all its cells at once.

    The statistic is the (weighted) mean effect, or studentised: over its standard error under the same signs. Groups are
    whole numbers; NULL effects are left out. A cell without spread has no studentised statistic.
    """
    ship(effects.sparkSession)
    w = (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w")
    rows = effects.where(F.col(value).isNotNull()).select(F.col(cell).alias("_c"), F.col(group).cast("long"), F.col(value).cast("double"), w)
    draws, own = np.arange(1, n + 1), arrow(effects.select(cell).schema)[0]

    def run(batches):
        for b in batches:
            names, units, e, k = b.column(0).to_pylist(), *(b.column(i).to_numpy() for i in (1, 2, 3))
            step = max(1, CELLS // (n + 1))
            for low in range(0, b.num_rows, step):
                part = slice(low, low + step)
                signs = np.concatenate((np.ones((len(e[part]), 1)), 1.0 - 2 * (hashed(seed, draws, units[part]) // 1024 % 2)), 1)
                where: dict = {}
                for i, c in enumerate(names[part]):
                    where.setdefault(c, []).append(i)
                columns = [[(k[part][i] * e[part][i]) @ signs[i] for i in where.values()], [[k[part][i].sum(), (k[part][i] ** 2).sum(), (k[part][i] * e[part][i] ** 2).sum()] for i in where.values()]]
                yield pa.RecordBatch.from_arrays([pa.array(list(where), own), *(pa.array(c, pa.list_(pa.float64())) for c in columns)], names=["_c", "sums", "own"])

    kind = effects.schema[cell].dataType.simpleString()
    cells = added(rows.mapInArrow(run, f"_c {kind}, sums array<double>, own array<double>"), ["_c"], ["sums", "own"])
    total, squares, power = (F.get("own", F.lit(i)) for i in range(3))

    def statistic(s: Column) -> Column:
        mean = s / total
        if not studentised:
            return mean
        error = F.sqrt(F.greatest(power / total - mean * mean, F.lit(0.0)) * squares / (total * total))
        return F.when(error > 1e-12, mean / error)

    stats = cells.select(F.col("_c").alias(cell), F.transform("sums", statistic).alias("stat"))
    return _p_values(stats, [cell], F.abs)
