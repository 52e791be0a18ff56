"""Centroid clustering: exact integer Lloyd rounds that send changes only (delta Lloyd).

Vectors become integers once. A round's table holds each vector with its owner and its distance to it, and is written to
the shared folder. In the next round a vector whose owner stayed where it was is compared with the centroids that moved
and with nothing else: all others are as far as before. Only vectors whose owner moved meet all centroids. Each vector that changes
owner gives one signed transfer to either side; the sums of a centroid are carried over and the transfers added, in integers, so that
they equal the sums over all its vectors. A round without transfers ends the rounds: nothing could change any more.
What the driver holds are k centroids and their sums.

Edge cases: vectors that are null, of another length, or with null or non-finite components are left out. A null id
counts as the empty text in the order that picks the first centroids; equal ids are ordered by their vectors. Repeated
rows count each. With fewer vectors than k there are as many centroids as vectors. Components beyond +-2^27 after scaling
are set to that bound, so that distances stay within 64 bits; sums of distances beyond 64 bits are set to the largest
long. An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, small_batches, table, written

#: Largest magnitude of a component; products of components below the second bound are exact in doubles.
MOST, EXACT = 1 << 27, 1 << 22
_NOBODY = -1


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(values * float(scale)), -MOST, MOST).astype(np.int64)


def flat(column, dims: int) -> np.ndarray:
    """A list column, all of whose lists have dims items, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def lists(matrix: np.ndarray) -> pa.Array:
    n, dims = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dims), pa.array(matrix.ravel().astype(np.int32)))


def vectors(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """id, v (integers) of the rows with dims finite components, owned by nobody."""
    import pyarrow.compute as pc

    small_batches(df.sparkSession)

    def run(batches):
        for b in batches:
            b = b.filter(pc.fill_null(pc.equal(pc.list_value_length(b.column(1)), dims), False))
            x = flat(b.column(1).cast(pa.list_(pa.float64())), dims)
            good = np.isfinite(x).all(1)
            v = integers(x[good], scale)
            none = np.full(len(v), _NOBODY)
            yield pa.record_batch([b.column(0).filter(pa.array(good)), lists(v), pa.array(none, pa.int32()), pa.array(none, pa.int32()), pa.array(none, pa.int64())], names=["id", "v", "was", "owner", "distance"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, vector_col).mapInArrow(run, f"id {kind}, v array<int>, was int, owner int, distance long")


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of each of v to each of c, exact."""
    if not len(v) or not len(c):
        return np.zeros((len(v), len(c)), np.int64)
    if max(np.abs(v).max(), np.abs(c).max()) < EXACT:
        x, y = v.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)).astype(np.int64)
    return np.stack([((v - one) ** 2).sum(1) for one in c], 1)


def nearest(v: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner (smaller number in ties) and distance of each vector, after the centroids in moved (rising numbers) have changed."""
    owner, distance = owner.astype(np.int64), distance.copy()
    free = (owner == _NOBODY) | np.isin(owner, moved)
    d = squared(v[free], centroids)
    if d.size:
        owner[free] = d.argmin(1)
        distance[free] = d.min(1)
    d = squared(v[~free], centroids[moved])
    if d.size:
        who, far = moved[d.argmin(1)], d.min(1)
        own, was = owner[~free], distance[~free]
        better = (far < was) | (far == was) & (who < own)
        owner[~free] = np.where(better, who, own)
        distance[~free] = np.where(better, far, was)
    return owner, distance


def reassigned(state: DataFrame, centroids: np.ndarray, moved: np.ndarray) -> DataFrame:
    """state after one assignment."""
    dims = centroids.shape[1]

    def run(batches):
        for b in batches:
            v = flat(b.column(1), dims).astype(np.int64)
            was = b.column(3).to_numpy(zero_copy_only=False)
            owner, distance = nearest(v, was, b.column(4).to_numpy(zero_copy_only=False), centroids, moved)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(was, pa.int32()), pa.array(owner, pa.int32()), pa.array(distance, pa.int64())], names=["id", "v", "was", "owner", "distance"])

    return state.mapInArrow(run, state.schema)


def transfers(state: DataFrame, dims: int) -> dict[int, tuple[int, list[int]]]:
    """Signed count and signed sum of the vectors that each centroid has gained and lost; one row for each centroid."""
    side = lambda who, sign: F.struct(F.col(who).alias("c"), F.lit(sign).cast("long").alias("sign"))
    rows = (
        state.where("owner <> was")
        .select("v", F.explode(F.array(side("owner", 1), side("was", -1))).alias("t"))
        .where(F.col("t.c") != _NOBODY)
        .groupBy(F.col("t.c").alias("c"))
        .agg(F.sum("t.sign").alias("n"), F.array(*[F.sum(F.col("v")[k] * F.col("t.sign")) for k in range(dims)]).alias("s"))
        .collect()
    )
    return {r["c"]: (r["n"], r["s"]) for r in rows}


def first_centroids(state: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    rows = state.select(F.sha2(name, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def cluster(df: DataFrame, id_col: str, vector_col: str, k: int, rounds: int, dims: int, scale: int = 256, seed: int = 2) -> tuple[DataFrame, np.ndarray]:
    """(id, v, owner and distance of each vector; the centroids) after so many rounds and a last assignment."""
    state = written(vectors(df, id_col, vector_col, dims, scale), "vectors")
    centroids = first_centroids(state, k, seed)
    if not len(centroids):
        return state, np.zeros((0, dims), np.int64)
    counts, sums = [0] * len(centroids), [[0] * dims for _ in centroids]
    moved = np.arange(len(centroids))
    for turn in range(rounds + 1):
        before, state = state, written(reassigned(state, centroids, moved), "assigned")
        removed(before)
        if turn == rounds:
            break
        for c, (n, s) in transfers(state, dims).items():
            counts[c] += n
            sums[c] = [x + y for x, y in zip(sums[c], s)]
        old = centroids
        centroids = np.array([[x // n for x in s] if n else old[c].tolist() for c, (n, s) in enumerate(zip(counts, sums))], np.int64)
        moved = np.flatnonzero((centroids != old).any(1))
        if not len(moved):
            break
    return state, centroids


def described(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, the sums of distances and the digest of its centroid, of each vector."""
    spark, most = state.sparkSession, (1 << 63) - 1
    got = state.groupBy("owner").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("d")).collect()  # a row for each centroid
    inertia = min(sum(int(r["d"]) for r in got), most)
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    rows = [(r["owner"], min(int(r["d"]), most), inertia, digest(centroids[r["owner"]].tolist())) for r in got]
    about = spark.createDataFrame(rows, "owner int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(about), "owner").select(F.col("id").alias("vec_id"), F.col("owner").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    return described(*cluster(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", k=40, rounds=5, dims=64))


def _sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """DuckDB SQL: every round over all vectors and centroids."""
    parts = [
        f"x AS (SELECT row_number() OVER () AS r, vec_id, [floor(256 * e::DOUBLE)::BIGINT for e in embedding] AS v FROM embeddings WHERE len(embedding) = {dims} AND len([e for e in embedding if e IS NULL OR NOT isfinite(e)]) = 0)",
        "vd AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM x)",
        f"c0 AS MATERIALIZED (SELECT c, unnest(v) AS y, generate_subscripts(v, 1) AS j FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM x) WHERE c < {k})",
    ]
    for t in range(rounds + 1):
        parts.append(f"a{t} AS MATERIALIZED (SELECT r, c, d FROM (SELECT r, c, sum((x - y) * (x - y)) AS d FROM vd JOIN c{t} USING (j) GROUP BY r, c) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if t < rounds:
            parts.append(f"n{t} AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM a{t} JOIN vd USING (r) GROUP BY c, j)")
            parts.append(f"c{t + 1} AS MATERIALIZED (SELECT c, j, coalesce(((s - ((s % n) + n) % n) // n)::BIGINT, y) AS y FROM c{t} LEFT JOIN n{t} USING (c, j))")
    parts.append(f"h AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY c)")
    return (
        "WITH " + ", ".join(parts) + f" SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,"
        f" (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{rounds} JOIN x USING (r) JOIN h USING (c)"
    )


SQL = _sql()
