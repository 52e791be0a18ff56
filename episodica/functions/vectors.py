"""Distances, similarities and descriptors of probability and feature vectors, as column expressions.

Vectors are ARRAY<DOUBLE>; everything stays in the JVM. Distances of vectors of different length are those of the
longer one padded with NULL, which makes the result NULL: callers keep lengths equal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x)


def once(value: Column, then) -> Column:
    """then(value), the value computed once, not for every entry of an array that refers to it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def doubles(a) -> Column:
    return F.transform(_c(a), lambda x: x.cast("double"))


def normalised(a, floor: float = EPS) -> Column:
    """Negative entries to zero, then divided by the sum (at least floor)."""
    pos = F.transform(_c(a), lambda x: F.greatest(x, F.lit(0.0)))
    return once(pos, lambda p: once(F.greatest(total(p), F.lit(floor)), lambda t: F.transform(p, lambda x: x / t)))


def strict_normalised(a, size: int) -> Column:
    """As normalised, but an error unless the vector has the size, is finite and has positive mass."""
    a = _c(a)
    ok = (F.size(a) == size) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x)) & (total(a) > 0)
    return F.when(F.assert_true(ok, F.lit("not a distribution")).isNull(), normalised(a))


def rooted(a) -> Column:
    """Square-root embedding."""
    return F.transform(_c(a), F.sqrt)


def weights_of(selected) -> Column:
    """Selected top-k weights, renormalised."""
    return F.transform(_c(selected), lambda x: x / F.greatest(total(selected), F.lit(EPS)))


def densified(ids, weights, n: int) -> Column:
    """Sparse (ids, weights) as a dense vector of n entries."""
    m = F.map_from_arrays(_c(ids), _c(weights))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda e: F.coalesce(F.try_element_at(m, e), F.lit(0.0)))


def dot(a, b) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def affinity(p, q) -> Column:
    """Bhattacharyya coefficient."""
    return total(F.zip_with(_c(p), _c(q), lambda x, y: F.sqrt(x * y)))


def hellinger(p, q) -> Column:
    """Affinity form: sqrt(clip(1 - sum sqrt(pq), 0, 1))."""
    return F.sqrt(F.least(F.greatest(1 - affinity(p, q), F.lit(0.0)), F.lit(1.0)))


def hellinger_chord(p, q) -> Column:
    return F.sqrt(total(F.zip_with(_c(p), _c(q), lambda x, y: F.pow(F.sqrt(x) - F.sqrt(y), F.lit(2)))) / 2)


def hellinger_snapped(p, q, snap: float = 1e-6) -> Column:
    """Affinities within snap of one count as one."""
    return F.when(affinity(p, q) > 1 - snap, F.lit(0.0)).otherwise(hellinger(p, q))


def sparse_hellinger(ids_a, w_a, ids_b, w_b) -> Column:
    """Hellinger distance of sparse vectors; only equal ids meet."""
    mb = F.map_from_arrays(_c(ids_b), _c(w_b))
    pairs = F.zip_with(_c(ids_a), _c(w_a), lambda i, w: F.sqrt(w * F.coalesce(F.try_element_at(mb, i), F.lit(0.0))))
    return F.sqrt(F.least(F.greatest(1 - total(pairs), F.lit(0.0)), F.lit(1.0)))


def weighted_jaccard(p, q) -> Column:
    lo = total(F.zip_with(_c(p), _c(q), lambda x, y: F.least(x, y)))
    hi = total(F.zip_with(_c(p), _c(q), lambda x, y: F.greatest(x, y)))
    return lo / F.greatest(hi, F.lit(EPS))


def support_jaccard_distance(a, b) -> Column:
    n = F.size(F.array_intersect(_c(a), _c(b)))
    return 1 - n / (F.size(_c(a)) + F.size(_c(b)) - n)


def selected_jaccard(ids_a, w_a, ids_b, w_b) -> Column:
    """Weighted Jaccard of sparse weight maps."""
    m = F.map_zip_with(F.map_from_arrays(_c(ids_a), _c(w_a)), F.map_from_arrays(_c(ids_b), _c(w_b)), lambda k, x, y: F.struct(F.least(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))).alias("lo"), F.greatest(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))).alias("hi")))
    v = F.map_values(m)
    return total(F.transform(v, lambda s: s["lo"])) / F.greatest(total(F.transform(v, lambda s: s["hi"])), F.lit(EPS))


def cosine(a, b, degenerate: float = 0.0) -> Column:
    d = norm(a) * norm(b)
    return F.when(d <= 1e-8, F.lit(degenerate)).otherwise(dot(a, b) / F.greatest(d, F.lit(1e-300)))


def euclidean(a, b) -> Column:
    return F.sqrt(total(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))))


def rms(a, b) -> Column:
    return euclidean(a, b) / F.sqrt(F.size(_c(a)))


def total_variation(p, q) -> Column:
    return total(F.zip_with(_c(p), _c(q), lambda x, y: F.abs(x - y))) / 2


def entropy(p, normal: bool = False) -> Column:
    """-sum p ln p; normal: as a share of ln n."""
    h = -total(F.transform(_c(p), lambda x: x * F.ln(F.greatest(x, F.lit(EPS)))))
    return h / F.ln(F.size(_c(p)).cast("double")) if normal else h


def descending(p) -> Column:
    return F.sort_array(_c(p), asc=False)


def margin(p) -> Column:
    s = descending(p)
    return F.try_element_at(s, F.lit(1)) - F.try_element_at(s, F.lit(2))


def top_mass(p, k: int) -> Column:
    return total(F.slice(descending(p), 1, k))


def tail_mass(selected) -> Column:
    return F.least(F.greatest(1 - total(selected), F.lit(0.0)), F.lit(1.0))


def top_ids(p, k: int) -> Column:
    """Positions (from 0) of the k largest entries, largest first, of equals the first."""
    order = F.array_sort(F.transform(_c(p), lambda x, i: F.struct((-x).alias("v"), i.alias("i"))))
    return F.transform(F.slice(order, 1, k), lambda s: s["i"])


def support_boundary(p, ids) -> Column:
    """Least probability inside the stored support minus the largest outside."""
    inside = F.array_min(F.transform(_c(ids), lambda e: F.element_at(_c(p), e.cast("int") + 1)))
    outside = F.array_max(F.filter(_c(p), lambda x, i: ~F.array_contains(_c(ids), i)))
    return inside - outside


def quantised(p, bits: int) -> Column:
    """Square roots rounded to bits, squared and renormalised; nothing left becomes uniform."""
    lv = float(2**bits - 1)
    q = F.transform(_c(p), lambda x: F.pow(F.round(F.sqrt(x) * lv) / lv, F.lit(2)))
    uniform = F.transform(_c(p), lambda x: 1.0 / F.size(_c(p)))
    return once(q, lambda v: once(total(v), lambda t: F.when(t > 0, F.transform(v, lambda x: x / t)).otherwise(uniform)))


def relabelled(ids, a: int, b: int, n: int) -> Column:
    """Ids under the bijection id -> (a id + b) mod n (a odd to n a power of two)."""
    return F.transform(_c(ids), lambda e: F.pmod(e * a + b, F.lit(n)))


def resampled(path, n: int) -> Column:
    """A scalar path read at n uniform points, linearly between its own."""
    path = _c(path)
    last = (F.size(path) - 1).cast("double")

    def at(i: Column) -> Column:
        t = i * last / float(max(1, n - 1))
        lo = F.floor(t)
        u = F.element_at(path, lo.cast("int") + 1)
        v = F.element_at(path, F.least(lo + 1, last).cast("int") + 1)
        return u + (t - lo) * (v - u)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def effective_support(ids_list, n: int) -> Column:
    """Share of n ids that the arrays of an array of arrays use."""
    return F.size(F.array_distinct(F.flatten(_c(ids_list)))) / F.lit(float(n))


def count_sketch(v, buckets: int, seed: int = 7) -> Column:
    """Signed sums in buckets; bucket and sign of an entry follow from its position by a linear congruence."""
    at = F.sequence(F.lit(0), F.lit(buckets - 1))

    def bucket(b: Column) -> Column:
        hit = F.transform(_c(v), lambda x, i: F.when(F.pmod(i * 48271 + seed, F.lit(buckets)) == b, x * (1 - 2 * F.pmod(F.floor((i * 69621 + seed) / 16), F.lit(2)))).otherwise(F.lit(0.0)))
        return total(hit)

    return F.transform(at, bucket)


def slope(v) -> Column:
    """Least-squares slope of an array's values over their positions."""
    v = _c(v)
    n = F.size(v).cast("double")
    mid = (n - 1) / 2
    top = total(F.transform(v, lambda x, i: x * (i - mid)))
    return F.when(n > 1, top / (n * (n * n - 1) / 12))


def centre_of_mass(d) -> Column:
    """Mean position (from one half) of the mass of an array."""
    return total(F.transform(_c(d), lambda x, i: x * (i + F.lit(0.5)))) / F.greatest(total(d), F.lit(EPS))
