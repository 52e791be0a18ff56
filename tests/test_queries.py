"""Every query with SQL gives the rows that DuckDB gives; the others give rows."""

import math

import duckdb
import pytest

from episodica import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan" if math.isnan(v) else f"{v + 0.0:.9g}")
    if isinstance(v, (list, tuple)):
        return (1, str([plain(x) for x in v]))
    return (1, str(v))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    want = duck.sql(catalog.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_gives_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_effective_rank_is_of_whole_groups(spark, duck):
    import numpy as np

    from episodica.operators.models import effective_rank

    got = {r["label"]: r for r in catalog.queries()["effective_rank"](spark, SF).collect()}
    groups = duck.sql("SELECT label, list(embedding ORDER BY vec_id) FROM embeddings GROUP BY label").fetchall()
    assert len(got) == len(groups) and max(len(vs) for _, vs in groups) > 11
    for label, vs in groups:
        e, s = effective_rank(np.array(vs, float))
        assert got[label]["n"] == len(vs)
        assert (got[label]["effective"], got[label]["stable"]) == pytest.approx((e, s), abs=2e-5)


def test_pca_whitening_gives_all_components(spark, duck):
    import numpy as np

    rows = catalog.queries()["pca_whitening"](spark, SF).collect()
    x = np.array([r["components"] for r in rows])
    assert x.shape[1] > 1 and len(rows) == duck.sql("SELECT count(*) FROM embeddings").fetchall()[0][0]
    assert np.allclose(x.T @ x / len(x), np.eye(x.shape[1]), atol=1e-4) and np.allclose(x.mean(0), 0, atol=1e-5)
    assert [r["first_component"] for r in rows] == x[:, 0].tolist()


def test_mahalanobis_is_shrunk_as_ledoit_and_wolf_define(spark, duck):
    import numpy as np

    x = {i: v for i, v in duck.sql("SELECT vec_id, embedding FROM embeddings").fetchall()}
    m = np.array([x[i] for i in sorted(x)], float)
    c = m - m.mean(0)
    n, p = c.shape
    cov = c.T @ c / n
    mu = np.trace(cov) / p
    far, noise = ((cov - mu * np.eye(p)) ** 2).sum(), sum(((np.outer(r, r) - cov) ** 2).sum() for r in c) / n**2
    share = min(noise, far) / far
    inverse = np.linalg.inv((1 - share) * cov + share * mu * np.eye(p))
    want = dict(zip(sorted(x), np.einsum("ij,jk,ik->i", c, inverse, c) / p))
    for r in catalog.queries()["mahalanobis_density"](spark, SF).collect():
        assert r["distance"] == pytest.approx(want[r["vec_id"]], abs=2e-6)


def test_json_is_safe(spark, duck):
    import json

    want = dict(duck.sql("SELECT event_id, CASE WHEN value <= 300 THEN value END FROM events").fetchall())
    rows = catalog.queries()["json_safe_encode"](spark, SF).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert json.loads(r["json"]) == {"event_id": r["event_id"], "value": want[r["event_id"]]}


def test_compressed_length_and_kernel_ridge(spark, duck):
    import numpy as np

    rows = catalog.queries()["compressed_length"](spark, SF).collect()
    assert len(rows) == duck.sql("SELECT count(*) FROM embeddings").fetchall()[0][0] and all(0 < r["ratio"] < 2 for r in rows)
    cells = duck.sql("SELECT c_nationkey, c_custkey % 4, c_acctbal / 1000, (c_custkey % 7)::DOUBLE FROM customer").fetchall()
    got = {}
    for r in catalog.queries()["kernel_ridge_loco"](spark, SF).collect():
        got.setdefault((r["c_nationkey"], r["fold"], r["x"]), []).append(r["predicted"])
    g = next(g for g, *_ in cells if len({f for h, f, *_ in cells if h == g}) > 1)
    own = [(f, x, y) for h, f, x, y in cells if h == g]
    for f, x, _ in own:
        a, b = np.array([c[1] for c in own if c[0] != f]), np.array([c[2] for c in own if c[0] != f])
        k = np.exp(-((a[:, None] - a) ** 2) / 2)
        want = np.exp(-((x - a) ** 2) / 2) @ np.linalg.solve(k + np.eye(len(a)), b - b.mean()) + b.mean()
        assert min(abs(p - want) for p in got[g, f, round(x, 6)]) < 1e-5


def test_table_fingerprint_ignores_order_and_sees_changes(spark):
    from episodica.sources import io

    t = spark.read.parquet(f"{SF}/nation.parquet")
    one = io.table_hash(t).head()
    assert io.table_hash(t.orderBy("n_name")).head() == one == catalog.queries()["table_fingerprint"](spark, SF).head()
    assert io.table_hash(t.where("n_nationkey > 0")).head() != one


@pytest.fixture(scope="session")
def short(tmp_path_factory):
    """The vectors with episodes of one, two and three steps behind them, and a connection that reads them."""
    d = str(tmp_path_factory.mktemp("short"))
    con = duckdb.connect()
    new = "(SELECT vec_id + 250000 * (1 + label) AS vec_id, embedding, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM src) WHERE r <= 1 + label % 3)"
    con.sql(f"CREATE TABLE embeddings AS WITH src AS (SELECT vec_id, embedding, label FROM '{SF}/embeddings.parquet') SELECT * FROM src UNION ALL SELECT * FROM {new}")
    con.sql(f"COPY embeddings TO '{d}/embeddings.parquet'")
    return d, con


@pytest.mark.parametrize("name", ["leave_one_out_distance", "self_reference_collapse", "cold_start_monitor"])
def test_same_rows_as_sql_with_short_episodes(spark, short, name):
    d, con = short
    df, want = catalog.queries()[name](spark, d), con.sql(catalog.oracle_sql()[name])
    got = sorted(tuple(plain(r[c]) for c in want.columns) for r in df.collect())
    assert got == sorted(tuple(map(plain, r)) for r in want.fetchall())


@pytest.mark.parametrize("block", [1, 7, 40, 25_000])
@pytest.mark.parametrize("name", ["path_speed", "route_acceleration", "velocity_turn", "layer_disagreement", "conditional_graph", "perturbation_response"])
def test_whole_labels(spark, short, duck, monkeypatch, name, block):
    """Results of whole labels do not depend on the blocks of ids in which they are ordered."""
    from episodica.plans import common

    monkeypatch.setattr(common, "BLOCK", block)
    d, con = short
    want = con.sql(catalog.oracle_sql()[name])
    got = sorted(tuple(plain(r[c]) for c in want.columns) for r in catalog.queries()[name](spark, d).collect())
    assert got == sorted(tuple(map(plain, r)) for r in want.fetchall())


def test_paths_are_of_whole_labels(spark, duck):
    """As many steps as vectors but one (two) for each label, and every member but the first, over all sites of four."""
    sizes = dict(duck.sql("SELECT label, count(*) FROM embeddings GROUP BY label").fetchall())
    rows = {r["label"]: r for r in catalog.queries()["path_speed"](spark, SF).collect()}
    assert {k: round(r["path"] / r["speed"]) for k, r in rows.items()} == {k: n - 1 for k, n in sizes.items()}
    assert set(sizes) == {r["label"] for r in catalog.queries()["route_acceleration"](spark, SF).collect()}
    assert catalog.queries()["velocity_turn"](spark, SF).count() == sum(n - 2 for n in sizes.values())
    assert {r["label"]: r["pairs"] for r in catalog.queries()["layer_disagreement"](spark, SF).collect()} == {k: n // 4 * 6 + math.comb(n % 4, 2) for k, n in sizes.items()}
    assert set(sizes) == {r["label"] for r in catalog.queries()["conditional_graph"](spark, SF).collect()}
    assert set(sizes) == {r["label"] for r in catalog.queries()["perturbation_response"](spark, SF).collect()}
