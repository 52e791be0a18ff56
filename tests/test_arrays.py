"""Array stores: round trips, pruning by chunks, foreign layouts, tags, and what failed writes leave."""

import gzip
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.operators.ranked import numbered
from episodica.sources import arrays as A


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i * 3, i % 4, [float(i), i / 7, -float(i)], i % 2 == 0) for i in range(230)]
    return numbered(spark.createDataFrame(rows, "ident long, kind int, v array<float>, even boolean").repartition(5), "ident", parts=6)


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_numbers_are_the_order_of_the_whole_table(spark, table):
    assert all(r["row"] * 3 == r["ident"] for r in table.collect()) and table.count() == 230
    odd = spark.createDataFrame([(None, 1), (5.0, 2), (5.0, 1), (None, 0)], "k double, t int")
    assert [(r["k"], r["t"]) for r in numbered(odd, "k", "t", parts=4).orderBy("row").collect()] == [(None, 0), (None, 1), (5.0, 1), (5.0, 2)]


def test_zarr_round_trip(spark, table, tmp_path):
    path = str(tmp_path / "z")
    A.write_zarr(table, path, chunk=32)
    back = A.read_zarr(spark, path)
    assert same(back.select(*table.columns), table)
    assert back.rdd.getNumPartitions() == 8 and not [f for f in (tmp_path / "z").rglob("*.part")]
    assert [r["row"] for r in A.read_zarr(spark, path, "kind", rows=(30, 70)).orderBy("row").collect()] == list(range(30, 70))
    with pytest.raises(Exception, match="there already"):
        A.write_zarr(table, path)


def test_only_the_chunks_asked_for_are_read(spark, table, tmp_path):
    path = str(tmp_path / "z")
    A.write_zarr(table, path, chunk=32)
    for name in ("kind", "ident", "v", "even"):  # all other chunks and arrays cannot be read any more
        for f in (tmp_path / "z" / name / "c").rglob("*"):
            if f.is_file() and (name != "kind" or f.name not in ("2", "3")):
                f.write_bytes(b"broken")
    r = A.read_zarr(spark, path, "kind").where("row >= 70 AND row <= 127")
    assert r.rdd.getNumPartitions() == 2
    assert [(x["row"], x["kind"]) for x in r.orderBy("row").collect()] == [(i, i % 4) for i in range(70, 128)]
    with pytest.raises(Exception):
        A.read_zarr(spark, path, "kind").collect()


def foreign(root, name, data, chunk, codecs, encoding=None, fill=0, leave=()):
    """An array as other writers lay it out: chunks along every axis, any byte order, chunks that are not there."""
    (root / name).mkdir(parents=True)
    names = [c["name"] for c in codecs]
    big = codecs[0].get("configuration", {}).get("endian") == "big"
    grid = [range(-(-n // c)) for n, c in zip(data.shape, chunk)]
    for at in np.ndindex(*map(len, grid)):
        if at in leave:
            continue
        part = np.full(chunk, fill, data.dtype)
        piece = data[tuple(slice(k * c, (k + 1) * c) for k, c in zip(at, chunk))]
        part[tuple(slice(0, n) for n in piece.shape)] = piece
        raw = part.astype(part.dtype.newbyteorder(">" if big else "<")).tobytes()
        if "zstd" in names:
            import zstandard

            raw = zstandard.ZstdCompressor().compress(raw)
        raw = gzip.compress(raw) if "gzip" in names else raw
        key = ".".join(map(str, at)) if encoding == "v2" else "c/" + "/".join(map(str, at))
        (root / name / key).parent.mkdir(parents=True, exist_ok=True)
        (root / name / key).write_bytes(raw)
    meta = {"zarr_format": 3, "node_type": "array", "shape": data.shape, "data_type": data.dtype.name, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunk}}, "codecs": codecs, "fill_value": fill, "chunk_key_encoding": {"name": encoding or "default"}}
    (root / name / "zarr.json").write_text(json.dumps(meta))


def test_foreign_layouts(spark, tmp_path):
    rng = np.random.default_rng(1)
    a, b, c = rng.random((50, 3, 4)).astype(np.float16), rng.integers(-9, 9, 50).astype(np.int16), rng.random((50, 5))
    foreign(tmp_path, "a", a, (16, 2, 4), [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "zstd"}])
    foreign(tmp_path, "b", b, (10,), [{"name": "bytes", "configuration": {"endian": "big"}}, {"name": "gzip"}], "v2", fill=-7, leave={(2,)})
    foreign(tmp_path, "c", c, (50, 5), [{"name": "bytes"}])
    rows = A.read_zarr(spark, str(tmp_path), "a", "b", "c").orderBy("row").collect()
    b[20:30] = -7
    assert np.array_equal([r["a"] for r in rows], a.reshape(50, -1).astype(np.float32))
    assert [r["b"] for r in rows] == b.tolist() and np.array_equal([r["c"] for r in rows], c)
    foreign(tmp_path, "d", b, (10,), [{"name": "bytes"}, {"name": "blosc"}])
    with pytest.raises(Exception, match="unsupported codec blosc"):
        A.read_zarr(spark, str(tmp_path), "d").count()
    with pytest.raises(Exception, match="no Zarr array"):
        A.read_zarr(spark, str(tmp_path), "none").count()


def test_failed_zarr_write_leaves_nothing(spark, table, tmp_path):
    bad = table.withColumn("v", F.when(F.col("row") == 200, F.lit(None)).otherwise(F.col("v")))
    with pytest.raises(Exception, match="no NULL"):
        A.write_zarr(bad, str(tmp_path / "z"), chunk=16)
    assert not (tmp_path / "z").exists()
    with pytest.raises(Exception, match="numbered"):
        A.write_zarr(table.where("row <> 64"), str(tmp_path / "z"), chunk=64) if table.where("row <> 64").count() % 64 else None
        A.write_zarr(table.where("row >= 64"), str(tmp_path / "y"), chunk=64)
    assert not (tmp_path / "y").exists()


def test_npz_bundles(spark, table, tmp_path):
    path = str(tmp_path / "n")
    full = table.withColumn("name", F.concat(F.lit("é"), F.col("kind")))
    assert A.write_npz(full, path, "profile", "2", rows=50, config={"width": 4})
    back = A.read_npz(spark, path, "profile", "2")
    assert same(back.select(*full.columns), full) and dict(back.dtypes)["name"] == "string"
    with np.load(next((tmp_path / "n").glob("*.npz"))) as z:  # any reader of such files can open one
        assert str(z["schema"]) == "profile" and str(z["version"]) == "2" and len(z["ident"]) <= 50
    for tag, version in (("profile", "1"), ("other", "2")):
        with pytest.raises(Exception, match="is .*, not"):
            A.read_npz(spark, path, tag, version).count()
    assert A.write_npz(full, path, "profile", "2", config={"width": 4}) is False
    with pytest.raises(ValueError, match="another configuration"):
        A.write_npz(full, path, "profile", "2", config={"width": 5})


def test_a_wrong_tag_in_one_bundle_raises(spark, table, tmp_path):
    A.write_npz(table.select("row"), str(tmp_path / "n"), "profile", "2", rows=40)
    last = json.loads((tmp_path / "n" / A.MANIFEST).read_text())["bundles"][-1]
    np.savez(tmp_path / "n" / last, schema=np.array("old"), version=np.array("2"), row=np.arange(3))
    with pytest.raises(Exception, match="schema is old, not profile"):
        A.read_npz(spark, str(tmp_path / "n"), "profile", "2").count()


def test_aborted_bundles_leave_nothing_to_read(spark, table, tmp_path):
    bad = table.withColumn("kind", F.when(F.col("row") == 199, F.lit(None)).otherwise(F.col("kind")))
    with pytest.raises(Exception, match="no NULL"):
        A.write_npz(bad.coalesce(2), str(tmp_path / "n"), "profile", "1", rows=20)
    left = os.listdir(tmp_path / "n") if (tmp_path / "n").exists() else []
    assert not [f for f in left if f.endswith(".npz") or f == A.MANIFEST]


def test_stray_files_are_not_rows(spark, table, tmp_path):
    A.write_npz(table.select("row"), str(tmp_path / "n"), "profile", "1")
    np.savez(tmp_path / "n" / "bundle-stray.npz", schema=np.array("profile"), version=np.array("1"), row=np.arange(5))
    assert A.read_npz(spark, str(tmp_path / "n"), "profile", "1").count() == 230
