"""Array stores as Spark data sources: Zarr (version 3) scan and sink, NPZ bundles with a schema tag.

Register with `register(spark)`, or use `read_zarr`, `write_zarr`, `read_npz`, `write_npz`. Files are reached through
pyarrow's file systems, so a path may name any store that these know (file, hdfs, s3, gs); executors must see it.

Zarr: the first axis are rows; a row's part of an array becomes a flat list (a value for arrays of one axis). One partition
is planned for each block of rows whose chunks no other block shares; only the arrays asked for are opened, and limits on
`row` (option or filter) leave whole blocks out before a byte is read. Chunk grids are regular; codecs: bytes (either
byte order), zstd, gzip. Others raise. A chunk without a file holds the fill value.

NPZ: a bundle holds some rows, a named array for each column, and its schema tag and version, which the scan compares with
those asked for before it gives a row. A store is the bundles that its manifest names: the manifest is written when the
whole write commits, so bundles of failed attempts are never read; an aborted write deletes what its tasks wrote.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import itertools
import json
import math
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import ArrayType, BooleanType, ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

from ..runtime import ship

#: Numpy kinds and the Spark types that hold them.
TYPES = {"bool": BooleanType(), "int8": ByteType(), "uint8": ShortType(), "int16": ShortType(), "uint16": IntegerType(), "int32": IntegerType(), "uint32": LongType(), "int64": LongType(), "float16": FloatType(), "float32": FloatType(), "float64": DoubleType()}
_NUMPY = {BooleanType(): "bool", ByteType(): "int8", ShortType(): "int16", IntegerType(): "int32", LongType(): "int64", FloatType(): "float32", DoubleType(): "float64"}
#: Rows of an Arrow batch that a scan hands over.
BATCH = 1024
MANIFEST = "_manifest.json"


class Store:
    """A folder of a pyarrow file system."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")

    def bytes(self, name: str) -> bytes | None:
        try:
            with self.fs.open_input_stream(f"{self.root}/{name}") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def json(self, name: str) -> dict | None:
        found = self.bytes(name)
        return None if found is None else json.loads(found)

    def put(self, name: str, content: bytes) -> None:
        """Write a file, seen under its name only when whole."""
        path = f"{self.root}/{name}"
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with self.fs.open_output_stream(part) as f:
            f.write(content)
        self.fs.move(part, path)

    def names(self, end: str) -> list[str]:
        from pyarrow import fs

        return sorted(x.base_name for x in self.fs.get_file_info(fs.FileSelector(self.root, allow_not_found=True)) if x.base_name.endswith(end))

    def delete(self, name: str = "") -> None:
        from pyarrow import fs

        path = f"{self.root}/{name}".rstrip("/")
        kind = self.fs.get_file_info(path).type
        if kind == fs.FileType.Directory:
            self.fs.delete_dir(path)
        elif kind == fs.FileType.File:
            self.fs.delete_file(path)

    def exists(self) -> bool:
        from pyarrow import fs

        return self.fs.get_file_info(self.root).type != fs.FileType.NotFound


def column(kind: DataType, values: np.ndarray) -> pa.Array:
    """Rows of a one- or two-dimensional array as a column of a Spark type."""
    values = values.astype(np.float32) if values.dtype == np.float16 else values
    if not isinstance(kind, ArrayType):
        return pa.array(values.astype(str).tolist() if isinstance(kind, StringType) else values.astype(_NUMPY[kind]))
    items = values.reshape(len(values), -1)
    edges = np.arange(len(items) + 1, dtype=np.int32) * items.shape[1]
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(items.ravel().astype(_NUMPY[kind.elementType])))


def batches(schema: StructType, columns: dict[str, np.ndarray]):
    n = len(next(iter(columns.values())))
    for low in range(0, n, BATCH):
        yield pa.RecordBatch.from_arrays([column(f.dataType, columns[f.name][low : low + BATCH]) for f in schema.fields], names=schema.names)


def matrix(array: pa.Array) -> np.ndarray:
    """A column as numpy: lists of one length become rows. Missing values raise, as array stores hold none."""
    if array.null_count:
        raise ValueError("an array store holds no NULL")
    if not pa.types.is_list(array.type):
        return array.to_numpy(zero_copy_only=False)
    flat = array.flatten()
    if flat.null_count or len(array) and len(set(np.diff(array.offsets.to_numpy()).tolist())) > 1:
        raise ValueError("lists of an array store have one length and no NULL")
    return flat.to_numpy(zero_copy_only=False).reshape(len(array), -1)


# ---- Zarr


@dataclass(frozen=True)
class ZarrArray:
    name: str
    shape: tuple
    chunk: tuple
    kind: str
    codecs: tuple
    fill: object
    prefix: str
    separator: str

    @classmethod
    def of(cls, store: Store, name: str) -> ZarrArray:
        meta = store.json(f"{name}/zarr.json")
        if meta is None or meta.get("node_type") != "array":
            raise ValueError(f"no Zarr array {name}")
        if meta.get("zarr_format") != 3 or meta["chunk_grid"]["name"] != "regular" or meta["data_type"] not in TYPES:
            raise ValueError(f"{name}: unsupported format, chunk grid or data type")
        codecs = tuple((c["name"], json.dumps(c.get("configuration", {}))) for c in meta["codecs"])
        for c, _ in codecs:
            if c not in ("bytes", "zstd", "gzip"):
                raise ValueError(f"{name}: unsupported codec {c}")
        encoding = meta.get("chunk_key_encoding", {"name": "default"})
        old = encoding["name"] == "v2"
        separator = encoding.get("configuration", {}).get("separator", "." if old else "/")
        return cls(name, tuple(meta["shape"]), tuple(meta["chunk_grid"]["configuration"]["chunk_shape"]), meta["data_type"], codecs, meta.get("fill_value"), "" if old else "c", separator)

    def key(self, at: tuple) -> str:
        return f"{self.name}/" + self.separator.join([*([self.prefix] if self.prefix else []), *map(str, at)])

    def decoded(self, raw: bytes | None) -> np.ndarray:
        if raw is None:
            return np.full(self.chunk, self.fill if not isinstance(self.fill, str) else float(self.fill.replace("Infinity", "inf")), self.kind)
        order = "<"
        for name, settings in reversed(self.codecs):
            if name == "zstd":
                import zstandard

                raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
            elif name == "gzip":
                raw = gzip.decompress(raw)
            else:
                order = ">" if json.loads(settings).get("endian") == "big" else "<"
        return np.frombuffer(raw, np.dtype(self.kind).newbyteorder(order)).reshape(self.chunk).astype(self.kind)

    def rows(self, store: Store, low: int, high: int) -> np.ndarray:
        """Rows low to high; each chunk that holds some of them is read once."""
        out = np.empty((high - low, *self.shape[1:]), self.kind)
        size = self.chunk[0]
        others = [range(-(-n // c)) for n, c in zip(self.shape[1:], self.chunk[1:])]
        for first in range(low // size, -(-high // size)):
            for rest in itertools.product(*others):
                part = self.decoded(store.bytes(self.key((first, *rest))))
                a, b = max(low, first * size), min(high, (first + 1) * size)
                target = tuple(slice(k * c, min((k + 1) * c, n)) for k, c, n in zip(rest, self.chunk[1:], self.shape[1:]))
                source = tuple(slice(0, s.stop - s.start) for s in target)
                out[(slice(a - low, b - low), *target)] = part[(slice(a - first * size, b - first * size), *source)]
        return out


@dataclass
class RowBlock(InputPartition):
    low: int
    high: int


class ZarrReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.schema = options["path"], schema
        low, _, high = options.get("rows", ":").partition(":")
        self.low, self.high = int(low or 0), int(high) if high else None

    def pushFilters(self, filters):
        """Limits on row leave out blocks; Spark applies all filters again."""
        for f in filters:
            if getattr(f, "attribute", None) == ("row",):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    end = f.value + (not isinstance(f, LessThan))
                    self.high = end if self.high is None else min(self.high, end)
            yield f

    def arrays(self, store: Store) -> list[ZarrArray]:
        found = [ZarrArray.of(store, n) for n in self.schema.names if n != "row"]
        if len({a.shape[0] for a in found}) > 1:
            raise ValueError("the arrays have different numbers of rows")
        return found

    def partitions(self):
        found = self.arrays(Store(self.path))
        sizes = [a.chunk[0] for a in found]
        shared = math.lcm(*sizes)
        block = shared if shared <= 8 * max(sizes) else max(sizes)
        end = found[0].shape[0] if self.high is None else min(self.high, found[0].shape[0])
        blocks = range(self.low // block, -(-end // block)) if end > self.low else ()
        return [RowBlock(max(self.low, k * block), min(end, (k + 1) * block)) for k in blocks] or [RowBlock(0, 0)]

    def read(self, partition: RowBlock):
        if partition.high <= partition.low:
            return
        store = Store(self.path)
        columns = {a.name: a.rows(store, partition.low, partition.high) for a in self.arrays(store)}
        columns["row"] = np.arange(partition.low, partition.high)
        yield from batches(self.schema, columns)


@dataclass
class Wrote(WriterCommitMessage):
    names: list
    rows: int
    columns: list


class ZarrWriter(DataSourceArrowWriter):
    """Chunks of whole rows; a task gets whole chunks, in order of their rows. Chunk files are seen when whole, the arrays at commit."""

    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.chunk, self.schema = options["path"], int(options.get("chunk", 256)), schema
        if Store(self.path).exists():
            raise ValueError(f"{self.path} is there already")

    def write(self, iterator):
        store, held, at, rows, widths, chunks = Store(self.path), [], None, 0, {}, []

        def flush():
            whole = pa.Table.from_batches(held)
            for f in self.schema.fields:
                if f.name == "row":
                    continue
                x = matrix(whole.column(f.name).combine_chunks())
                widths[f.name] = [str(x.dtype), *x.shape[1:]]
                padded = np.zeros((self.chunk, *x.shape[1:]), x.dtype)
                padded[whole.column("row").to_numpy() % self.chunk] = x
                import zstandard

                content = zstandard.ZstdCompressor(3).compress(np.ascontiguousarray(padded).astype(padded.dtype.newbyteorder("<")).tobytes())
                store.put(f"{f.name}/c/{at}" + ("/0" if x.ndim > 1 else ""), content)
            chunks.append(at)
            held.clear()

        for batch in iterator:
            owner = batch.column("row").to_numpy() // self.chunk
            edges = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges, edges[1:]):
                if held and owner[low] != at:
                    flush()
                if high > low:
                    at = int(owner[low])
                    held.append(batch.slice(low, high - low))
                    rows += high - low
        if held:
            flush()
        return Wrote(chunks, rows, [widths])

    def commit(self, messages):
        store, done = Store(self.path), [m for m in messages if m is not None]
        chunks = [c for m in done for c in m.names]
        rows = sum(m.rows for m in done)
        if sorted(chunks) != list(range(-(-rows // self.chunk))):
            self.abort(messages)
            raise ValueError("rows must be numbered 0, 1, ... and each chunk's rows be in one task")
        widths = next((m.columns[0] for m in done if m.columns[0]), {})
        for name, (kind, *width) in widths.items():
            meta = {
                "zarr_format": 3, "node_type": "array", "shape": [rows, *width], "data_type": kind, "fill_value": False if kind == "bool" else 0, "attributes": {},
                "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [self.chunk, *width]}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}},
                "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "zstd", "configuration": {"level": 3, "checksum": False}}],
            }
            store.put(f"{name}/zarr.json", json.dumps(meta).encode())
        store.put("zarr.json", json.dumps({"zarr_format": 3, "node_type": "group", "attributes": {"arrays": sorted(widths)}}).encode())

    def abort(self, messages):
        Store(self.path).delete()


class ZarrSource(DataSource):
    """Options: path, arrays (comma-separated; all that the group names by default), rows (low:high), chunk (rows, for writing)."""

    @classmethod
    def name(cls) -> str:
        return "zarr3"

    def schema(self) -> StructType:
        store = Store(self.options["path"])
        asked = self.options.get("arrays")
        group = store.json("zarr.json")
        names = asked.split(",") if asked else (group or {}).get("attributes", {}).get("arrays")
        if not names:
            raise ValueError("name the arrays to read")
        found = [ZarrArray.of(store, n.strip()) for n in names]
        return StructType([StructField("row", LongType()), *[StructField(a.name, TYPES[a.kind] if len(a.shape) == 1 else ArrayType(TYPES[a.kind])) for a in found]])

    def reader(self, schema: StructType) -> ZarrReader:
        return ZarrReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> ZarrWriter:
        return ZarrWriter(self.options, schema)


# ---- NPZ bundles


@dataclass
class Bundle(InputPartition):
    name: str


class NpzReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.options, self.schema = options, schema

    def partitions(self):
        return [Bundle(n) for n in bundles(Store(self.options["path"]))]

    def read(self, partition: Bundle):
        yield from batches(self.schema, opened(Store(self.options["path"]), partition.name, self.options, self.schema.names))


def bundles(store: Store) -> list[str]:
    """Those of the manifest, or all of a folder without one."""
    manifest = store.json(MANIFEST)
    return manifest["bundles"] if manifest else store.names(".npz")


def opened(store: Store, name: str, options: dict, columns=None) -> dict[str, np.ndarray]:
    """Columns of a bundle whose tag and version are those asked for."""
    with np.load(io.BytesIO(store.bytes(name)), allow_pickle=False) as z:
        for key in ("schema", "version"):
            if key in options and (key not in z or str(z[key]) != str(options[key])):
                raise ValueError(f"{name}: {key} is {str(z[key]) if key in z else 'missing'}, not {options[key]}")
        names = [n for n in z.files if n not in ("schema", "version")] if columns is None else columns
        found = {n: z[n] for n in names}
    if len({len(x) for x in found.values()}) > 1:
        raise ValueError(f"{name}: columns of different lengths")
    return found


class NpzWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.options, self.path, self.rows = options, options["path"], int(options.get("rows", 65_536))
        if Store(self.path).exists():
            raise ValueError(f"{self.path} is there already")

    def write(self, iterator):
        store, made, held, count, total = Store(self.path), [], [], 0, 0
        tags = {k: np.array(str(self.options[k])) for k in ("schema", "version") if k in self.options}

        def flush(table: pa.Table):
            content = io.BytesIO()
            arrays = {n: matrix(table.column(n).combine_chunks()) for n in table.column_names}
            np.savez_compressed(content, **tags, **{n: x.astype(str) if x.dtype == object else x for n, x in arrays.items()})
            name = f"bundle-{uuid.uuid4().hex}.npz"
            store.put(name, content.getvalue())
            made.append(name)

        try:
            for batch in iterator:
                while batch.num_rows:
                    part = batch.slice(0, self.rows - count)
                    batch = batch.slice(part.num_rows)
                    held.append(part)
                    count += part.num_rows
                    total += part.num_rows
                    if count == self.rows:
                        flush(pa.Table.from_batches(held))
                        held, count = [], 0
            if held:
                flush(pa.Table.from_batches(held))
        except BaseException:
            for name in made:
                store.delete(name)
            raise
        return Wrote(made, total, [])

    def commit(self, messages):
        done = [m for m in messages if m is not None]
        about = {k: str(self.options[k]) for k in ("schema", "version", "fingerprint") if k in self.options}
        content = {"bundles": [n for m in done for n in m.names], "rows": sum(m.rows for m in done)} | about
        Store(self.path).put(MANIFEST, json.dumps(content).encode())

    def abort(self, messages):
        for m in messages:
            for name in m.names if m is not None else ():
                Store(self.path).delete(name)


class NpzSource(DataSource):
    """Options: path; schema and version (compared at scan, written by the sink); rows (of a bundle), fingerprint (kept in the manifest)."""

    @classmethod
    def name(cls) -> str:
        return "npz_bundles"

    def schema(self) -> StructType:
        store = Store(self.options["path"])
        names = bundles(store)
        if not names:
            raise ValueError(f"no bundles in {self.options['path']}")
        found = opened(store, names[0], self.options)
        kind = lambda x: StringType() if x.dtype.kind == "U" else TYPES[x.dtype.name]
        return StructType([StructField(n, kind(x) if x.ndim == 1 else ArrayType(kind(x))) for n, x in found.items()])

    def reader(self, schema: StructType) -> NpzReader:
        return NpzReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> NpzWriter:
        return NpzWriter(self.options, schema)


# ---- entries


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (ZarrSource, NpzSource):
        spark.dataSource.register(source)


def read_zarr(spark: SparkSession, path: str, *arrays: str, rows: tuple | None = None) -> DataFrame:
    register(spark)
    out = spark.read.format("zarr3").option("path", path)
    if arrays:
        out = out.option("arrays", ",".join(arrays))
    return (out.option("rows", f"{rows[0]}:{rows[1]}") if rows else out).load()


def write_zarr(df: DataFrame, path: str, chunk: int = 256) -> None:
    """Write a table with a column row (0, 1, ...) as one array for each other column."""
    register(df.sparkSession)
    whole = df.repartition(F.floor(F.col("row") / chunk)).sortWithinPartitions("row")
    whole.write.format("zarr3").mode("append").option("path", path).option("chunk", chunk).save()


def read_npz(spark: SparkSession, path: str, schema: str, version: str) -> DataFrame:
    register(spark)
    return spark.read.format("npz_bundles").option("path", path).option("schema", schema).option("version", version).load()


def write_npz(df: DataFrame, path: str, schema: str, version: str, rows: int = 65_536, config: dict | None = None) -> bool:
    """Write a table as bundles; with a config whose fingerprint the store there has, nothing is done (False); another one raises."""
    register(df.sparkSession)
    out = df.write.format("npz_bundles").mode("append").option("path", path).option("schema", schema).option("version", version).option("rows", rows)
    if config is not None:
        mark = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()
        there = Store(path).json(MANIFEST)
        if there is not None:
            if (there.get("fingerprint"), there.get("schema"), there.get("version")) != (mark, schema, version):
                raise ValueError(f"{path} was made from another configuration")
            return False
        out = out.option("fingerprint", mark)
    out.save()
    return True


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; a local folder where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="episodica-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
