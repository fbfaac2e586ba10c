"""Point-cloud and graph files as tables, read in ranges, and a sink that commits submaps.

``keelson_cloud`` reads PLY (ASCII and both binary orders), NPY and NPZ files. The schema comes from the first file's header. Files of
fixed-width records, and uncompressed members of NPZ files, are cut into ranges of rows, ASCII files into ranges of bytes, so
one large file is many tasks; a compressed member has no random access and is one task. Ranges go to Arrow batches column by
column. Equality and IN filters on columns are applied to the records before that (``spark.sql.python.filterPushdown.enabled``).

``keelson_submaps`` writes one NPZ file a submap in two phases: tasks write under a staging name, the driver moves what the
committed tasks wrote and writes the manifest, with a hash a file, last. A target that exists is refused, and what a failed job
left is deleted. Both open paths through Arrow's filesystems, so any store that those know can be read.
"""

from __future__ import annotations

import hashlib
import io
import json
import posixpath
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

#: Bytes of a range, and rows of a batch.
RANGE_BYTES, BATCH_ROWS = 32 << 20, 65_536

#: The scalar types of PLY headers.
PLY_TYPES = {
    "char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8",
    "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8",
}
_SPARK = {"i1": T.ShortType(), "u1": T.ShortType(), "i2": T.ShortType(), "u2": T.IntegerType(), "i4": T.IntegerType(), "u4": T.LongType(), "i8": T.LongType(), "u8": T.LongType(), "f4": T.FloatType(), "f8": T.DoubleType(), "b1": T.BooleanType()}
_ARROW = {"ShortType": pa.int16(), "IntegerType": pa.int32(), "LongType": pa.int64(), "FloatType": pa.float32(), "DoubleType": pa.float64(), "BooleanType": pa.bool_(), "StringType": pa.string()}


def filesystem(path: str):
    """Arrow's filesystem of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[str]:
    """The cloud files at a path: the file itself, or those under a folder, in order."""
    from pyarrow import fs

    store, at = filesystem(path)
    if store.get_file_info(at).type == fs.FileType.File:
        return [at]
    found = [i.path for i in store.get_file_info(fs.FileSelector(at, recursive=True)) if i.type == fs.FileType.File and i.path.rsplit(".", 1)[-1].lower() in ("ply", "npy", "npz")]
    if not found:
        raise FileNotFoundError(f"no cloud files at {path}")
    return sorted(found)


@dataclass
class Piece:
    """Records of one dtype: where they begin in the file, how many there are, and how a compressed member is named."""

    name: str
    dtype: str | list
    rows: int
    start: int
    member: str = ""


@dataclass
class Layout:
    pieces: list[Piece]
    ascii: bool = False
    end: int = 0
    more: bool = False  # other elements follow the vertices


def _fields(piece: Piece) -> list[tuple[str, np.dtype]]:
    """Columns of a piece: its record's fields, or ``name``, or ``name_0`` and so on for rows of several numbers."""
    d = np.dtype(piece.dtype)
    if d.names:
        return [(n, d.fields[n][0]) for n in d.names]
    if d.shape:
        return [(f"{piece.name}_{k}", d.base) for k in range(int(np.prod(d.shape)))]
    return [(piece.name, d)]


def _kind(d: np.dtype) -> T.DataType:
    if d.kind in "US":
        return T.StringType()
    if d.str[1:] not in _SPARK:
        raise ValueError(f"type {d} can't be a column")
    return _SPARK[d.str[1:]]


def _npy(f, name: str, member: str = "") -> Piece:
    """The piece behind an NPY header; ``f`` stands behind it afterwards."""
    version = np.lib.format.read_magic(f)
    shape, fortran, d = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if not shape or d.hasobject or (fortran and len(shape) > 1):
        raise ValueError(f"{name}: only rows of plain numbers or text, in C order")
    d = np.dtype((d, shape[1:])) if len(shape) > 1 else d
    return Piece(name, d.descr if d.names else (d.base.str, d.shape) if d.shape else d.str, shape[0], f.tell(), member)


def layout(store, path: str, members: tuple[str, ...] = ()) -> Layout:
    """What a file has, from its header."""
    with store.open_input_file(path) as f:
        if path.lower().endswith(".npy"):
            return Layout([_npy(f, "value")])
        if path.lower().endswith(".npz"):
            out = []
            with zipfile.ZipFile(f) as z:
                for info in z.infolist():
                    name = info.filename.removesuffix(".npy")
                    if members and name not in members:
                        continue
                    with z.open(info) as m:
                        piece = _npy(m, name, info.filename)
                    if info.compress_type == zipfile.ZIP_STORED:
                        f.seek(info.header_offset + 26)
                        sizes = np.frombuffer(f.read(4), "<u2")
                        piece.start += info.header_offset + 30 + int(sizes.sum())
                        piece.member = ""
                    out.append(piece)
            if members and (missing := set(members) - {p.name for p in out}):
                raise ValueError(f"{path} has no {sorted(missing)}")
            out.sort(key=lambda p: members.index(p.name) if members else p.name)
            if len({p.rows for p in out}) > 1:
                raise ValueError(f"{path}: members of different lengths; name those to read together")
            return Layout(out)
        head = b""
        while b"end_header" not in head or not head.split(b"end_header", 1)[1][:2].count(b"\n"):
            more = f.read(4096)
            if not more or len(head) > 1 << 20:
                raise ValueError(f"{path}: no PLY header")
            head += more
        size = head.index(b"\n", head.index(b"end_header")) + 1
        words = [line.split() for line in head[:size].decode("ascii", "replace").splitlines()]
        if words[0] != ["ply"]:
            raise ValueError(f"{path} isn't a PLY file")
        form = next(w[1] for w in words if w and w[0] == "format")
        order = {"ascii": "", "binary_little_endian": "<", "binary_big_endian": ">"}[form]
        elements = [k for k, w in enumerate(words) if w and w[0] == "element"]
        if not elements or words[elements[0]][1] != "vertex":
            raise ValueError(f"{path}: vertices must come first")
        of_vertex = [w for w in words[elements[0] + 1 : elements[1] if len(elements) > 1 else None] if w and w[0] == "property"]
        if any(w[1] == "list" for w in of_vertex):
            raise ValueError(f"{path}: vertices have lists")
        return Layout([Piece("vertex", [(w[2], (order or "<") + PLY_TYPES[w[1]]) for w in of_vertex], int(words[elements[0]][2]), size)], not order, store.get_file_info(path).size, len(elements) > 1)


@dataclass
class Range(InputPartition):
    file: str
    first: int
    count: int


class CloudReader(DataSourceReader):
    def __init__(self, path: str, members: tuple[str, ...], schema: T.StructType, range_bytes: int):
        self.path, self.members, self.columns, self.range_bytes = path, members, schema, range_bytes
        self.allowed: list[tuple[str, set]] = []

    def partitions(self):
        store = filesystem(self.path)[0]
        out = []
        for file in listed(self.path):
            x = layout(store, file, self.members)
            if x.ascii:
                out += [Range(file, at, min(self.range_bytes, x.end - at)) for at in range(x.pieces[0].start, x.end, self.range_bytes)]
            elif any(p.member for p in x.pieces):
                out.append(Range(file, 0, x.pieces[0].rows))
            else:
                step = max(1, self.range_bytes // max(1, sum(np.dtype(_dtype(p)).itemsize for p in x.pieces)))
                out += [Range(file, at, min(step, x.pieces[0].rows - at)) for at in range(0, x.pieces[0].rows, step)]
        return out or [Range("", 0, 0)]

    def _batch(self, file: str, at: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
        keep = np.ones(len(at), bool)
        for name, values in self.allowed:
            keep &= np.isin(columns[name], list(values))
        arrays = []
        for f in self.columns:
            kind = _ARROW[type(f.dataType).__name__]
            if f.name == "file":
                arrays.append(pa.array([file] * int(keep.sum()), kind))
            elif f.name == "at":
                arrays.append(pa.array(at[keep], kind))
            else:
                x = columns[f.name][keep]
                x = np.char.decode(x, "utf-8") if x.dtype.kind == "S" else x
                arrays.append(pa.array(x.tolist() if x.dtype.kind == "U" else x.astype(x.dtype.newbyteorder("="), copy=False), kind, safe=False))
        return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in self.columns])

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store = filesystem(self.path)[0]
        x = layout(store, partition.file, self.members)
        if x.ascii:
            yield from self._lines(store, x, partition)
            return
        for first in range(partition.first, partition.first + partition.count, BATCH_ROWS):
            n = min(BATCH_ROWS, partition.first + partition.count - first)
            columns: dict[str, np.ndarray] = {}
            for p in x.pieces:
                for (name, _), column in zip(_fields(p), _columns(_records(store, partition.file, p, first, n))):
                    columns[name] = column
            yield self._batch(partition.file, np.arange(first, first + n, dtype=np.int64), columns)

    def _lines(self, store, x: Layout, part: Range) -> Iterator[pa.RecordBatch]:
        """Lines that begin in the range, of those that are vertices: the ``rows`` first ones of the file."""
        piece = x.pieces[0]
        fields = _fields(piece)
        with store.open_input_file(part.file) as f:
            f.seek(part.first - 1)
            data = f.read(part.count + 1)
            if len(data) == part.count + 1 and not data.endswith(b"\n"):
                while more := f.read(4096):  # the last line goes on in the next range
                    data += more.split(b"\n", 1)[0]
                    if b"\n" in more:
                        break
            skip = data.find(b"\n") + 1
            if not skip:
                return
            # with faces behind them, vertices have to be counted up to the range; without, every line is one
            before = _newlines(f, piece.start, part.first - 1 + skip) if x.more else 0
        at, rows, places = part.first - 1 + skip, [], []
        for line in data[skip:].split(b"\n"):
            words = line.split()
            if before >= piece.rows:
                break
            if len(words) == len(fields):
                rows.append(words)
                places.append(at)
            elif words:
                raise ValueError(f"{part.file}: a vertex of {len(words)} numbers")
            before += 1
            at += len(line) + 1
        for k in range(0, len(rows), BATCH_ROWS):
            some = list(zip(*rows[k : k + BATCH_ROWS]))
            columns = {name: np.array(c, float if d.kind == "f" else object).astype(d) for (name, d), c in zip(fields, some)}
            yield self._batch(part.file, np.array(places[k : k + BATCH_ROWS], np.int64), columns)


def _newlines(f, start: int, end: int) -> int:
    """Lines between two places: how many vertices come before a range. (Faces follow the vertices as lines of their own.)"""
    n = 0
    f.seek(start)
    while start < end:
        block = f.read(min(8 << 20, end - start))
        if not block:
            break
        n += block.count(b"\n")
        start += len(block)
    return n


def _dtype(p: Piece) -> np.dtype:
    return np.dtype([tuple(x) for x in p.dtype]) if isinstance(p.dtype, list) else np.dtype(p.dtype)


def _records(store, file: str, p: Piece, first: int, n: int) -> np.ndarray:
    d = _dtype(p)
    with store.open_input_file(file) as f:
        if not p.member:
            return np.frombuffer(f.read_at(n * d.itemsize, p.start + first * d.itemsize), d.base if d.subdtype else d).reshape((n, *d.shape))
        with zipfile.ZipFile(f) as z, z.open(p.member) as m:
            skip = p.start + first * d.itemsize
            while skip:
                skip -= len(m.read(min(skip, 8 << 20)))
            return np.frombuffer(m.read(n * d.itemsize), d.base if d.subdtype else d).reshape((n, *d.shape))


def _columns(x: np.ndarray) -> list[np.ndarray]:
    if x.dtype.names:
        return [x[n] for n in x.dtype.names]
    return [x] if x.ndim == 1 else list(x.reshape(len(x), -1).T)


class FilteringCloudReader(CloudReader):
    """Spark asks for a reader without this method where filters aren't pushed down."""

    def pushFilters(self, filters):
        names = {f.name for f in self.columns} - {"file", "at"}
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in names:
                self.allowed.append((f.attribute[0], set(f.value) if isinstance(f, In) else {f.value}))
            else:
                yield f


class CloudSource(DataSource):
    """Options: ``path`` (load's argument), ``members`` of NPZ files to read side by side, ``rangeBytes``, ``pushDown`` (true where
    ``spark.sql.python.filterPushdown.enabled`` is)."""

    @classmethod
    def name(cls):
        return "keelson_cloud"

    def _members(self) -> tuple[str, ...]:
        return tuple(m for m in self.options.get("members", "").split(",") if m)

    def schema(self):
        path = self.options["path"]
        pieces = layout(filesystem(path)[0], listed(path)[0], self._members()).pieces
        fields = [T.StructField("file", T.StringType()), T.StructField("at", T.LongType())]
        return T.StructType(fields + [T.StructField(n, _kind(d)) for p in pieces for n, d in _fields(p)])

    def reader(self, schema):
        kind = FilteringCloudReader if self.options.get("pushDown", "false") == "true" else CloudReader
        return kind(self.options["path"], self._members(), schema, int(self.options.get("rangeBytes", RANGE_BYTES)))


def read_cloud(spark: SparkSession, path: str, members: str = "", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """SRC-01, SRC-12: the records of cloud files, with ``file`` and ``at``: the row's number, of ASCII files its first byte."""
    spark.dataSource.register(CloudSource)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("keelson_cloud").option("pushDown", push).option("members", members).option("rangeBytes", range_bytes).load(path)


def labelled_segments(points: DataFrame, scan: str, label: str, least: int = 50) -> DataFrame:
    """SRC-01: points of the segments that have ``least`` points or more; label 0 is background."""
    there = points.where(F.col(label) != 0)
    large = there.groupBy(scan, label).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    return there.join(large, [scan, label], "left_semi")


def read_predicted_graph(spark: SparkSession, path: str, least: int = 50) -> tuple[DataFrame, DataFrame]:
    """SRC-03: ``points (file, at, x, y, z, label)`` of segments of ``least`` points, and ``relations (file, at, sub, obj, name)``
    between such segments; relations named none go, repeated pairs stay. Members ``xyz, labels, relation_edges, relation_labels``."""
    p = read_cloud(spark, path, "xyz,labels").select("file", "at", *[F.col(f"xyz_{k}").alias(c) for k, c in enumerate("xyz")], F.col("labels").cast("long").alias("label"))
    points = labelled_segments(p, "file", "label", least)
    ends = points.select("file", "label").distinct()
    r = read_cloud(spark, path, "relation_edges,relation_labels").select("file", "at", F.col("relation_edges_0").cast("long").alias("sub"), F.col("relation_edges_1").cast("long").alias("obj"), F.col("relation_labels").alias("name")).where("name <> 'none'")
    for side in ("sub", "obj"):
        r = r.join(ends.withColumnRenamed("label", side), ["file", side], "left_semi")
    return points, r.select("file", "at", "sub", "obj", "name")


# -- the sink ----------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str, str, int]]  # submap, staged path, sha256, rows


class SubmapWriter(DataSourceArrowWriter):
    def __init__(self, path: str, keys: list[str], columns: list[str], note: str):
        self.uri, self.keys, self.columns, self.note = path, keys, columns, note
        store, self.path = filesystem(path)
        if store.get_file_info(self.path).type.name != "NotFound":
            raise FileExistsError(f"{path} exists; submaps are never written over")
        self.staging = posixpath.join(posixpath.dirname(self.path.rstrip("/")), f"_{posixpath.basename(self.path.rstrip('/'))}-{uuid.uuid4().hex}")

    def write(self, iterator):
        store = filesystem(self.uri)[0]
        store.create_dir(self.staging, recursive=True)
        files, now, held = [], None, []

        def close():
            values = {c: np.concatenate([h[c] for h in held]) for c in self.columns}
            out = io.BytesIO()
            np.savez(out, **values, provenance=np.array(json.dumps({"submap": dict(zip(self.keys, now)), "rows_sha256": hashlib.sha256(b"".join(np.ascontiguousarray(v).tobytes() for v in values.values())).hexdigest(), "note": self.note}, sort_keys=True)))
            data, staged = out.getvalue(), f"{self.staging}/{uuid.uuid4().hex}.npz"
            with store.open_output_stream(staged) as f:
                f.write(data)
            files.append(("/".join(map(str, now)), staged, hashlib.sha256(data).hexdigest(), len(next(iter(values.values())))))

        for batch in iterator:
            of_key = list(zip(*(batch.column(k).to_pylist() for k in self.keys)))
            cuts = [k for k in range(1, len(of_key)) if of_key[k] != of_key[k - 1]]
            for a, b in zip([0, *cuts], [*cuts, len(of_key)]):
                if a == b:
                    continue
                if of_key[a] != now:
                    if now is not None:
                        close()
                    now, held = of_key[a], []
                held.append({c: batch.column(c)[a:b].to_numpy(zero_copy_only=False) for c in self.columns})
        if now is not None:
            close()
        return Written(files)

    def commit(self, messages):
        store = filesystem(self.uri)[0]
        files = sorted(f for m in messages if m is not None for f in m.files)
        if len({f[0] for f in files}) < len(files):
            self.abort(messages)
            raise ValueError("a submap came from two tasks: deal rows out by submap first")
        if store.get_file_info(self.path).type.name != "NotFound":
            self.abort(messages)
            raise FileExistsError(f"{self.uri} was made meanwhile")
        store.create_dir(self.staging, recursive=True)
        lines = []
        for submap, staged, sha, rows in files:
            final = f"{self.staging}/{submap}.npz"
            store.create_dir(posixpath.dirname(final), recursive=True)
            store.move(staged, final)
            lines.append(json.dumps({"submap": submap, "file": f"{submap}.npz", "sha256": sha, "rows": rows}, sort_keys=True))
        with store.open_output_stream(f"{self.staging}/manifest.json") as f:
            f.write("".join(x + "\n" for x in lines).encode())
        store.move(self.staging, self.path)  # one step: readers see all or nothing

    def abort(self, messages):
        store = filesystem(self.uri)[0]
        if store.get_file_info(self.staging).type.name != "NotFound":
            store.delete_dir(self.staging)


class SubmapSink(DataSource):
    """Options: ``path`` (save's argument), ``keys`` that name a submap, ``note`` for the provenance."""

    @classmethod
    def name(cls):
        return "keelson_submaps"

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("submaps are never written over")
        keys = self.options["keys"].split(",")
        return SubmapWriter(self.options["path"], keys, [f.name for f in schema if f.name not in keys], self.options.get("note", ""))


def write_submaps(points: DataFrame, path: str, keys: tuple[str, ...] = ("sequence_id", "anchor"), order: tuple[str, ...] = (), note: str = "") -> None:
    """SNK-04: one NPZ file a submap, with its columns and provenance, under ``path/<key>/<key>.npz``, and a manifest."""
    points.sparkSession.dataSource.register(SubmapSink)
    dealt = points.repartition(*keys).sortWithinPartitions(*keys, *order)
    dealt.write.format("keelson_submaps").option("keys", ",".join(keys)).option("note", note).mode("append").save(path)


def verify_submaps(spark: SparkSession, path: str) -> DataFrame:
    """``submap, rows, status`` of every file in the manifest or the folder: intact, changed, missing or unlisted."""
    told = spark.read.schema("submap string, file string, sha256 string, rows long").json(f"{path}/manifest.json")
    here = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", "true").load(path)
    here = here.select(F.element_at(F.split("path", path.split("://")[-1].rstrip("/") + "/", 2), -1).alias("file"), F.sha2("content", 256).alias("_sha"))
    x = told.join(here, "file", "full")
    status = F.when(F.col("submap").isNull(), "unlisted").when(F.col("_sha").isNull(), "missing").when(F.col("_sha") == F.col("sha256"), "intact").otherwise("changed")
    return x.select(F.coalesce("submap", F.regexp_replace("file", "[.]npz$", "")).alias("submap"), "rows", status.alias("status"))
