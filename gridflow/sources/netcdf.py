"""NetCDF classic files (CDF-1 and CDF-2) as a Spark data source, ``netcdf``.

``spark.read.format("netcdf").option("dimensions", "y,x").load(path)`` gives a row for each point of these dimensions: its ``index``
(from 1, in the order of the file) and the variables that begin with them; a further dimension makes an array. A schema
given by the user, or ``option("variables", "a,b")``, limits what is read to its variables. A file, or
each file of a folder, is read in ranges of points: a partition reads, of each of its variables, one
stretch of bytes (of each record, where the first dimension is the unlimited one), and no two partitions read the same bytes.

``df.write.format("netcdf").mode("overwrite").save(folder)`` writes a file for each partition that has rows, whose dimension is ``cell_count`` (or
``option("dimension", ...)``): tasks write to a folder of their own, and files are moved to their place when all have ended.
Classic files have no 64-bit integers: ``long`` columns are stored as doubles with the attribute ``kind``, up to 2**53.
Nulls are stored as the fill value of their type, and strings as characters, padded with zeros to the longest of the file.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

#: Points that a partition reads at most, and that are in a batch.
POINTS, BATCH = 1 << 20, 1 << 16

# fixed values of the format: tags, and types with their layout and fill values
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
FILL = {1: -127, 3: -32767, 4: -2147483647, 5: 9.969209968386869e36, 6: 9.969209968386869e36}
SPARK = {1: ShortType(), 3: ShortType(), 4: IntegerType(), 5: FloatType(), 6: DoubleType()}


@dataclass
class Variable:
    name: str
    dims: list[int]
    kind: int
    begin: int = 0
    size: int = 0  # bytes of the variable, or of one record of it
    attributes: dict[str, object] = field(default_factory=dict)


@dataclass
class Header:
    version: int
    records: int
    dims: list[tuple[str, int]]  # length 0: the unlimited one
    variables: dict[str, Variable]
    record_size: int = 0

    def is_record(self, v: Variable) -> bool:
        return bool(v.dims) and self.dims[v.dims[0]][1] == 0

    def length(self, dim: int) -> int:
        return self.dims[dim][1] or self.records


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Bytes:
    """Big-endian values of a file, one after the other."""

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def int(self, wide: bool = False) -> int:
        return struct.unpack(">q" if wide else ">i", self.file.read(8 if wide else 4))[0]

    def padded(self, n: int) -> bytes:
        got = self.file.read(n)
        self.file.read(-n % 4)
        return got

    def name(self) -> str:
        return self.padded(self.int()).decode()

    def count(self, tag: int) -> int:
        got, n = self.int(), self.int()
        if got not in (0, tag):
            raise ValueError(f"not a list with tag {tag}: {got}")
        return n

    def attributes(self) -> dict[str, object]:
        out: dict[str, object] = {}
        for _ in range(self.count(ATTRIBUTE)):
            name, kind, n = self.name(), self.int(), self.int()
            raw = self.padded(n * np.dtype(TYPES[kind]).itemsize)
            out[name] = raw.decode() if kind == 2 else np.frombuffer(raw, TYPES[kind]).tolist()
        return out


def header(path: str) -> Header:
    """What a file says of itself; only its head is read."""
    files, at = _opened(path)
    with files.open_input_file(at) as raw:
        b = _Bytes(raw)
        magic = raw.read(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2):
            raise ValueError(f"{path} is not a NetCDF classic file")
        records = b.int()
        dims = [(b.name(), b.int()) for _ in range(b.count(DIMENSION))]
        b.attributes()
        variables = {}
        for _ in range(b.count(VARIABLE)):
            name = b.name()
            v = Variable(name, [b.int() for _ in range(b.int())], 0)
            v.attributes, v.kind, v.size = b.attributes(), b.int(), b.int()
            v.begin = b.int(wide=magic[3] == 2)
            variables[name] = v
        out = Header(magic[3], records, dims, variables)
        own = [v for v in variables.values() if out.is_record(v)]
        for v in variables.values():  # sizes in the file may have overflowed
            shape = [dims[d][1] for d in v.dims if dims[d][1]]
            n = int(np.prod(shape, dtype=np.int64)) * np.dtype(TYPES[v.kind]).itemsize
            v.size = n if len(own) == 1 and v is own[0] else n + -n % 4
        out.record_size = sum(v.size for v in own)
        if records < 0:  # a file that was being written: its length tells
            out.records = (raw.size() - min(v.begin for v in own)) // out.record_size if own else 0
        return out


def _type(v: Variable, h: Header, dims: list[int]) -> DataType:
    if v.kind == 2:
        return StringType()
    one = LongType() if v.attributes.get("kind") == "long" else SPARK[v.kind]
    return ArrayType(one) if len(v.dims) > len(dims) else one


def _files(path: str) -> list[str]:
    files, at = _opened(path)
    info = files.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    return [prefix + f.path for f in sorted(files.get_file_info(fs.FileSelector(at)), key=lambda f: f.path) if f.base_name.endswith(".nc")]


def _chosen(h: Header, options: dict) -> tuple[list[int], list[Variable]]:
    """The dimensions of the points, and the variables that have them."""
    names = [n for n, _ in h.dims]
    wanted = [x.strip() for x in options.get("variables", "").split(",") if x.strip()]
    missing = [x for x in wanted if x not in h.variables]
    if missing:
        raise ValueError(f"no variable {', '.join(missing)}")
    if options.get("dimensions"):
        dims = [names.index(x.strip()) for x in options["dimensions"].split(",")]
    else:
        first = h.variables[wanted[0]] if wanted else max(h.variables.values(), key=lambda v: len(v.dims) - (v.kind == 2))
        dims = first.dims[:-1] if first.kind == 2 and len(first.dims) > 1 else first.dims
    own = [v for v in h.variables.values() if v.dims[: len(dims)] == dims and len(v.dims) <= len(dims) + 1 and (not wanted or v.name in wanted)]
    return dims, own


@dataclass
class Stretch(InputPartition):
    """Points start .. end - 1 of a file, of which the first has ``index``."""

    path: str
    start: int
    end: int
    index: int


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options, self.path = schema, dict(options), options["path"]
        self.points = int(options.get("points", POINTS))

    def partitions(self) -> list[Stretch]:
        out, before = [], 0
        for path in _files(self.path):
            h = header(path)
            dims, _ = _chosen(h, self.options)
            n = int(np.prod([h.length(d) for d in dims], dtype=np.int64))
            inner = int(np.prod([h.length(d) for d in dims[1:]], dtype=np.int64))
            # of records only whole ones
            step = max(1, self.points // inner) * inner if dims and h.dims[dims[0]][1] == 0 else self.points
            out += [Stretch(path, a, min(n, a + step), before + a + 1) for a in range(0, n, step)]
            before += n
        return out or [Stretch("", 0, 0, 0)]

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        if part.end <= part.start:
            return
        h = header(part.path)
        dims, _ = _chosen(h, self.options)
        inner = int(np.prod([h.length(d) for d in dims[1:]], dtype=np.int64))
        files, at = _opened(part.path)
        with files.open_input_file(at) as raw:
            step = max(1, BATCH // inner) * inner if h.dims[dims[0]][1] == 0 else BATCH
            for a in range(part.start, part.end, step):
                b = min(part.end, a + step)
                columns = []
                for f in self.schema.fields:
                    if f.name == "index":
                        columns.append(pa.array(np.arange(part.index + a - part.start, part.index + b - part.start)))
                    else:
                        columns.append(_column(raw, h, h.variables[f.name], len(dims), a, b, inner))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in self.schema.fields])


def _column(raw: pa.NativeFile, h: Header, v: Variable, depth: int, a: int, b: int, inner: int) -> pa.Array:
    """Points a .. b - 1 of a variable."""
    kind = np.dtype(TYPES[v.kind])
    each = int(np.prod([h.length(d) for d in v.dims[depth:]], dtype=np.int64))  # values of a point
    if h.is_record(v):
        got = b"".join(raw.read_at(inner * each * kind.itemsize, v.begin + r * h.record_size) for r in range(a // inner, b // inner))
    else:
        got = raw.read_at((b - a) * each * kind.itemsize, v.begin + a * each * kind.itemsize)
    if v.kind == 2:
        text = np.frombuffer(got, f"S{each}") if each else np.full(b - a, b"")
        return pa.array([x.decode("utf-8") for x in text.tolist()], pa.string())
    flat = np.frombuffer(got, kind)
    empty = flat == kind.type(FILL[v.kind])
    long = v.attributes.get("kind") == "long"
    native = np.where(empty, 0, flat).astype(np.int64) if long else flat.astype(np.int16 if v.kind == 1 else kind.newbyteorder("="))
    values = pa.array(native, mask=empty)
    return pa.FixedSizeListArray.from_arrays(values, each).cast(pa.list_(values.type)) if len(v.dims) > depth else values


class Writer(DataSourceArrowWriter):
    """A file for each partition, moved to its place at the end."""

    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.schema, self.path, self.overwrite = schema, options["path"].rstrip("/"), overwrite
        self.dimension = options.get("dimension", "cell_count")
        self.job = uuid.uuid4().hex
        files, at = _opened(self.path)
        files.create_dir(f"{at}/_temporary-{self.job}", recursive=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        held = list(batches)
        if not any(b.num_rows for b in held):  # such as a split of a Parquet file in which no row group begins
            return Written("", 0)
        table = pa.Table.from_batches(held)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.nc"
        files, at = _opened(self.path)
        with files.open_output_stream(f"{at}/_temporary-{self.job}/{name}") as out:
            write_file(out, table, self.dimension)
        return Written(name, table.num_rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, at = _opened(self.path)
        if self.overwrite:
            for f in files.get_file_info(fs.FileSelector(at)):
                if f.base_name.endswith(".nc"):
                    files.delete_file(f.path)
        for m in messages:
            if m is not None and m.rows:
                files.move(f"{at}/_temporary-{self.job}/{m.name}", f"{at}/{m.name}")
        files.delete_dir(f"{at}/_temporary-{self.job}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, at = _opened(self.path)
        files.delete_dir(f"{at}/_temporary-{self.job}")


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


def _encoded(name: str, column: pa.ChunkedArray) -> tuple[Variable, int, bytes]:
    """(variable without its place, values of a point, bytes) of a column."""
    kind, attributes, each = column.type, {}, 1
    if pa.types.is_list(kind):
        sizes = set(pa.compute.list_value_length(column).to_pylist())
        if len(sizes) > 1 or None in sizes:
            raise ValueError(f"arrays of {name} differ in length")
        each = sizes.pop() if sizes else 1
        column, kind = pa.compute.list_flatten(column), kind.value_type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        raw = [(x or "").encode() for x in column.to_pylist()]
        each = max(map(len, raw), default=1) or 1
        return Variable(name, [], 2, attributes=attributes), each, b"".join(x.ljust(each, b"\0") for x in raw)
    code = 6
    if pa.types.is_integer(kind):
        code = 3 if kind.bit_width <= 16 else 4 if kind.bit_width == 32 else 6
    elif kind == pa.float32():
        code = 5
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_integer(kind) and code == 6:
        attributes["kind"] = "long"
        if len(values) and (pa.compute.max(values).as_py() or 0) > 2**53 or (pa.compute.min(values).as_py() or 0) < -(2**53):
            raise ValueError(f"{name} has integers beyond 2**53")
    filled = values.cast(pa.float64() if code == 6 else kind, safe=False).fill_null(FILL[code])
    return Variable(name, [], code, attributes=attributes), each, filled.to_numpy(zero_copy_only=False).astype(TYPES[code]).tobytes()


def write_file(out: pa.NativeFile, table: pa.Table, dimension: str) -> None:
    """A whole CDF-2 file of a table: a dimension for its rows, and one for each length of arrays and strings."""
    dims, found = [(dimension, max(1, table.num_rows))], []
    for name in table.column_names:
        v, each, raw = _encoded(name, table.column(name))
        v.dims = [0]
        if each != 1 or v.kind == 2 or pa.types.is_list(table.column(name).type):
            v.dims.append(len(dims))
            dims.append((f"{name}_count", each))
        found.append((v, raw))

    def text(x: str) -> bytes:
        raw = x.encode()
        return struct.pack(">i", len(raw)) + raw + b"\0" * (-len(raw) % 4)

    def head(begins: list[int]) -> bytes:
        out = b"CDF\x02" + struct.pack(">iii", 0, DIMENSION, len(dims)) + b"".join(text(n) + struct.pack(">i", k) for n, k in dims) + struct.pack(">iiii", 0, 0, VARIABLE, len(found))
        for (v, raw), begin in zip(found, begins, strict=True):
            held = struct.pack(">ii", ATTRIBUTE, len(v.attributes)) if v.attributes else struct.pack(">ii", 0, 0)
            held += b"".join(text(k) + struct.pack(">i", 2) + text(str(x)) for k, x in v.attributes.items())
            size = min(len(raw) + -len(raw) % 4, 2**31 - 4)
            out += text(v.name) + struct.pack(f">i{len(v.dims)}i", len(v.dims), *v.dims) + held + struct.pack(">iiq", v.kind, size, begin)
        return out

    at, begins = len(head([0] * len(found))), []
    for _, raw in found:
        begins.append(at)
        at += len(raw) + -len(raw) % 4
    out.write(head(begins))
    for _, raw in found:
        out.write(raw + b"\0" * (-len(raw) % 4))


class NetCDF(DataSource):
    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def schema(self) -> StructType:
        h = header(_files(self.options["path"])[0])
        dims, own = _chosen(h, self.options)
        return StructType([StructField("index", LongType())] + [StructField(v.name, _type(v, h, dims)) for v in own])

    def reader(self, schema: StructType) -> Reader:
        names = [f.name for f in schema.fields if f.name != "index"]
        options = dict(self.options)
        if names and "dimensions" not in options:
            options["variables"] = ",".join(names)
        return Reader(schema, options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes ``netcdf`` known to the session as a format."""
    spark.dataSource.register(NetCDF)
