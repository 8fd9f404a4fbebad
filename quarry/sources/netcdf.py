"""NetCDF classic files (CDF-1, CDF-2, CDF-5) as a Spark data source.

    spark.dataSource.register(NetCDFDataSource)
    spark.read.format("netcdf_rows").load(path)

Rows run over the unlimited dimension (or the first, where none is): id, data (bytes of the BYTE variable), label (the INT variable). Each
partition reads its own range of rows of at most `rows_per_partition` (default: about 64 MB), so no read is larger than that.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.sources.files import listed, open_input

SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 4, 6: 8, 7: 1, 8: 2, 9: 4, 10: 8, 11: 8}
NAMES = {1: "BYTE", 2: "CHAR", 3: "SHORT", 4: "INT", 5: "FLOAT", 6: "DOUBLE", 7: "UBYTE", 8: "USHORT", 9: "UINT", 10: "INT64", 11: "UINT64"}
FORMATS = {1: "b", 2: "c", 3: "h", 4: "i", 5: "f", 6: "d", 7: "B", 8: "H", 9: "I", 10: "q", 11: "Q"}
TARGET = 64 << 20


@dataclass
class Variable:
    name: str
    dims: list[int]
    kind: int
    begin: int
    shape: list[int] = field(default_factory=list)
    record: bool = False

    @property
    def row_bytes(self) -> int:
        return math.prod(self.shape[1:]) * SIZES[self.kind]


@dataclass
class Header:
    version: int
    n_records: int
    dims: list[tuple[str, int]]
    attributes: dict
    variables: dict[str, Variable]
    record_bytes: int

    def where(self, v: Variable, row: int) -> int:
        return v.begin + row * (self.record_bytes if v.record else v.row_bytes)


class _Reader:
    def __init__(self, f):
        self.f, self.wide = f, False

    def take(self, n: int) -> bytes:
        out = self.f.read(n)
        if len(out) != n:
            raise ValueError("the file ends inside its header")
        return out

    def int4(self) -> int:
        return struct.unpack(">i", self.take(4))[0]

    def count(self) -> int:
        return struct.unpack(">q", self.take(8))[0] if self.wide else struct.unpack(">I", self.take(4))[0]

    def name(self) -> str:
        n = self.count()
        return self.take(n + -n % 4)[:n].decode("utf-8")

    def attributes(self) -> dict:
        tag, n, out = self.int4(), self.count(), {}
        for _ in range(n if tag else 0):
            name, kind, size = self.name(), self.int4(), self.count()
            raw = self.take(size * SIZES[kind] + -(size * SIZES[kind]) % 4)[: size * SIZES[kind]]
            out[name] = raw.decode("utf-8", "replace") if kind == 2 else list(struct.unpack(f">{size}{FORMATS[kind]}", raw))
        return out


def read_header(f) -> Header:
    r = _Reader(f)
    magic = r.take(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
        raise ValueError("not a NetCDF classic file")
    r.wide = magic[3] == 5
    n_records = r.count()
    tag, n = r.int4(), r.count()
    dims = [(r.name(), r.count()) for _ in range(n if tag else 0)]
    attributes = r.attributes()
    tag, n = r.int4(), r.count()
    found: dict[str, Variable] = {}
    for _ in range(n if tag else 0):
        name = r.name()
        ids = [r.count() for _ in range(r.count())]
        r.attributes()
        kind = r.int4()
        r.count()  # vsize: follows from shape and type
        begin = r.int4() if magic[3] == 1 else struct.unpack(">q", r.take(8))[0]
        record = bool(ids) and dims[ids[0]][1] == 0
        shape = [n_records if record and k == 0 else dims[d][1] for k, d in enumerate(ids)]
        found[name] = Variable(name, ids, kind, begin, shape, record)
    records = [v for v in found.values() if v.record]
    size = records[0].row_bytes if len(records) == 1 else sum(v.row_bytes + -v.row_bytes % 4 for v in records)
    return Header(magic[3], n_records, dims, attributes, found, size)


def pack(data: np.ndarray, labels: np.ndarray) -> bytes:
    """A CDF-5 file with a BYTE variable `data` (rows by bytes) and an INT variable `labels` of rows."""
    count = lambda n: struct.pack(">q", n)
    tag = lambda t, n: struct.pack(">i", t) + count(n)
    name = lambda said: count(len(said)) + said.encode() + bytes(-len(said) % 4)
    bodies = [np.ascontiguousarray(x).tobytes() for x in (data.astype(np.uint8), labels.astype(">i4"))]
    bodies = [b + bytes(-len(b) % 4) for b in bodies]

    def head(begins):
        out = b"CDF\5" + count(0) + tag(10, 2) + name("row") + count(data.shape[0]) + name("byte") + count(data.shape[1]) + tag(0, 0) + tag(11, 2)
        for said, dims, kind, body, begin in zip(("data", "labels"), ((0, 1), (0,)), (1, 4), bodies, begins):
            out += name(said) + count(len(dims)) + b"".join(map(count, dims)) + tag(0, 0) + struct.pack(">i", kind) + count(len(body)) + count(begin)
        return out

    size = len(head((0, 0)))
    return head((size, size + len(bodies[0]))) + b"".join(bodies)


def describe(path: str) -> list[dict]:
    """name, kind, dims (names) and shape of each variable."""
    with open_input(path) as f:
        h = read_header(f)
    return [{"name": v.name, "kind": NAMES[v.kind], "dims": [h.dims[d][0] for d in v.dims], "shape": v.shape} for v in h.variables.values()]


def _pick(h: Header, options: dict) -> tuple[Variable, Variable | None]:
    def one(option: str, kinds: tuple[int, ...]):
        if name := options.get(option):
            return h.variables[name]
        own = [v for v in h.variables.values() if v.kind in kinds and v.shape]
        return next((v for v in own if v.record), own[0] if own else None)

    data, label = one("data", (1, 7)), one("label", (4,))
    if data is None or data.kind not in (1, 7) or label is not None and label.kind != 4:
        raise ValueError("data is a BYTE variable and label an INT variable")
    return data, label


@dataclass
class Rows(InputPartition):
    path: str
    start: int
    stop: int
    first_id: int


class NetCDFReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self):
        out, seen = [], 0
        for path in listed(self.options["path"]):
            with open_input(path) as f:
                data, _ = _pick(read_header(f), self.options)
            n = data.shape[0]
            step = int(self.options.get("rows_per_partition") or max(1, TARGET // max(1, data.row_bytes)))
            out += [Rows(path, a, min(n, a + step), seen + a) for a in range(0, n, step)]
            seen += n
        return out

    def read(self, partition: Rows):
        with open_input(partition.path) as f:
            h = read_header(f)
            data, label = _pick(h, self.options)
            for row in range(partition.start, partition.stop):
                f.seek(h.where(data, row))
                raw = f.read(data.row_bytes)
                value = None
                if label is not None:
                    f.seek(h.where(label, row))
                    value = struct.unpack(">i", f.read(4))[0]
                yield partition.first_id + row - partition.start, raw, value


class NetCDFDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "netcdf_rows"

    def schema(self) -> str:
        return "id bigint, data binary, label int"

    def reader(self, schema) -> NetCDFReader:
        return NetCDFReader(self.options)


def read_netcdf(spark, path: str, **options):
    spark.dataSource.register(NetCDFDataSource)
    return spark.read.format("netcdf_rows").options(**{k: str(v) for k, v in options.items()}).load(path)
