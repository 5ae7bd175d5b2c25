"""dBase III files as a Spark data source.

Records have one width, so a file splits at any record: partitions are record ranges, read independently, each
task reading its bytes alone. All values are text; typing happens in normalisation. Files are opened through
Hadoop's file systems on the driver only to list and read headers; tasks read them through `pyarrow.fs`, or as
rows of `binaryFile` where a store is Spark's alone (see `read_binary`).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from ..errors import DecodeFailed, HeaderUnreadable, UnsupportedContainer
from ..functions.text import best_decoding

BATCH = 65_536


@dataclass(frozen=True)
class Field:
    name: str
    letter: str
    width: int
    decimals: int
    offset: int


@dataclass(frozen=True)
class Header:
    version: int
    records: int
    header_length: int
    record_length: int
    fields: tuple[Field, ...]


def unique_names(names: list[str]) -> list[str]:
    """The second X becomes X_1, and so on."""
    out: list[str] = []
    for n in names:
        name, k = n, 0
        while name in out:
            k += 1
            name = f"{n}_{k}"
        out.append(name)
    return out


def parse_header(data: bytes) -> Header:
    """Version, counts and fields out of a byte prefix; a partial one is refused."""
    if len(data) < 33:
        raise HeaderUnreadable("under 33 bytes")
    version, records, header, record = data[0], *struct.unpack("<IHH", data[4:12])
    if header < 33 or record < 1 or version & 7 not in (2, 3, 4, 5):
        raise HeaderUnreadable("not a dBase header")
    if len(data) < header:
        raise HeaderUnreadable(f"header of {header} bytes, {len(data)} given")
    found, at, offset = [], 32, 1
    while at + 32 <= header and data[at] != 0x0D:
        raw = data[at : at + 32]
        name = raw[:11].split(b"\0")[0].decode("latin-1").strip().upper()
        found.append((name, chr(raw[11]).upper(), raw[16], raw[17], offset))
        offset += raw[16]
        at += 32
    if not found or offset > record:
        raise HeaderUnreadable("field widths do not fit the record length")
    names = unique_names([f[0] for f in found])
    return Header(version, records, header, record, tuple(Field(n, *f[1:]) for n, f in zip(names, found, strict=True)))


def text_column(block: np.ndarray, field: Field, encoding: str) -> pa.Array:
    """A column of fixed-width cells: padding trimmed, empty cells NULL."""
    cells = np.ascontiguousarray(block[:, field.offset : field.offset + field.width]).view(f"S{field.width}").ravel() if field.width else np.full(len(block), b"", "S1")
    out = []
    for c in cells.tolist():
        c = c.strip(b" \0\t\r\n")
        out.append(c.decode(encoding, "replace") if c else None)
    return pa.array(out, pa.string())


def decode(data: bytes, header: Header, columns: list[str] | None = None, encoding: str | None = None) -> pa.RecordBatch:
    """Whole records of a block (no header); deleted ones are dropped."""
    n = len(data) // header.record_length
    block = np.frombuffer(data, np.uint8, n * header.record_length).reshape(n, header.record_length)
    block = block[block[:, 0] != 0x2A]
    encoding = encoding or best_decoding(data)
    fields = [f for f in header.fields if columns is None or f.name in columns]
    if not fields:
        raise DecodeFailed("no column asked for")
    return pa.RecordBatch.from_arrays([text_column(block, f, encoding) for f in fields], names=[f.name for f in fields])


def read_bytes(data: bytes, columns: list[str] | None = None, encoding: str | None = None) -> pa.Table:
    """A whole file in memory; as many records as the header declares and the data hold."""
    h = parse_header(data)
    n = min(h.records, (len(data) - h.header_length) // h.record_length)
    body = data[h.header_length : h.header_length + n * h.record_length]
    return pa.Table.from_batches([decode(body, h, columns, encoding)])


@dataclass
class Records(InputPartition):
    path: str
    start: int
    count: int


#: The column that option sourceColumn adds: the file that a row came from.
SOURCE = "_source_path"


def _filesystem(path: str):
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def _header_of(path: str) -> tuple[Header, int]:
    fs, p = _filesystem(path)
    size = fs.get_file_info(p).size
    with fs.open_input_file(p) as f:
        head = f.read(32)
        if len(head) < 12:
            raise HeaderUnreadable(path)
        return parse_header(head + f.read(max(0, struct.unpack("<H", head[8:10])[0] - 32))), size


def encode(names: list[str], widths: list[int], rows: list[tuple], encoding: str = "latin-1") -> bytes:
    """A dBase III file of text fields."""
    head = bytearray(struct.pack("<BBBBIHH20x", 3, 100, 1, 1, len(rows), 33 + 32 * len(names), 1 + sum(widths)))
    for n, w in zip(names, widths, strict=True):
        head += struct.pack("<11sc4xBB14x", n.encode("ascii")[:10], b"C", w, 0)
    body = bytearray()
    for r in rows:
        body += b" " + b"".join(("" if v is None else str(v)).encode(encoding, "replace")[:w].ljust(w) for v, w in zip(r, widths, strict=True))
    return bytes(head) + b"\r" + bytes(body) + b"\x1a"


class DbfReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = [n for n in schema.fieldNames() if n != SOURCE]
        self.source = SOURCE in schema.fieldNames()
        self.paths = [p for p in options["path"].split(",") if p]
        self.encoding = options.get("encoding")
        self.size = int({k.lower(): v for k, v in options.items()}.get("recordsperpartition", 20 * BATCH))

    def partitions(self) -> list[InputPartition]:
        out = []
        for p in self.paths:
            if p.lower().endswith(".dbc"):  # can't be split
                out.append(Records(p, 0, -1))
                continue
            h, size = _header_of(p)
            n = min(h.records, (size - h.header_length) // h.record_length)
            out += [Records(p, i, min(self.size, n - i)) for i in range(0, n, self.size)]
        return out or [Records(self.paths[0], 0, 0)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        for b in self.batches(partition):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([partition.path] * len(b), pa.string())], names=[*b.schema.names, SOURCE]) if self.source else b

    def batches(self, partition: Records) -> Iterator[pa.RecordBatch]:
        fs, p = _filesystem(partition.path)
        if partition.count < 0:
            from .dbc import unpack

            with fs.open_input_file(p) as f:
                yield from read_bytes(unpack(f.read()), self.names, self.encoding).to_batches(BATCH)
            return
        h, _ = _header_of(partition.path)
        encoding = self.encoding
        with fs.open_input_file(p) as f:
            if not encoding:
                f.seek(h.header_length)
                encoding = best_decoding(f.read(BATCH))
            f.seek(h.header_length + partition.start * h.record_length)
            left = partition.count
            while left > 0:
                n = min(left, BATCH)
                yield decode(f.read(n * h.record_length), h, self.names, encoding)
                left -= n


class DbfSource(DataSource):
    """spark.read.format("dbf").load(path): comma-separated paths; options encoding, recordsPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "dbf"

    def schema(self) -> StructType:
        first = next(p for p in self.options["path"].split(",") if p)
        names = [f.name for f in _header_of(first)[0].fields]  # a compressed file's header is plain
        if {k.lower(): v for k, v in self.options.items()}.get("sourcecolumn") == "true":
            names.append(SOURCE)
        return StructType([StructField(n, StringType()) for n in names])

    def reader(self, schema: StructType) -> DataSourceReader:
        return DbfReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DbfSource)


def read_dbf(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    register(spark)
    joined = paths if isinstance(paths, str) else ",".join(paths)
    return spark.read.format("dbf").options(**options).load(joined)


def read_binary(files: DataFrame, sample: bytes) -> DataFrame:
    """Rows of files that `spark.read.format("binaryFile")` listed, for stores that only Spark can open. `sample`: a prefix of one of them, for the schema."""
    h = parse_header(sample)
    names = [f.name for f in h.fields]

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                data = content.as_py()
                if path.as_py().lower().endswith(".dbc"):
                    from .dbc import unpack

                    data = unpack(data)
                t = read_bytes(data, names)
                for x in t.to_batches(BATCH):
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(x), pa.string()), *x.columns], names=["_source_path", *names])

    return files.select("path", "content").mapInArrow(run, StructType([StructField("_source_path", StringType()), *[StructField(n, StringType()) for n in names]]))
