"""Text sources: delimited, JSON, XML, fixed layout, Parquet, caller data (R11-R16, R25, R30-R35). Every value stays text."""

from __future__ import annotations

import csv
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

from ..errors import DecodeFailed, HeaderUnreadable, TranslationImpossible, UnsupportedContainer
from ..functions.text import best_decoding
from .dbf import unique_names

DELIMITERS = ",;\t|"
SAMPLE = 16_384


def sniff_delimiter(sample: str) -> str:
    """The delimiter a sample parses best with, else the most frequent one of its first line."""
    try:
        return csv.Sniffer().sniff(sample, DELIMITERS).delimiter
    except csv.Error:
        first = sample.split("\n", 1)[0]
        return max(DELIMITERS, key=first.count) if any(d in first for d in DELIMITERS) else ","


def header_of(data: bytes, encoding: str | None = None) -> list[str]:
    """Column names of a delimited file's first line; what reads like a sentence is refused."""
    line = data.split(b"\n", 1)[0].decode(encoding or best_decoding(data), "replace").lstrip("\ufeff").rstrip("\r")
    names = max((next(csv.reader([line], delimiter=d)) for d in DELIMITERS), key=len)
    if not line.strip() or any(len(n) > 64 or n.count(" ") > 6 for n in names):
        raise HeaderUnreadable("the first line is not a header")
    return unique_names([n.strip().upper() for n in names])


def _prefix(spark: SparkSession, path: str) -> bytes:
    """The first bytes of a file, by Hadoop's own readers."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(p).isDirectory():
        p = next(s.getPath() for s in fs.listStatus(p) if s.isFile() and s.getLen())
    stream = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, SAMPLE)))
    finally:
        stream.close()


def breaks_inside(sample: str) -> bool:
    """Whether a quoted cell of the sample holds a line end. Two quotes in a quoted cell are one."""
    inside = False
    for c in sample:
        if c == '"':
            inside = not inside
        elif c == "\n" and inside:
            return True
    return False


def read_csv(spark: SparkSession, path: str | list[str], *, delimiter: str | None = None, encoding: str | None = None, multiline: bool | None = None, source: str | None = None) -> DataFrame:
    """All columns text, empty cells NULL, names in upper case (R11). Files of one header; they are split among tasks unless cells hold line ends: `multiline` says so, else the first file's sample. `source` names a column to add: the file of each row."""
    head = _prefix(spark, path if isinstance(path, str) else path[0])
    encoding = encoding or best_decoding(head)
    delimiter = delimiter or sniff_delimiter(head.decode(encoding, "replace"))
    native = {"utf-8": "UTF-8", "latin-1": "ISO-8859-1"}.get(encoding)
    df = spark.read.csv(path, header=True, inferSchema=False, sep=delimiter, encoding=native or "ISO-8859-1", multiLine=breaks_inside(head.decode(encoding, "replace")) if multiline is None else multiline, escape='"', emptyValue="", nullValue="")
    if source:
        df = df.select("*", F.col("_metadata.file_path").alias(source))
    own = df.columns[: len(df.columns) - bool(source)]
    first = next(csv.reader([head.decode(encoding, "replace").lstrip("\ufeff").split("\n", 1)[0].rstrip("\r")], delimiter=delimiter), [])
    names = first if len(first) == len(own) else own
    if not native:
        # Spark reads a code page it does not know as Latin-1, byte for byte; its letters are then put in their places.
        high = bytes(range(128, 256))
        table = [(a, b) for a, b in zip(high.decode("latin-1"), high.decode(encoding, "replace"), strict=True) if a != b]
        here, there = "".join(a for a, _ in table), "".join(b for _, b in table)
        df = df.select(*[F.translate(F.col(f"`{c}`"), here, there).alias(f"c{i}") for i, c in enumerate(own)], *([source] if source else []))
    names = unique_names([c.strip().lstrip("\ufeff").upper() for c in names])
    df = df.toDF(*names, *([source] if source else []))
    return df.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in names], *([source] if source else []))


def flattened(df: DataFrame) -> DataFrame:
    """Every column as text; nested ones as JSON."""
    return df.select(*[(F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, StructType | ArrayType | MapType) else F.col(f"`{f.name}`").cast("string")).alias(f.name) for f in df.schema.fields])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Lines of objects, or a document whose longest array of objects is the table."""
    head = _prefix(spark, path).lstrip()
    first = head.split(b"\n", 1)[0]
    try:
        lines = isinstance(json.loads(first), dict) and head[:1] == b"{"
    except ValueError:
        lines = False
    df = spark.read.json(path, multiLine=not lines, primitivesAsString=True)
    if not lines or any(isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType) for f in df.schema.fields) and b"\n" not in head.strip():
        arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType)]
        if arrays:
            sizes = df.select(*[F.coalesce(F.max(F.size(f"`{a}`")), F.lit(0)).alias(a) for a in arrays]).first()
            best = max(arrays, key=lambda a: sizes[a])
            df = df.select(F.inline(f"`{best}`"))
    return flattened(df)


def read_xml(spark: SparkSession, path: str, row_tag: str | None = None) -> DataFrame:
    """Rows are the most frequent repeated tag; attributes and children are columns."""
    if not row_tag:
        import re
        from collections import Counter

        tags = Counter(re.findall(rb"<([A-Za-z_][\w.-]*)[\s>/]", _prefix(spark, path)))
        body = _prefix(spark, path)
        parents = [t for t, n in tags.items() if n > 1 and re.search(rb"<" + t + rb"[\s>][^<]*<[A-Za-z_]|<" + t + rb"\s+[\w.-]+=", body)]
        if not parents:
            raise DecodeFailed("no repeated element")
        row_tag = max(parents, key=lambda t: tags[t]).decode()
    df = spark.read.format("xml").options(rowTag=row_tag, attributePrefix="", valueTag="VALUE", inferSchema=False).load(path)
    return flattened(df)


def read_parquet(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.limit(limit) if limit else df


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """A workbook's active sheet as text; needs openpyxl, which is optional."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise UnsupportedContainer("reading workbooks needs openpyxl") from e
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, dtype=str))


def parse_layout(text: str) -> list[tuple[str, int, int]]:
    """(name, start, length) of a layout of lines name,size,start,end,type; starts count from 1."""
    out = []
    for row in csv.reader(text.splitlines()):
        if len(row) >= 4 and row[2].strip().isdigit():
            out.append((row[0].strip().upper(), int(row[2]), int(row[3]) - int(row[2]) + 1))
    if not out:
        raise DecodeFailed("no field in the layout")
    return out


def read_fixed(spark: SparkSession, path: str, layout: list[tuple[str, int, int]], encoding: str = "ISO-8859-1") -> DataFrame:
    """Lines cut by a layout."""
    lines = spark.read.text(path) if encoding == "UTF-8" else spark.read.csv(path, schema="value string", sep="\x01", encoding=encoding, quote="")
    return lines.select(*[F.nullif(F.trim(F.substring("value", s, n)), F.lit("")).alias(c) for c, s, n in layout])


def accept(spark: SparkSession, data) -> DataFrame:
    """A caller's table: Spark, Arrow or pandas frame, or a CSV or Parquet path (R35). Pandas text stays text."""
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, str):
        return read_parquet(spark, data) if data.lower().rstrip("/").endswith(".parquet") else read_csv(spark, data)
    if hasattr(data, "to_arrow") and not hasattr(data, "schema"):
        data = data.to_arrow()
    try:
        import pyarrow as pa

        if isinstance(data, pa.RecordBatch):
            data = pa.Table.from_batches([data])
        return spark.createDataFrame(data)
    except (TypeError, ValueError) as e:
        raise TranslationImpossible(f"cannot read {type(data).__name__}") from e


def pages(fetch, page_size: int = 100, max_pages: int | None = None):
    """Rows of a paged service: fetch(offset, limit) until a page is short (R32). Each row is text, nested values JSON."""
    k = 0
    while max_pages is None or k < max_pages:
        rows = fetch(k * page_size, page_size)
        for r in rows:
            yield {n: json.dumps(v, ensure_ascii=False) if isinstance(v, dict | list) else None if v is None else str(v).lower() if isinstance(v, bool) else str(v) for n, v in r.items()}
        if len(rows) < page_size:
            return
        k += 1


def pages_table(spark: SparkSession, fetch, **options) -> DataFrame:
    rows = list(pages(fetch, **options))
    names = list(dict.fromkeys(n for r in rows for n in r))
    from pyspark.sql.types import StructField

    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], StructType([StructField(n, StringType()) for n in names]))


def endpoints(spec: dict) -> list[dict]:
    """path, method, summary and parameters of a Swagger 2 or OpenAPI 3 document."""
    base = spec.get("basePath") or next((s.get("url", "") for s in spec.get("servers", [])), "")
    return [
        {"path": base.rstrip("/") + path, "method": m, "summary": op.get("summary", ""), "parameters": [p.get("name") for p in op.get("parameters", [])]}
        for path, ops in sorted(spec.get("paths", {}).items())
        for m, op in sorted(ops.items())
        if m in ("get", "post", "put", "delete", "patch")
    ]
