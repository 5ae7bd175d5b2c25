"""A partitioned Parquet lake: writes, currency, pruned reads, views, exports.

Layout: <root>/<system>/<family>/schema_signature=/uf=/year=. Reads go through partition discovery, so filters on
state and year prune folders and data predicates reach row groups; nothing is listed or read twice.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..errors import DecodeFailed, MissingColumn, NothingPublished
from ..functions.naming import schema_signature
from ..operators import generations
from ..operators.inventory import clean_states

PARTITIONS = ["schema_signature", "uf", "year"]


class Files:
    """Hadoop's view of a folder, so that any store Spark can write will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")

    def path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def fs(self):
        return self.path().getFileSystem(self.conf)

    def names(self, name: str = "") -> list[str]:
        p = self.path(name)
        return sorted(s.getPath().getName() for s in self.fs().listStatus(p)) if self.fs().exists(p) else []

    def size(self, name: str = "") -> int:
        p = self.path(name)
        return self.fs().getContentSummary(p).getLength() if self.fs().exists(p) else 0

    def delete(self, name: str) -> bool:
        return self.fs().delete(self.path(name), True)

    def rename(self, old: str, new: str) -> None:
        """Staged output takes its place; empty output is refused (L14, L15). What stood there is set aside first and comes back if the new one cannot take its place, so that no step loses both."""
        if not self.fs().exists(self.path(old)):
            raise DecodeFailed(f"nothing staged at {old}")
        self.fs().mkdirs(self.path(new).getParent())
        aside = f"{new}.old-{uuid.uuid4().hex}" if self.fs().exists(self.path(new)) else None
        if aside and not self.fs().rename(self.path(new), self.path(aside)):
            raise OSError(f"{new} could not be set aside")
        if not self.fs().rename(self.path(old), self.path(new)):
            if aside:
                self.fs().rename(self.path(aside), self.path(new))
            raise OSError(f"{old} could not take the place of {new}")
        if aside:
            self.delete(aside)

    def write(self, name: str, text: str) -> None:
        out = self.fs().create(self.path(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, name: str) -> str | None:
        if not self.fs().exists(self.path(name)):
            return None
        s = self.fs().open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(s)).decode()
        finally:
            s.close()


class Lake:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    # -- writing

    def write(self, df: DataFrame, system: str, family: str, *, uf: str = "uf", year: str = "year", fingerprint: str | None = None, max_records: int = 5_000_000) -> str:
        """Replace the partitions that df holds; zstd, dictionary-encoded, rows gathered by partition so that a partition is few files."""
        names = [c for c in df.columns if c not in (uf, year)]
        signature = schema_signature(names)
        out = df.withColumns({"schema_signature": F.lit(signature), "uf": F.coalesce(F.col(uf).cast("string"), F.lit("__none__")), "year": F.coalesce(F.col(year).cast("int"), F.lit(0))})
        # AQE splits a partition that is large and joins small ones: rebalancing, not hashing, so one huge year is not one task.
        out = out.hint("rebalance", *PARTITIONS)
        path = f"{self.root}/{system}/{family}"
        out.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", max_records).option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)
        if fingerprint:
            self.files.write(f"{system}/{family}/_fingerprints/{signature}.json", json.dumps({"fingerprint": fingerprint}))
        return signature

    def is_current(self, system: str, family: str, signature: str, fingerprint: str) -> bool:
        """Whether a family was built with this fingerprint and its files are there."""
        kept = self.files.read(f"{system}/{family}/_fingerprints/{signature}.json")
        return bool(kept) and json.loads(kept)["fingerprint"] == fingerprint and bool(self.files.size(f"{system}/{family}/schema_signature={signature}"))

    def clear(self, system: str, family: str, signature: str, uf: str, year: int) -> bool:
        return self.files.delete(f"{system}/{family}/schema_signature={signature}/uf={uf}/year={year}")

    # -- listing

    def systems(self) -> list[str]:
        return [n for n in self.files.names() if not n.startswith(("_", "."))]

    def families(self, system: str) -> list[str]:
        return [n for n in self.files.names(system) if not n.startswith(("_", "."))]

    def partitions(self, system: str, family: str) -> list[dict]:
        out = []
        base = f"{system}/{family}"
        for s in self.files.names(base):
            if s.startswith("schema_signature="):
                for u in self.files.names(f"{base}/{s}"):
                    out += [{"signature": s.split("=", 1)[1], "uf": u.split("=", 1)[1], "year": int(y.split("=", 1)[1])} for y in self.files.names(f"{base}/{s}/{u}") if y.startswith("year=")]
        return out

    def bytes_on_disk(self) -> int:
        return self.files.size()

    # -- reading

    def family(self, system: str, family: str) -> DataFrame:
        """All of a family, one schema."""
        if not self.files.names(f"{system}/{family}"):
            raise NothingPublished(f"{system}/{family}")
        return self.spark.read.option("basePath", f"{self.root}/{system}/{family}").option("mergeSchema", True).parquet(f"{self.root}/{system}/{family}/schema_signature=*")

    def scan(self, system: str, family: str, *, uf=None, years=None, columns: list[str] | None = None, optional: list[str] = (), where: str | None = None) -> DataFrame:
        """Pruned by state and year, cut to columns, filtered (L02-L04, F01, F02). No columns: all; an empty list: rows without columns."""
        df = self.family(system, family)
        if uf:
            df = df.where(F.col("uf").isin(clean_states(uf)))
        if years:
            df = df.where(F.col("year").isin([years] if isinstance(years, int) else list(years)))
        if where:
            df = df.where(where)
        if columns is None:
            return df
        if lacking := [c for c in columns if c not in df.columns]:
            raise MissingColumn(f"{system}/{family} lacks {lacking}")
        picked = list(dict.fromkeys([*columns, *[c for c in optional if c in df.columns]]))
        return df.select(*[F.col(f"`{c}`") for c in picked])

    def generations(self, system: str, series: str | None = None) -> dict[str, DataFrame]:
        """One lazy frame a family whose name begins with system_series."""
        names = [f for f in self.families(system) if not series or f == series or f.startswith((f"{system}_{series}_", f"{series}_"))]
        if not names:
            raise NothingPublished(f"{system} {series or ''}")
        return {f: self.family(system, f) for f in names}

    def scan_generations(self, system: str, series: str | None = None, *, columns: list[str] | None = None, on_missing: str = "raise", **filters) -> DataFrame:
        """All generations of a dataset under one schema."""
        parts = {}
        for name in self.generations(system, series):
            parts[name] = self.scan(system, name, **filters)
        if columns is not None:
            return generations.with_columns_or_refusal(parts, columns, on_missing)
        return generations.union(list(parts.values()), strict=False)

    def count(self, system: str, family: str, **filters) -> int:
        """Rows, from footers alone where only partitions are filtered: Spark's aggregate push-down answers count(*) without reading pages."""
        return self.scan(system, family, columns=[], **filters).count() if not filters.get("where") else self.scan(system, family, **filters).count()

    # -- SQL

    def open(self) -> list[str]:
        """A view for each family and one for each system over all its generations, by name."""
        made = []
        for s in self.systems():
            parts = []
            for f in self.families(s):
                df = self.family(s, f)
                view = f if f.lower().startswith(s.lower()) else f"{s}_{f}"
                df.createOrReplaceTempView(view)
                made.append(view)
                parts.append(df)
            if parts:
                generations.union(parts, strict=False).createOrReplaceTempView(s)
                made.append(s)
        return sorted(made)

    def sql(self, statement: str, *params, **named) -> DataFrame:
        """Any SQL over the views, with positional or named parameters."""
        return self.spark.sql(statement, args=list(params) if params else named or None)

    def views(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables() if t.isTemporary)

    def describe(self, view: str) -> list[tuple[str, str]]:
        return [(f.name, f.dataType.simpleString()) for f in self.spark.table(view).schema.fields]


def text_ready(df: DataFrame, separator: str = " | ") -> DataFrame:
    """List columns joined, for sinks of text."""
    return df.select(*[(F.array_join(F.transform(F.col(f"`{f.name}`"), lambda x: x.cast("string")), separator) if isinstance(f.dataType, ArrayType) else F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields])


def export(df: DataFrame, path: str, format: str | None = None) -> str:
    """CSV, Parquet (zstd) or a workbook (L23-L25). CSV has one header a file, also when there are no rows."""
    format = format or path.rsplit(".", 1)[-1].lower()
    if format == "parquet":
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    elif format == "csv":
        out = text_ready(df)
        if out.isEmpty():
            out = out.coalesce(1)
        out.write.mode("overwrite").csv(path, header=True, quoteAll=False, escape='"', emptyValue="")
    elif format == "json":
        df.write.mode("overwrite").json(path)
    elif format == "xlsx":
        from ..errors import UnsupportedContainer

        try:
            import openpyxl  # noqa: F401
        except ImportError as e:
            raise UnsupportedContainer("writing workbooks needs openpyxl") from e
        if df.limit(1_048_576).count() >= 1_048_576:
            raise ValueError("a sheet holds 1,048,575 rows")
        text_ready(df).toPandas().to_excel(path, index=False)
    else:
        raise ValueError(f"unknown format: {format}")
    return path


def write_reference(spark: SparkSession, entries: DataFrame, root: str) -> None:
    """The reference warehouse: codelist=/system=/window=, with code widths; a window is told from valid_from, so tables that share a start stay apart; the folders register the tables."""
    key = F.concat_ws("_", F.coalesce(F.col("valid_from").cast("string"), F.lit("")), F.coalesce(F.col("valid_to").cast("string"), F.lit("")))
    out = entries.withColumns({"code_width": F.length("code"), "window": key})
    out.hint("rebalance", "codelist", "system").write.mode("overwrite").option("compression", "zstd").partitionBy("codelist", "system", "window").parquet(f"{root}/reference")


def read_reference(spark: SparkSession, root: str, codelist: str, *, system: str | None = None, moment: int | None = None, width: int | None = None) -> DataFrame:
    """One codelist at one moment: system scope, window and width resolved."""
    from ..operators import codelists

    df = spark.read.option("basePath", f"{root}/reference").parquet(f"{root}/reference").where(F.col("codelist") == codelist).withColumn("code", F.col("code").cast("string"))
    if system:
        df = codelists.scoped(df, system).drop("borrowed")
    if width:
        df = df.where(F.col("code_width") == width)
    return codelists.at_moments(df, spark.createDataFrame([(moment,)], "moment int")).drop("moment")


def reference_tables(spark: SparkSession, root: str) -> DataFrame:
    """Codelists and windows on disk."""
    return spark.read.parquet(f"{root}/reference").select("codelist", "system", "window").distinct()


def blob_path(root: str, data: bytes) -> str:
    """Where content-addressed bytes lie."""
    import hashlib

    h = hashlib.sha256(data).hexdigest()
    return f"{root.rstrip('/')}/{h[:2]}/{h}"
