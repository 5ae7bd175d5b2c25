"""From listed files to a lake: one scan for each reader and header, and a build that skips what is current."""

from __future__ import annotations

import concurrent.futures
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import MissingColumn, NothingPublished, PartialFetch
from ..functions.naming import schema_signature
from ..functions.text import best_decoding
from ..operators import generations, normalize
from ..operators.dictionary import insert_new
from ..sources import dbf, text
from .lake import Lake

PROBES = 16


@dataclass(frozen=True)
class Group:
    """Files that one scan can read: same reader, same columns."""

    reader: str
    columns: tuple[str, ...]
    paths: tuple[str, ...]


def _header(spark: SparkSession, path: str) -> tuple[str, tuple[str, ...]]:
    """Reader and columns of one file, from its first bytes."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending in ("dbf", "dbc"):
        return ending, tuple(f.name for f in dbf._header_of(path)[0].fields)
    if ending == "parquet":
        return "parquet", tuple(spark.read.parquet(path).columns)
    head = text._prefix(spark, path)
    return f"csv/{best_decoding(head)}/{text.breaks_inside(head.decode('latin-1'))}", tuple(text.header_of(head))


def grouped(spark: SparkSession, paths: Iterable[str]) -> tuple[list[Group], list[str]]:
    """Groups of readable files and what is wrong with the others. Only headers are read, several at a time; a plan has a scan a group, not a file."""
    found: dict[tuple, list[str]] = {}
    failed = []

    def probe(path: str):
        try:
            return path, _header(spark, path), None
        except Exception as e:  # any reader's own kind; it is told and refused by the caller
            return path, None, f"{path}: {type(e).__name__}: {str(e)[:120]}"

    with concurrent.futures.ThreadPoolExecutor(PROBES) as pool:
        for path, key, error in pool.map(probe, paths):
            if error:
                failed.append(error)
            else:
                found.setdefault(key, []).append(path)
    return [Group(r, c, tuple(p)) for (r, c), p in sorted(found.items(), key=lambda x: x[1][0])], failed


def read_group(spark: SparkSession, group: Group) -> DataFrame:
    """The rows of a group's files, with the file of each in _source_path."""
    paths = list(group.paths)
    if group.reader in ("dbf", "dbc"):
        return dbf.read_dbf(spark, paths, sourceColumn="true")
    if group.reader == "parquet":
        return spark.read.parquet(*paths).select("*", F.col("_metadata.file_path").alias(dbf.SOURCE))
    _, encoding, multiline = group.reader.split("/")
    return text.read_csv(spark, paths, encoding=encoding, multiline=multiline == "True", source=dbf.SOURCE)


def normalised(spark: SparkSession, groups: list[Group], plan: normalize.Plan) -> list[DataFrame]:
    """Each group's planned columns typed; a column that no group has is refused, one that a generation lacks is NULL in the union."""
    have = {c for g in groups for c in g.columns}
    if lacking := [f.name for f in plan.fields if f.name not in have]:
        raise MissingColumn(f"planned columns that no source has: {lacking}")
    out = []
    for g in groups:
        here = normalize.Plan(tuple(f for f in plan.fields if f.name in g.columns))
        df = read_group(spark, g)
        out.append(normalize.with_provenance(normalize.normalise(df, here), source=F.col(dbf.SOURCE), signature=schema_signature(list(g.columns))))
    return out


def read_files(spark: SparkSession, paths: list[str], plan: normalize.Plan, *, allow_partial: bool = False) -> DataFrame:
    """One typed table of all files. A file that cannot be read refuses the whole unless that is allowed."""
    groups, failed = grouped(spark, paths)
    if failed and not allow_partial:
        raise PartialFetch("; ".join(failed[:20]))
    if not groups:
        raise NothingPublished("no source could be decoded")
    return generations.union(normalised(spark, groups, plan), strict=False)


def build(lake: Lake, files: DataFrame, plans: Callable[[str, str], normalize.Plan], *, rebuild: bool = False) -> list[dict]:
    """Every family of `files` (inventory.facts with size) into the lake, one job a family; families whose plan and sources are as at their last build are skipped. Outcomes: system, family, files, outcome (built, current, failed), error."""
    spark, out = lake.spark, []
    data = files.where("role = 'data'").select("system", "prefix", "geo", "year", "path", *(["size"] if "size" in files.columns else []))
    bare = lambda c: F.regexp_replace(c, "^[A-Za-z]+:/*(?=/)", "")
    for system, prefix in sorted(tuple(r) for r in data.select("system", "prefix").distinct().collect()):
        mine = data.where((F.col("system") == system) & (F.col("prefix") == prefix))
        rows = mine.collect()
        groups, failed = grouped(spark, [r["path"] for r in rows])
        out += [{"system": system, "family": prefix, "files": 1, "outcome": "failed", "error": e} for e in failed]
        sizes = {r["path"]: str(r["size"]) if "size" in mine.columns else "" for r in rows}
        for g in groups:
            family = f"{system}_{prefix}_{schema_signature(list(g.columns))[:10]}".lower()
            plan = plans(system, prefix)
            plan = normalize.Plan(tuple(f for f in plan.fields if f.name in g.columns))
            df = normalize.with_provenance(normalize.normalise(read_group(spark, g), plan), source=F.col(dbf.SOURCE), signature=schema_signature(list(g.columns)))
            where = mine.select(bare(F.col("path")).alias("__path"), F.col("geo").alias("uf"), "year")
            df = df.withColumn("__path", bare(F.col("_source_path"))).join(where, "__path", "left").drop("__path", "_ingested_at")
            signature = schema_signature([c for c in df.columns if c not in ("uf", "year")])
            mark = normalize.fingerprint(plan, [(p, sizes[p], "") for p in g.paths])
            current = not rebuild and lake.is_current(system, family, signature, mark)
            if not current:
                lake.write(df, system, family, fingerprint=mark)
            out.append({"system": system, "family": family, "files": len(g.paths), "outcome": "current" if current else "built", "error": None})
    return out


def ingest_pages(spark: SparkSession, endpoints: dict[str, Callable[[int, int], list[dict]]], root: str, *, page_size: int = 100, max_pages: int | None = None) -> list[dict]:
    """Each endpoint's pages as Parquet under root/<endpoint>, page by page, so that the driver holds one page; and an ingest row for each (L34). An endpoint is a function of page number and size that returns rows, none at the end."""
    out = []
    for name, get in sorted(endpoints.items()):
        page, rows, error = 0, 0, None
        try:
            while max_pages is None or page < max_pages:
                got = get(page, page_size)
                if not got:
                    break
                names = sorted({k for r in got for k in r})
                df = spark.createDataFrame([tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in got], ", ".join(f"`{n}` string" for n in names))
                df.write.mode("overwrite").parquet(f"{root}/{name}/page={page}")
                page, rows = page + 1, rows + len(got)
        except Exception as e:  # an endpoint's failure is its own row, the others go on
            error = f"{type(e).__name__}: {e}"[:200]
        out.append({"endpoint": name, "pages": page, "rows": rows, "error": error})
    return out


BINDING = ["system", "family", "field", "codelist"]


def pack_bindings(bindings: DataFrame, path: str) -> None:
    """Field-to-codelist bindings as one table to ship (L43): distinct keys, best confidence."""
    best = bindings.groupBy(*BINDING).agg(F.max("confidence").alias("confidence"), F.max_by("source", "confidence").alias("source"))
    best.write.mode("overwrite").option("compression", "zstd").parquet(path)


def seed_bindings(spark: SparkSession, path: str, held: DataFrame) -> DataFrame:
    """held, or the packed bindings where it holds none at all."""
    if not held.isEmpty():
        return held
    return insert_new(held, spark.read.parquet(path).select(*held.columns), BINDING)


def coverage_by_system(strata: DataFrame) -> DataFrame:
    """(system): strata, sampled, failed, pending (A57). strata: system, status (NULL: not tried)."""
    n = lambda c: F.count_if(c).alias
    return strata.groupBy("system").agg(F.count("*").alias("strata"), n(F.col("status") == "sampled")("sampled"), n(F.col("status") == "failed")("failed"), n(F.col("status").isNull())("pending"))


def census_summary(schemas: DataFrame) -> DataFrame:
    """(system, series): generations and the least and most fields of one (A66). schemas: system, series, signature, fields."""
    return schemas.groupBy("system", "series").agg(F.count_distinct("signature").alias("generations"), F.min("fields").alias("least_fields"), F.max("fields").alias("most_fields"))


def sample_plan(strata: DataFrame, *, systems: list[str] | None = None, only_pending: bool = True) -> DataFrame:
    """The strata to sample, cheapest first."""
    t = strata.where(F.col("system").isin(systems)) if systems else strata
    return (t.where("status is null") if only_pending else t).orderBy(F.col("bytes").asc_nulls_last(), "system", "series", "year")


def batches(df: DataFrame, rows: int = 65_536):
    """Record batches of up to `rows` rows, a partition at a time, so that the driver holds one partition (L08). Order is the frame's own."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, held = to_arrow_schema(df.schema), []
    for r in df.toLocalIterator(prefetchPartitions=True):
        held.append(r.asDict(recursive=True))
        if len(held) == rows:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)
