"""The public surface: fetch, load, scan, translate, describe, info, explore, search, export."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import codelists, generations, inventory, normalize, profile, render
from .plans import build as builds
from .plans import lake as lakes
from .plans import meaning
from .sources import text

Profile = render.Profile


def open_lake(spark: SparkSession, root: str) -> lakes.Lake:
    """A lake with every view registered."""
    lake = lakes.Lake(spark, root)
    lake.open()
    return lake


def scan(lake: lakes.Lake, system: str, series: str | None = None, *, uf=None, years=None, columns=None, where=None, on_missing_column: str = "raise") -> DataFrame:
    """Lazy rows of all generations, codes as they are."""
    return lake.scan_generations(system, series, columns=columns, on_missing=on_missing_column, uf=uf, years=years, where=where)


def load(lake: lakes.Lake, system: str, series: str | None = None, *, reference: DataFrame | None = None, docs: Iterable[render.FieldDoc] = (), profile: str | Profile = "analysis", moment: Column | None = None, **filters) -> tuple[DataFrame, render.Report]:
    """Rows with labels of each row's own year."""
    df = scan(lake, system, series, **filters)
    if reference is None:
        return df, render.Report()
    if moment is None and "year" in df.columns:
        moment = F.when(F.col("year") > 0, F.col("year") * 100).cast("int")
    return render.render(df, list(docs), reference, system=system, profile=profile, moment=moment)


def translate(spark: SparkSession, data, *, reference: DataFrame, docs: Iterable[render.FieldDoc], system: str = "*", year: int | None = None, profile: str | Profile = "analysis") -> tuple[DataFrame, render.Report]:
    """Labels for a caller's own table."""
    df = text.accept(spark, data)
    moment = F.lit(year * 100) if year else None
    return render.render(df, list(docs), reference, system=system, profile=profile, moment=moment)


def fetch(spark: SparkSession, files: DataFrame, *, plan: normalize.Plan, uf=None, years=None, months=None, columns: list[str] | None = None, reference: DataFrame | None = None, docs: Iterable[render.FieldDoc] = (), profile: str | Profile = "analysis", max_bytes: int | None = None, allow_partial: bool = False) -> tuple[DataFrame, render.Report]:
    """From listed files (see inventory.facts) to a labelled table: select, decode, normalise, render. A source that cannot be decoded refuses the whole unless that is allowed."""
    chosen = inventory.select_files(files, ufs=uf, years=years, months=months, max_bytes=max_bytes).select("path").collect()
    df = builds.read_files(spark, [r["path"] for r in chosen], plan, allow_partial=allow_partial)
    if columns is not None:
        df = df.select(*normalize.needed(columns, {}))
    if reference is None:
        return df, render.Report()
    return render.render(df, list(docs), reference, profile=profile)


def load_reference(spark: SparkSession, root: str, table: str, *, year: int | None = None, competence: int | None = None, system: str | None = None, code_width: int | None = None) -> DataFrame:
    """One codelist at one moment."""
    return lakes.read_reference(spark, root, table, system=system, moment=competence or (year * 100 if year else None), width=code_width)


def describe(df: DataFrame, field: str, codes: DataFrame | None = None, top: int = 20) -> DataFrame:
    """A field's most frequent values with labels."""
    out = profile.top_values(profile.frequencies(df, [field]), top).drop("field")
    return codelists.label_once(out, "value", codes) if codes is not None else out


def info(lake: lakes.Lake, system: str | None = None) -> DataFrame:
    """Families of a lake, or of one system."""
    t = meaning.compendium(lake)["families"]
    return t.where(F.col("system") == system) if system else t


def explore(files: DataFrame, system: str | None = None, series: str | None = None) -> DataFrame:
    """What exists: systems, then a system's series, then a series' files by state and year."""
    t = files.withColumnRenamed("prefix", "series") if "series" not in files.columns else files
    span = lambda: F.concat_ws("–", F.min("year").cast("string"), F.max("year").cast("string")).alias("years")
    if system is None:
        return t.groupBy("system").agg(F.count("*").alias("files"), F.count_distinct("series").alias("series"), span())
    t = t.where(F.col("system") == system)
    if series is None:
        return t.groupBy("series").agg(F.count("*").alias("files"), F.count_distinct("geo").alias("states"), span())
    return t.where(F.col("series") == series).groupBy("geo", "year").agg(F.count("*").alias("files"))


def load_population(df: DataFrame, *, uf=None, years=None, by: tuple[str, ...] = ()) -> DataFrame:
    """Population by the axes asked for; axes that the series lacks are refused."""
    from .errors import UnsupportedStratification

    if lacking := [a for a in by if a not in df.columns]:
        raise UnsupportedStratification(f"not split by {lacking}")
    if uf:
        df = df.where(F.col("uf").isin(inventory.clean_states(uf)))
    if years:
        df = df.where(F.col("year").isin([years] if isinstance(years, int) else list(years)))
    return df.groupBy("municipality", "year", *by).agg(F.sum("population").alias("population"))


batches, build = builds.batches, builds.build
search, export, pack, unpack, read_manifest, compendium = meaning.search, lakes.export, meaning.pack, meaning.unpack, meaning.read_manifest, meaning.compendium
field_availability, availability_windows = generations.availability, generations.intervals
