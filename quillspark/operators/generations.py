"""Schema generations: identity, union by name, drift, renames, availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, DoubleType, FractionalType, IntegralType, LongType, NullType, StringType

from ..errors import MissingColumn, SchemaConflict
from ..functions.naming import schema_signature


def families(presence: DataFrame) -> DataFrame:
    """(system, series, signature, family, first_year, last_year, files) of files with their ordered column names (A58). presence: system, series, year, path, names."""
    from ..functions.naming import family_id, schema_signature_col

    t = presence.withColumn("signature", schema_signature_col(F.col("names")))
    out = t.groupBy("system", "series", "signature").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_distinct("path").alias("files"))
    return out.withColumn("family", family_id(F.col("system"), F.col("series"), F.col("signature")))


def _wider(a: DataType, b: DataType) -> DataType | None:
    if a == b:
        return a
    if isinstance(a, NullType) or isinstance(b, NullType):
        return b if isinstance(a, NullType) else a
    if isinstance(a, IntegralType) and isinstance(b, IntegralType):
        return LongType()
    number = IntegralType | FractionalType
    if isinstance(a, number) and isinstance(b, number):
        if isinstance(a, DecimalType) and isinstance(b, DecimalType):
            scale = max(a.scale, b.scale)
            return DecimalType(min(38, max(a.precision - a.scale, b.precision - b.scale) + scale), scale)
        return DoubleType()
    return None


def unified(schemas: list, strict: bool = True) -> dict[str, DataType]:
    """Columns in order of first sight with one type each; types that do not widen are refused, or become text."""
    out: dict[str, DataType] = {}
    for s in schemas:
        for f in s.fields:
            kind = _wider(out.get(f.name, f.dataType), f.dataType)
            if kind is None:
                if strict:
                    raise SchemaConflict(f"{f.name}: {out[f.name].simpleString()} and {f.dataType.simpleString()}")
                kind = StringType()
            out[f.name] = kind
    return out


def conformed(df: DataFrame, columns: dict[str, DataType]) -> DataFrame:
    """df with exactly these columns; missing ones are NULL of their type."""
    return df.select(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def union(parts: list[DataFrame], strict: bool = True) -> DataFrame:
    """All generations under one schema, by name."""
    columns = unified([p.schema for p in parts], strict)
    out = conformed(parts[0], columns)
    for p in parts[1:]:
        out = out.unionByName(conformed(p, columns))
    return out


def with_columns_or_refusal(parts: dict[str, DataFrame], wanted: list[str], on_missing: str = "raise") -> DataFrame:
    """The wanted columns of all generations; one that lacks any is refused with the names of those that have it, or filled with NULL."""
    if on_missing not in ("raise", "null_fill"):
        raise ValueError(on_missing)
    every = unified([p.schema for p in parts.values()], strict=False)
    for name, p in parts.items():
        lacking = [c for c in wanted if c not in p.columns]
        if lacking and (on_missing == "raise" or any(c not in every for c in lacking)):
            carriers = {c: [n for n, q in parts.items() if c in q.columns] for c in lacking}
            raise MissingColumn(f"{name} lacks {lacking}; carried by {carriers}")
    return union([conformed(p, {c: every[c] for c in wanted}) for p in parts.values()], strict=False)


def presence(parts: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """(family, signature, field, position)."""
    rows = [(n, schema_signature(p.columns), c, i) for n, p in parts.items() for i, c in enumerate(p.columns)]
    return spark.createDataFrame(rows, "family string, signature string, field string, position int")


def drift(matrix: DataFrame) -> DataFrame:
    """(field, families, of, state): always or sometimes there (A39). One generation alone is insufficient."""
    total = matrix.agg(F.count_distinct("family").alias("of"))
    t = matrix.groupBy("field").agg(F.count_distinct("family").alias("families")).join(F.broadcast(total))  # one row
    return t.select("field", "families", "of", F.when(F.col("of") < 2, "insufficient").when(F.col("families") == F.col("of"), "always").otherwise("sometimes").alias("state"))


def renames(matrix: DataFrame) -> DataFrame:
    """(old, new, stem): fields that vanish where fields of their stem with a number appear, never both in one generation."""
    t = matrix.select("family", "field").distinct()
    stem = F.upper(F.regexp_replace("field", r"[_\d]+$", ""))
    t = t.withColumn("stem", stem)
    old, new = t.where(~F.col("field").rlike(r"\d$")), t.where(F.col("field").rlike(r"\d$"))
    near = F.startswith(F.col("o.stem"), F.col("n.stem")) | F.startswith(F.col("n.stem"), F.col("o.stem"))
    a, b = old.select("field", "stem").distinct().alias("o"), new.select("field", "stem").distinct().alias("n")
    # Field names are few; the first letters are the join key.
    pairs = a.join(b, (F.substring("o.stem", 1, 3) == F.substring("n.stem", 1, 3)) & near).select(F.col("o.field").alias("old"), F.col("n.field").alias("new"), F.col("n.stem").alias("stem"))
    both = t.alias("x").join(t.alias("y"), "family").select(F.col("x.field").alias("old"), F.col("y.field").alias("new"))
    return pairs.join(both.distinct(), ["old", "new"], "left_anti")


def signature_history(matrix: DataFrame, order: DataFrame) -> DataFrame:
    """Generations collapsed by signature, with the columns each adds and drops against the one before (A48). order: family, first_year."""
    g = matrix.join(order, "family").groupBy("signature").agg(F.min("first_year").alias("first_year"), F.array_sort(F.collect_set("field")).alias("fields"))
    prev = F.lag("fields").over(Window.orderBy("first_year", "signature"))  # a row a generation
    return g.withColumn("prev", prev).select("signature", "first_year", F.array_join(F.array_except("fields", F.coalesce("prev", F.array().cast("array<string>"))), ",").alias("added"), F.array_join(F.array_except(F.coalesce("prev", F.array().cast("array<string>")), "fields"), ",").alias("dropped"))


def intervals(years: DataFrame, by: list[str], known: DataFrame | None = None) -> DataFrame:
    """Contiguous runs of years: by, first, last (A43, A70). Years that `known` (by column year) lacks were never decoded and do not split a run."""
    w = Window.partitionBy(*by).orderBy("year")
    t = years.select(*by, "year").distinct()
    if known is None:
        t = t.withColumn("rank", F.col("year"))
    else:
        rank = known.select("year").distinct().withColumn("rank", F.row_number().over(Window.orderBy("year")))  # a row a year
        t = t.join(F.broadcast(rank), "year")
    t = t.withColumn("run", F.col("rank") - F.row_number().over(w))
    return t.groupBy(*by, "run").agg(F.min("year").alias("first"), F.max("year").alias("last"), F.count("*").alias("years")).drop("run")


def availability(years: DataFrame, decoded: DataFrame, span: DataFrame) -> DataFrame:
    """(field, year, state) for every field and year: unknown where no schema of the year was decoded, else present, partial or absent (A42, A46, A47). years: field, year, files; decoded: year, files; span: year."""
    grid = years.select("field").distinct().join(span.select("year").distinct())  # fields x years, both few
    t = grid.join(decoded.select("year", F.col("files").alias("of")), "year", "left").join(years, ["field", "year"], "left")
    state = F.when(F.col("of").isNull(), "unknown").when(F.col("files").isNull(), "absent").when(F.col("files") < F.col("of"), "partial").otherwise("present")
    return t.select("field", "year", state.alias("state"))


def change_boundaries(years: DataFrame) -> DataFrame:
    """(year, added, dropped): columns that appear or vanish against the year decoded before (A45). years: field, year."""
    g = years.groupBy("year").agg(F.array_sort(F.collect_set("field")).alias("fields"))
    prev = F.lag("fields").over(Window.orderBy("year"))  # a row a year
    t = g.withColumn("prev", prev).where("prev is not null")
    t = t.select("year", F.array_join(F.array_except("fields", "prev"), ",").alias("added"), F.array_join(F.array_except("prev", "fields"), ",").alias("dropped"))
    return t.where("added <> '' or dropped <> ''")


def pruned(parts: DataFrame, ufs: list[str] | None = None, years: list[int] | None = None) -> DataFrame:
    """Families with a partition that the filters match (F16). A partition without a year or state is evidence of nothing and stays. parts: family, uf, year."""
    keep: Column = F.lit(True)
    if ufs:
        keep = keep & (F.col("uf").isNull() | F.col("uf").isin(ufs))
    if years:
        keep = keep & (F.col("year").isNull() | F.col("year").isin(years))
    return parts.where(keep).select("family").distinct()
