"""Claims that a code means a label, merged by authority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sources in order of authority, with the confidence a claim of theirs has.
AUTHORITY = {"manual": (0, 1.0), "cnv": (1, 0.95), "def": (2, 0.9), "sigtap": (3, 0.9), "dbf_lookup": (4, 0.9), "demas_api": (5, 0.7), "pdf": (6, 0.5), "community": (7, 0.4), "inferred": (8, 0.3)}
KEY = ["system", "codelist", "code", "valid_from"]


def authority(source: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, (n, _) in AUTHORITY.items() for x in (k, n)])
    return F.coalesce(F.try_element_at(table, source), F.lit(99))


def confidence(source: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, (_, c) in AUTHORITY.items() for x in (k, c)])
    return F.coalesce(F.try_element_at(table, source), F.lit(0.0))


def merge(claims: DataFrame, key: list[str] = KEY) -> DataFrame:
    """One claim a key: best authority, ties to the newer (column seq). NULL keys are equal to each other, as windows group them."""
    best = Window.partitionBy(*key).orderBy(authority(F.col("source")), F.col("seq").desc(), "label")
    return claims.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def conflicts(claims: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Keys whose sources disagree: kept label, and the others in order."""
    kept = F.min_by("label", F.struct(authority(F.col("source")), -F.col("seq"), F.col("label")))
    return claims.groupBy(*key).agg(kept.alias("kept"), F.array_sort(F.collect_set("label")).alias("all")).where(F.size("all") > 1).select(*key, "kept", F.array_join(F.array_remove("all", F.col("kept")), " | ").alias("others"))


def insert_new(known: DataFrame, entries: DataFrame, key: list[str] = KEY) -> DataFrame:
    """known and those entries whose key it lacks; NULL keys compare equal."""
    e, k = entries.alias("e"), known.select(*key).distinct().alias("k")
    on = [F.col(f"e.{c}").eqNullSafe(F.col(f"k.{c}")) for c in key]
    return known.unionByName(e.join(k, on, "left_anti").select(*[F.col(f"e.{c}") for c in entries.columns]))


def bound_only(entries: DataFrame, bindings: DataFrame) -> DataFrame:
    """Entries of codelists that some field of their system uses."""
    return entries.join(bindings.select("system", "codelist").distinct(), ["system", "codelist"], "left_semi")


def collapsed(entries: DataFrame, most_codes: int | None = None) -> DataFrame:
    """One row an identity over all its windows; codelists of more than `most_codes` rows are left out where a limit is given."""
    out = entries.groupBy("system", "codelist", "code", "label").agg(F.min("valid_from").alias("valid_from"), F.when(F.count("valid_to") == F.count("*"), F.max("valid_to")).alias("valid_to"), F.max("confidence").alias("confidence"))
    if most_codes:
        small = out.groupBy("system", "codelist").count().where(F.col("count") <= most_codes).drop("count")
        out = out.join(small, ["system", "codelist"], "left_semi")
    return out


def replaced(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Derived rows are replaced whole: of keys that `new` has, only its rows stay."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def consensus(names: DataFrame) -> DataFrame:
    """The most used display name of each field, ties to the shorter, and whether it is disputed (A88). names: system, field, name."""
    n = names.groupBy("system", "field", "name").agg(F.count("*").alias("n"))
    return n.groupBy("system", "field").agg(F.max_by("name", F.struct(F.col("n"), -F.length("name"), F.col("name"))).alias("name"), (F.count("*") > 1).alias("disputed"))


def place_index(codes: DataFrame) -> DataFrame:
    """(six, seven): seven-digit rows win, six-digit ones are completed by their check digit."""
    from ..functions.geo import seven_digits

    t = codes.select(F.col("code"), seven_digits(F.col("code")).alias("seven")).where("seven is not null")
    rank = F.when(F.length("code") == 7, 0).otherwise(1)
    return t.groupBy(F.substring("seven", 1, 6).alias("six")).agg(F.min_by("seven", F.struct(rank, F.col("seven"))).alias("seven"))
