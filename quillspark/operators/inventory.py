"""Files, strata, systems, snapshots and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DatasetUnknown, FilterHasNoAxis, MassDisappearance, NothingPublished, RequestTooLarge
from ..functions.naming import UFS, canonical_series, logical_id, parse_file_name, resolved_date, role_of, system_of

PRESENT, COMPLETE = 0.5, 0.999


def facts(files: DataFrame, base: str = "", convention: Column | str = "monthly") -> DataFrame:
    """One row a file: system, prefix, geo, date, year, role, logical id, from its path alone (P40-P47). files: path."""
    p = parse_file_name(F.col("path"))
    t = files.withColumns({"system": system_of(F.col("path"), base), "prefix": p.prefix, "geo": p.geo, "digits": p.digits, "role": role_of(F.col("path"))})
    t = t.withColumn("date", resolved_date(F.col("digits"), convention))
    return t.withColumns({"year": F.nullif(F.floor(F.col("date") / 100).cast("int"), F.lit(0)), "logical_id": logical_id(F.col("system"), F.col("prefix"), F.col("geo"), F.col("date"), F.col("path"))})


def strata(files: DataFrame) -> DataFrame:
    """(system, series, year): files, bytes, and the cheapest sample: least (size, path), unknown sizes last."""
    cheap = F.min_by("path", F.struct(F.col("size").isNull(), F.col("size"), F.col("path")))
    return files.groupBy("system", "series", "year").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), cheap.alias("sample"))


def axis_shares(files: DataFrame) -> DataFrame:
    """(system, series, axis, share, present, complete): how far a dataset's files are split by state, year and month (F06). Annual dates carry no month."""
    share = {"uf": F.col("geo").isNotNull(), "year": F.col("year").isNotNull(), "month": F.coalesce(F.col("date") % 100 > 0, F.lit(False))}
    t = files.groupBy("system", "series").agg(*[F.round(F.avg(c.cast("double")), 6).alias(k) for k, c in share.items()])
    t = t.select("system", "series", F.explode(F.array(*[F.struct(F.lit(k).alias("axis"), F.col(k).alias("share")) for k in share])).alias("s")).select("system", "series", "s.axis", "s.share")
    return t.withColumns({"present": F.col("share") >= PRESENT, "complete": F.col("share") >= COMPLETE})


def clean_states(values: list[str] | None) -> list[str] | None:
    """Upper case, without repeats; unknown ones are refused."""
    if values is None:
        return None
    out = list(dict.fromkeys(v.strip().upper() for v in ([values] if isinstance(values, str) else values)))
    if bad := [v for v in out if v not in UFS]:
        raise ValueError(f"unknown states: {bad}")
    return out


def clean_months(values: list[int] | None) -> list[int] | None:
    """1 to 12, in order; others are refused."""
    if values is None:
        return None
    out = sorted({int(v) for v in ([values] if isinstance(values, int) else values)})
    if bad := [v for v in out if not 1 <= v <= 12]:
        raise ValueError(f"not months: {bad}")
    return out


def refuse_missing_axes(shares: DataFrame, system: str, series: str, *, uf=None, years=None, months=None) -> list[str]:
    """Refuse filters on axes that a dataset's files do not carry; return those it carries in part."""
    rows = {r["axis"]: r for r in shares.where((F.col("system") == system) & (F.col("series") == series)).collect()}  # three rows
    asked = [a for a, v in (("uf", uf), ("year", years), ("month", months)) if v]
    if none := [a for a in asked if a not in rows or not rows[a]["present"]]:
        raise FilterHasNoAxis(f"{system}.{series} is not split by {none}")
    return [a for a in asked if not rows[a]["complete"]]


def select_files(files: DataFrame, *, ufs=None, years=None, months=None, max_files: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """The files that filters pick, in order of year and path; over a size limit the request is refused before any work."""
    t = files.where("role = 'data'") if "role" in files.columns else files
    if ufs:
        t = t.where(F.col("geo").isin(clean_states(ufs)))
    if years:
        t = t.where(F.col("year").isin(list(years)))
    if months:
        t = t.where((F.col("date") % 100).isin(clean_months(months)))
    t = t.orderBy("year", "path")
    if max_files:
        t = t.limit(max_files)
    n, total = t.agg(F.count("*"), F.sum("size")).first() if "size" in t.columns else (t.count(), 0)
    if not n:
        raise NothingPublished("no file matches the filters")
    if max_bytes and (total or 0) > max_bytes:
        raise RequestTooLarge(f"{total} bytes selected, limit {max_bytes}")
    return t


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, state): new, gone, changed, unresolved (a size or time is unknown) or unchanged (J21, T10). Both: path, size, modified."""
    b, a = before.select("path", F.col("size").alias("s0"), F.col("modified").alias("m0"), F.lit(True).alias("b")), after.select("path", F.col("size").alias("s1"), F.col("modified").alias("m1"), F.lit(True).alias("a"))
    t = b.join(a, "path", "full")
    unknown = F.col("s0").isNull() | F.col("s1").isNull() | F.col("m0").isNull() | F.col("m1").isNull()
    differ = (F.coalesce(F.col("s0") != F.col("s1"), F.lit(False))) | F.coalesce(F.col("m0") != F.col("m1"), F.lit(False))
    return t.select("path", F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "gone").when(differ, "changed").when(unknown, "unresolved").otherwise("unchanged").alias("state"))


def moves(gone: DataFrame, arrived: DataFrame) -> DataFrame:
    """(old, new, how): a file of the same name, size and time elsewhere has moved; of the same size and time under another name it was renamed, if nothing else claims it. Only unique matches count (J19, J20). Both: path, size, modified."""
    name = F.element_at(F.split("path", "/"), -1)
    g, a = gone.withColumn("name", name), arrived.withColumn("name", name)

    def unique(keys: list[str], left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        one = lambda t, as_: t.dropna(subset=keys).groupBy(*keys).agg(F.min("path").alias(as_), F.count("*").alias("n")).where("n = 1").drop("n")
        return one(left, "old").join(one(right, "new"), keys).select("old", "new", F.lit(how).alias("how"))

    strong = unique(["name", "size", "modified"], g, a, "moved")
    g2 = g.join(strong.select(F.col("old").alias("path")), "path", "left_anti")
    a2 = a.join(strong.select(F.col("new").alias("path")), "path", "left_anti")
    return strong.unionByName(unique(["size", "modified"], g2, a2, "renamed"))


def refuse_mass_disappearance(diff: DataFrame, share: float = 0.2, least: int = 500) -> None:
    """A snapshot that withdraws a fifth of 500 known files or more is not believed."""
    known, gone = diff.agg(F.count_if(F.col("state") != "new"), F.count_if(F.col("state") == "gone")).first()
    if known >= least and gone / known >= share:
        raise MassDisappearance(f"{gone} of {known} known files are gone")


def prefix_majority(files: DataFrame) -> DataFrame:
    """(prefix, system, files, agreement, trusted): the system most files of a prefix lie in."""
    n = files.groupBy("prefix", "system").agg(F.count("*").alias("n"))
    t = n.groupBy("prefix").agg(F.max_by("system", F.struct(F.col("n"), F.col("system"))).alias("system"), F.sum("n").alias("files"), F.round(F.max("n") / F.sum("n"), 6).alias("agreement"))
    return t.withColumn("trusted", (F.col("agreement") >= 0.9) & (F.col("files") >= 5))


def resolve_system(files: DataFrame, learned: DataFrame) -> DataFrame:
    """A trusted prefix beats the path; disagreement is kept as a flag."""
    l = learned.select("prefix", F.col("system").alias("learned"), "trusted")  # noqa: E741
    t = files.join(l, "prefix", "left")
    pick = F.when(F.col("trusted"), F.col("learned")).otherwise(F.coalesce("system", "learned"))
    return t.withColumn("resolved", pick).withColumn("disagrees", F.coalesce(F.col("learned") != F.col("system"), F.lit(False))).drop("learned", "trusted")


def bind(observed: DataFrame, declared: DataFrame) -> DataFrame:
    """(system, series, dataset, rule) of observed pairs: declared as they are, else after clean-up, else by a series that one dataset alone has, else unbound (J15, A87). declared: system, series, dataset."""
    o = observed.select("system", "series").distinct().withColumn("clean", canonical_series(F.col("series")))
    d = declared.select("system", "series", "dataset").distinct()
    exact = d.select("system", "series", F.col("dataset").alias("d1"))
    cleaned = d.select("system", F.col("series").alias("clean"), F.col("dataset").alias("d2"))
    alone = d.groupBy(F.col("series").alias("clean")).agg(F.min("dataset").alias("d3"), F.count_distinct("dataset").alias("n")).where("n = 1").drop("n")
    t = o.join(exact, ["system", "series"], "left").join(cleaned, ["system", "clean"], "left").join(alone, "clean", "left")
    rule = F.when(F.col("d1").isNotNull(), "declared").when(F.col("d2").isNotNull(), "cleaned").when(F.col("d3").isNotNull(), "series_only").otherwise("unbound")
    return t.select("system", "series", F.coalesce("d1", "d2", "d3").alias("dataset"), rule.alias("rule"))


def join_grain(tables: dict[str, tuple[DataFrame, str]], key: str) -> DataFrame:
    """(key, dataset, column, rows, keys, most, grain): whether a declared key has one row or many in each dataset."""
    out = None
    for name, (df, column) in tables.items():
        n = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
        t = n.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"), F.count("*").alias("keys"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))
        t = t.select(F.lit(key).alias("key"), F.lit(name).alias("dataset"), F.lit(column).alias("column"), "rows", "keys", "most", F.when(F.col("most") > 1, "many").when(F.col("most") == 1, "one").otherwise("unmeasured").alias("grain"))
        out = t if out is None else out.unionByName(t)
    return out


def resolve_dataset(name: str, declared: DataFrame) -> tuple[str, str]:
    """(system, series) of a dataset's name, or a refusal with suggestions."""
    from ..functions.naming import dataset_spec
    from ..functions.text import suggestions

    system, series = dataset_spec(name)
    t = declared.where(F.upper("system") == system)
    if series:
        t = t.where(F.upper("series") == series)
    found = t.select("system", "series").distinct().limit(2).collect()
    if len(found) == 1:
        return found[0]["system"], found[0]["series"]
    near = [r["name"] for r in suggestions(declared.select(F.concat_ws("-", "system", "series").alias("n")).distinct(), "n", name).collect()]
    raise DatasetUnknown(f"{name!r} is {'ambiguous' if found else 'unknown'}; near: {near}")


def latest(rows: DataFrame, key: list[str], by: str) -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(by).desc()))).where("__n = 1").drop("__n")


def as_of(left: DataFrame, right: DataFrame, *, key: str, left_time: str, right_time: str, value: str, out: str) -> DataFrame:
    """left with the right side's last value not after each row's time, per key: both sides are laid in one order and the value carried forward, so no pairs are made."""
    cols = left.columns
    a = left.select(F.struct(*cols).alias("row"), F.col(key).alias("k"), F.col(left_time).alias("t"), F.lit(None).cast(right.schema[value].dataType).alias("v"), F.lit(1).alias("side"))
    b = right.select(F.lit(None).cast(a.schema["row"].dataType).alias("row"), F.col(key).alias("k"), F.col(right_time).alias("t"), F.col(value).alias("v"), F.lit(0).alias("side"))
    w = Window.partitionBy("k").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("last", F.last("v", ignorenulls=True).over(w)).where("side = 1").select("row.*", F.col("last").alias(out))
