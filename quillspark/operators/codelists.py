"""Codes and labels: vintages, scope, choice among tables, coverage, range-encoded packs.

A reference table has columns codelist, system, code, label, valid_from, valid_to (YYYYMM; valid_to NULL: open).
Which window serves a (codelist, system, year) is decided first, table-wide; codes are joined after that. A code
missing from the window chosen stays without a label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import affinity, useful_label
from ..functions.types import stripped

MOST_CANDIDATES, TIE, ENOUGH, DETAILED, SURE = 12, 0.05 + 1e-9, 0.5, 0.5, 0.99


def scoped(reference: DataFrame, system: str) -> DataFrame:
    """Each codelist's own copy for a system, else the shared one ('*'), else one borrowed from another system, recorded as such."""
    rank = F.when(F.col("system") == system, 0).when(F.col("system") == "*", 1).otherwise(2)
    owner = reference.select("codelist", "system", rank.alias("rank")).groupBy("codelist").agg(F.min(F.struct("rank", "system")).alias("o"))
    return reference.join(F.broadcast(owner), "codelist").where(F.col("system") == F.col("o.system")).select(*reference.columns, (F.col("o.rank") == 2).alias("borrowed"))


def windows_for(reference: DataFrame, moments: DataFrame) -> DataFrame:
    """(codelist, moment, valid_from, valid_to, how): the window of each codelist at each moment (YYYYMM; YYYY00 for a whole year; NULL: now). A dated window that overlaps; else the open-ended one, recorded as current; else none."""
    w = reference.select("codelist", "valid_from", "valid_to").distinct()
    first = F.when(F.col("moment") % 100 == 0, F.col("moment") + 1).otherwise(F.col("moment"))
    last = F.when(F.col("moment") % 100 == 0, F.col("moment") + 12).otherwise(F.col("moment"))
    m = moments.select("moment").distinct().withColumns({"a": first, "b": last})
    # Windows and moments are few (a row a vintage, a row a month), whatever the data's size.
    both = w.join(m, (F.coalesce(w["valid_from"], F.lit(0)) <= F.coalesce(m["b"], F.lit(999999))) & (F.coalesce(w["valid_to"], F.lit(999999)) >= F.coalesce(m["a"], F.lit(0))) | w["valid_to"].isNull())
    overlaps = (F.coalesce("valid_from", F.lit(0)) <= F.col("b")) & (F.coalesce("valid_to", F.lit(999999)) >= F.col("a"))
    how = F.when(F.col("moment").isNull(), F.when(F.col("valid_to").isNull(), "current").otherwise("newest")).when(overlaps & F.col("valid_to").isNotNull(), "dated").when(overlaps, "open").when(F.col("valid_to").isNull(), "current")
    order = F.when(how.isin("dated"), 0).when(how == "open", 1).when(how == "current", 2).otherwise(3)
    best = Window.partitionBy("codelist", "moment").orderBy(order, F.col("valid_from").desc_nulls_last())
    return both.withColumn("how", how).where("how is not null").withColumn("n", F.row_number().over(best)).where("n = 1").select("codelist", "moment", "valid_from", "valid_to", "how")


def at_moments(reference: DataFrame, moments: DataFrame) -> DataFrame:
    """The rows of `reference` that serve each moment, with the moment. A row a window and moment is broadcast."""
    w = windows_for(reference, moments).select(F.col("codelist").alias("__l"), "moment", F.col("valid_from").alias("__a"), F.col("valid_to").alias("__b"))
    on = (F.col("codelist") == F.col("__l")) & F.col("valid_from").eqNullSafe(F.col("__a")) & F.col("valid_to").eqNullSafe(F.col("__b"))
    return reference.join(F.broadcast(w), on).drop("__l", "__a", "__b")


def with_vintage_label(df: DataFrame, code_col: str, reference: DataFrame, moment: Column, out: str = "label") -> DataFrame:
    """df with the label of a code at each row's moment (J01-J03). `reference` is one codelist in scope; it is broadcast by Spark when its size allows, else shuffled on the code."""
    table = at_moments(reference, df.select(moment.alias("moment")))
    table = table.groupBy(F.col("moment").alias("__m"), stripped(F.col("code")).alias("__c")).agg(F.min("label").alias(out))
    return df.withColumns({"__k": stripped(F.col(code_col).cast("string")), "__t": moment}).join(table, F.col("__k").eqNullSafe(F.col("__c")) & F.col("__t").eqNullSafe(F.col("__m")), "left").drop("__k", "__t", "__c", "__m")


def label_once(df: DataFrame, code_col: str, table: DataFrame, out: str = "label") -> DataFrame:
    """A 1:1 lookup on the trimmed code; several labels of a code would multiply rows, so the first by name is taken."""
    one = table.groupBy(stripped(F.col("code")).alias("__c")).agg(F.min("label").alias(out))
    return df.withColumn("__k", stripped(F.col(code_col).cast("string"))).join(one, F.col("__k") == F.col("__c"), "left").drop("__k", "__c")


def merged(tables: list[DataFrame]) -> DataFrame:
    """Several tables for one field; the first that has a code wins."""
    every = None
    for i, t in enumerate(tables):
        t = t.select("code", "label").withColumn("o", F.lit(i))
        every = t if every is None else every.unionByName(t)
    return every.groupBy("code").agg(F.min_by("label", "o").alias("label"))


def coverage(observed: DataFrame, codes: DataFrame, by: list[str] = ["codelist"]) -> DataFrame:  # noqa: B006
    """Per codelist: codes observed that it has, shares of distinct values and of mass, granularity (A29-A33, J11, J12). observed: value, n; codes: codelist, code, label."""
    table = codes.groupBy(*by, "code").agg(F.min("label").alias("label"))
    total = observed.agg(F.count("*").alias("values"), F.sum("n").alias("mass"))
    hit = table.join(observed, table["code"] == observed["value"]).groupBy(*by).agg(F.count("*").alias("matched"), F.sum("n").alias("matched_mass"), F.count_distinct("label").alias("labels"))
    lists = codes.select(*by).distinct()
    out = lists.join(hit, by, "left").fillna(0).join(F.broadcast(total))  # one row
    return out.select(*by, "matched", F.round(F.try_divide("matched", "values"), 6).alias("share"), F.round(F.try_divide("matched_mass", "mass"), 6).alias("mass_share"), F.coalesce(F.round(F.try_divide("labels", "matched"), 6), F.lit(0.0)).alias("granularity"))


def ranked_bindings(bindings: DataFrame, field: str) -> DataFrame:
    """Candidates of a field in order (T02): family's own, not measured dead, confidence, name affinity, name. bindings: codelist, family_specific, decodes, confidence."""
    order = Window.orderBy(F.col("family_specific").desc(), (F.coalesce("decodes", F.lit(1.0)) <= 0).asc(), F.col("confidence").desc(), affinity(F.lit(field), F.col("codelist")), "codelist")
    return bindings.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MOST_CANDIDATES)


def choose(observed: DataFrame, codes: DataFrame, order: list[str], curated: str | None = None) -> dict:
    """The codelist for a field, measured against its observed values (A25, A26): {codelist, share, granularity, rollups, reason}. At most MOST_CANDIDATES rows reach the driver."""
    names = ([curated] if curated else []) + [o for o in order if o != curated]
    names = names[:MOST_CANDIDATES]
    if not names:
        return {"codelist": None, "share": 0.0, "granularity": 0.0, "rollups": [], "reason": "no candidate"}
    distinct = observed.agg(F.count("*")).first()[0]
    if not distinct:
        return {"codelist": names[0], "share": 0.0, "granularity": 0.0, "rollups": [], "reason": "nothing observed"}
    measured = {r["codelist"]: r for r in coverage(observed, codes.where(F.col("codelist").isin(names))).collect()}
    found = [(n, float(measured[n]["share"]), float(measured[n]["granularity"])) for n in names if n in measured]
    rollups = [n for n, s, g in found if s >= ENOUGH and g < DETAILED]
    if curated and curated in measured:
        n, s, g = found[0]
        return {"codelist": n, "share": s, "granularity": g, "rollups": [x for x in rollups if x != n], "reason": "curated"}
    for n, s, g in found:
        if s >= SURE and g >= SURE:
            return {"codelist": n, "share": s, "granularity": g, "rollups": [x for x in rollups if x != n], "reason": "measured"}
    if not found:
        return {"codelist": names[0], "share": 0.0, "granularity": 1.0, "rollups": [], "reason": "no candidate is known"}
    top = max((s for _, s, _ in found), default=0.0)
    near = [x for x in found if x[1] >= top - TIE]
    n, s, g = max(near, key=lambda x: (x[2], x[1]))
    if s < ENOUGH:
        return {"codelist": None, "share": s, "granularity": g, "rollups": [], "reason": "constant" if distinct <= 1 else "decodes too little"}
    if g < DETAILED:
        return {"codelist": None, "share": s, "granularity": g, "rollups": [n], "reason": "roll-up"}
    return {"codelist": n, "share": s, "granularity": g, "rollups": [x for x in rollups if x != n], "reason": "measured"}


def contradictions(codes: DataFrame, by: list[str] = ["codelist", "code"]) -> DataFrame:  # noqa: B006
    """Codes with more than one label."""
    return codes.groupBy(*by).agg(F.count_distinct(F.lower(stripped(F.col("label")))).alias("labels"), F.array_join(F.array_sort(F.collect_set("label")), " | ").alias("seen")).where("labels > 1")


def widths(codes: DataFrame) -> DataFrame:
    """Code widths of each codelist, and whether they are mixed."""
    return codes.groupBy("codelist").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.length("code"))), lambda x: x.cast("string")), ",").alias("code_widths"), (F.count_distinct(F.length("code")) > 1).alias("mixed"))


def list_stats(codes: DataFrame) -> DataFrame:
    """Codes, labels, granularity, blank labels, hierarchy."""
    blank = F.count_if(F.coalesce(stripped(F.col("label")), F.lit("")) == "")
    return codes.groupBy("codelist").agg(F.count_distinct("code").alias("codes"), F.count_distinct("label").alias("labels"), F.round(F.count_distinct("label") / F.count_distinct("code"), 6).alias("granularity"), ((F.count("*") >= 20) & (blank >= 0.9 * F.count("*"))).alias("blank_labels"), (F.count_distinct("label") > 200).alias("hierarchical"))


def vintages(reference: DataFrame) -> DataFrame:
    """Windows of each codelist."""
    return reference.groupBy("codelist").agg(F.count_distinct(F.struct(F.coalesce("valid_from", F.lit(0)), F.coalesce("valid_to", F.lit(0)))).alias("windows"), F.max(F.col("valid_to").isNull()).alias("open_ended"), F.count_distinct("code").alias("codes"))


def sentinel_codes(codes: DataFrame) -> DataFrame:
    """Codes whose own label says ignored, blank or not informed."""
    return codes.where(F.lower(F.col("label")).rlike(r"^\s*(ignorad[oa]|ign|n[aã]o informad[oa]|em branco|ignored|unknown|blank|not informed|sem informa[cç][aã]o)\s*$")).select("codelist", "code")


def range_encoded(codes: DataFrame) -> DataFrame:
    """Runs of consecutive numeric codes of one width and label as (codelist, code_lo, code_hi, label); other codes are runs of one."""
    t = codes.where(useful_label(F.col("code"), F.col("label"))).select("codelist", "code", "label").distinct()
    num = F.when(F.col("code").rlike(r"^\d{1,18}$"), F.col("code")).try_cast("bigint")
    t = t.withColumns({"n": num, "w": F.length("code")})
    order = Window.partitionBy("codelist", "label", "w", F.col("n").isNull()).orderBy("n", "code")
    t = t.withColumn("run", F.when(F.col("n").isNull(), F.row_number().over(order)).otherwise(F.col("n") - F.row_number().over(order)))
    return t.groupBy("codelist", "label", "w", F.col("n").isNull().alias("x"), "run").agg(F.min("code").alias("code_lo"), F.max("code").alias("code_hi")).select("codelist", "code_lo", "code_hi", "label")


def range_decoded(runs: DataFrame) -> DataFrame:
    """Codes of runs."""
    from ..functions.text import code_range

    every = F.when(F.col("code_lo") == F.col("code_hi"), F.array("code_lo")).otherwise(code_range(F.col("code_lo"), F.col("code_hi")))
    return runs.select("codelist", F.explode(every).alias("code"), "label")


def ranges_lookup(df: DataFrame, code_col: str, runs: DataFrame, out: str = "label") -> DataFrame:
    """Label by range without expanding it: candidates meet on width and first character, then on the bounds."""
    r = runs.select(F.col("code_lo").alias("__lo"), F.col("code_hi").alias("__hi"), F.col("label").alias(out), F.length("code_lo").alias("__w"), F.explode(F.transform(F.sequence(F.ascii("code_lo"), F.greatest(F.ascii("code_lo"), F.ascii("code_hi"))), lambda x: F.char(x))).alias("__f"))
    c = stripped(F.col(code_col).cast("string"))
    on = (F.col("__w") == F.length(c)) & (F.col("__f") == F.substring(c, 1, 1)) & (c >= F.col("__lo")) & (c <= F.col("__hi"))
    return df.join(r, on, "left").drop("__lo", "__hi", "__w", "__f")
