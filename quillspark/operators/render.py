"""Rendering coded columns with labels."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import LabelUnavailable
from ..functions.text import code_and_label, labelled_tokens, misses, tokens
from . import codelists


@dataclass(frozen=True)
class Profile:
    """What a reader wants to see."""

    columns: str = "label"  # code, label, both or combined
    headers: str = "original"  # original, translated or both
    companions: bool = True
    strict: bool = False
    overrides: dict[str, str] = field(default_factory=dict)


PROFILES = {"analysis": Profile("label"), "codes": Profile("code", companions=False), "audit": Profile("both"), "report": Profile("combined", headers="translated", companions=False)}


@dataclass(frozen=True)
class FieldDoc:
    """What is known of a field: whose codes it holds and how its cells are packed."""

    name: str
    code_system: str | None = None  # internal, external or none
    codelist: str | None = None
    candidates: tuple[str, ...] = ()
    delimiters: str | None = None
    width: int | None = None
    title: str | None = None


@dataclass
class Report:
    """What a rendering decided, as data."""

    decisions: list[dict] = field(default_factory=list)

    def merge(self, other: Report) -> Report:
        return Report(self.decisions + other.decisions)


def profile_of(name: str | Profile, **overrides) -> Profile:
    return replace(PROFILES[name] if isinstance(name, str) else name, **overrides)


def render(df: DataFrame, docs: list[FieldDoc], reference: DataFrame, *, system: str = "*", profile: str | Profile = "analysis", moment: Column | None = None) -> tuple[DataFrame, Report]:
    """df with its coded columns shown as the profile asks, and what was decided for each. `reference`: see codelists. One frequency table of the coded fields, cut to distinct values, serves every choice."""
    from .profile import frequencies

    p = profile_of(profile)
    report = Report()
    inscope = codelists.scoped(reference, system)
    coded = [d for d in docs if d.name in df.columns and (d.codelist or d.candidates) and d.code_system != "none"]
    freq = frequencies(df, [d.name for d in coded]).where("value is not null") if coded else None
    out, order = df, list(df.columns)
    for d in coded:
        how = p.overrides.get(d.name, p.columns)
        if how == "code":
            continue
        observed = freq.where(F.col("field") == d.name).select("value", "n")
        if d.delimiters or d.width:
            observed = observed.select(F.explode(tokens(F.col("value"), d.delimiters, d.width)).alias("value"), "n").groupBy("value").agg(F.sum("n").alias("n"))
        chosen = codelists.choose(observed, inscope, list(d.candidates), d.codelist)
        table = inscope.where(F.col("codelist") == chosen["codelist"]) if chosen["codelist"] else None
        if table is not None:
            used = codelists.at_moments(table, df.select(moment.alias("moment")) if moment is not None else df.sparkSession.createDataFrame([(None,)], "moment int"))
            doubled = codelists.contradictions(used, ["moment", "code"]).join(observed, F.col("code") == F.col("value"), "left_semi")
            if not doubled.isEmpty():
                chosen = {**chosen, "codelist": None, "reason": "contradictory labels"}
                table = None
        report.decisions.append({"field": d.name, **chosen})
        if table is None:
            if p.strict:
                raise LabelUnavailable(f"{d.name}: {chosen['reason']}")
            for r in chosen["rollups"]:
                name = f"{d.name}_{r}"
                out = codelists.label_once(out, d.name, inscope.where(F.col("codelist") == r), name)
                order.insert(order.index(d.name) + 1, name)
            continue
        label = f"{d.name}_label"
        if d.delimiters or d.width:
            lookup = table.groupBy("codelist").agg(F.map_from_entries(F.collect_list(F.struct("code", "label"))).alias("__map")).select("__map")
            cell = tokens(F.col(d.name), d.delimiters, d.width)
            out = out.join(F.broadcast(lookup)).withColumn(label, labelled_tokens(cell, F.col("__map")))  # one row
            if p.companions:
                out = out.withColumn(f"{d.name}_misses", misses(cell, F.col("__map")))
                order.insert(order.index(d.name) + 1, f"{d.name}_misses")
            out = out.drop("__map")
        else:
            out = codelists.with_vintage_label(out, d.name, table, moment if moment is not None else F.lit(None).cast("int"), label)
        system_ = d.code_system or "internal"
        if how == "combined":
            out = out.withColumn(d.name, code_and_label(F.col(d.name).cast("string"), F.col(label))).drop(label)
        elif how == "label" and system_ == "internal":
            out = out.withColumn(d.name, F.coalesce(F.col(label), F.col(d.name).cast("string"))).drop(label)
        else:
            order.insert(order.index(d.name) + 1, label)
    out = out.select(*[F.col(f"`{c}`") for c in order])
    return translated_headers(out, {d.name: d.title for d in docs if d.title}, p.headers), report


def translated_headers(df: DataFrame, titles: dict[str, str], style: str = "original") -> DataFrame:
    """Column headers as they are, translated, or both."""
    if style == "original":
        return df
    used: set[str] = set()
    names = []
    for c in df.columns:
        t = titles.get(c)
        new = c if not t else t if style == "translated" else f"{c} ({t})"
        while new in used:
            new += "_1"
        used.add(new)
        names.append(new)
    return df.toDF(*names)


#: Words of unit labels and how many of the unit make a year.
UNITS = ((r"(?i)hora|hour", 8766.0), (r"(?i)minuto|minute", 525960.0), (r"(?i)\bdia|day", 365.25), (r"(?i)m[eê]s|month", 12.0), (r"(?i)ano|year", 1.0))


def unit_divisor(label: Column) -> Column:
    """Units of a year that a unit's label names."""
    out = F.lit(None).cast("double")
    for pattern, n in reversed(UNITS):
        out = F.when(label.rlike(pattern), n).otherwise(out)
    return out


def age_in_years(value: Column, divisor: Column) -> Column:
    """Age in years to four places; what is not a number is NULL (P25)."""
    return F.bround(F.try_divide(value.try_cast("double"), divisor), 4)


def token_rule(values: DataFrame, least: float = 0.02) -> dict:
    """How a column's cells are packed (A72): {delimiter} that 2 % of values hold, or {width} if four fifths of lengths are multiples of the shortest common one of four, or {}. values: value, n."""
    marks = [",", ";", "|", "/", "*"]
    total = F.sum("n")
    row = values.agg(*[F.round(F.sum(F.when(F.contains("value", F.lit(m)), F.col("n")).otherwise(0)) / total, 6).alias(f"m{i}") for i, m in enumerate(marks)], (F.sum(F.when((F.length("value") % 4 == 0) & (F.length("value") > 4), F.col("n")).otherwise(0)) / F.nullif(F.sum(F.when(F.length("value") > 4, F.col("n"))), F.lit(0))).alias("four")).first()
    best = max(range(len(marks)), key=lambda i: row[f"m{i}"] or 0)
    if (row[f"m{best}"] or 0) >= least:
        return {"delimiters": marks[best]}
    if (row["four"] or 0) >= 0.8:
        return {"width": 4}
    return {}
