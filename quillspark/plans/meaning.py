"""Ledger, gaps, coverage, search and the portable summary."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BundleInvalid, CurationInvalid
from ..functions.text import fold, folded
from ..operators import codelists, detectors


def ledger(verdicts: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(field, semantic_type, confidence, aggregation)."""
    if declared is not None:
        verdicts = verdicts.join(declared.select("field", "declared"), "field", "left")
    return verdicts.withColumn("aggregation", detectors.aggregation_class(F.col("semantic_type"), F.col("declared") if declared is not None else None))


def decoded_share(freq: DataFrame, codes: DataFrame) -> DataFrame:
    """(field, coverage): mass of each field's values that its codelist decodes (A32). codes: field, code."""
    hit = freq.join(codes.select("field", F.col("code").alias("value")).distinct().withColumn("hit", F.lit(1)), ["field", "value"], "left")
    return hit.where("value is not null").groupBy("field").agg(F.round(F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("coverage"))


def gaps(ledger_: DataFrame, coverage: DataFrame, rows: DataFrame, most: float = 0.5) -> DataFrame:
    """Undecoded fields, largest first (A36). rows: field, system, rows, files."""
    t = ledger_.join(coverage, "field", "left").join(rows, "field")
    told = ("money", "numeric_measure", "date", "competencia", "free_text", "constant_column")
    return t.where((F.coalesce("coverage", F.lit(0.0)) < most) & ~F.col("semantic_type").isin(*told)).select("system", "field", "semantic_type", "coverage", (F.col("rows") * F.col("files")).alias("weight")).orderBy(F.col("weight").desc(), "field")


def gap_summary(found: DataFrame) -> DataFrame:
    """Gaps by system and kind."""
    return found.groupBy("system", "semantic_type").agg(F.count_distinct("field").alias("fields"), F.sum("weight").alias("weight"))


def coverage_report(coverage: DataFrame, rows: DataFrame) -> DataFrame:
    """Fields, decoded fields and mean coverage of each system."""
    t = rows.select("system", "field").distinct().join(coverage, "field", "left")
    return t.groupBy("system").agg(F.count("*").alias("fields"), F.count_if(F.coalesce("coverage", F.lit(0.0)) > 0).alias("decoded"), F.round(F.avg(F.coalesce("coverage", F.lit(0.0))), 6).alias("mean_coverage"))


#: Codelists that a semantic type suggests.
SUGGESTED = {"icd10": ("CID10", "ICD10"), "municipality_code_6": ("MUNICIP",), "municipality_code_7": ("MUNICIP",), "uf_alpha": ("UF",), "uf_numeric": ("UF",), "procedure_code": ("PROCED", "SIGTAP"), "cnes_establishment": ("CNES",)}


def semantic_bindings(verdicts: DataFrame, known: DataFrame) -> DataFrame:
    """(field, codelist): the first candidate of a field's type that is known (J14). known: codelist."""
    rows = [(k, c, i) for k, v in SUGGESTED.items() for i, c in enumerate(v)]
    s = verdicts.sparkSession.createDataFrame(rows, "semantic_type string, codelist string, o int").join(known.select("codelist").distinct(), "codelist")
    return verdicts.join(F.broadcast(s), "semantic_type").groupBy("field").agg(F.min_by("codelist", "o").alias("codelist"))


def suspects(bindings: DataFrame, measured: DataFrame, least: float = 0.1) -> DataFrame:
    """Bindings whose codelist decodes under a tenth of what was observed."""
    return bindings.join(measured.select("codelist", "share"), "codelist").where(F.col("share") < least)


def working(bindings: DataFrame) -> DataFrame:
    """Bindings that are not measured dead; unmeasured ones stay."""
    return bindings.where(F.col("decodes").isNull() | (F.col("decodes") > 0))


def label_disagreements(df: DataFrame, code_col: str, label_col: str, codes: DataFrame) -> DataFrame:
    """Stored labels that their code does not allow; one that begins with the other agrees."""
    t = df.select(F.col(code_col).alias("code"), F.col(label_col).alias("stored")).distinct().join(codes.select("code", "label"), "code")
    ok = F.startswith(F.lower("stored"), F.lower("label")) | F.startswith(F.lower("label"), F.lower("stored"))
    return t.groupBy("code", "stored").agg(F.max(ok).alias("ok")).where("not ok").select("code", "stored")


def icd_quality(values: DataFrame, known: DataFrame) -> DataFrame:
    """Counts of single, several, sentinel, malformed, unknown and absent values of a diagnosis column (A71). values: value, n."""
    v = F.upper(F.trim("value"))
    kind = F.when(v.isNull() | (v == ""), "absent").when(v.rlike(r"^(0+|9+|X+)$"), "sentinel").when(v.rlike(r"^[A-Z]\d{2}[\dX]?([ ,;*/|][A-Z]\d{2}[\dX]?)+$"), "several").when(~v.rlike(r"^[A-Z]\d{2}[\dX]?\d?$"), "malformed")
    t = values.withColumns({"v": v, "kind": kind}).join(known.select(F.col("code").alias("v")).distinct().withColumn("hit", F.lit(True)), "v", "left")
    return t.groupBy(F.coalesce("kind", F.when(F.col("hit"), "single").otherwise("unknown")).alias("kind")).agg(F.sum("n").alias("n"))


def search(documents: DataFrame, query: str, limit: int = 20, kind: str | None = None) -> DataFrame:
    """Rows whose text holds every word of a query, accents and case apart; exact words before beginnings, then by how often, then by name (X08, X09, T06). documents: kind, name, text."""
    words = [w for w in fold(query).split() if w]
    if not words:
        raise ValueError("empty query")
    t = documents if kind is None else documents.where(F.col("kind") == kind)
    body = F.concat(F.lit(" "), F.regexp_replace(folded(F.concat_ws(" ", "name", "text")), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    t = t.withColumn("__b", body)
    score = F.lit(0)
    for w in words:
        t = t.where(F.contains("__b", F.lit(f" {w}")))
        score = score + F.size(F.split("__b", f" {w} ", -1)) * 10 + F.size(F.split("__b", f" {w}", -1))
    at = F.greatest(F.locate(words[0], folded(F.col("text"))) - 40, F.lit(1))
    return t.select("kind", "name", score.alias("score"), F.substring(F.col("text"), at, F.lit(120)).alias("snippet")).orderBy(F.col("score").desc(), "kind", "name").limit(limit)


def parse_curation(doc: dict) -> list[dict]:
    """Authored truth about variables (X11): each names its system and field, a code system, and the evidence for it."""
    out = []
    for system, fields in (doc or {}).items():
        if not isinstance(fields, dict):
            raise CurationInvalid(f"{system}: not a map of fields")
        for name, d in fields.items():
            d = d or {}
            if d.get("code_system") not in (None, "internal", "external", "none"):
                raise CurationInvalid(f"{system}.{name}: code_system {d['code_system']!r}")
            if d.get("codelist") and not d.get("evidence"):
                raise CurationInvalid(f"{system}.{name}: a codelist needs evidence")
            if unknown := set(d) - {"code_system", "codelist", "codelists", "evidence", "token_rule", "depends_on", "modifies", "derived", "title", "description", "unit", "declared"}:
                raise CurationInvalid(f"{system}.{name}: unknown keys {sorted(unknown)}")
            out.append({"system": system.upper(), "field": name.upper(), **d})
    return out


def parse_dataset_docs(doc: dict) -> list[dict]:
    """What a dataset's row is, its unit and known biases."""
    out = []
    for system, series in (doc or {}).items():
        for name, d in (series or {}).items():
            if not (d or {}).get("grain"):
                raise CurationInvalid(f"{system}.{name}: what is a row?")
            out.append({"system": system.upper(), "series": name.upper(), "grain": d["grain"], "unit": d.get("unit"), "notes": "; ".join(d.get("biases", []))})
    return out


def roles_by_globs(files: DataFrame, globs: dict[str, str]) -> DataFrame:
    """The role that the first matching pattern gives a path."""
    import fnmatch

    role = F.lit(None).cast("string")
    for pattern, name in reversed(globs.items()):
        role = F.when(F.col("path").rlike(fnmatch.translate(pattern).replace("(?s:", "(?s)(?:").replace("\\z", "$").replace("\\Z", "$")), name).otherwise(role)
    return files.withColumn("role", role)


def pack(spark: SparkSession, tables: dict[str, DataFrame], path: str, note: str = "") -> str:
    """A portable bundle: a folder of Parquet tables and a manifest."""
    from .lake import Files

    counts = {}
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
        counts[name] = spark.read.parquet(f"{path}/{name}").count()
    Files(spark, path).write("manifest.json", json.dumps({"format": 1, "tables": counts, "note": note}))
    return path


def read_manifest(spark: SparkSession, path: str) -> dict:
    from .lake import Files

    text = Files(spark, path).read("manifest.json")
    if not text:
        raise BundleInvalid(f"no manifest in {path}")
    try:
        found = json.loads(text)
    except ValueError as e:
        raise BundleInvalid("unreadable manifest") from e
    if found.get("format") != 1:
        raise BundleInvalid(f"format {found.get('format')}")
    return found


def unpack(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A bundle's tables; row counts must be those of its manifest."""
    out = {n: spark.read.parquet(f"{path}/{n}") for n in read_manifest(spark, path)["tables"]}
    for n, c in read_manifest(spark, path)["tables"].items():
        if out[n].count() != c:
            raise BundleInvalid(f"{n}: {out[n].count()} rows, {c} packed")
    return out


def compendium(lake, reference: DataFrame | None = None) -> dict[str, DataFrame]:
    """A relational summary of a lake: systems, families, fields, codelists."""
    spark = lake.spark
    fam, fld = [], []
    for s in lake.systems():
        for f in lake.families(s):
            parts = lake.partitions(s, f)
            fam.append((s, f, len(parts), min((p["year"] for p in parts), default=None), max((p["year"] for p in parts), default=None)))
            fld += [(s, f, x.name, x.dataType.simpleString(), i) for i, x in enumerate(lake.family(s, f).schema.fields)]
    out = {"families": spark.createDataFrame(fam, "system string, family string, partitions int, first_year int, last_year int"), "fields": spark.createDataFrame(fld, "system string, family string, field string, type string, position int")}
    if reference is not None:
        out["codelists"] = codelists.list_stats(reference).join(codelists.vintages(reference).drop("codes"), "codelist")
    return out


def checks(reference: DataFrame) -> DataFrame:
    """(check, failures): codes with several labels in one window, mixed widths, blank labels, codelists read the wrong way round."""
    doubled = codelists.contradictions(reference, ["codelist", "system", "code", "valid_from", "valid_to"]).select(F.lit("contradictory").alias("check"), F.col("codelist").alias("subject"))
    mixed = codelists.widths(reference).where("mixed").select(F.lit("mixed_widths"), "codelist")
    blank = codelists.list_stats(reference).where("blank_labels").select(F.lit("blank_labels"), "codelist")
    wrong = reference.where((F.length("code") > 12) & F.contains("code", F.lit(" "))).select(F.lit("wrong_way"), "codelist").distinct()
    backward = reference.where("valid_to < valid_from").select(F.lit("backward_window"), "codelist").distinct()
    every = doubled.union(mixed).union(blank).union(wrong).union(backward)
    return every.groupBy("check").agg(F.count("*").alias("failures"), F.array_join(F.slice(F.array_sort(F.collect_set("subject")), 1, 20), ",").alias("subjects"))
