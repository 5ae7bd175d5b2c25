"""Secret scans with an incremental blob ledger, on DataFrame functions alone.

Every version of every text is a blob, addressed by the SHA-256 of its bytes. The ledger holds, for each blob and
rule version that were scanned, the spans found (an empty list where there were none). A scan takes the distinct
blobs of its rows, leaves out the blob and rule-version pairs that the ledger has, runs the rules that are left
on each blob once, and joins the findings back to all rows that hold the blob.

Spans come from splitting a text at a rule's matches: the lengths of the pieces and of the matches, summed up in
order, are the matches' places in code points. Two rules ask for a length that only a maximal run can have, so
their patterns state it; for `assign` shorter matches still consume text, so they are found first, then dropped.
Three rules more add spans that the base ones do not name: private key heads, tokens with a known prefix, web tokens.

Defined results: a null text is an empty one; repeated rows each get their row; an empty table gives no rows; a
hot blob is hashed map-side, scanned once and joined back on its hash, a join that Spark can split. Columns
other than those named are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Written, same


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    group: int = 0  # whose length must be `least`
    least: int = 1

    base: bool = True  # whether it counts in the base digest

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


RULES = (
    Rule("assign", 1, "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, "[0-9a-f]{24,}"),
    Rule("pem", 1, "-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----", base=False),
    Rule("prefixed", 1, "(gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abeprs]-[A-Za-z0-9-]{10,}|[rs]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35,})", base=False),
    Rule("jwt", 1, "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", base=False),
)

LEDGER = "blob string, rule string, spans array<struct<start:bigint,end:bigint>>"


def blobs_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, blob, text) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text"))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows for distinct blobs (blob, text, todo: array of rule keys to run)."""
    found = []
    for rule in rules:
        cut = blobs.where(F.array_contains("todo", rule.key)).where(F.col("text").rlike(rule.pattern))
        hits = F.arrays_zip(
            F.slice(F.split("text", rule.pattern, -1), F.lit(1), F.size(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)))).alias("lead"),
            F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)).alias("hit"),
            F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)).alias("part"),
        )
        rows = cut.select("blob", F.posexplode(hits).alias("i", "h"))
        rows = rows.select("blob", "i", F.length("h.lead").cast("long").alias("lead"), F.length("h.hit").cast("long").alias("n"), (F.length("h.part") >= rule.least).alias("keep"))
        so_far = Window.partitionBy("blob").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
        end = F.sum(F.col("lead") + F.col("n")).over(so_far)
        rows = rows.withColumn("end", end).where("keep").select("blob", F.lit(rule.key).alias("rule"), (F.col("end") - F.col("n")).alias("start"), "end")
        found.append(rows)
    spans = found[0]
    for x in found[1:]:
        spans = spans.unionByName(x)
    return spans


def unseen(rows: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Distinct blobs of rows that some rule version has not scanned: blob, text, todo."""
    blobs = rows.groupBy("blob").agg(F.first("text").alias("text"))
    every = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        return blobs.withColumn("todo", every)
    seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    # The ledger meets hashes alone; only blobs with something to do bring their texts.
    todo = rows.select("blob").distinct().join(seen, "blob", "left").select("blob", F.when(F.col("seen").isNull(), every).otherwise(F.array_except(every, F.col("seen"))).alias("todo"))
    todo = todo.where(F.size("todo") > 0)
    return rows.join(todo.select("blob"), "blob", "left_semi").groupBy("blob").agg(F.first("text").alias("text")).join(todo, "blob")


def scan(docs: DataFrame, ledger: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(doc_id, blob, rule, start, end) of all findings in docs; and the rows to append to the ledger."""
    rows = blobs_of(docs, id_col, text_col)
    todo = unseen(rows, ledger, rules)
    spans = scan_blobs(todo, rules)
    new = todo.select("blob", F.explode("todo").alias("rule")).join(spans.groupBy("blob", "rule").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")), ["blob", "rule"], "left")
    new = new.select("blob", "rule", F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"))
    known = new if ledger is None else ledger.select("blob", "rule", "spans").unionByName(new)
    current = [r.key for r in rules]
    found = known.where(F.col("rule").isin(current)).select("blob", "rule", F.explode("spans").alias("s"))
    found = rows.select("doc_id", "blob").join(found, "blob").select("doc_id", "blob", "rule", "s.start", "s.end")
    return found, new


def report(docs: DataFrame, ledger: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, n_<kind> for each rule, base_sha256 (of the base rules' spans) and spans (all of them; kind:start:end, by start, then rule)."""
    rows = blobs_of(docs, id_col, text_col)
    spans = scan_blobs(unseen(rows, ledger, rules), rules)
    if ledger is not None:
        spans = spans.unionByName(ledger.where(F.col("rule").isin([r.key for r in rules])).select("blob", "rule", F.explode("spans").alias("s")).select("blob", "rule", "s.start", "s.end"))
    order = F.coalesce(*[F.when(F.col("rule") == r.key, F.lit(i)) for i, r in enumerate(rules)])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    named = lambda some: F.transform(F.sort_array(F.collect_list(F.when(some, F.struct("start", order.alias("o"), "end")))), lambda s: F.concat_ws(":", F.element_at(kinds, s["o"] + 1), s["start"], s["end"]))
    based = F.col("rule").isin([r.key for r in rules if r.base])
    by_blob = spans.groupBy("blob").agg(F.array_join(named(F.lit(True)), ",").alias("spans"), F.array_join(named(based), ",").alias("base"), *[F.count(F.when(F.col("rule") == r.key, 1)).alias(f"n_{r.kind}") for r in rules])
    all_ = rows.select("doc_id", "blob").join(by_blob.withColumnRenamed("blob", "b"), same(F.col("blob"), F.col("b")), "left")
    return all_.select("doc_id", *[F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in rules], F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def report_in_steps(docs: DataFrame, steps: list[DataFrame], *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`report` of docs after each of `steps` (tables of versions, in order of history) was scanned into a written ledger; what no step has seen is scanned at the end."""
    write = Written(docs.sparkSession, "blob-ledger")
    ledger = None
    for step in steps:
        new = write(scan(step, ledger, id_col=id_col, text_col=text_col, rules=rules)[1])
        ledger = new if ledger is None else ledger.unionByName(new)
    return report(docs, ledger, id_col=id_col, text_col=text_col, rules=rules)


def reference(text: str | None) -> list[tuple[str, int, int]]:
    """The base spans of one text by plain regular expressions, for tests."""
    import re

    rules = (("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24))
    out = [(m.start(), i, kind, m.end()) for i, (kind, p, ok) in enumerate(rules) for m in re.finditer(p, text or "") if ok(m)]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]
