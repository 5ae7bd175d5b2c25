"""Semantic types of columns from their profiles.

A detector is a pair of Column expressions over a table of field statistics: a gate and a confidence. All are
evaluated in one projection; the verdict is the highest confidence, ties to the earlier detector. Callers may
pass detectors of their own. Gates that need patterns read rates made by `evidence` from the frequency table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import STATES
from .profile import entropy, rate, statistics, tails

#: Words in field names that hint at a type.
HINTS = {
    "age": r"(?i)IDADE|IDAD|NU_IDADE|ANOS|COD_IDADE|(^|_)AGE(_|$)",
    "money": r"(?i)VAL|VLR|VALOR|CUSTO|US_|_TOT|FINANC|VL_|PRICE|COST|TOTAL|PRECO|BAL",
    "municipality": r"(?i)MUNIC|MUN_|CODMUN|CO_MUN|IBGE|RESID|MOV|CIDADE|CITY",
    "establishment": r"(?i)CNES|ESTAB",
    "procedure": r"(?i)PROC|PRIPAL|SECUND|SIGTAP|ATO_PROF|PA_",
    "diagnosis": r"(?i)DIAG|CID|CAUSA|CAUS|MORTE|OBITO",
    "cpf": r"(?i)CPF", "cns": r"(?i)CNS", "cnpj": r"(?i)CNPJ|CGC",
}


def evidence(freq: DataFrame, universes: dict[str, DataFrame] | None = None) -> DataFrame:
    """Statistics of every field with the rates that detectors read. `universes` maps icd10, municipality, establishment or procedure to a table of codes (column code)."""
    v = F.col("value")
    uf = list(STATES.values())
    rates = {
        "r_age_letter": v.rlike(r"^[AMDH]\d{2,3}$"), "r_unit_letter": v.rlike(r"^[AMDH]"), "r_age_digit": v.rlike(r"^[1-4]\d{3}$"),
        "r_uf_alpha": F.upper(v).isin(*uf), "r_uf_numeric": v.isin(*STATES),
        "r_11": v.rlike(r"^\d{11}$"), "r_15": v.rlike(r"^\d{15}$"), "r_14": v.rlike(r"^\d{14}$"),
        "r_icd": v.rlike(r"(?i)^[A-TV-Z][0-9][0-9AB](\.?[0-9A-TV-Z]{0,4})?$"), "r_mun6": v.rlike(r"^\d{6}$"), "r_mun7": v.rlike(r"^\d{7}$"),
        "r_uf_prefix": F.substring(v, 1, 2).isin(*STATES), "r_8": v.rlike(r"^\d{8}$"),
        "r_ymd": v.rlike(r"^(19|20)\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])$"), "r_dmy": v.rlike(r"^(0[1-9]|[12]\d|3[01])(0[1-9]|1[0-2])(19|20)\d{2}$"),
        "r_competence": v.rlike(r"^(19|20)\d{2}(0[1-9]|1[0-2])$"), "r_decimal": v.rlike(r"[.,]\d+$"), "r_negative": v.rlike(r"^-"), "r_dead": v.rlike(r"^(0+|9+)$"),
        "r_letter": v.rlike(r"[A-Za-z]{2}"),
    }
    out = statistics(freq).join(freq.groupBy("field").agg(*[F.coalesce(rate(c), F.lit(0.0)).alias(k) for k, c in rates.items()]), "field")
    lengths = freq.where("value is not null").groupBy("field", F.length("value").alias("l")).agg(F.sum("n").alias("n"))
    lengths = lengths.groupBy("field").agg(F.max_by("l", F.struct("n", -F.col("l"))).alias("modal_length"), (F.max("n") / F.sum("n")).alias("modal_share"))
    out = out.join(lengths, "field", "left").join(entropy(freq), "field", "left").join(tails(freq), "field", "left")
    for name, codes in (universes or {}).items():
        plain = freq.withColumn("value", F.upper(F.replace("value", F.lit("."), F.lit("")))) if name == "icd10" else freq
        hit = plain.join(codes.select(F.col("code").alias("value")).distinct().withColumn("hit", F.lit(True)), "value", "left").groupBy("field").agg(F.coalesce(rate(F.col("hit")), F.lit(0.0)).alias(f"m_{name}"))
        out = out.join(hit, "field", "left").withColumn(f"t_{name}", F.lit(codes.count()))
    for name in ("icd10", "municipality", "establishment", "procedure"):
        if name not in (universes or {}):
            out = out.withColumns({f"m_{name}": F.lit(0.0), f"t_{name}": F.lit(0)})
    return out.fillna(0, ["entropy", "letters", "density", "units", "modal_length", "modal_share", "high", "numeric_rate", "digit_rate", "alpha_rate", "leading_zero_rate", "mean_length"])


@dataclass(frozen=True)
class Detector:
    name: Column | str
    gate: Callable[[], Column]
    confidence: Callable[[], Column]
    cap: float = 1.0


def _hint(kind: str) -> Column:
    return F.col("field").rlike(HINTS[kind])


def _add(base: float, *parts: tuple[Column, float]) -> Column:
    out = F.lit(base)
    for condition, value in parts:
        out = out + F.when(condition, value).otherwise(0.0)
    return out


def _c(name: str) -> Column:
    return F.col(name)


def _id(digits: str, kind: str) -> Detector:
    r = f"r_{digits}"
    return Detector(
        f"personal_identifier_{kind}",
        lambda: (_c(r) >= 0.8) & (_c(r) == F.greatest("r_11", "r_15", "r_14")) & (_c("distinct_count") >= 20) & (_c("distinct_count") / _c("non_null") >= 0.05) & (_hint(kind) | (_c(r) > 0.95)),
        lambda: 0.5 + 0.4 * _c(r),
        0.95,
    )


DETECTORS: tuple[Detector, ...] = (
    Detector("constant_column", lambda: (_c("distinct_count") == 1) & (_c("non_null") > 0), lambda: F.lit(0.9)),
    Detector(
        "datasus_age", lambda: _c("r_age_letter") >= 0.5,
        lambda: _add(0.4, (_c("r_unit_letter") > 0.95, 0.15), (_c("entropy") < 2.2, 0.15), (_c("density") > 0.5, 0.15), (_c("high") <= 130, 0.05), (_c("distinct_count").between(40, 400), 0.05), (_hint("age"), 0.05)), 0.97,
    ),
    Detector("datasus_age", lambda: (_c("r_age_digit") >= 0.8) & _hint("age") & (_c("density") >= 0.4), lambda: _add(0.55, (_c("density") > 0.7, 0.2), (_c("density") <= 0.7, 0.1), (_c("units") <= 4, 0.1)), 0.95),
    Detector("uf_alpha", lambda: (_c("r_uf_alpha") >= 0.9) & (_c("distinct_count") <= 30), lambda: F.lit(0.9)),
    Detector("uf_numeric", lambda: (_c("r_uf_numeric") >= 0.9) & (_c("distinct_count") <= 30), lambda: F.lit(0.9)),
    _id("11", "cpf"), _id("15", "cns"), _id("14", "cnpj"),
    Detector(
        "icd10", lambda: (_c("r_icd") >= 0.5) & ~((_c("density") > 0.5) & (_c("entropy") < 2.2) & (_c("letters") <= 6)),
        lambda: _add(0.35, (_c("entropy") >= 2.5, 0.15), (_c("letters") >= 10, 0.1), (_c("distinct_count") > 120, 0.1), (_hint("diagnosis"), 0.05)) + F.when(_c("t_icd10") > 1000, 0.25 * _c("m_icd10")).otherwise(0.0), 0.99,
    ),
    *[
        Detector(
            f"municipality_code_{w}", lambda w=w: (_c(f"r_mun{w}") >= 0.7) & (_c("r_uf_prefix") >= 0.7),
            lambda: 0.4 + 0.2 * _c("r_uf_prefix") + F.when(_c("t_municipality") > 0, 0.3 * _c("m_municipality")).when(_hint("municipality"), 0.08).otherwise(0.0) + F.when(_c("distinct_count") > 50, 0.05).otherwise(0.0), 0.98,
        )
        for w in (6, 7)
    ],
    Detector("cnes_establishment", lambda: (_c("r_mun7") >= 0.9) & (_hint("establishment") | (_c("t_establishment") > 0)), lambda: _add(0.55, (_hint("establishment"), 0.15)) + 0.3 * _c("m_establishment"), 0.97),
    Detector("date", lambda: (_c("r_8") >= 0.6) & (F.greatest("r_ymd", "r_dmy") >= 0.5), lambda: 0.55 + 0.4 * F.greatest("r_ymd", "r_dmy"), 0.97),
    Detector("competencia", lambda: (_c("r_mun6") >= 0.8) & (_c("r_competence") > 0.9 * _c("r_mun6")), lambda: F.lit(0.9)),
    Detector("procedure_code", lambda: _c("modal_length").isin(8, 10) & (_c("modal_share") >= 0.9) & (_c("digit_rate") >= 0.9), lambda: _add(0.35, (_c("distinct_count") > 100, 0.1), (_hint("procedure"), 0.1)) + F.when(_c("t_procedure") > 500, 0.4 * _c("m_procedure")).otherwise(0.0), 0.97),
    Detector("money", lambda: (_c("numeric_rate") >= 0.9) & (_hint("money") | (_c("r_decimal") > 0)) & ((_c("r_negative") == 0) | _hint("money")), lambda: _add(0.35, (_hint("money"), 0.3), (_c("r_decimal") > 0, 0.2), (_c("distinct_count") > 50, 0.1)), 0.95),
    Detector("categorical_undecoded", lambda: _c("distinct_count").between(1, 60), lambda: F.lit(0.5)),
    Detector("numeric_measure", lambda: (_c("numeric_rate") >= 0.95) & (_c("distinct_count") > 60) & (_c("leading_zero_rate") <= 0.05) & ~((_c("min_length") == _c("max_length")) & (_c("max_length") >= 5)), lambda: F.lit(0.6)),
    Detector("free_text", lambda: (_c("distinct_count") / _c("non_null") > 0.5) & (_c("mean_length") > 8) & (_c("r_letter") > 0.3), lambda: F.lit(0.6)),
)


def verdicts(stats: DataFrame, detectors: tuple[Detector, ...] = DETECTORS) -> DataFrame:
    """(field, semantic_type, confidence, alternatives)."""
    made = []
    for i, d in enumerate(detectors):
        score = F.when(F.coalesce(d.gate(), F.lit(False)), F.least(d.confidence(), F.lit(d.cap)))
        name = F.lit(d.name) if isinstance(d.name, str) else d.name
        made.append(F.struct(F.coalesce(F.round(score, 6), F.lit(-1.0)).alias("confidence"), F.lit(-i).alias("order"), name.alias("type")))
    every = F.sort_array(F.filter(F.array(*made), lambda x: x["confidence"] >= 0), False)
    out = stats.withColumn("v", every)
    best = F.try_element_at("v", F.lit(1))
    return out.select("field", F.coalesce(best["type"], F.lit("unknown")).alias("semantic_type"), F.coalesce(best["confidence"], F.lit(0.0)).alias("confidence"), F.array_join(F.transform(F.slice("v", 2, 20), lambda x: x["type"]), ",").alias("alternatives"))


def aggregation_class(semantic_type: Column, declared: Column | None = None) -> Column:
    """Whether a field may be summed."""
    summable = semantic_type.isin("money", "numeric_measure")
    if declared is not None:
        summable = summable | (declared == "measure")
    return F.when(F.coalesce(summable, F.lit(False)), "additive").otherwise("non_summable")


def membership(freq: DataFrame, codes: DataFrame) -> DataFrame:
    """(field, share): mass of each field's values that lie in a set of codes."""
    hit = freq.join(codes.select(F.col("code").alias("value")).distinct().withColumn("hit", F.lit(True)), "value", "left")
    return hit.groupBy("field").agg(F.coalesce(F.round(rate(F.col("hit")), 6), F.lit(0.0)).alias("share"))


def sensitive(verdicts_: DataFrame) -> DataFrame:
    """Columns that hold personal identifiers, by their shapes."""
    return verdicts_.where(F.startswith("semantic_type", F.lit("personal_identifier"))).select("field", "semantic_type", "confidence")


def retired(freq: DataFrame, top: int = 3) -> DataFrame:
    """Fields whose most frequent values are all zeros, nines or blank."""
    from .profile import top_values

    dead = F.min(F.col("value").rlike(r"^(0+|9+)$"))
    return top_values(freq, top).groupBy("field").agg(dead.alias("retired")).where("retired").select("field")
