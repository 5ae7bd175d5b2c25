"""Distributional profile of every column from one frequency table.

One unpivot and one aggregation (partial before its shuffle) make (field, value, n); all statistics are derived
from that table, so a profile reads the data once however many fields it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import absent, as_text, stripped

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def frequencies(df: DataFrame, fields: list[str] | None = None, salt: int = 1) -> DataFrame:
    """(field, value, n) of all present values, and one row a field with value NULL for absent ones. `salt` spreads the cells of one field when a single value holds most rows and map-side combining is off."""
    fields = fields or df.columns
    cells = [F.struct(F.lit(c).alias("field"), as_text(F.col(f"`{c}`"), df.schema[c].dataType).alias("value")) for c in fields]
    long = df.select(F.explode(F.array(*cells)).alias("c")).select("c.field", "c.value")
    long = long.select("field", F.when(~absent(F.col("value")), stripped(F.col("value"))).alias("value"))
    if salt > 1:
        long = long.groupBy("field", "value", F.pmod(F.monotonically_increasing_id(), F.lit(salt)).alias("s")).count().groupBy("field", "value").agg(F.sum("count").alias("n"))
        return long
    return long.groupBy("field", "value").agg(F.count("*").alias("n"))


def rate(condition: Column) -> Column:
    """Share of present rows whose value meets a condition, over a frequency table."""
    n = F.when(F.col("value").isNotNull(), F.col("n"))
    return F.try_divide(F.sum(F.when(F.coalesce(condition, F.lit(False)), n).when(n.isNotNull(), F.lit(0))), F.sum(n)).cast("double")


def statistics(freq: DataFrame, by: list[str] = ["field"]) -> DataFrame:  # noqa: B006
    """One row a field: counts, lengths, rates, numeric summary."""
    v, n = F.col("value"), F.when(F.col("value").isNotNull(), F.col("n"))
    x = F.when(v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), v).try_cast("double")
    xn = F.when(x.isNotNull(), F.col("n"))
    mean = F.try_divide(F.sum(x * xn), F.sum(xn))
    return freq.groupBy(*by).agg(
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("non_null"),
        F.coalesce(F.sum(F.when(v.isNull(), F.col("n"))), F.lit(0)).cast("long").alias("nulls"),
        F.count(v).cast("long").alias("distinct_count"),
        F.min(F.length(v)).cast("long").alias("min_length"),
        F.max(F.length(v)).cast("long").alias("max_length"),
        F.round(F.try_divide(F.sum(F.length(v) * n), F.sum(n)), 6).alias("mean_length"),
        F.round(rate(v.rlike(r"^\d+$")), 6).alias("digit_rate"),
        F.round(rate(v.rlike(r"^[A-Za-z]+$")), 6).alias("alpha_rate"),
        F.round(rate(x.isNotNull()), 6).alias("numeric_rate"),
        F.round(rate(v.rlike(r"^0\d")), 6).alias("leading_zero_rate"),
        F.min(x).alias("min_value"),
        F.max(x).alias("max_value"),
        F.round(mean, 6).alias("mean_value"),
    )


def top_values(freq: DataFrame, keep: int = 200) -> DataFrame:
    """(field, value, n, percent, rank) of the most frequent values, ties by value (A02, T01). The rank limit is applied before the shuffle, per task."""
    total = Window.partitionBy("field")
    order = total.orderBy(F.col("n").desc(), F.col("value").asc())
    present = freq.where("value is not null")
    totals = present.groupBy("field").agg(F.sum("n").alias("total"))
    ranked = present.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    return ranked.join(F.broadcast(totals), "field").select("field", "value", "n", F.round(F.col("n") * 100 / F.col("total"), 4).alias("percent"), "rank")


def entropy(freq: DataFrame) -> DataFrame:
    """(field, entropy, letters): Shannon bits of the first characters' distribution."""
    first = freq.where("value is not null").groupBy("field", F.substring("value", 1, 1).alias("ch")).agg(F.sum("n").alias("n"))
    total = first.groupBy("field").agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return first.join(F.broadcast(total), "field").groupBy("field").agg(F.round(-F.sum(p * F.log2(p)) + 0.0, 6).alias("entropy"), F.count("*").alias("letters"))


def quantiles(freq: DataFrame, at: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(field, q, x): nearest-rank quantiles of the numeric values, exact, by running counts over each field's distinct values."""
    x = freq.withColumn("x", F.col("value").try_cast("double")).where("x is not null").groupBy("field", "x").agg(F.sum("n").alias("n"))
    run = Window.partitionBy("field").orderBy("x")
    x = x.withColumn("upto", F.sum("n").over(run))
    total = x.groupBy("field").agg(F.sum("n").alias("total"))
    q = x.join(F.broadcast(total), "field").withColumn("q", F.explode(F.array(*[F.lit(a) for a in at])))
    return q.where(F.col("upto") >= F.ceil(F.col("q") * F.col("total"))).groupBy("field", "q").agg(F.min("x").alias("x"))


def approximate_quantiles(df: DataFrame, fields: list[str], at: tuple[float, ...] = QUANTILES, accuracy: int = 10_000) -> DataFrame:
    """The same by a mergeable sketch, for fields of very many distinct values."""
    return df.select(*[F.percentile_approx(F.col(c).try_cast("double"), list(at), accuracy).alias(c) for c in fields])


def tails(freq: DataFrame, prefix: int = 1, trim: float = 0.005) -> DataFrame:
    """(field, low, high, distinct_tails, density, units): the numbers after a prefix, trimmed by mass at both ends; density is distinct tails over the width of their span, 0 under five of them."""
    t = freq.where("value is not null").withColumn("tail", F.when(F.substring(F.col("value"), prefix + 1, 20).rlike(r"^\d+$"), F.substring(F.col("value"), prefix + 1, 20)).try_cast("bigint"))
    t = t.where("tail is not null").withColumn("unit", F.substring("value", 1, prefix))
    units = t.groupBy("field").agg(F.count_distinct("unit").alias("units"))
    t = t.groupBy("field", "tail").agg(F.sum("n").alias("n"))
    run = Window.partitionBy("field").orderBy("tail")
    t = t.withColumn("upto", F.sum("n").over(run))
    total = t.groupBy("field").agg(F.sum("n").alias("total"))
    t = t.join(F.broadcast(total), "field").where((F.col("upto") > F.col("total") * trim) & (F.col("upto") - F.col("n") < F.col("total") * (1 - trim)))
    out = t.groupBy("field").agg(F.min("tail").alias("low"), F.max("tail").alias("high"), F.count("*").alias("distinct_tails"))
    density = F.when(F.col("distinct_tails") >= 5, F.round(F.col("distinct_tails") / (F.col("high") - F.col("low") + 1), 6)).otherwise(F.lit(0.0))
    return out.join(units, "field").select("field", "low", "high", "distinct_tails", density.alias("density"), "units")


def profile(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One row a field with everything the detectors read."""
    freq = frequencies(df, fields)
    return statistics(freq).join(entropy(freq), "field", "left").join(tails(freq), "field", "left")
