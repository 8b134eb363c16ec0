"""Grouped measures: shares, entropy, lift, leaks, fits, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share_of(df: DataFrame, *by: str) -> DataFrame:
    """Count of each group and its share of all rows (the named denominator)."""
    counted = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def entropy(df: DataFrame, group: str, value: str) -> DataFrame:
    """Shannon entropy in bits of `value` within each group."""
    return entropy_of_counts(df.groupBy(group, value).agg(F.count(F.lit(1)).alias("c")), group)


def entropy_of_counts(counted: DataFrame, group: str) -> DataFrame:
    """The same from rows (group, a value's count `c`)."""
    # H = log2(N) - sum(c log2 c) / N, so one aggregation over the counts suffices
    out = counted.groupBy(group).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return out.select(group, "n", F.round(F.log2("n") - F.col("s") / F.col("n"), 6).alias("entropy"))


def lift(df: DataFrame, cue: Column, label: Column) -> DataFrame:
    """Counts, precision, base rate and lift of a cue for a class; null where undefined."""
    out = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(cue).alias("cued"), F.count_if(label).alias("positive"), F.count_if(cue & label).alias("both"))
    precision, base = F.try_divide(F.col("both"), F.col("cued")), F.try_divide(F.col("positive"), F.col("n"))
    return out.select("*", F.round(precision, 6).alias("precision"), F.round(base, 6).alias("base_rate"), F.round(F.try_divide(precision, base), 6).alias("lift"))


def leaks(df: DataFrame, grams: Column, label: Column, least: int) -> DataFrame:
    """Grams that occur in at least `least` rows of a class and in none outside."""
    told = df.select(label.alias("__label"), F.explode(F.array_distinct(grams)).alias("gram"))
    counted = told.groupBy("gram").agg(F.count_if("__label").alias("inside"), F.count_if(~F.col("__label")).alias("outside"))
    return counted.filter((F.col("inside") >= least) & (F.col("outside") == 0)).select("gram", "inside")


def budget_take(df: DataFrame, key: Column, size: str, budget: int) -> DataFrame:
    """Rows in order of an integer key of bounded range, while the total before a row's key
    group and its predecessors in it is below the budget.

    Totals of key groups are summed first, so the only ordered window without partitions
    runs over one row per key value, not over the rows.
    """
    keyed = df.withColumn("__key", key)
    sums = keyed.groupBy("__key").agg(F.sum(size).alias("__n"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("__key").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    reached = keyed.join(before.filter(F.col("__before") < budget).select("__key", "__before"), "__key")
    total = F.col("__before") + F.coalesce(F.sum(size).over(inside), F.lit(0))
    return reached.withColumn("prev_total", total).filter(F.col("prev_total") < budget).drop("__key", "__before")


def lcg(column: Column) -> Column:
    """A linear congruential step modulo 32768, equal in every SQL engine."""
    return F.pmod(column * 1103515245 + 12345, F.lit(32768))
