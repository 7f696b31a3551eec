"""Exploratory statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions import scalars as X


def missing(df: DataFrame) -> DataFrame:
    """(column, percent): share of nulls, two decimals, largest first."""
    n = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    stacked = n.select("__n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("k")) for c in df.columns])).alias("s"))
    percent = F.round(F.coalesce(F.try_divide(100.0 * F.col("s.k"), F.col("__n")), F.lit(0.0)), 2)
    return stacked.select("s.column", percent.alias("percent")).orderBy(F.desc("percent"), "column")


def frequency(df: DataFrame, value: str | Column, name: str = "value", top: int | None = None) -> DataFrame:
    """(name, n), commonest first; `top` makes it a top-k report."""
    c = F.col(value) if isinstance(value, str) else value
    out = df.select(c.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)
    return out.limit(top) if top else out


def weekdays(df: DataFrame, ts: str = "created_at") -> DataFrame:
    """Rows by weekday, Monday = 0."""
    return frequency(df, F.weekday(ts), "weekday", 10)


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, n): equal-width bins of the value's range; the last one is closed."""
    v = df.select(F.col(value).cast("double").alias("v")).where("v is not null")
    r = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))).cast("int")
    counted = v.join(F.broadcast(r)).groupBy(at.alias("bin"), "lo", "hi").agg(F.count("*").alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    return counted.select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n").orderBy("bin")


def density(df: DataFrame, value: str, points: int = 50) -> DataFrame:
    """(x, density): Gaussian kernel estimate on a fixed grid, bandwidth by Scott's rule; each distinct value is weighed by its count."""
    v = df.select(F.col(value).cast("double").alias("v")).where("v is not null")
    r = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"), F.stddev_samp("v").alias("s"))
    grid = r.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).select(
        (F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (points - 1)).alias("x"), "n", (F.greatest(F.coalesce("s", F.lit(0.0)), F.lit(1e-9)) * F.pow("n", F.lit(-0.2))).alias("h")
    )
    weighed = v.groupBy("v").agg(F.count("*").alias("m"))
    # The grid has `points` rows.
    kernel = F.exp(-F.pow((F.col("x") - F.col("v")) / F.col("h"), F.lit(2)) / 2) * F.col("m")
    return weighed.join(F.broadcast(grid)).groupBy("x", "n", "h").agg(F.sum(kernel).alias("k")).select("x", (F.col("k") / (F.col("n") * F.col("h") * 2.5066282746310002)).alias("density")).orderBy("x")


def feature_values(df: DataFrame, column: str, key: str) -> DataFrame:
    """Frequencies of one key of an array of 'key: value' texts."""
    k, v = X.parse_loose_pair(F.col("item"))
    items = df.select(F.explode(column).alias("item")).where("item is not null")
    return frequency(items.where(k == key), v, key)


def overview(df: DataFrame, ts: str = "created_at", birthday: str = "birthday", sex: str = "sex", features: str = "non_processing_features", today: str = "2026-01-01") -> dict[str, DataFrame]:
    """All reports by name; those whose column is missing are left out."""
    has = df.columns.__contains__
    out = {"missing": missing(df)}
    if has(ts):
        out["weekdays"] = weekdays(df, ts)
    if has(birthday):
        aged = df.select(X.age(F.try_to_timestamp(F.col(birthday).cast("string")), F.to_date(F.lit(today))).alias("age"))
        out |= {"age": histogram(aged, "age"), "age_density": density(aged, "age")}
    if has(sex):
        out["sex"] = frequency(df, sex, "sex")
    if has(features):
        out |= {k: feature_values(df, features, k) for k in ("device", "browser", "osfamily")}
    return out
