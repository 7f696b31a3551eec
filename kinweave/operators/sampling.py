"""Deterministic splitting and sampling by hashed ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def entity_split(entities: DataFrame, key: str = "entity_id", stratum: str = "entity_type", seed: int = 42) -> DataFrame:
    """(key, stratum, split): 20 % test, 20 % val, the rest train, by exact counts within each stratum.

    Ranks are counted in hash-range buckets first, so no stratum is sorted in one task."""
    hashed = entities.select(key, stratum, F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))).alias("h"))
    hashed = hashed.withColumn("bucket", F.substring("h", 1, 3))
    size = hashed.groupBy(stratum, "bucket").agg(F.count("*").alias("m"))
    # At most 4096 rows a stratum.
    before = size.select(stratum, "bucket", F.sum("m").over(W.partitionBy(stratum).orderBy("bucket")).alias("upto"), "m", F.sum("m").over(W.partitionBy(stratum)).alias("n"))
    within = F.row_number().over(W.partitionBy(stratum, "bucket").orderBy("h", key))
    ranked = hashed.withColumn("r", within).join(before.select(stratum, "bucket", "n", (F.col("upto") - F.col("m")).alias("base")), [stratum, "bucket"])
    rn = F.col("base") + F.col("r")
    return ranked.select(key, stratum, F.when(rn * 5 <= F.col("n"), "test").when(rn * 5 <= 2 * F.col("n"), "val").otherwise("train").alias("split"))


def balance(labelled: DataFrame, ratio: int = 8, seed: int = 42) -> DataFrame:
    """All positive pairs and min(ratio * positives, negatives) negative ones, those of the lowest hashes."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("a").cast("string"), F.col("b").cast("string")))
    rows = labelled.withColumns({"h": h, "bucket": F.substring(h, 1, 4)})
    positives = rows.agg(F.count_if(F.col("label") == 1).alias("pos"))
    negatives = rows.where("label = 0")
    size = negatives.groupBy("bucket").agg(F.count("*").alias("m"))
    # 65536 rows at most.
    base = size.select("bucket", (F.sum("m").over(W.orderBy("bucket")) - F.col("m")).alias("base"))
    ranked = negatives.withColumn("r", F.row_number().over(W.partitionBy("bucket").orderBy("h", "a", "b"))).join(base, "bucket").join(F.broadcast(positives))
    picked = ranked.where(F.col("base") + F.col("r") <= ratio * F.col("pos"))
    return rows.where("label = 1").select(*labelled.columns).unionByName(picked.select(*labelled.columns))
