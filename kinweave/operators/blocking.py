"""Candidate pairs: a union of capped equi-joins within blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A block keeps its first CAP members, by id: a feature of the operator, not a shortcut.
CAP = 800


def _key(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def block_keys(profiles: DataFrame, sites: DataFrame) -> DataFrame:
    """(pass, key, id) rows of all six passes. Empty device and os sets are values like others."""
    c = F.col
    device, os = F.concat_ws(", ", "device"), F.concat_ws(", ", "osfamily")
    geo, tz = c("geoname_id"), c("tz_offset").cast("string")
    passes = {
        "geo_device": (geo.isNotNull(), _key(geo, os, device)),
        "name_geo": (c("first_name_clean").isNotNull() & geo.isNotNull(), _key(c("first_name_clean"), c("last_name_clean"), geo)),
        "sex_geo": (c("sex").isNotNull() & geo.isNotNull() & (c("sex") != "unknown"), _key(c("sex"), geo)),
        "tz_geo": (tz.isNotNull() & geo.isNotNull(), _key(tz, geo)),
        "device_tz_geo": (tz.isNotNull() & geo.isNotNull(), _key(device, tz, geo)),
    }
    keys = F.array(*[F.struct(F.lit(p).alias("pass"), F.when(ok, key).alias("key")) for p, (ok, key) in passes.items()])
    own = profiles.select(F.explode(keys).alias("k"), c("profile_id").alias("id")).select("k.pass", "k.key", "id").where("key is not null")
    site = sites.select(F.lit("site").alias("pass"), c("site_id").cast("string").alias("key"), c("profile_id").alias("id")).distinct()
    return own.unionByName(site)


def capped(rows: DataFrame, keys: list[str], id_: str = "id", cap: int = CAP) -> DataFrame:
    """The first `cap` members of each block, numbered by id."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(id_))
    return rows.withColumn("rn", n).where(F.col("rn") <= cap)


def pairs_within(rows: DataFrame, keys: list[str], id_: str = "id", cap: int = CAP) -> DataFrame:
    """Distinct (a, b), a < b, of members that share a block."""
    members = capped(rows.select(*keys, id_).distinct(), keys, id_, cap)
    right = members.select(*keys, F.col(id_).alias("b"), F.col("rn").alias("rb"))
    return members.join(right, keys).where("rn < rb").select(F.col(id_).alias("a"), "b").distinct()


def candidate_pairs(profiles: DataFrame, sites: DataFrame, cap: int = CAP) -> DataFrame:
    """All passes in one capped self-join and one distinct."""
    return pairs_within(block_keys(profiles, sites), ["pass", "key"], "id", cap)


def block_sizes(rows: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """(group, n_keys, n_groups): blocks, and blocks of two or more members."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.groupBy(*group).agg(F.count("*").alias("n_keys"), F.count_if(F.col("n") >= 2).alias("n_groups"))


def label_pairs(pairs: DataFrame, labels: DataFrame, id_: str = "profile_id", label: str = "entity_id") -> DataFrame:
    """Append label: 1 if both ends are of one entity."""
    of = lambda e: labels.select(F.col(id_).alias(e), F.col(label).alias(f"l{e}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").withColumn("label", F.coalesce(F.col("la") == F.col("lb"), F.lit(False)).cast("int")).drop("la", "lb")


def blocking_recall(pairs: DataFrame, labels: DataFrame, id_: str = "profile_id", label: str = "entity_id") -> DataFrame:
    """(found, total, recall): true pairs found over all true pairs; 1 if there are none."""
    found = label_pairs(pairs, labels, id_, label).agg(F.coalesce(F.sum("label"), F.lit(0)).alias("found"))
    size = labels.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    total = size.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("total"))
    return found.join(F.broadcast(total)).withColumn("recall", F.coalesce(F.try_divide("found", "total"), F.lit(1.0)))
