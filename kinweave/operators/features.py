"""The 31 features of a candidate pair, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions import scalars as X
from kinweave.session import Scratch, small_methods

# Site categories with features of their own, and the flags compared.
CATEGORIES = ("has_order_365", "has_account", "has_accept_365", "visited_365", "has_click_365")
BOTH = ("is_gmail", "is_yandex", "is_man", "is_woman", "is_phone")
NAMES = (
    "fname_lev", "fname_jaccard", "full_name_jaccard", "phone_prefix_jaccard", "phone_prefix_overlap", "geo_match", "tz_diff", "device_jaccard", "osfamily_jaccard",
    "sites_jaccard", "sites_overlap", *(f"{c}_{m}" for c in CATEGORIES for m in ("jaccard", "overlap")), "last_event_diff_days", "day_overlap_ratio",
    *(f"both_{f}" for f in BOTH), "country_conflict", "tz_far_apart", "device_os_conflict",
)
USED = ("first_name_clean", "last_name_clean", "phone_prefix", "geoname_id", "tz_offset", "device", "osfamily", "last_event_date", "active_days", "country", *BOTH)


def site_sets(sites: DataFrame) -> DataFrame:
    """One row per profile: the set of all its sites, and of each category's."""
    of = lambda c: F.array_sort(F.collect_set(F.when(F.col("category") == c, F.col("site_id"))))
    return sites.groupBy("profile_id").agg(F.array_sort(F.collect_set("site_id")).alias("all"), *[of(c).alias(c) for c in CATEGORIES])


def sides(profiles: DataFrame, sites: DataFrame) -> DataFrame:
    """What a pair needs of each profile, made once a profile: the sets of name grams and of sites, nulls filled in."""
    c = F.col
    first, last = (F.coalesce(c(n), F.lit("")) for n in ("first_name_clean", "last_name_clean"))
    filled = lambda n, kind="string": F.coalesce(c(n), F.array().cast(f"array<{kind}>")).alias(n)
    kinds = {f.name: f.dataType.elementType.simpleString() for f in profiles.schema.fields if f.dataType.typeName() == "array"}
    full = profiles.select("profile_id", *USED).join(site_sets(sites), "profile_id", "left")
    return full.select(
        "profile_id", first.alias("first"), X.grams(first).alias("fname"), X.grams(F.concat(first, F.lit(" "), last)).alias("full_name"), "geoname_id", "tz_offset",
        F.unix_micros(c("last_event_date").cast("timestamp")).alias("last_event"), F.coalesce("country", F.lit("")).alias("country"), c("osfamily").isNotNull().alias("os_known"),
        *[F.coalesce(f, F.lit(False)).alias(f) for f in BOTH],
        *[filled(n, kinds[n]) for n in ("phone_prefix", "device", "osfamily", "active_days")],
        *[filled(n, "bigint").alias(s) for n, s in (("all", "sites"), *((n, n) for n in CATEGORIES))],
    )


#: The sets that are compared, by the name of their features.
SETS = {"fname": "fname", "full_name": "full_name", "phone_prefix": "phone_prefix", "device": "device", "osfamily": "osfamily", "day_overlap_ratio": "active_days", "sites": "sites", **{c: c for c in CATEGORIES}}


def _features(a: Column, b: Column) -> dict[str, Column]:
    """From the sides, and from n_* and common_* of each set: the members of both sides together, and those in common."""
    number = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    tz = F.coalesce(F.abs(a["tz_offset"] - b["tz_offset"]), F.lit(0)).cast("double")
    n, common = ({s: F.col(f"{k}_{s}") for s in SETS} for k in ("n", "common"))
    out = {f"{s}_jaccard": F.when(n[s] == 0, F.lit(1.0)).otherwise(common[s] / (n[s] - common[s])) for s in SETS}
    out |= {f"{s}_overlap": common[s] for s in SETS}
    out |= {
        "fname_lev": X.levenshtein_distance(a["first"], b["first"]),
        "geo_match": F.coalesce(a["geoname_id"] == b["geoname_id"], F.lit(False)).cast("int"),
        "tz_diff": tz,
        "last_event_diff_days": F.abs(a["last_event"] - b["last_event"]) / 8.64e10,
        "day_overlap_ratio": F.when(n["day_overlap_ratio"] == 0, F.lit(0.0)).otherwise(out["day_overlap_ratio_jaccard"]),
        **{f"both_{f}": (a[f] & b[f]).cast("int") for f in BOTH},
        "country_conflict": ((a["country"] != "") & (b["country"] != "") & (a["country"] != b["country"])).cast("int"),
        "tz_far_apart": (tz > 4).cast("int"),
        "device_os_conflict": (a["os_known"] & b["os_known"] & (F.size(a["device"]) > 0) & (F.size(b["device"]) > 0) & (a["osfamily"] != b["osfamily"])).cast("int"),
    }
    return {n: number(out[n]) if n not in ("last_event_diff_days",) else out[n] for n in NAMES}


def build_features(pairs: DataFrame, profiles: DataFrame, sites: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(a, b, 31 features) for each pair whose ends are both profiles; missing site sets are empty.

    Sides are broadcast while their measured size is within the limit of Scratch.small, and shuffled beyond it."""
    scratch = scratch or Scratch(pairs.sparkSession)
    small_methods(pairs.sparkSession)
    full = scratch.save(sides(profiles, sites))
    small = scratch.small(full)
    side = lambda e: small.select(F.col("profile_id").alias(e), F.struct(*[c for c in full.columns if c != "profile_id"]).alias(f"p{e}"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    pa, pb = F.col("pa"), F.col("pb")
    # Sets are met once a pair; what follows uses the counts.
    counts = {f"n_{s}": F.size(pa[c]) + F.size(pb[c]) for s, c in SETS.items()} | {f"common_{s}": X.overlap(pa[c], pb[c]) for s, c in SETS.items()}
    met = joined.select("a", "b", "pa", "pb", *[c.alias(n) for n, c in counts.items()])
    return met.select("a", "b", *[c.alias(n) for n, c in _features(pa, pb).items()])
