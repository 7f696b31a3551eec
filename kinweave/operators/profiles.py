"""From raw events to clean events, profile passports and set-valued indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.functions import parsing as P
from kinweave.functions import scalars as X

# Feature prefixes, flags and passport columns of the data model.
SITE_PREFIXES = ("has_accept_", "has_account", "has_click_", "has_order_", "has_view_", "source_site_", "visited_")
CATEGORY_PREFIXES = ("postman_response_", "postman_action_", "postman_campaign_", "postman_scenario_", "mm_event_")
FLAGS = ("is_gmail", "is_yandex", "is_man", "is_woman", "is_phone", "was_phone_lead")
LATEST = ("first_name_clean", "last_name_clean", "sex", "geoname_id", "geoname", "country", "subdivision_1_iso_code", "tz_offset", "birthday_clean")
SETS = {"email_normalized": "email_normalized", "email_domain": "email_domain", "phone_normalized": "phone_normalized", "phone_prefix": "phone_prefix", "device": "device", "osfamily": "osfamily", "browser": "browser"}


def drop_repeats(df: DataFrame) -> DataFrame:
    """Full-row distinct; map columns are compared by their sorted entries."""
    maps = [f.name for f in df.schema.fields if f.dataType.typeName() == "map"]
    keyed = df.withColumns({f"{m}__e": F.array_sort(F.map_entries(m)) for m in maps}) if maps else df
    return keyed.dropDuplicates([f"{c}__e" if c in maps else c for c in df.columns]).select(*df.columns)


def unify_labels(df: DataFrame, profile: str = "profile_id", label: str = "entity_id", ts: str = "created_at", tie: str | None = None) -> DataFrame:
    """Each profile's rows take the label of its latest row; null times never win, ties go to the larger `tie` (or label)."""
    tie = tie or label
    last = df.groupBy(profile).agg(F.max_by(label, F.when(F.col(ts).isNotNull(), F.struct(ts, tie))).alias("__label"))
    return df.drop(label).join(last.withColumnRenamed("__label", label), profile, "left").select(*df.columns)


def entity_types(df: DataFrame, profile: str = "profile_id", label: str = "entity_id") -> DataFrame:
    """(label, entity_type): multi_profile if the entity has more than one profile."""
    n = df.groupBy(label).agg(F.count_distinct(profile).alias("n"))
    return n.select(label, F.when(F.col("n") > 1, "multi_profile").otherwise("single_profile").alias("entity_type"))


def label_conflicts(df: DataFrame, profile: str = "profile_id", label: str = "entity_id") -> DataFrame:
    """The largest number of labels of one profile."""
    return df.groupBy(profile).agg(F.count_distinct(label).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("max_labels"))


def normalize_contacts(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns(
        {
            "email_normalized": X.normalize_email(c("email")),
            "email_domain": X.email_domain(c("email")),
            "phone_normalized": X.normalize_phone(c("phone")),
            "phone_prefix": X.phone_prefix(c("phone")),
            "first_name_clean": X.normalize_name(c("first_name")),
            "last_name_clean": X.normalize_name(c("last_name")),
            "birthday_clean": X.normalize_date(c("birthday")),
        }
    )


def preprocess(raw: DataFrame) -> DataFrame:
    """Parsed, distinct, label-unified and normalized events. Known keys become columns (the non-processing
    array first, then realtime, then site features); the maps fs and npf keep the rest."""
    df = raw.where(F.col("profile_id").isNotNull())
    df = df.withColumns({"fs": P.key_values(F.col("fs_features")), "npf": P.key_values(F.col("non_processing_features")), "rt": P.realtime(F.col("realtime_features"))})
    df = drop_repeats(df.drop("fs_features", "non_processing_features", "realtime_features"))
    if "entity_id" in df.columns:
        given = "entity_type" in df.columns
        # Both labels come from one latest row.
        pair = df.withColumn("__own", F.struct("entity_id", *["entity_type"] * given)).drop("entity_id", "entity_type")
        df = unify_labels(pair, label="__own").select(*pair.drop("__own").columns, "__own.*")
        if not given:
            df = df.join(entity_types(df), "entity_id", "left")
    pick = lambda k: F.coalesce(F.col("npf")[k], F.col("fs")[k])
    df = df.withColumns({k: pick(k) for k in ("osfamily", "device", "browser", "geoname_id", "subdivision_1_iso_code")})
    df = df.withColumns({k: F.col(f"rt.{k}") for k in ("country", "tz_offset", "geoname", "day", "local_hour")})
    df = df.withColumns({k: F.when(F.lower(F.col("fs")[k]) == "true", True) for k in FLAGS})
    return normalize_contacts(df)


def latest(value: str, ts: str = "created_at", tie: str | None = None) -> Column:
    """The latest value that isn't null; ties go to the larger `tie` (or value)."""
    return F.max_by(value, F.when(F.col(value).isNotNull() & F.col(ts).isNotNull(), F.struct(F.col(ts), F.col(tie or value)))).alias(value)


def value_set(value: str) -> Column:
    return F.array_sort(F.collect_set(value))


def passports(clean: DataFrame) -> DataFrame:
    """One row per profile: latest scalars, sets, flags, counters and times, in one aggregation."""
    labels = [F.first(c, ignorenulls=True).alias(c) for c in ("entity_id", "entity_type") if c in clean.columns]
    out = clean.groupBy("profile_id").agg(
        *[latest(c) for c in LATEST],
        *[value_set(c).alias(n) for n, c in SETS.items()],
        *[F.bool_or(c).alias(c) for c in FLAGS],
        F.max("created_at").alias("last_event_date"),
        F.min("created_at").alias("first_event_time"),
        F.max("created_at").alias("last_event_time"),
        F.count("*").alias("n_events"),
        value_set("day").alias("active_days"),
        value_set("local_hour").alias("active_hours"),
        *labels,
    )
    return out.withColumns({"n_emails": F.size("email_normalized"), "n_phones": F.size("phone_normalized"), "n_devices": F.size("device")})


def _index(clean: DataFrame, prefixes: tuple[str, ...], value: Column, name: str) -> DataFrame:
    rows = clean.select("profile_id", F.explode(F.map_entries("fs")).alias("e")).select("profile_id", F.col("e.key").alias("category"), F.col("e.value").alias("v"))
    return rows.where(F.col("category").rlike("^(" + "|".join(prefixes) + ")")).select("profile_id", "category", value.alias(name)).where(F.col(name).isNotNull()).distinct()


def site_index(clean: DataFrame) -> DataFrame:
    """Distinct (profile_id, category, site_id)."""
    return _index(clean, SITE_PREFIXES, X.to_id(F.nullif(F.col("v"), F.lit(""))), "site_id")


def category_index(clean: DataFrame) -> DataFrame:
    """Distinct (profile_id, category, value)."""
    return _index(clean, CATEGORY_PREFIXES, X.clean_category(F.col("v")), "value")


def idf(index: DataFrame, item: str, n: int | DataFrame, owner: str = "profile_id") -> DataFrame:
    """(item, df, idf): ln(n / owners that have the item); n is a number, or one row that has it."""
    seen = index.groupBy(item).agg(F.count_distinct(owner).alias("df"))
    seen = seen.withColumn("n", F.lit(n)) if isinstance(n, int) else seen.join(F.broadcast(n.select("n")))
    return seen.select(item, "df", F.log(F.col("n") / F.col("df")).alias("idf"))


def latest_row(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """The whole latest row of each key."""
    w = W.partitionBy(key).orderBy(F.col(ts).desc_nulls_last(), F.col(tie).desc())
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
