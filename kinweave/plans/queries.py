"""The engine's operators as queries over the driver's tables, each with SQL where SQL can say it.

Events stand in for raw events: a user is a profile, the event type and `k` of its properties are its
features. Everything runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import parsing as P
from kinweave.functions import scalars as X
from kinweave.operators import blocking, clustering, eda, features, metrics, profiles, sampling
from kinweave.operators.components import connected_components
from kinweave.plans import linkage
from kinweave.session import Scratch, configure
from kinweave.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _k(c="props"):
    return F.get_json_object(c, "$.k").cast("bigint")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(profile_id, created_at, event_type, event_id, k)."""
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("profile_id"), F.col("ts").alias("created_at"), "event_type", "event_id", "value", _k().alias("k"))


EV = "ev AS (SELECT user_id AS profile_id, ts AS created_at, event_type, event_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


@query(f"WITH {EV} SELECT event_id, CAST(k AS VARCHAR) AS typed, CAST(k + 1 AS VARCHAR) AS last_wins, 'true' AS flag, 'x:' || k AS rest, 5 AS n FROM ev")
def kv_parse(spark, sf_dir):
    e = events(spark, sf_dir)
    k = F.col("k").cast("string")
    m = P.key_values(F.array(F.concat(F.lit("typed:"), k), F.concat(F.lit("k:"), k), F.concat(F.lit("k:"), (F.col("k") + 1).cast("string")), F.lit("flag"), F.concat(F.lit("b:x:"), k), F.lit(None), F.concat(F.lit("t:"), "event_type")))
    return e.withColumn("m", m).select("event_id", F.col("m")["typed"].alias("typed"), F.col("m")["k"].alias("last_wins"), F.col("m")["flag"].alias("flag"), F.col("m")["b"].alias("rest"), F.size("m").alias("n"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, len(json_keys(props))::INT AS n FROM events")
def json_unpack(spark, sf_dir):
    m = P.json_map(F.col("props"))
    return read(spark, sf_dir, "events").select("event_id", m["k"].alias("k"), F.size(m).alias("n"))


@query("SELECT o_custkey, o_orderstatus, count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders) GROUP BY ALL")
def full_row_dedup(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", F.create_map(F.lit("p"), F.col("o_orderpriority")).alias("m"))
    return profiles.drop_repeats(o).groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))


@query(f"WITH {EV}, l AS (SELECT profile_id, arg_max(event_type, struct_pack(a := created_at, b := event_id)) AS t FROM ev GROUP BY 1) SELECT event_id, profile_id, t AS label FROM ev JOIN l USING (profile_id)")
def latest_label(spark, sf_dir):
    e = events(spark, sf_dir).withColumnRenamed("event_type", "label")
    return profiles.unify_labels(e, "profile_id", "label", "created_at", "event_id").select("event_id", "profile_id", "label")


@query(f"WITH {EV} SELECT * EXCLUDE n FROM (SELECT profile_id, event_id, event_type, row_number() OVER (PARTITION BY profile_id ORDER BY created_at DESC, event_id DESC) AS n FROM ev) WHERE n = 1")
def latest_row(spark, sf_dir):
    return profiles.latest_row(events(spark, sf_dir), "profile_id", "created_at", "event_id").select("profile_id", "event_id", "event_type")


@query("SELECT p_brand AS entity_id, CASE WHEN count(DISTINCT p_size) > 1 THEN 'multi_profile' ELSE 'single_profile' END AS entity_type FROM part GROUP BY 1")
def entity_type(spark, sf_dir):
    return profiles.entity_types(read(spark, sf_dir, "part"), "p_size", "p_brand").withColumnRenamed("p_brand", "entity_id")


@query("SELECT max(n) AS max_labels FROM (SELECT count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY o_custkey)")
def label_conflicts(spark, sf_dir):
    return profiles.label_conflicts(read(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus")


@query(
    f"""WITH {EV} SELECT profile_id, arg_max(k, struct_pack(a := created_at, b := event_id)) AS last_k, count(*) AS n_events, min(created_at) AS first_event_time, max(created_at) AS last_event_time,
    array_to_string(list_sort(list(DISTINCT event_type)), ', ') AS types, bool_or(event_type = 'purchase') AS bought, array_to_string(list_sort(list(DISTINCT isodow(created_at) - 1)), ', ') AS days, count(DISTINCT k) AS n_k FROM ev GROUP BY 1"""
)
def profile_passport(spark, sf_dir):
    return events(spark, sf_dir).groupBy("profile_id").agg(
        profiles.latest("k", tie="event_id").alias("last_k"), F.count("*").alias("n_events"), F.min("created_at").alias("first_event_time"), F.max("created_at").alias("last_event_time"),
        X.join_values(F.collect_set("event_type")).alias("types"), F.bool_or(F.col("event_type") == "purchase").alias("bought"),
        F.array_join(profiles.value_set(F.weekday("created_at")), ", ").alias("days"), F.size(F.collect_set("k")).cast("bigint").alias("n_k"),
    )


def _fs(spark, sf_dir):
    pair = F.concat(F.when(F.col("event_type") == "purchase", "has_order_365:").when(F.col("event_type") == "view", "visited_365:").when(F.col("event_type") == "click", "has_click_365:").otherwise("mm_event_30:"), F.col("k").cast("string"))
    return events(spark, sf_dir).select("profile_id", "event_id", "created_at", P.key_values(F.array(pair)).alias("fs"))


CATEGORY = "CASE event_type WHEN 'purchase' THEN 'has_order_365' WHEN 'view' THEN 'visited_365' WHEN 'click' THEN 'has_click_365' ELSE 'mm_event_30' END"


@query(f"WITH {EV} SELECT DISTINCT profile_id, {CATEGORY} AS category, k AS site_id FROM ev WHERE event_type IN ('purchase', 'view', 'click') AND k IS NOT NULL")
def site_index(spark, sf_dir):
    return profiles.site_index(_fs(spark, sf_dir))


@query(f"WITH {EV} SELECT DISTINCT profile_id, {CATEGORY} AS category, CAST(k AS VARCHAR) AS value FROM ev WHERE event_type NOT IN ('purchase', 'view', 'click') AND k IS NOT NULL")
def category_index(spark, sf_dir):
    return profiles.category_index(_fs(spark, sf_dir))


@query(f"WITH {EV}, s AS (SELECT DISTINCT profile_id, k FROM ev WHERE event_type IN ('purchase', 'view', 'click')) SELECT k AS site_id, count(*) AS df, round(ln((SELECT count(DISTINCT user_id) FROM events) / count(*)), 6) AS idf FROM s GROUP BY 1")
def idf_sites(spark, sf_dir):
    sites = profiles.site_index(_fs(spark, sf_dir))
    n = events(spark, sf_dir).agg(F.count_distinct("profile_id").alias("n"))
    out = profiles.idf(sites, "site_id", n)
    return out.select("site_id", "df", F.round("idf", 6).alias("idf"))


@query("SELECT c_mktsegment AS domain, count(DISTINCT c_custkey) AS df, round(ln((SELECT count(*) FROM customer) / count(DISTINCT c_custkey)), 6) AS idf FROM customer GROUP BY 1")
def idf_domains(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("profile_id"), F.col("c_mktsegment").alias("domain"))
    out = profiles.idf(c, "domain", c.agg(F.count("*").alias("n")))
    return out.select("domain", "df", F.round("idf", 6).alias("idf"))


@query("""SELECT c_custkey, lower(replace(c_name, ' ', '')) || '@x' || c_custkey % 9 || '.org' AS email, 'x' || c_custkey % 9 || '.org' AS domain, CASE WHEN length(d) = 10 THEN '7' || d WHEN length(d) = 11 AND d[1] IN ('7', '8') THEN '7' || d[2:] END AS phone,
    CASE WHEN length(d) = 10 THEN ('7' || d)[1:4] WHEN length(d) = 11 AND d[1] IN ('7', '8') THEN ('7' || d[2:])[1:4] END AS prefix, nullif(regexp_replace(lower(c_name), '[^a-z-]', '', 'g'), '') AS name, '1990-' || lpad(CAST(1 + c_custkey % 12 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + c_custkey % 28 AS VARCHAR), 2, '0') AS birthday, c_custkey % 2 = 0 AS flag
    FROM (SELECT *, CAST(89160000000 + c_custkey * 7 % 3000000000 AS VARCHAR) AS d FROM customer)""")
def contacts(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    email = F.concat(F.lit("\t "), F.upper("c_name"), F.concat(F.lit("@X"), (F.col("c_custkey") % 9).cast("string"), F.lit(".org ")))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    phone = F.concat(F.lit("+"), (F.lit(89160000000) + F.col("c_custkey") * 7 % 3000000000).cast("string"))
    return c.select(
        "c_custkey", X.normalize_email(email).alias("email"), X.strip(X.email_domain(email)).alias("domain"), X.normalize_phone(phone).alias("phone"), X.phone_prefix(phone).alias("prefix"),
        X.normalize_name(F.col("c_name")).alias("name"), X.normalize_date(F.concat(two(F.col("c_custkey") % 12 + 1), F.lit("."), two(F.col("c_custkey") % 28 + 1), F.lit(".1990"))).alias("birthday"), X.normalize_bool((F.col("c_custkey") % 2 == 0).cast("string")).alias("flag"),
    )


def _blocks(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    segment = c.select(F.lit("segment").alias("pass"), F.concat_ws("|", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("key"), F.col("c_custkey").alias("id"))
    balance = c.select(F.lit("balance").alias("pass"), F.floor(F.col("c_acctbal") / 10).cast("string").alias("key"), F.col("c_custkey").alias("id"))
    return segment.unionByName(balance)


BLOCKS = """b AS (SELECT 'segment' AS pass, c_nationkey || '|' || c_mktsegment AS key, c_custkey AS id FROM customer UNION ALL SELECT 'balance', CAST(CAST(floor(c_acctbal / 10) AS BIGINT) AS VARCHAR), c_custkey FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY pass, key ORDER BY id) AS rn FROM b QUALIFY rn <= 800), pr AS (SELECT DISTINCT x.id AS a, y.id AS b FROM r x JOIN r y ON x.pass = y.pass AND x.key = y.key AND x.rn < y.rn)"""


@query(f"WITH {BLOCKS} SELECT a, b FROM pr")
def blocking_union(spark, sf_dir):
    return blocking.pairs_within(_blocks(spark, sf_dir), ["pass", "key"], "id")


@query(f"WITH {BLOCKS}, g AS (SELECT pass, key, count(*) AS n FROM b GROUP BY ALL) SELECT pass, count(*) AS n_keys, count(*) FILTER (n >= 2) AS n_groups FROM g GROUP BY 1")
def block_sizes(spark, sf_dir):
    return blocking.block_sizes(_blocks(spark, sf_dir), ["pass", "key"], ["pass"])


@query(f"WITH {BLOCKS}, f AS (SELECT count(*) AS found FROM pr JOIN customer x ON x.c_custkey = a JOIN customer y ON y.c_custkey = b WHERE x.c_nationkey = y.c_nationkey), t AS (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) AS total FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey)) SELECT found, total, round(found / total, 9) AS recall FROM f, t")
def blocking_recall(spark, sf_dir):
    labels = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("profile_id"), F.col("c_nationkey").alias("entity_id"))
    out = blocking.blocking_recall(blocking_union(spark, sf_dir), labels)
    return out.withColumn("recall", F.round("recall", 9))


@query("""WITH p AS (SELECT x.s_suppkey AS a, y.s_suppkey AS b, lower(x.s_name) AS n, lower(y.s_name) AS m FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier QUALIFY rn <= 800) x JOIN (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier QUALIFY rn <= 800) y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey),
    g AS (SELECT *, list_distinct(list_transform(range(1, length(n)), lambda i: n[i:i + 1])) AS gn, list_distinct(list_transform(range(1, length(m)), lambda i: m[i:i + 1])) AS gm FROM p)
    SELECT a, b, round(levenshtein(n, m) / greatest(length(n), length(m)), 9) AS lev, round(len(list_intersect(gn, gm)) / (len(gn) + len(gm) - len(list_intersect(gn, gm))), 9) AS jac FROM g""")
def name_similarity(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    pairs = blocking.pairs_within(s.select(F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("id")), ["key"], "id")
    of = lambda e, n: s.select(F.col("s_suppkey").alias(e), F.lower("s_name").alias(n))
    j = pairs.join(of("a", "n"), "a").join(of("b", "m"), "b")
    return j.select("a", "b", F.round(X.levenshtein_distance(F.col("n"), F.col("m")), 9).alias("lev"), F.round(X.char_jaccard(F.col("n"), F.col("m")), 9).alias("jac"))


def _event_pairs(spark, sf_dir):
    e = events(spark, sf_dir)
    sets = e.groupBy("profile_id").agg(profiles.value_set("k").alias("ks"), F.count("*").alias("n_events"))
    pairs = blocking.pairs_within(e.select(F.col("k").alias("key"), F.col("profile_id").alias("id")).where("key is not null"), ["key"], "id")
    of = lambda x: sets.select(F.col("profile_id").alias(x), F.col("ks").alias(f"k{x}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", X.jaccard(F.col("ka"), F.col("kb")).alias("jaccard"), X.overlap(F.col("ka"), F.col("kb")).alias("overlap"))


EVP = f"""{EV}, d AS (SELECT DISTINCT k, profile_id AS id FROM ev WHERE k IS NOT NULL), er AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY id) AS rn FROM d QUALIFY rn <= 800),
ep AS (SELECT DISTINCT x.id AS a, y.id AS b FROM er x JOIN er y ON x.k = y.k AND x.rn < y.rn), es AS (SELECT id, list(k) AS ks FROM d GROUP BY 1),
ej AS (SELECT a, b, len(list_intersect(x.ks, y.ks)) AS overlap, len(x.ks) + len(y.ks) AS n FROM ep JOIN es x ON x.id = a JOIN es y ON y.id = b),
ef AS (SELECT a, b, overlap / (n - overlap) AS jaccard, overlap FROM ej)"""


@query(f"WITH {EVP} SELECT a, b, round(jaccard, 9) AS jaccard, overlap FROM ef")
def set_similarity(spark, sf_dir):
    return _event_pairs(spark, sf_dir).withColumn("jaccard", F.round("jaccard", 9))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the raw layout, for the whole runs; an entity is two users."""
    e = events(spark, sf_dir)
    k, u = F.coalesce("k", F.lit(0)), F.col("profile_id")
    text = lambda s, c: F.concat(F.lit(s), c.cast("string"))
    person = F.floor(u / 2)
    letter = lambda s, c: F.concat(F.lit(s), F.char(c + 97))
    return e.select(
        "created_at", letter("Name", person % 26).alias("first_name"), letter("Last", person % 7).alias("last_name"), F.concat(F.lit("u"), person.cast("string"), F.lit("@mail.org")).alias("email"),
        (F.lit(9160000000) + person).cast("string").alias("phone"), F.lit("1990-01-02").alias("birthday"), F.when(person % 2 == 0, "male").otherwise("female").alias("sex"),
        F.array(text("geoname_id:", person % 11), text("device:d", k % 3), text("osfamily:o", k % 2)).alias("non_processing_features"),
        F.to_json(F.struct((person % 5).cast("int").alias("tz_offset"), F.weekday("created_at").alias("day"), F.lit("XX").alias("country"))).alias("realtime_features"),
        F.array(text("has_order_365:", k), text("visited_365:", (person * 31 + k % 5)), F.lit("is_gmail")).alias("fs_features"), u.cast("string").alias("profile_id"), person.cast("string").alias("entity_id"),
    )


RAW = """rw AS (SELECT DISTINCT user_id AS u, user_id // 2 AS person, ts, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events),
pp AS (SELECT CAST(u AS VARCHAR) AS profile_id, 'name' || chr(CAST(97 + any_value(person) % 26 AS INT)) AS first_name_clean, 'last' || chr(CAST(97 + any_value(person) % 7 AS INT)) AS last_name_clean,
    CASE WHEN any_value(person) % 2 = 0 THEN 'male' ELSE 'female' END AS sex, CAST(any_value(person) % 11 AS VARCHAR) AS geoname_id, 'XX' AS country, CAST(any_value(person) % 5 AS INT) AS tz_offset,
    'u' || any_value(person) || '@mail.org' AS emails, 'mail.org' AS domains, '7' || (9160000000 + any_value(person)) AS phones, list_sort(list(DISTINCT 'd' || k % 3)) AS device, list_sort(list(DISTINCT 'o' || k % 2)) AS osfamily,
    count(*) AS n_events, min(ts) AS first_event_time, max(ts) AS last_event_time, list_sort(list(DISTINCT isodow(ts) - 1)) AS days FROM rw GROUP BY u),
si AS (SELECT DISTINCT CAST(u AS VARCHAR) AS profile_id, category, site_id FROM (SELECT u, 'has_order_365' AS category, k AS site_id FROM rw UNION ALL SELECT u, 'visited_365', person * 31 + k % 5 FROM rw))"""
PASSES = f"""{RAW}, dv AS (SELECT *, array_to_string(device, ', ') AS dev, array_to_string(osfamily, ', ') AS os FROM pp),
bk AS (SELECT 'geo_device' AS pass, concat_ws('|', geoname_id, os, dev) AS key, profile_id AS id FROM dv UNION ALL SELECT 'name_geo', concat_ws('|', first_name_clean, last_name_clean, geoname_id), profile_id FROM dv
    UNION ALL SELECT 'sex_geo', concat_ws('|', sex, geoname_id), profile_id FROM dv UNION ALL SELECT 'tz_geo', concat_ws('|', CAST(tz_offset AS VARCHAR), geoname_id), profile_id FROM dv
    UNION ALL SELECT 'device_tz_geo', concat_ws('|', dev, CAST(tz_offset AS VARCHAR), geoname_id), profile_id FROM dv UNION ALL SELECT DISTINCT 'site', CAST(site_id AS VARCHAR), profile_id FROM si)"""


@query(f"""WITH {RAW} SELECT * EXCLUDE (device, osfamily, days), array_to_string(device, ', ') AS device, array_to_string(osfamily, ', ') AS osfamily, array_to_string(days, ', ') AS days,
    '7916' AS prefixes, '1990-01-02' AS birthday_clean, true AS is_gmail, CAST(NULL AS BOOLEAN) AS is_man, 1 AS n_emails, len(device)::INT AS n_devices FROM pp""")
def passports(spark, sf_dir):
    """The passports of all profiles, from raw events on."""
    made = profiles.passports(profiles.preprocess(files.drop_labels(raw_events(spark, sf_dir))))
    joined = {"emails": "email_normalized", "domains": "email_domain", "phones": "phone_normalized", "prefixes": "phone_prefix", "device": "device", "osfamily": "osfamily", "days": "active_days"}
    plain = ("profile_id", "first_name_clean", "last_name_clean", "sex", "geoname_id", "country", "tz_offset", "birthday_clean", "is_gmail", "is_man", "n_events", "n_emails", "n_devices", "first_event_time", "last_event_time")
    return made.select(*plain, *[F.array_join(F.col(c).cast("array<string>"), ", ").alias(n) for n, c in joined.items()])


@query(f"WITH {PASSES} SELECT pass, key, id FROM bk")
def block_passes(spark, sf_dir):
    """The keys of all six passes."""
    data = linkage.link_profiles(files.drop_labels(raw_events(spark, sf_dir)), Scratch(configure(spark)))
    return blocking.block_keys(data.profiles, data.sites)


def _jaccard_sql(x: str, y: str, empty: float = 1.0) -> str:
    return f"(CASE WHEN len({x}) + len({y}) = 0 THEN {empty} ELSE len(list_intersect({x}, {y})) / (len({x}) + len({y}) - len(list_intersect({x}, {y}))) END)"


def _pair_features_sql() -> str:
    grams = lambda t: f"list_distinct(list_transform(range(1, length({t})), lambda i: substr({t}, i, 2)))"
    both = {n: f"x.{c}, y.{c}".split(", ") for n, c in (("device", "device"), ("osfamily", "osfamily"), ("day", "days"), ("sites", "al"), ("has_order_365", "ord"), ("visited_365", "vis"))}
    cols = {
        "fname_lev": "levenshtein(x.first_name_clean, y.first_name_clean) / greatest(length(x.first_name_clean), length(y.first_name_clean))",
        "fname_jaccard": _jaccard_sql(grams("x.first_name_clean"), grams("y.first_name_clean")), "full_name_jaccard": _jaccard_sql(grams("x.fn"), grams("y.fn")),
        "phone_prefix_jaccard": "1", "phone_prefix_overlap": "1", "geo_match": "(x.geoname_id = y.geoname_id)::INT", "tz_diff": "abs(x.tz_offset - y.tz_offset)",
        "device_jaccard": _jaccard_sql(*both["device"]), "osfamily_jaccard": _jaccard_sql(*both["osfamily"]),
        "last_event_diff_days": "abs(epoch_us(x.last_event_time) - epoch_us(y.last_event_time)) / 8.64e10", "day_overlap_ratio": _jaccard_sql(*both["day"], 0.0),
        **{f"both_{f}": "1" if f == "is_gmail" else "0" for f in features.BOTH}, "country_conflict": "(x.country <> y.country)::INT", "tz_far_apart": "(abs(x.tz_offset - y.tz_offset) > 4)::INT",
        "device_os_conflict": "(len(x.device) > 0 AND len(y.device) > 0 AND x.osfamily <> y.osfamily)::INT",
    }
    for n in ("sites", *features.CATEGORIES):
        # Categories without events have empty sets.
        cols |= {f"{n}_jaccard": _jaccard_sql(*both[n]), f"{n}_overlap": f"len(list_intersect({both[n][0]}, {both[n][1]}))"} if n in both else {f"{n}_jaccard": "1", f"{n}_overlap": "0"}
    # The time difference is one division of whole numbers: equal without rounding, whose ties differ.
    shown = ", ".join(f"round(CAST({cols[n]} AS DOUBLE), 9) AS {n}" if n != "last_event_diff_days" else f"{cols[n]} AS {n}" for n in features.NAMES)
    return f"""WITH {PASSES}, cp AS (SELECT *, row_number() OVER (PARTITION BY pass, key ORDER BY id) AS rn FROM (SELECT DISTINCT * FROM bk) QUALIFY rn <= 800),
    cand AS (SELECT DISTINCT p.id AS a, q.id AS b FROM cp p JOIN cp q ON p.pass = q.pass AND p.key = q.key AND p.rn < q.rn),
    st AS (SELECT profile_id, list(DISTINCT site_id) AS al, coalesce(list(DISTINCT site_id) FILTER (category = 'has_order_365'), []) AS ord, coalesce(list(DISTINCT site_id) FILTER (category = 'visited_365'), []) AS vis FROM si GROUP BY 1),
    full_ AS (SELECT pp.*, first_name_clean || ' ' || last_name_clean AS fn, al, ord, vis FROM pp JOIN st USING (profile_id))
    SELECT a, b, {shown} FROM cand JOIN full_ x ON x.profile_id = a JOIN full_ y ON y.profile_id = b"""


@query(_pair_features_sql())
def pair_features(spark, sf_dir):
    """The 31 features of all candidate pairs of the six passes."""
    scratch = Scratch(configure(spark))
    data = linkage.link_profiles(files.drop_labels(raw_events(spark, sf_dir)), scratch)
    built = features.build_features(blocking.candidate_pairs(data.profiles, data.sites), data.profiles, data.sites, scratch)
    return built.select("a", "b", *[F.round(n, 9).alias(n) if n != "last_event_diff_days" else n for n in features.NAMES])


@query("""WITH e AS (SELECT c_custkey AS entity_id, c_mktsegment AS entity_type, md5('42|' || c_custkey) AS h FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY h, entity_id) AS rn, count(*) OVER (PARTITION BY entity_type) AS n FROM e)
    SELECT entity_id, entity_type, CASE WHEN rn * 5 <= n THEN 'test' WHEN rn * 5 <= 2 * n THEN 'val' ELSE 'train' END AS split FROM r""")
def entity_split(spark, sf_dir):
    return sampling.entity_split(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("entity_type")))


@query("""WITH l AS (SELECT l_orderkey AS a, l_linenumber AS b, CASE WHEN l_quantity >= 48 THEN 1 ELSE 0 END AS label FROM lineitem), r AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || a || '|' || b), a, b) AS rn FROM l WHERE label = 0)
    SELECT a, b, label FROM l WHERE label = 1 UNION ALL SELECT a, b, label FROM r WHERE rn <= 8 * (SELECT count(*) FROM l WHERE label = 1)""")
def negative_sample(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), (F.col("l_quantity") >= 48).cast("int").alias("label"))
    return sampling.balance(rows)


@query("""WITH n AS (SELECT count(*) FILTER (q = 0 AND p = 0) AS a, count(*) FILTER (q = 0 AND p = 1) AS b, count(*) FILTER (q = 1 AND p = 0) AS c, count(*) FILTER (q = 1 AND p = 1) AS d
    FROM (SELECT quality AS q, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id)))
    SELECT round(a / (a + c), 9) AS precision_0, round(a / (a + b), 9) AS recall_0, a + b AS support_0, round(d / (b + d), 9) AS precision_1, round(d / (c + d), 9) AS recall_1, c + d AS support_1, round((a + d) / (a + b + c + d), 9) AS accuracy FROM n""")
def pair_metrics(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    out = metrics.classification_report(rows.select(F.col("quality").alias("label"), (F.col("n_chars") > 500).cast("int").alias("predicted")))
    return out.select(*[F.round(c, 9).alias(c) if not c.startswith("support") else c for c in ("precision_0", "recall_0", "support_0", "precision_1", "recall_1", "support_1", "accuracy")])


@query("""WITH n AS (SELECT count(*) FILTER (q = 0 AND p = 0) AS a, count(*) FILTER (q = 0 AND p = 1) AS b, count(*) FILTER (q = 1 AND p = 0) AS c, count(*) FILTER (q = 1 AND p = 1) AS d
    FROM (SELECT toxic AS q, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id))),
    r AS (SELECT a + b AS s0, c + d AS s1, a / (a + c) AS p0, a / (a + b) AS r0, d / (b + d) AS p1, d / (c + d) AS r1 FROM n), f AS (SELECT *, CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0 END AS f0, CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0 END AS f1 FROM r)
    SELECT round(f0, 9) AS f1_0, round(f1, 9) AS f1_1, round((p0 + p1) / 2, 9) AS macro_precision, round((r0 + r1) / 2, 9) AS macro_recall, round((f0 + f1) / 2, 9) AS macro_f1,
    round((p0 * s0 + p1 * s1) / (s0 + s1), 9) AS weighted_precision, round((r0 * s0 + r1 * s1) / (s0 + s1), 9) AS weighted_recall, round((f0 * s0 + f1 * s1) / (s0 + s1), 9) AS weighted_f1 FROM f""")
def full_report(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    out = metrics.classification_report(rows.select(F.col("toxic").alias("label"), (F.col("n_chars") > 500).cast("int").alias("predicted")))
    means = [f"{m}_{k}" for m in ("macro", "weighted") for k in ("precision", "recall", "f1")]
    return out.select(*[F.round(c, 9).alias(c) for c in ("f1_0", "f1_1", *means)])


@query("SELECT split, count(*) AS n FROM (WITH e AS (SELECT c_custkey AS entity_id, c_mktsegment AS entity_type, md5('42|' || c_custkey) AS h FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY h, entity_id) AS rn, count(*) OVER (PARTITION BY entity_type) AS n FROM e) SELECT CASE WHEN rn * 5 <= n THEN 'test' WHEN rn * 5 <= 2 * n THEN 'val' ELSE 'train' END AS split FROM r) GROUP BY 1")
def split_sizes(spark, sf_dir):
    return metrics.split_counts(entity_split(spark, sf_dir))


@query("SELECT size, count(*) AS n FROM (SELECT count(*) AS size FROM orders GROUP BY o_custkey) GROUP BY 1 ORDER BY 1")
def size_histogram(spark, sf_dir):
    return metrics.size_histogram(read(spark, sf_dir, "orders"), "o_custkey")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT s_suppkey AS a, s_suppkey + 7 AS b FROM supplier), u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
    r AS (SELECT x AS node, x AS c FROM u UNION SELECT u.y, r.c FROM r JOIN u ON u.x = r.node) SELECT node, min(c) AS component FROM r GROUP BY 1""")
def components(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 7).alias("b"))
    return connected_components(s, Scratch(spark))


@query()
def complete_linkage(spark, sf_dir):
    return clustering.cluster(_event_pairs(spark, sf_dir).withColumnRenamed("jaccard", "p"), 0.4)


def _fixed(spark, sf_dir):
    """Clusters that SQL can name: customers by nation and tens of their balance."""
    c = read(spark, sf_dir, "customer")
    named = c.select(F.col("c_custkey").alias("profile_id"), F.concat_ws("|", F.col("c_nationkey").cast("string"), F.floor(F.col("c_acctbal") / 50).cast("string")).alias("g"))
    return named.join(named.groupBy("g").agg(F.min("profile_id").alias("cluster_id"), F.count("*").alias("n")).where("n > 1"), "g").select("cluster_id", "profile_id")


FIXED = "nm AS (SELECT c_custkey AS profile_id, c_nationkey || '|' || CAST(floor(c_acctbal / 50) AS BIGINT) AS g FROM customer), cl AS (SELECT min(profile_id) OVER (PARTITION BY g) AS cluster_id, profile_id FROM nm QUALIFY count(*) OVER (PARTITION BY g) > 1)"
SCORED = f"{BLOCKS}, {FIXED}, sc AS (SELECT a, b, CASE WHEN (a + b) % 3 = 0 THEN 0.5 ELSE 1.0 END AS p FROM pr)"


def _scored(spark, sf_dir):
    return blocking_union(spark, sf_dir).withColumn("p", F.when((F.col("a") + F.col("b")) % 3 == 0, 0.5).otherwise(1.0))


CONFIDENT = f"""WITH {SCORED}, sz AS (SELECT cluster_id, count(*) AS size FROM cl GROUP BY 1), m AS (SELECT x.cluster_id, sum(p) AS s, min(p) AS m, count(*) AS k FROM sc JOIN cl x ON x.profile_id = a JOIN cl y ON y.profile_id = b WHERE x.cluster_id = y.cluster_id GROUP BY 1),
    st AS (SELECT cluster_id, size, coalesce(s / (size * (size - 1) / 2), 0) AS avg_prob, CASE WHEN k = size * (size - 1) / 2 THEN m ELSE 0 END AS min_prob FROM sz LEFT JOIN m USING (cluster_id))"""


@query(f"{CONFIDENT} SELECT cluster_id, size, round(avg_prob, 9) AS avg_prob, CAST(coalesce(min_prob, 0) AS DOUBLE) AS min_prob, avg_prob >= 0.99 AS confident FROM st")
def confidence(spark, sf_dir):
    out = clustering.confidence(_fixed(spark, sf_dir), _scored(spark, sf_dir))
    return out.withColumn("avg_prob", F.round("avg_prob", 9))


@query(f"""{CONFIDENT} SELECT 'auto' AS part, profile_id, 'entity_' || cluster_id AS id, size FROM cl JOIN st USING (cluster_id) WHERE avg_prob >= 0.99 UNION ALL
    SELECT 'auto', c_custkey, 'entity_' || c_custkey, 1 FROM customer WHERE c_custkey NOT IN (SELECT profile_id FROM cl JOIN st USING (cluster_id) WHERE avg_prob >= 0.99) UNION ALL
    SELECT 'review', profile_id, 'review_' || cluster_id, size FROM cl JOIN st USING (cluster_id) WHERE avg_prob < 0.99""")
def auto_and_review(spark, sf_dir):
    c = _fixed(spark, sf_dir)
    empty = {n: F.array().cast("array<string>").alias(n) for n in ("email_domain", "phone_prefix", "device", "osfamily")}
    people = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("profile_id"), F.col("c_name").alias("first_name_clean"), F.lit(None).cast("string").alias("last_name_clean"), F.col("c_nationkey").alias("geoname_id"), F.lit("").alias("country"), *empty.values())
    auto, review = clustering.outputs(c, clustering.confidence(c, _scored(spark, sf_dir)), people)
    return auto.select(F.lit("auto").alias("part"), "profile_id", F.col("predicted_entity_id").alias("id"), "size").unionByName(review.select(F.lit("review").alias("part"), "profile_id", F.col("cluster_id").alias("id"), "size"))


EVALUATED = f"""WITH {SCORED}, lb AS (SELECT c_custkey AS profile_id, c_nationkey || '|' || CAST(floor(c_acctbal / 70) AS BIGINT) AS e FROM customer), bl AS (SELECT a AS id FROM pr UNION SELECT b FROM pr),
    kn AS (SELECT cl.*, e FROM cl JOIN lb USING (profile_id) WHERE profile_id IN (SELECT id FROM bl)), sz AS (SELECT cluster_id, count(*) AS size FROM cl GROUP BY 1),
    h AS (SELECT e, cluster_id, count(*) AS n FROM kn GROUP BY ALL), g AS (SELECT e, CAST(sum(n) AS BIGINT) AS true_size, count(*) AS n_clusters, max(size) AS largest FROM h JOIN sz USING (cluster_id) GROUP BY 1 HAVING sum(n) >= 2),
    ce AS (SELECT e AS entity_id, true_size, n_clusters, CASE WHEN n_clusters > 1 THEN 'split' WHEN largest = true_size THEN 'perfect' ELSE 'merged' END AS status, largest > true_size AS with_others FROM g)"""


@query(f"{EVALUATED} SELECT * FROM ce")
def cluster_eval(spark, sf_dir):
    return clustering.evaluate(_fixed(spark, sf_dir), _entities(spark, sf_dir), _scored(spark, sf_dir))


def _entities(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("profile_id"), F.concat_ws("|", F.col("c_nationkey").cast("string"), F.floor(F.col("c_acctbal") / 70).cast("string")).alias("entity_id"))


@query(f"""{EVALUATED}, pb AS (SELECT count(*) AS passed_blocking FROM (SELECT e FROM lb WHERE profile_id IN (SELECT id FROM bl) GROUP BY e HAVING count(*) >= 2)), nc AS (SELECT count(DISTINCT cluster_id) AS clusters FROM cl)
    SELECT count(*) AS evaluated, count(*) FILTER (status = 'perfect') AS perfect, count(*) FILTER (status = 'merged') AS merged, count(*) FILTER (status = 'split') AS split, count(*) FILTER (with_others) AS merged_with_others,
    (SELECT passed_blocking FROM pb) AS passed_blocking, (SELECT clusters FROM nc) AS clusters, (SELECT passed_blocking FROM pb) - count(*) AS lost, count(*) - count(*) FILTER (status = 'perfect') AS partially_recovered, 0 AS fully_broken,
    coalesce(round(count(*) FILTER (status = 'perfect') / nullif(count(*), 0), 9), 0) AS recovery_multi FROM ce""")
def cluster_recovery(spark, sf_dir):
    """The metrics of a whole evaluation."""
    labels = _entities(spark, sf_dir)
    out = clustering.recovery(cluster_eval(spark, sf_dir), _fixed(spark, sf_dir), labels, _scored(spark, sf_dir))
    return out.withColumn("recovery_multi", F.round("recovery_multi", 9))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000) UNION ALL SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def union_semi_anti(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer").select("c_custkey"), read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return c.join(o.where("o_totalprice > 100000"), "c_custkey", "left_semi").unionByName(c.join(o, "c_custkey", "left_anti"))


@query("""SELECT 'text' AS "column", 0.0 AS percent UNION ALL SELECT 'long', round(100.0 * count(*) FILTER (n_chars <= 500) / count(*), 2) FROM documents UNION ALL SELECT 'doc_id', 0.0""")
def eda_missing(spark, sf_dir):
    return eda.missing(read(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("n_chars") > 500, F.col("n_chars")).alias("long")))


@query("SELECT CAST(isodow(ts) - 1 AS INT) AS weekday, count(*) AS n FROM events GROUP BY 1")
def eda_weekday(spark, sf_dir):
    return eda.weekdays(read(spark, sf_dir, "events"), "ts")


@query("""WITH r AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) SELECT CAST(least(floor((c_acctbal - lo) * 30 / (hi - lo)), 29) AS INT) AS bin, count(*) AS n FROM customer, r GROUP BY 1""")
def eda_histogram(spark, sf_dir):
    return eda.histogram(read(spark, sf_dir, "customer"), "c_acctbal").select("bin", "n")


@query("""WITH r AS (SELECT min(p_size) AS lo, max(p_size) AS hi, count(*) AS n, stddev_samp(p_size) * pow(count(*), -0.2) AS h FROM part), g AS (SELECT lo + i * (hi - lo) / 49 AS x, n, h FROM r, (SELECT unnest(range(50)) AS i))
    SELECT round(x, 6) AS x, round(sum(exp(-pow((x - p_size) / h, 2) / 2)) / (any_value(n) * any_value(h) * 2.5066282746310002), 9) AS density FROM part, g GROUP BY g.x""")
def eda_density(spark, sf_dir):
    return eda.density(read(spark, sf_dir, "part"), "p_size").select(F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


@query("SELECT event_type AS type, count(*) AS n FROM events GROUP BY 1")
def eda_frequency(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.array(F.concat(F.lit("type: "), "event_type")).alias("f"))
    return eda.feature_values(e, "f", "type")


@query("SELECT year(DATE '2026-01-01') - year(o_orderdate) AS age, count(*) AS n FROM orders GROUP BY 1")
def eda_age(spark, sf_dir):
    return eda.frequency(read(spark, sf_dir, "orders"), X.age(F.col("o_orderdate"), F.lit("2026-01-01").cast("date")).cast("bigint"), "age")


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS json FROM nation""")
def json_records(spark, sf_dir):
    return files.to_json_records(read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query("SELECT * FROM nation ORDER BY n_nationkey LIMIT 5")
def preview_rows(spark, sf_dir):
    return read(spark, sf_dir, "nation").orderBy("n_nationkey").limit(5)


@query()
def train_and_predict(spark, sf_dir):
    raw = raw_events(spark, sf_dir)
    config = files.Config()
    model, _ = linkage.train(raw, config)
    auto, _ = linkage.predict(raw, model, config)
    return auto


@query(f"WITH {EVP} SELECT a, b, round(jaccard, 9) AS jaccard, overlap FROM ef WHERE jaccard >= 0.1")
def flagship(spark, sf_dir):
    """Users with similar event properties: parse, aggregate, block, join, compare."""
    return _event_pairs(spark, sf_dir).where("jaccard >= 0.1").withColumn("jaccard", F.round("jaccard", 9))
