"""Scalar functions as column expressions: normalizers, conversions, set and string similarities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of true, and the formats of dates, tried in this order.
TRUE_WORDS = ("true", "1", "yes", "y", "t", "да")
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "MM.dd.yyyy", "dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy")


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (trim() knows spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize_email(c: Column) -> Column:
    """Trimmed, lower case, without spaces; null unless it has exactly one @."""
    s = F.replace(F.lower(strip(c)), F.lit(" "), F.lit(""))
    return F.when(F.length(s) - F.length(F.replace(s, F.lit("@"), F.lit(""))) == 1, s)


def email_domain(c: Column) -> Column:
    """What follows the raw address's first @, up to a second one, in lower case."""
    return F.lower(F.get(F.split(c, "@", -1), 1))


def normalize_phone(c: Column) -> Column:
    """11 digits that begin with 7, or null; ten digits get the 7, a leading 8 becomes one."""
    d = F.regexp_replace(c, "[^0-9]", "")
    local = F.when(F.length(d) == 11, F.when(F.substring(d, 1, 1).isin("7", "8"), F.concat(F.lit("7"), F.substring(d, 2, 10))))
    return F.when(F.length(d) == 10, F.concat(F.lit("7"), d)).otherwise(local)


def phone_prefix(c: Column) -> Column:
    return F.substring(normalize_phone(c), 1, 4)


def normalize_name(c: Column) -> Column:
    """Lower-case Latin and Cyrillic letters, hyphens and apostrophes; null if none are left."""
    return F.nullif(F.regexp_replace(F.lower(c), r"[^a-zа-яё\-']", ""), F.lit(""))


def normalize_date(c: Column) -> Column:
    """yyyy-MM-dd by the first format that fits, or null."""
    parsed = [F.try_to_timestamp(strip(c.cast("string")), F.lit(f)) for f in DATE_FORMATS]
    return F.date_format(F.coalesce(*parsed), "yyyy-MM-dd")


def normalize_bool(c: Column) -> Column:
    return F.coalesce(F.lower(F.btrim(c.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def to_id(c: Column) -> Column:
    """A whole number, cut towards zero; a bare flag is 1; text that is no finite number is null."""
    d = F.when(F.lower(c).isin("true"), F.lit(1.0)).otherwise(c.try_cast("double"))
    return F.when(~F.isnan(d) & (F.abs(d) < 9.2e18), d.cast("bigint"))


def clean_category(c: Column) -> Column:
    return F.nullif(F.lower(strip(c)), F.lit(""))


def set_to_string(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(c, lambda x: x.isNotNull() & (x != ""))), ", ")


def safe_set(c: Column) -> Column:
    """Distinct members that are neither null nor empty; null is the empty set."""
    return F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")))


def split_set(c: Column) -> Column:
    """The same for comma-separated text."""
    return safe_set(F.transform(F.split(c, ",", -1), strip))


def age(birthday: Column, today: Column) -> Column:
    """Difference of calendar years."""
    return F.year(today) - F.year(birthday)


def join_values(c: Column) -> Column:
    return F.coalesce(F.array_join(F.array_sort(c), ", "), F.lit(""))


def parse_loose_pair(c: Column) -> tuple[Column, Column]:
    """(key, value): split at the first ': ', else at the first ':', else the text is a flag."""
    wide, narrow = F.instr(c, ": "), F.instr(c, ":")
    at = F.when(wide > 0, wide).otherwise(narrow)
    key = F.when(at > 0, strip(F.substr(c, F.lit(1), at - 1))).otherwise(c)
    return key, F.when(at > 0, strip(F.substr(c, at + 1))).otherwise(F.lit("true"))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("bigint")


def jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    """|a & b| / |a | b| of sets without repeats; two empty sets give `empty`, null counts as empty."""
    a, b = (F.coalesce(x, F.slice(F.coalesce(a, b), 1, 0)) for x in (a, b))
    n, both = F.size(a) + F.size(b), F.size(F.array_intersect(a, b))
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(empty)).otherwise(both / (n - both))


def grams(c: Column, n: int = 2) -> Column:
    """The distinct n-character substrings of lower-cased text."""
    s = F.lower(F.coalesce(c, F.lit("")))
    starts = F.when(F.length(s) >= n, F.sequence(F.lit(1), F.length(s) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(s, i, F.lit(n))))


def char_jaccard(a: Column, b: Column, n: int = 2) -> Column:
    """Of gram sets: one-character texts have none, so any two of them give 1."""
    return jaccard(grams(a, n), grams(b, n))


def levenshtein_distance(a: Column, b: Column) -> Column:
    """Edits over the longer length: 0 for two empty texts, 1 if one is empty. Null is empty."""
    a, b = (F.coalesce(x, F.lit("")) for x in (a, b))
    return F.coalesce(F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b))), F.lit(0.0))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda x, y: x | y, conditions)
