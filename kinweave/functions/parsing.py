"""Parsing of event features into maps and structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The known keys of the realtime features; other keys are ignored.
REALTIME = "country string, is_million boolean, tz_offset int, geoname string, geoid bigint, local_hour int, day int, population bigint"


def key_values(c: Column) -> Column:
    """array<'key:value' or 'flag'> to map<string,string>: split at the first colon, flags are 'true', the last of
    repeated keys wins (mapKeyDedupPolicy LAST_WIN), null members are skipped, null is the empty map."""
    items = F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull())

    def entry(x: Column) -> Column:
        at = F.instr(x, ":")
        return F.struct(F.when(at > 0, F.substr(x, F.lit(1), at - 1)).otherwise(x), F.when(at > 0, F.substr(x, at + 1)).otherwise(F.lit("true")))

    return F.map_from_entries(F.transform(items, entry))


def realtime(c: Column) -> Column:
    """JSON object text to a struct; null and malformed text give a struct of nulls."""
    return F.coalesce(F.from_json(c, REALTIME), F.from_json(F.lit("{}"), REALTIME))


def json_map(c: Column) -> Column:
    """JSON object text to map<string,string>; null and malformed text give the empty map."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
