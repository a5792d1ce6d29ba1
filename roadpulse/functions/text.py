"""String, time, hash and binary expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tag rules of scene descriptions.
TAG_RULES = {
    "night": r"\bnight\b",
    "rain": r"(?<!after\s)\brain(ing|y)?\b",
    "after_rain": r"\bafter\s+rain\b",
    "peds": r"\bped(s|estrian)?\b|\bjaywalker\b",
    "cyclist": r"\bbicycl|\bbike\b|\bcyclist\b",
    "construction": r"\bconstruction\b",
    "intersection": r"\bintersection\b|\bcrosswalk\b",
    "turn": r"\bturn\b",
    "parked": r"\bparked\b|\bparking\s+lot\b",
    "bus": r"\bbus\b",
    "truck": r"\btruck\b",
    "hard_light": r"difficult lighting|glare",
}


def tags(description: Column) -> Column:
    """Sorted tags of a description; without night, day is inferred."""
    found = [F.when(description.rlike("(?i)" + rule), F.lit(tag)) for tag, rule in TAG_RULES.items()]
    day = F.when(~description.rlike("(?i)" + TAG_RULES["night"]), F.lit("day_inferred"))
    return F.array_sort(F.array_compact(F.array(*found, day)))


def short_category(category: Column) -> Column:
    return F.substring_index(category, ".", -1)


def second_category(category: Column) -> Column:
    return F.coalesce(F.get(F.split(category, r"\."), F.lit(1)), category)


#: How place names are shortened for display.
SHORT_PLACES = {"singapore-": "sg-", "boston-": "bos-"}


def location_label(location: Column) -> Column:
    for long, short in SHORT_PLACES.items():
        location = F.replace(location, F.lit(long), F.lit(short))
    return location


def metres_per_second(kmh: Column) -> Column:
    return kmh / 3.6


def utc_text(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def millis_between(a: Column, b: Column) -> Column:
    """Millisecond boundaries between two times."""
    return F.unix_millis(b) - F.unix_millis(a)


def retry_backoff_s(attempts: Column) -> Column:
    return F.least(F.lit(300), F.call_function("shiftleft", F.lit(2), F.least(attempts, F.lit(7)).cast("int")))


def edge_backoff_s(attempts: Column, jitter: Column) -> Column:
    return F.least(F.lit(60.0), F.pow(F.lit(2.0), F.least(attempts - 1, F.lit(6)))) * (1 + jitter)


def part_count(size: Column, part: Column) -> Column:
    return F.lit(1) + F.floor((size - 1) / part)


def event_id(vehicle: Column, kind: Column, boot: Column, seq: Column) -> Column:
    return F.concat_ws(":", vehicle, kind, boot, seq)


def frame_digest(body: Column, magic: bytes = b"") -> Column:
    """Hex SHA-256 of a batch body; version 2 puts its magic in front."""
    return F.sha2(F.concat(F.lit(magic), body), 256)


def uuid5(namespace: Column, name: Column) -> Column:
    """Version-5 UUID, in hex text, of a namespace UUID text and a name."""
    h = F.sha1(F.concat(F.unhex(F.replace(namespace, F.lit("-"))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def object_key(prefix: str, vehicle: Column, start: Column, identifier: Column) -> Column:
    """Storage key of a recording; null for identifiers with other characters than letters, digits, _ and -."""
    fine = vehicle.rlike("^[a-zA-Z0-9_-]{1,80}$") & identifier.rlike("^[a-zA-Z0-9_-]{1,80}$")
    return F.when(fine, F.concat(F.lit(f"{prefix}/vehicle_id="), vehicle, F.lit("/date="), F.date_format(start, "yyyy-MM-dd"), F.lit("/"), identifier, F.lit(".mcap")))


def spiffe_vehicle(uris: Column) -> Column:
    """The vehicle of the one SPIFFE identity among URIs; null for none or several."""
    mine = F.filter(uris, lambda u: u.rlike("^spiffe://[^/]+/vehicle/[a-zA-Z0-9_-]+$"))
    return F.when(F.size(mine) == 1, F.regexp_extract(F.element_at(mine, 1), "/vehicle/([a-zA-Z0-9_-]+)$", 1))


# Encoding and topic prefix by file suffix.
RAW_KINDS = {".jpg": ("jpeg", "/camera"), ".jpeg": ("jpeg", "/camera"), ".png": ("png", "/camera"), ".bin": ("application/octet-stream", "/lidar"), ".pcd": ("application/octet-stream", "/radar")}
RAW_PREFIXES = {"RADAR": "/radar", "CAM": "/camera", "LIDAR": "/lidar"}


def raw_topic(channel: Column, suffix: Column) -> Column:
    """Struct of topic and encoding of a raw recording: the channel's name rules, then the suffix."""
    encoding, by_suffix = F.lit("application/octet-stream"), F.lit("/raw")
    for end, (kind, place) in RAW_KINDS.items():
        encoding = F.when(suffix == end, kind).otherwise(encoding)
        by_suffix = F.when(suffix == end, place).otherwise(by_suffix)
    prefix = by_suffix
    for start, place in RAW_PREFIXES.items():
        prefix = F.when(channel.startswith(start), place).otherwise(prefix)
    return F.struct(F.concat(prefix, F.lit("/"), channel).alias("topic"), encoding.alias("encoding"))
