"""Column functions: memory quantities, globs, times, state text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of the binary units in memory quantities.
UNITS = {"Ki": 1 << 10, "Mi": 1 << 20, "Gi": 1 << 30}


def parse_memory(col: Column, units: tuple[str, ...] = ("Mi", "Gi")) -> Column:
    """``6Gi`` or ``512Mi`` in bytes; -1 for anything else, null included."""
    number = F.regexp_extract(col, r"^([0-9]+)([A-Za-z]+)$", 1)
    unit = F.regexp_extract(col, r"^([0-9]+)([A-Za-z]+)$", 2)
    found = F.lit(None).cast("long")
    for name in units:
        found = F.when(unit == name, number.try_cast("long") * F.lit(UNITS[name]).cast("long")).otherwise(found)
    return F.coalesce(found, F.lit(-1).cast("long"))


def glob_to_regex(col: Column) -> Column:
    """A shell pattern (``*``, ``?``, ``[..]``, ``[!..]``) as an anchored regular expression.

    No pattern fails: a bracket without an end is a character like others, a range that runs
    backwards is empty, and a bracket of empty ranges matches nothing (negated: anything).
    """

    def literal(x: Column) -> Column:
        return F.regexp_replace(x, r"([^A-Za-z0-9\s])", r"\\$1")

    def member(x: Column) -> Column:
        low, high = F.substring(x, 1, 1), F.substring(x, 3, 1)
        return F.when(F.char_length(x) < 3, literal(x)).when(low <= high, F.concat(literal(low), F.lit("-"), literal(high))).otherwise("")

    def token(x: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(x, r"\A\[!?", ""), r"\]\z", "")
        members = F.array_join(F.transform(F.regexp_extract_all(body, F.lit(r"(?s)(.-.|.)"), F.lit(1)), member), "")
        negated = F.startswith(x, F.lit("[!"))
        inside = F.when(members == "", F.when(negated, ".").otherwise("(?!)")).otherwise(F.concat(F.when(negated, "[^").otherwise("["), members, F.lit("]")))
        return F.when(x == "*", ".*").when(x == "?", ".").when(F.char_length(x) > 1, inside).otherwise(literal(x))

    tokens = F.regexp_extract_all(col, F.lit(r"(?s)(\[!?+\]?+[^\]]*+\]|.)"), F.lit(1))
    return F.concat(F.lit("^(?s:"), F.array_join(F.transform(tokens, token), ""), F.lit(r")\z"))


def iso_utc(col: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ``; the session's time zone must be UTC."""
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def epoch_seconds(col: Column) -> Column:
    """Whole seconds since 1970."""
    return F.unix_timestamp(col.cast("timestamp"))


def utc_to_local(col: Column, zone: str) -> Column:
    """Wall-clock text of a UTC time in ``zone``, followed by the zone's offset at that time."""
    utc = col.cast("timestamp")
    local = F.from_utc_timestamp(utc, zone)
    minutes = ((F.unix_timestamp(local) - F.unix_timestamp(utc)) / 60).cast("int")
    size = F.abs(minutes)
    offset = F.format_string("%s%02d:%02d", F.when(minutes < 0, "-").otherwise("+"), F.floor(size / 60), size % 60)
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), offset)


def base64_state(*cols: Column) -> Column:
    """Columns as JSON, as base64 text."""
    return F.base64(F.to_json(F.struct(*cols)).cast("binary"))


def unbase64_state(col: Column, schema: str) -> Column:
    return F.from_json(F.unbase64(col).cast("string"), schema)


def task_id(name: Column, index: Column) -> Column:
    """``name#index``."""
    return F.concat(name, F.lit("#"), index.cast("string"))
