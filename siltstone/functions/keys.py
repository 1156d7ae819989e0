"""Reading keys and concept lists as different tools spell them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at either end, in Unicode's sense (tabs and no-break spaces too).
_ENDS = r"(?U)^\s+|\s+$"
_LIST = "array<variant>"


def trim_all(c: Column) -> Column:
    """``c`` without white space of any kind at its ends."""
    return F.regexp_replace(c, _ENDS, "")


def norm_key(c: Column) -> Column:
    """A key as it is compared: trimmed, lower-cased; a blank key is null."""
    return F.nullif(F.lower(trim_all(c)), F.lit(""))


def _clean(items: Column) -> Column:
    return F.filter(F.transform(items, lambda x: F.lower(trim_all(x))), lambda x: x.isNotNull() & (x != ""))


def concept_list(c: Column) -> Column:
    """Concepts of a list text: the strings of a JSON array, else the pieces between commas.

    Pieces lose brackets and quotes; all are trimmed and lower-cased, empty ones dropped,
    order and repetitions kept.  Null gives an empty list.
    """
    parsed = F.try_parse_json(c)
    is_list = F.schema_of_variant(parsed).startswith("ARRAY")
    elements = F.try_variant_get(parsed, "$", _LIST)
    strings = F.transform(
        F.filter(elements, lambda v: F.schema_of_variant(v) == "STRING"),
        lambda v: F.try_variant_get(v, "$", "string"),
    )
    pieces = F.split(F.regexp_replace(c, "[\\[\\]\"']", ""), ",")
    return F.coalesce(F.when(parsed.isNotNull() & is_list, _clean(strings)).otherwise(_clean(pieces)), F.array().cast("array<string>"))


def concept_array(c: Column) -> Column:
    """Concepts of an array column, cleaned as :func:`concept_list` does."""
    return F.coalesce(_clean(c), F.array().cast("array<string>"))


def string_map(c: Column) -> Column:
    """The string values of a JSON object as a map; other values are left out, a text that is no object gives an empty map."""
    parsed = F.try_parse_json(c)
    fields = F.try_variant_get(parsed, "$", "map<string,variant>")
    strings = F.map_filter(fields, lambda k, v: F.schema_of_variant(v) == "STRING")
    out = F.transform_values(strings, lambda k, v: F.try_variant_get(v, "$", "string"))
    return F.coalesce(out, F.create_map().cast("map<string,string>"))


def metadata_is(c: Column, **wanted: str) -> Column:
    """Whether a JSON object has these string values."""
    held = string_map(c)
    out = F.lit(True)
    for key, value in wanted.items():
        out = out & F.coalesce(F.try_element_at(held, F.lit(key)) == value, F.lit(False))
    return out
