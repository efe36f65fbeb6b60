"""JSON with its types kept: a number is not a string, and what cannot be parsed is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def kind(value: Column, path: str = "$") -> Column:
    """STRING, BIGINT, ARRAY, OBJECT, ... of what lies at path; null if nothing does."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(value, path, "variant")), r"^([A-Z]+)", 1)


def text_at(value: Column, path: str) -> Column:
    """The string at path; null if it is missing or not a string."""
    return F.when(kind(value, path) == "STRING", F.try_variant_get(value, path, "string"))


def is_string(value: Column, path: str) -> Column:
    return F.coalesce(kind(value, path) == "STRING", F.lit(False))


def is_array(value: Column, path: str) -> Column:
    return F.coalesce(kind(value, path) == "ARRAY", F.lit(False))


def with_keys(value: Column | None, keys: dict[str, Column]) -> Column:
    """The object value, or an empty one, with keys set, as a map of variants."""
    new = F.create_map(*(x for k, v in keys.items() for x in (F.lit(k), v.cast("variant"))))
    if value is None:
        return new
    return F.map_concat(F.map_filter(F.try_variant_get(value, "$", "map<string,variant>"), lambda k, _: ~k.isin(*keys)), new)


def tolerant_object(text: Column) -> Column:
    """The JSON object in a model's answer, as a variant: code fences go; if the rest is no JSON, what stands between the
    first { and the last } is tried; anything but an object is null."""
    bare = strip(text)
    fenced = F.regexp_replace(F.regexp_replace(bare, r"^```(?:(?i)json)?\s*", ""), r"\s*```$", "")
    bare = F.when(bare.startswith("```"), fenced).otherwise(bare)
    first, last = F.instr(bare, "{"), F.length(bare) - F.instr(F.reverse(bare), "}") + 1
    inner = F.when((first > 0) & (last >= first) & F.contains(bare, F.lit("}")), F.substring(bare, first, last - first + 1))
    parsed = F.coalesce(F.try_parse_json(bare), F.try_parse_json(inner))
    return F.when(kind(parsed) == "OBJECT", parsed)
