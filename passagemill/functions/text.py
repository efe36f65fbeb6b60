"""Scalar functions on text. White space is Unicode's, all 29 characters of it, not only the blank."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
_HIGH = "".join(f"\\x{{{ord(c):x}}}" for c in WHITE if c > " ")
#: A class of these that asks three ranges of most characters, not 29 single ones.
_SPACE = f"[\\t-\\r\\x1c-\\x20[\\x{{85}}-\\x{{3000}}&&[{_HIGH}]]]+"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def text_key(text: Column) -> Column:
    """What stands for a text where texts are only compared: its md5 and xxhash64, 48 characters that are shuffled in its
    place. Null stays null and the empty text stays empty."""
    return F.when(text == "", text).otherwise(F.concat(F.md5(text), F.lpad(F.hex(F.xxhash64(text)), 16, "0")))


def key_md5(key: Column) -> Column:
    """The md5 of the text of a key."""
    return F.when(key == "", F.md5(key)).otherwise(F.left(key, F.lit(32)))


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def blank(text: Column) -> Column:
    """Null, empty or only white space."""
    return F.coalesce(strip(text) == "", F.lit(True))


def word_count(text: Column) -> Column:
    """One more than the gaps inside the text; gaps are fewer and quicker to find than words."""
    own = strip(text)
    return F.when(own == "", 0).otherwise(F.regexp_count(own, F.lit(_SPACE)) + 1)


def normalized(text: Column) -> Column:
    """Words joined by single blanks."""
    return strip(F.regexp_replace(text, _SPACE, " "))


def word_bounds(target: Column, tolerance: float) -> tuple[Column, Column]:
    """Least and most words for a target: the margin is a double product, rounded down; the least is 1 at least."""
    margin = F.floor(target.cast("double") * F.lit(float(tolerance)))
    return F.greatest(F.lit(1), target - margin).cast("long"), (target + margin).cast("long")


def length_fits(text: Column, target: Column, tolerance: float) -> Column:
    low, high = word_bounds(target, tolerance)
    return word_count(text).between(low, high)


def safe_name(value: Column) -> Column:
    """The last part of a path with everything but letters, digits, dot, dash and underscore turned into a dash."""
    last = F.regexp_extract(value, r"([^/\\]*)[/\\]*$", 1)
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(last, "[^A-Za-z0-9._-]+", "-"), F.lit("-_")), F.lit("")), F.lit("model"))


def label(path: str) -> str:
    """safe_name of a text of the driver: the runs of allowed characters of the last part that is not empty, by dashes."""
    parts = [x for x in path.replace("\\", "/").split("/") if x]
    return "-".join(re.findall("[A-Za-z0-9._-]+", parts[-1])).strip("-_") or "model" if parts else "model"


def backoff(attempt: Column, delay: float) -> Column:
    """Seconds to wait after a failed attempt, before jitter of up to a second."""
    return F.lit(float(delay)) * F.pow(F.lit(2.0), attempt - 1)
