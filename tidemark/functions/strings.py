"""Labels, tokens and parsed text fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words in file names and what they hint at.
NAME_HINTS = {"panorama": r"(^|[^\p{L}\p{N}])pano", "edited": r"(^|[^\p{L}\p{N}])(img_e|edited|edit($|[^\p{L}\p{N}]))", "timelapse": r"timelapse", "slowmotion": r"slo-?w?mo"}


def title_if_lower(x: Column) -> Column:
    """Title case for names written in lower case only."""
    return F.when(x == F.lower(x), F.initcap(x)).otherwise(x)


def first_label(*parts: Column) -> Column:
    """The first part that isn't blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(p), F.lit("")) for p in parts])


def joined_key(*parts: Column) -> Column:
    """Parts that aren't null, with bars between; null without any."""
    return F.nullif(F.concat_ws("|", *parts), F.lit(""))


def path_tokens(path: Column) -> Column:
    """Lower-case alphanumeric words of a path, without the extension."""
    return F.filter(F.split(F.lower(F.regexp_replace(path, r"\.[^./\\]*$", "")), "[^\\p{L}\\p{N}]+"), lambda x: x != "")


def name_hint(path: Column) -> Column:
    """What a path without its extension hints at; the first in the order of NAME_HINTS. Words may go on: panorama, timelapse2."""
    stem, out = F.lower(F.regexp_replace(path, r"\.[^./\\]*$", "")), F.lit(None).cast("string")
    for hint, pattern in reversed(NAME_HINTS.items()):
        out = F.when(stem.rlike(pattern), hint).otherwise(out)
    return out


def rational(x: Column) -> Column:
    """A number written plainly or as a fraction; null if it is neither or divides by 0."""
    parts = F.split(F.trim(x), "/")
    return F.when(F.size(parts) == 2, F.try_divide(parts[0].try_cast("double"), parts[1].try_cast("double"))).otherwise(F.trim(x).try_cast("double"))


def dms(degrees: Column, minutes: Column, secs: Column, ref: Column) -> Column:
    """Decimal degrees from parts and a compass letter."""
    value = rational(degrees) + F.coalesce(rational(minutes), F.lit(0.0)) / 60 + F.coalesce(rational(secs), F.lit(0.0)) / 3600
    return F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)


def offset_minutes(x: Column) -> Column:
    """Minutes of a UTC offset such as +02:00 or -0330; Z is 0."""
    p = r"^([+-])(\d{2}):?(\d{2})$"
    sign = F.when(F.regexp_extract(x, p, 1) == "-", -1).otherwise(1)
    value = sign * (F.regexp_extract(x, p, 2).try_cast("int") * 60 + F.regexp_extract(x, p, 3).try_cast("int"))
    return F.when(F.upper(x) == "Z", F.lit(0)).otherwise(value)


def has_keyword(text: Column, words: list[str]) -> Column:
    """Whether the lower-case text contains one of the words."""
    low, out = F.lower(text), F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return F.coalesce(out, F.lit(False))
