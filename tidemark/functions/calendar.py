"""Calendar, daylight and clock expressions. Timestamps are UTC; local time comes from an explicit offset or zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Federal holidays on fixed days, and days after Easter Sunday.
FIXED_HOLIDAYS = {"01-01": "Neujahr", "05-01": "Tag der Arbeit", "10-03": "Tag der Deutschen Einheit", "12-25": "1. Weihnachtstag", "12-26": "2. Weihnachtstag"}
EASTER_HOLIDAYS = {-2: "Karfreitag", 1: "Ostermontag", 39: "Christi Himmelfahrt", 50: "Pfingstmontag"}


def seconds(ts: Column) -> Column:
    """Whole epoch seconds."""
    return F.floor(ts.cast("double")).cast("bigint")


def local_time(ts: Column, offset_min: Column) -> Column:
    """The wall clock at a numeric offset from UTC, as a timestamp; a null offset means UTC."""
    return F.timestamp_add("MINUTE", F.coalesce(offset_min, F.lit(0)).cast("int"), ts)


def iso_weekday(day: Column) -> Column:
    return F.weekday(day) + 1


def is_weekend(day: Column) -> Column:
    return F.weekday(day) >= 5


def season(day: Column) -> Column:
    """Meteorological season."""
    m = F.month(day)
    return F.when(m.isin(12, 1, 2), "winter").when(m.between(3, 5), "spring").when(m.between(6, 8), "summer").otherwise("autumn")


def season_year(day: Column) -> Column:
    """Year of a season: December belongs to the winter of the next year."""
    return F.year(day) + (F.month(day) == 12).cast("int")


def daypart(hour: Column) -> Column:
    return F.when(hour.between(6, 10), "morning").when(hour.between(11, 16), "noon").when(hour.between(17, 21), "evening").otherwise("night")


def easter(year: Column) -> Column:
    """Western Easter Sunday of a Gregorian year (Gauss's rule with the century corrections)."""
    golden = F.pmod(year, F.lit(19))
    century = F.floor(year / 100)
    p = F.floor((13 + 8 * century) / 25)
    q = F.floor(century / 4)
    moon = F.pmod(15 - p + century - q, F.lit(30))
    sunday = F.pmod(4 + century - q, F.lit(7))
    full = F.pmod(19 * golden + moon, F.lit(30))
    after = F.pmod(2 * F.pmod(year, F.lit(4)) + 4 * F.pmod(year, F.lit(7)) + 6 * full + sunday, F.lit(7))
    late = ((full == 29) & (after == 6)) | ((full == 28) & (after == 6) & (golden > 10))
    return F.date_add(F.make_date(year, F.lit(3), F.lit(22)), (full + after - F.when(late, 7).otherwise(0)).cast("int"))


def holiday(day: Column) -> Column:
    """Name of the federal holiday on a day; null on other days."""
    key, days = F.date_format(day, "MM-dd"), F.datediff(day, easter(F.year(day)))
    out = F.lit(None).cast("string")
    for after, name in EASTER_HOLIDAYS.items():
        out = F.when(days == after, name).otherwise(out)
    for month_day, name in FIXED_HOLIDAYS.items():
        out = F.when(key == month_day, name).otherwise(out)
    return out


def month_day_distance(a: Column, month: int, day: int) -> Column:
    """Days between two month-days of one year (2001). Not circular; 29 February counts as 1 March."""
    start = F.make_date(F.lit(2001), F.month(a), F.lit(1))
    return F.abs(F.datediff(F.date_add(start, F.dayofmonth(a) - 1), F.lit(f"2001-{month:02d}-{day:02d}").cast("date")))


def sun(day: Column, lat: Column, lon: Column) -> dict[str, Column]:
    """Epoch seconds of sunrise and sunset by the sunrise equation, and whether the sun stays up or down all day."""
    deg, rad = F.degrees, F.radians
    wrap = lambda x: x - F.lit(360.0) * F.when(x >= 0, F.floor(x / 360)).otherwise(F.ceil(x / 360))
    julian = F.datediff(day, F.lit("1970-01-01").cast("date")) + 2440588
    mean = julian - F.lit(2451545.0) + 0.0008 - lon / 360
    m = wrap(357.5291 + 0.98560028 * mean)
    centre = 1.9148 * F.sin(rad(m)) + 0.0200 * F.sin(2 * rad(m)) + 0.0003 * F.sin(3 * rad(m))
    ecliptic = wrap(m + 102.9372 + centre + 180.0)
    transit = 2451545.0 + mean + 0.0053 * F.sin(rad(m)) - 0.0069 * F.sin(2 * rad(ecliptic))
    tilt = F.asin(F.sin(rad(ecliptic)) * F.sin(rad(F.lit(23.44))))
    cos_h = (F.sin(rad(F.lit(-0.83))) - F.sin(rad(lat)) * F.sin(tilt)) / (F.cos(rad(lat)) * F.cos(tilt))
    regular = (cos_h >= -1) & (cos_h <= 1)
    half = deg(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos_h)))) / 360
    epoch = lambda j: F.round((j - 2440587.5) * 86400).cast("bigint")
    return {"sunrise": F.when(regular, epoch(transit - half)), "sunset": F.when(regular, epoch(transit + half)), "polar_day": cos_h < -1, "polar_night": cos_h > 1}


def golden_hour(t: Column, sunrise: Column, sunset: Column, minutes: int = 60) -> Column:
    """Whether an epoch second lies in the golden minutes after sunrise or before sunset, all in UTC; false without a sunrise."""
    return F.coalesce(t.between(sunrise, sunrise + minutes * 60) | t.between(sunset - minutes * 60, sunset), F.lit(False))


#: Forms of a time stamp in a file name, tried in this order.
FILENAME_FORMS = (
    r"(?<!\d)(\d{4})(\d{2})(\d{2})[_-]?(\d{2})(\d{2})(\d{2})(?!\d)",
    r"(?<!\d)(\d{4})[-_.](\d{2})[-_.](\d{2})[ T_-](\d{2})[-_.](\d{2})[-_.](\d{2})(?!\d)",
    r"(?i)(?:IMG|DSC|VID|MOV|PXL|PHOTO)[_-]?(\d{4})(\d{2})(\d{2})[_-]?(\d{2})(\d{2})(\d{2})",
)


def filename_time(name: Column) -> Column:
    """Timestamp in a file name, by the first form that matches and is a date."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    out = F.lit(None).cast("timestamp")
    for p in reversed(FILENAME_FORMS):
        parts = [F.regexp_extract(stem, p, k) for k in range(1, 7)]
        text = F.concat(F.concat_ws("-", *parts[:3]), F.lit(" "), F.concat_ws(":", *parts[3:]))
        out = F.when(parts[0] != "", F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), out)).otherwise(out)
    return out
