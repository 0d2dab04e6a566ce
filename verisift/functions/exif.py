"""EXIF values as columns: rationals, coordinates, shutter speeds, summary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def rational(num: Column, den: Column) -> Column:
    """num / den; null for a zero denominator."""
    return num.cast("double") / F.nullif(den, F.lit(0)).cast("double")


def dms_to_decimal(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Decimal degrees with seven digits; south and west are negative."""
    x = degrees + minutes / 60 + seconds / 3600
    return F.bround(F.when(F.coalesce(ref, F.lit("")).isin("S", "W"), -x).otherwise(x), 7)


def altitude(value: Column, ref: Column) -> Column:
    return F.when(F.coalesce(ref.cast("string"), F.lit("")) == "1", -value).otherwise(value)


def direction(value: Column) -> Column:
    return F.concat(F.bround(value, 1).cast("decimal(20,1)").cast("string"), F.lit("°"))


def shutter(num: Column, den: Column) -> Column:
    """"2s", "1/125", or the nearest 1/x of another ratio."""
    return (
        F.when(num.isNull() | den.isNull() | (num == 0), None)
        .when(den == 1, F.concat(num.cast("string"), F.lit("s")))
        .when(num == 1, F.concat(F.lit("1/"), den.cast("string")))
        .otherwise(F.concat(F.lit("1/"), F.rint(den.cast("double") / num).cast("long").cast("string")))
    )


def one_decimal_or_null(value: Column) -> Column:
    """One digit after the point; zero counts as missing."""
    return F.when(value != 0, F.bround(value, 1))


def coordinates(gps: Column) -> Column:
    six = lambda c: F.bround(c, 6).cast("decimal(20,6)").cast("string")
    return F.concat(six(gps["latitude"]), F.lit(", "), six(gps["longitude"]))


def maps_url(gps: Column) -> Column:
    return F.concat(F.lit("https://www.google.com/maps?q="), gps["latitude"].cast("string"), F.lit(","), gps["longitude"].cast("string"))


def summary(e: Column) -> Column:
    """The lines of an EXIF record that are there, else "No EXIF data found"."""
    truthy = lambda c: c.isNotNull() & (c.cast("string") != "") & (c.cast("string") != "0")
    line = lambda test, *parts: F.when(test, F.concat(*parts))
    lines = F.array_compact(F.array(
        F.when(truthy(e["camera_make"]) & truthy(e["camera_model"]), F.concat(F.lit("Camera: "), e["camera_make"], F.lit(" "), e["camera_model"])).when(truthy(e["camera_model"]), F.concat(F.lit("Camera: "), e["camera_model"])),
        line(truthy(e["datetime_taken"]), F.lit("Taken: "), e["datetime_taken"]),
        line(truthy(e["focal_length"]), F.lit("Focal length: "), e["focal_length"].cast("string"), F.lit("mm")),
        line(truthy(e["aperture"]), F.lit("Aperture: f/"), e["aperture"].cast("string")),
        line(truthy(e["shutter_speed"]), F.lit("Shutter: "), e["shutter_speed"]),
        line(truthy(e["iso"]), F.lit("ISO: "), e["iso"].cast("string")),
        line(e["gps"].isNotNull(), F.lit("GPS: "), coordinates(e["gps"])),
    ))
    return let(lines, lambda x: F.when(F.size(x) > 0, F.array_join(x, "\n")).otherwise(F.lit("No EXIF data found")))
