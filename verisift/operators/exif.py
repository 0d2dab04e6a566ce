"""EXIF records of images. A walk over the TIFF directories gives raw values; everything derived from them is native."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from verisift.functions import exif as fx

# EXIF tag numbers.
_TEXT = {("Image", 271): "camera_make", ("Image", 272): "camera_model", ("EXIF", 42036): "lens_model", ("Image", 305): "software", ("EXIF", 36867): "datetime_taken", ("EXIF", 36868): "datetime_digitized", ("Image", 315): "artist", ("Image", 33432): "copyright", ("Image", 270): "description"}
_CODED = {
    ("EXIF", 41986): ("exposure_mode", {0: "Auto Exposure", 1: "Manual Exposure", 2: "Auto Bracket"}),
    ("EXIF", 37385): ("flash", {0: "Flash did not fire", 1: "Flash fired", 16: "Flash did not fire, compulsory flash mode", 24: "Flash did not fire, auto mode", 25: "Flash fired, auto mode"}),
    ("EXIF", 41987): ("white_balance", {0: "Auto", 1: "Manual"}),
    ("EXIF", 40961): ("color_space", {1: "sRGB", 2: "Adobe RGB", 65535: "Uncalibrated"}),
}
_RATIONAL = {("EXIF", 37386): "focal", ("EXIF", 41989): "focal35", ("EXIF", 33437): "fnumber", ("EXIF", 33434): "exposure", ("GPS", 6): "altitude", ("GPS", 17): "img_direction"}
_INT = {("EXIF", 34855): "iso", ("Image", 274): "orientation", ("GPS", 5): "altitude_ref"}

_PAIR = T.StructType([T.StructField("num", T.LongType()), T.StructField("den", T.LongType())])
RAW = T.StructType([
    *(T.StructField(n, T.StringType()) for n in [*_TEXT.values(), *(n for n, _ in _CODED.values()), "lat_ref", "lon_ref", "warning"]),
    *(T.StructField(n, _PAIR) for n in _RATIONAL.values()),
    *(T.StructField(n, T.IntegerType()) for n in _INT.values()),
    T.StructField("lat", T.ArrayType(_PAIR)), T.StructField("lon", T.ArrayType(_PAIR)),
    T.StructField("raw", T.MapType(T.StringType(), T.StringType())),
])
_ARROW = to_arrow_type(RAW)


def exif_block(content: bytes) -> bytes | None:
    """The TIFF structure of a JPEG's APP1 segment or of a TIFF file."""
    if content[:4] in (b"II*\x00", b"MM\x00*"):
        return content
    pos = 2
    while content[:2] == b"\xff\xd8" and pos + 4 <= len(content) and content[pos] == 0xFF and content[pos + 1] not in (0xDA, 0xD9):
        length = int.from_bytes(content[pos + 2:pos + 4], "big")
        if content[pos + 1] == 0xE1 and content[pos + 4:pos + 10] == b"Exif\0\0":
            return content[pos + 10:pos + 2 + length]
        pos += 2 + length
    return None


def raw_tags(content: bytes) -> dict:
    from verisift.operators.parsers import tiff_tags

    try:
        block = exif_block(content)
        tags = tiff_tags(block) if block else {}
    except Exception as e:  # broken structures give a warning, not a failure
        return {"warning": f"Could not read EXIF data: {e}"}
    if not any(tags.values()):
        return {"warning": "No EXIF data found in this file"}
    pair = lambda v: {"num": int(v[0]), "den": int(v[1])} if isinstance(v, tuple) else {"num": int(v), "den": 1}
    out: dict = {"raw": [(f"{group} {tag}", str(v[0] if len(v) == 1 else v)) for group, entries in tags.items() for tag, v in entries.items()]}
    for (group, tag), name in _TEXT.items():
        if value := tags[group].get(tag):
            out[name] = str(value[0]).strip() or None
    for (group, tag), (name, names) in _CODED.items():
        if value := tags[group].get(tag):
            out[name] = names.get(value[0], str(value[0]))
    for (group, tag), name in _RATIONAL.items():
        if value := tags[group].get(tag):
            out[name] = pair(value[0])
    for (group, tag), name in _INT.items():
        value = tags[group].get(tag)
        if value and isinstance(value[0], int):
            out[name] = value[0]
    for tag, ref, name in ((2, 1, "lat"), (4, 3, "lon")):
        if (value := tags["GPS"].get(tag)) and len(value) >= 3:
            out[name] = [pair(v) for v in value[:3]]
            out[f"{name}_ref"] = str(tags["GPS"].get(ref, [""])[0]) or None
    return out


@F.arrow_udf(RAW)
def read_tags(content: pa.Array) -> pa.Array:
    return pa.array([None if x is None else raw_tags(x) for x in content.to_pylist()], _ARROW)


def _coordinate(name: str):
    p = F.col(f"t.{name}")
    part = lambda i: fx.rational(F.get(p, i)["num"], F.get(p, i)["den"])
    return fx.dms_to_decimal(part(0), part(1), part(2), F.col(f"t.{name}_ref"))


def extract_exif(files: DataFrame, *keep: str) -> DataFrame:
    """files: path, content. Returns ``keep``, path and the struct ``exif`` with its summary inside; warnings where there is nothing to read."""
    ratio = lambda n: fx.rational(F.col(f"t.{n}.num"), F.col(f"t.{n}.den"))
    lat, lon = _coordinate("lat"), _coordinate("lon")
    gps = F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("latitude"), lon.alias("longitude"), fx.altitude(ratio("altitude"), F.col("t.altitude_ref")).alias("altitude"), fx.direction(ratio("img_direction")).alias("direction")))
    text = [F.col(f"t.{n}").alias(n) for n in ("camera_make", "camera_model", "lens_model", "software")]
    more = [F.col(f"t.{n}").alias(n) for n in ("exposure_mode", "flash", "white_balance", "datetime_taken", "datetime_digitized", "orientation")]
    record = F.struct(
        *text,
        fx.one_decimal_or_null(ratio("focal")).alias("focal_length"), fx.one_decimal_or_null(ratio("focal35")).alias("focal_length_35mm"), fx.one_decimal_or_null(ratio("fnumber")).alias("aperture"),
        fx.shutter(F.col("t.exposure.num"), F.col("t.exposure.den")).alias("shutter_speed"), F.col("t.iso").alias("iso"),
        *more,
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.col("t.color_space").alias("color_space"),
        gps.alias("gps"), F.col("t.artist").alias("artist"), F.col("t.copyright").alias("copyright"), F.col("t.description").alias("description"),
        F.coalesce(F.col("t.raw"), F.create_map().cast("map<string,string>")).alias("raw"),
        F.array_compact(F.array(F.col("t.warning"))).alias("warnings"), F.lit("tiff-directories").alias("extractor"),
    )
    out = files.withColumn("t", read_tags(F.col("content"))).select(*keep, "path", record.alias("exif"))
    return out.select(*keep, "path", "exif", fx.summary(F.col("exif")).alias("summary"), F.col("exif.gps").isNotNull().alias("has_gps"), F.when(F.col("exif.gps").isNotNull(), fx.maps_url(F.col("exif.gps"))).alias("maps_url"))
