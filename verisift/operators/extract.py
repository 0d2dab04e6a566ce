"""Plain text out of files: native for text types and HTML, one Arrow function for the rest."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from verisift.functions import rules
from verisift.functions.text import decode_text, word_count
from verisift.functions.urls import strip_tags

NO_TEXT = [*rules.IMAGE_TYPES, "svg", *rules.AUDIO_TYPES, *rules.VIDEO_TYPES]
PARSED = ["pdf", "docx", "pptx", "xlsx", "csv", "xml", "json", "epub", "zip", "tar", "gz"]
_TYPE = T.StructType([T.StructField("text", T.StringType()), T.StructField("extractor", T.StringType()), T.StructField("warnings", T.ArrayType(T.StringType()))])
_ARROW = to_arrow_type(_TYPE)


@F.arrow_udf(_TYPE)
def parsed_text(content: pa.Array, kind: pa.Array, path: pa.Array) -> pa.Array:
    from verisift.operators import parsers

    out = []
    for data, name, where in zip(content.to_pylist(), kind.to_pylist(), path.to_pylist()):
        if data is None:
            out.append(None)
            continue
        text, extractor, warnings = parsers.extract(data, name, where or "")
        out.append({"text": text.encode("utf-8", "replace").decode(), "extractor": extractor, "warnings": warnings})
    return pa.array(out, _ARROW)


def extract_text(files: DataFrame, *keep: str, max_chars: int = 0, kind: str = "real_type") -> DataFrame:
    """files: path, content, real_type. Returns ``keep``, path, text, char_count, word_count, extractor, truncated, warnings. Never fails."""
    k = F.col(kind)
    got = files.withColumn("_parsed", parsed_text(F.when(k.isin(*PARSED), F.col("content")), k, F.col("path")))
    plain = decode_text(F.col("content"))
    text = F.when(k.isin(*NO_TEXT), "").when(k.isin(*PARSED), F.col("_parsed.text")).when(k == "html", strip_tags(plain)).otherwise(plain)
    extractor = F.when(k.isin(*NO_TEXT), "").when(k.isin(*PARSED), F.col("_parsed.extractor")).when(k == "html", "tag-strip").otherwise("plain-text")
    advice = F.concat(F.lit("Type '"), k, F.lit("' requires AI assistance for text extraction."))
    warnings = F.when(k.isin(*NO_TEXT), F.array(advice)).otherwise(F.coalesce(F.col("_parsed.warnings"), F.array().cast("array<string>")))
    got = got.select(*keep, "path", F.coalesce(text, F.lit("")).alias("_text"), extractor.alias("extractor"), warnings.alias("warnings"))
    cut = F.length("_text") > max_chars if max_chars else F.lit(False)
    body = F.substring("_text", 1, max_chars) if max_chars else F.col("_text")
    return got.select(*keep, "path", body.alias("text"), F.length(body).alias("char_count"), word_count(body).alias("word_count"), "extractor", cut.alias("truncated"), "warnings")
