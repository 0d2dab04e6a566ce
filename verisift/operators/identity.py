"""The engine: what a file is, whether it is intact, whether its name lies, what is in it, how risky it is.

``analyze`` is one narrow plan over rows of (path, length, content): native sniffing, one Arrow stage for the formats that need a parser,
native risk and composition. No shuffle; ``content`` never crosses an exchange.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from verisift.functions import detect, rules
from verisift.functions.detect import with_type
from verisift.functions.text import decode_text, human_size, language, one_decimal, text_metadata

STRINGS = "array<string>"

METADATA = {
    "pages": "int", "encrypted": "boolean", "contains_images": "boolean", "contains_tables": "boolean", "language": "string", "estimated_tokens": "bigint",
    "paragraphs": "bigint", "words": "bigint", "estimated_pages": "int", "sheets": "int", "sheet_names": "array<string>", "rows": "bigint", "columns": "int",
    "slides": "int", "text_length": "bigint", "characters": "bigint", "lines": "bigint", "width": "int", "height": "int", "mode": "string",
    "dpi": "struct<x:int,y:int>", "has_transparency": "boolean", "duration": "double", "bitrate": "bigint", "sample_rate": "int", "channels": "int",
    "resolution": "string", "codec": "string", "fps": "double", "file_count": "int", "total_uncompressed_bytes": "bigint", "total_compressed_bytes": "bigint",
    "total_bytes": "bigint", "inspection_error": "string", "inspection_note": "string",
}
_SIMPLE = {"int": T.IntegerType(), "bigint": T.LongType(), "string": T.StringType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "array<string>": T.ArrayType(T.StringType())}
_SIMPLE["struct<x:int,y:int>"] = T.StructType().add("x", "integer").add("y", "integer")
METADATA_TYPE = T.StructType([T.StructField(k, _SIMPLE[v]) for k, v in METADATA.items()])
PROBE_TYPE = T.StructType([
    T.StructField("errors", _SIMPLE["array<string>"]), T.StructField("warnings", _SIMPLE["array<string>"]), T.StructField("metadata", METADATA_TYPE),
    T.StructField("text", T.StringType()), T.StructField("error", T.StringType()),
])

#: Types whose bytes go through the Arrow stage; all others are handled by expressions.
PROBED = ["pdf", "docx", "xlsx", "pptx", "epub", "csv", "xml", "svg", "json", "zip", "tar", "gz", "bz2", *rules.IMAGE_TYPES, *rules.AUDIO_TYPES, *rules.VIDEO_TYPES]
ZIP_TYPES = ["zip", "docx", "xlsx", "pptx", "epub"]


def _probe(with_metadata: bool):
    @F.arrow_udf(PROBE_TYPE)
    def probe(content: pa.Array, kind: pa.Array) -> pa.Array:
        from verisift.operators import parsers

        out = []
        for data, name in zip(content.to_pylist(), kind.to_pylist()):
            if data is None:
                out.append(None)
                continue
            try:
                errors, warnings = parsers.validate(data, name)
                meta = parsers.inspect(data, name) if with_metadata and name not in ("xml", "json", "gz", "bz2") else {}
                text = meta.pop("_text", None)
                out.append({"errors": errors, "warnings": warnings, "metadata": meta, "text": text, "error": None})
            except Exception as e:  # a file that crashes a parser fails alone
                out.append({"errors": [], "warnings": [], "metadata": {}, "text": None, "error": str(e)})
        return pa.array(out, probe_type)

    # keeps filters on the results above this stage: pushed below, they would repeat the sniffing and the parsing
    return probe.asNondeterministic()


probe_type = to_arrow_type(PROBE_TYPE)


def validation(content: Column, kind: Column, probe: Column, text: Column) -> Column:
    """struct(errors, warnings): native rules for text, video and magic-only types, else what the probe found."""
    blank = ~text.rlike(rules.NOT_WHITE)
    four, twelve = F.substring(content, 1, 4), F.substring(content, 9, 4)
    known_video = (F.substring(content, 5, 4) == F.lit(bytearray(b"ftyp"))) | (four == F.lit(bytearray(b"\x1a\x45\xdf\xa3"))) | ((four == F.lit(bytearray(b"RIFF"))) & (twelve == F.lit(bytearray(b"AVI "))))
    seven = F.substring(content, 1, 6) != F.lit(bytearray(b"7z\xbc\xaf'\x1c"))
    rar = F.substring(content, 1, 6) != F.lit(bytearray(b"Rar!\x1a\x07"))
    error = F.when((kind == "7z") & seven, "Invalid 7Z magic bytes").when((kind == "rar") & rar, "Invalid RAR magic bytes")
    known = [*PROBED, "txt", "md", "html", "7z", "rar"]
    warning = (
        F.when(kind.isin("txt", "md", "html") & blank, F.concat(F.upper(kind), F.lit(" file is empty")))
        .when(kind.isin(*rules.VIDEO_TYPES) & ~known_video, "Could not fully verify video structure; file may be valid")
        .when(~kind.isin(*known), F.concat(F.lit("No validator for type '"), kind, F.lit("'; skipping structural check")))
    )
    none = F.array().cast(STRINGS)
    return F.struct(
        F.concat(F.coalesce(probe["errors"], none), F.array_compact(F.array(error))).alias("errors"),
        F.concat(F.coalesce(probe["warnings"], none), F.array_compact(F.array(warning))).alias("warnings"),
    )


def metadata_struct(kind: Column, probe: Column, text: Column) -> Column:
    """The metadata record: text types natively, others from the probe."""
    native = {name: F.when(kind.isin(*rules.TEXT_TYPES), value) for name, value in text_metadata(text).items()}
    guessed = F.when(probe["text"].isNotNull(), F.when(probe["text"].rlike(rules.NOT_WHITE), language(probe["text"])).otherwise("unknown"))
    cols = []
    for name, kind_ in METADATA.items():
        value = probe["metadata"][name]
        if name in native:
            value = F.coalesce(native[name].cast(kind_), value)
        if name == "language":
            value = F.coalesce(value, guessed)
        cols.append(value.cast(kind_).alias(name))
    return F.struct(*cols)


def embedded_program(kind: Column, names: Column) -> Column:
    """The first member of a ZIP that is a program, or null."""
    pattern = "(?i)(?:" + "|".join(s.replace(".", r"\.") for s in rules.EXECUTABLE_SUFFIXES) + ")$"
    return F.when(kind.isin(*ZIP_TYPES), F.get(F.filter(names, lambda n: n.rlike(pattern)), 0))


def risk(valid: Column, matches: Column, errors: Column, inspection_error: Column, length: Column, program: Column) -> Column:
    """struct(score, warnings): points add up, to 100 at most."""
    points = (
        F.when(matches, 0).otherwise(40)
        + F.when(~valid, 50).when(F.size(errors) > 0, 30).otherwise(0)
        + F.when(inspection_error.isNotNull(), 20).otherwise(0)
        + F.when(length == 0, 30).otherwise(0)
        + F.when(program.isNotNull(), 80).otherwise(0)
    )
    said = F.array_compact(F.array(
        F.when(~matches, F.lit("Extension mismatch")),
        F.when(inspection_error.isNotNull(), F.lit("Metadata could not be fully extracted")),
        F.when(length == 0, F.lit("File is empty")),
        F.when(program.isNotNull(), F.concat(F.lit("Embedded executable detected: "), program)),
    ))
    return F.struct(F.least(points, F.lit(100)).cast("int").alias("score"), said.alias("warnings"))


def analyze(files: DataFrame, *, skip_metadata: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """files: path, length, content and, for paths that have no bytes, ``missing`` (the guard's message). Returns the result record of every
    row, with the columns named in ``keep``. ``error`` is set only where a parser crashed."""
    if "missing" not in files.columns:
        files = files.withColumn("missing", F.lit(None).cast("string"))
    typed = with_type(files).withColumn("_text", F.when(F.col("real_type").isin(*rules.TEXT_TYPES), decode_text(F.col("content"))))
    here = F.col("missing").isNull() & (F.col("length") > 0)
    probed = typed.withColumn("probe", _probe(not skip_metadata)(F.when(here & F.col("real_type").isin(*PROBED), F.col("content")), F.col("real_type")))
    checked = probed.withColumn("check", validation(F.col("content"), F.col("real_type"), F.col("probe"), F.col("_text")))
    if skip_metadata:
        checked = checked.withColumn("metadata", F.lit(None).cast(METADATA_TYPE))
    else:
        checked = checked.withColumn("metadata", metadata_struct(F.col("real_type"), F.col("probe"), F.col("_text")))
    matches = detect.extension_matches(F.col("real_type"), F.col("extension"))
    checked = checked.withColumn("matches", matches).withColumn("structure_ok", F.size("check.errors") == 0)
    wrong = F.when(~F.col("matches") & (F.col("extension") != ""), F.concat(F.lit("File is not a valid "), F.upper("extension"), F.lit(" (real type: "), F.col("real_type"), F.lit(")")))
    checked = checked.withColumn("errors_", F.concat(F.array_compact(F.array(wrong)), F.col("check.errors")))
    program = embedded_program(F.col("real_type"), F.col("zip_names"))
    inspection_error = F.lit(None).cast("string") if skip_metadata else F.col("metadata.inspection_error")
    checked = checked.withColumn("risk", risk(F.col("structure_ok"), F.col("matches"), F.col("errors_"), inspection_error, F.col("length"), program))
    empty, missing, none = F.col("length") == 0, F.col("missing"), F.array().cast(STRINGS)
    plain = lambda value, otherwise: F.when(missing.isNull() & ~empty, value).otherwise(otherwise)
    return checked.select(
        *keep,
        "path",
        plain(F.col("structure_ok") & (F.size("errors_") == 0) & F.col("matches"), F.lit(False)).alias("valid"),
        plain(F.col("real_type"), F.lit("unknown")).alias("real_type"),
        plain(F.col("mime"), F.lit(rules.UNKNOWN_MIME)).alias("mime"),
        plain(F.col("extension"), F.lit("")).alias("extension"),
        plain(F.col("matches"), F.lit(False)).alias("extension_matches"),
        F.coalesce("length", F.lit(0)).cast("long").alias("size_bytes"),
        human_size(F.coalesce("length", F.lit(0))).alias("size_human"),
        plain(F.col("risk.score"), F.when(missing.isNotNull(), 0).otherwise(30)).cast("int").alias("risk_score"),
        plain(F.concat("check.warnings", "risk.warnings"), none).alias("warnings"),
        F.when(missing.isNotNull(), F.array(missing)).when(empty, F.array(F.lit("File is empty"))).otherwise(F.col("errors_")).alias("errors"),
        plain(F.col("metadata"), F.lit(None)).alias("metadata"),
        F.col("probe.error").alias("error"),
    )


def validate(files: DataFrame, **names) -> DataFrame:
    """``analyze`` without metadata; what it would cost is pruned from the plan."""
    return analyze(files, skip_metadata=True, **names)


def metadata_json(metadata: Column) -> Column:
    """The metadata as a JSON object of the keys that are there."""
    return F.coalesce(F.to_json(metadata), F.lit("{}"))


def summary(r: DataFrame) -> Column:
    """The readable report of a result row."""
    m = lambda name: F.col(f"metadata.{name}")
    line = lambda label, name: F.when(m(name).isNotNull(), F.concat(F.lit(f"{label}: "), m(name).cast("string")))
    kind = F.when(F.col("real_type") == "unknown", F.lit("Unknown type")).otherwise(F.upper("real_type"))
    tokens = F.when(m("estimated_tokens") >= 1000, F.concat(one_decimal(m("estimated_tokens") / 1000), F.lit("k"))).otherwise(m("estimated_tokens").cast("string"))
    lines = F.array(
        F.concat(F.when(F.col("valid"), "✓ Valid ").otherwise("✗ Invalid "), kind),
        line("Pages", "pages"), line("Slides", "slides"), line("Paragraphs", "paragraphs"), line("Sheets", "sheets"),
        F.concat(F.lit("Dimensions: "), m("width").cast("string"), F.lit("×"), m("height").cast("string")),
        F.concat(F.lit("Duration: "), one_decimal(m("duration")), F.lit("s")),
        line("Language", "language"),
        F.when(m("contains_tables"), F.lit("Contains tables")),
        F.when(m("contains_images"), F.lit("Contains images")),
        F.concat(F.lit("Size: "), F.col("size_human")),
        F.concat(F.lit("Tokens: "), tokens),
        F.concat(F.lit("Risk Score: "), F.col("risk_score").cast("string")),
    )
    marked = lambda sign, name: F.transform(name, lambda x: F.concat(F.lit(sign), x))
    return F.array_join(F.concat(F.array_compact(lines), marked("⚠  ", "warnings"), marked("✗  ", "errors")), "\n")


# --------------------------------------------------------------------------- reports over result rows

def batch_summary(results: DataFrame) -> DataFrame:
    """total, succeeded, failed, success_rate. Only rows with ``error`` failed."""
    failed = F.count_if(F.coalesce("error", F.lit("")) != "")
    total = F.count(F.lit(1))
    return results.agg(total.alias("total"), (total - failed).alias("succeeded"), failed.alias("failed"), F.when(total > 0, (total - failed) / total).otherwise(F.lit(0.0)).alias("success_rate"))


def risk_tier(score: Column) -> Column:
    return F.when(score == 0, "safe").when(score < 40, "low").when(score < 70, "medium").otherwise("high")


def upload_gate(results: DataFrame, allowed: list[str], max_risk: int = 50) -> DataFrame:
    """Adds accepted and reason: invalid files (their first error), types that aren't allowed, then risk above ``max_risk``."""
    reason = (
        F.when(~F.col("valid"), F.coalesce(F.get("errors", 0), F.lit("Invalid file")))
        .when(~F.col("real_type").isin(*allowed), F.concat(F.lit("Type not allowed: "), F.col("real_type")))
        .when(F.col("risk_score") > max_risk, F.concat(F.lit("Risk too high: "), F.col("risk_score").cast("string")))
    )
    return results.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def rag_preflight(results: DataFrame, max_tokens: int = 100_000) -> DataFrame:
    """Valid rows whose token estimate (0 if there is none) fits."""
    return results.where(F.col("valid") & (F.coalesce("metadata.estimated_tokens", F.lit(0)) <= max_tokens))
