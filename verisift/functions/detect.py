"""Type detection: an ordered cascade of native expressions.

Only three questions need a parser: is a text that begins like JSON valid JSON, is one that begins with "<" well-formed XML, and which
members does a ZIP have. These go through Arrow functions that see a value for such rows only.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

from . import rules
from .text import decode_text, let, lstrip, split_lines, strip


#: (type, [(offset or None, bytes), ...]) in order of precedence
Signatures = Sequence[tuple[str, list[tuple[int | None, bytes]]]]


@F.arrow_udf(BooleanType())
def parses_as_json(text: pa.Array) -> pa.Array:
    def ok(x):
        try:
            json.loads(x)
        except (ValueError, RecursionError):
            return False
        return True

    return pa.array([None if x is None else ok(x) for x in text.to_pylist()], pa.bool_())


@F.arrow_udf(BooleanType())
def parses_as_xml(text: pa.Array) -> pa.Array:
    def ok(x):
        try:
            ET.fromstring(x)
        except (ET.ParseError, ValueError):
            return False
        return True

    return pa.array([None if x is None else ok(x) for x in text.to_pylist()], pa.bool_())


@F.arrow_udf(ArrayType(StringType()))
def zip_names(content: pa.Array) -> pa.Array:
    """Member names of ZIP bytes; null if they can't be read."""
    from verisift.operators.parsers import zip_listing

    return pa.array([None if x is None else zip_listing(x) for x in content.to_pylist()], pa.list_(pa.string()))


def head_of(content: Column) -> Column:
    return F.substring(content, 1, rules.HEAD_BYTES)


# filters on types stay above the stage that parses: pushed below, they would repeat it
parses_as_json, parses_as_xml, zip_names = parses_as_json.asNondeterministic(), parses_as_xml.asNondeterministic(), zip_names.asNondeterministic()


def signature(content: Column, extra: Signatures = ()) -> Column:
    """The first matching signature's type, or null. MKV and WebM are told apart; ZIP is not refined. ``extra`` signatures come after the built-in ones."""
    head = head_of(content)
    out = None
    for name, parts in [*rules.SIGNATURES, *extra]:
        tests = [F.contains(head, F.lit(bytearray(b))) if at is None else F.substring(content, at + 1, len(b)) == F.lit(bytearray(b)) for at, b in parts]
        test = tests[0]
        for t in tests[1:]:
            test = test & t
        value = F.lit(name)
        if name == "mkv":
            value = F.when(F.contains(F.substring(content, 1, rules.WEBM_BYTES), F.lit(bytearray(b"webm"))), F.lit("webm")).otherwise(value)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def container_type(names: Column) -> Column:
    """Which kind of ZIP the member names make."""
    out = None
    for name, member in rules.CONTAINER_MEMBERS:
        test = F.array_contains(names, member)
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit("zip"))


def sample_of(content: Column) -> Column:
    """The first 2,048 characters. A character takes four bytes at most, a line end one more, so the bytes to decode are bounded."""
    return F.substring(decode_text(F.substring(content, 1, rules.SAMPLE_CHARS * 5)), 1, rules.SAMPLE_CHARS)


def json_candidate(sample: Column, s: Column) -> Column:
    """The text to parse if a sample begins like JSON, else null. ``s``: the sample without leading white space."""
    whole = s.startswith("{") | s.startswith("[")
    bare = F.lower(F.substring(s, 1, 6)).isin("null", "true", "false") | s.startswith('"') | s.rlike(r"^[\p{Nd}+-]")
    return F.when(whole, sample).when(bare, strip(s))


def xml_candidate(s: Column) -> Column:
    low = F.lower(F.substring(s, 1, 14))
    return F.when(s.startswith("<") & ~s.startswith("<?xml") & ~low.startswith("<!doctype") & ~low.startswith("<html"), s)


def looks_like_csv(sample: Column) -> Column:
    """For comma, semicolon or tab: each of the first five lines that isn't empty has some, in numbers that differ by two at most."""

    def even(lines: Column, mark: str) -> Column:
        counts = F.transform(F.filter(F.slice(lines, 1, 5), lambda x: x != ""), lambda x: F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit(""))))
        return F.coalesce((F.array_min(counts) > 0) & (F.array_max(counts) - F.array_min(counts) <= 2), F.lit(False))

    return let(split_lines(sample), lambda x: (F.size(x) >= 2) & (even(x, ",") | even(x, ";") | even(x, "\t")))


def text_type(sample: Column, s: Column, extension: Column, is_json: Column, is_xml: Column) -> Column:
    """Type of a text from its sample, the stripped sample, the declared extension and what the parsers said."""
    low = F.lower(F.substring(s, 1, 14))
    hits = sum((F.contains(sample, F.lit(m)).cast("int") for m in rules.MARKDOWN_MARKS), F.lit(0))
    return (
        F.when(is_json, "json")
        .when(low.startswith("<!doctype html") | low.startswith("<html"), "html")
        .when(extension.isin("md", "markdown") & (hits >= 1), "md")
        .when(s.startswith("<?xml") | F.coalesce(is_xml, F.lit(False)), "xml")
        .when(looks_like_csv(sample), "csv")
        .when(hits >= 2, "md")
        .otherwise("txt")
    )


def with_type(files: DataFrame, *, path: str = "path", content: str = "content", extra: Signatures = ()) -> DataFrame:
    """Adds extension, real_type, mime and zip_names. Steps are columns: each is computed once, and the parsers' stage keeps filters above it."""
    c, names = F.col(content), F.col("zip_names")
    out = files.withColumn("extension", extension_of(F.col(path))).withColumn("_kind", signature(c, extra))
    text = F.col("_kind").isNull() & (F.length(c) > 0) & ~F.contains(head_of(c), F.lit(bytearray(b"\x00")))
    out = out.withColumn("_sample", F.when(text, sample_of(c))).withColumn("_s", lstrip(F.col("_sample")))
    out = out.withColumns({"zip_names": zip_names(zip_bytes(c)), "_json": parses_as_json(json_candidate(F.col("_sample"), F.col("_s"))), "_xml": parses_as_xml(xml_candidate(F.col("_s")))})
    is_zip = F.substring(c, 1, 4) == F.lit(bytearray(b"PK\x03\x04"))
    kind = (
        F.when(is_zip, container_type(F.coalesce(names, F.array().cast("array<string>"))))
        .when(F.col("_kind").isNotNull(), F.col("_kind"))
        .when(F.col("_sample").isNotNull(), text_type(F.col("_sample"), F.col("_s"), F.col("extension"), F.col("_json"), F.col("_xml")))
        .otherwise("unknown")
    )
    out = out.withColumn("real_type", kind).drop("_kind", "_sample", "_s", "_json", "_xml")
    return out.withColumn("mime", mime_of(F.col("real_type")))


def zip_bytes(content: Column) -> Column:
    """The content where it begins as a ZIP, else null: what the listing function has to see."""
    return F.when(F.substring(content, 1, 2) == F.lit(bytearray(b"PK")), content)


def mime_of(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in rules.TYPE_MIME.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit(rules.UNKNOWN_MIME))


def extension_of(path: Column) -> Column:
    """The last suffix of the file name, lower-cased; none for names that begin or end with their only dot."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))


def extension_matches(kind: Column, extension: Column) -> Column:
    table = F.create_map(*[x for k, v in rules.EXTENSION_ALIASES.items() for x in (F.lit(k), F.array(*[F.lit(e) for e in v]))])
    canonical = F.when(kind == "tiff", F.lit("tif")).otherwise(kind)
    return (extension == kind) | (extension == canonical) | F.coalesce(F.array_contains(F.try_element_at(table, kind), extension), F.lit(False))
