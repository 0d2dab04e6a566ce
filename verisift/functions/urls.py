"""URLs as columns: validation, MIME types, HTTP responses, HTML text and titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import MIME_TYPE, NOT_WHITE, WHITE
from .text import human_size, strip

_STRING_ARRAY = "array<string>"


def scheme_of(url: Column) -> Column:
    """Lower-cased; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def authority_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def url_errors(url: Column) -> Column:
    """Empty for a URL that can be fetched. A bracketed host that isn't closed can't be parsed."""
    scheme, authority = scheme_of(url), authority_of(url)
    message = (
        F.when(url.isNull(), F.lit("Invalid URL: no URL"))
        .when(F.contains(authority, F.lit("[")) != F.contains(authority, F.lit("]")), F.lit("Invalid URL: Invalid IPv6 URL"))
        .when(~scheme.isin("http", "https"), F.concat(F.lit("Unsupported scheme: '"), scheme, F.lit("'")))
        .when(authority == "", F.lit("URL has no host"))
    )
    return F.array_compact(F.array(message))


def mime_to_type(mime: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MIME_TYPE.items() for x in pair])
    return F.coalesce(F.try_element_at(table, mime), F.lit("unknown"))


def inspection(url: Column, status: Column, reason: Column, content_type: Column, content_length: Column, encoding: Column, server: Column, failure: Column) -> Column:
    """The inspection record of a URL from a HEAD response. ``failure``: message of a request that got no response."""
    bad = url_errors(url)
    mime = F.nullif(strip(F.get(F.split(F.coalesce(content_type, F.lit("")), ";"), 0)), F.lit(""))
    size = F.expr("cast(null as bigint)") if content_length is None else strip(content_length).try_cast("long")
    http_error = F.when(status >= 400, F.concat(F.lit("HTTP "), status.cast("string"), F.lit(": "), F.coalesce(reason, F.lit(""))))
    errors = F.when(F.size(bad) > 0, bad).otherwise(F.array_compact(F.array(F.concat(F.lit("Request failed: "), failure), F.when(failure.isNull(), http_error))))
    ok = F.size(errors) == 0
    when_ok = lambda c: F.when(ok, c)
    return F.struct(
        ok.alias("valid"), url.alias("url"), when_ok(mime).alias("mime"),
        F.when(ok, mime_to_type(F.coalesce(mime, F.lit("")))).otherwise(F.lit("unknown")).alias("real_type"),
        when_ok(size).alias("size_bytes"), when_ok(human_size(size)).alias("size_human"),
        F.when((F.size(bad) == 0) & failure.isNull(), status).alias("status_code"), when_ok(encoding).alias("content_encoding"), when_ok(server).alias("server"),
        F.when(ok & mime.isNull(), F.array(F.lit("Server did not return Content-Type"))).otherwise(F.array().cast(_STRING_ARRAY)).alias("warnings"),
        errors.alias("errors"),
    )


def strip_tags(html: Column) -> Column:
    """Tags become blanks, white space collapses."""
    return strip(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), WHITE + "+", " "))


def html_title(html: Column) -> Column:
    """Stripped text of the first title element; null if there is none."""
    title = F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)</title>", 1)
    return F.when(F.lower(html).contains("<title"), strip(title))


def html_description(html: Column) -> Column:
    """content of the meta element named description."""
    tag = F.regexp_extract(html, r"""(?is)<meta\b[^>]*\bname\s*=\s*["']?description["']?[^>]*>""", 0)
    return F.when(tag != "", F.regexp_extract(tag, r"""(?is)\bcontent\s*=\s*["']([^"']*)["']""", 1))


def has_text(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(NOT_WHITE)
