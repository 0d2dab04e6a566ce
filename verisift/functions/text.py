"""Text as columns: words, lines, token estimates, sizes, language guess. All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import LANGUAGE_WORDS, LINE_END, NOT_WHITE, WHITE


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITE}+", "")


def decode_text(content: Column) -> Column:
    """UTF-8 with replacement of bad bytes, line ends as \\n."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n|\r", "\n")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NOT_WHITE + "+")), F.lit(0)).cast("long")


def line_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def split_lines(text: Column) -> Column:
    """str.splitlines: no empty line after a final line end."""
    parts = F.split(text, LINE_END, -1)
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def tokens_from_words(words: Column) -> Column:
    """max(1, int(words / 0.75)), in IEEE doubles."""
    return F.greatest(F.lit(1), F.floor(words.cast("double") / F.lit(0.75))).cast("long")


def token_estimate(text: Column) -> Column:
    return tokens_from_words(word_count(text))


def one_decimal(x: Column) -> Column:
    """One digit after the point, ties to even."""
    return F.bround(x, 1).cast("decimal(38,1)").cast("string")


def human_size(n: Column) -> Column:
    x = n.cast("double")
    out = F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
    for power, unit in enumerate(["KB", "MB", "GB", "TB"], 1):
        out = out.when(x / 1024.0 ** power < 1024, F.concat(one_decimal(x / 1024.0 ** power), F.lit(f" {unit}")))
    return out.otherwise(F.concat(one_decimal(x / 1024.0 ** 5), F.lit(" PB")))


def language(text: Column) -> Column:
    """The language whose frequent words are most frequent in the first 5,000 characters; "unknown" if there are none or the text is blank.
    A guess of our own: language libraries can't be matched exactly."""
    spaced = F.concat(F.lit("  "), F.regexp_replace(F.lower(F.substring(text, 1, 5000)), r"[^\p{L}]+", "  "), F.lit("  "))
    counts = lambda t: [F.struct(F.regexp_count(t, F.lit(f" (?:{'|'.join(words)}) ")).alias("n"), F.lit(code).alias("code")) for code, words in LANGUAGE_WORDS.items()]
    return let(spaced, lambda t: let(F.greatest(*counts(t)), lambda best: F.when(best["n"] > 0, best["code"]).otherwise(F.lit("unknown"))))


def text_metadata(text: Column) -> dict[str, Column]:
    """characters, lines, words, language, estimated_tokens."""
    words = word_count(text)
    return {"characters": F.length(text).cast("long"), "lines": line_count(text), "words": words, "language": language(text), "estimated_tokens": tokens_from_words(words)}
