"""Personal data in text: find, resolve overlaps, redact. All built-in expressions.

Each pattern's matches are found by ``regexp_extract_all``; their offsets are running sums over the pieces between them. Candidates in order of
precedence are folded: one is rejected if its start lies in an accepted span or its end does. One that strictly contains an accepted
span is kept, as a match; the redacted text then replaces the outer span only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import PII_PATTERNS
from .text import let

MATCH = "struct<pii_type:string,value:string,start:int,end:int,confidence:string>"


def _insensitive(pattern: str) -> str:
    return f"(?i){pattern}"


def pattern_matches(text: Column, name: str, pattern: str, confidence: str) -> Column:
    """All matches of one pattern, left to right."""
    regex = _insensitive(pattern)
    empty = F.array().cast(f"array<{MATCH}>")
    start = F.struct(F.lit(0).alias("pos"), empty.alias("out"))

    def step(pieces: Column):
        def add(acc: Column, value: Column, i: Column) -> Column:
            at = acc["pos"] + F.length(F.get(pieces, i))
            match = F.struct(F.lit(name).alias("pii_type"), value.alias("value"), at.cast("int").alias("start"), (at + F.length(value)).cast("int").alias("end"), F.lit(confidence).alias("confidence"))
            return F.struct((at + F.length(value)).alias("pos"), F.concat(acc["out"], F.array(match)).alias("out"))

        return add

    def located(values: Column) -> Column:
        indexed = F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
        return let(F.split(text, regex, -1), lambda pieces: F.aggregate(indexed, start, lambda acc, x: step(pieces)(acc, x["v"], x["i"]), lambda acc: acc["out"]))

    return let(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), lambda values: F.when(F.size(values) > 0, located(values)).otherwise(empty))


def raw_counts(text: Column) -> dict[str, Column]:
    """Number of matches of each pattern before overlaps are resolved."""
    return {name: F.coalesce(F.regexp_count(text, F.lit(_insensitive(p))), F.lit(0)) for name, p, _ in PII_PATTERNS}


def pii_matches(text: Column) -> Column:
    """Accepted matches by position; empty for null or empty text."""
    empty = F.array().cast(f"array<{MATCH}>")
    candidates = F.flatten(F.array(*[pattern_matches(text, *p) for p in PII_PATTERNS]))
    clash = lambda a, c: ((a["start"] <= c["start"]) & (c["start"] < a["end"])) | ((a["start"] < c["end"]) & (c["end"] <= a["end"]))
    accepted = F.aggregate(candidates, empty, lambda acc, c: F.when(F.exists(acc, lambda a: clash(a, c)), acc).otherwise(F.concat(acc, F.array(c))))
    by_start = F.array_sort(accepted, lambda a, b: a["start"] - b["start"])
    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, by_start).otherwise(empty)


def types_found(matches: Column) -> Column:
    """Distinct types by first position."""
    return F.array_distinct(F.transform(matches, lambda m: m["pii_type"]))


def redact(text: Column, matches: Column) -> Column:
    """``[REDACTED_TYPE]`` in place of every match; spans inside an outer match vanish with it."""
    outer = let(matches, lambda ms: F.filter(ms, lambda m: ~F.exists(ms, lambda o: (o["start"] <= m["start"]) & (m["end"] <= o["end"]) & ((o["end"] - o["start"]) > (m["end"] - m["start"])))))
    tag = lambda m: F.concat(F.lit("[REDACTED_"), F.upper(m["pii_type"]), F.lit("]"))
    begin = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    step = lambda acc, m: F.struct(m["end"].alias("pos"), F.concat(acc["out"], F.substring(text, acc["pos"] + 1, m["start"] - acc["pos"]), tag(m)).alias("out"))
    folded = F.aggregate(outer, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))
    return F.when(F.size(matches) > 0, folded).otherwise(text)


def with_pii(df: DataFrame, text_col: str, *, redacted: bool = True) -> DataFrame:
    """Adds matches, has_pii, pii_count, types_found and redacted_text."""
    out = df.withColumn("matches", pii_matches(F.col(text_col)))
    out = out.withColumn("has_pii", F.size("matches") > 0).withColumn("pii_count", F.size("matches")).withColumn("types_found", types_found(F.col("matches")))
    return out.withColumn("redacted_text", redact(F.col(text_col), F.col("matches"))) if redacted else out


def explode_pii(df: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """One row per accepted match, with the columns named in ``keep``."""
    return df.select(*keep, pii_matches(F.col(text_col)).alias("matches")).select(*keep, F.inline("matches"))
