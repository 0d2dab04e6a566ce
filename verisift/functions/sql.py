"""SQL names for the engine's scalar functions, as SQL functions: their bodies are inlined into the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .rules import EXECUTABLE_SUFFIXES, MIME_TYPE, NOT_WHITE, WHITE

_MIME = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MIME_TYPE.items())
_UNITS = " ".join(f"WHEN n / {1024.0 ** p!r}D < 1024 THEN concat(CAST(CAST(bround(n / {1024.0 ** p!r}D, 1) AS DECIMAL(38,1)) AS STRING), ' {u}')" for p, u in enumerate(["KB", "MB", "GB", "TB"], 1))
_PROGRAM = "|".join(s[1:] for s in EXECUTABLE_SUFFIXES)

FUNCTIONS = {
    "word_count(t STRING) RETURNS BIGINT": f"coalesce(regexp_count(t, r'{NOT_WHITE}+'), 0)",
    "token_estimate(t STRING) RETURNS BIGINT": f"greatest(1, CAST(floor(CAST(coalesce(regexp_count(t, r'{NOT_WHITE}+'), 0) AS DOUBLE) / 0.75D) AS BIGINT))",
    "strip_white(t STRING) RETURNS STRING": f"regexp_replace(t, r'^{WHITE}+|{WHITE}+$', '')",
    "human_size(n BIGINT) RETURNS STRING": f"CASE WHEN n < 1024 THEN concat(CAST(n AS STRING), ' B') {_UNITS} ELSE concat(CAST(CAST(bround(n / {1024.0 ** 5!r}D, 1) AS DECIMAL(38,1)) AS STRING), ' PB') END",
    "mime_to_type(mime STRING) RETURNS STRING": f"CASE mime {_MIME} ELSE 'unknown' END",
    "is_program(name STRING) RETURNS BOOLEAN": f"name RLIKE r'(?i)\\.(?:{_PROGRAM})$'",
    "risk_tier(score INT) RETURNS STRING": "CASE WHEN score = 0 THEN 'safe' WHEN score < 40 THEN 'low' WHEN score < 70 THEN 'medium' ELSE 'high' END",
    "content_sha256(content BINARY) RETURNS STRING": "sha2(content, 256)",
}


def register(spark: SparkSession) -> list[str]:
    """Creates the temporary functions; returns their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
