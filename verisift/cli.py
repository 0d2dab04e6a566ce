"""Command line: analyze, validate, type, tokens and url over one path or URL, on a local session."""

from __future__ import annotations

import argparse
import json
import os
import sys
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verisift.operators.identity import analyze
from verisift.operators.web import RESPONSE, inspect_urls
from verisift.sources.files import load_files
from verisift.sources.session import ship

COLORS = {"green": "32", "yellow": "33", "red": "31"}


def session() -> SparkSession:
    spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def one_file(spark: SparkSession, path: str) -> DataFrame:
    """The file, or a row with the guard's message."""
    message = None
    if not os.path.exists(path):
        message = f"File not found: {path}"
    elif not os.path.isfile(path):
        message = f"Path is not a file: {path}"
    elif not os.access(path, os.R_OK):
        message = f"File is not readable: {path}"
    if message:
        return spark.createDataFrame([(path, 0, None, message)], "path string, length long, content binary, missing string")
    return load_files(spark, "file://" + os.path.abspath(path)).withColumn("path", F.lit(path)).withColumn("missing", F.lit(None).cast("string"))


def result_of(spark: SparkSession, path: str, skip_metadata: bool = False) -> dict:
    row = analyze(one_file(spark, path), skip_metadata=skip_metadata).first().asDict(recursive=True)
    meta = row.pop("metadata") or {}
    row.pop("error")
    return row | {"metadata": {k: v for k, v in meta.items() if v is not None}}


def paint(text: str, color: str) -> str:
    return f"\x1b[{COLORS[color]}m{text}\x1b[0m" if sys.stdout.isatty() else text


def echo(text: str = "") -> None:
    """Terminals without Unicode get a question mark for what they lack."""
    try:
        print(text)
    except UnicodeEncodeError:
        print(text.encode("ascii", "replace").decode())


def pretty(r: dict) -> None:
    m = r["metadata"]
    echo(paint(f"{'[OK]' if r['valid'] else '[FAIL]'} {r['real_type'].upper()}", "green" if r["valid"] else "red"))
    echo()
    for key in ("pages", "slides", "paragraphs", "sheets"):
        if key in m:
            echo(f"{key.capitalize() + ':':<14}{m[key]}")
    if "duration" in m:
        echo(f"Duration:     {m['duration']}s")
    if "width" in m and "height" in m:
        echo(f"Dimensions:   {m['width']}x{m['height']}")
    if "language" in m:
        echo(f"Language:     {m['language']}")
    for key in ("tables", "images"):
        if m.get(f"contains_{key}"):
            echo(f"Contains {key}")
    echo(f"Size:         {r['size_human']}")
    if "estimated_tokens" in m:
        n = m["estimated_tokens"]
        echo(f"Tokens:       {f'{n / 1000:.1f}k' if n >= 1000 else n}")
    score = r["risk_score"]
    echo(f"Risk Score:   {paint(str(score), 'green' if score == 0 else 'yellow' if score < 50 else 'red')}")
    echo(f"MIME:         {r['mime']}")
    echo(f"Ext match:    {paint('yes', 'green') if r['extension_matches'] else paint('no', 'red')}  ({r['extension']!r} declared)")
    for w in r["warnings"]:
        echo(paint(f"[WARN]  {w}", "yellow"))
    for e in r["errors"]:
        echo(paint(f"[FAIL]  {e}", "red"))


def head(url: str, timeout: int = 10) -> dict:
    """HEAD request; redirects are followed."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=timeout) as r:
            h = r.headers
            return {"status": r.status, "reason": r.reason, "content_type": h.get("Content-Type"), "content_length": h.get("Content-Length"), "content_encoding": h.get("Content-Encoding"), "server": h.get("Server")}
    except urllib.error.HTTPError as e:
        return {"status": e.code, "reason": e.reason}


def inspect_one(spark: SparkSession, url: str, fetcher=head) -> dict:
    names = [x.split()[0] for x in RESPONSE.split(", ")]
    response = {"url": url}
    if url.lower().startswith(("http://", "https://")):
        try:
            response |= fetcher(url)
        except Exception as e:  # the record says what failed
            response["failure"] = str(e)
    row = spark.createDataFrame([tuple(response.get(n) for n in names)], RESPONSE)
    return inspect_urls(row).first().asDict(recursive=True)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="verisift", description="What a file really is.")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, text in (("analyze", "full report of a file"), ("validate", "exit code 0 for a valid file, 1 otherwise"), ("type", "the detected type"), ("tokens", "estimated tokens"), ("url", "inspect a URL")):
        p = commands.add_parser(name, help=text)
        p.add_argument("target")
        if name in ("analyze", "url"):
            p.add_argument("--pretty", action="store_true", help="readable output")
        if name == "analyze":
            p.add_argument("--no-metadata", action="store_true", help="skip metadata")
    args = parser.parse_args(argv)
    spark = session()
    if args.command == "analyze":
        r = result_of(spark, args.target, args.no_metadata)
        pretty(r) if args.pretty else echo(json.dumps(r, indent=2, default=str))
    elif args.command == "validate":
        r = result_of(spark, args.target, True)
        echo("valid" if r["valid"] else "invalid")
        for e in r["errors"]:
            echo(paint(f"  - {e}", "red"))
        return 0 if r["valid"] else 1
    elif args.command == "type":
        echo(result_of(spark, args.target, True)["real_type"])
    elif args.command == "tokens":
        echo(str(result_of(spark, args.target)["metadata"].get("estimated_tokens", 0)))
    else:
        r = inspect_one(spark, args.target)
        if args.pretty:
            for k in ("url", "valid", "status_code", "mime", "real_type", "size_human"):
                echo(f"{k + ':':<14}{r[k]}")
        else:
            echo(json.dumps(r, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
