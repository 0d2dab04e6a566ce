"""URLs with their responses: inspection by HEAD, text by GET. Fetching is a boundary: a function that the caller gives, or a table of responses."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verisift.functions import urls
from verisift.functions.text import word_count
from verisift.operators.extract import extract_text

RESPONSE = "url string, status int, reason string, content_type string, content_length string, content_encoding string, server string, body binary, failure string"
_FIELDS = [x.split()[0] for x in RESPONSE.split(", ")]


def fetch(df: DataFrame, fetcher: Callable[[str], dict]) -> DataFrame:
    """df: url. Calls ``fetcher(url)`` on executors for URLs that can be fetched; it returns some of the response fields. Exceptions become ``failure``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url in batch.column("url").to_pylist():
                try:
                    rows.append({**dict.fromkeys(_FIELDS), **fetcher(url), "url": url})
                except Exception as e:  # one URL's failure is its own
                    rows.append({**dict.fromkeys(_FIELDS), "url": url, "failure": str(e)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("url", pa.string()), ("status", pa.int32()), *((f, pa.string()) for f in _FIELDS[2:7]), ("body", pa.binary()), ("failure", pa.string())]))

    good = df.where(F.size(urls.url_errors(F.col("url"))) == 0).select("url")
    bad = df.where(F.size(urls.url_errors(F.col("url"))) > 0).select("url", *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in RESPONSE.split(", ")[1:]])
    return good.mapInArrow(run, RESPONSE).unionByName(bad)


def inspect_urls(responses: DataFrame) -> DataFrame:
    """responses: the columns of RESPONSE. One inspection record a row."""
    c = F.col
    record = urls.inspection(c("url"), c("status"), c("reason"), c("content_type"), c("content_length"), c("content_encoding"), c("server"), c("failure"))
    return responses.select(record.alias("r")).select("r.*")


# --------------------------------------------------------------------------- HTML

# Elements that hold no content of a page.
NOISE = ["script", "style", "nav", "footer", "header", "aside", "form", "noscript", "iframe"]
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Page(HTMLParser):
    """Texts with their places in the element tree, outside noise, and title and description."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, dict]] = []
        self.texts: list[tuple[tuple[int, ...], str]] = []
        self.marks: dict[str, int] = {}
        self.serial, self.path = 0, []
        self.title, self.description = None, None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and a.get("name") == "description" and self.description is None:
            self.description = a.get("content", "")
        if tag in _VOID:
            return
        self.serial += 1
        self.stack.append((tag, a))
        self.path.append(self.serial)
        if not self._noise():
            for key, hit in (("main", tag == "main"), ("article", tag == "article"), ("#content", a.get("id") == "content"), ("#main-content", a.get("id") == "main-content"), (".content", "content" in a.get("class", "").split()), ("body", tag == "body")):
                if hit:
                    self.marks.setdefault(key, self.serial)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:], self.path[i:]
                break

    def _noise(self) -> bool:
        return any(t in NOISE for t, _ in self.stack)

    def handle_data(self, data):
        if any(t == "title" for t, _ in self.stack) and self.title is None and data.strip():
            self.title = data.strip()
        if data.strip() and not self._noise():
            self.texts.append((tuple(self.path), data.strip()))


def main_text(html: str) -> dict:
    """text of the main content area, title, description."""
    page = _Page()
    page.feed(html)
    page.close()
    root = next((page.marks[k] for k in ("main", "article", "#content", "#main-content", ".content", "body") if k in page.marks), None)
    text = "\n".join(t for path, t in page.texts if root is None or root in path)
    return {"text": text, "title": page.title, "description": page.description}


_HTML = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "title", "description")])


@F.arrow_udf(_HTML)
def html_content(html: pa.Array) -> pa.Array:
    return pa.array([None if x is None else main_text(x) for x in html.to_pylist()], pa.struct([(n, pa.string()) for n in ("text", "title", "description")]))


def extract_urls(responses: DataFrame, *, max_chars: int = 0) -> DataFrame:
    """responses: the columns of RESPONSE with bodies. HTML (or no type) goes the HTML way, anything else the way of files."""
    bad = urls.url_errors(F.col("url"))
    mime = F.lower(F.trim(F.get(F.split(F.coalesce("content_type", F.lit("")), ";"), 0)))
    failed = F.when(F.size(bad) > 0, bad).otherwise(F.array_compact(F.array(F.concat(F.lit("Fetch failed: "), F.col("failure")), F.when(F.col("failure").isNull() & (F.col("status") >= 400), F.concat(F.lit("HTTP "), F.col("status").cast("string"), F.lit(": "), F.coalesce("reason", F.lit("")))))))
    rows = responses.withColumn("errors", failed).withColumn("mime", mime).withColumn("content", F.when(F.size("errors") == 0, F.col("body")))
    is_html = F.contains(F.col("mime"), F.lit("text/html")) | (F.col("mime") == "")
    kind = F.when(F.size("errors") > 0, "unknown").when(is_html, "html").otherwise(urls.mime_to_type(F.col("mime")))
    rows = rows.withColumn("real_type", kind).withColumn("page", html_content(F.when((F.col("real_type") == "html") & (F.size("errors") == 0), F.make_valid_utf8(F.col("content").cast("string")))))
    suffix = F.when(F.col("real_type").isin("pdf", "docx", "xlsx", "pptx", "csv", "json", "xml", "txt", "epub"), F.concat(F.lit("body."), F.col("real_type"))).otherwise("body.bin")
    files = rows.withColumn("path", suffix)
    got = extract_text(files, "url", "errors", "mime", "real_type", "page", "content", max_chars=max_chars)
    page = F.col("page").isNotNull()
    whole = F.coalesce(F.col("page.text"), F.lit(""))
    text = F.when(F.size("errors") > 0, "").when(page, F.substring(whole, 1, max_chars) if max_chars else whole).otherwise(F.col("text"))
    cut = F.when(page & (F.length(whole) > max_chars), F.lit(f"Text truncated at {max_chars} characters")) if max_chars else F.lit(None).cast("string")
    return got.select(
        "url", text.alias("text"), F.col("page.title").alias("title"), F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("date"), F.col("page.description").alias("description"),
        "real_type", "mime", F.coalesce(F.length("content"), F.lit(0)).alias("size_bytes"), F.length(text).alias("char_count"), word_count(text).alias("word_count"),
        F.when(F.size("errors") > 0, "").when(page, "html-parser").otherwise(F.col("extractor")).alias("extractor"),
        F.when(page, F.array_compact(F.array(cut))).when(F.size("errors") > 0, F.array().cast("array<string>")).otherwise(F.col("warnings")).alias("warnings"), "errors",
        (urls.has_text(text) & (F.size("errors") == 0)).alias("valid"),
    )
