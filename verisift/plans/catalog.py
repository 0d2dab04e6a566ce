"""The engine's registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verisift.functions import exif as fx
from verisift.functions import pii, rules, text, urls
from verisift.operators import ai, chunk, dedup, diff, exif, identity
from verisift.operators.extract import extract_text
from verisift.operators.web import extract_urls, inspect_urls
from verisift.plans import fixtures, oracle
from verisift.sources.files import text_as_files
from verisift.sources.session import ship, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Extension that document ``doc_id`` declares: the entry at doc_id modulo their number.
EXTENSIONS = ["txt", "md", "csv", "json", "pdf", "text", ""]


def query(name: str, sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(lambda t: table(spark, sf_dir, t), spark)

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def declared_name():
    ext = F.get(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % len(EXTENSIONS)).cast("int"))
    return F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(F.lit("")))


def document_files(t) -> DataFrame:
    return text_as_files(t("documents"), "text", declared_name(), "doc_id")


def results(t, **names) -> DataFrame:
    return identity.analyze(document_files(t), keep=("doc_id",), **names)


# --------------------------------------------------------------------------- hashes and duplicates

@query("content_hash", oracle.CONTENT_HASH)
def _(t, spark):
    h = dedup.content_hash(F.col("content"))
    return document_files(t).select("doc_id", h.alias("h")).select("doc_id", "h.*", dedup.short_hash(F.col("h.sha256")).alias("short"))


@query("find_duplicates", oracle.FIND_DUPLICATES)
def _(t, spark):
    return dedup.find_duplicates(document_files(t), order="doc_id")


@query("duplicate_keep_delete", oracle.KEEP_DELETE)
def _(t, spark):
    return dedup.keep_first(document_files(t), order="doc_id").withColumnRenamed("ord", "doc_id")


@query("wasted_bytes_total", oracle.WASTED)
def _(t, spark):
    return dedup.wasted_bytes(document_files(t))


# --------------------------------------------------------------------------- text

@query("text_metadata", oracle.TEXT_METADATA)
def _(t, spark):
    m = text.text_metadata(F.coalesce("text", F.lit("")))
    return t("documents").select("doc_id", *[m[k].alias(k) for k in ("characters", "lines", "words", "estimated_tokens")])


@query("token_estimate_by_lang", oracle.TOKENS_BY_LANG)
def _(t, spark):
    return t("documents").groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(text.token_estimate(F.col("text"))).alias("tokens"))


@query("conversation_tokens", oracle.CONVERSATION_TOKENS)
def _(t, spark):
    return t("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(text.token_estimate(F.col("text"))).alias("tokens"))


@query("human_size", oracle.HUMAN_SIZE)
def _(t, spark):
    scaled = F.octet_length("text").cast("long") * F.pow(F.lit(7.0), F.col("doc_id") % 16).cast("long")
    return t("documents").select("doc_id", scaled.alias("n")).select("doc_id", "n", text.human_size(F.col("n")).alias("size_human"))


@query("language_guess", oracle.LANGUAGE)
def _(t, spark):
    return t("documents").select("doc_id", text.language(F.col("text")).alias("language"))


# --------------------------------------------------------------------------- personal data

@query("pii_raw_counts", oracle.PII_RAW)
def _(t, spark):
    def counted(name):
        return t(name).select(F.lit(name).alias("source_table"), *[c.alias(k) for k, c in pii.raw_counts(F.col("html" if name == "pages" else "text")).items()])

    rows = counted("documents").unionByName(counted("pages")).unionByName(counted("conversations"))
    return rows.groupBy("source_table").agg(*[F.sum(k).cast("long").alias(k) for k, _, _ in rules.PII_PATTERNS])


@query("pii_matches", oracle.PII_MATCHES)
def _(t, spark):
    return pii.explode_pii(t("documents"), "text", "doc_id").withColumnRenamed("start", "start_").withColumnRenamed("end", "end_")


@query("pii_types", oracle.PII_TYPES)
def _(t, spark):
    return pii.with_pii(t("documents").select("doc_id", "text"), "text", redacted=False).select("doc_id", "has_pii", F.col("pii_count").cast("long").alias("pii_count"), F.array_join("types_found", ",").alias("types_found"))


@query("pii_redact", oracle.PII_REDACT)
def _(t, spark):
    return pii.with_pii(t("documents").select("doc_id", "text"), "text").select("doc_id", F.sha2(F.coalesce("redacted_text", F.lit("")), 256).alias("redacted_sha256"), F.length("redacted_text").alias("redacted_chars"))


@query("pii_by_source", oracle.PII_BY_SOURCE)
def _(t, spark):
    return pii.explode_pii(t("documents"), "text", "source").groupBy("source", "pii_type").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------- types, validity, risk

@query("detect_type_documents", oracle.DETECT_DOCUMENTS)
def _(t, spark):
    return identity.with_type(document_files(t)).select("doc_id", "extension", "real_type", "mime")


@query("detect_type_pages", oracle.DETECT_PAGES)
def _(t, spark):
    files = text_as_files(t("pages"), "html", F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html")), "page_id")
    return identity.with_type(files).select("page_id", "real_type", "mime")


@query("detect_type_events", oracle.DETECT_EVENTS)
def _(t, spark):
    files = text_as_files(t("events"), "props", F.concat(F.lit("event_"), F.col("event_id").cast("string"), F.lit(".json")), "event_id")
    return identity.with_type(files).groupBy("real_type", "mime").agg(F.count(F.lit(1)).alias("files"))


@query("type_histogram", oracle.TYPE_HISTOGRAM)
def _(t, spark):
    return identity.with_type(document_files(t)).groupBy("real_type", "mime").agg(F.count(F.lit(1)).alias("files"))


@query("extension_check", oracle.EXTENSION_CHECK)
def _(t, spark):
    return results(t, skip_metadata=True).select("doc_id", "extension", "real_type", "extension_matches", F.array_join("errors", "; ").alias("errors"))


@query("risk_score", oracle.RISK_SCORE)
def _(t, spark):
    return results(t, skip_metadata=True).select("doc_id", "valid", "risk_score", F.array_join("warnings", "; ").alias("warnings"))


@query("analyze_text", oracle.ANALYZE)
def _(t, spark):
    r = results(t)
    return r.select("doc_id", "path", "valid", "real_type", "mime", "extension", "extension_matches", "size_bytes", "size_human", "risk_score", "metadata.characters", "metadata.lines", "metadata.words", "metadata.estimated_tokens")


@query("validate_text", oracle.VALIDATE)
def _(t, spark):
    return identity.validate(document_files(t), keep=("doc_id",)).select("doc_id", "valid", "real_type", "risk_score", F.size("errors").alias("n_errors"))


@query("risk_tiers", oracle.RISK_TIERS)
def _(t, spark):
    return results(t, skip_metadata=True).groupBy(identity.risk_tier(F.col("risk_score")).alias("tier")).agg(F.count(F.lit(1)).alias("files"))


@query("high_risk", oracle.HIGH_RISK)
def _(t, spark):
    return results(t, skip_metadata=True).where("risk_score > 50").select("doc_id", "path", "risk_score")


@query("upload_gate", oracle.UPLOAD_GATE)
def _(t, spark):
    return identity.upload_gate(results(t, skip_metadata=True), ["txt", "md", "csv"]).select("doc_id", "accepted", "reason")


@query("rag_preflight", oracle.RAG_PREFLIGHT)
def _(t, spark):
    return identity.rag_preflight(results(t), 100_000).select("doc_id", "metadata.estimated_tokens")


@query("batch_summary", oracle.BATCH_SUMMARY)
def _(t, spark):
    return identity.batch_summary(results(t, skip_metadata=True))


@query("folder_scan", oracle.FOLDER_SCAN)
def _(t, spark):
    r = results(t, skip_metadata=True)
    return r.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("risk_score") > 0).alias("at_risk"), F.max("risk_score").alias("highest"))


@query("type_rollup", oracle.TYPE_ROLLUP)
def _(t, spark):
    r = results(t, skip_metadata=True).withColumn("tier", identity.risk_tier(F.col("risk_score")))
    return r.rollup("real_type", "tier").agg(F.count(F.lit(1)).alias("files"))


@query("result_summary")
def _(t, spark):
    r = results(t)
    return r.select("doc_id", identity.summary(r).alias("summary"), identity.metadata_json(F.col("metadata")).alias("metadata_json"))


# --------------------------------------------------------------------------- files of every format

def fixture_files(spark) -> DataFrame:
    """The small files of ``fixtures``, whose expected results are known: PDF, Office, images, audio, video, archives, text, and broken ones."""
    return spark.createDataFrame([(name, len(data), bytearray(data)) for name, data in fixtures.fixture_files().items()], "path string, length bigint, content binary")


@query("fixture_records", oracle.FIXTURE_RECORDS)
def _(t, spark):
    r = identity.analyze(fixture_files(spark))
    first_line = F.substring_index(identity.summary(r), "\n", 1)
    return r.select("path", "valid", "real_type", "extension", "extension_matches", "risk_score", F.size("errors").alias("n_errors"), F.array_join("warnings", "; ").alias("warnings"), first_line.alias("summary"))


@query("fixture_metadata", oracle.FIXTURE_METADATA)
def _(t, spark):
    r = identity.analyze(fixture_files(spark))
    return r.select("path", F.explode(F.from_json(identity.metadata_json(F.col("metadata")), "map<string,string>")).alias("name", "value")).where("name not in ('language', 'inspection_error')")


@query("fixture_text", oracle.FIXTURE_TEXT)
def _(t, spark):
    shown = F.when(F.col("text").rlike("[\\x00-\\x08\\x{FFFD}]"), "binary").otherwise(F.translate("text", "\n", "|"))
    return extract_text(identity.with_type(fixture_files(spark)), "path").select("path", shown.alias("text"), "extractor")


@query("exif_records", oracle.EXIF_RECORDS)
def _(t, spark):
    e = exif.extract_exif(fixture_files(spark).where("path like '%.jpg'"))
    fields = ["camera_make", "camera_model", "shutter_speed", "aperture", "iso", "focal_length", "gps.latitude", "gps.longitude", "gps.altitude"]
    return e.select("path", *[F.col(f"exif.{f}") for f in fields], "has_gps", "maps_url")


# --------------------------------------------------------------------------- chunks and differences

def _chunks(strategy, **names):
    def run(t, spark):
        return chunk.chunk_rows(t("documents"), "text", "doc_id", strategy=strategy, **names).withColumn("text", F.sha2("text", 256)).withColumnRenamed("text", "text_sha256")

    return run


query("chunk_fixed", oracle.CHUNK_FIXED)(_chunks("fixed"))
query("chunk_sentence", oracle.CHUNK_SENTENCE)(_chunks("sentence"))
query("chunk_paragraph", oracle.CHUNK_PARAGRAPH)(_chunks("paragraph"))
query("chunk_semantic", oracle.CHUNK_SEMANTIC)(_chunks("semantic"))


def document_pairs(t) -> DataFrame:
    """Each document with the one whose id follows."""
    d = t("documents").select("doc_id", "text")
    left, right = d.select(F.col("doc_id").alias("path_a"), F.col("text").alias("text_a"), (F.col("doc_id") + 1).alias("path_b")), d.select(F.col("doc_id").alias("path_b"), F.col("text").alias("text_b"))
    return left.join(right, "path_b")


@query("diff_documents")
def _(t, spark):
    return diff.diff_pairs(document_pairs(t))


@query("diff_identity", oracle.DIFF_IDENTITY)
def _(t, spark):
    return diff.diff_pairs(document_pairs(t)).select("path_a", "path_b", "identical")


# --------------------------------------------------------------------------- URLs and HTML

@query("url_validate", oracle.URL_VALIDATE)
def _(t, spark):
    p = t("pages")
    bad = F.when(F.col("page_id") % 5 == 1, F.concat(F.lit("ftp://"), F.substring("url", 8, 500))).when(F.col("page_id") % 5 == 2, F.lit("https:///path")).when(F.col("page_id") % 5 == 3, F.upper("url")).otherwise(F.col("url"))
    return p.select("page_id", bad.alias("url")).select("page_id", "url", F.array_join(urls.url_errors(F.col("url")), "; ").alias("errors"), urls.scheme_of(F.col("url")).alias("scheme"))


def _responses(t) -> DataFrame:
    """Responses that page ids fix: a status, a type, and the page as body."""
    kinds = F.get(F.array(*[F.lit(x) for x in ("text/html; charset=utf-8", "application/pdf", "image/PNG", "", "text/csv ; header=present")]), (F.col("page_id") % 5).cast("int"))
    status = F.when(F.col("page_id") % 7 == 3, 404).otherwise(200)
    return t("pages").select(
        "url", status.alias("status"), F.when(status == 404, "Not Found").otherwise("OK").alias("reason"), kinds.alias("content_type"), F.octet_length("html").cast("string").alias("content_length"),
        F.lit(None).cast("string").alias("content_encoding"), F.lit("nginx").alias("server"), F.col("html").cast("binary").alias("body"), F.lit(None).cast("string").alias("failure"), "page_id",
    )


@query("url_inspect", oracle.URL_INSPECT)
def _(t, spark):
    return inspect_urls(_responses(t)).select("url", "valid", "mime", "real_type", "size_bytes", "size_human", "status_code", F.array_join("warnings", "; ").alias("warnings"), F.array_join("errors", "; ").alias("errors"))


@query("url_extract")
def _(t, spark):
    return extract_urls(_responses(t))


@query("mime_to_type", oracle.MIME_TO_TYPE)
def _(t, spark):
    names = [*rules.MIME_TYPE, "audio/mp4", "text/xml", "audio/x-wav", "TEXT/HTML", ""]
    return spark.createDataFrame([(n,) for n in names], "mime string").select("mime", urls.mime_to_type(F.col("mime")).alias("real_type"))


@query("html_text", oracle.HTML_TEXT)
def _(t, spark):
    files = text_as_files(t("pages"), "html", F.lit("page.html"), "page_id").withColumn("real_type", F.lit("html"))
    return extract_text(files, "page_id").select("page_id", F.sha2("text", 256).alias("text_sha256"), F.col("char_count").cast("long").alias("char_count"), "word_count")


@query("html_title", oracle.HTML_TITLE)
def _(t, spark):
    return t("pages").select("page_id", urls.html_title(F.col("html")).alias("title"))


@query("extract_truncated", oracle.EXTRACT_TRUNCATED)
def _(t, spark):
    files = text_as_files(t("documents"), "text", F.lit("a.txt"), "doc_id").withColumn("real_type", F.lit("txt"))
    return extract_text(files, "doc_id", max_chars=500).select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.col("char_count").cast("long").alias("char_count"), "truncated", "extractor")


# --------------------------------------------------------------------------- EXIF values and AI layer

@query("exif_gps_decimal", oracle.EXIF_GPS)
def _(t, spark):
    i = F.col("event_id")
    part = lambda n, d: fx.rational(n, d)
    ref = F.when(i % 3 == 0, "S").otherwise("N")
    value = fx.dms_to_decimal(part(i % 90, F.lit(1)), part(i * 7 % 60, F.lit(1)), part(i * 13 % 6000, F.when(i % 11 == 0, 0).otherwise(100)), ref)
    return t("events").select("event_id", value.alias("latitude"))


@query("shutter_format", oracle.SHUTTER)
def _(t, spark):
    n, d = F.col("event_id") % 7, F.col("event_id") * 11 % 250 + 1
    return t("events").select("event_id", fx.shutter(n, d).alias("shutter"))


def _failures(t) -> DataFrame:
    """Error classes and messages that event ids fix."""
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % len(values)).cast("int"))
    return t("events").select("event_id", pick(oracle.ERROR_CLASSES).alias("name"), pick(oracle.ERROR_MESSAGES).alias("message"))


@query("llm_error_kind", oracle.ERROR_KIND)
def _(t, spark):
    return _failures(t).select("event_id", ai.error_kind(F.col("name"), F.col("message")).alias("kind"))


@query("llm_backoff", oracle.BACKOFF)
def _(t, spark):
    return t("events").select("event_id", ai.backoff((F.col("event_id") % 8).cast("double")).alias("wait"))


@query("llm_audit_summary")
def _(t, spark):
    def complete(prompt, model, **_):
        if len(prompt) % 3 == 0 or "backup" not in model and len(prompt) % 2:
            raise RuntimeError("503 service unavailable" if len(prompt) % 5 else "401 unauthorized")
        return '{"label": "other", "confidence": "high", "reasoning": "fixed"}'

    quick = ai.RetryPolicy(max_attempts=2, base_delay=0.0)
    config = ai.Provider("openai", "main", retry=quick, fallbacks=[ai.Provider("groq", "backup", retry=quick)])
    out = ai.classify_content(t("conversations").select("conv_id", "turn", "text"), "text", config, complete)
    return out.groupBy("success", "provider_used", "used_fallback", "retry_count", "classification.label").agg(F.count(F.lit(1)).alias("calls"))
