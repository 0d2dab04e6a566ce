"""Calls of language-model providers, at DataFrame scale. The completion function is the caller's; keys are read where it runs.

Error classes, backoff, prompts and parsing of answers are expressions; retries and fallbacks run in one Arrow stage that returns the
whole trail of attempts.
"""

from __future__ import annotations

import os
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETRYABLE = ("rate_limit", "server_error", "network", "unknown")
# Environment variables with providers' keys.
ENV_KEYS = {"openai": "OPENAI_API_KEY", "anthropic": "ANTHROPIC_API_KEY", "gemini": "GOOGLE_API_KEY", "google": "GOOGLE_API_KEY", "mistral": "MISTRAL_API_KEY", "cohere": "COHERE_API_KEY", "groq": "GROQ_API_KEY", "together": "TOGETHER_API_KEY", "azure": "AZURE_API_KEY"}
# Labels of the classification.
LABELS = ["invoice", "legal contract", "financial report", "resume / CV", "research paper", "technical documentation", "news article", "email", "meeting notes", "presentation", "spreadsheet data", "code", "medical document", "receipt", "other"]
# Which parts of a class name or message mean which kind of error, in order; a tuple needs all of its parts.
_KINDS = [
    ("rate_limit", ["ratelimit", "rate_limit"], ["429", "rate limit"]),
    ("auth", ["autherror", "authenticationerror"], ["401", "403"]),
    ("context_length", ["contextwindow", "contextlength"], [("context", "length")]),
    ("invalid_request", ["badrequest"], ["400", ("invalid", "model")]),
    ("server_error", ["serviceunavailable"], ["500", "502", "503", "504"]),
    ("network", ["connect"], ["connection", "timeout", "network"]),
]


def classify_error(name: str, message: str) -> str:
    name, message = name.lower(), message.lower()
    for kind, in_name, in_message in _KINDS:
        if any(x in name for x in in_name) or any(all(p in message for p in ([x] if isinstance(x, str) else x)) for x in in_message):
            return kind
    return "unknown"


def error_kind(name: Column, message: Column) -> Column:
    """classify_error as an expression."""
    name, message = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(message, F.lit("")))
    out = None
    for kind, in_name, in_message in _KINDS:
        test = F.lit(False)
        for x in in_name:
            test = test | F.contains(name, F.lit(x))
        for x in in_message:
            every = F.lit(True)
            for p in [x] if isinstance(x, str) else x:
                every = every & F.contains(message, F.lit(p))
            test = test | every
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("unknown")


def backoff(attempt: Column, base: float = 1.0, cap: float = 30.0, jitter: bool = False) -> Column:
    """Seconds before the next attempt (0-based): min(cap, base * 2^attempt), or a random part of it."""
    capped = F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), attempt))
    return F.rand() * capped if jitter else capped


@dataclass
class RetryPolicy:
    max_attempts: int = 3
    base_delay: float = 1.0
    max_delay: float = 30.0
    jitter: bool = True
    retryable: tuple[str, ...] = RETRYABLE

    def wait_time(self, attempt: int) -> float:
        capped = min(self.max_delay, self.base_delay * 2**attempt)
        return random.uniform(0, capped) if self.jitter else capped


@dataclass
class Provider:
    """One provider and those to fall back on. A key given here stays out of plans and logs: it is never a literal or a column."""

    provider: str = "openai"
    model: str = "gpt-4o-mini"
    api_key: str | None = field(default=None, repr=False)
    max_tokens: int = 1024
    temperature: float = 0.1
    fallbacks: list[Provider] = field(default_factory=list)
    retry: RetryPolicy = field(default_factory=RetryPolicy)

    def key(self) -> str | None:
        return self.api_key or os.environ.get(ENV_KEYS.get(self.provider.lower(), ""))

    @property
    def routed_model(self) -> str:
        p = {"google": "gemini"}.get(self.provider.lower(), self.provider.lower())
        return f"{p}/{self.model}" if p in ("gemini", "anthropic", "ollama", "groq") and "/" not in self.model else self.model

    @property
    def display_name(self) -> str:
        return f"{self.provider}/{self.model}"


Completion = Callable[..., str]


def _one_provider(prompt: str, system: str, p: Provider, trail: list[dict], fallback: bool, complete: Completion, sleep) -> str | None:
    for attempt in range(1, p.retry.max_attempts + 1):
        wait = p.retry.wait_time(attempt - 2) if attempt > 1 else 0.0
        if wait:
            sleep(wait)
        began = time.perf_counter()
        entry = {"provider": p.provider, "model": p.model, "attempt_number": attempt, "error_kind": None, "error_message": None, "wait_before_ms": wait * 1000, "succeeded": False, "is_fallback": fallback}
        trail.append(entry)
        try:
            answer = complete(model=p.routed_model, system=system, prompt=prompt, max_tokens=p.max_tokens, temperature=p.temperature, api_key=p.key()) or ""
            entry |= {"succeeded": True, "duration_ms": (time.perf_counter() - began) * 1000}
            return answer
        except Exception as e:  # whatever the client raises is classified
            kind = classify_error(type(e).__name__, str(e))
            entry |= {"error_kind": kind, "error_message": str(e)[:200], "duration_ms": (time.perf_counter() - began) * 1000}
            if kind == "context_length" and attempt == 1:
                prompt = prompt[: int(len(prompt) * 0.7)]
            elif kind not in p.retry.retryable:
                return None
    return None


def orchestrate(prompt: str, system: str, config: Provider, complete: Completion, sleep=time.sleep) -> dict:
    """The answer of the first provider that gives one, with all attempts. Never raises."""
    began, trail = time.perf_counter(), []
    for i, p in enumerate([config, *config.fallbacks]):
        answer = _one_provider(prompt, system, p, trail, i > 0, complete, sleep)
        if answer is not None:
            return {"value": answer, "success": True, "provider_used": p.display_name, "attempts": trail, "total_duration_ms": round((time.perf_counter() - began) * 1000, 1), "error": None}
    tried = ", ".join(dict.fromkeys(f"{a['provider']}/{a['model']}" for a in trail))
    error = f"All AI providers failed after {len(trail)} total attempt(s). Tried: {tried}. Check your API keys and network connection. See .attempts for the full error log."
    return {"value": None, "success": False, "provider_used": None, "attempts": trail, "total_duration_ms": round((time.perf_counter() - began) * 1000, 1), "error": error}


ATTEMPT = "struct<provider:string,model:string,attempt_number:int,error_kind:string,error_message:string,duration_ms:double,wait_before_ms:double,succeeded:boolean,is_fallback:boolean>"
_ATTEMPT = pa.struct([("provider", pa.string()), ("model", pa.string()), ("attempt_number", pa.int32()), ("error_kind", pa.string()), ("error_message", pa.string()), ("duration_ms", pa.float64()), ("wait_before_ms", pa.float64()), ("succeeded", pa.bool_()), ("is_fallback", pa.bool_())])


def call(df: DataFrame, prompt: Column, system: str, config: Provider, complete: Completion, sleep=time.sleep) -> DataFrame:
    """Adds value, success, provider_used, attempts, total_duration_ms, error, used_fallback and retry_count to every row."""
    ready = df.withColumn("_prompt", prompt)
    added = [("value", pa.string()), ("success", pa.bool_()), ("provider_used", pa.string()), ("attempts", pa.list_(_ATTEMPT)), ("total_duration_ms", pa.float64()), ("error", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [orchestrate(p or "", system, config, complete, sleep) for p in batch.column("_prompt").to_pylist()]
            names = [n for n in batch.schema.names if n != "_prompt"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array([g[n] for g in got], t) for n, t in added)], names=[*names, *(n for n, _ in added)])

    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    out = ready.mapInArrow(run, f"{carried}, value string, success boolean, provider_used string, attempts array<{ATTEMPT}>, total_duration_ms double, error string")
    return out.withColumn("used_fallback", used_fallback(F.col("attempts"))).withColumn("retry_count", retry_count(F.col("attempts")))


def used_fallback(attempts: Column) -> Column:
    return F.exists(attempts, lambda a: a["succeeded"] & a["is_fallback"])


def retry_count(attempts: Column) -> Column:
    return F.greatest(F.lit(0), F.size(attempts) - 1)


def trail(success: Column, attempts: Column, total_ms: Column, error: Column) -> Column:
    """The readable log of a call: a head line, one line an attempt, the final error."""
    whole = lambda x: F.rint(x).cast("long").cast("string")
    head = F.concat(F.lit("AI call "), F.when(success, "succeeded").otherwise("FAILED"), F.lit(" ("), whole(total_ms), F.lit("ms total)"))

    def line(a: Column) -> Column:
        name = F.concat(a["provider"], F.lit("/"), a["model"], F.when(a["is_fallback"], " [fallback]").otherwise(""), F.lit(" attempt "), a["attempt_number"].cast("string"))
        bad = F.concat(F.lit("  ✗ "), name, F.lit(" ["), F.coalesce(a["error_kind"], F.lit("unknown")), F.lit("] "), F.coalesce(a["error_message"], F.lit("")))
        return F.when(a["succeeded"], F.concat(F.lit("  ✓ "), name, F.lit(" ("), whole(a["duration_ms"]), F.lit("ms)"))).otherwise(bad)

    last = F.when(error.isNotNull(), F.array(F.concat(F.lit("  Final error: "), error))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(head), F.transform(attempts, line), last), "\n")


def raise_if_failed(df: DataFrame) -> DataFrame:
    """The rows of ``call``; reading one that failed raises its error."""
    return df.withColumn("success", F.when(F.col("success"), F.lit(True)).otherwise(F.raise_error(F.coalesce("error", F.lit("AI call failed"))).cast("boolean")))


def strip_fences(answer: Column) -> Column:
    """An answer without code fences around it."""
    return F.trim(F.regexp_replace(answer, r"```(?:json)?\s*|\s*```", ""))


def classify_prompt(text: Column, labels: list[str] | None = None) -> Column:
    listed = "\n".join(f"- {x}" for x in labels or LABELS)
    ask = f'Choose the category of this document.\n\n{listed}\n\nAnswer with JSON only: {{"label": "<one of the list>", "confidence": "<high|medium|low>", "reasoning": "<one sentence>"}}\n\nDocument:\n'
    return F.concat(F.lit(ask), F.substring(F.coalesce(text, F.lit("")), 1, 2000))


def parse_classification(answer: Column) -> Column:
    """struct(label, confidence, reasoning); an answer that isn't JSON is unknown, with low confidence."""
    got = F.from_json(strip_fences(answer), "label string, confidence string, reasoning string", {"mode": "PERMISSIVE"})
    fallback = F.struct(F.lit("unknown").alias("label"), F.lit("low").alias("confidence"), F.substring(answer, 1, 200).alias("reasoning"))
    return F.when(got["label"].isNotNull(), got).otherwise(fallback)


def classify_content(df: DataFrame, text_col: str, config: Provider, complete: Completion, labels: list[str] | None = None, **names) -> DataFrame:
    out = call(df, classify_prompt(F.col(text_col), labels), "You classify documents. Answer with valid JSON only.", config, complete, **names)
    return out.withColumn("classification", F.when(F.col("success"), parse_classification(F.col("value"))))


def extract_structured(df: DataFrame, text_col: str, schema: dict[str, str], config: Provider, complete: Completion, strict: bool = False, **names) -> DataFrame:
    """fields: map of the schema's keys to answers (null where missing); parse_error if the answer isn't a JSON object. ``strict`` raises for missing fields."""
    listed = "\n".join(f"  - {k}: {v}" for k, v in schema.items())
    ask = f"Extract these fields from the document:\n\n{listed}\n\nAnswer with one JSON object with exactly these keys: {list(schema)}; null for missing ones.\n\nDocument:\n"
    out = call(df, F.concat(F.lit(ask), F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, 4000)), "You extract data. Answer with valid JSON only.", config, complete, **names)
    got = F.from_json(strip_fences(F.col("value")), "map<string,string>")
    out = out.withColumn("_got", F.when(F.col("success"), got)).withColumn("parse_error", F.col("success") & F.col("_got").isNull())
    fields = F.create_map(*[x for k in schema for x in (F.lit(k), F.try_element_at(F.col("_got"), F.lit(k)))])
    missing = F.filter(F.array(*[F.lit(k) for k in schema]), lambda k: F.try_element_at(F.col("_got"), k).isNull())
    if strict:
        fields = F.when(F.size(missing) > 0, F.raise_error(F.concat(F.lit("Required fields missing from extraction: "), F.array_join(missing, ", ")))).otherwise(fields)
    return out.withColumn("fields", F.when(F.col("_got").isNotNull(), fields)).drop("_got")


def clean_document(df: DataFrame, text_col: str, config: Provider, complete: Completion, instructions: str | None = None, **names) -> DataFrame:
    """value is the cleaned text."""
    extra = f" {instructions}" if instructions else ""
    ask = f"Remove page headers, footers, page numbers, watermarks and menus from this document and mend its line breaks. Keep all content, tables and structure.{extra}\n\nDocument:\n"
    return call(df, F.concat(F.lit(ask), F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, 6000)), "You clean documents. Answer with the cleaned text only.", config, complete, **names)


def semantic_similarity(df: DataFrame, a: str, b: str, config: Provider, complete: Completion, **names) -> DataFrame:
    """similarity: struct(score, verdict, reasoning); an answer that isn't JSON scores 0.0, unknown."""
    part = lambda c: F.substring(F.coalesce(F.col(c), F.lit("")), 1, 1500)
    ask = 'Compare the meaning of two excerpts. Answer with JSON only: {"score": <0.0 to 1.0>, "verdict": "<identical|highly similar|related|different>", "reasoning": "<one sentence>"}\n\nA:\n'
    out = call(df, F.concat(F.lit(ask), part(a), F.lit("\n\nB:\n"), part(b)), "You compare documents. Answer with valid JSON only.", config, complete, **names)
    got = F.from_json(strip_fences(F.col("value")), "score double, verdict string, reasoning string")
    fine = F.struct(F.coalesce(got["score"], F.lit(0.0)).alias("score"), F.coalesce(got["verdict"], F.lit("unknown")).alias("verdict"), F.coalesce(got["reasoning"], F.lit("")).alias("reasoning"))
    poor = F.struct(F.lit(0.0).alias("score"), F.lit("unknown").alias("verdict"), F.substring("value", 1, 200).alias("reasoning"))
    return out.withColumn("similarity", F.when(F.col("success"), F.when(got["score"].isNotNull() | got["verdict"].isNotNull(), fine).otherwise(poor)))
