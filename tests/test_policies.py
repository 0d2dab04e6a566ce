"""One test for each decided quirk; the numbers are those of the blueprint's list."""

import hashlib

import pytest
from conftest import pdf, png, zipped
from pyspark.sql import functions as F

from verisift.functions import pii, sql, urls
from verisift.operators import ai, chunk, diff, identity, parsers
from verisift.operators.extract import extract_text
from verisift.operators.web import RESPONSE, extract_urls
from verisift.sources import heads

FILES = {
    "k1.pdf": png(), "k2.docx": b"PK\x03\x04junk", "k3.zip": zipped({"a.exe": b"MZ"}), "k4": b"words", "k5.mov": b"\0\0\0\x18ftypqt  " + b"\0" * 40, "k5.m4a": b"\0\0\0\x18ftypM4A " + b"\0" * 40,
    "k6a.txt": b"BM is how it begins", "k6b.txt": b"BZh too", "k7.json": b'{"a": "' + b"x" * 3000 + b'"}', "k8.txt": b"a, b\nc, d\n", "k9.txt": b"## one heading", "k9b.txt": b"# one heading",
    "k10.md": b"- one item", "k10.txt": b"- one item", "k11.svg": b"<svg xmlns='http://www.w3.org/2000/svg'/>", "k12.epub": zipped({"META-INF/container.xml": "<c/>"}), "k13.bin": b"\x01\x02\x00",
    "k14.txt": b"", "k15.json": b"null\n", "k15b.json": b"null", "k16.json": "﻿{}".encode(), "k23.gz": __import__("gzip").compress(b"x"), "k33.md": b"one, two\nthree, four\n", "k35.xml": b"<?xml version='1.0'?><a>", "k35.pdf": b"%PDF-1.4 nothing", "ok.pdf": pdf(),
}


@pytest.fixture(scope="module")
def both(spark):
    df = spark.createDataFrame([(k, len(v), bytearray(v)) for k, v in FILES.items()], "path string, length long, content binary")
    return tuple({r["path"]: r for r in identity.analyze(df, skip_metadata=s).collect()} for s in (False, True))


@pytest.mark.parametrize("name,path,kind,score", [
    ("K-1", "k1.pdf", "png", 70), ("K-2", "k2.docx", "zip", 100), ("K-3", "k3.zip", "zip", 80), ("K-4", "k4", "txt", 40), ("K-5", "k5.mov", "mp4", 70), ("K-5", "k5.m4a", "mp4", 70),
    ("K-6", "k6a.txt", "bmp", 100), ("K-7", "k7.json", "txt", 70), ("K-8", "k8.txt", "csv", 70), ("K-9", "k9.txt", "md", 70), ("K-9", "k9b.txt", "txt", 0), ("K-10", "k10.md", "md", 0), ("K-10", "k10.txt", "txt", 0),
    ("K-11", "k11.svg", "svg", 20), ("K-12", "k12.epub", "epub", 0), ("K-13", "k13.bin", "unknown", 70), ("K-14", "k14.txt", "unknown", 30), ("K-15", "k15.json", "txt", 70), ("K-15", "k15b.json", "json", 0),
    ("K-16", "k16.json", "txt", 70), ("K-33", "k33.md", "csv", 70), ("K-35", "k35.xml", "xml", 50), ("K-35", "k35.pdf", "pdf", 70),
])
def test_scores(both, name, path, kind, score):
    r = both[0][path]
    assert (r["real_type"], r["risk_score"]) == (kind, score), (name, r)


def test_k2_k35_without_metadata(both):
    assert (both[1]["k2.docx"]["risk_score"], both[1]["k35.pdf"]["risk_score"], both[1]["k35.xml"]["risk_score"]) == (90, 50, 50)


def test_k4_no_error_text(both):
    assert both[0]["k4"]["errors"] == [] and not both[0]["k4"]["valid"]


def test_k6_bz2(both):
    assert both[0]["k6b.txt"]["real_type"] == "bz2"


def test_k23_gz_has_no_metadata(both):
    assert all(v is None for v in both[0]["k23.gz"]["metadata"])


def test_k17_no_luhn_no_bearer(spark):
    got = spark.createDataFrame([("4111111111111112 bearer abcdefghijklmnopqrst",)], "t string").select(pii.pii_matches(F.col("t"))).first()[0]
    assert [m["pii_type"] for m in got] == ["credit_card"]


def test_k18_nested_spans(spark):
    r = pii.with_pii(spark.createDataFrame([("x https://h/a@b.co?key=1 y",)], "t string"), "t").first()
    assert r["pii_count"] == 2 and r["redacted_text"] == "x [REDACTED_URL_WITH_TOKEN] y"


def test_k19_headers_run_together():
    assert diff.compare("a\n", "b\n", "p", "q")["unified_diff"].startswith("--- p+++ q@@ -1 +1 @@-a\n")


def test_k20_diff_reads_text_only():
    assert diff.compare("", "x\n", "p", "q")["lines_added"] == 1


def test_k21_summary_words():
    assert diff.compare("a\n", "b\n", "p", "q")["summary"] == "+1 lines added, -1 lines removed, 0% similar"


def test_k22_html_fallback(spark):
    df = spark.createDataFrame([("a.html", bytearray(b"<p>a</p> <b>c</b>"), "html")], "path string, content binary, real_type string")
    assert extract_text(df).first()["text"] == "a c"


def test_k24_archives_go_by_suffix():
    data = zipped({"a.txt": "in"})
    assert parsers.extract(data, "zip", "x.zip")[0] == "[a.txt]\nin" and parsers.extract(data, "zip", "x.jar")[2] == ["No readable text files found inside archive"]


def test_k25_exif_size_is_null(spark):
    from conftest import exif_jpeg

    from verisift.operators.exif import extract_exif

    e = extract_exif(spark.createDataFrame([("a.jpg", bytearray(exif_jpeg()))], "path string, content binary")).first()["exif"]
    assert e["width"] is None and e["height"] is None


def test_k26_k27_mime_case_and_unmapped_types(spark):
    assert spark.range(1).select(urls.mime_to_type(F.lit("TEXT/HTML"))).first()[0] == "unknown"
    row = spark.createDataFrame([("http://h/x", 200, "OK", "Application/Odd", None, None, None, bytearray(b"raw"), None)], RESPONSE)
    r = extract_urls(row).first()
    assert (r["mime"], r["real_type"], r["text"], r["extractor"]) == ("application/odd", "unknown", "raw", "plain-text")


def test_k30_tokens_of_empty_text():
    assert parsers.tokens("") == 1 and parsers.tokens("a b c") == 4


def test_k31_missing_files_succeed(spark):
    df = spark.createDataFrame([("gone", 0, None, "File not found: gone")], "path string, length long, content binary, missing string")
    r = identity.analyze(df)
    assert not r.first()["valid"] and identity.batch_summary(r).first()["failed"] == 0


def test_k29_k28_dropped():
    assert "top_k" not in ai.classify_content.__code__.co_varnames


def test_chunks_never_lose_text(spark):
    t = "Alpha beta. Gamma delta! " * 40
    for s in ("fixed", "sentence"):
        rows = chunk.chunk_rows(spark.createDataFrame([(t,)], "t string"), "t", strategy=s, size=50, overlap=0).orderBy("index").collect()
        assert "".join(r["text"] for r in rows).replace(" ", "") == t.replace(" ", "")


def test_sql_functions(spark):
    assert "human_size" in sql.register(spark)
    r = spark.sql(r"SELECT human_size(2048) a, token_estimate('a b c') b, mime_to_type('text/csv') c, is_program('X.EXE') d, risk_tier(50) e, strip_white(' x ') f, word_count('a b') g, content_sha256(X'61') h").first()
    assert tuple(r) == ("2.0 KB", 4, "csv", True, "medium", "x", 2, hashlib.sha256(b"a").hexdigest())


def test_file_heads(spark, folder):
    heads.register(spark)
    got = {r["path"].rsplit("/", 1)[1]: r for r in spark.read.format("file_heads").option("path", f"file://{folder}").option("head_bytes", "8").option("partition_bytes", "2000").load().collect()}
    for f in folder.iterdir():
        data = f.read_bytes()
        r = got[f.name]
        assert (r["length"], bytes(r["head"]), r["sha256"], r["md5"]) == (len(data), data[:8], hashlib.sha256(data).hexdigest(), hashlib.md5(data).hexdigest())
    quick = spark.read.format("file_heads").option("path", str(folder)).option("hash", "false").load()
    assert quick.where("sha256 is not null").count() == 0 and quick.count() == len(got)


def test_extra_signatures(spark):
    from verisift.functions.detect import with_type

    df = spark.createDataFrame([("a.wasm", 8, bytearray(b"\0asm\x01\0\0\0"))], "path string, length long, content binary")
    assert with_type(df).first()["real_type"] == "unknown"
    assert with_type(df, extra=[("wasm", [(0, b"\0asm")])]).first()["real_type"] == "wasm"


def test_batch_with_progress(spark, folder, tmp_path):
    from verisift.operators.batch import analyze_many
    from verisift.sources.files import load_files

    heard = []
    results, summary = analyze_many(load_files(spark, f"file://{folder}"), f"file://{tmp_path}/out", on_progress=lambda a, b: heard.append((a, b)), every=0.01)
    n = len(list(folder.iterdir()))
    assert results.count() == n and (summary["total"], summary["failed"], summary["success_rate"]) == (n, 0, 1.0) and heard[-1] == (n, n)


def test_ai_trail(spark):
    df = spark.createDataFrame([("x",)], "t string")

    def down(prompt, **_):
        raise RuntimeError("401 no")

    out = ai.call(df, F.col("t"), "s", ai.Provider("openai", "m", fallbacks=[ai.Provider("groq", "f")]), down)
    text = out.select(ai.trail(F.col("success"), F.col("attempts"), F.col("total_duration_ms"), F.col("error"))).first()[0].split("\n")
    assert text[0].startswith("AI call FAILED (") and text[1] == "  ✗ openai/m attempt 1 [auth] 401 no" and text[2].startswith("  ✗ groq/f [fallback] attempt 1") and text[3].startswith("  Final error: All AI providers failed")
    with pytest.raises(Exception, match="All AI providers failed"):
        ai.raise_if_failed(out).collect()
