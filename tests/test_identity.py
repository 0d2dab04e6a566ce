"""End-to-end records of the fixture files, through the real binaryFile source."""

import pytest
from pyspark.sql import functions as F

from verisift.functions.detect import extension_matches, extension_of
from verisift.operators import identity
from verisift.operators.exif import extract_exif
from verisift.operators.extract import extract_text
from verisift.sources.files import load_files, load_paths, text_as_files


@pytest.fixture(scope="module")
def files(spark, folder):
    return load_files(spark, f"file://{folder}").withColumn("path", F.regexp_extract("path", "([^/]+)$", 1))


@pytest.fixture(scope="module")
def full(files):
    return {r["path"]: r for r in identity.analyze(files).collect()}


@pytest.fixture(scope="module")
def quick(files):
    return {r["path"]: r for r in identity.validate(files).collect()}


@pytest.mark.parametrize("name,kind,valid,score", [
    ("report.pdf", "pdf", True, 0), ("photo.png", "png", True, 0), ("photo.pdf", "png", False, 70), ("corrupted.pdf", "pdf", False, 70),
    ("document.docx", "docx", True, 0), ("corrupted.docx", "zip", False, 100), ("sheet.xlsx", "xlsx", True, 0), ("deck.pptx", "pptx", True, 0),
    ("archive.zip", "zip", True, 0), ("photo.zip", "png", False, 70), ("data.json", "json", True, 0), ("broken.json", "txt", False, 70), ("data.csv", "csv", True, 0),
    ("readme.txt", "txt", True, 0), ("notes.md", "md", True, 0), ("empty.pdf", "unknown", False, 30), ("book.epub", "epub", True, 0), ("evil.zip", "zip", True, 80),
    ("a.tar", "tar", True, 0), ("a.gz", "gz", True, 0), ("bad.gz", "gz", False, 50), ("a.bz2", "bz2", True, 0), ("a.7z", "7z", True, 0), ("a.rar", "rar", True, 0),
    ("movie.mp4", "mp4", True, 0), ("movie.mov", "mp4", False, 70), ("movie.mkv", "mkv", True, 0), ("movie.webm", "webm", True, 0), ("tone.wav", "wav", True, 0), ("stub.mp3", "mp3", True, 0),
    ("good.xml", "xml", True, 0), ("bad.xml", "xml", False, 50), ("page.html", "html", True, 0), ("pic.svg", "svg", True, 20), ("noext", "txt", False, 40),
    ("blank.txt", "txt", True, 0), ("prose.txt", "csv", False, 70), ("null.json", "txt", False, 70), ("binary.bin", "unknown", False, 70),
])
def test_record(full, name, kind, valid, score):
    r = full[name]
    assert (r["real_type"], r["valid"], r["risk_score"]) == (kind, valid, score), r


def test_corruption_without_metadata(quick):
    """Broken containers lose the points of unreadable metadata; broken texts keep theirs."""
    assert quick["corrupted.docx"]["risk_score"] == 90
    assert quick["corrupted.pdf"]["risk_score"] == 50
    assert quick["bad.xml"]["risk_score"] == 50
    assert quick["report.pdf"]["metadata"] is None


def test_messages(full):
    assert full["photo.pdf"]["errors"] == ["File is not a valid PDF (real type: png)"]
    assert full["empty.pdf"]["errors"] == ["File is empty"] and full["empty.pdf"]["extension"] == ""
    assert full["noext"]["errors"] == [] and full["noext"]["warnings"] == ["Extension mismatch"]
    assert full["evil.zip"]["warnings"] == ["Embedded executable detected: bin/MALWARE.EXE"]
    assert full["blank.txt"]["warnings"] == ["TXT file is empty"]
    assert full["stub.mp3"]["warnings"] == ["Audio metadata could not be read"]
    assert full["bad.xml"]["errors"][0].startswith("XML parse error: ")
    assert full["binary.bin"]["warnings"][0] == "No validator for type 'unknown'; skipping structural check"


def test_metadata(full):
    meta = {k: {a: b for a, b in r["metadata"].asDict().items() if b is not None} if r["metadata"] else {} for k, r in full.items()}
    assert meta["report.pdf"]["pages"] == 1
    assert (meta["photo.png"]["width"], meta["photo.png"]["height"], meta["photo.png"]["mode"]) == (3, 2, "RGB")
    assert (meta["document.docx"]["paragraphs"], meta["document.docx"]["words"], meta["document.docx"]["estimated_pages"]) == (2, 3, 1)
    assert (meta["sheet.xlsx"]["sheets"], meta["sheet.xlsx"]["sheet_names"], meta["sheet.xlsx"]["columns"]) == (1, ["Data"], 3)
    assert meta["deck.pptx"]["slides"] == 1
    assert (meta["data.csv"]["rows"], meta["data.csv"]["columns"]) == (3, 3)
    assert (meta["readme.txt"]["words"], meta["readme.txt"]["lines"], meta["readme.txt"]["estimated_tokens"]) == (10, 4, 13)
    assert meta["archive.zip"]["file_count"] == 2
    assert meta["a.tar"] == {"file_count": 1, "total_bytes": 5}
    assert (meta["tone.wav"]["duration"], meta["tone.wav"]["sample_rate"], meta["tone.wav"]["channels"]) == (1.0, 44100, 1)
    assert meta["a.gz"] == {}
    assert (meta["camera.jpg"]["width"], meta["camera.jpg"]["height"]) == (6, 4)
    assert "inspection_note" in meta["movie.mkv"]


def test_guards(spark, files):
    paths = spark.createDataFrame([("report.pdf",), ("nowhere.txt",)], "path string")
    got = {r["path"]: r for r in identity.analyze(load_paths(paths, files)).collect()}
    assert got["report.pdf"]["valid"]
    assert got["nowhere.txt"]["errors"] == ["File not found: nowhere.txt"] and got["nowhere.txt"]["risk_score"] == 0


def test_summary_and_reports(files):
    r = identity.analyze(files)
    text = {x["path"]: x["s"] for x in r.select("path", identity.summary(r).alias("s")).collect()}
    assert text["photo.png"].split("\n")[:2] == ["✓ Valid PNG", "Dimensions: 3×2"]
    assert "✗  File is empty" in text["empty.pdf"]
    batch = identity.batch_summary(r).first()
    assert batch["failed"] == 0 and batch["success_rate"] == 1.0 and batch["total"] == batch["succeeded"]
    gate = {x["path"]: x for x in identity.upload_gate(r, ["pdf", "zip"]).collect()}
    assert gate["report.pdf"]["accepted"] and gate["evil.zip"]["reason"] == "Risk too high: 80" and gate["data.csv"]["reason"] == "Type not allowed: csv"
    assert gate["photo.pdf"]["reason"].startswith("File is not a valid PDF")
    kept = {x["path"] for x in identity.rag_preflight(r, 12).collect()}
    assert "readme.txt" not in kept and "data.csv" in kept


def test_empty_batch(spark):
    none = text_as_files(spark.createDataFrame([], "t string"), "t", F.lit("a.txt"))
    assert identity.batch_summary(identity.analyze(none)).first()["success_rate"] == 0.0


@pytest.mark.parametrize("name,ext", [("a.txt", "txt"), (".bashrc", ""), ("a.tar.GZ", "gz"), ("dir.d/file", ""), ("x.", ""), ("..foo", "foo"), ("/p/q.Md", "md")])
def test_extension(spark, name, ext):
    assert spark.range(1).select(extension_of(F.lit(name))).first()[0] == ext


@pytest.mark.parametrize("kind,declared,ok", [("jpg", "jpeg", True), ("tiff", "tif", True), ("gz", "gzip", True), ("txt", "text", True), ("md", "markdown", True), ("html", "htm", True), ("pdf", "docx", False), ("png", "", False)])
def test_extension_matches(spark, kind, declared, ok):
    assert spark.range(1).select(extension_matches(F.lit(kind), F.lit(declared))).first()[0] is ok


def test_extraction(files):
    typed = files.withColumn("real_type", F.when(F.col("path").endswith(".docx"), "docx").when(F.col("path") == "movie.mp4", "mp4").otherwise(F.regexp_extract("path", r"\.([^.]+)$", 1)))
    got = {r["path"]: r for r in extract_text(typed).collect()}
    assert got["document.docx"]["text"] == "Hello big world\na | b"
    assert got["deck.pptx"]["text"] == "[Slide 1]\nTitle here"
    assert got["sheet.xlsx"]["text"] == "[Sheet: Data]\nname | 7"
    assert got["data.csv"]["text"] == "a | b | c\n1 | 2 | 3\n4 | 5 | 6"
    assert got["page.html"]["text"] == "Hi there"
    assert got["good.xml"]["text"] == "x\ny\nz"
    assert got["data.json"]["text"].startswith('{\n  "a": [')
    assert got["book.epub"]["text"] == "one\n\ntwo"
    assert got["archive.zip"]["text"] == "[readme.txt]\nhello\n\n[data.json]\n{}"
    assert got["a.tar"]["text"] == "[note.txt]\n12345" and got["a.gz"]["text"] == "text inside"
    assert got["movie.mp4"]["text"] == "" and "AI assistance" in got["movie.mp4"]["warnings"][0]
    assert got["bad.xml"]["warnings"][0].startswith("XML extraction failed")
    cut = {r["path"]: r for r in extract_text(typed, max_chars=4).collect()}
    assert cut["readme.txt"]["text"] == "Just" and cut["readme.txt"]["truncated"]


def test_exif(files):
    got = {r["path"]: r for r in extract_exif(files.where("path in ('camera.jpg', 'photo.png')")).collect()}
    e = got["camera.jpg"]["exif"]
    assert (e["camera_make"], e["aperture"], e["shutter_speed"], e["iso"], e["focal_length"]) == ("Acme", 2.8, "1/125", 200, 50.0)
    assert (e["gps"]["latitude"], e["gps"]["longitude"], e["gps"]["altitude"]) == (-10.5, 20.26, 123.4)
    assert got["camera.jpg"]["summary"].split("\n") == ["Camera: Acme Cam 1", "Taken: 2024:01:02 03:04:05", "Focal length: 50.0mm", "Aperture: f/2.8", "Shutter: 1/125", "ISO: 200", "GPS: -10.500000, 20.260000"]
    assert got["photo.png"]["summary"] == "No EXIF data found" and got["photo.png"]["exif"]["warnings"] == ["No EXIF data found in this file"]


def test_plan_has_no_exchange_and_one_probe(files):
    plan = identity.analyze(files)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
