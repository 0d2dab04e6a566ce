"""DuckDB SQL with the same rows as the queries in ``catalog``."""

from __future__ import annotations

from verisift.functions import rules

_W = rules.WHITE
_NW = rules.NOT_WHITE


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_W}+|{_W}+$', '', 'g')"


def _lstrip(x: str) -> str:
    return f"regexp_replace({x}, '^{_W}+', '')"


def _words(x: str) -> str:
    return f"CAST(len(regexp_extract_all(coalesce({x}, ''), '{_NW}+')) AS BIGINT)"


def _tokens(words: str) -> str:
    return f"greatest(1, CAST(floor({words} / 0.75::DOUBLE) AS BIGINT))"


def _size(n: str) -> str:
    """One digit after the point, ties to even: the scaled value's exact decimal decides."""
    def one(power: int) -> str:
        return f"CAST(CAST(round_even({n} / {1024.0 ** power!r}::DOUBLE, 1) AS DECIMAL(30,1)) AS VARCHAR)"

    parts = " ".join(f"WHEN {n} / {1024.0 ** p!r}::DOUBLE < 1024 THEN {one(p)} || ' {u}'" for p, u in enumerate(["KB", "MB", "GB", "TB"], 1))
    return f"CASE WHEN {n} < 1024 THEN {n} || ' B' {parts} ELSE {one(5)} || ' PB' END"


CONTENT_HASH = """
SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, CAST(strlen(text) AS BIGINT) AS size_bytes, substr(sha256(text), 1, 16) || '...' AS short FROM documents
"""

_EXT = "CASE doc_id % 7 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' WHEN 2 THEN 'csv' WHEN 3 THEN 'json' WHEN 4 THEN 'pdf' WHEN 5 THEN 'text' ELSE '' END"
_PATH = f"'doc_' || doc_id || CASE WHEN ({_EXT}) <> '' THEN '.' || ({_EXT}) ELSE '' END"

FIND_DUPLICATES = f"""
SELECT sha256(text) AS sha256, CAST(min(strlen(text)) AS BIGINT) AS size_bytes, count(*) AS count,
       CAST(min(strlen(text)) * (count(*) - 1) AS BIGINT) AS wasted_bytes, arg_min({_PATH}, doc_id) AS first_path
FROM documents WHERE strlen(text) >= 1 GROUP BY 1 HAVING count(*) >= 2
"""
KEEP_DELETE = f"""
SELECT sha256, doc_id, path, size_bytes, CASE WHEN doc_id = first THEN 'KEEP' ELSE 'DELETE' END AS action
FROM (SELECT *, min(doc_id) OVER (PARTITION BY sha256) AS first, count(*) OVER (PARTITION BY sha256) AS n
      FROM (SELECT doc_id, {_PATH} AS path, CAST(strlen(text) AS BIGINT) AS size_bytes, sha256(text) AS sha256 FROM documents WHERE strlen(text) >= 1))
WHERE n >= 2
"""
WASTED = """
SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS member_files, CAST(sum(size * (n - 1)) AS BIGINT) AS wasted_bytes
FROM (SELECT min(strlen(text)) AS size, count(*) AS n FROM documents WHERE strlen(text) >= 1 GROUP BY sha256(text) HAVING count(*) >= 2)
"""

TEXT_METADATA = f"""
SELECT doc_id, CAST(length(text) AS BIGINT) AS characters, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS lines,
       {_words('text')} AS words, {_tokens(_words('text'))} AS estimated_tokens FROM documents
"""
TOKENS_BY_LANG = f"SELECT lang, count(*) AS docs, CAST(sum({_tokens(_words('text'))}) AS BIGINT) AS tokens FROM documents GROUP BY 1"
CONVERSATION_TOKENS = f"SELECT conv_id, count(*) AS turns, CAST(sum({_tokens(_words('text'))}) AS BIGINT) AS tokens FROM conversations GROUP BY 1"
HUMAN_SIZE = f"""
SELECT doc_id, n, {_size('n')} AS size_human
FROM (SELECT doc_id, CAST(strlen(text) * CAST(pow(7.0, doc_id % 16) AS BIGINT) AS BIGINT) AS n FROM documents)
"""

_COUNTS = ", ".join(f"struct_pack(n := len(regexp_extract_all(spaced, ' (?:{'|'.join(w)}) ')), code := '{c}')" for c, w in rules.LANGUAGE_WORDS.items())
_SPACED = r"'  ' || regexp_replace(lower(substr(text, 1, 5000)), '[^\p{L}]+', '  ', 'g') || '  '"
LANGUAGE = f"SELECT doc_id, CASE WHEN best.n > 0 THEN best.code ELSE 'unknown' END AS language FROM (SELECT doc_id, list_max([{_COUNTS}]) AS best FROM (SELECT doc_id, {_SPACED} AS spaced FROM documents))"

# --------------------------------------------------------------------------- personal data

PII_RAW = " UNION ALL ".join(
    f"SELECT '{t}' AS source_table, " + ", ".join(f"CAST(sum(len(regexp_extract_all({c}, '(?i){p}', 0))) AS BIGINT) AS {n}" for n, p, _ in rules.PII_PATTERNS) + f" FROM {t}"
    for t, c in (("documents", "text"), ("pages", "html"), ("conversations", "text"))
)
_CANDIDATES = " UNION ALL ".join(
    f"SELECT doc_id, source, {k} AS pri, '{n}' AS pii_type, '{conf}' AS confidence, regexp_extract_all(text, '(?i){p}', 0) AS m, string_split_regex(text, '(?i){p}') AS parts FROM documents"
    for k, (n, p, conf) in enumerate(rules.PII_PATTERNS)
)
_MATCHES = f"""
found AS (SELECT doc_id, source, pri, pii_type, confidence, m, parts, unnest(range(1, len(m) + 1)) AS k FROM ({_CANDIDATES}) WHERE len(m) > 0),
placed AS (
  SELECT doc_id, source, pri, pii_type, confidence, m[k] AS value,
         CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS INTEGER) AS s
  FROM found),
cand AS (SELECT *, CAST(s + length(value) AS INTEGER) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY pri, s) AS rn FROM placed),
fold AS (
  SELECT doc_id, rn, true AS ok, [struct_pack(s := s, e := e)] AS spans FROM cand WHERE rn = 1
  UNION ALL
  SELECT c.doc_id, c.rn, len(list_filter(f.spans, lambda x: (x.s <= c.s AND c.s < x.e) OR (x.s < c.e AND c.e <= x.e))) = 0,
         CASE WHEN len(list_filter(f.spans, lambda x: (x.s <= c.s AND c.s < x.e) OR (x.s < c.e AND c.e <= x.e))) = 0 THEN list_append(f.spans, struct_pack(s := c.s, e := c.e)) ELSE f.spans END
  FROM fold f JOIN cand c ON c.doc_id = f.doc_id AND c.rn = f.rn + 1),
matches AS (SELECT c.* FROM cand c JOIN fold f ON c.doc_id = f.doc_id AND c.rn = f.rn WHERE f.ok)
"""
PII_MATCHES = f"WITH RECURSIVE {_MATCHES} SELECT doc_id, pii_type, value, s AS start_, e AS end_, confidence FROM matches"
PII_TYPES = f"""
WITH RECURSIVE {_MATCHES},
firsts AS (SELECT doc_id, pii_type, min(s) AS s, count(*) AS n FROM matches GROUP BY 1, 2),
per_doc AS (SELECT doc_id, sum(n) AS n, string_agg(pii_type, ',' ORDER BY s) AS types FROM firsts GROUP BY 1)
SELECT d.doc_id, p.n IS NOT NULL AS has_pii, CAST(coalesce(p.n, 0) AS BIGINT) AS pii_count, coalesce(p.types, '') AS types_found
FROM documents d LEFT JOIN per_doc p USING (doc_id)
"""
PII_REDACT = f"""
WITH RECURSIVE {_MATCHES},
outermost AS (SELECT * FROM matches a WHERE NOT EXISTS (SELECT 1 FROM matches b WHERE a.doc_id = b.doc_id AND b.s <= a.s AND a.e <= b.e AND b.e - b.s > a.e - a.s)),
pieces AS (
  SELECT o.doc_id, o.s, o.e, substr(d.text, coalesce(lag(o.e) OVER (PARTITION BY o.doc_id ORDER BY o.s), 0) + 1, o.s - coalesce(lag(o.e) OVER (PARTITION BY o.doc_id ORDER BY o.s), 0)) || '[REDACTED_' || upper(o.pii_type) || ']' AS piece
  FROM outermost o JOIN documents d USING (doc_id)),
joined AS (SELECT doc_id, string_agg(piece, '' ORDER BY s) AS head, max(e) AS last FROM pieces GROUP BY 1),
done AS (SELECT d.doc_id, CASE WHEN j.doc_id IS NULL THEN d.text ELSE j.head || substr(d.text, j.last + 1) END AS redacted FROM documents d LEFT JOIN joined j USING (doc_id))
SELECT doc_id, sha256(coalesce(redacted, '')) AS redacted_sha256, CAST(length(redacted) AS INTEGER) AS redacted_chars FROM done
"""
PII_BY_SOURCE = f"WITH RECURSIVE {_MATCHES} SELECT source, pii_type, count(*) AS n FROM matches GROUP BY 1, 2"

# --------------------------------------------------------------------------- types, validity, risk

_HITS = " + ".join(f"CAST(contains(sample, '{m}') AS INTEGER)" for m in rules.MARKDOWN_MARKS)


def _even(mark: str) -> str:
    counts = f"list_transform(list_filter(lines[1:5], lambda x: x <> ''), lambda x: length(x) - length(replace(x, {mark}, '')))"
    return f"coalesce(list_min({counts}) > 0 AND list_max({counts}) - list_min({counts}) <= 2, false)"


def _typed(table: str, key: str, column: str, ext: str) -> str:
    """Types of a text column without NUL; XML that isn't declared is not parsed here."""
    prefixes = {"%PDF-": "pdf", "GIF87a": "gif", "BM": "bmp", "II*" + "\x00": "tiff", "ID3": "mp3", "fLaC": "flac", "OggS": "ogg", "PK\x03\x04": "zip", "PK\x05\x06": "zip", "BZh": "bz2", "Rar!\x1a\x07": "rar", "GIF89a": "gif", "<svg": "svg"}
    signed = " ".join(f"WHEN starts_with(body, '{p}') THEN '{t}'" for p, t in prefixes.items() if "\x00" not in p and "\x03" not in p and "\x05" not in p and "\x1a" not in p)
    return f"""
    SELECT *, CASE WHEN body = '' THEN 'unknown' {signed} WHEN substr(body, 5, 4) = 'ftyp' THEN 'mp4'
      WHEN starts_with(body, '<?xml') AND contains(substr(body, 1, 512), '<svg') THEN 'svg'
      WHEN (starts_with(s, '{{') OR starts_with(s, '[')) AND json_valid(sample) THEN 'json'
      WHEN (lower(s) IN ('null', 'true', 'false') OR starts_with(s, '"') OR regexp_matches(s, '^[0-9+-]')) AND json_valid({_strip('s')}) THEN 'json'
      WHEN starts_with(lower(s), '<!doctype html') OR starts_with(lower(s), '<html') THEN 'html'
      WHEN ext IN ('md', 'markdown') AND ({_HITS}) >= 1 THEN 'md'
      WHEN starts_with(s, '<?xml') THEN 'xml'
      WHEN len(lines) >= 2 AND ({_even("','")} OR {_even("';'")} OR {_even("chr(9)")}) THEN 'csv'
      WHEN ({_HITS}) >= 2 THEN 'md' ELSE 'txt' END AS real_type
    FROM (SELECT *, {_lstrip('sample')} AS s, CASE WHEN pieces[len(pieces)] = '' THEN pieces[1:len(pieces) - 1] ELSE pieces END AS lines
      FROM (SELECT *, string_split_regex(sample, '{rules.LINE_END}') AS pieces
        FROM (SELECT *, substr(replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10)), 1, 2048) AS sample
          FROM (SELECT {key}, coalesce({column}, '') AS body, {ext} AS ext FROM {table}))))"""


_MIME = "CASE real_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.TYPE_MIME.items()) + f" ELSE '{rules.UNKNOWN_MIME}' END"
_DOCS = _typed("documents", "doc_id", "text", _EXT)
DETECT_DOCUMENTS = f"SELECT doc_id, ext AS extension, real_type, {_MIME} AS mime FROM ({_DOCS})"
DETECT_PAGES = f"SELECT page_id, real_type, {_MIME} AS mime FROM ({_typed('pages', 'page_id', 'html', chr(39) + 'html' + chr(39))})"
DETECT_EVENTS = f"SELECT real_type, {_MIME} AS mime, count(*) AS files FROM ({_typed('events', 'event_id', 'props', chr(39) + 'json' + chr(39))}) GROUP BY 1, 2"
TYPE_HISTOGRAM = f"SELECT real_type, {_MIME} AS mime, count(*) AS files FROM ({_DOCS}) GROUP BY 1, 2"

_RESULT = f"""
  SELECT *, CASE WHEN body = '' THEN 30 ELSE CASE WHEN matches THEN 0 WHEN ext = '' THEN 40 ELSE 70 END END AS score, matches AND body <> '' AS ok
  FROM (SELECT *, {_PATH} AS path, ext = real_type OR (ext = 'text' AND real_type = 'txt') OR (ext = 'markdown' AND real_type = 'md') AS matches FROM ({_DOCS}))
"""
_WRONG = "CASE WHEN NOT matches AND ext <> '' THEN 'File is not a valid ' || upper(ext) || ' (real type: ' || real_type || ')' END"
EXTENSION_CHECK = f"SELECT doc_id, ext AS extension, real_type, matches AS extension_matches, coalesce({_WRONG}, '') AS errors FROM ({_RESULT})"
RISK_SCORE = f"SELECT doc_id, ok AS valid, CAST(score AS INTEGER) AS risk_score, CASE WHEN matches THEN '' ELSE 'Extension mismatch' END AS warnings FROM ({_RESULT})"
_TEXTUAL = "real_type IN ('txt', 'md', 'html', 'xml', 'json')"
_CSV_WORDS = _words("replace(body, ',', ' ')")
ANALYZE = f"""
SELECT doc_id, path, ok AS valid, real_type, {_MIME} AS mime, ext AS extension, matches AS extension_matches, CAST(strlen(body) AS BIGINT) AS size_bytes, {_size('strlen(body)')} AS size_human,
       CAST(score AS INTEGER) AS risk_score, CASE WHEN {_TEXTUAL} THEN CAST(length(body) AS BIGINT) END AS characters,
       CASE WHEN {_TEXTUAL} THEN CAST(length(body) - length(replace(body, chr(10), '')) + 1 AS BIGINT) END AS lines,
       CASE WHEN {_TEXTUAL} THEN {_words('body')} END AS words,
       CASE WHEN {_TEXTUAL} THEN {_tokens(_words('body'))} WHEN real_type = 'csv' THEN {_tokens(_CSV_WORDS)} END AS estimated_tokens
FROM ({_RESULT})
"""
VALIDATE = f"SELECT doc_id, ok AS valid, real_type, CAST(score AS INTEGER) AS risk_score, CAST(({_WRONG}) IS NOT NULL AS INTEGER) AS n_errors FROM ({_RESULT})"
_TIER = "CASE WHEN score = 0 THEN 'safe' WHEN score < 40 THEN 'low' WHEN score < 70 THEN 'medium' ELSE 'high' END"
RISK_TIERS = f"SELECT {_TIER} AS tier, count(*) AS files FROM ({_RESULT}) GROUP BY 1"
HIGH_RISK = f"SELECT doc_id, path, CAST(score AS INTEGER) AS risk_score FROM ({_RESULT}) WHERE score > 50"
UPLOAD_GATE = f"""
SELECT doc_id, reason IS NULL AS accepted, reason FROM (
  SELECT doc_id, CASE WHEN NOT ok THEN coalesce({_WRONG}, 'Invalid file') WHEN real_type NOT IN ('txt', 'md', 'csv') THEN 'Type not allowed: ' || real_type WHEN score > 50 THEN 'Risk too high: ' || score END AS reason
  FROM ({_RESULT}))
"""
RAG_PREFLIGHT = f"SELECT doc_id, estimated_tokens FROM (SELECT doc_id, CASE WHEN real_type = 'csv' THEN {_tokens(_CSV_WORDS)} ELSE {_tokens(_words('body'))} END AS estimated_tokens FROM ({_RESULT}) WHERE ok) WHERE estimated_tokens <= 100000"
BATCH_SUMMARY = "SELECT count(*) AS total, count(*) AS succeeded, CAST(0 AS BIGINT) AS failed, CASE WHEN count(*) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS success_rate FROM documents"
FOLDER_SCAN = f"SELECT count(*) AS files, count(*) FILTER (WHERE score > 0) AS at_risk, CAST(max(score) AS INTEGER) AS highest FROM ({_RESULT})"
TYPE_ROLLUP = f"SELECT real_type, tier, count(*) AS files FROM (SELECT real_type, {_TIER} AS tier FROM ({_RESULT})) GROUP BY ROLLUP (real_type, tier)"

# --------------------------------------------------------------------------- files of every format
# What is known of the files in ``fixtures`` from the bytes that they were made of.

_MISMATCH, _FFPROBE = "Extension mismatch", "Install ffprobe for full video metadata"
_RECORDS = [
    # path, valid, type, extension, extension matches, risk, errors, warnings, first line of the summary
    ("report.pdf", True, "pdf", "pdf", True, 0, 0, "", "✓ Valid PDF"),
    ("photo.png", True, "png", "png", True, 0, 0, "", "✓ Valid PNG"),
    ("photo.pdf", False, "png", "pdf", False, 70, 1, _MISMATCH, "✗ Invalid PNG"),
    ("corrupted.pdf", False, "pdf", "pdf", True, 70, 1, "Metadata could not be fully extracted", "✗ Invalid PDF"),
    ("document.docx", True, "docx", "docx", True, 0, 0, "", "✓ Valid DOCX"),
    ("corrupted.docx", False, "zip", "docx", False, 100, 2, _MISMATCH + "; Metadata could not be fully extracted", "✗ Invalid ZIP"),
    ("sheet.xlsx", True, "xlsx", "xlsx", True, 0, 0, "", "✓ Valid XLSX"),
    ("deck.pptx", True, "pptx", "pptx", True, 0, 0, "", "✓ Valid PPTX"),
    ("archive.zip", True, "zip", "zip", True, 0, 0, "", "✓ Valid ZIP"),
    ("photo.zip", False, "png", "zip", False, 70, 1, _MISMATCH, "✗ Invalid PNG"),
    ("data.json", True, "json", "json", True, 0, 0, "", "✓ Valid JSON"),
    ("broken.json", False, "txt", "json", False, 70, 1, _MISMATCH, "✗ Invalid TXT"),
    ("data.csv", True, "csv", "csv", True, 0, 0, "", "✓ Valid CSV"),
    ("readme.txt", True, "txt", "txt", True, 0, 0, "", "✓ Valid TXT"),
    ("notes.md", True, "md", "md", True, 0, 0, "", "✓ Valid MD"),
    ("empty.pdf", False, "unknown", "", False, 30, 1, "", "✗ Invalid Unknown type"),
    ("book.epub", True, "epub", "epub", True, 0, 0, "", "✓ Valid EPUB"),
    ("evil.zip", True, "zip", "zip", True, 80, 0, "Embedded executable detected: bin/MALWARE.EXE", "✓ Valid ZIP"),
    ("a.tar", True, "tar", "tar", True, 0, 0, "", "✓ Valid TAR"),
    ("a.gz", True, "gz", "gz", True, 0, 0, "", "✓ Valid GZ"),
    ("bad.gz", False, "gz", "gz", True, 50, 1, "", "✗ Invalid GZ"),
    ("a.bz2", True, "bz2", "bz2", True, 0, 0, "", "✓ Valid BZ2"),
    ("a.7z", True, "7z", "7z", True, 0, 0, "", "✓ Valid 7Z"),
    ("a.rar", True, "rar", "rar", True, 0, 0, "", "✓ Valid RAR"),
    ("movie.mp4", True, "mp4", "mp4", True, 0, 0, "", "✓ Valid MP4"),
    ("movie.mov", False, "mp4", "mov", False, 70, 1, _MISMATCH, "✗ Invalid MP4"),
    ("movie.mkv", True, "mkv", "mkv", True, 0, 0, "", "✓ Valid MKV"),
    ("movie.webm", True, "webm", "webm", True, 0, 0, "", "✓ Valid WEBM"),
    ("tone.wav", True, "wav", "wav", True, 0, 0, "", "✓ Valid WAV"),
    ("stub.mp3", True, "mp3", "mp3", True, 0, 0, "Audio metadata could not be read", "✓ Valid MP3"),
    ("good.xml", True, "xml", "xml", True, 0, 0, "", "✓ Valid XML"),
    ("bad.xml", False, "xml", "xml", True, 50, 1, "", "✗ Invalid XML"),
    ("page.html", True, "html", "html", True, 0, 0, "", "✓ Valid HTML"),
    ("pic.svg", True, "svg", "svg", True, 20, 0, "Metadata could not be fully extracted", "✓ Valid SVG"),
    ("camera.jpg", True, "jpg", "jpg", True, 0, 0, "", "✓ Valid JPG"),
    ("noext", False, "txt", "", False, 40, 0, _MISMATCH, "✗ Invalid TXT"),
    ("blank.txt", True, "txt", "txt", True, 0, 0, "TXT file is empty", "✓ Valid TXT"),
    ("prose.txt", False, "csv", "txt", False, 70, 1, _MISMATCH, "✗ Invalid CSV"),
    ("null.json", False, "txt", "json", False, 70, 1, _MISMATCH, "✗ Invalid TXT"),
    ("binary.bin", False, "unknown", "bin", False, 70, 1, "No validator for type 'unknown'; skipping structural check; " + _MISMATCH, "✗ Invalid Unknown type"),
]
_PIXEL = {"width": 1, "height": 1, "mode": "RGB", "has_transparency": "false"}


def _prose(words: int, characters: int, lines: int) -> dict:
    return {"words": words, "characters": characters, "lines": lines, "estimated_tokens": max(1, int(words / 0.75))}


_METADATA = {
    "report.pdf": {"pages": 1, "encrypted": "false", "contains_images": "false", "contains_tables": "false", "estimated_tokens": 1},
    "photo.png": _PIXEL | {"width": 3, "height": 2}, "photo.pdf": _PIXEL, "photo.zip": _PIXEL, "camera.jpg": _PIXEL | {"width": 6, "height": 4},
    "document.docx": {"paragraphs": 2, "words": 3, "estimated_tokens": 4, "estimated_pages": 1},
    "sheet.xlsx": {"sheets": 1, "sheet_names": '["Data"]', "rows": 1, "columns": 3, "estimated_tokens": 2},
    "deck.pptx": {"slides": 1, "text_length": 10, "estimated_tokens": 2}, "book.epub": {"estimated_tokens": 2},
    "archive.zip": {"file_count": 2, "total_uncompressed_bytes": 7, "total_compressed_bytes": 7}, "evil.zip": {"file_count": 2, "total_uncompressed_bytes": 3, "total_compressed_bytes": 3},
    "a.tar": {"file_count": 1, "total_bytes": 5}, "tone.wav": {"duration": 1.0, "bitrate": 705600, "sample_rate": 44100, "channels": 1},
    "data.csv": {"rows": 3, "columns": 3, "estimated_tokens": 12}, "prose.txt": {"rows": 3, "columns": 2, "estimated_tokens": 8},
    "data.json": _prose(3, 13, 1), "broken.json": _prose(1, 6, 1), "readme.txt": _prose(10, 54, 4), "notes.md": _prose(6, 24, 5), "good.xml": _prose(2, 38, 1), "bad.xml": _prose(2, 31, 1),
    "page.html": _prose(3, 57, 1), "noext": _prose(3, 16, 1), "blank.txt": _prose(0, 4, 2), "null.json": _prose(1, 5, 2),
    **{f"movie.{x}": {"inspection_note": _FFPROBE} for x in ("mp4", "mov", "mkv", "webm")},
}
_TEXTS = {
    "document.docx": ("Hello big world|a | b", "docx"), "sheet.xlsx": ("[Sheet: Data]|name | 7", "xlsx"), "deck.pptx": ("[Slide 1]|Title here", "pptx"), "report.pdf": ("", "pdf"),
    "archive.zip": ("[readme.txt]|hello||[data.json]|{}", "archive"), "evil.zip": ("[readme.txt]|x", "archive"), "corrupted.docx": ("", "archive"), "a.tar": ("[note.txt]|12345", "archive"), "a.gz": ("text inside", "archive"), "bad.gz": ("", "archive"),
    "data.json": ('{|  "a": [|    1,|    2|  ]|}', "json"), "data.csv": ("a | b | c|1 | 2 | 3|4 | 5 | 6", "csv"), "prose.txt": ("one |  two|three |  four|five |  six", "csv"), "book.epub": ("one||two", "epub+zip"),
    "good.xml": ("x|y|z", "xml.etree"), "page.html": ("Hi there", "tag-strip"), "broken.json": ('{"a": ', "plain-text"), "readme.txt": ("Just some prose.|Another line here.|And the last one.|", "plain-text"),
    "notes.md": ("# Title||- item|> quote|", "plain-text"), "noext": ("plain words only", "plain-text"), "blank.txt": ("  | ", "plain-text"), "null.json": ("null|", "plain-text"), "empty.pdf": ("", "plain-text"),
    **{x: ("binary", "plain-text") for x in ("a.bz2", "a.7z", "a.rar", "binary.bin")},
    **{x: ("", "") for x in ("photo.png", "photo.pdf", "corrupted.pdf", "photo.zip", "movie.mp4", "movie.mov", "movie.mkv", "movie.webm", "tone.wav", "stub.mp3", "bad.xml", "pic.svg", "camera.jpg")},
}


def _literal(x) -> str:
    return str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def _values(columns: str, rows: list[tuple]) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS v({columns})"


FIXTURE_RECORDS = _values("path, valid, real_type, extension, extension_matches, risk_score, n_errors, warnings, summary", _RECORDS)
FIXTURE_METADATA = _values("path, name, value", [(p, k, str(v)) for p, m in _METADATA.items() for k, v in m.items()])
FIXTURE_TEXT = _values("path, text, extractor", [(p, *x) for p, x in _TEXTS.items()])
EXIF_RECORDS = """
SELECT 'camera.jpg' AS path, 'Acme' AS camera_make, 'Cam 1' AS camera_model, '1/125' AS shutter_speed, 2.8::DOUBLE AS aperture, 200::INTEGER AS iso, 50.0::DOUBLE AS focal_length,
       -10.5::DOUBLE AS latitude, 20.26::DOUBLE AS longitude, 123.4::DOUBLE AS altitude, true AS has_gps, 'https://www.google.com/maps?q=-10.5,20.26' AS maps_url
"""

# --------------------------------------------------------------------------- chunks and differences

_COUNTED = f"CAST({_words('chunk')} AS BIGINT) AS word_count, {_tokens(_words('chunk'))} AS token_estimate"
CHUNK_FIXED = f"""
SELECT doc_id, CAST(s / 462 AS INTEGER) AS index, sha256(chunk) AS text_sha256, CAST(s AS INTEGER) AS char_start, CAST(least(s + 512, n) AS INTEGER) AS char_end, {_COUNTED}
FROM (SELECT doc_id, s, n, substr(text, CAST(s + 1 AS BIGINT), 512) AS chunk
      FROM (SELECT doc_id, text, length(text) AS n, unnest(range(0, length(text), 462)) AS s FROM documents WHERE regexp_matches(text, '{_NW}')))
"""


def _packed(source: str, gap: int, joiner: str, size: int = 512) -> str:
    """Greedy packing as a recursive walk over parts(doc_id, i, p): one row a finished chunk."""
    return f"""
parts AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i FROM ({source}) WHERE p <> ''),
sized AS (SELECT doc_id, i, length(p) AS l, lead(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL AS last, sum(length(p) + {gap}) OVER (PARTITION BY doc_id ORDER BY i) - length(p) - {gap} AS pos FROM parts),
walk AS (
  SELECT doc_id, i, l AS len, 0 AS start, 0 AS chunk FROM sized WHERE i = 1
  UNION ALL
  SELECT s.doc_id, s.i, CASE WHEN w.len + s.l + {gap} > {size} THEN s.l ELSE w.len + {gap} + s.l END, CASE WHEN w.len + s.l + {gap} > {size} THEN s.pos ELSE w.start END, w.chunk + CASE WHEN w.len + s.l + {gap} > {size} THEN 1 ELSE 0 END
  FROM walk w JOIN sized s ON s.doc_id = w.doc_id AND s.i = w.i + 1),
chunks AS (SELECT w.doc_id, w.chunk AS idx, min(w.start) AS char_start, string_agg(p.p, {joiner} ORDER BY w.i) AS chunk FROM walk w JOIN parts p ON p.doc_id = w.doc_id AND p.i = w.i GROUP BY 1, 2)
"""


def _sentences(source: str, column: str) -> str:
    marked = f"regexp_replace({column}, '([.!?]){_W}+([A-Z\"])', '\\1' || chr(1) || '\\2', 'g')"
    return f"SELECT doc_id, k, {_strip('x')} AS p FROM (SELECT doc_id, unnest(string_split(m, chr(1))) AS x, unnest(range(1, len(string_split(m, chr(1))) + 1)) AS k FROM (SELECT doc_id, {marked} AS m FROM {source}))"


def _chunk_rows(extra: str = "char_start") -> str:
    return f"SELECT doc_id, CAST(idx AS INTEGER) AS index, sha256(chunk) AS text_sha256, CAST({extra} AS INTEGER) AS char_start, CAST({extra} + length(chunk) AS INTEGER) AS char_end, {_COUNTED} FROM chunks"


CHUNK_SENTENCE = f"WITH RECURSIVE {_packed(_sentences('documents', 'text'), 1, chr(39) + ' ' + chr(39))} {_chunk_rows()}"
# documents have one paragraph each, so paragraphs are whole texts
CHUNK_PARAGRAPH = f"WITH chunks AS (SELECT doc_id, 0 AS idx, 0 AS char_start, {_strip('text')} AS chunk FROM documents WHERE regexp_matches(text, '{_NW}')) {_chunk_rows()}"
CHUNK_SEMANTIC = f"""
WITH RECURSIVE whole AS (SELECT doc_id, {_strip('text')} AS text FROM documents WHERE regexp_matches(text, '{_NW}')),
{_packed(_sentences("(SELECT * FROM whole WHERE length(text) > 768)", 'text'), 1, chr(39) + ' ' + chr(39)).replace('chunks AS (', 'long_chunks AS (')},
chunks AS (SELECT * FROM long_chunks UNION ALL SELECT doc_id, 0, 0, text FROM whole WHERE length(text) <= 768)
{_chunk_rows()}
"""
DIFF_IDENTITY = "SELECT a.doc_id AS path_a, b.doc_id AS path_b, a.text = b.text AS identical FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1"

# --------------------------------------------------------------------------- URLs and HTML

URL_VALIDATE = r"""
SELECT page_id, url, CASE WHEN scheme NOT IN ('http', 'https') THEN 'Unsupported scheme: ''' || scheme || '''' WHEN authority = '' THEN 'URL has no host' ELSE '' END AS errors, scheme
FROM (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS scheme, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1) AS authority
  FROM (SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'ftp://' || substr(url, 8, 500) WHEN 2 THEN 'https:///path' WHEN 3 THEN upper(url) ELSE url END AS url FROM pages))
"""
_KIND = "CASE coalesce(mime, '') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.MIME_TYPE.items()) + " ELSE 'unknown' END"
URL_INSPECT = f"""
SELECT url, ok AS valid, CASE WHEN ok THEN mime END AS mime, CASE WHEN ok THEN {_KIND} ELSE 'unknown' END AS real_type, CASE WHEN ok THEN n END AS size_bytes, CASE WHEN ok THEN {_size('n')} END AS size_human,
       status AS status_code, CASE WHEN ok AND mime IS NULL THEN 'Server did not return Content-Type' ELSE '' END AS warnings, CASE WHEN ok THEN '' ELSE 'HTTP 404: Not Found' END AS errors
FROM (SELECT url, CAST(strlen(html) AS BIGINT) AS n, page_id % 7 <> 3 AS ok, CAST(CASE WHEN page_id % 7 = 3 THEN 404 ELSE 200 END AS INTEGER) AS status,
             CASE page_id % 5 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'image/PNG' WHEN 4 THEN 'text/csv' END AS mime FROM pages)
"""
MIME_TO_TYPE = "SELECT mime, real_type FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in [*rules.MIME_TYPE.items(), ("audio/mp4", "unknown"), ("text/xml", "unknown"), ("audio/x-wav", "unknown"), ("TEXT/HTML", "unknown"), ("", "unknown")]) + ") AS v(mime, real_type)"
_STRIPPED = _strip(f"regexp_replace(regexp_replace(replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '<[^>]+>', ' ', 'g'), '{_W}+', ' ', 'g')")
HTML_TEXT = f"SELECT page_id, sha256(t) AS text_sha256, CAST(length(t) AS BIGINT) AS char_count, {_words('t')} AS word_count FROM (SELECT page_id, {_STRIPPED} AS t FROM pages)"
HTML_TITLE = f"SELECT page_id, CASE WHEN contains(lower(html), '<title') THEN {_strip('regexp_extract(html, ' + chr(39) + '(?is)<title[^>]*>([^<]*)</title>' + chr(39) + ', 1)')} END AS title FROM pages"
EXTRACT_TRUNCATED = """
SELECT doc_id, sha256(substr(t, 1, 500)) AS text_sha256, CAST(least(length(t), 500) AS BIGINT) AS char_count, length(t) > 500 AS truncated, 'plain-text' AS extractor
FROM (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents)
"""

# --------------------------------------------------------------------------- EXIF values and AI layer

EXIF_GPS = """
SELECT event_id, round_even(CASE WHEN event_id % 3 = 0 THEN -x ELSE x END, 7) AS latitude
FROM (SELECT event_id, CAST(event_id % 90 AS DOUBLE) + CAST(event_id * 7 % 60 AS DOUBLE) / 60 + CAST(event_id * 13 % 6000 AS DOUBLE) / nullif(CASE WHEN event_id % 11 = 0 THEN 0 ELSE 100 END, 0)::DOUBLE / 3600 AS x FROM events)
"""
SHUTTER = """
SELECT event_id, CASE WHEN n = 0 THEN NULL WHEN d = 1 THEN n || 's' WHEN n = 1 THEN '1/' || d ELSE '1/' || CAST(round_even(d / n::DOUBLE, 0) AS BIGINT) END AS shutter
FROM (SELECT event_id, event_id % 7 AS n, event_id * 11 % 250 + 1 AS d FROM events)
"""
ERROR_CLASSES = ["RateLimitError", "AuthenticationError", "ContextWindowExceededError", "BadRequestError", "ServiceUnavailableError", "APIConnectionError", "ValueError"]
ERROR_MESSAGES = ["please slow down: 429", "key rejected", "maximum context length exceeded", "invalid model name", "502 bad gateway", "timeout while reading", "something else", "Rate limit reached", "HTTP 403", "network is unreachable", "invalid argument"]
_NAMES = "CASE event_id % 7 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(ERROR_CLASSES)) + " END"
_MESSAGES = "CASE event_id % 11 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(ERROR_MESSAGES)) + " END"
ERROR_KIND = f"""
SELECT event_id, CASE
  WHEN contains(c, 'ratelimit') OR contains(c, 'rate_limit') OR contains(m, '429') OR contains(m, 'rate limit') THEN 'rate_limit'
  WHEN contains(c, 'autherror') OR contains(c, 'authenticationerror') OR contains(m, '401') OR contains(m, '403') THEN 'auth'
  WHEN contains(c, 'contextwindow') OR contains(c, 'contextlength') OR (contains(m, 'context') AND contains(m, 'length')) THEN 'context_length'
  WHEN contains(c, 'badrequest') OR contains(m, '400') OR (contains(m, 'invalid') AND contains(m, 'model')) THEN 'invalid_request'
  WHEN contains(c, 'serviceunavailable') OR contains(m, '500') OR contains(m, '502') OR contains(m, '503') OR contains(m, '504') THEN 'server_error'
  WHEN contains(m, 'connection') OR contains(m, 'timeout') OR contains(m, 'network') OR contains(c, 'connect') THEN 'network'
  ELSE 'unknown' END AS kind
FROM (SELECT event_id, lower({_NAMES}) AS c, lower({_MESSAGES}) AS m FROM events)
"""
BACKOFF = "SELECT event_id, least(30.0::DOUBLE, pow(2.0, event_id % 8)) AS wait FROM events"
