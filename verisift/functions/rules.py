"""Tables of the engine: signatures, names of types, MIME types, personal-data patterns.

The values below are fixed: results depend on them exactly.
"""

from __future__ import annotations

DOCX_MIME = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
XLSX_MIME = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
PPTX_MIME = "application/vnd.openxmlformats-officedocument.presentationml.presentation"
UNKNOWN_MIME = "application/octet-stream"

# Signatures in order of precedence, as (type, [(offset, bytes)]); offset None means anywhere in the head.
SIGNATURES: list[tuple[str, list[tuple[int | None, bytes]]]] = [
    ("pdf", [(0, b"%PDF-")]),
    ("png", [(0, b"\x89PNG\r\n\x1a\n")]),
    ("jpg", [(0, b"\xff\xd8\xff")]),
    ("gif", [(0, b"GIF87a")]),
    ("bmp", [(0, b"BM")]),
    ("webp", [(0, b"RIFF"), (8, b"WEBP")]),
    ("tiff", [(0, b"II*\x00")]),
    ("tiff", [(0, b"MM\x00*")]),
    ("mp3", [(0, b"ID3")]),
    ("mp3", [(0, b"\xff\xfb")]),
    ("flac", [(0, b"fLaC")]),
    ("ogg", [(0, b"OggS")]),
    ("wav", [(0, b"RIFF"), (8, b"WAVE")]),
    ("mp4", [(4, b"ftyp")]),
    ("avi", [(0, b"RIFF"), (8, b"AVI ")]),
    ("mkv", [(0, b"\x1a\x45\xdf\xa3")]),
    ("zip", [(0, b"PK\x03\x04")]),
    ("zip", [(0, b"PK\x05\x06")]),
    ("tar", [(257, b"ustar")]),
    ("gz", [(0, b"\x1f\x8b")]),
    ("bz2", [(0, b"BZh")]),
    ("7z", [(0, b"7z\xbc\xaf'\x1c")]),
    ("rar", [(0, b"Rar!\x1a\x07")]),
    ("gif", [(0, b"GIF89a")]),
    ("svg", [(0, b"<?xml"), (None, b"<svg")]),
    ("svg", [(0, b"<svg")]),
]
HEAD_BYTES, SAMPLE_CHARS, WEBM_BYTES = 512, 2048, 64

# The member that tells an Office or EPUB container from a plain archive, in order.
CONTAINER_MEMBERS = [("docx", "word/document.xml"), ("xlsx", "xl/workbook.xml"), ("pptx", "ppt/presentation.xml"), ("epub", "META-INF/container.xml")]

# MIME type of each detected type.
TYPE_MIME = {
    "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp",
    "webp": "image/webp", "tiff": "image/tiff", "mp3": "audio/mpeg", "flac": "audio/flac", "ogg": "audio/ogg",
    "wav": "audio/wav", "mp4": "video/mp4", "avi": "video/x-msvideo", "mkv": "video/x-matroska", "webm": "video/webm",
    "docx": DOCX_MIME, "xlsx": XLSX_MIME, "pptx": PPTX_MIME, "epub": "application/epub+zip", "zip": "application/zip",
    "tar": "application/x-tar", "gz": "application/gzip", "bz2": "application/x-bzip2", "7z": "application/x-7z-compressed",
    "rar": "application/x-rar-compressed", "svg": "image/svg+xml", "html": "text/html", "xml": "application/xml",
    "json": "application/json", "csv": "text/csv", "md": "text/markdown", "txt": "text/plain",
}

# Extensions that are accepted for a type besides its own name.
EXTENSION_ALIASES = {"jpg": ["jpeg"], "tiff": ["tif"], "gz": ["gzip"], "txt": ["text"], "md": ["markdown"], "html": ["htm"]}

# Substrings that count as Markdown.
MARKDOWN_MARKS = ["# ", "## ", "### ", "* ", "- ", "> ", "```", "**", "__"]

# Suffixes of programs.
EXECUTABLE_SUFFIXES = [".exe", ".dll", ".bat", ".cmd", ".ps1", ".vbs", ".msi", ".scr", ".com", ".pif"]

# MIME type -> type, for HTTP responses.
MIME_TYPE = {
    "application/pdf": "pdf",
    "image/png": "png",
    "image/jpeg": "jpg",
    "image/gif": "gif",
    "image/webp": "webp",
    "image/svg+xml": "svg",
    "image/tiff": "tiff",
    "image/bmp": "bmp",
    "audio/mpeg": "mp3",
    "audio/wav": "wav",
    "audio/flac": "flac",
    "audio/ogg": "ogg",
    "audio/aac": "aac",
    "video/mp4": "mp4",
    "video/quicktime": "mov",
    "video/x-matroska": "mkv",
    "video/webm": "webm",
    "video/x-msvideo": "avi",
    DOCX_MIME: "docx",
    XLSX_MIME: "xlsx",
    PPTX_MIME: "pptx",
    "application/zip": "zip",
    "application/gzip": "gz",
    "application/x-tar": "tar",
    "application/x-bzip2": "bz2",
    "application/x-7z-compressed": "7z",
    "application/x-rar-compressed": "rar",
    "application/json": "json",
    "application/xml": "xml",
    "text/html": "html",
    "text/plain": "txt",
    "text/csv": "csv",
    "text/markdown": "md",
    "application/epub+zip": "epub",
}

# Personal data, in order of precedence: (type, pattern, confidence); case is ignored.
PII_PATTERNS = [
    ("credit_card", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b", "high"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "high"),
    ("email", r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b", "high"),
    ("phone_us", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b", "high"),
    ("phone_intl", r"\b\+\d{1,3}[-.\s]\d{1,4}[-.\s]\d{4,10}\b", "medium"),
    ("ip_address", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "medium"),
    ("iban", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}(?:[A-Z0-9]?){0,16}\b", "high"),
    ("passport", r"\b[A-Z]{1,2}[0-9]{6,9}\b", "low"),
    ("date_of_birth", r"\b(?:born|dob|date of birth)[\s:]*\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\b", "medium"),
    ("url_with_token", r"https?://[^\s]+(?:token|key|secret|auth)=[^\s&]+", "high"),
    ("api_key", r"\b(?:sk|pk|api|key|secret)[-_][a-zA-Z0-9]{16,}\b", "high"),
    ("aws_key", r"\bAKIA[0-9A-Z]{16}\b", "high"),
]

# Groups of types.
IMAGE_TYPES = ["png", "jpg", "jpeg", "gif", "bmp", "webp", "tiff", "tif"]
AUDIO_TYPES = ["mp3", "wav", "flac", "ogg", "m4a", "aac"]
VIDEO_TYPES = ["mp4", "mov", "mkv", "webm", "avi"]
TEXT_TYPES = ["txt", "md", "html", "xml", "json"]
ARCHIVE_MEMBER_SUFFIXES = [".txt", ".md", ".csv", ".json", ".xml", ".html", ".htm", ".py", ".js", ".ts", ".css", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".rst", ".log", ".sql"]

#: White space as Python's str methods see it, in a form that Java and RE2 both read.
WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WHITE = WHITE.replace("[", "[^", 1)
#: Line ends as str.splitlines sees them.
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"

#: Frequent words of some languages, for the built-in guess of a text's language.
LANGUAGE_WORDS = {
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit", "von", "zu", "den", "auf", "sich"],
    "en": ["the", "and", "of", "to", "is", "that", "it", "was", "for", "with", "as", "this", "by", "be"],
    "es": ["el", "los", "las", "y", "que", "es", "una", "por", "con", "para", "del", "se", "como", "pero"],
    "fr": ["le", "les", "et", "est", "une", "dans", "qui", "pour", "pas", "sur", "des", "du", "au", "avec"],
}
