"""Parsers of container and media formats over bytes, from the standard library alone.

``validate`` gives (valid, errors, warnings), ``inspect`` the metadata of a type, ``extract`` its text. They never raise. They run inside
Arrow functions, so a file's bytes cross to Python once. What needs a library that isn't here (page text of PDFs, audio
frames, video streams) is read from headers as far as that goes; a warning or note says so.
"""

from __future__ import annotations

import bz2
import csv
import gzip
import io
import json
import posixpath
import re
import struct
import tarfile
import xml.etree.ElementTree as ET
import zipfile
import zlib

from verisift.functions import rules

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def decode(content: bytes) -> str:
    """UTF-8 with replacement, any line end as a newline."""
    return content.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")


def tokens(text: str) -> int:
    return max(1, int(len(text.split()) / 0.75))


def suffix_of(name: str) -> str:
    base = posixpath.basename(name)
    at = base.rfind(".")
    return base[at:].lower() if 0 < at < len(base) - 1 else ""


def zip_listing(content: bytes) -> list[str] | None:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return z.namelist()
    except Exception:  # whatever a broken archive provokes
        return None


# --------------------------------------------------------------------------- Office containers

def docx_parts(content: bytes) -> tuple[list[str], list[list[str]]]:
    """Body paragraphs, and the rows of tables as lists of cell texts."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" if t.tag in (f"{_W}br", f"{_W}cr") else "" for t in e.iter())
    if body is None:
        return [], []
    rows = [["\n".join(text(p) for p in c.findall(f"{_W}p")) for c in r.findall(f"{_W}tc")] for t in body.findall(f"{_W}tbl") for r in t.findall(f"{_W}tr")]
    return [text(p) for p in body.findall(f"{_W}p")], rows


def pptx_slides(content: bytes) -> list[list[str]]:
    """Stripped, non-empty paragraphs of each slide, in presentation order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        deck = ET.fromstring(z.read("ppt/presentation.xml"))
        ids = [s.get(f"{_R}id") for s in deck.iter() if s.tag.endswith("}sldId")]
        rels = {}
        if "ppt/_rels/presentation.xml.rels" in z.namelist():
            rels = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(z.read("ppt/_rels/presentation.xml.rels"))}
        out = []
        for i in ids:
            target = posixpath.normpath(posixpath.join("/ppt", rels[i])).lstrip("/")
            root = ET.fromstring(z.read(target))
            texts = ["".join(t.text or "" for t in p.iter(f"{_A}t")).strip() for p in root.iter(f"{_A}p")]
            out.append([t for t in texts if t])
        return out


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref.upper())[0]:
        n = n * 26 + ord(c) - 64
    return n


def xlsx_sheets(content: bytes) -> list[tuple[str, int, int, list[list[str]]]]:
    """(title, rows, columns, cell texts by row) of each sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        book = ET.fromstring(z.read("xl/workbook.xml"))
        rels = {}
        if "xl/_rels/workbook.xml.rels" in names:
            rels = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
        out = []
        for k, sheet in enumerate(book.iter(f"{_S}sheet"), 1):
            target = posixpath.normpath(posixpath.join("/xl", rels.get(sheet.get(f"{_R}id"), f"worksheets/sheet{k}.xml"))).lstrip("/")
            last_row = last_col = 0
            cells = []
            for row in ET.fromstring(z.read(target)).iter(f"{_S}row"):
                last_row = int(row.get("r") or last_row + 1)
                col, texts = 0, []
                for c in row.findall(f"{_S}c"):
                    col = _column(c.get("r") or "") or col + 1
                    last_col = max(last_col, col)
                    value, inline = c.find(f"{_S}v"), c.find(f"{_S}is")
                    kind = c.get("t", "n")
                    if kind == "inlineStr" and inline is not None:
                        texts.append("".join(t.text or "" for t in inline.iter(f"{_S}t")))
                    elif value is not None and value.text is not None:
                        texts.append(shared[int(value.text)] if kind == "s" else {"1": "True", "0": "False"}.get(value.text, value.text) if kind == "b" else value.text)
                cells.append(texts)
            out.append((sheet.get("name", ""), last_row, last_col, cells))
        return out


def epub_pages(content: bytes, ordered: bool) -> list[str]:
    """HTML members with their tags replaced by blanks, by name or as they come."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = [n for n in (sorted(z.namelist()) if ordered else z.namelist()) if n.endswith((".html", ".xhtml", ".htm"))]
        return [re.sub(r"<[^>]+>", " ", z.read(n).decode("utf-8", "replace")) for n in names]


# --------------------------------------------------------------------------- PDF

def pdf_probe(content: bytes) -> dict:
    """Number of pages and whether images occur, from the objects themselves (object streams included)."""
    if b"%%EOF" not in content and b"startxref" not in content:
        raise ValueError("no end-of-file marker or cross-reference found")
    text = content
    for m in re.finditer(rb"stream\r?\n", content):
        head = content[max(0, m.start() - 300):m.start()]
        if b"/ObjStm" in head and b"FlateDecode" in head:
            try:
                text += zlib.decompressobj().decompress(content[m.end():])
            except zlib.error:
                continue
    pages = len(re.findall(rb"/Type\s*/Page(?![A-Za-z])", text))
    return {"pages": pages, "encrypted": False, "contains_images": bool(re.search(rb"/Subtype\s*/Image\b", text)), "contains_tables": False}


def pdf_text(content: bytes) -> list[str]:
    """Strings shown by the content streams, a stream at a time. A plain reading: encodings of embedded fonts are not resolved."""
    out = []
    for m in re.finditer(rb"stream\r?\n", content):
        end = content.find(b"endstream", m.end())
        data = content[m.end():end if end > 0 else len(content)]
        if b"FlateDecode" in content[max(0, m.start() - 300):m.start()]:
            try:
                data = zlib.decompressobj().decompress(data)
            except zlib.error:
                continue
        if b"BT" not in data:
            continue
        shown = [re.sub(rb"\\([()\\])", rb"\1", s).decode("latin-1") for s in re.findall(rb"\(((?:\\.|[^\\()])*)\)", data)]
        if any(s.strip() for s in shown):
            out.append(" ".join(shown))
    return out


# --------------------------------------------------------------------------- images, audio, video

def image_info(content: bytes, kind: str) -> dict:
    """width, height, mode, dpi, has_transparency; raises ValueError for broken files."""
    out: dict = {"dpi": None, "has_transparency": False}
    if kind == "png":
        pos, seen, first = 8, set(), True
        while pos + 8 <= len(content):
            length, name = struct.unpack(">I4s", content[pos:pos + 8])
            data = content[pos + 8:pos + 8 + length]
            if len(data) < length or pos + 12 + length > len(content):
                raise ValueError("truncated PNG chunk")
            if zlib.crc32(name + data) != struct.unpack(">I", content[pos + 8 + length:pos + 12 + length])[0]:
                raise ValueError(f"broken PNG chunk {name.decode('latin-1')}")
            if first and name != b"IHDR":
                raise ValueError("PNG without header")
            if name == b"IHDR":
                w, h, depth, color = struct.unpack(">IIBB", data[:10])
                out |= {"width": w, "height": h, "mode": {0: "1" if depth == 1 else "I;16" if depth == 16 else "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}.get(color, "?")}
                out["has_transparency"] = color in (4, 6)
            elif name == b"tRNS":
                out["has_transparency"] = True
            elif name == b"pHYs" and len(data) == 9 and data[8] == 1:
                x, y = struct.unpack(">II", data[:8])
                out["dpi"] = (round(x * 0.0254), round(y * 0.0254))
            seen.add(name)
            first = False
            pos += 12 + length
            if name == b"IEND":
                break
        if not {b"IHDR", b"IDAT", b"IEND"} <= seen:
            raise ValueError("incomplete PNG")
    elif kind in ("jpg", "jpeg"):
        pos, mode = 2, None
        while pos + 4 <= len(content):
            if content[pos] != 0xFF:
                raise ValueError("broken JPEG marker")
            marker, length = content[pos + 1], struct.unpack(">H", content[pos + 2:pos + 4])[0]
            data = content[pos + 4:pos + 2 + length]
            if marker == 0xE0 and data[:5] == b"JFIF\0" and data[7] in (1, 2):
                x, y = struct.unpack(">HH", data[8:12])
                out["dpi"] = (x, y) if data[7] == 1 else (round(x * 2.54), round(y * 2.54))
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w, parts = struct.unpack(">HHB", data[1:6])
                mode = {1: "L", 3: "RGB", 4: "CMYK"}.get(parts, "?")
                out |= {"width": w, "height": h, "mode": mode}
            if marker == 0xDA:
                break
            pos += 2 + length
        if mode is None:
            raise ValueError("JPEG without frame header")
    elif kind == "gif":
        if len(content) < 13:
            raise ValueError("truncated GIF")
        w, h = struct.unpack("<HH", content[6:10])
        clear = re.search(rb"\x21\xf9\x04([\x00-\xff])", content)
        out |= {"width": w, "height": h, "mode": "P", "has_transparency": bool(clear and clear[1][0] & 1)}
    elif kind == "bmp":
        if len(content) < 30:
            raise ValueError("truncated BMP")
        w, h = struct.unpack("<ii", content[18:26])
        bits = struct.unpack("<H", content[28:30])[0]
        out |= {"width": w, "height": abs(h), "mode": {1: "1", 4: "P", 8: "P", 24: "RGB", 32: "RGB"}.get(bits, "RGB")}
    elif kind == "webp":
        chunk = content[12:16]
        if chunk == b"VP8 " and len(content) >= 30:
            w, h = struct.unpack("<HH", content[26:30])
            out |= {"width": w & 0x3FFF, "height": h & 0x3FFF, "mode": "RGB"}
        elif chunk == b"VP8L" and len(content) >= 25:
            bits = struct.unpack("<I", content[21:25])[0]
            clear = bool(bits >> 28 & 1)
            out |= {"width": (bits & 0x3FFF) + 1, "height": (bits >> 14 & 0x3FFF) + 1, "mode": "RGBA" if clear else "RGB", "has_transparency": clear}
        elif chunk == b"VP8X" and len(content) >= 30:
            clear = bool(content[20] & 0x10)
            out |= {"width": int.from_bytes(content[24:27], "little") + 1, "height": int.from_bytes(content[27:30], "little") + 1, "mode": "RGBA" if clear else "RGB", "has_transparency": clear}
        else:
            raise ValueError("broken WebP")
    elif kind in ("tiff", "tif"):
        tags = tiff_tags(content)["Image"]
        if 256 not in tags or 257 not in tags:
            raise ValueError("TIFF without dimensions")
        bits = tags.get(258, [1])
        kind_ = tags.get(262, [1])[0]
        out |= {"width": int(tags[256][0]), "height": int(tags[257][0]), "mode": {2: "RGBA" if len(bits) == 4 else "RGB", 3: "P", 5: "CMYK"}.get(kind_, "1" if bits[0] == 1 else "L")}
        out["has_transparency"] = out["mode"] == "RGBA"
        if 282 in tags and 283 in tags and tags.get(296, [2])[0] in (2, 3):
            scale = 2.54 if tags.get(296, [2])[0] == 3 else 1
            out["dpi"] = tuple(round(n / (d or 1) * scale) for n, d in (tags[282][0], tags[283][0]))
    else:
        raise ValueError("no reader for this image type")
    return out


def tiff_tags(data: bytes) -> dict[str, dict[int, list]]:
    """The directories of a TIFF structure: Image, EXIF, GPS; rationals as (numerator, denominator)."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise ValueError("not a TIFF structure")
    size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
    letter = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}

    def directory(at: int) -> dict[int, list]:
        out = {}
        if at + 2 > len(data):
            return out
        (n,) = struct.unpack(order + "H", data[at:at + 2])
        for k in range(n):
            entry = data[at + 2 + 12 * k:at + 14 + 12 * k]
            if len(entry) < 12:
                break
            tag, kind, count = struct.unpack(order + "HHI", entry[:8])
            width = size.get(kind, 1) * count
            start = at + 10 + 12 * k if width <= 4 else struct.unpack(order + "I", entry[8:12])[0]
            value = data[start:start + width]
            if len(value) < width:
                continue
            if kind == 2:
                out[tag] = [value.split(b"\0")[0].decode("utf-8", "replace")]
            elif kind in (5, 10):
                flat = struct.unpack(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", value)
                out[tag] = list(zip(flat[::2], flat[1::2]))
            elif kind in letter:
                out[tag] = list(struct.unpack(f"{order}{count}{letter[kind]}", value))
            else:
                out[tag] = [value]
        return out

    image = directory(struct.unpack(order + "I", data[4:8])[0])
    child = lambda tag: directory(image[tag][0]) if tag in image and isinstance(image[tag][0], int) else {}
    return {"Image": image, "EXIF": child(0x8769), "GPS": child(0x8825)}


def audio_info(content: bytes, kind: str) -> dict | None:
    """duration, bitrate, sample_rate, channels from headers; None if they hold nothing that can be read."""
    if kind == "wav":
        pos, rate, byte_rate, channels = 12, None, None, None
        while pos + 8 <= len(content):
            name, length = content[pos:pos + 4], struct.unpack("<I", content[pos + 4:pos + 8])[0]
            if name == b"fmt " and len(content) >= pos + 24:
                channels, rate, byte_rate = struct.unpack("<HII", content[pos + 10:pos + 20])
            elif name == b"data" and byte_rate:
                return {"duration": round(length / byte_rate, 2), "bitrate": byte_rate * 8, "sample_rate": rate, "channels": channels}
            pos += 8 + length + (length & 1)
        return None
    if kind == "flac" and len(content) >= 26:
        packed = int.from_bytes(content[18:26], "big")
        rate, channels, samples = packed >> 44, (packed >> 41 & 7) + 1, packed & (1 << 36) - 1
        length = samples / rate if rate else 0
        return {"duration": round(length, 2), "bitrate": int(len(content) * 8 / length) if length else 0, "sample_rate": rate, "channels": channels}
    if kind == "mp3":
        at = 0
        if content[:3] == b"ID3" and len(content) >= 10:
            at = 10 + (content[6] << 21 | content[7] << 14 | content[8] << 7 | content[9])
        frame = re.compile(rb"\xff[\xfa\xfb]").search(content, at)
        if frame and len(content) >= frame.start() + 4:
            b = content[frame.start():frame.start() + 4]
            rates = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 0]
            bitrate, rate = rates[b[2] >> 4] * 1000, [44100, 48000, 32000, 0][b[2] >> 2 & 3]
            if bitrate and rate:
                return {"duration": round((len(content) - frame.start()) * 8 / bitrate, 2), "bitrate": bitrate, "sample_rate": rate, "channels": 1 if b[3] >> 6 == 3 else 2}
        return None
    if kind == "ogg":
        at = content.find(b"\x01vorbis")
        last = content.rfind(b"OggS")
        if at >= 0 and len(content) >= at + 24:
            channels, rate = content[at + 11], struct.unpack("<I", content[at + 12:at + 16])[0]
            nominal = struct.unpack("<i", content[at + 20:at + 24])[0]
            granule = struct.unpack("<q", content[last + 6:last + 14])[0] if last >= 0 else 0
            return {"duration": round(granule / rate, 2) if rate else 0.0, "bitrate": nominal, "sample_rate": rate, "channels": channels}
    return None


def video_info(content: bytes) -> dict:
    """Duration of MP4 families from the movie header; else a note."""
    at = content.find(b"mvhd")
    if at >= 0 and len(content) >= at + 32:
        if content[at + 4] == 1:
            scale, length = struct.unpack(">IQ", content[at + 24:at + 36])
        else:
            scale, length = struct.unpack(">II", content[at + 16:at + 24])
        if scale:
            return {"duration": round(length / scale, 2)}
    return {"inspection_note": "Install ffprobe for full video metadata"}


# --------------------------------------------------------------------------- validation

def _zip_member(content: bytes, member: str, label: str) -> str | None:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            if member not in z.namelist():
                return f"Missing {member} – not a valid {label}"
    except zipfile.BadZipFile:
        return f"File is not a valid {label} (bad ZIP structure)"
    except Exception as e:
        return f"{label} validation failed: {e}"
    return None


def _attempt(prefix: str, action) -> str | None:
    try:
        action()
    except Exception as e:
        return f"{prefix}: {e}"
    return None


def validate(content: bytes, kind: str) -> tuple[list[str], list[str]]:
    """(errors, warnings) of bytes as a type that needs a parser; valid if there are no errors."""
    error, warnings = None, []
    if kind == "pdf":
        if not content.startswith(b"%PDF-"):
            return ["File is not a valid PDF"], []
        try:
            if pdf_probe(content)["pages"] == 0:
                warnings.append("PDF has no pages")
        except Exception as e:
            error = f"PDF is corrupted or unreadable: {e}"
    elif kind in ("docx", "xlsx", "pptx"):
        member = dict(rules.CONTAINER_MEMBERS)[kind]
        reader = {"docx": docx_parts, "xlsx": xlsx_sheets, "pptx": pptx_slides}[kind]
        error = _zip_member(content, member, kind.upper()) or _attempt(f"{kind.upper()} is corrupted", lambda: reader(content))
    elif kind == "epub":
        error = _zip_member(content, "META-INF/container.xml", "EPUB")
    elif kind == "csv":
        try:
            if not list(csv.reader(io.StringIO(content.decode("utf-8", "replace"), newline=""))):
                warnings.append("CSV file is empty")
        except Exception as e:
            error = f"CSV is unreadable: {e}"
    elif kind in ("xml", "svg"):
        error = _attempt("XML parse error", lambda: ET.parse(io.BytesIO(content)))
    elif kind == "json":
        error = _attempt("JSON parse error", lambda: json.loads(decode(content)))
    elif kind in rules.IMAGE_TYPES:
        error = _attempt("Image is corrupted or unreadable", lambda: image_info(content, kind))
    elif kind in rules.AUDIO_TYPES:
        try:
            if audio_info(content, kind) is None:
                warnings.append("Audio metadata could not be read")
        except Exception as e:
            error = f"Audio file is unreadable: {e}"
    elif kind == "zip":
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                if bad := z.testzip():
                    error = f"ZIP integrity check failed on: {bad}"
        except zipfile.BadZipFile as e:
            error = f"Invalid ZIP file: {e}"
        except Exception as e:
            error = f"ZIP validation error: {e}"
    elif kind == "tar":
        error = _attempt("TAR validation error", lambda: tarfile.open(fileobj=io.BytesIO(content)).getmembers())
    elif kind == "gz":
        error = _attempt("GZ validation error", lambda: gzip.GzipFile(fileobj=io.BytesIO(content)).read(1024))
    elif kind == "bz2":
        error = _attempt("BZ2 validation error", lambda: bz2.BZ2File(io.BytesIO(content)).read(1024))
    return [error] if error else [], warnings


# --------------------------------------------------------------------------- metadata

def inspect(content: bytes, kind: str) -> dict:
    """Metadata of a type that needs a parser. ``_text`` is the text whose language the caller may guess."""
    out: dict = {}
    try:
        if kind == "pdf":
            out |= pdf_probe(content)
            out["_text"] = "\n".join(pdf_text(content))
            out["estimated_tokens"] = tokens(out["_text"])
        elif kind == "docx":
            paragraphs, _ = docx_parts(content)
            words = sum(len(p.split()) for p in paragraphs)
            text = "\n".join(paragraphs)
            out |= {"paragraphs": len(paragraphs), "words": words, "estimated_pages": max(1, round(words / 300)), "_text": text, "estimated_tokens": tokens(text)}
        elif kind == "xlsx":
            sheets = xlsx_sheets(content)
            flat = " ".join(c for _, _, _, rows in sheets for r in rows for c in r)
            out |= {"sheets": len(sheets), "sheet_names": [s[0] for s in sheets], "rows": sum(s[1] for s in sheets), "columns": max((s[2] for s in sheets), default=0), "estimated_tokens": tokens(flat)}
        elif kind == "pptx":
            slides = pptx_slides(content)
            text = "\n".join(t for s in slides for t in s)
            out |= {"slides": len(slides), "text_length": len(text), "_text": text, "estimated_tokens": tokens(text)}
        elif kind == "epub":
            text = " ".join(epub_pages(content, ordered=False))
            out |= {"_text": text, "estimated_tokens": tokens(text)}
        elif kind == "csv":
            rows = list(csv.reader(io.StringIO(content.decode("utf-8", "replace"), newline="")))
            out |= {"rows": len(rows), "columns": max((len(r) for r in rows), default=0), "estimated_tokens": tokens(" ".join(" ".join(r) for r in rows))}
        elif kind in rules.IMAGE_TYPES or kind == "svg":
            info = image_info(content, kind)
            dpi = info.pop("dpi")
            out |= info | ({"dpi": {"x": dpi[0], "y": dpi[1]}} if dpi else {})
        elif kind in rules.AUDIO_TYPES:
            out |= audio_info(content, kind) or {}
        elif kind in rules.VIDEO_TYPES:
            out |= video_info(content)
        elif kind == "zip":
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                members = z.infolist()
            out |= {"file_count": len(members), "total_uncompressed_bytes": sum(m.file_size for m in members), "total_compressed_bytes": sum(m.compress_size for m in members)}
        elif kind == "tar":
            with tarfile.open(fileobj=io.BytesIO(content)) as t:
                members = t.getmembers()
            out |= {"file_count": len(members), "total_bytes": sum(m.size for m in members if m.isfile())}
    except Exception as e:
        out["inspection_error"] = str(e)
    return out


# --------------------------------------------------------------------------- text

def _strip_tags(html: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", html)).strip()


def _archive_text(content: bytes, suffix: str) -> str:
    parts = []
    if suffix == ".zip":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for m in z.infolist():
                if suffix_of(m.filename) in rules.ARCHIVE_MEMBER_SUFFIXES:
                    try:
                        parts.append(f"[{m.filename}]\n{z.read(m.filename).decode('utf-8', 'replace')}")
                    except Exception:  # an unreadable member is skipped, the others count
                        continue
    elif suffix == ".tar":
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            for m in t.getmembers():
                if m.isfile() and suffix_of(m.name) in rules.ARCHIVE_MEMBER_SUFFIXES:
                    parts.append(f"[{m.name}]\n{t.extractfile(m).read().decode('utf-8', 'replace')}")
    elif suffix == ".gz":
        try:
            parts.append(gzip.decompress(content).decode("utf-8", "replace"))
        except Exception:  # as for members
            pass
    return "\n\n".join(parts)


def extract(content: bytes, kind: str, path: str) -> tuple[str, str, list[str]]:
    """(text, extractor, warnings) of a type that needs a parser."""
    label = {"csv": "CSV", "xml": "XML", "json": "JSON", "docx": "DOCX", "pptx": "PPTX", "xlsx": "XLSX", "epub": "EPUB", "pdf": "PDF"}.get(kind, "Archive")
    try:
        if kind == "pdf":
            pdf_probe(content)
            return "\n\n".join(pdf_text(content)), "pdf", []
        if kind == "docx":
            paragraphs, rows = docx_parts(content)
            lines = [p for p in paragraphs if p.strip()]
            lines += [x for x in (" | ".join(c.strip() for c in r if c.strip()) for r in rows) if x]
            return "\n".join(lines), "docx", []
        if kind == "pptx":
            return "\n\n".join(f"[Slide {i}]\n" + "\n".join(s) for i, s in enumerate(pptx_slides(content), 1) if s), "pptx", []
        if kind == "xlsx":
            parts = []
            for title, _, _, rows in xlsx_sheets(content):
                lines = [" | ".join(r) for r in rows if r]
                if lines:
                    parts.append(f"[Sheet: {title}]\n" + "\n".join(lines))
            return "\n\n".join(parts), "xlsx", []
        if kind == "csv":
            return "\n".join(" | ".join(r) for r in csv.reader(io.StringIO(content.decode("utf-8", "replace"), newline=""))), "csv", []
        if kind == "xml":
            parts = []
            for e in ET.parse(io.BytesIO(content)).iter():
                parts += [t.strip() for t in (e.text, e.tail) if t and t.strip()]
            return "\n".join(parts), "xml.etree", []
        if kind == "json":
            return json.dumps(json.loads(decode(content)), indent=2, ensure_ascii=False), "json", []
        if kind == "epub":
            return "\n\n".join(t for t in (_strip_tags(p) for p in epub_pages(content, ordered=True)) if t), "epub+zip", []
        text = _archive_text(content, suffix_of(path))
        return text, "archive", [] if text else ["No readable text files found inside archive"]
    except Exception as e:
        return "", "archive" if label == "Archive" else "", [f"{label} extraction failed: {e}"]
