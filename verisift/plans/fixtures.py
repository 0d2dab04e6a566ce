"""Small files of every format, made here: the fixture queries and the tests read them."""

from __future__ import annotations

import bz2
import gzip
import io
import struct
import tarfile
import wave
import zipfile
import zlib


def png(width: int = 1, height: int = 1) -> bytes:
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    rows = b"".join(b"\0" + b"\xff\0\0" * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def zipped(members: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in members.items():
            z.writestr(k, v)
    return out.getvalue()


def pdf() -> bytes:
    return (
        b"%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Type/Pages/Kids[3 0 R]/Count 1>>endobj\n"
        b"3 0 obj<</Type/Page/Parent 2 0 R/MediaBox[0 0 9 9]>>endobj\nxref\n0 4\ntrailer<</Root 1 0 R/Size 4>>\nstartxref\n9\n%%EOF\n"
    )


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def docx() -> bytes:
    body = "<w:p><w:r><w:t>Hello big world</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    return zipped({"[Content_Types].xml": "<Types/>", "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def xlsx() -> bytes:
    return zipped({
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>name</t></is></c><c r="C1"><v>7</v></c></row></sheetData></worksheet>',
    })


def pptx() -> bytes:
    return zipped({
        "ppt/presentation.xml": f'<p:presentation {P}><p:sldIdLst><p:sldId id="1" r:id="rId1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": '<Relationships xmlns="x"><Relationship Id="rId1" Target="slides/slide1.xml"/></Relationships>',
        "ppt/slides/slide1.xml": f"<p:sld {P}><a:p><a:r><a:t>Title here</a:t></a:r></a:p></p:sld>",
    })


def wav() -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(44100)
        w.writeframes(b"\0\0" * 44100)
    return out.getvalue()


def tar(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def exif_jpeg() -> bytes:
    """A JPEG with camera, exposure and GPS entries, and a frame header."""
    order = ">"

    def directory(items, at):
        head, data = struct.pack(">H", len(items)), b""
        room = at + 2 + 12 * len(items) + 4
        for tag, kind, count, value in items:
            if len(value) <= 4:
                head += struct.pack(">HHI", tag, kind, count) + value.ljust(4, b"\0")
            else:
                head += struct.pack(">HHI", tag, kind, count) + struct.pack(">I", room + len(data))
                data += value
        return head + b"\0" * 4 + data

    text = lambda s: (2, len(s) + 1, s.encode() + b"\0")
    rationals = lambda *v: (5, len(v), b"".join(struct.pack(order + "II", *x) for x in v))
    image = [(271, *text("Acme")), (272, *text("Cam 1")), (34665, 4, 1, b"????"), (34853, 4, 1, b"????")]
    exif = [(33434, *rationals((1, 125))), (33437, *rationals((28, 10))), (34855, 3, 1, struct.pack(">H", 200)), (36867, *text("2024:01:02 03:04:05")), (37386, *rationals((50, 1)))]
    gps = [(1, *text("S")), (2, *rationals((10, 1), (30, 1), (0, 1))), (3, *text("E")), (4, *rationals((20, 1), (15, 1), (3600, 100))), (6, *rationals((1234, 10)))]
    first = directory(image, 8)
    exif_at = 8 + len(first)
    second = directory(exif, exif_at)
    gps_at = exif_at + len(second)
    image = [(t, k, c, struct.pack(">I", exif_at) if t == 34665 else struct.pack(">I", gps_at) if t == 34853 else v) for t, k, c, v in image]
    block = b"MM\0*" + struct.pack(">I", 8) + directory(image, 8) + second + directory(gps, gps_at)
    app1 = b"Exif\0\0" + block
    sof = b"\x08" + struct.pack(">HHB", 4, 6, 3) + b"\x01\x11\0" * 3
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xc0" + struct.pack(">H", len(sof) + 2) + sof + b"\xff\xda\0\x02\xff\xd9"


def fixture_files() -> dict[str, bytes]:
    return {
        "report.pdf": pdf(), "photo.png": png(3, 2), "photo.pdf": png(), "corrupted.pdf": b"%PDF-1.4\ngarbage", "document.docx": docx(), "corrupted.docx": b"PK\x03\x04junk",
        "sheet.xlsx": xlsx(), "deck.pptx": pptx(), "archive.zip": zipped({"readme.txt": "hello", "data.json": "{}"}), "photo.zip": png(), "data.json": b'{"a": [1, 2]}', "broken.json": b'{"a": ',
        "data.csv": b"a,b,c\n1,2,3\n4,5,6\n", "readme.txt": b"Just some prose.\nAnother line here.\nAnd the last one.\n", "notes.md": b"# Title\n\n- item\n> quote\n", "empty.pdf": b"",
        "book.epub": zipped({"META-INF/container.xml": "<c/>", "b.xhtml": "<p>two</p>", "a.html": "<p>one</p>"}), "evil.zip": zipped({"readme.txt": "x", "bin/MALWARE.EXE": b"MZ"}),
        "a.tar": tar({"note.txt": b"12345"}), "a.gz": gzip.compress(b"text inside"), "bad.gz": b"\x1f\x8bxx", "a.bz2": bz2.compress(b"text"), "a.7z": b"7z\xbc\xaf'\x1c" + b"\0" * 20, "a.rar": b"Rar!\x1a\x07\0" + b"\0" * 20,
        "movie.mp4": b"\0\0\0\x18ftypisom" + b"\0" * 40, "movie.mov": b"\0\0\0\x18ftypqt  " + b"\0" * 40, "movie.mkv": b"\x1a\x45\xdf\xa3" + b"\0" * 40, "movie.webm": b"\x1a\x45\xdf\xa3\0webm" + b"\0" * 40,
        "tone.wav": wav(), "stub.mp3": b"ID3" + b"\0" * 30, "good.xml": b"<?xml version='1.0'?><a>x<b>y</b>z</a>", "bad.xml": b"<?xml version='1.0'?><a><b></a>", "page.html": b"<!DOCTYPE html><html><body><p>Hi  there</p></body></html>",
        "pic.svg": b"<svg xmlns='http://www.w3.org/2000/svg'/>", "camera.jpg": exif_jpeg(), "noext": b"plain words only", "blank.txt": b"  \n ", "prose.txt": b"one, two\nthree, four\nfive, six\n", "null.json": b"null\n", "binary.bin": b"\x01\x00\x02\x00",
    }
