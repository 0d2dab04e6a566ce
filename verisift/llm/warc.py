"""WARC: archives of one gzip member per record, and a sequential reader.

Writing. Digests are computed by Spark; equal payloads of at least 100 bytes are grouped by digest, the smallest
page_id of a group is stored as ``response``, the others as ``revisit`` records (identical-payload-digest
profile: HTTP headers only, with the full Content-Length, and WARC-Refers-To). Each task streams its rows into archives
that roll over at ARCHIVE_BYTES, in the shared folder. File names carry the task attempt and the manifest, a Parquet table
committed by Spark, lists the files of the attempts that counted: retries leave no doubles.

Reading. Archives are read in slices of 64 KB through an incremental zlib decompressor. Each member is
framed by its Content-Length; the block digest of every record and the payload digest of every response are recomputed
and compared. A record that is cut off, misframed or doesn't match its digest raises ``WarcError`` or, with ``strict=False``, ends
its archive with a row whose ``error`` is set.

Defined cases: null html is an empty payload, null url an empty target. Payloads under 100 bytes are always
responses. Rows with a null page_id are never referred to (a group with null ids only has responses
only). Rows that repeat the smallest page_id of their group are all responses. Line breaks, blanks and non-ASCII bytes in a URL are
percent-encoded in the header. An empty table gives no archives and no rows. Extra columns are ignored, whatever their names. Payloads of any
length are written from the row's bytes and read in slices. A folder without a scheme is one of Spark's default file system.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, qualified, scratch_path, ship, shuffle_parts, table

MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 64 << 20
SLICE = 1 << 16
FETCHED = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:page:"


class WarcError(ValueError):
    """An archive that breaks the format or a digest."""


# --------------------------------------------------------------------------- writing

def record_bytes(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as one gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("Content-Length", str(len(block)))])
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1\r\n" + head.encode("ascii") + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{ID_PREFIX}{'' if page_id is None else page_id}>"),
        ("WARC-Date", FETCHED),
        ("WARC-Target-URI", quote(url or "", safe="!#$%&'()*+,/:;=?@[]~")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{ID_PREFIX}{refers_to}>"), ("WARC-Profile", PROFILE)]
    return record_bytes(fields, http if refers_to is not None else http + payload)


def info_record() -> bytes:
    return record_bytes([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:archive:info>"), ("WARC-Date", FETCHED), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _write(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = _file_system(folder)
        files.create_dir(top, recursive=True)
        ctx = TaskContext.get()
        out, name, size, n, done = None, "", 0, 0, []

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((name, n, size))
                out = None

        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")]
            for i in range(batch.num_rows):
                if out is None:
                    name = f"part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}-{len(done):04d}.warc.gz"
                    out, n = files.open_output_stream(f"{top}/{name}", compression=None), 0
                    size = out.write(info_record()) or 0
                page_id, url, html, digest, refers_to = (c[i].as_py() for c in cols)
                data = page_record(page_id, url, html, digest, refers_to)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], names=["archive", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives and returns the manifest: archive, records, bytes."""
    spark = pages.sparkSession
    ship(spark)
    folder = qualified(spark, folder)
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    shared = (
        pages.select(F.col(id_col).cast("long").alias("page_id"), html.alias("html"))
        .where(F.length("html") >= MIN_REVISIT_BYTES)
        .groupBy(F.sha2("html", 256).alias("digest"))
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and first_id is not null")
        .drop("n")
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    plan = rows.join(shared, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))
    return materialise(plan.mapInArrow(_write(folder, archive_bytes), "archive string, records long, bytes long"), "manifest")


# --------------------------------------------------------------------------- reading

class MemberStream:
    """Bytes of one gzip member at a time, out of slices of the archive."""

    def __init__(self, source):
        self.source, self.rest, self.z, self.out = source, b"", None, b""

    def next_member(self) -> bool:
        if not self.rest:
            self.rest = self.source.read(SLICE)
        if not self.rest:
            return False
        self.z, self.out = zlib.decompressobj(31), b""
        return True

    def _more(self) -> bytes:
        """Some more bytes of this member; empty at its end."""
        while not self.z.eof:
            data = self.z.unconsumed_tail or self.rest
            self.rest = b""
            if not data:
                data = self.source.read(SLICE)
                if not data:
                    raise WarcError("archive ends inside a member")
            try:
                got = self.z.decompress(data, SLICE)
            except zlib.error as e:
                raise WarcError(f"bad gzip data: {e}") from None
            if self.z.eof:
                self.rest = self.z.unused_data
            if got:
                return got
        return b""

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes:
        while mark not in self.out:
            got = self._more()
            if not got or len(self.out) > most:
                raise WarcError("record header is not complete")
            self.out += got
        head, _, self.out = self.out.partition(mark)
        return head

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.out:
                self.out = self._more()
                if not self.out:
                    raise WarcError("record is shorter than its Content-Length")
            piece, self.out = self.out[:n], self.out[n:]
            n -= len(piece)
            yield piece

    def end(self) -> None:
        tail = self.out
        while got := self._more():
            tail += got
            if len(tail) > 4:
                break
        if tail != b"\r\n\r\n":
            raise WarcError("record does not end after its Content-Length")


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def read_records(source, *, payloads: bool = False) -> Iterator[dict]:
    """All records of an archive in order. ``source`` has read(n)."""
    stream = MemberStream(source)
    while stream.next_member():
        head = stream.until(b"\r\n\r\n")
        if not head.startswith(b"WARC/1."):
            raise WarcError("not a WARC record")
        fields = _fields(head)
        length = fields.get("content-length", "")
        if not (length.isascii() and length.isdigit()):
            raise WarcError("record has no Content-Length")
        block, payload, http, kept, size = hashlib.sha256(), hashlib.sha256(), b"", [], 0
        is_http, in_http = fields.get("content-type", "").startswith("application/http"), True
        for piece in stream.exactly(int(length)):
            block.update(piece)
            if is_http and in_http:
                http += piece
                if b"\r\n\r\n" not in http:
                    continue
                http, _, piece = http.partition(b"\r\n\r\n")
                in_http = False
            payload.update(piece)
            size += len(piece)
            if payloads:
                kept.append(piece)
        stream.end()
        if fields.get("warc-block-digest", "") not in ("", "sha256:" + block.hexdigest()):
            raise WarcError(f"block digest of {fields.get('warc-record-id')} does not match")
        kind, said = fields.get("warc-type", ""), fields.get("warc-payload-digest", "")
        if kind == "response" and said not in ("", "sha256:" + payload.hexdigest()):
            raise WarcError(f"payload digest of {fields.get('warc-record-id')} does not match")
        if kind == "revisit":
            length = _fields(http).get("content-length", "0")
            if not (length.isascii() and length.isdigit()):
                raise WarcError(f"revisit {fields.get('warc-record-id')} has no length of its payload")
            size = int(length)
        yield {"type": kind, "id": fields.get("warc-record-id", "").strip("<>"), "url": fields.get("warc-target-uri", ""), "refers_to": fields.get("warc-refers-to", "").strip("<>"), "payload_bytes": size, "payload_digest": said.removeprefix("sha256:") if said else payload.hexdigest(), "payload": b"".join(kept) if payloads else None}


def _number(name: str) -> int | None:
    tail = name.removeprefix(ID_PREFIX)
    return int(tail) if tail.lstrip("-").isdigit() else None


def _read(folder: str, payloads: bool, strict: bool):
    schema = pa.schema([("archive", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = _file_system(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows, held = [], 0
                with files.open_input_stream(f"{top}/{name}", compression=None) as f:
                    try:
                        for r in read_records(f, payloads=payloads):
                            if r["type"] not in ("response", "revisit"):
                                continue
                            rows.append({"archive": name, "page_id": _number(r["id"]), "url": r["url"], "payload_bytes": r["payload_bytes"], "payload_digest": r["payload_digest"], "record_type": r["type"], "refers_to": _number(r["refers_to"]), "payload": r["payload"], "error": None})
                            held += len(r["payload"] or b"") + 200
                            if held > 8 << 20:
                                yield pa.RecordBatch.from_pylist(rows, schema)
                                rows, held = [], 0
                    except WarcError as e:
                        if strict:
                            raise WarcError(f"{name}: {e}") from None
                        rows.append({"archive": name, "error": str(e)})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str, *, payloads: bool = False, strict: bool = True) -> DataFrame:
    """Rows of all page records of the manifest's archives; each archive is read from start to end by one task."""
    ship(spark)
    folder = qualified(spark, folder)
    return manifest.select("archive").repartition(shuffle_parts(spark), F.col("archive")).mapInArrow(
        _read(folder, payloads, strict), "archive string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, error string"
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 10 over all of ``pages``: written as archives to the shared folder, then read back."""
    folder = scratch_path(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL_OP10 = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
