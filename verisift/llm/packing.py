"""Packing along a space-filling curve.

1. Tokenise. The tokenizer never joins across ASCII white space, so words are looked up in a bounded cache and
   only unseen ones are encoded. A document's ids (16 bits each) end with the id of the document end.
2. Project. The document's vector of token counts is hashed: each id has a pseudo-random sign in each of three dimensions.
   The sums, divided by the vector's length, are squashed to a 1024^3 grid, and the Hilbert index of the cell is the key.
3. Range-sort narrow rows (row, key, tokens) by key. Token sums of the ranges and running sums inside them
   give every document its place in one long stream along the curve.
4. Cut the stream every 2048 tokens. Each document finds its pieces from its own place alone, so the ids are
   joined to places by row and never sorted. Only the stream's last sequence is padded.

Defined cases: null text is empty, an empty document is its end id alone; repeated rows are packed once each;
documents with equal keys follow in row order; an empty table gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, mix64, ship, table, tidy, worker_cache

SEQUENCE = 2048
END_ID = 1
HASHED, DIMS, BITS = 1024, 3, 10
CACHE_WORDS = 600_000  # entries of a worker process's cache
BUFFER_BYTES = 1 << 20
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class WordEncoder:
    """ids of texts as little-endian uint16 bytes, equal to the tokenizer's encode(text, add_special_tokens=False).

    No token spans ASCII white space, so whole words are cached. New words go through the tokenizer many at a time,
    with a control byte between them whose id says where each one stops.
    """

    MARK = b"\x01"
    # an ASCII mark other than the apostrophe, straight after a letter of ASCII or Latin-1
    AFTER_WORD = staticmethod(re.compile(rb"[!-&(-/:-@\[-`{-~](?:(?<=[a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))").sub)

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self.tokenizer.encode(self.MARK.decode(), add_special_tokens=False).ids
        self.words: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u2") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[bytes]) -> None:
        odd = [w for w in new if self.MARK in w] if any(self.MARK in w for w in new) else []
        if odd:
            new = list(set(new).difference(odd))
            self.words.update(zip(odd, (x.tobytes() for x in self._ids([w.decode("utf-8", "replace") for w in odd]))))
        blocks = [new[i:i + 1000] for i in range(0, len(new), 1000)]
        mark = b" " + self.MARK + b" "
        for block, ids in zip(blocks, self._ids([mark.join(b).decode("utf-8", "replace") for b in blocks])):
            stops = (np.flatnonzero(ids == self.mark) * 2).tolist()
            data = ids.tobytes()
            self.words.update(zip(block, map(lambda a, b: data[a:b], [0, *(x + 2 for x in stops)], [*stops, len(data)])))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        # Lower case merges cache entries, and so does a mark taken from the word before it: the tokenizer lower-cases, too, and ends
        # a run of letters there. Its special strings are case-sensitive.
        split = [(t if b"<|" in t else self.AFTER_WORD(rb" \g<0>", t.lower())).split() for t in texts]
        new = set().union(*split).difference(self.words) if split else set()
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words = dict(islice(self.words.items(), CACHE_WORDS // 2))  # the first come are the frequent ones
            new = set().union(*split).difference(self.words)
        self.learn(list(new))
        get = self.words.__getitem__
        return [b"".join(map(get, ws)) for ws in split]


_ENCODERS: dict[str, WordEncoder] = worker_cache("encoders")


def encoder(path: str) -> WordEncoder:
    """One encoder for each path and worker process, until a task of another function runs there."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def projection() -> np.ndarray:
    """The signs (+1, -1) of the HASHED vector places in DIMS dimensions."""
    bits = mix64(np.arange(HASHED, dtype=np.uint64) + np.uint64(0x51A7))
    return np.stack([((bits >> np.uint64(d)) & np.uint64(1)).astype(np.float64) * 2 - 1 for d in range(DIMS)], axis=1)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert indices of integer points (n, dims): Gray code and axis exchanges from the top bit down."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def document_points(ids: list[bytes], signs: np.ndarray) -> np.ndarray:
    """Grid points of documents: token counts at hashed places, projected, divided by the vector's length."""
    place = (mix64(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(HASHED)).astype(np.int32)
    out = np.zeros((len(ids), DIMS))
    for k, b in enumerate(ids):
        counts = np.bincount(place[np.frombuffer(b, dtype="<u2")], minlength=HASHED).astype(np.float64)
        out[k] = counts @ signs / np.sqrt(counts @ counts)
    return np.clip(((np.tanh(out * 0.8) + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)


def _tokenise(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, signs, end = encoder(path), projection(), np.array([end_id], dtype="<u2").tobytes()
        for batch in batches:
            texts, lo, part, held = batch.column("text").cast(pa.large_binary()), 0, [], 0
            for i in range(len(texts)):  # slabs of some MB of text
                part.append(texts[i].as_py() or b"")
                held += len(part[-1])
                if held >= BUFFER_BYTES or i == len(texts) - 1:
                    ids = [b + end for b in enc.encode(part)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("row").slice(lo, len(ids)), batch.column("doc_id").slice(lo, len(ids)), pa.array(hilbert_keys(document_points(ids, signs))), pa.array([len(b) // 2 for b in ids], pa.int64()), pa.array(ids, pa.binary())],
                        names=["row", "doc_id", "key", "n", "ids"],
                    )
                    lo, part, held = i + 1, [], 0

    return run


def _cut(sequence: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, places, blobs = batch.column("doc_id"), batch.column("place").to_numpy(), batch.column("ids")
            src, start, length, crc, total, seq, off, ids_out = [], [], [], [], [], [], [], []
            for i in range(len(places)):
                ids = np.frombuffer(blobs[i].as_py(), dtype="<u2").astype("<u4")
                place, done, n = int(places[i]), 0, len(ids)
                while done < n:
                    at = (place + done) % sequence
                    take = min(sequence - at, n - done)
                    piece = ids[done:done + take]
                    src.append(i)
                    start.append(done)
                    length.append(take)
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(n)
                    seq.append((place + done) // sequence)
                    off.append(at)
                    ids_out.append(piece.tobytes())
                    done += take
            yield pa.RecordBatch.from_arrays(
                [docs.take(pa.array(src, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total, seq, off)), pa.array(ids_out, pa.binary())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    return run


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents, with their ids as little-endian unsigned 32-bit numbers in ``ids``."""
    ship(docs.sparkSession)
    id_type = docs.select(F.col(id_col).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    tokens = materialise(
        docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .mapInArrow(tidy(_tokenise(tokenizer or tokenizer_path(), end_id), "encoders"), f"row long, doc_id {id_type}, key long, n long, ids binary"),
        "tokens",
    )
    ranged = materialise(tokens.select("row", "key", "n").repartitionByRange("key", "row").withColumn("part", F.spark_partition_id()), "curve")
    sums = ranged.groupBy("part").agg(F.sum("n").alias("sum"))  # one row a range
    base = sums.select("part", (F.sum("sum").over(Window.orderBy("part")) - F.col("sum")).alias("base"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("key", "row")) - F.col("n")
    places = ranged.withColumn("inside", inside).join(base, "part").select("row", (F.col("base") + F.col("inside")).alias("place"))
    return tokens.select("row", "doc_id", "ids").join(places, "row").select("doc_id", "place", "ids").mapInArrow(
        tidy(_cut(sequence)), f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 8 over all of ``documents``."""
    return pack(table(spark, sf_dir, "documents")).drop("ids")
