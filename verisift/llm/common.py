"""Shared pieces of the corpus operators: scratch tables, tokens as numpy arrays, 64-bit hashes.

Nothing here collects data to the driver. Scratch tables are ordinary Parquet
under ``spark.checkpoint.dir`` (shared by driver and executors), so a lost
executor only costs the tasks it was running.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verisift.sources.session import qualified  # noqa: F401  for the operators
from verisift.sources.session import ship as _ship
from verisift.sources.session import table  # noqa: F401  for the operators

#: The six ASCII white-space bytes that separate words in every contract: 0x09-0x0D and 0x20.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_U64 = np.uint64
_MIX1 = _U64(0xBF58476D1CE4E5B9)
_MIX2 = _U64(0x94D049BB133111EB)
_GOLDEN = _U64(0x9E3779B97F4A7C15)


# --------------------------------------------------------------------------- session helpers

def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Where it is unset, a local session (tests) gets a temp folder; on a cluster that would
    be another folder on each machine, so it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="verisift-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def dropping_shuffles(spark: SparkSession):
    """The shuffles of what is written meanwhile are deleted as soon as it is written, not when the driver happens to collect garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, name: str, *, options: dict[str, str] | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.options(**(options or {}))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def materialise_by(df: DataFrame, key: str, name: str, *, options: dict[str, str] | None = None, into: DataFrame | None = None) -> DataFrame:
    """``materialise`` as a table bucketed by ``key`` in as many buckets as shuffles have partitions: a later join by key doesn't move it. To be given to ``discard``.
    ``into``: such a table that gets the rows besides its own; ``df`` may read it."""
    spark, path, table_name = df.sparkSession, scratch_path(df.sparkSession, name), f"{name}_{uuid.uuid4().hex}"
    writer = df.write.options(**(options or {}))
    if into is not None:
        path, table_name, writer = into.scratch_path, into.scratch_table, writer.mode("append")
    buckets = shuffle_parts(spark) if into is None else into.scratch_buckets
    writer.bucketBy(buckets, key).format("parquet").option("path", path).saveAsTable(table_name)
    out = spark.table(table_name)
    out.scratch_path, out.scratch_table, out.scratch_buckets = path, table_name, buckets
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a frame from ``materialise`` or ``materialise_by`` that nothing reads any more."""
    spark = df.sparkSession
    if hasattr(df, "scratch_table"):
        spark.sql(f"DROP TABLE IF EXISTS {df.scratch_table}")
    at = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, and bound what a worker holds of a batch."""
    for key, usual, bounded in (("maxRecordsPerBatch", "10000", "2000"), ("maxBytesPerBatch", None, str(8 << 20))):
        key = f"spark.sql.execution.arrow.{key}"  # some MB of text in a worker at a time
        if spark.conf.get(key, None) in (usual, str(2**31 - 1), str(2**63 - 1)):
            spark.conf.set(key, bounded)
    _ship(spark)


def _return_memory() -> None:
    """Give freed memory back to the system: Python workers live on after a task, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_CACHES: dict[str, dict] = {}


def worker_cache(name: str) -> dict:
    """What a Python worker keeps from task to task for the functions that name it in ``tidy``; a task of any other function empties it."""
    return _CACHES.setdefault(name, {})


def _forget(but: str) -> None:
    others = [c for name, c in _CACHES.items() if name != but and c]
    for c in others:
        c.clear()
    if others:
        gc.collect()
        _return_memory()


MAPPED = 1 << 20


def _map_arrays(above: int = MAPPED) -> None:
    try:
        ctypes.CDLL(None).mallopt(-3, above)  # larger arrays are mapped, so freeing them frees them
        ctypes.CDLL(None).mallopt(-1, 2 * above if above > MAPPED else 1 << 17)  # what may lie free at the heap's end
    except (OSError, AttributeError):
        pass


def tidy_cogroup(run, mapped: int = MAPPED):
    """A function of two tables that returns its memory when it is done, and that of worker caches when it begins. Arrays above ``mapped`` bytes are mapped."""

    def wrapped(left, right):
        _forget("")
        _map_arrays(mapped)
        try:
            return run(left, right)
        finally:
            _return_memory()

    return wrapped


def tidy_group(run, mapped: int = MAPPED):
    """``tidy_cogroup`` of one table."""
    both = tidy_cogroup(lambda records, _: run(records), mapped)
    return lambda records: both(records, None)


def tidy(run, cache: str = "", mapped: int = MAPPED):
    """A batch function that returns its memory when its task is done, and that of worker caches other than ``cache`` when it begins. Arrays above ``mapped`` bytes are mapped."""

    def wrapped(batches):
        _forget(cache)
        _map_arrays(mapped)
        try:
            yield from run(batches)
        finally:
            gc.collect()
            _return_memory()

    return wrapped


def stable(df: DataFrame) -> DataFrame:
    """A frame whose rows get the same monotonically_increasing_id in every use: a scan of files with projections and filters
    as it is, anything else written once (a shuffle may deal rows otherwise once columns are pruned)."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = {m[1] for line in plan.splitlines() if (m := re.match(r"[\s:+|-]*([A-Z]\w+)", line))}
    return df if nodes <= {"Project", "Filter", "Relation"} else materialise(df, "input")


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as decimal text, taken mod ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == F.lit(remainder)


# --------------------------------------------------------------------------- numpy tokens

def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser over a uint64 array."""
    x = x.astype(_U64, copy=True)
    x ^= x >> _U64(30)
    x *= _MIX1
    x ^= x >> _U64(27)
    x *= _MIX2
    x ^= x >> _U64(31)
    return x


def _byte_table(seed: int) -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=_U64) * _GOLDEN + _U64(seed))


_TABLE = _byte_table(0x5EED)
OTHER_TABLE = _byte_table(0xD1CE)  # for a second hash of the same bytes
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_R = _U64(0xD6E8FEB86659FD93)
_RINV = _U64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(base: np.uint64, n: int, key: str) -> np.ndarray:
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.empty(size, dtype=_U64)
        have[0] = 1
        done = 1
        step = base
        while done < size:  # doubling: powers[done:2*done] = powers[:done] * base**done
            take = min(done, size - done)
            have[done:done + take] = have[:take] * step
            step = _U64(int(step) * int(step) & 0xFFFFFFFFFFFFFFFF)
            done += take
        _POWERS[key] = have
    return have


def binary_column(arr) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string/binary array and its n+1 offsets; nulls are empty."""
    if hasattr(arr, "combine_chunks"):
        arr = arr.combine_chunks()
        if hasattr(arr, "chunks"):
            arr = arr.chunk(0) if arr.num_chunks else pa.array([], pa.large_binary())
    arr = arr.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset:arr.offset + n + 1]
    data = arr.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words of all rows, and the n+1 word offsets of the rows."""
    size = len(raw)
    if size == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    word = ~_IS_SPACE[raw]
    cut = np.zeros(size + 1, dtype=bool)  # a row begins here
    cut[offsets] = True
    starts_mask = word.copy()
    starts_mask[1:] &= ~word[:-1] | cut[1:size]
    ends_mask = word.copy()
    ends_mask[:-1] &= ~word[1:] | cut[1:size]
    starts = np.flatnonzero(starts_mask)
    ends = np.flatnonzero(ends_mask) + 1
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, *, lower: bool = False, table: np.ndarray = _TABLE) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over random byte values, taken from prefix sums, then mixed."""
    if len(starts) == 0:
        return np.zeros(0, _U64)
    out = np.empty(len(starts), _U64)
    block = 1 << 20  # bounded working memory whatever the batch holds
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = int(np.searchsorted(ends, base + block, side="right"))
        hi = max(hi, lo + 1)
        stop = int(ends[hi - 1])
        piece = raw[base:stop]
        vals = table[_LOWER[piece] if lower else piece]
        prefix = np.empty(len(piece) + 1, _U64)
        prefix[0] = 0
        np.cumsum(vals * _powers(_R, len(piece), "r")[:len(piece)], out=prefix[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        h = (prefix[e] - prefix[s]) * _powers(_RINV, len(piece) + 1, "rinv")[s]
        out[lo:hi] = mix64(h ^ (e - s).astype(_U64) * _GOLDEN)
        lo = hi
    return out


def shingle_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of the ``len(words)-k+1`` runs of k words (none if there are fewer words)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, _U64)
    done, power, bits = words, _R, bin(k)[3:]  # the runs of ``width`` words and _R**width, by doubling
    width = 1
    with np.errstate(over="ignore"):
        for bit in bits:
            done = done[:-width] * power + done[width:]
            width, power = 2 * width, power * power
            if bit == "1":
                done = done[:-1] * _R + words[width:]
                width, power = width + 1, power * _R
        return mix64(done + _U64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
