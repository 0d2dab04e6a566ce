"""Substring dedup by level-wise doubling of repeated word windows.

A word is removed when a window of WINDOW consecutive words of one document covers it whose word sequence also
starts anywhere else. Windows that occur once at one length cannot repeat at a longer one, so each level only extends what
repeated at the level before:

* A level of length L below WINDOW looks at *anchors*: of all L-windows inside a WINDOW-window, the leftmost with the smallest
  hash. Equal windows have equal anchors, so an anchor that stands alone rules out every window that it anchors. Anchors
  are a small part of all positions (about 2 / (WINDOW - L + 2)).
* Windows whose anchor repeated survive. They go on, as runs of word hashes, to a level of twice the length (5, 9, 18, 35; LEVELS),
  and so on until no candidate survives or the level of WINDOW itself has decided about every single surviving window.

Counting needs no join back and no group in one place: a hash's rows are summed with partial aggregation, carrying the least row
and position. Where the sum is 1 these *are* the lone occurrence, which goes back to its document. Frequent passages
collapse before the shuffle. Of the texts, only those with a candidate after the first level and those that lose words cross the network,
once each: the others stop at a filter of row numbers. Later levels read the survivors' runs alone, which are bucketed by row number and don't move. The last level compares 64 bits of one hash
of the words' bytes and 32 of another, independent one; earlier levels only choose candidates.

Defined cases: null text has no words; documents with fewer words than WINDOW lose nothing; repeated rows are documents of their own
(all their windows repeat); all kept or no kept words: kept_sha256 is that of the joined or the empty string. Texts of any length are read whole. An
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OTHER_TABLE, binary_column, discard, materialise, materialise_by, shingle_hashes, ship, stable, table, tidy, word_hashes, word_spans
from .filters import BlockFilter

WINDOW = 35
LEVELS = 4
BATCH_ROWS = 1 << 20
CHUNK_WORDS = 1 << 15  # words looked at at once, but for a longer document
MARKER = -1  # position of the unit that each document with a window has besides its own: it is always alone, so that the document is in the count of lone units


def level_lengths(window: int = WINDOW, levels: int = LEVELS) -> list[int]:
    """Rising lengths, each at most twice the one before, ending with the window: 35 -> [5, 9, 18, 35]."""
    out = [window]
    while len(out) < levels and out[0] > 1:
        out.insert(0, -(-out[0] // 2))
    return out


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest of every run of ``width`` values, the leftmost of equal ones, by doubling."""
    at, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[:-step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        have += step
    return at


def window_anchors(words: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of a run of words the position of its anchor; and the hashes of all runs of ``length`` words."""
    hashes = shingle_hashes(words, length, seed=length)
    if len(words) < window:
        return np.zeros(0, np.int64), hashes
    return sliding_argmin(hashes, window - length + 1), hashes


class Runs:
    """Runs of words of a batch's documents one after the other: word hashes, second hashes, where each run begins and the last ends, its position and row in the batch."""

    def __init__(self, words: np.ndarray, second: np.ndarray, starts: np.ndarray, at: np.ndarray, owner: np.ndarray):
        self.words, self.second, self.starts, self.at, self.owner = words, second, starts, at, owner

    def some(self) -> Iterator[Runs]:
        """The runs by some CHUNK_WORDS words at a time."""
        lo = 0
        while lo < len(self.at):
            hi = max(lo + 1, int(np.searchsorted(self.starts, self.starts[lo] + CHUNK_WORDS, side="right")) - 1)
            part = slice(self.starts[lo], self.starts[hi])
            yield Runs(self.words[part], self.second[part], self.starts[lo:hi + 1] - self.starts[lo], self.at[lo:hi], self.owner[lo:hi])
            lo = hi

    def windows(self, window: int) -> np.ndarray:
        """Where the windows begin that lie in one run."""
        return np.flatnonzero(np.arange(window, len(self.words) + window) <= np.repeat(self.starts[1:], np.diff(self.starts)))

    def keys(self, where: np.ndarray) -> np.ndarray:
        """Row in the batch and position in the document of words, as one number."""
        run = np.searchsorted(self.starts, where, side="right") - 1
        return (self.owner[run] << 32) + where - self.starts[run] + self.at[run]


def _from_texts(batch: pa.RecordBatch, twice: bool) -> Runs:
    """Each text is one run; second hashes if ``twice``."""
    raw, offsets = binary_column(batch.column("text"))
    starts, ends, at = word_spans(raw, offsets)
    hashes = word_hashes(raw, starts, ends)
    second = word_hashes(raw, starts, ends, table=OTHER_TABLE).astype(np.uint32) if twice else hashes
    return Runs(hashes, second, at, np.zeros(len(at) - 1, np.int64), np.arange(len(at) - 1))


def _from_runs(batch: pa.RecordBatch, twice: bool) -> Runs:
    """The same from survivors."""
    at, size, words, second = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("at", "size", "words", "second"))
    return Runs(words.view(np.uint64), second.view(np.uint32), np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), at.astype(np.int64), np.repeat(np.arange(batch.num_rows), np.diff(batch.column("at").offsets.to_numpy())))


def _lists(column):
    """row -> numpy array of a list column; null is empty."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    offsets = offsets - offsets[0]
    return lambda i: values[offsets[i]:offsets[i + 1]]


def _among(values: np.ndarray, those: np.ndarray) -> np.ndarray:
    """Which values are among ascending others."""
    return those[np.minimum(np.searchsorted(those, values), len(those) - 1)] == values if len(those) else np.zeros(len(values), bool)


_UNIT = pa.schema([("h1", pa.int64()), ("h2", pa.int32()), ("row", pa.int64()), ("pos", pa.int32()), ("units", pa.int32())])


def _units(read, length: int, window: int, marked: bool):
    """Rows (hash, row, position) of the units of a level: its anchors, or all windows at the last. units: how many the document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def flush():
            cols = [np.concatenate([p[k] for p in parts]) for k in range(5)]
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _UNIT)], schema=_UNIT)

        for batch in batches:
            rows = batch.column("row").to_numpy()
            for runs in read(batch, length == window).some():
                own, hashes = window_anchors(runs.words, length, window)
                own = own[runs.windows(window)]  # ascending
                own = own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own
                h1 = hashes[own].view(np.int64)
                h2 = (shingle_hashes(runs.second.astype(np.uint64), window, seed=2)[own].astype(np.uint32) if length == window else np.zeros(len(own), np.uint32)).view(np.int32)
                # an anchor of two runs of a document stands in each of them: it is one unit
                keys, first = np.unique(runs.keys(own), return_index=True)
                owner, pos, h1, h2 = keys >> 32, keys.astype(np.int32), h1[first], h2[first]
                units = np.bincount(owner, minlength=batch.num_rows)
                if marked:
                    has = np.flatnonzero(units)
                    owner, h1 = np.concatenate([owner, has]), np.concatenate([h1, rows[has]])
                    h2, pos = (np.concatenate([x, np.full(len(has), MARKER, np.int32)]) for x in (h2, pos))
                    units[has] += 1
                parts.append((h1, h2, rows[owner], pos, units[owner].astype(np.int32)))
                held += len(owner)
                if held >= BATCH_ROWS:
                    yield flush()
                    parts, held = [], 0
        if parts:
            yield flush()

    return run


def _survive(read, length: int, window: int):
    """The runs of words whose windows all have a repeated unit, without the words after the last level. Column lone holds the document's lone positions."""
    last = length == window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("lone")
            lone = np.sort((np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy())) << 32) + column.flatten().to_numpy(zero_copy_only=False))
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32))]
            for runs in read(batch, not last).some():
                where = runs.windows(window)
                if not len(where):
                    continue
                keys = runs.keys(window_anchors(runs.words, length, window)[0][where])
                alive = np.zeros(len(runs.words) + 1, bool)
                alive[where] = ~_among(keys, lone)
                begins = np.zeros(len(alive), bool)
                begins[runs.starts] = True  # runs of two documents don't join
                first = np.flatnonzero(alive & (begins | ~np.concatenate([[False], alive[:-1]])))
                size = np.flatnonzero(alive[:-1] & (begins[1:] | ~alive[1:])) + window - first
                taken = np.zeros(0, np.int64) if last else np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
                keys = runs.keys(first)
                out.append((keys >> 32, keys & (1 << 32) - 1, size, runs.words[taken], runs.second[taken].astype(np.uint32)))
            owner, at, size, words, second = (np.concatenate(x) for x in zip(*out))
            rows = np.flatnonzero(np.bincount(owner, minlength=batch.num_rows))
            cuts = np.append(np.searchsorted(owner, rows), len(owner))
            runs_of = lambda x, kind: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, kind))
            ends = pa.array((np.concatenate([[0], np.cumsum(size)])[cuts] if not last else np.zeros(len(cuts))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row").take(pa.array(rows, pa.int64())), runs_of(at, pa.int32()), runs_of(size, pa.int32()),
                    pa.ListArray.from_arrays(ends, pa.array(words.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(second.view(np.int32))),
                ],
                names=["row", "at", "size", "words", "second"],
            )

    return run


def _remove(texts: bool):
    """at, size: the runs of words whose windows all repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, size, column = _lists(batch.column("at")), _lists(batch.column("size")), batch.column("text").cast(pa.large_binary())
            n_words, n_removed, sha, kept_texts, spans = [], [], [], [], []
            for i in range(batch.num_rows):
                words = (column[i].as_py() or b"").split()
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, at(i), 1)
                np.add.at(cover, at(i) + size(i), -1)
                gone = np.cumsum(cover[:-1]) > 0
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if len(at(i)) else words)
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(kept).hexdigest())
                if texts:
                    kept_texts.append(kept)
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    spans.append([{"from": int(a), "to": int(b)} for a, b in edge.reshape(-1, 2)])
            cols = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if texts:
                cols += [pa.array(kept_texts, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))]
                names += ["kept_text", "removed"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def repeated_runs(source: DataFrame, window: int = WINDOW, levels: int = LEVELS, report: list | None = None) -> DataFrame:
    """source: row, text. row, at, size: the runs of words whose windows all repeat. ``report`` gets (length, documents, candidate windows) of each level."""
    found, read, runs = source, _from_texts, None
    for length in level_lengths(window, levels):
        units = found.mapInArrow(tidy(_units(read, length, window, runs is None)), "h1 long, h2 int, row long, pos int, units int")
        counted = units.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row"), F.min("pos").alias("pos"), F.min("units").alias("units"))
        # the lone units of a document: no more than its words
        lone = materialise(counted.where("n = 1").groupBy("row").agg(F.collect_list("pos").alias("lone"), F.max("units").alias("units")), f"lone-{length}")
        if runs is None:
            lone = lone.where("size(lone) < units")
            found = BlockFilter(lone.select(F.xxhash64("row")), lone.count()).probe(found, F.xxhash64("row"), "alive").where("alive").drop("alive").join(lone.hint("merge"), "row")
        else:  # a document without a lone unit isn't among them
            found = found.join(lone.hint("merge"), "row", "left")
        left = found.drop("units").mapInArrow(tidy(_survive(read, length, window)), "row long, at array<int>, size array<int>, words array<long>, second array<int>")
        before, runs = runs, materialise(left, "runs") if length == window else materialise_by(left, "row", "runs")
        if before is not None:
            discard(before)
        found, read = runs, _from_runs
        if report is not None:
            left = runs.agg(F.count(F.lit(1)), F.sum(F.expr(f"aggregate(size, 0L, (a, x) -> a + x - {window - 1})"))).first()
            report.append((length, left[0], left[1] or 0))
        if length < window and not runs.take(1):
            none = materialise(runs, "runs")
            discard(runs)
            runs = none
            break
    return runs.select("row", "at", "size")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, levels: int = LEVELS, texts: bool = False, report: list | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; with ``texts`` also kept_text and the removed word spans."""
    ship(docs.sparkSession)
    id_type = docs.select(F.col(id_col).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    source = stable(docs).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    runs = repeated_runs(source.select("row", "text"), window, levels, report)
    probed = BlockFilter(runs.select(F.xxhash64("row")), runs.count()).probe(source, F.xxhash64("row"), "loses")
    nothing = [F.array().cast("array<int>").alias(c) for c in ("at", "size")]
    out = probed.where("not loses").select("doc_id", "text", *nothing).unionByName(probed.where("loses").join(runs.hint("merge"), "row", "left").select("doc_id", "text", "at", "size"))
    extra = ", kept_text string, removed array<struct<`from`: long, `to`: long>>" if texts else ""
    return out.mapInArrow(tidy(_remove(texts)), f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string{extra}")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 5 over all of ``documents``."""
    return remove_repeats(table(spark, sf_dir, "documents"))


SQL_OP5 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p, len(w) AS n FROM d),
s AS (SELECT r, p, word, n, md5(string_agg(word, ' ') OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) AS h FROM t),
c AS (SELECT r, p, word, CASE WHEN p <= n - 34 AND count(*) FILTER (WHERE p <= n - 34) OVER (PARTITION BY h) > 1 THEN 1 ELSE 0 END AS starts FROM s),
g AS (SELECT r, p, word, max(starts) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM c),
k AS (SELECT r, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone = 0) AS kept FROM g GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
