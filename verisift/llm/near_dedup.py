"""MinHash near-dedup with Order MinHash sketches and banded alignment.

1. A document is the sequence of its five-word shingles, each labelled with its occurrence number, so that all labelled
   shingles of a document differ. Documents with equal word sequences are one *text* from here on.
2. Sketches. One 64-bit value of a labelled shingle deals it into one of BANDS sketches; a sketch takes its LENGTH smallest
   values and retains their text order; the hash of that tuple is the text's bucket in that band. Texts of similarity 0.8 agree in a given
   band with probability 0.8^LENGTH, so they miss all bands in less than one of 10,000 cases.
3. Candidates. A bucket's texts are first paired with the bucket's most central text only (that with the fullest buckets over all bands,
   as the original of a group of copies has). Pairs are dropped where lengths rule out the similarity, or a 256-bin min-wise estimate is
   below it by more than 4.5 standard deviations.
4. Banded alignment. The longest common subsequence of two labelled sequences, for positions no further apart than the similarity
   allows, is a longest increasing run of positions. similarity = matches / (n_a + n_b - matches): the Jaccard index of
   the shingles that keep their order; its complement is a metric. Links are pairs of 0.8 or more.
5. Components of the links are the classes. Where a bucket of any size still holds several classes, all of its pairs of texts of different
   classes are compared: the texts are gathered in packs of bounded size, those of the largest class apart from the others, and every two packs meet
   (two of the largest class don't: their texts are one class). Two packs give a count of shared shingles for all pairs at once (frequent shingles by a
   matrix product, rare ones by their lists); pairs whose count allows a link are aligned, unless they are of one class by then, so that a meeting
   of packs gives a forest of links, not all of them. So every pair of texts with a bucket in common is in one class, or has been
   compared and is no link; no bucket is cut, at any size. The work of a bucket is the number of its texts times that of its texts
   outside the largest class.

Two texts of similarity 0.8 or more that share no bucket are the only loss (step 2). Copies are told by the number of their words and two 64-bit hashes
of the word sequence, without a look at the bytes: the exact operator is ``exact_dedup``.

Defined cases: null or blank text has no words; all such rows are one class. Texts of under five words are one
shingle, the whole text. Word order counts, case counts, white space doesn't. Repeated rows are copies. An empty table gives no rows. Extra
columns are ignored. Very long texts are sketched and aligned whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _GOLDEN, _R, binary_column, materialise, mix64, shingle_hashes, ship, stable, table, tidy, word_hashes, word_spans
from .components import merged
from .filters import without_rows

SHINGLE = 5
SIMILARITY = 0.8
BANDS, LENGTH = 32, 6
PACK = 1 << 16  # shingles of a pack of texts, on average at most
RARE = 16  # a shingle of up to so many texts in two packs is counted by its list of texts
COLUMNS = 1 << 11  # frequent shingles of one matrix product
ESTIMATE_BINS = 256


def _documents(column) -> Iterator[tuple[int, np.ndarray]]:
    raw, offsets = binary_column(column)
    starts, ends, at = word_spans(raw, offsets)
    hashes = word_hashes(raw, starts, ends)
    for i in range(len(at) - 1):
        yield i, hashes[at[i]:at[i + 1]]


def shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    return shingle_hashes(words, min(k, len(words)), seed=len(words) if len(words) < k else 0) if len(words) else np.zeros(0, np.uint64)


def labelled(h: np.ndarray) -> np.ndarray:
    """Values of (shingle, occurrence number), in text order."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] != s[:-1]
    if new.all():
        return mix64(h)
    place = np.arange(len(s))
    occ = np.empty(len(s), np.uint64)
    occ[order] = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64)
    return mix64(h + occ * _GOLDEN)


def sketch(h: np.ndarray, g: np.ndarray, bands: int = BANDS, length: int = LENGTH) -> np.ndarray:
    """The bucket of each band (0: the band is empty). h: shingles, g: their labelled values, in text order."""
    order = np.argsort(g)
    bounds = np.searchsorted(g[order], (np.arange(bands, dtype=np.uint64) << np.uint64(64 - bands.bit_length() + 1)))
    counts = np.diff(np.append(bounds, len(g)))
    at = bounds[:, None] + np.arange(length)
    inside = np.arange(length) < counts[:, None]
    pos = np.where(inside, order[np.minimum(at, len(g) - 1)], len(g))
    pos.sort(axis=1)  # back into text order
    values = np.append(h, np.uint64(0))[pos]
    acc = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for j in range(length):
        acc = acc * _R + values[:, j]
    return np.where(counts > 0, mix64(acc) | np.uint64(1), np.uint64(0))


def estimate_bytes(g: np.ndarray, bins: int = ESTIMATE_BINS) -> bytes:
    """One byte for the smallest value of each bin; 0 for an empty bin."""
    s = np.sort(g)
    bounds = np.searchsorted(s, (np.arange(bins, dtype=np.uint64) << np.uint64(64 - bins.bit_length() + 1)))
    full = np.diff(np.append(bounds, len(s))) > 0
    low = (s[np.minimum(bounds, len(s) - 1)] % np.uint64(255)).astype(np.uint8) + 1
    return np.where(full, low, 0).astype(np.uint8).tobytes()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, n, est, sigs = [], [], [], []
        for _, words in _documents(batch.column("text")):
            h = shingles(words)
            count = len(words)
            place = mix64(np.arange(count, dtype=np.uint64))
            keys.append(b"" if not count else np.array([np.bitwise_xor.reduce(mix64(words + place)), np.add.reduce(mix64(words ^ (place * _R))), count], dtype=np.uint64).tobytes())
            n.append(len(h))
            if len(h):
                g = labelled(h)
                est.append(estimate_bytes(g))
                sigs.append(sketch(h, g).view(np.int64))
            else:
                est.append(b"")
                sigs.append(np.zeros(0, np.int64))
        flat = np.concatenate(sigs) if sigs else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sigs])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(est, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
            names=["row", "doc_id", "key", "n", "est", "sigs"],
        )


def _likely(similarity: float):
    """Drops pairs whose min-wise estimate is more than 4.5 standard deviations below the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for c in ("est_a", "est_b"))
            filled = ((a > 0) | (b > 0)).sum(axis=1)
            least = similarity - 4.5 * np.sqrt(similarity * (1 - similarity) / np.maximum(filled, 1))
            keep = ((a == b) & (a > 0)).sum(axis=1) >= least * filled
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])

    return run


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text's labelled shingles, in text order."""
    for batch in batches:
        out = [labelled(shingles(words)).tobytes() for _, words in _documents(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.large_binary())], names=["row", "shingles"])


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each of ``left`` shares with each of ``right``; the values of an array differ."""
    values = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right), dtype=np.int32), [len(v) for v in (*left, *right)])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    times = np.diff(np.append(first, len(values)))
    out = np.zeros((len(left), len(right)), np.float32)
    for t in range(2, RARE + 1):  # every list of t texts: its pairs
        at = first[times == t]
        if len(at):
            lists = owner[at[:, None] + np.arange(t)]  # ascending, so texts of the left come first
            for i in range(t - 1):
                for j in range(i + 1, t):
                    a, b = lists[:, i], lists[:, j]
                    meet = (a < len(left)) & (b >= len(left))
                    if meet.any():
                        out += np.bincount(a[meet].astype(np.int64) * len(right) + (b[meet] - len(left)), minlength=out.size).reshape(out.shape)
    often = np.flatnonzero(times > RARE)
    for lo in range(0, len(often), COLUMNS):
        block = often[lo:lo + COLUMNS]
        reps = times[block]
        at = np.repeat(first[block], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        has = np.zeros((len(left) + len(right), len(block)), np.float32)
        has[owner[at], np.repeat(np.arange(len(block)), reps)] = 1
        out += has[:len(left)] @ has[len(left):].T
    return out


def forest(left: dict, right: dict | None, similarity: float) -> list[tuple[int, int, float]]:
    """Links between two packs (or inside one) that join their classes as all links between them would.
    A pack: row, n, label (arrays), shingles (a list of arrays)."""
    inside = right is None
    right = left if inside else right
    n_l, n_r = left["n"][:, None], right["n"][None, :]
    least = np.ceil(similarity * (n_l + n_r) / (1 + similarity) - 1e-6)  # shared shingles that a link needs
    open_ = (left["label"][:, None] != right["label"][None, :]) & (np.minimum(n_l, n_r) >= similarity * np.maximum(n_l, n_r))
    if inside:
        open_ &= np.tri(len(left["row"]), k=-1, dtype=bool)
    if not open_.any():
        return []
    use_l, use_r = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
    counts = shared_counts([left["shingles"][k] for k in use_l], [right["shingles"][k] for k in use_r])
    i, j = np.nonzero(open_[np.ix_(use_l, use_r)] & (counts >= least[np.ix_(use_l, use_r)]))
    best = np.argsort(-counts[i, j], kind="stable")
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    out = []
    for a, b in zip(use_l[i[best]].tolist(), use_r[j[best]].tolist()):
        la, lb = find(int(left["label"][a])), find(int(right["label"][b]))
        if la != lb:
            sim = alignment_similarity(left["shingles"][a], right["shingles"][b], similarity)
            if sim >= similarity:
                root[max(la, lb)] = min(la, lb)
                out.append((int(left["row"][a]), int(right["row"][b]), sim))
    return out


def _meet(similarity: float):
    """Rows with one or two packs (``packs``: arrays of texts) become links a < b."""

    def opened(pack: pa.Array) -> dict:
        raw, at = binary_column(pack.field("shingles"))
        return {c: pack.field(c).to_numpy() for c in ("row", "n", "label")} | {"shingles": [raw[lo:hi].view(np.uint64) for lo, hi in zip(at, at[1:])]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                packs = [opened(p.values) for p in batch.column("packs")[k].values.field("texts")] if batch.num_rows else []
                links = forest(packs[0], packs[1] if len(packs) > 1 else None, similarity)
                if links:
                    a, b, sims = zip(*links)
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(sims, pa.float64())], names=["a", "b", "similarity"])

    return run


def longest_increasing(values: np.ndarray) -> int:
    if len(values) < 2 or (values[1:] > values[:-1]).all():
        return len(values)
    tails: list[int] = []
    for v in values.tolist():
        at = bisect_left(tails, v)
        if at == len(tails):
            tails.append(v)
        else:
            tails[at] = v
    return len(tails)


def alignment_similarity(a: np.ndarray, b: np.ndarray, similarity: float) -> float:
    """Matches over the union for two labelled sequences, aligned within the band that ``similarity`` allows."""
    n, m = len(a), len(b)
    if not n or not m:
        return 1.0 if n == m else 0.0
    if min(n, m) < similarity * max(n, m):
        return 0.0
    band = int((n + m) * (1 - similarity) / (1 + similarity)) + 1  # most insertions and deletions
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    if len(i) < similarity * (n + m - len(i)):
        return len(i) / (n + m - len(i))  # an upper bound that is already too low
    matches = longest_increasing(j[np.argsort(i)])
    return matches / (n + m - matches)


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[object, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            keep, sims = [], []
            ids = batch.column("a").to_pylist()
            texts_a = batch.column("text_a").cast(pa.large_binary())
            for k, words in _documents(batch.column("text_b")):
                if last[0] != ids[k]:  # rows come sorted by a
                    (_, own), = _documents(texts_a.slice(k, 1))
                    last = (ids[k], labelled(shingles(own)))
                sim = alignment_similarity(last[1], labelled(shingles(words)), similarity)
                if sim >= similarity:
                    keep.append(k)
                    sims.append(sim)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep, pa.int64())), batch.column("b").take(pa.array(keep, pa.int64())), pa.array(sims, pa.float64())], names=["a", "b", "similarity"])

    return run


class NearDuplicates:
    """The tables of one run: rows (row, doc_id, key, text), texts' buckets, links, classes."""

    def __init__(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY):
        ship(docs.sparkSession)
        self.similarity = similarity
        self.docs = stable(docs).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        id_type = self.docs.schema["doc_id"].dataType.simpleString()
        self.sketched = materialise(self.docs.mapInArrow(tidy(_sketches), f"row long, doc_id {id_type}, key binary, n long, est binary, sigs array<long>"), "sketches")
        # the row that stands for all rows of a text
        self.texts = materialise(self.sketched.groupBy("key").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies")), "texts")
        one = self.sketched.join(self.texts.select("row"), "row").where("n > 0")
        exploded = one.select("row", "n", F.posexplode("sigs").alias("band", "sig")).where("sig <> 0")
        full = exploded.groupBy("band", "sig").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        self.members = materialise(exploded.join(full, ["band", "sig"]), "buckets")
        # what later steps need of the texts that share a bucket with another one. Texts move by hash at every size (merge): whether
        # a side could be broadcast would depend on the data
        weights = self.members.groupBy("row").agg(F.sum("m").alias("weight"))
        self.weights = materialise(weights, "weights")
        self.estimates = materialise(one.select("row", "est").join(self.weights.select("row"), "row"), "estimates")
        self.pool = materialise(self.docs.select("row", "text").join(self.weights.select("row").hint("merge"), "row"), "pool")

    def star_pairs(self) -> DataFrame:
        """Every text of a bucket with its most central one."""
        pivots = self.members.join(self.weights, "row").groupBy("band", "sig").agg(F.max(F.struct("weight", -F.col("row"), "n")).alias("p"))
        return self.members.join(pivots, ["band", "sig"]).select("row", "n", (-F.col("p.col2")).alias("other"), F.col("p.n").alias("other_n"))

    def named(self, labels: DataFrame) -> DataFrame:
        return self.members.join(labels.withColumnRenamed("node", "row"), "row")

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs a < b that lengths and estimates allow."""
        close = F.least("n", "other_n") >= self.similarity * F.greatest("n", "other_n")
        pairs = pairs.where((F.col("row") != F.col("other")) & close).select(F.least("row", "other").alias("a"), F.greatest("row", "other").alias("b")).distinct()
        est = lambda c: self.estimates.select(F.col("row").alias(c), F.col("est").alias(f"est_{c}"))
        return materialise(pairs.join(est("a"), "a").join(est("b"), "b").mapInArrow(tidy(_likely(self.similarity)), "a long, b long"), "pairs")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Links (a, b, similarity) among the pairs."""
        text = lambda c: self.pool.select(F.col("row").alias(c), F.col("text").alias(f"text_{c}"))
        rows = pairs.join(text("b").hint("merge"), "b").join(text("a").hint("merge"), "a").select("a", "b", "text_a", "text_b")
        return materialise(rows.mapInArrow(tidy(_verify(self.similarity)), "a long, b long, similarity double"), "links")

    def packs(self, labels: DataFrame) -> DataFrame:
        """Every bucket of several classes, its texts in packs: band, sig, n_big, n_rest (its packs of the largest class, of the others), outer, part, texts."""
        # a bucket of two texts has met its central text, and so has been compared
        named = self.named(labels).where("m > 2")
        per_class = named.groupBy("band", "sig", "label").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("load"))
        largest = F.struct("size", "label")
        buckets = per_class.groupBy("band", "sig").agg(F.max_by("label", largest).alias("big"), F.count(F.lit(1)).alias("classes"), F.sum("load").alias("load"), F.max_by("load", largest).alias("big_load")).where("classes > 1")
        parts = lambda load: (F.floor(load / PACK) + 1).cast("int")
        buckets = buckets.select("band", "sig", "big", parts(F.col("big_load")).alias("n_big"), parts(F.col("load") - F.col("big_load")).alias("n_rest"))
        outer = F.col("label") != F.col("big")
        part = F.pmod(F.xxhash64("row", "band"), F.when(outer, F.col("n_rest")).otherwise(F.col("n_big"))).cast("int")
        crowded = materialise(named.join(buckets, ["band", "sig"]).select("row", "n", "label", "band", "sig", "n_big", "n_rest", outer.alias("outer"), part.alias("part")), "crowded")
        sequences = materialise(self.pool.join(crowded.select("row").distinct().hint("merge"), "row").select("row", "text").mapInArrow(tidy(_sequences), "row long, shingles binary"), "sequences")
        texts = F.collect_list(F.struct("row", "n", "label", "shingles")).alias("texts")
        return crowded.join(sequences.hint("merge"), "row").groupBy("band", "sig", "n_big", "n_rest", "outer", "part").agg(texts)

    def rest_links(self, labels: DataFrame) -> DataFrame:
        """Links (a, b, similarity) that join the classes of every bucket as all links between its texts would."""
        # the other packs meet each other and those of the largest class; a meeting is named by its two packs
        rest = F.transform(F.sequence(F.lit(0), F.col("n_rest") - 1), lambda k: F.struct(F.least(k, F.col("part")).alias("l"), F.greatest(k, F.col("part")).alias("r"), F.lit(True).alias("alike")))
        big = F.transform(F.sequence(F.lit(0), F.col("n_big") - 1), lambda k: F.struct(F.col("part").alias("l"), k.alias("r"), F.lit(False).alias("alike")))
        with_rest = F.transform(F.sequence(F.lit(0), F.col("n_rest") - 1), lambda k: F.struct(k.alias("l"), F.col("part").alias("r"), F.lit(False).alias("alike")))
        meetings = self.packs(labels).select("band", "sig", F.explode(F.when(F.col("outer"), F.concat(rest, big)).otherwise(with_rest)).alias("meet"), F.struct("outer", "part", "texts").alias("pack"))
        met = meetings.groupBy("band", "sig", "meet").agg(F.collect_list("pack").alias("packs"))
        return materialise(met.select("packs").mapInArrow(tidy(_meet(self.similarity)), "a long, b long, similarity double"), "links")

    def classes(self) -> DataFrame:
        """Rows with the class of their text: row, doc_id, key, label."""
        links = self.verify(self.likely(self.star_pairs()))
        labels = merged(self.weights.select(F.col("row").alias("node"), F.col("row").alias("label")), links)
        labels = merged(labels, self.rest_links(labels))
        by_text = self.texts.join(labels.withColumnRenamed("node", "row"), "row", "left").select("key", F.coalesce("label", "row").alias("label"))
        return materialise(self.sketched.select("row", "doc_id", "key").join(by_text, "key"), "classes")


def near_duplicates(docs: DataFrame, **names) -> DataFrame:
    """One row per input row: doc_id, class_id (smallest doc_id of the class), class_size, kept (one row of each class)."""
    rows = NearDuplicates(docs, **names).classes()
    heads = rows.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"), F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row")).alias("head"))
    return rows.join(heads, "label").select("row", "doc_id", "class_id", "class_size", (F.col("row") == F.col("head.row")).alias("kept"))


def keep_one_of_each(docs: DataFrame, **names) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    docs = stable(docs)
    return without_rows(docs, near_duplicates(docs, **names).where(~F.col("kept")).select("row"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: one row each with its class."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("row")
