"""Language ID: segmentation-marginalised unigrams over a fixed public piece vocabulary.

A language is a unigram distribution over the pieces of a published vocabulary (nothing is trained on how to split). A word's
probability is the sum over *all* its segmentations into pieces, by the forward algorithm; a text's is the product over its
words. Piece probabilities are fitted by EM (forward-backward expected counts, weighted by word counts), one small distributed
job a round. The posterior over the learned languages is the score.

A word is a run of letters, lower-cased, with the vocabulary's word mark in front; longer runs than MAX_WORD are cut there.
A letter without a piece of its own has probability UNKNOWN in every language. All words of a text are scored; distinct words are
scored once in a worker, in numpy slabs of equal length, and kept in a bounded cache.

Fitting reads FIT_ROWS labelled rows a language at most, in expectation (the documented bound of a classifier's sample), picked
by a hash of the id. Only text and language of rows outside the held-out fold are read in fitting; the language, source and id
of a row are never inputs of a prediction.

Defined cases: a null text or a text without a letter is ``und`` with score 0; if nothing is labelled, all rows are
``und``; null languages are not learned from; ties go to the first language by code point; repeated rows get equal results; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _R, held_out, materialise, mix64, ship, table, tidy, worker_cache

FIT_ROWS = 10_000
EM_ROUNDS = 2
MAX_WORD = 32
UNKNOWN = 1e-7
CACHE_WORDS = 250_000
FLUSH_WORDS = 300_000
BUFFER_BYTES = 1 << 20
VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
_WORDS = re.compile(r"[^\W\d_]+")  # holds other numerals, too, such as ½


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Pieces:
    """The vocabulary as a hash table of piece hashes, probed by whole arrays."""

    BITS = 17

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        names = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        # words are a mark and lower-case letters: no other piece can be part of one
        names = sorted(p for p in names if p == MARK or (p[1:] if p.startswith(MARK) else p).isalpha())
        self.names, self.n, self.longest = names, len(names), max(map(len, names))
        self.powers = np.ones(self.longest + 1, np.uint64)
        for i in range(1, self.longest + 1):
            self.powers[i] = np.uint64(int(self.powers[i - 1]) * int(_R) & (2**64 - 1))
        self.keys = np.zeros(1 << self.BITS, np.uint64)
        self.ids = np.full(1 << self.BITS, -1, np.int32)
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(names):
            by_length.setdefault(len(p), []).append(i)
        for length, ids in by_length.items():
            codes = np.frombuffer("".join(names[i] for i in ids).encode("utf-32-le"), dtype="<u4").reshape(-1, length)
            for i, h in zip(ids, self.prefixes(codes)[:, -1].tolist()):
                slot = self._slot(np.array([h], np.uint64))[0]
                while self.keys[slot]:
                    slot = (slot + 1) % len(self.keys)
                self.keys[slot], self.ids[slot] = h, i

    @staticmethod
    def prefixes(codes: np.ndarray) -> np.ndarray:
        values = mix64(codes.astype(np.uint64) + np.uint64(1))
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        for i in range(codes.shape[1]):
            out[:, i + 1] = out[:, i] * _R + values[:, i]
        return out

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        slot = self._slot(h)
        out = np.full(len(h), -1, np.int32)
        rest = np.arange(len(h))
        while len(rest):
            k = self.keys[slot]
            hit = k == h[rest]
            out[rest[hit]] = self.ids[slot[hit]]
            on = ~hit & (k != 0)
            rest, slot = rest[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out

    def arcs(self, codes: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, rows, pieces) of the lattices of equally long words; piece n stands for a letter without a piece."""
        prefix, out = self.prefixes(codes), []
        for end in range(1, codes.shape[1] + 1):
            for length in range(1, min(end, self.longest) + 1):
                ids = self.find(prefix[:, end] - prefix[:, end - length] * self.powers[length])
                if length == 1:
                    out.append((end - 1, end, np.arange(len(ids)), np.where(ids < 0, self.n, ids)))
                else:
                    rows = np.flatnonzero(ids >= 0)
                    if len(rows):
                        out.append((end - length, end, rows, ids[rows]))
        return out


_PIECES: dict[str, Pieces] = worker_cache("pieces")


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def letter_runs(text: str) -> list[str]:
    """The runs of letters (Unicode categories L*) of a text, marked and cut at MAX_WORD."""
    out, runs = [], _WORDS.findall(text.lower())
    if not "".join(runs).isalpha():
        runs = [part for run in runs for part in ([run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]
    for run in runs:
        while len(run) > MAX_WORD:
            out.append(MARK + run[:MAX_WORD])
            run = run[MAX_WORD:]
        out.append(MARK + run)
    return out


def slabs(words: list[str], most: int = 4_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes and code points of equally long words, a bounded number at a time."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        for lo in range(0, len(at), most):
            idx = at[lo:lo + most]
            yield idx, np.frombuffer("".join(words[i] for i in idx).encode("utf-32-le"), dtype="<u4").reshape(len(idx), length)


def forward(arcs, n: int, length: int, probs: np.ndarray) -> np.ndarray:
    """Sums over all segmentations: (n, languages). probs: (pieces+1, languages)."""
    alpha = np.zeros((length + 1, n, probs.shape[1]))
    alpha[0] = 1
    for start, end, rows, ids in arcs:
        if len(rows) == n:
            alpha[end] += alpha[start] * probs[ids]
        else:
            alpha[end, rows] += alpha[start, rows] * probs[ids]
    return alpha


def word_log_probs(words: list[str], vocab: Pieces, probs: np.ndarray) -> np.ndarray:
    out = np.zeros((len(words), probs.shape[1]))
    for idx, codes in slabs(words):
        alpha = forward(vocab.arcs(codes), len(idx), codes.shape[1], probs)
        out[idx] = np.log(np.maximum(alpha[-1], 1e-300))
    return out


def expected_counts(words: list[str], weights: np.ndarray, vocab: Pieces, probs: np.ndarray) -> np.ndarray:
    """Forward-backward: expected uses of each piece in the words, by weight. probs: (pieces+1,)."""
    total = np.zeros(vocab.n + 1)
    for idx, codes in slabs(words):
        n, length = codes.shape
        arcs = vocab.arcs(codes)
        alpha = forward(arcs, n, length, probs[:, None])[:, :, 0]
        beta = np.zeros((length + 1, n))
        beta[length] = 1
        for start, end, rows, ids in reversed(arcs):
            beta[start, rows] += beta[end, rows] * probs[ids]
        scale = weights[idx] / np.maximum(alpha[length], 1e-300)
        for start, end, rows, ids in arcs:
            total += np.bincount(ids, alpha[start, rows] * probs[ids] * beta[end, rows] * scale[rows], minlength=vocab.n + 1)
    return total


# --------------------------------------------------------------------------- fitting

def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def flush():
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text")):
            c = counts.setdefault(lang.as_py(), Counter())
            c.update(letter_runs(text.as_py() or ""))
            if sum(map(len, counts.values())) > FLUSH_WORDS:
                yield flush()
    yield flush()


def _expect(path: str, langs: list[str], probs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = pieces(path)
        total = np.zeros((len(langs), vocab.n + 1))
        for batch in batches:
            lang, words, n = np.array(batch.column("lang").to_pylist()), batch.column("word").to_pylist(), batch.column("n").to_numpy()
            for k, name in enumerate(langs):
                at = np.flatnonzero(lang == name)
                if len(at):
                    total[k] += expected_counts([words[i] for i in at], n[at].astype(float), vocab, probs[:, k])
        k, piece = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[k, piece])], names=["k", "piece", "expected"])

    return run


class LanguageModel:
    """languages, their piece probabilities (pieces+1, languages) and log priors. Its size is bounded by vocabulary times languages."""

    def __init__(self, langs: list[str], probs: np.ndarray, path: str):
        self.langs, self.probs, self.path = langs, probs, path


def fit(labelled: DataFrame, *, fit_rows: int = FIT_ROWS, rounds: int = EM_ROUNDS, path: str | None = None) -> LanguageModel:
    """labelled: doc_id, text, lang (rows to learn from)."""
    spark = labelled.sparkSession
    ship(spark)
    path = path or vocabulary_path()
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))  # one row a language
    share = F.lit(float(fit_rows)) / F.col("rows")
    sample = rows.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * float(1 << 30))
    words = materialise(sample.select("lang", "text").mapInArrow(tidy(_count_words), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    vocab = pieces(path)
    probs = np.full((vocab.n + 1, len(langs)), 1.0 / vocab.n)
    probs[-1] = UNKNOWN
    for _ in range(rounds if langs else 0):
        got = words.mapInArrow(tidy(_expect(path, langs, probs), "pieces"), "k int, piece int, expected double").groupBy("k", "piece").agg(F.sum("expected").alias("expected")).toPandas()
        total = np.zeros((len(langs), vocab.n + 1))
        total[got["k"].to_numpy(), got["piece"].to_numpy()] = got["expected"].to_numpy()
        total = np.round(total, 6)[:, :-1] + 0.1
        probs[:-1] = (total / total.sum(axis=1, keepdims=True)).T
    return LanguageModel(langs, probs, path)


# --------------------------------------------------------------------------- prediction

class _Scorer:
    def __init__(self, model: LanguageModel):
        self.model, self.vocab = model, pieces(model.path)
        self.reset()

    def reset(self):
        self.index: dict[bytes, int] = {}
        self.table = np.zeros((1 << 16, len(self.model.langs) + 1))  # log probabilities and number of words with letters

    def learn(self, new: list[bytes]) -> None:
        runs, owner = [], []
        for i, w in enumerate(new):
            for r in letter_runs(w.decode("utf-8", "replace")):
                runs.append(r)
                owner.append(i)
        values = np.zeros((len(new), self.table.shape[1]))
        if runs:
            owner = np.array(owner)
            lp = word_log_probs(runs, self.vocab, self.model.probs)
            for k in range(lp.shape[1]):
                values[:, k] = np.bincount(owner, lp[:, k], minlength=len(new))
            values[:, -1] = np.bincount(owner, minlength=len(new))
        base = len(self.index)
        while base + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[base:base + len(new)] = values
        self.index.update(zip(new, range(base, base + len(new))))

    def totals(self, texts: list[bytes]) -> np.ndarray:
        words = [t.split() for t in texts]
        new = set().union(*words).difference(self.index) if words else set()
        if len(self.index) + len(new) > CACHE_WORDS:
            self.reset()
            new = set().union(*words)
        if new:
            self.learn(sorted(new))
        get = self.index.__getitem__
        out = np.zeros((len(texts), self.table.shape[1]))
        for i, ws in enumerate(words):
            if ws:
                out[i] = self.table[np.fromiter(map(get, ws), np.int64, len(ws))].sum(axis=0)
        return out


def _predict(shared, keep_text: bool = False):
    state: list[_Scorer] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not state:
            state.append(_Scorer(shared.value))
        scorer, langs = state[0], shared.value.langs
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            lo, part, held, totals = 0, [], 0, []
            for i in range(len(texts)):  # slabs of some MB of text
                part.append(texts[i].as_py() or b"")
                held += len(part[-1])
                if held >= BUFFER_BYTES or i == len(texts) - 1:
                    totals.append(scorer.totals(part))
                    lo, part, held = i + 1, [], 0
            total = np.concatenate(totals) if totals else np.zeros((0, len(langs) + 1))
            known = (total[:, -1] > 0) & (len(langs) > 0)
            pred, score = np.full(len(total), "und", dtype=object), np.zeros(len(total))
            if len(langs):
                ll = total[:, :-1]
                best = ll.argmax(axis=1)
                post = 1 / np.exp(ll - ll.max(axis=1, keepdims=True)).sum(axis=1)
                pred[known], score[known] = np.array(langs, dtype=object)[best[known]], post[known]
            carried = [c for c in batch.schema.names if keep_text or c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(pred, pa.string()), pa.array(score)], names=[*carried, "lang_pred", "score"])

    return run


def predict(rows: DataFrame, model: LanguageModel, *, keep_text: bool = False) -> DataFrame:
    """rows: text and columns to carry. Returns those columns with lang_pred, score."""
    spark = rows.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if keep_text or f.name != "text")
    return rows.mapInArrow(tidy(_predict(shared, keep_text), "pieces"), f"{carried}, lang_pred string, score double")


def identify(docs: DataFrame, *, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """docs: doc_id, text, lang. Learns outside the held-out fold, predicts all rows."""
    fold = held_out(F.col("doc_id"), modulus, remainder)
    model = fit(docs.where(~fold).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    return predict(docs.select("doc_id", fold.alias("held_out"), F.col("text").cast("string").alias("text")), model)


def with_language(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, with their own columns, whose language is told (not ``und``): those with a letter."""
    fold = held_out(F.col(id_col), 5, 0)
    model = fit(docs.where(~fold).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")))
    names = [f"c{k}" for k in range(len(docs.columns))]  # no clash with the prediction's columns
    at = docs.columns.index(text_col)
    rows = docs.toDF(*["text" if k == at else n for k, n in enumerate(names)]).withColumn("text", F.col("text").cast("string"))
    told = predict(rows, model, keep_text=True).where(F.col("lang_pred") != "und")
    return told.drop("lang_pred", "score").toDF(*docs.columns)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 2 over all of ``documents``."""
    return identify(table(spark, sf_dir, "documents"))
