"""Chunks of text for retrieval, as exploded rows.

Substrings by position and growing arrays cost Spark's expressions the square of a text's length, so a text is cut by one Arrow function, in time
linear in its length; counts of words and tokens are native. Positions count the parts' lengths and joiners, so those of packed chunks are approximate.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from verisift.functions.text import tokens_from_words, word_count

CHUNKS_TYPE = T.ArrayType(T.StructType().add("text", "string").add("char_start", "integer").add("char_end", "integer"))
STRATEGIES = ("fixed", "sentence", "paragraph", "semantic")
# Where a sentence ends, where a paragraph ends.
SENTENCE_BREAK = r'(?<=[.!?])\s+(?=[A-Z"])'
PARAGRAPH_BREAK = r"\n{2,}"

Chunk = tuple[str, int, int]


def fixed(text: str, size: int, overlap: int) -> Iterator[Chunk]:
    """Windows of ``size`` characters, each ``size - overlap`` after the one before."""
    for at in range(0, len(text), max(1, size - overlap)):
        window = text[at:at + size]
        yield window, at, at + len(window)


def _packed(text: str, break_: str, joiner: str, size: int) -> Iterator[Chunk]:
    """As many parts as fit, one at least. Where a chunk ends is looked up in the running sum of the parts' lengths."""
    parts = [part for piece in re.split(break_, text) if (part := piece.strip())]
    gap, at = len(joiner), 0
    sums = [0, *accumulate(len(part) + gap for part in parts)]
    while at < len(parts):
        after = max(at + 1, bisect_right(sums, sums[at] + size + gap) - 1)
        chunk = joiner.join(parts[at:after])
        yield chunk, sums[at], sums[at] + len(chunk)
        at = after


def sentences(text: str, size: int) -> Iterator[Chunk]:
    return _packed(text, SENTENCE_BREAK, " ", size)


def paragraphs(text: str, size: int) -> Iterator[Chunk]:
    return _packed(text, PARAGRAPH_BREAK, "\n\n", size)


def semantic(text: str, size: int) -> Iterator[Chunk]:
    """Paragraph chunks; those above 1.5 times the size are packed again by sentences."""
    for chunk, start, end in paragraphs(text, size):
        if len(chunk) <= size * 1.5:
            yield chunk, start, end
        else:
            yield from ((part, start + a, start + b) for part, a, b in sentences(chunk, size))


def _cutter(strategy: str, size: int, overlap: int):
    arrow = to_arrow_type(CHUNKS_TYPE)

    def cut(text: str) -> Iterator[Chunk]:
        if strategy == "fixed":
            return fixed(text, size, overlap)
        return {"sentence": sentences, "paragraph": paragraphs}.get(strategy, semantic)(text, size)

    @F.arrow_udf(CHUNKS_TYPE)
    def cut_all(texts: pa.Array) -> pa.Array:
        offsets, chunks, starts, ends = [0], [], [], []
        for value in texts.cast(pa.binary()):
            text = (value.as_py() or b"").decode("utf-8", "replace")
            for chunk, start, end in cut(text) if text.strip() else ():
                chunks.append(chunk)
                starts.append(start)
                ends.append(end)
            offsets.append(len(chunks))
        fields = [pa.array(chunks, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
        structs = pa.StructArray.from_arrays(fields, fields=list(arrow.value_type))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs).cast(arrow)

    return cut_all


def chunks(text: Column, strategy: str = "paragraph", size: int = 512, overlap: int = 50) -> Column:
    """Chunks of a text; none for null or blank text. Unknown strategies are ``semantic``."""
    return _cutter(strategy, size, overlap)(text)


def chunk_rows(df: DataFrame, text_col: str, *keep: str, strategy: str = "paragraph", size: int = 512, overlap: int = 50) -> DataFrame:
    """One row per chunk: ``keep``, index, text, char_start, char_end, word_count, token_estimate."""
    out = df.select(*keep, F.posexplode(chunks(F.col(text_col), strategy, size, overlap)).alias("index", "chunk"))
    words = word_count(F.col("chunk.text"))
    return out.select(*keep, "index", "chunk.text", "chunk.char_start", "chunk.char_end", words.alias("word_count"), tokens_from_words(words).alias("token_estimate"))
