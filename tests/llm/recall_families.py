"""python tests/llm/recall_families.py: merges that near-dedup loses against brute force in made-up hot families (README's figures)."""

from __future__ import annotations

import itertools
import random
import sys
import tempfile
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from verisift.llm import near_dedup  # noqa: E402

FAMILIES = [(1, 400, 200, 3), (2, 1000, 200, 3), (3, 400, 400, 6), (4, 600, 120, 2)]  # seed, texts, words, edits


def family(seed: int, size: int, n_words: int, edits: int) -> list[str]:
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocab) for _ in range(n_words)]
    out = []
    for _ in range(size):
        words = list(base)
        for _ in range(edits):
            words[rng.randrange(n_words)] = rng.choice(vocab)
        out.append(" ".join(words))
    return out


def by_force(texts: list[str]) -> tuple[list[int], int, float]:
    """Class of each text, number of links, median similarity."""
    sequences = [near_dedup.labelled(near_dedup.shingles(np.array([hash(w) & (2**63 - 1) for w in t.split()], np.uint64))) for t in texts]
    root, links, sims = list(range(len(texts))), 0, []

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            sims.append(near_dedup.alignment_similarity(sequences[i], sequences[j], 0.8))
            if sims[-1] >= 0.8:
                links += 1
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))], links, float(np.median(sims))


def main() -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "16").config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp()}").config("spark.ui.enabled", "false").getOrCreate()
    for seed, size, n_words, edits in FAMILIES:
        texts = family(seed, size, n_words, edits)
        want, links, median = by_force(texts)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
        got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
        sound = all(want[i] == want[j] or got[i] != got[j] for i, j in itertools.combinations(range(size), 2))
        print(f"{size} texts of {n_words} words, {edits} edits: median {median:.3f}, links {links}, merges {size - len(set(want))}, lost {len(set(got.values())) - len(set(want))}, sound {sound}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
