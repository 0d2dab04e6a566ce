"""The corpus operators on small awkward tables, against brute force in plain Python."""

from __future__ import annotations

import gzip
import hashlib
import io
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from verisift.llm import common, exact_dedup, filters, fingerprints, language_id, lm_scoring, mixing, near_dedup, packing, substring_dedup, url_filters, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size string, score string, _row string, `key` string"


def make_docs(rng):
    """Copies, near copies, shared passages, nulls everywhere, empty, blank, very long and repeated rows."""
    vocab = {"en": ["the", "and", "of", "house", "river", "stone", "walks", "quiet", "morning", "light"], "fr": ["le", "et", "de", "maison", "rivière", "pierre", "marche", "calme", "matin", "lumière"]}
    words = {k: v + [rng.choice(v) + rng.choice(v) for _ in range(300)] for k, v in vocab.items()}
    prose = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows, passage = [], prose("en", 50)
    for i in range(60):
        lang = "en" if i % 3 else "fr"
        rows.append([i, prose(lang, rng.randint(3, 160)), lang, f"s{i % 5}"])
    for i in range(60, 70):
        rows.append([i, rows[i - 60][1].replace(" ", "\n" if i % 2 else "  "), "en", "s0"])  # copies but for white space
    for i in range(70, 76):
        w = prose("en", 200).split()
        rows.append([2 * i, " ".join(w), "en", "s1"])
        w[100] = "changed"
        rows.append([2 * i + 1, " ".join(w), "en", "s1"])
    for i in range(200, 206):
        rows.append([i, prose("en", 30) + " " + passage + " " + prose("en", 30), None, None])
    rows += [[300, None, "en", "s2"], [301, "", None, "s2"], [302, " \n\t ", "fr", "s2"], [303, "12 34 !!", "en", "s2"], [306, "½ ² Ⅷ ٣ _", "en", "s2"], [None, prose("en", 40), "en", None], [304, prose("fr", 20_000), "fr", "s3"], [305, "the " * 500, "en", "s3"]]
    rows += [list(rows[5]), list(rows[5])]  # repeated rows
    return [tuple([*r, len(r[1]) if r[1] else None, "x", "y", "z", "_", "k"]) for r in rows]


@pytest.fixture(scope="module")
def rows():
    return make_docs(random.Random(3))


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('docs')}/documents.parquet"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id = -1")


def norm(t):
    import re

    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def words(t):
    return (t or "").encode().split()


# --------------------------------------------------------------------------- tokens

def test_words_and_hashes_agree_with_bytes():
    import pyarrow as pa

    texts = ["The cat", None, "", " \t a\x0bb ", "é è x", "same same"]
    raw, offsets = common.binary_column(pa.array(texts))
    starts, ends, at = common.word_spans(raw, offsets)
    got = [[bytes(raw[s:e]) for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(at, at[1:])]
    assert got == [words(t) for t in texts]
    h = common.word_hashes(raw, starts, ends, lower=True)
    flat = [w.lower() for ws in got for w in ws]
    assert len(set(h.tolist())) == len(set(flat)) and h[-1] == h[-2]


# --------------------------------------------------------------------------- 6: exact dedup

def test_exact_groups(docs, rows, none):
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    smallest = {k: min(v, key=lambda i: (i is None, i or 0)) for k, v in groups.items()}
    got = exact_dedup.exact_groups(docs).collect()
    want = Counter((r[0], smallest[norm(r[1])], len(groups[norm(r[1])]), hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in rows)
    assert Counter((g["doc_id"], g["keep_id"], g["group_size"], g["text_sha256"]) for g in got) == want
    kept = [g for g in got if g["kept"]]
    assert len(kept) == len(groups) and all(g["doc_id"] == g["keep_id"] for g in kept)
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.drop_copies(docs).columns == docs.columns and exact_dedup.drop_copies(docs).count() == len(groups)


def test_digest_index(spark):
    entries = spark.createDataFrame([(bytearray([i % 4]), (False, i, i)) for i in range(20)], "digest binary, row_key struct<no_id:boolean,doc_id:long,row:long>")
    index = exact_dedup.DigestIndex(spark)
    index.ingest(entries, 20)
    index.ingest(entries.where("row_key.doc_id < 8"), 8)
    index.ingest(entries.where("row_key.doc_id = -1"), 0)
    merge = index._merge(*index.runs[:2])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in merge and "Exchange" not in merge
    assert index.get(b"\x02").count() == 2
    index.compact()
    got = {bytes(r["digest"])[0]: (r["row_key"]["doc_id"], r["n"]) for r in index.entries().collect()}
    assert got == {k: (k, 7) for k in range(4)}
    assert index.get(b"\x02").first()["n"] == 7 and index.get(b"\x09").count() == 0
    index.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_run")]


def test_filters(spark, monkeypatch):
    keys = spark.range(0, 30_000, 3).select(F.xxhash64("id").alias("h"))
    rows = spark.range(30_000).withColumn("_block", F.lit("clash"))
    for most in (filters.BROADCAST_BYTES, 0):
        monkeypatch.setattr(filters, "BROADCAST_BYTES", most)
        got = filters.BlockFilter(keys, 10_000).probe(rows, F.xxhash64("id"), "maybe")
        assert got.columns == ["id", "_block", "maybe"]
        n = {r["k"]: (r["n"], r["hits"]) for r in got.groupBy((F.col("id") % 3 == 0).alias("k")).agg(F.count("*").alias("n"), F.count(F.when(F.col("maybe"), 1)).alias("hits")).collect()}
        assert n[True] == (10_000, 10_000) and n[False][0] == 20_000 and n[False][1] < 1000
    none = filters.BlockFilter(keys.where("false"), 0).probe(rows, F.xxhash64("id"), "maybe")
    assert none.where("maybe").count() == 0


def test_collisions_are_grouped_by_bytes(spark, docs, monkeypatch):
    """All texts under one digest: the bytes decide."""
    monkeypatch.setattr(F, "sha2", lambda c, n: F.lit("00" * 32))
    got = exact_dedup.exact_groups(docs.where("doc_id < 5 or doc_id in (60, 61)"))
    sizes = sorted(r["group_size"] for r in got.collect())
    monkeypatch.undo()
    assert sizes == sorted(r["group_size"] for r in exact_dedup.exact_groups(docs.where("doc_id < 5 or doc_id in (60, 61)")).collect())


# --------------------------------------------------------------------------- 4: mixing

def water_fill(sizes):
    """sizes: in order of sources. The iterative rule of the contract."""
    w = [1 + i % 3 for i in range(len(sizes))]
    target, fixed, left = [0.0] * len(sizes), set(), float(sum(sizes))
    while True:
        open_ = [i for i in range(len(sizes)) if i not in fixed]
        total = sum(w[i] for i in open_)
        over = [i for i in open_ if left * w[i] / total > 3 * sizes[i]] if total else []
        if not over:
            for i in open_:
                target[i] = left * w[i] / total
            return target
        for i in over:
            target[i] = 3.0 * sizes[i]
            fixed.add(i)
            left -= target[i]


def test_mixing(docs, rows, none):
    size = Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, water_fill([size[n] for n in names])))
    got = mixing.mix(docs).collect()
    assert Counter((g["doc_id"], g["size"]) for g in got) == Counter((r[0], len(words(r[1]))) for r in rows)
    taken, source_of = Counter(), {(r[0], len(words(r[1]))): r[3] for r in rows}
    for g in got:
        s = source_of[g["doc_id"], g["size"]]
        assert g["source_size"] == size[s] and g["target"] == pytest.approx(target[s]) and g["taken"] <= 3 * g["size"]
        taken[s] += g["taken"]
    largest = {s: max([len(words(r[1])) for r in rows if r[3] == s]) for s in names}
    assert all(abs(taken[s] - target[s]) <= largest[s] * 1.5 for s in names)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=str)
    assert mixing.mix(none).count() == 0
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns and sum(len(words(r["text"])) for r in out.collect()) == sum(taken.values())


def test_mixing_of_repeated_rows(spark):
    """Null ids, one id for all, and equal rows: each source still comes near its target, and reruns agree."""
    data = [(None, f"a{i} " + "w " * 9, "a") for i in range(600)] + [(7, "same words here", "b") for _ in range(900)] + [(7, f"x{i} y", "c") for i in range(300)] + [(i, "z " * 50, "d") for i in range(10)]
    frame = lambda parts: spark.createDataFrame(data, "doc_id long, text string, source string").repartition(parts)
    got, per = mixing.mix(frame(3)).collect(), defaultdict(lambda: [0, 0, 0.0])
    for g in got:
        per[g["target"]][0] += g["taken"]
    size = {"a": 6000, "b": 2700, "c": 600, "d": 500}
    for t in water_fill([size[s] for s in "abcd"]):
        assert abs(per[t][0] - t) <= 50
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(frame(7)).collect()))


def test_smaller_budgets_are_nested(spark):
    data = spark.createDataFrame([("s", i * 7919 % 100_003, 10) for i in range(400)], "source_key string, hash long, size long").withColumn("hash", F.col("hash") * (1 << 43))
    cut = lambda b: mixing.thresholds(data, spark.createDataFrame([("s", float(b))], "source_key string, budget double")).first()["threshold"]
    taken = {b: {r["hash"] for r in data.where(F.col("hash") < cut(b)).collect()} for b in (0, 35, 100, 2000, 4000)}
    assert [len(taken[b]) for b in (0, 35, 100, 2000, 4000)] == [0, 3, 10, 200, 400]
    assert taken[35] <= taken[100] <= taken[2000]


# --------------------------------------------------------------------------- 5: substring dedup

def brute_repeats(rows, window):
    """(id, words) in order; the mask of each row's removed words."""
    counts = Counter(tuple(w[j:j + window]) for w in rows for j in range(len(w) - window + 1))
    for w in rows:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if counts[tuple(w[j:j + window])] > 1:
                gone[j:j + window] = [True] * window
        yield gone


def windows_that_repeat(rows):
    counts = Counter(tuple(w[j:j + 35]) for w in (words(r[1]) for r in rows) for j in range(len(w) - 34))
    return sum(n for n in counts.values() if n > 1)


def test_search_ends_where_nothing_survives(spark):
    data = [(i, " ".join(f"w{i}x{k}" for k in range(60))) for i in range(8)]
    report = []
    got = substring_dedup.remove_repeats(spark.createDataFrame(data, "doc_id long, text string"), report=report).collect()
    assert report == [(5, 0, 0)] and all((g["n_words"], g["n_removed"]) == (60, 0) for g in got) and len(got) == 8


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_substring_dedup(docs, rows, none, levels):
    want = Counter()
    for r, gone in zip(rows, brute_repeats([words(r[1]) for r in rows], 35)):
        kept = b" ".join(w for w, g in zip(words(r[1]), gone) if not g)
        want[r[0], len(gone), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    report = []
    got = substring_dedup.remove_repeats(docs, levels=levels, texts=True, report=report).collect()
    assert [r[0] for r in report] == {1: [35], 2: [18, 35], 4: [5, 9, 18, 35]}[levels]
    assert [r[1:] for r in report] == sorted((r[1:] for r in report), reverse=True) and report[-1][2] == windows_that_repeat(rows)
    assert Counter((g["doc_id"], g["n_words"], g["n_removed"], g["kept_sha256"]) for g in got) == want
    assert all(sum(s["to"] - s["from"] for s in g["removed"]) == g["n_removed"] and hashlib.sha256(g["kept_text"].encode()).hexdigest() == g["kept_sha256"] for g in got)
    assert substring_dedup.remove_repeats(none).count() == 0


def test_small_windows(docs, rows):
    """Short windows repeat inside and across documents all the time."""
    got = {(g["doc_id"], g["n_words"]): g["n_removed"] for g in substring_dedup.remove_repeats(docs, window=3).collect()}
    for r, gone in zip(rows, brute_repeats([words(r[1]) for r in rows], 3)):
        assert got[r[0], len(gone)] == sum(gone)


def test_windows_of_one_word(docs, rows):
    """Runs of neighbouring documents touch without joining."""
    got = Counter((g["doc_id"], g["n_words"], g["n_removed"]) for g in substring_dedup.remove_repeats(docs, window=1).collect())
    assert got == Counter((r[0], len(gone), sum(gone)) for r, gone in zip(rows, brute_repeats([words(r[1]) for r in rows], 1)))


def test_short_documents_are_hashed_together(monkeypatch):
    """Few steps for many documents; each document's units and runs are those it has on its own."""
    import pyarrow as pa

    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40, n)) for n in [*rng.integers(0, 120, 300), 5000]]
    lone = [sorted(set(rng.integers(0, 120, 2).tolist())) for _ in texts]
    batch = pa.record_batch({"row": pa.array(np.arange(len(texts)) + 70), "text": pa.array(texts), "lone": pa.array(lone, pa.list_(pa.int32()))})
    calls, real = [], substring_dedup.shingle_hashes
    monkeypatch.setattr(substring_dedup, "shingle_hashes", lambda *a, **k: calls.append(a) or real(*a, **k))

    def units(read, b, length):
        return Counter(tuple(x.values()) for out in substring_dedup._units(read, length, 35, length < 18)(iter([b])) for x in out.to_pylist())

    def survivors(read, b, length):
        return pa.Table.from_batches(list(substring_dedup._survive(read, length, 35)(iter([b]))))

    whole, together = units(substring_dedup._from_texts, batch, 9), survivors(substring_dedup._from_texts, batch, 9)
    assert len(calls) < 10
    alone = [batch.slice(i, 1) for i in range(len(texts))]
    assert whole == sum((units(substring_dedup._from_texts, b, 9) for b in alone), Counter())
    assert together.to_pylist() == [x for b in alone for x in survivors(substring_dedup._from_texts, b, 9).to_pylist()]
    runs = together.combine_chunks().to_batches()[0]
    for length in (18, 35):
        assert units(substring_dedup._from_runs, runs, length) == sum((units(substring_dedup._from_runs, runs.slice(i, 1), length) for i in range(runs.num_rows)), Counter())


# --------------------------------------------------------------------------- 3: near-dedup

def brute_sequence(t):
    w = words(t)
    k = min(5, len(w))
    seen, out = Counter(), []
    for j in range(len(w) - k + 1 if k else 0):
        s = tuple(w[j:j + k])
        out.append((s, seen[s]))
        seen[s] += 1
    return out


def brute_similarity(a, b):
    """Longest common subsequence over the union, by the quadratic table."""
    if not a or not b:
        return float(a == b)
    table = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, table[j] = table[j], last + 1 if x == y else max(table[j], table[j - 1])
    return table[-1] / (len(a) + len(b) - table[-1])


def test_alignment_against_the_table():
    rng = random.Random(1)
    for _ in range(60):
        a = [rng.randrange(1000) for _ in range(rng.randint(1, 60))]
        b = a[:]
        for _ in range(rng.randint(0, 4)):
            b.insert(rng.randrange(len(b) + 1), rng.randrange(1000)) if rng.random() < 0.5 else b.pop(rng.randrange(len(b))) if len(b) > 1 else None
        a, b = list(dict.fromkeys(a)), list(dict.fromkeys(b))
        want = brute_similarity(a, b)
        got = near_dedup.alignment_similarity(np.array(a, np.uint64), np.array(b, np.uint64), 0.8)
        assert (got >= 0.8) == (want >= 0.8) and (want < 0.8 or got == pytest.approx(want))


def test_near_duplicates(docs, rows, none):
    texts = {}
    for r in rows:
        texts.setdefault(tuple(words(r[1])), []).append(r[0])
    keys = [k for k in texts if len(k) < 1000]
    seqs = {k: brute_sequence(" ".join(w.decode() for w in k)) for k in keys}
    parent = {k: k for k in texts}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if seqs[a] and seqs[b] and min(len(a), len(b)) >= 0.7 * max(len(a), len(b)) and set(seqs[a]) & set(seqs[b]) and brute_similarity(seqs[a], seqs[b]) >= 0.8:
                parent[find(a)] = find(b)
    members = defaultdict(list)
    for k, ids in texts.items():
        members[find(k)] += ids
    want = Counter((i, min((x for x in ids if x is not None), default=None), len(ids)) for ids in members.values() for i in ids)
    got = near_dedup.near_duplicates(docs).collect()
    assert Counter((g["doc_id"], g["class_id"], g["class_size"]) for g in got) == want
    assert sum(g["kept"] for g in got) == len(members)
    assert near_dedup.near_duplicates(none).count() == 0
    assert near_dedup.keep_one_of_each(docs).columns == docs.columns and near_dedup.keep_one_of_each(docs).count() == len(members)


def test_large_group_of_near_copies(spark):
    """One original with many copies that differ from it by a word each, and from each other by two."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10_000)}" for _ in range(150)]
    data = [(0, " ".join(base))]
    for i in range(1, 120):
        w = base[:]
        w[rng.randrange(150)] = f"n{i}"
        data.append((i, " ".join(w)))
    data += [(1000 + i, " ".join(f"w{rng.randrange(10_000)}" for _ in range(150))) for i in range(30)]
    got = near_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect()
    assert {g["class_id"] for g in got if g["doc_id"] < 1000} == {0} and all(g["class_size"] == 1 for g in got if g["doc_id"] >= 1000)


def hot_family(spark, texts=240):
    """Texts around 0.67 to each other, a third of them with a twin of 0.8 or a little more or less; and their classes by brute force."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(200)]

    def edited(w, k):
        w = w[:]
        for j in rng.sample(range(200), k):
            w[j] = f"n{rng.random()}"
        return w

    family = [edited(base, 4) for _ in range(texts)]
    family += [edited(w, 4) for w in family[::3]]
    rng.shuffle(family)
    sets = [{tuple(w[j:j + 5]) for j in range(196)} for w in family]  # all words of a text differ, and keep their order
    label = list(range(len(family)))
    for i in range(len(family)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (392 - both) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(family)], "doc_id long, text string").repartition(4)
    return docs, dict(enumerate(label))


def classes_of(docs):
    return {g["doc_id"]: g["class_id"] for g in near_dedup.near_duplicates(docs).collect()}


def test_full_buckets_lose_no_link(spark):
    docs, want = hot_family(spark)
    assert 60 < len(want) - len(set(want.values())) and classes_of(docs) == want


def test_central_text_without_links_ends_no_search(spark, monkeypatch):
    """The text with the fullest buckets links to nothing (0.77 and less); two others of its buckets are links."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(200)]

    def edited(w, name, places):
        return [f"{name}{j}" if j in places else x for j, x in enumerate(w)]

    apart = lambda: {20 + 40 * k + rng.randrange(-15, 16) for k in range(5)}
    texts = [base] + [edited(base, f"z{i}x", apart()) for i in range(40)]
    twin = edited(base, "a", apart())
    texts[20:20] = [twin, edited(twin, "b", {3})]
    pairs = near_dedup.NearDuplicates.star_pairs
    monkeypatch.setattr(near_dedup.NearDuplicates, "star_pairs", lambda self: pairs(self).where("n < 0"))
    got = classes_of(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").coalesce(1))
    assert got == {i: 20 if i == 21 else i for i in range(len(texts))}


def test_packs_of_any_size_lose_no_link(spark, monkeypatch):
    """Buckets dealt into many packs give the classes of buckets in one; the workers read PACK from the plan, not from the module."""
    docs, want = hot_family(spark, 90)
    monkeypatch.setattr(near_dedup, "PACK", 1500)
    run = near_dedup.NearDuplicates(docs)
    packs = run.packs(run.weights.select(F.col("row").alias("node"), F.col("row").alias("label")))
    assert packs.agg(F.max("part")).first()[0] >= 2
    assert classes_of(docs) == want


def test_shared_counts_and_forest_against_sets(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(near_dedup, "RARE", 4)
    monkeypatch.setattr(near_dedup, "COLUMNS", 7)
    draw = lambda: rng.permutation(60)[:rng.integers(0, 50)].astype(np.uint64)
    left, right = [draw() for _ in range(12)], [draw() for _ in range(9)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in right] for a in left]
    assert near_dedup.shared_counts(left, right).tolist() == want
    base = np.arange(100, dtype=np.uint64)
    texts = [np.append(base[k // 4:], np.arange(1000 * k, 1000 * k + k % 9, dtype=np.uint64)) for k in range(1, 40)]
    pack = lambda at: {"row": np.array(at), "n": np.array([len(texts[k]) for k in at]), "label": np.array(at), "shingles": [texts[k] for k in at]}
    link = lambda a, b: near_dedup.alignment_similarity(texts[a], texts[b], 0.9) >= 0.9
    for l, r in ((list(range(39)), None), (list(range(0, 39, 2)), list(range(1, 39, 2)))):
        got = near_dedup.forest(pack(l), pack(r) if r else None, 0.9)
        assert all(link(a, b) for a, b, _ in got)
        parts = lambda edges: {frozenset(c) for c in joined(39, edges)}
        assert parts((a, b) for a, b, _ in got) == parts((a, b) for a in l for b in (r or l) if a != b and link(a, b))
        assert len(got) == 39 - len(joined(39, [(a, b) for a, b, _ in got]))


def joined(n, edges):
    classes = [{k} for k in range(n)]
    for a, b in edges:
        one, other = (next(c for c in classes if x in c) for x in (a, b))
        if one is not other:
            classes.remove(other)
            one |= other
    return classes


def test_sketches_follow_order():
    rng = np.random.default_rng(0)
    w = rng.integers(0, 2**63, 400).astype(np.uint64)
    h = near_dedup.shingles(w)
    one = near_dedup.sketch(h, near_dedup.labelled(h))
    turned = near_dedup.shingles(np.concatenate([w[200:], w[:200]]))
    other = near_dedup.sketch(turned, near_dedup.labelled(turned))
    edited = w.copy()
    edited[10] = 1
    e = near_dedup.shingles(edited)
    assert (one == near_dedup.sketch(e, near_dedup.labelled(e))).mean() > 0.7 > 0.4 > (one == other).mean()


# --------------------------------------------------------------------------- 7: fingerprints

def xx(values, longs=False):
    import xxhash

    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest((v & (2**64 - 1)).to_bytes(8, "little") if longs else v, seed=seed)
    return seed - 2**64 if seed >= 2**63 else seed


def xx_int(value, number):
    """xxhash64(long, int)."""
    import xxhash

    seed = xxhash.xxh64_intdigest((value & (2**64 - 1)).to_bytes(8, "little"), seed=42)
    seed = xxhash.xxh64_intdigest((number & (2**32 - 1)).to_bytes(4, "little"), seed=seed)
    return seed - 2**64 if seed >= 2**63 else seed


def brute_fingerprint(t):
    w = words(t)
    k, low = fingerprints.K, (1 << fingerprints.POS_BITS) - 1
    h = [xx(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [xx(w)] if w else []
    seen, pairs = Counter(), []
    for i, x in enumerate(h):
        x >>= fingerprints.POS_BITS
        pairs.append((xx_int(x, seen[x]) & ~low | i, i))
        seen[x] += 1
    slots = {}
    for v, i in sorted(pairs):
        slots.setdefault(v >> 58, []).append(i)
    out = []
    for b in range(-32, 32):
        out.append(None if b not in slots else f"{xx([h[i] for i in sorted(slots[b][:fingerprints.LENGTH])], longs=True) & 0xFFFF:04x}")
    return out


def brute_likeness(a, b):
    filled = [(x, y) for x, y in zip(a, b) if x or y]
    return sum(x == y for x, y in filled) / len(filled) if filled else 1.0


def test_fingerprints(docs, rows, none):
    by_id = {}
    for r in rows:
        t = r[1] or ""
        key = (r[0] is None, r[0] or 0)
        by_id.setdefault(key, []).append(t)
    order = sorted(by_id)
    stands = {k: min(v, key=lambda t: (len(t), hashlib.sha256(t.encode()).hexdigest())) for k, v in by_id.items()}
    want = Counter()
    for k, ts in by_id.items():
        after = stands[order[(order.index(k) + 1) % len(order)]]
        for t in ts:
            q = len(t) // 4
            edited = t[:len(t) - q] + after[:q]
            a, e, n = (brute_fingerprint(x) for x in (t, edited, after))
            text = lambda s: "".join(x or "----" for x in s)
            want[None if k[0] else k[1], len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(e), round(brute_likeness(a, e), 9), round(brute_likeness(a, n), 9)] += 1
    got = fingerprints.fingerprints(docs).collect()
    assert Counter((g["doc_id"], g["n_chars"], g["edited_sha256"], g["fingerprint"], g["edited_fingerprint"], round(g["near_edited"], 9), round(g["near_next"], 9)) for g in got) == want
    assert fingerprints.fingerprints(none).count() == 0
    near = [g["near_edited"] for g in got if g["n_chars"] > 300]
    assert min(near) > max(g["near_next"] for g in got if g["n_chars"] > 300 and g["near_next"] < 0.2)


def test_fingerprint_plan_is_native(docs):
    plan = docs.select(fingerprints.slots_of(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --------------------------------------------------------------------------- 2: language ID

def brute_forward(word, probs, names):
    index, alpha = {p: i for i, p in enumerate(names)}, [1.0] + [0.0] * len(word)
    for end in range(1, len(word) + 1):
        for length in range(1, min(end, language_id.MAX_WORD + 1) + 1):
            i = index.get(word[end - length:end])
            p = probs[i] if i is not None else probs[-1] if length == 1 else 0.0
            alpha[end] += alpha[end - length] * p
    return alpha[-1]


def test_forward_sums_all_segmentations():
    vocab = language_id.pieces(language_id.vocabulary_path())
    probs = np.random.default_rng(0).dirichlet(np.ones(vocab.n + 1), 2).T
    for w in ["▁the", "▁maison", "▁qßz", "▁" + "ab" * 10]:
        got = language_id.word_log_probs([w], vocab, probs)[0]
        assert got == pytest.approx([math.log(brute_forward(w, probs[:, k], vocab.names)) for k in range(2)])


def test_expected_counts_by_enumeration():
    vocab = language_id.pieces(language_id.vocabulary_path())
    probs = np.random.default_rng(1).dirichlet(np.ones(vocab.n + 1))
    index = {p: i for i, p in enumerate(vocab.names)}

    def splits(w):
        if not w:
            yield []
        for n in range(1, min(len(w), language_id.MAX_WORD + 1) + 1):
            i = index.get(w[:n], vocab.n if n == 1 else None)
            if i is not None:
                yield from ([i, *rest] for rest in splits(w[n:]))

    every = [(s, float(np.prod(probs[s]))) for s in splits("▁theme")]
    want = np.zeros(vocab.n + 1)
    for s, p in every:
        for i in s:
            want[i] += 3 * p / sum(q for _, q in every)
    assert language_id.expected_counts(["▁theme"], np.array([3.0]), vocab, probs) == pytest.approx(want)


def test_language_id(docs, rows, none):
    got = language_id.identify(docs).collect()
    truth = {r[0]: r[2] for r in rows}
    assert len(got) == len(rows)
    for g in got:
        assert g["held_out"] == (zlib.crc32(b"" if g["doc_id"] is None else str(g["doc_id"]).encode()) % 5 == 0)
        if g["doc_id"] in (300, 301, 302, 303, 306):
            assert (g["lang_pred"], g["score"]) == ("und", 0.0)
        else:
            assert g["lang_pred"] in ("en", "fr") and 0 <= g["score"] <= 1
    judged = [g for g in got if g["held_out"] and truth[g["doc_id"]] and g["lang_pred"] != "und" and (g["doc_id"] or 99) < 60]
    assert np.mean([g["lang_pred"] == truth[g["doc_id"]] for g in judged]) > 0.9
    assert language_id.identify(none).count() == 0
    unlabelled = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {g["lang_pred"] for g in unlabelled} == {"und"}
    kept = language_id.with_language(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {300, 301, 302, 303, 306}


# --------------------------------------------------------------------------- 1: LM scoring

def test_lm_base_scores_and_counts(docs, rows, none):
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    tokens = lambda t: [*(w.lower() for w in words(t)), None]
    c = Counter(w for r in rows if not fold(r[0]) for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for r in rows:
        ts = tokens(r[1])
        want[r[0], fold(r[0]), len(ts), sum(c[w] > 0 for w in ts), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ts), 5)] += 1
    got = lm_scoring.score_documents(docs).collect()
    assert Counter((g["doc_id"], g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"], round(g["base_score"], 5)) for g in got) == want
    held = [g for g in got if g["held_out"]]
    assert sum(g["score"] for g in held) > sum(g["base_score"] for g in held) and all(g["score"] < 0 for g in got)
    assert lm_scoring.score_documents(none).count() == 0
    only_held = docs.where(common.held_out(F.col("doc_id"), 7, 2))
    assert {(g["score"], g["base_score"]) for g in lm_scoring.score_documents(only_held).collect()} == {(0.0, 0.0)}


def test_head_limit_leaves_counts_whole(docs, monkeypatch):
    """With a small head the rest of the words is counted through the join."""
    whole = {(g["doc_id"], g["n_tokens"]): g for g in lm_scoring.score_documents(docs).collect()}
    real = lm_scoring.fit_vocabulary
    monkeypatch.setattr(lm_scoring, "fit_vocabulary", lambda counts: real(counts, 40))
    for g in lm_scoring.score_documents(docs).collect():
        w = whole[g["doc_id"], g["n_tokens"]]
        assert (g["n_known"], g["train_tokens"]) == (w["n_known"], w["train_tokens"]) and g["base_score"] == pytest.approx(w["base_score"]) and g["score"] < 0


def test_event_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    words_, counts = np.unique(rng.integers(1, 2**63, 3000).astype(np.uint64)), None
    counts = rng.integers(2, 500, len(words_))
    vocab = lm_scoring.Vocabulary(words_, counts, {"tokens": int(counts.sum()) + 100, "types": len(words_) + 50, "threshold": 2, "outside_tokens": 100, "unseen": 0.5})
    assert (vocab.find(words_) < len(words_)).all() and (vocab.find(words_ + np.uint64(1)) == len(words_)).sum() > 2900
    w = vocab.start_weights() + rng.normal(0, 0.3, (vocab.layout.rows, lm_scoring.SLOTS)).astype(np.float32)
    labels = np.array([5, 700, 3, 0])
    total = sum(np.exp(lm_scoring.log_probs(w, vocab, np.array([5, 700, 3, e]), vocab.code[labels], np.array([0, 4])))[3] for e in range(lm_scoring.EVENTS))
    assert total == pytest.approx(1, abs=1e-4)
    inside = defaultdict(float)
    for i, e in enumerate(vocab.event[:-1]):
        inside[e] += 10 ** vocab.inside[i]
    assert all(x == pytest.approx(1) for x in inside.values())


def test_score_against_a_plain_softmax(spark, docs, rows, monkeypatch):
    """score of whole rows, from the trained weights, one token at a time in plain Python."""
    kept = {}
    real = lm_scoring.train
    monkeypatch.setattr(lm_scoring, "train", lambda training, vocab: kept.setdefault("w", (vocab, real(training, vocab)))[1])
    got = {g["doc_id"]: g["score"] for g in lm_scoring.score_documents(docs).collect()}
    vocab, w = kept["w"]
    u, at = (1 << 64) - 1, vocab.layout
    golden, r = int(common._GOLDEN), int(common._R)

    def softmax(indexes):
        x = [sum(float(w[i][k]) for i in indexes) for k in range(32)]
        top = max(x)
        total = sum(math.exp(v - top) for v in x)
        return [v - top - math.log(total) for v in x]

    def score(text):
        tokens = lm_tokens(text)
        seen, total = [int(lm_scoring.START)] * 3, 0.0
        for index in vocab.find(tokens).tolist():
            c1, c2, c3 = seen[-1], seen[-2], seen[-3]
            cls, slot = divmod(int(vocab.place[int(vocab.event[index])]), 32)
            top = lambda x, bits: (x & u) >> (64 - bits)
            one = softmax([at.bias, at.prev1 + top(c1, at.bits), at.prev2 + top(c2, at.bits - 1), at.prev3 + top(c3, at.bits - 2), at.pair + top((c1 * r + c2) * golden, at.bits)])
            two = softmax([at.slot_bias + cls, at.slot1 + top((c1 + cls * r) * golden, at.bits), at.slot2 + top((c2 + cls * r) * golden, at.bits - 1)])
            total += (one[cls] + two[slot]) / math.log(10) + float(vocab.inside[index])
            seen.append(int(vocab.code[index]))
        return total

    for i, text in [(r_[0], r_[1]) for r_ in rows if r_[0] in (0, 1, 7, 20, 140, 300)]:
        assert got[i] == pytest.approx(score(text), rel=1e-4)  # all known words are in the head: an unknown one has the whole of the last event


def test_every_context_has_room_for_a_row_of_its_own():
    """60,000 words before a token, their pairs and their classes, in the table of 16 million training tokens: none but chance collisions share a row."""
    layout = lm_scoring.Layout(1 << 24)
    rng = np.random.default_rng(6)
    c = np.unique(rng.integers(1, 2**63, 60000).astype(np.uint64))
    by_class, in_class = layout.features(c, c[::-1].copy(), np.roll(c, 1), rng.integers(0, 32, len(c)))
    assert all(len(np.unique(rows)) > 0.99 * len(c) for rows in by_class + in_class[1:])
    assert [lm_scoring.Layout(1 << k).bits > k for k in (10, 20, 33, 40)] == [True] * 4


def test_rows_travel_and_merge_whole():
    """Over several shards: rows come back as sent, are averaged by tokens, kept where no one touched them, and answered to those who ask."""
    import pyarrow as pa

    rng = np.random.default_rng(7)
    far = 5 << lm_scoring.SHARD_BITS
    ids = [np.unique(rng.integers(0, far, 3000)) for _ in range(3)]
    w = [(rng.integers(-3000, 3000, (len(i), 32)) / 64).astype(np.float32) for i in ids]
    n = [rng.integers(1, 50, len(i)) for i in ids]
    old = lm_scoring.pack(ids[2], None, w[2])
    assert (old.num_rows, *map(np.array_equal, lm_scoring.unpack(old.to_pylist()[::-1]), (ids[2], w[2] * 64))) == (5, True, True)
    sent = pa.Table.from_batches([lm_scoring.pack(ids[0], n[0], w[0]), old, lm_scoring.pack(ids[1], n[1], w[1])])
    shards = [lm_scoring._merge(sent.filter(pa.compute.equal(sent["shard"], s))) for s in range(5)]
    got = dict(zip(*lm_scoring.unpack(pa.concat_tables(shards).to_pylist())))
    want, tokens = {}, Counter()
    for i in (0, 1):
        for row, k, x in zip(ids[i].tolist(), n[i], w[i] * 64.0):
            want[row] = want.get(row, 0) + k * x
            tokens[row] += k
    want = {row: np.rint(x / tokens[row]) for row, x in want.items()}
    want = dict(zip(ids[2].tolist(), w[2] * 64)) | want
    assert got.keys() == want.keys() and all(np.array_equal(got[r], want[r]) for r in want)
    asked = np.unique(np.concatenate([ids[0][::2], rng.integers(0, far, 500)]))
    ask = pa.Table.from_batches([lm_scoring.pack(asked, part=9)])
    answers = [lm_scoring._answer(pa.concat_tables([t, ask.filter(pa.compute.equal(ask["shard"], s))])) for s, t in enumerate(shards)]
    assert all(set(a["part"].to_pylist()) == {9} for a in answers)
    assert lm_scoring.unpack(pa.concat_tables(answers).to_pylist())[0].tolist() == [r for r in asked.tolist() if r in want]


def test_parts_hold_tokens_and_scores_come_from_steps(monkeypatch):
    """What a part holds in place of texts is what the texts give; numbers travel whole in as few planes as they need; steps and weights score alike."""
    import pyarrow as pa

    for x in (np.array([], np.uint16), np.zeros(9, np.uint32), np.array([0, 255], np.int64), np.array([65535, 256], np.uint16), np.array([3, 1 << 50], np.int64)):
        sent = lm_scoring.squeeze(x)
        assert sent[0] == (int(x.max(initial=0)).bit_length() + 7) // 8 and np.array_equal(lm_scoring.expand(sent, x.dtype, len(x)), x)
    rng = np.random.default_rng(11)
    texts = [None, "", *(" ".join(f"w{k}" for k in rng.zipf(1.3, n) % 5000) for n in (1, 400, 3000)), "x"]
    batch = pa.RecordBatch.from_pydict({"row": [*range(6)], "doc_id": [*range(6)], "held_out": [False] * 6, "text": pa.array(texts, pa.string())})
    _, tokens, offsets = next(lm_scoring.slabs(batch))
    words_, counts = np.unique(tokens, return_counts=True)
    head = counts > 1
    stats = {"tokens": len(tokens), "types": len(words_), "threshold": 2, "outside_tokens": int((~head).sum()), "unseen": 0.5}
    vocab = lm_scoring.Vocabulary(words_[head], counts[head], stats)
    monkeypatch.setattr(lm_scoring, "TaskContext", type("One", (), {"get": staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 3})())}))
    (dealt,) = lm_scoring._deal(type("Shared", (), {"value": vocab}))(iter([batch]))
    for one, other in ((lm_scoring.indexed(vocab, dealt.slice(k)), lm_scoring.indexed(vocab, batch.slice(k))) for k in (0, 2)):
        assert all(np.array_equal(a, b) for a, b in zip(next(one), next(other), strict=True))
    index = vocab.find(tokens)
    at = np.split(tokens, offsets[1:-1])
    assert dealt["outside"].to_pylist() == [t[vocab.find(t) == len(vocab.counts) - 1].view(np.int64).tolist() for t in at] and dealt["part"].to_pylist() == [3 << 32] * 6
    events, codes = vocab.event[index].astype(np.int64), vocab.code[index]
    for softmax in (0, 1):
        ids, steps = lm_scoring.unpack(lm_scoring._learn(vocab, [batch.slice(3, 1)], [], softmax).to_pylist(), spare=1)
        used = [lm_scoring.Used(vocab, vocab.place[events], codes, offsets, softmax) for _ in range(2)]
        want = lm_scoring.log_probs(used[0].weights(ids, steps[:-1]), vocab, events, codes, offsets, used[0])
        used[1].point_to(ids, steps)
        assert len(ids) < len(used[0].ids) and np.allclose(lm_scoring.log_probs(steps, vocab, events, codes, offsets, used[1]), want, rtol=1e-5, atol=1e-5)


def test_training_in_parts_against_the_whole_table(spark, docs):
    """Two parts, two rounds: the weights are those of trainers that hold the whole table, averaged by tokens."""
    frame = docs.where("length(text) < 5000").select((F.pmod(F.xxhash64("text"), F.lit(2))).alias("part"), "doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("round"))
    frame = common.materialise(frame.repartition(1).sortWithinPartitions("part", "doc_id", "text"), "ordered")
    vocab = lm_scoring.fit_vocabulary(lm_scoring.count_words(frame))
    got = lm_scoring.train(frame.select("part", "doc_id", "text"), vocab)
    want, at = vocab.start_weights(), vocab.layout
    rows_ = frame.collect()
    for k in (0, 1):
        total, tokens = np.zeros(want.shape), np.zeros(len(want))
        for part in (0, 1):
            texts = [lm_tokens(r["text"]) for r in rows_ if (r["part"], r["round"]) == (part, k)]
            assert texts
            index = vocab.find(np.concatenate(texts))
            trainer = lm_scoring.Trainer(want)
            trainer.learn(vocab, vocab.left_out[index].astype(np.int64), vocab.code[index], np.cumsum([0, *map(len, texts)]))
            total += trainer.w * trainer.touched[:, None]
            tokens += trainer.touched
        new = np.flatnonzero(tokens)
        want[new] = np.rint(total[new] / tokens[new, None] / lm_scoring.STEP) * lm_scoring.STEP
    touched = np.flatnonzero(np.abs(want - vocab.start_weights()).max(axis=1))
    assert len(touched) > 1000 and max(np.abs(got[int(r)] - want[r]).max() for r in touched) <= 2 * lm_scoring.STEP
    assert set(got.rows) <= set(touched.tolist()) | set(range(at.bias, at.slot_bias + 32)) | {r for r, x in got.rows.items() if not x.any()}


def test_each_softmax_is_learned_alone():
    """The rows of one softmax at a time, with the weights that learning both at once gives; never both in a worker."""
    import pyarrow as pa

    texts = pa.record_batch({"text": pa.array(["a b c a b d", "b c a d e f a b", None, "c c c a"] * 40)})
    words_, counts = np.unique(np.concatenate([lm_tokens(t) for t in texts.column("text").to_pylist()]), return_counts=True)
    vocab = lm_scoring.Vocabulary(words_, counts, {"tokens": int(counts.sum()), "types": len(words_), "threshold": 1, "outside_tokens": 0, "unseen": 0.0})
    both = lm_scoring.unpack(lm_scoring._learn(vocab, [texts], []).to_pylist())
    apart = [lm_scoring.unpack(lm_scoring._learn(vocab, [texts], [], k).to_pylist()) for k in (0, 1)]
    assert apart[0][0].max() < vocab.layout.bias < apart[1][0].min() and both[1].any()
    assert all(np.array_equal(np.concatenate([a[k] for a in apart]), both[k]) for k in (0, 1))


def test_a_later_round_stands_for_the_rounds_before(spark):
    """A round adds its rows to the table, which is not written again; its shuffles are gone as soon as it is written."""
    import pyarrow as pa

    old, new = np.array([3, 8, 900_000]), np.array([8, 11])
    records = [lm_scoring.pack(ids, None, np.full((len(ids), 32), x, np.float32)).to_pylist() for ids, x in ((old, 1), (new, 2))]
    for r in records[1]:
        r["part"] = -1
    files = lambda: sum(".data" in str(f) for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()))
    before, kept, weights = files(), spark.conf.get(common.CLEANUP, None), None
    for r in records:
        frame = spark.createDataFrame([tuple(x.values()) for x in r], lm_scoring.SHARD).repartition(3, "ids")
        with common.dropping_shuffles(spark):
            weights = common.materialise_by(frame, "shard", "lm_weights_test", into=weights)
    assert (files(), spark.conf.get(common.CLEANUP, None)) == (before, kept)
    rows_ = [r.asDict() for r in weights.collect()]
    for given in (rows_, rows_[::-1]):
        ids, steps = lm_scoring.unpack(given)
        assert dict(zip(ids.tolist(), (steps[:, 0] / 64).tolist())) == {3: 1, 8: 2, 11: 2, 900_000: 1}
    asked = pa.Table.from_batches([lm_scoring.pack(np.array([8]), part=4)])
    got = lm_scoring._answer_from(asked, pa.Table.from_pylist([r for r in rows_ if r["shard"] == 0], asked.schema)).to_pylist()
    assert [(r["part"], x.tolist()) for r in got for x in lm_scoring.unpack([r])] == [(4, [8]), (4, [[128] * 32])]
    common.discard(weights)


def lm_tokens(text):
    import pyarrow as pa

    raw, offsets = common.binary_column(pa.array([text or ""]))
    starts, ends, _ = common.word_spans(raw, offsets)
    return np.append(common.word_hashes(raw, starts, ends, lower=True), lm_scoring.END_HASH)


def test_gradient_steps_lower_the_loss():
    rng = np.random.default_rng(3)
    words_ = np.unique(rng.integers(1, 2**63, 50).astype(np.uint64))
    counts = np.full(len(words_), 100)
    vocab = lm_scoring.Vocabulary(words_, counts, {"tokens": int(counts.sum()), "types": len(words_), "threshold": 1, "outside_tokens": 0, "unseen": 0.0})
    labels = np.tile(np.arange(40), 300)
    offsets = np.array([0, len(labels)])
    trainer = lm_scoring.Trainer(vocab.start_weights())
    codes = vocab.code[labels]
    before = lm_scoring.log_probs(trainer.w, vocab, labels, codes, offsets).mean()
    trainer.learn(vocab, labels, codes, offsets)
    trainer.learn(vocab, labels, codes, offsets)
    assert lm_scoring.log_probs(trainer.w, vocab, labels, codes, offsets).mean() > before + 1


# --------------------------------------------------------------------------- 8: packing

def test_packing(docs, rows, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for r in rows:
        want[r[0], tuple([*t.encode(r[1] or "", add_special_tokens=False).ids, 1])] += 1
    got = packing.pack(docs).collect()
    seqs, parts = defaultdict(list), defaultdict(list)
    for g in got:
        ids = np.frombuffer(bytes(g["ids"]), "<u4")
        assert len(ids) == g["length"] and zlib.crc32(bytes(g["ids"])) == g["ids_crc32"]
        seqs[g["sequence_id"]].append((g["offset"], g["length"]))
        parts[g["doc_id"], g["doc_tokens"]].append((g["start"], tuple(ids)))
    for s, pieces in seqs.items():
        at = 0
        for off, n in sorted(pieces):
            assert off == at
            at += n
        assert at == 2048 or s == max(seqs)
    for (doc, n), c in Counter((k[0], len(k[1])) for k, m in want.items() for _ in range(m)).items():
        assert sum(len(p) for _, p in parts[doc, n]) == n * c
    once = {k: v for k, v in want.items() if v == 1 and sum(1 for q in want if q[0] == k[0] and len(q[1]) == len(k[1])) == 1}
    for doc, ids in once:
        assert tuple(x for _, p in sorted(parts[doc, len(ids)]) for x in p) == ids
    assert packing.pack(none).count() == 0


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    texts = ["", "  ", "<|endoftext|> a<|endoftext|>b <|ENDOFTEXT|>", "ÀÉ é é ΟΔΟΣ İstanbul it's I'LL don't 12² ½x ﬁ", "x\x1cy \x01 a\x01b", "你好 世界 🎉🎉ok", "z" * 3000]
    pick = np.random.default_rng(7)
    odd = [*"aeZA'stre09 \n.,;:!?*#$&()[]{}<|>^`~_-+=/\\\"@%\x01éÉß×÷ÿñΣσІ中…«’\u0338\u0301½Ⅷ\xa0", "'s", "'ll", "word"]
    texts += ["".join(pick.choice(odd, n)) for n in pick.integers(0, 60, 3000)] + [a + b + c for a in odd for b in odd for c in ("Σ", "s", "\u0338")]
    got = packing.WordEncoder(packing.tokenizer_path()).encode([x.encode() for x in texts])
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_hilbert_curve_visits_neighbours():
    bits = 3
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = packing.hilbert_keys(grid, bits)
    assert sorted(keys.tolist()) == list(range(512))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


# --------------------------------------------------------------------------- 9: URL filters

def host_by_hand(url):
    """The host without the pattern of the operator."""
    scheme, mark, rest = (url or "").partition("://")
    if not mark or not scheme[:1].isalpha() or not scheme.isascii() or not all(c.isalnum() or c in "+.-" for c in scheme):
        return None
    for end in "/?#":
        rest = rest.partition(end)[0]
    name = rest.rpartition("@")[2]
    if name.startswith("["):
        inside, mark, after = name[1:].partition("]")
        name = f"[{inside}]" if mark and inside and "[" not in inside and after[:1] in ("", ":") else ""
    else:
        name = name.partition(":")[0]
        name = "" if "[" in name or "]" in name else name
    return name.lower().rstrip(".") or None


def brute_filter(captures, events):
    import datetime as dt

    per = defaultdict(dict)
    for scope, value, action, day in events:
        if None in (scope, value, action, day) or action not in ("add", "remove"):
            continue
        key = f"{scope}:{value.lower()}"
        per[key][day] = max(action, per[key].get(day, ""))
    out = []
    for page, url, day in captures:
        import re

        host, keys = host_by_hand(url), set()
        if host:
            labels = [host] if host[0] == "[" or re.fullmatch(r"[0-9]+(\.[0-9]+){3}", host) else host.split(".")
            keys = {f"host:{host}", *(f"domain:{'.'.join(labels[i:])}" for i in range(len(labels)))}
            seg = re.match(url_filters.SEGMENT_PATTERN, url)
            if seg:
                keys.add(f"prefix:{host}/{seg[1]}")
        met = []
        for k in keys:
            past = [d for d in per.get(k, {}) if day is not None and d <= day]
            if past and per[k][max(past)] == "add":
                met.append(k)
        assert day is None or isinstance(day, dt.date)
        out.append((page, host, len(met), min(met, default=None), not met))
    return Counter(out)


def test_url_filters(spark):
    import datetime as dt

    rng = random.Random(9)
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    hosts = ["a.com", "x.a.com", "b.org", "deep.x.a.com", "c.net"]
    captures = [(i, rng.choice([f"http://{rng.choice(hosts)}/p{rng.randrange(3)}/q", f"HTTPS://u:p@{rng.choice(hosts).upper()}:80", "no url", "", None, f"http://{rng.choice(hosts)}./"]), rng.choice([day(rng.randrange(400)), None]) if rng.random() < 0.1 else day(rng.randrange(400))) for i in range(300)]
    captures += captures[:3]
    events = [(rng.choice(["host", "domain", "prefix"]), rng.choice([*hosts, "com", "a.com/p1", "b.org/p0"]), rng.choice(["add", "remove"]), day(rng.randrange(400))) for _ in range(150)]
    events += [(None, "a.com", "add", day(3)), ("host", None, "add", day(3)), ("host", "a.com", None, day(3)), ("host", "a.com", "add", None), ("host", "c.net", "odd", day(1))]
    odd = ["http://[::1]/a", "http://[2001:db8::2]:80/b", "http://u@x@b.org/p0/q", "http://u@/x", "http://[::1", "http://[a@b]/", "http://a[b.com/", "http://10.0.0.1:8/q", "http://[]/", "http://a.com", "http://a.com?x", "http://" + "l" * 100_000 + ".com/p"]
    for u, want in zip(odd, ["[::1]", "[2001:db8::2]", "b.org", None, None, None, None, "10.0.0.1", None, "a.com", "a.com", "l" * 100_000 + ".com"]):
        assert host_by_hand(u) == want
    captures += [(1000 + i, u, day(200)) for i, u in enumerate(odd)]
    cap = spark.createDataFrame(captures, "page_id long, url string, fetch_date date")
    ev = spark.createDataFrame(events, "scope string, value string, action string, on_date date")
    got = Counter((r["page_id"], r["host"], r["n_entries"], r["first_entry"], r["allowed"]) for r in url_filters.filter_captures(cap, ev).collect())
    assert got == brute_filter(captures, events)
    assert all(r["allowed"] for r in url_filters.filter_captures(cap, ev.where("false")).collect())
    assert url_filters.filter_captures(cap.where("false"), ev).count() == 0


# --------------------------------------------------------------------------- 10: WARC

def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "x" * 200 + "é</p>"
    pages = [(5, "http://a/ä b", big), (3, "http://b", big), (9, None, "short"), (4, "http://c\r\nX: y", "short"), (7, "http://d", None), (3, "http://b", big), (None, "http://e", big), (11, "http://f", "y" * 100_000), (12, "http://g", "z" * 99), (13, "http://g", "z" * 99)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string").repartition(2)
    folder = f"file://{tmp_path}/warc"
    manifest = warc.write_archives(df, folder, archive_bytes=1500)
    got = warc.read_archives(spark, manifest, folder, payloads=True).collect()
    want = Counter()
    for i, _, html in pages:
        data = (html or "").encode()
        first = 3 if html == big else i
        revisit = len(data) >= 100 and i != first
        want[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None] += 1
    assert Counter((g["page_id"], g["payload_bytes"], g["payload_digest"], g["record_type"], g["refers_to"]) for g in got) == want
    assert all(bytes(g["payload"]) == b"" or hashlib.sha256(bytes(g["payload"])).hexdigest() == g["payload_digest"] for g in got if g["record_type"] == "response")
    assert manifest.count() > 2 and sum(r["records"] for r in manifest.collect()) == len(pages)
    none = warc.write_archives(df.where("false"), f"file://{tmp_path}/none")
    assert warc.read_archives(spark, none, f"file://{tmp_path}/none").count() == 0
    archive = next((tmp_path / "warc").glob("*.warc.gz")).read_bytes()
    assert gzip.decompress(archive).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def one_record(payload=b"hello" * 50):
    return warc.page_record(1, "http://a", payload, hashlib.sha256(payload).hexdigest(), None)


@pytest.mark.parametrize("broken", ["cut", "digest", "length", "gzip", "header"])
def test_broken_archives(broken):
    good = one_record()
    plain = gzip.decompress(good)
    data = {"cut": good[:-20], "digest": gzip.compress(plain.replace(b"hello", b"jello", 1)), "length": gzip.compress(plain.replace(b"Content-Length: 325", b"Content-Length: 320").replace(b"\r\n\r\n\r\n\r\n", b"")[:-9]), "gzip": b"junk" + good, "header": gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n")}[broken]
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(good + data)))
    assert [r["payload_bytes"] for r in warc.read_records(io.BytesIO(good + good))] == [250, 250]


def test_broken_archive_ends_with_an_error_row(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(one_record() + b"junk")
    manifest = spark.createDataFrame([("a.warc.gz",)], "archive string")
    got = warc.read_archives(spark, manifest, f"file://{tmp_path}", strict=False).collect()
    assert [g["error"] is None for g in got] == [True, False]


# --------------------------------------------------------------------------- pipeline

def smallest_of(groups):
    """Of each group of rows the one with the smallest id, nulls last."""
    return Counter(min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups)


def near_groups(rows):
    """Classes of rows by brute force over all pairs of texts that share a shingle."""
    texts = defaultdict(list)
    for r in rows:
        texts[tuple(words(r[1]))].append(r)
    keys = list(texts)
    seqs = [brute_sequence(" ".join(w.decode() for w in k)) for k in keys]
    sets, links = [set(s) for s in seqs], []
    for i in range(len(keys)):
        for j in range(i):
            # the union holds at least the longer one, the matches are shared shingles
            if len(sets[i] & sets[j]) >= 0.8 * max(len(sets[i]), len(sets[j]), 1) and brute_similarity(seqs[i], seqs[j]) >= 0.8:
                links.append((i, j))
    return [[r for i in c for r in texts[keys[i]]] for c in joined(len(keys), links)]


def test_pipeline(spark, docs, rows, tmp_path):
    """Every stage of the chain against brute force on its own input, with the clashing columns carried along."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    at = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    inputs, outputs = {}, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, f"file://{tmp_path}")
        if name != "packing":
            assert out.columns == docs.columns
        inputs[name], at = at, common.materialise(out, name)
        outputs[name] = [tuple(r) for r in at.collect()]
    given = {name: [tuple(r) for r in df.collect()] for name, df in inputs.items()}
    assert Counter(given["language_id"]) == Counter(rows)
    assert Counter(outputs["language_id"]) == Counter(r for r in rows if any(c.isalpha() for c in r[1] or ""))
    equal = defaultdict(list)
    for r in given["exact_dedup"]:
        equal[norm(r[1])].append(r)
    assert Counter(r[0] for r in outputs["exact_dedup"]) == Counter(r[0] for r in smallest_of(equal.values()))
    assert Counter(outputs["near_dedup"]) == smallest_of(near_groups(given["near_dedup"]))
    size, taken, most = Counter(), Counter(), Counter()
    for r in given["mixing"]:
        size[r[3]] += len(words(r[1]))
        most[r[3]] = max(most[r[3]], len(words(r[1])))
    for r, n in Counter(outputs["mixing"]).items():
        assert r in given["mixing"] and n <= 3 * given["mixing"].count(r)
        taken[r[3]] += n * len(words(r[1]))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    for s, target in zip(names, water_fill([size[n] for n in names])):
        assert abs(taken[s] - target) <= most[s] / 2 + 1
    t = Tokenizer.from_file(packing.tokenizer_path())
    tokens = Counter()
    for r in given["packing"]:
        tokens[r[0]] += len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1
    pieces = at.select("doc_id", "length", "sequence_id").collect()
    packed, full = Counter(), Counter()
    for p in pieces:
        packed[p["doc_id"]] += p["length"]
        full[p["sequence_id"]] += p["length"]
    assert packed == tokens and all(n == 2048 for s, n in full.items() if s != max(full))
    run = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert run.columns == at.columns and Counter(map(tuple, run.collect())) == Counter(outputs["packing"])


def test_pipeline_of_an_empty_table(spark, none, tmp_path):
    import corpus_pipeline

    none.write.parquet(f"file://{tmp_path}/documents.parquet")
    at = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        at = common.materialise(stage(spark, at, f"file://{tmp_path}"), name)
        assert at.count() == 0
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_entry_without_the_subpackage(tmp_path):
    """The registry works where these folders are deleted."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parents[2]
    shutil.copytree(top / "verisift", tmp_path / "verisift", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    shutil.copy(top / "corpus_pipeline.py", tmp_path)
    code ="import __spark_entry__ as e; q = e.queries(); assert 'find_duplicates' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
