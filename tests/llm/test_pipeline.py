"""Stages of the pipeline against brute force."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skillgrid.llm import similar, simhash

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def near_dedup(spark, rows):
    """(doc_id, text) of the rows that the stage keeps."""
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], SCHEMA)
    return sorted(((r.doc_id, r.text) for r in STAGES["near_dedup"](spark, docs, "").collect()), key=str)


def brute_force(rows):
    """One row, that of the smallest id, of each component of texts that share 0.8 of their shingles of five words or more."""
    sets = []
    for _, t in rows:
        w = t.lower().split()
        sets.append({tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))})
    of = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            of[x].append(k)
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, s in enumerate(sets):
        for j in {j for x in s for j in of[x] if j < k}:
            both = len(s & sets[j])
            if both / (len(s) + len(sets[j]) - both) >= 0.8:
                a, b = sorted((find(k), find(j)))
                root[b] = a
    return sorted((rows[k] for k in range(len(rows)) if find(k) == k), key=str)


def altered(rng, words, name, share):
    """``words`` with a stretch replaced such that about ``share`` of all shingles of both are common."""
    n = len(words) - 4
    lost = max(1, round(n * (1 - share) / (1 + share)) - 4)
    at = int(rng.integers(4, len(words) - lost - 4))
    return [*words[:at], *[f"{name}x{k}" for k in range(lost)], *words[at + lost :]]


@pytest.mark.parametrize("share", [0.72, 0.78, 0.805, 0.83])
def test_near_dedup_at_a_similarity(spark, share):
    rng = np.random.default_rng(int(share * 1000))
    rows = []
    for k in range(150):
        words = [f"{k}w{j}" for j in range(int(rng.integers(80, 900)))]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(altered(rng, words, f"{k}y", share)))]
    assert near_dedup(spark, rows) == brute_force(rows)


def test_near_dedup_of_chains(spark):
    """Copies of copies: the ends of a chain aren't alike, its neighbours are."""
    rng = np.random.default_rng(7)
    rows = []
    for k in range(25):
        words = [f"{k}w{j}" for j in range(300)]
        for step in range(8):
            rows.append((len(rows), " ".join(words)))
            words = altered(rng, words, f"{k}s{step}", 0.86)
    assert near_dedup(spark, rows) == brute_force(rows)


@pytest.mark.parametrize("keep", [similar.keep_first, simhash.keep_first])
def test_columns_named_like_inner_ones(spark, keep):
    """Every name that near-dedup uses inside may be a column of the table."""
    names = ("near_id", "near_hash", "dropped_hash", "doc", "component", "first", "text_hash", "size", "keys", "node", "band", "key", "n", "src", "dst", "marks", "hashes", "a", "b", "low", "high", "fps", "nameless")
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text), (2, text), (3, text + " more and other words that it has alone")], "doc_id long, text string").withColumns({n: F.col("doc_id") for n in names})
    kept = keep(docs)
    assert kept.columns == docs.columns and sorted(tuple(r)[::2][:1] for r in kept.collect()) == [(1,), (3,)]


@pytest.mark.parametrize("keep", [similar.keep_first, simhash.keep_first])
def test_null_and_shared_ids(spark, keep):
    """A document is its id and text: neither a null id nor one that two texts share takes other texts with it."""
    text = [" ".join(f"{k}w{j}" for j in range(60)) for k in range(6)]
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (4, text[1]), (5, text[2]), (5, text[3]), (1, text[3]), (6, text[2]), (7, text[4]), (7, text[4]), (None, None), (9, text[5]), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = keep(docs).collect()
    assert collections.Counter(r.text for r in got) == collections.Counter([*text, None])
    assert {(r.doc_id, r.text) for r in got} == {(None, text[0]), (None, text[1]), (5, text[2]), (1, text[3]), (7, text[4]), (9, text[5]), (None, None)}


def test_language_margins(spark):
    """Random letters are rejected by their narrow margin; short clean texts, which zstandard alone stores as they are, stay."""
    rng = np.random.default_rng(3)
    clean = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    words = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(2, 10)))) for _ in range(n))
    long = [r for r in clean.where("length(text) > 400").orderBy("doc_id").limit(200).collect()]
    short = [(2_000_000 + k, " ".join(r.text.split()[20:24]), r.lang, "s", 0) for k, r in enumerate(long)]
    gibberish = [(1_000_000 + k, words(int(rng.integers(80, 600))), None, "g", 0) for k in range(200)]
    docs = clean.unionAll(spark.createDataFrame(short + gibberish, SCHEMA))
    kept = collections.Counter(r.source if r.source in ("s", "g") else "clean" for r in STAGES["language"](spark, docs, "").collect())
    assert kept["g"] <= 2
    assert kept["s"] >= 185
    assert kept["clean"] >= 0.98 * clean.count()


def test_near_dedup_goes_through_simhash(spark, monkeypatch):
    """With no key of minima in common, near copies whose fingerprints differ in three bits or fewer are still found; what is as near and less alike than 0.8 isn't."""
    whole = similar.signatures
    monkeypatch.setattr(similar, "signatures", lambda *a: whole(*a).withColumn("keys", F.transform("keys", lambda k, i: F.xxhash64("text_hash", i))))
    rng = np.random.default_rng(11)
    rows = []
    for k in range(60):
        words = [f"{k}w{j}" for j in range(int(rng.integers(300, 3000)))]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:-1], f"{k}last"]))]
    rows += [(200, "a a a a a"), (201, "a " * 10 + "b")]  # 6 of 7 shingles are one, so the fingerprints are equal
    prints = [simhash.fingerprint(t, 5)[0] for _, t in rows]
    assert prints[120] == prints[121]
    near = [k for k in range(0, 120, 2) if ((prints[k] ^ prints[k + 1]) & 2**64 - 1).bit_count() <= 3]
    kept = {i for i, _ in near_dedup(spark, rows)}
    assert len(near) > 30 and {*range(0, 120, 2), 200, 201} <= kept and kept & {*range(1, 120, 2)} == {k + 1 for k in range(0, 120, 2)} - {k + 1 for k in near}
