from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pixelloom.llm import copies, simhash
from pixelloom.plans.storage import write_shared


def planted(seed=3):
    """Texts with copies in which one to five words of 80 to 160 are exchanged, clean ones, odd ones and a group that crosses blocks."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for _ in range(40):
        base = [word() for _ in range(rng.randint(80, 160))]
        texts.append(" ".join(base))
        for changes in (1, 2, 3, 5):
            changed = list(base)
            for at in rng.sample(range(len(base)), changes):
                changed[at] = word()
            texts.append(" ".join(changed))
    texts += [" ".join(word() for _ in range(100)) for _ in range(60)] + [None, "", "one two", "ONE two", "one two three", " ".join(["same"] * 900)]
    rng.shuffle(texts)
    return texts


def brute(texts):
    def five(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets, root = [five(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    n = 0
    for i, j in combinations(range(len(texts)), 2):
        union = len(sets[i] | sets[j])
        if not union or 5 * len(sets[i] & sets[j]) >= 4 * union:
            a, b = sorted((find(i), find(j)))
            root[b], n = a, n + 1
    return [find(i) for i in range(len(texts))], n


def test_pipeline_stage_takes_planted_near_copies(spark, docs_of, monkeypatch):
    texts = planted()
    expected, n = brute(texts)
    assert n > 100
    docs = docs_of(texts)
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect())
    assert got == sorted(set(expected))
    monkeypatch.setattr(copies, "BLOCK_TEXTS", 2)
    monkeypatch.setattr(copies, "COLUMNS", 64)
    assert {r.doc_id: r.component_id for r in copies.near_copies(docs).collect()} == dict(enumerate(expected))


def test_keep_first_copy_of_odd_documents(odd_docs, no_docs):
    kept = copies.keep_first_copy(odd_docs)
    assert kept.columns == [c for c in odd_docs.columns if c != "row_key"]
    found = copies.near_copies(odd_docs.select("doc_id", "text")).collect()
    assert len(found) == odd_docs.count()
    assert {r.doc_id for r in kept.collect()} == {r.component_id for r in found}
    assert copies.keep_first_copy(no_docs).count() == 0


def test_rows_of_a_hot_band_are_dealt_in_parts(spark):
    rows = spark.range(3000).selectExpr("if(id < 2000, 0, id % 50) AS key", "id AS node")
    facts = spark.range(40).selectExpr("id AS key", "id * 7 AS fact")
    got = copies.with_facts(rows, facts, ["key"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(facts, "key").collect()))
    assert got.columns == ["key", "node", "fact"]


def test_rows_are_told_apart_by_id_and_hash(spark, docs_of, monkeypatch):
    """Different rows whose hashes are equal stay different rows."""
    collide = lambda: F.lit(7).cast("long")
    monkeypatch.setattr(simhash, "row_key", collide)
    monkeypatch.setattr(copies, "row_key", collide)
    long = " ".join(f"w{i}" for i in range(90))
    texts = ["one text of its own", "another text of its own", long, long + " and a tail", "a fifth text of its own"]
    nameless = docs_of(["first of no id", "second of no id", "second of no id"]).withColumn("doc_id", F.lit(None).cast("long"))
    docs = docs_of(texts).unionByName(nameless)
    groups = {r.doc_id: r.component_id for r in copies.near_copies(docs_of(texts)).collect()}
    assert groups == {0: 0, 1: 1, 2: 2, 3: 2, 4: 4}
    alone = lambda rows: write_shared(rows.select("doc_id", collide().alias("row_key"), F.col("doc_id").alias("component_id")), "alone")  # noqa: E731  every row a group
    kept = simhash.firsts_of(docs, alone).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept))) == sorted(map(repr, [*enumerate(texts), (None, "first of no id"), (None, "second of no id")]))


def planted_pairs(n, seed=9):
    """Pairs of texts of 60 to 200 words whose similarity is spread over 0.8 to 0.95, with their exact similarity."""
    rng, texts, similar = random.Random(seed), [], []
    while len(similar) < n:
        base = [f"p{len(similar)}w{rng.randrange(10_000)}" for _ in range(rng.randint(60, 200))]
        changed = list(base)
        for at in rng.sample(range(len(base)), rng.randint(1, max(1, len(base) // 40))):
            changed[at] = f"q{rng.randrange(10_000)}"
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (base, changed))
        jaccard = len(a & b) / len(a | b)
        if 0.8 <= jaccard <= 0.95:
            texts += [" ".join(base), " ".join(changed)]
            similar.append(jaccard)
    return texts, similar


def test_recall_by_similarity(docs_of):
    texts, similar = planted_pairs(2000)
    found = {r.doc_id: r.component_id for r in copies.near_copies(docs_of(texts)).collect()}
    met = [found[2 * i + 1] == found[2 * i] == 2 * i for i in range(len(similar))]
    for low in (0.80, 0.85, 0.90):
        band = [m for m, s in zip(met, similar, strict=True) if low <= s < low + 0.05 + 1e-9]
        assert len(band) > 300 and sum(band) / len(band) >= 0.999
    assert len(set(found.values())) >= len(similar)  # no two pairs are joined


def test_simhash_proposes_and_similarity_decides(docs_of, monkeypatch):
    """Without any min-hash band the copies within two bits are found, and no text of the same fingerprint that isn't similar."""
    monkeypatch.setattr(copies, "bands", lambda hashes: hashes[:0].view("int64"))
    rng = random.Random(8)
    base = [f"w{rng.randrange(10_000)}" for _ in range(4000)]
    texts = [" ".join(base), " ".join([*base, "more"]), "same " * 900 + "a b c", "same " * 900 + "d e f", None, " ".join(base[:100])]
    bits = lambda i, j: (simhash.fingerprint(texts[i].encode(), 5) ^ simhash.fingerprint(texts[j].encode(), 5)).bit_count()
    assert bits(0, 1) <= 2 and bits(2, 3) <= 2
    assert {r.doc_id: r.component_id for r in copies.near_copies(docs_of(texts)).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5}


@pytest.mark.parametrize("sample", [8192, 40])
def test_pairs_that_no_band_proposes_are_found(docs_of, monkeypatch, sample):
    """Without min-hash bands, and with SimHash alone, all groups are still those of all pairs; whatever hashes are taken for common."""
    monkeypatch.setattr(copies, "bands", lambda hashes: hashes[:0].view("int64"))
    monkeypatch.setattr(copies, "SAMPLE_TEXTS", sample)
    monkeypatch.setattr(copies, "COMMON", 2)
    texts = planted(5)
    expected, n = brute(texts)
    assert n > 100
    assert {r.doc_id: r.component_id for r in copies.near_copies(docs_of(texts)).collect()} == dict(enumerate(expected))


def test_texts_that_share_common_lines_only_are_not_asked(docs_of):
    """A line that many texts share makes no pairs: its hashes are the last ones of every text."""
    rng = random.Random(2)
    texts = [" ".join([*(f"w{rng.randrange(9000)}" for _ in range(60)), *"this one line of many words stands in each and every text here".split()]) for _ in range(120)]
    docs = docs_of(texts)
    common = copies.common_hashes(docs, len(texts))
    assert len(common) == 9
    shared = copies.prefixes(docs, common).groupBy("key").count().where("count > 1").count()
    assert shared == 0 < copies.prefixes(docs, common[:0]).groupBy("key").count().where("count > 1").count()
