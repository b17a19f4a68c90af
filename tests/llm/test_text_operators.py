"""Line dedup, decontamination, sharding, token counts, pieces: against brute force and on odd input."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pixelloom.llm import decontamination, line_dedup, pieces, sharding, token_counts
from pixelloom.plans.storage import new_path

vocabularies = pytest.importorskip("public_tokenizers")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_lines(rows):
    held, keyed = defaultdict(set), []
    for i, text in rows:
        lines = (text or "").split("\n")
        keys = [fold(line.strip(" \t\n\x0b\f\r")) for line in lines]
        keyed.append((i, lines, keys))
        for k in keys:
            if len(k) >= 20:
                held[k].add(-1 if i is None else i)
    lost = {k: max(v) for k, v in held.items() if len(v) >= 3}
    out = []
    for i, lines, keys in keyed:
        kept = [line for line, k in zip(lines, keys, strict=True) if k not in lost or lost[k] == (-1 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_line_dedup_matches_brute_force(odd_docs, docs_of):
    shared = "This line is shared by MANY documents"
    texts = [f"{shared}\nown line number {i} of this text\n  {shared.upper()}\t\n" + "\n".join(f"filler {i} {j} {'z' * 20}" for j in range(130)) + f"\n{shared}" for i in range(5)]
    for docs in (odd_docs, docs_of(texts)):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        found = line_dedup.dedup_lines(docs)
        got = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in found.collect()]
        assert sorted(got, key=repr) == brute_lines(rows)
        assert set(docs.columns) - {"row_key"} <= set(found.columns)


def test_first_occurrences_are_streamed_from_sorted_ranges(spark):
    rows = [(h, h, d, pos) for h in range(5) for d in [None, *range(40)] for pos in range(h + d % 3 if d else 1)]
    random.Random(1).shuffle(rows)
    occurrences = spark.createDataFrame(rows, "h1 long, h2 long, doc_id long, pos int").repartition(5)
    found = line_dedup.first_occurrences(occurrences)
    plan = found.groupBy("h1", "h2").count()._jdf.queryExecution().executedPlan().toString()
    ranges = plan.index("rangepartitioning")
    sort, window = plan.index("Sort [h1"), plan.index("Window")
    assert window < sort < ranges and plan[:ranges].count("hashpartitioning") == 1  # that of the counts alone
    assert sorted(map(repr, found.collect())) == sorted(repr(Row(h1=h, h2=g, doc_id=d, pos=pos)) for h, g, d, pos in rows if pos == 0)


def test_bitmaps_of_long_texts(docs_of):
    """A text of 50,000 lines of which the 1st, the 30,001st and the last but one go."""
    shared = [f"a line that is shared, number {k}" for k in range(3)]
    long = [f"own {i}" for i in range(50_000)]
    long[0], long[30_000], long[49_998] = shared
    docs = docs_of(["\n".join(long), *["\n".join(shared)] * 3])
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[0].n_dropped == 3 and got[0].kept_text == "\n".join(x for x in long if x not in shared)
    assert [got[i].n_dropped for i in (1, 2, 3)] == [3, 3, 0]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text or ""))


def brute_hits(text, items):
    words, hit, found = words_of(text), set(), set()
    for item, t in items:
        w = words_of(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            for at in range(len(words) - n + 1):
                if words[at : at + n] == w[s : s + n]:
                    hit.update(range(at, at + n))
                    found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found)


def test_decontamination_matches_brute_force(spark, odd_docs, docs_of):
    passage = "Alpha beta-gamma, delta epsilon zeta eta theta iota kappa lambda mu nu É xi"
    items = [(1, passage), (2, "short Passage!"), (3, ""), (4, None), (None, "one"), (10, passage), (5, "É É")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = [f"lead {passage.upper()} tail", passage[:60], "a short   passage again short passage", passage + " " + passage, "é é É É", "alpha beta", "delta epsilon zeta eta theta iota kappa lambda mu nu É xi"]
    for docs in (docs_of(texts), odd_docs):
        got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontamination.decontaminate(docs, benchmark).collect()), key=repr)
        want = sorted(((r.doc_id, *brute_hits(r.text, items)) for r in docs.collect()), key=repr)
        assert got == want
    docs = docs_of(texts)
    clean = {r.doc_id for r in decontamination.decontaminate(docs, benchmark, "documents").collect()}
    assert clean == {r.doc_id for r in docs.collect() if not brute_hits(r.text, items)[1]}
    cut = {r.doc_id: r.text for r in decontamination.decontaminate(docs, benchmark, "spans").collect()}
    assert cut[0] == "lead tail" and cut[5] == "alpha beta"
    with pytest.raises(ValueError):
        decontamination.decontaminate(docs, benchmark, "other")


def test_decontamination_in_blocks(spark, docs_of, monkeypatch):
    benchmark = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(14))) for i in range(9)], "item_id long, text string")
    docs = docs_of([" ".join(f"w{i}x{j}" for j in range(i, 14)) for i in range(9)])
    whole = sorted(map(repr, decontamination.decontaminate(docs, benchmark).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", 20)
    assert sorted(map(repr, decontamination.decontaminate(docs, benchmark).collect())) == whole


def one_by_one(sizes, shards):
    """Every group alone through the heap: the shard of each (size, rank), and the loads."""
    heap, placed = [(0, s) for s in range(shards)], {}
    for size, n in sorted(sizes, reverse=True):
        for rank in range(n):
            load, shard = heapq.heappop(heap)
            placed[size, rank] = shard
            heapq.heappush(heap, (load + size, shard))
    return placed, sorted(s for s, _ in heap)


def test_schedule_equals_one_by_one():
    rng = random.Random(4)
    cases = [([(5, 1), (4, 1), (3, 3)], 2), ([(1000, 1), (7, 900), (3, 1)], 4), ([(17, 10_000)], 40), ([(100, 3), (99, 3), (1, 500)], 40), ([(3, 2)], 5), ([(6, 1), (3, 8)], 2)]
    cases += [([(s, rng.randint(1, 60)) for s in rng.sample(range(1, 400), rng.randint(1, 25))], rng.randint(1, 9)) for _ in range(200)]
    for sizes, shards in cases:
        want, loads = one_by_one(sizes, shards)
        got, plan = {}, sharding.schedule(sizes, shards)
        for size, n in sizes:
            mine = [(first, members) for s, first, members in plan if s == size]
            for rank in range(n):
                first, members = [p for p in mine if p[0] <= rank][-1]
                got[size, rank] = members[(rank - first) % len(members)]
        assert got == want


def test_sharding_equals_the_schedule_of_all_groups(spark, docs_of):
    """The whole assignment against a heap over all groups, on the smallest test table and on many small groups."""
    small = docs_of([f"{'x' * (i % 7)}{i}" for i in range(10_000)])
    for docs, shards in ((spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"), 40), (small.select("doc_id", "text"), 7)):
        size, members = Counter(), defaultdict(list)
        for r in docs.collect():
            digest = hashlib.sha256((r.text or "").encode()).digest() if r.text is not None else hashlib.sha224(b"null").digest()
            size[digest] += len((r.text or "").encode()) + 16
            members[digest].append(r.doc_id)
        heap, want = [(0, s) for s in range(shards)], {}
        for digest in sorted(size, key=lambda d: (-size[d], d)):
            load, shard = heapq.heappop(heap)
            want |= dict.fromkeys(members[digest], shard)
            heapq.heappush(heap, (load + size[digest], shard))
        assert {r.doc_id: r.shard for r in sharding.shard_documents(docs, shards).collect()} == want


def test_slots_are_stable(docs_of):
    """Equal doc_ids in a shard get their slots by text, whatever the partitions."""
    docs = docs_of([f"t{i % 90}" for i in range(300)]).withColumn("doc_id", F.col("doc_id") % 50)
    rows = [sorted((r.doc_id, r.text_crc32, r.shard, r.slot) for r in sharding.shard_documents(docs.repartition(n), 3).collect()) for n in (1, 5)]
    assert rows[0] == rows[1]


def test_sharding_laws(odd_docs, docs_of):
    for docs in (odd_docs, docs_of([f"text {i % 40} " * (i % 17 + 1) for i in range(400)])):
        rows = sharding.shard_documents(docs, 4).collect()
        source = docs.select("doc_id", "text").collect()
        assert sorted(repr((r.doc_id, r.size, r.text_crc32)) for r in rows) == sorted(
            repr((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode()))) for r in source
        )
        for shard in {r.shard for r in rows}:
            assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
        by_text = defaultdict(set)
        text_of = defaultdict(set)
        for r in source:
            text_of[r.doc_id].add(r.text)
        for r in rows:
            if len(text_of[r.doc_id]) == 1:
                by_text[next(iter(text_of[r.doc_id]))].add(r.shard)
        assert all(len(v) == 1 for v in by_text.values())
    loads = [sum(r.size for r in rows if r.shard == s) for s in range(4)]
    assert max(loads) - min(loads) <= max(r.size for r in rows) * 10


def test_slots_without_gaps_over_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_SLOT_BLOCK", 10)
    rows = sharding.shard_documents(docs_of([f"t{i}" for i in range(300)]), 3).collect()
    for shard in range(3):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


def test_token_counts_and_cache(spark, odd_docs, odd_texts):
    import tokenizers

    path = vocabularies.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    cache = new_path(spark, "cache")
    args = (path, cache, vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN)
    for _ in range(2):
        got = token_counts.count_tokens(odd_docs, *args).collect()
        assert sorted(repr((r.text, r.n_bytes, r.n_tokens)) for r in got) == sorted(
            repr((r.text, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids))) for r in odd_docs.collect()
        )
        assert spark.read.parquet(cache).count() == len({t or "" for t in odd_texts} | {"other text of id five"})


def test_counter_agrees_with_the_libraries():
    import tokenizers

    path = vocabularies.path("byte_bpe_50k.json")
    texts = ["<|endoftext|> a", "tab\tnew\n\n  line ", "ſ ǅ ŉ", "١٢٣ १२", "a" * 2000, " " * 900, "it's we'LL", "😀", "¼ ² ª", "x\u0085y\xa0z"]
    library = tokenizers.Tokenizer.from_file(path)
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert token_counts.Counter(path, vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN).count(texts) == want
    assert token_counts.Counter(path, None, None).count([*texts, None]) == [*want, 0]


def test_pieces_match_the_library(odd_docs, odd_texts):
    import sentencepiece

    path = vocabularies.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    more = ["▁ ▁▁a", "<s> <unk> <0x41>", "\x00\x01", "ab" * 300, " " * 300, "😀👍🏽", "Ａﬁ"]
    vocab = pieces.vocabulary(path)
    ids, offsets = pieces.encode_texts([*odd_texts, *more], vocab)
    for text, a, b in zip([*odd_texts, *more], offsets[:-1], offsets[1:], strict=True):
        assert ids[a:b].tolist() == library.encode(text or "")
        assert pieces.decode_ids(ids[a:b].tolist(), vocab) == library.decode(ids[a:b].tolist())
    encoded = pieces.encode_documents(odd_docs, path)
    decoded = pieces.decode_documents(encoded, path)
    assert sorted(r.text for r in decoded.select("text").collect()) == sorted(r.text or "" for r in odd_docs.collect())
    assert {r.round_trip for r in pieces.piece_digests(odd_docs, path).collect()} == {True}


def test_no_documents(spark, no_docs):
    benchmark = spark.createDataFrame([(1, "some words of it")], "item_id long, text string")
    model = vocabularies.path("piece_bpe_32k.model")
    assert line_dedup.dedup_lines(no_docs).count() == 0
    for mode in ("mark", "documents", "spans"):
        assert decontamination.decontaminate(no_docs, benchmark, mode).count() == 0
    assert sharding.shard_documents(no_docs).count() == 0
    assert token_counts.count_tokens(no_docs, vocabularies.path("byte_bpe_50k.json"), new_path(spark, "cache")).count() == 0
    assert pieces.encode_documents(no_docs, model).count() == 0
    assert pieces.piece_digests(no_docs, model).count() == 0


def test_no_benchmark(spark, odd_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(odd_docs, none).where("contaminated").count() == 0
