"""Cross-tokenizer alignment against plain loops, the minimal perfect hash, and several passes."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.llm import alignment

vocabularies = pytest.importorskip("public_tokenizers")
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def paths():
    return [vocabularies.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")] + [vocabularies.PATTERN]


def byte_of(letter):
    """The byte of a letter of the byte-level alphabet, by its published rule."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return ord(letter) if ord(letter) in shown else hidden[ord(letter) - 256]


def brute(texts, paths):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(paths[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    found, seen = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        bytes_a = [bytes(map(byte_of, a.id_to_token(i))) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        groups, left, right, at_a, at_b = [], [], [], 0, 0
        if text and b"".join(bytes_a) == b"".join(bytes_b) == whole:
            j = 0
            for i, piece in zip(ids_a, bytes_a, strict=True):
                left.append(i)
                at_a += len(piece)
                while j < len(ids_b) and at_b + len(bytes_b[j]) <= at_a:
                    at_b += len(bytes_b[j])
                    right.append(ids_b[j])
                    j += 1
                if at_a == at_b:
                    groups.append((left, right))
                    left, right = [], []
        found.append(groups)
        seen.update((x[-1], y[-1]) for x, y in groups)
    most = Counter()
    for (_, y), n in seen.items():
        most[y] = max(most[y], n)
    out = []
    for groups in found:
        links = [(x[-1], y[-1]) for x, y in groups]
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(seen[p] == most[p[1]] for p in links),
            sum(seen[p] for p in links), hashlib.sha256(written.encode()).hexdigest() if groups else "",
        ))
    return out


def compare(docs, paths):
    rows = docs.select("doc_id", "text").collect()
    want = [(r.doc_id, *x) for r, x in zip(rows, brute([r.text for r in rows], paths), strict=True)]
    found = alignment.align_documents(docs, *paths)
    assert set(found.columns) == (set(docs.columns) - {"text"}) | set(NAMES)
    assert sorted(repr((r.doc_id, *(r[n] for n in NAMES))) for r in found.collect()) == sorted(map(repr, want))
    return want


def odd(docs_of):
    extra = ["one two  three", " one\ttwo three\n four", "one\u00a0two three", "one\u3000two three", "x" * 70 + " y", "one two " * 30, "a \u2581 b", "one\x1ctwo three", "don't stop , now .", "<|endoftext|> in <s>text</s>", "two  spaces   three", " leading", "trailing ", "a▁b", "▁", "tab\tand\nline\r\n", "\x00 nul", "emoji 🙂🙃 é ﬁ", "中文字符", "the end. The end."]
    return docs_of(extra, 1000)


def test_equals_plain_loops_on_odd_texts(odd_docs, docs_of, paths, spark):
    more = odd(docs_of)
    docs = odd_docs.unionByName(more, allowMissingColumns=True).withColumns({n: F.lit("mine") for n in ("n_a", "count_sum", "key", "row", "shard")}).repartition(3)
    want = compare(docs, paths)
    assert sum(w[1] > 0 for w in want) > 40 and any(w[1] == 0 and w[0] is not None for w in want)


def test_small_shards_chunks_and_several_passes_change_nothing(docs_of, odd_texts, paths, monkeypatch):
    docs = odd(docs_of).unionByName(docs_of([t for t in odd_texts if t is None or len(t) < 1000])).withColumns({c: F.lit("mine") for c in ("row", "row_")}).repartition(3)
    for name, value in {"SHARD_PAIRS": 30, "TABLE_PAIRS": 100, "LEAF_ROWS": 3, "ARITY": 2, "KEPT_CHUNKS": 40, "KEPT_CHARS": 4, "CHUNK": 300, "JOINED": 3}.items():
        monkeypatch.setattr(alignment, name, value)
    compare(docs, paths)


def test_chunks_join_to_the_text_and_align_as_the_whole(odd_texts, paths):
    aligner = alignment.Aligner(*paths)
    assert aligner.cuts
    texts = [t for t in odd_texts if t and len(t) < 5000] + ["one two  three four", " a b\tc d", "caf\u00e9 na\u00efve", "one\u00a0two three"]
    assert all(" ".join(alignment.cut(t)) == t for t in texts)
    whole = alignment.Aligned(aligner, texts)
    chunks = alignment.Chunks(aligner)
    for _ in range(2):  # with nothing known, and with everything
        parts = chunks.align(texts)
        assert (parts.n_a == whole.n_a).all() and (parts.n_b == whole.n_b).all() and (parts.keys == whole.keys()).all() and (parts.group_at == whole.group_at).all()
        assert parts.digests() == [hashlib.sha256(w).hexdigest() if w else "" for w in whole.written()]


def test_no_documents(no_docs, paths):
    assert alignment.align_documents(no_docs, *paths).collect() == []


def test_minimal_hash_is_perfect_and_survives_storage():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 7, 20_000):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        made = alignment.MinimalHash.from_bytes(*alignment.MinimalHash.of(keys).to_bytes())
        assert sorted(made.places(keys)) == list(range(len(keys)))
    table = alignment.CountTable([{"sizes": (m := alignment.MinimalHash.of(keys)).to_bytes()[0], "bits": m.to_bytes()[1], "keys": keys[np.argsort(m.places(keys))].tobytes(), "counts": np.arange(len(keys)).tobytes()}])
    strangers = np.setdiff1d(rng.integers(0, 2**63, 5000).astype(np.uint64), keys)
    assert not table.look_up(strangers)[0].any() and not table.look_up(strangers)[1].any()
    assert (table.look_up(keys)[0] == m.places(keys)).all()
