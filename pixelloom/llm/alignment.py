"""Alignment of two tokenizers over the same bytes, and how often each pair of their tokens is linked in the corpus.

First pass: every task aligns its texts and returns its distinct pairs with counts, a few thousand rows however long the texts are. Pairs are
dealt by the second tokenizer's id into shards of a bounded size, and each shard gets a minimal perfect hash: levels of bit arrays, where a pair
that has a bit to itself takes that bit's rank as its place and the others go on to the next level. Places index dense vectors of
counts, which are summed in a tree. The pairs themselves lie beside the counts in the order of their places, so every look-up is verified.

Neither tokenizer lets a token reach over a single space between two other characters, so a text is aligned in chunks from one such space to the next, and a
task aligns each distinct chunk once, as long as its table has room.

Second pass: the texts are aligned again, and links look up their counts. Tables of up to TABLE_PAIRS pairs go to the tasks as one broadcast of a
known size; beyond that there is one such pass for every further TABLE_PAIRS, whose sums are added.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pixelloom.llm.common import table
from pixelloom.llm.token_counts import _PLAIN, _RUN
from pixelloom.llm.tokens import mix
from pixelloom.plans.storage import write_shared

#: Pairs of a shard, about; of one broadcast (17 bytes and a bit each); and of what a task gathers before it lets go.
SHARD_PAIRS = 1 << 16
TABLE_PAIRS = 1 << 21
HELD_PAIRS = 1 << 20
#: Bytes of text that are aligned at once. A longer text is aligned alone.
CHUNK = 2 << 20
#: Rows of partial counts that become one dense vector, and dense vectors that are summed in one task.
LEAF_ROWS = 1 << 18
ARITY = 16
#: Chunks whose alignment a task keeps, and the longest that it keeps; when there are more it begins anew.
KEPT_CHUNKS, KEPT_CHARS = 1 << 18, 64
#: Chunks that are aligned as one text.
JOINED = 256
#: A space between characters that no library takes for white space; and white space that isn't ASCII or seldom.
_CUT = re.compile(r"(?<=[^ \t\n\r]) (?=[^ \t\n\r])")
_RARE = "\x0b\x0c\x1c\x1d\x1e\x1f"
_OTHER = re.compile(r"[\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")


class MinimalHash:
    """Places 0 to n - 1 for n distinct 64-bit keys; any other key gets some place or -1, so compare keys."""

    def __init__(self, bits: list[np.ndarray], first: list[int] | None = None) -> None:
        self.bits = bits
        self.ranks = [np.concatenate([[0], np.cumsum(b, dtype=np.int64)]) for b in bits]
        self.first = np.concatenate([[0], np.cumsum([r[-1] for r in self.ranks])]).astype(np.int64)

    @staticmethod
    def _spot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(keys + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> MinimalHash:
        keys, bits = np.asarray(keys, np.uint64), []
        while len(keys):
            size = max(8, 2 * len(keys))
            spot = cls._spot(keys, len(bits), size)
            alone = np.bincount(spot, minlength=size) == 1
            bits.append(alone)
            keys = keys[~alone[spot]]
        return cls(bits)

    def places(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, np.uint64)
        out, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.bits):
            spot = self._spot(keys[rest], level, len(bits))
            here = bits[spot]
            out[rest[here]] = self.first[level] + self.ranks[level][spot[here]]
            rest = rest[~here]
        return out

    def to_bytes(self) -> tuple[list[int], bytes]:
        return [len(b) for b in self.bits], np.packbits(np.concatenate(self.bits)).tobytes() if self.bits else b""

    @classmethod
    def from_bytes(cls, sizes: list[int], packed: bytes) -> MinimalHash:
        flat = np.unpackbits(np.frombuffer(packed, np.uint8), count=sum(sizes)).astype(bool)
        return cls([x.copy() for x in np.split(flat, np.cumsum(sizes)[:-1])] if sizes else [])


class Aligner:
    """Both tokenizers, without special tokens, and the bytes of all their tokens.

    `first` is a byte-level .json file, `ranks` the same vocabulary as ranks for plain texts, `second` a .model file that
    puts a space before each text; the first gets that space from us.
    """

    def __init__(self, first: str, second: str, ranks: str | None, pattern: str | None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.fast = Tokenizer.from_file(first), None
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.special = [str(x.content) for x in self.a.get_added_tokens_decoder().values()]
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        # The byte-level alphabet: printable Latin-1 characters stand for themselves, all other bytes for those from 256 on, in order.
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - plain))}
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        ids = [[b"%d" % i for i in range(len(x))] for x in (self.a_bytes, self.b_bytes)]
        #: Whether no piece goes on with a space after another character.
        self.cuts = not any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.piece_size()))
        #: How a token is written: in a group, and as the last of its side of a group.
        self.written = [x + b"," for x in ids[0]] + [x + b"|" for x in ids[0]] + [x + b"," for x in ids[1]] + [x + b";" for x in ids[1]]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        spaced = [" " + t for t in texts]
        a: list[list[int]] = [[]] * len(texts)
        slow = [i for i, t in enumerate(texts) if self.fast is None or not _PLAIN.match(t) or _RUN.search(t) or any(s in t for s in self.special)]
        for i in set(range(len(texts))).difference(slow):
            a[i] = self.fast.encode_ordinary(spaced[i])
        for i, x in zip(slow, self.a.encode_batch_fast([spaced[i] for i in slow], add_special_tokens=False) if slow else [], strict=True):
            a[i] = x.ids
        b = self.b.encode(texts, num_threads=1) if texts else []
        exact = set(range(len(texts))).difference(slow)  # ranks stand for bytes, so their tokens always join to the text
        for i, t in enumerate(spaced):  # without the same bytes on both sides a text has no tokens
            whole = t.encode()
            if len(whole) == 1 or b"".join(map(self.b_bytes.__getitem__, b[i])) != whole or i not in exact and b"".join(map(self.a_bytes.__getitem__, a[i])) != whole:
                a[i] = b[i] = []
        return a, b


@cache
def _aligner(first: str, second: str, ranks: str | None, pattern: str | None) -> Aligner:
    return Aligner(first, second, ranks, pattern)


class Aligned:
    """The tokens of some texts one after the other; `a_last`, `b_last` are the places where both end, one for each group."""

    def __init__(self, aligner: Aligner, texts: list[str]) -> None:
        self.aligner = aligner
        a, b = aligner.encode(texts)
        self.n_a, self.n_b = (np.array([len(x) for x in y], np.int64) for y in (a, b))
        self.a, self.b = (np.fromiter(chain.from_iterable(y), np.int64, int(n.sum())) for y, n in ((a, self.n_a), (b, self.n_b)))
        a_end, b_end = self.a_end, self.b_end = np.cumsum(aligner.a_size[self.a]), np.cumsum(aligner.b_size[self.b])
        ends = np.zeros((2, int(a_end[-1]) + 1 if len(a_end) else 1), bool)  # by byte: both sides have the same bytes
        ends[0, a_end] = ends[1, b_end] = True
        self.a_last, self.b_last = np.flatnonzero(ends[1, a_end]), np.flatnonzero(ends[0, b_end])
        self.a_at, self.b_at = (np.concatenate([[0], np.cumsum(n)]) for n in (self.n_a, self.n_b))
        self.group_at = np.searchsorted(self.a_last, self.a_at)

    def split(self, ends: np.ndarray) -> bool:
        """From now on the parts of all texts together that end at these bytes stand for the texts; false if a part's end isn't the end of a group."""
        at = [np.concatenate([[0], np.searchsorted(x, ends, side="right")]) for x in (self.a_end, self.b_end, self.a_end[self.a_last])]
        if len(self.a_last) < len(ends) or not np.array_equal(self.a_end[self.a_last][at[2][1:] - 1], ends):
            return False
        self.a_at, self.b_at, self.group_at = at
        self.n_a, self.n_b = np.diff(self.a_at), np.diff(self.b_at)
        return True

    def keys(self) -> np.ndarray:
        """The linked pair of each group: the second tokenizer's id below the first's."""
        return (self.a[self.a_last].astype(np.uint64) << np.uint64(32)) | self.b[self.b_last].astype(np.uint64)

    def written(self) -> list[bytes]:
        """Each text's groups in writing; empty without tokens."""
        n, m, place = len(self.aligner.a_bytes), len(self.aligner.b_bytes), np.zeros(len(self.a) + len(self.b), np.int64)
        ends_a, ends_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        ends_a[self.a_last] = ends_b[self.b_last] = True
        group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
        before_b = np.concatenate([[0], self.b_last + 1])  # tokens of the second before a group
        after_a = np.concatenate([self.a_last + 1, [len(self.a)]])  # tokens of the first up to the end of a group
        place[np.arange(len(self.a)) + before_b[group_a]] = self.a + n * ends_a
        place[np.arange(len(self.b)) + after_a[group_b]] = 2 * n + self.b + m * ends_b
        codes, at, written = place.tolist(), (self.a_at + self.b_at).tolist(), self.aligner.written
        return [b"".join(map(written.__getitem__, codes[i:j]))[:-1] for i, j in zip(at, at[1:], strict=False)]


def _simple(text: str) -> bool:
    """Whether all spaces are single ones between two other characters, as far as a quick look can tell."""
    if any(c in text for c in _RARE) or not text.isascii() and _OTHER.search(text):
        return False
    return not ("  " in text or " \n" in text or "\n " in text or "\t" in text or "\r" in text or text[0] == " " or text[-1] == " ")


def cut(text: str) -> list[str]:
    """The text's chunks, which single spaces join to it again; the whole of it where other white space could matter."""
    if not text:
        return []
    if _simple(text):
        return text.split(" ")
    if any(c in text for c in _RARE) or not text.isascii() and _OTHER.search(text):
        return [text]
    return _CUT.split(text)


class Chunks:
    """Texts aligned by the chunks that they consist of. `n_a`, `n_b`, `keys`, `writing`: of the chunks known so far, whose keys are from `offset` to `offset`."""

    def __init__(self, aligner: Aligner, writes: bool = True) -> None:
        self.aligner, self.writes = aligner, writes
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.names: list[str] = []
        self.writing: list[bytes] = []
        self.n_a, self.n_b, self.offset, self.keys = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint64)
        self.kept = 0

    def _found(self, chunks: list[str]) -> Aligned:
        """The chunks aligned: joined by spaces to longer texts, which is faster, and alone if one of these has no tokens."""
        texts = [" ".join(chunks[i : i + JOINED]) for i in range(0, len(chunks), JOINED)]
        if len(chunks) > 1 and all(map(_simple, texts)):
            found = Aligned(self.aligner, texts)
            size = map(len, chunks) if all(t.isascii() for t in texts) else (len(c.encode()) for c in chunks)
            if found.n_a.all() and found.split(np.cumsum(np.fromiter(size, np.int64, len(chunks)) + 1)):
                return found
        return Aligned(self.aligner, chunks)

    def _add(self, chunks: list[str]) -> None:
        if chunks:
            found = self._found(chunks)
            self.at.update(zip(chunks, range(len(self.names), len(self.names) + len(chunks)), strict=True))
            self.names += chunks
            self.writing += found.written() if self.writes else []
            self.n_a, self.n_b = np.concatenate([self.n_a, found.n_a]), np.concatenate([self.n_b, found.n_b])
            self.offset = np.concatenate([self.offset, self.offset[-1] + found.group_at[1:]])
            self.keys = np.concatenate([self.keys, found.keys()])

    def _drop_long(self) -> None:
        for name in self.names[self.kept :]:
            del self.at[name]
        del self.names[self.kept :], self.writing[self.kept :]  # the latter is empty if nothing is written
        self.n_a, self.n_b, self.offset = self.n_a[: self.kept], self.n_b[: self.kept], self.offset[: self.kept + 1]
        self.keys = self.keys[: self.offset[-1]]

    def align(self, texts: list[str]) -> AlignedTexts:
        self._drop_long()
        pieces = [cut(t) if self.aligner.cuts else [t] if t else [] for t in texts]
        flat = list(chain.from_iterable(pieces))
        fresh = [c for c in dict.fromkeys(flat) if c not in self.at]
        if len(self.at) + len(fresh) > KEPT_CHUNKS and self.at:
            self.clear()
            fresh = list(dict.fromkeys(flat))
        short = [c for c in fresh if len(c) <= KEPT_CHARS]
        for i in range(0, len(short), 64 * JOINED):
            self._add(short[i : i + 64 * JOINED])
        self.kept = len(self.names)
        self._add([c for c in fresh if len(c) > KEPT_CHARS])
        ids = np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))
        return AlignedTexts(self, ids, np.array([len(p) for p in pieces], np.int64))


class AlignedTexts:
    """`n_a`, `n_b`, `groups` of each text, and the `keys` of all groups; text i has those from `group_at[i]` to `group_at[i + 1]`."""

    def __init__(self, chunks: Chunks, ids: np.ndarray, sizes: np.ndarray) -> None:
        owner = np.repeat(np.arange(len(sizes)), sizes)
        bad = np.bincount(owner[chunks.n_a[ids] == 0], minlength=len(sizes)) > 0  # a chunk without tokens: the text has none
        ids, sizes = ids[~bad[owner]], np.where(bad, 0, sizes)
        self.chunks, self.ids, self.at = chunks, ids, np.concatenate([[0], np.cumsum(sizes)])
        n = chunks.offset[ids + 1] - chunks.offset[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        self.keys = chunks.keys[np.repeat(chunks.offset[ids] - ends[:-1], n) + np.arange(ends[-1])]
        self.group_at = ends[self.at]
        self.groups = np.diff(self.group_at)
        self.n_a, self.n_b = (np.diff(np.concatenate([[0], np.cumsum(x[ids])])[self.at]) for x in (chunks.n_a, chunks.n_b))

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups as written; empty without tokens."""
        ids, at, writing = self.ids.tolist(), self.at.tolist(), self.chunks.writing.__getitem__
        return [hashlib.sha256(b";".join(map(writing, ids[i:j]))).hexdigest() if j > i else "" for i, j in zip(at, at[1:], strict=False)]


def _parts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about CHUNK bytes, with the place of the first; null is empty."""
    first, texts, held = 0, [], 0
    for i, scalar in enumerate(column):
        texts.append(scalar.as_py() or "")
        held += len(texts[-1])
        if held >= CHUNK:
            yield first, texts
            first, texts, held = i + 1, [], 0
    if texts:
        yield first, texts


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, at, np.concatenate([n for _, n in parts]))
    return keys, counts


def partial_counts(docs: DataFrame, tools: tuple) -> DataFrame:
    """`(key, n, task)`: the distinct pairs that a task has seen, with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        chunks = Chunks(_aligner(*tools), writes=False)
        for batch in batches:
            for _, texts in _parts(batch.column("text")):
                parts.append(np.unique(chunks.align(texts).keys, return_counts=True))
                if sum(len(k) for k, _ in parts) > HELD_PAIRS:
                    parts = [_merged(parts)]
                    if len(parts[0][0]) > HELD_PAIRS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(parts[0][0].view(np.int64)), pa.array(parts[0][1])], ["key", "n"])
                        parts = []
        if parts:
            keys, counts = _merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["key", "n"])

    return docs.select("text").mapInArrow(run, "key long, n long").withColumn("task", F.spark_partition_id())


def _hash_shard(group: pa.Table) -> pa.Table:
    keys = np.asarray(group.column("key"), dtype=np.int64).view(np.uint64)
    made = MinimalHash.of(keys)
    ordered = np.empty_like(keys)
    ordered[made.places(keys)] = keys
    sizes, bits = made.to_bytes()
    return pa.table({"shard": group.column("shard")[:1].cast(pa.int64()), "sizes": pa.array([sizes], pa.list_(pa.int64())), "bits": [bits], "keys": [ordered.tobytes()]})


_VECTOR = pa.schema([("shard", pa.int64()), ("leaf", pa.int64()), ("counts", pa.binary())])


def _vector(key: tuple, counts: list[np.ndarray]) -> pa.Table:
    return pa.table({"shard": [key[0].as_py() for _ in counts], "leaf": [key[1].as_py() for _ in counts], "counts": [c.tobytes() for c in counts]}, _VECTOR)


def _dense(key: tuple, rows: pa.Table, hashes: pa.Table) -> pa.Table:
    """Partial counts as a vector over a shard's places; none where there are no rows."""
    if not rows.num_rows:
        return _vector(key, [])
    shard = hashes.slice(0, 1).to_pylist()[0]
    keys = np.frombuffer(shard["keys"], np.uint64)
    counts = np.zeros(len(keys), np.int64)
    wanted = np.asarray(rows.column("key"), dtype=np.int64).view(np.uint64)
    at = MinimalHash.from_bytes(shard["sizes"], shard["bits"]).places(wanted)
    if not np.array_equal(keys[at], wanted):
        raise ValueError("a pair has no place of its own")
    np.add.at(counts, at, np.asarray(rows.column("n"), dtype=np.int64))
    return _vector(key, [counts])


def _add(key: tuple, group: pa.Table) -> pa.Table:
    return _vector(key, [sum(np.frombuffer(x.as_py(), np.int64) for x in group.column("counts"))])


def pair_counts(docs: DataFrame, tools: tuple) -> DataFrame:
    """`(shard, n_pairs, sizes, bits, keys, counts)`: the minimal perfect hash of each shard, its pairs and their counts by place.

    All pairs of one id of the second tokenizer are in one shard.
    """
    partial = write_shared(partial_counts(docs, tools), "pair-partials")
    distinct = write_shared(partial.groupBy("key").agg(F.count("*").alias("rows")), "pairs")
    n, rows = distinct.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    shards = max(1, -(-n // SHARD_PAIRS))
    shard = F.pmod(F.xxhash64(F.col("key").bitwiseAND(F.lit((1 << 32) - 1))), F.lit(shards)).alias("shard")
    hashes = distinct.select(shard, "key").groupBy("shard").applyInArrow(_hash_shard, "shard long, sizes array<long>, bits binary, keys binary")
    hashes = write_shared(hashes, "pair-hashes")
    leaves = max(1, -(-rows // (shards * LEAF_ROWS)))
    leaf = F.pmod(F.xxhash64("task", "key"), F.lit(leaves)).alias("leaf")
    dealt = hashes.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(leaves - 1).cast("long"))).alias("leaf"), "sizes", "bits", "keys")
    vectors = partial.select(shard, leaf, "key", "n").groupBy("shard", "leaf").cogroup(dealt.groupBy("shard", "leaf")).applyInArrow(_dense, "shard long, leaf long, counts binary")
    while leaves > 1:
        leaves = -(-leaves // ARITY)
        vectors = write_shared(vectors, "pair-vectors").withColumn("leaf", F.floor(F.col("leaf") / ARITY)).groupBy("shard", "leaf").applyInArrow(_add, "shard long, leaf long, counts binary")
    return write_shared(hashes.join(vectors.drop("leaf"), "shard").withColumn("n_pairs", (F.octet_length("counts") / 8).cast("long")), "pair-counts")


class CountTable:
    """Look-ups in some shards of `pair_counts`."""

    def __init__(self, rows: list[dict]) -> None:
        self.hashes = [MinimalHash.from_bytes(r["sizes"], r["bits"]) for r in rows]
        self.keys = [np.frombuffer(r["keys"], np.uint64) for r in rows]
        self.counts = [np.frombuffer(r["counts"], np.int64) for r in rows]
        self.best = []
        for keys, counts in zip(self.keys, self.counts, strict=True):
            ids, at = np.unique(keys & np.uint64(0xFFFFFFFF), return_inverse=True)
            most = np.zeros(len(ids), np.int64)
            np.maximum.at(most, at, counts)
            self.best.append(counts == most[at])

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each key's count, and whether it is the highest of its second id; zero and no for keys of other shards."""
        count, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        for hashed, own, counts, highest in zip(self.hashes, self.keys, self.counts, self.best, strict=True):
            at = hashed.places(keys)
            held = np.flatnonzero(at >= 0)
            held = held[own[at[held]] == keys[held]]
            count[held], best[held] = counts[at[held]], highest[at[held]]
        return count, best


_FOUND = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())]


def look_up_documents(docs: DataFrame, rows: list[dict], tools: tuple) -> DataFrame:
    """`docs` (text last) without its text but with the figures of each document, counts being those that `rows` of `pair_counts` hold."""
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, chunks = CountTable(shared.value), Chunks(_aligner(*tools))
        for batch in batches:
            own = batch.drop_columns(["text"])
            for first, texts in _parts(batch.column("text")):
                aligned = chunks.align(texts)
                distinct, at = np.unique(aligned.keys, return_inverse=True)
                count, best = counts.look_up(distinct)
                sums = [np.concatenate([[0], np.cumsum(x[at])]) for x in (best, count)]
                n_best, count_sum = (np.diff(s[aligned.group_at]) for s in sums)
                found = [aligned.n_a, aligned.n_b, aligned.groups, aligned.groups, n_best, count_sum, aligned.digests()]
                arrays = [*own.slice(first, len(texts)).columns, *(pa.array(x, kind) for x, (_, kind) in zip(found, _FOUND, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, [*own.schema.names, *(n for n, _ in _FOUND)])

    schema = StructType(docs.drop("text").schema.fields + [StructField(n, StringType() if kind == pa.string() else LongType()) for n, kind in _FOUND])
    return docs.mapInArrow(run, schema)


def align_documents(docs: DataFrame, first: str, second: str, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """`docs` without its text but with `n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`; same-named columns are replaced.

    The first tokenizer encodes a space and the text, the second puts the space itself; special tokens' strings are plain
    text. Null and empty texts, and texts whose tokens' bytes on either side aren't those of space and text, have no tokens: zeros, and an empty
    digest. A group ends where both tokenizers end a token, and links those two tokens. A pair's count is the number of its links in `docs`; copies
    count as often as they stand there. Texts are aligned whole, however long; repeated rows have a row each.
    """
    tools = (first, second, ranks, pattern)
    docs = docs.select(*(c for c in docs.columns if c not in {n for n, _ in _FOUND}))
    counted = pair_counts(docs, tools)
    tables: list[list[int]] = []
    room = 0
    for r in counted.select("shard", "n_pairs").orderBy("shard").toLocalIterator():  # one row a shard
        if not tables or r["n_pairs"] > room:
            tables.append([])
            room = TABLE_PAIRS
        tables[-1].append(r["shard"])
        room -= r["n_pairs"]

    def load(shards: list[int]) -> list[dict]:
        return [r.asDict() for r in counted.where(F.col("shard").isin(shards)).drop("n_pairs", "shard").collect()]

    if len(tables) < 2:
        return look_up_documents(docs, load(tables[0]) if tables else [], tools)
    row = "row"
    while row in docs.columns:
        row += "_"
    numbered = write_shared(docs.withColumn(row, F.monotonically_increasing_id()), "aligned-rows")
    passes = [look_up_documents(numbered.select(row, "text"), load(t), tools) for t in tables]
    sums = passes[0]
    for more in passes[1:]:
        sums = sums.unionByName(more)
    same = [F.first(n).alias(n) if n not in ("n_best", "count_sum") else F.sum(n).alias(n) for n, _ in _FOUND]
    return numbered.drop("text").join(sums.groupBy(row).agg(*same), row).drop(row)


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment figures of all documents."""
    import public_tokenizers as vocabularies

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    paths = [vocabularies.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")]
    return align_documents(docs, *paths, vocabularies.PATTERN)
