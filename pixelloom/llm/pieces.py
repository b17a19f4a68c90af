"""SentencePiece encoding and decoding by suffix-array matching.

The texts of a batch are cut before each run of word marks (no piece of a vocabulary that passes `Vocabulary`'s check
crosses such a cut), and the distinct stretches are concatenated and indexed by a suffix array as deep as the longest piece. Every piece's
occurrences are a range of that array, found by binary search for all pieces at once. Each occurrence is an edge; the edges are sorted by
position and length. Relaxation then follows the model's own rule: of all edges that span two neighbouring
symbols, the one of the best score, leftmost among equals, replaces them, in all stretches side by side, until
none is left. What no piece covers falls back to bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pixelloom.llm.common import table
from pixelloom.llm.toxicity import chunks

MARK = "▁"
#: Stretches of more symbols are relaxed one by one with a heap instead of side by side.
LONG = 96
#: Bytes of text that are indexed at once.
BATCH = 3 << 20
_CUT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Vocabulary:
    """The pieces of a SentencePiece BPE model with byte fallback, as arrays.

    Raises ValueError for a model that this method can't encode: without byte fallback, with user-defined or unused pieces, or with a piece that has a
    word mark after another character.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.texts = [model.id_to_piece(i) for i in ids]
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        bytes_at = {int(self.texts[i][3:5], 16): i for i in ids if model.is_byte(i)}
        if len(bytes_at) != 256 or any(model.is_unused(i) for i in ids) or any(MARK in self.texts[i].lstrip(MARK) for i in plain):
            raise ValueError(f"not a byte-fallback BPE model without crossing pieces: {path}")
        self.byte_ids = np.array([bytes_at[b] for b in range(256)])
        self.values = [b"" if model.is_control(i) or model.is_unknown(i) else t.replace(MARK, " ").encode() for i, t in enumerate(self.texts)]
        for b, i in bytes_at.items():
            self.values[i] = bytes([b])
        scores = np.array([model.get_score(i) for i in plain])
        self.alphabet = np.array(sorted({ord(c) for i in plain for c in self.texts[i]}), np.int64)
        self.ids = np.array(plain)
        #: Place of each id in the order of scores, best first; equal scores share a place.
        self.order = np.zeros(len(self.texts), np.int64)
        self.order[self.ids] = np.unique(-scores, return_inverse=True)[1]
        self.lengths = np.array([len(self.texts[i]) for i in plain])
        self.depth = int(self.lengths.max())
        self.codes = np.zeros((len(plain), self.depth), np.int64)
        for row, i in enumerate(plain):
            self.codes[row, : len(self.texts[i])] = self.symbols(np.array([ord(c) for c in self.texts[i]]))

    def symbols(self, points: np.ndarray) -> np.ndarray:
        """Code points as places in the alphabet from 2 on; 1 for others; 0 for the end of a stretch."""
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(points == _END, 0, np.where(self.alphabet[at] == points, at + 2, 1))


_END = 0x110000  # beyond Unicode


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, sorted by their first `depth` symbols (by more, where that is for free)."""
    width = int(codes.max()) + 1
    reach, rank = 1, codes
    while width ** 2 < 1 << 62 and reach < depth:  # pack neighbours while they fit a key
        shifted = np.concatenate([rank[reach:], np.zeros(min(reach, len(rank)), np.int64)])
        rank, width, reach = rank * width + shifted, width**2, 2 * reach
    while reach < depth:
        rank = np.unique(rank, return_inverse=True)[1]
        shifted = np.concatenate([rank[reach:] + 1, np.zeros(min(reach, len(rank)), np.int64)])
        rank, reach = rank * (len(rank) + 1) + shifted, 2 * reach
    return np.argsort(rank, kind="stable")


def _bound(codes: np.ndarray, suffixes: np.ndarray, vocab: Vocabulary, upper: bool) -> np.ndarray:
    """For every piece the first suffix that doesn't sort before it (upper: that sorts after all that begin with it)."""
    padded = np.concatenate([codes, np.zeros(vocab.depth, np.int64)])
    low, high = np.zeros(len(vocab.ids), np.int64), np.full(len(vocab.ids), len(suffixes))
    columns = np.arange(vocab.depth)
    inside = columns < vocab.lengths[:, None]
    while (open_ := low < high).any():
        rows = np.flatnonzero(open_)
        mid = (low[rows] + high[rows]) // 2
        diff = np.where(inside[rows], np.sign(padded[suffixes[mid][:, None] + columns] - vocab.codes[rows]), 0)
        first = diff[np.arange(len(rows)), np.argmax(diff != 0, axis=1)]
        before = first <= 0 if upper else first < 0
        low[rows[before]] = mid[before] + 1
        high[rows[~before]] = mid[~before]
    return low


def edges(codes: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Ids of the pieces that occur in `codes`, one row for each position and a column for each length; -1 for none."""
    suffixes = suffix_array(codes, vocab.depth)
    low, high = (_bound(codes, suffixes, vocab, upper) for upper in (False, True))
    count = high - low
    piece = np.repeat(np.arange(len(count)), count)
    starts = suffixes[np.arange(len(piece)) + np.repeat(low - np.cumsum(count) + count, count)]
    found = np.full((len(codes), vocab.depth + 1), -1, np.int32)
    found[starts, vocab.lengths[piece]] = vocab.ids[piece]
    return found


def _relax_long(start: int, size: int, found: np.ndarray, order: np.ndarray) -> list[tuple[int, int]]:
    """Relax one stretch with a heap: O(n log n) however long it is."""
    depth = found.shape[1] - 1
    length = [1] * size
    before, after = list(range(-1, size - 1)), list(range(1, size + 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < size and length[i] + length[j] <= depth:
            piece = found[start + i, length[i] + length[j]]
            if piece >= 0:
                heapq.heappush(heap, (int(order[piece]), i, length[i], length[j]))

    for i in range(size - 1):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if length[i] != a or j >= size or length[j] != b:
            continue
        length[i], length[j] = a + b, 0
        after[i] = after[j]
        if after[j] < size:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [(start + i, n) for i, n in enumerate(length) if n]


def relax(starts: np.ndarray, sizes: np.ndarray, found: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of every symbol that stays, by position."""
    depth = found.shape[1] - 1
    done: list[tuple[np.ndarray, np.ndarray]] = []
    for i in np.flatnonzero(sizes > LONG):
        kept = _relax_long(int(starts[i]), int(sizes[i]), found, order)
        done.append(tuple(np.array(kept, np.int64).T))
    short = np.flatnonzero((sizes > 0) & (sizes <= LONG))
    n = sizes[short]
    owner = np.repeat(np.arange(len(short)), n)
    at = np.repeat(starts[short] - np.cumsum(n) + n, n) + np.arange(n.sum())
    length = np.ones(len(at), np.int64)
    none = np.int64(1) << 62
    while len(at):
        both = length[:-1] + length[1:]
        fits = (owner[:-1] == owner[1:]) & (both <= depth)
        piece = np.where(fits, found[at[:-1], np.where(fits, both, 0)], -1)
        key = np.append(np.where(piece >= 0, (order[piece] << 32) + np.arange(len(piece)), none), none)
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        best = np.minimum.reduceat(key, first)
        open_ = best < none
        rows = np.diff(np.append(first, len(at)))
        stays = np.repeat(~open_, rows)
        if stays.any():
            done.append((at[stays], length[stays]))
        into = best[open_] & 0xFFFFFFFF
        length[into] += length[into + 1]
        stays[into + 1] = True
        at, length, owner = at[~stays], length[~stays], owner[~stays]
    if not done:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at, length = (np.concatenate(x) for x in zip(*done, strict=True))
    by = np.argsort(at, kind="stable")
    return at[by], length[by]


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ..., count[0] of them, then those of begin[1], and so on."""
    return np.arange(count.sum()) + np.repeat(begin - np.cumsum(count) + count, count)


def encode_texts(texts: list[str | None], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and where each text's begin. Null and empty texts have none."""
    known: dict[str, int] = {}
    parts = [[known.setdefault(p, len(known)) for p in _CUT.findall(MARK + t.replace(" ", MARK))] if t else [] for t in texts]
    sizes = np.array([len(p) for p in known], np.int64)
    if not len(sizes):
        return np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    joined = np.frombuffer("".join(known).encode("utf-32-le"), np.uint32).astype(np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    points = np.full(len(joined) + len(sizes), _END, np.int64)
    points[_ranges(starts, sizes)] = joined
    found = edges(vocab.symbols(points), vocab)
    at, length = relax(starts, sizes, found, vocab.order)
    ids = found[at, length].astype(np.int64)
    widths = np.ones(len(ids), np.int64)
    bare = np.flatnonzero(ids < 0)  # single symbols that are no piece
    raw = [chr(c).encode() for c in points[at[bare]].tolist()]
    widths[bare] = [len(b) for b in raw]
    flat = np.repeat(ids, widths)
    flat[_ranges((np.cumsum(widths) - widths)[bare], widths[bare])] = vocab.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    ends = np.append(np.cumsum(widths), 0)
    part_end = ends[np.searchsorted(at, starts + sizes) - 1]
    part_begin = np.append(0, part_end[:-1])
    counts = np.array([len(p) for p in parts], np.int64)
    used = np.fromiter((i for p in parts for i in p), np.int64, counts.sum())
    n = (part_end - part_begin)[used]
    offsets = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(counts))]
    return flat[_ranges(part_begin[used], n)], offsets


def decode_ids(ids: list[int], vocab: Vocabulary) -> str:
    """The text of a list of ids, without the word mark that encoding puts first. Bytes that are no UTF-8 become U+FFFD."""
    text = b"".join(map(vocab.values.__getitem__, ids)).decode("utf-8", "replace")
    return text.removeprefix(" ")


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """`docs` with `ids`, the pieces of each whole text; empty for null and empty texts.

    `model` is a file that every executor has. Repeated rows are encoded alike. Other columns pass through; one named `ids` is replaced.
    """
    docs = docs.drop("ids")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            done = 0
            for part in chunks(batch.column("text"), BATCH):
                ids, offsets = encode_texts(part.to_pylist(), vocab)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                rest = batch.slice(done, len(part))
                done += len(part)
                yield pa.RecordBatch.from_arrays([*(rest.column(n) for n in names), lists], [*names, "ids"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """`encoded` with `text` made of `ids`; empty for null or empty lists."""
    encoded = encoded.drop("text")
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            texts = [decode_ids(x or [], vocab) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], [*names, "text"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("text", T.StringType())]))


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """`(doc_id, n_tokens, ids_sha256, round_trip)` for each row: encoded, digested (ids as little-endian 32-bit numbers) and decoded again.

    `round_trip` tells whether decoding gives the text back; a null text counts as empty. It fails for texts that hold the word mark itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            done = 0
            for part in chunks(batch.column("text"), BATCH):
                texts = part.to_pylist()
                ids, offsets = encode_texts(texts, vocab)
                raw, all_ids = ids.astype("<i4"), ids.tolist()
                digests, same = [], []
                for text, a, b in zip(texts, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    digests.append(hashlib.sha256(raw[a:b].tobytes()).hexdigest())
                    same.append(decode_ids(all_ids[a:b], vocab) == (text or ""))
                doc_ids = batch.column("doc_id").slice(done, len(part))
                done += len(part)
                columns = [doc_ids, pa.array(np.diff(offsets)), pa.array(digests), pa.array(same)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, round_trip boolean")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, as digest, and whether decoding gives the text back."""
    import public_tokenizers as vocabularies

    return piece_digests(table(spark, sf_dir, "documents"), vocabularies.path("piece_bpe_32k.model"))
