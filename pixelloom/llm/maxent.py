"""Language-model scores of a hashed maximum-entropy model with a class-factored softmax.

Tokens are words and one end for each text. A word's path leads from the root through classes of classes: first one of `CLASSES` by
its last letters (or the end), then `DEPTH` times one of `BRANCH` parts of nearly equal counts, most frequent words first. Every step is a
softmax over the parts of a node with hashed features: at the root of the last word, of the one before (a skip), and of both (a
trigram's context); below it of the last word with the node. Contexts are words by their full hashes, not only frequent ones.
In the last class a word has its share of the class's smoothed counts, so all words, known or not, have probabilities that sum to one.

Counts cover every training text and are summed by Spark. The weights start from the counts' log-shares and are trained in `ROUNDS` synchronous
steps. In each, tasks sum over their part of the texts what the model expects and what occurs, by feature and output; Spark adds these up,
and the weights move along the gradient (occurred less expected), scaled to the log-ratio of the two. The sums don't depend on how texts are
spread over tasks, so neither do the scores, but for rounding. Counts of the `KNOWN_WORDS` most frequent words are broadcast; rarer words
are looked up by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm.common import row_key, table
from pixelloom.llm.tokens import batch_words, mix
from pixelloom.llm.toxicity import chunks, fold_of
from pixelloom.plans.storage import write_shared

BRANCH, DEPTH = 16, 2
#: Classes of words by their last letters; the root's last part is the end.
CLASSES = BRANCH - 1
END = CLASSES
#: Cells at the bottom of each class. The last one also holds rare and unknown words.
CELLS = BRANCH**DEPTH
#: First node of each level: the root, the classes, their parts, and so on; and how many there are.
FIRST = [0, *(1 + CLASSES * sum(BRANCH**i for i in range(d)) for d in range(DEPTH))]
NODES = 1 + CLASSES * sum(BRANCH**d for d in range(DEPTH))
#: Rows of the weight tables of the root and of the nodes below. Features are hashed to them; more rows, fewer collisions.
ROOT_ROWS, LOWER_ROWS = 1 << 16, 1 << 18
ROWS = ROOT_ROWS + LOWER_ROWS
KNOWN_WORDS = 1 << 20
ROUNDS = 4
#: Share of the log-ratio that a step takes, at the root (where three features add up) and below; what both sums are raised by.
ROOT_RATE, LOWER_RATE, PRIOR = 0.4, 0.9, 0.5
#: Bytes of text that are split at once, and events that are weighed at once.
CHUNK, SLICE = 2 << 20, 1 << 15
#: Hash of what stands before a text.
BEGIN = np.uint64(1)


def _row(kind: int, context: np.ndarray, node: np.ndarray | int) -> np.ndarray:
    """Hash of a feature to a row of the tables."""
    with np.errstate(over="ignore"):
        x = mix(np.asarray(context, np.uint64) + np.asarray(node, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(kind))
    rows, first = (ROOT_ROWS, 0) if kind < 4 else (LOWER_ROWS, ROOT_ROWS)
    return first + ((x >> np.uint64(20)) % np.uint64(rows)).astype(np.int64)


@dataclass
class Model:
    """`known`, `known_count`, `known_cell`: sorted hashes of frequent words, their counts and cells; `mass`: counts + 1 summed over each cell."""

    known: np.ndarray
    known_count: np.ndarray
    known_cell: np.ndarray
    mass: np.ndarray
    bias: np.ndarray
    tokens: int
    distinct: int
    ends: int
    weights: np.ndarray

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and count of each word; those that are not among the frequent ones are in the last cell of their class, with count 0."""
        tail = ((hashes & np.uint64(BRANCH - 1)).astype(np.int64) + 1) * CELLS - 1
        if not len(self.known):
            return tail, np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        here = self.known[at] == hashes
        return np.where(here, self.known_cell[at], tail), np.where(here, self.known_count[at], 0)

    def log_odds(self, node: np.ndarray | int, rows: list[np.ndarray]) -> np.ndarray:
        """Log-probabilities of all parts of each node."""
        z = self.weights[rows[0]]
        for r in rows[1:]:
            z += self.weights[r]
        z += self.bias[node]
        most = z
        while most.shape[1] > 1:  # by halves, which is faster than a reduction along short rows
            half = most.shape[1] // 2
            most = np.maximum(most[:, :half], most[:, half:])
        z -= most
        z -= np.log(np.einsum("ij->i", np.exp(z)))[:, None]
        return z


def root_rows(before: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        both = mix(before) * np.uint64(31) + last
    return [_row(1, last, 0), _row(2, before, 0), _row(3, both, 0)]


def hashed_words(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, the class in the lowest bits, and where each text's words begin."""
    found = batch_words(part)
    last = found.data[np.maximum(found.ends - 1, 0)].astype(np.uint64) * np.uint64(31)
    last += np.where(found.ends - found.starts > 1, found.data[np.maximum(found.ends - 2, 0)], 0).astype(np.uint64)
    with np.errstate(over="ignore"):
        group = ((last * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(CLASSES)
    return (found.hashes & ~np.uint64(BRANCH - 1)) | group, found.offsets


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)


@dataclass
class Weighed:
    """Contexts at one level, and the steps that were taken from them: `at` places of the steps, `of` the context of each, `taken` its part, `count`."""

    rows: list[np.ndarray]
    logs: np.ndarray
    total: np.ndarray  # count of each context
    at: slice
    of: np.ndarray
    taken: np.ndarray
    count: np.ndarray


@dataclass
class Events:
    """The distinct words of a chunk, and its tokens as distinct steps from contexts. Places of words count from 2: 0 is the end, 1 the begin."""

    words: np.ndarray
    cell: np.ndarray
    known: np.ndarray  # counts of the frequent words
    begins: np.ndarray
    token: np.ndarray  # place of each token's word
    root: tuple[np.ndarray, np.ndarray]  # sorted keys of (before, last, class), counts
    root_of: np.ndarray
    lower: tuple[np.ndarray, np.ndarray]  # sorted keys of (last, cell), counts
    lower_of: np.ndarray  # for tokens that are words

    @staticmethod
    def of(model: Model, part: pa.Array) -> Events:
        hashes, offsets = hashed_words(part)
        words, back = np.unique(np.concatenate([np.array([0, BEGIN], np.uint64), hashes]), return_inverse=True)
        cell, known = model.look_up(words)
        begins = offsets + np.arange(len(offsets))
        token = np.zeros(begins[-1], np.int64)
        inner = np.ones(len(token), bool)
        inner[begins[1:] - 1] = False
        token[inner] = back[2:]
        last = np.concatenate([[1], token[:-1]])
        last[begins[:-1]] = 1
        before = np.concatenate([[1], last[:-1]])
        before[begins[:-1]] = 1
        group = np.where(token == 0, END, cell[token] // CELLS)
        keys, root_of, count = np.unique((before * len(words) + last) * BRANCH + group, return_inverse=True, return_counts=True)
        low, lower_of, low_count = np.unique((last * (CLASSES * CELLS) + cell[token])[inner], return_inverse=True, return_counts=True)
        return Events(words, cell, known, begins, token, (keys, count), root_of, (low, low_count), lower_of)

    def weighed(self, model: Model) -> Iterator[tuple[bool, Weighed]]:
        """Every level's contexts in slices, with whether they are at the root."""
        n = len(self.words)
        keys, count = self.root
        for context, *rest in self._slices(keys, count, BRANCH):
            before, last = self.words[context // n], self.words[context % n]
            rows = root_rows(before, last)
            yield True, Weighed(rows, model.log_odds(np.zeros(len(last), np.int64), rows), *rest)
        keys, count = self.lower
        for d in range(DEPTH):
            size = BRANCH ** (DEPTH - d)
            for context, *rest in self._slices(keys, count, size):
                last, node = context // (CLASSES * CELLS // size), FIRST[d + 1] + context % (CLASSES * CELLS // size)
                rows = [_row(4 + d, self.words[last], node)]
                yield False, Weighed(rows, model.log_odds(node, rows), *rest)

    @staticmethod
    def _slices(keys: np.ndarray, count: np.ndarray, size: int) -> Iterator[tuple]:
        contexts = keys // size
        starts = _starts(contexts)
        for i in range(0, len(starts), SLICE):
            mine = starts[i : i + SLICE]
            at = slice(mine[0], starts[i + SLICE] if i + SLICE < len(starts) else len(keys))
            of = np.repeat(np.arange(len(mine)), np.diff(np.append(mine, at.stop)))
            yield contexts[mine], np.add.reduceat(count[at], mine - at.start), at, of, keys[at] % size // (size // BRANCH), count[at]


class Sums:
    """What a task's texts expect and what occurs in them, by row and part."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.expected, self.occurred = np.zeros(ROWS * BRANCH), np.zeros(ROWS * BRANCH)

    def add(self, part: pa.Array) -> None:
        for _, w in Events.of(self.model, part).weighed(self.model):
            p = (np.exp(w.logs) * w.total[:, None].astype(np.float32)).astype(np.float64).reshape(-1)
            count = w.count.astype(np.float64)
            for r in w.rows:
                first = r * BRANCH
                np.add.at(self.expected, (first[:, None] + np.arange(BRANCH)).reshape(-1), p)
                np.add.at(self.occurred, first[w.of] + w.taken, count)

    def batches(self) -> Iterator[pa.RecordBatch]:
        expected, occurred = self.expected.reshape(ROWS, BRANCH), self.occurred.reshape(ROWS, BRANCH)
        touched = np.flatnonzero(occurred.any(axis=1))
        for i in range(0, len(touched), 1 << 14):
            at = touched[i : i + (1 << 14)]
            columns = np.concatenate([expected[at], occurred[at]], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(c, pa.float32()) for c in columns.T)], ["row", *_SUMS])


_SUMS = [f"{side}{k}" for side in ("e", "o") for k in range(BRANCH)]


def moves(sums: DataFrame) -> DataFrame:
    """`(row, m0, m1, ...)`: how far each weight moves by the sums of what is expected and what occurred, over all tasks."""
    total = sums.groupBy("row").agg(*(F.sum(c).alias(c) for c in _SUMS))
    rate = F.when(F.col("row") < ROOT_ROWS, ROOT_RATE).otherwise(LOWER_RATE)
    return total.select("row", *((rate * F.log((F.col(f"o{k}") + PRIOR) / (F.col(f"e{k}") + PRIOR))).cast("float").alias(f"m{k}") for k in range(BRANCH)))


def count_words(docs: DataFrame) -> DataFrame:
    """`(h, c)` for every distinct word of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch.column("text"), CHUNK):
                words, counts = np.unique(hashed_words(part)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["h", "c"])

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def place_words(known: np.ndarray, count: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Cell of each known word: in its class, by the middle of its stretch when the most frequent come first; `rest` counts the class's rare words."""
    group, cell = (known & np.uint64(BRANCH - 1)).astype(np.int64), np.zeros(len(known), np.int64)
    for k in range(CLASSES):
        at = np.flatnonzero(group == k)
        at = at[np.lexsort((known[at], -count[at]))]
        if len(at):
            upto = np.cumsum(count[at])
            middle = (2 * upto - count[at]) * CELLS // (2 * (upto[-1] + rest[k] + 1))
            cell[at] = k * CELLS + np.minimum(middle, CELLS - 1)
    return cell


def node_bias(mass: np.ndarray, ends: int) -> np.ndarray:
    """Log-shares of the parts of all nodes; an empty part counts as a hundredth."""
    out = np.zeros((NODES, BRANCH), np.float32)
    for d in range(DEPTH, -1, -1):
        size = mass.reshape(-1, BRANCH ** (DEPTH - d)).sum(axis=1) if d else np.append(mass.reshape(CLASSES, -1).sum(axis=1), ends + 0.5)
        size = np.maximum(size, 0.01).reshape(-1, BRANCH)
        out[FIRST[d] : FIRST[d] + len(size)] = np.log(size / size.sum(axis=1, keepdims=True))
    return out


def start_model(counts: DataFrame, ends: int) -> Model:
    """Model of the counts alone. `ends`: training texts."""
    level = F.floor(F.log2("c") * 16).cast("int")  # at most some thousand levels
    levels = counts.groupBy(level.alias("level")).count().toPandas().sort_values("level", ascending=False)
    fit = levels["level"][levels["count"].cumsum() <= KNOWN_WORDS]
    if len(fit):
        frequent = counts.where(level >= int(fit.min())).toArrow()
        known, count = frequent.column("h").to_numpy().view(np.uint64), frequent.column("c").to_numpy()
    else:  # no word, or too many in the first level alone: all are looked up by the join
        known, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    by = np.argsort(known)
    known, count = known[by], count[by]
    groups = counts.groupBy(F.pmod("h", F.lit(BRANCH)).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).toPandas()
    rest_c, rest_n = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    rest_c[groups["k"]], rest_n[groups["k"]] = groups["c"], groups["n"]
    tokens, distinct = int(rest_c.sum()) + ends, int(rest_n.sum()) + (ends > 0)
    group = (known & np.uint64(BRANCH - 1)).astype(np.int64)
    np.subtract.at(rest_c, group, count)
    np.subtract.at(rest_n, group, 1)
    cell = place_words(known, count, rest_c)
    mass = np.zeros(CLASSES * CELLS)
    np.add.at(mass, cell, count + 1)
    mass[CELLS - 1 :: CELLS] += rest_c + rest_n + 1
    return Model(known, count, cell, mass, node_bias(mass, ends), tokens, distinct, ends, np.zeros((ROWS, BRANCH), np.float32))


def train(docs: DataFrame, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """Model of all texts of `docs` (null as empty), and the table of all counts. Each text is in one round's step, chosen by hash."""
    counts = write_shared(count_words(docs), "word-counts")
    model = start_model(counts, docs.count())
    turn = F.pmod(row_key(), F.lit(rounds))
    tasks = max(1, docs.rdd.getNumPartitions() // rounds)
    for i in range(rounds):
        held = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            sums = Sums(held.value)
            for batch in batches:
                for part in chunks(batch.column("text"), CHUNK):
                    sums.add(part)
            yield from sums.batches()

        some = docs.where(turn == i).select(F.col("text").cast("binary").alias("text")).coalesce(tasks)
        parts = some.mapInArrow(run, "row bigint, " + ", ".join(f"{c} float" for c in _SUMS))
        moved = moves(parts).toArrow()
        rows = moved.column("row").to_numpy()
        for k in range(BRANCH):
            model.weights[rows, k] += moved.column(f"m{k}").to_numpy()
        del moved
        held.destroy()
    return model, counts


def score_chunk(model: Model, part: pa.Array) -> dict[str, np.ndarray | pa.Array]:
    """What can be said without the counts of rare words, and each text's rare words with their numbers."""
    events = Events.of(model, part)
    root, lower = np.zeros(len(events.root[0])), np.zeros(len(events.lower[0]))
    for top, w in events.weighed(model):
        (root if top else lower)[w.at] += w.logs[w.of, w.taken]
    count = events.known
    count[:2] = 0
    gain = np.log10(count + 1.0)
    word = events.token > 0
    logs = root[events.root_of] / np.log(10)
    logs[word] += lower[events.lower_of] / np.log(10) + (gain - np.log10(model.mass[events.cell]))[events.token[word]]
    total = lambda x: np.add.reduceat(x, events.begins[:-1])
    n_tokens = np.diff(events.begins)
    base = total(np.where(word, gain[events.token], np.log10(model.ends + 1.0))) - n_tokens * np.log10(model.tokens + model.distinct + 1.0)
    rare = word & (count[events.token] == 0)
    owner = np.repeat(np.arange(len(n_tokens)), n_tokens)[rare]
    n = len(events.words)
    pairs, times = np.unique(owner * n + events.token[rare], return_counts=True)
    at = pa.array(np.searchsorted(pairs // n, np.arange(len(n_tokens) + 1)), pa.int32())
    return {
        "n_tokens": n_tokens,
        "n_known": total((word & ~rare).astype(np.int64)) + (model.ends > 0),
        "base": base,
        "score": total(logs),
        "rare": pa.ListArray.from_arrays(at, pa.array(events.words[pairs % n].view(np.int64))),
        "times": pa.ListArray.from_arrays(at, pa.array(times, pa.int32())),
    }


def score_documents(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """`(doc_id, n_tokens, n_known, base_score, score)` for each row of `docs`.

    Words are runs of all but ASCII white space, A-Z as a-z; every text, also a null or empty one, has one end. `base_score` is the
    add-one unigram log10 probability, `score` the model's. A row is judged by itself, also when it repeats or has no doc_id.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["n_tokens", "n_known", "base", "score", "rare", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in chunks(batch.column("text"), CHUNK):
                found = score_chunk(held.value, part)
                keys = [batch.column(c).slice(done, len(part)) for c in ("row_id", "doc_id")]
                done += len(part)
                columns = [x if isinstance(x, pa.Array) else pa.array(x) for x in (found[n] for n in names)]
                yield pa.RecordBatch.from_arrays([*keys, *columns], ["row_id", "doc_id", *names])

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.col("text").cast("binary").alias("text"))
    schema = f"row_id bigint, doc_id {kind}, n_tokens bigint, n_known bigint, base double, score double, rare array<bigint>, times array<int>"
    partial = write_shared(rows.mapInArrow(run, schema), "scores")
    rare = partial.select("row_id", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row_id", F.col("x.rare").alias("h"), F.col("x.times").alias("n"))
    gains = rare.join(counts, "h").groupBy("row_id").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("gain"), F.sum("n").alias("found"))
    gain = F.coalesce("gain", F.lit(0.0))
    return partial.join(gains, "row_id", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        (F.col("base") + gain).alias("base_score"),
        (F.col("score") + gain).alias("score"),
    )


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from those outside fold 2 of 7."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = fold_of(F.col("doc_id"), 7)
    model, counts = train(docs.where(fold != 2))
    scored = score_documents(docs, model, counts)
    return scored.select(
        "doc_id", (fold == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
