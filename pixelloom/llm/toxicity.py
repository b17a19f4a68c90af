"""Toxicity by two Kneser-Ney language models, one of toxic and one of ordinary documents.

Each class has word and word-pair counts of its own, but an expression keeps them only where the numbers of documents that hold it tell
the classes apart (`LEAST_APART`); it is then untied. Discounted counts of untied pairs back off to words, those of untied words to
word beginnings: the mass that a class has left is shared out over the longest untied beginning (`BEGINNINGS`) of a word, or none, by
the class's counts of tied words, smoothed towards both classes'. What happens inside a beginning is the same for both classes: words share it by pooled counts
and by how many words they follow. So a rare word, a language or a topic that the sample happens to favour weighs the same on
both sides unless its beginning tells the classes apart. Either class's model sums to one after every word.

Only untied expressions and their contexts are in the model. Each is held by a dozen sampled documents at least, so they are fewer than a twelfth
of the sample's expressions; none is cut. A document's evidence is the difference of the two log-likelihoods, divided by its length; a
logistic curve, fitted on labelled documents that the counts don't hold, makes it a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm.common import table
from pixelloom.llm.tokens import batch_words, combine, text_bytes
from pixelloom.plans.storage import write_shared

#: Most labelled documents of each class that are counted, and that the curve is fitted on: those with the smallest hashes of doc_id.
SAMPLE_ROWS = 6_000
CURVE_ROWS = 3_000
#: Least likelihood-ratio statistic of an expression's document counts for it to have counts of its own.
LEAST_APART = 16.0
#: Where no expression reaches that, as with few labels, the next of these that any reaches takes its place.
LESS_APART = (8.0, 4.0, 2.0)
#: Slope of the curve where its documents don't give one that rises: evidence then still ranks.
PLAIN_SLOPE = 10.0
#: Letters (code points) of a word's beginnings that are counted as expressions of their own.
BEGINNINGS = (4, 5, 6, 7, 8)
DISCOUNT = 0.75
#: Tied words that the pooled shares of beginnings weigh as in a class's own.
SHARED = 50.0
#: Share of toxic documents that the score supposes, whatever their share among the labels.
CURVE_SHARE = 0.2
#: Bytes of text that are split and scored at once.
CHUNK = 1 << 20


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text modulo `folds`; null is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[pa.Array]:
    """The column in slices of about `size` bytes, at least one text each."""
    if not len(column):
        return
    offsets = text_bytes(column)[1]
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1)
        yield column.slice(start, stop - start)
        start = stop


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted hash in sorted `keys`, or the last place, which is spare."""
    if len(keys) == 1:
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys[:-1], wanted), len(keys) - 2)
    return np.where(keys[at] == wanted, at, len(keys) - 1)


def _pairs(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word with the one before it, and of the one before; a text's first word follows 0."""
    before = np.concatenate([np.zeros(1, np.uint64), words[:-1]])
    before[offsets[:-1][offsets[:-1] < len(words)]] = 0
    return combine(before, words), before


@dataclass
class KneserNey:
    """Both classes' models as arrays in the order of sorted hashes, each with a spare last entry for what is not in them."""

    words: np.ndarray  # untied
    word_log: np.ndarray  # 2 x n: log P_c(w)
    stems: np.ndarray  # untied beginnings; the spare entry is none
    stem_log: np.ndarray  # 2 x n: log of the mass of a beginning; all of its words have the same share of it in both classes
    contexts: np.ndarray  # first words of untied pairs
    rest_log: np.ndarray  # 2 x n: log of the mass that a context leaves to the backoff
    pairs: np.ndarray  # untied
    pair_p: np.ndarray  # 2 x n: the discounted share of the pair in its context
    pair_word: np.ndarray  # 2 x n: P_c of the pair's second word
    slope: float = 0.0
    level: float = -2.0

    def evidence(self, column: pa.Array) -> np.ndarray:
        """Mean over words of log P_toxic - log P_ordinary for each text, less that of a word without untied beginning; 0 without words."""
        out, plain = [], self.stem_log[1][-1] - self.stem_log[0][-1]
        for part in chunks(column):
            found = batch_words(part, marks=False)
            keys, before = _pairs(found.hashes, found.offsets)
            w, v, p = _find(self.words, found.hashes), _find(self.contexts, before), _find(self.pairs, keys)
            stem = np.full(len(w), len(self.stems) - 1)
            for n in BEGINNINGS:  # longer ones last, so that they prevail
                at = _find(self.stems, found.beginnings(n))
                stem = np.where(at < len(self.stems) - 1, at, stem)
            own, paired = w < len(self.words) - 1, p < len(self.pairs) - 1
            single = [np.where(own, self.word_log[c][w], self.stem_log[c][stem]) for c in (0, 1)]
            ratio = single[1] - single[0] + self.rest_log[1][v] - self.rest_log[0][v]
            at, of = p[paired], v[paired]
            logs = [np.log(self.pair_p[c][at] + np.exp(self.rest_log[c][of]) * self.pair_word[c][at]) for c in (0, 1)]
            ratio[paired] = logs[1] - logs[0]
            sums = np.concatenate([[0.0], np.cumsum(ratio)])
            n = np.diff(found.offsets)
            out.append((sums[found.offsets[1:]] - sums[found.offsets[:-1]]) / np.maximum(n, 1) - np.where(n > 0, plain, 0))
        return np.concatenate(out) if out else np.empty(0)

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.level + self.slope * self.evidence(column), -40, 40)))


def apart(held0: Column, held1: Column, docs0: int, docs1: int) -> Column:
    """Likelihood-ratio statistic of the numbers of documents, by class, that hold an expression."""
    held, docs = held0 + held1, docs0 + docs1
    part = lambda seen, of, n: F.when(seen > 0, seen * F.log(seen * docs / (of * n))).otherwise(0.0)
    cells = [(held0, held, docs0), (held1, held, docs1), (F.lit(docs0) - held0, F.lit(docs) - held, docs0), (F.lit(docs1) - held1, F.lit(docs) - held, docs1)]
    return 2 * sum((part(*cell) for cell in cells[1:]), part(*cells[0]))


def _sorted(table: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    order = np.argsort(table["h"])
    return {k: a[order] for k, a in table.items()}


def _log(x: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(x, 1e-300))


def estimate(words: dict[str, np.ndarray], stems: dict[str, np.ndarray], seconds: dict[str, np.ndarray], pairs: dict[str, np.ndarray], totals: dict[str, float]) -> KneserNey:
    """Kneser-Ney estimates from what is untied, and totals of all.

    words: h, c0, c1 (counts by class), left (distinct words before it, both classes). stems: h, t0, t1 (counts of the tied words whose longest untied beginning it is).
    seconds, the tied second words of untied pairs: h, stem (0: none), inside (their share of the stem). pairs: h, v, w, c0, c1, n0, n1 (counts of v).
    totals: c0, c1 (all words), t0, t1 (tied words without untied beginning), left (sum over untied words).
    """
    words, stems, seconds, pairs = map(_sorted, (words, stems, seconds, pairs))
    total = [totals["c0"], totals["c1"]]
    share = [np.maximum(words[f"c{c}"] - DISCOUNT, 0) / max(total[c], 1) for c in (0, 1)]
    left = [max(1 - share[c].sum(), 1e-9) for c in (0, 1)]
    # untied words and beginnings share what is left: the former as much of it as in both classes together
    tied = [np.append(stems[f"t{c}"], totals[f"t{c}"]) + 0.0 for c in (0, 1)]
    pooled = tied[0] + tied[1] + 1.0
    own = DISCOUNT * len(words["h"]) / max(DISCOUNT * len(words["h"]) + pooled.sum(), 1)
    spread = (words["left"] + 1) / max(totals["left"] + len(words["h"]), 1)
    mass = [(tied[c] + SHARED * pooled / pooled.sum()) / (tied[c].sum() + SHARED) * (1 - own) for c in (0, 1)]
    word_p = np.stack([np.append(share[c] + left[c] * own * spread, 1.0) for c in (0, 1)])
    stem_p = np.stack([left[c] * mass[c] for c in (0, 1)])
    spare = lambda a: np.append(a, np.zeros(1, a.dtype))
    heads, tops, tails = spare(words["h"]), spare(stems["h"]), spare(seconds["h"])
    w, second = _find(heads, pairs["w"]), _find(tails, pairs["w"])
    inside, of = np.append(seconds["inside"], 0.0)[second], _find(tops, spare(seconds["stem"])[second])
    contexts, context = np.unique(pairs["v"], return_inverse=True)
    pair_p, rest = np.zeros((2, len(w) + 1)), np.ones((2, len(contexts) + 1))
    pair_word = np.ones((2, len(w) + 1))
    for c in (0, 1):
        pair_p[c][:-1] = np.maximum(pairs[f"c{c}"] - DISCOUNT, 0) / np.maximum(pairs[f"n{c}"], 1)
        rest[c][:-1] = 1 - np.bincount(context, pair_p[c][:-1], len(contexts))
        pair_word[c][:-1] = np.where(w < len(heads) - 1, word_p[c][w], stem_p[c][of] * inside)
    return KneserNey(heads, _log(word_p), tops, _log(stem_p), spare(contexts), _log(rest), spare(pairs["h"]), pair_p, pair_word)


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and level of a logistic curve, by Newton steps with a light penalty; the toxic weigh `CURVE_SHARE`."""
    if not len(y) or y.min() == y.max():
        return PLAIN_SLOPE, -2.0
    low, high = (float(np.median(x[y == c])) for c in (0, 1))
    scale, middle = max(abs(high - low), 0.02), (low + high) / 2
    design = np.stack([np.clip((x - middle) / scale, -3, 3), np.ones(len(x))], axis=1)
    weight = np.where(y == 1, CURVE_SHARE / (y == 1).sum(), (1 - CURVE_SHARE) / (y == 0).sum()) * len(y)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        grad = design.T @ (weight * (y - p)) - np.array([0.01, 0.0]) * beta
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([0.01, 1e-6])
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    if beta[0] <= 0:
        return PLAIN_SLOPE, -2.0
    return float(beta[0] / scale), float(beta[1] - beta[0] * middle / scale)


def _sample(labels: DataFrame, folds: list[int], rows: int) -> DataFrame:
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
    known = known.where("toxic = most").where(fold_of(F.col("doc_id"), 4).isin(folds)).select("doc_id", "toxic")
    pick = lambda y: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return pick(1).unionByName(pick(0))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (kind 0), pairs (1) and beginnings (2), and of the documents that hold them, by class, summed within each chunk.

    `v`, `w`: a pair's words; `stems`: a word's beginnings from the longest down.
    """
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        done = 0
        for part in chunks(batch.column("text")):
            found = batch_words(part, marks=False)
            owner = found.owner()
            side = toxic[done : done + len(part)]
            done += len(part)
            keys, before = _pairs(found.hashes, found.offsets)
            heads = np.stack([found.beginnings(n) for n in BEGINNINGS])
            whose = np.tile(np.arange(len(found.hashes)), len(BEGINNINGS))[heads.ravel() != 0]
            everything = np.arange(len(found.hashes))
            for kind, hashes, token in ((0, found.hashes, everything), (1, keys, everything), (2, heads.ravel()[heads.ravel() != 0], whose)):
                unique, first, place = np.unique(hashes, return_index=True, return_inverse=True)
                held = np.unique(place * len(part) + owner[token])
                count = lambda at, who: [np.bincount(at, side[who] == c, len(unique)).astype(np.int64) for c in (0, 1)]
                v, w = (before[first], found.hashes[first]) if kind == 1 else (unique, unique)
                columns = [unique.view(np.int64), v.view(np.int64), w.view(np.int64), *count(place, owner[token]), *count(held // len(part), held % len(part))]
                mine = heads[::-1, first].T if kind == 0 else np.zeros((len(unique), 0), np.uint64)
                mine = mine.reshape(len(unique), -1)
                stems = pa.ListArray.from_arrays(pa.array(np.arange(len(unique) + 1) * mine.shape[1], pa.int32()), pa.array(mine.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unique), kind, np.int32)), *map(pa.array, columns), stems], ["kind", "h", "v", "w", "c0", "c1", "d0", "d1", "stems"])


def _longest_stem(words: DataFrame, untied: DataFrame) -> DataFrame:
    """`words` with `stem`: the longest of their `stems` that is in `untied` (h), or 0."""
    each = words.select("h", F.posexplode("stems").alias("place", "stem")).where("stem <> 0")
    found = each.join(untied.select(F.col("h").alias("stem")), "stem", "left_semi").groupBy("h").agg(F.min_by("stem", "place").alias("stem"))
    return words.join(found, "h", "left").withColumn("stem", F.coalesce("stem", F.lit(0)))


def statistics(sums: DataFrame) -> tuple[dict[str, np.ndarray], ...]:
    """The arguments of `estimate` from the counts of all expressions (kind, h, v, w, c0, c1, own, stems)."""
    single, pairs, heads = (sums.where(F.col("kind") == kind) for kind in (0, 1, 2))
    left = pairs.groupBy(F.col("w").alias("h")).agg(F.count("*").alias("left"))
    words = single.select("h", "c0", "c1", "own", "stems").join(left, "h")
    stemmed = write_shared(_longest_stem(words, heads.where("own")).drop("stems"), "stemmed")
    tied, own = stemmed.where("not own"), stemmed.where("own")
    # a tied word's share of its beginning: discounted pooled counts, and the rest by the words that it follows
    stems = tied.groupBy("stem").agg(*(F.sum(c).alias(c) for c in ("c0", "c1", "left")), F.count("*").alias("n"))
    untied = pairs.where("own").select("h", "v", "w", "c0", "c1")
    first = single.select(F.col("h").alias("v"), F.col("c0").alias("n0"), F.col("c1").alias("n1"))
    seconds = tied.join(untied.select(F.col("w").alias("h")).distinct(), "h").alias("s").join(stems.alias("a"), "stem")
    pooled, everything = F.col("s.c0") + F.col("s.c1"), F.col("a.c0") + F.col("a.c1")
    inside = (pooled - DISCOUNT + DISCOUNT * F.col("n") * F.col("s.left") / (F.col("a.left") + 1)) / everything
    totals = single.agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).first().asDict()
    loose = tied.where("stem = 0").agg(F.sum("c0").alias("t0"), F.sum("c1").alias("t1")).first().asDict()
    totals |= loose | own.agg(F.sum("left").alias("left")).first().asDict()

    def arrays(df: DataFrame) -> dict[str, np.ndarray]:
        found = {name: c.to_numpy() for name, c in zip(df.columns, df.toArrow().columns, strict=True)}
        return {name: c.view(np.uint64) if name in ("h", "v", "w", "stem") else c for name, c in found.items()}

    return (
        arrays(own.select("h", "c0", "c1", "left")),
        arrays(stems.where("stem <> 0").select(F.col("stem").alias("h"), F.col("c0").alias("t0"), F.col("c1").alias("t1"))),
        arrays(seconds.select("s.h", "stem", inside.alias("inside"))),
        arrays(untied.join(first, "v", "left").na.fill(0, ["n0", "n1"])),
        {k: float(x or 0) for k, x in totals.items()},
    )


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, curve_rows: int = CURVE_ROWS) -> KneserNey:
    """Fit on the labelled documents of folds 0, 1 (counts) and 3 (curve) of 4; fold 2 is never looked at.

    Labels that are null or conflict in one doc_id are left out. Without labels of both classes all scores are alike.
    """
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    sample = _sample(labels, [0, 1], sample_rows)
    docs0, docs1 = (sample.where(F.col("toxic") == c).count() for c in (0, 1))
    counted = texts.join(F.broadcast(sample), "doc_id").select("text", "toxic")
    schema = "kind int, h bigint, v bigint, w bigint, c0 bigint, c1 bigint, d0 bigint, d1 bigint, stems array<bigint>"
    one = [F.first(c).alias(c) for c in ("v", "w", "stems")]
    sums = counted.mapInArrow(_count, schema).groupBy("kind", "h").agg(*one, *(F.sum(c).alias(c) for c in ("c0", "c1", "d0", "d1")))
    sums = write_shared(sums.withColumn("apart", apart(F.col("d0"), F.col("d1"), docs0, docs1)), "expressions")
    levels = (LEAST_APART, *LESS_APART)
    reach = sums.agg(*(F.count_if(F.col("apart") >= level).alias(f"n{i}") for i, level in enumerate(levels))).first()
    least = next((level for level, n in zip(levels, reach, strict=True) if n), LEAST_APART)
    model = estimate(*statistics(sums.withColumn("own", F.col("apart") >= least).drop("apart")))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(held.value.evidence(batch.column("text"))), batch.column("toxic").cast(pa.int32())], ["x", "y"])

    curve = texts.join(F.broadcast(_sample(labels, [3], curve_rows)), "doc_id").select("text", "toxic")
    points = curve.mapInArrow(weigh, "x double, y int").toPandas().sort_values(["x", "y"])
    model.slope, model.level = fit_curve(points["x"].to_numpy(), points["y"].to_numpy())
    return model


def score_toxicity(docs: DataFrame, model: KneserNey, threshold: float = 0.3) -> DataFrame:
    """`(doc_id, score, predicted)` for each row of `docs`, in order of evidence per word, whatever the length.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z as a-z, of the whole text. Null, empty and blank texts have no evidence: they get the
    curve's value at zero. Rows that repeat get the same score. Other columns are not looked at.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = held.value.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside fold 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
