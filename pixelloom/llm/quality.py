"""Quality rules: document statistics, fixed limits, and boosted trees over the statistics.

The trees learn from labelled documents (a bounded sample, `SAMPLE_ROWS`) and are broadcast as flat numpy arrays; statistics and
scores of all documents are computed in Arrow batches without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelloom.llm import boosting
from pixelloom.llm.common import table

#: Most labelled rows that the trees are fitted on: those with the smallest hashes of doc_id.
SAMPLE_ROWS = 20_000
#: Documents that the trees find good with less than this probability are rejected.
LEAST_GOOD = 0.35

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Features and whether the score may only rise (1) or fall (-1) with them.
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "digit_share": 0,
    "mark_share": -1,
    "distinct_share": 0,
    "run_share": -1,
    "line_words": 0,
    "stop_share": 0,
}
MONOTONE = np.array(list(FEATURES.values()))
_UPPER, _DIGIT, _MARK = (bytes(b for b in range(256) if chr(b) in kept) for kept in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!?|*#"))


def _repeated(words: list) -> int:
    """Words covered by 3-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered = bytearray(len(words))
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered[i] = covered[i + 1] = covered[i + 2] = 1
    return sum(covered)


def text_stats(text: bytes | None) -> tuple[list[int], list[float]]:
    """The five statistics and the features of a UTF-8 text; null has no words."""
    text = text or b""
    words = text.split()  # bytes: ASCII white space only
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) - len(joined.translate(None, bytes(range(0x80, 0xC0))))
    chars = len(joined) - chars  # continuation bytes don't count
    symbols = len(text) - len(text.translate(None, SYMBOLS.encode()))
    lines = [line for line in text.split(b"\n") if line.split(None, 1)]
    dup_lines = len(lines) - len(set(lines))
    repeat = _repeated(words)
    share = lambda kept: (len(joined) - len(joined.translate(None, kept))) / max(1, chars)
    same = sum(map(bytes.__eq__, words, words[1:]))
    features = [
        np.log1p(n),
        chars / max(1, n),
        symbols / max(1, chars),
        dup_lines / max(1, len(lines)),
        repeat / max(1, n),
        share(_UPPER),
        share(_DIGIT),
        share(_MARK),
        len(set(words)) / max(1, n),
        same / max(1, n),
        n / max(1, len(lines)),
        sum(1 for w in words if len(w) < 4) / max(1, n),
    ]
    return [n, chars, symbols, dup_lines, repeat], features


def _measure(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    found = [text_stats(t.as_py()) for t in texts]
    stats = np.array([s for s, _ in found], np.int64).reshape(-1, len(STATS))
    return stats, np.array([f for _, f in found], np.float64).reshape(-1, len(FEATURES))


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> boosting.Trees:
    """Trees for P(quality = 1), from at most `sample_rows` labelled documents. Labels that are null or conflict in one doc_id are left out.

    doc_id may be of any type that sorts. Of several texts of one doc_id the one with the smallest hash counts, so the trees depend on the rows only.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("y_max"))
    sample = known.where("y = y_max").select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, features = _measure(batch.column("text"))
            columns = [batch.column("doc_id"), batch.column("y").cast(pa.float64()), *(pa.array(c) for c in features.T)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "y", *FEATURES])

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(sample), "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, y double, " + ", ".join(f"{name} double" for name in FEATURES)
    one = texts.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.sha2("text", 256))).alias("text"))
    rows = one.mapInArrow(measure, schema).toPandas().sort_values("doc_id")
    return boosting.fit(rows[list(FEATURES)].to_numpy(), rows["y"].to_numpy(), MONOTONE)


def quality_rules(docs: DataFrame, trees: boosting.Trees, least_good: float = LEAST_GOOD, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """`docs` with the five statistics, `base_failed`, `p_good` and `kept`.

    A document fails the base rules with fewer than `min_words` words, or more than `max_repeat` percent of its words in
    repeated windows; else it is kept if the trees give it `least_good` or more. Null and empty texts have no words and fail. Rows are judged one by one,
    repeated ones alike. Other columns pass through but for those named here, which are replaced.
    """
    made = [*STATS, "base_failed", "p_good", "kept"]
    docs = docs.drop(*made)
    names, model = docs.columns, docs.sparkSession.sparkContext.broadcast(trees)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats, features = _measure(batch.column("text").cast(pa.large_binary()))
            good = model.value.probability(features)
            failed = (stats[:, 0] < min_words) | (100 * stats[:, 4] > max_repeat * stats[:, 0])
            columns = [*(pa.array(c) for c in stats.T), pa.array(failed), pa.array(good), pa.array(~failed & (good >= least_good))]
            kept = [batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays([*kept, *columns], [*names, *made])

    types = [T.LongType()] * len(STATS) + [T.BooleanType(), T.DoubleType(), T.BooleanType()]
    return docs.mapInArrow(judge, T.StructType([*docs.schema.fields, *map(T.StructField, made, types)]))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality_rules(docs, trees).select("doc_id", *STATS, "base_failed", "kept")
