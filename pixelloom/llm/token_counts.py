"""Token counts through a cache of digests.

A text's digest is looked up with the tokenizer's digest among stored counts. Only digests without a count are encoded, each once, and their
counts are appended to the cache. Copies of one text collapse before the shuffle that brings the misses together.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm.common import table
from pixelloom.plans.storage import new_path, write_shared

SCHEMA = "digest binary, version string, n_tokens bigint"
#: Texts of these characters, without long unbroken runs, are split alike by both libraries; all others go to the reference library.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ]*\Z")
_RUN = re.compile(r"\S{400}|\s{400}")


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class Counter:
    """Counts the tokens of texts as the `tokenizers` library does for a .json file, or `sentencepiece` for a .model.

    `ranks`, if given, names a file with the same vocabulary as ranks: plain texts are then encoded by `tiktoken`,
    which gives the same tokens several times faster. Null counts as the empty text.
    """

    def __init__(self, path: str, ranks: str | None, pattern: str | None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.fast = None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.full = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.special = [str(x.content) for x in tokenizer.get_added_tokens_decoder().values()]
        self.full = lambda texts: [len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    def count(self, texts: list[str | None]) -> list[int]:
        texts = [t or "" for t in texts]
        counts = [0] * len(texts)
        rest = []
        for i, text in enumerate(texts):
            if self.fast is None or not _PLAIN.match(text) or _RUN.search(text) or any(s in text for s in self.special):
                rest.append(i)
            else:
                counts[i] = len(self.fast.encode_ordinary(text))
        for i, n in zip(rest, self.full([texts[i] for i in rest]) if rest else [], strict=True):
            counts[i] = n
        return counts


@cache
def _counter(path: str, ranks: str | None, pattern: str | None) -> Counter:
    return Counter(path, ranks, pattern)


def _digest():
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; a cache that was never written is empty."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(SCHEMA).parquet(path) if exists else spark.createDataFrame([], SCHEMA)


def count_tokens(docs: DataFrame, tokenizer: str, cache_path: str, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """`docs` with `n_bytes` and `n_tokens`; counts that `cache_path` lacks are encoded and appended to it.

    `tokenizer` (and `ranks`) are files that every executor has. The content is normalised in so far as null becomes empty; a tokenizer tells all
    other differences apart, so nothing else may be folded. Each distinct text is encoded once, however often it
    repeats. Counts of other tokenizer versions in the cache are ignored. A count written twice by jobs that ran side by side is the same
    twice and is read once. Other columns pass through but for `n_bytes`, `n_tokens` and `digest`, which are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_bytes", "n_tokens", "digest")
    version = hashlib.sha256("|".join(file_digest(p) for p in (tokenizer, ranks) if p).encode()).hexdigest()

    def stored() -> DataFrame:
        return read_cache(spark, cache_path).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _counter(tokenizer, ranks, pattern).count(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([version] * len(counts)), pa.array(counts, pa.int64())], ["digest", "version", "n_tokens"])

    distinct = docs.select(_digest().alias("digest"), F.coalesce("text", F.lit("")).alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(stored(), "digest", "left_anti").select("digest", "text")
    misses.mapInArrow(encode, SCHEMA).write.mode("append").parquet(cache_path)
    keyed = docs.withColumn("digest", _digest()).withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    counts = write_shared(stored(), "counts")  # straight from a table, so that adaptive execution can split the join of a hot text
    return keyed.join(counts, "digest").drop("digest")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents. The cache is a new one, so the query shows the cost of a first run."""
    import public_tokenizers as vocabularies

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cache_path = new_path(spark, "token-counts")
    counted = count_tokens(docs, vocabularies.path("byte_bpe_50k.json"), cache_path, vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
