"""Benchmark decontamination with DataFrame operations only.

The benchmark's word windows are broadcast as a hash table, in blocks of bounded size, keyed by the hash of one
anchor word of each window (its longest). One pass over the documents splits each text into words,
looks every word up, and verifies a hit by comparing the whole window with the words around the anchor. Only
verified hits are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelloom.llm.common import LOWER, UPPER, row_key, same_row, table

#: ASCII characters that are neither letters nor digits separate words.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Most windows in one broadcast block; at 10 words a window that is some tens of MB.
BLOCK_WINDOWS = 200_000


def split_words(text: Column) -> Column:
    """Words of a text, their case unchanged; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def benchmark_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """`(item, window, len, offset, anchor, head)`: each distinct window of each item.

    `window` is the words joined by spaces, `offset` the anchor's place in it; `anchor` and `head`
    are hashes of the anchor word and the first word.
    """
    words = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        split_words(F.translate("text", UPPER, LOWER)).alias("words"),
    ).where(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(width))
    starts = words.select("item", "words", n.alias("len"), F.explode(F.sequence(F.lit(1), F.size("words") - n + 1)).alias("start"))
    cut = starts.select("item", "len", F.slice("words", F.col("start"), F.col("len")).alias("w"))
    longest = F.array_max(F.transform("w", lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"))))["i"]
    placed = cut.withColumn("offset", -longest)
    word_hash = lambda at: F.xxhash64(F.lower(F.get("w", at)))
    return placed.select(
        "item", F.array_join("w", " ").alias("window"), "len", "offset", word_hash(F.col("offset")).alias("anchor"), word_hash(F.lit(0)).alias("head")
    ).distinct()


def _hits(words: DataFrame, windows: DataFrame) -> DataFrame:
    """Every occurrence of a window: `(doc_id, row_key, start, len, item)`. `windows` is small enough to broadcast."""
    placed = words.select("doc_id", "row_key", "words", F.posexplode("words").alias("pos", "word"))
    hashed = placed.withColumn("anchor", F.xxhash64(F.lower("word")))
    start = F.col("pos") - F.col("offset")
    inside = (start >= 0) & (start + F.col("len") <= F.size("words"))
    head = F.xxhash64(F.lower(F.get("words", start))) == F.col("head")
    text = F.translate(F.array_join(F.slice("words", start + 1, F.col("len")), " "), UPPER, LOWER)
    found = hashed.join(F.broadcast(windows), "anchor").where(inside & head).where(text == F.col("window"))
    return found.select("doc_id", "row_key", start.alias("start"), "len", "item").distinct()


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """`(doc_id, row_key, spans, n_hit, items)` of the documents that hold a window of an item.

    `spans` are the hit stretches, as sorted `(start, end)` word places without overlap; `items` the sorted ids as strings.
    A benchmark of more than `BLOCK_WINDOWS` windows is searched in as many blocks as that takes.
    """
    windows = benchmark_windows(benchmark, width)
    words = docs.select("doc_id", row_key().alias("row_key"), split_words(F.col("text")).alias("words"))
    blocks = max(1, -(-windows.count() // (BLOCK_WINDOWS // 2)))
    hits = None
    for block in range(blocks):
        some = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block) if blocks > 1 else windows
        found = _hits(words, some)
        hits = found if hits is None else hits.unionByName(found)
    row = ["doc_id", "row_key"]
    reach = hits.groupBy(*row, "start").agg((F.col("start") + F.max("len")).alias("end"), F.collect_set("item").alias("items"))
    before = Window.partitionBy(*row).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*row).orderBy("start")
    apart = reach.withColumn("fresh", F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int"))
    spans = apart.withColumn("span", F.sum("fresh").over(so_far)).groupBy(*row, "span").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )
    return spans.groupBy(*row).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"),
        F.sum(F.col("end") - F.col("start")).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "mark", width: int = 10) -> DataFrame:
    """Mark, cut or remove documents that hold benchmark passages.

    Words are runs of ASCII letters, ASCII digits and non-ASCII characters, A-Z lower-cased. A window is `width` consecutive words of an item,
    or the whole item if it has fewer, but not none. A document word inside any occurrence of a window is hit.

    mode `mark`: all rows with `n_words`, `n_hit`, `items` (sorted ids as strings) and `contaminated`. `documents`: the rows
    without a hit, columns unchanged. `spans`: all rows; in `text` each hit stretch of words goes, with the separators
    inside it, and what is left is joined by one space.

    Null texts have no words and no hits. A null item id is the id ''; items with the same id count once. Rows that repeat
    are judged one by one, also with equal or null doc_id. Other columns pass through but for those named here, which are
    replaced, and `row_key` and `spans`, which are left out. Empty tables are fine on both sides.
    """
    made = ["n_words", "n_hit", "items", "contaminated", "row_key", "spans"]
    docs = docs.drop(*made)
    found = find_contamination(docs, benchmark, width)
    keyed = docs.withColumn("row_key", row_key())
    if mode == "documents":
        return keyed.join(found, same_row(keyed, found), "left_anti").select(*docs.columns)
    joined = keyed.join(found, same_row(keyed, found), "left").select(*[keyed[c] for c in docs.columns], "spans", "n_hit", "items")
    if mode == "mark":
        return joined.select(
            *docs.columns,
            F.size(split_words(F.col("text"))).cast("long").alias("n_words"),
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
            F.col("n_hit").isNotNull().alias("contaminated"),
        )
    if mode != "spans":
        raise ValueError(f"unknown mode {mode!r}")
    outside = F.filter(
        split_words(F.col("text")), lambda _, i: ~F.exists("spans", lambda s: (i >= s["start"]) & (i < s["end"]))
    )
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(outside, " "))
    return joined.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns])


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document. The word counts come from a pass of their own, so no text is shuffled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    thin = docs.select("doc_id", row_key().alias("row_key"), F.size(split_words(F.col("text"))).cast("long").alias("n_words"))
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    joined = thin.join(found, same_row(thin, found), "left").select(thin["doc_id"], "n_words", "n_hit", "items")
    items = F.coalesce("items", F.expr("cast(array() as array<string>)"))
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


SQL = r"""
WITH item AS (
    SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), win AS (
    SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win
    FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM item WHERE len(w) > 0)
), doc AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), lens AS (
    SELECT DISTINCT n FROM win
), spot AS (
    SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM doc, lens WHERE len(w) >= n)
), hit AS (
    SELECT DISTINCT a.doc_id, a.s, a.n, b.item FROM spot a JOIN win b ON a.win = b.win AND a.n = b.n
), words AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
    sha256(coalesce(i.ids, '')) AS items_sha256, h.n_hit IS NOT NULL AS contaminated
FROM doc d LEFT JOIN words h ON d.doc_id = h.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
"""
