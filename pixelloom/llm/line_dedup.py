"""Drop lines that many documents share; DataFrame operations only.

Occurrences of lines are kept as two 64-bit hashes with document and position, never as text. They are
range-partitioned on hash and document, so that a line of a third of all documents spreads over many partitions, and sorted there by
document and position. A running row number over that order lets only the first occurrence of each hash in a document through; as
a hash and document are never in two partitions, nothing has to be carried over their borders. First occurrences collapse
into counts before the next shuffle. What goes back to the documents is a bitmap of dropped lines: one long for every 64
lines up to the last that is dropped, built from runs of zeros and the words that aren't zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelloom.llm.common import WHITE_SPACE, fold_case, row_key, same_row, table
from pixelloom.plans.storage import write_shared


def _lines():
    return F.split(F.coalesce("text", F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """`(h1, h2, doc_id, row_key, pos)` of every line whose key has `min_chars` code points or more."""
    lines = docs.select("doc_id", row_key().alias("row_key"), F.posexplode(_lines()).alias("pos", "line"))
    stripped = lines.withColumn("line", F.trim("line", F.lit(WHITE_SPACE))).where(F.char_length("line") >= min_chars)
    keyed = stripped.withColumn("line", fold_case(F.col("line")))
    return keyed.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"), "doc_id", "row_key", "pos")


def first_occurrences(occurrences: DataFrame) -> DataFrame:
    """The first of each hash in each document, streamed from sorted range partitions."""
    ranged = occurrences.repartitionByRange("h1", "h2", "doc_id")
    place = F.row_number().over(Window.partitionBy("h1", "h2", "doc_id").orderBy("pos"))
    return ranged.withColumn("place", place).where(F.col("place") == 1).drop("place")


def drop_bitmaps(occurrences: DataFrame, min_docs: int) -> DataFrame:
    """`(doc_id, row_key, dropped array<bigint>, n_dropped)` for the documents that lose lines; bit k of word w is line 64 w + k."""
    first = first_occurrences(occurrences)
    shared = first.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= min_docs)
    shared = write_shared(shared, "shared-lines")  # straight from a table, so that adaptive execution can split the join of a hot line
    lost = occurrences.join(shared, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    row = ["doc_id", "row_key"]
    words = lost.groupBy(*row, F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, pos % 64))").alias("bits"))
    gap = F.col("word") - F.coalesce(F.lag("word").over(Window.partitionBy(*row).orderBy("word")), F.lit(-1)) - 1
    runs = words.withColumn("gap", gap).groupBy(*row).agg(
        F.array_sort(F.collect_list(F.struct("word", "gap", "bits"))).alias("runs"), F.sum(F.bit_count("bits")).alias("n_dropped")
    )
    dense = F.flatten(F.transform("runs", lambda r: F.concat(F.array_repeat(F.expr("0L"), r["gap"]), F.array(r["bits"]))))
    return runs.select(*row, dense.alias("dropped"), "n_dropped")


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """The documents with `n_lines`, `n_dropped` and `kept_text`, one row for each row of `docs`.

    A text is split at \\n; a line's key is the line stripped of white space at both ends with A-Z in lower case.
    Keys of `min_chars` code points or more in `min_docs` documents or more lose all their lines but those in the
    largest doc_id. A null text counts as empty: one empty line, kept. A null doc_id is a document of its own,
    smaller than all others. Rows that share a doc_id are one document for the counts, yet keep their own texts.
    Other columns pass through, whatever their names, but for `n_lines`, `n_dropped` and `kept_text`, which are replaced,
    and `row_key`, which is left out. An empty table gives an empty result.
    """
    docs = docs.drop("n_lines", "n_dropped", "kept_text", "row_key")
    occurrences = write_shared(line_hashes(docs.select("doc_id", "text"), min_chars), "lines")
    maps = drop_bitmaps(occurrences, min_docs)
    keyed = docs.withColumn("row_key", row_key())
    joined = keyed.join(maps, same_row(keyed, maps), "left").select(*[keyed[c] for c in keyed.columns], "dropped", maps["n_dropped"])

    def stays(_, i):
        bits = F.get("dropped", F.floor(i / 64).cast("int"))
        return bits.isNull() | (F.expr("1L").bitwiseAND(F.call_function("shiftrightunsigned", bits, (i % 64).cast("int"))) == 0)

    kept = F.when(F.col("dropped").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.filter(_lines(), stays), "\n"))
    return joined.select(
        *docs.columns,
        F.size(_lines()).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("kept_text"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup of all documents; the text is given by its SHA-256."""
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH split AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
    SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line
), shared AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT k.*, (s.key IS NOT NULL AND k.doc_id <> s.keeper) AS dropped FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
