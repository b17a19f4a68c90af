"""Near-duplicates by SimHash fingerprints, compared exactly in tiles.

Distinct fingerprints are sorted into tiles by the population counts of their parts: four of 16 bits, eight of 8, or sixteen of 4, the more the
more fingerprints there are, which changes the tiles' sizes but not the links. Two fingerprints
within the radius have counts whose differences sum to the radius at most, so only tile pairs that close meet; all others are
skipped without looking inside. A crowded tile is cut into blocks by hash. Pairs of blocks are found by their numbers; only for pairs that
exist do the fingerprints meet, and are compared whole with numpy: exclusive-or, bit counts, threshold. Each pair of blocks returns a spanning
forest of its links instead of the links, so a dense group costs no more rows than it has members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm.common import row_key, table
from pixelloom.plans.components import connected_components
from pixelloom.plans.storage import write_shared

#: Parts whose bit counts make a tile, and the most fingerprints for which they are taken. Random bits leave 1.4 %, 0.03 % and 0.0001 % of all pairs.
PARTS = ((4, 2_000_000), (8, 1_000_000_000), (16, None))
#: Fingerprints in a block; two blocks make a comparison of 8 MB.
BLOCK = 1024


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """Hashes of the word shingles of a UTF-8 text, repeats included; all words are one shingle if there are fewer."""
    words = text.lower().split() if text else []  # bytes: A-Z only, ASCII white space only
    if not words:
        return np.empty(0, "<u8")
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, 42) for s in shingles), "<u8", max(1, len(words) - shingle + 1))


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """SimHash of the word shingles of a UTF-8 text; 0 if it has no words."""
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprint_of(hashes: np.ndarray) -> int:
    """SimHash of the hashes of a text's shingles."""
    ones = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        some = hashes[part : part + (1 << 16)]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """`(doc_id, row_key, fp)` for each row; `fp` is the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64)
            keys = [batch.column("doc_id"), batch.column("row_key")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(found.view(np.int64))], ["doc_id", "row_key", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", row_key().alias("row_key"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, row_key bigint, fp bigint")


def _base(parts: int, radius: int) -> int:
    """Base of a signature's digits, in which steps within the radius don't carry."""
    return 64 // parts + 2 * radius + 1


def _signature(fp: Column, parts: int, radius: int) -> Column:
    """The parts' bit counts as digits, each raised by the radius."""
    bits, base = 64 // parts, _base(parts, radius)
    digit = lambda k: F.bit_count(F.shiftrightunsigned(fp, bits * k).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))).cast("long") + radius
    return sum((digit(k) * F.lit(base**k).cast("long") for k in range(1, parts)), digit(0))


def _steps(parts: int, radius: int) -> list[int]:
    """Differences of signatures within the radius, one of each opposite pair."""
    near = [()]
    for _ in range(parts):
        near = [(*d, x) for d in near for x in range(-radius, radius + 1) if sum(map(abs, d)) + abs(x) <= radius]
    return [sum(x * _base(parts, radius) ** k for k, x in enumerate(d)) for d in near if d >= (0,) * parts]


def forest(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each linked id with the smallest id of its local component. `left`, `right`: places in `ids` that are linked."""
    used, ends = np.unique(np.concatenate([left, right]), return_inverse=True)
    known, place = np.unique(ids[used], return_inverse=True)
    a, b = place[ends[: len(left)]], place[ends[len(left) :]]
    label = np.arange(len(known))
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if np.array_equal(label, before):
            moved = label != np.arange(len(known))
            return known[moved], known[label[moved]]


def near_links(distinct: DataFrame, radius: int = 2, parts: int | None = None) -> DataFrame:
    """Links `(u, v)` that connect what fingerprints within `radius` bits connect.

    `distinct` has one row `(fp, node)` for each fingerprint. The links are a spanning set, not all pairs. `parts` is chosen by their
    number if not given.
    """
    if parts is None:
        n = distinct.count()
        parts = next(p for p, most in PARTS if most is None or n <= most)
    signed = distinct.withColumn("sig", _signature(F.col("fp"), parts, radius))
    counts = signed.groupBy("sig").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocks = signed.join(counts, "sig").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    tiles = write_shared(blocks.groupBy("sig", "block").agg(F.collect_list("fp").alias("fps"), F.collect_list("node").alias("nodes")), "tiles")
    steps = F.array(*[F.lit(s).cast("long") for s in _steps(parts, radius)])
    numbers = counts.select("sig", "blocks")
    near = numbers.select(F.col("sig").alias("sig_a"), F.col("blocks").alias("blocks_a"), F.explode(steps).alias("step")).withColumn("sig", F.col("sig_a") + F.col("step"))
    met = near.join(numbers, "sig").select("sig_a", "sig", F.explode(F.sequence(F.lit(0), F.col("blocks_a") - 1)).alias("block_a"), "blocks")
    least = F.when(F.col("sig_a") == F.col("sig"), F.col("block_a")).otherwise(0)
    asked = met.select("sig_a", "block_a", "sig", F.explode(F.sequence(least, F.col("blocks") - 1)).alias("block"))
    left = tiles.select(F.col("sig").alias("sig_a"), F.col("block").alias("block_a"), F.col("fps").alias("fps_a"), F.col("nodes").alias("nodes_a"))
    pairs = asked.join(left, ["sig_a", "block_a"]).join(tiles, ["sig", "block"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = lambda batch, name, i: batch.column(name)[i].values.to_numpy(zero_copy_only=False)
        for batch in batches:
            u, v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i in range(batch.num_rows):
                a, b = column(batch, "fps_a", i).view(np.uint64), column(batch, "fps", i).view(np.uint64)
                close = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
                left, right = np.nonzero(close)
                nodes = np.concatenate([column(batch, "nodes_a", i), column(batch, "nodes", i)])
                right = right + len(a)
                apart = nodes[left] != nodes[right]
                if apart.any():
                    found = forest(nodes, left[apart], right[apart])
                    u.append(found[0])
                    v.append(found[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    return pairs.select("fps_a", "nodes_a", "fps", "nodes").mapInArrow(compare, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """`(doc_id, row_key, fp, component_id)` for each row of `docs`.

    Documents link when their fingerprints differ in `radius` bits or fewer; `component_id` is the smallest doc_id reachable
    over links. Null, empty and blank texts have fingerprint 0 and link like any other. Repeated rows stay. doc_id must be an
    integer; a null one takes part with its text, can't name a component, and gets null where no other id is reachable.
    An empty table gives an empty result. Other columns are not looked at.
    """
    prints = write_shared(fingerprints(docs, shingle), "fingerprints")
    return groups(prints, lambda distinct: near_links(distinct, radius))


def groups(prints: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`prints` (doc_id, row_key, fp) with `component_id`; `links` gives the links `(u, v)` of distinct rows `(fp, node)`."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").cast("long").alias("node"))
    # fingerprints that only null ids have take numbers of their own, which are taken away again at the end
    named = distinct.withColumn("alone", F.col("node").isNull())
    if named.where("alone").limit(1).count():
        top = distinct.agg(F.max("node")).first()[0]
        named = named.withColumn("node", F.coalesce("node", F.lit((top or 0) + 1) + F.monotonically_increasing_id()))
        named = write_shared(named, "nodes")
    found = connected_components(links(named.select("fp", "node")))
    placed = named.join(found, named["node"] == found["node"], "left").select(
        "fp", F.coalesce("component", named["node"]).alias("component_id"), "alone"
    )
    roots = named.where("alone").select(F.col("node").alias("component_id"), F.lit(True).alias("nameless"))
    placed = placed.drop("alone").join(roots, "component_id", "left").select(
        "fp", F.when(F.col("nameless").isNull(), F.col("component_id")).alias("component_id")
    )
    return prints.join(placed, "fp").select("doc_id", "row_key", "fp", "component_id")


def keep_first(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest doc_id; columns unchanged.

    Of several texts of that doc_id the one of the smallest hash stays, and exact repeats of the row only once.
    Rows whose doc_id is null stay only if their group has no other id, one for each text. A column `row_key` is left out.
    """
    return firsts_of(docs, lambda texts: near_duplicates(texts, radius, shingle))


def firsts_of(docs: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of `docs` that `keep_first` keeps of the groups that `find` returns for its doc_id and text."""
    docs = docs.drop("row_key")
    found = find(docs.select("doc_id", "text"))
    firsts = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    named = firsts.where("doc_id is not null").groupBy("doc_id").agg(F.min("row_key").alias("row_key"))
    keep = named.unionByName(firsts.where("doc_id is null").select("doc_id", "row_key").distinct())
    keyed = docs.withColumn("row_key", row_key())
    same = F.coalesce(keyed["doc_id"] == keep["doc_id"], keyed["doc_id"].isNull() & keep["doc_id"].isNull())
    kept = keyed.join(keep, (keyed["row_key"] == keep["row_key"]) & same, "left_semi")
    # repeats of a row: equal id and hash, and for null ids, which a hash alone would have to tell apart, a second hash
    other = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit("second"), "text")).alias("other")
    row = F.struct("doc_id", "row_key", other)
    return kept.withColumn("row_key", row).dropDuplicates(["row_key"]).select(*docs.columns)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
