"""Near copies by SimHash, and by the Jaccard similarity of their word shingles, verified exactly.

SimHash proposes first: the fingerprints of the same shingles are linked in tiles, as operator 1 does, and a group of linked ones is a band of its own. It
reaches a few bits only, and pairs of similarity 0.8 lie up to some 19 bits apart, so min-hash bands propose the rest: texts that agree in all minima of a band meet. A pair of similarity 0.8 meets in none of the 32 bands of 5 with
probability 3e-6. Only texts that meet others have their shingles made again. First each is held against the one member of its bands that
meets most, which joins a group of copies to its original at a cost that grows with the group, not its square. Bands whose members are
not all joined by then are cut into blocks, and all pairs of blocks but those of joined members are compared whole. Each returns a
spanning forest of the pairs that are similar enough. No link is made that isn't verified.

Bands may miss a pair, so prefixes have the last word: two sets of similarity s share one of the first n - ceil(s n) + 1 of their n hashes, in whatever order all hashes are put.
Texts of different groups that share such a hash meet; those whose shared ones leave s within reach are verified. So no pair is lost. Hashes that are common in a sample come last in the order, which
changes how many texts meet, not what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelloom.llm.common import row_key, same_row
from pixelloom.llm.simhash import fingerprint_of, firsts_of, forest, groups, near_links, shingle_hashes
from pixelloom.plans.components import connected_components
from pixelloom.plans.storage import write_shared

BANDS, ROWS = 32, 5
#: Texts, and shingles, in a block.
BLOCK_TEXTS, BLOCK_SHINGLES = 256, 100_000
#: Shingles that are compared at a time.
COLUMNS = 8192
#: Parts in which the rows of one band, tree or star are dealt for a join.
PARTS = 128
#: Texts, about, in which hashes are counted, and in how many of them a hash is common.
SAMPLE_TEXTS, COMMON = 8192, 8

_random = np.random.default_rng(42)
_FACTORS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """Distinct hashes of the word shingles of a UTF-8 text, sorted; all words are one shingle if there are fewer."""
    return np.unique(shingle_hashes(text, shingle))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of minima; none for an empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for part in range(0, len(hashes), 2048):
        mixed = hashes[part : part + 2048, None] * _FACTORS + _OFFSETS
        np.minimum(least, mixed.min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), b) for b, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def set_prints(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """`(doc_id, row_key, fp, simhash, bands)` for each row; `fp` tells sets of shingles apart and is 0 for the empty one; `simhash` is the SimHash of all shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, marks, keys = [], [], []
            for text in batch.column("text"):
                hashes = shingle_hashes(text.as_py(), shingle)
                found = np.unique(hashes)
                marks.append(fingerprint_of(hashes))
                prints.append(xxhash.xxh64_intdigest(found.tobytes(), 42) if len(found) else 0)
                keys.append(bands(found))
            hashed = [pa.array(np.array(numbers, np.uint64).view(np.int64)) for numbers in (prints, marks)]
            columns = [batch.column("doc_id"), batch.column("row_key"), *hashed, pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_key", "fp", "simhash", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", row_key().alias("row_key"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, row_key bigint, fp bigint, simhash bigint, bands array<bigint>")


def similar(a: list[np.ndarray], b: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in `a` and `b` of the sets whose Jaccard similarity is `similarity` or more."""
    size_a, size_b = np.array([len(s) for s in a]), np.array([len(s) for s in b])
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(flat_a, flat_b)
    row_a, row_b = np.repeat(np.arange(len(a)), size_a), np.repeat(np.arange(len(b)), size_b)
    if not len(common):
        return np.empty(0, np.int64), np.empty(0, np.int64)

    def placed(flat, rows):
        at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        here = common[at] == flat
        order = np.argsort(at[here], kind="stable")
        return at[here][order], rows[here][order]

    (at_a, row_a), (at_b, row_b) = placed(flat_a, row_a), placed(flat_b, row_b)
    shared = np.zeros((len(a), len(b)), np.int64)
    for low in range(0, len(common), COLUMNS):
        width = min(COLUMNS, len(common) - low)
        sides = []
        for at, rows, n in ((at_a, row_a, len(a)), (at_b, row_b, len(b))):
            some = slice(*np.searchsorted(at, [low, low + width]))
            side = np.zeros((n, width), np.float32)  # exact: counts stay below 2 ** 24
            side[rows[some], at[some] - low] = 1
            sides.append(side)
        shared += (sides[0] @ sides[1].T).astype(np.int64)
    return np.nonzero(shared + 1e-9 >= similarity * (size_a[:, None] + size_b[None, :] - shared))


def shingle_sets(docs: DataFrame, asked: DataFrame, shingle: int = 5) -> DataFrame:
    """`(node, hashes)`: the shingles of each text that `asked` `(doc_id, row_key, node)` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), shingle).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

    rows = docs.select("doc_id", row_key().alias("row_key"), F.col("text").cast("binary").alias("text"))
    texts = rows.join(asked, same_row(rows, asked)).select("node", "text")
    return write_shared(texts.mapInArrow(run, "node bigint, hashes array<bigint>").dropDuplicates(["node"]), "sets")


def with_facts(rows: DataFrame, facts: DataFrame, on: list[str], row: str = "node") -> DataFrame:
    """`rows` with the one row of `facts` for their `on`; the rows of one `on` are dealt in parts by `row`, so that no task takes them all."""
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(row), F.lit(PARTS)).cast("int"))
    asked = dealt.select(*on, "part").distinct().join(facts, on)
    return dealt.join(asked, [*on, "part"]).drop("part")


def star_links(stars: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs `(u, v)` of `stars` that are similar enough. A `v` with many `u` is dealt in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column("hashes_u"), batch.column("hashes_v"), strict=True):
                a, b = a.values.to_numpy(), b.values.to_numpy()
                common = len(np.intersect1d(a, b, assume_unique=True))
                good.append(common + 1e-9 >= similarity * (len(a) + len(b) - common))
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    parts = stars.groupBy("v").agg(F.ceil(F.count("*") / BLOCK_TEXTS).cast("int").alias("parts"))
    members = with_facts(stars, parts, ["v"], "u").select("u", "v", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int").alias("part"))
    members = members.join(sets.select(F.col("node").alias("u"), F.col("hashes").alias("hashes_u")), "u")
    middles = parts.join(sets.select(F.col("node").alias("v"), F.col("hashes").alias("hashes_v")), "v")
    middles = middles.select("v", "hashes_v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = members.join(middles, ["v", "part"]).select("u", "v", "hashes_u", "hashes_v")
    return write_shared(pairs.mapInArrow(run, "u bigint, v bigint"), "stars")


def block_links(inside: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links `(u, v)` between different `tree`s of a band's members, `inside`: `(key, node, tree)`. All pairs of blocks are compared whole
    but those of one tree; each returns a spanning forest."""
    sized = inside.join(sets.select("node", F.size("hashes").alias("size")), "node")
    share = F.greatest(F.count("*") / BLOCK_TEXTS, F.sum("size") / BLOCK_SHINGLES)
    trees = sized.groupBy("key", "tree").agg(share.alias("share")).withColumn("own", F.col("share") >= 1)
    rest = trees.groupBy("key").agg(F.ceil(F.sum(F.when(~F.col("own"), F.col("share")))).cast("int").alias("rest"))
    cuts = with_facts(trees, rest, ["key"], "tree").select("key", "tree", "own", F.when(F.col("own"), F.ceil("share").cast("int")).otherwise(F.col("rest")).alias("blocks"))
    cut = with_facts(sized, cuts, ["key", "tree"]).select(
        "key", "own", F.when(F.col("own"), F.col("tree")).otherwise(0).alias("tree"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "node"
    )
    members = F.collect_list(F.struct("node", "hashes")).alias("members")
    blocks = write_shared(cut.join(sets, "node").groupBy("key", F.struct("own", "tree", "block").alias("block")).agg(members), "blocks")
    a, b = blocks.select("key", F.col("block").alias("block_a")), blocks.select("key", "block")
    one_tree = F.col("block.own") & F.col("block_a.own") & (F.col("block.tree") == F.col("block_a.tree"))
    asked = a.join(b, "key").where((F.col("block_a") <= F.col("block")) & ~one_tree)
    left = blocks.select("key", F.col("block").alias("block_a"), F.col("members").alias("members_a"))
    pairs = asked.join(left, ["key", "block_a"]).join(blocks, ["key", "block"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(batch, name, i):
            members = batch.column(name)[i].values
            hashes = members.field("hashes")
            return members.field("node").to_numpy(), [h.values.to_numpy() for h in hashes]

        for batch in batches:
            u, v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i in range(batch.num_rows):
                (nodes_a, a), (nodes_b, b) = side(batch, "members_a", i), side(batch, "members", i)
                x, y = similar(a, b, similarity)
                nodes = np.concatenate([nodes_a, nodes_b])
                apart = nodes_a[x] != nodes_b[y]
                if apart.any():
                    found = forest(nodes, x[apart], y[apart] + len(a))
                    u.append(found[0])
                    v.append(found[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    return pairs.select("members_a", "members").mapInArrow(compare, "u bigint, v bigint")


def simhash_bands(prints: DataFrame, distinct: DataFrame, radius: int = 2) -> DataFrame:
    """`(node, key)`: a band for each group of SimHash fingerprints that links of `radius` bits connect, with the `distinct` rows `(fp, node)` of its texts.

    Texts of one set of shingles may repeat them differently, so a node can be in several groups."""
    marks = prints.where("fp <> 0").select("fp", "simhash").distinct().join(distinct, "fp").select("simhash", "node")
    marks = write_shared(marks, "simhashes")
    found = connected_components(near_links(marks.select(F.col("simhash").alias("fp"), F.col("simhash").alias("node")).distinct(), radius))
    grouped = marks.join(found.select(F.col("node").alias("simhash"), "component"), "simhash", "left")
    return grouped.select("node", F.xxhash64(F.lit("simhash"), F.coalesce("component", "simhash")).alias("key")).distinct()


def common_hashes(docs: DataFrame, n: int, shingle: int = 5) -> np.ndarray:
    """The hashes that `COMMON` texts or more hold of a sample of some `SAMPLE_TEXTS` of the `n` different ones of `docs`, sorted. They only order hashes, so a sample is enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py(), shingle).view(np.int64))], ["key"])

    rows = docs.select(row_key().alias("row_key"), F.col("text").cast("binary").alias("text"))
    some = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "row_key"), F.lit(max(1, n // SAMPLE_TEXTS))) == 0).dropDuplicates(["row_key"])
    found = some.select("text").mapInArrow(run, "key bigint").groupBy("key").count().where(F.col("count") >= COMMON).select("key").toPandas()["key"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


def prefixes(docs: DataFrame, common: np.ndarray, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """`(key, fp, place, size)`: the first n - ceil(s n) + 1 of a text's n hashes with their places, those in `common` last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                found = shingles(text.as_py(), shingle)
                if len(found):
                    last = np.isin(found, common)
                    first = np.concatenate([found[~last], found[last]])[: len(found) - int(np.ceil(similarity * len(found) - 1e-9)) + 1]
                    print_ = np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 42)).view(np.int64)
                    columns = [first.view(np.int64), np.full(len(first), print_), np.arange(len(first), dtype=np.int32), np.full(len(first), len(found), np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "fp", "place", "size"])

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "key bigint, fp bigint, place int, size int")


def missed_pairs(docs: DataFrame, distinct: DataFrame, links: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The pairs `(u, v)` that `links` don't connect and that may be similar enough, by what their prefixes share: all others aren't."""
    one_key = Window.partitionBy("key")
    rows = prefixes(docs, common_hashes(docs, distinct.count(), shingle), shingle, similarity)
    rows = rows.withColumns({"least": F.min("fp").over(one_key), "most": F.max("fp").over(one_key)}).where("least < most").drop("least", "most")
    trees = connected_components(links)
    placed = distinct.join(trees, "node", "left").select("fp", "node", F.coalesce("component", "node").alias("tree"))
    rows = write_shared(rows.distinct().join(placed, "fp").select("key", "node", "tree", "place", "size"), "prefixes")
    u, v = (rows.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("node", "tree", "place", "size"))) for side in "uv")
    least, most = F.least("size_u", "size_v"), F.greatest("size_u", "size_v")
    met = u.join(v.hint("merge"), "key").where((F.col("node_u") < F.col("node_v")) & (F.col("tree_u") != F.col("tree_v")) & (least + 1e-6 >= similarity * most))
    shared = met.groupBy(F.col("node_u").alias("u"), F.col("node_v").alias("v"), "size_u", "size_v").agg(F.count("*").alias("n"), F.max("place_u").alias("place_u"), F.max("place_v").alias("place_v"))
    # beyond the last hash that both prefixes hold, and beyond the prefix that ends first, so many may be shared
    rest = F.least(F.least(F.col("size_u") - F.col("place_u"), F.col("size_v") - F.col("place_v")) - 1, F.ceil(similarity * most - 1e-9) - 1)
    asked = shared.where(F.col("n") + rest + 1e-6 >= similarity / (1 + similarity) * (F.col("size_u") + F.col("size_v")))
    return write_shared(asked.select("u", "v"), "missed")


def copy_links(docs: DataFrame, prints: DataFrame, distinct: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Links `(u, v)` that connect what pairs of `similarity` or more connect among `distinct` rows `(fp, node)`."""
    one = prints.groupBy("fp").agg(F.min(F.struct("doc_id", "row_key")).alias("row")).join(distinct, "fp")
    one = write_shared(one.select("row.doc_id", "row.row_key", "node"), "representatives")
    least = prints.select("doc_id", "row_key", "bands").join(one, same_row(prints, one)).select("node", F.explode(F.array_distinct("bands")).alias("key"))
    keys = write_shared(least.unionByName(simhash_bands(prints, distinct)), "bands")
    met = write_shared(with_facts(keys, keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), ["key"]), "met")
    sets = shingle_sets(docs, one.join(met.select("node").distinct(), "node"), shingle)

    # each text is held against the best known member of its bands, which is the original where there is one
    known = met.groupBy("node").agg(F.struct(F.sum("n").alias("met"), (-F.col("node")).alias("minus")).alias("rank"))
    best = met.join(known, "node").groupBy("key").agg(F.max("rank").alias("rank"))
    stars = with_facts(met, best, ["key"]).groupBy(F.col("node").alias("u")).agg((-F.max("rank")["minus"]).alias("v")).where("u <> v")
    stars = write_shared(stars, "asked")
    linked = star_links(stars, sets, similarity)

    # bands that still hold different trees; of bands with the same members one is enough
    trees = connected_components(linked)
    inside = met.join(trees, "node", "left").select("key", "node", F.coalesce("component", "node").alias("tree"))
    inside = write_shared(inside, "inside")
    ends = [F.min("tree").alias("least"), F.max("tree").alias("most"), F.min("node").alias("first"), F.max("node").alias("last")]
    open_bands = inside.groupBy("key").agg(*ends, F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("members")).where("least < most")
    open_bands = open_bands.groupBy("n", "members", "first", "last").agg(F.min("key").alias("key"))
    done = stars.select(F.lit(2).cast("long").alias("n"), F.least("u", "v").alias("first"), F.greatest("u", "v").alias("last"))
    open_bands = open_bands.join(done, ["n", "first", "last"], "left_anti").select("key")
    linked = write_shared(linked.unionByName(block_links(with_facts(inside, open_bands, ["key"]), sets, similarity)), "links")

    # what no band proposed
    missed = missed_pairs(docs, distinct, linked, shingle, similarity)
    ends = missed.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return linked.unionByName(star_links(missed, shingle_sets(docs, one.join(ends, "node"), shingle), similarity))


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """`(doc_id, row_key, fp, component_id)` for each row of `docs`; rules for nulls and repeats as in `near_duplicates`."""
    prints = write_shared(set_prints(docs, shingle), "sets")
    return groups(prints.select("doc_id", "row_key", "fp"), lambda distinct: copy_links(docs, prints, distinct, shingle, similarity))


def keep_first_copy(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id, by the rules of `keep_first`."""
    return firsts_of(docs, lambda texts: near_copies(texts, shingle, similarity))
