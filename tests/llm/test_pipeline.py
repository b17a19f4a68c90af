"""The pipeline's stages against brute force on planted and odd documents, and the columns of every registered query."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pixelloom.llm import quality
from pixelloom.llm.queries import QUERIES
from tests.llm.test_copies import brute as brute_groups
from tests.llm.test_text_operators import brute_hits, brute_lines, fold

vocabularies = pytest.importorskip("public_tokenizers")
SHARED = "This line stands in very many of the documents here"
PASSAGE = "one benchmark passage of more than ten words that no training text may hold at all"


def texts():
    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("lo", "mi", "ta", "re", "su") for b in ("ran", "vek", "dol", "pim", "gus", "zet", "nor")]
    make = lambda n: " ".join(rng.choice(words) + str(rng.randrange(90)) * (rng.random() < 0.7) for _ in range(n))
    made = [make(rng.randint(60, 200)) for _ in range(40)]
    near = []
    for t in made[:6]:
        w = t.split()
        w[len(w) // 2] = "changed"
        near.append(" ".join(w))
    lined = [f"{SHARED}\n{make(80)}\n  {SHARED.upper()} " for _ in range(5)] + ["\n".join([SHARED] * 60)]
    dirty = [f"{make(70)} {PASSAGE.upper()}. {make(20)}" for _ in range(3)]
    junk = ["### " + " ".join(["$$ ||"] * 70), "short text", " ".join(["again and"] * 90)] * 3
    return [*made, *near, made[3], made[3], *lined, *dirty, *junk, None, "", " \n\t", "x" * 5000, make(30_000), "é " * 70]


@pytest.fixture(scope="module")
def folder(spark, docs_of, tmp_path_factory):
    """A folder of tables; documents have a null id, a repeated row, and columns that operators use themselves."""
    where = str(tmp_path_factory.mktemp("tables"))
    docs = docs_of(texts())
    docs = docs.unionByName(docs.where("doc_id = 1")).unionByName(docs.where("doc_id = 2").withColumn("doc_id", F.lit(None).cast("long")))
    docs.withColumns({n: F.lit("mine") for n in ("row_key", "kept", "n_dropped", "ids", "fp")}).write.parquet(f"{where}/documents.parquet")
    labels = [(i, int(not (t or "").startswith(("###", "short", "again")))) for i, t in enumerate(texts()) if i % 2 or i > 55]
    spark.createDataFrame([*labels, (None, 1)], "doc_id long, quality int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def key(r):
    return repr((r.doc_id, r.text))


def by_hand(rows, k, spark, folder):
    """What stage `k` should leave of its input rows: sorted (doc_id, text)."""
    if k == 0:
        frame = spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string")
        trees = quality.fit_quality(frame, spark.read.parquet(f"{folder}/labels.parquet"))
        keep = []
        for r in rows:
            stats, features = quality.text_stats(r.text.encode() if r.text is not None else None)
            margin = trees.base
            for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value, strict=True):
                at = 0
                while feature[at] >= 0:
                    at = 2 * at + 1 + int(features[feature[at]] > threshold[at])
                margin += value[at]
            good = 1 / (1 + 2.718281828459045 ** -margin) >= quality.LEAST_GOOD
            if stats[0] >= 50 and 100 * stats[4] <= 50 * stats[0] and good:
                keep.append((r.doc_id, r.text))
        return sorted(map(repr, keep))
    if k == 1:
        held = {}
        for r in rows:
            for line in r.text.split("\n"):
                if len(line.strip(" \t\x0b\f\r")) >= 20:
                    held.setdefault(fold(line.strip(" \t\x0b\f\r")), set()).add(-1 if r.doc_id is None else r.doc_id)
        out = []
        for r in rows:
            lines = [x for x in r.text.split("\n") if len(s := held.get(fold(x.strip(" \t\x0b\f\r")), ())) < 3 or max(s) == (-1 if r.doc_id is None else r.doc_id)]
            if "\n".join(lines).strip(" \t\n\x0b\f\r"):
                out.append((r.doc_id, "\n".join(lines)))
        return sorted(map(repr, out))
    if k == 2:
        named = sorted({(r.doc_id, r.text) for r in rows if r.doc_id is not None}) + [(None, r.text) for r in rows if r.doc_id is None]
        group, _ = brute_groups([t for _, t in named])
        return sorted(repr(named[i]) for i in range(len(named)) if group[i] == i)
    return sorted(repr((r.doc_id, r.text)) for r in rows if not brute_hits(r.text, [(1, PASSAGE)])[1])


def test_stages_equal_brute_force(spark, folder):
    import sentencepiece

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        rows = docs.collect()
        kept = corpus_pipeline.write_shared(stage(spark, docs, folder), "test-stage")
        got = kept.collect()
        assert sorted(map(key, got)) == by_hand(rows, k, spark, folder), name
        assert 0 < len(got) < len(rows), name
        assert kept.columns == columns and all(r.row_key == r.kept == r.ids == "mine" for r in got)
        docs = kept
    library = sentencepiece.SentencePieceProcessor(model_file=vocabularies.path("piece_bpe_32k.model"))
    want = sorted(repr((r.doc_id, library.encode(r.text))) for r in docs.collect())
    assert sorted(repr((r.doc_id, list(r.ids))) for r in corpus_pipeline.STAGES[4][1](spark, docs, folder).collect()) == want
    assert sorted(repr((r.doc_id, list(r.ids))) for r in corpus_pipeline.run(spark, folder).collect()) == want


def test_stages_of_no_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


#: What the queries return, by contract; more columns may follow.
COLUMNS = {
    1: "doc_id bigint, fingerprint string, component_id bigint",
    2: "page_id bigint, host string, path string, rule string, verdict string",
    3: "doc_id bigint, held_out boolean, score double, predicted int",
    4: "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    5: "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    6: "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    8: "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    9: "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    10: "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    11: "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    12: "query_id bigint, rank int, vec_id bigint, score bigint",
    13: "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_returns_a_row_for_each_of_its_table(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir).cache()
    n = int(name[2:].split("_")[0])
    table = spark.read.parquet(f"{sf_dir}/{'pages' if n == 2 else 'documents'}.parquet")
    if n in COLUMNS:
        assert [f"{c} {t}" for c, t in found.dtypes][: COLUMNS[n].count(",") + 1] == COLUMNS[n].split(", ")
    first = found.columns[0]
    if n == 12:  # five for each vector whose id is divisible by 50
        queries = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 50 = 0").select("vec_id").collect()
        assert sorted(r[0] for r in found.collect()) == sorted(r[0] for r in queries for _ in range(5))
        return
    assert sorted(r[0] for r in found.select(first).collect()) == sorted(r[0] for r in table.select(first).collect())
