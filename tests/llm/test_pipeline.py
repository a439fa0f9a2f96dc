"""The pipeline against its stages' plain versions, over the smallest tables."""

import random

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallywick.llm.common import read_table
from tallywick.llm.queries import vocabulary_path

from . import brute
from .test_operators import hot_lines


def rows_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages_equal_their_plain_versions(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    columns = docs.columns
    items = [(r["item_id"], r["text"]) for r in read_table(spark, sf_dir, "benchmark").collect()]
    expected = rows_of(docs)
    labels = {r["doc_id"]: r["quality"] for r in read_table(spark, sf_dir, "labels").collect()}
    assert len(labels) < 576  # too few for any certified cutoff: the base rules decide
    m = {d: brute.measures(t) for d, t in expected.items()}
    expected = {d: t for d, t in expected.items() if m[d]["n_words"] >= 20 and 100 * m[d]["n_repeat_words"] <= 30 * m[d]["n_words"]}
    docs = corpus_pipeline.quality_rules(spark, docs, sf_dir)
    assert docs.columns == columns and rows_of(docs) == expected

    order = sorted(expected.items())
    cut = dict(zip((d for d, _ in order), brute.line_dedup(order), strict=True))
    expected = {d: t for d, t in cut.items() if brute.words(t)}
    docs = corpus_pipeline.line_dedup(spark, docs, sf_dir)
    assert docs.columns == columns and rows_of(docs) == expected
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())

    order = sorted(expected)
    comp = brute.near_groups([expected[d] for d in order])
    expected = {order[c]: expected[order[c]] for c in set(comp)}
    docs = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    assert docs.columns == columns and rows_of(docs) == expected

    expected = {d: t for d, t in expected.items() if not brute.contamination(t, items)[1]}
    docs = corpus_pipeline.decontamination(spark, docs, sf_dir)
    assert docs.columns == columns and rows_of(docs) == expected

    lib = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    ids = {d: lib.encode(t, add_special_tokens=False).ids for d, t in expected.items()}
    last = {
        d: (len(x), brute.sha(np.array(x, "<u4").tobytes()), brute.sha(lib.decode(x, skip_special_tokens=False))) for d, x in ids.items()
    }
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == last


def test_line_dedup_stage_aligns_with_all_holders_of_a_common_line(spark, sf_dir):
    rows = hot_lines()
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    expected = dict(zip((d for d, _ in rows), brute.line_dedup(rows), strict=True))
    found = corpus_pipeline.line_dedup(spark, docs, sf_dir)
    assert rows_of(found) == expected and expected[50] != dict(rows)[50]
    assert all(r["n_chars"] == len(r["text"]) for r in found.collect())


AWKWARD = [
    (1, "one two three four five six seven eight nine ten. " * 3 + "and the rest of it is long enough to stay here", "en", "s", 3, "x"),
    (None, "a row without an id has words enough to stay in the corpus, twenty of them at least, or so it seems to me now", None, None, None, None),
    (2, None, "en", "s", None, "x"), (3, "", "en", "s", 0, "x"), (4, " \n\t ", None, "s", 4, "x"),
    (5, "This row comes twice and has words enough to stay in the corpus, twenty of them at least, and a few more.", "de", "s", 1, "x"),
    (5, "This row comes twice and has words enough to stay in the corpus, twenty of them at least, and a few more.", "de", "s", 1, "x"),
    (5, "This row has the same id but other words, enough to stay in the corpus too, since there are twenty of them here.", "de", "s", 1, "x"),
]
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, hash string"


def tables(spark, path):
    spark.createDataFrame([(1, 1, 0), (None, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "no such words"), (2, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_stages_with_awkward_rows(spark, tmp_path):
    tables(spark, tmp_path)
    rng = random.Random(51)
    long = " ".join(f"w{rng.randrange(40_000)}" for _ in range(150_000))
    rows = [*AWKWARD, (9, long, "en", "s", len(long), "x")]
    docs = spark.createDataFrame(rows, CLASHING)
    names = ("did", "n_hit", "n_words", "first", "node", "places", "new", "kept", "n_removed_lines", "stratum", "id", "none", "fp", "given0", "items", "least", "text_", "base_failed")
    clashing = docs.limit(3).select("*", *[F.lit("mine").alias(c) for c in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, clashing, str(tmp_path))
        assert found.columns == clashing.columns and all(r[c] == "mine" for r in found.collect() for c in names)
    left = {name: sorted(((r["doc_id"], r["text"]) for r in stage(spark, docs, str(tmp_path)).collect()), key=str) for name, stage in corpus_pipeline.STAGES[:-1]}
    every = sorted(((r[0], r[1]) for r in rows), key=str)
    assert left["quality_rules"] == [x for x in every if x[1] and len(x[1].split()) >= 20 and x[0] != 1]
    assert left["line_dedup"] == every and left["decontamination"] == every
    assert left["near_dedup"] == sorted({x for x in every if x[0] not in (3, 4)}, key=str)
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(encoded) == len(rows) and sum(r["n_tokens"] == 0 for r in encoded) == 3


def test_run_on_awkward_and_empty_tables(spark, tmp_path):
    tables(spark, tmp_path / "some")
    spark.createDataFrame(AWKWARD, CLASHING).write.parquet(str(tmp_path / "some" / "documents.parquet"))
    assert sorted((r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path / "some")).collect()), key=str) == [5, 5, None]
    tables(spark, tmp_path / "none")
    spark.createDataFrame([], CLASHING).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], CLASHING), str(tmp_path / "none")).count() == 0
