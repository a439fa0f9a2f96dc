"""Queries of the operators against their SQL, over the smallest tables and over hand-made ones."""

import os
import random

import duckdb
import pytest

from tallywick.llm.oracles import ORACLES
from tallywick.llm.queries import QUERIES

from .test_operators import WORDS, prose


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=str)


def check(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            path = f"{sf_dir}/{f}"
            con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    rel = con.execute(ORACLES[name])
    names = [c[0] for c in rel.description]
    df = QUERIES[name](spark, sf_dir)
    assert sorted(names) == sorted(df.columns)
    got = [tuple(r) for r in df.collect()]
    assert plain(got, df.columns) == plain(rel.fetchall(), names)
    return [dict(zip(df.columns, r, strict=True)) for r in got]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert check(spark, sf_dir, name)


def test_quality_equals_its_sql_where_cutoffs_are_certified(spark, tmp_path):
    rng = random.Random(41)
    docs, labels = [], []
    for i in range(4200):
        lang = ["en", "de", "fr", None][i % 4] if i < 3000 else ["en", "de"][i % 2]
        good = rng.random() < 0.7
        text = prose(rng, rng.randrange(20, 40))
        if not good and rng.random() < 0.8:
            text += " " + " ".join(rng.choice(["# $", "| |", "<< >>"]) for _ in range(rng.randrange(4, 12)))
        if not good and rng.random() < 0.3:
            text += "\n" + "\n".join([" ".join(rng.sample(WORDS, 3))] * 5)
        docs.append((i, text, lang))
        labels.append((i, int(good)))
    docs += [(None, None, None), (4300, "", "en"), docs[0], docs[5]]
    labels += [(0, 0), (None, 1), (7, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = check(spark, str(tmp_path), "op3_quality_rules")
    lang = {i: x for i, _, x in docs}
    cut = {lang[r["doc_id"]] for r in rows if not r["kept"] and not r["base_failed"]}
    assert {"en", "de"} <= cut


@pytest.mark.parametrize("name", ["op5_chat_formatting", "op7_benchmark_decontamination", "op8_sharding"])
def test_awkward_rows_equal_the_sql(spark, tmp_path, name):
    rng = random.Random(42)
    text = prose(rng, 30)
    docs = [(1, text), (1, text), (1, text), (1, "other"), (None, None), (None, None), (2, ""), (3, "é 日本 " * 300), (None, text), (5, f"so {text.upper()} then"), (6, "short item")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    items = [(7, text), (8, "short, item"), (9, None), (None, "日本 é"), (7, text), (10, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    turns = [(1, 0, "user", "<|im_end|>"), (1, 1, "assistant", "<\\|x <|"), (1, 1, "assistant", "<\\|x <|"), (2, None, None, None), (None, 0, "assistant", text), (3, 0, "assistant", "")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert check(spark, str(tmp_path), name)
