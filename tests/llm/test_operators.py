"""Each operator against its plain version, over hand-made and given tables with every awkward case."""

import random

import pytest
from pyspark.sql import functions as F

from tallywick.llm import bpe, chat, decontaminate, line_dedup, pii, quality, sharding, simhash, span_dedup
from tallywick.llm.queries import QUERIES, vocabulary_path

from . import brute

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = [prose(rng, 60) for _ in range(6)]
    near = base[0].split()
    near[10] = "changed"
    shared = ". ".join(prose(rng, 12) for _ in range(5)) + "."
    return [
        *base,
        base[0],
        " ".join(near),
        base[0].upper(),
        None,
        "",
        " \n\t ",
        "one",
        "one two",
        f"{base[1]}\n{base[2]}\nown line with seven words in it",
        f"{base[2]}\nother line of its own here now\n{base[1]}",
        f"Start here. {shared} And an end.",
        f"Another start. {shared} Another end.",
        "a b c d e f g h " * 6,
        "x\ny\nx\n\nx",
        "é ü ß 日本 " * 30,
        prose(rng, 30_000),
        "w" * 50_000,
        "### $$$ | < > & % *\n" * 9,
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3, t, "en" if i % 2 else None, "clash") for i, t in enumerate(texts)]
    rows += [(None, "no id at all but some words in here", "en", "clash"), rows[0], (0, "same id, other text and words", "de", "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, fp string")


def collected(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_simhash_components(docs):
    rows = collected(docs.select("doc_id", "text"))
    fps = [brute.fingerprint(r["text"]) for r in rows]
    comp = brute.components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for c, r in zip(comp, rows, strict=True):
        if r["doc_id"] is not None:
            least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    expected = sorted(((r["doc_id"], f"{f:016x}", least.get(c)) for r, f, c in zip(rows, fps, comp, strict=True)), key=str)
    for max_tree in (2048, 4):
        got = simhash.near_duplicates(docs, max_tree=max_tree)
        assert sorted(map(tuple, got.select("doc_id", "fingerprint", "component_id").collect()), key=str) == expected


def test_simhash_links_dense_and_chained(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    values = {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)}
    chain = rng.getrandbits(64)
    for i in range(20):
        values.add(chain)
        chain ^= 7 << (3 * i)
    values |= {rng.getrandbits(64) for _ in range(200)}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    comp = brute.components(values, lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3)
    expected = {v: values[c] for v, c in zip(values, comp, strict=True)}
    from tallywick.llm.components import connected

    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    for max_tree in (2048, 16):
        links = simhash.fingerprint_links(fps, max_tree=max_tree)
        got = {v: v for v in values} | {r["node"]: r["root"] for r in connected(links).collect()}
        assert got == expected


def test_bk_tree_follows_edges_within_the_radius():
    rng = random.Random(1)
    values = [rng.getrandbits(16) for _ in range(500)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert sorted(tree.values[i] for i in tree.within(q, 3)) == sorted(v for v in set(values) if (v ^ q).bit_count() <= 3)


def test_simhash_representatives(docs):
    rows = collected(docs)
    comp = brute.near_groups([r["text"] for r in rows])
    first = {}
    for c, r in zip(comp, rows, strict=True):
        first[c] = min(first.get(c, (2, 0)), (r["doc_id"] is None, r["doc_id"] or 0))
    for max_tree in (2048, 3):
        got = collected(simhash.keep_representatives(docs, max_tree=max_tree))
        assert set(got[0]) == {"doc_id", "text", "lang", "fp"} and all(r["fp"] == "clash" for r in got)
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted(first.values())


def test_near_duplicates_of_five_words(spark):
    rng = random.Random(17)
    texts = [prose(rng, rng.choice([25, 60, 200, 900])) for _ in range(60)]
    for _ in range(240):
        w = rng.choice(texts).split()
        for _ in range(max(1, len(w) // rng.choice([30, 45, 60, 100]))):
            w[rng.randrange(len(w))] = f"new{rng.randrange(99)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    comp = brute.near_groups(texts)
    for max_tree in (2048, 16):
        kept = {r["doc_id"] for r in simhash.keep_representatives(df, max_tree=max_tree).collect()}
        assert set(comp) <= kept and len(kept - set(comp)) <= 0.02 * (len(texts) - len(set(comp)))
    by_name = {r["doc_id"] for r in simhash.keep_representatives(df.withColumn("doc_id", F.format_string("%04d", "doc_id"))).collect()}
    assert {int(x) for x in by_name} == kept or len({int(x) for x in by_name} ^ kept) <= 4


def test_quality_measures_and_base_rules(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = collected(quality.quality(docs, labels))
    expected = [{"doc_id": r["doc_id"], **brute.measures(r["text"])} for r in collected(docs)]
    key = lambda r: str(sorted(r.items(), key=str))
    assert sorted(({k: r[k] for k in expected[0]} for r in got), key=key) == sorted(expected, key=key)
    for r in got:
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed)


def test_quality_cutoffs_hold_their_risk(spark):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        good = rng.random() < 0.7
        value = rng.randrange(0, 12) if good else rng.randrange(5, 100)
        rows.append(("en" if i % 3 else "de", good, value, 0, 0, 0))
    rows += [("fr", True, 0, 0, 0, 0)] * 5 + [("fr", False, 90, 0, 0, 0)] * 5
    holdout = spark.createDataFrame(rows, "stratum string, good boolean, symbols int, dup_lines int, repeats int, sameness int")
    found = {(r["stratum"], r["rule"]): r for r in quality.certified_cutoffs(holdout).collect()}
    assert set(found) == {("en", "symbols"), ("de", "symbols")}  # fr has too few labels for any certificate
    import math

    for (s, _), r in found.items():
        good = [x[2] for x in rows if x[0] == s and x[1]]
        bad = [x[2] for x in rows if x[0] == s and not x[1]]
        best = None
        for c in sorted(set(good + bad), reverse=True):
            n, k, p = len(good), sum(x >= c for x in good), quality.RISK / 4
            if c > 0 and k < p * n and sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) <= quality.DELTA / 12:
                gain = sum(x >= c for x in bad) - quality.COST * k
                if gain > 0 and (best is None or gain > best[0]):
                    best = (gain, c)
        assert r["cutoff"] == best[1]


def test_quality_keeps_columns_and_rows(spark, docs):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = collected(quality.keep_good(docs.withColumn("kept", F.lit("x")), labels))
    assert rows and set(rows[0]) == {"doc_id", "text", "lang", "fp", "kept"}
    assert all(brute.measures(r["text"])["n_words"] >= 20 for r in rows)


ITEMS = [(1, "Alpha1 beta2, gamma3 delta4 epsilon5 zeta6 eta7 theta8 iota9 kappa10 lambda11 mu12"), (2, "short item"), (10, ""), (3, None), (4, "日本 ü")]


def test_decontamination(spark, docs):
    more = spark.createDataFrame(
        [
            (900, "so: ALPHA1 beta2 gamma3-delta4 epsilon5 zeta6 eta7 theta8 iota9 kappa10 but then"),
            (901, "x short; item short item"),
            (902, "shortitem"),
            (903, "beta2 gamma3 delta4 epsilon5 zeta6 eta7 theta8 iota9 kappa10 lambda11 mu12 mu12"),
        ],
        "doc_id long, text string",
    )
    rows = docs.select("doc_id", "text").unionByName(more)
    nameless = rows.filter("doc_id = 0").first()["text"].split()
    every = [*ITEMS, ITEMS[0], (None, " ".join(nameless[3:20]))]
    items = spark.createDataFrame(every, "item_id long, text string")
    for limit in (1 << 20, 200, 20):
        got = collected(decontaminate.contamination(rows, items, max_block_bytes=limit, keep=("doc_id", "text")))
        assert len(got) == rows.count()
        for r in got:
            n, hit, names = brute.contamination(r["text"], every)
            assert (r["n_words"], r["n_hit"], r["items"]) == (n, hit, names)
            cut = [(r["text"] or "").encode()[s["start"] : s["end"]].decode() for s in r["spans"]]
            assert sum(len(brute.normal_words(c)) for c in cut) == hit
    kept = collected(decontaminate.drop_contaminated(rows.withColumn("n_hit", F.lit(5)), items))
    assert all(brute.contamination(r["text"], every)[1] == 0 and r["n_hit"] == 5 for r in kept)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.drop_contaminated(rows, none).count() == rows.count()


def test_the_automaton_is_built_once():
    items = [("a", b"one two three"), (None, b"four")]
    first = decontaminate.scanner(items, "a benchmark")
    built = decontaminate._built["a benchmark"]
    assert first(b"so one two three, four") == (5, [(1, 5)], ["a"]) == decontaminate.scanner(items, "a benchmark")(b"so one two three, four")
    assert decontaminate._built["a benchmark"] is built
    many = [b"w%d" % i for i in range(5000)]
    codes, length = decontaminate.numbered(many)
    assert length == 3 and len(set(codes.values())) == 5000 and {len(c) for c in codes.values()} == {3}


def test_sharding(spark, docs):
    got = collected(sharding.shard_documents(docs))
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(r["doc_id"]), len((r["text"] or "").encode()) + 1, brute.crc(r["text"])) for r in collected(docs))
    for s in range(16):
        places = sorted(r["slot"] for r in got if r["shard"] == s)
        assert places == list(range(len(places)))
    assert all(r["law"] == "bytes" and r["grown_shard"] is None for r in got)


def test_shard_map_versions(spark, tmp_path):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    loads = sharding.slot_bytes(sharding.with_slots(rows))
    first = sharding.balanced_map(spark, loads)
    path = str(tmp_path / "map")
    sharding.write_map(first, path)
    second = sharding.rebalanced_map(spark, sharding.read_map(spark, path), loads, 17)
    sharding.write_map(second, path)
    assert sharding.read_map(spark, path, 1).count() == first.count()
    old = {r["virtual_slot"]: r["shard"] for r in first.collect()}
    new = {r["virtual_slot"]: r["shard"] for r in sharding.read_map(spark, path).collect()}
    assert set(new.values()) == set(range(17))
    assert sum(old[k] != new[k] for k in old) < len(old) / 8
    for m, n in ((first, 16), (second, 17)):
        sizes = [r["b"] for r in m.groupBy("shard").agg(F.sum("bytes").alias("b")).collect()]
        assert max(sizes) <= 1.03 * sum(sizes) / n
    shrunk = sharding.rebalanced_map(spark, second, loads, 10)
    assert {r["shard"] for r in shrunk.collect()} == set(range(10))
    placed = sharding.shard_documents(rows, map_path=path, version=1)
    assert {r["virtual_slot"]: r["shard"] for r in placed.collect()} == old
    grown = collected(sharding.shard_documents(rows, map_path=path))
    assert {r["virtual_slot"]: r["shard"] for r in grown} == new and {r["map_version"] for r in grown} == {2}
    again = str(tmp_path / "other")
    made = collected(sharding.shard_documents(rows, map_path=again))
    assert {r["virtual_slot"]: r["shard"] for r in sharding.read_map(spark, again).collect()} == {r["virtual_slot"]: r["shard"] for r in made}


def test_repeated_ids_are_spread(spark):
    same = spark.range(1000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    equal = spark.range(0, 1000, 1, 5).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    runs = [sorted(map(str, sharding.shard_documents(same.unionByName(equal).repartition(n)).collect())) for n in (3, 1)]
    assert runs[0] == runs[1]
    got = collected(sharding.shard_documents(same.unionByName(equal)))
    for rows in ([r for r in got if r["doc_id"] == 7], [r for r in got if r["doc_id"] is None]):
        sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(16)]
        assert len(rows) == 1000 and max(sizes) < 2 * sum(sizes) / 16


def test_patience_equals_the_recursive_version():
    rng = random.Random(11)
    for _ in range(300):
        a = [rng.randrange(12) for _ in range(rng.randrange(15))]
        b = [rng.choice(a) if a and rng.random() < 0.6 else rng.randrange(12) for _ in range(rng.randrange(15))]
        assert line_dedup.patience(a, b) == brute.patience(a, b)


def test_line_dedup(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts) if t is not None]
    df = spark.createDataFrame([*rows, rows[0], (None, texts[0]), (99, None)], "doc_id long, text string").withColumn("did", F.lit("mine"))
    expected = {d: t for (d, _), t in zip(rows, brute.line_dedup(rows), strict=True)}
    got = collected(line_dedup.dedup_lines(df, n_removed="n"))
    assert len(got) == len(rows) + 3 and all(r["did"] == "mine" for r in got)
    for r in got:
        assert r["text"] == (expected[r["doc_id"]] if r["doc_id"] in expected else None if r["doc_id"] == 99 else "")


def test_line_dedup_aligns_lines_left_over_with_other_holders(spark):
    a, b = "first hot line with six words", "other hot line with six words"
    rows = [(1, f"{a}\n{b}"), (2, f"own of two\n{a}\nmore of two"), (3, f"{b}\nown of three\n{a}"), (4, f"{b}\nown of four\n{a}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: rows[0][1], 2: "own of two\nmore of two", 3: f"{b}\nown of three", 4: "own of four"}


def test_line_dedup_loses_no_link(spark):
    x = "a line that has six words"
    rows = [(1, f"{x}\nother end"), (2, f"{x}\nshort mark\nend of two"), (3, f"{x}\nshort mark\nend of two"), (4, f"own\n{x}\nshort mark"), (5, f"{x}\n\nshort mark\nown end of it")]
    rows += [(10 + i, f"start of {i}\nfirst hot line of many words\nthen\nthat\nmiddle {i % 4} of all of them\nand\nso\non\nlast hot line of many words") for i in range(40)]
    rng = random.Random(12)
    pool = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 2, 3, 6, 8]))) for _ in range(25)]
    rows += [(100 + i, "\n".join(rng.choice(pool) if rng.random() < 0.7 else prose(rng, 6) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = dict(zip((d for d, _ in rows), brute.line_dedup(rows), strict=True))
    assert got[3] == "" and got[4] == "own"
    assert {d: got[d] for d in got if d < 100} == {d: expected[d] for d in expected if d < 100}
    lost = [(x, y) for d in got for x, y in [(brute.words(got[d]), brute.words(expected[d]))] if x != y]
    removed = sum(len(brute.words(t)) - len(brute.words(expected[d])) for d, t in rows)
    assert sum(len(x) - len(y) for x, y in lost) <= 0.02 * removed


HOT = "the very common line of seven words"


def hot_lines():
    """Only the 25th holder of the common line aligns with the last one: in the others the line comes twice."""
    rows = [(i, f"own start of {i}\n{HOT}\nown middle of {i}\n{HOT}\nown end of {i}") for i in range(40)]
    rows[24] = (24, f"own start of 24\n{HOT}\nown end of 24")
    return [*rows, (50, f"own start of 50\n{HOT}\nown end of 50")]


def test_line_dedup_aligns_lines_left_over_with_all_other_holders(spark):
    rows = hot_lines()
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50] == "own start of 50\nown end of 50"
    assert got == dict(zip((d for d, _ in rows), brute.line_dedup(rows), strict=True))


def test_line_dedup_equals_aligning_all_pairs(spark, monkeypatch):
    rng = random.Random(17)
    pool = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 2, 5, 6, 8]))) for _ in range(9)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.7 else f"own line {i} {k}" for k in range(rng.randrange(1, 10)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = dict(zip((d for d, _ in rows), brute.line_dedup(rows), strict=True))
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()} == expected
    monkeypatch.setattr(line_dedup, "PAIRS_AT_ONCE", 1)
    monkeypatch.setattr(line_dedup, "PARTNERS", 1)
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df, rounds=0).collect()} == expected


def test_aligning_shared_lines_equals_aligning_all():
    rng = random.Random(13)
    for _ in range(300):
        a = [rng.randrange(1, 14) for _ in range(rng.randrange(1, 15))]
        b = [rng.choice(a) if rng.random() < 0.6 else rng.randrange(1, 14) for _ in range(rng.randrange(1, 15))]
        size = {h: rng.randrange(1, 5) for h in range(14)}
        blocks, last = [], None
        for i, j in brute.patience(a, b):
            if last != (i - 1, j - 1):
                blocks.append([])
            blocks[-1].append(j)
            last = (i, j)
        expected = [j for x in blocks if sum(size[b[j]] for j in x) >= 5 for j in x]
        shared = [(size[h], [i for i, x in enumerate(a) if x == h], [j for j, x in enumerate(b) if x == h], h) for h in set(a) & set(b)]
        assert line_dedup.deleted_lines(shared, len(a), len(b), 5) == expected


def test_shortest_runs_cover_every_block():
    rng = random.Random(14)
    for _ in range(200):
        words = [rng.randrange(1, 8) for _ in range(rng.randrange(1, 9))]
        for at in range(len(words)):
            runs = line_dedup.shortest_runs(words, at, 5)
            assert len(runs) <= 5 and all(a <= at < b and sum(words[a:b]) >= 5 for a, b in runs)
            for a in range(at + 1):
                for b in range(at + 1, len(words) + 1):
                    assert (sum(words[a:b]) >= 5) == any(a <= c and d <= b for c, d in runs)


def test_span_dedup(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts) if t is not None]
    df = spark.createDataFrame([*rows, rows[0], (99, None)], "doc_id long, text string").withColumn("hash", F.lit("mine"))
    expected = {d: t for (d, _), t in zip(rows, brute.span_dedup(rows), strict=True)}
    got = collected(span_dedup.dedup_spans(df, n_removed="n"))
    assert len(got) == len(rows) + 2 and all(r["hash"] == "mine" for r in got)
    for r in got:
        assert r["text"] == expected.get(r["doc_id"])


def test_span_dedup_finds_passages_of_short_sentences(spark):
    passage = " ".join(f"w{i}!!" for i in range(60))
    rows = [(1, f"Own start of the first. {passage}"), (2, f"Other start of the next. {passage} Its own end here."), (3, "w3!! w4!! w5!! stay.")]
    got = {r["doc_id"]: r["text"] for r in span_dedup.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "Other start of the next. Its own end here.", 3: rows[2][1]}


def test_span_dedup_finds_passages_inside_sentences(spark):
    rng = random.Random(11)
    shared = [prose(rng, 51) for _ in range(3)]
    rows = [
        (1, f"{prose(rng, 30)} {shared[0]} {prose(rng, 30)} {shared[1].upper()} {prose(rng, 5)}"),
        (2, f"{prose(rng, 40)} {shared[0]} {prose(rng, 20)}. Half a sentence {shared[2]} ends."),
        (3, "\n ".join(f"{prose(rng, 33)} {shared[1]} {prose(rng, 33)} {shared[2]} é".split(" "))),
        (4, f"{prose(rng, 12)} {' '.join(shared[0].split()[:24])} {prose(rng, 12)}"),
        (5, "ab cd ef " * 40),
        (6, f"{prose(rng, 40)} {shared[0]} {prose(rng, 20)} {shared[0]} {prose(rng, 9)}"),
        (None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n"]) for r in span_dedup.dedup_spans(df, n_removed="n", passage=span_dedup.PASSAGE).collect()}
    assert got[1] == (rows[0][1], 0) and got[4] == (rows[3][1], 0) and got[None] == (None, 0)
    assert got[5][0].startswith("ab cd ef " * 8) and len(got[5][0].split()) < 80
    for doc, pieces in ((2, [shared[0]]), (3, [shared[1], shared[2]]), (6, [shared[0]] * 2)):
        text, n = got[doc]
        left, was = brute.words(text), brute.words(rows[doc - 1][1])
        assert n >= len(pieces) and len(was) - 51 * len(pieces) <= len(left) <= len(was) - len(pieces) * (51 - 2 * (span_dedup.WINDOW - 1))
        own = [x for x in was if not any(x in p.lower().split() for p in pieces)]
        assert [x for x in left if x in set(own)] == own


TRICKY = [
    "It's  a\n\n test of 12 things… don't!!", "ΑΣ ΑΣᲉ İstanbul é ﬁ ½ ²", "<|endoftext|>x <|endoftext|", "\x1c \x85 a", "日本語のテキスト 🙂🙂", "", " ", "\n", "a" * 3000, "=-" * 700,
    "the" * 900 + " " + "ing" * 500, "tab\tand  double", "<|startoftext|>hi<|endoftext|>", "\U0001dfd7b ՘", "x " * 40_000,
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoding_equals_the_library(spark, texts, name):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary_path(name))
    cases = TRICKY + [t for t in texts if t is not None]
    rng = random.Random(2)
    alphabet = ["a", "the", " ", "\n", "é", "Σ", "'s", "'", "!", "12", "日", "🙂", "​", "<|endoftext|>", " "]
    cases += ["".join(rng.choice(alphabet) if rng.random() < 0.8 else chr(rng.randrange(32, 0x2FFF)) for _ in range(60)) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(cases)) + [(-1, None)], "doc_id long, text string")
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode_documents(df, vocabulary_path(name)).collect()}
    expected = {i: e.ids for i, e in enumerate(lib.encode_batch(cases, add_special_tokens=False))} | {-1: []}
    assert ids == expected
    back = bpe.decode_documents(bpe.encode_documents(df, vocabulary_path(name)), vocabulary_path(name))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: lib.decode(x, skip_special_tokens=False) for i, x in expected.items()}
    if name.startswith("byte"):
        counts = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in bpe.token_counts(df, vocabulary_path(name)).collect()}
        assert counts == {i: (len(((cases[i] if i >= 0 else None) or "").encode()), len(x), len(x) > 512) for i, x in expected.items()}


def test_transducer_emits_stable_tokens_in_bounded_memory():
    with open(vocabulary_path("word_bpe_49k.json"), encoding="utf-8") as f:
        v = bpe.Vocabulary(f.read())
    rng = random.Random(4)
    syllables = ["th", "ing", "er", "a", "aa", "tion", "s", "ab", "ers"]
    for _ in range(20):
        data = "".join(rng.choice(syllables) for _ in range(900)).encode()
        whole = v.merge([*(v.first[b] for b in data[:-1]), v.last[data[-1]]])
        coder, out, most = bpe.Transducer(v), [], 0
        at = 0
        while at < len(data):
            step = rng.randrange(1, 200)
            out += coder.push(data[at : at + step])
            at += step
            assert out == whole[: len(out)]
            most = max(most, len(coder.held))
        assert out + coder.end() == whole
        assert most <= bpe.BLOCK + v.lookahead + 200 + 64


def long_texts(rng):
    """Texts without white space, and of white space, that are longer than a piece."""
    n = 3 * bpe.SPAN + 11
    cjk = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    mixed = "".join(rng.choice(["日本", "don't", "'s", "'", "!!", "12", "é", "e\u0301", "Σ", "가", "x", "'ll", "'l"]) for _ in range(n))
    yield from (cjk, mixed, "a" * n, "7" * n, "=" * n + "'s", "!" * n + "word", " " * n, " " * n + "x", "\n" * n + " x", "x" + " \n" * n + "y", "x " + "漢" * n, f"{cjk} {mixed}  {cjk[:50]}", "\u0301" * n)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_long_words_equal_the_library(name):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary_path(name))
    with open(vocabulary_path(name), encoding="utf-8") as f:
        v = bpe.Vocabulary(f.read())
    encoder = bpe.Encoder(v)
    counter = bpe.Counter(v) if name.startswith("byte") else None
    for text in long_texts(random.Random(21)):
        expected = lib.encode(text, add_special_tokens=False).ids
        assert b"".join(encoder.encode(text)) == bpe.packed(expected), text[:20]
        assert counter is None or counter(text) == len(expected)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_memory_does_not_grow_with_a_word(name):
    import tracemalloc

    with open(vocabulary_path(name), encoding="utf-8") as f:
        v = bpe.Vocabulary(f.read())
    encoder, decoder = bpe.Encoder(v), bpe.Decoder(v)
    peaks = []
    for n in (40_000, 400_000):
        text = "".join(chr(0x4E00 + i * 7 % 20_000) for i in range(n))
        tracemalloc.start()
        decoder.begin()
        for piece in encoder.encode(text):
            decoder.push([int.from_bytes(piece[i : i + 4], "little") for i in range(0, len(piece), 4)])
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.3 * peaks[0] < 4 << 20


def test_improper_merges_are_refused():
    import json

    with open(vocabulary_path("word_bpe_49k.json"), encoding="utf-8") as f:
        file = json.load(f)
    file["model"]["merges"] = file["model"]["merges"][::-1]
    with pytest.raises(ValueError):
        bpe.Vocabulary(json.dumps(file))


def test_decoder_holds_unfinished_characters():
    with open(vocabulary_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        v = bpe.Vocabulary(f.read())
    d = bpe.Decoder(v)
    d.begin()
    ids = [v.first[b] for b in "é🙂".encode()] + [v.first[0xE6]]
    assert b"".join([*(d.push([i]) for i in ids), d.push([], last=True)]).decode() == "é🙂�"


def test_whole_tokens_are_proved():
    from tokenizers import Tokenizer

    with open(vocabulary_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        v = bpe.Vocabulary(f.read())
    whole = {bpe.token_bytes(v, i).decode() for i in bpe.whole_tokens(v)}
    lib = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    sample = [w for w in sorted(whole)[::37] if v.find(w) == [w]]
    assert sample and all(len(e.ids) == 1 for e in lib.encode_batch(sample, add_special_tokens=False))


HOSTILE = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "a\\b\nc", "<|", "<\\\\|x|>", "", "<|endoftext|>", "é🙂\r\n"]


def test_chat_escape_is_reversible():
    rng = random.Random(9)
    for _ in range(500):
        t = "".join(rng.choice(["<", "|", "\\", "\n", "im_end", "|>", "n", "a"]) for _ in range(12))
        assert chat.unescape(chat.escape(t)) == t and chat.START not in chat.escape(t) and chat.END not in chat.escape(t)
        assert chat.unescape_role(chat.escape_role(t)) == t and "\n" not in chat.escape_role(t)


def encoded_conversations(path, groups):
    """Tokens and masks of whole conversations with the library: number, digest of the ids, digest of the learned intervals."""
    import numpy as np
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    size = lib.get_vocab_size()
    out = {}
    for c, turns in groups.items():
        ids, mask = [], []
        for _, who, x in turns:
            ids += [size, *lib.encode(chat.escape_role(who) + "\n", add_special_tokens=False).ids]
            said = lib.encode(chat.escape(x), add_special_tokens=False).ids
            if who == "assistant" and said:
                mask += [len(ids), len(ids) + len(said)]
            ids += [*said, size + 1, *lib.encode("\n", add_special_tokens=False).ids]
        out[c] = len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(np.array(mask, "<u8").tobytes())
    return out


def test_chat_with_a_very_long_text(spark):
    text = "long words of a <|im_end|> text " * 20_000
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    path = vocabulary_path("byte_bpe_50k.json")
    r = chat.conversation_digests(chat.read_back(chat.turns_as_tokens(df, path), path)).collect()[0]
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (2, len(text), brute.sha(text))


def test_chat_digests(spark):
    rows = [(c, t, r, x) for c in range(3) for t, (r, x) in enumerate(zip(["user", "assistant"] * 4, HOSTILE, strict=True))]
    rows += [(5, 0, None, None), (5, 1, "assistant", None), (6, None, "a\nb", "x"), (6, 2, "assistant", "y"), (6, 2, "assistant", "y"), (None, 0, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit("mine"))
    path = vocabulary_path("byte_bpe_50k.json")
    got = collected(chat.conversation_digests(chat.read_back(chat.turns_as_tokens(df, path), path)))
    groups = {}
    for c, t, r, x in rows:
        groups.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert len(got) == len(groups)
    for r in got:
        turns = sorted(groups[r["conv_id"]])
        learned = "".join(x for _, who, x in turns if who == "assistant")
        shown = "".join(f"{chat.START}{chat.escape_role(who)}\n{chat.escape(x)}{chat.END}\n" for _, who, x in turns)
        assert r["n_turns"] == len(turns) and r["formatted_chars"] == len(shown)
        assert r["turns_sha256"] == brute.sha("".join(f"{who}\n{x}\n" for _, who, x in turns))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), brute.sha(learned))
    lib_of = encoded_conversations(path, {c: sorted(v) for c, v in groups.items()})
    assert {r["conv_id"]: (r["n_tokens"], r["ids_sha256"], r["mask_sha256"]) for r in got} == lib_of
    placed = collected(chat.placed(chat.turns_as_tokens(df, path)).filter("conv_id = 0").orderBy("first"))
    assert [p["first"] for p in placed] == [sum(len(q["ids"]) for q in placed[:i]) for i in range(len(placed))]


PRIVATE = (
    "Dr. Ada Lund wrote to ada.lund@mail3.example.com and éan.7@mail3.example.com from 10.20.30.40. Call +1 (743) 555-3824 or (743) 555-3824, "
    'card 4111-1111-1111-1111, ssn 123-45-6789, token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"### Mrs. Ada LUND, Господин Иван Петров.'
)


def test_pii_is_replaced_alike_everywhere(spark):
    clean = "Licensed under CC BY-NC 4.0. Version 3. It is 1,234.5 and 2024-01-02; don't at 9:30."
    df = spark.createDataFrame([(1, PRIVATE), (2, clean), (3, None), (4, ""), (None, "again ada.lund@mail3.example.com 10.20.30.40"), (1, PRIVATE)], "doc_id long, text string")
    got = collected(pii.pseudonymised(df.withColumn("own", F.lit("mine")), b"k", spans="spans"))
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 6 and by[2]["text"] == clean and by[2]["spans"] == [] and by[3]["text"] is None and by[4]["text"] == ""
    new = by[1]["text"]
    for secret in ("ada.lund", "mail3", "10.20.30.40", "555-3824", "4111-1111", "123-45-6789", "24be64439", "Lund", "LUND", "Иван", "Петров"):
        assert secret not in new
    assert [s["kind"] for s in by[1]["spans"]] == ["name", "email", "email", "ip", "phone", "phone", "card", "ssn", "secret", "name", "name"]
    for s in by[1]["spans"]:
        assert PRIVATE[s["start"] : s["end"]] not in new
    found = [(a, b, k) for a, b, k, _ in pii.mentions(new)]
    assert [k for _, _, k in found] == [s["kind"] for s in by[1]["spans"]]
    part = {k: [new[a:b] for a, b, kind in found if kind == k] for k in {x[2] for x in found}}
    assert part["phone"][0] == "+1 " + part["phone"][1] and part["name"][0].lower() == part["name"][1].lower() and part["name"][1].split()[1].isupper()
    assert pii.luhn(part["card"][0].replace("-", "")) and part["email"][0].split("@")[1] == part["email"][1].split("@")[1]
    assert all("а" <= c.lower() <= "я" for c in part["name"][2].replace(" ", ""))
    assert by[None]["text"] == f"again {part['email'][0]} {part['ip'][0]}"


def test_pii_takes_plain_digits_for_a_card_by_their_check_digit():
    kinds = [[k for _, _, k, _ in pii.mentions(f"no {x} here")] for x in ("4111111111111111", "4111111111111112", "4111 1111 1111 1112")]
    assert kinds == [["card"], [], ["card"]]


@pytest.mark.parametrize("text", ['config api_key = "qwertyuiopasdf"', "access-key: abcdefghijk", "APIKEY=abcdefghijkl"])
def test_pii_finds_keys_without_other_signs(text):
    assert [kind for _, _, kind, _ in pii.mentions(text)] == [kind for _, _, kind, _ in pii.mentions(f"{text} 7")] == ["secret"]


def test_pii_short_formats_do_not_run_out(spark):
    letters = [chr(c) for c in range(97, 123)]
    entities = [("email_local", c) for c in letters] + [("ip", f"{i}.{j}.1.1") for i in range(10) for j in range(10)]
    rows = collected(pii.without_collisions(pii._drawn(spark.createDataFrame([(*e, 0, "") for e in entities], "kind string, canon string, attempt int, gender string"), b"k"), b"k", 128))
    made = {(r["kind"], r["surrogate"]) for r in rows}
    assert len(made) == len(rows) == len(entities) and not made & set(entities)
    for kind, canon in (("email_local", "a_"), ("email_domain", "a.io"), ("phone", "123456"), ("ssn", "123456789"), ("card", "4111111111111111"), ("secret", "deadbeef"), ("name_given", "ada"), ("iban", "DE89370400440532013000"), ("name_family", "王")):
        short, grown = (pii.surrogate(b"k", kind, canon, n) for n in (0, 2 * pii.DRAWS))
        assert len(grown) > len(short), kind
        if kind == "card":
            assert pii.luhn(short) and pii.luhn(grown)
        if kind == "iban":
            assert pii.account_remainder(short) == pii.account_remainder(grown) == 1
    assert pii.shaped("phone", "+49 123-456", ["98765432"]) == "+49 987-65432"


def test_pii_collisions_are_drawn_again(spark):
    domain = [f"{a}.{b}.1.1" for a in range(1, 10) for b in range(1, 10)]
    table = spark.createDataFrame([("ip", c, 0, "") for c in domain], "kind string, canon string, attempt int, gender string")
    rows = collected(pii.without_collisions(pii._drawn(table, b"k"), b"k"))
    surrogates = [r["surrogate"] for r in rows]
    assert len(set(surrogates)) == len(domain) == len(rows) and not set(surrogates) & set(domain)
    assert any(r["attempt"] > 0 for r in rows)
    df = spark.createDataFrame([(i, f"x {c} y") for i, c in enumerate(domain)], "doc_id long, text string")
    few = {r["doc_id"]: r["text"] for r in pii.pseudonymised(df, b"k").collect()}
    joined = {r["doc_id"]: r["text"] for r in pii.pseudonymised(df, b"k", max_broadcast=0).collect()}
    assert few == joined and len(set(few.values())) == len(domain)


def test_pii_follows_a_name_through_its_document(spark):
    rows = [
        (1, "Dr. Ada Lund came. Ada Lund spoke; Lund left, and ADA waited. lund is no name here."),
        (2, "Mr. Andrea Rossi met Dr. Andrea Rossi."),
        (3, "Lund alone is not found; nor is Andrea."),
        (4, "Mrs. Kim Park and Mr. Kim Noor, then Kim."),
    ]
    got = {r["doc_id"]: r for r in pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), b"k", spans="spans").collect()}
    one = got[1]["text"]
    assert len(got[1]["spans"]) == 4 and "Lund" not in one and "Ada" not in one and one.endswith("lund is no name here.")
    given, family = one.split()[1], one.split()[2]
    assert one == f"Dr. {given} {family} came. {given} {family} spoke; {family} left, and {given.upper()} waited. lund is no name here."
    words = got[2]["text"].replace(".", "").split()
    assert words[1:3] == words[5:7] and words[1][-1] in "nrsd"
    assert got[3]["text"] == rows[2][1]
    words = got[4]["text"].replace(",", "").replace(".", "").split()
    assert words[1] == words[5] == words[-1]


def test_pii_other_formats(spark):
    text = "IBAN DE89 3704 0044 0532 0130 00 at 2001:db8::ff00:42:8329, born 1970-02-03, DOB: 3/12/1988, call 2125551234; DE00ABCD0044EFGH and 12:34:56:78 stay, as does 2125551234"
    row = pii.pseudonymised(spark.createDataFrame([(1, text)], "doc_id long, text string"), b"k", spans="s").collect()[0]
    assert [s["kind"] for s in row["s"]] == ["iban", "ipv6", "birth", "birth", "phone"]
    again = pii.mentions(row["text"])
    assert [k for _, _, k, _ in again] == ["iban", "ipv6", "birth", "birth", "phone"] and row["text"].endswith("; DE00ABCD0044EFGH and 12:34:56:78 stay, as does 2125551234")
    assert row["text"][5:7] == "DE" and all(text[s["start"] : s["end"]] not in row["text"][: len(text) - 80] for s in row["s"])


def test_pii_with_clashing_columns_and_long_texts(spark):
    long = "filler words here. " * 60_000 + "Write to ada@example.org."
    df = spark.createDataFrame([(1, long, "a", "b", "c", 5)], "doc_id long, text string, new_text string, spans string, found string, did int")
    row = pii.pseudonymised(df, b"k", spans="spans").collect()[0]
    assert (row["new_text"], row["found"], row["did"]) == ("a", "c", 5) and len(row["spans"]) == 1 and "ada@" not in row["text"] and len(row["text"]) == len(long)
    with pytest.raises(TypeError):
        pii.pseudonymised(df.withColumn("doc_id", F.lit("x")), b"k")


def test_pii_equals_the_plain_version(spark):
    rng = random.Random(31)
    names = ["Ada Lund", "Ada Noor", "Kim Park", "Иван Петров", "Noor", "Mia Lund"]
    kinds = [
        lambda: f"{rng.choice(['a', 'b', 'ab', 'ba'])}@{rng.choice(['x', 'y', 'xy'])}.org", lambda: f"{rng.randrange(1, 9)}.{rng.randrange(1, 9)}.1.1", lambda: f"{rng.randrange(100, 110)}-12-3456",
        lambda: f"{rng.choice(['Mr', 'Mrs', 'Dr', 'Frau'])}. {rng.choice(names)}", lambda: rng.choice(names), lambda: rng.choice(["words", "of", "no", "Interest", "at 12:30", "3.14"]),
        lambda: f"token={rng.choice(['abcdefgh', 'deadbeef01', 'ABC/9876543'])}",
    ]
    rows = [(i, "; ".join(rng.choice(kinds)() for _ in range(rng.randrange(0, 9)))) for i in range(80)]
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), b"k").collect()}
    assert [got[i] for i, _ in rows] == brute.pseudonymised([t for _, t in rows], b"k")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_on_empty_tables(spark, tmp_path_factory, name):
    path = tmp_path_factory.mktemp(name)
    for table, schema in {
        "documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string",
        "conversations": "conv_id long, turn long, role string, text string",
    }.items():
        spark.createDataFrame([], schema).write.parquet(str(path / f"{table}.parquet"))
    assert QUERIES[name](spark, str(path)).count() == (1 if name.startswith("op5_") else 0)
