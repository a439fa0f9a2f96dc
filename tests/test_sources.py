"""Payload grammar, labelled vectors, parameters and samples."""

import gzip
import json

import pytest

from tallywick.sources import parameters, references
from tallywick.sources.payload import as_json, parsed

GOOD = '{"id":"a","transaction":{"amount":12.5,"installments":3,"requested_at":"2026-03-11T18:45:53Z"},"merchant":{"id":"m","mcc":"5411"}'
CASES = {
    GOOD + "}": True,
    GOOD + ',"more":{"x":[1,{"y":null}]}}': True,
    GOOD + "} trailing": True,
    GOOD + ",}": True,
    '{"customer":{"known_merchants":["a","b",]}}': False,
    '{"id":5}': False,
    '{"transaction":null}': False,
    '{"last_transaction":null}': True,
    '{"last_transaction":{}}': True,
    '{"transaction":{"installments":12.5}}': False,
    '{"terminal":{"km_from_home":"7"}}': False,
    '{"terminal":{"is_online":1}}': False,
    '{"transaction":{"amount":.5}}': False,
    '{"transaction":{"amount":5.}}': False,
    "{}": True,
    "": False,
    "invalid json": False,
    "[]": False,
    "null": False,
    '{"id":"x, }","merchant":{"id":"a,}b",}}': True,
}


def test_payload_grammar(spark):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(CASES)] + [(99, None)], "n int, body string")
    rows = {r["n"]: r for r in parsed(df).collect()}
    for i, (body, ok) in enumerate(CASES.items()):
        assert rows[i]["parse_ok"] == ok, body
    assert not rows[99]["parse_ok"] and rows[99]["transaction"] is None
    assert rows[0]["transaction"]["installments"] == 3 and rows[7]["last_transaction"] is None and rows[8]["last_transaction"] is not None
    assert rows[19]["merchant"]["id"] == "a,}b"


def test_a_large_payload(spark):
    body = json.dumps({"id": "x", "customer": {"known_merchants": [f"MERC-{i:05d}" for i in range(200)]}})
    df = spark.createDataFrame([(body,)], "body string")
    row = parsed(df).collect()[0]
    assert row["parse_ok"] and len(row["customer"]["known_merchants"]) == 200
    again = parsed(parsed(df).select(as_json().alias("body"))).collect()[0]
    assert again["customer"] == row["customer"]


def test_json_array_of_vectors(spark, tmp_path):
    items = [{"vector": [i / 10, 0.5], "label": "fraud" if i % 3 == 0 else "legit", "x": 1} for i in range(7)] + [{"vector": [1.0] * 14}]
    path = str(tmp_path / "references.json.gz")
    with gzip.open(path, "wt") as f:
        json.dump(items, f)
    rows = sorted(references.read_json_array(spark, path, partitions=3).collect())
    assert [r["orig_id"] for r in rows] == list(range(8))
    assert [r["label"] for r in rows] == [1, 0, 0, 1, 0, 0, 1, 0]
    assert all(len(r["vector"]) == 14 for r in rows) and rows[2]["vector"][:3] == [pytest.approx(0.2), 0.5, 0.0]
    with gzip.open(path, "wt") as f:
        json.dump([{"vector": [1.0] * 15}], f)
    with pytest.raises(Exception, match="more than 14"):
        references.read_json_array(spark, path).collect()


def test_json_arrays_are_written(spark, tmp_path):
    for n in (0, 1, 5):
        df = spark.createDataFrame([(i, [i / 7, -1.0], i % 2) for i in range(n)], "orig_id long, vector array<float>, label int")
        references.write_json_array(df.repartition(2), str(tmp_path / str(n)))
        (part,) = (tmp_path / str(n)).glob("part-*.gz")
        with gzip.open(part, "rt") as f:
            assert [x["label"] for x in json.load(f)] == [["legit", "fraud"][i % 2] for i in range(n)]
        back = sorted((r["orig_id"], r["vector"][:2], r["label"]) for r in references.read_json_array(spark, str(tmp_path / str(n))).collect())
        assert back == sorted((r["orig_id"], r["vector"], r["label"]) for r in df.collect())


def test_flat_files(spark, tmp_path):
    data = [([i + d / 100 for d in range(14)], i % 2 ^ 1) for i in range(10)]
    df = spark.createDataFrame([(i, v, y) for i, (v, y) in enumerate(data)], "orig_id long, vector array<float>, label int").repartition(3)
    references.write_flat(df, str(tmp_path / "v.bin"), str(tmp_path / "y.bin"))
    assert (tmp_path / "y.bin").read_bytes() == bytes(y for _, y in data) and len((tmp_path / "v.bin").read_bytes()) == 10 * 14 * 4
    rows = sorted(references.read_flat(spark, str(tmp_path / "v.bin"), str(tmp_path / "y.bin")).collect())
    assert len(rows) == 10 and [r["label"] for r in rows] == [y for _, y in data]
    assert rows[3]["vector"] == pytest.approx(data[3][0], rel=1e-6)
    assert references.exists(spark, str(tmp_path / "v.bin")) and not references.exists(spark, str(tmp_path / "v.bin"), str(tmp_path / "none"))


def test_parameters(tmp_path):
    path = tmp_path / "p.json"
    path.write_text('{"max_km": 7, "other": 1}')
    limits = parameters.read_limits(str(path))
    assert limits.max_km == 7 and limits.max_amount == 0
    with pytest.raises(FileNotFoundError):
        parameters.read_limits(str(tmp_path / "none"))
    assert parameters.read_category_risk(str(tmp_path / "none")) == {}
    path.write_text("{broken")
    with pytest.raises(ValueError):
        parameters.read_category_risk(str(path))
    assert parameters.setting("X", "d", {"X": ""}) == "d" and parameters.setting("X", "d", {"X": "v"}) == "v"


def plain_sample(rows, budget, share=0.55):
    fraud = [i for i, y in rows if y == 1]
    other = [i for i, y in rows if y != 1]
    nf = min(int(budget * share), len(fraud))
    no = min(budget - nf, len(other))
    picked = []
    for cls, n, turn in ((fraud, nf, 0), (other, no, 1)):
        step = len(cls) // n if n and len(cls) > n else 1
        picked += [(k, turn, cls[k]) for k in range(0, len(cls), step)][:n]
    return [i for _, _, i in sorted(picked)]


@pytest.mark.parametrize(("n", "every", "budget"), [(500, 3, 100), (500, 50, 100), (40, 2, 100), (30, 1000, 10), (0, 2, 5), (50, 2, 0)])
def test_stratified_sample(spark, n, every, budget):
    rows = [(i * 7, int(i % every == 0)) for i in range(n)]
    got = references.stratified(spark.createDataFrame(rows, "orig_id long, label int"), budget).collect()
    assert [r["orig_id"] for r in sorted(got, key=lambda r: r["position"])] == plain_sample(rows, budget)
    assert sorted(r["position"] for r in got) == list(range(len(got)))
