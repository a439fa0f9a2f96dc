"""Fixed point, calendar, features, policy predicates and decisions."""

import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from tallywick.functions import calendar
from tallywick.functions.fixedpoint import box_distance, clamp, columns, quantise, quantised, ratio, squared_distance
from tallywick.operators import policy
from tallywick.operators.decision import decision, response, vote
from tallywick.operators.features import category_risk, known_merchant, with_features
from tallywick.sources.payload import PAYLOAD

Q = columns("q")


def f32(x):
    return struct.unpack("f", struct.pack("f", x))[0]


def test_quantise_table(spark):
    cases = {0.0: 0, 1.0: 10000, -1.0: -10000, -2.0: -10000, -0.5: 0, 0.5: 5000, 1.5: 10000, 0.0001: 1, float("nan"): 0, float("inf"): 10000, float("-inf"): -10000}
    df = spark.createDataFrame([(float(x),) for x in cases], "x float")
    got = [r[0] for r in df.select(quantise(F.col("x"))).collect()]
    assert got == list(cases.values())


def test_quantise_rounds_in_32_bits(spark):
    cents = list(range(0, 1_000_001, 97))
    df = spark.createDataFrame([(c / 100,) for c in cents], "x double").select(F.col("x").cast("float").alias("x"))
    got = [r[0] for r in df.select(quantise(clamp(ratio(F.col("x"), F.lit(10000).cast("float"))))).collect()]
    assert got == [int(f32(f32(f32(f32(c / 100) / 10000) * 10000) + 0.5)) for c in cents]


def test_ratio_by_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 4.0)], "x float, y float")
    assert [r[0] for r in df.select(clamp(ratio(F.col("x"), F.col("y")))).collect()] == [1, 0, 0, 0.25]


def test_short_vectors_are_padded(spark):
    df = spark.createDataFrame([([0.5],), (None,)], "v array<float>")
    rows = [list(r) for r in df.select(*quantised(F.col("v"), "d")).collect()]
    assert rows == [[5000] + [0] * 13, [0] * 14]


def test_distances(spark):
    zero = [0] * 14
    far = [[0] * 14, [0] * 6 + [3, 4] + [0] * 6, [0] * 6 + [10000] + [0] * 7, [10000] * 14]
    rows = [(*[-10000] * 14, *f) if f[0] else (*zero, *f) for f in far]
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in Q + columns("d")))
    assert [r[0] for r in df.select(squared_distance(Q, columns("d"))).collect()] == [0, 25, 100_000_000, 14 * 20000**2]


def test_a_box_is_never_further_than_its_points(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(200):
        q, a, b = ([rng.randrange(-10000, 10001) for _ in range(14)] for _ in range(3))
        rows.append((*q, *a, *map(min, a, b), *map(max, a, b)))
    names = Q + columns("d") + columns("lo") + columns("hi")
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in names))
    both = df.select(box_distance(Q, columns("lo"), columns("hi")).alias("box"), squared_distance(Q, columns("d")).alias("point")).collect()
    assert all(r["box"] <= r["point"] for r in both)


def test_hour_and_weekday(spark):
    cases = {
        "2026-03-11T20:23:35Z": (20, 2), "2026-03-09T00:00:00Z": (0, 0), "2026-03-15T23:59:59Z": (23, 6), "2026-03-10T12:00:00Z": (12, 1), "2026-03-10T12:00:00+09:00": (12, 1),
        "2024-02-29T01:02:03.5Z": (1, 3), "2026-03-10": (0, 0), "": (0, 0), "2026-03-10T24:00:00Z": (0, 0), "2026-13-10T12:00:00Z": (12, 0), "xxxxxxxxxxxxxxxxxxxxx": (0, 0),
    }
    df = spark.createDataFrame([(s,) for s in cases], "s string")
    assert [tuple(r) for r in df.select(calendar.hour(F.col("s")), calendar.weekday(F.col("s"))).collect()] == list(cases.values())


def test_minutes_between(spark):
    cases = [
        ("2026-03-10T10:01:00Z", "2026-03-10T10:00:59Z", 1), ("2026-03-10T10:00:59Z", "2026-03-10T10:00:00Z", 0), ("2026-03-10T10:00:00Z", "2026-03-10T11:00:00Z", 0),
        ("2026-03-01T00:00:00Z", "2026-02-28T23:59:00Z", 1), ("2024-03-01T00:00:00Z", "2024-02-28T00:00:00Z", 2880), ("short", "2026-03-10T10:00:00Z", 0),
        ("2026-03-10T10:00:00Z", "", 0), ("2026-01-01T00:00:00+03:00", "2025-12-31T00:00:00-03:00", 1440),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "a string, b string")
    assert [r[0] for r in df.select(calendar.minutes_between(F.col("a"), F.col("b"))).collect()] == [c[2] for c in cases]


def payloads(spark, *bodies):
    rows = spark.createDataFrame([(json.dumps(b),) for b in bodies], "body string")
    return rows.select(F.from_json("body", PAYLOAD).alias("p")).select("p.*")


LEGIT = {
    "transaction": {"amount": 41.12, "installments": 2, "requested_at": "2026-03-11T18:45:53Z"},
    "customer": {"avg_amount": 82.24, "tx_count_24h": 3, "known_merchants": ["MERC-003", "MERC-016"]},
    "merchant": {"id": "MERC-016", "mcc": "5411", "avg_amount": 60.25},
    "terminal": {"is_online": False, "card_present": True, "km_from_home": 29.23},
    "last_transaction": None,
}
FRAUD = {
    "transaction": {"amount": 9505.97, "installments": 10, "requested_at": "2026-03-14T05:15:12Z"},
    "customer": {"avg_amount": 81.28, "tx_count_24h": 20, "known_merchants": ["MERC-008", "MERC-007", "MERC-005"]},
    "merchant": {"id": "MERC-068", "mcc": "7802", "avg_amount": 54.86},
    "terminal": {"is_online": False, "card_present": True, "km_from_home": 952.27},
    "last_transaction": None,
}


def test_features_of_known_payloads(spark):
    got = [list(r) for r in with_features(payloads(spark, LEGIT, FRAUD), []).collect()]
    assert got[0] == pytest.approx([0.004112, 0.1667, 0.05, 0.7826, 0.3333, -1, -1, 0.02923, 0.15, 0, 1, 0, 0.15, 0.006025], abs=0.001)
    assert got[1] == pytest.approx([0.9506, 0.8333, 1, 0.2174, 0.8333, -1, -1, 0.9523, 1, 0, 1, 1, 0.75, 0.0055], abs=0.001)


def test_features_of_absent_parts(spark):
    empty, present = (list(r) for r in with_features(payloads(spark, {}, {"last_transaction": {}, "transaction": {"amount": 5}}), []).collect())
    assert empty == [0, 0, 0, 0, 0, -1, -1, 0, 0, 0, 0, 1, 0.5, 0]
    assert present[5:7] == [0, 0] and present[2] == 1  # an amount over an average of 0
    assert not any(math.isnan(x) for x in empty + present)


def test_lookups(spark):
    df = spark.createDataFrame([("a", ["a", "b"], "5411"), ("a", None, "1"), (None, [""], None), (None, [None], "7995")], "m string, k array<string>, c string")
    assert [r[0] for r in df.select(known_merchant(F.col("m"), F.col("k"))).collect()] == [True, False, True, False]
    assert [round(r[0], 4) for r in df.select(category_risk(F.col("c"))).collect()] == [0.15, 0.5, 0.5, 0.85]
    assert [r[0] for r in df.select(category_risk(F.col("c"), {})).collect()] == [0.5] * 4


BOXES = {
    "boundary_online": ({5: -10000, 6: -10000, 9: 10000, 10: 0, 7: 850, 2: 1500, 12: 2000}, (True, True, False, False)),
    "boundary_present": ({5: -10000, 6: -10000, 9: 0, 10: 10000, 7: 3700, 2: 10000, 12: 8000, 8: 4000}, (True, True, False, False)),
    "wide": ({9: 10000, 10: 0, 2: 5000, 7: 3000, 12: 8500}, (True, False, False, False)),
    "late": ({0: 1400, 2: 10000, 5: 300, 6: 400, 7: 3400, 8: 2000, 9: 10000, 10: 0, 11: 0, 12: 3000}, (True, False, True, False)),
    "denial": ({5: -10000, 6: -10000, 9: 0, 10: 10000, 7: 1000, 2: 5000, 12: 2500}, (False, False, False, True)),
    "none": ({}, (False, False, False, False)),
    "late_but_known": ({0: 1400, 2: 10000, 5: 300, 6: 400, 7: 3400, 8: 2000, 9: 10000, 10: 0, 11: 10000, 12: 3000}, (True, False, False, False)),
    "wide_too_near": ({9: 10000, 10: 0, 2: 5000, 7: 2999, 12: 8500}, (False, False, False, False)),
}


def test_policy_boxes(spark):
    df = spark.createDataFrame([tuple(b.get(i, 0) for i in range(14)) for b, _ in BOXES.values()], ", ".join(f"{c} int" for c in Q))
    got = [tuple(r) for r in df.select(policy.approval_repair(), policy.boundary_approval(), policy.late_denial(), policy.denial_repair()).collect()]
    assert got == [e for _, e in BOXES.values()]


def test_ambiguous_votes(spark):
    df = spark.createDataFrame([(f, q9) for f in range(6) for q9 in (0, 10000)], "f int, q9 int")
    got = [r[0] for r in df.select(policy.ambiguous(F.col("f"))).collect()]
    assert got == [2 <= f <= 4 or (f == 1 and q9 == 0) for f in range(6) for q9 in (0, 10000)]


def test_decisions(spark):
    rows = spark.range(6).select(F.col("id").cast("int").alias("n")).select("n", *decision(F.col("n")), response(F.col("n")).alias("r")).collect()
    assert [r["approved"] for r in rows] == [n < 3 for n in range(6)]
    assert [r["fraud_score"] for r in rows] == [0, 0.2, 0.4, 0.6, 0.8, 1]
    assert json.loads(rows[3]["r"]) == {"approved": False, "fraud_score": 0.6}


def test_a_query_without_neighbours_has_no_votes(spark):
    near = spark.createDataFrame([(1, 1), (1, 0), (1, 1)], "qid long, label int")
    assert {tuple(r) for r in vote(near, spark.range(1, 3).withColumnRenamed("id", "qid")).collect()} == {(1, 2), (2, 0)}
