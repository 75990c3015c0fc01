import pytest
from pyspark.sql import functions as F

from lodestone.functions import names as N
from lodestone.functions import text as X
from lodestone.operators import stats as A


def _frame(spark, values):
    return spark.createDataFrame([("m", i, float(v)) for i, v in enumerate(values)], "k string, i long, value double")


def test_percentiles(spark):
    r = A.linear_stats(_frame(spark, range(1, 101)), ["k"]).first()
    assert (r.avg, r.p50) == (50.5, 50.5) and 95 <= r.p95 <= 96 and 99 <= r.p99 <= 100
    assert A.nearest_stats(_frame(spark, range(1, 101)), ["k"]).first().p95 == 95
    assert A.linear_stats(_frame(spark, []), ["k"]).count() == 0


@pytest.mark.parametrize(("values", "higher", "trend"), [([1000, 1000, 600, 600], False, "improving"), ([600, 600, 1000, 1000], False, "degrading"), ([500, 501, 500, 502], False, "stable"), ([0.7, 0.9], True, "improving")])
def test_trend(spark, values, higher, trend):
    assert A.halves_trend(_frame(spark, values), ["k"], ["i"], higher_is_better=higher).first().trend == trend


def test_outliers_and_moving_average(spark):
    assert [r.value for r in A.outliers(_frame(spark, [100] * 9 + [10000]), ["k"]).collect()] == [10000.0]
    assert A.outliers(_frame(spark, [5]), ["k"]).count() == 0
    assert [r.moving for r in A.moving_average(_frame(spark, [100, 150, 200, 250, 300]), ["k"], ["i"]).orderBy("i").collect()] == [150.0, 200.0, 250.0]


def test_names(spark):
    one = spark.range(1)
    key = lambda w: one.select(N.phonetic_key(F.lit(w))).first()[0]
    assert key("Smith") == key("Smythe") and key("Robert") == key("Rupert") and key("Marpa") == key("Marpah") and key("Marpa") != key("Milarepa") and key("") == "0000"
    assert one.select(N.edit_similarity(F.lit(""), F.lit(""))).first()[0] == 1.0
    assert one.select(N.name_similarity(F.lit("marpa"), F.lit("milarepa"))).first()[0] < 0.7


def test_repair_json(spark):
    assert spark.range(1).select(X.repair_json(F.lit('```json\n{"a": [1, 2,],}\n```'))).first()[0] == '{"a": [1, 2]}'


def test_numbers_over_slices_of_a_group(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(8)
    rows = [(rng.choice(("a", "b", None)), rng.choice((None, *range(40))), i, float(rng.randrange(9))) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t long, i long, value double")
    for size in (1, 7, 3600):
        got = {r["i"]: (r["_i"], r["_n"]) for r in A.numbered(df, ["k"], ["t", "i"], size).collect()}
        for k in ("a", "b", None):
            own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
            assert [got[r[2]] for r in own] == [(n + 1, len(own)) for n in range(len(own))]
    for width, run in ((3, 4), (5, 5), (4, 64), (1, 2), (500, 2)):
        got = {r["i"]: r["moving"] for r in A.moving_average(df, ["k"], ["t", "i"], width=width, run=run).select("i", F.round("moving", 9).alias("moving")).collect()}
        want = {}
        for k in ("a", "b", None):
            own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
            for n in range(min(width, len(own)) - 1, len(own)):
                part = [r[3] for r in own[max(0, n - width + 1) : n + 1]]
                want[own[n][2]] = round(sum(part) / len(part), 9)
        assert got == want


def test_nearest_over_blocks(spark):
    import numpy as np

    from lodestone.functions.scoring import nearest

    v = np.random.default_rng(4).integers(-2, 3, (60, 3)).astype(float)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame([*rows, (90, None), (91, [1.0, None, 2.0]), (92, [float("nan"), 1.0, 1.0])], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["similarity"] for r in nearest(df, df.where("vec_id % 3 = 0"), 4, 0.1, block=7, stored=11).collect()}
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
    want = {}
    for q in range(0, 60, 3):
        s = sorted((-round(float(unit[q] @ unit[j]), 6), j) for j in range(60) if j != q)
        want |= {(q, j): -x for x, j in s[:4] if -x >= 0.1}
    assert got == pytest.approx(want)
    assert nearest(df.limit(0), df).collect() == [] and nearest(df, df.limit(0)).collect() == []
