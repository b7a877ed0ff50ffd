import random
import statistics

import pytest
from pyspark.sql import functions as F

from fluxalign.operators import quantiles
from fluxalign.operators.quantiles import exact_quantiles

SHARES = {"q1": 0.25, "mid": 0.5, "q3": 0.75}


def brute(values, p):
    values = sorted(values)
    at = p * (len(values) - 1)
    low = int(at)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)


@pytest.mark.parametrize("broadcast", [True, False])
def test_quantiles_of_hard_values(spark, broadcast, monkeypatch):
    """Ties, both signs, both zeros, subnormal and huge values, nulls, a null group, single rows."""
    if not broadcast:
        monkeypatch.setattr(quantiles, "BROADCAST_ROWS", 0)
    rng = random.Random(3)
    hard = [0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, 1.0, 1.0, 1.0000000000000002, -1.0]
    groups = {"a": [rng.gauss(0, 1) for _ in range(501)], "b": [rng.choice([-2.5, 0.0, 7.0]) for _ in range(400)], "c": hard, "d": [4.0], None: [rng.uniform(-1e-9, 1e9) for _ in range(60)]}
    rows = [(g, i, v) for g, values in groups.items() for i, v in enumerate(values)] + [("a", -1, None), ("e", 0, None)]
    df = spark.createDataFrame(rows, "g string, i int, value double")
    members = F.when(F.col("i") % 3 != 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    got = {(r.g, r.member): r for r in exact_quantiles(df, ["g"], "value", SHARES, members).collect()}
    want = {(g, k): [v for i, v in enumerate(values) if k == 0 or i % 3] for g, values in groups.items() for k in (0, 1)}
    assert set(got) == {key for key, values in want.items() if values}
    for key, r in got.items():
        assert [r.q1, r.mid, r.q3] == [pytest.approx(brute(want[key], p), rel=1e-15, abs=0) for p in SHARES.values()], key


def test_quantiles_of_an_empty_table(spark):
    df = spark.createDataFrame([], "g string, value double")
    assert exact_quantiles(df, ["g"], "value", SHARES).columns == ["g", "member", "q1", "mid", "q3"]
    assert exact_quantiles(df, ["g"], "value", SHARES).count() == 0


def test_key_keeps_order_and_value(spark):
    values = [-1e308, -2.0, -5e-324, 0.0, 5e-324, 0.1, 2.0, 1e308]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", quantiles.order_key(F.col("v")).alias("k"))
    rows = df.withColumn("back", quantiles.from_key(F.col("k"))).collect()
    assert [r.v for r in sorted(rows, key=lambda r: r.k % (1 << 64))] == values and all(r.v == r.back for r in rows)
    assert statistics.median(values) == 0.0 + 5e-324 / 2
