"""Rows at given ranks, tiles, bins, running sums and exact rounding."""

import random
from decimal import ROUND_HALF_UP, Decimal, getcontext

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from retainr.functions.numeric import avg_round, round_ratio
from retainr.operators import ranking
from retainr.operators.ranking import quantile_bin_end, running_sums, with_tiles
from retainr.plans import churn


def _data(spark, n=5000):
    # a third of the rows share one value: heavy ties are split by the tie key
    return spark.range(n).select(
        F.col("id").alias("user_id"),
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise((F.col("id") * 7919) % 100_003 - 300).cast("long").alias("m"))


def _largest_share(df, order, key):
    """Share of the rows that the largest range holds."""
    per = ranking.with_range(df.select(F.lit(0).alias("o"), F.struct(order, key).alias("k")), "o", "k", "b").groupBy("b").count()
    n, most, ranges = per.agg(F.sum("count"), F.max("count"), F.count("*")).first()
    assert ranges > ranking.RANGES / 2
    return most / n


SHAPES = {
    "epoch microseconds": "id + 1735689600000000",
    "pareto": f"CAST(FLOOR(POW(PMOD(XXHASH64(id), {1 << 40}L) / {1 << 40}L + 1e-6, -2.5)) AS LONG)",
    "a third is one value": "IF(id % 3 = 0, 5L, id)",
    "only three values": "id % 3",
}


@pytest.mark.parametrize("shape", SHAPES)
def test_ranges_are_balanced_and_tiles_exact(spark, shape):
    """10^6 rows: no range over twice the mean, so no task sorts more than 0.2 % of the rows; NTILE equals SQL."""
    n = 1_000_000
    df = spark.range(n).select((F.col("id") + 10**15).alias("user_id"), F.expr(SHAPES[shape]).alias("m"))
    assert _largest_share(df, F.col("m"), F.col("user_id")) < 2 / ranking.RANGES
    got = with_tiles(df, {"t": F.col("m")}, F.col("user_id"), 5)
    want = df.withColumn("t", F.ntile(5).over(Window.orderBy("m", "user_id")))
    assert got.exceptAll(want).count() == 0


def test_heavy_tailed_scores(spark):
    """Min-max scaled Pareto scores crowd near 0: running sums stay exact and every range small."""
    raw = spark.range(1, 200_001).select((F.lit(1e9) / F.pow(F.col("id").cast("double"), 1.2)).alias("x"), (F.col("id") % 7).alias("w"))
    scores = raw.crossJoin(F.broadcast(raw.agg(F.max("x").alias("top")))).select((F.col("x") / F.col("top")).alias("k"), "w")
    d = ranking.with_range(scores.withColumn("o", F.lit(0)), "o", "k", "b").groupBy("b").count()
    assert d.agg(F.max("count")).first()[0] < 2 * 200_000 / ranking.RANGES
    got = running_sums(scores, F.col("k"), {"cum": "w"}).toPandas().sort_values("k")
    assert got["cum"].tolist() == got["w"].cumsum().tolist()


def test_hot_value_without_a_tie_is_counted_before_the_shuffle(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 1.5).otherwise(F.col("id") / 7.0).alias("x"))
    got = churn.with_quantiles(df, "x", [0.0, 0.01, 0.3, 0.5, 0.99, 1.0]).first()["quantiles"]
    assert got == pytest.approx(df.toPandas()["x"].quantile([0.0, 0.01, 0.3, 0.5, 0.99, 1.0]).tolist(), abs=1e-12)
    assert churn.with_quantiles(df.where("x < 0"), "x", [0.5]).count() == 0


@pytest.mark.parametrize("n", [0, 1, 3, 7, 13, 2000])
def test_tiles_match_sql_ntile_and_pandas_qcut(spark, n):
    df = _data(spark, n)
    got = with_tiles(df, {"t": F.col("m"), "u": -F.col("m")}, F.col("user_id"), 5)
    got = with_tiles(got, {"q": F.col("m")}, F.col("user_id"), 5, quantile_bin_end).toPandas()
    ref = df.withColumn("t", F.ntile(5).over(Window.orderBy("m", "user_id"))).withColumn(
        "u", F.ntile(5).over(Window.orderBy(-F.col("m"), "user_id"))).toPandas()
    got, ref = (x.sort_values("user_id").reset_index(drop=True) for x in (got, ref))
    assert got["t"].tolist() == ref["t"].tolist() and got["u"].tolist() == ref["u"].tolist()
    if n >= 5:
        ranks = ref.sort_values(["m", "user_id"])["m"].rank(method="first")
        want = pd.qcut(ranks, 5, labels=[1, 2, 3, 4, 5]).astype(int)
        assert got["q"].tolist() == want.sort_index().tolist()
    elif n == 1:
        assert got["q"].tolist() == [1]


def test_running_sums(spark):
    df = spark.range(1, 3001).select((F.col("id") * 37 % 3001 / 3001).alias("k"), (F.col("id") % 7).alias("w"))
    got = running_sums(df, F.col("k"), {"cum": "w"}, {"all": "w"}).toPandas().sort_values("k")
    assert got["cum"].tolist() == got["w"].cumsum().tolist()
    assert set(got["all"]) == {got["w"].sum()}


def test_round_ratio_is_exact_far_beyond_64_bits(spark):
    getcontext().prec = 60
    rng = random.Random(7)
    pairs = [(rng.randint(-10**rng.randint(1, 22), 10**rng.randint(1, 22)), rng.randint(1, 10**rng.randint(1, 12)))
             for _ in range(3000)]
    pairs += [(k * 5, 1000) for k in range(-40, 40)]          # exact ties at the 3rd decimal
    df = spark.createDataFrame([(Decimal(n), d) for n, d in pairs], "n decimal(38,0), d long")
    for n, d, r2, r4 in df.select("n", "d", round_ratio("n", "d", 2), round_ratio("n", "d", 4)).collect():
        for digits, r in ((2, r2), (4, r4)):
            want = (abs(n) / d).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP)
            assert r == float(-want if n < 0 else want), (n, d, digits, r, want)
    assert spark.createDataFrame([(5, 0)], "n long, d long").select(round_ratio("n", "d", 2)).first()[0] is None


def test_avg_round_of_huge_sums(spark):
    df = spark.range(4000).select((F.lit(9 * 10**15) + F.col("id")).cast("decimal(20,2)").alias("x"))
    assert df.agg(avg_round("x", 2, 2)).first()[0] == pytest.approx(9 * 10**15 + 1999.5)
