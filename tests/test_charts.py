"""Chart-feeding tables (V1-V6)."""

from pyspark.sql import functions as F

from retainr.plans import charts, churn
from retainr.sources.mapping import canonical_tables
from tests.conftest import SF_SMALL


def test_chart_tables(spark):
    t = canonical_tables(spark, SF_SMALL)
    o, s = t["fact_orders"], t["fact_app_sessions"]
    bars = charts.repeat_rate_bars(o).collect()
    assert [r["window_days"] for r in sorted(bars, key=lambda r: r["window_days"])] == [7, 14, 30]
    assert all(r["label"].endswith("%") for r in bars)
    bubble = charts.rfm_bubble(o)
    assert bubble.columns == ["user_id", "recency_days", "frequency_orders", "monetary_rub",
                              "segment", "rfm_score"]
    assert charts.rfm_bubble(o, fraction=0.5).count() <= bubble.count()
    m = spark.createDataFrame([(0.81234, None, 0.5, 0.25)], "roc_auc double, pr_auc double, f1 double, recall double")
    card = charts.metric_card(m).first()
    assert (card["roc_auc"], card["pr_auc"], card["f1"], card["recall"]) == (0.812, 0.0, 0.5, 0.25)
    imp = spark.createDataFrame([(f"x{i}", float(i)) for i in range(20)], "feature string, importance double")
    assert [r["feature"] for r in charts.top_importances(imp, 3).collect()] == ["x19", "x18", "x17"]
    series = charts.daily_series(s, o)
    assert series.columns == ["dt", "delivered_orders_n", "gmv_rub", "dau"]
    windows, months = charts.repeat_panels(o)
    assert windows.count() == 3 and months.count() > 0


def test_percent_text(spark):
    from retainr.functions.numeric import percent_text

    rows = [(0.1234,), (0.0,), (1.0,), (-0.05,), (None,)]
    df = spark.createDataFrame(rows, "x double")
    assert [r[0] for r in df.select(percent_text("x")).collect()] == ["12.34%", "0.00%", "100.00%", "-5.00%", None]
    assert df.select(percent_text("x", 1)).first()[0] == "12.3%"
