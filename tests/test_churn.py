"""Churn metrics against brute force in numpy, economics edge cases, a small model fit."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from retainr.plans import churn, features
from retainr.sources.mapping import canonical_tables
from tests.conftest import SF_SMALL


def _scores(spark, n=600, seed=7):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, 2, n)
    score = np.round(np.clip(rng.normal(0.4 + 0.2 * label, 0.2), 0, 1), 2)  # many ties
    pdf = pd.DataFrame({"user_id": np.arange(n), "churn_label": label, "churn_proba": score})
    return spark.createDataFrame(pdf), pdf


def _brute(pdf):
    y, s = pdf["churn_label"].to_numpy(), pdf["churn_proba"].to_numpy()
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    ap = np.mean([((s >= v) & (y == 1)).sum() / (s >= v).sum() for v in pos])
    best = (0.5, -np.inf, -np.inf)
    for t in np.unique(np.concatenate(([0.0], s, [1.0]))):
        p = s >= t
        tp, fp = (p & (y == 1)).sum(), (p & (y == 0)).sum()
        fn, tn = (~p & (y == 1)).sum(), (~p & (y == 0)).sum()
        ba = (tp / (tp + fn) + tn / (tn + fp)) / 2
        f1 = 2 * tp / (2 * tp + fp + fn) if (2 * tp + fp + fn) else 0.0
        if ba > best[1] or (ba == best[1] and f1 > best[2]):
            best = (float(t), ba, f1)
    return auc, ap, best


def test_threshold_and_metrics_match_brute_force(spark):
    df, pdf = _scores(spark)
    auc, ap, (thr, ba, f1) = _brute(pdf)
    got = churn.best_threshold(df).first()
    assert got["threshold"] == pytest.approx(thr)
    assert got["balanced_accuracy"] == pytest.approx(ba)
    assert got["f1"] == pytest.approx(f1)
    m = churn.classification_metrics(df, got["threshold"]).first()
    assert m["roc_auc"] == pytest.approx(auc)
    assert m["pr_auc"] == pytest.approx(ap)
    p = pdf["churn_proba"] >= got["threshold"]
    assert m["tp"] == float((p & (pdf["churn_label"] == 1)).sum())


def test_score_table(spark):
    df, pdf = _scores(spark, 3000)
    table = churn.score_table(df)
    t = table.orderBy(F.desc("score")).toPandas()
    assert t["cum_pos"].tolist() == t["pos"].cumsum().tolist()
    assert t["cum_neg"].iloc[-1] == (pdf["churn_label"] == 0).sum()


def test_economics_and_top_k_edges(spark):
    df, pdf = _scores(spark, 50)
    none = churn.campaign_economics(df, threshold=2.0).first()
    assert all(v == 0.0 for v in none.asDict().values())
    some = churn.campaign_economics(df, threshold=0.5).first()
    n = float((pdf["churn_proba"] >= 0.5).sum())
    assert some["n_targeted_users"] == n
    assert some["roi"] == pytest.approx((n * 0.19 * 780 * 0.28 - n * 95) / (n * 95))
    k = churn.top_k_precision(df, k=1000).first()
    assert k["k"] == 50 and k["precision_at_k"] == pytest.approx(pdf["churn_label"].mean())
    empty = churn.top_k_precision(df.limit(0)).first()
    assert empty["precision_at_k"] == 0.0
    assert churn.target_summary(df.limit(0)).first()["positive_rate"] == 0.0


def test_winsorize_matches_pandas(spark):
    pdf = pd.DataFrame({"x": [1.0, 2, 3, 4, 5, 6, 7, 8, 9, 10, None]})
    df = spark.createDataFrame(pdf)
    got = churn.winsorize(df, "x", out_col="w").toPandas()["w"]
    want = pdf["x"].clip(pdf["x"].quantile(0.01), pdf["x"].quantile(0.99))
    assert got.iloc[:10].tolist() == pytest.approx(want.iloc[:10].tolist())
    assert pd.isna(got.iloc[10])


def test_exact_stratified_split(spark):
    df, pdf = _scores(spark, 1001)
    train, test = churn.stratified_split(df)
    counts = pdf["churn_label"].value_counts()
    got = {r[0]: r[1] for r in test.groupBy("churn_label").count().collect()}
    assert got == {k: int(round(0.25 * v)) for k, v in counts.items()}
    assert train.count() + test.count() == 1001
    assert train.join(test, "user_id").count() == 0


def test_feature_matrix_requires_target(spark):
    df, _ = _scores(spark, 10)
    with pytest.raises(ValueError):
        churn.feature_columns(df.drop("churn_label"))


def test_small_model_fit_save_load(spark, scratch):
    t = canonical_tables(spark, SF_SMALL)
    feats = features.user_features(t["dim_users"], t["fact_orders"], t["fact_app_sessions"],
                                   t["fact_ab_test_assignments"], test_id="free_delivery_banner_v1")
    data = features.modeling_dataset(feats, eligible_only=False)
    res = churn.train_churn_model(data, maxIter=3, maxDepth=3)
    assert 0.0 <= res.threshold <= 1.0
    assert "future_orders_cnt" not in res.feature_names and "user_id" not in res.feature_names
    m = res.metrics.first()
    assert m["tp"] + m["fp"] + m["tn"] + m["fn"] == res.scored_test.count()
    imp = churn.feature_importances(res.model, res.feature_names, top_n=5).collect()
    assert len(imp) == 5
    path = churn.save_model(res.model, f"{scratch}/model")
    again = churn.score(churn.load_model(path), res.scored_test.drop("churn_proba"))
    a = res.scored_test.select("user_id", F.col("churn_proba").alias("a"))
    assert again.join(a, "user_id").where(F.abs(F.col("churn_proba") - F.col("a")) > 1e-12).count() == 0


def test_top_k(spark):
    df, pdf = _scores(spark, 400)
    got = churn.top_k_precision(df, k=123).first()
    want = pdf.sort_values(["churn_proba", "user_id"], ascending=[False, True]).head(123)
    assert got["k"] == 123 and got["precision_at_k"] == pytest.approx(want["churn_label"].mean())
