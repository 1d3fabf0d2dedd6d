"""Histogram boosting against a plain booster on the rows themselves, category encoder, saved pipelines."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

import __spark_entry__ as E
from retainr.plans import boosting, churn, features
from retainr.plans.boosting import UNIT, HistogramBoosting, HistogramBoostingModel, draws, gradients, tree_columns
from retainr.plans.encoding import CategoryEncoder
from retainr.plans.registry import QUERIES
from retainr.sources.mapping import canonical_tables
from tests.conftest import SF_SMALL

NAMES = ["a", "b", "c", "flag", "empty"]


def _rows(n=700, seed=3):
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=n), rng.integers(0, 9, n).astype(float), rng.gamma(0.5, 3, n)
    flag = (rng.random(n) < 0.2).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(-(1.5 * a - 0.4 * b * flag + 0.2 * c)))).astype(int)
    a[rng.random(n) < 0.15] = np.nan
    return [(i, int(y[i]), None if np.isnan(a[i]) and i % 2 else float(a[i]), float(b[i]), float(c[i]), float(flag[i]), None)
            for i in range(n)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id long, label int, a double, b double, c double, flag double, empty double")


class Plain:
    """The same booster, row by row: every candidate split is tried by going through the rows of the node."""

    def __init__(self, rows, keys, depth, alpha, lam, rate, child, share, column_share, seed):
        self.y = np.array([r[1] for r in rows], dtype=float)
        self.x = np.array([[np.nan if v is None else v for v in r[2:]] for r in rows])
        self.keys, self.seed, self.share, self.column_share = keys, seed, share, column_share
        self.depth, self.alpha, self.lam, self.rate, self.child = depth, alpha, lam, rate, child
        self.margin = np.zeros(len(rows))

    def _score(self, g, h):
        t = max(abs(g) - self.alpha, 0.0)
        return t * t / max(h + self.lam, 1e-12)

    def _split(self, rows, columns, g, h):
        total_g, total_h = int(g[rows].sum()) / UNIT, int(h[rows].sum()) / UNIT
        best = None
        for c in columns:
            x = self.x[:, c]
            values = np.unique(self.x[:, c][~np.isnan(self.x[:, c])])[:-1]
            for t in values.tolist():
                for left_too in (False, True):
                    left = [r for r in rows if (left_too if math.isnan(x[r]) else x[r] <= t)]
                    gl, hl = int(g[left].sum()) / UNIT, int(h[left].sum()) / UNIT
                    gr, hr = total_g - gl, total_h - hl
                    if hl < self.child or hr < self.child:
                        continue
                    gain = self._score(gl, hl) + self._score(gr, hr) - self._score(total_g, total_h)
                    if gain > boosting.MIN_GAIN and (best is None or gain > best[0]):
                        best = (gain, c, t, left_too, left)
        return best

    def grow(self, number):
        g, h = gradients(self.margin, self.y)
        used = np.flatnonzero(draws(self.keys, self.seed, number) < self.share).tolist()
        columns = tree_columns(self.x.shape[1], self.column_share, self.seed, number).tolist()
        out = {}

        def node(at, rows, everyone, level):
            s = self._split(rows, columns, g, h) if level < self.depth else None
            if s is None:
                gs, hs = int(g[rows].sum()) / UNIT, int(h[rows].sum()) / UNIT
                w = -self.rate * math.copysign(max(abs(gs) - self.alpha, 0.0), gs) / max(hs + self.lam, 1e-12)
                out[at] = ("leaf", w)
                self.margin[everyone] += w
                return
            gain, c, t, left_too, left = s
            out[at] = ("split", c, t, left_too)
            x, inside = self.x[:, c], set(left)
            go = [r for r in everyone if (left_too if math.isnan(x[r]) else x[r] <= t)]
            node(2 * at, left, go, level + 1)
            node(2 * at + 1, [r for r in rows if r not in inside], [r for r in everyone if r not in set(go)], level + 1)

        node(1, used, list(range(len(self.y))), 0)
        return out


@pytest.mark.parametrize("share,column_share,rewrite", [(1.0, 1.0, 16), (0.8, 0.6, 2)])
def test_same_trees_as_the_plain_booster(spark, monkeypatch, share, column_share, rewrite):
    monkeypatch.setattr(boosting, "REWRITE", rewrite)
    rows = _rows(220)
    df = _frame(spark, rows).repartition(3, "id")
    keys = np.array([r[0] for r in df.select("id", F.xxhash64("id").alias("k")).orderBy("id").select("k").collect()])
    model = HistogramBoosting(inputCols=NAMES, keyCol="id", maxIter=5, maxDepth=3, stepSize=0.3, subsamplingRate=share,
                              columnRate=column_share, regAlpha=0.2, regLambda=1.4, seed=7).fit(df)
    plain = Plain(rows, keys, 3, 0.2, 1.4, 0.3, 1.0, share, column_share, 7)
    split = 0
    for number, tree in enumerate(model.fitted_trees()):
        want = plain.grow(number)
        got = {}
        for at in range(1, len(tree.column)):
            if at in want:
                got[at] = (("split", tree.column[at], tree.threshold[at], tree.missing_left[at]) if tree.column[at] >= 0
                           else ("leaf", tree.value[at]))
        assert got == want, number
        split += sum(v[0] == "split" for v in want.values())
    assert split >= 10
    scores = [r[0] for r in model.transform(df).orderBy("id").select("probability").collect()]
    assert scores == pytest.approx((1 / (1 + np.exp(-plain.margin))).tolist(), abs=1e-12)


def test_trees_do_not_depend_on_partitions(spark):
    df = _frame(spark, _rows())
    fit = HistogramBoosting(inputCols=NAMES, keyCol="id", maxIter=3, maxDepth=4, maxBins=32)
    models = [fit.fit(df.repartition(n)).getOrDefault("trees") for n in (1, 7)]
    assert models[0] == models[1]


def test_penalties_and_edges(spark):
    df = _frame(spark, _rows())
    heavy = HistogramBoosting(inputCols=NAMES, keyCol="id", maxIter=1, regAlpha=1e6).fit(df)
    assert heavy.fitted_trees()[0].value[1] == 0.0 and list(heavy.featureImportances.toArray()) == [0.0] * 5
    scored = heavy.transform(df.where("id < 3"))
    assert [r.probability for r in scored.collect()] == [0.5] * 3
    with pytest.raises(ValueError):
        HistogramBoosting(inputCols=NAMES, maxIter=1).fit(df.limit(0))
    some = HistogramBoosting(maxIter=2, maxDepth=2, keyCol="id").fit(df.withColumn("label", F.expr("if(id < 5, null, label)")))
    assert some.getInputCols() == NAMES and 0 <= some.transform(df).agg(F.max("probability")).first()[0] <= 1


def test_importances_and_auc(spark):
    df = _frame(spark, _rows(1500))
    model = HistogramBoosting(inputCols=NAMES, keyCol="id", maxIter=12, stepSize=0.3, maxDepth=3).fit(df)
    weights = model.featureImportances.toArray()
    assert weights.sum() == pytest.approx(1) and weights[4] == 0 and weights[0] == max(weights)
    scored = model.transform(df).select("id", F.col("label").alias("churn_label"), F.col("probability").alias("churn_proba"))
    assert churn.classification_metrics(scored).first()["roc_auc"] > 0.8


def test_encoder(spark, scratch):
    df = spark.createDataFrame([(1, "x", "p", 5), (2, None, "q", 6), (3, "y", "p", 7)], "id long, c string, d string, n int")
    model = CategoryEncoder(inputCols=["c", "d"]).fit(df)
    assert model.output_columns() == ["c_unknown", "c_x", "c_y", "d_p", "d_q"]
    model.write().overwrite().save(f"{scratch}/encoder")
    again = type(model).load(f"{scratch}/encoder")
    new = spark.createDataFrame([(4, "z", None, 8), (5, None, "q", 9)], df.schema)
    got = [tuple(r) for r in again.transform(new).orderBy("id").collect()]
    assert got == [(4, 8, 0, 0, 0, 0, 0), (5, 9, 1, 0, 0, 0, 1)]  # unseen values and unseen nulls are 0 everywhere
    with pytest.raises(ValueError):
        CategoryEncoder(inputCols=["c", "d"], maxCategories=2).fit(df)


def _features(spark):
    t = canonical_tables(spark, SF_SMALL)
    return features.user_features(t["dim_users"], t["fact_orders"], t["fact_app_sessions"],
                                  t["fact_ab_test_assignments"], test_id="free_delivery_banner_v1")


def test_saved_pipeline_scores_raw_features(spark, scratch):
    raw = _features(spark)  # all users: few of this size are eligible
    res = churn.train_churn_model(raw, maxIter=3, maxDepth=3, minChildWeight=0.05)
    assert not {"future_orders_cnt", "user_id", "label", "is_model_eligible"} & set(res.feature_names)
    assert "city_ASIA" in res.feature_names and "days_since_last_order" in res.feature_names
    assert res.scored_test.count() + res.train.count() == raw.count()
    path = churn.save_model(res.model, f"{scratch}/model")
    loaded = churn.load_model(path)
    assert isinstance(loaded, PipelineModel) and isinstance(loaded.stages[-1], HistogramBoostingModel)
    # new rows, straight from the feature table, with a value nobody has seen and one that is missing
    new = raw.withColumns({"city": F.lit("ATLANTIS"), "gender": F.lit(None).cast("string")})
    scored = churn.score(loaded, new)
    assert scored.count() == raw.count() and scored.where("churn_proba > 0 AND churn_proba < 1").count() == raw.count()
    same = churn.score(loaded, raw).join(res.scored_test.select("user_id", F.col("churn_proba").alias("p")), "user_id")
    assert same.where(F.abs(F.col("churn_proba") - F.col("p")) > 1e-12).count() == 0
    top = churn.feature_importances(res.model, res.feature_names, top_n=5, spark=spark).collect()
    assert len(top) == 5 and top[0].importance > 0


def test_widened_dataset_and_fitted_encoder(spark):
    raw = _features(spark)
    encoder = CategoryEncoder(inputCols=features.CATEGORICAL_COLUMNS).fit(features.eligible(raw))
    sc = spark.sparkContext
    sc.setJobGroup("lazy", "lazy")
    try:
        wide = features.modeling_dataset(raw, encoder=encoder)
        assert sc.statusTracker().getJobIdsForGroup("lazy") == []
    finally:
        sc.setJobGroup("tests", "tests")
    assert wide.columns == features.modeling_dataset(raw).columns
    res = churn.train_churn_model(wide, maxIter=2, maxDepth=2, booster="plain")
    assert res.feature_names == [c for c in wide.columns if c not in ("churn_label", "user_id", "future_orders_cnt")]


def test_registered_scores(spark):
    got = E.queries()["churn_model_scores"](spark, SF_SMALL).toPandas()
    assert list(got.columns) == ["user_id", "churn_label", "churn_proba"] and got.user_id.is_unique
    again = E.queries()["churn_model_scores"](spark, SF_SMALL).toPandas()
    assert got.sort_values("user_id").values.tolist() == again.sort_values("user_id").values.tolist()
    assert "churn_model_scores" not in QUERIES
    assert Pipeline(stages=churn.churn_pipeline(["a"], booster="gbt", maxIter=1)).getStages()
