"""Churn model: feature matrix, seeded stratified split, boosted trees, scoring, threshold
choice, metrics, importances, campaign economics (M1-M13).

Everything that touches all rows is a distributed DataFrame job:
* the threshold scan (M5) and ROC-AUC / average precision (M6) work on one row per *distinct*
  score with exact running sums of positives and negatives (``operators.ranking.running_sums``),
  not on a collected score array and not in a single-partition window;
* the split (M2) takes an exact quota of each class, by a seeded md5 of the id;
* training is a ``Pipeline`` of a fitted category encoder and a booster, so a saved model scores raw feature rows.

The booster is ``boosting.HistogramBoosting`` (second-order, L1 and L2 penalties, rows and columns drawn per tree), with
the settings below; ``booster="plain"`` has no penalties and no draws, ``booster="gbt"`` is MLlib's
``GBTClassifier``.  Row and column draws differ from the reference's, so scores are close and not equal; the pipeline, the
split, the threshold rule and the metric definitions are the same.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from retainr.functions.columns import col
from retainr.functions.numeric import clip
from retainr.operators.lineage import StoredTable
from retainr.operators.ranking import at_rank, rows_at_ranks, running_sums
from retainr.plans.boosting import HistogramBoosting
from retainr.plans.encoding import CategoryEncoder
from retainr.plans.features import CATEGORICAL_COLUMNS

TARGET = "churn_label"
SCORE = "churn_proba"
LEAK_COLUMNS = ["future_orders_cnt", "user_id"]
TEST_SIZE = 0.25
SEED = 42

# Booster settings of the reference model (350 trees, depth 5, learning rate 0.06,
# row subsample 0.9, column subsample 0.85, L1 0.2, L2 1.4) and of its fallback (320 trees, depth 6, rate 0.08).
BOOSTER_PARAMS = {"maxIter": 350, "maxDepth": 5, "stepSize": 0.06, "subsamplingRate": 0.9, "columnRate": 0.85,
                  "regAlpha": 0.2, "regLambda": 1.4}
PLAIN_PARAMS = {"maxIter": 320, "maxDepth": 6, "stepSize": 0.08, "subsamplingRate": 1.0, "columnRate": 1.0,
                "regAlpha": 0.0, "regLambda": 0.0}
GBT_PARAMS = {"maxIter": 350, "maxDepth": 5, "stepSize": 0.06, "subsamplingRate": 0.9,
              "featureSubsetStrategy": "0.85"}

# Retention campaign economics defaults.
CAMPAIGN_THRESHOLD = 0.6
AVG_ORDER_VALUE_RUB = 780.0
GROSS_MARGIN_PCT = 0.28
CAMPAIGN_COST_RUB = 95.0
EXPECTED_SAVE_RATE = 0.19
TOP_K = 1000


# ---------------------------------------------------------------- M1 feature matrix

def feature_columns(dataset: DataFrame, target: str = TARGET) -> list[str]:
    """Model inputs: every numeric column except the target and the leak / id columns (trap T18); categories become numeric
    by ``encoding.CategoryEncoder``, and dates are no inputs."""
    if target not in dataset.columns:
        raise ValueError(f"no column {target!r} to learn from")
    return [f.name for f in dataset.schema.fields if isinstance(f.dataType, NumericType)
            and f.name not in (target, "label", "is_model_eligible", *LEAK_COLUMNS)]


def feature_matrix(dataset: DataFrame, target: str = TARGET) -> tuple[DataFrame, list[str]]:
    """``features`` vector + integer ``label`` column, and the feature names in vector order."""
    names = feature_columns(dataset, target)
    assembler = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
    out = assembler.transform(dataset.withColumn("label", col(target).cast("int")))
    return out, names


# ---------------------------------------------------------------- M2 split

def _draw(id_col: str, seed: int) -> Column:
    """A 60-bit integer from md5 of the seed and the id (the same in any engine)."""
    text = F.concat(F.lit(f"{seed}|"), col(id_col).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def with_test_flag(df: DataFrame, label: str = TARGET, test_size: float = TEST_SIZE, seed: int = SEED,
                   id_col: str = "user_id", out: str = "in_test") -> DataFrame:
    """Add whether a row is in the test part: in each class of the 0/1 label exactly round(test_size * rows) rows, those
    with the smallest draws (ties by id).  Found without a sort: the last such row of a class is a scalar subquery."""
    draw, tie = _draw(id_col, seed), col(id_col)
    by_class = [F.when(col(label) == value, draw) for value in (0, 1)]
    last = rows_at_ranks(df, by_class, tie,
                         lambda n: [F.round(n * test_size).cast("long")])
    flag = F.lit(False)
    for i, d in enumerate(by_class):
        e = at_rank("__last", i, 0)
        flag = flag | F.coalesce((d < e["v"]) | ((d == e["v"]) & (tie <= e["u"])), F.lit(False))
    return df.withColumn("__last", last).withColumn(out, flag).drop("__last")


def stratified_split(df: DataFrame, label: str = TARGET, test_size: float = TEST_SIZE,
                     seed: int = SEED, id_col: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """Seeded split into (train, test), exactly stratified by the 0/1 label; see ``with_test_flag``."""
    flagged = with_test_flag(df, label, test_size, seed, id_col, "__test")
    return flagged.where(~col("__test")).drop("__test"), flagged.where("__test").drop("__test")


# ---------------------------------------------------------------- M3 / M4 model and scores

def gbt_classifier(seed: int = SEED, **overrides) -> GBTClassifier:
    params = dict(GBT_PARAMS)
    params.update(overrides)
    return GBTClassifier(featuresCol="features", labelCol="label", seed=seed, **params)


def churn_pipeline(names: list[str], seed: int = SEED, booster: str = "histogram", **overrides) -> list:
    """The stages that learn the 0/1 column ``label`` from the numeric columns ``names``."""
    if booster == "gbt":
        return [VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep"), gbt_classifier(seed, **overrides)]
    params = {"histogram": BOOSTER_PARAMS, "plain": PLAIN_PARAMS}[booster] | overrides
    return [HistogramBoosting(inputCols=names, labelCol="label", scoreCol=SCORE, seed=seed, **params)]


def score(model: PipelineModel, df: DataFrame, out_col: str = SCORE) -> DataFrame:
    """Positive-class probability as a double column (M4)."""
    out = model.transform(df)
    if "probability" not in out.columns:
        return out.withColumnRenamed(SCORE, out_col)
    return out.withColumn(out_col, vector_to_array("probability").getItem(1)).drop(
        "features", "rawPrediction", "probability", "prediction")


def minmax_scores(df: DataFrame, column: str, out_col: str = SCORE) -> DataFrame:
    """M4 fallback for models without probabilities: (x - min) / max(max - min, 1e-9), with the
    extremes as one scalar subquery."""
    v = col(column).cast("double")
    ends = df.agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi"))).scalar()
    return df.withColumn("__ends", ends).withColumn(
        out_col, (v - col("__ends.lo")) / F.greatest(col("__ends.hi") - col("__ends.lo"), F.lit(1e-9))).drop("__ends")


# ---------------------------------------------------------------- M5 / M6 threshold and metrics

def score_table(scored: DataFrame, label: str = TARGET, score_col: str = SCORE) -> DataFrame:
    """One row per distinct score: pos, neg, cum_pos / cum_neg = positives / negatives with
    a score >= this one (running sums in descending score order) and the totals P, N.  Thresholds 0
    and 1 are always present (with zero counts when no row has that score)."""
    bounds = scored.sparkSession.createDataFrame([(0.0, 0, 0), (1.0, 0, 0)], "score double, pos long, neg long")
    each = scored.select(
        col(score_col).cast("double").alias("score"), (col(label) == 1).cast("long").alias("pos"),
        (col(label) != 1).cast("long").alias("neg"))
    grouped = each.unionByName(bounds).groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    down = -col("score")
    return running_sums(grouped, down, {"cum_pos": "pos", "cum_neg": "neg"}, {"P": "pos", "N": "neg"})


def threshold_scan(scored: DataFrame, label: str = TARGET, score_col: str = SCORE,
                   table: DataFrame | None = None) -> DataFrame:
    """Balanced accuracy and F1 of ``score >= t`` for every candidate threshold t (all distinct
    scores plus 0 and 1), with the confusion counts."""
    t = table if table is not None else score_table(scored, label, score_col)
    tp, fp = col("cum_pos"), col("cum_neg")
    fn, tn = col("P") - tp, col("N") - fp
    tpr = F.try_divide(tp.cast("double"), F.nullif(col("P"), F.lit(0)))
    tnr = F.try_divide(tn.cast("double"), F.nullif(col("N"), F.lit(0)))
    classes = (col("P") > 0).cast("int") + (col("N") > 0).cast("int")
    ba = (F.coalesce(tpr, F.lit(0.0)) + F.coalesce(tnr, F.lit(0.0))) / F.nullif(classes, F.lit(0))
    f1 = F.coalesce(F.try_divide((2 * tp).cast("double"), F.nullif(2 * tp + fp + fn, F.lit(0))), F.lit(0.0))
    return t.select(col("score").alias("threshold"), ba.alias("balanced_accuracy"), f1.alias("f1"),
                    tp.alias("tp"), fp.alias("fp"), tn.alias("tn"), fn.alias("fn"), "pos", "neg", "P", "N")


def _best() -> Column:
    return F.max_by(F.struct("threshold", "balanced_accuracy", "f1", "tp", "fp", "tn", "fn"),
                    F.struct("balanced_accuracy", "f1", (-col("threshold")).alias("t")))


def best_threshold(scored: DataFrame, label: str = TARGET, score_col: str = SCORE) -> DataFrame:
    """M5: the threshold with the best balanced accuracy, then the best F1, then the smallest
    threshold (order-free form of the greedy scan, trap T20).  One row."""
    return threshold_scan(scored, label, score_col).agg(_best().alias("b")).select(
        "b.threshold", "b.balanced_accuracy", "b.f1")


def classification_metrics(scored: DataFrame, threshold=None, label: str = TARGET,
                           score_col: str = SCORE) -> DataFrame:
    """M6: roc_auc, pr_auc, f1, precision, recall, tp, fp, tn, fn at ``score >= threshold``.

    ``threshold`` may be a number, a scalar Column, or None for the best balanced-accuracy
    threshold (M5) chosen on the same rows.  ROC-AUC counts ties one half (Mann-Whitney), average precision sums
    recall increase x precision over distinct scores (trap T21); both are NULL when a class is missing.  All of it is
    one aggregate over the per-distinct-score table.
    """
    scan = threshold_scan(scored, label, score_col)
    precision = F.try_divide(col("tp").cast("double"), F.nullif(col("tp") + col("fp"), F.lit(0)))
    if threshold is None:
        chosen = _best()
    else:
        thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
        over = col("threshold") >= thr
        p, n = F.sum(F.when(over, col("pos")).otherwise(0)), F.sum(F.when(over, col("neg")).otherwise(0))
        chosen = F.struct(p.alias("tp"), n.alias("fp"), (F.max("N") - n).alias("tn"), (F.max("P") - p).alias("fn"))
    one = scan.agg(
        chosen.alias("b"), F.max("P").alias("P"), F.max("N").alias("N"),
        F.sum(col("neg") * ((col("tp") - col("pos")) + col("pos") / 2.0)).alias("pairs"),
        F.sum(F.when(col("pos") > 0, col("pos") * precision)).alias("ap")).select("b.*", "P", "N", "pairs", "ap")
    tp, fp, fn = col("tp"), col("fp"), col("fn")

    def ratio(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), F.nullif(b, F.lit(0))), F.lit(0.0))

    return one.select(
        F.try_divide(col("pairs"), F.nullif(col("P") * col("N"), F.lit(0)).cast("double")).alias("roc_auc"),
        F.try_divide(col("ap"), F.nullif(col("P"), F.lit(0)).cast("double")).alias("pr_auc"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"), *[col(c).cast("double").alias(c) for c in ("tp", "fp", "tn", "fn")])


# ---------------------------------------------------------------- M7 importances

def feature_importances(model: PipelineModel, names: list[str], top_n: int = 25,
                        spark: SparkSession | None = None) -> DataFrame:
    """Top-n importances of the fitted trees (zeros when the model exposes none).  The table
    has one row per feature, so it is built from the model on the driver."""
    tree = model.stages[-1]
    values = (list(tree.featureImportances.toArray()) if hasattr(tree, "featureImportances")
              else [0.0] * len(names))
    spark = spark or SparkSession.builder.getOrCreate()
    df = spark.createDataFrame(list(zip(names, [float(v) for v in values], strict=True)), "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature").limit(top_n)


# ---------------------------------------------------------------- M8 - M11

def campaign_economics(scored: DataFrame, score_col: str = SCORE,
                       threshold: float = CAMPAIGN_THRESHOLD,
                       avg_order_value_rub: float = AVG_ORDER_VALUE_RUB,
                       gross_margin_pct: float = GROSS_MARGIN_PCT,
                       retention_campaign_cost_rub: float = CAMPAIGN_COST_RUB,
                       expected_save_rate: float = EXPECTED_SAVE_RATE) -> DataFrame:
    """M8: users with score >= threshold, campaign cost, saved users, gross uplift, net uplift,
    ROI (all zero when nobody is targeted).  One row."""
    n = scored.agg(F.count_if(col(score_col) >= threshold).cast("double").alias("n"))
    cost = col("n") * retention_campaign_cost_rub
    saved = col("n") * expected_save_rate
    gross = saved * avg_order_value_rub * gross_margin_pct
    net = gross - cost
    roi = F.coalesce(F.try_divide(net, F.nullif(cost, F.lit(0.0))), F.lit(0.0))
    return n.select(col("n").alias("n_targeted_users"), cost.alias("campaign_cost_rub"),
                    saved.alias("saved_users"), gross.alias("gross_profit_uplift_rub"),
                    net.alias("net_uplift_rub"), roi.alias("roi"))


def top_k_precision(scored: DataFrame, label: str = TARGET, score_col: str = SCORE,
                    k: int = TOP_K, id_col: str = "user_id") -> DataFrame:
    """M9: mean label of the k highest scores (k clipped to [1, n], ties by id, trap T22);
    0.0 for an empty input.  One row (k, precision_at_k)."""
    top = scored.orderBy(F.desc(score_col), F.asc(id_col)).limit(max(k, 1))
    return top.agg(F.count(F.lit(1)).alias("k"),
                   F.coalesce(F.avg(col(label).cast("double")), F.lit(0.0)).alias("precision_at_k"))


def with_quantiles(df: DataFrame, column: str, qs: list[float], out: str = "quantiles") -> DataFrame:
    """Add an array of exact quantiles of a column, with linear interpolation (pandas / ``quantile_cont``); NULL
    without values.  The values at the ranks around each quantile come from one scalar subquery."""
    v = col(column).cast("double")

    def ranks(n: Column) -> list[Column]:
        low = [F.floor((n - 1) * q) + 1 for q in qs]
        return [r for x in low for r in (x, F.least(x + 1, n))]

    values = []
    for i, q in enumerate(qs):
        lo, hi = at_rank("__at", 0, 2 * i), at_rank("__at", 0, 2 * i + 1)
        h = (lo["n"] - 1) * F.lit(q)
        values.append(lo["v"] + (h - F.floor(h)) * (hi["v"] - lo["v"]))
    found = rows_at_ranks(df, [v], None, ranks)
    return df.withColumn("__at", found).withColumn(out, F.array(*values)).drop("__at")


def winsorize(df: DataFrame, column: str, lower_q: float = 0.01, upper_q: float = 0.99,
              out_col: str | None = None) -> DataFrame:
    """Clip ``column`` to its [lower_q, upper_q] quantiles; NULL stays NULL."""
    d = with_quantiles(df, column, [lower_q, upper_q], "__q")
    return d.withColumn(out_col or column, clip(col(column).cast("double"), F.get("__q", F.lit(0)), F.get("__q", F.lit(1)))
                        ).drop("__q")


def target_summary(df: DataFrame, label_col: str = TARGET, label: str = "target") -> DataFrame:
    """Label name, number of observations, positive rate (0.0 when empty).  One row."""
    return df.agg(F.lit(label).alias("label"), F.count(F.lit(1)).alias("n_obs"),
                  F.coalesce(F.avg(col(label_col).cast("double")), F.lit(0.0))
                  .alias("positive_rate"))


def recency_scores(features: DataFrame) -> DataFrame:
    """A model-free churn score from the feature table: money per day since registration, scaled to
    [0, 1] and reversed (M4), so that it takes as many values as there are users.  Lets M5, M6, M8
    and M9 run on every table without a fitted model; a trained model's ``score`` output has the same columns."""
    f = features.select("user_id", col(TARGET).cast("int").alias(TARGET),
                        (-col("gmv_per_day")).alias("__raw"))
    return minmax_scores(f, "__raw").drop("__raw")


# ---------------------------------------------------------------- M12 / M13

def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


@dataclass
class ChurnModelResult:
    """Fitted pipeline, chosen threshold, one-row metrics, feature names and the scored
    test rows (a DataFrame, not collected arrays)."""
    model: PipelineModel
    threshold: float
    metrics: DataFrame
    feature_names: list[str]
    scored_test: DataFrame
    train: DataFrame = field(repr=False, default=None)


def train_churn_model(dataset: DataFrame, target: str = TARGET, test_size: float = TEST_SIZE,
                      seed: int = SEED, booster: str = "histogram", **overrides) -> ChurnModelResult:
    """Split, fit category encoder and boosted trees on the training rows, score the test rows, choose the
    threshold on them (trap T19) and compute the metrics.

    ``dataset`` is the feature table itself (``features.eligible(user_features(...))``) or an already widened
    ``modeling_dataset``.  The categories are those of all given rows, as in a one-hot step before the split; a row with another
    value later has 0 in all of a column's flags."""
    if target not in dataset.columns:
        raise ValueError(f"no column {target!r} to learn from")
    # features and split are read many times: they are computed once
    data = StoredTable(dataset.withColumn("label", col(target).cast("int")), "churn-data").df
    categories = [c for c in CATEGORICAL_COLUMNS if c in data.columns]
    encoder = [CategoryEncoder(inputCols=categories).fit(data)] if categories else []
    flagged = StoredTable(with_test_flag(data, target, test_size, seed, out="__test"), "churn-split").df
    train, test = flagged.where(~col("__test")).drop("__test"), flagged.where("__test").drop("__test")
    names = feature_columns(encoder[0].transform(data) if encoder else data, target)
    model = Pipeline(stages=[*encoder, *churn_pipeline(names, seed, booster, **overrides)]).fit(train)
    scored = score(model, test)
    thr = best_threshold(scored, target, SCORE).first()["threshold"]
    metrics = classification_metrics(scored, thr, target, SCORE)
    return ChurnModelResult(model, float(thr), metrics, names, scored, train)
