"""Second-order histogram boosting for 0/1 labels (M3), as an ML Estimator and Model.

Trees are grown on gradients g = p - y and Hessians h = p (1 - p) of the logistic loss.  With T(G) = sign(G) max(|G| - regAlpha, 0), a
set of rows with sums G and H scores T(G)^2 / (H + regLambda); a split gains the scores of its sides less that of
the node, and a leaf adds -stepSize T(G) / (H + regLambda) to the margin.  Each tree sees a share of the rows (a seeded hash of the row's key) and of
the columns (a seeded draw on the driver); a row without a value follows the direction that gained more in training.

The rows are binned once (at most ``maxBins`` quantile bins a column, a byte each) into a stored table.  A level of a tree is
one job: every task adds up g and h of its rows by (node, column, bin) and Spark adds up the tasks, so what reaches the driver is a histogram
whose size is fixed by nodes, columns and bins.  g and h are summed as integers (units of 2**-28): the sums, and the trees with them, do not depend on
the order of rows or tasks, nor on lost and repeated ones.  Margins are written back every ``REWRITE`` trees; in between
a task adds the newest trees itself.

Scoring is a native expression, a CASE for each tree.

Edge cases: rows whose label is null are not used; null and NaN values are missing; a column without values is never split; without rows
``fit`` raises ValueError.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from retainr.functions.columns import col
from retainr.operators.lineage import StoredTable

UNIT = 1 << 28
REWRITE = 16
MIN_GAIN = 1e-6
MAX_BINS = 254


@dataclass
class Tree:
    """A tree in heap order: the children of node i are 2i (left) and 2i + 1; ``column`` is -1 at a leaf."""

    column: list[int]
    cut: list[int]  # a row goes left if its bin is at most this
    threshold: list[float]  # ... if its value is at most this
    missing_left: list[bool]
    value: list[float]  # what a leaf adds to the margin
    gain: list[float] = field(default_factory=list)

    @classmethod
    def root(cls, depth: int) -> Tree:
        n = 2 << depth
        return cls([-1] * n, [0] * n, [0.0] * n, [False] * n, [0.0] * n, [0.0] * n)

    def nodes_of(self, bins: np.ndarray) -> np.ndarray:
        """Leaf (or open node) of each row of bins."""
        column, cut, left = np.array(self.column), np.array(self.cut), np.array(self.missing_left)
        at = np.ones(len(bins), dtype=np.int64)
        rows = np.arange(len(bins))
        while True:
            c = column[at]
            inner = c >= 0
            if not inner.any():
                return at
            b = bins[rows, np.where(inner, c, 0)]
            goes_left = np.where(b == 0, left[at], b <= cut[at])
            at = np.where(inner, 2 * at + 1 - goes_left, at)

    def values_of(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes_of(bins)]

    def sql(self, names: list[str], at: int = 1) -> str:
        """The tree as a SQL expression of the columns."""
        if self.column[at] < 0:
            return f"{self.value[at]!r}D"
        x = "CAST(`" + names[self.column[at]].replace("`", "``") + "` AS DOUBLE)"
        small = f"{x} <= {self.threshold[at]!r}D"
        left = f"({x} IS NULL OR isnan({x}) OR {small})" if self.missing_left[at] else f"({small} AND NOT isnan({x}))"
        return f"CASE WHEN {left} THEN {self.sql(names, 2 * at)} ELSE {self.sql(names, 2 * at + 1)} END"


def draws(keys: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """A number in [0, 1) for each row key: the same for a key wherever and however often it is computed."""
    z = keys.view(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def tree_columns(n: int, share: float, seed: int, tree: int) -> np.ndarray:
    """The columns a tree may split on."""
    k = max(1, math.floor(n * share))
    return np.sort(np.random.default_rng([seed, tree]).permutation(n)[:k])


def gradients(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """g and h in units of 1 / UNIT."""
    p = 1.0 / (1.0 + np.exp(-margin))
    return np.rint((p - label) * UNIT).astype(np.int64), np.rint(p * (1.0 - p) * UNIT).astype(np.int64)


def bin_of(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """0 for a missing value, else 1 + the number of cuts below it."""
    out = np.searchsorted(cuts, values, side="left") + 1
    out[np.isnan(values)] = 0
    return out.astype(np.uint8)


@dataclass
class _Penalty:
    alpha: float
    lambda_: float
    rate: float
    min_child: float

    def score(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        t = np.maximum(np.abs(g) - self.alpha, 0.0)
        return t * t / np.maximum(h + self.lambda_, 1e-12)

    def leaf(self, g: float, h: float) -> float:
        return float(-self.rate * math.copysign(max(abs(g) - self.alpha, 0.0), g) / max(h + self.lambda_, 1e-12))


def best_split(g: np.ndarray, h: np.ndarray, n_cuts: np.ndarray, penalty: _Penalty):
    """(gain, column, cut, missing left, (g, h) of the left side) of a node's histograms [column, bin]; None if no split gains.

    Ties go to the first column, then the smallest cut, then missing values to the right."""
    total_g, total_h = g[0].sum() / UNIT, h[0].sum() / UNIT
    below_g, below_h = np.cumsum(g[:, 1:], axis=1)[:, :-1], np.cumsum(h[:, 1:], axis=1)[:, :-1]
    gl = np.stack([below_g, below_g + g[:, :1]], axis=2) / UNIT
    hl = np.stack([below_h, below_h + h[:, :1]], axis=2) / UNIT
    gr, hr = total_g - gl, total_h - hl
    gain = penalty.score(gl, hl) + penalty.score(gr, hr) - penalty.score(total_g, total_h)
    allowed = (hl >= penalty.min_child) & (hr >= penalty.min_child)
    allowed &= (np.arange(1, gl.shape[1] + 1)[None, :] <= n_cuts[:, None])[:, :, None]
    gain = np.where(allowed, gain, -np.inf)
    at = int(gain.argmax())
    if not gain.size or not gain.flat[at] > MIN_GAIN:
        return None
    column, cut, left = (int(x) for x in np.unravel_index(at, gain.shape))
    sums = tuple(int(below[column, cut] + (x[column, 0] if left else 0)) for x, below in ((g, below_g), (h, below_h)))
    return float(gain.flat[at]), column, cut + 1, bool(left), sums


class _BoostingParams(HasInputCols, HasLabelCol, HasSeed):
    scoreCol = Param(Params._dummy(), "scoreCol", "column of the probability of label 1", TypeConverters.toString)
    keyCol = Param(Params._dummy(), "keyCol", "id of a row, for drawing rows", TypeConverters.toString)
    ignoredCols = Param(Params._dummy(), "ignoredCols", "columns that are no inputs", TypeConverters.toListString)
    maxIter = Param(Params._dummy(), "maxIter", "number of trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a tree", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "learning rate", TypeConverters.toFloat)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of the rows for a tree", TypeConverters.toFloat)
    columnRate = Param(Params._dummy(), "columnRate", "share of the columns for a tree", TypeConverters.toFloat)
    regAlpha = Param(Params._dummy(), "regAlpha", "L1 penalty", TypeConverters.toFloat)
    regLambda = Param(Params._dummy(), "regLambda", "L2 penalty", TypeConverters.toFloat)
    minChildWeight = Param(Params._dummy(), "minChildWeight", "least sum of h on a side", TypeConverters.toFloat)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a column, 254 at most", TypeConverters.toInt)


def _quantile_cuts(df: DataFrame, names: list[str], bins: int) -> list[np.ndarray]:
    """Ascending cuts of each column between its smallest and largest value: one aggregate for all columns."""
    shares = [i / bins for i in range(bins + 1)]
    value = [F.nanvl(col(f"`{n}`").cast("double"), F.lit(None).cast("double")) for n in names]
    rows = df.agg(*[F.percentile_approx(v, shares, 100 * bins).alias(str(i)) for i, v in enumerate(value)]).first()
    return [np.unique(np.array(r, dtype=np.float64))[:-1] if r else np.empty(0) for r in rows]


class HistogramBoosting(Estimator, _BoostingParams, DefaultParamsReadable, DefaultParamsWritable):
    """See the module; without ``inputCols`` every numeric column is an input but the label, the key and ``ignoredCols``."""

    @keyword_only
    def __init__(self, *, inputCols=None, labelCol="label", scoreCol="probability", keyCol=None, ignoredCols=None, maxIter=350,
                 maxDepth=5, stepSize=0.06, subsamplingRate=0.9, columnRate=0.85, regAlpha=0.2, regLambda=1.4,
                 minChildWeight=1.0, maxBins=MAX_BINS, seed=42):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        self._setDefault(labelCol="label", scoreCol="probability", ignoredCols=[], maxIter=350, maxDepth=5, stepSize=0.06,
                         subsamplingRate=0.9, columnRate=0.85, regAlpha=0.2, regLambda=1.4, minChildWeight=1.0,
                         maxBins=MAX_BINS, seed=42)

    def _names(self, dataset: DataFrame) -> list[str]:
        if self.isDefined(self.inputCols):
            return self.getInputCols()
        no_input = {self.getLabelCol(), *self.getOrDefault(self.ignoredCols)}
        if self.isDefined(self.keyCol):
            no_input.add(self.getOrDefault(self.keyCol))
        return [f.name for f in dataset.schema.fields if isinstance(f.dataType, NumericType) and f.name not in no_input]

    def _fit(self, dataset: DataFrame) -> HistogramBoostingModel:
        names, p = self._names(dataset), {x.name: self.getOrDefault(x) for x in self.params if self.isDefined(x)}
        rows = dataset.where(col(p["labelCol"]).isNotNull())
        cuts = _quantile_cuts(rows, names, min(p["maxBins"], MAX_BINS))
        key = F.xxhash64(*([p["keyCol"]] if "keyCol" in p else [f"`{n}`" for n in names]))
        state = StoredTable(rows.select(
            key.alias("key"), col(p["labelCol"]).cast("double").alias("label"),
            F.array(*[col(f"`{n}`").cast("double") for n in names]).alias("x")).mapInArrow(
            lambda batches: _binned(batches, cuts), "key long, label double, margin double, bins binary"), "boosting")
        if state.df.isEmpty():
            state.drop()
            raise ValueError("no rows to learn from")
        n_cuts = np.array([len(c) for c in cuts])
        penalty = _Penalty(p["regAlpha"], p["regLambda"], p["stepSize"], p["minChildWeight"])
        trees, pending = [], []
        for t in range(p["maxIter"]):
            tree, columns = Tree.root(p["maxDepth"]), tree_columns(len(names), p["columnRate"], p["seed"], t)
            draw = (p["seed"], t, p["subsamplingRate"])
            open_nodes, sums = [1], {}
            for _ in range(p["maxDepth"]):
                g, h = _histograms(state.df, pending, tree, open_nodes, columns, draw)
                grown = []
                for i, node in enumerate(open_nodes):
                    total = int(g[i][0].sum()), int(h[i][0].sum())
                    split = best_split(g[i], h[i], n_cuts[columns], penalty)
                    if split is None:
                        tree.value[node] = penalty.leaf(total[0] / UNIT, total[1] / UNIT)
                        continue
                    gain, c, cut, left, below = split
                    tree.column[node], tree.cut[node], tree.missing_left[node] = int(columns[c]), cut, left
                    tree.threshold[node], tree.gain[node] = float(cuts[columns[c]][cut - 1]), gain
                    grown += [2 * node, 2 * node + 1]
                    sums[2 * node], sums[2 * node + 1] = below, (total[0] - below[0], total[1] - below[1])
                open_nodes = grown
                if not open_nodes:
                    break
            for node in open_nodes:  # the deepest nodes: their sums are known from the splits above them
                tree.value[node] = penalty.leaf(sums[node][0] / UNIT, sums[node][1] / UNIT)
            trees.append(tree)
            pending.append(tree)
            if len(pending) == REWRITE and t + 1 < p["maxIter"]:
                new = StoredTable(state.df.mapInArrow(
                    lambda batches, done=tuple(pending): _with_margins(batches, done), state.df.schema), "boosting")
                state.drop()
                state, pending = new, []
        state.drop()
        return HistogramBoostingModel(inputCols=names, scoreCol=p["scoreCol"], trees=json.dumps([asdict(t) for t in trees]))


def _binned(batches, cuts: list[np.ndarray]):
    for batch in batches:
        x = np.asarray(batch.column(2).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(batch.num_rows, -1)
        bins = np.empty(x.shape, dtype=np.uint8)
        for j, c in enumerate(cuts):
            bins[:, j] = bin_of(x[:, j], c)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.zeros(batch.num_rows)), pa.array([r.tobytes() for r in bins], pa.binary())],
            ["key", "label", "margin", "bins"])


def _bins(batch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)


def _margins(batch, trees) -> np.ndarray:
    bins, margin = _bins(batch), batch.column(2).to_numpy().copy()
    for t in trees:
        margin += t.values_of(bins)
    return margin


def _with_margins(batches, trees):
    for batch in batches:
        if batch.num_rows:
            yield batch.set_column(2, "margin", pa.array(_margins(batch, trees)))


def _histograms(rows: DataFrame, pending: list[Tree], tree: Tree, nodes: list[int], columns: np.ndarray, draw) -> tuple:
    """g and h summed by [node, column, bin] over the rows drawn for a tree, as integers."""
    seed, number, share = draw
    place = np.full(len(tree.column), -1)
    place[nodes] = np.arange(len(nodes))
    shape = (len(nodes), len(columns), MAX_BINS + 2)

    def run(batches):
        total = np.zeros((2, math.prod(shape)), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, margin = _bins(batch), _margins(batch, pending)
            at = place[tree.nodes_of(bins)]
            used = np.flatnonzero((at >= 0) & (draws(batch.column(0).to_numpy(), seed, number) < share))
            g, h = gradients(margin[used], batch.column(1).to_numpy()[used])
            for j, c in enumerate(columns):
                cell = (at[used] * shape[1] + j) * shape[2] + bins[used, c]
                # sums of integers below 2**53 are exact as doubles
                total[0] += np.bincount(cell, g, total.shape[1]).astype(np.int64)
                total[1] += np.bincount(cell, h, total.shape[1]).astype(np.int64)
        some = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0, some]), pa.array(total[1, some])], ["cell", "g", "h"])

    sums = rows.mapInArrow(run, "cell long, g long, h long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    found = sums.toPandas()
    out = np.zeros((2, math.prod(shape)), dtype=np.int64)
    out[:, found["cell"]] = found["g"], found["h"]
    return out[0].reshape(shape), out[1].reshape(shape)


class HistogramBoostingModel(Model, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted trees; ``transform`` adds the probability of label 1."""

    scoreCol = Param(Params._dummy(), "scoreCol", "column of the probability of label 1", TypeConverters.toString)
    trees = Param(Params._dummy(), "trees", "the trees as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, scoreCol=None, trees=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def fitted_trees(self) -> list[Tree]:
        return [Tree(**t) for t in json.loads(self.getOrDefault(self.trees))]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = self.getInputCols()
        leaves = ", ".join(t.sql(names) for t in self.fitted_trees())
        margin = F.expr(f"aggregate(array({leaves}), 0.0D, (sum, x) -> sum + x)") if leaves else F.lit(0.0)
        return dataset.withColumn(self.getOrDefault(self.scoreCol), 1.0 / (1.0 + F.exp(-margin)))

    @property
    def featureImportances(self):
        """Mean gain of a column's splits, scaled to a sum of 1 (zeros if nothing was split)."""
        n = len(self.getInputCols())
        gain, splits = np.zeros(n), np.zeros(n)
        for t in self.fitted_trees():
            for c, x in zip(t.column, t.gain, strict=True):
                if c >= 0:
                    gain[c] += x
                    splits[c] += 1
        mean = gain / np.maximum(splits, 1)
        return Vectors.dense(mean / mean.sum() if mean.sum() else mean)
