"""One-click predictive models: encoding, task choice, split, forest, importances."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, inheritable_thread_target
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.columns import col, nan_to_null, temporal_columns, text_columns
from tablegauge.operators.features import hash_fraction
from tablegauge.session import materialize, with_workers

TREES = 100
MAX_DEPTH = 10
SEED = 42
# Memory for node statistics: more nodes are split per pass over the data.
PASS_MEMORY_MB = 1024
TEST_SHARE = 0.2
CLASSES_BELOW = 10
# Trees choose among BINS intervals of a feature, so rows in the same intervals are told apart by their label only. From
# MANY_ROWS rows on, if they fill at most MOST_CELLS combinations of intervals, trees are fitted to the cells.
BINS = 32
MANY_ROWS = 2_000_000
MOST_CELLS = 20_000
FITS_AT_ONCE = 8


def choose_task(df: DataFrame, target: str, requested: str = "regression") -> DataFrame:
    """classification only if asked for and the target is text or has few values."""
    is_text = target in text_columns(df)
    distinct = F.countDistinct(target)
    return df.agg(distinct.alias("distinct_values")).select(
        F.lit(target).alias("target"), "distinct_values",
        F.when(F.lit(requested == "classification") & (F.lit(is_text) | (F.col("distinct_values") < CLASSES_BELOW)),
               "classification").otherwise("regression").alias("task"))


def label_codes(df: DataFrame, target: str) -> DataFrame:
    """Code of each class: its position in alphabetical (or numeric) order.

    A classification target has a handful of classes.
    """
    classes = df.select(target).filter(col(target).isNotNull()).distinct()
    listed = classes.agg(F.array_sort(F.collect_set(target)).alias("l"))
    return listed.select(F.posexplode("l").alias("code", target)).select(target, "code")


def split_rows(df: DataFrame, key: list[str], share: float = TEST_SHARE) -> DataFrame:
    """Add ``is_test`` from a hash of the row key: the same rows every time."""
    return df.withColumn("is_test", hash_fraction(*key) < share)


def encode_features(df: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Add ``features``: numbers as they are and text one-hot without its first level.

    Returns the frame and one name per slot. Missing text is all zeros.
    """
    df = nan_to_null(df)
    texts = [c for c in features if c in text_columns(df)]
    numbers = [c for c in features if c not in texts]
    moments = set(temporal_columns(df))

    def number(c: str):
        if c in moments:
            return F.unix_seconds(col(c).cast("timestamp")).cast("double")
        return col(c).cast("double")

    out = df.withColumns({f"_n_{c}": F.coalesce(number(c), F.lit(0.0)) for c in numbers}) if numbers else df
    inputs, names = [f"_n_{c}" for c in numbers], list(numbers)
    for c in texts:
        indexer = StringIndexer(inputCol=c, outputCol=f"_i_{c}", stringOrderType="alphabetDesc", handleInvalid="keep").fit(out)
        levels = list(indexer.labels)
        out = OneHotEncoder(inputCol=f"_i_{c}", outputCol=f"_o_{c}", dropLast=True).fit(
            indexer.transform(out)).transform(indexer.transform(out))
        if len(levels) < 2:
            continue
        # In descending order the alphabetically first level is the last slot.
        out = VectorSlicer(inputCol=f"_o_{c}", outputCol=f"_v_{c}", indices=list(range(len(levels) - 1))).transform(out)
        inputs.append(f"_v_{c}")
        names += [f"{c}_{level}" for level in levels[:-1]]
    out = VectorAssembler(inputCols=inputs, outputCol="features").transform(out)
    kept = [c for c in out.columns if not c.startswith(("_n_", "_i_", "_o_", "_v_"))]
    return out.select(*kept), names


def _importances(spark, model, names: list[str]) -> DataFrame:
    """All slots, the most important first; one number per slot of the fitted model."""
    weights = [float(w) for w in np.asarray(model.featureImportances)]
    rows = spark.createDataFrame(list(zip(names, weights)), "feature string, importance double")
    return rows.orderBy(F.col("importance").desc(), "feature")


def _prepared(df: DataFrame, target: str, key: list[str]):
    features = [c for c in df.columns if c != target and c not in key]
    encoded, names = encode_features(split_rows(df, key), features)
    return encoded, names


def _splits(slots: DataFrame, n: int) -> list[list[float]]:
    """Up to ``BINS`` - 1 split points for each of the columns ``s0`` to ``s<n-1>``: every value but the largest of a
    column with few values, else quantiles of all rows."""
    names = [f"s{i}" for i in range(n)]
    sizes = slots.agg(*[F.approx_count_distinct(c) for c in names]).first()
    few = [c for c, size in zip(names, sizes) if size <= 2 * BINS]
    values = dict(zip(few, slots.agg(*[F.array_sort(F.collect_set(c)) for c in few]).first())) if few else {}
    many = [c for c in names if len(values.get(c, range(BINS + 1))) > BINS]
    values |= dict(zip(many, slots.approxQuantile(many, [i / (BINS - 1) for i in range(BINS)], 0.001))) if many else {}
    return [sorted(set(values[c]))[:-1] for c in names]


class CellForest:
    """A forest over cells: combinations of intervals of the features. Its trees read the numbers of the intervals."""

    def __init__(self, trees: Sequence, splits: list[list[float]], classes: bool):
        self.trees, self.splits, self.classes = trees, splits, classes

    @property
    def featureImportances(self) -> np.ndarray:  # noqa: N802 - named as in a model of Spark's
        total = np.sum([t.featureImportances.toArray() for t in self.trees], axis=0)
        return total / total.sum() if total.sum() > 0 else total

    def score(self, cells: DataFrame) -> DataFrame:
        """``cell`` and ``prediction``: the mean of the trees, or the class with the largest mean share, the first of equals."""
        points = cells.select("cell", _numbers(self.splits))
        if not self.classes:
            votes = [t.transform(points).select("cell", "prediction") for t in self.trees]
            return reduce(DataFrame.unionAll, votes).groupBy("cell").agg(F.avg("prediction").alias("prediction"))
        votes = [t.transform(points).select("cell", F.posexplode(vector_to_array("probability")).alias("label", "share")) for t in self.trees]
        shares = reduce(DataFrame.unionAll, votes).groupBy("cell", "label").agg(F.avg("share").alias("share"))
        best = F.max_by("label", F.struct("share", -F.col("label")))
        return shares.groupBy("cell").agg(best.cast("double").alias("prediction"))

    def transform(self, slots: DataFrame) -> DataFrame:
        """Rows of slot columns with their ``prediction``: every cell that occurs is scored once."""
        placed = slots.withColumn("cell", _cell(self.splits))
        return placed.join(self.score(materialize(placed.select("cell").distinct().coalesce(4), "test-cells")), "cell")


def _cell(splits: list[list[float]]) -> Column:
    """The number of a row's cell: the numbers of its intervals as digits."""
    number = F.lit(0).cast("bigint")
    for i, points in enumerate(splits):
        at = reduce(lambda a, t, i=i: a + (F.col(f"s{i}") > t).cast("bigint"), points, F.lit(0).cast("bigint"))
        number = number * (len(points) + 1) + at
    return number


def _over(number: Column, by: int) -> Column:
    """Whole-number quotient of a number that is not negative."""
    return F.call_function("div", number, F.lit(by))


def _numbers(splits: list[list[float]]) -> Column:
    """The numbers of the intervals of a ``cell``, as ``features``."""
    out, rest = [], F.col("cell")
    for points in reversed(splits):
        out.append(F.pmod(rest, F.lit(len(points) + 1)).cast("double"))
        rest = _over(rest, len(points) + 1)
    return array_to_vector(F.array(*out[::-1])).alias("features")


def _drawn(rows: DataFrame, trees: int) -> DataFrame:
    """``cell``, ``tree``, ``weight``, ``label``: for each tree the rows of a cell as often as a bootstrap draws them.

    Every row (cell, label, n) stands for n equal ones and is drawn by a Poisson number of mean n, as in Spark's forests;
    the draws of a cell are added up within a task and then over all tasks, with the mean of the drawn labels.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([SEED, TaskContext.get().partitionId()])
        places: dict[int, int] = {}
        weights, sums = np.zeros((64, trees), np.int64), np.zeros((64, trees))
        for batch in batches:
            for part in (batch.slice(k, 8192) for k in range(0, batch.num_rows, 8192)):
                cell, label, n = (c.to_numpy(zero_copy_only=False) for c in part.columns)
                order = np.argsort(cell, kind="stable")
                own, starts = np.unique(cell[order], return_index=True)
                at = [places.setdefault(c, len(places)) for c in own.tolist()]
                while len(places) > len(weights):
                    weights, sums = (np.concatenate([x, np.zeros_like(x)]) for x in (weights, sums))
                drawn = rng.poisson(1.0 if (n == 1).all() else n[order][:, None], (len(cell), trees))
                weights[at] += np.add.reduceat(drawn, starts, axis=0)
                sums[at] += np.add.reduceat(drawn * label[order][:, None], starts, axis=0)
        cells = np.fromiter(places, np.int64, len(places))
        for k in range(0, len(cells), 512):
            some = slice(k, k + 512)
            w, size = weights[:len(cells)][some], len(cells[some])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(cells[some], trees)), pa.array(np.tile(np.arange(trees, dtype=np.int64), size)),
                pa.array(w.ravel()), pa.array(sums[:len(cells)][some].ravel())], names=["cell", "tree", "weight", "total"])

    parts = rows.mapInArrow(run, "cell bigint, tree bigint, weight bigint, total double").filter("weight > 0")
    return parts.groupBy("cell", "tree").agg(F.sum("weight").cast("double").alias("weight"), F.sum("total").alias("total")).select(
        "cell", "tree", "weight", (F.col("total") / F.col("weight")).alias("label"))


def _cell_forest(slots: DataFrame, n: int, one_tree, classes: bool, trees: int) -> CellForest | None:
    """A forest fitted to the cells of the training rows, or None if they are too many."""
    train = slots.filter(~F.col("is_test"))
    splits = _splits(train, n)
    if np.prod([len(p) + 1.0 for p in splits]) > 2.0 ** 62:
        return None
    placed = train.select(_cell(splits).alias("cell"), "label")
    if placed.agg(F.approx_count_distinct("cell", 0.02)).first()[0] > MOST_CELLS:
        return None
    if classes:
        # Rows of a cell and class are equal. The draws of each stay apart.
        equal = placed.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("n"))
        n_classes = slots.agg(F.max("label")).first()[0] + 1
        coded = equal.select((F.col("cell") * F.lit(int(n_classes)) + F.col("label").cast("bigint")).alias("cell"), "label", "n")
        drawn = _drawn(with_workers(coded), trees).withColumn("cell", _over(F.col("cell"), int(n_classes)))
    else:
        drawn = _drawn(with_workers(placed.withColumn("n", F.lit(1).cast("bigint"))), trees)
    points = materialize(drawn.select("tree", "weight", "label", _numbers(splits)).repartition(FITS_AT_ONCE, "tree"), "cell-draws").persist()

    def fit(tree: int):
        return one_tree.copy({one_tree.seed: SEED + tree}).fit(points.filter(F.col("tree") == tree).coalesce(1))

    try:
        with ThreadPool(FITS_AT_ONCE) as pool:
            fitted = pool.map(inheritable_thread_target(slots.sparkSession)(fit), range(trees))
    finally:
        points.unpersist()
    return CellForest(fitted, splits, classes)


def _slots(data: DataFrame, n: int) -> DataFrame:
    """A stored copy with the slots of ``features`` as columns ``s0``, ``s1``, …"""
    values = data.withColumn("features", vector_to_array("features"))
    return materialize(values.select("label", "is_test", *[F.col("features")[i].alias(f"s{i}") for i in range(n)]), "slots")


def _fit_and_score(data: DataFrame, n: int, forest, subset: str, many: int):
    """(model, test rows with ``label`` and ``prediction``) of a forest over ``n`` slots."""
    classes = isinstance(forest, RandomForestClassifier)
    if n and data.count() >= many:
        slots = _slots(data, n)
        one_tree = forest.copy({forest.numTrees: 1, forest.bootstrap: False, forest.weightCol: "weight", forest.featureSubsetStrategy: subset})
        model = _cell_forest(slots, n, one_tree, classes, forest.getNumTrees())
        if model is not None:
            return model, model.transform(slots.filter("is_test"))
    model = forest.fit(data.filter(~F.col("is_test")))
    return model, model.transform(data.filter("is_test"))


def fit_classifier(df: DataFrame, target: str, key: list[str], trees: int = TREES, max_depth: int = MAX_DEPTH, many: int = MANY_ROWS):
    """(metrics, importances, model) of a forest that predicts the class."""
    encoded, names = _prepared(df.filter(col(target).isNotNull()), target, key)
    codes = label_codes(df, target).withColumnRenamed("code", "_label")
    data = encoded.join(codes, target).select(F.col("_label").cast("double").alias("label"), "features", "is_test")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=max_depth, seed=SEED, maxMemoryInMB=PASS_MEMORY_MB)
    model, scored = _fit_and_score(data, len(names), forest, "sqrt" if trees > 1 else "all", many)
    metrics = scored.agg(F.count(F.lit(1)).alias("test_rows"), F.avg(
        (F.col("prediction") == F.col("label")).cast("int")).alias("accuracy")).select(
        F.lit("classification").alias("model_type"), F.lit(target).alias("target"), "test_rows", "accuracy")
    return metrics, _importances(df.sparkSession, model, names), model


def fit_regressor(df: DataFrame, target: str, key: list[str], trees: int = TREES, max_depth: int = MAX_DEPTH, many: int = MANY_ROWS):
    """(metrics, importances, model) of a forest that predicts the value."""
    encoded, names = _prepared(df.filter(col(target).isNotNull()), target, key)
    data = encoded.select(col(target).cast("double").alias("label"), "features", "is_test")
    forest = RandomForestRegressor(numTrees=trees, maxDepth=max_depth, seed=SEED, maxMemoryInMB=PASS_MEMORY_MB,
                                   featureSubsetStrategy="all")
    model, scored = _fit_and_score(data, len(names), forest, "all", many)
    r2 = RegressionEvaluator(metricName="r2").evaluate(scored)
    metrics = scored.agg(F.count(F.lit(1)).alias("test_rows")).select(
        F.lit("regression").alias("model_type"), F.lit(target).alias("target"), "test_rows", F.lit(r2).alias("r2_score"))
    return metrics, _importances(df.sparkSession, model, names), model


def uplift_scores(df: DataFrame, features: list[str], treated: str, outcome: str, key: list[str],
                  trees: int = 20, max_depth: int = 5) -> DataFrame:
    """Two-model uplift: the difference of a treated and a control model's scores."""
    encoded, _ = encode_features(df, features)
    data = encoded.select(*key, treated, col(outcome).cast("double").alias("label"), "features")
    forest = RandomForestRegressor(numTrees=trees, maxDepth=max_depth, seed=SEED, maxMemoryInMB=PASS_MEMORY_MB,
                                   featureSubsetStrategy="all")
    with_offer = forest.fit(data.filter(col(treated))).setPredictionCol("score_treated")
    without = forest.fit(data.filter(~col(treated))).setPredictionCol("score_control")
    scored = without.transform(with_offer.transform(data))
    return scored.select(*key, "score_treated", "score_control",
                         (F.col("score_treated") - F.col("score_control")).alias("uplift"))
