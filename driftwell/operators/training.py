"""Training jobs on Spark ML: split, fit, measure, keep the reference values."""

from __future__ import annotations

import itertools
import random
import sys
import warnings
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import Bucketizer, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.operators import metrics as M
from driftwell.operators.splits import kfold, repeated_kfold, train_test_split
from driftwell.session import ensure_checkpoints, scratch_path
from driftwell.operators.textfeatures import MAX_VOCABULARY, sparse_vectors, terms, vocabulary, weights

SHARES = 4096  # shares a cell of equal rows can be dealt into
UNITS = 1 << 18  # shares of cells that boosted trees draw from, where there are fewer cells


@dataclass
class Trained:
    """A fitted model, its scored test rows, its metrics (one row) and the values it learned from: the reference that
    drift checks hold later requests against (feature_name, value; a row per feature and training row)."""

    model: Model
    scored: DataFrame
    metrics: DataFrame
    parameters: dict = field(default_factory=dict)
    reference: DataFrame | None = None


def kept(df: DataFrame) -> DataFrame:
    """Materialise a frame that several fits read, so that a lost executor costs no refit."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()


def checked(df: DataFrame, features: list[str], label: str, key: str) -> DataFrame:
    """Key, label and features. Rows that cannot be learned from are not dropped: they stop the job, with their number."""
    rows = df.select(key, F.col(label).cast("double").alias("label"), *features)
    unknown = F.col("label").isNull()
    for f in features:
        unknown = unknown | F.col(f).isNull() | F.isnan(F.col(f).cast("double"))
    bad = rows.filter(unknown).count()
    if bad:
        raise ValueError(f"{bad} rows have no label or a null feature; impute or drop them first")
    return rows


def assemble(df: DataFrame, features: list[str], label: str, key: str) -> DataFrame:
    """Label and feature vector of rows that can all be learned from."""
    return VectorAssembler(inputCols=features, outputCol="features").transform(checked(df, features, label, key))


def reference_values(train: DataFrame, features: list[str]) -> DataFrame:
    """(feature_name, value) of the training side."""
    wide = train.select(*[F.col(c).cast("double").alias(c) for c in features])
    return wide.unpivot([], features, "feature_name", "value")


def training_reference(df: DataFrame, key: str, features: list[str], label: str, stratify: bool = True, seed: int = 42) -> DataFrame:
    """The reference a training on these rows leaves, without training."""
    rows = df.select(key, F.col(label).cast("double").alias("label"), *features)
    return reference_values(_sides(rows, key, stratify, seed)[0], features)


def training_sides(df: DataFrame, key: str, label: str, stratify: bool = True, seed: int = 42) -> DataFrame:
    """(is_test, label, n): what a training on these rows learns from and is measured on; a regression has no label."""
    rows = df.select(key, F.col(label).cast("double").alias("label"))
    split = train_test_split(rows, key, "label" if stratify else None, seed=seed)
    return split.groupBy("is_test", *(["label"] if stratify else [])).agg(F.count("*").alias("n"))


def _sides(df: DataFrame, key: str, stratify: bool, seed: int) -> tuple[DataFrame, DataFrame]:
    split = train_test_split(df, key, "label" if stratify else None, seed=seed)
    return split.filter(~F.col("is_test")), split.filter("is_test")


def _once(df: DataFrame, label: str) -> DataFrame:
    """The frame as Parquet in the shared folder: a few numbers a row, read as often as a fit needs them."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _written_sides(df: DataFrame, key: str, stratify: bool, seed: int) -> tuple[DataFrame, DataFrame]:
    """Training and test side, split once and written: a fit reads its rows many times and would split them each time.

    The key stays with the test rows only. Training rows keep `_share`, a number below SHARES that follows from the key.
    """
    split = train_test_split(df, key, "label" if stratify else None, seed=seed)
    both = _once(split.withColumns({
        "_share": F.pmod(F.xxhash64(key), F.lit(SHARES)).cast("smallint"), key: F.when(F.col("is_test"), F.col(key))
    }), "sides")
    return both.filter(~F.col("is_test")).drop(key, "is_test"), both.filter("is_test").drop("_share", "is_test")


def _scored_once(model: Model, test: DataFrame) -> DataFrame:
    """Test rows with prediction, and with the score of class 1 where the model has one."""
    scored = model.transform(test)
    if "probability" in scored.columns:
        scored = scored.withColumn("score", vector_to_array("probability")[1])
    extra = [c for c in ("prediction", "score") if c in scored.columns]
    return _once(scored.select(*test.columns, *extra), "scored").withColumn("one", F.lit(1))


def fit_classifier(rows: DataFrame, key: str, fit: Callable[[DataFrame], Model], seed: int = 42, features: list[str] | None = None) -> Trained:
    """Stratified split, fit, and accuracy/precision/recall/F1/AUC of class 1 on the test side."""
    train, test = _written_sides(rows, key, True, seed)
    model = fit(train)
    scored = _scored_once(model, test)
    report = M.classification_metrics(scored, ["one"], "label", "prediction")
    if "score" in scored.columns:
        report = report.join(M.roc_auc(scored, ["one"], "label", "score").select("one", "auc"), "one")
    return Trained(model, scored, report.drop("one"), reference=reference_values(train, features) if features else None)


def fit_regressor(rows: DataFrame, key: str, fit: Callable[[DataFrame], Model], seed: int = 42, features: list[str] | None = None) -> Trained:
    train, test = _written_sides(rows, key, False, seed)
    model = fit(train)
    scored = _scored_once(model, test)
    metrics = M.regression_metrics(scored, ["one"], "label", "prediction").drop("one")
    return Trained(model, scored, metrics, reference=reference_values(train, features) if features else None)


def _edges(train: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    """Where trees may cut each feature: between all its values if there are at most `bins`, else at quantiles of all rows."""
    counts = train.agg(*[F.approx_count_distinct(f).alias(f) for f in features]).first()
    many = [f for f in features if counts[f] > 2 * bins]
    edges = {}
    for f in features:
        if f not in many:
            values = sorted(float(r[0]) for r in train.select(f).distinct().collect())
            if len(values) > bins:
                many.append(f)
            edges[f] = [a + (b - a) / 2 for a, b in zip(values, values[1:])]
    quantiles = train.select(*[F.col(f).cast("double") for f in many]).approxQuantile(many, [i / bins for i in range(1, bins)], 0.001) if many else []
    return edges | {f: sorted(set(q)) for f, q in zip(many, quantiles)}


def fit_trees(train: DataFrame, features: list[str], trees: Estimator, least: int = 1, weight: str | None = None) -> Model:
    """Boosted trees on rows that share all bins, taken together.

    Trees see a feature only by its bin, so rows of one cell (of all bins, and of the label where it is a class) are alike
    to them: one row with the number or weight of all, and their mean label, gives the same sums in every node. The cells
    do not grow with the rows, and every tree costs a pass over the cells. Where a tree learns from a share of the rows,
    cells are dealt into shares by the key, so that about UNITS of them are drawn or left out, or all cells if there are
    more. `least`: rows a leaf must have, counted by weight.
    """
    bins = trees.getMaxBins()
    edges = _edges(train, features, bins)
    names = [f"_bin{i}" for i in range(len(features))]
    # An empty bin below all numbers: bins begin at 1, and zeros, which Spark's search for cuts only estimates, do not occur.
    inf, least_number = float("inf"), -sys.float_info.max
    cut = [f"_cut{i}" for i in range(len(features))]
    cutter = Bucketizer(splitsArray=[[-inf, least_number, *edges[f], inf] for f in features], inputCols=features, outputCols=cut)
    # A bin is a number that trees may cut, not a category, as the cutter marks it.
    plain = SQLTransformer(statement=f"SELECT *, {', '.join(f'{c} + 0D AS {n}' for c, n in zip(cut, names))} FROM __THIS__")
    cells = plain.transform(cutter.transform(train))
    regression = isinstance(trees, GBTRegressor)
    kinds = [] if regression else ["label"]
    mass = F.count("*").cast("double") if weight is None else F.sum(weight)
    sums = [mass.alias("_mass"), *([F.avg("label").alias("label")] if regression else [])]
    if trees.getSubsamplingRate() < 1:
        shares = max(1, min(SHARES, UNITS // max(1, cells.agg(F.approx_count_distinct(F.struct(*names, *kinds))).first()[0])))
        kinds = [*kinds, F.pmod("_share", F.lit(shares)).alias("_share")]
    units = kept(cells.groupBy(*names, *kinds).agg(*sums))
    size, total = units.agg(F.count("*"), F.sum("_mass")).first()
    parts = max(1, min(train.sparkSession.sparkContext.defaultParallelism, size >> 13))
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    # A leaf's rows are counted by weight, since a row here stands for many.
    # With room for more cuts than there are bins, all of them are found.
    settings = {trees.weightCol: "_mass", trees.maxBins: 2 * bins, trees.minWeightFractionPerNode: min((least - 0.5) / total, 0.499)}
    model = trees.fit(assembler.transform(units).select("label", "_mass", "features").repartition(parts), settings)
    return PipelineModel(stages=[cutter, plain, assembler, model])


def train_credit(df: DataFrame, key: str, features: list[str], label: str, trees: int = 500,
                 seed: int = 42) -> Trained:
    """Boosted trees: depth 3, step 0.05, leaves of 5 or more, 80 % row samples."""
    gbt = GBTClassifier(maxIter=trees, maxDepth=3, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="sqrt", seed=seed)
    return fit_classifier(checked(df, features, label, key), key, lambda train: fit_trees(train, features, gbt, least=5), seed, features)


def train_house(df: DataFrame, key: str, features: list[str], label: str, trees: int = 200,
                seed: int = 42) -> Trained:
    """Boosted regression trees: depth 5, step 0.1."""
    gbt = GBTRegressor(maxIter=trees, maxDepth=5, stepSize=0.1, seed=seed)
    return fit_regressor(checked(df, features, label, key), key, lambda train: fit_trees(train, features, gbt), seed, features)


def weighted_rows(df: DataFrame, label: str = "label") -> DataFrame:
    """Weight positives by negatives / max(positives, 1); a scalar subquery, not a join."""
    counts = df.agg(F.count_if(F.col(label) == 0) / F.greatest(F.count_if(F.col(label) == 1), F.lit(1)).cast("double"))
    return df.withColumn("_pos", counts.scalar()).withColumn(
        "weight", F.when(F.col(label) == 1, F.col("_pos")).otherwise(F.lit(1.0))
    ).drop("_pos")


def train_fraud(df: DataFrame, key: str, features: list[str], label: str, trees: int = 200,
                seed: int = 42) -> Trained:
    """Boosted trees for a rare class: depth 6, step 0.1, positives weighted up."""
    rows = weighted_rows(checked(df, features, label, key))
    gbt = GBTClassifier(maxIter=trees, maxDepth=6, stepSize=0.1, subsamplingRate=0.8, seed=seed)
    return fit_classifier(rows, key, lambda train: fit_trees(train, features, gbt, weight="weight"), seed, features)


def train_sentiment(docs: DataFrame, key: str, text: str, label: str, max_features: int = MAX_VOCABULARY,
                    iterations: int = 1000, seed: int = 42) -> Trained:
    """Tf-idf fitted on the training side only, then logistic regression."""
    # Split without the texts and written: three joins read the marks.
    rows = docs.select(key, F.col(label).cast("double").alias("label"))
    marks = _once(train_test_split(rows, key, "label", seed=seed), "marks")
    grams = terms(docs, key, text)
    train_keys = marks.filter(~F.col("is_test")).select(key)
    vocab = vocabulary(grams.join(train_keys, key, "left_semi"), max_features=max_features)
    # Every document has a vector; one without a known term is all zeros.
    vectors = sparse_vectors(weights(grams, vocab, key), key, max_features, marks)
    # Written once: fit and test would each tokenise the corpus again.
    ready = kept(marks.join(vectors, key))
    model = LogisticRegression(maxIter=iterations, regParam=1e-4).fit(ready.filter(~F.col("is_test")))
    scored = model.transform(ready.filter("is_test")).withColumns(
        {"one": F.lit(1), "score": vector_to_array("probability")[1]}
    )
    return Trained(model, scored, M.classification_metrics(scored, ["one"], "label", "prediction").drop("one"))


def train_image(df: DataFrame, key: str, vector: str, label: str, classes: int, width: int,
                iterations: int = 50, seed: int = 42) -> Trained:
    """Standardised vectors into a perceptron with hidden layers of 256 and 128."""
    rows = df.select(key, F.col(vector).cast("array<double>").alias("raw"), F.col(label).cast("double").alias("label"))
    train, test = (side.withColumn("raw", array_to_vector("raw")) for side in _written_sides(rows, key, True, seed))
    stages = [
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
        MultilayerPerceptronClassifier(layers=[width, 256, 128, classes], maxIter=iterations, seed=seed),
    ]
    model = Pipeline(stages=stages).fit(train)
    scored = model.transform(test).withColumn("one", F.lit(1))
    per_class = M.multiclass_report(scored, ["one"], "label", "prediction")
    # support x recall summed over classes is the number of hits
    report = per_class.agg(
        F.sum("support").alias("n"),
        (F.sum(F.col("support") * F.col("recall")) / F.sum("support")).alias("accuracy"),
        F.max("f1_macro").alias("f1_score"),
        F.max("f1_weighted").alias("f1_weighted"),
    )
    return Trained(model, scored, report)


def train_challenger(df: DataFrame, key: str, features: list[str], label: str, iterations: int = 200,
                     seed: int = 99) -> Trained:
    """Logistic regression on the same features as the champion."""
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    stages = Pipeline(stages=[assembler, LogisticRegression(maxIter=iterations)])
    trained = fit_classifier(checked(df, features, label, key), key, stages.fit, seed, features)
    trained.model = trained.model.stages[-1]  # the regression itself is what callers save
    return trained


def _measured(marked: DataFrame, keys: list[str], tasks: list[tuple[dict, Estimator, tuple[DataFrame, Column]]], workers: int) -> list[dict]:
    """Fit and measure many times on one kept table; a row of metrics per fit comes back, in the order of the tasks.

    A task is (values of the keys, estimator, (rows, which of them are held out)). Fits are jobs of many small stages, so a few
    run at a time and fill each other's gaps. The pool is bounded: `workers` fits at once, whatever their number.
    """
    spark = marked.sparkSession

    def one(labels: dict, estimator: Estimator, side: tuple[DataFrame, Column]) -> dict:
        rows, held = side
        model = estimator.fit(rows.filter(~held))
        scored = model.transform(rows.filter(held)).withColumns({k: F.lit(v) for k, v in labels.items()})
        return M.classification_metrics(scored, keys, "label", "prediction").first().asDict()

    def started(task: tuple) -> Callable[[], dict]:
        return inheritable_thread_target(spark)(lambda: one(*task))

    with ThreadPoolExecutor(workers) as pool:
        return [f.result() for f in [pool.submit(started(t)) for t in tasks]]


def _score_table(spark: SparkSession, rows: list[dict], shape: str) -> DataFrame:
    return spark.createDataFrame(rows, f"{shape}, n bigint, accuracy double, precision double, recall double, f1_score double")


def cv_scores(df: DataFrame, key: str, estimator: Estimator, folds: int = 5, repeats: int = 1,
              seed: int = 42, workers: int = 4) -> DataFrame:
    """Accuracy and F1 of each (repeat, fold), with the number of held-out rows as n.

    The folds of all repeats are assigned in one pass and kept; `workers` fits run at a time.
    """
    marked = kept(repeated_kfold(df, key, "label", folds, repeats, seed))
    tasks = [({"repeat": r, "fold": f}, estimator, (marked.filter(F.col("repeat") == r), F.col("fold") == f)) for r in range(repeats) for f in range(folds)]
    return _score_table(df.sparkSession, _measured(marked, ["repeat", "fold"], tasks, workers), "repeat int, fold int")


def cv_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.count("*").alias("fits"),
        F.round(F.avg("accuracy"), 4).alias("cv_accuracy_mean"),
        F.round(F.stddev_pop("accuracy"), 4).alias("cv_accuracy_std"),
        F.round(F.avg("f1_score"), 4).alias("cv_f1_mean"),
    )


def grid_trials(space: dict[str, list], max_trials: int) -> list[dict]:
    """Every combination in order; a warning tells how many `max_trials` leaves out."""
    names = list(space)
    combos = list(itertools.product(*[space[n] for n in names]))
    if len(combos) > max_trials:
        warnings.warn(f"{len(combos) - max_trials} of {len(combos)} combinations are not tried", stacklevel=2)
    return [dict(zip(names, c)) for c in combos[:max_trials]]


def random_trials(space: dict[str, tuple], trials: int, seed: int = 42) -> list[dict]:
    """Seeded draws: (low, high) of ints or floats, or a list of choices."""
    rng = random.Random(seed)

    def draw(bounds):
        if isinstance(bounds, list):
            return rng.choice(bounds)
        low, high = bounds
        return rng.randint(low, high) if isinstance(low, int) else rng.uniform(low, high)

    return [{name: draw(bounds) for name, bounds in space.items()} for _ in range(trials)]


def hpo_cv(df: DataFrame, key: str, estimator: Estimator, trials: list[dict], folds: int = 5,
           metric: str = "accuracy", seed: int = 42, top: int | None = None, workers: int = 4,
           halving: int | None = None) -> DataFrame:
    """Cross-validated score of every trial, best first: trial, params, score, folds, held_out (rows scored so far).

    The folds are assigned once, so every trial sees the same ones. By default every trial is fitted on all folds. With
    `halving` = h (successive halving) all trials are fitted on one fold, the best of h in every h go on to h times as
    many, and so on; a trial that stopped early is still reported, with the folds it was scored on, after those that
    went further. `top` cuts the report, not the search.
    """
    assert trials, "no trials given"
    marked = kept(kfold(df, key, "label", folds, seed))
    done: dict[int, list[dict]] = {i: [] for i in range(len(trials))}
    alive, upto = list(done), 1 if halving else folds
    while True:
        tasks = [({"trial": t, "fold": f}, estimator.copy({estimator.getParam(k): v for k, v in trials[t].items()}), (marked, F.col("fold") == f))
                 for t in alive for f in range(len(done[t]), upto)]
        for row in _measured(marked, ["trial", "fold"], tasks, workers):
            done[row["trial"]].append(row)
        if upto >= folds:
            break
        ranked = sorted(alive, key=lambda t: (-sum(r[metric] for r in done[t]) / len(done[t]), t))
        alive, upto = ranked[: max(1, -(-len(ranked) // halving))], min(folds, upto * halving)
    rows = [(t, str(trials[t]), round(sum(r[metric] for r in scores) / len(scores), 6), len(scores), sum(r["n"] for r in scores)) for t, scores in done.items()]
    report = df.sparkSession.createDataFrame(rows, "trial int, params string, score double, folds int, held_out bigint")
    ordered = report.orderBy(F.col("folds").desc(), F.col("score").desc(), "trial")
    return ordered if top is None else ordered.limit(top)
