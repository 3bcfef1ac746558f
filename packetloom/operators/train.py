"""Detector and attributor training with Spark ML."""
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IndexToString, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..session import cut
from . import evaluate, prepare
from .joins import bounded


def scaler(train: DataFrame) -> list:
    """Stages that give `features`: each column minus its mean, over its population spread.

    The statistics come from the training rows alone; a constant column is only shifted.
    """
    stats = train.agg(*[f(c).alias(f"{n}_{c}") for c in fixed.FEATURES
                        for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scaled = ", ".join(f"({c} - ({stats[f'm_{c}'] or 0.0}D)) / ({stats[f's_{c}'] or 1.0}D) AS z_{c}"
                       for c in fixed.FEATURES)
    return [SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__"),
            VectorAssembler(inputCols=[f"z_{c}" for c in fixed.FEATURES], outputCol="features")]


def packed(rows: DataFrame, per_part: int = 50_000) -> DataFrame:
    """Rows written once and read in as many partitions as they fill; each round of a fit reads them all."""
    held = cut(rows)
    return held.repartition(max(1, held.count() // per_part)).persist()


def side_by_side(do: Callable, items: Iterable) -> list:
    """do(item) for each item, at one time: a round of a fit over few partitions leaves most cores to the other fits."""
    items = list(items)
    with ThreadPoolExecutor(max(1, len(items))) as pool:
        return list(pool.map(do, items))


def boosted(rounds: int = 200, seed: int = 42):
    return GBTClassifier(labelCol="y", weightCol="weight", maxIter=rounds, maxDepth=5, stepSize=0.1, seed=seed,
                         checkpointInterval=10)


def linear(rounds: int = 100, seed: int = 42):
    """The contender that is swept over the same grid."""
    return LogisticRegression(labelCol="y", weightCol="weight", maxIter=rounds, standardization=False)


def fit_gate(train: DataFrame, alpha: float, learner, stages: list | None = None,
             label: str = fixed.LABEL_COLUMN) -> PipelineModel:
    """Scaler and binary learner on weighted rows. Merged rows come with the stages of the whole ones."""
    rows = prepare.weighted(train, label, alpha)
    return Pipeline(stages=[*(stages or scaler(train)), learner]).fit(rows)


def gate_probability(model: PipelineModel, rows: DataFrame) -> DataFrame:
    out = model.transform(rows)
    return out.select(*rows.columns, vector_to_array("probability")[1].alias("p"))


def shape_probability(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """The same for rows with many equal vectors: each vector is scored once."""
    scored = cut(gate_probability(model, rows.select(*fixed.FEATURES).distinct()))
    return rows.join(bounded(scored, made=True), fixed.FEATURES).select(*rows.columns, "p")


Learners = dict[str, Callable[[], object]]


def sweep(train: DataFrame, val: DataFrame, learners: Learners, alphas: list[float] | None = None,
          label: str = fixed.LABEL_COLUMN) -> tuple[DataFrame, dict]:
    """One fit per (model, alpha); the frontier of all of them on the validation rows."""
    train = packed(train)
    stages, scored = scaler(train), None
    points = [(name, alpha) for name in learners for alpha in alphas or fixed.GATE_ALPHAS]
    fitted = dict(zip(points, side_by_side(lambda p: fit_gate(train, p[1], learners[p[0]](), stages, label), points)))
    for (name, alpha), model in fitted.items():
        part = gate_probability(model, val).select(
            F.lit(name).alias("model"), F.lit(alpha).alias("alpha"), F.col(label).alias("label"), "y", "p", "mult")
        scored = part if scored is None else scored.unionByName(part)
    train.unpersist()
    return evaluate.frontier(scored), fitted


def test_numbers(fitted: PipelineModel, test: DataFrame, model: str, alpha: float, threshold: float,
                 split: str, label: str = fixed.LABEL_COLUMN) -> DataFrame:
    """One row: a fitted model's numbers on test rows at a threshold."""
    rows = shape_probability(fitted, test)
    rows = evaluate.decided(rows.withColumnRenamed(label, "label") if label != "label" else rows, threshold)
    rows = cut(rows.select("label", "y", "p", "pred", "mult"))
    # All four have one row.
    return (evaluate.binary_scores(rows).crossJoin(F.broadcast(evaluate.benign_fpr(rows)))
            .crossJoin(F.broadcast(evaluate.confusion(rows)))
            .crossJoin(F.broadcast(evaluate.recall_averages(evaluate.class_recall(rows))))
            .select(F.lit(split).alias("split"), F.lit(model).alias("model"), F.lit(alpha).alias("alpha"),
                    F.lit(threshold).alias("threshold"), "*"))


def evaluate_split(parts: DataFrame, points: dict[str, tuple[float, float]], learners: Learners,
                   name: str, label: str = fixed.LABEL_COLUMN) -> DataFrame:
    """Fit every model on the train part at its own point; one row of test numbers each.

    Neither learner draws rows, so a row that stands for its copies gives the fit of all of them.
    """
    train, test = parts.filter("part = 'train'"), parts.filter("part = 'test'")
    stages, out = scaler(train), None
    train = packed(prepare.merged(train, label))
    fits = side_by_side(lambda m: fit_gate(train, points[m][0], learners[m](), stages, label), learners)
    for model, fitted in zip(learners, fits):
        line = test_numbers(fitted, test, model, *points[model], name, label)
        out = line if out is None else out.unionByName(line)
    train.unpersist()
    return out


def split_report(raw: DataFrame, points: dict[str, tuple[float, float]], learners: Learners,
                 row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """The three evaluations: deduplicated, random with duplicates, whole sources held out."""
    rows = cut(prepare.balanced(prepare.multiplicity(prepare.prepared(raw)), row_id=row_id, seed=seed))
    parts = {
        "dedup": prepare.stratified_split(prepare.unique_shapes(rows, ["y"], row_id, seed), "y", row_id, seed),
        "random": prepare.random_split(rows, "y", row_id, seed),
        "group": prepare.group_split(rows, seed=seed)}
    out = None
    for lines in side_by_side(lambda name: evaluate_split(cut(parts[name]), points, learners, name), parts):
        out = lines if out is None else out.unionByName(lines)
    return out


def chosen_report(parts: DataFrame, learners: Learners, alphas: list[float] | None = None,
                  label: str = fixed.LABEL_COLUMN) -> tuple[DataFrame, dict]:
    """Sweep on the validation part, one operating point per model, its numbers on the test part, and the fitted models.

    The models that are measured are those that the sweep fitted; test rows take no part in the choice.
    """
    front, fitted = sweep(parts.filter("part = 'train'"), parts.filter("part = 'val'"), learners, alphas, label)
    points = evaluate.operating_point(cut(front)).collect()  # one row per model
    test, out, chosen = parts.filter("part = 'test'"), None, {}
    for point in points:
        name = point["model"]
        chosen[name] = fitted[name, point["alpha"]]
        line = test_numbers(chosen[name], test, name, point["alpha"], point["threshold"], "dedup", label).withColumns({
            "val_macro_recall": F.lit(point["macro_recall"]).cast("double"),
            "val_per_flow_benign_fpr": F.lit(point["per_flow_benign_fpr"]).cast("double"), "reason": F.lit(point["reason"])})
        out = line if out is None else out.unionByName(line)
    return out, chosen


# --- attributor ---------------------------------------------------------------
def forest(trees: int = 300, seed: int = 42):
    """Multi-class trees with class probabilities."""
    return RandomForestClassifier(labelCol="family_index", weightCol="weight", numTrees=trees, maxDepth=10, seed=seed)


def fit_attributor(train: DataFrame, alpha: float, learner, stages: list | None = None) -> PipelineModel:
    """Scaler, family index in sorted order, learner, on attack rows."""
    rows = prepare.weighted(train, "family", alpha)
    index = StringIndexer(inputCol="family", outputCol="family_index", stringOrderType="alphabetAsc").fit(rows)
    names = IndexToString(inputCol="prediction", outputCol="pred", labels=index.labels)
    fitted = Pipeline(stages=[*(stages or scaler(train)), learner, names]).fit(index.transform(rows))
    return fitted


def family_scores(model: PipelineModel, rows: DataFrame) -> DataFrame:
    out = model.transform(rows)
    return out.select(*rows.columns, "pred", F.array_max(vector_to_array("probability")).alias("conf"))


def alpha_sweep(train: DataFrame, val: DataFrame, make: Callable[[], object], alphas: list[float] | None = None):
    """Fit per alpha; macro F1 on the validation rows, and the fitted models."""
    train = packed(train)
    stages, scored = scaler(train), None
    points = list(alphas or fixed.FAMILY_ALPHAS)
    fitted = dict(zip(points, side_by_side(lambda a: fit_attributor(train, a, make(), stages), points)))
    for alpha, model in fitted.items():
        part = family_scores(model, val).select(F.lit(alpha).alias("alpha"), "family", "pred", "conf")
        scored = part if scored is None else scored.unionByName(part)
    train.unpersist()
    return evaluate.macro_f1(scored, ("alpha",)), scored, fitted


def attribution_report(parts: DataFrame, make: Callable[[], object], alphas: list[float] | None = None):
    """Alpha and confidence threshold chosen on the validation part; what they give on the test part.

    Returns the per-family table, each row with the chosen alpha and threshold and the test's macro F1, coverage and
    accuracy when attributed; the scored test rows; and the chosen model.
    """
    scores, scored, fitted = alpha_sweep(parts.filter("part = 'train'"), parts.filter("part = 'val'"), make, alphas)
    alpha = evaluate.best_alpha(scores).first()["alpha"]
    val = cut(scored.filter(F.col("alpha") == alpha))
    threshold = evaluate.confidence_threshold(evaluate.attribution_sweep(val)).first()["threshold"]
    test = cut(family_scores(fitted[alpha], parts.filter("part = 'test'")).select("family", "pred", "conf"))
    whole = evaluate.attribution_sweep(test, [threshold]).select("coverage", "accuracy_when_attributed").withColumnsRenamed(
        {"coverage": "test_coverage", "accuracy_when_attributed": "test_accuracy"})
    table = (evaluate.family_table(test, threshold).crossJoin(F.broadcast(whole))
             .crossJoin(F.broadcast(evaluate.macro_f1(test).withColumnRenamed("macro_f1", "test_macro_f1")))
             .withColumns({"alpha": F.lit(alpha), "threshold": F.lit(threshold)}))
    return table, test, fitted[alpha]


def agreement(offline: DataFrame, live: DataFrame, key: str = "flow_id", tolerance: float = 1e-4) -> DataFrame:
    """Rows scored twice: pairs, missing rows, largest difference, verdict mismatches.

    Both sides: key, p, pred.
    """
    a = offline.select(key, F.col("p").alias("p1"), F.col("pred").alias("v1"))
    b = live.select(key, F.col("p").alias("p2"), F.col("pred").alias("v2"))
    gap = F.abs(F.col("p1") - F.col("p2"))
    return a.join(b, key, "full").agg(
        F.count("*").alias("rows"), F.count_if(F.col("p1").isNull() | F.col("p2").isNull()).alias("unmatched"),
        F.max(gap).alias("largest_gap"), F.count_if(gap >= tolerance).alias("over_tolerance"),
        F.count_if(F.col("v1") != F.col("v2")).alias("verdict_mismatches"))
