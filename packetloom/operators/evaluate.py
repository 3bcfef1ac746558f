"""Detection and attribution quality."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.numeric import share

SLICES = 256


def is_benign(label: str = "label") -> Column:
    return F.upper(F.col(label)) == fixed.BENIGN


def decided(rows: DataFrame, threshold: float, probability: str = "p") -> DataFrame:
    return rows.withColumn("pred", F.when(F.col(probability) >= threshold, 1).otherwise(0))


# --- binary -------------------------------------------------------------------
def class_recall(rows: DataFrame) -> DataFrame:
    """Per label: n and recall; for the benign label the share left alone."""
    right = F.when(is_benign(), F.col("pred") == 0).otherwise(F.col("pred") == 1)
    return rows.groupBy("label").agg(F.count("*").alias("n"), share(F.count_if(right), F.count("*")).alias("recall"))


def recall_averages(per_class: DataFrame) -> DataFrame:
    """Macro and weighted recall over attack classes, from the rounded recalls."""
    return per_class.filter(~is_benign()).agg(
        F.bround(F.avg("recall"), 4).alias("macro_recall"),
        F.bround(F.sum(F.col("recall") * F.col("n")) / F.sum("n"), 4).alias("weighted_recall"))


def benign_fpr(rows: DataFrame) -> DataFrame:
    """False alarms per flow (weighted by multiplicity) and per shape."""
    benign, wrong = F.col("y") == 0, (F.col("y") == 0) & (F.col("pred") == 1)
    flows = F.coalesce(F.sum(F.when(benign, F.col("mult"))), F.lit(0.0))
    bad = F.coalesce(F.sum(F.when(wrong, F.col("mult"))), F.lit(0.0))
    return rows.agg(share(bad, flows, 6).alias("per_flow_fpr"),
                    share(F.count_if(wrong), F.count_if(benign), 6).alias("per_shape_fpr"),
                    F.count_if(benign).alias("benign_shapes"), flows.cast("long").alias("benign_flows_represented"))


def confusion(rows: DataFrame) -> DataFrame:
    y, p = F.col("y") == 1, F.col("pred") == 1
    return rows.agg(F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"),
                    F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"))


def binary_scores(rows: DataFrame, probability: str = "p") -> DataFrame:
    """accuracy, precision, recall, f1, roc_auc."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    area = rank_auc(rows.select(F.lit("p").alias("feature"), F.col(probability).alias("value"), "y"))
    return confusion(rows).crossJoin(F.broadcast(area.select("auc"))).select(
        share(tp + tn, tp + tn + fp + fn).alias("accuracy"), share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.bround("auc", 4).alias("roc_auc"))


def _ranked(values: DataFrame) -> DataFrame:
    """Per feature and distinct value of (feature, value, y): pos, neg, and both counts below and in all.

    Rows are first counted per distinct value. The distinct values are cut in ranges
    at rough quantiles; counts run within a range, and one row per range carries the
    offset, so no task sees a whole feature.
    """
    counts = values.groupBy("feature", "value").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    marks = F.array(*[F.lit(i / SLICES) for i in range(1, SLICES)])
    bounds = counts.groupBy("feature").agg(F.percentile_approx("value", marks, 1000).alias("bounds"))
    # One row per feature, and one per feature and range: both are bounded by construction.
    placed = counts.join(F.broadcast(bounds), "feature").withColumn(
        "slice", F.size(F.filter("bounds", lambda b: b < F.col("value")))).drop("bounds")
    sums = placed.groupBy("feature", "slice").agg(*[F.sum(c).alias(c) for c in ("pos", "neg")])
    whole = Window.partitionBy("feature")
    below = whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("feature", "slice", *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"{c}_offset") for c in ("pos", "neg")],
                          *[F.sum(c).over(whole).alias(f"{c}_all") for c in ("pos", "neg")])
    inside = Window.partitionBy("feature", "slice").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(F.broadcast(offsets), ["feature", "slice"]).withColumns({
        f"{c}_below": F.col(f"{c}_offset") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in ("pos", "neg")})


def _auc() -> Column:
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_below") + F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return F.when(pairs > 0, wins / pairs)


def _stump_auc() -> Column:
    """AUC of the tree with the one split of least Gini impurity; equal splits go to the smallest value.

    Its score takes two values, the share of positives on either side. Without a split it is even: 0.5.
    """
    lp, ln = (F.col(f"{c}_below") + F.col(c).cast("double") for c in ("pos", "neg"))
    rp, rn = F.col("pos_all") - lp, F.col("neg_all") - ln
    purity = (lp * lp + ln * ln) / (lp + ln) + (rp * rp + rn * rn) / (rp + rn)
    auc = (F.greatest(lp * rn, rp * ln) + 0.5 * (lp * ln + rp * rn)) / F.nullif((lp + rp) * (ln + rn), F.lit(0.0))
    mixed = (F.sum("pos") > 0) & (F.sum("neg") > 0)
    best = F.min_by(F.when(rp + rn > 0, auc), F.when(rp + rn > 0, F.struct(-purity, "value")))
    return F.when(mixed, F.coalesce(best, F.lit(0.5)))


def rank_auc(values: DataFrame) -> DataFrame:
    """Rank AUC per feature of (feature, value, y), ties at half."""
    return _ranked(values).groupBy("feature").agg(_auc().alias("auc"))


def _feature_values(rows: DataFrame, features: list[str] | None) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                                for c in features or fixed.FEATURES]))
    return rows.select("y", pairs.alias("x")).select("x.feature", "x.value", "y")


def univariate_auc(rows: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Per feature the direction-free rank AUC."""
    return rank_auc(_feature_values(rows, features)).select(
        "feature", F.bround(F.greatest("auc", 1 - F.col("auc")), 4).alias("univariate_auc"))


def leakage_check(rows: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Per feature: direction-free rank AUC, AUC of a one-split tree, and whether either alone tells the classes apart."""
    both = _ranked(_feature_values(rows, features)).groupBy("feature").agg(_auc().alias("a"), _stump_auc().alias("t"))
    u = F.greatest("a", 1 - F.col("a"))
    return both.select("feature", F.bround(u, 4).alias("univariate_auc"), F.bround("t", 4).alias("stump_auc"),
                       ((u >= fixed.LEAK_AUC) | (F.col("t") >= fixed.LEAK_AUC)).alias("flagged"))


# --- frontier -----------------------------------------------------------------
def reached(probability: Column, grid: list[float]) -> Column:
    """How many thresholds of the grid a probability reaches."""
    return sum((F.when(probability >= t, 1).otherwise(0) for t in grid), F.lit(0))


def _grid(spark, grid: list[float]) -> DataFrame:
    return spark.createDataFrame([(i + 1, float(t)) for i, t in enumerate(grid)], "place int, threshold double")


def frontier(rows: DataFrame, grid: list[float] | None = None, by: tuple[str, ...] = ("model", "alpha")) -> DataFrame:
    """One row per (model, alpha, threshold): recalls, false alarm rates, budget flag.

    Rows (model, alpha, label, y, p, mult) are counted once per reached threshold;
    the grid is applied to those counts, not to the rows.
    """
    grid = grid or fixed.GATE_THRESHOLDS
    keys = list(by)
    counts = rows.groupBy(*keys, "label", "y", reached(F.col("p"), grid).alias("level")).agg(
        F.count("*").alias("n"), F.sum("mult").alias("m"))
    wide = counts.crossJoin(F.broadcast(_grid(rows.sparkSession, grid)))
    hit = F.col("level") >= F.col("place")
    per_label = wide.groupBy(*keys, "threshold", "label", "y").agg(
        F.sum("n").alias("n"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("flagged"),
        F.sum("m").alias("m"), F.sum(F.when(hit, F.col("m")).otherwise(0)).alias("flagged_m"))
    attack = F.col("y") == 1
    r = F.when(attack, share(F.col("flagged"), F.col("n")))

    def benign(c: str) -> Column:
        return F.coalesce(F.sum(F.when(~attack, F.col(c))), F.lit(0))

    out = per_label.withColumn("r", r).groupBy(*keys, "threshold").agg(
        F.bround(F.avg("r"), 4).alias("macro_recall"),
        F.bround(F.sum(F.col("r") * F.col("n")) / F.sum(F.when(attack, F.col("n"))), 4).alias("weighted_recall"),
        share(benign("flagged_m"), benign("m"), 6).alias("per_flow_benign_fpr"),
        share(benign("flagged"), benign("n"), 6).alias("per_shape_benign_fpr"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(attack, F.struct("label", "r"))))).alias("per_class_recall"))
    return out.withColumn("meets_fpr_budget", F.col("per_flow_benign_fpr") <= fixed.FPR_BUDGET)


def operating_point(front: DataFrame, by: str = "model") -> DataFrame:
    """The grid point with most macro recall inside the false alarm budget.

    Ties go to (alpha 0, threshold 0.5), then fewer false alarms, lower alpha, lower
    threshold. Without a point inside the budget: alpha 0, threshold 0.5.
    """
    default = (F.col("alpha") == 0.0) & (F.col("threshold") == 0.5)
    row = F.struct("alpha", "threshold", "macro_recall", "per_flow_benign_fpr")
    order = F.struct(-F.col("macro_recall"), ~default, "per_flow_benign_fpr", "alpha", "threshold")
    fits = F.col("meets_fpr_budget") & F.col("macro_recall").isNotNull()
    picked = front.groupBy(by).agg(
        F.min_by(row, F.when(fits, order)).alias("best"), F.min_by(row, F.when(default, order)).alias("fallback"))
    best = F.coalesce("best", "fallback")
    is_default = (best["alpha"] == 0.0) & (best["threshold"] == 0.5)
    why = (F.when(F.col("best").isNull(), "no point meets the budget").when(is_default, "default kept")
           .otherwise("most macro recall within the budget"))
    return picked.select(by, best["alpha"].alias("alpha"), best["threshold"].alias("threshold"),
                         best["macro_recall"].alias("macro_recall"),
                         best["per_flow_benign_fpr"].alias("per_flow_benign_fpr"), why.alias("reason"))


# --- families -----------------------------------------------------------------
# Rows: family (true), pred (largest probability), conf (that probability).
def attributed(threshold) -> Column:
    return (F.col("conf") >= threshold) & (F.col("pred") != fixed.ABSTAIN_FAMILY)


def attribution_sweep(rows: DataFrame, grid: list[float] | None = None) -> DataFrame:
    """Coverage and accuracy when attributed, per threshold, from one count per level."""
    grid = grid or fixed.FAMILY_THRESHOLDS
    named = F.col("pred") != fixed.ABSTAIN_FAMILY
    level = F.when(named, reached(F.col("conf"), grid)).otherwise(0)
    counts = rows.groupBy(level.alias("level")).agg(
        F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("family")).alias("right"))
    hit = F.col("level") >= F.col("place")
    summed = counts.crossJoin(F.broadcast(_grid(rows.sparkSession, grid))).groupBy("threshold").agg(
        F.sum("n").alias("total"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("attributed"),
        F.sum(F.when(hit, F.col("right")).otherwise(0)).alias("right"))
    return summed.select(
        "threshold", share(F.col("attributed"), F.col("total")).alias("coverage"),
        F.when(F.col("attributed") > 0, share(F.col("right"), F.col("attributed"))).alias("accuracy_when_attributed"),
        "attributed", "total")


def confidence_threshold(sweep: DataFrame, floor: float = fixed.ACCURACY_FLOOR) -> DataFrame:
    """Most coverage with accuracy at the floor; the lowest threshold wins ties.

    When no threshold meets the floor, the most accurate one.
    """
    acc = F.col("accuracy_when_attributed")
    row = F.struct("threshold", "coverage", "accuracy_when_attributed")
    met = F.struct(-F.col("coverage"), -acc, "threshold")
    picked = sweep.filter(acc.isNotNull()).agg(
        F.min_by(row, F.when(acc >= floor, met)).alias("a"),
        F.min_by(row, F.struct(-acc, "threshold")).alias("b"))
    best = F.coalesce("a", "b")
    return picked.select(best["threshold"].alias("threshold"), best["coverage"].alias("coverage"),
                         best["accuracy_when_attributed"].alias("accuracy_when_attributed"),
                         F.col("a").isNotNull().alias("meets_floor"))


def family_table(rows: DataFrame, threshold: float) -> DataFrame:
    a, right = attributed(threshold), F.col("pred") == F.col("family")
    n = F.count("*")
    return rows.groupBy("family").agg(
        n.alias("n"), share(F.count_if(a), n).alias("attributed_rate"),
        F.when(F.count_if(a) > 0, share(F.count_if(a & right), F.count_if(a))).alias("accuracy_when_attributed"),
        share(F.count_if(right), n).alias("argmax_recall"))


def family_confusion(rows: DataFrame, classes: list[str]) -> DataFrame:
    """Counts by true family (rows) and predicted family (one column per class).

    Every class has a row and a column, also when it does not occur.
    """
    base = rows.sparkSession.createDataFrame([(c,) for c in classes], "family string")
    counts = rows.groupBy("family").pivot("pred", classes).agg(F.count(F.lit(1)))
    return base.join(counts, "family", "left").fillna(0, classes)


def macro_f1(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Unweighted mean F1 over the families that occur as truth or prediction."""
    keys = list(by)
    cells = rows.groupBy(*keys, "family", "pred").agg(F.count("*").alias("n"))
    hit = F.when(F.col("family") == F.col("pred"), F.col("n")).otherwise(0)
    truth = cells.select(*keys, F.col("family").alias("c"), hit.alias("tp"), F.col("n").alias("t"), F.lit(0).alias("p"))
    guess = cells.select(*keys, F.col("pred").alias("c"), F.lit(0).alias("tp"), F.lit(0).alias("t"), F.col("n").alias("p"))
    per = truth.unionByName(guess).groupBy(*keys, "c").agg(
        (2 * F.sum("tp") / (F.sum("t") + F.sum("p"))).alias("f1"))
    return (per.groupBy(*keys) if keys else per.groupBy()).agg(F.bround(F.avg("f1"), 4).alias("macro_f1"))


def best_alpha(per_alpha: DataFrame) -> DataFrame:
    """Alpha with the largest macro F1; the lowest alpha wins ties."""
    return per_alpha.agg(F.min_by(F.struct("alpha", "macro_f1"), F.struct(-F.col("macro_f1"), "alpha")).alias("b")).select("b.*")


def below_pinned(per_class: DataFrame, pinned: DataFrame, slack: float = 0.01) -> DataFrame:
    """Classes whose recall fell below the pinned value minus the slack, or vanished."""
    joined = pinned.withColumnRenamed("recall", "pinned").join(per_class, "label", "left")
    return joined.filter(F.col("recall").isNull() | (F.col("recall") < F.col("pinned") - slack))


def label_differences(seen: DataFrame, expected: DataFrame) -> DataFrame:
    """Labels on one side only."""
    a, b = seen.select("label").distinct(), expected.select("label").distinct()
    extra = a.exceptAll(b).withColumn("side", F.lit("unexpected"))
    return extra.unionByName(b.exceptAll(a).withColumn("side", F.lit("missing")))
