"""Verdicts and attack families."""
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..session import cut

Scorer = Callable[[DataFrame], DataFrame]


def technique_table(spark) -> DataFrame:
    return spark.createDataFrame(
        fixed.TECHNIQUES, "attack_family string, technique_id string, technique_name string, tactic string")


def verdict(probability: Column, threshold: float = fixed.VERDICT_THRESHOLD) -> Column:
    return F.when(probability >= threshold, "suspicious").otherwise("normal")


def confidence(probability: Column, threshold: float = fixed.VERDICT_THRESHOLD) -> Column:
    """Probability of the verdict's own class, four digits."""
    return F.when(probability >= threshold, F.bround(probability, 4)).otherwise(
        F.bround(1 - probability, 4))


def judge(scored: DataFrame, probability: str = "probability",
          threshold: float = fixed.VERDICT_THRESHOLD) -> DataFrame:
    p = F.col(probability)
    return scored.withColumns({"cnn_verdict": verdict(p, threshold),
                               "cnn_confidence": confidence(p, threshold)})


def best_family(probs: Column, classes: list[str]) -> Column:
    """Class of the largest probability; the first in class order wins ties."""
    names = F.array(*[F.lit(c) for c in classes])
    return F.element_at(names, F.array_position(probs, F.array_max(probs)).cast("int"))


def attribute(scored: DataFrame, classes: list[str], probs: str = "family_probs",
              threshold: float = fixed.ATTRIBUTION_THRESHOLD,
              abstain: str = fixed.ABSTAIN_FAMILY) -> DataFrame:
    """Family and technique of suspicious rows; NULL where the model declines.

    Needs cnn_verdict and an array of class probabilities in the order of `classes`.
    """
    p = F.col(probs)
    top, family = F.array_max(p), best_family(p, classes)
    named = (F.col("cnn_verdict") == "suspicious") & (top >= threshold) & (family != abstain)
    out = scored.withColumns({
        "attack_family": F.when(named, family),
        "attribution_confidence": F.when(named, F.bround(top, 4))})
    return name_technique(out)


def name_technique(rows: DataFrame) -> DataFrame:
    """Join attack_family to its technique; unknown families stay unattributed.

    A suspicious row without a technique carries the unattributed name.
    """
    table = technique_table(rows.sparkSession)
    out = rows.join(F.broadcast(table), "attack_family", "left")
    return out.withColumn("technique_name", F.coalesce("technique_name", F.when(
        F.col("cnn_verdict") == "suspicious", F.lit(fixed.UNATTRIBUTED_NAME))))


def classify(flows: DataFrame, gate: Scorer, attributor: Scorer | None, classes: list[str],
             threshold: float = fixed.VERDICT_THRESHOLD,
             family_threshold: float = fixed.ATTRIBUTION_THRESHOLD) -> DataFrame:
    """Two stages: `gate` adds probability; `attributor` adds family_probs.

    The attributor sees only the rows the gate flagged. The judged rows, far fewer than
    the packets they come from, are written once, so that the two halves are not built
    twice.
    """
    judged = judge(gate(flows), threshold=threshold)
    if attributor is None:
        blank = F.lit(None).cast("array<double>")
        return attribute(judged.withColumn("family_probs", blank), classes,
                         threshold=family_threshold)
    return attributed(cut(judged), attributor, classes, family_threshold)


def attributed(judged: DataFrame, attributor: Scorer, classes: list[str],
               family_threshold: float = fixed.ATTRIBUTION_THRESHOLD) -> DataFrame:
    """Judged rows with their families. Only flagged rows are shown to the attributor, so `judged` is read twice."""
    flagged = attributor(judged.filter("cnn_verdict = 'suspicious'"))
    rest = judged.filter("cnn_verdict <> 'suspicious'").withColumn(
        "family_probs", F.lit(None).cast("array<double>"))
    return attribute(flagged.unionByName(rest), classes, threshold=family_threshold)


def model_gate(model) -> Scorer:
    """A fitted Spark ML pipeline as a scorer: adds probability of the attack class."""
    def run(rows: DataFrame) -> DataFrame:
        out = model.transform(rows)
        made = [c for c in out.columns if c not in rows.columns]
        return out.withColumn("_p", vector_to_array("probability")[1]).drop(*made).withColumnRenamed(
            "_p", "probability")
    return run


def model_attributor(model) -> Scorer:
    """A fitted multi-class pipeline as a scorer: adds family_probs."""
    def run(rows: DataFrame) -> DataFrame:
        held = rows.withColumnRenamed("probability", "gate_probability")
        out = model.transform(held)
        made = [c for c in out.columns if c not in held.columns]
        return (out.withColumn("family_probs", vector_to_array("probability")).drop(*made)
                .withColumnRenamed("gate_probability", "probability"))
    return run
