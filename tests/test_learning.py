"""Fits: what must be true of any learner, on the smallest tables."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom import fixed
from packetloom.functions import numeric
from packetloom.operators import evaluate, flows, prepare, train
from packetloom.plans import queries_learning as q
from packetloom.session import cut
from packetloom.sources import sinks


@pytest.fixture(scope="module")
def parts(spark, sf):
    return cut(q._training_rows(spark, sf))


def test_parts_are_whole_and_apart(parts):
    by = {(r["part"], r["y"]): r["count"] for r in parts.groupBy("part", "y").count().collect()}
    assert sum(by.values()) == parts.count()
    assert {p for p, _ in by} == {"train", "val", "test"} and {y for _, y in by} == {0, 1}


def test_a_saved_model_agrees_on_every_row(parts, tmp_path):
    model = train.fit_gate(train.packed(parts.filter("part = 'train'")), 0.5, train.boosted(3))
    sinks.save_model(model, f"{tmp_path}/gate")
    test = parts.filter("part = 'test'").select("row_id", "y", *fixed.FEATURES)
    one = train.gate_probability(model, test).withColumnRenamed("p", "p1")
    two = train.gate_probability(sinks.load_model(f"{tmp_path}/gate"), test).select("row_id", F.col("p").alias("p2"))
    both = one.join(two, "row_id")
    assert both.count() == test.count() and both.filter("p1 <> p2 or p1 < 0 or p1 > 1").isEmpty()


def test_boosting_lowers_the_training_loss(parts):
    rows = train.packed(parts.filter("part = 'train'"))
    loss = []
    for rounds in (1, 12):
        p = train.gate_probability(train.fit_gate(rows, 0.0, train.boosted(rounds)), rows.select("y", *fixed.FEATURES))
        loss.append(p.agg(F.avg(-F.log(F.greatest(F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p")), F.lit(1e-9))))).first()[0])
    assert loss[1] < loss[0]


def test_the_linear_contender_is_at_its_optimum(parts):
    """The weighted gradient of the log loss is near zero in every direction."""
    rows = train.packed(parts.filter("part = 'train'"))
    model = train.fit_gate(rows, 0.25, train.linear())
    data = model.stages[1].transform(model.stages[0].transform(prepare.weighted(rows, fixed.LABEL_COLUMN, 0.25))).select("features", "y", "weight").toPandas()
    x = np.array([v.toArray() for v in data.features])
    fitted = model.stages[-1]
    p = 1 / (1 + np.exp(-(x @ fitted.coefficients.toArray() + fitted.intercept)))
    w = data.weight.to_numpy() / data.weight.sum()
    slope = np.append(x.T @ (w * (p - data.y)), (w * (p - data.y)).sum())
    assert np.abs(slope).max() < 2e-3


def test_the_frontier_holds_every_alpha_and_threshold_and_its_point(parts):
    front, fitted = train.sweep(parts.filter("part = 'train'"), parts.filter("part = 'val'"), {"linear": train.linear})
    rows = front.collect()
    assert set(fitted) == {("linear", a) for a in fixed.GATE_ALPHAS}
    assert {(r["alpha"], r["threshold"]) for r in rows} == {(a, t) for a in fixed.GATE_ALPHAS for t in fixed.GATE_THRESHOLDS}


def test_family_forest_names_known_families(spark, sf):
    rows = cut(prepare.stratified_split(prepare.families(q._prepared(spark, sf).filter("y = 1")), "family"))
    scores, scored, fitted = train.alpha_sweep(rows.filter("part = 'train'"), rows.filter("part = 'val'"), lambda: train.forest(4), [0.0, 1.0])
    assert sorted(r["alpha"] for r in scores.collect()) == [0.0, 1.0] and set(fitted) == {0.0, 1.0}
    assert all(0 <= r["macro_f1"] <= 1 for r in scores.collect())
    known = {r[0] for r in rows.select("family").distinct().collect()}
    assert {r[0] for r in scored.select("pred").distinct().collect()} <= known


def plain_stump(rows, k):
    """AUC of the best one-split tree, by trying every split."""
    values, best = sorted({r[k] for r in rows}), None
    for v in values[:-1]:
        sides = [[r[6] for r in rows if r[k] <= v], [r[6] for r in rows if r[k] > v]]
        gini = sum(len(s) * (1 - (sum(s) / len(s)) ** 2 - (1 - sum(s) / len(s)) ** 2) for s in sides)
        if best is None or gini < best[0] - 1e-9:
            best = (gini, v)
    share = lambda r: 0 if best is None else np.mean([x[6] for x in rows if (x[k] <= best[1]) == (r[k] <= best[1])])
    good, bad = [share(r) for r in rows if r[6]], [share(r) for r in rows if not r[6]]
    return np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])


def test_one_split_trees_equal_brute_force(spark):
    rows = [(float(k % 5), float(k % 3), 1.0, float(k * 37 % 101), float(k % 7), float(k * k % 83), int(k % 5 > 2 or k % 11 == 3)) for k in range(210)]
    frame = spark.createDataFrame(rows, ", ".join([*[f"{c} double" for c in fixed.FEATURES], "y int"]))
    found = {r["feature"]: r for r in evaluate.leakage_check(frame).collect()}
    for k, c in enumerate(fixed.FEATURES):
        good, bad = [r[k] for r in rows if r[6]], [r[k] for r in rows if not r[6]]
        auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
        assert found[c]["univariate_auc"] == pytest.approx(max(auc, 1 - auc), abs=1e-4)
        assert found[c]["stump_auc"] == pytest.approx(plain_stump(rows, k), abs=1e-4)
    assert found[fixed.FEATURES[2]]["stump_auc"] == 0.5 and not found[fixed.FEATURES[2]]["flagged"]


def test_a_feature_that_tells_the_classes_apart_is_flagged(spark):
    rows = [(float(k), 1.0, 1.0, 1.0, 1.0, float(k % 2), int(k < 40)) for k in range(100)]
    frame = spark.createDataFrame(rows, ", ".join([*[f"{c} double" for c in fixed.FEATURES], "y int"]))
    found = {r["feature"]: r for r in evaluate.leakage_check(frame).collect()}
    assert found[fixed.FEATURES[0]]["flagged"] and found[fixed.FEATURES[0]]["stump_auc"] == 1.0
    assert not any(found[c]["flagged"] for c in fixed.FEATURES[1:])
    assert all(r["stump_auc"] is None for r in evaluate.leakage_check(frame.filter("y = 1")).collect())


def test_the_chosen_point_is_carried_to_the_test_part(parts):
    report, chosen = train.chosen_report(parts, {"linear": train.linear}, [0.0, 0.5])
    (row,) = report.collect()
    front, _ = train.sweep(parts.filter("part = 'train'"), parts.filter("part = 'val'"), {"linear": train.linear}, [0.0, 0.5])
    point = evaluate.operating_point(front).first()
    assert (row["alpha"], row["threshold"], row["reason"]) == (point["alpha"], point["threshold"], point["reason"])
    scored = train.gate_probability(chosen["linear"], parts.filter("part = 'test'")).select("y", "p").collect()
    cells = {(y, p): sum(1 for r in scored if r["y"] == y and (r["p"] >= row["threshold"]) == p) for y in (0, 1) for p in (False, True)}
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (cells[0, False], cells[0, True], cells[1, False], cells[1, True])


def test_the_family_report_uses_what_the_validation_part_chose(spark, sf):
    rows = cut(prepare.stratified_split(prepare.families(q._prepared(spark, sf).filter("y = 1")), "family"))
    table, test, _ = train.attribution_report(rows, lambda: train.forest(4), [0.0, 1.0])
    table, test = table.collect(), test.collect()
    assert len(test) == rows.filter("part = 'test'").count() == sum(r["n"] for r in table)
    limit = table[0]["threshold"]
    assert limit in fixed.FAMILY_THRESHOLDS and table[0]["alpha"] in (0.0, 1.0)
    given = [r for r in test if r["conf"] >= limit and r["pred"] != fixed.ABSTAIN_FAMILY]
    for r in table:
        own = [x for x in test if x["family"] == r["family"]]
        assert r["argmax_recall"] == pytest.approx(np.mean([x["pred"] == x["family"] for x in own]), abs=1e-4)
        assert r["attributed_rate"] == pytest.approx(sum(x in given for x in own) / len(own), abs=1e-4)
        assert r["test_coverage"] == pytest.approx(len(given) / len(test), abs=1e-4)


def test_family_rows_hold_each_vector_once_in_one_part(spark, sf):
    vector = [F.col(c).cast("float").alias(c) for c in fixed.FEATURES]
    rows = q._family_rows(spark, sf).select(*vector, "family", "part")
    whole = prepare.families(q._prepared(spark, sf).filter("y = 1")).select(*vector, "family")
    assert rows.count() == rows.drop("part").distinct().count() == whole.distinct().count() < whole.count()
    assert {r[0] for r in rows.select("part").distinct().collect()} == {"train", "val", "test"}


def _copied(parts, times):
    return cut(parts.withColumn("copy", F.explode(F.sequence(F.lit(1), times))).drop("copy"))


@pytest.mark.parametrize("learner", [lambda: train.boosted(3), train.linear])
def test_merged_rows_give_the_fit_of_all_their_copies(parts, learner):
    whole = _copied(parts.filter("part = 'train'"), 3 + F.col("y"))
    stages = train.scaler(whole)
    fits = [train.fit_gate(train.packed(rows), 0.5, learner(), stages) for rows in (whole, prepare.merged(whole))]
    one, two = (train.gate_probability(m, parts.filter("part = 'test'").select("row_id", *fixed.FEATURES)) for m in fits)
    both = one.join(two.select("row_id", F.col("p").alias("p2")), "row_id")
    assert both.filter(F.abs(F.col("p") - F.col("p2")) > 1e-4).isEmpty() and not both.isEmpty()
    by_shape = train.shape_probability(fits[0], _copied(parts, 3 + F.col("y")).select("row_id", "y", *fixed.FEATURES)).groupBy("row_id").agg(
        F.count("*").alias("n"), F.min("p").alias("lo"), F.max("p").alias("p3"))
    again = one.join(by_shape, "row_id").join(parts.select("row_id", "y"), "row_id")
    assert again.count() == both.count() and again.filter("p <> p3 or lo <> p3 or n <> 3 + y").isEmpty()


def test_a_split_is_fitted_on_merged_rows(parts, monkeypatch):
    """Copies of rows change neither what a fit reads nor what it gives."""
    read, fit = [], train.fit_gate
    monkeypatch.setattr(train, "fit_gate", lambda rows, *a: read.append(rows.count()) or fit(rows, *a))
    lines = [train.evaluate_split(p, {"linear": (0.0, 0.5)}, {"linear": train.linear}, "dedup").first() for p in (parts, _copied(parts, F.lit(3)))]
    assert read[0] == read[1] and all(lines[0][c] * 3 == lines[1][c] for c in ("tn", "fp", "fn", "tp"))


def test_shapes_are_counted_for_the_rows_that_are_left(spark, sf):
    """Counting among all rows after the choice gives what counting before it gives."""
    rows = q._prepared(spark, sf)
    before = prepare.unique_shapes(prepare.balanced(prepare.multiplicity(rows)), ["y"])
    after = prepare.multiplicity(prepare.unique_shapes(prepare.balanced(rows), ["y"]), among=rows).select(*before.columns)
    assert after.exceptAll(before).isEmpty() and after.count() == before.count() and not after.filter("mult > 1").isEmpty()


def test_the_served_model_is_fitted_on_merged_rows(spark, sf, monkeypatch):
    read, fit = [], train.fit_gate
    monkeypatch.setattr(train, "fit_gate", lambda rows, *a: read.append(rows) or fit(rows, *a))
    (row,) = q.train_serve_agreement(spark, sf).collect()
    assert row["unmatched"] == row["over_tolerance"] == row["verdict_mismatches"] == 0
    assert read[0].count() < row["rows"] == read[0].agg(F.sum("copies")).first()[0]


def test_rows_played_as_packets_are_summed_up_not_sorted(spark, sf, monkeypatch):
    """Safe rows give back one flow each, so no packet is dealt out and folded."""
    folded, fold = [], flows._fold
    monkeypatch.setattr(flows, "_fold", lambda *a: folded.append(a) or fold(*a))
    (row,) = q.train_serve_agreement(spark, sf).collect()
    assert row["rows"] > 0 and row["unmatched"] == row["over_tolerance"] == row["verdict_mismatches"] == 0 and not folded


def test_a_condition_reads_columns_that_are_computed_once(spark):
    raw = spark.range(20).withColumn("_row", F.col("id") % 3)
    rows = raw.withColumn("x", F.sqrt("id") + F.col("_row"))
    safe = (F.col("x") > 1) & (F.col("x") != 3) & (F.col("x") < 5)
    kept = prepare.where(rows, safe)
    assert kept.columns == rows.columns and sorted(kept.collect()) == sorted(rows.filter(safe).collect())
    assert [df._jdf.queryExecution().optimizedPlan().toString().count("SQRT") for df in (kept, rows.filter(safe))] == [1, 4]


def test_whole_numbers_are_rounded_as_round_does(spark):
    values = [0.0, -0.0, 0.49999999999999994, 0.5, 1.5, 2.5, -0.5, -1.5, -2.5, 1234567.5, 4503599627370495.5, 1e15, 99999999.4999999, 3.0000000000000004, None]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select(numeric.rounded(F.col("x")).alias("a"), F.round("x").alias("b"))
    assert rows.filter("not a <=> b").isEmpty()
