"""Queries on labelled flows: preparation, evaluation, training."""
from pyspark.sql import functions as F

from .. import fixed
from ..operators import evaluate, flows, prepare, scoring, train
from ..session import cut, scratch
from ..sources import readers, sinks
from . import view_sql as v
from . import views
from .catalog import query

LABELLED = v.over("labelled")
VECTOR = "duration_s, protocol, fwd_packets, bwd_packets, fwd_bytes, bwd_bytes"
FLOAT_VECTOR = ", ".join(f"CAST({c} AS FLOAT) AS {c}" for c in VECTOR.split(", "))


def _prepared(spark, sf):
    return prepare.prepared(views.labelled_raw(spark, sf))


def order_sql(row_id: str, seed: int = 42) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || {row_id}), 1, 15) AS BIGINT)"


# --- sources ------------------------------------------------------------------
SCAN = v.over("labelled") + """SELECT attack_label, protocol, count(*) AS n, CAST(sum(fp) AS BIGINT) AS fwd_packets, CAST(sum(dur_us) AS BIGINT) AS duration
FROM labelled_raw GROUP BY 1, 2"""


def _scan(rows):
    return rows.groupBy("attack_label", "protocol").agg(
        F.count("*").alias("n"), F.sum("fwd_packets").cast("long").alias("fwd_packets"),
        F.sum("duration_s").cast("long").alias("duration"))


@query("labelled_parquet_scan", SCAN)
def labelled_parquet_scan(spark, sf):
    path = scratch(spark, "labelled")
    views.labelled_raw(spark, sf).write.parquet(path)
    return _scan(readers.labelled_parquet(spark, path))


@query("labelled_csv_scan", SCAN)
def labelled_csv_scan(spark, sf):
    path = scratch(spark, "labelled-csv")
    views.labelled_raw(spark, sf).write.option("header", True).csv(path)
    return _scan(readers.labelled_csv(spark, path))


# --- preparation --------------------------------------------------------------
@query("prepared_features", LABELLED + f"SELECT row_id, {VECTOR}, attack_label, source_ip, y FROM labelled")
def prepared_features(spark, sf):
    return _prepared(spark, sf)


@query("binary_labels", LABELLED + "SELECT attack_label, y, count(*) AS n FROM labelled GROUP BY 1, 2")
def binary_labels(spark, sf):
    return _prepared(spark, sf).groupBy("attack_label", "y").agg(F.count("*").alias("n"))


@query("reconstructable_rows", LABELLED + """SELECT row_id FROM labelled WHERE fwd_packets + bwd_packets > 0
AND NOT (fwd_bytes > 0 AND fwd_packets = 0) AND NOT (bwd_bytes > 0 AND bwd_packets = 0)""")
def reconstructable_rows(spark, sf):
    return _prepared(spark, sf).filter(prepare.reconstructable()).select("row_id")


@query("replay_safe_rows", LABELLED + """SELECT row_id FROM labelled WHERE fwd_packets > 0 AND NOT (bwd_bytes > 0 AND bwd_packets = 0)
AND fwd_packets + bwd_packets <= 9 AND duration_s < 4.0 AND protocol IN (6, 17)
AND CASE WHEN fwd_packets + bwd_packets > 1 THEN duration_s / (fwd_packets + bwd_packets - 1) ELSE 0 END < 0.8""")
def replay_safe_rows(spark, sf):
    return _prepared(spark, sf).filter(prepare.replay_safe(1.0, 9, 4.0)).select("row_id")


FAMILY_OF = """CASE replace(attack_label, '–', '-') WHEN 'PortScan' THEN 'port-scan' WHEN 'DoS Hulk' THEN 'dos' WHEN 'DDoS' THEN 'ddos'
  WHEN 'FTP-Patator' THEN 'brute-force' WHEN 'Bot' THEN 'botnet' WHEN 'Web Attack - Brute Force' THEN 'web-attack' WHEN 'Web Attack - XSS' THEN 'web-attack'
  ELSE 'other' END"""


@query("label_families", LABELLED + f"SELECT {FAMILY_OF} AS family, attack_label, count(*) AS n FROM labelled WHERE y = 1 GROUP BY 1, 2")
def label_families(spark, sf):
    return prepare.families(_prepared(spark, sf).filter("y = 1")).groupBy("family", "attack_label").agg(F.count("*").alias("n"))


@query("unmapped_labels", LABELLED + "SELECT DISTINCT attack_label AS label FROM labelled WHERE attack_label = 'Unlisted Thing'")
def unmapped_labels(spark, sf):
    return prepare.unmapped_labels(_prepared(spark, sf))


@query("label_normalise", LABELLED + "SELECT row_id, replace(attack_label, '–', '-') AS label FROM labelled")
def label_normalise(spark, sf):
    from ..functions import text
    return _prepared(spark, sf).select("row_id", text.clean_label(F.col("attack_label")).alias("label"))


@query("class_counts", LABELLED + "SELECT attack_label, count(*) AS n FROM labelled GROUP BY 1")
def class_counts(spark, sf):
    return prepare.value_counts(_prepared(spark, sf), "attack_label")


@query("class_weights", LABELLED + """, c AS (SELECT attack_label, count(*) AS n, count(*) ** -0.5 AS w FROM labelled GROUP BY 1)
SELECT attack_label, n, round(w / (SELECT sum(n * w) / sum(n) FROM c), 9) AS weight FROM c""")
def class_weights(spark, sf):
    return prepare.class_weights(_prepared(spark, sf), "attack_label", 0.5).withColumn("weight", F.round("weight", 9))


@query("shape_multiplicity", LABELLED + f"""SELECT row_id, CASE WHEN y = 1 THEN 1.0 ELSE CAST(count(*) OVER (PARTITION BY y, {VECTOR}) AS DOUBLE) END AS mult
FROM labelled""")
def shape_multiplicity(spark, sf):
    return prepare.multiplicity(_prepared(spark, sf)).select("row_id", "mult")


@query("duplicate_stats", LABELLED + f"""SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT {FLOAT_VECTOR}, y FROM labelled)) AS unique_rows,
  round_even(1 - (SELECT count(*) FROM (SELECT DISTINCT {FLOAT_VECTOR}, y FROM labelled)) / count(*), 4) AS duplicate_rate FROM labelled""")
def duplicate_stats(spark, sf):
    return prepare.duplicate_stats(_prepared(spark, sf), ["y"]).withColumn("rows", F.col("rows").cast("long"))


UNIQUE = f"""uniq AS (SELECT * FROM labelled QUALIFY row_number() OVER (PARTITION BY {', '.join(f'CAST({c} AS FLOAT)' for c in VECTOR.split(', '))}, y
  ORDER BY {order_sql('row_id')}, row_id) = 1)"""


@query("unique_shapes", v.over("labelled", extra=UNIQUE) + "SELECT row_id, attack_label, y FROM uniq")
def unique_shapes(spark, sf):
    return prepare.unique_shapes(_prepared(spark, sf), ["y"]).select("row_id", "attack_label", "y")


@query("stratified_split", LABELLED + f""", r AS (SELECT row_id, attack_label, row_number() OVER w AS place, count(*) OVER (PARTITION BY attack_label) AS n
  FROM labelled WINDOW w AS (PARTITION BY attack_label ORDER BY {order_sql('row_id')}, row_id))
SELECT row_id, attack_label, CASE WHEN place <= ceil(n * 0.2) THEN 'test' WHEN place <= ceil(n * 0.2) + ceil((n - ceil(n * 0.2)) * 0.25) THEN 'val'
  ELSE 'train' END AS part FROM r""")
def stratified_split(spark, sf):
    return prepare.stratified_split(_prepared(spark, sf), "attack_label").select("row_id", "attack_label", "part")


@query("group_split", LABELLED + f""", g AS (SELECT source_ip, row_number() OVER (ORDER BY {order_sql('source_ip')}, source_ip) AS place, count(*) OVER () AS n
  FROM (SELECT DISTINCT source_ip FROM labelled))
SELECT row_id, source_ip, CASE WHEN place <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS part FROM labelled JOIN g USING (source_ip)""")
def group_split(spark, sf):
    return prepare.group_split(_prepared(spark, sf)).select("row_id", "source_ip", "part")


@query("class_sample", LABELLED + f"""SELECT row_id, attack_label FROM labelled QUALIFY row_number() OVER (PARTITION BY attack_label
  ORDER BY {order_sql('row_id')}, row_id) <= CASE WHEN attack_label = 'BENIGN' THEN 120 ELSE 25 END""")
def class_sample(spark, sf):
    return prepare.class_sample(_prepared(spark, sf)).select("row_id", "attack_label")


@query("balanced_rows", LABELLED + f""", b AS (SELECT row_id, y, row_number() OVER (ORDER BY {order_sql('row_id')}, row_id) AS place FROM labelled WHERE y = 0)
SELECT row_id, y FROM labelled WHERE y = 1
UNION ALL SELECT row_id, y FROM b WHERE place <= floor((SELECT count(*) FROM labelled WHERE y = 1) * 1.5)""")
def balanced_rows(spark, sf):
    return prepare.balanced(_prepared(spark, sf), 1.5).select("row_id", "y")


# --- binary evaluation --------------------------------------------------------
PRED = "pred AS (SELECT *, CASE WHEN p >= 0.65 THEN 1 ELSE 0 END AS pred FROM scores)"
SCORES = v.over("scores", extra=PRED)
RECALLS = """recalls AS (SELECT label, count(*) AS n, round_even(avg(CASE WHEN label = 'BENIGN' THEN 1 - pred ELSE pred END), 4) AS recall FROM pred GROUP BY 1)"""


def _decided(spark, sf):
    return evaluate.decided(views.scored_rows(spark, sf), 0.65)


@query("class_recall", v.over("scores", extra=PRED + ",\n" + RECALLS) + "SELECT label, n, recall FROM recalls")
def class_recall(spark, sf):
    return evaluate.class_recall(_decided(spark, sf))


@query("recall_averages", v.over("scores", extra=PRED + ",\n" + RECALLS) + """SELECT round_even(avg(recall), 4) AS macro_recall,
  round_even(sum(recall * n) / sum(n), 4) AS weighted_recall FROM recalls WHERE label <> 'BENIGN'""")
def recall_averages(spark, sf):
    return evaluate.recall_averages(evaluate.class_recall(_decided(spark, sf)))


@query("benign_false_alarms", SCORES + """SELECT round_even(sum(mult) FILTER (WHERE y = 0 AND pred = 1) / sum(mult) FILTER (WHERE y = 0), 6) AS per_flow_fpr,
  round_even(count(*) FILTER (WHERE y = 0 AND pred = 1) / count(*) FILTER (WHERE y = 0), 6) AS per_shape_fpr,
  count(*) FILTER (WHERE y = 0) AS benign_shapes, CAST(sum(mult) FILTER (WHERE y = 0) AS BIGINT) AS benign_flows_represented FROM pred""")
def benign_false_alarms(spark, sf):
    return evaluate.benign_fpr(_decided(spark, sf))


CELLS = """cells AS (SELECT count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp,
  count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp FROM pred)"""


@query("binary_confusion", v.over("scores", extra=PRED + ",\n" + CELLS) + "SELECT tn, fp, fn, tp FROM cells")
def binary_confusion(spark, sf):
    return evaluate.confusion(_decided(spark, sf))


def auc_sql(value: str, source: str) -> str:
    """Rank AUC of a value, ties at half."""
    return f"""(SELECT sum(pos * (coalesce(lower, 0) + neg / 2.0)) / (sum(pos) * sum(neg)) FROM (
      SELECT pos, neg, sum(neg) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lower FROM (
        SELECT {value} AS x, CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) AS pos, CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE) AS neg FROM {source} GROUP BY 1)))"""


@query("binary_scores", v.over("scores", extra=PRED + ",\n" + CELLS) + f"""SELECT round_even((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy,
  round_even(tp / (tp + fp), 4) AS "precision", round_even(tp / (tp + fn), 4) AS recall, round_even(2 * tp / (2 * tp + fp + fn), 4) AS f1,
  round_even({auc_sql('p', 'scores')}, 4) AS roc_auc FROM cells""")
def binary_scores(spark, sf):
    return evaluate.binary_scores(_decided(spark, sf))


@query("feature_auc", LABELLED + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round_even(greatest(a, 1 - a), 4) AS univariate_auc FROM (SELECT {auc_sql(c, 'labelled')} AS a)" for c in fixed.FEATURES))
def feature_auc(spark, sf):
    return evaluate.univariate_auc(_prepared(spark, sf))


GRID = "grid AS (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])::DOUBLE AS threshold)"
FRONT = """sweep AS (SELECT CASE WHEN fold % 2 = 0 THEN 'first' ELSE 'second' END AS model, [0.0, 0.15, 0.25, 0.35, 0.5][fold // 2 + 1]::DOUBLE AS alpha, * FROM scores),
byclass AS (SELECT model, alpha, threshold, label, y, count(*) AS n, sum(mult) AS m, count(*) FILTER (WHERE p >= threshold) AS hit,
    coalesce(sum(mult) FILTER (WHERE p >= threshold), 0) AS hit_m, round_even(count(*) FILTER (WHERE p >= threshold) / count(*), 4) AS r
  FROM sweep, grid GROUP BY 1, 2, 3, 4, 5),
front AS (SELECT model, alpha, threshold, round_even(avg(r) FILTER (WHERE y = 1), 4) AS macro_recall,
    round_even(sum(r * n) FILTER (WHERE y = 1) / sum(n) FILTER (WHERE y = 1), 4) AS weighted_recall,
    coalesce(round_even(sum(hit_m) FILTER (WHERE y = 0) / sum(m) FILTER (WHERE y = 0), 6), 0) AS per_flow_benign_fpr,
    coalesce(round_even(sum(hit) FILTER (WHERE y = 0) / sum(n) FILTER (WHERE y = 0), 6), 0) AS per_shape_benign_fpr FROM byclass GROUP BY 1, 2, 3)"""
FRONTIER = v.over("scores", extra=GRID + ",\n" + FRONT)


def _frontier(spark, sf):
    rows = views.scored_rows(spark, sf)
    alphas = F.array(*[F.lit(a) for a in fixed.GATE_ALPHAS])
    rows = rows.withColumns({"model": F.when(F.col("fold") % 2 == 0, "first").otherwise("second"),
                             "alpha": F.element_at(alphas, (F.floor(F.col("fold") / 2) + 1).cast("int"))})
    return evaluate.frontier(rows)


@query("threshold_frontier", FRONTIER + """SELECT model, alpha, threshold, macro_recall, weighted_recall, per_flow_benign_fpr, per_shape_benign_fpr,
  per_flow_benign_fpr <= 0.01 AS meets_fpr_budget FROM front""")
def threshold_frontier(spark, sf):
    return _frontier(spark, sf).drop("per_class_recall")


@query("frontier_class_recall", FRONTIER + "SELECT model, alpha, threshold, label, r AS recall FROM byclass WHERE y = 1")
def frontier_class_recall(spark, sf):
    return _frontier(spark, sf).select("model", "alpha", "threshold", F.explode("per_class_recall").alias("label", "recall"))


@query("operating_point", FRONTIER + """, pick AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY per_flow_benign_fpr > 0.01,
    CASE WHEN per_flow_benign_fpr > 0.01 AND NOT (alpha = 0 AND threshold = 0.5) THEN 1 ELSE 0 END,
    -macro_recall, NOT (alpha = 0 AND threshold = 0.5), per_flow_benign_fpr, alpha, threshold) AS place FROM front)
SELECT model, alpha, threshold, macro_recall, per_flow_benign_fpr, CASE WHEN per_flow_benign_fpr > 0.01 THEN 'no point meets the budget'
  WHEN alpha = 0 AND threshold = 0.5 THEN 'default kept' ELSE 'most macro recall within the budget' END AS reason FROM pick WHERE place = 1""")
def operating_point(spark, sf):
    return evaluate.operating_point(_frontier(spark, sf))


@query("recall_regression", v.over("scores", extra=PRED + ",\n" + RECALLS) + """SELECT label, n, recall, 0.5::DOUBLE AS pinned FROM recalls WHERE recall < 0.49""")
def recall_regression(spark, sf):
    per = evaluate.class_recall(_decided(spark, sf))
    pinned = per.select("label", F.lit(0.5).alias("recall"))
    return evaluate.below_pinned(per, pinned)


@query("label_differences", LABELLED + """, seen AS (SELECT DISTINCT attack_label AS label FROM labelled WHERE y = 1)
SELECT label, 'unexpected' AS side FROM seen WHERE label IN ('Unlisted Thing', 'Web Attack – Brute Force', 'Web Attack – XSS')
UNION ALL SELECT label, 'missing' FROM (VALUES ('DoS GoldenEye'), ('DoS slowloris'), ('DoS Slowhttptest'), ('SSH-Patator'), ('Web Attack - Brute Force'),
  ('Web Attack - XSS'), ('Web Attack - Sql Injection'), ('Heartbleed')) e(label)""")
def label_differences(spark, sf):
    """Raw labels against the listed ones; the dashes differ."""
    seen = _prepared(spark, sf).filter("y = 1").select(F.col("attack_label").alias("label"))
    return evaluate.label_differences(seen, prepare.family_table(spark))


# --- families -----------------------------------------------------------------
FAM = v.over("family_scores")


def _families(spark, sf):
    rows = views.family_scores(spark, sf)
    return rows.select("row_id", "turn", "family", scoring.best_family(F.col("family_probs"), views.FAMILIES).alias("pred"),
                       F.array_max("family_probs").alias("conf"))


SWEEP = """tgrid AS (SELECT unnest([0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])::DOUBLE AS threshold),
asweep AS (SELECT threshold, round_even(count(*) FILTER (WHERE a) / count(*), 4) AS coverage,
  CASE WHEN count(*) FILTER (WHERE a) > 0 THEN round_even(count(*) FILTER (WHERE a AND pred = family) / count(*) FILTER (WHERE a), 4) END AS accuracy_when_attributed,
  count(*) FILTER (WHERE a) AS attributed, count(*) AS total
  FROM (SELECT *, conf >= threshold AND pred <> 'other' AS a FROM family_scores, tgrid) GROUP BY 1)"""


@query("family_argmax", FAM + "SELECT row_id, family, pred, conf FROM family_scores")
def family_argmax(spark, sf):
    return _families(spark, sf).drop("turn")


@query("attribution_sweep", v.over("family_scores", extra=SWEEP) + "SELECT * FROM asweep")
def attribution_sweep(spark, sf):
    return evaluate.attribution_sweep(_families(spark, sf))


@query("confidence_threshold", v.over("family_scores", extra=SWEEP) + """SELECT threshold, coverage, accuracy_when_attributed, accuracy_when_attributed >= 0.85 AS meets_floor
FROM asweep WHERE accuracy_when_attributed IS NOT NULL ORDER BY accuracy_when_attributed < 0.85,
  CASE WHEN accuracy_when_attributed >= 0.85 THEN -coverage END, -accuracy_when_attributed, threshold LIMIT 1""")
def confidence_threshold(spark, sf):
    return evaluate.confidence_threshold(evaluate.attribution_sweep(_families(spark, sf)), 0.85)


@query("family_report", FAM + """SELECT family, count(*) AS n, round_even(count(*) FILTER (WHERE a) / count(*), 4) AS attributed_rate,
  coalesce(round_even(count(*) FILTER (WHERE a AND pred = family) / nullif(count(*) FILTER (WHERE a), 0), 4), -1) AS accuracy_when_attributed,
  round_even(count(*) FILTER (WHERE pred = family) / count(*), 4) AS argmax_recall
FROM (SELECT *, conf >= 0.5 AND pred <> 'other' AS a FROM family_scores) GROUP BY 1""")
def family_report(spark, sf):
    return evaluate.family_table(_families(spark, sf), 0.5).fillna(-1.0, ["accuracy_when_attributed"])


@query("family_confusion", FAM + "SELECT family, " + ", ".join(
    f"count(*) FILTER (WHERE pred = '{c}') AS \"{c}\"" for c in views.FAMILIES) + " FROM family_scores GROUP BY 1")
def family_confusion(spark, sf):
    return evaluate.family_confusion(_families(spark, sf), views.FAMILIES)


@query("macro_f1", FAM + """SELECT round_even(avg(2.0 * tp / (t + p)), 4) AS macro_f1 FROM (
  SELECT c, (SELECT count(*) FROM family_scores WHERE family = c AND pred = c) AS tp, (SELECT count(*) FROM family_scores WHERE family = c) AS t,
    (SELECT count(*) FROM family_scores WHERE pred = c) AS p
  FROM (SELECT family AS c FROM family_scores UNION SELECT pred FROM family_scores))""")
def macro_f1(spark, sf):
    return evaluate.macro_f1(_families(spark, sf))


@query("best_alpha", FAM + """, f AS (SELECT alpha, round_even(avg(2.0 * tp / (t + p)), 4) AS macro_f1 FROM (
  SELECT alpha, c, count(*) FILTER (WHERE family = c AND pred = c) AS tp, count(*) FILTER (WHERE family = c) AS t, count(*) FILTER (WHERE pred = c) AS p
  FROM (SELECT [0.0, 0.25, 0.5, 0.75, 1.0][turn % 5 + 1]::DOUBLE AS alpha, * FROM family_scores), (SELECT DISTINCT family AS c FROM family_scores)
  GROUP BY 1, 2) WHERE t + p > 0 GROUP BY 1)
SELECT alpha, macro_f1 FROM f ORDER BY macro_f1 DESC, alpha LIMIT 1""")
def best_alpha(spark, sf):
    alphas = F.array(*[F.lit(a) for a in fixed.FAMILY_ALPHAS])
    rows = _families(spark, sf).withColumn("alpha", F.element_at(alphas, (F.col("turn") % 5 + 1).cast("int")))
    return evaluate.best_alpha(evaluate.macro_f1(rows, ("alpha",)))


# --- training -----------------------------------------------------------------
# Fits depend on Spark's learners, so those below have no SQL; tests/test_learning.py holds them against what must be true of any.
LEARNERS = {"trees": train.boosted, "linear": train.linear}


def _training_rows(spark, sf):
    rows = _prepared(spark, sf)
    unique = cut(prepare.unique_shapes(prepare.balanced(rows), ["y"]))
    return cut(prepare.stratified_split(prepare.multiplicity(unique, among=rows), "y"))


@query("standardised_features", LABELLED + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, 0.0 AS mean, CASE WHEN stddev_pop({c}) > 0 THEN 1.0 ELSE 0.0 END AS spread FROM labelled" for c in fixed.FEATURES))
def standardised_features(spark, sf):
    """Mean and population spread of each column after scaling."""
    rows = _prepared(spark, sf)
    scaled = train.scaler(rows)[0].transform(rows)
    stats = scaled.agg(*[F.array((F.round(F.avg(f"z_{c}"), 6) + 0.0), F.round(F.stddev_pop(f"z_{c}"), 6)).alias(c) for c in fixed.FEATURES])
    return stats.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c)[0].alias("mean"), F.col(c)[1].alias("spread"))
                                            for c in fixed.FEATURES])).alias("s")).select("s.*")


@query("gate_training")
def gate_training(spark, sf):
    """Boosted trees on the train part, through a saved model, scored on the test part."""
    parts = _training_rows(spark, sf)
    model = train.fit_gate(train.packed(parts.filter("part = 'train'")), 0.5, train.boosted())
    path = scratch(spark, "gate")
    sinks.save_model(model, path)
    rows = train.gate_probability(sinks.load_model(path), parts.filter("part = 'test'"))
    return evaluate.binary_scores(evaluate.decided(rows, 0.5))


@query("frontier_training")
def frontier_training(spark, sf):
    """Both models over all alphas and the whole threshold grid, on the validation part."""
    parts = _training_rows(spark, sf)
    front, _ = train.sweep(parts.filter("part = 'train'"), parts.filter("part = 'val'"), LEARNERS)
    return front.drop("per_class_recall")


@query("split_evaluation")
def split_evaluation(spark, sf):
    return train.split_report(cut(views.labelled_raw(spark, sf)), {"trees": (0.5, 0.5), "linear": (0.0, 0.5)}, LEARNERS)


def stump_sql(value: str, source: str) -> str:
    """AUC of a tree with one split: the two sides of the split of least Gini impurity, the smallest value among equals."""
    return f"""coalesce((SELECT (greatest(lp * rn, rp * ln) + 0.5 * (lp * ln + rp * rn)) / ((lp + rp) * (ln + rn)) FROM (
      SELECT x, lp, ln, p_all - lp AS rp, n_all - ln AS rn FROM (
        SELECT x, sum(pos) OVER (ORDER BY x) AS lp, sum(neg) OVER (ORDER BY x) AS ln, sum(pos) OVER () AS p_all, sum(neg) OVER () AS n_all FROM (
          SELECT {value} AS x, CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) AS pos, CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE) AS neg FROM {source} GROUP BY 1)))
      WHERE rp + rn > 0 ORDER BY (lp * lp + ln * ln) / (lp + ln) + (rp * rp + rn * rn) / (rp + rn) DESC, x LIMIT 1), 0.5)"""


@query("leakage_check", LABELLED + f""", b AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {order_sql('row_id')}, row_id) AS place FROM labelled),
balanced AS (SELECT * FROM b WHERE y = 1 OR place <= floor((SELECT count(*) FROM labelled WHERE y = 1) * 1.5)),
aucs AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, (SELECT greatest(a, 1 - a) FROM (SELECT {auc_sql(c, 'balanced')} AS a)) AS u, {stump_sql(c, 'balanced')} AS t" for c in fixed.FEATURES)
    + f""") SELECT feature, round_even(u, 4) AS univariate_auc, round_even(t, 4) AS stump_auc, u >= {fixed.LEAK_AUC} OR t >= {fixed.LEAK_AUC} AS flagged FROM aucs""")
def leakage_check(spark, sf):
    """Every feature on its own, on the balanced rows."""
    return evaluate.leakage_check(prepare.balanced(_prepared(spark, sf), 1.5))


@query("chosen_point_test")
def chosen_point_test(spark, sf):
    """Both models at the operating points that the validation part chooses, on the test part."""
    return train.chosen_report(_training_rows(spark, sf), LEARNERS)[0]


def _family_rows(spark, sf):
    """Attacks, each vector once per family, in parts: equal rows in two parts would raise every number."""
    attacks = prepare.families(_prepared(spark, sf).filter("y = 1"))
    return cut(prepare.stratified_split(cut(prepare.unique_shapes(attacks, ["family"])), "family"))


@query("attributor_training")
def attributor_training(spark, sf):
    """Family forest per alpha, macro F1 on the validation part."""
    rows = _family_rows(spark, sf)
    scores, _, _ = train.alpha_sweep(rows.filter("part = 'train'"), rows.filter("part = 'val'"), train.forest)
    return scores


@query("attribution_test_report")
def attribution_test_report(spark, sf):
    """Families on the test part, with the alpha and the confidence threshold that the validation part chooses."""
    rows = _family_rows(spark, sf)
    return train.attribution_report(rows, train.forest)[0]


@query("train_serve_agreement", LABELLED + """, safe AS (SELECT DISTINCT row_id FROM labelled WHERE fwd_packets > 0 AND NOT (bwd_bytes > 0 AND bwd_packets = 0)
  AND (duration_s = 0 OR fwd_packets + bwd_packets > 1) AND protocol IN (6, 17) AND duration_s < 100 AND CASE WHEN fwd_packets + bwd_packets > 1 THEN duration_s / (fwd_packets + bwd_packets - 1) ELSE 0 END < 12)
SELECT count(*) AS rows, 0 AS unmatched, 0 AS over_tolerance, 0 AS verdict_mismatches FROM safe""")
def train_serve_agreement(spark, sf):
    """Labelled rows played as packets, rebuilt as flows, scored both ways by one model.

    A single packet cannot carry a duration, so such rows are left out.
    """
    rows = prepare.where(_prepared(spark, sf), prepare.replay_safe() & (
        (F.col("duration_s") == 0) | (F.col("fwd_packets") + F.col("bwd_packets") > 1)))
    # written once, so that the numbers stay as they are
    rows = cut(rows.distinct().withColumn("flow_id", F.monotonically_increasing_id()))
    model = train.fit_gate(train.packed(prepare.merged(rows)), 0.0, train.linear(), train.scaler(rows))
    n = F.col("flow_id")
    as_flows = rows.withColumns({
        "src_ip": F.concat_ws(".", F.lit("100"), *[(F.floor(n / d) % 256).cast("string") for d in (65536, 256, 1)]),
        "src_port": (1024 + F.floor(n / 16777216) % 60000).cast("int"), "dst_ip": F.lit(views.SERVER),
        "dst_port": (1 + F.floor(n / 16777216 / 60000) % 60000).cast("int"), "proto": F.col("protocol").cast("int")})
    packets = flows.expand_to_packets(as_flows).withColumn("seq", F.col("flow_id") * 4096 + F.col("nth"))
    # Every row has a key of its own and, being safe, 2000 packets at most, which make one flow.
    built = flows.feature_columns(flows.build_flows(packets.drop("flow_id", "nth"), group_rows=None, whole=True))
    live = built.withColumn("flow_id", F.floor(F.col("flow_id") / 4096))
    score = lambda r: evaluate.decided(train.gate_probability(model, r), 0.5)
    out = train.agreement(score(rows), score(live))
    return out.select("rows", *[F.col(c).cast("int").alias(c) for c in ("unmatched", "over_tolerance", "verdict_mismatches")])


@query("evaluation_metadata", v.over("scores", extra=PRED + ",\n" + RECALLS) + "SELECT label, n, recall FROM recalls")
def evaluation_metadata(spark, sf):
    """The recall table written as one JSON file and read back."""
    path = scratch(spark, "metadata")
    sinks.write_json(evaluate.class_recall(_decided(spark, sf)), path)
    return spark.read.schema("label string, n long, recall double").json(path)
