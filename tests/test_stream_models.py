"""Streams with fitted models, counters, rates in two steps, and state that ends."""
import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from packetloom import fixed
from packetloom.operators import enrich, prepare, scoring, train
from packetloom.plans import queries_learning, views
from packetloom.sources import readers, sinks
from packetloom.streaming import counters, detect
from packetloom.streaming import flows as stream
from tests.test_scale_rules import ALERT, T0
from tests.test_streams import arrive, packet, table, wait_for


def test_one_late_row_is_counted_once_over_restarts(spark, tmp_path):
    source, sink, state, counts = (str(tmp_path / x) for x in ("in", "out", "state", "counts"))
    progress = counters.Progress(spark, counts)
    spark.streams.addListener(progress)
    try:
        for rows in ([packet(1, 0), packet(2, 500, port=2000)], [packet(3, 100), packet(4, 600, port=2000)]):
            arrive(spark, rows, source)
            run = stream.advance(readers.packet_stream(spark, source), sink, state, 15, 120, "10 seconds")
            progress.settle(run)
    finally:
        spark.streams.removeListener(progress)
    found = counters.totals(spark, counts, str(run.id)).first().asDict()
    held = stream.still_open(spark, state).count()
    assert found == {"late_rows": 1, "rows_written": spark.read.schema(stream.OUTPUT).parquet(sink).count()}
    assert found["rows_written"] + held == 3 and found["rows_written"] == 2


def test_throttle_state_ends_on_a_live_stream(spark, tmp_path):
    rows = [(T0, 1, "suspicious", 0.999, "a", "T1", "n", "t", 90, "x", "s"), (T0 + timedelta(seconds=1), 2, "suspicious", 0.999, "a", "T1", "n", "t", 90, "x", "s"),
            (T0, 3, "suspicious", 0.999, "b", "T1", "n", "t", 90, "x", "s")]
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    frame = spark.createDataFrame(rows, ALERT)
    frame.coalesce(1).write.parquet(source)
    alerts = detect.throttled_alerts(spark.readStream.schema(frame.schema).parquet(source), 4, live=True, late_s=0)
    run = (alerts.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state)
           .trigger(processingTime="500 milliseconds").start())
    held = lambda: spark.read.format("statestore").option("path", state).option("operatorId", 0).option("stateVarName", "last").load().count()
    try:
        assert wait_for(lambda: any(p.sink.numOutputRows == 2 or p.numInputRows for p in run.recentProgress))
        time.sleep(1)
        sent = run.recentProgress
        assert wait_for(lambda: len(run.recentProgress) > len(sent) + 2 and held() == 0)
    finally:
        run.stop()
    assert sorted(r["id"] for r in spark.read.schema(frame.schema).parquet(sink).collect()) == [1, 3]


def test_fitted_models_on_a_stream_equal_the_batch(spark, sf, tmp_path):
    """Saved and loaded models: the gate sees all flows, the family model the flagged ones only."""
    raw = queries_learning._prepared(spark, sf)
    rows = prepare.stratified_split(raw, "y").filter("part = 'train'").drop("part")
    gate = train.fit_gate(train.packed(rows), 0.5, train.boosted(2))
    family = train.fit_attributor(train.packed(prepare.families(rows.filter("y = 1"))), 0.5, train.forest(3))
    sinks.save_model(gate, f"{tmp_path}/gate")
    sinks.save_model(family, f"{tmp_path}/family")
    classes = sorted(r[0] for r in prepare.families(rows.filter("y = 1")).select("family").distinct().collect())
    shown = []

    def attributor(flagged):
        shown.append((flagged.count(), flagged.filter("cnn_verdict <> 'suspicious'").count()))
        return scoring.model_attributor(sinks.load_model(f"{tmp_path}/family"))(flagged)

    flows = views.flow_rows(spark, sf).withColumn("protocol", F.col("proto").cast("double"))
    flows = flows.withColumns({c: F.col(c).cast("double") for c in fixed.FEATURES})
    dims = views.geo(spark, sf), views.scored(spark, sf), views.counted(spark, sf)
    judge = scoring.model_gate(sinks.load_model(f"{tmp_path}/gate"))
    pick = lambda r: r.select("flow_id", "cnn_verdict", "cnn_confidence", "attack_family", "technique_id", "country", "rep.source")
    limits = judge(flows).approxQuantile("probability", [0.7], 0.0)[0], 0.2
    expected = pick(enrich.enriched(scoring.classify(flows, judge, attributor, classes, *limits), *dims))
    flows.repartition(2).write.parquet(f"{tmp_path}/in")
    arriving = spark.readStream.schema(flows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    detect.run_to_sinks(arriving, f"{tmp_path}/state", {"d": (f"{tmp_path}/out", pick)},
                        stage=detect.two_stage(judge, attributor, classes, *dims, *limits)).awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    rows_of = lambda r: sorted(map(str, r.collect()))
    assert rows_of(found.select(expected.columns)) == rows_of(expected)
    assert all(wrong == 0 for _, wrong in shown) and sum(n for n, _ in shown[1:]) == shown[0][0] > 0


def test_rates_count_every_packet_once(spark, tmp_path):
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    seconds = [0, 0, 1, 3, 3, 3, 40, 41, 90]
    for part in (seconds[:6], seconds[6:]):
        arrive(spark, [packet(k, s) for k, s in enumerate(part)], source)
        rows = detect.packet_rate(readers.packet_stream(spark, source), 4, 2, "1 second")
        detect.append_batches(rows, sink, state).awaitTermination()
    found = {r["at"]: (r["packets"], r["rate"]) for r in detect.rate_flushed(spark, sink, state, 4, 2).selectExpr(
        "unix_timestamp(at) - unix_timestamp(timestamp'2024-03-01 12:00:00') as at", "packets", "rate").collect()}
    expected = {}
    for s in seconds:
        for end in (s // 2 * 2 + 2, s // 2 * 2 + 4):
            expected[end] = expected.get(end, 0) + 1
    assert found == {end: (n, n / 4) for end, n in expected.items()}
    with pytest.raises(ValueError, match="steps"):
        detect.packet_rate(table(spark, [packet(1, 0)]), 5, 2)
