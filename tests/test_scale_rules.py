"""Identities, answers, sinks and index runs that must hold at any scale and after a lost run."""
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from packetloom import schema, session
from packetloom.operators import alerts, enrich, retrieval
from packetloom.plans import views
from packetloom.sources import sinks
from packetloom.streaming import detect

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_addresses_are_unique_far_above_the_test_data(spark):
    ids = spark.range(0, 2_000_000, 7).unionByName(spark.range(230_000_000, 230_100_000)).filter("id % 10 <> 9")
    found = ids.select(views.client_ip(F.col("id")).alias("ip"))
    assert found.distinct().count() == ids.count()
    assert found.filter(~F.col("ip").rlike(r"^(13[1-9]|14\d|15\d|16[0-8])(\.\d{1,3}){3}$")).isEmpty()


def test_repeated_answers_give_one_row_for_each_packet(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    geo = spark.createDataFrame([("131.1.1.1", "Old", "a", "b", "1.0", "2.0", at(0)), ("131.1.1.1", "New", "a", "b", "3.0", "4.0", at(9)),
                                 ("131.1.1.1", "Old", "a", "b", "1.0", "2.0", at(0))],
                                "ip string, country_name string, city string, state string, latitude string, longitude string, ts timestamp")
    body = '{"data": {"abuseConfidenceScore": %d, "totalReports": 3}}'
    scores = spark.createDataFrame([("131.1.1.1", 200, body % 10, at(5)), ("131.1.1.1", 200, body % 80, at(6)), ("131.1.1.1", 429, "", at(7))],
                                   "ip string, status int, body string, ts timestamp")
    counts = spark.createDataFrame([("131.1.1.1", 503, "", at(1)), ("131.1.1.1", 200, '{"attacks": 1}', at(2))], "ip string, status int, body string, ts timestamp")
    packets = spark.createDataFrame([(k, T0, "131.1.1.1", "132.1.1.1", 1, 2, 6) for k in range(5)],
                                    "seq long, ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, proto int")
    packets = packets.unionByName(packets.limit(1).withColumns({"seq": F.lit(99).cast("long"), "proto": F.lit(1)}))
    rows = enrich.telemetry_rows(packets, enrich.geo_records(geo), enrich.scored_source(scores), enrich.count_source(counts)).collect()
    assert sorted(r.id for r in rows) == [0, 1, 2, 3, 4]
    assert {(r.country, r.lat, r.abuse_score, r.blacklisted) for r in rows} == {("New, a, b", 3.0, 80, "Yes")}


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Fake:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.work_folder(Fake())


def test_routing_keeps_microseconds_and_refuses_unknown_targets(spark, tmp_path):
    at = T0 + timedelta(microseconds=123456)
    logs = spark.createDataFrame([(1, at, "x")], schema.LOG)
    sinks.route(sinks.as_routed(logs, "logs"), {"logs": f"{tmp_path}/logs"})
    assert sinks.read_fact(spark, f"{tmp_path}/logs", schema.LOG).select(F.unix_micros("timestamp") % 1_000_000).first()[0] == 123456
    with pytest.raises(ValueError, match="metrics"):
        other = sinks.as_routed(spark.createDataFrame([(1, at, 1.0, 1.0, 1.0, 1)], schema.METRIC), "metrics")
        sinks.route(sinks.as_routed(logs, "logs").unionByName(other), {"logs": f"{tmp_path}/more"})
    assert not sinks.exists(spark, f"{tmp_path}/more")


def test_fact_reads_prune_days_and_bear_older_files(spark, tmp_path):
    days = [(k, T0 + timedelta(days=k % 5, seconds=k), "x") for k in range(200)]
    rows = spark.createDataFrame(days, schema.LOG)
    sinks.write_fact(rows, f"{tmp_path}/logs", schema.LOG)
    some = sinks.read_fact(spark, f"{tmp_path}/logs", schema.LOG + ", later string", "2024-01-02", "2024-01-03")
    assert some.count() == 80 and some.filter("later is not null").isEmpty()
    assert "PartitionFilters: [isnotnull(day" in some._jdf.queryExecution().toString()
    assert len(list((tmp_path / "logs").glob("day=*/part-*.parquet"))) <= 10


def test_an_index_run_that_died_leaves_nothing_doubled(spark, tmp_path):
    d = views.detections(spark, "/root/testdata/sf0.001")
    high = d.agg(F.max("id")).first()[0]
    index, docs = f"{tmp_path}/index", f"{tmp_path}/docs"
    retrieval.sync(d.filter(F.col("id") <= high // 2), index, docs)
    # the postings of the next run are there, its documents are not
    lost = f"{tmp_path}/lost"
    retrieval.sync(d, index, lost)
    spark.read.parquet(docs).count()
    known = retrieval.stored(spark, docs)
    state = known.agg(F.count("*").alias("n"), F.max("doc_id").alias("top")).first()
    fresh = retrieval.incident_documents(retrieval.delta(d, known)[0])
    (retrieval.postings(fresh).withColumn("sync", F.lit(f"from-{state['n']}-{state['top']}")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("sync").parquet(f"{tmp_path}/half"))
    retrieval.sync(d.filter(F.col("id") <= high // 2), f"{tmp_path}/half", f"{tmp_path}/half-docs")
    retrieval.sync(d, f"{tmp_path}/half", f"{tmp_path}/half-docs")
    found = retrieval.stored(spark, f"{tmp_path}/half")
    assert found.count() == found.select("doc_id", "term").distinct().count()
    assert found.select("doc_id").distinct().count() == retrieval.stored(spark, f"{tmp_path}/half-docs").count() == d.count()


ALERT = ("ts timestamp, id long, verdict string, confidence double, src_ip string, technique_id string, technique_name string, "
         "tactic string, abuse_score int, rep_source string, summary string")


def test_both_halves_of_a_stream_of_alerts_share_the_throttle(spark, tmp_path):
    """Row 1 is a first sight; row 2, of its source and technique and corroborated, is held back, as the batch does."""
    rows = [(0, 1, 0.5, "a", "T1", None), (100, 2, 0.999, "a", "T1", 90), (100, 3, 0.999, "b", "T1", 90), (301, 4, 0.999, "a", "T1", 90),
            (400, 5, 0.5, "c", "T2", 60), (401, 6, 0.999, "d", None, 70), (402, 7, 0.999, "d", None, 70)]
    frame = spark.createDataFrame([(T0 + timedelta(seconds=t), i, "suspicious", c, ip, tech, "n", "t", abuse, "x", "s")
                                   for t, i, c, ip, tech, abuse in rows], ALERT)
    batch = sorted((r.id, r.trigger) for r in alerts.alerts(frame).collect())
    source = f"{tmp_path}/in"
    for low, high in ((0, 4), (4, 99)):
        frame.filter((F.col("id") >= low) & (F.col("id") < high)).coalesce(1).write.mode("append").parquet(source)
        stream = detect.throttled_alerts(spark.readStream.schema(frame.schema).parquet(source))
        detect.append_batches(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    found = sorted((r.id, r.trigger) for r in spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect())
    assert found == batch == [(1, "new-technique"), (3, "corroborated"), (4, "corroborated"), (5, "new-technique"), (6, "corroborated")]


def test_no_step_of_a_chain_computes_the_steps_before_it_over_again(spark, sf, monkeypatch):
    """Each step reads its rows for the values and for the edges; written between steps, the readers do not multiply."""
    from packetloom.operators import chain, flows
    from packetloom.plans import views
    leaves, write = [], chain.cut

    def noted(rows):
        leaves.append(rows._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return write(rows)
    monkeypatch.setattr(chain, "cut", noted)
    monkeypatch.setattr(flows, "cut", noted, raising=False)
    built = flows.build_flows(views.late_packets(spark, sf), views.IDLE_S, views.ACTIVE_S, mode="tracker", group_rows=20, order="arrival")
    assert built.count() == flows.build_flows(views.late_packets(spark, sf), views.IDLE_S, views.ACTIVE_S, mode="tracker",
                                              group_rows=None, order="arrival").count()
    assert max(leaves) <= 6, leaves


def test_a_search_looks_up_only_what_can_win_and_makes_its_queries_once(spark, sf, tmp_path, monkeypatch):
    looked_up, made = [], str(tmp_path / "made")
    monkeypatch.setattr(retrieval, "is_small", lambda rows: looked_up.append(rows.count()) or True, raising=False)

    def noted(text):
        with open(made, "a") as out:
            out.write("once\n")
        return text
    docs = views.table(spark, sf, "documents").select("doc_id", "text")
    asked = views.table(spark, sf, "benchmark").filter("text is not null").select(F.col("item_id").alias("query_id"), "text").limit(1)
    asked = asked.withColumn("text", F.udf(noted, "string")("text"))
    best = retrieval.search_text(docs, asked, k=1).collect()
    assert best and open(made).read() == "once\n"
    assert looked_up and looked_up[0] < docs.count() // 4
    assert best == retrieval.search_text(docs, asked, k=500).filter("rank = 1").collect()


def test_a_stream_of_detections_makes_its_lookup_tables_once(spark, sf, monkeypatch):
    from packetloom.plans import queries_streams
    given = []
    monkeypatch.setattr(detect, "two_stage", lambda gate, attributor, classes, *tables, **kw: given.extend(tables))
    queries_streams._stage(spark, sf)
    assert len(given) == 3 and not any("customer" in f for t in given for f in t.inputFiles())
