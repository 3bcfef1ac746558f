"""Splits, shapes and searches whose groups are hot: equal to brute force, with the work of a task bounded."""
import math
import random

import pytest
from pyspark.sql import functions as F

from packetloom import fixed
from packetloom.functions import text
from packetloom.operators import prepare, retrieval
from packetloom.session import cut


@pytest.mark.parametrize("bucket_rows", [1, 40, 10 ** 6])
def test_cutoffs_equal_a_sort_at_every_depth(spark, bucket_rows):
    rows = spark.range(5_000).select(F.when(F.col("id") < 4_000, 0).otherwise(F.col("id") % 3 + 1).alias("grp"), F.col("id").alias("row_id"))
    slim = prepare.in_order(rows, F.col("grp"), "row_id", 7)
    wanted = spark.createDataFrame([(g, m, k) for g in range(4) for m, k in (("a", 1), ("b", 300), ("c", 0), ("d", 10 ** 9))], "g int, mark string, k long")
    ordered = {}
    for r in slim.collect():
        ordered.setdefault(r["g"], []).append((r["h"], r["id"]))
    expected = {(g, m, sorted(ordered[g])[k - 1]) for g in ordered for m, k in (("a", 1), ("b", 300)) if k <= len(ordered[g])}
    found = prepare.cutoffs(slim, wanted, bucket_rows).collect()
    assert {(r["g"], r["mark"], tuple(r["cut"])) for r in found} == expected and len(found) == len(expected)


def test_a_hot_shape_is_joined_apart(spark):
    rnd = random.Random(3)
    data = [(*[float(k % 3 if k > 900 else 1) for _ in fixed.FEATURES], int(k % 10 == 0), k) for k in range(1_500)]
    data += [(*[float(rnd.randrange(50)) for _ in fixed.FEATURES], 0, k) for k in range(1_500, 1_800)]
    rows = spark.createDataFrame(data, ", ".join([*[f"{c} double" for c in fixed.FEATURES], "y int", "row_id long"]))
    seen = {}
    for r in data:
        if r[-2] == 0:
            seen[r[:-2]] = seen.get(r[:-2], 0) + 1
    expected = {r[-1]: float(seen[r[:-2]] if r[-2] == 0 else 1) for r in data}
    for heavy in (100, 10 ** 6):
        found = prepare.multiplicity(rows, heavy)
        assert found.columns == [*rows.columns, "mult"]
        assert {r["row_id"]: r["mult"] for r in found.collect()} == expected and found.count() == len(data)


def test_pruned_search_equals_scoring_everything(spark):
    """A word in all documents, rare words, repeated words, equal documents, more hits wanted than there are."""
    rnd = random.Random(5)
    common, rare = ["flow", "suspicious", "network"], [f"rare{k}x" for k in range(60)]
    texts = {k: " ".join(rnd.choices(common, k=rnd.randrange(1, 9)) + rnd.choices(rare, k=rnd.randrange(0, 3))) for k in range(600)}
    texts |= {600 + k: "flow rare1x" for k in range(9)} | {700: ""}
    asked = {1: "flow suspicious rare1x", 2: "flow network", 3: "rare5x rare5x rare7x flow flow", 4: "unknownword", 5: "suspicious rare9x network rare11x", 6: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    queries = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    words = {r["doc_id"]: r["t"] for r in docs.select("doc_id", text.tokens(F.col("text")).alias("t")).collect()}
    mean = sum(map(len, words.values())) / len(words)
    df = {}
    for t in words.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    asked_words = {r["query_id"]: r["t"] for r in queries.select("query_id", text.tokens(F.col("text")).alias("t")).collect()}
    for k in (1, 5, 50):
        expected = set()
        for q, terms in asked_words.items():
            scores = []
            for d, t in words.items():
                s = 0
                for w in set(terms) & set(t):
                    tf, n = t.count(w), len(words)
                    idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                    weight = tf * (fixed.BM25_K1 + 1) / (tf + fixed.BM25_K1 * (1 - fixed.BM25_B + fixed.BM25_B * len(t) / mean))
                    s += math.floor(idf * weight * terms.count(w) * retrieval.UNITS)
                if s > 0:
                    scores.append((-s, d))
            expected |= {(q, d, rank) for rank, (_, d) in enumerate(sorted(scores)[:k], 1)}
        found = retrieval.search_text(docs, queries, k).collect()
        assert {(r["query_id"], r["doc_id"], r["rank"]) for r in found} == expected
    weighted, strong, weak = retrieval.plan(cut(retrieval.postings(docs)), retrieval.document_table(docs), queries, 5)
    every = weighted.join(retrieval.query_terms(queries), "term").count()
    scored = weighted.join(strong, "term").count()
    assert scored < every / 2 and not weak.isEmpty()


def test_copies_of_many_words_are_not_broadcast(spark, tmp_path):
    """A small written table of words grows 32-fold when it is salted; its size on disk does not say so."""
    spark.range(3_000).select(F.concat(F.lit("w"), "id").alias("term"), F.lit(1.0).alias("idf")).write.parquet(f"{tmp_path}/words")
    spark.range(9_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 4_000).alias("term")).write.parquet(f"{tmp_path}/index")
    index, side = spark.read.parquet(f"{tmp_path}/index"), spark.read.parquet(f"{tmp_path}/words")
    joined = retrieval._join_terms(index, side, 10)
    assert joined.count() == index.join(side, "term").count()
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


def test_postings_count_within_the_row(spark):
    """Words of a text are counted without a shuffle of words; rows that share an id are put together as before."""
    rows = [(1, "scan b scan a b scan"), (2, ""), (3, None), (4, "a"), (5, "x y"), (5, "y z"), (None, "q q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["term"], r["tf"], r["length"]) for r in retrieval.postings(docs).collect()}
    words = retrieval.tokenized(docs).select("doc_id", "length", F.explode("tokens").alias("term"))
    by_shuffle = words.groupBy("doc_id", "length", "term").count().collect()
    assert found == {(r["doc_id"], r["term"], r["count"], r["length"]) for r in by_shuffle}
    plain = retrieval.postings(docs.filter("doc_id < 5"))
    assert plain.count() == retrieval.postings(docs).filter("doc_id < 5").count()
    assert "Exchange" not in plain._jdf.queryExecution().executedPlan().toString()
