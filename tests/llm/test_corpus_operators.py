"""Mixing, decontamination, sharding, scoring and the pipeline."""
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from corpus_fixture import brute_groups, no_documents, odd_documents, plain_words
from pyspark.sql import functions as F

import corpus_pipeline
from packetloom.llm import decontaminate, mixing, ppm, queries, ranks, sharding

TABLES = "documents benchmark labels pages".split()


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(str(round(r[k], 9) if isinstance(r[k], float) else r[k]) for k in order) for r in rows))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rows = queries.QUERIES[name](spark, sf)
    found = con.execute(queries.SQL[name])
    columns, expected = [d[0] for d in found.description], found.fetchall()
    assert expected and sorted(columns) == sorted(rows.columns)
    assert bag(rows.columns, rows.collect()) == bag(columns, expected)


def test_there_is_one_query_for_each_operator():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in sorted(queries.QUERIES, key=lambda n: int(re.match(r"op(\d+)_", n)[1]))] == list(range(1, 14))


@pytest.mark.parametrize("name", [n for n in sorted(queries.QUERIES)])
def test_queries_bear_odd_and_empty_tables(spark, tmp_path, name):
    """One row for each document of odd tables (pairs for op6, pages for op12, words and phrases for op11 and op13), none for empty ones."""
    labels = spark.createDataFrame([(10, 1, 0), (11, 0, None), (None, 1, 1), (10, 1, 0)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(1, None), (2, ""), (2, "http://a.org/x"), (None, "no url")], "page_id long, url string")
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (None, "a b c d e f g h")], "item_id long, text string")
    for where, docs, n in (("odd", odd_documents(spark), odd_documents(spark).count()), ("none", no_documents(spark), 0)):
        docs.write.parquet(f"{tmp_path}/{where}/documents.parquet")
        (labels if n else labels.limit(0)).write.parquet(f"{tmp_path}/{where}/labels.parquet")
        (bench if n else bench.limit(0)).write.parquet(f"{tmp_path}/{where}/benchmark.parquet")
        (pages if n else pages.limit(0)).write.parquet(f"{tmp_path}/{where}/pages.parquet")
        rows = queries.QUERIES[name](spark, f"{tmp_path}/{where}").collect()
        if name.startswith("op6"):
            assert rows == []
        elif name.startswith("op9"):
            assert sum(r["section"] == 0 for r in rows) == n
        elif name.startswith("op2"):
            assert sorted(r["position"] for r in rows) == list(range(len(rows))) and (n or not rows)
        elif name.startswith("op12"):
            assert len(rows) == (4 if n else 0)
        elif name.startswith(("op11", "op13")):
            assert len(rows) == len(set(rows)) and bool(rows) == bool(n)
        else:
            assert len(rows) == n


# Mixing

def test_mixing_meets_its_rates(spark):
    docs = spark.range(30000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 20000, "big").when(F.col("id") < 29900, "mid").alias("source"))
    weights = spark.createDataFrame([("big", 1.0), ("mid", 1.0), (None, 2.0)], "source string, weight double")
    rated = {r["mix_key"]: r for r in mixing.rates(docs, weights=weights, total=40000).collect()}
    assert rated["=big"]["rate"] == pytest.approx(0.5) and rated["null"]["rate"] == pytest.approx(200) and rated["null"]["parts"] == 4
    n = {r["source"]: r["count"] for r in mixing.mixed_rows(docs, weights=weights, total=40000).groupBy("source").count().collect()}
    for source, wanted in (("big", 10000), ("mid", 10000), (None, 20000)):
        assert abs(n[source] - wanted) < 5 * math.sqrt(wanted)


def test_mixing_inverts_the_poisson_distribution(spark):
    """Against a plain inversion of the same draws, for small and large means."""
    from hashlib import md5
    docs = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("source"))
    weights = spark.createDataFrame([("0", 1.0), ("1", 20.0), ("2", 300.0)], "source string, weight double")
    rated = mixing.rates(docs, weights=weights, total=32100)
    n = {r["doc_id"]: r["n"] for r in mixing.replicated(docs, rated).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    means = {r["mix_key"]: (r["rate"] / r["parts"], r["parts"]) for r in rated.collect()}
    for doc_id in range(300):
        mean, parts = means[f"={doc_id % 3}"]
        wanted = 0
        for part in range(1, parts + 1):
            u = int(md5(f"{mixing.SEED}:{doc_id}:{part}".encode()).hexdigest()[:13], 16) / 2**52
            k, p, c = 0, math.exp(-mean), math.exp(-mean)
            while c <= u and k < 500:
                k += 1
                p *= mean / k
                c += p
            wanted += k
        assert n.get(doc_id, 0) == wanted


def test_mixing_keeps_columns_and_copies_equal_ids_alike(spark):
    docs = odd_documents(spark)
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    by_id = Counter(r["doc_id"] for r in mixed.select("doc_id").collect())
    assert by_id[10] % 3 == 0


def test_ranks_are_gapless_whatever_the_buckets(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKET", 7)
    rows = spark.range(500).select("id", (F.col("id") % 3).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(50)) / 50).alias("draw"))
    for groups in ([], ["g"]):
        found = ranks.gapless(rows, "draw", groups, ["id"], "place").collect()
        by = defaultdict(list)
        for r in found:
            by[tuple(r[g] for g in groups)].append((r["place"], r["draw"], r["id"]))
        for own in by.values():
            own.sort()
            assert [x[0] for x in own] == list(range(len(own))) and [x[1:] for x in own] == sorted(x[1:] for x in own)


def test_rows_without_an_id_are_drawn_by_their_text(spark):
    """A source without ids meets its weight, and whole texts arrive."""
    rows = [(None, f"text {k}", "a") for k in range(4000)] + [(k, f"t {k}", "b") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "source string, weight double")
    n = {r["source"]: r["count"] for r in mixing.mixed_rows(docs, weights=weights, total=8000).groupBy("source").count().collect()}
    assert abs(n["a"] - 2000) < 5 * math.sqrt(2000) and abs(n["b"] - 6000) < 5 * math.sqrt(6000)
    plan = mixing.mix_plan(docs).collect()
    sums = {(r["text"].encode()): zlib.crc32(r["text"].encode()) for r in docs.collect()}
    assert {(r["size"], r["text_crc32"]) for r in plan} <= {(len(t), c) for t, c in sums.items()}
    assert sorted(r["position"] for r in plan) == list(range(len(plan)))


# Decontamination

def test_changed_numbers_and_names_are_caught_and_inconsistent_ones_are_not(spark):
    item = "If Anna has 12 apples and gives 5 apples to Bob then how many apples does Anna have when Bob eats 3 kg of them"
    texts = {
        1: "noise before. " + item + " noise after",
        2: "x y " + item.replace("Anna", "Maria").replace("12", "40").replace("Bob", "Otto").replace(" 5 ", " 9 ").replace("kg", "lbs"),
        3: item.replace("Anna", "Maria", 1),
        4: "If Anna has 12 apples and then something else happens that is not in the item at all, with many other words",
        5: None, 6: "", 7: "apples " * 50}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(9, item), (8, "short one"), (7, None)], "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontaminate.leaks(docs, bench).collect()}
    assert set(rows) == {1, 2} and not rows[1]["changed"] and rows[2]["changed"]
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench).collect()) == [3, 4, 5, 6, 7]


def test_items_without_plain_words_are_matched_as_they_are(spark):
    docs = spark.createDataFrame([(1, "see 1 2 3 4 5 6 7 8 there"), (2, "see 9 2 7 4 1 6 3 8 there")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "1 2 3 4 5 6 7 8")], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.leaks(docs, bench).collect()] == [1]


def test_items_are_found_whatever_their_capitals(spark):
    item = "Yesterday Anna bought 12 red apples at the small market near Berlin and gave Bob five of them before noon"
    texts = {1: "noise " + item.upper().replace(" ", " !! ") + " noise", 2: item.lower(), 3: item.title() + " and more", 4: item.replace("Anna", "Maria"),
             5: item.upper().replace("12", "30"), 6: "ANNA BOUGHT NOTHING AT THE SMALL MARKET NEAR BERLIN YESTERDAY AND GAVE BOB NO APPLES"}
    docs = spark.createDataFrame([*texts.items(), (None, item.upper())], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item), (8, "ONE TWO THREE FOUR FIVE SIX")], "item_id long, text string")
    rows = {r["doc_id"]: (r["item_id"], r["changed"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert rows == {1: (9, False), 2: (9, False), 3: (9, False), 4: (9, True), 5: (9, True), None: (9, False)}
    assert [r["doc_id"] for r in decontaminate.clean(docs, bench).collect()] == [6]
    bench = spark.createDataFrame([(7, "Alice Bob Carol Dave Eve Frank")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so alice bob carol dave eve frank came"), (2, "Xa Xb Xc Xd Xe Xf")], "doc_id long, text string")
    assert [r["doc_id"] for r in decontaminate.leaks(docs, bench).collect()] == [1]


def some_words(seed, n):
    rng = random.Random(seed)
    return [rng.choice("stra mor tel qui ban lo ver nam".split()) + rng.choice("na ko rin del us tam".split()) + rng.choice("a e i o".split()) for _ in range(n)]


def test_rows_that_share_an_id_or_have_none_are_told_apart(spark):
    item, other = " ".join(some_words(1, 40)), " ".join(some_words(2, 300))
    rows = [(1, item), (1, other), (1, item), (None, f"x {item} y"), (None, other), (None, None), (2, other + " " + item)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, leak_key string")
    bench = spark.createDataFrame([(9, item), (9, item), (None, other), (7, None)], "item_id long, text string")
    found = decontaminate.leaks(docs, bench).collect()
    assert sorted((str(r["doc_id"]), r["item_id"], r["windows"], r["matched"], r["changed"]) for r in found) == [
        ("1", 9, 36, 36, False), ("2", 9, 36, 36, False), ("None", 9, 36, 36, False)]
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) + (r["text"] or "-")[:1] for r in kept.collect()) == sorted(["1" + other[0], "None" + other[0], "None-"])


def test_long_quotes_and_short_items(spark):
    """45 of 59 words in a row are a quote, 45 in three parts are too few; items of three and four words must stand whole."""
    words = some_words(3, 59)
    texts = {1: words[:45], 2: words[14:], 3: words[:15] + ["x"] + words[20:35] + ["y"] + words[40:55], 4: words[:20], 5: words[:30] + ["x"] + words[30:],
             6: "we said Two green Ducks swim, often".split(), 7: "two green ducks, they swim".split(), 8: ["oh", "my", "goodness"]}
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(words)), (8, "two green ducks swim"), (7, "Oh my... goodness"), (6, "we said")], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()) == [(1, 9), (2, 9), (5, 9), (6, 8), (8, 7)]


def test_candidates_lose_no_pair(spark):
    """Probing the rarest windows finds what comparing all windows finds, also where items share most of theirs."""
    rng = random.Random(4)
    shared = some_words(5, 30)
    items = [shared + some_words(k, 20) for k in range(6)] + [some_words(k, 30) for k in range(10, 14)]
    docs = []
    for k in range(60):
        w = list(rng.choice(items))
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = "new"
        a, b = sorted(rng.sample(range(len(w) + 1), 2)) if k % 2 else (0, len(w))
        docs.append(some_words(100 + k, 5) + w[a:b])
    docs += [shared] * 5
    rows = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")

    def windows(w):
        return [tuple(w[k:k + 5]) for k in range(len(w) - 4)]

    expected = set()
    for k, doc in enumerate(docs):
        there = set(windows(doc))
        at = {i - j for i, x in enumerate(windows(doc)) for j, _ in enumerate(items[0])}
        for j, item in enumerate(items):
            own = windows(item)
            run = max((sum(1 for _ in g) for shift in at for hit, g in itertools.groupby(
                0 <= p + shift < len(doc) - 4 and tuple(doc[p + shift:p + shift + 5]) == x for p, x in enumerate(own)) if hit), default=0)
            if sum(x in there for x in own) >= 0.8 * len(own) or run >= max(len(own) / 2, 16):
                expected.add((k, j))
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(rows, bench).collect()} == expected and len(expected) > 30


def test_documents_without_items_stay(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    items = [(r["item_id"], plain_words(r["text"])) for r in bench.collect()]
    for r in docs.collect():
        text = " " + " ".join(plain_words(r["text"])) + " "
        for item_id, words in items:
            if f" {' '.join(words)} " in text:
                assert (r["doc_id"], item_id) in found
    assert len(found) < 0.1 * docs.count()


# Sharding

def test_placements(spark):
    docs = odd_documents(spark).unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), allowMissingColumns=True)
    rows = sharding.placements(docs).collect()
    texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
    assert {r["law"] for r in rows} == {"key"} and {r["shard"] for r in rows} == set(range(16))
    assert all(r["grown_shard"] in (r["shard"], 16) for r in rows)
    assert 0.02 < sum(r["grown_shard"] == 16 for r in rows) / len(rows) < 0.12
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert max(map(len, by.values())) < 1.6 * len(rows) / 16


def test_movement_stays_in_the_subtree_whose_weight_changed(spark):
    keys = spark.range(20000).select(F.col("id").alias("k"))
    before = sharding.tree()
    after = sharding.reweighted(before, 6, 3.0)
    rows = keys.select(sharding.descend(F.col("k"), before).alias("a"), sharding.descend(F.col("k"), after).alias("b")).collect()
    moved = [(r["a"], r["b"]) for r in rows if r["a"] != r["b"]]
    # shard 6 is in rack 1 of region 0: rows come into region 0, or into rack 1, or into shard 6
    assert moved and all(b // 8 == 0 and (a // 8 == 1 or b // 4 == 1) and (a // 4 != 1 or b == 6) for a, b in moved)
    assert abs(sum(r["b"] == 6 for r in rows) / len(rows) - 3 / 18) < 0.02
    gone = keys.select(sharding.descend(F.col("k"), sharding.reweighted(before, 6, 0.0)).alias("b"))
    assert gone.filter("b = 6 or b is null").isEmpty()


def test_write_shards(spark, tmp_path):
    docs = odd_documents(spark)
    sharding.write_shards(docs, f"{tmp_path}/out")
    again = spark.read.parquet(f"{tmp_path}/out")
    assert again.count() == docs.count()
    assert sharding.assigned(docs).columns == [*docs.columns, "_shard"]


# Scoring

class PlainTrie:
    """Prediction by partial matching, symbol by symbol, with dictionaries."""

    def __init__(self, texts):
        self.counts = defaultdict(Counter)
        for t in texts:
            data = self.padded(t)
            for at in range(ppm.ORDER, len(data)):
                for k in range(ppm.ORDER + 1):
                    self.counts[data[at - k:at]][data[at]] += 1

    @staticmethod
    def padded(text):
        data = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode()
        return b"\xff" * ppm.ORDER + data + b"\xff"

    def log10(self, text):
        data, total = self.padded(text), 0.0
        for at in range(ppm.ORDER, len(data)):
            hidden = set()
            for k in range(ppm.ORDER, -1, -1):
                seen = {s: n for s, n in self.counts.get(data[at - k:at], {}).items() if s not in hidden}
                if not seen:
                    continue
                whole = sum(seen.values()) + len(seen)
                if data[at] in seen:
                    total += math.log10(seen[data[at]] / whole)
                    break
                total += math.log10(len(seen) / whole)
                hidden |= set(seen)
            else:
                total -= math.log10(256 - len(hidden))
        return total


def test_scores_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").filter("length(text) < 3000").limit(60)
    docs = docs.unionByName(odd_documents(spark).select("doc_id", "text").filter("coalesce(length(text), 0) < 3000"))
    rows = [tuple(r) for r in docs.collect()]
    held = [doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2 for doc_id, _ in rows]
    trie = PlainTrie([t for (_, t), h in zip(rows, held) if not h])
    words = Counter(w for (_, t), h in zip(rows, held) if not h for w in [*plain_words(t), None])
    total, kinds = words.total(), len(words)
    expected = []
    for (doc_id, t), h in zip(rows, held):
        own = [*plain_words(t), None]
        base = sum(math.log10((words[w] + 1) / (total + 1 * (kinds + 1))) for w in own)
        expected.append((doc_id, h, len(own), sum(words[w] > 0 for w in own), total, round(base, 6), round(trie.log10(t), 6)))
    for common in (ppm.COMMON_WORDS, 5):
        ppm.COMMON_WORDS, usual = common, ppm.COMMON_WORDS
        try:
            found = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6))
                     for r in ppm.score_texts(docs).collect()]
        finally:
            ppm.COMMON_WORDS = usual
        assert sorted(found, key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("nodes", [1 << 20, 3000, 100])
def test_scores_keep_grams_that_are_rare_in_a_large_corpus(spark, monkeypatch, nodes):
    """Over 2^20 counts, so that a gram seen once has less than a 2^-20 share; few or nearly no grams sent to the tasks."""
    monkeypatch.setattr(ppm, "NODES", nodes)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").filter("length(text) < 1000").limit(40)
    rows = [tuple(r) for r in docs.collect()] + [(10**6 + k, "lorem ipsum " * 40_000) for k in range(3)] + [(None, None), (None, "xq zj wvk")]
    rows += [rows[0], rows[0]]
    held = [doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2 for doc_id, _ in rows]
    trie = PlainTrie([t for (_, t), h in zip(rows, held) if not h])
    assert any(held) and trie.counts[b""].total() > 1 << 20
    short = [r for r in rows if len(r[1] or "") < 1000]
    found = ppm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).filter("n_tokens < 1000").collect()
    assert sorted(((r["doc_id"], round(r["score"], 6)) for r in found), key=str) == sorted(((i, round(trie.log10(t), 6)) for i, t in short), key=str)


def test_probabilities_sum_to_one():
    """Over all next bytes, for contexts that are known, partly known and unknown; also of a pruned trie."""
    found, _ = ppm.grams(["the cat sat on the mat", "the cap", "a bat at a mat", None])
    for least in (1, 2):
        levels = []
        for k in range(ppm.ORDER + 1):
            keys, n = np.unique(found & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True)
            levels.append((keys[n >= least], n[n >= least]))
        predictor = ppm.Predictor(levels)
        for context in (b"the ", b"xhe ", b"zzzz", b"\xff\xff\xff\xff", b" at "):
            base = int.from_bytes(context, "big") << 8
            p = 10 ** predictor.log10(np.array([base + s for s in range(256)], np.uint64))
            assert p.sum() == pytest.approx(1)


def test_scores_where_nothing_teaches(spark):
    held = [k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2]
    docs = spark.createDataFrame([(k, "some text") for k in held], "doc_id long, text string")
    rows = ppm.score_texts(docs).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["n_tokens"] == 3 and r["base_score"] == 0 for r in rows)
    assert rows[0]["score"] == pytest.approx(-10 * math.log10(256))


# The pipeline

def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, docs
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, sf)
        assert out.columns == (columns if k < len(corpus_pipeline.STAGES) - 1 else [*columns, "shard"])
        out.write.parquet(f"{tmp_path}/{k}")
        before, kept = kept, spark.read.parquet(f"{tmp_path}/{k}")
        if name == "ngram_jaccard_join":
            groups = brute_groups([(r["doc_id"], r["text"]) for r in before.filter("n_chars < 4000").collect()], 5, 80, 100)
            stay = {r["doc_id"] for r in kept.filter("n_chars < 4000").collect()}
            assert stay <= {g[2] for g in groups} and len(stay) >= 0.98 * len({g[2] for g in groups})
        if name in ("language_id", "ngram_jaccard_join", "benchmark_decontamination"):
            assert kept.count() > 0.85 * before.count()
    again = corpus_pipeline.run(spark, sf)
    assert bag(again.columns, again.collect()) == bag(kept.columns, kept.collect())


def test_pipeline_bears_odd_and_empty_tables(spark, tmp_path):
    bench = spark.createDataFrame([(1, None), (2, "short")], "item_id long, text string")
    for where, docs in (("odd", odd_documents(spark)), ("none", no_documents(spark))):
        docs.write.parquet(f"{tmp_path}/{where}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{where}/benchmark.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{where}")
        assert rows.columns == [*docs.columns, "_shard"]
        assert (rows.count() == 0) == (where == "none")
