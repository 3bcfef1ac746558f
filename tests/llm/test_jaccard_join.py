import random
from itertools import combinations

import numpy as np
import pytest
from corpus_fixture import brute_groups, edited, no_documents, odd_documents, plain_words

from packetloom.llm import jaccard_join as J
from packetloom.llm.common import shingle_sets, word_hashes
from packetloom.llm.graph import components
from packetloom.session import _scratch, cut


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: [(x is not None, x) for x in r])


@pytest.mark.parametrize("width, num", [(3, 90), (5, 80), (1, 50)])
def test_groups_equal_brute_force(spark, sf, width, num):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    expected = brute_groups([tuple(r) for r in docs.collect()], width, num, 100)
    assert order(J.jaccard_groups(docs, width, num, 100).collect()) == order(expected)


def test_groups_of_many_sizes(spark, monkeypatch):
    """Small and large sets, subsets and lists, components in one block and in many, a hot passage, thousands of copies."""
    monkeypatch.setattr(J, "BLOCK", 3000)
    monkeypatch.setattr(J, "LARGE", 300)
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for n in (*range(3, 48), 80, 150, 320, 700, 1500):
        base = [rng.choice(vocabulary) for _ in range(n)]
        texts += [base, base[:-1], base + ["end"], [*base[:n // 2], "x", *base[n // 2 + 1:]], edited(rng, base, 0.02)]
    crowd = [rng.choice(vocabulary) for _ in range(120)]
    texts += [edited(rng, crowd, 0.02) for _ in range(60)] + [passage + [rng.choice(vocabulary) for _ in range(40)] for _ in range(40)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(1000 + k, " ".join(crowd)) for k in range(300)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert order(J.jaccard_groups(docs, 3, 90, 100).collect()) == order(brute_groups(rows, 3, 90, 100))


def tied_texts(rng):
    """60 unlinked texts of 200 words, each with a near copy, that share a passage with the next one; and 30 that grow by 4 %, each linked with the next."""
    passages = [[f"p{rng.randrange(10**6)}" for _ in range(40)] for _ in range(61)]
    bases = [[*passages[k], *[f"w{rng.randrange(10**6)}" for _ in range(120)], *passages[k + 1]] for k in range(60)]
    texts = [t for b in bases for t in (b, [*b[:100], "x", *b[101:]])]
    growing = passages[0] + [f"g{k}" for k in range(60)]
    for k in range(30):
        texts.append(growing)
        growing = growing + [f"h{k}_{m}" for m in range(len(growing) // 25)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sketched", [1000, 8_000_000])
def test_texts_tied_by_chance_do_not_all_meet(spark, monkeypatch, sketched):
    """The texts of a component that lists alone tie are not copied for its every two blocks."""
    monkeypatch.setattr(J, "BLOCK", 2000)
    monkeypatch.setattr(J, "SKETCHED", sketched, raising=False)
    seen = []
    monkeypatch.setattr(J, "cut", lambda df: (out := cut(df), "blocks" in df.columns and seen.extend(r["blocks"] for r in out.collect()))[0])
    rows = tied_texts(random.Random(8))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert order(J.jaccard_groups(docs, 3, 90, 100).collect()) == order(brute_groups(rows, 3, 90, 100))
    assert len(seen) == 150 and seen.count(1) == 120


def test_written_tables_go_once_they_are_used(spark):
    docs = spark.createDataFrame(tied_texts(random.Random(9)), "doc_id long, text string")
    held = _scratch.setdefault(spark.sparkContext.applicationId, [])
    before = len(held)
    assert J.one_of_each(docs, 3, 90, 100).count() == 61
    assert len(held) - before <= 5


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert order(J.jaccard_groups(docs).collect()) == order(brute_groups(rows, 3, 90, 100))
    assert J.jaccard_groups(no_documents(spark)).collect() == []


def near_texts(rng):
    """Four unlinked texts of 80 words, each with a near copy."""
    bases = [[f"w{rng.randrange(500)}" for _ in range(80)] for _ in range(4)]
    return [(" ".join(b), " ".join([*b[:-1], "end"])) for b in bases]


def test_links_of_null_and_repeated_ids(spark):
    """Near copies whose ids are all null; one id on two different texts, each with a near copy; and the same rows again."""
    (a, a2), (b, b2), (c, c2), (d, d2) = near_texts(random.Random(5))
    rows = [(None, a), (None, a2), (7, b), (8, b2), (7, c), (9, c2), (None, d), (3, d2), (None, None), (7, "")]
    for own in (rows, rows + rows[:5]):
        docs = spark.createDataFrame(own, "doc_id long, text string")
        found = order(J.jaccard_groups(docs, 3, 90, 100).select("doc_id", "n_shingles", "n_links").collect())
        assert found == order((i, n, k) for i, n, _, k in brute_groups(own, 3, 90, 100))
        assert order(J.jaccard_groups(docs, 3, 90, 100).collect()) == order(brute_groups(own, 3, 90, 100))


def test_one_of_each_keeps_a_row_of_each_group(spark):
    docs = odd_documents(spark).filter("doc_id is not null")
    kept = J.one_of_each(docs, 5, 80, 100)
    assert kept.columns == docs.columns
    groups = J.jaccard_groups(docs, 5, 80, 100).collect()
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r["component_id"] for r in groups})
    assert J.one_of_each(no_documents(spark)).collect() == []


def test_one_of_each_with_null_and_repeated_ids(spark):
    (a, a2), (b, b2), (c, c2), (d, d2) = near_texts(random.Random(6))
    rows = [(1, a), (1, b), (None, c), (None, c2), (None, c), (4, d), (4, c + " x " + a), (2, b2), (0, d2), (None, a2), (5, None), (5, None), (None, ""), (None, "")]
    kept = [tuple(r) for r in J.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 100).collect()]
    of_c = [r for r in kept if r[1] in (c, c2)]
    assert len(of_c) == 1
    assert order(r for r in kept if r not in of_c) == order([(1, a), (1, b), (4, c + " x " + a), (0, d2), (5, None), (None, "")])


def test_word_hashes_follow_the_words():
    texts = ["a b  c", None, "", "A B", "b a", " x\x0by\x0cz ", "é É", "ab ba", "word " * 900_000, "q" * 3_000_000 + " end"]
    found = word_hashes(texts)
    assert [len(x) for x in found] == [len(plain_words(t)) for t in texts]
    meaning = {}
    for text, hashes in zip(texts, found):
        for word, value in zip(plain_words(text), hashes.tolist()):
            assert meaning.setdefault(word, value) == value
    assert len(set(meaning.values())) == len(meaning)


def test_shingles_are_sorted_and_distinct():
    for found, n in zip(shingle_sets(["a b c a b c a", "a", "a b", "b a", None], 3), (3, 1, 1, 1, 0)):
        assert len(found) == n and (np.diff(found.astype(object)) > 0).all()


@pytest.mark.parametrize("num", [50, 80, 90, 100])
def test_threshold_numbers(num):
    at = J.Threshold(num, 100)
    for a, b in combinations(range(1, 60), 2):
        linked = [o for o in range(min(a, b) + 1) if 100 * o >= num * (a + b - o)]
        assert at.overlap(a, b) == (linked[0] if linked else at.overlap(a, b))
        assert bool(linked) == (at.overlap(a, b) <= min(a, b))
        if linked:
            assert at.overlap(a, b) in at.subset_sizes(a, 100) and at.overlap(a, b) >= at.least(max(a, b))


def test_boundary_weighs_costs():
    at = J.Threshold(90, 100)
    assert J.boundary({5: 10}, at) >= 5
    assert J.boundary({39: 1000}, at) < 39


@pytest.mark.parametrize("num, share, marked", [(90, 0.21, True), (80, 0.41, True), (80, 0.41, False), (50, 1.0, True)])
def test_linked_sets_share_a_posting(num, share, marked):
    """Whatever is counted as single or frequent; single shingles are left out."""
    from collections import Counter
    rng = np.random.default_rng(num)
    at = J.Threshold(num, 100)
    assert at.counted == pytest.approx(min(1, share))
    common = rng.integers(0, 2**63, 30, np.uint64) * np.uint64(2)
    sets = []
    for _ in range(120):
        base = np.unique(np.concatenate((rng.integers(0, 2**63, rng.integers(5, 120), np.uint64) * np.uint64(2), common[rng.random(30) < 0.5])))
        sets += [base, base[rng.random(len(base)) < 0.97], np.unique(np.append(base, rng.integers(0, 2**63, 3, np.uint64)))]
    rows = Counter(x for s in sets for x in s.tolist())
    marks = np.zeros(J.MARKS // 8, np.uint8)
    for x, n in rows.items():
        if n > 1 or not marked:
            marks[(x & (J.MARKS - 1)) >> 3] |= 1 << (x & 7)
    tokens = np.array(sorted(x for x, n in rows.items() if n > 20), np.uint64)
    limit = min(2**64 - 1, int(at.counted * 2**64))
    tokens = tokens[tokens < np.uint64(limit)]
    order = J.Order(limit, marks, tokens, np.argsort(np.array([rows[x] for x in tokens.tolist()])))
    posted = [set(order.postings(s, at.prefix(len(s))).tolist()) for s in sets]
    for x, y in combinations(range(len(sets)), 2):
        a, b = set(sets[x].tolist()), set(sets[y].tolist())
        if 100 * len(a & b) >= num * len(a | b):
            assert posted[x] & posted[y]


def test_components_of_a_long_path(spark):
    path = [(k, k + 1) for k in range(0, 300)] + [(1000, 1001), (1001, 1001), (1001, 1000), (None, 5)]
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(301)}, 1000: 1000, 1001: 1000}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
