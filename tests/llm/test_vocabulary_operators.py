"""Spelling variants, URL filters and collocations against plain rules."""
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from corpus_fixture import no_documents, odd_documents
from pyspark.sql import functions as F

from packetloom.llm import collocations, url_filter, variants

# Spelling variants


def is_near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) - len(u) == 1 and any(v[:k] + v[k + 1:] == u for k in range(len(v)))


def some_words(rng, n, letters="abé"):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(n)})


def test_composition_accepts_the_near_pairs():
    rng = random.Random(1)
    for _ in range(150):
        words = some_words(rng, rng.randint(0, 70))
        expected = {(i, j) for j in range(len(words)) for i in range(j) if is_near(words[i], words[j])}
        for prefix in (0, 1, 2):
            found = [tuple(sorted(p)) for p in variants.one_edit_pairs(words, prefix)]
            assert len(found) == len(set(found))
            assert set(found) == {(i, j) for i, j in expected if words[i][:prefix] == words[j][:prefix] and min(len(words[i]), len(words[j])) >= prefix}


def test_equal_endings_are_one_state():
    machine = variants.Acceptor()
    end = machine.state(True, [])
    assert machine.state(True, []) == end and machine.state(False, [("x", end)]) == machine.state(False, [("x", end)]) != end


def test_composition_bears_long_words():
    long = "a" * 30_000
    words = sorted([long, long[1:], long[:9] + "b" + long[10:], long + "bb"])
    assert sorted(tuple(sorted(p)) for p in variants.one_edit_pairs(words)) == sorted(
        (i, j) for j in range(4) for i in range(j) if sorted((len(words[i]), len(words[j]))) in ([29_999, 30_000], [30_000, 30_000]))


@pytest.mark.parametrize("most", [1, 3, 20, 10_000])
def test_near_pairs_however_prefixes_are_split(spark, most):
    words = some_words(random.Random(most), 250)
    table = spark.createDataFrame([(w, len(w) + 10) for w in words], "word string, n long")
    found = [tuple(r) for r in variants.near_pairs(table, most).select("word", "near", "near_n").collect()]
    assert sorted(found) == sorted((u, v, len(v) + 10) for u in words for v in words if u != v and is_near(u, v))


def plain_variants(rows, letters, occurrences, ratio):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= letters and c >= occurrences}
    short = defaultdict(set)
    for w in n:
        for k in range(len(w)):
            short[w[:k] + "*" + w[k + 1:]].add(w)
            short[w[:k] + w[k + 1:]].add(w)
        short[w].add(w)
    form, degree = {}, {}
    for w in n:
        keys = {w, *(w[:k] + "*" + w[k + 1:] for k in range(len(w))), *(w[:k] + w[k + 1:] for k in range(len(w)))}
        near = {v for k in keys for v in short[k] if v != w and is_near(v, w)}
        degree[w] = len(near)
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], degree[w], n[form[w]] if form[w] else None))
    return sorted(out)


@pytest.mark.parametrize("letters, occurrences, ratio, most", [(6, 5, 5, 10_000), (1, 1, 2, 10)])
def test_variants_equal_brute_force(spark, sf, letters, occurrences, ratio, most):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60).unionByName(
        odd_documents(spark).filter("length(text) < 60000 or text is null").select("doc_id", "text"))
    rows = [tuple(r) for r in docs.collect()]
    found = variants.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), letters, occurrences, ratio, most).collect()
    assert sorted(tuple(r) for r in found) == plain_variants(rows, letters, occurrences, ratio)
    assert any(r["form"] and r["root"] != r["form"] for r in found) or letters > 1


def test_variants_of_odd_and_empty_tables(spark):
    assert variants.spelling_variants(no_documents(spark)).collect() == []
    found = {r["word"]: r for r in variants.spelling_variants(odd_documents(spark), 1, 1, 5).collect()}
    assert found["a" * 70_000]["n"] == 1 and found["a" * 70_000]["n_near"] == 0
    assert all(w == re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in found)


# URL filters

def plain_verdict(url, sites, otherwise="allow"):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")
    fits = [(len(h + p), -k, v, h + p) for k, (v, h, p) in enumerate(sites) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[3] if fits else None, max(fits)[2] if fits else otherwise


def test_automaton_equals_expressions():
    rng = random.Random(2)
    for _ in range(100):
        rules = [url_filter.Rule("allow", "".join(rng.choice(["a", "b", "/", "*", "**", "?", "[ab]", "[a-c]", "\\*", "é"]) for _ in range(rng.randint(1, 12))))
                 for _ in range(rng.randint(1, 60))]
        urls = ["".join(rng.choice("ab/*cé") for _ in range(rng.randint(0, 14))) for _ in range(40)]
        fits = url_filter.Automaton(rules).fits([u.encode() for u in urls])
        for k, url in enumerate(urls):
            for j, rule in enumerate(rules):
                parts = re.findall(r"\*\*|\\.|\[.*?\]|.", rule.glob)
                form = "".join({"*": "[^/]*", "**": "(?s:.)*", "?": "[\x00-\x2e\x30-\x7f]"}.get(p, p if p[0] in "[\\" else re.escape(p)) for p in parts)
                assert fits[k, j] == bool(re.fullmatch(form, url)), (url, rule.glob)


def test_automaton_reads_long_urls_whole():
    rules = [url_filter.site_rule("block", "x.org", "/a"), url_filter.Rule("block", "**/end"), url_filter.Rule("block", "*a*b*")]
    fits = url_filter.Automaton(rules).fits([b".x.org/" + b"a" * 2_000_000 + b"/end", b"", b"." + b"ab" * 200_000] + [b".x.org/"] * 20)
    assert fits[:4].tolist() == [[True, True, False], [False] * 3, [False, False, True], [False] * 3]


def test_rules_are_bounded():
    with pytest.raises(ValueError):
        url_filter.Automaton([url_filter.Rule("allow", "a" * (url_filter.BITS + 1))])


URLS = [None, "", "no scheme", "://", "http://", "http://ORG", "http://org/", "https://a.Example.ORG/en/12?x=/es/", "https://example.org/es/",
        "https://example.org/es", "x://notorg/", "x://evil.com/.example.org/es/1", "http://example.org:80/es/", "http://b.com/fr/#de/", "http://com/de/é",
        "http://com/de/?", "http://com?/de/", "http://a.com/" + "x" * 100_000 + ".exe", "http://m.casino-win.example.com/en/1", "http://m.casino-win.example.com/fr/1",
        "http://q.net/a\nb", "a://b://org/", "http://b.org/\x00"]


def test_verdicts_equal_plain_rules(spark):
    rows = [(k, u, "<p>", "h", 1) for k, u in enumerate(URLS)] + [(3, "http://org/", None, None, None), (3, "http://org/", None, None, None), (None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, k int")
    found = [tuple(r)[:5] for r in url_filter.judge(pages, globs=()).collect()]
    assert found == [(r[0], *plain_verdict(r[1], url_filter.SITES)) for r in rows]
    whole = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    assert whole[18]["verdict"] == "block" and whole[18]["pattern"] == "*casino*/**" and whole[19]["verdict"] == "allow" and whole[19]["rule"] == "com/fr/"
    assert whole[17]["verdict"] == "block" and whole[17]["pattern"] == "**.exe"
    kept = url_filter.allowed(pages)
    assert kept.columns == pages.columns and kept.count() == sum(r["verdict"] == "allow" for r in url_filter.judge(pages).collect())
    assert url_filter.judge(pages.limit(0)).collect() == []


def test_longest_rule_wins_and_first_of_equals(spark):
    sites = (("block", "a.b", "/"), ("allow", "a.b", "/"), ("allow", "b", "/xx"), ("block", "b", "/x"))
    pages = spark.createDataFrame([(1, "h://a.b/"), (2, "h://a.b/xx"), (3, "h://c.b/xxx"), (4, "h://b/xy")], "page_id long, url string")
    found = [(r["rule"], r["verdict"]) for r in url_filter.judge(pages, sites=sites, globs=(), otherwise="block").collect()]
    assert found == [("a.b/", "block"), ("a.b/", "block"), ("b/xx", "allow"), ("b/x", "block")]


# Collocations

def plain_counts(rows, longest):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for at in range(len(words) - k + 1):
                    f[lang, k, " ".join(words[at:at + k])] += 1
    return f, n


def plain_collocations(rows, support, longest, top):
    f, n = plain_counts(rows, longest)
    made = {key: a for key, a in f.items() if key[1] > 1 and a >= support}
    gone = set()
    for (lang, k, phrase), a in made.items():
        w = phrase.split(" ")
        for size in range(2, k):
            for at in range(k - size + 1):
                inner = (lang, size, " ".join(w[at:at + size]))
                if 100 * a >= 80 * f[inner]:
                    gone.add(inner)
    best = defaultdict(list)
    for (lang, k, phrase), a in made.items():
        if (lang, k, phrase) not in gone:
            w = phrase.split(" ")
            cuts = []
            for j in range(1, k):
                left, r = f[lang, j, " ".join(w[:j])], f[lang, k - j, " ".join(w[j:])]
                cuts.append((2_000_000 * a // (left + r), j, left, r))
            score, _, left, r = min(cuts)
            best[lang].append((-score, -a, phrase.encode(), left, r))
    return [(lang, rank, p.decode(), -a, left, r, n[lang], -s)
            for lang, found in best.items() for rank, (s, a, p, left, r) in enumerate(sorted(found)[:top], 1)]


def odd_texts(spark):
    rng = random.Random(5)
    words = ["New", "york", "é", "\u00a0x", "a-b", "\x00", "of", "the", "the"]
    rows = [(k, "".join(rng.choice(words) + rng.choice(["  ", " ", "\t", " ", ". ", "\n", "?"]) for _ in range(rng.randint(0, 60))),
             rng.choice(["en", "en", "EN", None, ""])) for k in range(150)]
    rows += rows[:3] + [(None, "new york of the", None), (None, None, "en"), (7, "", "en"), (8, "x" * 70_000 + " x", "en"), (9, "the the " * 40_000, "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.mark.parametrize("sample, support", [(1, 5), (4, 30), (1000, 8)])
def test_frequent_phrases_are_closed_and_exact(spark, sample, support):
    """Whatever the sample holds, further passes find what it missed."""
    docs = odd_texts(spark).withColumn("k", F.lit("x")).withColumn("n", F.lit(None).cast("int"))
    f, n = plain_counts([(r["lang"], r["text"]) for r in docs.collect()], 4)
    found = {(r["lang"], r["k"], r["phrase"]): r["n"] for r in collocations.frequent_phrases(docs, support, 4, sample).collect()}
    assert {k: v for k, v in found.items() if k[1]} == {k: v for k, v in f.items() if v >= support}
    assert {k[0]: v for k, v in found.items() if not k[1] and v} == {k: v for k, v in n.items() if v}


@pytest.mark.parametrize("top, support", [(2000, 5), (3, 2)])
def test_collocations_equal_brute_force(spark, sf, top, support):
    docs = odd_texts(spark).unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").limit(40))
    expected = plain_collocations([(r["lang"], r["text"]) for r in docs.collect()], support, 4, top)
    found = [tuple(r) for r in collocations.collocations(docs, top, support).collect()]
    assert sorted(found) == sorted(expected)


def test_collocations_of_odd_and_empty_tables(spark):
    assert collocations.collocations(no_documents(spark)).collect() == []
    rows = odd_documents(spark)
    expected = plain_collocations([(r["lang"], r["text"]) for r in rows.collect()], 30, 4, 2000)
    assert sorted(tuple(r) for r in collocations.collocations(rows).collect()) == sorted(expected)


def test_scores_beyond_64_bits(spark):
    big = 2**61
    phrases = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big + 2), ("en", 1, "c", big + 1), ("en", 2, "a b", big - 1), ("en", 2, "b c", 30),
                                     ("en", 3, "a b c", 30)], "lang string, k int, phrase string, n long")
    found = {r["phrase"]: r["score"] for r in collocations.scored(phrases, 30).collect()}
    assert found == {"a b": 2_000_000 * (big - 1) // (2 * big + 2), "a b c": 2_000_000 * 30 // (2 * big)}


def test_counts_do_not_depend_on_portions(spark, monkeypatch):
    docs = odd_texts(spark)
    whole = sorted(tuple(r) for r in collocations.frequent_phrases(docs, 5).collect())
    data = {k: v for k, v in collocations._batches([pa.RecordBatch.from_pydict({"lang": ["en", "de"], "t": ["a b. " * 9, "x"]})])}
    assert data == {"en": [b"a b. " * 9], "de": [b"x"]}
    monkeypatch.setattr(collocations, "READ", 8)
    parts = [t for lang, t in collocations._batches([pa.RecordBatch.from_pydict({"lang": ["en", "de"], "t": ["a b. " * 9, "x"]})]) if lang == "en"]
    assert len(parts) > 2 and b"".join(x for t in parts for x in t) == b"a b. " * 9
    assert sorted(tuple(r) for r in collocations.frequent_phrases(docs.coalesce(1), 5).collect()) == whole
    words = collocations.Words([b"a  b. c", b"D"], "en")
    assert words.texts(np.arange(4), 1).to_pylist() == list("abcd") and words.texts(np.array([0]), 2).to_pylist() == ["a b"]
    assert words.pieces[0] == words.pieces[1] != words.pieces[2]


def test_tally_counts_hashes_that_differ_in_low_bits_only():
    rng = np.random.default_rng(1)
    for spread in (3, 1 << 40):
        found = rng.integers(0, 50, 500).astype(np.uint64) * np.uint64(spread)
        at = np.flatnonzero(rng.random(500) < 0.8)
        places, n = collocations.tally(found, at)
        assert dict(zip(found[places].tolist(), n.tolist())) == Counter(found[at].tolist()) and (np.diff(places) > 0).all()
    assert len(collocations.tally(found, at[:0])[0]) == 0
