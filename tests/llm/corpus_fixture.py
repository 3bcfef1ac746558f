"""Documents that show every odd case, and plain rules to hold the operators against."""
import random
import re

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, shard string, mix int, judged string, h long, t string"


def odd_documents(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows, ties, and columns with clashing names."""
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "stra mor tel qui ban lo".split() for b in "na ko rin del us".split()]
    prose = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(8)]
    long_text = "\n".join(" ".join(rng.choice(words) + str(k % 7) for _ in range(11)) for k in range(6000))
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "Two words", "é ß 漢字 \U0001f600", "12345 678", "a" * 70_000, long_text, *prose,
             prose[0], prose[0].upper(), prose[1] + " tail"]
    rows = [(k, t, ["en", "de", None][k % 3], ["src0", None, "src1"][k % 3], None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [rows[10], rows[10], (None, prose[2], None, None, None), (None, None, None, None, None)]
    extra = (7, "key", "s", 1, "j", 2, "t")
    return spark.createDataFrame([r + (extra if k % 2 else (None,) * 7) for k, r in enumerate(rows)], COLUMNS)


def no_documents(spark):
    return spark.createDataFrame([], COLUMNS)


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_groups(rows, width, num, den):
    """rows: (doc_id, text). Per row: size of its set, smallest id that links reach, number of links."""
    sets = []
    for _, text in rows:
        w = plain_words(text)
        span = min(width, len(w))
        sets.append({tuple(w[k:k + span]) for k in range(len(w) - span + 1)} if w else set())
    parent, links = list(range(len(sets))), [0] * len(sets)

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x in range(len(sets)):
        for y in range(x):
            if sets[x] and den * len(sets[x] & sets[y]) >= num * len(sets[x] | sets[y]):
                links[x] += 1
                links[y] += 1
                parent[root(x)] = root(y)
    least = {}
    for x, (doc_id, _) in enumerate(rows):
        known = [i for i in (least.get(root(x)), doc_id) if i is not None]
        least[root(x)] = min(known) if known else None
    return [(rows[x][0], len(sets[x]), least[root(x)], links[x]) for x in range(len(sets))]


def edited(rng, words, share):
    return [f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in words]
