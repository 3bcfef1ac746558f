"""Benchmark decontamination by templates: numbers, names and units become typed placeholders."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import bounded
from ..session import cut
from .common import fresh, keep_ids

# Template words in a window.
WIDTH = 5
# Words in a window that must not be placeholders, for its template to be evidence.
PLAIN = 3
# Share of an item's windows that a document must hold.
SHARE = 0.8
# Or: share of an item's windows, and how many at least, that a document must hold in a row.
RUN_SHARE, RUN = 0.5, 16
# Words of the shortest item that is looked for. Those shorter than a window must stand as they are.
SHORTEST = 3
# Marks before the words that are replaced: numbers, names, units.
MARKS = ""
UNITS = ("km|cm|mm|m|mi|miles?|ft|feet|inch|inches|kg|g|mg|lbs?|oz|pounds?|l|ml|liters?|litres?|gallons?|s|sec|seconds?|min|minutes?|h|hours?|"
         "days?|weeks?|months?|years?|dollars?|cents?|euros?|usd|eur|percent|degrees?|mph|kmh|kb|mb|gb|tb|hz|khz|mhz|ghz|watts?|kw|kwh|volts?")
# Applied in this order; SQL applies the same. The second to fourth only matter where there is a digit.
RULES = (
    (r"[^\p{L}\p{M}0-9]+", " "),
    (r"([0-9]+)", f" {MARKS[0]}$1 "),
    (f"({MARKS[0]}[0-9]+) +(?i:({UNITS})) ", f"$1 {MARKS[2]}$2 "),
    (" +", " "),
    (r"(^| )(\p{Lu}[\p{L}\p{M}]*)", f"$1{MARKS[1]}$2"),
)
NAMES = RULES[4]
# An item is looked for in two forms: with names replaced, and with names as words, so that it is found in other capitals.
# Words have the same places in both.
FORMS = ("template", "folded")


def _spaced(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """`keep`, and in _c the words of a text with a space behind each, numbers and units marked."""
    first, digits = RULES[0], RULES[1:4]
    rows = rows.select(*keep, F.concat(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(" ")).alias("_c"))
    rows = rows.select(*keep, F.regexp_replace("_c", *first).alias("_c"))
    marked = F.col("_c")
    for rule in digits:
        marked = F.regexp_replace(marked, *rule)
    return rows.select(*keep, F.ltrim(F.when(F.col("_c").rlike("[0-9]"), marked).otherwise(F.col("_c"))).alias("_c"))


def _with_words(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """`keep`, and in template and folded the words of a text: lower case, a space behind each, replaced ones marked."""
    return _spaced(rows, text, *keep).select(*keep, F.lower(F.regexp_replace("_c", *NAMES)).alias("template"), F.lower("_c").alias("folded"))


def _with_forms(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """_with_words() with _form() of both, in fewer steps."""
    rows = _spaced(rows, text, *keep)
    rows = rows.select(*keep, F.when(F.col("_c").contains(MARKS[0]), _form("_c")).otherwise(F.col("_c")).alias("_c"))
    names = F.ltrim(F.regexp_replace(F.concat(F.lit(" "), "_c"), r" \p{Lu}[^ ]*+", f" {MARKS[1]}"))
    return rows.select(*keep, F.lower(names).alias("template"), F.lower("_c").alias("folded"))


def _form(words: Column | str) -> Column:
    """Marked words as their marks alone."""
    return F.regexp_replace(words, f"([{MARKS}])[^ ]*", "$1")


def _windows(words: Column, width: int = WIDTH) -> Column:
    """Array of all runs of `width` words, as text, in the order of their places; one expression finds them all."""
    return F.regexp_extract_all(words, F.lit(f"(?=((?:[^ ]++ ){{{width}}}))[^ ]++ "), 1)


def _key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What tells rows apart: rows with one id and one text are alike."""
    return F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("~")), F.lit(":"), F.xxhash64(F.col(text).cast("string")).cast("string"))


def evidence(benchmark: DataFrame) -> DataFrame:
    """(item_id, form, kind, ip, place, h, named, windows): the windows that are evidence, each numbered from 0 in place, and
    how many the item has.

    Kind `form`: a window by its form, if PLAIN of its words are no placeholders. Kind `exact`: an item without such
    windows is matched by its marked words as they are. Kind `short`: so is an item shorter than a window, as a whole.
    """
    items = _with_words(benchmark.filter("item_id is not null").dropDuplicates(["item_id", "text"]), "text", "item_id")
    items = items.select("item_id", F.explode(F.array(*[F.struct(F.lit(f).alias("form"), F.col(f).alias("w")) for f in FORMS])).alias("x")).select("item_id", "x.*")
    items = items.withColumn("n", F.size(F.split("w", " ")) - 1).filter(F.col("n") >= SHORTEST)
    long = items.filter(F.col("n") >= WIDTH).select(
        "item_id", "form", F.posexplode(F.arrays_zip(_windows(_form("w")).alias("by_form"), _windows(F.col("w")).alias("by_word"))).alias("ip", "x"))
    plain = F.size(F.filter(F.split(F.trim("x.by_form"), " "), lambda w: ~w.rlike(f"^[{MARKS}]"))) >= PLAIN
    long = long.select("item_id", "form", "ip", plain.alias("plain"), F.xxhash64("x.by_form").alias("h"), F.xxhash64("x.by_word").alias("own"),
                       F.col("x.by_form").contains(MARKS[1]).alias("named"))
    whole = Window.partitionBy("item_id", "form")
    long = long.withColumn("good", F.max("plain").over(whole)).filter("plain or not good")
    long = long.select("item_id", "form", F.when(F.col("good"), F.lit("form")).otherwise(F.lit("exact")).alias("kind"), "ip",
                       F.when(F.col("good"), F.col("h")).otherwise(F.col("own")).alias("h"),
                       (F.col("good") & F.col("named")).alias("named"))
    short = items.filter((F.col("n") < WIDTH) & (F.col("form") == "folded")).select(
        "item_id", "form", F.concat(F.lit("short"), F.col("n").cast("string")).alias("kind"), F.lit(0).alias("ip"), F.xxhash64("w").alias("h"), F.lit(False).alias("named"))
    # two texts under one id are one item with the windows of both
    return (long.unionByName(short).dropDuplicates(["item_id", "form", "kind", "ip", "h"])
            .withColumn("place", F.dense_rank().over(Window.partitionBy("item_id", "form", "kind").orderBy("ip")) - 1)
            .withColumn("windows", F.max("place").over(Window.partitionBy("item_id", "form", "kind")) + 1))


def _hashed(words: DataFrame, kinds: list[str], *keep: str) -> DataFrame:
    """(keep, form, kind, dp, h): the windows of documents, of the kinds that are asked for."""
    ways = []
    for kind in kinds:
        width = int(kind[5:]) if kind.startswith("short") else WIDTH
        for form in FORMS if width == WIDTH else FORMS[1:]:
            ways.append((form, kind, _windows(_form(form) if kind == "form" else F.col(form), width)))
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("form"), F.lit(k).alias("kind"), w.alias("all")) for f, k, w in ways])).alias("x")
    return words.select(*keep, each).select(*keep, "x.form", "x.kind", F.posexplode("x.all").alias("dp", "w")).select(*keep, "form", "kind", "dp", F.xxhash64("w").alias("h"))


def _named(words: Column) -> Column:
    """Those of _windows() that hold a name; empty texts stand for the others. They are the same in folded form."""
    window = f"(?=(?:[^ {MARKS[1]}][^ ]*+ ){{0,{WIDTH - 1}}}+{MARKS[1]})(?=((?:[^ ]++ ){{{WIDTH}}}))[^ ]++ "
    return F.regexp_extract_all(words, F.lit(f"{window}|[^ ]++ "), 1)


def _needed(known: DataFrame) -> DataFrame:
    """known, with what a document that holds the item can't do without: any `lacking` of its windows hold one of the
    document's, as it may lack 1 - SHARE of them, and so do all windows of one `block`, as a run that is long enough fills
    a block of half its length."""
    run = F.greatest(F.ceil(F.col("windows") * RUN_SHARE), F.lit(RUN))
    return known.withColumns({"block": F.floor(F.col("place") / F.floor((run + 1) / 2)), "lacking": F.col("windows") - F.ceil(F.col("windows") * SHARE) + 1})


def _nameless(known: DataFrame) -> DataFrame:
    """known without the windows that hold a name, where an item has enough others: `lacking` and one in each block."""
    of = ["item_id", "form", "kind"]
    block = _needed(known).groupBy(*of, "block").agg(F.max("lacking").alias("lacking"), F.count_if(~F.col("named")).alias("n"))
    enough = block.groupBy(*of).agg(((F.min("n") > 0) & (F.sum("n") >= F.max("lacking"))).alias("enough"))
    return known.join(enough, of).filter("not (named and enough)").drop("enough")


def _candidates(docs: DataFrame, known: DataFrame, kinds: list[str]) -> DataFrame:
    """(key, item_id) of documents that may hold an item; none that does is left out.

    Windows with names are looked at only for items that need them, and documents are joined to each item's rarest windows
    only, as far as _needed() allows. So a window that many documents and items share is no evidence to begin with where
    there are others.
    """
    ids, known, ways = docs.select(_key().alias("key"), "text"), cut(_nameless(known)), []
    if "form" in kinds:
        forms = _with_forms(ids, "text", "key")
        named = not known.filter("named and kind = 'form' and form = 'template'").isEmpty()
        windows = F.concat(_windows(F.col("folded")), _named(F.col("template"))) if named else _windows(F.col("folded"))
        ways.append(forms.select("key", F.explode(windows).alias("w")).filter("w <> ''"))
    others = [k for k in kinds if k != "form"]
    if others:
        parts = [_windows(F.col(f), int(k[5:]) if k.startswith("short") else WIDTH) for k in others for f in (FORMS[1:] if k.startswith("short") else FORMS)]
        ways.append(_with_words(ids, "text", "key").select("key", F.explode(F.concat(*parts)).alias("w")))
    sought = bounded(known.select("h").distinct())
    seen = ways[0] if len(ways) == 1 else ways[0].unionByName(ways[1])
    hits = cut(seen.select("key", F.xxhash64("w").alias("h")).join(sought, "h").distinct())
    counts = hits.groupBy("h").agg(F.count(F.lit(1)).alias("often"))
    # windows that no document has are the rarest of all
    ranked = _needed(known).join(counts, "h", "left").fillna(0, ["often"])
    of = ["item_id", "form", "kind"]
    order = ["often", "place"]
    ranked = ranked.withColumn("k", F.row_number().over(Window.partitionBy(*of).orderBy(*order)))
    ranked = ranked.withColumn("b", F.row_number().over(Window.partitionBy(*of, "block").orderBy(*order)))
    probes = ranked.filter("often > 0 and (k <= lacking or b = 1)").select("h", "item_id").distinct()
    return cut(hits.join(bounded(probes), "h").select("key", "item_id").distinct())


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """leaks() with the key of the row in place of its id."""
    known = cut(evidence(benchmark))
    kinds = sorted(r["kind"] for r in known.select("kind").distinct().collect())
    if not kinds:
        return docs.select(_key().alias("key"), F.lit(None).cast("long").alias("item_id"), F.lit(0).alias("windows"), F.lit(0).cast("long").alias("matched"),
                           F.lit(False).alias("changed")).limit(0)
    pairs = _candidates(docs, known, kinds)
    texts = keep_ids(docs.select(_key().alias("key"), "text"), pairs.select("key").distinct(), on="key").dropDuplicates(["key"])
    words = cut(_with_words(texts, "text", "key"))
    wanted = pairs.join(bounded(known, made=True), "item_id")
    met = cut(_hashed(words, kinds, "key").join(wanted, ["key", "form", "kind", "h"]).select(
        "key", "item_id", "form", "kind", "dp", "ip", "place", "windows", (F.col("dp") - F.col("ip")).alias("shift")))
    of = ["key", "item_id", "form", "kind"]
    judged = cut(_judged(words, benchmark, met))
    clash = judged.filter("clash").select("key", "item_id", "form", "shift")
    # names that clash by the template are no evidence in the folded form either
    clash = clash.unionByName(clash.filter(F.col("form") == FORMS[0]).withColumn("form", F.lit(FORMS[1]))).distinct()
    sound = met.join(clash, ["key", "item_id", "form", "shift"], "left_anti").join(
        judged.select("key", "item_id", "form", "shift", "changed"), ["key", "item_id", "form", "shift"], "left")
    along = Window.partitionBy(*of, "shift").orderBy("place")
    runs = sound.select(*of, "shift", "place").distinct().withColumn("island", F.col("place") - F.row_number().over(along))
    longest = runs.groupBy(*of, "shift", "island").agg(F.count(F.lit(1)).alias("run")).groupBy(*of).agg(F.max("run").alias("run"))
    total = sound.groupBy(*of).agg(F.first("windows").alias("windows"), F.countDistinct("place").alias("matched"),
                                   (F.max(F.coalesce("changed", F.lit(0))) > 0).alias("changed")).join(longest, of)
    held = total.filter((F.col("matched") >= SHARE * F.col("windows")) | (F.col("run") >= F.greatest(RUN_SHARE * F.col("windows"), F.lit(RUN))))
    # told by the template where it is held by it
    best = F.max(F.struct((F.col("form") == FORMS[0]).alias("t"), "matched", "windows", "changed")).alias("b")
    return held.groupBy("key", "item_id").agg(best).select("key", "item_id", "b.windows", "b.matched", "b.changed")


def _judged(words: DataFrame, benchmark: DataFrame, met: DataFrame) -> DataFrame:
    """(key, item_id, form, shift, clash, changed): of each alignment, whether its values clash and whether one differs."""
    places = met.filter(~F.col("kind").startswith("short")).select(
        "key", "item_id", "form", "shift", F.explode(F.sequence("ip", F.col("ip") + WIDTH - 1)).alias("ip")).distinct()

    def slots(rows: DataFrame, at: str, value: str, *keep: str) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("form"), F.split(f, " ").alias("w")) for f in FORMS])).alias("x")
        rows = rows.select(*keep, each).select(*keep, "x.form", F.posexplode("x.w").alias(at, value))
        return rows.filter(F.col(value).rlike(f"^[{MARKS}]"))

    items = _with_words(benchmark.filter("item_id is not null").dropDuplicates(["item_id", "text"]), "text", "item_id")
    both = (places.withColumn("dp", F.col("shift") + F.col("ip")).join(slots(words, "dp", "value", "key"), ["key", "form", "dp"])
            .join(slots(items, "ip", "mine", "item_id"), ["item_id", "form", "ip"]).select("key", "item_id", "form", "shift", "mine", "value").distinct())
    return both.groupBy("key", "item_id", "form", "shift").agg(
        (F.countDistinct("mine") < F.count(F.lit(1))).alias("clash"), F.max((F.col("mine") != F.col("value")).cast("int")).alias("changed"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, windows, matched, changed), one row for each document that holds an item, as it is or with other
    numbers, names or units, or with all words but numbers and units as they are, whatever their capitals.

    Windows of documents and items meet by hash. The words that stand for placeholders are compared: along one alignment,
    a value of the item must always stand for the same value of the document. matched counts the item's windows on
    consistent alignments; it must be SHARE of all, or RUN_SHARE of them, and RUN at least, must stand in a row. changed
    tells that some value differs. Items of SHORTEST words up to a window must stand as they are; shorter ones and null
    ids of items are never looked for. Rows of one id and one text are one document; rows that share an id but not a text
    are told apart, and a null id is an id. Null and empty texts give no row; an empty table on either side gives none.
    """
    found = _found(docs, benchmark)
    ids = docs.select(_key().alias("key"), "doc_id")
    held = keep_ids(ids, found.select("key").distinct(), on="key").dropDuplicates(["key"])
    return held.join(found, "key").select("doc_id", "item_id", "windows", "matched", "changed")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with their columns, but for those that hold an item, whatever their id."""
    name = fresh(docs.columns, "leak_key")
    gone = _found(docs, benchmark).select(F.col("key").alias(name)).distinct()
    return keep_ids(docs.withColumn(name, _key()), gone, "left_anti", on=name).drop(name)


def _sql_words(text: str, names: bool) -> str:
    out = f"coalesce({text}, '') || ' '"
    for pattern, by in RULES if names else RULES[:4]:
        out = f"regexp_replace({out}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
    return f"list_filter(string_split(lower({out}), ' '), lambda w: w <> '')"


def _sql_zip(words: str) -> str:
    return f"list_zip({', '.join(f'{words}[{k + 1}:]' for k in range(WIDTH))}, true)"


_SLOT = f"regexp_matches(x, '^[{MARKS}]')"
_BARE = f"list_transform(w, lambda x: CASE WHEN {_SLOT} THEN x[1] ELSE x END)"
LEAKS_SQL = f"""
WITH texts AS (SELECT DISTINCT doc_id, text FROM documents),
docs AS (SELECT row_number() OVER () AS key, doc_id, text FROM texts),
both_items AS (SELECT DISTINCT item_id, 'template' AS form, {_sql_words('text', True)} AS w FROM benchmark WHERE item_id IS NOT NULL
               UNION SELECT item_id, 'folded', {_sql_words('text', False)} FROM benchmark WHERE item_id IS NOT NULL),
both_docs AS (SELECT key, 'template' AS form, {_sql_words('text', True)} AS w FROM docs UNION ALL SELECT key, 'folded', {_sql_words('text', False)} FROM docs),
items AS (SELECT *, {_BARE} AS f FROM both_items WHERE len(w) >= {WIDTH}),
it AS (SELECT item_id, form, unnest(range(0, len(w) - {WIDTH} + 1)) AS ip, unnest({_sql_zip('w')}) AS own, unnest({_sql_zip('f')}) AS bare,
         unnest(list_transform(range(0, len(f) - {WIDTH} + 1), lambda i: len(list_filter(f[i + 1:i + {WIDTH}], lambda x: NOT {_SLOT})))) >= {PLAIN} AS plain FROM items),
told AS (SELECT *, bool_or(plain) OVER (PARTITION BY item_id, form) AS good FROM it),
kept AS (SELECT item_id, form, CASE WHEN good THEN 'form' ELSE 'exact' END AS kind, ip, CASE WHEN good THEN bare ELSE own END AS k FROM told WHERE plain OR NOT good),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY item_id, form, kind ORDER BY ip) - 1 AS place FROM kept),
known AS (SELECT *, max(place) OVER (PARTITION BY item_id, form, kind) + 1 AS windows FROM ranked),
dt AS (SELECT key, form, unnest(range(0, len(w) - {WIDTH} + 1)) AS dp, unnest({_sql_zip('w')}) AS own, unnest({_sql_zip(_BARE)}) AS bare FROM both_docs WHERE len(w) >= {WIDTH}),
met AS (SELECT DISTINCT key, item_id, d.form, kind, dp, ip, place, windows, dp - ip AS shift FROM dt d JOIN known n ON n.form = d.form AND n.kind = 'form' AND n.k = d.bare
        UNION SELECT DISTINCT key, item_id, d.form, kind, dp, ip, place, windows, dp - ip FROM dt d JOIN known n ON n.form = d.form AND n.kind = 'exact' AND n.k = d.own),
spots AS (SELECT DISTINCT key, item_id, form, shift, unnest(range(ip, ip + {WIDTH})) AS ip FROM met),
theirs AS (SELECT key, form, unnest(range(0, len(w))) AS dp, unnest(w) AS value FROM both_docs SEMI JOIN met USING (key)),
ours AS (SELECT item_id, form, unnest(range(0, len(w))) AS ip, unnest(w) AS mine FROM both_items),
slots AS (SELECT DISTINCT p.key, p.item_id, p.form, shift, mine, value FROM spots p
          JOIN theirs t ON t.key = p.key AND t.form = p.form AND t.dp = p.shift + p.ip JOIN ours o ON o.item_id = p.item_id AND o.form = p.form AND o.ip = p.ip
          WHERE regexp_matches(mine, '^[{MARKS}]') AND regexp_matches(value, '^[{MARKS}]')),
judged AS (SELECT key, item_id, form, shift, count(DISTINCT mine) < count(*) AS clash, bool_or(mine <> value) AS changed FROM slots GROUP BY ALL),
clashes AS (SELECT key, item_id, form, shift FROM judged WHERE clash UNION SELECT key, item_id, 'folded', shift FROM judged WHERE clash AND form = 'template'),
sound AS (SELECT m.*, coalesce(changed, false) AS changed FROM met m ANTI JOIN clashes c USING (key, item_id, form, shift)
          LEFT JOIN judged j ON j.key = m.key AND j.item_id = m.item_id AND j.form = m.form AND j.shift = m.shift),
islands AS (SELECT key, item_id, form, kind, shift, place - row_number() OVER (PARTITION BY key, item_id, form, kind, shift ORDER BY place) AS island
            FROM (SELECT DISTINCT key, item_id, form, kind, shift, place FROM sound)),
runs AS (SELECT key, item_id, form, kind, max(n) AS run FROM (SELECT key, item_id, form, kind, shift, island, count(*) AS n FROM islands GROUP BY ALL) GROUP BY ALL),
total AS (SELECT key, item_id, form, kind, any_value(windows) AS windows, count(DISTINCT place) AS matched, bool_or(changed) AS changed FROM sound GROUP BY ALL),
held AS (SELECT key, item_id, form, windows, matched, changed FROM total JOIN runs USING (key, item_id, form, kind)
         WHERE matched >= {SHARE} * windows OR run >= greatest({RUN_SHARE} * windows, {RUN})),
short AS (SELECT key, item_id, 'folded' AS form, 1 AS windows, 1 AS matched, false AS changed FROM both_items i JOIN both_docs d
          ON i.form = 'folded' AND d.form = 'folded' AND len(i.w) BETWEEN {SHORTEST} AND {WIDTH - 1}
          AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(i.w, ' ') || ' ')),
best AS (SELECT key, item_id, max({{t: form = 'template', matched: matched, windows: windows, changed: changed}}) AS b FROM (FROM held UNION ALL FROM short) GROUP BY ALL)
SELECT doc_id, item_id, b.windows AS windows, b.matched AS matched, b.changed AS changed FROM best JOIN docs USING (key)"""
