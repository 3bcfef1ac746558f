"""BM25 search over incidents or any text table."""
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import numeric, text
from ..session import cut
from .joins import bounded, is_small

CONTEXT_FIELDS = [
    "id", "cnn_verdict", "cnn_confidence", "attack_family", "technique_id", "technique_name",
    "tactic", "src_ip", "dst_ip", "dst_port", "country", "summary", "timestamp",
]
CITATION_FIELDS = ["id", "technique_id", "technique_name", "src_ip", "country", "timestamp"]

# Distinct query terms up to which the query side is broadcast.
BROADCAST_TERMS = 100_000
# Shares into which each query term is split in the shuffled join.
SALT = 32
# Units of a score in the whole-number sums.
UNITS = 1e12


def incident_documents(detections: DataFrame) -> DataFrame:
    return detections.select(F.col("id").alias("doc_id"), text.incident_text().alias("text"))


def tokenized(docs: DataFrame) -> DataFrame:
    """doc_id, tokens, length."""
    rows = docs.select("doc_id", text.tokens(F.col("text")).alias("tokens"))
    return rows.withColumn("length", F.size("tokens").cast("long"))


def postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, tf, length): the stored index.

    With `terms` (a small table of words) only their postings, pruned before the shuffle.
    """
    return counted(tokenized(docs), terms)


def counted(words: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """The postings of texts that are taken apart already.

    With `terms` words are pruned first and the few that stay are counted by a shuffle. Without, a document's words,
    which lie in one row, are sorted and counted there: no task gathers the words of many texts. Only where a doc_id
    comes more than once are its rows put together first.
    """
    if terms is not None:
        rows = words.select("doc_id", "length", F.explode("tokens").alias("term"))
        rows = rows.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
        return rows.groupBy("doc_id", "length", "term").agg(F.count("*").alias("tf")).select("doc_id", "term", "tf", "length")
    if not words.groupBy("doc_id").count().filter("count > 1").isEmpty():
        words = words.groupBy("doc_id", "length").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
    run = F.transform("sorted", lambda t, i: F.struct(t.alias("term"), i.alias("last")))
    ends = F.filter(run, lambda r: ~F.get("sorted", r["last"] + 1).eqNullSafe(r["term"]))
    before = lambda i: F.coalesce(F.get("ends", i - 1)["last"], F.lit(-1))
    tallied = F.transform("ends", lambda e, i: F.struct(e["term"].alias("term"), (e["last"] - before(i)).cast("long").alias("tf")))
    rows = words.select("doc_id", "length", F.sort_array("tokens").alias("sorted")).select("doc_id", "length", ends.alias("ends"))
    return rows.select("doc_id", "length", F.explode(tallied).alias("p")).select("doc_id", "p.term", "p.tf", "length")


def document_table(docs: DataFrame) -> DataFrame:
    """(doc_id, length) of every document, also the empty ones."""
    return tokenized(docs).select("doc_id", "length")


def document_frequency(index: DataFrame) -> DataFrame:
    """Documents per term; the index has one row per (doc, term)."""
    return index.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(doc_table: DataFrame) -> DataFrame:
    n, total = F.count("*"), F.sum("length")
    return doc_table.agg(n.alias("docs"), F.when(total > 0, total / n).otherwise(1.0).alias("mean_length"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, repeats): a repeated query word counts as often as it stands."""
    words = queries.select("query_id", F.explode(text.tokens(F.col("text"))).alias("term"))
    return words.groupBy("query_id", "term").agg(F.count("*").alias("repeats"))


def search(index: DataFrame, doc_table: DataFrame, queries: DataFrame, k: int = fixed.TOP_K,
           broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """Top k documents per query: query_id, doc_id, score (4 digits), rank.

    Only postings of query terms take part, and of those only what can matter. The k-th
    best score of a query by its strongest word alone is one that its k-th hit reaches.
    Words that cannot reach it together, by the largest weight each of them has, bring
    no hit of their own: their postings are looked up for documents that other words
    have found, and of these only for such as can still pass the k-th best sum found.
    The result is that of scoring all postings.

    The side of the words is broadcast when it is counted small; otherwise terms are
    salted, so a word that stands in a third of all documents is spread over tasks.
    Sums are whole numbers of 1e-12, so equal documents tie exactly however the rows
    are split, and ties go to the smaller id.
    """
    weighted, strong, weak = plan(index, doc_table, queries, k, broadcast_terms)
    part = F.floor(F.col("w") * F.col("repeats") * UNITS)
    limits = bounded(strong.select("query_id", "goal", "weak").distinct())
    found = _join_terms(weighted, strong.drop("goal", "weak"), broadcast_terms).groupBy("query_id", "doc_id").agg(F.sum(part).alias("s"))
    found = cut(found.join(limits, "query_id").filter(F.col("s") + F.col("weak") >= F.col("goal")).drop("goal"))
    # The k-th best sum of the strong words is a score that the k-th hit reaches too, and a far better one.
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("s").desc(), "doc_id"))
    reached = bounded(found.withColumn("nth", nth).filter(F.col("nth") == k).select("query_id", F.col("s").alias("reached")))
    found = cut(found.join(reached, "query_id", "left").filter(
        F.col("s") + F.col("weak") >= F.coalesce("reached", F.lit(0))).drop("reached"))
    words = bounded(weak.select("query_id", "term", "repeats"), broadcast_terms)
    open_docs = found.filter("weak > 0")
    asked = open_docs.select("query_id", "doc_id").join(words, "query_id")
    looked_up = weighted.join(words.select("term").distinct(), "term", "left_semi")
    near = cut(open_docs.select("doc_id").distinct())
    if is_small(near):
        looked_up = looked_up.join(F.broadcast(near), "doc_id", "left_semi")
    added = asked.join(looked_up, ["doc_id", "term"]).groupBy("query_id", "doc_id").agg(F.sum(part).alias("more"))
    summed = found.join(added, ["query_id", "doc_id"], "left").withColumn(
        "s", F.col("s") + F.coalesce("more", F.lit(0))).filter("s > 0")
    best = Window.partitionBy("query_id").orderBy(F.col("s").desc(), "doc_id")
    return summed.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "doc_id", F.bround(F.col("s") / UNITS, 4).alias("score"), "rank")


def plan(index: DataFrame, doc_table: DataFrame, queries: DataFrame, k: int = fixed.TOP_K,
         broadcast_terms: int = BROADCAST_TERMS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings with their weight w, and the strong and the weak words of each query.

    Words: query_id, term, repeats, goal (a score that the k-th hit reaches), weak (the most that the weak words give).
    """
    terms = query_terms(queries)
    matched = _of_queries(index, terms, broadcast_terms)
    weights = document_frequency(matched.select("doc_id", "term")).crossJoin(F.broadcast(corpus_stats(doc_table))).select(
        "term", "mean_length", numeric.bm25_idf(F.col("docs"), F.col("df")).alias("idf"))
    weight = F.col("idf") * numeric.bm25_weight(F.col("tf"), F.col("length"), F.col("mean_length"))
    weighted = cut(_join_terms(matched, bounded(weights, broadcast_terms), broadcast_terms).select("doc_id", "term", weight.alias("w")))
    tops = weighted.groupBy("term").agg(F.max("w").alias("top"))
    bound = F.floor(F.col("top") * F.col("repeats") * UNITS)
    falling = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "term")
    words = cut(terms.join(tops, "term").withColumn("bound", bound).withColumns({
        "nth": F.row_number().over(falling),
        "rest": F.sum("bound").over(falling.rowsBetween(Window.currentRow, Window.unboundedFollowing))}))
    lead = words.filter("nth = 1").select("query_id", "term", "repeats")
    alone = F.floor(F.col("w") * F.col("repeats") * UNITS)
    first = _join_terms(weighted, lead, broadcast_terms).select("query_id", "doc_id", alone.alias("s"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("s").desc(), "doc_id"))
    goals = first.withColumn("nth", nth).filter(F.col("nth") == k).select("query_id", F.col("s").alias("goal"))
    words = words.join(bounded(goals), "query_id", "left").withColumn("goal", F.coalesce("goal", F.lit(0)))
    strong = F.col("rest") >= F.col("goal")
    weak = F.max(F.when(~strong, F.col("rest"))).over(Window.partitionBy("query_id"))
    words = cut(words.withColumns({"strong": strong, "weak": F.coalesce(weak, F.lit(0))}).drop("top", "bound", "nth", "rest"))
    return weighted, words.filter("strong").drop("strong"), words.filter("not strong").drop("strong")


def _small(terms: DataFrame, bound: int) -> bool:
    return terms.limit(bound + 1).count() <= bound


def _of_queries(index: DataFrame, terms: DataFrame, bound: int) -> DataFrame:
    """Postings of query terms; when the terms are many, found by a shuffled join and written once."""
    asked = terms.select("term").distinct()
    if _small(terms, bound):
        return index.join(F.broadcast(asked), "term", "left_semi")
    return cut(_join_terms(index, asked, bound).select("doc_id", "term", "tf", "length"))


def _join_terms(matched: DataFrame, side: DataFrame, bound: int) -> DataFrame:
    if _small(side, bound):
        return matched.join(F.broadcast(side), "term")
    salted = matched.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)))
    copies = side.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    # The copies look as small as the words they come from, but are too many to broadcast.
    return salted.join(copies.hint("merge"), ["term", "salt"])


def search_text(docs: DataFrame, queries: DataFrame, k: int = fixed.TOP_K,
                broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """Search without a stored index: the index is derived, pruned to the query terms.

    The texts are read and taken apart once; words and index are written, since frequencies and scores both read them.
    So are the queries, which may be derived from a large table.
    """
    queries = cut(queries)
    terms = query_terms(queries)
    few = terms if _small(terms, broadcast_terms) else None
    words = cut(tokenized(docs))
    return search(cut(counted(words, few)), words.select("doc_id", "length"), queries, k, broadcast_terms)


def delta(detections: DataFrame, indexed: DataFrame) -> tuple[DataFrame, bool]:
    """Rows still to index, and whether the index must be rebuilt.

    `indexed` is the document table. The index is rebuilt when the table shrank or
    its highest id went back. Otherwise rows above the high-water mark come, or, when
    the counts show that rows were added below it, all rows the index lacks.
    """
    old = indexed.agg(F.count("*").alias("n"), F.max("doc_id").alias("top")).first()
    if old["n"] == 0:
        return detections, False
    above = F.col("id") > old["top"]
    new = detections.agg(F.count("*").alias("n"), F.max("id").alias("top"), F.count_if(above).alias("above")).first()
    if new["n"] < old["n"] or new["top"] is None or new["top"] < old["top"]:
        return detections, True
    if old["n"] + new["above"] == new["n"]:
        return detections.filter(above), False
    return detections.join(indexed.select(F.col("doc_id").alias("id")), "id", "left_anti"), False


def stored(spark: SparkSession, path: str) -> DataFrame:
    """A stored index or document table."""
    return spark.read.parquet(path).drop("sync")


def sync(detections: DataFrame, index_path: str, docs_path: str) -> int:
    """Bring a stored index up to date; gives the number of rows indexed.

    What a run adds lies in one folder, named by the state that it started from. A run that died is run again from the same
    state, so it overwrites what was left. The document table is written last: the next delta is taken from it.
    """
    from ..sources.sinks import exists
    spark = detections.sparkSession
    known = stored(spark, docs_path) if exists(spark, docs_path) else spark.createDataFrame([], "doc_id long, length long")
    state = known.agg(F.count("*").alias("n"), F.max("doc_id").alias("top")).first()
    fresh, rebuild = delta(detections, known)
    docs = cut(incident_documents(fresh))
    for rows, path in ((postings(docs), index_path), (document_table(docs), docs_path)):
        (rows.withColumn("sync", F.lit(f"from-{state['n']}-{state['top']}")).write.mode("overwrite")
         .option("partitionOverwriteMode", "static" if rebuild else "dynamic").partitionBy("sync").parquet(path))
    return docs.count()


def context(hits: DataFrame, detections: DataFrame) -> DataFrame:
    """Hits with the fields an answer may use."""
    return hits.join(detections.select(*CONTEXT_FIELDS), hits.doc_id == detections.id).drop("doc_id")


def citations(cited: DataFrame, detections: DataFrame) -> DataFrame:
    """Rows (ref, position, id) with the fields a citation shows."""
    return cited.join(detections.select(*CITATION_FIELDS), "id")


def grounded(cited: Column, allowed: Column) -> Column:
    """Cited ids (as text) that are allowed: integers, first occurrence, order kept."""
    from ..functions.parsed import whole_number
    ids = F.filter(F.transform(cited, whole_number), lambda i: i.isNotNull())
    return F.array_intersect(F.array_distinct(ids), allowed)
