"""Retrieval queries: documents searched with benchmark texts, detections with questions."""
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text
from ..operators import retrieval
from ..session import scratch
from . import view_sql as v
from . import views
from .catalog import joined, query, stamped

STOP = "[" + ", ".join(f"'{w}'" for w in fixed.STOPWORDS) + "]"


def terms_sql(text_column: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({text_column}), '{fixed.TOKEN_PATTERN}'), "
            f"lambda t: NOT list_contains({STOP}, t))")


def search_sql(docs: str, queries: str, k: int = 6) -> str:
    """CTEs that rank docs (doc_id, text) for queries (query_id, text) into `ranked`."""
    return f"""toks AS (SELECT doc_id, {terms_sql('text')} AS toks FROM ({docs})),
stats AS (SELECT count(*) AS n, CASE WHEN sum(len(toks)) > 0 THEN sum(len(toks)) / count(*) ELSE 1.0 END AS avgdl FROM toks),
posts AS (SELECT doc_id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, len(toks) AS len, unnest(toks) AS term FROM toks) GROUP BY 1, 2),
dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY 1),
qt AS (SELECT query_id, term, count(*) AS reps FROM (SELECT query_id, unnest({terms_sql('text')}) AS term FROM ({queries})) GROUP BY 1, 2),
parts AS (SELECT query_id, doc_id, CAST(floor(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))
    * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl))) * reps * 1e12::DOUBLE) AS BIGINT) AS part
  FROM qt JOIN posts USING (term) JOIN dfs USING (term), stats),
ranked AS (SELECT query_id, doc_id, round_even(CAST(s AS DOUBLE) / 1e12::DOUBLE, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank
  FROM (SELECT query_id, doc_id, sum(part) AS s FROM parts GROUP BY 1, 2) WHERE s > 0 QUALIFY rank <= {k})"""


DOCS = "SELECT doc_id, text FROM documents"
BENCH = "SELECT item_id AS query_id, text FROM benchmark"


def _docs(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", "text")


def _bench(spark, sf):
    return views.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("search_terms", f"SELECT doc_id, array_to_string({terms_sql('text')}, ' ') AS terms FROM documents")
def search_terms(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(text.tokens(F.col("text")), " ").alias("terms"))


@query("document_index", f"WITH {search_sql(DOCS, BENCH)} SELECT doc_id, term, tf, CAST(len AS BIGINT) AS length FROM posts")
def document_index(spark, sf):
    return retrieval.postings(_docs(spark, sf))


@query("document_frequency", f"WITH {search_sql(DOCS, BENCH)} SELECT term, df FROM dfs")
def document_frequency(spark, sf):
    return retrieval.document_frequency(retrieval.postings(_docs(spark, sf)))


@query("corpus_statistics", f"WITH {search_sql(DOCS, BENCH)} SELECT n AS docs, round(avgdl, 9) AS mean_length FROM stats")
def corpus_statistics(spark, sf):
    out = retrieval.corpus_stats(retrieval.document_table(_docs(spark, sf)))
    return out.select("docs", F.round("mean_length", 9).alias("mean_length"))


@query("search_documents", f"WITH {search_sql(DOCS, BENCH)} SELECT * FROM ranked")
def search_documents(spark, sf):
    """Every benchmark text, whole, as a question to all documents."""
    return retrieval.search_text(_docs(spark, sf), _bench(spark, sf))


@query("search_documents_many_terms", f"WITH {search_sql(DOCS, BENCH)} SELECT * FROM ranked")
def search_documents_many_terms(spark, sf):
    """The same with the query side taken as too large to broadcast."""
    docs = _docs(spark, sf)
    return retrieval.search(retrieval.postings(docs), retrieval.document_table(docs), _bench(spark, sf), broadcast_terms=10)


INCIDENT = """SELECT id AS doc_id, array_to_string(list_filter(['detection ' || id, cnn_verdict, attack_family, technique_id, technique_name, tactic,
  'src ' || src_ip, country, 'dst ' || dst_ip || ' port ' || dst_port, CASE proto WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' ELSE CAST(proto AS VARCHAR) END,
  summary, strftime(timestamp, '%Y-%m-%d %H:%M:%S')], lambda p: p IS NOT NULL AND p <> ''), ' ') AS text FROM detections"""
# One question per technique on the newest address that showed it.
ASKED = """SELECT row_number() OVER (ORDER BY technique_id) AS query_id,
  'what do we know about ' || technique_name || ' from ' || arg_max(src_ip, (timestamp, id)) || ' any ' || tactic || ' ' || tactic || '?' AS text
FROM detections WHERE technique_id IS NOT NULL GROUP BY technique_id, technique_name, tactic"""


def _questions(spark, sf):
    from pyspark.sql import Window
    d = views.detections(spark, sf).filter("technique_id is not null")
    newest = d.groupBy("technique_id", "technique_name", "tactic").agg(F.max_by("src_ip", F.struct("timestamp", "id")).alias("ip"))
    asked = F.concat(F.lit("what do we know about "), "technique_name", F.lit(" from "), "ip", F.lit(" any "), "tactic",
                     F.lit(" "), "tactic", F.lit("?"))
    return newest.select(F.row_number().over(Window.orderBy("technique_id")).cast("long").alias("query_id"), asked.alias("text"))


ASK = v.over("detections", extra=search_sql(INCIDENT, ASKED))


@query("incident_text", v.over("detections") + INCIDENT)
def incident_text(spark, sf):
    return retrieval.incident_documents(views.detections(spark, sf))


@query("search_incidents", ASK + "SELECT * FROM ranked")
def search_incidents(spark, sf):
    return retrieval.search_text(retrieval.incident_documents(views.detections(spark, sf)), _questions(spark, sf))


@query("retrieved_context", ASK + """SELECT r.query_id, r.rank, r.score, d.id, cnn_verdict, cnn_confidence, technique_id, src_ip, dst_ip, dst_port, country, summary,
  strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp FROM ranked r JOIN detections d ON d.id = r.doc_id""")
def retrieved_context(spark, sf):
    d = views.detections(spark, sf)
    hits = retrieval.search_text(retrieval.incident_documents(d), _questions(spark, sf))
    return stamped(retrieval.context(hits, d).select(
        "query_id", "rank", "score", "id", "cnn_verdict", "cnn_confidence", "technique_id", "src_ip", "dst_ip", "dst_port",
        "country", "summary", "timestamp"))


@query("grounded_citations", ASK + """, cites AS (
  SELECT query_id, list(doc_id ORDER BY rank) AS got FROM ranked GROUP BY query_id)
SELECT query_id, array_to_string([got[2], got[1]], '|') AS cited FROM cites""")
def grounded_citations(spark, sf):
    """An answer cites the second and first hit, a repeat, junk and ids never retrieved."""
    hits = retrieval.search_text(retrieval.incident_documents(views.detections(spark, sf)), _questions(spark, sf))
    got = hits.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))),
                                                   lambda h: h["doc_id"]).alias("got"))
    at = lambda i: F.element_at("got", i).cast("string")
    said = F.array(F.lit("999999999"), at(2), F.lit("junk"), at(1), F.lit(None).cast("string"), at(2))
    return got.select("query_id", joined(retrieval.grounded(said, F.col("got"))).alias("cited"))


@query("index_delta", v.over("detections") + """, h AS (SELECT max(id) * 7 // 10 AS h FROM detections),
n AS (SELECT count(*) FILTER (WHERE id <= h) AS low, count(*) AS n FROM detections, h)
SELECT 'part' AS step, 0 AS before, low AS after, false AS rebuilt FROM n UNION ALL SELECT 'rest', low, n, false FROM n
UNION ALL SELECT 'again', n, n, false FROM n UNION ALL SELECT 'shrunk', n, low, true FROM n""")
def index_delta(spark, sf):
    """Index the older part, then all, then all again, then a table whose ids went back: that index is built anew."""
    d = views.detections(spark, sf)
    low = d.filter(F.col("id") <= d.agg(F.max("id")).first()[0] * 7 // 10)
    index, docs = scratch(spark, "index"), scratch(spark, "docs")
    steps, before = [], 0
    for step, rows in (("part", low), ("rest", d), ("again", d), ("shrunk", low)):
        rebuilt = before > 0 and retrieval.delta(rows, retrieval.stored(spark, docs))[1]
        retrieval.sync(rows, index, docs)
        after = retrieval.stored(spark, docs)
        if retrieval.stored(spark, index).select("doc_id").distinct().count() != after.count():
            raise ValueError("postings and documents differ")
        steps.append((step, before, after.count(), bool(rebuilt)))
        before = steps[-1][2]
    return spark.createDataFrame(steps, "step string, before long, after long, rebuilt boolean")
