"""One query for each operator, over its whole table, and SQL where it can say the same."""
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .collocations import COLLOCATIONS_SQL, collocations
from .decontaminate import LEAKS_SQL, leaks
from .jaccard_join import jaccard_groups
from .language import predict
from .licenses import scan_licenses
from .mixing import MIX_SQL, mix_plan
from .personal import find
from .ppm import score_texts
from .quality import judged, trusted_ids
from .sharding import PLACEMENTS_SQL, placements
from .tokens import section_tokens
from .url_filter import VERDICTS_SQL, judge
from .variants import VARIANTS_SQL, spelling_variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_ngram_jaccard_join(spark, sf_dir):
    return jaccard_groups(table(spark, sf_dir, "documents"), 3, 90, 100)


@query
def op2_source_mixing(spark, sf_dir):
    return mix_plan(table(spark, sf_dir, "documents"))


@query
def op3_personal_data(spark, sf_dir):
    return find(table(spark, sf_dir, "documents"))


@query
def op4_quality_rules(spark, sf_dir):
    return judged(table(spark, sf_dir, "documents"), trusted_ids(table(spark, sf_dir, "labels")))


@query
def op5_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


@query
def op6_benchmark_decontamination(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_sharding(spark, sf_dir):
    return placements(table(spark, sf_dir, "documents"))


@query
def op8_language_id(spark, sf_dir):
    return predict(table(spark, sf_dir, "documents"))


@query
def op9_token_counts(spark, sf_dir):
    return section_tokens(table(spark, sf_dir, "documents"))


@query
def op10_lm_scoring(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents"))


@query
def op11_spelling_variants(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"))


@query
def op12_url_filters(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))


@query
def op13_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


SQL["op2_source_mixing"] = MIX_SQL
SQL["op6_benchmark_decontamination"] = LEAKS_SQL
SQL["op7_sharding"] = PLACEMENTS_SQL
SQL["op11_spelling_variants"] = VARIANTS_SQL
SQL["op12_url_filters"] = VERDICTS_SQL
SQL["op13_collocations"] = COLLOCATIONS_SQL
