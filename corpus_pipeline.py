"""From raw documents to shards of a training mix."""
from pyspark.sql import DataFrame, SparkSession

from packetloom.llm.decontaminate import clean
from packetloom.llm.jaccard_join import one_of_each
from packetloom.llm.language import recognised
from packetloom.llm.mixing import mixed_rows
from packetloom.llm.sharding import assigned
from packetloom.session import passing


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language is told with a clear margin stay."""
    return recognised(docs)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are near copies (words in fives, 0.8) the one with the smallest id stays."""
    return one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold a benchmark item go."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in proportion to their sources' weights, shuffled; a row may come several times or not at all."""
    return mixed_rows(docs)


def in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with their shard."""
    return assigned(docs)


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard_join", distinct_texts),
    ("benchmark_decontamination", without_benchmark),
    ("source_mixing", mixed_sources),
    ("sharding", in_shards),
]

# The stages hash and compress; SQL can't say that, so tests hold the stages against brute force.
ORACLE_SQL = None


def _written(spark: SparkSession, sf_dir: str, stages: list) -> DataFrame:
    """What the last of these stages gives; what the others gave, and all that the stages wrote on the way, is deleted."""
    if not stages:
        return spark.read.parquet(f"{sf_dir}/documents.parquet")
    with passing(spark) as kept:
        return kept(stages[-1][1](spark, _written(spark, sf_dir, stages[:-1]), sf_dir))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each reads what the one before wrote to the shared folder."""
    return STAGES[-1][1](spark, _written(spark, sf_dir, STAGES[:-1]), sf_dir)
