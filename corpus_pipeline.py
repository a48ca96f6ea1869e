"""Corpus preparation: toxicity, line dedup, SimHash near-dedup, benchmark decontamination, SentencePiece tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows to the shared folder
and gives them to the next; what a stage has read is deleted once its own rows stand. All stages but the last return the
columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, linededup, pieces, simhash, toxicity
from tessera.llm.storage import discard, write

#: The network's weights and the star contractions are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with n_chars brought up to date."""
    return docs.select(*(F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(c) for c in columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, fitted on the labels at hand, scores 0.5 or more go."""
    network = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, network).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows lose their lines; every document stays."""
    return _measured(linededup.dedup(docs), docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates stays."""
    return simhash.keep_one(docs).select(docs.columns)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out of the texts; every document stays."""
    return _measured(decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text, with their number and digests."""
    return pieces.tokens(docs, keep=[c for c in docs.columns if c != "text"])


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", dedup_near),
    ("benchmark decontamination", cut_benchmark),
    ("sentencepiece", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        before = path
        docs, path = write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            discard(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
