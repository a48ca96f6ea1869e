"""The registered queries of this package and their SQL. Each reads the whole table it is meant for."""

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, html, langid, lexical, linededup, multiindex, pieces, quality, secrets, sharding, simhash, toxicity, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict:
    return {
        "op1_simhash": lambda s, d: simhash.near_duplicates(table(s, d, "documents")),
        "op2_sharding": lambda s, d: sharding.shard(table(s, d, "documents")),
        "op3_language": lambda s, d: langid.identify(table(s, d, "documents")),
        "op4_pieces": lambda s, d: pieces.tokens(table(s, d, "documents"), keep=["doc_id"], with_ids=False),
        "op5_toxicity": lambda s, d: toxicity.score(table(s, d, "documents"), table(s, d, "labels")),
        "op6_secrets": lambda s, d: secrets.scan(table(s, d, "documents")),
        "op7_html": lambda s, d: html.extract(table(s, d, "pages")),
        "op8_line_dedup": lambda s, d: linededup.dedup(table(s, d, "documents"), keep=["doc_id", "text"]),
        "op9_decontamination": lambda s, d: decontaminate.report(table(s, d, "documents"), table(s, d, "benchmark")),
        "op10_embedding_dedup": lambda s, d: multiindex.near_duplicates(table(s, d, "embeddings")),
        "op11_quality": lambda s, d: quality.score(table(s, d, "documents"), table(s, d, "labels")),
        "op12_whitening": lambda s, d: whitening.report(table(s, d, "embeddings")),
        "op13_lexical_search": lambda s, d: lexical.search(table(s, d, "documents"), table(s, d, "benchmark")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_line_dedup": linededup.ORACLE, "op9_decontamination": decontaminate.ORACLE, "op10_embedding_dedup": multiindex.ORACLE, "op13_lexical_search": lexical.ORACLE}
