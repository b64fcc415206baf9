"""A cleaning pipeline over ``documents``; each stage calls one operator and reads what the stage before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import jaccard, lines, mixing, packing, quality
from parlance.llm.base import table, written
from parlance.llm.queries import LABELS, WEIGHTS, WHOLE, tokenizer_path
from parlance.session import ship_package


def _ready(spark: SparkSession) -> None:
    """A stage may be called alone: workers need the package, and Arrow batches of whole texts must stay small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    ship_package(spark)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    _ready(spark)
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from all texts; ``n_chars`` follows the text."""
    _ready(spark)
    cleaned = lines.drop_common_lines(docs, min_docs=10, min_chars=1).drop("n_lines", "n_dropped")
    return cleaned.selectExpr(*[c if c != "n_chars" else "CAST(length(text) AS BIGINT) AS n_chars" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, Jaccard similarity of 0.75 or more)."""
    _ready(spark)
    return jaccard.keep_one_of_each(docs)


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken at rates that bring the label domains to their target shares; the good domain stays whole."""
    _ready(spark)
    return mixing.mixed(docs, table(spark, sf_dir, "labels"), LABELS, WEIGHTS, keep_whole=WHOLE)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as tokens in sequences of 1,024."""
    _ready(spark)
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing to target weights", mixing_to_targets),
    ("best-fit packing", best_fit_packing),
]
# The classifier, the fitted rates and the tokenizer can't be expressed in SQL; the tests check each stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
