"""A training corpus from raw documents: filter, drop near copies and repeats, hide personal data, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxward.llm.ngram_join import JaccardParams, jaccard_components
from voxward.llm.packing import PackParams, pack_documents
from voxward.llm.pii import PiiParams, replace_pii
from voxward.llm.quality import keep_good
from voxward.llm.repeats import RepeatParams, remove_repeats
from voxward.llm.tables import small_side, stored, table
from voxward.session import ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: by their own measures or by their host's verdict."""
    ship_package(spark)
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest doc_id stays.

    Of rows that repeat a doc_id one stays. Rows without doc_id stay.
    """
    ship_package(spark)
    components = jaccard_components(docs, JaccardParams(width=5, percent=80))
    dropped = stored(components.where("doc_id != component_id").select("doc_id").distinct(), "near-copies")
    kept = docs.join(small_side(dropped), "doc_id", "left_anti").select(docs.columns)
    ids = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    repeated = stored(ids.select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    once = kept.join(small_side(repeated), "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])
    return kept.join(small_side(repeated), "doc_id", "left_anti").select(docs.columns).union(once)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that occur earlier are cut out of the texts."""
    ship_package(spark)
    return remove_repeats(docs, RepeatParams(window=100)).select(docs.columns)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by surrogates."""
    ship_package(spark)
    return replace_pii(docs, PiiParams()).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents with their places in sequences of 1024."""
    ship_package(spark)
    return pack_documents(docs, PackParams())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", suffix_array_dedup),
    ("PII", pii_surrogates),
    ("best-fit packing", best_fit_packing),
]

#: Tokens and keyed surrogates are beyond SQL; tests/llm/test_llm_queries.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is stored and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
