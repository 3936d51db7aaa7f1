"""A training corpus from raw documents: language ID, near duplicates, secrets, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet to the shared folder and
rereads as the next stage's docs. All but the last keep the columns of documents, whatever others there are and whatever
their names; an empty table gives an empty one at every stage; a row whose doc_id is null or repeated is a document like any
other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from papyrix.llm import common, jaccard, language, mixing, packing, secrets


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Set lang to the language found; documents without a letter (null and empty texts are such), for which none is found, go.

    Of languages equally near the first by code point is set; repeated rows are judged one by one; a very long text is read whole.
    """
    return language.keep_identified(docs, language.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 80 % of their 5-word shingles, the smallest doc_id stays.

    Rows whose doc_id is null or repeated come after all others; a text without words is linked with nothing and stays, one
    of fewer than five words is a shingle of its own.
    """
    return jaccard.keep_one(docs, k=5, percent=80)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by a mark, overlapping ones by one; all documents stay, null texts as they are."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a null source is one of its own, a document without a word gets
    the whole copies of its source only, so none where the source is taken less than once."""
    return mixing.apply(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of 2048 ids; a null or empty text is one piece that holds the end id."""
    return packing.pack(docs)


STAGES = [("language_id", identify), ("ngram_jaccard", near_duplicates), ("secret_scan", hide_secrets), ("source_mix", mix_sources), ("best_fit_packing", pack)]

ORACLE_SQL = None  # trained models, hashes and token ids are beyond SQL; tests/llm/test_brute.py does the stages one row after another


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, _ = common.stage(docs, name)
    return docs
