"""A stored index: postings, vocabulary and documents as Parquet, in place of sorted runs, a merge and a pickled dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boolean, index


def build(docs: DataFrame, terms: Column, path: str, parts: int | None = None) -> None:
    """Write the index of a table with doc_id and text (and name, if it has one) under a folder.

    postings (term, doc_id, tf) are ranged by term and document, so a hot term is several files and a term's filter reads few
    row groups; blocks hold the same compressed, in the same order; vocabulary (term, term_id, df, cf); documents (doc_id,
    name, n_terms, n_tokens, norm), with those that have no terms.
    """
    spark = docs.sparkSession
    order = ("term", "doc_id")
    posts = index.postings(docs, terms)
    (posts.repartitionByRange(parts, *order) if parts else posts.repartitionByRange(*order)).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/postings")
    posts = spark.read.parquet(f"{path}/postings")
    blocks = index.compress_blocks(posts)
    (blocks.repartitionByRange(parts, "term", "block") if parts else blocks.repartitionByRange("term", "block")).sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/blocks")
    vocab = index.vocabulary(posts)
    vocab.join(index.term_ids(vocab), "term").select("term", "term_id", "df", "cf").write.mode("overwrite").parquet(f"{path}/vocabulary")
    names = docs.select("doc_id", F.col("name") if "name" in docs.columns else F.col("doc_id").cast("string").alias("name")).dropDuplicates(["doc_id"])
    names.join(index.doc_stats(posts), "doc_id", "left").na.fill(0, ["n_terms", "n_tokens"]).na.fill(0.0, ["norm"]).write.mode("overwrite").parquet(f"{path}/documents")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a stored index by name."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("postings", "blocks", "vocabulary", "documents")}


def lookup(spark: SparkSession, path: str, term: str) -> DataFrame:
    """name, doc_id, tf of a term, in the order of names; the filter reaches the scan, and only its blocks are decompressed."""
    found = index.decompress_blocks(spark.read.parquet(f"{path}/blocks").where(F.col("term") == term))
    return found.join(spark.read.parquet(f"{path}/documents").select("doc_id", "name"), "doc_id").select("name", "doc_id", "tf").orderBy("name", "doc_id")


def search(spark: SparkSession, path: str, expression: str, in_memory: bool = False) -> DataFrame:
    """doc_id of documents that satisfy a boolean expression, over the stored postings; ``in_memory`` keeps them for later queries."""
    tables = load(spark, path)
    tree = boolean.parse(expression)
    posts = tables["postings"].persist() if in_memory else tables["postings"].where(F.col("term").isin(boolean.terms(tree)))
    return boolean.evaluate(posts, tables["documents"], tree)


def skips_of(spark: SparkSession, path: str, term: str) -> DataFrame:
    """at, doc_id, skip_to of one term's skip list."""
    return index.skip_lists(spark.read.parquet(f"{path}/postings").where(F.col("term") == term)).drop("term")


def has(spark: SparkSession, path: str, term: str, docs: DataFrame) -> DataFrame:
    """doc_id, found: whether each of some documents has the term; of its compressed blocks only those that may hold them are read."""
    asked = docs.select("doc_id").distinct().withColumn("block", F.floor(F.col("doc_id") / index.BLOCK_IDS).cast("long"))
    blocks = spark.read.parquet(f"{path}/blocks").where(F.col("term") == term).join(asked.select("block").distinct(), "block", "left_semi")
    held = index.decompress_blocks(blocks).select("doc_id", F.lit(True).alias("found"))
    return asked.select("doc_id").join(held, "doc_id", "left").select("doc_id", F.coalesce("found", F.lit(False)).alias("found"))
