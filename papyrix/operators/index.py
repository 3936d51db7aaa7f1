"""Postings, vocabulary, document statistics, skip lists, compressed postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec
from . import blocks

BLOCK_IDS = 65536  # document ids that a block of compressed postings spans


def tokens(docs: DataFrame, terms: Column) -> DataFrame:
    """doc_id, pos, term in text order."""
    return docs.select("doc_id", F.posexplode(terms).alias("pos", "term"))


def postings(docs: DataFrame, terms: Column) -> DataFrame:
    """doc_id, term, tf: one hash aggregation with map-side counts."""
    return docs.select("doc_id", F.explode(terms).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def postings_of(docs: DataFrame, terms: Column, wanted: list[str] | DataFrame) -> DataFrame:
    """The postings of some terms (a list, or a small table with ``term``): no other token is shuffled."""
    if isinstance(wanted, DataFrame):
        rows = docs.select("doc_id", F.explode(terms).alias("term")).join(wanted.select("term").distinct(), "term", "left_semi")
    else:
        rows = docs.select("doc_id", F.explode(F.filter(terms, lambda t: t.isin(*wanted))).alias("term"))
    return rows.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def lengths(docs: DataFrame, terms: Column) -> DataFrame:
    """doc_id, dl (number of tokens) of documents that have any, without a shuffle; doc_id must not repeat."""
    return docs.select("doc_id", F.size(terms).cast("long").alias("dl")).where("dl > 0")


def vocabulary(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def posting_lists(posts: DataFrame) -> DataFrame:
    """term, df, cf, docs (ascending ids): the index in memory form; persist it for repeated queries."""
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.sort_array(F.collect_list("doc_id")).alias("docs"))


def doc_stats(posts: DataFrame) -> DataFrame:
    """doc_id, n_terms, n_tokens, norm (root of the sum of squared counts, taken from an integer sum)."""
    return posts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("n_tokens"), F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))


def with_gaps(posts: DataFrame) -> DataFrame:
    """Postings with ``gap``, the id's distance to the term's previous one."""
    return posts.withColumn("gap", F.col("doc_id") - F.lag("doc_id", 1, 0).over(Window.partitionBy("term").orderBy("doc_id")))


def un_gaps(gaps: DataFrame, order: str) -> DataFrame:
    return gaps.withColumn("doc_id", F.sum("gap").over(Window.partitionBy("term").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def skip_lists(posts: DataFrame) -> DataFrame:
    """term, at, doc_id, skip_to: every floor(sqrt(n))-th posting and the one that many further on."""
    n = F.count(F.lit(1)).over(Window.partitionBy("term"))
    rows = posts.withColumn("at", F.row_number().over(Window.partitionBy("term").orderBy("doc_id")) - 1).withColumn("step", F.floor(F.sqrt(n)))
    picked = rows.where("at % step = 0").withColumn("skip_to", F.lead("doc_id").over(Window.partitionBy("term").orderBy("at")))
    return picked.where("skip_to IS NOT NULL").select("term", F.col("at").cast("long").alias("at"), "doc_id", "skip_to")


def code_sizes(posts: DataFrame) -> DataFrame:
    """Bytes of all ids by variable-byte codes, plain and as gaps, and of counts by gamma codes, in closed form."""
    gaps = with_gaps(posts)
    per_term = gaps.groupBy("term").agg(F.sum(codec.vbyte_size(F.col("doc_id"))).alias("plain"), F.sum(codec.vbyte_size(F.col("gap"))).alias("gapped"), F.ceil(F.sum(codec.gamma_bits(F.col("tf"))) / 8).alias("counts"))
    return per_term.agg(F.sum("plain").alias("bytes_ids"), F.sum("gapped").alias("bytes_gaps"), F.sum("counts").cast("long").alias("bytes_counts"))


def _in_blocks(posts: DataFrame) -> DataFrame:
    """Postings dealt out by term and block of BLOCK_IDS document ids, equal ones together; one number is sorted, not terms."""
    block = F.floor(F.col("doc_id") / BLOCK_IDS).cast("long")
    rows = posts.select(F.xxhash64("term", block).alias("key"), "term", block.alias("block"), "doc_id", "tf")
    return rows.repartition("key").sortWithinPartitions("key")


def compress(posts: DataFrame, gaps: bool = True) -> DataFrame:
    """term, block, df, base, ids (variable-byte), bits, counts (gamma): the compressed index, in rows of BLOCK_IDS document ids.

    A term's ids are one code, cut between blocks: base is the id before a block's first (0 without gaps), so each block can be
    read alone. Its counts are the first ``bits`` bits of its blocks, joined.
    """
    rows = _in_blocks(posts).mapInArrow(blocks.encode(gaps), "term string, block long, df long, first long, last long, rest binary, bits long, counts binary")
    base = F.lag("last", 1, 0).over(Window.partitionBy("term").orderBy("block")) if gaps else F.lit(0).cast("long")
    coded = rows.withColumn("base", base).withColumn("ids", F.concat(codec.vbyte_column(F.col("first") - F.col("base")), "rest"))
    return coded.select("term", "block", "df", "base", "ids", "bits", "counts")


def decompress(index: DataFrame, gaps: bool = True) -> DataFrame:
    """term, doc_id of a compressed index."""
    return index.select("term", "df", "base", "ids").mapInArrow(blocks.decode(gaps), "term string, doc_id long")


def compress_blocks(posts: DataFrame) -> DataFrame:
    """term, block, df, ids, counts: the compressed index in blocks of BLOCK_IDS document ids, so no row grows with a term.

    ids are the gaps of a block's documents (from the block's first possible id on) in variable-byte codes, counts gamma
    codes that can be read back.
    """
    return _in_blocks(posts).mapInArrow(blocks.encode_blocks(BLOCK_IDS), "term string, block long, df long, ids binary, counts binary")


def decompress_blocks(index: DataFrame) -> DataFrame:
    """term, doc_id, tf of compressed blocks."""
    return index.select("term", "block", "df", "ids", "counts").mapInArrow(blocks.decode_blocks(BLOCK_IDS), "term string, doc_id long, tf long")


def term_ids(vocab: DataFrame) -> DataFrame:
    """term, term_id: dense ids from 1 in the order of terms.

    Terms are numbered within their first two characters and offset by the counts of smaller ones, a table as long as there
    are different beginnings, so no task numbers the whole vocabulary.
    """
    named = vocab.select("term", F.substring("term", 1, 2).alias("start"))
    per = named.groupBy("start").agg(F.count(F.lit(1)).alias("n"))
    before = per.select("start", (F.sum("n").over(Window.orderBy("start")) - F.col("n")).alias("before"))
    return named.join(before, "start").select("term", (F.col("before") + F.row_number().over(Window.partitionBy("start").orderBy("term"))).alias("term_id"))
