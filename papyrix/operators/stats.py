"""Collection statistics, growth and frequency laws."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import shared
from . import index, ordered


def collection(posts: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: documents, tokens, terms, their means, mean term length, shortest and longest document, terms in one document."""
    lengths = posts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("tokens"))
    per_doc = lengths.agg(
        F.sum("tokens").alias("n_tokens"), F.min(F.struct("tokens", "doc_id", "terms")).alias("s"), F.max(F.struct("tokens", "doc_id", "terms")).alias("l"), F.sum("terms").alias("all_terms")
    )
    vocab = index.vocabulary(posts).agg(F.count(F.lit(1)).alias("n_terms"), F.avg(F.length("term")).alias("mean_term_length"), F.sum((F.col("df") == 1).cast("int")).alias("df1_terms"))
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    return n.join(F.broadcast(per_doc)).join(F.broadcast(vocab)).select(
        "n_docs", "n_tokens", "n_terms", (F.col("n_tokens") / F.col("n_docs")).alias("tokens_per_doc"), (F.col("all_terms") / F.col("n_docs")).alias("terms_per_doc"), "mean_term_length",
        F.col("s.tokens").alias("shortest_tokens"), F.col("s.terms").alias("shortest_terms"), F.col("l.tokens").alias("longest_tokens"), F.col("l.terms").alias("longest_terms"), "df1_terms",
    )


def extreme_postings(posts: DataFrame, k: int = 10) -> DataFrame:
    """The k highest and k lowest postings by tf, ties by document and term; two bounded heaps, no full sort."""
    high = posts.orderBy(F.desc("tf"), "doc_id", "term").limit(k).withColumn("side", F.lit("top"))
    return high.unionByName(posts.orderBy("tf", "doc_id", "term").limit(k).withColumn("side", F.lit("bottom")))


def ranked_terms(vocab: DataFrame) -> DataFrame:
    """rank, term, cf by falling cf, ties by term.

    The rank is by counts of each cf (a table as long as there are different cf) and a number within equal cf, so no
    task sees the whole vocabulary.
    """
    per = vocab.groupBy("cf").agg(F.count(F.lit(1)).alias("n"))
    before = per.select("cf", (F.sum("n").over(Window.orderBy(F.desc("cf")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("cf").orderBy("term"))
    return vocab.join(before, "cf").select((F.col("before") + within).alias("rank"), "term", "cf")


def zipf_fit(ranked: DataFrame) -> DataFrame:
    """alpha and c of cf = c * rank ^ alpha, by least squares on logarithms."""
    x, y = F.log("rank"), F.log("cf")
    return ranked.agg(F.regr_slope(y, x).alias("alpha"), F.exp(F.regr_intercept(y, x)).alias("c"))


def zipf_mass(ranked: DataFrame, share: float) -> DataFrame:
    """Predicted and actual tokens of the first floor(n * share) ranks."""
    n = ranked.agg(F.count(F.lit(1)).alias("n"))
    first = ranked.join(F.broadcast(n)).where(F.col("rank") <= F.floor(F.col("n") * share)).join(F.broadcast(zipf_fit(ranked)))
    return first.agg(F.sum(F.col("c") * F.pow("rank", "alpha")).alias("predicted"), F.sum("cf").alias("actual"))


def prune(ranked: DataFrame, share: float, stop_words: tuple[str, ...]) -> DataFrame:
    """The first floor(n * share) terms and whether each is a stop word."""
    n = ranked.agg(F.count(F.lit(1)).alias("n"))
    return ranked.join(F.broadcast(n)).where(F.col("rank") <= F.floor(F.col("n") * share)).select("rank", "term", F.col("term").isin(*stop_words).alias("is_stop"))


def heaps_growth(lines: DataFrame) -> DataFrame:
    """line_no, n_tokens, n_terms so far, of a table with line_no and terms; new terms are counted at their first line.

    The running sums are over one row a line, kept once, in ranges of lines.
    """
    shared.prepare(lines.sparkSession)
    words = lines.select("line_no", F.explode(F.array_distinct("terms")).alias("term"))
    new = words.groupBy("term").agg(F.min("line_no").alias("line_no")).groupBy("line_no").agg(F.count(F.lit(1)).alias("n_terms"))
    per = lines.select("line_no", F.size("terms").cast("long").alias("n_tokens")).join(new, "line_no", "left").na.fill(0, ["n_terms"]).checkpoint()
    return ordered.running(ordered.split(per, "line_no"), ["n_tokens", "n_terms"], "line_no").select("line_no", "n_tokens", "n_terms")


def heaps_fit(growth: DataFrame) -> DataFrame:
    """beta and k of terms = k * tokens ^ beta."""
    x, y = F.log("n_tokens"), F.log("n_terms")
    return growth.where("n_tokens > 0").agg(F.regr_slope(y, x).alias("beta"), F.exp(F.regr_intercept(y, x)).alias("k"))


def run_stats(runs: DataFrame) -> DataFrame:
    """Number, total, mean, upper median, least and most seconds of timed runs, and documents a second."""
    return runs.agg(
        F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("total"), F.avg("seconds").alias("mean"), F.element_at(F.sort_array(F.collect_list("seconds")), (F.floor(F.count(F.lit(1)) / 2) + 1).cast("int")).alias("median"),
        F.min("seconds").alias("least"), F.max("seconds").alias("most"), (F.sum("docs") / F.sum("seconds")).alias("docs_per_second"),
    )


def confusion(pairs: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Rows are true labels, columns predicted ones, zeros filled in; labels outside the list are dropped."""
    return pairs.where(F.col("truth").isin(*labels)).groupBy("truth").pivot("predicted", list(labels)).count().na.fill(0)
