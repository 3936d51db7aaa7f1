"""Ranked retrieval. ``queries`` has qid, term, qtf and is small, so it is broadcast where Spark finds it so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import index


def top(scored: DataFrame, k: int) -> DataFrame:
    """rank 1..k of each query by score, ties to the larger doc_id; scores are compared rounded to 9 digits."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("doc_id")))
    return scored.withColumn("score", F.round("score", 9)).withColumn("rank", rank).where(F.col("rank") <= k)


def matches(posts: DataFrame, queries: DataFrame) -> DataFrame:
    return posts.join(queries, "term")


def cosine(posts: DataFrame, queries: DataFrame, k: int, norms_of: DataFrame | None = None) -> DataFrame:
    """Raw counts, norms over whole documents and over the query's terms that the vocabulary has.

    posts may hold the query's terms only where ``norms_of`` has the postings of all.
    """
    hits = matches(posts, queries).groupBy("qid", "doc_id").agg(F.sum(F.col("qtf") * F.col("tf")).alias("dot"))
    known = queries.join(posts.select("term").distinct(), "term", "left_semi")
    norms = known.groupBy("qid").agg(F.sqrt(F.sum(F.col("qtf") * F.col("qtf"))).alias("qnorm"))
    scored = hits.join(index.doc_stats(norms_of if norms_of is not None else posts).select("doc_id", "norm"), "doc_id").join(norms, "qid")
    return top(scored.select("qid", "doc_id", (F.col("dot") / (F.col("qnorm") * F.col("norm"))).alias("score")), k)


def overlap(posts: DataFrame, queries: DataFrame, k: int, by_position: bool = False) -> DataFrame:
    """Number of query entries in the document; ties to the larger doc_id, or (``by_position``) to the earlier query term."""
    hits = matches(posts, queries).groupBy("qid", "doc_id").agg(F.sum("qtf").cast("double").alias("score"), F.min("pos").alias("pos"))
    if not by_position:
        return top(hits.drop("pos"), k)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "pos", "doc_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).drop("pos")


def tfidf(posts: DataFrame, n_docs: int) -> DataFrame:
    vocab = index.vocabulary(posts).select("term", "df")
    return posts.join(vocab, "term").withColumn("weight", (1 + F.log("tf")) * F.log(F.lit(float(n_docs)) / (F.col("df") + 1e-10)))


def vector_search(posts: DataFrame, queries: DataFrame, n_docs: int, k: int) -> DataFrame:
    """Query weights with idf over df + 1; the document's norm is over the query's terms only."""
    weights = tfidf(posts.join(queries.select("term").distinct(), "term", "left_semi"), n_docs)
    df = weights.where("weight > 0").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = queries.join(posts.select("term").distinct(), "term", "left_semi").join(df, "term", "left")
    q = known.withColumn("qw", (1 + F.log("qtf")) * F.log(F.lit(float(n_docs)) / (F.coalesce("df", F.lit(0)) + 1))).select("qid", "term", "qw")
    qnorm = q.groupBy("qid").agg(F.sqrt(F.sum(F.round(F.col("qw") * F.col("qw"), 12))).alias("qnorm"))
    hits = weights.where("weight > 0").select("term", "doc_id", "weight").join(q, "term").groupBy("qid", "doc_id").agg(F.sum(F.col("qw") * F.col("weight")).alias("dot"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("dnorm"))
    one = lambda c: F.when(F.col(c) == 0, 1.0).otherwise(F.col(c))
    return top(hits.join(qnorm, "qid").select("qid", "doc_id", (F.col("dot") / (one("qnorm") * one("dnorm"))).alias("score")), k)


def _sums(posts: DataFrame, queries: DataFrame, formulas: dict[str, Column], lengths: DataFrame | None) -> DataFrame:
    """qid, doc_id and sums of formulas over df, cf, tf, qtf, dl and the collection's n, tokens, avdl (one row, broadcast).

    posts may hold the queries' terms only where ``lengths`` (doc_id, dl, of all documents with terms) is given: then no
    other posting is made. Postings are dealt out by document before they meet the queries, which are broadcast with their
    terms' counts, so what is dealt out does not grow with the number of queries.
    """
    stats = posts.groupBy("doc_id").agg(F.sum("tf").alias("dl")) if lengths is None else lengths
    whole = stats.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("tokens"), F.avg("dl").alias("avdl"))
    terms = posts.join(queries.select("term").distinct(), "term", "left_semi")
    known = queries.join(index.vocabulary(terms), "term")
    rows = terms.join(stats, "doc_id").join(F.broadcast(known), "term").join(F.broadcast(whole))
    return rows.groupBy("qid", "doc_id").agg(*[F.sum(f).alias(name) for name, f in formulas.items()])


def _scored(posts: DataFrame, queries: DataFrame, formula: Column, k: int, lengths: DataFrame | None) -> DataFrame:
    return top(_sums(posts, queries, {"score": formula}, lengths), k)


def runs(posts: DataFrame, queries: DataFrame, formulas: dict[str, Column], k: int, lengths: DataFrame | None = None) -> DataFrame:
    """run (the formula's name), qid, doc_id, score, rank 1..k by each of several formulas, from one pass over the postings."""
    scored = _sums(posts, queries, formulas, lengths)
    each = scored.select("qid", "doc_id", F.explode(F.array(*[F.struct(F.lit(name).alias("run"), F.round(name, 9).alias("score")) for name in formulas])).alias("x")).select("x.run", "qid", "doc_id", "x.score")
    rank = F.row_number().over(Window.partitionBy("run", "qid").orderBy(F.desc("score"), F.desc("doc_id")))
    return each.withColumn("rank", rank).where(F.col("rank") <= k)


K1, B, K3, LAMBDA = 1.2, 0.75, 8.0, 0.15


def bm25_formula() -> Column:
    c = F.col
    idf = F.log2((c("n") - c("df") + 0.5) / (c("df") + 0.5))
    return (K3 + 1) * c("qtf") / (K3 + c("qtf")) * c("tf") / (c("tf") + K1 * (1 - B + B * c("dl") / c("avdl"))) * idf


def robertson_formula() -> Column:
    c = F.col
    return c("qtf") * K1 * c("tf") / (c("tf") + K1 * (1 - B + B * c("dl") / c("avdl"))) * F.log2(c("n") / c("df") + 1)


def bm25(posts: DataFrame, queries: DataFrame, k: int, lengths: DataFrame | None = None) -> DataFrame:
    return _scored(posts, queries, bm25_formula(), k, lengths)


def tfidf_robertson(posts: DataFrame, queries: DataFrame, k: int, lengths: DataFrame | None = None) -> DataFrame:
    return _scored(posts, queries, robertson_formula(), k, lengths)


def hiemstra(posts: DataFrame, queries: DataFrame, k: int, lengths: DataFrame | None = None) -> DataFrame:
    c = F.col
    return _scored(posts, queries, c("qtf") * F.log2(1 + LAMBDA * c("tf") * c("tokens") / ((1 - LAMBDA) * c("cf") * c("dl"))), k, lengths)
