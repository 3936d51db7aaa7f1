"""Effectiveness and correlation. ``run`` has qid, doc_id, rank; ``qrels`` has qid, doc_id, rel."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ordered


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run with rel (0 if not judged), relevant found so far, and the query's number of relevant documents."""
    upto = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = run.select("qid", "doc_id", "rank").join(qrels, ["qid", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    need = qrels.where("rel > 0").groupBy("qid").agg(F.count(F.lit(1)).alias("n_rel"))
    return rows.withColumn("found", F.sum((F.col("rel") > 0).cast("int")).over(upto)).join(need, "qid")


def per_query(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """qid, precision at k, average precision, nDCG at k (linear gain, the ideal order from the judgements)."""
    rows = judged(run, qrels)
    gain = F.col("rel") / F.log2(F.col("rank") + 1)
    own = rows.groupBy("qid").agg(
        (F.sum(F.when((F.col("rel") > 0) & (F.col("rank") <= k), 1).otherwise(0)) / k).alias("p_at_k"),
        (F.sum(F.when(F.col("rel") > 0, F.col("found") / F.col("rank")).otherwise(0.0)) / F.first("n_rel")).alias("ap"),
        F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias("dcg"),
    )
    ideal = qrels.where("rel > 0").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "doc_id"))).where(F.col("rank") <= k)
    ideal = ideal.groupBy("qid").agg(F.sum(gain).alias("idcg"))
    return own.join(ideal, "qid").select("qid", "p_at_k", "ap", (F.col("dcg") / F.col("idcg")).alias("ndcg"))


def overall(per: DataFrame) -> DataFrame:
    return per.agg(F.avg("p_at_k").alias("p_at_k"), F.avg("ap").alias("map"), F.avg("ndcg").alias("ndcg"))


def interpolated(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """qid, level (0 to 10 tenths), precision: the highest at that recall or beyond."""
    rows = judged(run, qrels).where("rel > 0").select("qid", (F.col("found") / F.col("rank")).alias("p"), (10 * F.col("found")).alias("f"), "n_rel")
    levels = rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(10)))).where("f >= level * n_rel").groupBy("qid", "level").agg(F.max("p").alias("precision"))
    frame = qrels.where("rel > 0").select("qid").distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(10))))
    return frame.join(levels, ["qid", "level"], "left").select("qid", "level", F.coalesce("precision", F.lit(0.0)).alias("precision"))


def summary(values: DataFrame, column: str) -> DataFrame:
    """Median, mean and mode (the smallest of the most frequent values)."""
    mode = values.groupBy(column).count().agg(F.min_by(column, F.struct(-F.col("count"), F.col(column))).alias("mode"))
    return values.agg(F.median(column).alias("median"), F.avg(column).alias("mean")).join(F.broadcast(mode))


def histogram(values: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """bin (from 0) and count over equal parts of the range, the last one closed."""
    ends = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    return values.join(F.broadcast(ends)).select(at.cast("long").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def correlation(pairs: DataFrame, x: str, y: str, parts: int = 200) -> DataFrame:
    """n, Pearson's r and Spearman's rho of two columns; average ranks for ties. Rows with a null in either are left out."""
    rows = pairs.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    ranked = rows.join(average_ranks(rows, "x", parts), "x").join(average_ranks(rows, "y", parts), "y")
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("pearson"), F.corr("x_rank", "y_rank").alias("spearman"))


def average_ranks(rows: DataFrame, c: str, parts: int = 200) -> DataFrame:
    """Each different value of a column with its average rank over all rows, as ``c``_rank.

    Values are counted first and cut into at most ``parts`` ranges at quantiles (that many numbers come to the driver).
    Ranks are exact wherever the cuts fall, and no task sorts more than a range.
    """
    values = rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    found = values.agg(F.percentile_approx(c, [k / parts for k in range(1, parts)], 10000)).first()[0]
    cuts = sorted(set(found or []))

    def place(low: int, high: int):
        """The number of cuts below the value, by halving."""
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col(c) <= cuts[mid], place(low, mid)).otherwise(place(mid + 1, high))

    values = values.withColumn("part", place(0, len(cuts)))
    sizes = values.groupBy("part").agg(F.sum("n").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy(c).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return values.join(F.broadcast(before), "part").select(c, (F.col("before") + within + (F.col("n") + 1) / 2).alias(f"{c}_rank"))


def position_correlation(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """qid, n, rho: Spearman's correlation of the document ids that two runs have at equal positions, for the first k of each."""
    first = a.where(F.col("rank") <= k).select("qid", "rank", F.col("doc_id").alias("x"))
    rows = first.join(b.where(F.col("rank") <= k).select("qid", "rank", F.col("doc_id").alias("y")), ["qid", "rank"])

    def ranked(c):
        return F.rank().over(Window.partitionBy("qid").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("qid", c)) - 1) / 2

    return rows.select("qid", ranked("x").alias("rx"), ranked("y").alias("ry")).groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("rho"))


def p_value(r: float, n: int) -> float:
    """Two-sided p of a correlation by Student's t with n - 2 degrees of freedom."""
    if n < 3 or math.isnan(r):
        return 1.0
    if abs(r) >= 1:
        return 0.0
    v = n - 2
    return _beta(v / 2, 0.5, v / (v + r * r * v / (1 - r * r)))


def _beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x in (0.0, 1.0):
        return x
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f = 0.0
    for k in range(300, 0, -1):
        m, odd = divmod(k, 2)
        d = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)) if odd else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        f = d / (1 + f)
    return front / (1 + f)


def strength(rho: F.Column) -> F.Column:
    a = F.abs(rho)
    size = F.when(a >= 0.7, "strong").when(a >= 0.5, "moderate").when(a >= 0.3, "weak").otherwise("very weak")
    return F.concat_ws(" ", size, F.when(rho > 0, "positive").otherwise("negative"))


def rank_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """k, percent: for each k the share of the first k of one ranking that are among the other's first k (item, rank).

    Ranks go from 1 without gaps, so equal ranges of them are summed apart.
    """
    both = a.join(b.withColumnRenamed("rank", "rank_b"), "item").select(F.greatest("rank", "rank_b").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    frame = a.select(F.col("rank").alias("k")).join(both, "k", "left").select("k", F.coalesce("n", F.lit(0)).alias("n"))
    summed = ordered.running(frame.withColumn("part", F.floor(F.col("k") / ordered.ROWS)), ["n"], "k")
    return summed.select("k", (100.0 * F.col("n") / F.col("k")).alias("percent"))
