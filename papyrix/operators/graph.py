"""Link graphs: crawl simulation, PageRank, HITS, neighbourhoods. Edges have src and dst."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import shared


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 8) -> DataFrame:
    """node, score after a fixed number of rounds; uniform start and teleport, dangling mass spread uniformly.

    Each round is one join on the source and one aggregation on the target; lineage is cut by reliable checkpoints.
    """
    shared.prepare(edges.sparkSession)
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    links = edges.join(degree, "src").checkpoint()
    everyone = nodes(edges).checkpoint()
    n = everyone.count()
    score = everyone.withColumn("score", F.lit(1.0 / max(n, 1)))
    for k in range(rounds):
        given = links.join(score.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") / F.col("out")).alias("in"))
        moved = given.agg(F.coalesce(F.sum("in"), F.lit(0.0)).alias("moved"))
        score = everyone.join(given, "node", "left").join(F.broadcast(moved)).select("node", ((1 - alpha) / n + alpha * (F.coalesce("in", F.lit(0.0)) + (1 - F.col("moved")) / n)).alias("score"))
        if k % 4 == 3:
            score = score.checkpoint()
    return score


def hits(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """node, authority, hub after a fixed number of rounds, each summing to 1."""
    shared.prepare(edges.sparkSession)
    edges = edges.checkpoint()
    everyone = nodes(edges).checkpoint()
    hub = everyone.withColumn("hub", F.lit(1.0))
    authority = None

    def spread(values: DataFrame, column: str, from_: str, to: str, name: str) -> DataFrame:
        got = edges.join(values.withColumnRenamed("node", from_), from_).groupBy(F.col(to).alias("node")).agg(F.sum(column).alias("v"))
        total = got.agg(F.sum("v").alias("t"))
        return everyone.join(got, "node", "left").join(F.broadcast(total)).select("node", F.coalesce(F.col("v") / F.col("t"), F.lit(0.0)).alias(name))

    for k in range(rounds):
        authority = spread(hub, "hub", "src", "dst", "authority")
        if k % 2:
            authority = authority.checkpoint()
        hub = spread(authority, "authority", "dst", "src", "hub")
    return authority.join(hub, "node")


def khop(edges: DataFrame, node, hops: int = 2) -> DataFrame:
    """Nodes within some hops of one, in either direction, with the least number of hops."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    near = both.where(F.col("src") == node).select(F.col("dst").alias("node"), F.lit(1).alias("hops"))
    reached, last = near, near
    for k in range(2, hops + 1):
        last = last.join(both, last["node"] == both["src"]).select(F.col("dst").alias("node"), F.lit(k).alias("hops")).distinct()
        reached = reached.unionByName(last)
    return reached.where(F.col("node") != node).groupBy("node").agg(F.min("hops").alias("hops"))


def crawl(pages: DataFrame, links: DataFrame, seeds: DataFrame, max_depth: int, per_seed: int | None = None, total: int | None = None, start_depth: int = 0) -> tuple[DataFrame, DataFrame]:
    """Breadth-first crawl over stored pages, one level at a time: (visited url, depth, origin, seq; edges src, dst).

    pages has url, links src and dst, seeds url and seq. Each level is a join of the frontier with links, an anti join with
    what was visited, and the caps in the order of the queue. A page at its seed's cap adds no edges.
    """
    shared.prepare(pages.sparkSession)
    fetched = pages.select("url").distinct()
    front = seeds.select("url", "seq", F.col("url").alias("origin")).dropDuplicates(["url"])
    visited = edges = None
    for depth in range(start_depth, max_depth + 1):
        if visited is not None:
            front = front.join(visited.select("url"), "url", "left_anti")
        found = front.join(fetched, "url", "left_semi").withColumn("depth", F.lit(depth))
        if per_seed is not None:
            order = Window.partitionBy("origin").orderBy("seq", "url")
            found = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_seed)  # a bound that Spark takes before it deals out
            if visited is not None:
                before = visited.groupBy("origin").agg(F.count(F.lit(1)).alias("had"))
                found = found.join(before, "origin", "left").withColumn("nth", F.col("nth") + F.coalesce("had", F.lit(0))).where(F.col("nth") <= per_seed)
        if total is not None:
            have = visited.count() if visited is not None else 0
            found = found.orderBy("seq", "url").limit(max(0, total - have))
        found = found.select("url", "depth", "origin", "seq", *(["nth"] if per_seed is not None else [])).checkpoint()
        visited = found if visited is None else visited.unionByName(found).checkpoint()
        open_ = found if per_seed is None else found.where(F.col("nth") < per_seed)
        out = open_.join(links.select(F.col("src").alias("url"), "dst").distinct(), "url")
        new_edges = out.select(F.col("url").alias("src"), "dst")
        edges = new_edges if edges is None else edges.unionByName(new_edges)
        queue = out.select(F.col("dst").alias("next"), "origin", F.struct("seq", F.col("dst").alias("d")).alias("o"))
        first = queue.groupBy("next").agg(F.min(F.struct("o", "origin")).alias("m"))
        front = first.select(F.col("next").alias("url"), F.col("m.o.seq").alias("seq"), F.col("m.origin").alias("origin"))
    return visited.select("url", "depth", "origin", "seq"), edges.distinct()


def subgraph(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges whose two ends are among kept (url)."""
    return edges.join(kept.select(F.col("url").alias("src")), "src", "left_semi").join(kept.select(F.col("url").alias("dst")), "dst", "left_semi").select("src", "dst")


def depth_distribution(visited: DataFrame, max_depth: int) -> DataFrame:
    """depth, pages, share for each depth from 0, empty ones included."""
    frame = visited.sparkSession.range(max_depth + 1).select(F.col("id").cast("int").alias("depth"))
    per = frame.join(visited.groupBy("depth").agg(F.count(F.lit(1)).alias("n")), "depth", "left").select("depth", F.coalesce("n", F.lit(0)).alias("pages"))
    return per.withColumn("share", F.col("pages") / F.sum("pages").over(Window.partitionBy()))
