"""Mixing sources to target weights by dependent rounding, in DataFrame operations only.

Every document of a source should be taken target / source_size times on average: whole copies, and one more with the
fractional probability. Pivotal rounding settles the fractions: of two open documents it moves words from one to the
other, at random and without bias, until one of them is at 0 or 1; the other goes on. Documents meet in random groups
of about FAN; each group leaves one open document, and those meet again in a FAN times smaller number of groups, a
reduction tree whose last group of each source leaves one, which goes to the nearer end. So a source's taken words differ
from its target by half of one document at most, and no group grows with a source.

Defined results: a null text has size 0 and is taken 0 words; a null source is a source of its own, ordered last;
repeated rows are told apart by a running number and rounded one by one; an empty table gives an empty result; other
columns of documents may have any names. All random draws are hashes of ids, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3  # times its size that a source, or a document, can be taken
FAN = 24
SEED = 20240229


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target of every source: weights 1, 2, 3, repeating by code point, share all sizes.

    A target stops at MOST times its source's size and the excess goes to the others by weight: with sources in the
    order of size / weight, those up to some place stop, and the rest share what is left. The table has a row a source.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    weighed = sums.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", (F.col("rank") - 1) % 3 + 1)
    all_ = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    shared = (
        weighed.withColumn("total", F.sum("source_size").over(all_))
        .withColumn("stopped", MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.col("total") - F.col("stopped")) / F.col("left_weight"))  # words a unit of weight if only those before stop
        .withColumn("goes_on", F.col("level") * F.col("weight") <= MOST * F.col("source_size"))
        .withColumn("final", F.min(F.when(F.col("goes_on"), F.struct(F.col("source_size") / F.col("weight"), "rank", "level"))).over(all_)["level"])
    )
    stop = (MOST * F.col("source_size")).cast("double")
    return shared.select("source", "source_size", F.when(F.col("final").isNull(), stop).otherwise(F.least(stop, F.col("final") * F.col("weight"))).alias("target"))


def _uniform(*columns) -> Column:
    """In [0, 1), from a hash."""
    return F.pmod(F.xxhash64(*columns, F.lit(SEED)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _pivot(members: Column) -> Column:
    """Fold a group's open documents (doc_id, rep, size, p): the settled ones, and the open one that is left, if any."""
    kind = "struct<open:struct<doc_id:bigint,rep:bigint,size:bigint,p:double>,done:array<struct<doc_id:bigint,rep:bigint,size:bigint,take:int>>>"

    def meet(state, new):
        old = state["open"]
        up = F.least((1 - old["p"]) * old["size"], new["p"] * new["size"])  # words that old can gain from new
        down = F.least(old["p"] * old["size"], (1 - new["p"]) * new["size"])
        gains = _uniform(old["doc_id"], old["rep"], new["doc_id"], new["rep"]) * (up + down) < down
        moved = F.when(gains, up).otherwise(-down)
        # the one whose room was the smaller is settled, exactly; compared again so that rounding can't leave both open
        old_full, old_empty = gains & ((1 - old["p"]) * old["size"] <= new["p"] * new["size"]), ~gains & (old["p"] * old["size"] <= (1 - new["p"]) * new["size"])
        settled = F.when(old_full | old_empty, F.struct(old["doc_id"].alias("doc_id"), old["rep"].alias("rep"), old["size"].alias("size"), old_full.cast("int").alias("take")))
        settled = settled.otherwise(F.struct(new["doc_id"].alias("doc_id"), new["rep"].alias("rep"), new["size"].alias("size"), (~gains).cast("int").alias("take")))
        still_new = F.struct(new["doc_id"].alias("doc_id"), new["rep"].alias("rep"), new["size"].alias("size"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), new["p"] - moved / new["size"])).alias("p"))
        still_old = F.struct(old["doc_id"].alias("doc_id"), old["rep"].alias("rep"), old["size"].alias("size"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), old["p"] + moved / old["size"])).alias("p"))
        open_ = F.when(old_full | old_empty, still_new).otherwise(still_old)
        return F.when(old.isNull(), F.struct(new.alias("open"), state["done"].alias("done"))).otherwise(
            F.struct(open_.alias("open"), F.concat(state["done"], F.array(settled)).alias("done"))
        ).cast(kind)

    return F.aggregate(members, F.struct(F.lit(None).alias("open"), F.array().alias("done")).cast(kind), meet)


def copies(sized: DataFrame) -> DataFrame:
    """doc_id, rep, size, source, source_size, target, copies of a table with doc_id, source, size (read twice: stage it)."""
    shares, _ = common.stage(targets(sized).withColumn("x", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)), "targets")
    counted = sized.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"))  # a row repeated very often is one row here
    joined = counted.withColumn("_s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).join(
        shares.withColumn("_s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source"), "_s"
    )
    rows = joined.select("source", "doc_id", "size", "source_size", "target", "x", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("rep"))
    rows, _ = common.stage(rows.withColumn("p", F.col("x") - F.floor("x")), "mix")
    open_ = (F.col("p") > 0) & (F.col("size") > 0)
    done = [rows.where(~open_).select("doc_id", "rep", "size", "source", F.lit(0).alias("take"))]
    level = rows.where(open_).select("source", F.struct("doc_id", "rep", "size", "p").alias("m"))
    most = level.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    sizes = level.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    key = lambda d: d.withColumn("_s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    step, depth = FAN, 0
    level = key(level).join(key(sizes).drop("source"), "_s").drop("_s")
    while most > 0:
        groups = F.ceil(F.col("n") / F.lit(step))
        met = level.withColumn("g", F.pmod(F.xxhash64(F.col("m")["doc_id"], F.col("m")["rep"], F.lit(SEED + depth)), groups)).groupBy("source", "g").agg(
            F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct(_uniform(F.col("m")["doc_id"], F.col("m")["rep"], F.lit(depth)).alias("o"), F.col("m").alias("m")))).alias("members")
        )
        met, _ = common.stage(met.select("source", "n", _pivot(F.transform("members", lambda x: x["m"])).alias("r")), f"level{depth}")
        done.append(met.select("source", F.explode("r.done").alias("d")).select("d.doc_id", "d.rep", "d.size", "source", "d.take"))
        level = met.select("source", "n", F.col("r.open").alias("m"))
        if step >= most:
            break
        step, depth = step * FAN, depth + 1
    last = level.select("m.doc_id", "m.rep", "m.size", "source", (F.col("m.p") >= 0.5).cast("int").alias("take")) if most else None
    taken = done[0]
    for part in [*done[1:], *([last] if most else [])]:
        taken = taken.unionByName(part)
    out = key(taken).join(key(shares).drop("source"), "_s").drop("_s")
    return out.select("doc_id", "rep", "size", "source", "source_size", "target", (F.floor("x") + F.col("take")).cast("long").alias("copies"))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"))


def mix(docs: DataFrame) -> DataFrame:
    """The decision for each row of documents."""
    return copies(common.stage(sized(docs), "sizes")[0])


def apply(docs: DataFrame) -> DataFrame:
    """Documents, each row as often as the mix takes it; one shuffle of the texts, by (doc_id, source, size).

    Rows equal in these are numbered by their text, then by a hash of their other columns (but maps), so reruns agree.
    """
    keys = ["_doc", "_source", "_size"]
    plain = [c for c in docs.columns if c != "text" and "map<" not in dict(docs.dtypes)[c]]
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64(*[F.col(f"`{c}`") for c in plain]).alias("_hash"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_doc"), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("_source"), word_count(F.col("text")).alias("_size"),
    )
    own = own.withColumn("_rep", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_row")["text"], "_hash")).cast("long"))
    chosen = mix(docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_doc"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_source"), F.col("size").alias("_size"), F.col("rep").alias("_rep"), "copies").where("copies > 0")
    return own.join(chosen, [*keys, "_rep"]).withColumn("_c", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("_row.*")


def op1_source_mixing(spark, sf_dir: str) -> DataFrame:
    made = mix(common.table(spark, sf_dir, "documents"))
    return made.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
