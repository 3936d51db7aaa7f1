"""Language identification by correlation of n-gram counts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grams as counting
from ..functions import text

PROFILE = 1_000_000  # grams of all profiles that go to every task


def profile(grams: DataFrame) -> DataFrame:
    """lang, gram, cnt of a table with lang and grams."""
    return grams.select("lang", F.explode("grams").alias("gram")).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("cnt"))


def line_profile(lines: DataFrame, n: int) -> DataFrame:
    """lang, gram, cnt of a table with lang and line, n 1 or 2: counted a piece of text at a time, so few rows are dealt out."""
    return lines.select("lang", "line").mapInArrow(counting.profile(n), "lang string, gram string, cnt long").groupBy("lang", "gram").agg(F.sum("cnt").alias("cnt"))


def _r(n, sx, sxx, sy, syy, sxy):
    """Pearson's correlation from sums, to 10 digits; null where a side does not vary."""
    d = lambda c: c.cast("double")
    under = (n * d(sxx) - d(sx) * d(sx)) * (n * d(syy) - d(sy) * d(sy))
    return F.round(F.when(under > 0, (n * d(sxy) - d(sx) * d(sy)) / F.sqrt(under)), 10)


def identify_lines(lines: DataFrame, n: int) -> DataFrame:
    """``identify`` of a table with doc_id, lang and line by the profiles of its own languages, n 1 or 2.

    A document of one row is compared with all profiles where it is read, and nothing of it is dealt out. Documents of
    several rows, and all where the profiles are too long to send to every task, go through ``identify``.
    """
    spread = lambda rows: rows.select("doc_id", "lang", text.char_ngrams(F.col("line"), n).alias("grams"))
    found = line_profile(lines, n).where("lang IS NOT NULL").limit(PROFILE + 1).collect()
    if len(found) > PROFILE:
        return identify(spread(lines), line_profile(lines, n))
    langs, place = sorted({r.lang for r in found}), {}
    for r in found:
        place.setdefault(r.gram, len(place))
    at, counts = {name: k for k, name in enumerate(langs)}, np.zeros((len(place) + 1, len(langs)), np.int64)
    for r in found:
        counts[place[r.gram], at[r.lang]] = r.cnt
    if not langs:
        return lines.select("doc_id", F.lit(None).cast("string").alias("lang_pred")).where("false")
    kind = lines.schema["doc_id"].dataType.simpleString()
    repeated = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("doc_id").alias("again"))
    several = not repeated.isEmpty()
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    once = lines.join(repeated, same, "left_anti") if several else lines
    rows = once.select("doc_id", "line").mapInArrow(counting.sums(n, place, counts), f"doc_id {kind}, sx long, sxx long, nx long, sxy array<long>, nxy array<long>")
    sy, syy, ny = ([int(v) for v in x] for x in (counts.sum(0), (counts.astype(object) ** 2).sum(0), (counts > 0).sum(0)))
    known = lambda x, k: F.get(F.array(*[F.lit(v).cast("long") for v in x]), k)

    def one(sxy, k):
        r = _r(F.col("nx") + known(ny, k) - F.get("nxy", k), F.col("sx"), F.col("sxx"), known(sy, k), known(syy, k), sxy)
        return F.struct(r.alias("r"), (-k).alias("k"))

    best = F.array_max(F.filter(F.transform("sxy", one), lambda x: x["r"] > -1))
    out = rows.select("doc_id", best.alias("best")).where("best IS NOT NULL").select("doc_id", F.get(F.array(*[F.lit(x) for x in langs]), -F.col("best.k")).alias("lang_pred"))
    if not several:
        return out
    return out.unionByName(identify(spread(lines.join(repeated, same, "left_semi")), line_profile(lines, n)))


def identify(grams: DataFrame, profiles: DataFrame) -> DataFrame:
    """doc_id, lang_pred: the profile of the highest Pearson correlation over the union of both sides' n-grams.

    The union is never built: with missing counts 0, r follows from the sums of both sides, of the products of common
    n-grams, and the union's size. A correlation that is not above -1 gives null; ties go to the first by name.
    """
    own = grams.select("doc_id", F.explode("grams").alias("gram")).groupBy("doc_id", "gram").agg(F.count(F.lit(1)).alias("x"))
    left = own.groupBy("doc_id").agg(F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.count(F.lit(1)).alias("nx"))
    right = profiles.groupBy("lang").agg(F.sum("cnt").alias("sy"), F.sum(F.col("cnt") * F.col("cnt")).alias("syy"), F.count(F.lit(1)).alias("ny"))
    common = own.join(profiles, "gram").groupBy("doc_id", "lang").agg(F.sum(F.col("x") * F.col("cnt")).alias("sxy"), F.count(F.lit(1)).alias("nxy"))
    common = common.select(F.col("doc_id").alias("d"), F.col("lang").alias("l"), "sxy", "nxy")
    c = F.col
    pairs = left.join(F.broadcast(right.where("lang IS NOT NULL"))).join(common, c("doc_id").eqNullSafe(c("d")) & (c("lang") == c("l")), "left").na.fill(0, ["sxy", "nxy"])
    rows = pairs.select("doc_id", "lang", _r(c("nx") + c("ny") - c("nxy"), c("sx"), c("sxx"), c("sy"), c("syy"), c("sxy")).alias("r")).where("r > -1")
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("r"), "lang"))
    return rows.withColumn("k", best).where("k = 1").select("doc_id", F.col("lang").alias("lang_pred"))
