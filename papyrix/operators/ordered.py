"""Row numbers, following values and running sums in a global order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS = 250_000  # rows of a part, about
PARTS = 512  # at most


def _before(order: list[str], cut) -> Column:
    """Whether a row comes before a cut; nulls last."""
    name, value = order[0], cut[0]
    less = F.col(name).isNotNull() if value is None else F.coalesce(F.col(name) < F.lit(value), F.lit(False))
    return less | (F.col(name).eqNullSafe(F.lit(value)) & _before(order[1:], cut[1:])) if len(order) > 1 else less


def split(rows: DataFrame, *order: str) -> DataFrame:
    """rows with ``part`` (from 0): ranges of the ascending order, nulls last; equal keys share one.

    Ranges are cut at keys of a random few thousand rows, as Spark's own ranges are; what follows holds wherever they fall.
    """
    keys = rows.select(*[F.unix_micros(c).alias(c) if t == "timestamp" else F.col(c) for c, t in rows.select(*order).dtypes])
    n = rows.count()
    parts = min(PARTS, -(-n // ROWS))
    if parts < 2:
        return rows.withColumn("part", F.lit(0))
    seen = keys.sample(min(1.0, 40 * parts / n), 0).orderBy(*[F.col(c).asc_nulls_last() for c in order]).collect()
    cuts = list(dict.fromkeys(tuple(seen[len(seen) * k // parts]) for k in range(1, parts))) if seen else []
    names = [f"_{k}" for k in range(len(order))]

    def place(low: int, high: int) -> Column:
        """The number of cuts that don't come after the row, by halving."""
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(_before(names, cuts[mid]), place(low, mid)).otherwise(place(mid + 1, high))

    named = rows.withColumns({x: F.unix_micros(c) if t == "timestamp" else F.col(c) for x, (c, t) in zip(names, rows.select(*order).dtypes)})
    return named.withColumn("part", place(0, len(cuts))).drop(*names)


def _within(order: tuple[str, ...]):
    return Window.partitionBy("part").orderBy(*[F.col(c).asc_nulls_last() for c in order])


def _sums_before(per: DataFrame, names: list[str]) -> DataFrame:
    """Sums over smaller parts, of a table of one row a part."""
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(per.select("part", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"_{c}") for c in names]))


def number(parted: DataFrame, name: str, *order: str) -> DataFrame:
    """A table of ``split`` with each row's number (from 1) in the order."""
    before = _sums_before(parted.groupBy("part").agg(F.count(F.lit(1)).alias("n")), ["n"])
    return parted.withColumn(name, F.row_number().over(_within(order))).join(before, "part").withColumn(name, F.col(name) + F.col("_n")).drop("_n", "part")


def running(parted: DataFrame, names: list[str], *order: str) -> DataFrame:
    """A table of ``split`` with whole-number columns replaced by their sums up to each row; the order has no ties."""
    before = _sums_before(parted.groupBy("part").agg(*[F.sum(c).alias(c) for c in names]), names)
    upto = _within(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = parted.withColumns({c: F.sum(c).over(upto) for c in names}).join(before, "part")
    return rows.withColumns({c: F.col(c) + F.col(f"_{c}") for c in names}).drop("part", *[f"_{c}" for c in names])


def following(parted: DataFrame, value: str, name: str, *order: str) -> DataFrame:
    """A table of ``split`` with a column's value in the next row, null in the last; ties are taken in the order of the value."""
    order = (*order, value)
    first = F.struct(*[x for c in order for x in (F.col(c).isNull(), F.col(c))])
    heads = parted.groupBy("part").agg(F.min_by(F.struct(value), first).alias("head"))
    heads = heads.select("part", F.lead("head").over(Window.orderBy("part")).alias("head"))
    rows = parted.withColumn(name, F.lead(F.struct(value)).over(_within(order))).join(F.broadcast(heads), "part")
    return rows.withColumn(name, F.coalesce(name, "head")[value]).drop("head", "part")
