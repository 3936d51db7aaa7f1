"""Term counts over a stream of documents; the same tokeniser as in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vocabulary(docs: DataFrame, terms: Column) -> DataFrame:
    """term, cf of all documents so far, for a sink in complete or update mode."""
    return docs.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("cf"))
