"""Language identification by rank order: a document's most frequent n-grams against each language's profile.

N-grams are of 1 to 3 letters of lower-cased words, word ends included. A document's distance to a language is the sum,
over its most frequent n-grams, of how far each is out of place in the profile; one that the profile lacks counts PROFILE.

Defined results: a null text, or one without letters, is ``und`` with score 0, as is every text when nothing could be
learned; of languages at the same distance the first by code point wins; a null doc_id is not held out; repeated rows
are predicted one by one; an empty table gives an empty result; other columns of documents may have any names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

PROFILE = 400  # n-grams in a profile and, at most, of a document that are compared
LEARN = 4000  # documents of a language, about, that its profile is learned from, picked by a hash of id and text
BROADCAST = 200_000  # languages whose sizes are broadcast, at most
UND = "und"

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point, that of its lower-case letter, or 1 if it is no letter."""
    global _letters
    if _letters is None:
        _letters = np.array([ord(c.lower()[0]) if (c := chr(p)).isalpha() else 1 for p in range(0x110000)], np.uint64)
    return _letters


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The text's n-grams as packed code points, in ascending order, and their counts."""
    if not text:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    c = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    c = np.concatenate(([1], c, [1])).astype(np.uint64)
    c = c[np.concatenate(([True], (c[1:] != 1) | (c[:-1] != 1)))]
    if len(c) < 3:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    two = c[:-1] << np.uint64(21) | c[1:]
    three = (two[:-1] << np.uint64(21) | c[2:])[c[1:-1] != 1]
    return np.unique(np.concatenate((c[c != 1], two, three)), return_counts=True)


def top(keys: np.ndarray, counts: np.ndarray, n: int = PROFILE) -> np.ndarray:
    """The n most frequent, most frequent first, ties to the smaller n-gram."""
    if len(keys) > n:
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.argsort(-counts, kind="stable")[:n]]


class Profiles:
    def __init__(self, ranked: dict[str, list[int]]):
        """ranked: each language's n-grams, most frequent first."""
        self.names = sorted(ranked)
        self.keys = np.unique(np.array([g for x in ranked.values() for g in x], np.uint64))
        self.rank = np.full((len(self.names), len(self.keys) + 1), -1, np.int64)
        for k, name in enumerate(self.names):
            self.rank[k, np.searchsorted(self.keys, np.array(ranked[name], np.uint64))] = np.arange(len(ranked[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = top(*grams(text))
        if not len(own) or not self.names:
            return UND, 0.0
        at = np.searchsorted(self.keys, own)
        at = np.where(self.keys[np.minimum(at, len(self.keys) - 1)] == own, at, len(self.keys))
        found = self.rank[:, at]
        far = np.where(found < 0, PROFILE, np.minimum(np.abs(found - np.arange(len(own))), PROFILE)).sum(axis=1)
        best = int(far.argmin())
        return self.names[best], 1.0 - float(far[best]) / (PROFILE * len(own))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def learn(docs: DataFrame) -> Profiles:
    """Profiles of all languages of documents that are not held out. The driver gets PROFILE n-grams of each language."""
    common.arrow_batches(docs.sparkSession)
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    sizes, _ = common.stage(known.groupBy("lang").count(), "languages")
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST else sizes
    share = F.least(F.lit(1.0), F.lit(float(LEARN)) / F.col("count")) * (1 << 30)
    picked = known.join(sizes, "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share).select("lang", "text")

    def run(batches):
        import pyarrow as pa

        common.claim("profiles", lambda: None)
        for batch in batches:
            parts: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts.setdefault(lang, []).append(grams(text.as_py()))
            for lang, own in parts.items():
                keys, back = np.unique(np.concatenate([k for k, _ in own]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([c for _, c in own]), len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts)], ["lang", "gram", "n"])

    counted = picked.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counted.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("k") <= PROFILE)
    out: dict[str, list[int]] = {}
    for r in sorted(ranked.select("lang", "k", "gram").collect()):
        out.setdefault(r.lang, []).append(r.gram)
    return Profiles(out)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred and score of every document, from its text alone."""

    def run(batches):
        import pyarrow as pa

        common.claim("profiles", lambda: None)
        for batch in batches:
            said = [profiles.predict(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())], ["doc_id", "lang_pred", "score"])

    common.arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, profiles: Profiles, least: float = 0.0) -> DataFrame:
    """The rows whose language is found with a score of ``least`` or more, ``lang`` set to it; other columns as they are."""
    names = docs.columns
    at = [names.index("text"), names.index("lang")]

    def run(batches):
        import pyarrow as pa

        common.claim("profiles", lambda: None)
        for batch in batches:
            said = [profiles.predict(x.as_py()) for x in batch.column(at[0])]
            columns = list(batch.columns)
            columns[at[1]] = pa.array([x for x, _ in said], pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array([x != UND and s >= least for x, s in said], pa.bool_()))

    common.arrow_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return predict(docs, learn(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
