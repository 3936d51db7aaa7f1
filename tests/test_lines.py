"""Languages by whole lines against plain Python and the general operator; two runs from one pass against two."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from papyrix.functions import text
from papyrix.operators import correlate, index, rank

DOCS = [(1, "en", "thecatandthedog"), (2, "es", "elperroyelgato"), (3, "de", "derhundunddiekatze"), (4, "en", ""), (5, "es", "zzzzzzzzzz"), (6, None, "qqñ𐐷qq"), (7, "de", "d"), (8, "fr", "lechienetlechat"), (8, "fr", "unautrechien"), (None, "en", "adog"), (None, "es", "ungato"), (9, "en", "thethethe" * 300)]


def _want(n):
    counts = lambda s: Counter(s[k : k + n] for k in range(len(s) - n + 1))
    profiles, docs = {}, {}
    for k, lang, line in DOCS:
        if lang is not None:
            profiles.setdefault(lang, Counter()).update(counts(line))
        docs.setdefault(k, Counter()).update(counts(line))
    out = {}
    for k, x in docs.items():
        best = None
        for lang in sorted(profiles) if x else ():
            y, keys = profiles[lang], x.keys() | profiles[lang].keys()
            m, sx, sy = len(keys), sum(x.values()), sum(y.values())
            under = (m * sum(v * v for v in x.values()) - sx * sx) * (m * sum(v * v for v in y.values()) - sy * sy)
            if under > 0 and (r := round((m * sum(x[g] * y[g] for g in keys) - sx * sy) / under**0.5, 10)) > -1 and (best is None or r > best[0]):
                best = r, lang
        if best:
            out[k] = best[1]
    return out


@pytest.mark.parametrize("n", [1, 2])
def test_languages_of_lines(spark, n, monkeypatch):
    lines = spark.createDataFrame(DOCS, "doc_id long, lang string, line string").repartition(3)
    assert {r.doc_id: r.lang_pred for r in correlate.identify_lines(lines, n).collect()} == _want(n)
    once = lines.where("doc_id <> 8")
    # one row a document: nothing is spread to grams
    assert "regexp_extract_all" not in correlate.identify_lines(once, n)._jdf.queryExecution().toString()
    monkeypatch.setattr(correlate, "PROFILE", 3)
    plain = lines.where("line NOT LIKE '%𐐷%'")
    general = {r.doc_id: r.lang_pred for r in correlate.identify_lines(plain, n).collect()}
    assert general == {k: v for k, v in _want(n).items() if k != 6}


def test_profiles_of_lines(spark):
    lines = spark.createDataFrame(DOCS, "doc_id long, lang string, line string").where("doc_id <> 6 OR doc_id IS NULL")
    for n in (1, 2):
        want = correlate.profile(lines.select("lang", text.char_ngrams(F.col("line"), n).alias("grams")))
        assert sorted(map(tuple, correlate.line_profile(lines, n).collect())) == sorted(map(tuple, want.collect()))


def test_two_runs_from_one_pass(spark):
    docs = spark.createDataFrame([(k, " ".join("abcdef"[(k * j) % 6] for j in range(1, 3 + k % 7))) for k in range(40)], "doc_id long, text string")
    posts = index.postings(docs, text.tok_basic(F.col("text")))
    asked = spark.createDataFrame([(q, t, 1 + q % 2) for q in range(3) for t in "abcx"[q:]], "qid int, term string, qtf long")
    both = rank.runs(posts, asked, {"one": rank.bm25_formula(), "two": rank.robertson_formula()}, 5)
    for name, f in (("one", rank.bm25), ("two", rank.tfidf_robertson)):
        got = both.where(F.col("run") == name).select("qid", "doc_id", "score", "rank")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, f(posts, asked, 5).select("qid", "doc_id", "score", "rank").collect()))
