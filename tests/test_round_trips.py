"""Writers against their readers, and the small operators against plain Python."""

from collections import Counter

from pyspark.sql import functions as F

from papyrix.functions import text
from papyrix.operators import evaluate, index
from papyrix.sources import readers

DOCS = [(1, "the cat and the dog"), (2, "un perro y el gato"), (3, None), (4, ""), (5, "the the the")]


def _posts(spark):
    return index.postings(spark.createDataFrame(DOCS, "doc_id long, text string"), text.tok_basic(F.col("text")))


def test_index_round_trip_reads_only_the_terms_asked_for(spark, tmp_path):
    posts = _posts(spark)
    readers.write_index(posts, str(tmp_path / "index"), 2)
    assert sorted(readers.read_index(spark, str(tmp_path / "index")).collect()) == sorted(posts.collect())
    the = readers.read_index(spark, str(tmp_path / "index"), "the")
    assert sorted((r.doc_id, r.tf) for r in the.collect()) == [(1, 2), (5, 3)]
    assert not readers.read_index(spark, str(tmp_path / "index"), "nowhere").collect()


def test_terms_file_holds_each_term_with_its_counts(spark, tmp_path):
    readers.write_terms(index.vocabulary(_posts(spark)), str(tmp_path / "terms"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "terms")).collect()]
    words = [(d, w) for d, t in DOCS for w in (t or "").split()]
    cf, df = Counter(w for _, w in words), Counter(w for _, w in set(words))
    assert sorted(lines) == sorted(f"{w} {cf[w]} {df[w]}" for w in cf)


def test_csv_round_trip(spark, tmp_path):
    readers.write_csv(_posts(spark), str(tmp_path / "csv"), "term", "doc_id")
    back = spark.read.option("header", True).schema("doc_id long, term string, tf long").csv(str(tmp_path / "csv"))
    assert sorted(back.collect()) == sorted(_posts(spark).collect())


def test_term_ids_are_dense_and_in_order(spark):
    ids = index.term_ids(index.vocabulary(_posts(spark))).orderBy("term_id").collect()
    assert [r.term_id for r in ids] == list(range(1, len(ids) + 1))
    assert [r.term for r in ids] == sorted(r.term for r in ids)


def test_average_ranks_with_ties_hot_values_and_nulls(spark):
    values = [7.0] * 40 + [float(v % 13) for v in range(60)] + [None] * 5
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    kept = sorted(v for v in values if v is not None)
    want = {v: sum(i + 1 for i, w in enumerate(kept) if w == v) / kept.count(v) for v in set(kept)}
    for parts in (2, 5, 200):
        got = {r.x: r.x_rank for r in evaluate.average_ranks(rows, "x", parts).collect()}
        assert got == want
    assert evaluate.average_ranks(rows.where("x > 99"), "x").count() == 0


def test_position_correlation_of_equal_and_opposed_runs(spark):
    run = spark.createDataFrame([(1, r, r) for r in range(1, 6)], "qid int, rank int, doc_id long")
    turned = spark.createDataFrame([(1, r, 6 - r) for r in range(1, 6)], "qid int, rank int, doc_id long")
    assert evaluate.position_correlation(run, run, 5).first().rho == 1
    same = evaluate.position_correlation(run, turned, 3).first()
    assert (same.n, same.rho) == (3, -1)


def test_correlation_leaves_out_rows_with_a_null(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 9.0), (None, 1.0), (5.0, None)], "a double, b double")
    got = evaluate.correlation(rows, "a", "b").first()
    assert got.n == 3 and abs(got.spearman - 1) < 1e-12
