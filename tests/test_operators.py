import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from papyrix.functions import text
from papyrix.operators import boolean, evaluate, graph, index, rank
from papyrix.plans import catalog


@pytest.fixture(scope="module")
def posts(spark):
    docs = spark.createDataFrame([(1, "uno dos dos"), (2, "dos tres"), (3, "uno uno uno cuatro"), (4, None)], "doc_id long, text string")
    return docs, index.postings(docs, text.tok_basic(F.col("text")))


def test_cosine(spark, posts):
    asked = spark.createDataFrame([(1, "uno", 1), (1, "dos", 1), (1, "nada", 1)], "qid int, term string, qtf long")
    got = [(r.doc_id, round(r.score, 6)) for r in rank.cosine(posts[1], asked, 10).orderBy("rank").collect()]
    assert got == [(1, 0.948683), (3, 0.670820), (2, 0.5)]


def test_boolean(posts):
    ids = lambda e: sorted(r.doc_id for r in boolean.evaluate(posts[1], posts[0], e).collect())
    assert ids("uno & dos") == [1] and ids("uno | tres") == [1, 2, 3] and ids("~uno") == [2, 4] and ids("nada") == [] and ids("uno & dos & tres") == []


def test_compression_round_trip(posts):
    for gaps in (True, False):
        got = index.decompress(index.compress(posts[1], gaps), gaps)
        assert sorted(map(tuple, got.collect())) == sorted((r.term, r.doc_id) for r in posts[1].collect())


def test_evaluation(spark):
    run = spark.createDataFrame([(1, k, k) for k in range(1, 16)], "qid int, doc_id long, rank int")
    qrels = spark.createDataFrame([(1, k, 1) for k in [1, 4, 5, 10, 14, *range(100, 106)]], "qid int, doc_id long, rel int")
    r = evaluate.per_query(run, qrels).first()
    assert r.p_at_k == 0.4 and abs(r.ap - 0.259740) < 1e-6
    got = [round(x.precision, 6) for x in evaluate.interpolated(run, qrels).orderBy("level").collect()]
    assert got == [1, 0.6, 0.6, 0.4, 0.357143, 0, 0, 0, 0, 0, 0]


def test_pagerank_and_crawl(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "c")], "src string, dst string")
    score = {r.node: r.score for r in graph.pagerank(edges, rounds=60).collect()}
    for k, v in {"a": 0.372527, "b": 0.195824, "c": 0.394149, "d": 0.0375}.items():
        assert abs(score[k] - v) < 1e-5
    seeds = spark.createDataFrame([("a", 0), ("d", 1)], "url string, seq int")
    visited, out = graph.crawl(graph.nodes(edges).withColumnRenamed("node", "url"), edges, seeds, max_depth=3, per_seed=1)
    assert sorted(r.url for r in visited.collect()) == ["a", "d"] and out.count() == 0


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_topics_hold_every_term_of_a_text(spark, tmp_path):
    spark.createDataFrame([(1, "uno dos dos tres uno cuatro cinco"), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((r.qid, r.term, r.qtf, r.pos) for r in catalog._topics(spark, str(tmp_path)).collect())
    assert got == [(1, "cinco", 1, 6), (1, "cuatro", 1, 5), (1, "dos", 2, 1), (1, "tres", 1, 3), (1, "uno", 2, 0)]
