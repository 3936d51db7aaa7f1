"""Global order in ranges against plain Python, with ties, nulls and one hot key; ranges of a few rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from papyrix.operators import evaluate, graph, ordered
from papyrix.plans import catalog


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(ordered, "ROWS", 7)


def _key(row, *names):
    return [(row[n] is None, row[n] if row[n] is not None else 0) for n in names]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(rng.choice([None, 1, 1, 1, 2, 3, 5]), rng.choice([None, *"abcdefgh"]), k, rng.randrange(9)) for k in range(120)]
    return spark.createDataFrame(data, "a int, b string, c long, v long").repartition(3)


def test_numbers_and_sums_in_a_global_order(rows):
    order = ("a", "b", "c")
    # the table is cut, and no range has more than a share of it
    parts = [r["count"] for r in ordered.split(rows, *order).groupBy("part").count().collect()]
    assert len(parts) > 5 and max(parts) < 60
    got = {r.c: r.n for r in ordered.number(ordered.split(rows, *order), "n", *order).collect()}
    want = sorted(rows.collect(), key=lambda r: [(r.a is None, r.a or 0), (r.b is None, r.b or ""), r.c])
    assert got == {r.c: k + 1 for k, r in enumerate(want)}
    sums = {r.c: r.v for r in ordered.running(ordered.split(rows, *order), ["v"], *order).collect()}
    assert sums == {r.c: sum(x.v for x in want[: k + 1]) for k, r in enumerate(want)}


def test_the_next_row_is_found_across_ranges(spark):
    rng = random.Random(4)
    when = datetime(2024, 1, 1)
    data = [(rng.choice([None, *(when + timedelta(seconds=s) for s in range(6))]), k, rng.choice([None, 1, 2, 3, 4])) for k in range(90)]
    rows = spark.createDataFrame(data, "ts timestamp, event_id long, user_id long").repartition(3)
    got = {r.event_id: r.nxt for r in ordered.following(ordered.split(rows, "ts", "event_id"), "user_id", "nxt", "ts", "event_id").collect()}
    want = sorted(data, key=lambda r: (r[0] is None, r[0] or when, r[1]))
    assert got == {r[1]: (want[k + 1][2] if k + 1 < len(want) else None) for k, r in enumerate(want)}


def test_edges_are_those_of_one_order_of_all_events(spark, tmp_path):
    rng = random.Random(5)
    data = [(k, datetime(2024, 1, 1) + timedelta(microseconds=rng.randrange(40)), rng.randrange(12)) for k in range(200)]
    spark.createDataFrame(data, "event_id long, ts timestamp, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    users = [r[2] for r in sorted(data, key=lambda r: (r[1], r[0]))]
    edges = catalog._edges(spark, str(tmp_path))
    assert sorted(map(tuple, edges.collect())) == sorted({(a, b) for a, b in zip(users, users[1:]) if a != b})
    # later plans hold no window without a partition key
    assert "SinglePartition" not in edges._jdf.queryExecution().toString()


def test_overlap_of_long_rankings(spark):
    rng = random.Random(6)
    a, b = rng.sample(range(60), 50), rng.sample(range(60), 50)
    frame = lambda x: spark.createDataFrame([(v, k + 1) for k, v in enumerate(x)], "item long, rank long")
    got = {r.k: r.percent for r in evaluate.rank_overlap(frame(a), frame(b)).collect()}
    assert got == {k: 100.0 * len(set(a[:k]) & set(b[:k])) / k for k in range(1, 51)}


def test_crawl_without_caps_has_no_window_over_an_origin(spark):
    edges = spark.createDataFrame([(k, 2 * k + j) for k in range(1, 40) for j in (0, 1)], "src long, dst long")
    seeds = spark.createDataFrame([(1, 0)], "url long, seq int")
    pages = graph.nodes(edges).withColumnRenamed("node", "url")
    visited, _ = graph.crawl(pages, edges, seeds, max_depth=3)
    assert sorted((r.url, r.depth) for r in visited.collect()) == [(u, u.bit_length() - 1) for u in range(1, 16)]
    capped, _ = graph.crawl(pages, edges, seeds, max_depth=3, per_seed=5)
    assert sorted(r.url for r in capped.collect()) == [1, 2, 3, 4, 5]
    total, _ = graph.crawl(pages, edges, seeds, max_depth=3, total=6)
    assert sorted(r.url for r in total.select(F.col("url")).collect()) == [1, 2, 3, 4, 5, 6]


def test_growth_over_ranges_of_lines(spark, tmp_path):
    rng = random.Random(7)
    data = [(k // 4 * 3, k % 4, " ".join(rng.choice("abcdefghijklmnop") * rng.randrange(1, 4) for _ in range(rng.randrange(5)))) for k in range(80)]
    rng.shuffle(data)
    spark.createDataFrame(data, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    growth = catalog._growth(spark, str(tmp_path))
    want, seen, total = [], set(), 0
    for k, (_, _, line) in enumerate(sorted(data)):
        total += len(line.split())
        seen |= set(line.split())
        want.append((k + 1, total, len(seen)))
    assert sorted(map(tuple, growth.collect())) == want
    # the sums are made in ranges
    assert "windowspecdefinition(part" in growth._jdf.queryExecution().toString()
