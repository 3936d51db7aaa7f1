"""Queries for the smaller operators: pieces of the index, laws, rankings and graphs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import boolean, evaluate, graph, index, rank, stats, stored
from ..sources import shared
from . import catalog as c
from .catalog import query

_CLEAN = "regexp_replace(translate(lower(coalesce(text, '')), 'áéíóúüÁÉÍÓÚÜ', 'aeiouuAEIOUU'), '[^\\p{L}\\p{M}_]', '', 'g')"


# text and addresses


@query(f"SELECT doc_id, md5({_CLEAN}) AS cleaned FROM documents")
def clean_chars(spark, d):
    return c._docs(spark, d).select("doc_id", F.md5(text.clean_chars(F.col("text"))).alias("cleaned"))


@query(f"WITH s AS (SELECT lang, {_CLEAN} AS t FROM documents), g AS (SELECT lang, unnest(regexp_extract_all(t, '(?s)..')) AS gram FROM s UNION ALL SELECT lang, unnest(regexp_extract_all(substring(t, 2), '(?s)..')) FROM s) SELECT lang, gram, count(*) AS cnt FROM g GROUP BY ALL")
def bigram_profile(spark, d):
    grams = c._docs(spark, d).select("lang", F.explode(text.char_ngrams(text.clean_chars(F.col("text")), 2)).alias("gram"))
    return grams.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("cnt"))


@query(f"WITH {c._TOK}, stop AS (SELECT unnest([{c._STOP}]) AS term) SELECT doc_id, count(*) AS n_tokens FROM tok ANTI JOIN stop USING (term) GROUP BY doc_id")
def stop_basic(spark, d):
    stop = spark.createDataFrame([(w,) for w in text.STOP_WORDS], "term string")
    return index.tokens(c._docs(spark, d), text.tok_basic(F.col("text"), fold=True)).join(F.broadcast(stop), "term", "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"))


@query(f"SELECT page_id, {c._STATIC} AS is_static FROM pages")
def url_is_static(spark, d):
    return c._table(spark, d, "pages").select("page_id", urls.is_static(F.col("url")).alias("is_static"))


@query("SELECT page_id, url FROM pages WHERE url LIKE 'http://%' OR url LIKE 'https://%'")
def url_http_filter(spark, d):
    return c._table(spark, d, "pages").where(F.col("url").startswith("http://") | F.col("url").startswith("https://")).select("page_id", "url")


@query("SELECT l_returnflag, l_linestatus, CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.5 THEN 'moderate' WHEN abs(r) >= 0.3 THEN 'weak' ELSE 'very weak' END || CASE WHEN r > 0 THEN ' positive' ELSE ' negative' END AS strength FROM (SELECT l_returnflag, l_linestatus, corr(l_quantity, l_extendedprice) AS r FROM lineitem GROUP BY ALL)")
def strength_label(spark, d):
    rho = c._table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.corr(F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double")).alias("r"))
    return rho.select("l_returnflag", "l_linestatus", evaluate.strength(F.col("r")).alias("strength"))


# index and statistics


@query(f"WITH {c._POST} SELECT doc_id, count(*) AS n_terms, sum(tf)::BIGINT AS n_tokens FROM post GROUP BY doc_id")
def doc_lengths(spark, d):
    return index.doc_stats(c._posts(spark, d)).select("doc_id", "n_terms", "n_tokens")


@query(f"WITH {c._POST} SELECT doc_id, round(sqrt(sum(tf * tf)), 9) AS norm FROM post GROUP BY doc_id")
def doc_norm(spark, d):
    return index.doc_stats(c._posts(spark, d)).select("doc_id", F.round("norm", 9).alias("norm"))


@query(f"WITH {c._POST}, {c._Q} SELECT term, qtf FROM q WHERE term IN (SELECT term FROM post)")
def query_vocab_filter(spark, d):
    asked = c._asked(spark).select("term", "qtf")
    return asked.join(c._posts(spark, d).select("term"), "term", "left_semi")


@query(f"WITH {c._POST}, {c._Q} SELECT round(sqrt(sum(qtf * qtf)), 9) AS norm FROM q WHERE term IN (SELECT term FROM post)")
def query_norm(spark, d):
    return query_vocab_filter(spark, d).agg(F.round(F.sqrt(F.sum(F.col("qtf") * F.col("qtf"))), 9).alias("norm"))


@query(f"WITH {c._TOK} SELECT count(DISTINCT term) AS n_terms, count(DISTINCT doc_id) AS n_docs FROM tok")
def distinct_count(spark, d):
    posts = c._posts(spark, d)
    return posts.agg(F.count_distinct("term").alias("n_terms"), F.count_distinct("doc_id").alias("n_docs"))


@query(f"WITH {c._VOCAB} SELECT term, row_number() OVER (ORDER BY term) AS term_id FROM vocab")
def term_ids(spark, d):
    return index.term_ids(index.vocabulary(c._posts(spark, d)))


@query(f"WITH {c._POST} SELECT term, doc_id FROM post")
def un_dgaps(spark, d):
    gaps = index.with_gaps(c._posts(spark, d)).withColumn("at", F.row_number().over(Window.partitionBy("term").orderBy("doc_id"))).select("term", "at", "gap")
    return index.un_gaps(gaps, "at").select("term", "doc_id")


_GAPS = f"{c._POST}, g AS (SELECT term, tf, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term ORDER BY doc_id) AS gap FROM post)"


@query(f"WITH {_GAPS} SELECT term, sum(greatest(1, ceil(length(bin(gap)) / 7.0)))::BIGINT AS n_bytes FROM g GROUP BY term")
def vbyte_encode(spark, d):
    return index.compress(c._posts(spark, d)).groupBy("term").agg(F.sum(F.length("ids")).alias("n_bytes"))


@query(f"WITH {_GAPS} SELECT term, ceil(sum(2 * length(bin(tf)) - 1) / 8.0)::BIGINT AS n_bytes FROM g GROUP BY term")
def gamma_encode(spark, d):
    return index.compress(c._posts(spark, d)).groupBy("term").agg(F.ceil(F.sum("bits") / 8).alias("n_bytes"))


def _stored(spark, d) -> str:
    """The stored index of the documents, by the basic tokeniser."""
    path = shared.new_path(spark, "index")
    stored.build(c._docs(spark, d), c._tokens(), path)
    return path


@query(f"WITH {c._POST} SELECT doc_id::VARCHAR AS name, doc_id, tf FROM post WHERE term = 'der'")
def compressed_lookup(spark, d):
    return stored.lookup(spark, _stored(spark, d), "der")


@query(f"WITH {c._POST} SELECT term, doc_id, tf FROM post")
def compress_blocks(spark, d):
    return index.decompress_blocks(index.compress_blocks(c._posts(spark, d)))


@query(f"WITH {c._VOCAB} SELECT term, row_number() OVER (ORDER BY term) AS term_id, df, cf FROM vocab")
def bsbi_build(spark, d):
    return stored.load(spark, _stored(spark, d))["vocabulary"]


@query(f"WITH {c._POST}, s AS (SELECT doc_id, count(*) AS n_terms, sum(tf)::BIGINT AS n_tokens, sqrt(sum(tf * tf)) AS norm FROM post GROUP BY doc_id) SELECT DISTINCT d.doc_id, d.doc_id::VARCHAR AS name, coalesce(n_terms, 0) AS n_terms, coalesce(n_tokens, 0) AS n_tokens, round(coalesce(norm, 0), 9) AS norm FROM documents d LEFT JOIN s USING (doc_id)")
def load_dicts(spark, d):
    return stored.load(spark, _stored(spark, d))["documents"].withColumn("norm", F.round("norm", 9))


_BOOL = f"WITH {c._POST}, f AS (SELECT doc_id, bool_or(term = 'the') AS a, bool_or(term = 'of') AS b, bool_or(term = 'und') AS c FROM post GROUP BY doc_id) SELECT d.doc_id FROM documents d LEFT JOIN f USING (doc_id) WHERE (coalesce(a, false) AND coalesce(b, false)) OR NOT coalesce(c, false)"


@query(_BOOL)
def bool_disk(spark, d):
    return stored.search(spark, _stored(spark, d), "(the & of) | ~und")


@query(_BOOL)
def bool_memory(spark, d):
    return stored.search(spark, _stored(spark, d), "(the & of) | ~und", in_memory=True)


@query(f"WITH {c._POST}, r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, floor(sqrt(count(*) OVER ()))::BIGINT AS s FROM post WHERE term = 'the'), p AS (SELECT place, doc_id, lead(doc_id) OVER (ORDER BY place) AS skip_to FROM r WHERE place % s = 0) SELECT * FROM p WHERE skip_to IS NOT NULL")
def skiplist_get(spark, d):
    return stored.skips_of(spark, _stored(spark, d), "the").withColumnRenamed("at", "place")


@query(f"WITH {c._POST} SELECT doc_id, doc_id IN (SELECT doc_id FROM post WHERE term = 'de') AS found FROM post WHERE term = 'the'")
def skiplist_probe(spark, d):
    return stored.has(spark, _stored(spark, d), "de", c._some(spark, d, ["the"]))


@query(f"WITH {c._RANKED}, f AS (SELECT regr_slope(ln(cf), ln(rank)) AS a, exp(regr_intercept(ln(cf), ln(rank))) AS k FROM ranked) SELECT rank, round(k * pow(rank, a), 4) AS predicted FROM ranked, f")
def zipf_predicted(spark, d):
    ranked = c._ranked(spark, d)
    return ranked.join(F.broadcast(stats.zipf_fit(ranked))).select("rank", F.round(F.col("c") * F.pow("rank", "alpha"), 4).alias("predicted"))


@query(f"WITH {c._GROWTH}, f AS (SELECT regr_slope(ln(n_terms), ln(n_tokens)) AS b, exp(regr_intercept(ln(n_terms), ln(n_tokens))) AS k FROM growth WHERE n_tokens > 0) SELECT line_no, round(k * pow(n_tokens, b), 4) AS predicted FROM growth, f")
def heaps_predicted(spark, d):
    growth = c._growth(spark, d)
    return growth.join(F.broadcast(stats.heaps_fit(growth))).select("line_no", F.round(F.col("k") * F.pow("n_tokens", "beta"), 4).alias("predicted"))


# boolean operators


def _boolean(name: str, expression: str, sql: str) -> None:
    def run(spark, d):
        return boolean.evaluate(c._some(spark, d, ["the", "und"]), c._docs(spark, d), expression)

    run.__name__ = name
    query(f"WITH {c._POST}, a AS (SELECT doc_id FROM post WHERE term = 'the'), b AS (SELECT doc_id FROM post WHERE term = 'und') {sql}")(run)


_boolean("bool_and", "the & und", "SELECT doc_id FROM a INTERSECT SELECT doc_id FROM b")
_boolean("bool_or", "the | und", "SELECT doc_id FROM a UNION SELECT doc_id FROM b")
_boolean("bool_not", "~the", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM a")


@query("SELECT DISTINCT doc_id FROM documents")
def all_docs(spark, d):
    return c._table(spark, d, "documents").select("doc_id").distinct()


# runs and judgements


@query(f"WITH {c._JUDGED} SELECT qid, rank, round(found / n_rel, 7) AS recall, round(found / rank, 7) AS precision FROM j")
def pr_curve_raw(spark, d):
    j = evaluate.judged(c._run(spark, d), c._qrels(spark, d))
    return j.select("qid", "rank", F.round(F.col("found") / F.col("n_rel"), 7).alias("recall"), F.round(F.col("found") / F.col("rank"), 7).alias("precision"))


_SECOND = "sc2 AS (SELECT qid, doc_id, round(sum(qtf * 1.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avdl)) * log2(n / df + 1)), 9) AS score FROM post JOIN topics USING (term) JOIN vocab USING (term) JOIN st USING (doc_id), g GROUP BY qid, doc_id), run2 AS (SELECT * FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC)::INT AS rank FROM sc2) WHERE rank <= 1000)"
_AT = "(SELECT a.qid, 50 AS k, a.doc_id AS x, b.doc_id AS y FROM run a JOIN run2 b USING (qid, rank) WHERE rank <= 50 UNION ALL SELECT a.qid, 25, a.doc_id, b.doc_id FROM run a JOIN run2 b USING (qid, rank) WHERE rank <= 25 UNION ALL SELECT a.qid, 10, a.doc_id, b.doc_id FROM run a JOIN run2 b USING (qid, rank) WHERE rank <= 10)"


@query(f"WITH {c._RUN}, {_SECOND} SELECT qid, k::INT AS k, count(*) AS n, round(corr(rx, ry), 7) AS rho FROM (SELECT qid, k, rank() OVER (PARTITION BY qid, k ORDER BY x) AS rx, rank() OVER (PARTITION BY qid, k ORDER BY y) AS ry FROM {_AT}) GROUP BY qid, k HAVING count(*) > 1")
def rank_corr_topk(spark, d):
    """Both runs come from one pass, to the depth that is compared, and are kept for the three depths."""
    shared.prepare(spark)
    topics = c._topics(spark, d).drop("pos")
    both = rank.runs(c._some(spark, d, topics), topics, {"bm25": rank.bm25_formula(), "tfidf": rank.robertson_formula()}, 50, c._lengths(spark, d)).checkpoint()
    first, second = both.where("run = 'bm25'"), both.where("run = 'tfidf'")
    out = None
    for k in (10, 25, 50):
        one = evaluate.position_correlation(first, second, k).where("n > 1").select("qid", F.lit(k).alias("k"), "n", F.round("rho", 7).alias("rho"))
        out = one if out is None else out.unionByName(one)
    return out


# graphs


def _hits_sql(rounds: int) -> str:
    """authority and hub by so many rounds, starting from equal hubs."""
    steps = [c._EDGES, "nodes AS MATERIALIZED (SELECT src AS node FROM edges UNION SELECT dst FROM edges)", "h0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE AS v FROM nodes)"]
    for k in range(rounds):
        for new, old, to, by in ((f"a{k}", f"h{k}", "dst", "src"), (f"h{k + 1}", f"a{k}", "src", "dst")):
            steps.append(f"{new}g AS MATERIALIZED (SELECT {to} AS node, sum(v) AS v FROM edges JOIN {old} ON node = {by} GROUP BY {to})")
            steps.append(f"{new} AS MATERIALIZED (SELECT node, coalesce(g.v / (SELECT sum(v) FROM {new}g), 0) AS v FROM nodes LEFT JOIN {new}g g USING (node))")
    return f"WITH {', '.join(steps)} SELECT node, round(a.v, 9) AS authority, round(h.v, 9) AS hub FROM a{rounds - 1} a JOIN h{rounds} h USING (node)"


@query(_hits_sql(8))
def hits(spark, d):
    return graph.hits(c._edges(spark, d)).select("node", F.round("authority", 9).alias("authority"), F.round("hub", 9).alias("hub"))


@query(f"SELECT node, score FROM ({c._rank_sql(8)}) ORDER BY score DESC, node LIMIT 10")
def top_pages(spark, d):
    return graph.pagerank(c._edges(spark, d)).select("node", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "node").limit(10)


@query(f"SELECT node, authority FROM ({_hits_sql(8)}) ORDER BY authority DESC, node LIMIT 10")
def top_authorities(spark, d):
    return hits(spark, d).select("node", "authority").orderBy(F.desc("authority"), "node").limit(10)


@query(f"WITH {c._EDGES}, o AS (SELECT src AS node, count(*) AS n_out FROM edges GROUP BY src), i AS (SELECT dst AS node, count(*) AS n_in FROM edges GROUP BY dst) SELECT node, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in FROM o FULL JOIN i USING (node)")
def graph_nodes(spark, d):
    edges = c._edges(spark, d)
    out, into = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_out")), edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_in"))
    return out.join(into, "node", "full").na.fill(0)


@query(f"WITH {c._EDGES}, a AS (SELECT src AS item, row_number() OVER (ORDER BY count(*) DESC, src) AS rank FROM edges GROUP BY src), b AS (SELECT dst AS item, row_number() OVER (ORDER BY count(*) DESC, dst) AS rank_b FROM edges GROUP BY dst) SELECT item, rank, rank_b FROM a JOIN b USING (item) WHERE rank <= 50 AND rank_b <= 50")
def rank_compare_topn(spark, d):
    edges = c._edges(spark, d)

    def first(column: str, name: str) -> DataFrame:
        best = edges.groupBy(F.col(column).alias("item")).count().orderBy(F.desc("count"), "item").limit(50)
        return best.select("item", F.row_number().over(Window.orderBy(F.desc("count"), "item")).cast("long").alias(name))

    return first("src", "rank").join(first("dst", "rank_b"), "item")


def _bfs(spark, d, total: int | None = None) -> DataFrame:
    edges = c._edges(spark, d)
    seed = edges.agg(F.min("src").alias("url")).where("url IS NOT NULL").withColumn("seq", F.lit(0))
    return graph.crawl(graph.nodes(edges).withColumnRenamed("node", "url"), edges, seed, max_depth=3, total=total)[0]


_BFS = f"{c._EDGES}, k AS (SELECT min(src) AS url, 0 AS depth FROM edges UNION SELECT dst, depth + 1 FROM k JOIN edges ON src = url WHERE depth < 3), seen AS (SELECT url, min(depth) AS depth FROM k GROUP BY url)"


@query(f"WITH RECURSIVE {_BFS} SELECT url, depth::INT AS depth FROM seen")
def crawl_bfs(spark, d):
    return _bfs(spark, d).select("url", "depth")


@query(f"WITH RECURSIVE {_BFS} SELECT f.depth::INT AS depth, count(url) AS pages, round(count(url) / (SELECT count(*) FROM seen), 9) AS share FROM range(0, 4) f(depth) LEFT JOIN seen USING (depth) GROUP BY f.depth")
def depth_distribution(spark, d):
    return graph.depth_distribution(_bfs(spark, d), 3).select("depth", F.col("pages").cast("long").alias("pages"), F.round("share", 9).alias("share"))


@query(f"WITH RECURSIVE {_BFS} SELECT url, depth::INT AS depth FROM seen ORDER BY depth, url LIMIT 60")
def crawl_total_cap(spark, d):
    """The crawl stops at its cap, here of 60 pages of the 150 within reach, in the order of the queue."""
    return _bfs(spark, d, 60).select("url", "depth")
