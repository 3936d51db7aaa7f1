"""Queries over the driver's tables for each operator, with the SQL that gives the same rows.

Doubles are rounded on both sides, so that the order of sums does not show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stem, text, urls
from ..operators import boolean, correlate, evaluate, graph, index, ordered, rank, stats
from ..sources import readers, shared

QUERY = ("the", "of", "de", "und", "la", "the")  # terms of the sample query, one of them twice
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _table(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark, d) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", "text", "lang")


def _posts(spark, d) -> DataFrame:
    return index.postings(_docs(spark, d), text.tok_basic(F.col("text"), fold=True))


def _tokens():
    return text.tok_basic(F.col("text"), fold=True)


def _lines(spark, d) -> DataFrame:
    """doc_id, lang and each text's letters."""
    return _docs(spark, d).select("doc_id", "lang", text.clean_chars(F.col("text")).alias("line"))


def _some(spark, d, wanted) -> DataFrame:
    """Postings of some terms only."""
    return index.postings_of(_docs(spark, d), _tokens(), wanted)


def _lengths(spark, d) -> DataFrame:
    return index.lengths(_docs(spark, d), _tokens())


def _asked(spark) -> DataFrame:
    rows: dict[str, list] = {}
    for k, t in enumerate(QUERY):
        rows.setdefault(t, [1, t, 0, k])[2] += 1
    return spark.createDataFrame(list(rows.values()), "qid int, term string, qtf long, pos int")


def _topics(spark, d) -> DataFrame:
    """qid, term, qtf, pos (of the first time): the terms of each whole benchmark text."""
    terms = _table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.posexplode(text.tok_basic(F.col("text"), fold=True)).alias("pos", "term"))
    return terms.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"), F.min("pos").alias("pos"))


def _qrels(spark, d) -> DataFrame:
    """Documents of quality 1 are relevant to every topic: few topics, so the topics are broadcast."""
    good = _table(spark, d, "labels").where("quality = 1").select("doc_id").distinct()
    return good.join(F.broadcast(_topics(spark, d).select("qid").distinct())).select("qid", "doc_id", F.lit(1).alias("rel"))


def _edges(spark, d) -> DataFrame:
    """user to the next event's user, without loops, each once; kept, since graph operators read it many times."""
    shared.prepare(spark)
    e = _table(spark, d, "events").select("ts", "event_id", F.col("user_id").alias("src"))
    nxt = ordered.following(ordered.split(e, "ts", "event_id"), "src", "dst", "ts", "event_id")
    return nxt.select("src", "dst").where("dst IS NOT NULL AND src <> dst").distinct().checkpoint()


_TOK = "tok AS (SELECT doc_id, unnest(regexp_extract_all(translate(lower(coalesce(text, '')), 'áéíóúüÁÉÍÓÚÜ', 'aeiouuAEIOUU'), '[a-z]+')) AS term FROM documents)"
_POST = f"{_TOK}, post AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL)"
_VOCAB = f"{_POST}, vocab AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY term)"
_RANKED = f"{_VOCAB}, ranked AS (SELECT row_number() OVER (ORDER BY cf DESC, term) AS rank, term, cf FROM vocab)"
_Q = "q AS (SELECT * FROM (VALUES ('the', 2, 0), ('of', 1, 1), ('de', 1, 2), ('und', 1, 3), ('la', 1, 4)) v(term, qtf, pos))"
_EDGES = "edges AS (SELECT DISTINCT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL AND src <> dst)"
_TOPICS = "tt AS (SELECT item_id AS qid, regexp_extract_all(translate(lower(text), 'áéíóúüÁÉÍÓÚÜ', 'aeiouuAEIOUU'), '[a-z]+') AS l FROM benchmark), topics AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(l) AS term FROM tt) GROUP BY ALL)"
_STATS = "st AS (SELECT doc_id, sum(tf) AS dl, sqrt(sum(tf * tf)) AS norm FROM post GROUP BY doc_id), g AS (SELECT count(*) AS n, sum(dl) AS tokens, avg(dl) AS avdl FROM st)"


def _top(scored: str, k: int = 10) -> str:
    return f"SELECT doc_id, score, rank FROM (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id DESC)::INT AS rank FROM (SELECT doc_id, round(score, 9) AS score FROM ({scored}))) WHERE rank <= {k}"


# scans and text functions


@query("SELECT doc_id, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents) WHERE line <> '' GROUP BY doc_id")
def scan_lines(spark, d):
    return readers.lines(_docs(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT props) AS n_props, sum(length(json_extract_string(props, '$.k')))::BIGINT AS k_chars FROM events GROUP BY event_type")
def scan_json_stats(spark, d):
    return _table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("props").alias("n_props"), F.sum(F.length(F.get_json_object("props", "$.k"))).alias("k_chars"))


@query(f"WITH {_VOCAB} SELECT term, df, list_sort(list(doc_id))[1] AS first_doc FROM vocab JOIN post USING (term) GROUP BY term, df")
def scan_dump(spark, d):
    lists = index.posting_lists(_posts(spark, d))
    made = lists.select(F.concat_ws(":", "term", F.col("df").cast("string"), F.concat(F.array_join(F.transform("docs", lambda x: x.cast("string")), ","), F.lit(","))).alias("value"))
    return readers.dump(made).select("term", "df", F.element_at("docs", 1).alias("first_doc"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]*\n[ \t\n\x0B\f\r]*', ' ', 'g'), ' ')) AS body FROM documents")
def scan_trec(spark, d):
    marked = _docs(spark, d).select(F.concat(F.lit("<DOC>\n<DOCNO>"), F.col("doc_id").cast("string"), F.lit("</DOCNO>\n"), F.coalesce("text", F.lit("")), F.lit("\n</DOC>\n")).alias("text"))
    return readers.trec(marked).select("doc_id", F.md5("text").alias("body"))


@query("SELECT term, count(*) AS cf FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS term FROM documents) GROUP BY term")
def tok_basic(spark, d):
    return _docs(spark, d).select(F.explode(text.tok_basic(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("cf"))


@query(f"WITH {_TOK} SELECT doc_id, count(*) AS n_tokens FROM tok GROUP BY doc_id")
def tok_basic_fold(spark, d):
    return _docs(spark, d).select("doc_id", F.size(text.tok_basic(F.col("text"), True)).cast("long").alias("n_tokens")).where("n_tokens > 0")


@query("SELECT doc_id, md5(translate(text, 'áéíóúüÁÉÍÓÚÜ', 'aeiouuAEIOUU')) AS folded FROM documents")
def fold_accents(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(text.fold_accents(F.col("text"))).alias("folded"))


#: Where each pattern is looked for: table, id, a text in Spark's SQL and in DuckDB's; the invented documents hold no URL, date or abbreviation.
_WHERE = {
    "urls": ("pages", "page_id", "concat(url, ' ', html)", "url || ' ' || html"),
    "dates": ("orders", "o_orderkey", "concat('on ', date_format(o_orderdate, 'dd/MM/yyyy'), ' or ', date_format(o_orderdate, 'dd-MM-yyyy'))", "'on ' || strftime(o_orderdate, '%d/%m/%Y') || ' or ' || strftime(o_orderdate, '%d-%m-%Y')"),
    "abbreviations": ("supplier", "s_suppkey", "concat('el Dr.', s_name, ' y la Sra.', s_suppkey, ' etc.')", "'el Dr.' || s_name || ' y la Sra.' || s_suppkey || ' etc.'"),
}


def _pattern(name: str) -> None:
    table, key, here, there = _WHERE.get(name, ("documents", "doc_id", "text", "text"))

    def run(spark, d):
        found = F.size(text.tok_regex(F.expr(here), name)).cast("long")
        return _table(spark, d, table).select(key, found.alias("n")).where("n > 0")

    run.__name__ = f"tok_{name}"
    # RE2's word ends are of ASCII letters: other letters are made one, other signs a space; that changes none of these patterns' own letters
    plain = f"regexp_replace(regexp_replace({there}, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\x00-\\x7F]', ' ', 'g'), '[^\\x00-\\x7F]', 'x', 'g')"
    where = plain if name in ("acronyms", "numbers", "abbreviations") else there
    query(None if name == "names" else f"SELECT {key}, len(regexp_extract_all({where}, '{text.PATTERNS[name]}')) AS n FROM {table} WHERE n > 0")(run)


for _name in text.PATTERNS:
    _pattern(_name)


@query()
def tok_regex(spark, d):
    return index.postings(_docs(spark, d), text.tokenize(F.col("text"), stop_words=text.STOP_WORDS))


@query(f"WITH t AS (SELECT translate(unnest(regexp_extract_all(text, '{text.PATTERNS['words']}')), 'áéíóúüÁÉÍÓÚÜ', 'aeiouuAEIOUU') AS t FROM documents) SELECT CASE WHEN regexp_full_match(t, '[a-zA-Z]+(-[a-zA-Z]+)*') THEN lower(t) ELSE t END AS token, count(*) AS n FROM t GROUP BY 1")
def tok_case(spark, d):
    return _docs(spark, d).select(F.explode(text.tok_regex(F.col("text"), "words")).alias("t")).select(text.tok_case(text.strip_tags(F.col("t"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query(f"WITH {_POST} SELECT term, sum(tf)::BIGINT AS cf FROM post WHERE term NOT IN ({_STOP}) GROUP BY term")
def stop_list(spark, d):
    return _posts(spark, d).where(~F.col("term").isin(*text.STOP_WORDS)).groupBy("term").agg(F.sum("tf").alias("cf"))


@query()
def stem_compare(spark, d):
    posts = _posts(spark, d)
    vocab = index.vocabulary(posts)
    out = None
    for method in stem.METHODS:
        one = stem.stem_terms(vocab, method).agg(F.lit(method).alias("method"), F.count_distinct("stem").alias("n_stems"), F.sum("cf").alias("n_tokens"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT lang, gram, count(*) AS cnt FROM (SELECT lang, unnest(string_split(regexp_replace(translate(lower(text), 'áéíóúüÁÉÍÓÚÜ', 'aeiouuAEIOUU'), '[^\\p{L}\\p{M}_]', '', 'g'), '')) AS gram FROM documents) WHERE gram <> '' GROUP BY ALL")
def char_profile(spark, d):
    return correlate.profile(_docs(spark, d).select("lang", text.char_ngrams(text.clean_chars(F.col("text")), 1).alias("grams")))


# pages


@query("SELECT page_id, regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) AS domain FROM pages")
def url_domain(spark, d):
    return _table(spark, d, "pages").select("page_id", urls.domain(F.col("url")).alias("domain"))


_LINKS = """links AS (SELECT page_id, url AS src, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1)) AS href FROM pages)"""


@query(f"WITH {_LINKS} SELECT page_id, href, count(*) AS n FROM links GROUP BY ALL")
def html_links(spark, d):
    return _table(spark, d, "pages").select("page_id", F.explode(urls.html_links(F.col("html"))).alias("href")).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LINKS} SELECT DISTINCT src, regexp_extract(src, '^([^:/?#]+://[^/?#]*)', 1) || href AS dst FROM links WHERE href LIKE '/%'")
def url_resolve(spark, d):
    rows = _table(spark, d, "pages").select(F.col("url").alias("src"), F.explode(urls.html_links(F.col("html"))).alias("href"))
    return rows.where(F.col("href").startswith("/")).select("src", urls.resolve(F.col("src"), F.col("href")).alias("dst")).where(F.col("dst").rlike("^https?://")).distinct()


_PATH = "regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)"
_STATIC = f"(regexp_matches(lower({_PATH}), '\\.({'|'.join(urls.STATIC)})$') OR (NOT regexp_matches(url, '^[^#]*\\?.') AND ({_PATH} LIKE '%/' OR regexp_extract({_PATH}, '([^/]*)$', 1) NOT LIKE '%.%')))"


@query(f"SELECT CASE WHEN {_STATIC} THEN 'static' ELSE 'dynamic' END AS page_type, count(*) AS n FROM pages GROUP BY page_type")
def static_dynamic_counts(spark, d):
    return _table(spark, d, "pages").select(F.when(urls.is_static(F.col("url")), "static").otherwise("dynamic").alias("page_type")).groupBy("page_type").agg(F.count(F.lit(1)).alias("n"))


# statistics and laws


@query(f"WITH {_POST} SELECT * FROM post")
def term_freq(spark, d):
    return _posts(spark, d)


@query(f"WITH {_VOCAB} SELECT term, df, cf, md5(array_to_string(list_sort(list(doc_id)), ',')) AS docs FROM vocab JOIN post USING (term) GROUP BY term, df, cf")
def vocab_stats(spark, d):
    return index.posting_lists(_posts(spark, d)).select("term", "df", "cf", F.md5(F.array_join(F.transform("docs", lambda x: x.cast("string")), ",")).alias("docs"))


@query("SELECT term, count(*) AS df FROM (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM conversations) GROUP BY term")
def line_df(spark, d):
    return _table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.array_distinct(text.tok_basic(F.col("text")))).alias("term")).select("conv_id", "turn", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query(f"WITH {_VOCAB} SELECT count(*) AS n_terms, sum(cf)::BIGINT AS n_tokens FROM vocab")
def collection_totals(spark, d):
    return index.vocabulary(_posts(spark, d)).agg(F.count(F.lit(1)).alias("n_terms"), F.sum("cf").alias("n_tokens"))


@query(f"""WITH {_VOCAB}, l AS (SELECT doc_id, count(*) AS terms, sum(tf)::BIGINT AS tokens FROM post GROUP BY doc_id), v AS (SELECT count(*) AS n_terms, avg(length(term)) AS m, sum((df = 1)::INT)::BIGINT AS df1 FROM vocab),
s AS (SELECT * FROM l ORDER BY tokens, doc_id LIMIT 1), b AS (SELECT * FROM l ORDER BY tokens DESC, doc_id DESC LIMIT 1), n AS (SELECT count(*) AS n_docs FROM documents), a AS (SELECT sum(tokens)::BIGINT AS n_tokens, sum(terms) AS t FROM l)
SELECT n_docs, n_tokens, n_terms, round(n_tokens / n_docs, 9) AS tokens_per_doc, round(a.t / n_docs, 9) AS terms_per_doc, round(m, 9) AS mean_term_length, s.tokens AS shortest_tokens, s.terms AS shortest_terms, b.tokens AS longest_tokens, b.terms AS longest_terms, df1 AS df1_terms FROM n, a, v, s, b""")
def collection_stats(spark, d):
    out = stats.collection(_posts(spark, d), _docs(spark, d))
    return out.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(f"WITH {_POST} SELECT doc_id, count(*) AS n_terms, sum(tf)::BIGINT AS n_tokens, round(sqrt(sum(tf * tf)), 9) AS norm FROM post GROUP BY doc_id")
def doc_lengths_and_norms(spark, d):
    return index.doc_stats(_posts(spark, d)).withColumn("norm", F.round("norm", 9))


@query(f"WITH {_POST} SELECT * FROM (SELECT *, 'top' AS side FROM post ORDER BY tf DESC, doc_id, term LIMIT 10) UNION ALL SELECT * FROM (SELECT *, 'bottom' AS side FROM post ORDER BY tf, doc_id, term LIMIT 10)")
def top_bottom_postings(spark, d):
    return stats.extreme_postings(_posts(spark, d))


def _ranked(spark, d):
    return stats.ranked_terms(index.vocabulary(_posts(spark, d)).select("term", "cf"))


@query(f"WITH {_RANKED} SELECT * FROM ranked")
def rank_terms(spark, d):
    return _ranked(spark, d)


@query(f"WITH {_RANKED} SELECT round(regr_slope(ln(cf), ln(rank)), 7) AS alpha, round(exp(regr_intercept(ln(cf), ln(rank))), 4) AS c FROM ranked")
def zipf_fit(spark, d):
    return stats.zipf_fit(_ranked(spark, d)).select(F.round("alpha", 7).alias("alpha"), F.round("c", 4).alias("c"))


@query(f"WITH {_RANKED}, f AS (SELECT regr_slope(ln(cf), ln(rank)) AS a, exp(regr_intercept(ln(cf), ln(rank))) AS c, count(*) AS n FROM ranked) SELECT round(sum(c * pow(rank, a)), 3) AS predicted, sum(cf)::BIGINT AS actual FROM ranked, f WHERE rank <= floor(n * 0.2)")
def zipf_mass(spark, d):
    return stats.zipf_mass(_ranked(spark, d), 0.2).select(F.round("predicted", 3).alias("predicted"), "actual")


@query(f"WITH {_RANKED}, n AS (SELECT count(*) AS n FROM ranked) SELECT rank, term, term IN ({_STOP}) AS is_stop FROM ranked, n WHERE rank <= floor(n * 0.1)")
def prune_top_pct(spark, d):
    return stats.prune(_ranked(spark, d), 0.1, text.STOP_WORDS)


_LINES = "li AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS line_no, regexp_extract_all(lower(text), '[a-z]+') AS terms FROM conversations)"
_GROWTH = f"{_LINES}, w AS (SELECT line_no, unnest(terms) AS term FROM li), nw AS (SELECT line_no, count(*) AS c FROM (SELECT term, min(line_no) AS line_no FROM w GROUP BY term) GROUP BY line_no), growth AS (SELECT li.line_no, sum(len(terms)) OVER (ORDER BY li.line_no)::BIGINT AS n_tokens, sum(coalesce(c, 0)) OVER (ORDER BY li.line_no)::BIGINT AS n_terms FROM li LEFT JOIN nw USING (line_no))"


def _growth(spark, d):
    rows = _table(spark, d, "conversations").select("conv_id", "turn", "text")
    lines = ordered.number(ordered.split(rows, "conv_id", "turn"), "line_no", "conv_id", "turn")
    return stats.heaps_growth(lines.select("line_no", text.tok_basic(F.col("text")).alias("terms")))


@query(f"WITH {_GROWTH} SELECT * FROM growth")
def heaps_growth(spark, d):
    return _growth(spark, d)


@query(f"WITH {_GROWTH} SELECT round(regr_slope(ln(n_terms), ln(n_tokens)), 7) AS beta, round(exp(regr_intercept(ln(n_terms), ln(n_tokens))), 5) AS k FROM growth WHERE n_tokens > 0")
def heaps_fit(spark, d):
    return stats.heaps_fit(_growth(spark, d)).select(F.round("beta", 7).alias("beta"), F.round("k", 5).alias("k"))


# index, boolean and ranked search


@query(f"WITH {_POST} SELECT term, doc_id, tf FROM post WHERE term IN ('the', 'und')")
def posting_lookup(spark, d):
    return _some(spark, d, ["the", "und"])


@query(f"WITH {_POST} SELECT term, doc_id, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term ORDER BY doc_id) AS gap FROM post")
def dgaps(spark, d):
    return index.with_gaps(_posts(spark, d)).select("term", "doc_id", "gap")


@query(f"WITH {_POST}, r AS (SELECT term, doc_id, row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1 AS place, floor(sqrt(count(*) OVER (PARTITION BY term)))::BIGINT AS s FROM post), p AS (SELECT term, place, doc_id, lead(doc_id) OVER (PARTITION BY term ORDER BY place) AS skip_to FROM r WHERE place % s = 0) SELECT term, place, doc_id, skip_to FROM p WHERE skip_to IS NOT NULL")
def skiplist_build(spark, d):
    return index.skip_lists(_posts(spark, d)).withColumnRenamed("at", "place")


@query(f"WITH {_POST}, g AS (SELECT term, tf, doc_id, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term ORDER BY doc_id) AS gap FROM post), t AS (SELECT sum(greatest(1, ceil(length(bin(doc_id)) / 7.0))) AS a, sum(greatest(1, ceil(length(bin(gap)) / 7.0))) AS b, ceil(sum(2 * length(bin(tf)) - 1) / 8.0) AS c FROM g GROUP BY term) SELECT sum(a)::BIGINT AS bytes_ids, sum(b)::BIGINT AS bytes_gaps, sum(c)::BIGINT AS bytes_counts FROM t")
def compress_report(spark, d):
    return index.code_sizes(_posts(spark, d))


@query(f"WITH {_POST} SELECT term, doc_id FROM post")
def compress_index(spark, d):
    return index.decompress(index.compress(_posts(spark, d)))


@query(f"WITH {_POST}, f AS (SELECT doc_id, bool_or(term = 'the') AS a, bool_or(term = 'of') AS b, bool_or(term = 'und') AS c FROM post GROUP BY doc_id) SELECT d.doc_id FROM documents d LEFT JOIN f USING (doc_id) WHERE (coalesce(a, false) AND coalesce(b, false)) OR NOT coalesce(c, false)")
def bool_eval(spark, d):
    return boolean.evaluate(_some(spark, d, ["the", "of", "und"]), _docs(spark, d), "(the & of) | ~und")


@query(f"WITH {_POST} SELECT doc_id FROM post WHERE term = 'the' INTERSECT SELECT doc_id FROM post WHERE term = 'de'")
def and_skip(spark, d):
    return boolean.intersect(_some(spark, d, ["the", "de"]), "the", "de")


@query(f"WITH {_POST}, {_Q}, qn AS (SELECT sqrt(sum(qtf * qtf)) AS qn FROM q WHERE term IN (SELECT term FROM post)), {_STATS} " + _top("SELECT doc_id, sum(qtf * tf) / (any_value(qn) * any_value(norm)) AS score FROM post JOIN q USING (term) JOIN st USING (doc_id), qn GROUP BY doc_id"))
def cosine_daat(spark, d):
    return rank.cosine(_some(spark, d, [*QUERY]), _asked(spark), 10, _posts(spark, d)).select("doc_id", "score", "rank")


@query(f"WITH {_POST}, {_Q} " + _top("SELECT doc_id, sum(qtf)::DOUBLE AS score FROM post JOIN q USING (term) GROUP BY doc_id"))
def overlap_daat(spark, d):
    return rank.overlap(_some(spark, d, [*QUERY]), _asked(spark), 10).select("doc_id", "score", "rank")


@query(f"WITH {_POST}, {_Q}, s AS (SELECT doc_id, sum(qtf)::DOUBLE AS score, min(pos) AS pos FROM post JOIN q USING (term) GROUP BY doc_id) SELECT doc_id, score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, pos, doc_id)::INT AS rank FROM s) WHERE rank <= 10")
def overlap_taat(spark, d):
    return rank.overlap(_some(spark, d, [*QUERY]), _asked(spark), 10, by_position=True).select("doc_id", "score", "rank")


@query(f"WITH {_VOCAB}, n AS (SELECT count(*) AS n FROM documents) SELECT doc_id, term, round((1 + ln(tf)) * ln(n / (df + 1e-10)), 7) AS weight FROM post JOIN vocab USING (term), n")
def tfidf_matrix(spark, d):
    docs = _docs(spark, d)
    return rank.tfidf(_posts(spark, d), docs.count()).select("doc_id", "term", F.round("weight", 7).alias("weight"))


@query(f"""WITH {_VOCAB}, {_Q}, n AS (SELECT count(*)::DOUBLE AS n FROM documents), w AS (SELECT doc_id, term, (1 + ln(tf)) * ln(n / (df + 1e-10)) AS weight FROM post JOIN vocab USING (term), n WHERE term IN (SELECT term FROM q)),
p AS (SELECT * FROM w WHERE weight > 0), dd AS (SELECT term, count(*) AS df FROM p GROUP BY term), qw AS (SELECT term, (1 + ln(qtf)) * ln(n / (coalesce(dd.df, 0) + 1)) AS qw FROM q JOIN (SELECT term FROM vocab) USING (term) LEFT JOIN dd USING (term), n), qn AS (SELECT sqrt(sum(qw * qw)) AS qn FROM qw) """ + _top("SELECT doc_id, sum(qw * weight) / (any_value(qn) * sqrt(sum(weight * weight))) AS score FROM p JOIN qw USING (term), qn GROUP BY doc_id"))
def vsm_search(spark, d):
    return rank.vector_search(_some(spark, d, [*QUERY]), _asked(spark), _docs(spark, d).count(), 10).select("doc_id", "score", "rank")


def _model(formula: str) -> str:
    return f"WITH {_VOCAB}, {_Q}, {_STATS} " + _top(f"SELECT doc_id, sum({formula}) AS score FROM post JOIN q USING (term) JOIN vocab USING (term) JOIN st USING (doc_id), g GROUP BY doc_id")


@query(_model("9.0 * qtf / (8.0 + qtf) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avdl)) * log2((n - df + 0.5) / (df + 0.5))"))
def bm25(spark, d):
    return rank.bm25(_some(spark, d, [*QUERY]), _asked(spark), 10, _lengths(spark, d)).select("doc_id", "score", "rank")


@query(_model("qtf * 1.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avdl)) * log2(n / df + 1)"))
def tfidf_robertson(spark, d):
    return rank.tfidf_robertson(_some(spark, d, [*QUERY]), _asked(spark), 10, _lengths(spark, d)).select("doc_id", "score", "rank")


@query(_model("qtf * log2(1 + 0.15 * tf * tokens / (0.85 * cf * dl))"))
def hiemstra_lm(spark, d):
    return rank.hiemstra(_some(spark, d, [*QUERY]), _asked(spark), 10, _lengths(spark, d)).select("doc_id", "score", "rank")


# evaluation: all topics at once, depth 1000


_RUN = f"{_VOCAB}, {_TOPICS}, {_STATS}, sc AS (SELECT qid, doc_id, round(sum(9.0 * qtf / (8.0 + qtf) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avdl)) * log2((n - df + 0.5) / (df + 0.5))), 9) AS score FROM post JOIN topics USING (term) JOIN vocab USING (term) JOIN st USING (doc_id), g GROUP BY qid, doc_id), run AS (SELECT * FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC)::INT AS rank FROM sc) WHERE rank <= 1000)"
_JUDGED = f"{_RUN}, qrels AS (SELECT qid, doc_id FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), (SELECT DISTINCT qid FROM topics)), need AS (SELECT qid, count(*) AS n_rel FROM qrels GROUP BY qid), j AS (SELECT run.qid, rank, (qrels.doc_id IS NOT NULL)::INT AS rel, n_rel, sum((qrels.doc_id IS NOT NULL)::INT) OVER (PARTITION BY run.qid ORDER BY rank) AS found FROM run LEFT JOIN qrels ON run.qid = qrels.qid AND run.doc_id = qrels.doc_id JOIN need ON need.qid = run.qid)"
_PER = f"{_JUDGED}, idcg AS (SELECT qid, sum(1 / log2(i + 1)) AS idcg FROM need, range(1, 11) t(i) WHERE i <= n_rel GROUP BY qid), per AS (SELECT qid, sum(CASE WHEN rank <= 10 THEN rel ELSE 0 END) / 10 AS p_at_k, sum(CASE WHEN rel = 1 THEN found / rank ELSE 0 END) / any_value(n_rel) AS ap, sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) ELSE 0 END) / any_value(idcg) AS ndcg FROM j JOIN idcg USING (qid) GROUP BY qid)"


def _run(spark, d):
    topics = _topics(spark, d).drop("pos")
    return rank.bm25(_some(spark, d, topics), topics, 1000, _lengths(spark, d))


@query(f"WITH {_RUN} SELECT * FROM run")
def batch_search(spark, d):
    return _run(spark, d).select("qid", "doc_id", "rank")


@query(f"WITH {_PER} SELECT qid, round(p_at_k, 7) AS p_at_k, round(ap, 7) AS ap, round(ndcg, 7) AS ndcg FROM per")
def eval_perquery(spark, d):
    return evaluate.per_query(_run(spark, d), _qrels(spark, d)).select("qid", *[F.round(c, 7).alias(c) for c in ("p_at_k", "ap", "ndcg")])


@query(f"WITH {_PER} SELECT round(avg(p_at_k), 7) AS p_at_k, round(avg(ap), 7) AS map, round(avg(ndcg), 7) AS ndcg FROM per")
def eval_global(spark, d):
    return evaluate.overall(evaluate.per_query(_run(spark, d), _qrels(spark, d))).select(*[F.round(c, 7).alias(c) for c in ("p_at_k", "map", "ndcg")])


@query(f"WITH {_JUDGED} SELECT n.qid, level::INT AS level, round(coalesce((SELECT max(found / rank) FROM j WHERE j.qid = n.qid AND rel = 1 AND 10 * found >= level * j.n_rel), 0), 7) AS precision FROM need n, range(0, 11) t(level)")
def iprec_at_recall(spark, d):
    return evaluate.interpolated(_run(spark, d), _qrels(spark, d)).withColumn("precision", F.round("precision", 7))


@query(f"WITH {_PER} SELECT round(median(p_at_k), 7) AS median, round(avg(p_at_k), 7) AS mean, (SELECT round(p_at_k, 7) FROM per GROUP BY p_at_k ORDER BY count(*) DESC, p_at_k LIMIT 1) AS mode FROM per")
def metric_summary(spark, d):
    return evaluate.summary(evaluate.per_query(_run(spark, d), _qrels(spark, d)), "p_at_k").select(*[F.round(c, 7).alias(c) for c in ("median", "mean", "mode")])


@query("SELECT round(corr(o_totalprice, o_custkey), 7) AS pearson, round(corr(rx, ry), 7) AS spearman, count(*) AS n FROM (SELECT *, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2 AS rx, rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2 AS ry FROM orders)")
def rank_corr(spark, d):
    return evaluate.correlation(_table(spark, d, "orders"), "o_totalprice", "o_custkey").select("n", F.round("pearson", 7).alias("pearson"), F.round("spearman", 7).alias("spearman"))


@query(f"""WITH gr AS (SELECT doc_id, lang, unnest(string_split(regexp_replace(translate(lower(text), 'áéíóúüÁÉÍÓÚÜ', 'aeiouuAEIOUU'), '[^\\p{{L}}\\p{{M}}_]', '', 'g'), '')) AS gram FROM documents), x AS (SELECT doc_id, gram, count(*) AS x FROM gr WHERE gram <> '' GROUP BY ALL), y AS (SELECT lang, gram, count(*) AS y FROM gr WHERE gram <> '' GROUP BY ALL),
l AS (SELECT DISTINCT lang FROM y), dl AS (SELECT DISTINCT doc_id, lang FROM x, l), u AS (SELECT doc_id, lang, gram, x, NULL AS y FROM x, l UNION ALL SELECT doc_id, lang, gram, NULL, y FROM dl JOIN y USING (lang)), p AS (SELECT doc_id, lang, gram, coalesce(sum(x), 0) AS x, coalesce(sum(y), 0) AS y FROM u GROUP BY ALL), r AS (SELECT doc_id, lang, round(corr(x, y), 10) AS r FROM p GROUP BY ALL)
SELECT doc_id, lang AS lang_pred FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY r DESC, lang) AS k FROM r WHERE r > -1) WHERE k = 1""")
def langid_char(spark, d):
    return correlate.identify_lines(_lines(spark, d), 1)


@query()
def langid_bigram_confusion(spark, d):
    said = correlate.identify_lines(_lines(spark, d), 2)
    return stats.confusion(said.join(_docs(spark, d).select("doc_id", F.col("lang").alias("truth")), "doc_id").withColumnRenamed("lang_pred", "predicted"), ("de", "en", "es", "fr"))


# graphs


def _rank_sql(rounds: int) -> str:
    steps = [f"{_EDGES}, nodes AS MATERIALIZED (SELECT src AS node FROM edges UNION SELECT dst FROM edges), n AS (SELECT count(*)::DOUBLE AS n FROM nodes), deg AS (SELECT src, count(*) AS out FROM edges GROUP BY src), r0 AS MATERIALIZED (SELECT node, 1 / n AS score FROM nodes, n)"]
    for k in range(rounds):
        steps.append(f"i{k} AS MATERIALIZED (SELECT dst AS node, sum(score / out) AS got FROM edges JOIN r{k} ON node = src JOIN deg USING (src) GROUP BY dst), m{k} AS (SELECT coalesce(sum(got), 0) AS moved FROM i{k}), r{k + 1} AS MATERIALIZED (SELECT node, 0.15 / n + 0.85 * (coalesce(got, 0) + (1 - moved) / n) AS score FROM nodes LEFT JOIN i{k} USING (node), n, m{k})")
    return f"WITH {', '.join(steps)} SELECT node, round(score, 9) AS score FROM r{rounds}"


@query(_rank_sql(8))
def pagerank(spark, d):
    return graph.pagerank(_edges(spark, d)).withColumn("score", F.round("score", 9))


@query(f"WITH {_EDGES}, b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), h1 AS (SELECT dst AS node FROM b WHERE src = (SELECT min(src) FROM edges)), h2 AS (SELECT DISTINCT b.dst AS node FROM h1 JOIN b ON b.src = h1.node) SELECT node, CASE WHEN node IN (SELECT node FROM h1) THEN 1 ELSE 2 END AS hops FROM (SELECT node FROM h1 UNION SELECT node FROM h2) WHERE node <> (SELECT min(src) FROM edges)")
def khop(spark, d):
    edges = _edges(spark, d)
    return graph.khop(edges, edges.agg(F.min("src")).first()[0])


@query(f"WITH RECURSIVE {_EDGES}, c AS (SELECT DISTINCT src AS url, 0 AS depth FROM edges WHERE src = (SELECT min(src) FROM edges) UNION SELECT dst, depth + 1 FROM c JOIN edges ON src = url WHERE depth < 2), v AS (SELECT url, min(depth) AS depth FROM c GROUP BY url) SELECT depth::INT AS depth, count(*) AS pages FROM v GROUP BY depth")
def crawl_depths(spark, d):
    edges = _edges(spark, d)
    seed = edges.agg(F.min("src").alias("url")).withColumn("seq", F.lit(0))
    visited, _ = graph.crawl(graph.nodes(edges).withColumnRenamed("node", "url"), edges, seed, max_depth=2)
    return graph.depth_distribution(visited, 2).select("depth", F.col("pages").cast("long").alias("pages")).where("pages > 0")


@query(f"WITH {_EDGES}, a AS (SELECT src AS item, row_number() OVER (ORDER BY count(*) DESC, src) AS rank FROM edges GROUP BY src), b AS (SELECT dst AS item, row_number() OVER (ORDER BY count(*) DESC, dst) AS rank_b FROM edges GROUP BY dst), k AS (SELECT greatest(rank, rank_b) AS k, count(*) AS n FROM a JOIN b USING (item) GROUP BY 1) SELECT a.rank AS k, round(100.0 * sum(coalesce(n, 0)) OVER (ORDER BY a.rank) / a.rank, 7) AS percent FROM a LEFT JOIN k ON k.k = a.rank")
def overlap_at_k(spark, d):
    edges = _edges(spark, d)

    def ranking(c):
        degree = edges.groupBy(F.col(c).alias("item")).agg((-F.count(F.lit(1))).alias("less")).checkpoint()
        return ordered.number(ordered.split(degree, "less", "item"), "rank", "less", "item").select("item", F.col("rank").cast("long").alias("rank"))

    return evaluate.rank_overlap(ranking("src"), ranking("dst")).withColumn("percent", F.round("percent", 7))


@query(f"WITH {_PER}, e AS (SELECT min(ap) AS lo, max(ap) AS hi FROM per) SELECT CASE WHEN hi > lo THEN least(floor((ap - lo) / (hi - lo) * 20), 19)::BIGINT ELSE 0 END AS bin, count(*) AS n FROM (SELECT round(ap, 9) AS ap FROM per), (SELECT round(lo, 9) AS lo, round(hi, 9) AS hi FROM e) GROUP BY bin")
def metric_histogram(spark, d):
    return evaluate.histogram(evaluate.per_query(_run(spark, d), _qrels(spark, d)).select(F.round("ap", 9).alias("ap")), "ap")


@query(f"WITH {_EDGES} SELECT max(dst) AS last_node, count(*) AS n_edges FROM edges WHERE src IN (SELECT dst FROM edges)")
def subgraph(spark, d):
    edges = _edges(spark, d)
    kept = edges.select(F.col("dst").alias("url")).distinct()
    return graph.subgraph(edges, kept).agg(F.max("dst").alias("last_node"), F.count(F.lit(1)).alias("n_edges"))
