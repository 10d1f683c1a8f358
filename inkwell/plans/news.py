"""The registered news queries: each operator over whole tables, with the same in SQL."""

from __future__ import annotations

import gzip
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.operators import analysis, filters
from inkwell.sources import crawl

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, prefix: tuple[str, ...] = ("articles",)):
    """Registers a query, and its SQL behind the common table expressions that it names."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = ("WITH " + ",\n".join(_CTE[p] for p in prefix) + "\n" if prefix else "") + sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def articles(spark: SparkSession, d: str) -> DataFrame:
    """documents as articles: the first line is the title, URL and date follow from source, language and id."""
    title = F.substring_index("text", "\n", 1)
    when = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(CAST(doc_id % 365 AS INT), 0, 0, (doc_id * 7919) % 86400)")
    url = F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "lang", F.lit("/"), F.col("doc_id").cast("string"))
    return _t(spark, d, "documents").select(F.col("doc_id").alias("id"), title.alias("title"), F.expr("substring(text, length(substring_index(text, '\\n', 1)) + 2)").alias("text"), url.alias("url"), when.alias("publish_date"), "lang", "source")


_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"


def _words_sql(c: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace(lower({c}), '[^\\p{{L}}\\s]+', '', 'g'), '\\s+'), lambda t: t <> '')"


def _tokens_sql(c: str) -> str:
    return f"list_filter({_words_sql(c)}, lambda t: NOT list_contains({_STOP}, t))"


_BUCKET = "CASE WHEN n <= 200 THEN 'wc200' WHEN n <= 500 THEN 'wc500' WHEN n <= 1000 THEN 'wc1000' WHEN n <= 2000 THEN 'wc2000' WHEN n <= 3000 THEN 'wc3000' WHEN n <= 5000 THEN 'wc5000' ELSE 'wcmax' END"


def _in(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_SCORE = f"len(list_filter(w, lambda t: list_contains({_in(X.POSITIVE)}, t))) - len(list_filter(w, lambda t: list_contains({_in(X.NEGATIVE)}, t)))"
_NAMES = r"(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+)"
_CTE = {
    "articles": """articles AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, substring(text, length(split_part(text, chr(10), 1)) + 2) AS "text",
  'https://' || source || '.example.org/' || lang || '/' || doc_id AS url,
  TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 365 AS INT)) + to_seconds((doc_id * 7919) % 86400) AS publish_date, lang, source FROM documents)""",
    "tokens": f"tokens AS MATERIALIZED (SELECT *, {_tokens_sql('title')} AS tt, {_tokens_sql('text')} AS xt FROM articles)",
    "idf": "m AS (SELECT count(*) AS m FROM articles),\nidf AS MATERIALIZED (SELECT word, count(*) AS df, ln(((SELECT m FROM m) + 1.0) / (count(*) + 1)) AS idf FROM (SELECT id, unnest(list_distinct(list_concat(tt, xt))) AS word FROM tokens) GROUP BY word)",
    "top": """tf AS (SELECT 'title' AS field, id, word, count(*) AS tf FROM (SELECT id, unnest(tt) AS word FROM tokens) GROUP BY ALL UNION ALL SELECT 'text', id, word, count(*) FROM (SELECT id, unnest(xt) AS word FROM tokens) GROUP BY ALL),
top AS MATERIALIZED (SELECT * FROM (SELECT field, id, word, tf * idf AS value, row_number() OVER (PARTITION BY field, id ORDER BY tf * idf DESC, word) AS rank FROM tf JOIN idf USING (word)) WHERE rank <= 20)""",
    "graph": """both_fields AS (SELECT id FROM top GROUP BY id HAVING count(DISTINCT field) = 2),
vals AS MATERIALIZED (SELECT id, word, max(value) FILTER (WHERE field = 'title') AS title_value, max(value) FILTER (WHERE field = 'text') AS text_value FROM top WHERE id IN (SELECT id FROM both_fields) GROUP BY id, word),
weights AS MATERIALIZED (SELECT id, word, coalesce(title_value, 0) / 1 + coalesce(text_value, 0) / 2 AS weight FROM vals WHERE coalesce(title_value, 0) / 1 + coalesce(text_value, 0) / 2 > 0),
nodes AS MATERIALIZED (SELECT word FROM vals GROUP BY word HAVING count(*) > 1),
top20 AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, word) AS rank FROM weights) WHERE rank <= 20)""",
    "features": f"""extra AS (SELECT id, {_BUCKET} AS length, CASE WHEN s > 0 THEN 'positive_1' WHEN s < 0 THEN 'negative_1' ELSE 'neutral_1' END AS mood,
  'm_' || month(publish_date) AS month, 'd_' || day(publish_date) AS day, 'wd_' || (dayofweek(publish_date) + 1) AS weekday
  FROM (SELECT id, publish_date, len(tt) + len(xt) AS n, {_SCORE} AS s FROM (SELECT *, {_words_sql('text')} AS w FROM tokens)))""",
    "stories": f"""mention AS MATERIALIZED (SELECT id, lower(e) AS entity, min(instr(body, e) - 1) AS position
  FROM (SELECT id, body, unnest(list_distinct(regexp_extract_all(body, '{_NAMES}', 1))) AS e FROM (SELECT id, title || '. ' || text AS body FROM articles)) GROUP BY ALL)""",
    "dag": """pairs AS (SELECT a.id AS old_id, b.id AS new_id, date_diff('day', x.publish_date, y.publish_date) AS days, list_sort(list(DISTINCT a.entity)) AS entities
  FROM mention a JOIN mention b ON a.entity = b.entity AND a.position < 1000 AND b.position < 1000 JOIN articles x ON x.id = a.id JOIN articles y ON y.id = b.id WHERE x.publish_date < y.publish_date GROUP BY ALL),
edges AS (SELECT old_id, new_id, entities FROM (SELECT *, row_number() OVER (PARTITION BY old_id, entities ORDER BY days, new_id) AS r FROM pairs) WHERE r = 1)""",
}
# Words get vectors by a digest; components are whole numbers, so that sums don't depend on their order.
_CTE["vecs"] = "vecs AS (SELECT word, list_transform(embedding, lambda x: floor(x::DOUBLE * 1000000)) AS e FROM (SELECT word, ('0x' || substr(md5(word), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings) AS vec_id FROM (SELECT DISTINCT word FROM top20)) JOIN embeddings USING (vec_id))"
_CTE["sums"] = "sums AS (SELECT id, string_agg(x::BIGINT, ',' ORDER BY k) AS v FROM (SELECT id, k, sum(x) AS x FROM (SELECT id, unnest(e) AS x, generate_subscripts(e, 1) AS k FROM top20 JOIN vecs USING (word)) GROUP BY id, k) GROUP BY id)"
_CTE["node_sums"] = _CTE["sums"].replace("sums AS", "node_sums AS", 1).replace("JOIN vecs USING (word)", "JOIN vecs USING (word) WHERE word IN (SELECT word FROM nodes)")
_TFIDF = ("articles", "tokens", "idf", "top")
_GRAPH = (*_TFIDF, "graph")

START, END = date(2024, 2, 10), date(2024, 3, 15)


@query("SELECT id, url FROM articles WHERE publish_date::DATE BETWEEN DATE '2024-02-10' AND DATE '2024-03-15'")
def date_range(spark, d):
    return filters.date_range(articles(spark, d), START, END).select("id", "url")


@query("SELECT id, url FROM articles WHERE contains(url, 'src1.example.org/en') OR contains(url, 'src2.')")
def on_sites(spark, d):
    return filters.on_sites(articles(spark, d), ["src1.example.org/en", "src2."]).select("id", "url")


@query("SELECT id, url FROM articles WHERE regexp_extract(url, '^https?://([^/]+)', 1) IN ('src1.example.org', 'src2.example.org')")
def site_host_match(spark, d):
    return filters.on_hosts(articles(spark, d), ["src1.example.org", "src2.example.org"]).select("id", "url")


@query("SELECT id, url FROM articles WHERE NOT url LIKE '%/de/%' AND NOT url LIKE '%src1%'")
def exclude_url(spark, d):
    return filters.exclude_in_url(articles(spark, d), ["*/de/*", "*src1*"]).select("id", "url")


@query("SELECT id, url FROM articles WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def from_urls_semi(spark, d):
    a = articles(spark, d)
    good = _t(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id")).distinct()
    return filters.from_urls(a, a.join(good, "id").select("url")).select("id", "url")


@query(f"SELECT id FROM articles WHERE list_has_any({_tokens_sql(chr(39).join(['title || ', '. ', ' || text']))}, ['clown', 'erst', 'nicht'])")
def keyword_tokens(spark, d):
    return filters.keyword_tokens(articles(spark, d), ["clown", "erst", "nicht"]).select("id")


@query("SELECT id FROM articles WHERE contains(title, 'Licensed') OR contains(text, 'Licensed') OR contains(title, 'token') OR contains(text, 'token')")
def keyword_substring(spark, d):
    return filters.keyword_substring(articles(spark, d), ["Licensed", "token"]).select("id")


_PLACES = ("The", "Und", "De", "La", "Thing")
_PLACES_SQL = "places AS (SELECT id, list_filter(['The', 'Und', 'De', 'La', 'Thing'], lambda c: contains(' ' || regexp_replace(title || '. ' || text, '[^\\p{L}]+', ' ', 'g') || ' ', ' ' || c || ' ')) AS c FROM articles)"
_CTE["places"] = _PLACES_SQL


@query("SELECT id, unnest(list_filter(c, lambda x: x <> 'La')) AS country FROM places WHERE len(list_filter(c, lambda x: x <> 'La')) >= 2 AND list_has_any(c, ['The', 'De'])", ("articles", "places"))
def mentions_countries(spark, d):
    return filters.mentions_countries(articles(spark, d), ["The", "De"], 2, ["La"], True, _PLACES).select("id", F.explode("countries").alias("country"))


_LANGS = ", ".join(f"len(list_filter(w, lambda t: list_contains({_in(v)}, t))) AS {k}" for k, v in sorted(X.LANGUAGE_WORDS.items()))


@query(f"SELECT id, url FROM (SELECT id, url, {_LANGS} FROM (SELECT id, url, {_words_sql(chr(39).join(['title || ', '. ', ' || text']))} AS w FROM articles)) WHERE en > 0 AND en > de AND en >= es AND en >= fr")
def in_language(spark, d):
    return filters.in_language(articles(spark, d), "en").select("id", "url")


@query("SELECT source || '/' || lang AS url, min(id) AS id FROM articles GROUP BY ALL")
def distinct_url(spark, d):
    a = articles(spark, d).select("id", F.concat("source", F.lit("/"), "lang").alias("url"))
    return filters.distinct_urls(a, [F.col("id")])


@query("SELECT id, publish_date FROM articles ORDER BY publish_date DESC, id LIMIT 50")
def limit_topn(spark, d):
    from inkwell.plans.pipeline import Pipeline

    return Pipeline(articles(spark, d).orderBy(F.desc("publish_date"), "id")).limit_num_articles(50).get_features(["id", "publish_date"]).collect()


@query("SELECT url FROM articles WHERE NOT url LIKE '%/fr/%'")
def url_only(spark, d):
    from inkwell.plans.pipeline import Pipeline

    return Pipeline(articles(spark, d)).exclude_in_url(["*/fr/*"]).url_only().collect()


@query("SELECT id, length(title) || ':' || title AS title FROM articles WHERE title IS NOT NULL")
def apply_udf(spark, d):
    @F.pandas_udf("string")
    def measured(titles: pd.Series) -> pd.Series:
        return titles.map(lambda t: f"{len(t)}:{t}")

    return filters.apply_udf(articles(spark, d), measured, "title").select("id", "title")


_INDEX_CTE = "idx AS (SELECT url, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+(/[^?#]*)?', 1) AS url_path, page_id FROM pages)"
_CTE["index"] = _INDEX_CTE


def _index(spark, d):
    host, path = X.host(F.col("url")), F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)?", 1)
    return _t(spark, d, "pages").select("url", path.alias("url_path"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("url_host_registered_domain"), F.lit("warc").alias("subset"), F.concat(F.lit("CRAWL-"), (F.col("page_id") % 3).cast("string")).alias("crawl"), F.when(F.col("url").contains("/en/"), "eng").when(F.col("url").contains("/fr/"), "fra").alias("content_languages"), F.lit("f").alias("warc_filename"), (F.col("page_id") * 10).cast("int").alias("warc_record_offset"), F.lit(10).alias("warc_record_length"), F.lit("utf-8").alias("content_charset"))


@query("SELECT url, url_path, (page_id * 10)::INTEGER AS warc_record_offset FROM idx WHERE page_id % 3 IN (0, 1) AND lower(regexp_extract(host, '([^.]+\\.[^.]+)$', 1)) IN ('example.com', 'example.org') AND (contains(url, '/en/') OR NOT contains(url, '/fr/')) AND length(url_path) > 1 AND NOT url_path LIKE '%/de/%'", ("index",))
def index_query(spark, d):
    out = crawl.index_filter(_index(spark, d), ["CRAWL-0", "CRAWL-1"], ["example.com", "example.org"], "en", blacklist=["*/de/*"], start=date(2020, 1, 1), end=date(2024, 1, 1), today=date(2026, 1, 1))
    return out.select("url", "url_path", "warc_record_offset")


_CRAWLS = ("January 2023", "November/December 2023", "May 2021", "Winter 2013", "October 2022", "March 2022", "2009 - 2010", "September 2024")


@query("SELECT id FROM (VALUES ('January 2023'), ('November/December 2023'), ('October 2022'), ('September 2024')) v(id)", ())
def crawls_since(spark, d):
    return crawl.crawls_since(spark.createDataFrame([(c,) for c in _CRAWLS], "id string"), date(2022, 6, 1))


@query("SELECT strftime(g, '%Y%m%d') AS prefix FROM generate_series(TIMESTAMP '2024-02-10', TIMESTAMP '2024-04-14', INTERVAL 1 DAY) t(g)", ())
def news_listing_days(spark, d):
    return crawl.news_listing_days(spark, START, END)


@query("SELECT id, '/' || (1985 + id % 45) || '/x' AS path FROM articles WHERE NOT ((1985 + id % 45) BETWEEN 1991 AND 2026 AND (1985 + id % 45) NOT BETWEEN 2010 AND 2012)")
def wrong_year_path(spark, d):
    a = articles(spark, d).select("id", F.concat(F.lit("/"), (F.col("id") % 45 + 1985).cast("string"), F.lit("/x")).alias("path"))
    return a.where(~crawl.wrong_year(F.col("path"), date(2010, 1, 1), date(2012, 1, 1), date(2026, 1, 1)))


@query("SELECT year(publish_date) AS year, count(*) AS count FROM articles GROUP BY ALL")
def articles_by_year(spark, d):
    return analysis.articles_over_time(articles(spark, d), "year")


@query("SELECT year(publish_date) AS year, month(publish_date) AS month, count(*) AS count FROM articles GROUP BY ALL")
def articles_by_month(spark, d):
    return analysis.articles_over_time(articles(spark, d), "month")


@query("SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]+)', 1) AS domain FROM pages", ())
def article_domains(spark, d):
    return analysis.article_domains(_t(spark, d, "pages"))


@query("SELECT year(publish_date) AS year, month(publish_date) AS month, count(*) FILTER (WHERE contains(title || '. ' || text, 'the')) AS the, count(*) FILTER (WHERE contains(title || '. ' || text, 'nicht')) AS nicht FROM articles GROUP BY ALL")
def keywords_over_time(spark, d):
    return analysis.keywords_over_time(articles(spark, d), ["the", "nicht"])


@query("SELECT country, n AS count, round(n / sum(n) OVER (), 6) AS share FROM (SELECT country, count(*) AS n FROM (SELECT unnest(c) AS country FROM places) GROUP BY country)", ("articles", "places"))
def country_share(spark, d):
    c = filters.mentions_countries(articles(spark, d), output=True, gazetteer=_PLACES)
    return analysis.country_shares(c).withColumn("share", F.round("share", 6))


@query("SELECT id, len(tt)::BIGINT AS n_title, len(xt)::BIGINT AS n_text, md5(array_to_string(xt, ' ')) AS tokens FROM tokens", ("articles", "tokens"))
def tokenize(spark, d):
    t = analysis.with_tokens(articles(spark, d))
    return t.select("id", F.size("title_tokens").cast("bigint").alias("n_title"), F.size("text_tokens").cast("bigint").alias("n_text"), F.md5(F.array_join("text_tokens", " ")).alias("tokens"))


@query("SELECT id, word, tf FROM tf WHERE field = 'text'", _TFIDF)
def term_freq(spark, d):
    return analysis.term_frequency(analysis.with_tokens(articles(spark, d)), "text_tokens")


@query("SELECT word, df, round(idf, 6) AS idf FROM idf", _TFIDF[:3])
def doc_freq_idf(spark, d):
    return analysis.inverse_frequency(analysis.with_tokens(articles(spark, d))).withColumn("idf", F.round("idf", 6))


def _top(spark, d, field):
    return analysis.top_words(articles(spark, d), field, 20).withColumn("value", F.round("value", 6))


@query("SELECT id, word, round(value, 6) AS value, rank FROM top WHERE field = 'title'", _TFIDF)
def tfidf_top_n_title(spark, d):
    return _top(spark, d, "title")


@query("SELECT id, word, round(value, 6) AS value, rank FROM top WHERE field = 'text'", _TFIDF)
def tfidf_top_n_text(spark, d):
    return _top(spark, d, "text")


def _tfidf(spark, d):
    return analysis.top_tfidf(articles(spark, d), 20)


def _values(spark, d):
    return analysis.word_values(_tfidf(spark, d))


@query("SELECT word FROM nodes", _GRAPH)
def word_nodes(spark, d):
    return analysis.word_nodes(_values(spark, d)).select("word")


@query("SELECT 'article' AS kind, title AS label FROM articles WHERE id IN (SELECT id FROM both_fields) UNION ALL SELECT 'word', word FROM nodes", _GRAPH)
def node_union(spark, d):
    arts, nodes, _ = analysis.tfidf_graph(_tfidf(spark, d))
    both = analysis.all_nodes(arts, nodes)
    return both.select(F.when(F.col("word").isNull(), "article").otherwise("word").alias("kind"), F.coalesce("word", "title").alias("label"))


@query("SELECT id, word, round(title_value, 6) AS title_value, round(text_value, 6) AS text_value FROM vals", _GRAPH)
def edges_full_outer(spark, d):
    return _values(spark, d).select("id", "word", F.round("title_value", 6).alias("title_value"), F.round("text_value", 6).alias("text_value"))


@query("SELECT id AS id1, word, round(weight, 6) AS weight FROM weights JOIN nodes USING (word)", _GRAPH)
def tfidf_graph_edges(spark, d):
    _, nodes, edges = analysis.tfidf_graph(_tfidf(spark, d))
    return edges.join(nodes.withColumnRenamed("id", "id2"), "id2").select("id1", "word", F.round("weight", 6).alias("weight"))


@query("SELECT id, word, round(weight, 6) AS weight, rank FROM top20", _GRAPH)
def article_top20(spark, d):
    return analysis.article_top_words(_values(spark, d)).withColumn("weight", F.round("weight", 6))


@query("SELECT id, length FROM extra", ("articles", "tokens", "features"))
def num_words_bucket(spark, d):
    t = analysis.with_tokens(articles(spark, d))
    return t.select("id", analysis.length_bucket(analysis.token_total()).alias("length"))


@query("SELECT id, month, day, weekday FROM extra", ("articles", "tokens", "features"))
def date_features(spark, d):
    return articles(spark, d).select("id", *analysis.date_features(F.col("publish_date")))


@query("SELECT id, mood FROM extra", ("articles", "tokens", "features"))
def sentiment(spark, d):
    return articles(spark, d).select("id", X.sentiment(F.col("text")).alias("mood"))


_NODE_VALUES = "SELECT id, concat_ws(',', (SELECT string_agg(word, ',' ORDER BY rank) FROM top20 t WHERE t.id = e.id), length, mood, month, day, weekday) AS value FROM extra e WHERE id IN (SELECT id FROM top20)"


@query(_NODE_VALUES, (*_GRAPH, "features"))
def node_values(spark, d):
    return analysis.node_values(_tfidf(spark, d), features=analysis.article_features(articles(spark, d)))


@query(f"SELECT value, count(*) AS n FROM (SELECT value FROM ({_NODE_VALUES}) UNION ALL SELECT word FROM nodes) GROUP BY value", (*_GRAPH, "features"))
def news2vec_nodes(spark, d):
    return analysis.news2vec_graph(_tfidf(spark, d), analysis.article_features(articles(spark, d)))[1].groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT id AS id1, count(*) AS degree, round(sum(weight), 4) AS weight FROM weights JOIN nodes USING (word) GROUP BY id", _GRAPH)
def news2vec_edges(spark, d):
    return analysis.news2vec_graph(_tfidf(spark, d))[0].groupBy("id1").agg(F.count("*").alias("degree"), F.round(F.sum("weight"), 4).alias("weight"))


@query(f"SELECT id, lower(e) AS entity, instr(body, e) - 1 AS position FROM (SELECT id, body, unnest(list_distinct(regexp_extract_all(body, '{_NAMES}', 1))) AS e FROM (SELECT id, title || '. ' || text AS body FROM articles))")
def entities_capitalised(spark, d):
    found = analysis.explode_entities(analysis.capitalised_entities(articles(spark, d)))
    return found.select("id", "entity", F.col("position").cast("bigint").alias("position"))


def _stories(spark, d):
    """All articles, and the first mention of each name in each."""
    found = analysis.capitalised_entities(articles(spark, d))
    return found, analysis.first_mentions(analysis.explode_entities(found))


@query("SELECT id, entity, position FROM mention", ("articles", "stories"))
def entities_first_mention(spark, d):
    return _stories(spark, d)[1].select("id", "entity", F.col("position").cast("bigint").alias("position"))


@query("SELECT id, entity FROM mention WHERE NOT regexp_matches(entity, 'license') AND NOT regexp_matches(entity, '^th')", ("articles", "stories"))
def entity_blacklist(spark, d):
    return analysis.blacklist(_stories(spark, d)[1], ["license", "^th"]).select("id", "entity")


@query("SELECT id, count(*) AS n, string_agg(entity, ',' ORDER BY position, entity) AS entities FROM mention GROUP BY id", ("articles", "stories"))
def entity_arrays(spark, d):
    out = analysis.collect_entities(*_stories(spark, d))
    return out.select("id", F.size("entities").cast("bigint").alias("n"), F.array_join(F.transform("entities", lambda e: e["entity"]), ",").alias("entities"))


def _dag(spark, d):
    return analysis.entity_dag(analysis.collect_entities(*_stories(spark, d)))[1]


@query("SELECT old_id, new_id, unnest(entities) AS entity FROM edges", ("articles", "stories", "dag"))
def entity_dag_edges(spark, d):
    return _dag(spark, d).select("old_id", "new_id", "entity")


@query("SELECT old_id, new_id, max(entity) AS entity FROM (SELECT old_id, new_id, unnest(entities) AS entity FROM edges) GROUP BY ALL", ("articles", "stories", "dag"))
def dag_single_edge(spark, d):
    return analysis.single_edges(_dag(spark, d))


@query("SELECT id, " + ", ".join(f"max(word) FILTER (WHERE rank = {k}) AS \"{k}\"" for k in range(1, 21)) + " FROM top20 GROUP BY id", _GRAPH)
def feature_pivot(spark, d):
    return analysis.feature_pivot(_values(spark, d))


def _vectors(spark, d, words):
    e = _t(spark, d, "embeddings")
    n = e.agg(F.count("*").alias("n")).scalar()
    at = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("bigint") % n
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000000).cast("double"))
    return words.select("word", at.alias("vec_id")).join(e, "vec_id").select(F.col("word").alias("token"), whole.alias("token_embedding"))


def _said(embedding):
    return F.array_join(F.transform(embedding, lambda x: x.cast("bigint")), ",")


@query("SELECT id, v AS embedding FROM sums", (*_GRAPH, "vecs", "sums"))
def embedding_sum(spark, d):
    top = analysis.article_top_words(_values(spark, d))
    wide = top.groupBy("id").pivot("rank", list(range(1, 21))).agg(F.max("word"))
    sums = analysis.accumulate_embeddings(wide, _vectors(spark, d, top.select("word").distinct()), analysis.FEATURE_COLUMNS)
    return sums.select("id", _said("embedding").alias("embedding"))


@query("SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages", ())
def html_title(spark, d):
    return _t(spark, d, "pages").select("page_id", filters.html_title(F.col("html")).alias("title"))


@query("SELECT page_id, CASE WHEN len(h) < 5 THEN 1.0::DOUBLE ELSE len(list_filter(h, lambda x: regexp_matches(x, '(?is)<a\\s[^>]*href'))) / len(h) END AS ratio FROM (SELECT page_id, regexp_extract_all(html, '(?is)(<h[1-6][^>]*>.*?</h[1-6]>)', 1) AS h FROM pages)", ())
def headline_link_ratio(spark, d):
    return _t(spark, d, "pages").select("page_id", filters.linked_headlines(F.col("html")).alias("ratio"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://(?:[^/@]*@)?([^/:?#]+)', 1)), '^www\\.', '') AS domain, regexp_extract(lower(regexp_extract(url, '^https?://(?:[^/@]*@)?([^/:?#]+)', 1)), '([^.]+\\.[^.]+)$', 1) AS root FROM pages", ())
def allowed_domain(spark, d):
    return _t(spark, d, "pages").select("page_id", X.allowed_domain(F.col("url")).alias("domain"), X.allowed_domain(F.col("url"), False).alias("root"))


@query("SELECT id, list_sum(p)::BIGINT AS total, len(p)::BIGINT AS n, p[1]::BIGINT AS first FROM (SELECT id, list_concat(list_transform(range(greatest(0, 100 - len(k))), lambda x: 0), k) AS p FROM (SELECT id, list_transform(xt[greatest(1, len(xt) - 99):], lambda x: length(x)) AS k FROM tokens))", ("articles", "tokens"))
def pad_tokens(spark, d):
    t = analysis.with_tokens(articles(spark, d))
    p = X.pad_tokens(F.transform("text_tokens", F.length), 100)
    return t.select("id", p.alias("p")).select("id", F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.size("p").cast("bigint").alias("n"), F.get("p", F.lit(0)).cast("bigint").alias("first"))


@query("SELECT id FROM articles WHERE title <> '' AND text <> '' AND publish_date IS NOT NULL")
def complete_articles(spark, d):
    return filters.complete(articles(spark, d)).select("id")


@query("SELECT ('0x' || substr(md5(id::VARCHAR), 1, 8))::BIGINT % greatest(1, (SELECT count(*) // 250 FROM articles)) AS batch, count(*) AS n FROM articles GROUP BY ALL")
def batch_split(spark, d):
    return analysis.batches(articles(spark, d), 250).groupBy("batch").agg(F.count("*").alias("n"))


def _archive(batches):
    """Each page as a gzipped archive of a request and a response."""
    for b in batches:
        rows = []
        for url, html in zip(b["url"], b["html"]):
            http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (html or "").encode()
            head = f"WARC-Target-URI: {url}\r\nContent-Length: "
            ask = f"WARC/1.0\r\nWARC-Type: request\r\n{head}0\r\n\r\n\r\n\r\n".encode()
            rows.append(gzip.compress(ask) + gzip.compress(f"WARC/1.0\r\nWARC-Type: response\r\n{head}{len(http)}\r\n\r\n".encode() + http + b"\r\n\r\n"))
        yield pd.DataFrame({"content": rows})


_TITLE = "trim(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'))"


@query(f"SELECT url, {_TITLE} AS title, 'ok' AS status FROM pages WHERE regexp_matches(url, '^https?://([^/@]*[.])?example[.](com|org)(/|$)')", ())
def warc_pages(spark, d):
    files = _t(spark, d, "pages").select("url", "html").mapInPandas(_archive, "content binary")
    return crawl.articles_from_warcs(files, ["example.com", "example.org"]).select("url", "title", "status")


@query()
def sample(spark, d):
    return filters.sample(articles(spark, d), 100).select("id", "url")


@query()
def classify(spark, d):
    a = articles(spark, d)
    labelled = a.join(_t(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("label")), "id")
    return analysis.classify(a, analysis.fit_classifier(labelled, "label"), 0.5, True).select("id", "pred")


@query()
def lda_topics(spark, d):
    return analysis.find_topics(articles(spark, d))


@query("SELECT url, v AS embedding FROM articles JOIN node_sums USING (id)", (*_GRAPH, "vecs", "node_sums"))
def news2vec_embedding(spark, d):
    t = _tfidf(spark, d)
    words = analysis.word_nodes(analysis.word_values(t)).select("word")
    return analysis.news2vec_embed(t, _vectors(spark, d, words)).select("url", _said("embedding").alias("embedding"))


@query("SELECT id, text_top FROM (SELECT id, string_agg(word, ',' ORDER BY rank) AS text_top FROM top WHERE field = 'text' GROUP BY id) JOIN (SELECT DISTINCT id FROM top WHERE field = 'title') USING (id)", _TFIDF)
def top_tfidf(spark, d):
    words = F.array_join(F.transform(F.array_sort("text_top_n", lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["word"] < b["word"], -1).when(a["word"] > b["word"], 1).otherwise(0)), lambda x: x["word"]), ",")
    return _tfidf(spark, d).select("id", words.alias("text_top"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Monthly counts of the articles that have a keyword."""
    return analysis.articles_over_time(filters.keyword_tokens(articles(spark, d), ["erst", "nicht", "pour"]), "month")
