"""The news operators on small hand-made frames, and their registered queries against SQL."""

import gzip
import itertools
import random
from collections import Counter
from datetime import date, datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from inkwell.functions import terms
from inkwell.functions import text as X
from inkwell.operators import analysis, filters
from inkwell.plans import news
from inkwell.plans.pipeline import Pipeline, add_model, csv_articles, embedding_csv, graph_csv, mongo_options, write_edge_list, write_node_map
from inkwell.sources import crawl

SF = "/root/testdata/sf0.001"
ARTICLE = "id bigint, title string, text string, url string, publish_date timestamp_ntz"


@pytest.fixture(scope="module")
def arts(spark):
    rows = [
        (1, "Policy talks", "The policy of Peru and Chile is good", "https://apnews.com/a/1", datetime(2024, 1, 1)),
        (2, "Notpolicy", "nothing here", "https://www.vox.com/2021/b", datetime(2024, 1, 31, 23, 59)),
        (3, None, "policy", "https://xapnews.com/c", datetime(2024, 2, 1)),
        (4, "", "", "https://m.apnews.com/d?x=1", None),
        (5, "Policy talks", "The policy of Peru and Chile is good", "https://apnews.com/a/1", datetime(2024, 3, 1)),
    ]
    return spark.createDataFrame(rows, ARTICLE)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_filters(spark, arts):
    assert ids(filters.date_range(arts, date(2024, 1, 1), date(2024, 1, 31))) == [1, 2]
    assert ids(filters.on_sites(arts, ["apnews.com"])) == [1, 3, 4, 5]
    assert ids(filters.on_hosts(arts, ["apnews.com"])) == [1, 4, 5]
    assert ids(filters.exclude_in_url(arts, ["*/a/*", "*vox*"])) == [3, 4]
    assert ids(filters.from_urls(arts, ["https://xapnews.com/c"])) == [3]
    assert ids(filters.from_urls(arts, arts.where("id = 3"))) == [3]
    assert ids(filters.keyword_tokens(arts, ["policy"])) == [1, 5]
    assert ids(filters.keyword_substring(arts, ["policy"])) == [1, 2, 3, 5]
    assert ids(filters.mentions_countries(arts, ["Peru"], 2)) == [1, 5]
    assert ids(filters.mentions_countries(arts, ["Peru"], 2, ["Chile"])) == []
    assert ids(filters.mentions_countries(arts.withColumn("countries", F.lit('["Peru"]')), ["Peru"])) == [1, 2, 3, 4, 5]
    assert ids(filters.in_language(arts)) == [1, 5]
    assert ids(filters.distinct_urls(arts, [F.col("id")])) == [1, 2, 3, 4]
    assert ids(filters.complete(arts)) == [1, 2, 5]
    assert ids(filters.apply_udf(arts, F.upper, "title")) == [1, 2, 4, 5]
    assert filters.sample(arts, 3).count() == 3


def test_pipeline_has_a_fixed_order_and_is_immutable(spark, arts):
    p = Pipeline(arts)
    q = p.limit_num_articles(1).by_keywords(["policy"]).on_sites(["apnews"]).distinct()
    assert p.spec == {} and len(q.to_pandas()) == 1
    assert p.url_only().collect().columns == ["url"]
    with pytest.raises(ValueError):
        p.url_only().classified(None).collect()
    with pytest.raises(ValueError):
        p.graph("other")
    nodes, words, edges = p.by_keywords(["policy"]).top_tfidf(5).graph("tfidf").result()
    assert set(edges.columns) == {"id1", "id2", "weight"} and nodes.count() == 2 and words.count() > 0
    p.run()


def test_saved_idf_leaves_out_new_words(spark, arts, tmp_path):
    path = str(tmp_path / "idf")
    Pipeline(arts.where("id = 1")).top_tfidf(5, save_path=path).run()
    got = Pipeline(arts.where("id = 2").withColumn("text", F.lit("policy unheard"))).top_tfidf(5, load_path=path)
    assert got.result().count() == 0  # no known word in its title


def test_tokens_and_small_functions(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first().x

    assert one(X.tokens(F.lit("It's 2019, and we need #revolution"))) == ["need", "revolution"]
    assert one(X.tokens(F.lit(""))) == [] and one(X.tokens(F.lit(None).cast("string"))) is None
    assert one(X.pad_tokens(F.array(F.lit(7), F.lit(8)), 4)) == [0, 0, 7, 8]
    assert one(X.pad_tokens(F.array(*map(F.lit, range(6))), 4)) == [2, 3, 4, 5]
    assert one(X.language(F.lit("xyz"))) is None
    assert X.database_uri("mongodb://u:p@h:1/x?a=b", "d", "c") == "mongodb://u:p@h:1/d.c?a=b"
    lemmas = spark.createDataFrame([("talks", "talk")], "word string, lemma string")
    df = spark.createDataFrame([(1, ["talks", "go", "talks"]), (2, []), (3, None)], "id int, t array<string>")
    assert {r.id: r.t for r in X.lemmatise(df, "t", lemmas).collect()} == {1: ["talk", "go", "talk"], 2: [], 3: None}


def told(spark, rows):
    return spark.createDataFrame(rows, "id bigint, title_tokens array<string>, text_tokens array<string>")


def best_words(spark, rows, n, saved=None):
    """(id, word, title_value, title_rank, text_value, text_rank) by brute force."""
    counts = {}
    for i, title, text in rows:
        for k, words in enumerate((title, text)):
            for w in words or ():
                counts.setdefault(i, {}).setdefault(w, [0, 0])[k] += 1
    df = Counter(w for of in counts.values() for w in of)
    lns = {r.c: r.x for r in spark.createDataFrame([(c,) for c in set(df.values())], "c int").select("c", F.ln((len(rows) + 1.0) / (F.col("c") + 1)).alias("x")).collect()}
    idf = saved if saved is not None else {w: lns[c] for w, c in df.items()}  # Python's logarithm may differ in the last bit, and so rank otherwise
    out = set()
    for i, of in counts.items():
        ranks = [{w: (v, r) for r, (v, w) in enumerate(sorted((-(tf[k] * idf[w]), w) for w, tf in of.items() if tf[k] and w in idf), 1) if r <= n} for k in (0, 1)]
        out |= {(i, w, *(x for k in (0, 1) for x in ((round(-ranks[k][w][0], 9), ranks[k][w][1]) if w in ranks[k] else (None, None)))) for w in {*ranks[0], *ranks[1]}}
    return out


@pytest.mark.parametrize("known", [1, 7, 40, 10**6])
@pytest.mark.parametrize("kind", ["own", "saved", "twice"])
def test_best_words_equal_brute_force(spark, known, kind):
    rng = random.Random(known)
    words = [f"w{k:03}" for k in range(120)]

    def some(most):
        return rng.choices(words, [1 / (k + 1) for k in range(120)], k=rng.randrange(most))

    rows = [(i // 2 if kind == "twice" else i, some(9) or None, some(90)) for i in range(60)] + [(98, None, None), (99, words[60:], words)]
    saved = {w: rng.choice([-1.0, 0.0, 0.5, 2.0, rng.random()]) for w in words[::2]} if kind == "saved" else None
    table = saved and spark.createDataFrame(list(saved.items()), "word string, idf double")
    got = analysis.ranked_words(told(spark, rows), 5, table, known).collect()
    assert {(r.id, r.word, *(x if x is None else round(x, 9) for x in r[2:])) for r in got} == best_words(spark, rows, 5, saved)


def test_best_words_come_without_joining_or_shuffling_all_words(spark):
    rows = [(i, [f"t{i}"], [f"w{(i + k) % 300}" for k in range(100)]) for i in range(50)]
    plan = analysis.ranked_words(told(spark, rows), 3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") <= 1 and "word" not in plan.split("hashpartitioning(", 1)[1].split(")")[0]
    lists, _ = analysis.article_terms(told(spark, rows))
    assert lists.count() == 50  # a row an article, no row a word
    few = list(terms.candidates(iter(lists.toArrow().to_batches()), 3, (["w0"], [0.1]), 1.0, 2.0))
    assert all(w != "w0" for b in few for w in b.column(1).to_pylist())


def test_plain_articles_give_the_words_that_the_jvm_splits(spark):
    odd = ["ΑΣ ΣΑΣ", "\u0178A\x0bB\x85c", "I\u0307İx", "\ua7c0\ua7d1 x", "good\u2003bad \U0001f600war", "", " ", "the THE", None, "日本 ÀÉ ß", "a\u0378b", "x\ufb01 \U00010570"]
    odd += ["".join(f"{chr(c)}A{chr(c)} " for c in range(k, k + 512) if not 0xD800 <= c < 0xE000 and c != 10) for k in range(0, 0x1FC00, 512)]
    df = spark.createDataFrame([(i, t, u, None, datetime(2024, 1, 1)) for i, (t, u) in enumerate(zip(odd, odd[3:] + odd[:3]))], ARTICLE)
    told_by = [analysis.article_terms(x)[0].collect() for x in (df, analysis.with_tokens(df))]
    plain, jvm = ({r.id: set(zip(r.words, r.title_tf, r.text_tf)) for r in rows} for rows in told_by)
    assert plain == jvm and len(plain) == len(odd)
    t = analysis.with_tokens(df)
    want = t.select("id", analysis.length_bucket(analysis.token_total()).alias("length"), X.sentiment(F.col("text")).alias("mood"))
    assert sorted(want.collect(), key=str) == sorted(analysis.article_features(df).select("id", "length", "mood").collect(), key=str)


def test_terms_reach_the_jvm_in_pieces_and_no_text_is_split_there(spark):
    df = spark.createDataFrame([(i, f"title t{'ab'[i % 2]}", "some words of a text", "u", datetime(2024, 1, 1)) for i in range(50)], ARTICLE).coalesce(1)
    pieces, n = analysis.term_pieces(df)
    assert n == 50 and pieces.count() == 1 and {(r.word, r.df) for r in pieces.select(F.inline(F.arrays_zip(F.col("words").alias("word"), "df"))).collect()} == {("title", 50), ("ta", 25), ("tb", 25), ("words", 50), ("text", 50)}
    assert "lambda" not in analysis.article_features(df)._jdf.queryExecution().optimizedPlan().toString()  # words are filtered in Arrow batches


def test_graph_works_its_values_out_once(spark, arts):
    _, nodes, edges = analysis.tfidf_graph(analysis.top_tfidf(arts, 3))
    for df in (nodes, edges):
        assert "Generate" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_vectors_are_shuffled_whole(spark):
    f = spark.createDataFrame([(0, "c", "d"), (1, "c", "e")], "id bigint, a string, b string")
    e = spark.createDataFrame([("c", [0.0, 2.0]), ("d", [1.0, None, 5.0]), ("e", None)], "token string, token_embedding array<double>")
    sums = analysis.accumulate_embeddings(f, e, ["a", "b"])
    assert "explode" not in sums._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id: r.embedding for r in sums.collect()} == {0: [1.0, 2.0, 5.0], 1: [0.0, 2.0]}


def test_word_values_read_the_best_words_once(spark, arts):
    plan = analysis.word_values(analysis.top_tfidf(arts, 3))._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "regexp_replace" not in plan


def test_features_before_the_join_equal_those_after(spark, arts):
    tfidf = analysis.top_tfidf(arts, 3)
    own = analysis.node_values(tfidf, features=analysis.article_features(arts))
    assert sorted(own.collect()) == sorted(analysis.node_values(tfidf).collect()) and own.count() > 0


def test_models_read_each_text_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def looked(t):
        seen.add(1)
        return t

    rows = [(i, "a", "good words here" if i % 2 else "other bad words", "u", datetime(2024, 1, 1)) for i in range(40)]
    df = spark.createDataFrame(rows, ARTICLE).withColumn("text", looked("text"))
    assert analysis.find_topics(df, k=2).count() > 0
    assert seen.value <= 80  # the filter may read a text beside the projection
    seen.value = 0
    model = analysis.fit_classifier(df.withColumn("label", (F.col("id") % 2).cast("double")), "label")
    assert seen.value <= 80
    assert analysis.classify(spark.createDataFrame(rows, ARTICLE), model).count() == 20


def test_classifier_tokens_equal_those_of_the_jvm(spark):
    rows = [(i, t, u, "u", None) for i, (t, u) in enumerate([("The b", "a c, ΑΣ Σ"), ("x", "Good war"), ("", ""), (None, "x"), ("y", None), ("the", "ß É日本 b a b"), ("Ω the", "")])]
    df = spark.createDataFrame(rows, ARTICLE)
    got = analysis._with_all_tokens(df)
    want = df.select("id", X.tokens(X.all_text(F.col("title"), F.col("text"))).alias("tokens")).where("tokens is not null")
    assert {(r.id, *r.tokens) for r in got.collect()} == {(r.id, *r.tokens) for r in want.collect()}
    assert got.where("size(tokens) > 0")._jdf.queryExecution().optimizedPlan().toString().count("run(") == 1


def test_embedding_sums(spark, tmp_path):
    f = spark.createDataFrame([(0, "c", "d"), (1, "c", "c"), (2, "x", None)], "id bigint, a string, b string")
    e = spark.createDataFrame([("c", [0.0, 2.0]), ("d", [1.0, 0.0])], "token string, token_embedding array<double>")
    assert {r.id: r.embedding for r in analysis.accumulate_embeddings(f, e, ["a", "b"]).collect()} == {0: [1.0, 2.0], 1: [0.0, 4.0]}
    assert {r.id for r in analysis.accumulate_embeddings(f, e, ["a", "b"], {"a": ["d"]}).collect()} == {0, 1}
    (tmp_path / "e.csv").write_text(",0,1\nc,0,2\n")
    assert embedding_csv(spark, str(tmp_path / "e.csv")).first().token_embedding == [0.0, 2.0]


def test_story_graph(spark):
    def story(i, day, *names):
        return (i, "t", "x", "u", datetime(2024, 1, day), [(n, "N", k) for k, n in enumerate(names)])

    rows = [story(1, 1, "a", "b"), story(2, 2, "a", "b"), story(3, 3, "a", "b", "c"), story(4, 3, "a"), story(5, 3, "z"), story(6, 1, "a")]
    df = spark.createDataFrame(rows, ARTICLE + ", entities array<struct<entity:string,type:string,position:int>>")
    edges = analysis.entity_dag(df)[1]
    got = {(r.old_id, r.new_id, r.entity) for r in edges.collect()}
    assert {(1, 2, "a"), (1, 2, "b"), (1, 4, "a"), (2, 3, "a"), (2, 3, "b"), (2, 4, "a")} <= got
    assert not any(5 in e or e[:2] == (1, 3) for e in got)
    assert analysis.single_edges(edges).where("old_id = 1 and new_id = 2").first().entity == "b"


@pytest.mark.parametrize("hot", [0, 3, 12, 10**6])
def test_story_graph_with_hot_entities_equals_brute_force(spark, hot):
    rng = random.Random(5)
    rows = []
    for i in range(70):
        names = [n for n, p in (("all", 1), ("most", 0.8), ("third", 0.33), ("some", 0.15)) if rng.random() < p] + rng.sample([f"rare{k}" for k in range(25)], 2)
        rows.append((i, "t", "x", "u", datetime(2024, 1, rng.randint(1, 12), rng.randint(0, 3)) if i else None, [(n, "N", k) for k, n in enumerate(names)]))
    want = {}
    for a, b in itertools.permutations(rows[1:], 2):
        both = frozenset(e[0] for e in a[5]) & {e[0] for e in b[5]}
        if a[4] < b[4] and both:
            key = (b[4].date() - a[4].date(), b[0])
            want[a[0], both] = min(want.get((a[0], both), key), key)
    want = sorted((a, m[1], e) for (a, both), m in want.items() for e in both)
    df = spark.createDataFrame(rows, ARTICLE + ", entities array<struct<entity:string,type:string,position:int>>")
    assert sorted((r.old_id, r.new_id, r.entity) for r in analysis.entity_dag(df, hot=hot)[1].collect()) == want


def test_story_graph_lists_no_pairs_of_a_hot_entity(spark):
    n = 20_000
    df = spark.range(n).select("id", F.lit("t").alias("title"), F.lit("x").alias("text"), F.lit("u").alias("url"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id as int), 0, 0, 0)").alias("publish_date"), F.expr("array(named_struct('entity', 'all', 'type', 'N', 'position', 0))").alias("entities"))
    edges = analysis.entity_dag(df)[1]
    assert edges.agg(F.count("*"), F.min(F.expr("new_id - old_id")), F.max(F.expr("new_id - old_id"))).first()[:] == (n - 1, 1, 1)


def test_topics_know_every_word(spark):
    def name(i):  # letters only, so that a word is one token
        return "zq" + "".join(chr(97 + int(c)) for c in str(i))

    n = 17_000
    rows = [(i, "", " ".join(name(k) for k in range(i % 100, n, 100)), "u", datetime(2024, 1, 1)) for i in range(200)]
    topics = analysis.find_topics(spark.createDataFrame(rows, ARTICLE), k=2, words_each=n)
    assert topics.where("topic = 0").select("word").distinct().count() == n


def test_topic_vectors_count_each_word_kept(spark):
    from pyspark.ml.clustering import LDA

    seen = []
    fit, LDA.fit = LDA.fit, lambda self, df, *a: seen.append(df) or fit(self, df, *a)
    try:
        rows = [(i, ["apple pear", "", "the"][i % 3], ["apple plum plum", "fig fig fig pear", ""][i % 3] + f" only{'abcdefghi'[i]} всё", "u", None) for i in range(9)] + [(9, None, "fig", "u", None), (10, "the", "", "u", None)]
        topics = analysis.find_topics(spark.createDataFrame(rows, ARTICLE), k=2, words_each=20).collect()
    finally:
        LDA.fit = fit
    got = sorted(tuple(sorted(r.features.values)) for r in seen[0].collect())
    assert got == sorted(3 * [(1.0, 2.0, 2.0), (1.0, 3.0), ()])  # всё is in every article with words, only... in one
    assert {r.word for r in topics} == {"apple", "pear", "plum", "fig"} and {r.features.size for r in seen[0].collect()} == {4}


def test_entities(spark, arts):
    found = analysis.extract_entities(arts.where("id = 1"), lambda a, b: [("Peru", "GPE", 3), ("Peru", "GPE", 1), ("U.S.", "GPE", 0)])
    rows = analysis.first_mentions(analysis.blacklist(analysis.explode_entities(found), [r"^U\."]))
    assert [tuple(r) for r in rows.collect()] == [(1, "Peru", "GPE", 1)]
    assert analysis.collect_entities(arts, rows).count() == 1 and analysis.collect_entities(arts, rows, "left").count() == 5


def test_csv_and_edge_list(spark, tmp_path):
    (tmp_path / "a.csv").write_text(',title,text,url,publish_date\n0,T,"two\nlines ""q""",u,2024-01-02 03:04:05\n')
    r = csv_articles(spark, str(tmp_path / "a.csv")).first()
    assert r.text == 'two\nlines "q"' and r.publish_date == datetime(2024, 1, 2, 3, 4, 5) and "_c0" not in r
    (tmp_path / "n.csv").write_text("id\n1\n2\n")
    (tmp_path / "e.csv").write_text("id1,id2,weight\n1,2,0.5\n")
    _, edges = graph_csv(spark, str(tmp_path / "n.csv"), str(tmp_path / "e.csv"))
    write_edge_list(edges, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["1 2 0.5"]
    write_node_map(spark.createDataFrame([(1, "a,b")], "id bigint, value string"), str(tmp_path / "map"))
    assert [r.value for r in spark.read.text(str(tmp_path / "map")).collect()] == ["1 a,b"]


def warc(url, html, kind="response", mime="text/html; charset=utf-8"):
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {mime}\r\n\r\n".encode() + html.encode()
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(http)}\r\n\r\n".encode() + http + b"\r\n\r\n"


PAGE = '<html><head><title>Old</title><meta property="og:title" content="New"><meta property="og:type" content="article"><meta property="article:published_time" content="2021-09-20T01:02:03Z"></head><body><nav><p>menu</p></nav><p>One <b>é</b></p><p>Two</p></body></html>'


def test_warc_articles(spark, tmp_path):
    whole = b"".join(gzip.compress(x) for x in (warc("http://a/1", PAGE), warc("http://a/2", PAGE, "request"), warc("http://a/3", "{}", mime="application/json"), warc("http://a/4", "<p>no date</p>")))
    (tmp_path / "w.warc.gz").write_bytes(whole)
    (tmp_path / "x.warc.gz").write_bytes(whole[:200])
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.gz"))
    rows = crawl.articles_from_warcs(files).where("url = 'http://a/1'").collect()
    assert (rows[0].title, rows[0].text, rows[0].publish_date) == ("New", "One é\nTwo", datetime(2021, 9, 20, 1, 2, 3))
    assert [r.url for r in crawl.is_article(crawl.articles_from_warcs(files)).select("url").distinct().collect()] == ["http://a/1"]
    n = len(gzip.compress(warc("http://a/1", PAGE)))
    index = spark.createDataFrame([("w", 0, n), ("gone", 0, 1)], "warc_filename string, warc_record_offset int, warc_record_length int")

    def read(name, offset, length):
        if name == "gone":
            raise OSError(name)
        return whole[offset : offset + length]

    got = crawl.articles_from_index(index, read).collect()
    assert sorted((r.url, r.status) for r in got) == [("gone", "input failed"), ("http://a/1", "ok")]
    counted, seen = crawl.counted(crawl.articles_from_index(index, read))
    counted.collect()
    assert seen.get == {"processed": 2, "failed": 0, "not_html": 0, "inputs_failed": 1}
    row = ("http://a/1", "/1", "w", 0, n, "UTF-8", "C-2", "warc", "a", None)
    cols = "url string, url_path string, warc_filename string, warc_record_offset int, warc_record_length int, content_charset string, crawl string, subset string, url_host_registered_domain string, content_languages string"
    table = spark.createDataFrame([row, ("http://a/9", "/9", "gone", 0, 1, "UTF-8", "C-1", "warc", "a", None)], cols)
    assert [r.url for r in crawl.crawl_articles(table, read, "all", start=date(2021, 9, 20), end=date(2021, 9, 20)).collect()] == ["http://a/1"]
    assert crawl.crawl_articles(table, read, "C-2", keywords=["Two"]).count() == 1 and crawl.crawl_articles(table, read, "C-2", keywords=["None"]).count() == 0
    assert crawl.crawl_articles(table, read, ["C-1"]).count() == 0 and crawl.crawl_articles(table, read, url_only=True).count() == 2
    with pytest.raises(ValueError):
        crawl.crawl_articles(table, read, "latest")


def test_news_crawl_of_some_days(spark, tmp_path):
    folder = str(tmp_path)
    for day, urls in (("20210920", ["http://a.org/1", "http://b.org/2", "http://www.a.org/3"]), ("20211101", ["http://a.org/4"]), ("20210801", ["http://a.org/5"])):
        body = b"".join(gzip.compress(warc(u, PAGE)) for u in urls) + gzip.compress(warc("http://a.org/x", "{}", mime="application/json"))
        (tmp_path / f"CC-NEWS-{day}010203-00001.warc.gz").write_bytes(body)
    paths = spark.createDataFrame([(f"{folder}/CC-NEWS-{d}010203-00001.warc.gz",) for d in ("20210920", "20211101", "20210801", "20210921")], "uri string")

    def opened(uri):
        return open(uri, "rb")

    days = {"start": date(2021, 9, 1), "end": date(2021, 9, 30)}
    assert {r.url for r in crawl.news_crawl_articles(paths, opened, **days).collect()} == {"http://a.org/1", "http://b.org/2", "http://www.a.org/3"}
    assert {r.url for r in crawl.news_crawl_articles(paths, opened, ["a.org"], **days).collect()} == {"http://a.org/1", "http://www.a.org/3"}
    every = crawl.articles_from_archives(paths, opened)
    assert {(r.status, r["count"]) for r in every.groupBy("status").count().collect()} == {("ok", 5), ("not html", 3), ("input failed", 1)}
    assert crawl.articles_from_archives(paths, opened, limit=4).count() == 3  # one an archive
    assert crawl.news_crawl_articles(paths, opened, url_only=True, limit=2, **days).count() == 2


def test_crawl_lists(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"id": "C-3", "name": "May 2022 Index"}, {"id": "C-2", "name": "March 2022 Index"}, {"id": "C-1", "name": "May 2021 Index"}]')
    c = crawl.read_crawls(spark, str(tmp_path / "c.json"))
    assert crawl.crawl_ids(c) == ["C-3", "C-2", "C-1"] and crawl.select_crawls(c, "latest") == ["C-3"]
    assert crawl.select_crawls(c, since=date(2022, 3, 5)) == ["C-3", "C-2"] and crawl.select_crawls(c, "C-1") == ["C-1"] and crawl.select_crawls(c, "all") == "all"
    with pytest.raises(ValueError):
        crawl.select_crawls(c)


def test_crawl_selection(spark, tmp_path):
    names = spark.createDataFrame([(c,) for c in ("September 2021", "July/August 2021", "January 2022", "Summer 2013", "March 2020")], "id string")
    assert {r.id for r in crawl.crawls_since(names, date(2021, 8, 1)).collect()} == {"September 2021", "January 2022"}
    assert crawl.news_listing_days(spark, date(2021, 1, 30), date(2021, 1, 31), 1).count() == 3
    (tmp_path / "p.txt").write_text("a/b\n")
    assert crawl.listing(spark, str(tmp_path / "p.txt"), "bucket").first().uri == "s3://bucket/a/b"
    with pytest.raises(ValueError):
        crawl.index_filter(spark.createDataFrame([], crawl.INDEX_SCHEMA), sites=["nodot"])
    with pytest.raises(KeyError):
        crawl.language_code("xx")
    path = str(tmp_path / "index")
    spark.createDataFrame([], crawl.INDEX_SCHEMA).write.parquet(path)
    assert crawl.query_index(spark, path, "SELECT count(*) AS n FROM ccindex").first().n == 0


def test_search(spark):
    q = crawl.search_query(["a b"], ["x.com", "y.org"], date(2024, 1, 1), date(2024, 1, 31))
    assert q == "a b site:x.com OR site:y.org after:2023-12-31 before:2024-02-01"
    assert crawl.search(spark, lambda query, start: [f"{query}{start + k}" for k in range(10)], "q", 15).count() == 15
    for most in (5, 25):
        with pytest.raises(ValueError):
            crawl.search(spark, lambda query, start: [], "q", most)
    assert {r.url for r in crawl.search(spark, lambda query, start: ["u", "v"] if start == 1 else [], "q", 30).collect()} == {"u", "v"}

    def download(url):
        if url == "v":
            raise OSError(url)
        return PAGE.encode()

    got = crawl.search_articles(spark, lambda query, start: ["u", "v"] if start == 1 else [], download, ["x"], max_articles=20).collect()
    assert [(r.url, r.title, r.publish_date) for r in got] == [("u", "New", datetime(2021, 9, 20, 1, 2, 3))]
    with pytest.raises(ValueError):
        crawl.link_to_article("v", download)
    assert crawl.parse_article("u", PAGE, title="Given")["title"] == "Given"
    assert crawl.dict_to_article({"url": "u", "title": "t", "text": "x", "publish_date": None})["text"] == "x"


def test_page_titles_keep_cut_references(spark):
    for html, want in (
        ("<title>Auf&amp</title>", "Auf&amp"),
        ("<TITLE lang='x'> a &amp;&lt;&#39;b&am\n</Title><title>c</title>", "a &<'b&am"),
        ("<title>&amp;lt; &copy 1</title>", "&lt; &copy 1"),
        ("<title>open", ""),
        ("<p>none</p>", ""),
    ):
        assert crawl.parse_article("u", html)["title"] == crawl.page_title(html) == want
    assert crawl.page_title("<title" * 300_000) == crawl.page_title("<title>" * 300_000) == ""


def test_mapping_vocabulary_and_lemmas(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([2.0, 3.0, 5.0])], "id bigint, x double")
    assert {(r.id, r.y) for r in analysis.map_with_index(df, "id", "x", "y", lambda xs, k: [x * k for x in xs], k=2).collect()} == {(0, 4.0), (1, 6.0), (2, 10.0)}
    t = spark.createDataFrame([("The cat, the DOG!",), (None,), ("",)], "t string")
    ids = X.token_ids(F.col("t"), {"the": 1, "cat": 2, "dog": 3}, 3)
    assert [r.i for r in t.select(ids.alias("i")).collect()] == [[2, 1, 3], None, [0, 0, 0]]
    lemmas = spark.createDataFrame([("talks", "talk"), ("were", "be"), ("cats", "cat")], "word string, lemma string")
    a = spark.createDataFrame([(1, "Talks were on", "cats, the cats")], "id bigint, title string, text string")
    r = analysis.with_tokens(a, lemmas).first()
    assert (r.title_tokens, r.text_tokens) == (["talk"], ["cat", "cat"])  # be and on are stop words
    top = analysis.top_tfidf(a.unionByName(spark.createDataFrame([(2, "x", "y")], a.schema)), 5, lemmas=lemmas).where("id = 1").first()
    assert [w.word for w in top.text_top_n] == ["cat"]


def test_models_must_be_there(spark):
    with pytest.raises(FileNotFoundError):
        add_model(spark, "/tmp/no such model.zip")
    assert mongo_options("c", "d", "e")["partitioner.options.partition.size"] == "4"
    assert crawl.storage_options("k", "s")["spark.hadoop.fs.s3a.access.key"] == "k"


def test_page_predicates(spark):
    h = "".join(f"<h2><a href='{u}'>x</a></h2>" for u in ("/a", "http://s.org/b", "http://t.org/c", "/d", "http://t.org/e"))
    df = spark.createDataFrame([(h + "<meta property='og:type' content='Article'>",)], "html string")
    r = df.select(filters.linked_headlines(F.col("html")).alias("all"), filters.linked_headlines(F.col("html"), self_domain="s.org").alias("own"), filters.og_type_is_article(F.col("html")).alias("og"), filters.is_html(F.lit("Text/HTML; x")).alias("is")).first()
    assert (r["all"], r["own"], r["og"], r["is"]) == (1.0, 0.6, True, True)


SAMPLED = ["warc_pages", "embedding_sum", "news2vec_embedding", "entity_arrays", "date_range", "keyword_tokens", "mentions_countries", "in_language", "tokenize", "tfidf_top_n_text", "tfidf_graph_edges", "node_values", "entity_dag_edges", "feature_pivot", "index_query", "crawls_since", "country_share"]


@pytest.mark.parametrize("name", SAMPLED)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    a, b = news.QUERIES[name](spark, SF).toPandas(), db.execute(news.ORACLE_SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)

    def rows(df):
        return sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))

    assert rows(a) == rows(b)


def test_entry_imports_without_the_corpus_operators(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["year", "month", "count"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
