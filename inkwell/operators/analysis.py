"""Counts over time, TF-IDF, entities, graphs, embeddings and models over article tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions import terms
from inkwell.functions import text as T
from inkwell.functions.store import written

# --- counts ------------------------------------------------------------------


def articles_over_time(df: DataFrame, period: str = "month") -> DataFrame:
    if period not in ("year", "month"):
        raise ValueError("period must be year or month")
    keys = [F.year("publish_date").cast("bigint").alias("year"), F.month("publish_date").cast("bigint").alias("month")]
    return df.groupBy(*keys[: 1 + (period == "month")]).agg(F.count("*").alias("count"))


def keywords_over_time(df: DataFrame, keywords) -> DataFrame:
    """Per month, how many articles have each keyword in title or text; one pass for all keywords."""
    body = T.all_text(F.col("title"), F.col("text"))
    counts = [F.count_if(body.contains(k)).alias(k) for k in keywords]
    return df.groupBy(F.year("publish_date").cast("bigint").alias("year"), F.month("publish_date").cast("bigint").alias("month")).agg(*counts)


def article_domains(df: DataFrame) -> DataFrame:
    return df.select(T.netloc(F.col("url")).alias("domain")).distinct()


def country_shares(df: DataFrame) -> DataFrame:
    """Per country of the countries column: articles and share of all mentions."""
    by = df.select(F.explode("countries").alias("country")).groupBy("country").agg(F.count("*").alias("count"))
    total = by.agg(F.sum("count").alias("n")).scalar()
    return by.withColumn("share", F.col("count") / total)


# --- TF-IDF ------------------------------------------------------------------


def with_tokens(df: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """Adds title_tokens and text_tokens; with a dictionary (word, lemma), words become lemmas before stop words go."""
    if lemmas is None:
        return df.withColumns({"title_tokens": T.tokens(F.col("title")), "text_tokens": T.tokens(F.col("text"))})
    df = df.withColumns({"title_tokens": T.words(F.col("title")), "text_tokens": T.words(F.col("text"))})
    for c in ("title_tokens", "text_tokens"):
        df = T.lemmatise(df, c, lemmas).withColumn(c, F.filter(c, lambda x: ~x.isin(*T.STOP_WORDS)))
    return df


def term_frequency(df: DataFrame, token_col: str) -> DataFrame:
    return df.select("id", F.explode(token_col).alias("word")).groupBy("id", "word").agg(F.count("*").alias("tf"))


#: Rows of some MB each: a block of rows is written as soon as it has its size, not after a hundred rows.
LARGE_ROWS = {"parquet.block.size": str(32 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "4"}
_PIECE = "words array<string>, df array<int>, counts binary"


def _pieces(df: DataFrame) -> DataFrame:
    kind = df.schema["id"].dataType.simpleString()
    plain = "title_tokens" not in df.columns
    fields = [F.col("title_tokens"), F.col("text_tokens")]
    if plain:
        (title, title_words), (text, text_words) = T.parted("title"), T.parted("text")
        fields = [title, text, title_words, text_words]
    return df.select("id", *fields).mapInArrow(lambda batches: terms.counted(batches, plain), f"ids array<{kind}>, {_PIECE}")


def term_pieces(df: DataFrame) -> tuple[DataFrame, int]:
    """The pieces of functions.terms, written, and the number of rows: the rest of TF-IDF reads this.

    df: (id, title_tokens, text_tokens), or (id, title, text) whose words are split here in Arrow batches. An article's words are
    counted where it is read, without a shuffle. Only if an id comes several times are rows put together.
    """
    kind = df.schema["id"].dataType.simpleString()
    pieces = written(_pieces(df), "terms", **LARGE_ROWS)
    n, most = pieces.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if most <= 1:
        return pieces, n
    rows = pieces.mapInArrow(terms.unpacked, f"id {kind}, words array<string>, title_tf array<int>, text_tf array<int>")
    pairs = rows.select("id", F.inline(F.arrays_zip(F.col("words").alias("word"), "title_tf", "text_tf"))).groupBy("id", "word").agg(F.sum("title_tf").alias("title_tf"), F.sum("text_tf").alias("text_tf"))
    lists = pairs.groupBy("id").agg(F.collect_list(F.struct("word", "title_tf", "text_tf")).alias("w"))
    lists = lists.select("id", F.col("w.word").alias("words"), F.col("w.title_tf").cast("array<int>").alias("title_tf"), F.col("w.text_tf").cast("array<int>").alias("text_tf"))
    return written(lists.mapInArrow(terms.packed, f"ids array<{kind}>, {_PIECE}"), "terms", **LARGE_ROWS), n


def article_terms(df: DataFrame) -> tuple[DataFrame, int]:
    """(id, words, title_tf, text_tf) of each article, and the number of rows."""
    pieces, n = term_pieces(df)
    kind = df.schema["id"].dataType.simpleString()
    return pieces.mapInArrow(terms.unpacked, f"id {kind}, words array<string>, title_tf array<int>, text_tf array<int>"), n


def _with_idf(counts: DataFrame, m: int, df: Column) -> DataFrame:
    return counts.groupBy("word").agg(df.alias("df")).withColumn("idf", F.ln((m + 1.0) / (F.col("df") + 1)))


def inverse_frequency(df: DataFrame) -> DataFrame:
    """(word, df, idf) over title and text together: ln((m + 1) / (df + 1)) with m articles. To save one, write it."""
    pairs = df.select("id", F.explode(F.array_distinct(F.concat("title_tokens", "text_tokens"))).alias("word"))
    return _with_idf(pairs, df.agg(F.count("*").alias("m")).scalar(), F.count("*"))


KNOWN = 1 << 18  # frequent words whose idf is sent to all tasks


def ranked_words(df: DataFrame, n: int, idf: DataFrame | None = None, known: int = KNOWN) -> DataFrame:
    """(id, word, title_value, title_rank, text_value, text_rank) of the words that are among the n best of a field.

    df: (id, title_tokens, text_tokens), or (id, title, text), which is faster where tokens aren't lemmas.
    Ties go by word, value and rank are null for the field of which a word is none of the best. Words that a saved idf lacks
    are left out. The `known` most frequent words get their idf where the articles are read; of the others only those are joined
    that may be among the best with any idf that such a word can have.
    """
    pieces, m = term_pieces(df)
    table = _with_idf(pieces.select(F.inline(F.arrays_zip(F.col("words").alias("word"), "df"))), m, F.sum("df")) if idf is None else idf.where("idf is not null")
    table = written(table.select("word", F.col("idf").cast("double").alias("idf")), "idf")
    size, high = table.agg(F.count("*"), F.max("idf")).first()
    cut = None if size <= known else table.agg(F.percentile_approx("idf", known / size)).first()[0]
    told = (table if cut is None else table.where(F.col("idf") < cut)).toArrow()
    sent = df.sparkSession.sparkContext.broadcast((told["word"].to_pylist(), told["idf"].to_numpy()))
    low = cut if idf is None or cut is None else float("-inf")  # a saved idf may lack a word

    def pick(batches):
        return terms.piece_candidates(batches, n, sent.value, low, high)

    kind = df.schema["id"].dataType.simpleString()
    valued = pieces.mapInArrow(pick, f"id {kind}, word string, title_tf int, text_tf int, idf double")
    if cut is not None:
        found = written(valued, "candidates")
        rare = found.where("idf is null").drop("idf").join(table.where(F.col("idf") >= cut), "word")
        valued = found.where("idf is not null").unionByName(rare)
    for field in ("title", "text"):
        valued = valued.withColumn(f"{field}_value", F.when(F.col(f"{field}_tf") > 0, F.col(f"{field}_tf") * F.col("idf")))
    for field in ("title", "text"):
        rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col(f"{field}_value").desc_nulls_last(), "word"))
        valued = valued.withColumn(f"{field}_rank", F.when(F.col(f"{field}_value").isNotNull() & (rank <= n), rank.cast("bigint")))
    kept = valued.where("title_rank is not null or text_rank is not null")
    return kept.select("id", "word", *(F.when(F.col(f"{field}_rank").isNotNull(), F.col(f"{field}_{x}")).alias(f"{field}_{x}") for field in ("title", "text") for x in ("value", "rank")))


def top_words(df: DataFrame, field: str, n: int, idf: DataFrame | None = None) -> DataFrame:
    """(id, word, value, rank): the n best words of title or text."""
    return ranked_words(df, n, idf).where(f"{field}_rank is not null").select("id", "word", F.col(f"{field}_value").alias("value"), F.col(f"{field}_rank").alias("rank"))


def top_tfidf(df: DataFrame, n: int = 20, idf: DataFrame | None = None, how: str = "inner", lemmas: DataFrame | None = None) -> DataFrame:
    """Adds title_tokens, text_tokens and title_top_n, text_top_n (array of value, word). Inner: articles without tokens in a field go.

    The arrays are written, so what is built on them reads them back instead of working them out again; tokens come last, so that
    the join moves none.
    """
    best = [F.sort_array(F.collect_list(F.when(F.col(f"{f}_rank").isNotNull(), F.struct(F.col(f"{f}_value").alias("value"), "word"))), asc=False) for f in ("title", "text")]
    top = ranked_words(df.select("id", "title", "text") if lemmas is None else with_tokens(df, lemmas), n, idf).groupBy("id").agg(*(F.when(F.size(b) > 0, b).alias(f"{f}_top_n") for f, b in zip(("title", "text"), best)))
    if how == "inner":
        top = top.where("title_top_n is not null and text_top_n is not null")
    joined = with_tokens(df.join(written(top, "top"), "id", how), lemmas)
    return joined.select(*(c for c in joined.columns if c not in ("title_top_n", "text_top_n")), "title_top_n", "text_top_n")


# --- entities ----------------------------------------------------------------


def capitalised_entities(df: DataFrame, max_chars: int | None = None) -> DataFrame:
    """entities array<struct<entity,type,position>> of capitalised word sequences of two or more: a default for model-backed extractors."""
    body = T.all_text(F.col("title"), F.col("text"))
    if max_chars:
        body = F.substring(body, 1, max_chars)
    names = F.array_distinct(F.regexp_extract_all(body, F.lit(r"(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+)"), 1))
    return df.withColumn("entities", F.transform(names, lambda e: F.struct(F.lower(e).alias("entity"), F.lit("NAME").alias("type"), (F.instr(body, e) - 1).alias("position"))))


def extract_entities(df: DataFrame, extractor) -> DataFrame:
    """extractor: title, text -> [(entity, type, position)], scored in Arrow batches."""
    schema = "array<struct<entity:string,type:string,position:int>>"

    @F.pandas_udf(schema)
    def run(title, text):
        import pandas as pd

        return pd.Series([[{"entity": e, "type": t, "position": p} for e, t, p in extractor(a, b)] for a, b in zip(title, text)])

    return df.withColumn("entities", run("title", "text"))


def explode_entities(df: DataFrame) -> DataFrame:
    return df.select("id", F.inline("entities"))


def blacklist(entities: DataFrame, patterns) -> DataFrame:
    for p in patterns:
        entities = entities.where(~F.col("entity").rlike(p))
    return entities


def first_mentions(entities: DataFrame) -> DataFrame:
    """One row per article and entity: the first position; an aggregate, so it combines before the shuffle."""
    return entities.groupBy("id", "entity").agg(F.min(F.struct("position", "type")).alias("m")).select("id", "entity", "m.type", "m.position")


def collect_entities(df: DataFrame, entities: DataFrame, how: str = "inner") -> DataFrame:
    rows = entities.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("position", "entity", "type"))).alias("__e"))
    rows = rows.select("id", F.transform("__e", lambda x: F.struct(x["entity"].alias("entity"), x["type"].alias("type"), x["position"].alias("position"))).alias("entities"))
    return df.drop("entities").join(rows, "id", how)


# --- graphs ------------------------------------------------------------------

TITLE_PART, TEXT_PART = 1, 2


def word_values(tfidf: DataFrame) -> DataFrame:
    """(id, word, title_value, text_value): both fields by one pass and one aggregate instead of a full outer join."""
    none = F.lit(None).cast("double")
    title = F.transform("title_top_n", lambda e: F.struct(e["word"].alias("word"), e["value"].alias("title_value"), none.alias("text_value")))
    text = F.transform("text_top_n", lambda e: F.struct(e["word"].alias("word"), none.alias("title_value"), e["value"].alias("text_value")))
    kept = tfidf.where(F.col("title_top_n").isNotNull() & F.col("text_top_n").isNotNull())
    return kept.select("id", F.inline(F.concat(title, text))).groupBy("id", "word").agg(F.max("title_value").alias("title_value"), F.max("text_value").alias("text_value"))


def all_nodes(articles: DataFrame, words: DataFrame) -> DataFrame:
    """Article and word nodes in one table; each has nulls for what only the other has."""
    return articles.unionByName(words, allowMissingColumns=True)


def weighted(values: DataFrame) -> DataFrame:
    weight = F.coalesce("title_value", F.lit(0.0)) / TITLE_PART + F.coalesce("text_value", F.lit(0.0)) / TEXT_PART
    return values.select("id", "word", weight.alias("weight")).where("weight > 0")


def word_nodes(values: DataFrame) -> DataFrame:
    """(id, word): words of more than one article; ids are hashes of the word, below zero so that they meet no article's."""
    return values.groupBy("word").agg(F.count("*").alias("n")).where("n > 1").select((-F.abs(F.xxhash64("word") % (1 << 62)) - 1).alias("id"), "word")


def tfidf_graph(tfidf: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(article nodes, word nodes, edges id1, id2, weight). Values and word nodes are written, since edges read them again."""
    return _graph_of(tfidf, written(word_values(tfidf), "values"))


def _graph_of(tfidf: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes = written(word_nodes(values), "nodes")
    edges = weighted(values).join(nodes.withColumnRenamed("id", "id2"), "word").select(F.col("id").alias("id1"), "id2", "weight")
    articles = tfidf.where(F.col("title_top_n").isNotNull() & F.col("text_top_n").isNotNull()).select("id", "title", "text", "publish_date", "url")
    return articles, nodes, edges


def article_top_words(values: DataFrame, n: int = 20) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight"), "word"))
    return weighted(values).withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= n)


def token_total() -> Column:
    """Tokens of title and text together."""
    return F.size("title_tokens") + F.size("text_tokens")


def length_bucket(n: Column) -> Column:
    out = F.when(n <= 200, "wc200")
    for top in (500, 1000, 2000, 3000, 5000):
        out = out.when(n <= top, f"wc{top}")
    return out.otherwise("wcmax")


def date_features(d: Column) -> list[Column]:
    return [F.concat(F.lit(p), f(d).cast("string")).alias(a) for p, f, a in (("m_", F.month, "month"), ("d_", F.dayofmonth, "day"), ("wd_", F.dayofweek, "weekday"))]


def article_features(df: DataFrame) -> DataFrame:
    """(id, length, mood, month, day, weekday) of articles whose tokens aren't lemmas; each text is split once, in Arrow batches."""
    kind = df.schema["id"].dataType.simpleString()
    (title, title_words), (text, text_words) = T.parted("title"), T.parted("text")
    told = df.select("id", *date_features(F.col("publish_date")), title, text, title_words, text_words).mapInArrow(terms.said, f"id {kind}, month string, day string, weekday string, n_title int, n_text int, score int")
    none = F.size(F.lit(None).cast("array<string>"))
    length = F.coalesce("n_title", none) + F.coalesce("n_text", none)
    return told.select("id", length_bucket(length).alias("length"), T.mood_of(F.col("score")).alias("mood"), "month", "day", "weekday")


def node_values(tfidf: DataFrame, n: int = 20, features: DataFrame | None = None, values: DataFrame | None = None) -> DataFrame:
    """(id, value): top words, length bucket, sentiment and dates of an article, joined by commas.

    features: article_features of the same articles, where tokens aren't lemmas; without it the texts go through the join.
    values: word_values(tfidf), where they are written.
    """
    top = article_top_words(word_values(tfidf) if values is None else values, n).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), ",").alias("words"))
    extra = tfidf.select("id", length_bucket(token_total()).alias("length"), T.sentiment(F.col("text")).alias("mood"), *date_features(F.col("publish_date"))) if features is None else features
    return extra.join(top, "id").select("id", F.concat_ws(",", "words", "length", "mood", "month", "day", "weekday").alias("value"))


def news2vec_graph(tfidf: DataFrame, features: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges id1, id2, weight; node map id, value) with word nodes by their word; features as in node_values."""
    values = written(word_values(tfidf), "values")
    _, nodes, edges = _graph_of(tfidf, values)
    return edges, node_values(tfidf, features=features, values=values).unionByName(nodes.select("id", F.col("word").alias("value")))


HOT = 256  # articles of an entity from which on its pairs are no longer listed


def entity_dag(df: DataFrame, max_position: int = 1000, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(articles, edges old_id, new_id, entity, entity_type): an edge leads to the next story sharing exactly that set of entities.

    Pairs are listed only of entities of at most `hot` articles. Two articles that share none of those but some hot ones are
    compared by what hot entities they have: candidates for one set are ranked by day and id, and an old story takes the first
    rank after its own day that isn't a listed pair. Candidates of the same day are joined, since their times decide.
    """
    flat = df.select("id", "publish_date", F.inline("entities")).where(F.col("position") < max_position).where("publish_date is not null and entity is not null and type is not null")
    flat = flat.select("id", F.col("publish_date").alias("date"), F.struct("entity", F.col("type").alias("entity_type")).alias("e")).distinct()
    marked = flat.join(flat.groupBy("e").agg((F.count("*") > hot).alias("hot")), "e")
    none = F.array().cast("array<struct<entity:string,entity_type:string>>")
    stories = marked.where("hot").groupBy("id", "date").agg(F.sort_array(F.collect_list("e")).alias("has"))

    cold = marked.where("not hot")
    old, new = (cold.select(F.col("id").alias(f"{k}_id"), F.col("date").alias(f"{k}_date"), "e") for k in ("old", "new"))
    listed = old.join(new, "e").where("old_date < new_date").groupBy("old_id", "new_id").agg(F.collect_list("e").alias("cold"), F.datediff(F.first("new_date"), F.first("old_date")).alias("days"))
    for k in ("old", "new"):
        listed = listed.join(stories.select(F.col("id").alias(f"{k}_id"), F.col("has").alias(f"{k}_has")), f"{k}_id", "left")
    listed = listed.withColumn("shared", F.sort_array(F.array_intersect(F.coalesce("old_has", none), F.coalesce("new_has", none))))
    by_cold = listed.select("old_id", "new_id", "days", F.sort_array(F.concat("cold", "shared")).alias("entities"))

    # Hot entities alone: `has` is what the old story has, `shared` what a candidate has of it.
    kinds = stories.select("has").distinct().select("has", F.explode("has").alias("e"))
    match = kinds.join(kinds.withColumnRenamed("has", "other"), "e").groupBy("has", "other").agg(F.sort_array(F.collect_list("e")).alias("shared"))
    olds = stories.join(match.select("has", "shared").distinct(), "has").select(F.col("id").alias("old_id"), F.col("date").alias("old_date"), F.to_date("date").alias("day"), "has", "shared")
    found = stories.withColumnRenamed("has", "other").join(match, "other").select(F.col("id").alias("new_id"), F.col("date").alias("new_date"), F.to_date("date").alias("day"), "has", "shared")
    within = Window.partitionBy("has", "shared")
    ranked = found.withColumn("rank", F.row_number().over(within.orderBy("day", "new_id")))
    both = olds.withColumn("one", F.lit(0)).unionByName(found.select("day", "has", "shared", F.lit(1).alias("one")), allowMissingColumns=True)
    placed = both.withColumn("past", F.sum("one").over(within.orderBy("day").rangeBetween(Window.unboundedPreceding, Window.currentRow))).where("one = 0")
    taken = listed.where("size(shared) > 0").select("old_id", "new_id", F.col("old_has").alias("has"), "shared").join(ranked.select("new_id", "has", "shared", "rank"), ["new_id", "has", "shared"])
    taken = taken.groupBy("old_id", "shared").agg(F.sort_array(F.collect_list("rank")).alias("taken"))
    after = F.filter(F.coalesce("taken", F.array().cast("array<int>")), lambda r: r > F.col("past"))
    run = F.size(F.filter(after, lambda r, i: r == F.col("past") + 1 + i))  # listed pairs in a row from the first rank on
    placed = placed.join(taken, ["old_id", "shared"], "left").select("old_id", "old_date", "has", "shared", (F.col("past") + 1 + run).cast("int").alias("rank"))
    later = placed.join(ranked.select("has", "shared", "rank", "new_id", "new_date"), ["has", "shared", "rank"])
    today = olds.join(found, ["has", "shared", "day"]).where("old_date < new_date").join(listed, ["old_id", "new_id"], "left_anti")
    by_hot = later.unionByName(today, allowMissingColumns=True).select("old_id", "new_id", F.datediff("new_date", "old_date").alias("days"), F.col("shared").alias("entities"))

    first = by_cold.unionByName(by_hot).groupBy("old_id", "entities").agg(F.min(F.struct("days", "new_id")).alias("m"))
    edges = first.select("old_id", F.col("m.new_id").alias("new_id"), F.inline("entities"))
    return df.select("id", "url", "text", "title", "publish_date"), edges


def single_edges(edges: DataFrame) -> DataFrame:
    """One edge per pair of nodes, labelled by its last entity."""
    return edges.groupBy("old_id", "new_id").agg(F.max("entity").alias("entity"))


# --- embeddings --------------------------------------------------------------

FEATURE_COLUMNS = [str(k) for k in range(1, 21)]


def feature_pivot(values: DataFrame, n: int = 20) -> DataFrame:
    """(id, '1' .. 'n'): the top words by rank; ranks are listed, so the pivot needs no extra pass."""
    return article_top_words(values, n).groupBy("id").pivot("rank", list(range(1, n + 1))).agg(F.max("word"))


def accumulate_embeddings(df: DataFrame, embeddings: DataFrame, features: list[str], domains: dict[str, list[str]] | None = None) -> DataFrame:
    """(id, embedding): the sum of the vectors of the tokens in the feature columns; repeated tokens count again.

    One unpivot and one join, whichever kind the planner picks by size; domains restrict what a feature may match. A vector goes
    to its id's partition whole, and is added up there.
    """
    flat = df.unpivot("id", features, "feature", "token").where(F.col("token").isNotNull())
    for f, allowed in (domains or {}).items():
        flat = flat.where((F.col("feature") != f) | F.col("token").isin(allowed))
    vectors = embeddings.select("token", F.col("token_embedding").cast("array<double>").alias("x")).where("size(x) > 0")
    parts = flat.select("id", "token").join(vectors, "token").select("id", "x").repartition("id")

    def add(a, b):
        return F.zip_with(a, b, lambda p, q: F.coalesce(p + q, p, q))

    return parts.groupBy("id").agg(F.collect_list("x").alias("v")).select("id", F.aggregate("v", F.array().cast("array<double>"), add).alias("embedding"))


def news2vec_features(tfidf: DataFrame) -> DataFrame:
    wide = feature_pivot(word_values(tfidf))
    extra = tfidf.select("id", "title", "text", "publish_date", "url", length_bucket(token_total()).alias("num_words_ord"), T.sentiment(F.col("text")).alias("sentiment"), *date_features(F.col("publish_date")))
    return extra.join(wide, "id")


def export_features(tfidf: DataFrame) -> DataFrame:
    """title, text, publish_date, url, the top words '1' to '20' and the five other features."""
    return news2vec_features(tfidf).select("title", "text", "publish_date", "url", *(F.col(f"`{c}`") for c in FEATURE_COLUMNS), "num_words_ord", "sentiment", "month", "day", "weekday")


def news2vec_embed(tfidf: DataFrame, embeddings: DataFrame, how: str = "inner") -> DataFrame:
    """title, text, publish_date, url, embedding; inner: articles without a known token go."""
    f = news2vec_features(tfidf)
    domains = {"num_words_ord": ["wc200", "wc500", "wc1000", "wc2000", "wc3000", "wc5000", "wcmax"], "sentiment": ["positive_1", "neutral_1", "negative_1"], "month": [f"m_{k}" for k in range(1, 13)], "day": [f"d_{k}" for k in range(1, 32)], "weekday": [f"wd_{k}" for k in range(1, 8)]}
    sums = accumulate_embeddings(f, embeddings, FEATURE_COLUMNS + list(domains), domains)
    return f.select("id", "title", "text", "publish_date", "url").join(sums, "id", how).drop("id")


# --- models ------------------------------------------------------------------


def _with_all_tokens(df: DataFrame) -> DataFrame:
    """Adds tokens, those of title and text together, split in Arrow batches; rows without title or text go."""

    @F.arrow_udf("array<string>")
    def run(text: pa.Array, words: pa.Array) -> pa.Array:
        return terms.tokens(text, words)

    split = run.asNondeterministic()  # so that a filter on tokens doesn't split the texts once more
    both = df.where("title is not null and text is not null").withColumn("__all", T.all_text(F.col("title"), F.col("text")))
    return both.withColumn("tokens", split(*T.parted("__all"))).drop("__all")


def fit_classifier(df: DataFrame, label_col: str, features: int = 1 << 14):
    """A logistic regression over hashed tokens of title and text, as a pipeline model: a stand-in for a pretrained network."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF

    rows = _with_all_tokens(df)
    hashing = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=features)
    hashed = written(hashing.transform(rows).select("tf", label_col), "hashed")  # fitting reads its rows several times
    return PipelineModel([hashing, LogisticRegression(featuresCol="tf", labelCol=label_col, maxIter=10, regParam=0.01).fit(hashed)])


def classify(df: DataFrame, model, threshold: float = 0.5, output: bool = False) -> DataFrame:
    """Articles whose probability of the class is above the threshold; rows without title or text go."""
    from pyspark.ml.functions import vector_to_array

    rows = _with_all_tokens(df).where("size(tokens) > 0")
    scored = model.transform(rows).withColumn("pred", vector_to_array("probability")[1]).where(F.col("pred") > threshold)
    return scored.select(*df.columns, *(["pred"] if output else []))


def score_batches(df: DataFrame, scorer, column: str, output: str) -> DataFrame:
    """A column of scores by a batch scorer (array of values -> array of floats), in Arrow batches."""

    @F.pandas_udf("double")
    def run(x):
        import pandas as pd

        return pd.Series(scorer(x), dtype="float64")

    return df.withColumn(output, run(column))


def map_with_index(df: DataFrame, index: str, column: str, mapped: str, func, kind: str = "double", **options) -> DataFrame:
    """(index, mapped): func(list of values, **options) -> list, over a batch of a partition at a time."""
    import pandas as pd

    def run(batches):
        for b in batches:
            yield pd.DataFrame({index: b[index], mapped: list(func(b[column].tolist(), **options))})

    of = df.schema[index].dataType.simpleString()
    return df.select(index, column).mapInPandas(run, f"`{index}` {of}, `{mapped}` {kind}")


def find_topics(df: DataFrame, k: int = 10, words_each: int = 10, seed: int = 7) -> DataFrame:
    """(topic, word, weight) of a topic model over the tokens of title and text; words in over 90 % of articles or in only one are left out.

    Words are counted and turned into vectors a piece at a time (functions.terms). The driver holds the weights of the other words,
    however many, and no word itself.
    """
    from pyspark.ml.clustering import LDA
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import StructField, StructType

    spark = df.sparkSession
    texts = df.where("title is not null and text is not null").select(F.lit(0).alias("id"), "title", "text")
    pieces = written(_pieces(texts).withColumn("piece", F.monotonically_increasing_id()), "terms", **LARGE_ROWS)
    n = pieces.select("ids", "words", "df", "counts").mapInArrow(terms.filled, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counted = pieces.select(F.inline(F.arrays_zip(F.col("words").alias("word"), "df"))).groupBy("word").agg(F.sum("df").alias("df"))
    kept = counted.where(F.col("df").between(2, 0.9 * n))
    # Indices without a sort: a word's place in its partition, after the words of the partitions before.
    kept = written(kept.select("word", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place")), "words")
    start, size = {}, 0
    for part, m in sorted(kept.groupBy("part").agg(F.count("*")).collect()):
        start[part], size = size, size + m
    if not size:
        raise ValueError("no word is in two articles and in at most 90 % of them")
    offsets = spark.createDataFrame(list(start.items()), "part int, start bigint")
    names = kept.join(F.broadcast(offsets), "part").select("word", (F.col("start") + F.col("place")).cast("int").alias("index"))
    placed = pieces.select("piece", F.posexplode("words").alias("pos", "word")).join(names, "word").select("piece", "pos", "index", F.lit(None).cast("binary").alias("counts"))
    rows = pieces.select("piece", F.lit(-1).alias("pos"), F.lit(-1).alias("index"), "counts").unionByName(placed)
    shaped = rows.repartition("piece").sortWithinPartitions("piece", "pos").mapInArrow(lambda b: terms.vectors(b, size), "features struct<type:tinyint,size:int,indices:array<int>,values:array<double>>")
    vectors = written(shaped, "vectors", schema=StructType([StructField("features", VectorUDT())]))  # each iteration reads all rows again
    model = LDA(k=k, seed=seed, maxIter=5, optimizer="online").fit(vectors)
    zipped = F.inline(F.arrays_zip("termIndices", "termWeights"))
    topics = model.describeTopics(words_each).select("topic", zipped)
    return topics.join(names, F.col("termIndices") == F.col("index")).select("topic", "word", F.col("termWeights").alias("weight"))


def batches(df: DataFrame, max_rows: int, key: str = "id") -> DataFrame:
    """Adds batch: about max_rows rows each, by digest of a key; no global sort."""
    n = F.greatest(F.lit(1), (df.agg(F.count("*").alias("n")).scalar() / max_rows).cast("bigint"))
    return df.withColumn("batch", F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint") % n)
