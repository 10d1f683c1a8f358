"""A fluent, immutable article pipeline: a specification first, one Spark plan at the end."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import analysis, filters

ARTICLE_SCHEMA = "title string, text string, url string, publish_date timestamp_ntz"


def csv_articles(spark: SparkSession, path: str, schema: str | None = ARTICLE_SCHEMA) -> DataFrame:
    """Articles from CSV with quoted line breaks; an unnamed leading index column is dropped. schema None infers."""
    options = {"header": True, "multiLine": True, "escape": '"'}
    df = spark.read.csv(path, inferSchema=schema is None, **options)
    if schema is not None:
        wanted = spark.createDataFrame([], schema).schema
        df = df.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in wanted if f.name in df.columns})
    return df.drop("_c0")


def graph_csv(spark: SparkSession, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    return tuple(spark.read.csv(p, header=True, inferSchema=True, multiLine=True, escape='"') for p in (nodes, edges))


def embedding_csv(spark: SparkSession, path: str) -> DataFrame:
    """(token, token_embedding) from a CSV of a token column and numeric ones."""
    df = spark.read.csv(path, header=True)
    first, *rest = df.columns
    return df.select(F.col(f"`{first}`").alias("token"), F.array(*(F.col(f"`{c}`").cast("double") for c in rest)).alias("token_embedding"))


def mongo_articles(spark: SparkSession, connection: str, database: str, collection: str, partition_mb: int = 4) -> DataFrame:
    """Needs the public MongoDB connector on the class path; partition_mb: of documents that a task reads."""
    return spark.read.format("mongodb").options(**mongo_options(connection, database, collection, partition_mb)).load()


def mongo_options(connection: str, database: str, collection: str, partition_mb: int = 4) -> dict[str, str]:
    return {"connection.uri": connection, "database": database, "collection": collection, "partitioner.options.partition.size": str(partition_mb)}


def add_model(spark: SparkSession, archive: str) -> None:
    """Ships a zipped model to every executor, unpacked in its working folder; a missing one raises FileNotFoundError."""
    from pathlib import Path

    if not Path(archive).exists():
        raise FileNotFoundError(archive)
    spark.sparkContext.addArchive(archive)


@dataclass(frozen=True)
class Pipeline:
    """source: a frame, or spark -> frame. Filters apply in a fixed order, whatever the order of calls; the limit comes last."""

    source: DataFrame | Callable[[SparkSession], DataFrame]
    spec: dict = field(default_factory=dict)
    stages: tuple = ()

    def _with(self, **kw) -> Pipeline:
        return replace(self, spec={**self.spec, **kw})

    def in_date_range(self, start=None, end=None):
        return self._with(dates=(start, end))

    def on_sites(self, sites):
        return self._with(sites=tuple(sites))

    def exclude_in_url(self, patterns):
        return self._with(exclude=tuple(patterns))

    def apply_udf(self, udf, column: str):
        return self._with(udf=(udf, column))

    def distinct(self):
        return self._with(distinct=True)

    def from_urls(self, urls):
        return self._with(urls=urls)

    def by_keywords(self, keywords, tokens: bool = True):
        return self._with(keywords=(tuple(keywords), tokens))

    def mentions_countries(self, countries=(), min_num_countries: int = 0, ignore_countries=(), output: bool = False):
        return self._with(countries=(countries, min_num_countries, ignore_countries, output))

    def in_language(self, lang: str = "en"):
        return self._with(lang=lang)

    def classified(self, model, threshold: float = 0.5, output: bool = False):
        return self._with(model=(model, threshold, output))

    def sample(self, n: int, seed: int = 7):
        return self._with(sample=(n, seed))

    def limit_num_articles(self, n: int):
        return self._with(limit=n)

    def url_only(self, on: bool = True):
        return self._with(url_only=on)

    def get_features(self, columns):
        return self._with(columns=tuple(columns))

    def then(self, stage: Callable[[DataFrame], object]) -> Pipeline:
        """A further stage: a function of the frame, such as analysis.top_tfidf."""
        return replace(self, stages=(*self.stages, stage))

    def top_tfidf(self, n: int, load_path: str | None = None, save_path: str | None = None, lemmas: DataFrame | None = None):
        def stage(df):
            if not load_path and not save_path:
                return analysis.top_tfidf(df, n, lemmas=lemmas)
            known = df.sparkSession.read.parquet(load_path) if load_path else analysis.inverse_frequency(analysis.with_tokens(df, lemmas))
            if save_path:
                known.write.mode("overwrite").parquet(save_path)
                known = df.sparkSession.read.parquet(save_path)
            return analysis.top_tfidf(df, n, known, lemmas=lemmas)

        return self.then(stage)

    def get_entities(self, blacklist_entities=(), max_string_search: int | None = None, extractor=None):
        def stage(df):
            found = analysis.extract_entities(df, extractor) if extractor else analysis.capitalised_entities(df, max_string_search)
            rows = analysis.first_mentions(analysis.blacklist(analysis.explode_entities(found), blacklist_entities))
            return analysis.collect_entities(df, rows)

        return self.then(stage)

    def graph(self, kind: str):
        kinds = {"tfidf": analysis.tfidf_graph, "news2vec": analysis.news2vec_graph, "entity_dag": analysis.entity_dag}
        if kind not in kinds:
            raise ValueError(f"kind must be one of {sorted(kinds)}")
        return self.then(kinds[kind])

    def collect(self, spark: SparkSession | None = None) -> DataFrame:
        """The filtered articles, lazily."""
        s = self.spec
        if s.get("url_only") and "model" in s:
            raise ValueError("url_only leaves nothing to classify")
        df = self.source(spark) if callable(self.source) else self.source
        bare = s.get("url_only")
        if not bare and "dates" in s:
            df = filters.date_range(df, *s["dates"])
        if not bare and "sites" in s:
            df = filters.on_sites(df, s["sites"])
        if "exclude" in s:
            df = filters.exclude_in_url(df, s["exclude"])
        if bare:
            df = df.select("url")
        if "udf" in s:
            df = filters.apply_udf(df, *s["udf"])
        if s.get("distinct"):
            df = filters.distinct_urls(df) if len(df.columns) > 1 else df.distinct()
        if "urls" in s:
            df = filters.from_urls(df, s["urls"])
        if "keywords" in s:
            words, tokens = s["keywords"]
            df = (filters.keyword_tokens if tokens else filters.keyword_substring)(df, words)
        if "countries" in s:
            df = filters.mentions_countries(df, *s["countries"])
        if "lang" in s:
            df = filters.in_language(df, s["lang"])
        if "model" in s:
            df = analysis.classify(df, *s["model"])
        if "sample" in s:
            df = filters.sample(df, *s["sample"])
        if "limit" in s:
            df = df.limit(s["limit"])
        return df.select(*s["columns"]) if "columns" in s else df

    # --- terminal actions

    def result(self, spark: SparkSession | None = None):
        out = self.collect(spark)
        for stage in self.stages:
            out = stage(out)
        return out

    def to_pandas(self, spark: SparkSession | None = None):
        out = self.result(spark)
        return out.toPandas() if isinstance(out, DataFrame) else [x.toPandas() for x in out]

    def run(self, spark: SparkSession | None = None) -> None:
        out = self.result(spark)
        for x in (out,) if isinstance(out, DataFrame) else out:
            x.write.format("noop").mode("overwrite").save()

    def send_to(self, target: str, format: str = "parquet", spark: SparkSession | None = None, **options) -> None:
        """Appends to a store: Parquet, CSV, JDBC, MongoDB or any other format on the class path. MongoDB's batches: maxBatchSize."""
        writer = self.result(spark).write.format(format).mode("append").options(**options)
        writer.save(target) if target else writer.save()


def write_node_map(nodes: DataFrame, path: str) -> None:
    """id and value a line."""
    nodes.select(F.concat_ws(" ", F.col("id").cast("string"), "value").alias("value")).write.text(path)


def write_edge_list(edges: DataFrame, path: str) -> None:
    edges.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in ("id1", "id2", "weight"))).alias("value")).write.text(path)


def to_networkx(nodes: DataFrame, edges: DataFrame, source: str = "old_id", target: str = "new_id", label: str = "entity"):
    """A directed graph on the driver, for drawing; needs networkx, and an edge table that fits the driver."""
    import networkx as nx

    g = nx.DiGraph()
    for r in nodes.toLocalIterator():
        g.add_node(r["id"], **r.asDict())
    for r in edges.toLocalIterator():
        g.add_edge(r[source], r[target], label=r[label])
    return g
