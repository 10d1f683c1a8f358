"""Article filters: declarative predicates that reach the scan wherever the source can take them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as T


def date_range(df: DataFrame, start=None, end=None) -> DataFrame:
    """Both bounds inclusive by day and optional. publish_date itself is compared, so the bounds can be pushed down."""
    if start is not None:
        df = df.where(F.col("publish_date") >= F.lit(start).cast("date").cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col("publish_date") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
    return df


def on_sites(df: DataFrame, sites) -> DataFrame:
    """Sites as substrings of the URL."""
    return df.where(T.contains_any(F.col("url"), sites))


def on_hosts(df: DataFrame, sites) -> DataFrame:
    return df.where(T.on_host(F.col("url"), sites))


def exclude_in_url(df: DataFrame, patterns) -> DataFrame:
    """Drops URLs like any pattern; * matches anything, _ one character."""
    for p in patterns:
        df = df.where(~F.col("url").like(T.wildcard(p)))
    return df


def from_urls(df: DataFrame, urls) -> DataFrame:
    """Rows whose URL is in a list, or in the url column of a frame (semi-join)."""
    if isinstance(urls, DataFrame):
        return df.join(urls.select("url"), "url", "left_semi")
    return df.where(F.col("url").isin(list(urls)))


def keyword_tokens(df: DataFrame, keywords) -> DataFrame:
    """A keyword is one of the tokens of title and text."""
    t = T.tokens(T.all_text(F.col("title"), F.col("text")))
    return df.where(F.arrays_overlap(t, F.array(*map(F.lit, keywords))))


def keyword_substring(df: DataFrame, keywords) -> DataFrame:
    """A keyword occurs, as written, in the title or the text."""
    return df.where(F.coalesce(T.contains_any(F.col("title"), keywords), F.lit(False)) | F.coalesce(T.contains_any(F.col("text"), keywords), F.lit(False)))


def mentions_countries(df: DataFrame, wanted=(), least: int = 0, ignore=(), output: bool = False, gazetteer=T.GAZETTEER) -> DataFrame:
    """Filters by the countries mentioned. A countries column is used as it is (array, or JSON text), else extracted."""
    if "countries" in df.columns:
        c = F.from_json("countries", "array<string>") if dict(df.dtypes)["countries"] == "string" else F.col("countries")
    else:
        c = T.countries(T.all_text(F.col("title"), F.col("text")), gazetteer)
    if ignore:
        c = F.array_except(c, F.array(*map(F.lit, ignore)))
    df = df.withColumn("countries", c)
    if least:
        df = df.where(F.coalesce(F.size("countries"), F.lit(0)) >= least)
    if wanted:
        df = df.where(F.arrays_overlap("countries", F.array(*map(F.lit, wanted))))
    return df if output else df.drop("countries")


def in_language(df: DataFrame, lang: str = "en") -> DataFrame:
    return df.where(T.language(T.all_text(F.col("title"), F.col("text"))) == lang)


def distinct_urls(df: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """One row per URL, the least in the given order (by default of all orderable columns): a partial aggregate, no window."""
    rest = [F.col(c) for c in df.columns if c != "url"]
    key = F.struct(*(order or rest))
    best = df.groupBy("url").agg(F.min_by(F.struct(*rest), key).alias("__best"))
    return best.select(*(F.col("url") if c == "url" else F.col("__best")[c].alias(c) for c in df.columns))


def apply_udf(df: DataFrame, udf, column: str) -> DataFrame:
    """Replaces a column by udf(column) where it isn't null; other rows go."""
    return df.where(F.col(column).isNotNull()).withColumn(column, udf(F.col(column)))


def sample(df: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """n rows by a seeded random order: a bounded heap per task, no full sort."""
    return df.orderBy(F.rand(seed)).limit(n)


def complete(df: DataFrame) -> DataFrame:
    """Articles that have a title, a text and a date."""
    return df.where((F.col("title") != "") & (F.col("text") != "") & F.col("publish_date").isNotNull())


# --- pages and crawl records ------------------------------------------------


def og_type_is_article(html: Column) -> Column:
    tag = F.lower(F.regexp_extract(html, r"(?i)(<meta[^>]*\bproperty=[\"']og:type[\"'][^>]*>)", 1))
    return F.regexp_extract(tag, r"content=[\"']([^\"']*)[\"']", 1) == "article"


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def linked_headlines(html: Column, least: float = 0.0, self_domain: str | None = None) -> Column:
    """The share of headlines that hold a link (of the own domain); fewer than five headlines count as all linked."""
    heads = F.regexp_extract_all(html, F.lit(r"(?is)(<h[1-6][^>]*>.*?</h[1-6]>)"), 1)
    link = r"(?is)<a\s[^>]*href" if self_domain is None else rf"(?is)<a\s[^>]*href=[\"'](?:/|https?://[^/\"']*{self_domain})"
    linked = F.size(F.filter(heads, lambda h: h.rlike(link)))
    return F.when(F.size(heads) < 5, F.lit(1.0)).otherwise(linked / F.size(heads))


def is_html(content_type: Column, identified: Column | None = None) -> Column:
    kinds = ("text/html", "application/xhtml+xml")
    by_header = F.coalesce(T.contains_any(F.lower(content_type), kinds), F.lit(False))
    return by_header if identified is None else F.coalesce(identified.isin(*kinds), F.lit(False)) | by_header


def is_wet_text_record(rec_type: Column, content_type: Column) -> Column:
    return (rec_type == "conversion") & (content_type == "text/plain")


def is_wat_json_record(rec_type: Column, content_type: Column) -> Column:
    return (rec_type == "metadata") & (content_type == "application/json")
