"""Web-crawl sources: the URL index, crawl listings, WARC archives and the articles in them."""

from __future__ import annotations

import gzip
import html as markup
import io
import re
import zlib
from datetime import date
from html.parser import HTMLParser
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions.store import written
from inkwell.functions.text import ISO_639_3, wildcard
from inkwell.operators import filters

_STRINGS = "url_surtkey url url_host_name url_host_tld url_host_2nd_last_part url_host_3rd_last_part url_host_4th_last_part url_host_5th_last_part url_host_registry_suffix url_host_registered_domain url_host_private_suffix url_host_private_domain url_host_name_reversed url_protocol url_path url_query content_digest content_mime_type content_mime_detected content_charset content_languages content_truncated fetch_redirect warc_filename warc_segment crawl subset"
INDEX_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in _STRINGS.split()]
    + [T.StructField("url_port", T.IntegerType()), T.StructField("fetch_time", T.TimestampType()), T.StructField("fetch_status", T.ShortType()), T.StructField("warc_record_offset", T.IntegerType()), T.StructField("warc_record_length", T.IntegerType())]
)
RECORD_COLUMNS = ["url", "url_path", "warc_filename", "warc_record_offset", "warc_record_length", "content_charset"]
MONTHS = {m: k for k, m in enumerate("january february march april may june july august september october november december".split(), 1)}


def read_index(spark: SparkSession, path: str, view: str | None = "ccindex") -> DataFrame:
    """The index with its declared schema; crawl and subset prune partitions."""
    df = spark.read.schema(INDEX_SCHEMA).parquet(path)
    if view:
        df.createOrReplaceTempView(view)
    return df


def query_index(spark: SparkSession, path: str, query: str) -> DataFrame:
    """Any SQL over the view ccindex."""
    read_index(spark, path)
    return spark.sql(query)


def read_index_csv(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    casts = {c: F.col(c).cast("int") for c in ("warc_record_offset", "warc_record_length") if c in df.columns}
    return df.drop("_c0").withColumns(casts)


def language_code(lang: str) -> str:
    """The three-letter code; unknown two-letter codes raise KeyError."""
    return lang if len(lang) == 3 else ISO_639_3[lang]


def wrong_year(path: Column, start: date, end: date, today: date | None = None) -> Column:
    """Whether a path holds /Y/ for a year since 1991 outside of the range."""
    years = [str(y) for y in range(1991, (today or date.today()).year + 1) if not start.year <= y <= end.year]
    return path.rlike("/(" + "|".join(years) + ")/") if years else F.lit(False)


def index_filter(df: DataFrame, crawls="all", sites=None, lang=None, urls=None, blacklist=(), start=None, end=None, limit=None, today: date | None = None) -> DataFrame:
    """The index rows of articles to fetch, as plain predicates, which prune partitions and reach the Parquet scan.

    crawls: all, an id or several; what "latest" or a date stand for, select_crawls says.
    """
    df = df.where("subset = 'warc'")
    if crawls == "latest":
        raise ValueError("latest is no crawl: take it from select_crawls")
    if crawls != "all":
        df = df.where(F.col("crawl").isin([crawls] if isinstance(crawls, str) else list(crawls)))
    if sites:
        if bad := [s for s in sites if "." not in s]:
            raise ValueError(f"not a domain: {bad[0]}")
        df = df.where(F.col("url_host_registered_domain").isin(list(sites)))
    if urls:
        df = df.where(F.col("url").isin(list(urls)))
    if lang:
        df = df.where(F.col("content_languages").isNull() | (F.col("content_languages") == language_code(lang)))
    df = df.where(F.length("url_path") > 1)
    for p in blacklist:
        df = df.where(~F.col("url_path").like(wildcard(p)))
    if start and end:
        df = df.where(~wrong_year(F.col("url_path"), start, end, today))
    df = df.select(*RECORD_COLUMNS)
    return df.limit(limit) if limit else df


def read_crawls(spark: SparkSession, path: str) -> DataFrame:
    """(place, id, name) of a JSON list of crawls, newest first, as the index server gives it."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<struct<id:string,name:string>>")).alias("place", "c"))
    return rows.select("place", "c.id", "c.name")


def crawl_ids(crawls: DataFrame) -> list[str]:
    """All ids, newest first; a list has some hundreds."""
    return [r.id for r in crawls.orderBy("place").collect()]


def select_crawls(crawls: DataFrame, choice=None, since: date | None = None):
    """What index_filter takes: "all", the latest crawl's id, the ids given, or without a choice those since a date."""
    if choice == "all":
        return "all"
    if choice == "latest":
        return crawl_ids(crawls)[:1]
    if choice is not None:
        return [choice] if isinstance(choice, str) else list(choice)
    if since is None:
        raise ValueError("choose crawls, or a start date")
    return crawl_ids(crawls_since(crawls, since, "name"))


def crawls_since(crawls: DataFrame, since: date, col: str = "id") -> DataFrame:
    """Crawls of a later year than the date's, or of its year and a month not before; a name's least year counts."""
    name = F.lower(col)
    year = F.array_min(F.transform(F.regexp_extract_all(name, F.lit("([0-9]{4})"), 1), lambda y: y.cast("int")))
    month = F.coalesce(*(F.when(name.contains(m), F.lit(k)) for m, k in MONTHS.items()))
    return crawls.where((year > since.year) | ((year == since.year) & (month >= since.month)))


def news_listing_days(spark: SparkSession, start: date, end: date, pad: int = 30) -> DataFrame:
    """The day prefixes of archive listings: from start to `pad` days after end."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.date_add(F.lit(end), pad))).alias("day")).select(F.date_format("day", "yyyyMMdd").alias("prefix"))


def archives_between(paths: DataFrame, start: date | None, end: date | None, pad: int = 30, col: str = "uri") -> DataFrame:
    """The archives of a listing whose name says a day from start to `pad` days after end; all without a bound."""
    if start is None and end is None:
        return paths
    day = F.to_date(F.regexp_extract(col, r"([0-9]{8})[0-9]*-[0-9]+\.warc", 1), "yyyyMMdd")
    if start is not None:
        paths = paths.where(day >= F.lit(start))
    return paths if end is None else paths.where(day <= F.date_add(F.lit(end), pad))


def listing(spark: SparkSession, path: str, bucket: str) -> DataFrame:
    """A (gzipped) listing of paths as full URIs."""
    return spark.read.text(path).select(F.concat(F.lit(f"s3://{bucket}/"), "value").alias("uri"))


# --- WARC ----------------------------------------------------------------------


def warc_records(source):
    """(type, headers, http headers, payload) of the records in WARC bytes or a file of them, gzipped member by member or not.

    Records are read one at a time, so memory follows the largest, not the archive. Stops at damage.
    """
    f = io.BufferedReader(io.BytesIO(source)) if isinstance(source, bytes) else source if hasattr(source, "peek") else io.BufferedReader(source)
    if f.peek(2)[:2] == b"\x1f\x8b":
        f = gzip.GzipFile(fileobj=f)
    try:
        while True:
            line = f.readline()
            while line in (b"\r\n", b"\n"):
                line = f.readline()
            if not line.startswith(b"WARC/"):
                return
            head = _headers(f)
            body = f.read(int(head.get("content-length", "0")))
            http, payload = {}, body
            if head.get("warc-type") == "response" and b"\r\n\r\n" in body:
                top, payload = body.split(b"\r\n\r\n", 1)
                http = _headers(io.BytesIO(top.split(b"\r\n", 1)[-1] + b"\r\n\r\n"))
            yield head.get("warc-type"), head, http, payload
    except (EOFError, OSError, ValueError, zlib.error):
        return  # a cut archive gives what it holds


def _headers(f) -> dict[str, str]:
    out = {}
    while (line := f.readline().strip()) != b"":
        k, _, v = line.decode("utf-8", "replace").partition(":")
        out[k.strip().lower()] = v.strip()
    return out


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__()
        self.meta, self.parts, self.skip, self.at = {}, [], 0, ""

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta" and (k := a.get("property") or a.get("name") or a.get("itemprop")):
            self.meta.setdefault(k.lower(), a.get("content") or "")
        elif tag == "time" and a.get("datetime"):
            self.meta.setdefault("time", a["datetime"])
        elif tag in ("script", "style", "nav", "footer", "aside"):
            self.skip += 1
        elif tag in ("title", "p", "h1"):
            self.at = tag
            if tag != "title":
                self.parts.append("")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "nav", "footer", "aside"):
            self.skip = max(0, self.skip - 1)
        elif tag == self.at:
            self.at = ""

    def handle_data(self, data):
        if not self.skip and self.at == "p" and self.parts:
            self.parts[-1] += data


_TITLE, _END, _REFERENCE = re.compile("<title", re.I), re.compile("</title>", re.I), re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[a-zA-Z]\w*);")


def page_title(html: str) -> str:
    """What the first title element holds, else ''. References count where a semicolon ends them: a cut one stays as it is."""
    at = _TITLE.search(html)
    start = html.find(">", at.end()) + 1 if at else 0
    end = _END.search(html, start) if start else None
    return _REFERENCE.sub(lambda m: markup.unescape(m.group()), html[start : end.start()]).strip() if end else ""


_DATES = ("article:published_time", "datepublished", "date", "dc.date", "pubdate", "time")


def parse_article(url: str, html: str | bytes, charset: str | None = None, title: str | None = None) -> dict:
    """title (the given one, if any), text, url, publish_date (ISO text or None), og_type and every meta tag of a page."""
    if isinstance(html, bytes):
        html = html.decode(charset or "utf-8", "replace")
    r = _Reader()
    r.feed(html)
    when = next((m.group() for k in _DATES if (m := re.match(r"\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?)?", r.meta.get(k, "")))), None)
    return {"url": url, "title": title or r.meta.get("og:title") or page_title(html), "text": "\n".join(p.strip() for p in r.parts if p.strip()), "publish_date": when and when.replace("T", " "), "og_type": r.meta.get("og:type"), "meta": r.meta}


def link_to_article(link: str, download) -> dict:
    """parse_article of what download(link) -> bytes gives; a page that can't be had or read raises ValueError."""
    try:
        return parse_article(link, download(link))
    except (OSError, LookupError, ValueError) as e:
        raise ValueError(f"{link}: {e}") from e


def dict_to_article(fields: dict) -> dict:
    """An article of the same form from url, title, text and publish_date."""
    return {"og_type": None, "meta": {}, **{k: fields[k] for k in ("url", "title", "text", "publish_date")}}


#: status: ok, not html, failed (a page that can't be parsed), input failed (an archive or a range that can't be read).
_ARTICLE = "url string, title string, text string, publish_date timestamp_ntz, og_type string, meta map<string,string>, status string"
_ROWS = 256


def _frame(rows: list[dict]):
    import pandas as pd

    names = ["url", "title", "text", "publish_date", "og_type", "meta", "status"]
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype="datetime64[us]" if c == "publish_date" else object) for c in names})


def _articles(records, sites=(), limit: int | None = None):
    """Rows of the responses among the records; at most `limit` that are ok."""
    import pandas as pd

    good = 0
    for kind, head, http, payload in records:
        if kind != "response":
            continue
        url = head.get("warc-target-uri", "")
        if not any(k in http.get("content-type", "").lower() for k in ("text/html", "application/xhtml+xml")):
            yield {"url": url, "status": "not html"}
            continue
        if sites and not _on_sites(url, sites):
            continue
        charset = re.search(r"charset=([\w-]+)", http.get("content-type", ""))
        try:
            a = parse_article(url, payload, charset and charset.group(1))
            yield {**a, "publish_date": pd.Timestamp(a["publish_date"]) if a["publish_date"] else None, "status": "ok"}
            good += 1
        except (LookupError, ValueError):
            yield {"url": url, "status": "failed"}
        if limit is not None and good >= limit:
            return


def _on_sites(url: str, sites) -> bool:
    host = (urlsplit(url).hostname or "").lower()
    return any(host == s.lower() or host.endswith("." + s.lower()) for s in sites)


def _in_frames(rows):
    some = []
    for r in rows:
        some.append(r)
        if len(some) == _ROWS:
            yield _frame(some)
            some = []
    yield _frame(some)


def articles_from_warcs(files: DataFrame, sites=(), limit_each: int | None = None) -> DataFrame:
    """Articles of the HTML responses in WARC files (a binaryFile scan: column content), damage skipped."""

    def run(batches):
        yield from _in_frames(r for b in batches for raw in b["content"] for r in _articles(warc_records(bytes(raw)), sites, limit_each))

    return files.select("content").mapInPandas(run, _ARTICLE)


def articles_from_archives(paths: DataFrame, open_file, sites=(), limit: int | None = None, col: str = "uri") -> DataFrame:
    """Articles of whole archives, streamed: open_file(uri) -> binary file runs in the tasks, one archive after another.

    With a limit each archive gives its equal part of it, rounded up, and the table no more than it.
    """
    quota = None if limit is None else -(-limit // max(1, paths.count()))

    def run(batches):
        def rows():
            for b in batches:
                for uri in b[col]:
                    try:
                        with open_file(uri) as f:
                            yield from _articles(warc_records(f), sites, quota)
                    except OSError:
                        yield {"url": uri, "status": "input failed"}

        yield from _in_frames(rows())

    out = paths.select(col).mapInPandas(run, _ARTICLE)
    return out if limit is None else out.where("status = 'ok'").limit(limit)


def articles_from_index(rows: DataFrame, read_range) -> DataFrame:
    """Articles of index rows; read_range(file, offset, length) -> bytes runs in the tasks. Ranges that can't be read are marked."""

    def run(batches):
        def rows_():
            for b in batches:
                for f, o, n in zip(b["warc_filename"], b["warc_record_offset"], b["warc_record_length"]):
                    try:
                        yield from _articles(warc_records(read_range(f, int(o), int(n))))
                    except OSError:
                        yield {"url": f, "status": "input failed"}

        yield from _in_frames(rows_())

    return rows.select("warc_filename", "warc_record_offset", "warc_record_length").mapInPandas(run, _ARTICLE)


def counted(df: DataFrame, name: str = "records"):
    """(df, an observation): after an action on df, observation.get has processed, failed, not_html and inputs_failed."""
    from pyspark.sql import Observation

    o = Observation(name)
    return df.observe(o, F.count("*").alias("processed"), *(F.count_if(F.col("status") == s).alias(s.replace(" ", "_").replace("input_", "inputs_")) for s in ("failed", "not html", "input failed"))), o


def is_article(df: DataFrame) -> DataFrame:
    """Complete records that say they are articles."""
    return df.where("status = 'ok' and title <> '' and text <> '' and publish_date is not null and og_type = 'article'")


def _finished(df: DataFrame, start, end, keywords, limit) -> DataFrame:
    out = filters.date_range(is_article(df), start, end).select("title", "text", "url", "publish_date")
    if keywords:
        out = filters.keyword_substring(out, keywords)
    return out if limit is None else out.limit(limit)


def crawl_articles(index: DataFrame, read_range, crawls="all", sites=None, lang=None, urls=None, blacklist=(), start: date | None = None, end: date | None = None, keywords=(), limit: int | None = None, url_only: bool = False) -> DataFrame:
    """Articles of a web crawl: index rows are selected, their ranges read, their pages parsed and filtered."""
    rows = index_filter(index, crawls, sites, lang, urls, blacklist, start, end, limit)
    return rows.select("url") if url_only else _finished(articles_from_index(rows, read_range), start, end, keywords, limit)


def news_crawl_articles(archives: DataFrame, open_file, sites=(), start: date | None = None, end: date | None = None, keywords=(), limit: int | None = None, url_only: bool = False) -> DataFrame:
    """Articles of the news crawl: the archives of the days in question are streamed, pages of the sites parsed and filtered."""
    pages = articles_from_archives(archives_between(archives, start, end), open_file, sites)
    if url_only:
        return pages.where("status = 'ok'").select("url") if limit is None else pages.where("status = 'ok'").select("url").limit(limit)
    return _finished(pages, start, end, keywords, limit)


def storage_options(key: str, secret: str) -> dict[str, str]:
    """Session settings for reading the crawl's buckets with one's own credentials."""
    s3 = "spark.hadoop.fs.s3a."
    return {s3 + "aws.credentials.provider": "org.apache.hadoop.fs.s3a.SimpleAWSCredentialsProvider", s3 + "access.key": key, s3 + "secret.key": secret, s3 + "impl": "org.apache.hadoop.fs.s3a.S3AFileSystem"}


# --- search engine ----------------------------------------------------------------


def search_query(keywords=(), sites=(), start: date | None = None, end: date | None = None) -> str:
    """The engine's query string: keywords, alternative sites, and a date window widened by a day on each side."""
    from datetime import timedelta

    parts = [*keywords]
    if sites:
        parts.append(" OR ".join(f"site:{s}" for s in sites))
    if start:
        parts.append(f"after:{start - timedelta(1)}")
    if end:
        parts.append(f"before:{end + timedelta(1)}")
    return " ".join(parts)


def search(spark: SparkSession, client, query: str, max_articles: int = 100) -> DataFrame:
    """URLs that client(query, start) -> [url] gives, in pages of ten, fetched by tasks; no result raises ValueError."""
    pages = spark.range(0, -(-max_articles // 10), 1, max(1, -(-max_articles // 10)))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k in b.column("id").to_pylist():
                urls = list(client(query, 10 * k + 1))[:10]
                yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string())], ["url"])

    out = written(pages.mapInArrow(run, "url string").limit(max_articles), "found")  # the engine is asked once
    if out.isEmpty():
        raise ValueError("the search found nothing")
    return out


def search_articles(spark: SparkSession, client, download, keywords=(), sites=(), start: date | None = None, end: date | None = None, max_articles: int = 100, url_only: bool = False) -> DataFrame:
    """Articles of the pages that the engine finds; download(url) -> bytes runs in the tasks, pages that fail go."""
    urls = search(spark, client, search_query(keywords, sites, start, end), max_articles)
    if url_only:
        return urls

    def run(batches):
        def rows():
            import pandas as pd

            for b in batches:
                for u in b["url"]:
                    try:
                        a = link_to_article(u, download)
                        yield {**a, "publish_date": pd.Timestamp(a["publish_date"]) if a["publish_date"] else None, "status": "ok"}
                    except ValueError:
                        yield {"url": u, "status": "failed"}

        yield from _in_frames(rows())

    return urls.mapInPandas(run, _ARTICLE).where("status = 'ok'").select("title", "text", "url", "publish_date")
