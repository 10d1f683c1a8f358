"""The operators' registered queries, and their SQL where SQL can express them."""

from __future__ import annotations

import secrets

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import bpe, embed_dedup, html_text, licenses, mixing, ngram_join, pii, secret_scan, topk, toxicity
from inkwell.llm.common import table

REPETITION = 1.5
RANKS = "byte_bpe_50k.tiktoken"


def held_out(ident):
    return F.coalesce(F.crc32(ident.cast("string")) % 5 == 0, F.lit(False))


_keys: dict[str, bytes] = {}


def pii_key(spark: SparkSession) -> bytes:
    """spark.inkwell.pii.key in hexadecimal; where unset, random bytes that last as long as the application."""
    told = spark.conf.get("spark.inkwell.pii.key", None)
    return bytes.fromhex(told) if told else _keys.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as often as the mixture uses them: every one, none more than REPETITION times over its source. Null and empty texts have no tokens and stay; ties go by digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mixing.mix(docs, repetition=REPETITION, marks=True)
    return out.select("doc_id", "source", mixing.token_count(F.col("text")).alias("n_tokens"), "mix_epoch", "mix_key", "mix_block")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each whole text and what they decode to, as digests. Null and empty texts have no ids; repeated rows repeat."""
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), keep=["doc_id"], ids=False, decode=True)


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of each row whose vec_id 20 divides, among all others; ties to the smaller vec_id."""
    v = table(spark, sf_dir, "embeddings")
    return topk.top_k(v, v.where("vec_id % 20 = 0"), k=20, scale=64)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets of each whole text. Null and empty texts have none; repeated rows repeat."""
    return secret_scan.secret_scan(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.98 and more within a label, and their components. Vectors that can't be compared link with nothing."""
    return embed_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with personal data replaced, and counts of each kind. Null stays null, equal values stay equal."""
    return pii.pseudonyms(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score and a decision for each whole text, learnt from the labels that aren't held out. Empty texts get the bias."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), train_where=~held_out(F.col("id")))
    return toxicity.score(docs, machine, keep=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many others each document links with at 60 percent of their word pairs, and its component. Texts without words link with nothing."""
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"), width=2, percent=60)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each whole page. Null and empty pages have an empty one."""
    return html_text.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence that each whole text is, and the notices among its lines. Null and empty texts have none."""
    return licenses.license_scan(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_byte_bpe, op3_exact_topk, op4_secret_scan, op5_embedding_dedup, op6_pii_pseudonyms, op7_toxicity, op8_ngram_jaccard, op9_html_text, op10_license_scan)}


def _fold(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _secret_sql() -> str:
    words = "|".join(map(_fold, ("password", "passwd", "secret", "token")))
    assign = f"(?:{words}|{_fold('api')}_?{_fold('key')})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
    kinds = [("assign", assign, 0), ("access", "AKIA[A-Z0-9]+", 18), ("hex", "[0-9a-f]+", 16), ("github", "gh[pousr]_[A-Za-z0-9]+", 40), ("slack", "xox[abprs]-[A-Za-z0-9-]+", 15), ("google", "AIza[A-Za-z0-9_-]+", 39), ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30), ("private", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 1)]
    # A match begins after the gaps and matches before it.
    parts = []
    for k, (kind, rx, least) in enumerate(kinds):
        ok = f"len(regexp_extract(m[i], '{rx}', 1)) >= 12" if kind == "assign" else f"len(m[i]) >= {least}"
        parts.append(
            f"SELECT doc_id, {k} AS k, '{kind}' AS kind, i, list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))), 0) AS a, len(m[i]) AS n, {ok} AS ok "
            f"FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{rx}', 0) AS m, string_split_regex(t, '{rx}') AS g FROM d))"
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, k, kind, a::BIGINT AS a, (a + n)::BIGINT AS z FROM ({' UNION ALL '.join(parts)}) WHERE ok),
g AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
             coalesce(string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k) FILTER (WHERE k < 3), '') AS base,
             string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN g USING (doc_id)"""


def _components(edges: str, nodes: str) -> str:
    """CTEs: reach(node, least) from edges(a, b) in both directions."""
    return f"""reach AS (SELECT node, node AS seen FROM ({nodes}) UNION SELECT reach.node, e.b FROM reach JOIN ({edges}) e ON e.a = reach.seen),
least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)"""


_TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20"""

_DEDUP_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.98),
{_components('SELECT * FROM links', 'SELECT vec_id AS node FROM embeddings')}
SELECT node AS vec_id, (SELECT count(*) FROM links WHERE a = node) AS n_links, component_id, node = component_id AS kept FROM least"""

_NGRAM_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), least(len(w) + 1, 2)))) AS i FROM w)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
one AS MATERIALIZED (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * k >= 60 * (x.n + y.n - k)),
links AS MATERIALIZED (SELECT a, b FROM one UNION ALL SELECT b, a FROM one),
{_components('SELECT * FROM links', 'SELECT doc_id AS node FROM documents')}
SELECT node AS doc_id, coalesce((SELECT n FROM n WHERE n.doc_id = node), 0)::BIGINT AS n_shingles, (SELECT count(*) FROM links WHERE a = node) AS n_similar, component_id FROM least"""

ORACLE_SQL = {
    "op1_mix_sources": mixing.mix_sql(REPETITION),
    "op3_exact_topk": _TOPK_SQL,
    "op4_secret_scan": _secret_sql(),
    "op5_embedding_dedup": _DEDUP_SQL,
    "op8_ngram_jaccard": _NGRAM_SQL,
    "op10_license_scan": licenses.license_sql(),
}
