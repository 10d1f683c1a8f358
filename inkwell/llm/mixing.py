"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power alpha, normalised. Bisection finds the alpha that meets a target: an
entropy of the weights, or a limit to how often any source's tokens repeat. A weight becomes a token budget, and a budget
is met by permutations of the source: whole epochs, each in a fresh pseudo-random order of blocks, then the blocks of one
more permutation until the budget is reached; the last block is cut by its own inner order.

Blocks are leading digits of a keyed digest, so a source has at most 4096 of them and as many inner ones, however large
it is: no source is ever sorted or gathered as a whole. What is broadcast has one row a source; more than `max_sources`
sources raise an error.

A null source is a source of its own, a null text has no tokens; documents of a source without any tokens appear once.
Rows that share source and id stand or fall together in the last epoch.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.llm.common import settle

SEED = 20240229
MAX_SOURCES = 200_000
STEPS = 50


def weights(tokens: list[int], alpha: float) -> list[float]:
    top = max(tokens)
    w = [(t / top) ** alpha for t in tokens]
    total = math.fsum(w)
    return [x / total for x in w]


def entropy(w: list[float]) -> float:
    return -math.fsum(x * math.log(x) for x in w if x > 0)


def budget_for(tokens: list[int], w: list[float], budget: int | None) -> float:
    """The given tokens, or the least number that uses each source whole."""
    return float(budget) if budget is not None else max(t / x for t, x in zip(tokens, w))


def bisect_alpha(tokens: list[int], repetition: float | None = None, entropy_share: float | None = None, budget: int | None = None) -> float:
    """The least alpha in [0, 1] whose repetitions stay within the limit, or the greatest that has the share of the highest entropy.

    A budget that no alpha can meet within the limit raises an error, as do targets out of range.
    """
    if entropy_share is not None and not 0 <= entropy_share <= 1 or repetition is not None and repetition <= 0:
        raise ValueError("a share of the entropy lies in 0..1, a repetition above 0")

    def flat_enough(alpha):  # holds at 0 and, as alpha grows, ceases to
        return entropy(weights(tokens, alpha)) >= entropy_share * math.log(len(tokens))

    def even_enough(alpha):  # holds at 1 and, as alpha falls, ceases to
        w = weights(tokens, alpha)
        b = budget_for(tokens, w, budget)
        return max(x * b / t for t, x in zip(tokens, w)) <= repetition

    lo, hi = 0.0, 1.0
    if entropy_share is not None:
        if len(tokens) < 2 or flat_enough(1.0):
            return 1.0
        for _ in range(STEPS):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if flat_enough(mid) else (lo, mid)
        return round(lo, 9)
    if even_enough(0.0):
        return 0.0
    if not even_enough(1.0) and (budget is None or budget > repetition * sum(tokens) * (1 + 1e-12)):
        raise ValueError(f"no weights keep repetitions within {repetition}: {sum(tokens)} tokens for a budget of {budget}")
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if even_enough(mid) else (mid, hi)
    return round(hi, 9)


def token_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _key(epoch, source, ident, seed: int):
    return F.md5(F.concat_ws("|", F.lit(seed), epoch.cast("string"), F.coalesce(source, F.lit("\x00")), F.coalesce(ident.cast("string"), F.lit("\x00"))))


def plan(docs: DataFrame, repetition: float | None = None, entropy_share: float | None = None, budget: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, max_sources: int = MAX_SOURCES):
    """(alpha, one row a source: source, epochs to use whole, digest up to which the next one is used, budget)."""
    if (repetition is None) == (entropy_share is None):
        raise ValueError("give one target: repetition or entropy_share")
    spark = docs.sparkSession
    slim = settle(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), token_count(F.col(f"`{text_col}`").cast("string")).alias("n")), "tokens")
    rows = slim.groupBy("source").agg(F.sum("n").alias("t")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    full = [r for r in rows if r.t > 0]
    alpha, shares = 1.0, {}
    if full:
        tokens = [r.t for r in full]
        alpha = bisect_alpha(tokens, repetition, entropy_share, budget)
        w = weights(tokens, alpha)
        total = budget_for(tokens, w, budget)
        shares = {r.source: math.floor(total * x + 0.5) for r, x in zip(full, w)}
    told = [(r.source, *divmod(shares[r.source], r.t), shares[r.source]) if r.t else (r.source, 1, 0, 0) for r in rows]
    schema = "source string, epochs bigint, rest bigint, budget bigint"
    table = spark.createDataFrame(told, schema)
    part = F.broadcast(table.where("rest > 0").withColumnRenamed("source", "of"))
    keyed = slim.join(part, F.col("source").eqNullSafe(F.col("of"))).select("source", "id", "n", "rest", _key(F.col("epochs"), F.col("source"), F.col("id"), seed).alias("key"))

    def cut(frame, digits):
        """Per source, the piece of the permutation in which the rest of its budget is reached, and what remains for it."""
        sums = frame.groupBy("source", "rest", F.substring("key", 1, digits).alias("piece")).agg(F.sum("n").alias("n"))
        before = F.sum("n").over(Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
        w = sums.withColumn("before", F.coalesce(before, F.lit(0))).where("before < rest")
        return w.groupBy("source").agg(F.max("piece").alias("piece"), F.max_by(F.col("rest") - F.col("before"), "piece").alias("rest"))

    at = None
    for digits in (3, 6, 32):
        if at is not None:
            few = F.broadcast(at.withColumnRenamed("source", "of"))
            keyed = keyed.drop("rest").join(few, F.col("source").eqNullSafe(F.col("of")) & F.col("key").startswith(F.col("piece"))).select("source", "id", "n", "rest", "key")
        at = settle(cut(keyed, digits), "cuts")
    cuts = {r.source: r.piece for r in at.collect()}
    rows = [(s, e, cuts.get(s, "") if r else "", b) for s, e, r, b in told]
    return alpha, spark.createDataFrame(rows, "source string, epochs bigint, last string, budget bigint")


def mix(docs: DataFrame, repetition: float | None = None, entropy_share: float | None = None, budget: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, marks: bool = False, max_sources: int = MAX_SOURCES) -> DataFrame:
    """docs as often as the mixture uses them. With marks also mix_epoch, mix_block and mix_key, whose order within an epoch
    is the permutation. Without a budget, the least one that uses every document is taken. Texts are not shuffled."""
    _, table = plan(docs, repetition, entropy_share, budget, id_col, text_col, source_col, seed, max_sources)
    few = F.broadcast(table.select(F.col("source").alias("__source"), F.col("epochs").alias("__epochs"), F.col("last").alias("__last")))
    source = F.col(f"`{source_col}`").cast("string")
    out = docs.join(few, source.eqNullSafe(F.col("__source")))
    # The epoch in which the budget ends takes what comes up to the cut.
    more = _key(F.col("__epochs"), source, F.col(f"`{id_col}`"), seed) <= F.col("__last")
    times = F.col("__epochs") + more.cast("bigint")
    out = out.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.when(times > 0, F.sequence(F.lit(0).cast("bigint"), times - 1)).otherwise(F.array().cast("array<bigint>"))).alias("__epoch"))
    if not marks:
        return out.drop("__epoch")
    out = out.drop("mix_epoch").withColumnRenamed("__epoch", "mix_epoch")
    key = _key(F.col("mix_epoch"), source, F.col(f"`{id_col}`"), seed)
    return out.withColumn("mix_key", key).withColumn("mix_block", F.conv(F.substring("mix_key", 1, 3), 16, 10).cast("int"))


def mix_sql(repetition: float, seed: int = SEED) -> str:
    """op1's rows from `documents` for DuckDB: repetition target, covering budget."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n FROM documents),
s AS (SELECT source, sum(n)::BIGINT AS t FROM d GROUP BY source),
f AS (SELECT max(t) AS hi, min(t) AS lo FROM s WHERE t > 0),
bis(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, CASE WHEN (SELECT hi / lo FROM f) <= {repetition} THEN 0.0 ELSE 1.0 END::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN power((SELECT hi / lo FROM f), 1 - (lo + hi) / 2) <= {repetition} THEN lo ELSE (lo + hi) / 2 END,
         CASE WHEN power((SELECT hi / lo FROM f), 1 - (lo + hi) / 2) <= {repetition} THEN (lo + hi) / 2 ELSE hi END
  FROM bis WHERE i < {STEPS}),
a AS (SELECT round(hi, 9) AS alpha FROM bis WHERE i = {STEPS}),
b AS (SELECT source, t, CASE WHEN t > 0 THEN floor((SELECT hi FROM f) * power(t / (SELECT hi FROM f), (SELECT alpha FROM a)) + 0.5)::BIGINT ELSE 0 END AS budget FROM s),
p AS (SELECT source, CASE WHEN t > 0 THEN budget // t ELSE 1 END AS epochs, CASE WHEN t > 0 THEN budget % t ELSE 0 END AS rest FROM b),
k AS (SELECT d.*, p.epochs, p.rest, md5(concat_ws('|', '{seed}', p.epochs::VARCHAR, coalesce(d.source, chr(0)), d.doc_id::VARCHAR)) AS key FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k),
e AS (SELECT doc_id, source, n, unnest(range(epochs + CASE WHEN before < rest THEN 1 ELSE 0 END)) AS epoch FROM c)
SELECT doc_id, source, n AS n_tokens, epoch::BIGINT AS mix_epoch, md5(concat_ws('|', '{seed}', epoch::VARCHAR, coalesce(source, chr(0)), doc_id::VARCHAR)) AS mix_key,
       ('0x' || substr(mix_key, 1, 3))::INTEGER AS mix_block FROM e"""
