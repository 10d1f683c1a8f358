"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words in lower case, and stems of them, hashed into buckets: insults are inflected, and a
stem is learnt from rows that never had the form at hand. The machine adds a weight for each term and, for each pair of terms, the inner product of their factors, so that an insult beside a mention of a
group counts for more than the sum of both. It is fitted in the driver on at most `fit_rows` labelled rows, chosen by
hash of their id, and every bucket that at least LEAST_ROWS of them have, so that terms which tell only in a pair take
part too; scoring covers every text whole.

Terms of fewer than LEAST_ROWS rows of the sample have no weight, as nothing can be learnt from them; toxic rows, where they
are the fewer, count up to HEAVIEST times. Null and empty texts have no terms and get the machine's bias as their score.
Labels are never inputs of a score. Repeated rows have a score each; of several texts with one labelled id the least is learnt from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import _BYTE_LOWER, ceil_div, extend, pieces, settle, trim, utf8, word_hashes

BITS = 20
HEADS = (4, 6, 7)  # bytes of the stems that count as terms beside the whole word
FIT_ROWS = 20_000
FACTORS = 8
HEAVIEST = 3.0  # how much a toxic row counts at most, where they are the fewer
LEAST_ROWS = 3  # for a term to be learnt from
LEAD, LEAD_GAIN = 1024, 2.0  # terms that are fitted first
EPOCHS, RATE, EPS, START = (40, 15), 0.02, 1e-2, 0.01  # EPS holds rare terms back

_BREAKS = np.ones(256, bool)
_BREAKS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def text_terms(column) -> tuple[np.ndarray, np.ndarray, int]:
    """(bucket, text) of each term occurrence, and the number of texts."""
    data, offsets = utf8(column)
    upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    if len(upper):  # accented capitals
        data = data.copy()
        data[upper] += 32
    words, owner, *heads = word_hashes(data, offsets, _BREAKS, _BYTE_LOWER, HEADS)
    shift = np.uint64(64 - BITS)
    buckets, owners = [words >> shift], [owner]
    for k, h in enumerate(heads):
        other = h != words
        buckets.append((h[other] * np.uint64(2 * k + 0x9E3779B97F4A7C15)) >> shift)
        owners.append(owner[other])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners), len(offsets) - 1


@dataclass
class Machine:
    """slot: the term number of each bucket or -1."""

    slot: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def scores(self, buckets: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        term = self.slot[buckets]
        known = term >= 0
        m = len(self.weight)
        pair = np.unique(owner[known] * m + term[known])
        doc, term = pair // m, pair % m
        z = self.bias + np.bincount(doc, self.weight[term], n)
        for f in self.factor.T:
            z += 0.5 * (np.bincount(doc, f[term], n) ** 2 - np.bincount(doc, f[term] ** 2, n))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _none(factors: int) -> Machine:
    return Machine(np.full(1 << BITS, -1, np.int32), 0.0, np.zeros(1), np.zeros((1, factors)))


def fit(rows: list[np.ndarray], labels: np.ndarray, factors: int = FACTORS) -> Machine:
    """A machine for term buckets (distinct, per row) and 0/1 labels, all in memory. Without rows, all scores are 0.5."""
    y, n = np.asarray(labels, np.float64), len(rows)
    if not n:
        return _none(factors)
    bucket = np.concatenate(rows)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    ones, all_ = np.bincount(bucket, y[owner], 1 << BITS), np.bincount(bucket, minlength=1 << BITS)
    slot, lead = _order(np.arange(1 << BITS), ones, all_, y.sum(), n)
    return learn(slot, [slot[r][slot[r] >= 0] for r in rows], y, factors, lead)


def _order(bucket, ones, rows, toxic, n) -> tuple[np.ndarray, int]:
    """(slots of the buckets of at least LEAST_ROWS rows, how many come first): those that tell most by themselves do.

    They go by a smoothed log-likelihood ratio of the label with and without the term.
    """
    base = (toxic + 0.5) / (n + 1)
    rate = (ones + 2 * base) / (rows + 2)
    gain = ones * np.log(rate / base) + (rows - ones) * np.log((1 - rate) / (1 - base))
    order = np.argsort(-gain, kind="stable")
    order = order[rows[order] >= LEAST_ROWS]
    return _slots(bucket[order]), int((gain[order[:LEAD]] > LEAD_GAIN).sum())


def _slots(buckets) -> np.ndarray:
    slot = np.full(1 << BITS, -1, np.int32)
    slot[np.asarray(buckets, np.int64)] = np.arange(len(buckets))
    return slot


def learn(slot: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, factors: int = FACTORS, lead: int = 0, epochs: tuple[int, int] = EPOCHS, seed: int = 7) -> Machine:
    """Weights and factors of the terms (numbers, per row) by Adam on the logistic loss; deterministic.

    The first `lead` terms are fitted alone, then all together: what those explain isn't put down to the many others.
    A step costs what its rows hold, however many terms there are: only the terms of its rows move.
    """
    y, n, m = np.asarray(labels, np.float32), len(rows), max(1, int(slot.max()) + 1)
    base = (y.sum() + 0.5) / (n + 1)
    heavy = min(HEAVIEST, max(1.0, (n - y.sum()) / max(1.0, y.sum())))
    rng = np.random.default_rng(seed)
    bias = np.full(1, np.log(base / (1 - base)), np.float32)
    p = np.concatenate([np.zeros((m, 1), np.float32), rng.normal(0, START, (m, factors)).astype(np.float32)], axis=1)  # weight, factors
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (bias, p)]
    decay = np.array([2e-5] + [2e-4] * factors, np.float32)
    step, batch = 0, max(1, min(256, ceil_div(n, 12)))

    def move(x, grad, m1, m2):
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.999 * m2 + 0.001 * grad * grad
        return x - RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + EPS), m1, m2

    alone = [r[r < lead] for r in rows]
    for use in [alone] * epochs[0] + [rows] * epochs[1]:
        order = rng.permutation(n)
        for a in range(0, n, batch):
            i = order[a : a + batch]
            some = [use[k] for k in i.tolist()]
            owner, term = np.repeat(np.arange(len(i)), [len(r) for r in some]), np.concatenate(some)
            by = np.argsort(term, kind="stable")
            term, owner = term[by], owner[by]
            start = np.flatnonzero(np.diff(term, prepend=-1))
            seen = term[start]
            q = p[seen]
            each = np.repeat(np.arange(len(seen)), np.diff(start, append=len(term)))
            s = np.stack([np.bincount(owner, c[each], len(i)) for c in q.T], axis=1)
            squares = np.bincount(owner, (q[:, 1:] ** 2).sum(axis=1)[each], len(i))
            z = bias[0] + s[:, 0] + 0.5 * ((s[:, 1:] ** 2).sum(axis=1) - squares)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) * np.where(y[i] > 0, heavy, 1) / len(i)
            step += 1
            bias, *moments[0] = move(bias, np.float32(g.sum()), *moments[0])
            if len(seen):
                s[:, 0] = 1
                grad = np.add.reduceat((g[:, None] * s).astype(np.float32)[owner], start, axis=0)
                grad[:, 1:] -= q[:, 1:] * grad[:, :1]
                p[seen], moments[1][0][seen], moments[1][1][seen] = move(q, grad + decay * q, moments[1][0][seen], moments[1][1][seen])
    return Machine(slot, float(bias[0]), p[:, 0].copy(), p[:, 1:].copy())


def _rows(batches):
    for b in pieces(batches, 1):
        bucket, owner, n = text_terms(b.column("text"))
        out = []
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(n + 1))
        for a, z in zip(cuts, cuts[1:]):
            out.append(np.unique(bucket[order[a:z]]).astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(out, pa.binary())], ["label", "terms"])


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_where=None) -> Machine:
    """Fits on labelled rows for which train_where (a condition on id_col) holds; an id labelled twice counts by its larger label."""
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null")
    if train_where is not None:
        chosen = chosen.where(train_where)
    chosen = chosen.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    some = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    some = some.join(F.broadcast(chosen), "id").groupBy("id").agg(F.first("label").alias("label"), F.min("text").alias("text"))
    rows = settle(some.select("label", "text").mapInArrow(_rows, "label int, terms binary"), "labelled")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n:
        return _none(FACTORS)
    counts = rows.mapInArrow(_counts, "bucket int, ones bigint, rows bigint").groupBy("bucket").agg(F.sum("ones").alias("ones"), F.sum("rows").alias("rows"))
    # One partition at a time comes to the driver: its memory follows the sample's terms, not their copies on the way.
    counts = counts.where(F.col("rows") >= LEAST_ROWS).coalesce(8).mapInArrow(_packed, "rows binary")
    counts = np.concatenate([np.zeros((0, 3), np.int64), *(np.frombuffer(bytes(r.rows), np.int64).reshape(-1, 3) for r in counts.toLocalIterator())])
    counts = counts[np.argsort(counts[:, 0])]
    slot, lead = _order(*counts.T, ones, n)
    packed = rows.mapInArrow(_chosen(docs.sparkSession.sparkContext.broadcast(slot)), "label int, terms binary")
    got = sorted((bytes(r.terms), r.label) for r in packed.coalesce(16).toLocalIterator())
    machine = learn(slot, [np.frombuffer(t, np.int32) for t, _ in got], np.array([y for _, y in got]), lead=lead)
    del got
    trim()
    return machine


def _counts(batches):
    ones, rows = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for b in batches:
        for y, t in zip(b.column("label").to_pylist(), b.column("terms").to_pylist()):
            t = np.frombuffer(t, np.int32)
            rows[t] += 1
            ones[t] += y
    at = np.flatnonzero(rows)
    for a in range(0, len(at), 50_000):
        i = at[a : a + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(ones[i]), pa.array(rows[i])], ["bucket", "ones", "rows"])


def _packed(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([np.stack([c.to_numpy().astype(np.int64) for c in b.columns], axis=1).tobytes()], pa.binary())], ["rows"])


def _chosen(slot):
    def run(batches):
        for b in batches:
            out = []
            for t in b.column("terms").to_pylist():
                s = slot.value[np.frombuffer(t, np.int32)]
                out.append(s[s >= 0].tobytes())
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(out, pa.binary())], ["label", "terms"])

    return run


def _score(machine):
    def run(batches):
        m = machine.value
        for b in pieces(batches, -1):
            s = m.scores(*text_terms(b.column(b.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*b.schema.names[:-1], "score", "predicted"])

    return run


def score(docs: DataFrame, machine: Machine, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (default: all of docs), then score (0 to 1) and predicted (1 from 0.5 on); no shuffle.

    Columns of docs called score or predicted are left out.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted", "__text")]
    src = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").cast("string").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # a few MB, whatever the corpus
    return src.mapInArrow(_score(shared), extend(src.drop("__text").schema, "score double, predicted int"))
