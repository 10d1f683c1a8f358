"""Exact top-k search by three-phase uniform thresholds.

A score is an inner product, the sum of partial scores over slices of the components. A slice of a block of candidates is a
node, a group of its own. First, every node gives each query its local score list, its k best partial scores; those entries
alone get full scores, whose k-th best is a safe cutoff. Second, the cutoff goes out: an entry that reaches it must have a
partial score of at least a slice's equal part of it in some slice, so nodes collect just those. Third, the partial scores
that collected entries lack are fetched from the other nodes and added, exactly; the best k are taken.

Vectors are compared as integers, floor(scale * x), kept in the least of 16, 32 and 64 bits that holds them. Null vectors and
those with null or non-finite components take no part, nor do rows without an id; vectors of another length than a query's
aren't its candidates. Ties go to the smaller id; a row's candidates are all rows with another id, and a query whose id is
repeated is answered for each of its rows. Sums that don't fit in 63 bits raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.llm.common import ceil_div, settle

SLICES = 2
QUERY_ROWS = 1024
CANDIDATE_ROWS = 8192
QUERY_BLOCKS = 4  # that come to a node at a time
PIECE = 1024
_NONE = np.iinfo(np.int64).min


def _valid(col: str):
    v = F.col(col)
    return F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


_PACKED = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("slice", pa.int32()), ("top", pa.int64()), ("ids", pa.binary()), ("bits", pa.int32()), ("vecs", pa.binary())])
_PACKED_DDL = "dim int, block bigint, slice int, top bigint, ids binary, bits int, vecs binary"


def _slices(dim: int):
    step = ceil_div(dim, SLICES)
    return [slice(s, min(dim, s + step)) for s in range(0, dim, step)]


def _pack(scale: int):
    """A block of vectors as one row a slice; top: the greatest component of the whole block."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        dim, block = t.column("dim")[0].as_py(), t.column("block")[0].as_py()
        v = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column("vec").chunks]).astype(np.float64)
        v = np.floor(v * scale)
        top = np.abs(v).max()
        if top >= 2.0**62:
            raise OverflowError("components too large")
        bits = 16 if top < 1 << 15 else 32 if top < 1 << 31 else 64
        v = v.reshape(-1, dim).astype(f"i{bits // 8}")
        ids = t.column("id").to_numpy().astype(np.int64).tobytes()
        return pa.Table.from_pylist([{"dim": dim, "block": block, "slice": k, "top": int(top), "ids": ids, "bits": bits, "vecs": np.ascontiguousarray(v[:, s]).tobytes()} for k, s in enumerate(_slices(dim))], _PACKED)

    return run


class _Node:
    """A slice of a block of candidates, and blocks of queries as they come."""

    def __init__(self, t: pa.Table):
        rows = t.select(["kind", "block", "qb", "dim", "slice", "top", "ids", "bits", "vecs"]).to_pylist()
        own = next(r for r in rows if r["kind"] == 0)
        self.dim, self.slice, self.block = own["dim"], own["slice"], own["block"]
        self.c, self.ids, self.top = self._vectors(own), np.frombuffer(own["ids"], np.int64), own["top"]
        self.queries = {r["qb"]: r for r in rows if r["kind"] == 1}

    @staticmethod
    def _vectors(r):
        return np.frombuffer(r["vecs"], f"i{r['bits'] // 8}").reshape(len(r["ids"]) // 8, -1)

    def both(self, qb):
        """(queries, candidates, query ids) in the narrowest type whose sums are exact."""
        r = self.queries[qb]
        top = r["top"] * self.top * self.dim
        if top >= 1 << 63:
            raise OverflowError("scores don't fit in a long")
        kind = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64
        return self._vectors(r).astype(kind), self.c.astype(kind), np.frombuffer(r["ids"], np.int64)


_ENTRIES = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("qb", pa.int64()), ("from", pa.int32()), ("slice", pa.int32()), ("q", pa.binary()), ("c", pa.binary()), ("partial", pa.binary())])
_ENTRIES_DDL = "dim int, block bigint, qb bigint, from int, slice int, q binary, c binary, partial binary"


def _narrow(partial) -> bytes:
    x = partial.astype(np.int64)
    return (x.astype(np.int32) if not len(x) or max(-int(x.min()), int(x.max())) < 1 << 31 else x).tobytes()


def _wide(partial: bytes, n: int) -> np.ndarray:
    return np.frombuffer(partial, np.int32 if len(partial) == 4 * n else np.int64).astype(np.int64)


def _entries(node: _Node, qb: int, i, j, partial):
    """Entries that a node gives: places of query and candidate in their blocks, and the partial score."""
    return {"dim": node.dim, "block": node.block, "qb": qb, "from": node.slice, "slice": node.slice, "q": i.astype(np.uint16).tobytes(), "c": j.astype(np.uint16).tobytes(), "partial": _narrow(partial)}


def _first(k: int):
    """The k best partial scores of each query in each node."""

    def run(t: pa.Table) -> pa.Table:
        node, out = _Node(t), []
        for qb in sorted(node.queries):
            q, c, qid = node.both(qb)
            best, place = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64)
            for a in range(0, len(c), PIECE):
                p = q @ c[a : a + PIECE].T
                ids = np.broadcast_to(np.arange(a, a + p.shape[1]), p.shape)
                own = qid[:, None] == node.ids[a : a + PIECE]
                if p.dtype == np.int64:
                    p[own] = _NONE
                else:
                    p[own] = -np.inf
                best, place = (np.concatenate(x, axis=1) for x in ((best.astype(p.dtype), p), (place, ids)))
                if best.shape[1] > k:
                    top = np.argpartition(best, best.shape[1] - k, axis=1)[:, -k:]
                    best, place = np.take_along_axis(best, top, axis=1), np.take_along_axis(place, top, axis=1)
            ok = best > (_NONE if best.dtype == np.int64 else -np.inf)
            i, j = np.nonzero(ok)
            out.append(_entries(node, qb, i, place[i, j], best[i, j]))
        return pa.Table.from_pylist(out, _ENTRIES)

    return run


def _collect(k: int):
    """Entries of at least a slice's equal part of the cutoff; queries of fewer than k entries so far collect all."""

    def run(t: pa.Table) -> pa.Table:
        node, out = _Node(t), []
        cutoffs = {r["qb"]: np.frombuffer(r["vecs"], np.int64) for r in t.select(["kind", "qb", "vecs"]).to_pylist() if r["kind"] == 2}
        for qb in sorted(node.queries):
            q, c, qid = node.both(qb)
            cutoff = cutoffs.get(qb, np.full(len(q), _NONE))
            parts = len(_slices(node.dim))
            part = -(-cutoff // parts)  # partial scores are whole numbers
            if q.dtype != np.int64:
                part = np.where(cutoff == _NONE, -np.inf, part).astype(np.float64)  # below 2^53, so exact
            rows, cols, got = [], [], []
            for a in range(0, len(c), PIECE):
                p = q @ c[a : a + PIECE].T
                i, j = np.nonzero((p >= part[:, None]) & (qid[:, None] != node.ids[a : a + PIECE]))
                rows.append(i)
                cols.append(j + a)
                got.append(p[i, j].astype(np.int64))
            out.append(_entries(node, qb, *map(np.concatenate, (rows, cols, got))))
        return pa.Table.from_pylist(out, _ENTRIES)

    return run


def _fetch(t: pa.Table) -> pa.Table:
    """The partial scores, in one node, of entries that other nodes gave."""
    node, out = _Node(t), []
    for r in t.select(["kind", "qb", "from", "q", "c"]).to_pylist():
        if r["kind"] == 2:
            q, c, _ = node.both(r["qb"])
            i, j = np.frombuffer(r["q"], np.uint16), np.frombuffer(r["c"], np.uint16)
            p = np.zeros(len(i), np.int64)
            for a in range(0, len(i), 100_000):
                p[a : a + 100_000] = (q[i[a : a + 100_000]].astype(np.float64 if q.dtype != np.int64 else np.int64) * c[j[a : a + 100_000]]).sum(axis=1).astype(np.int64)
            out.append({"dim": node.dim, "block": node.block, "qb": r["qb"], "from": r["from"], "slice": node.slice, "q": None, "c": None, "partial": _narrow(p)})
    return pa.Table.from_pylist(out, _ENTRIES)


_FULL = pa.schema([("dim", pa.int32()), ("qb", pa.int64()), ("place", pa.int64()), ("c_block", pa.int64()), ("c_place", pa.int64()), ("score", pa.int64())])
_FULL_DDL = "dim int, qb bigint, place bigint, c_block bigint, c_place bigint, score bigint"


def _resolve(k: int):
    """Full scores of the entries of a block of queries and one of candidates, each pair once; the best k of each query."""

    def run(t: pa.Table) -> pa.Table:
        given: dict[int, list] = {}
        for r in t.to_pylist():
            given.setdefault(r["from"], []).append(r)
        pairs, scores = [], []
        for rows in given.values():
            first = next(r for r in rows if r["q"] is not None)
            pairs.append(np.frombuffer(first["q"], np.uint16).astype(np.int64) << 16 | np.frombuffer(first["c"], np.uint16))
            scores.append(sum(_wide(r["partial"], len(pairs[-1])) for r in rows))
        pair, first = np.unique(np.concatenate(pairs), return_index=True)
        score = np.concatenate(scores)[first]
        q, c = pair >> 16, pair & 65535
        order = np.lexsort((c, -score, q))  # places follow ids
        q, c, score = q[order], c[order], score[order]
        top = np.arange(len(q)) - np.searchsorted(q, q) < k
        n = int(top.sum())
        return pa.Table.from_arrays([pa.array(np.full(n, t.column("dim")[0].as_py(), np.int32)), pa.array(np.full(n, t.column("qb")[0].as_py(), np.int64)), pa.array(q[top]), pa.array(np.full(n, t.column("block")[0].as_py(), np.int64)), pa.array(c[top]), pa.array(score[top])], schema=_FULL)

    return run


def _thresholds(k: int):
    """The k-th best full score of each query of a block, or none."""
    schema = pa.schema([("dim", pa.int32()), ("qb", pa.int64()), ("vecs", pa.binary())])

    def run(t: pa.Table) -> pa.Table:
        q, s = t.column("place").to_numpy(), t.column("score").to_numpy()
        n = t.column("rows")[0].as_py()
        out = np.full(n, _NONE)
        order = np.lexsort((-s, q))
        q, s = q[order], s[order]
        at = np.searchsorted(q, np.arange(n)) + k - 1
        ok = at < np.searchsorted(q, np.arange(n), "right")
        out[ok] = s[at[ok]]
        return pa.Table.from_pylist([{"dim": t.column("dim")[0].as_py(), "qb": t.column("qb")[0].as_py(), "vecs": out.tobytes()}], schema)

    return run


def _places(block: str, place: str, name: str):
    """The ids of packed blocks, with their places."""

    def run(batches):
        for b in batches:
            for dim, number, ids in zip(*(b.column(b.schema.get_field_index(x)).to_pylist() for x in ("dim", "block", "ids"))):
                ids = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), dim, np.int32)), pa.array(np.full(len(ids), number)), pa.array(np.arange(len(ids))), pa.array(ids)], ["dim", block, place, name])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", counts: dict | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest scores of each row of queries among the rows of vectors.

    counts, if given, learns how many pairs there are and how many of them got a full score.
    """

    def clean(df):
        df = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
        return df.where(_valid("vec")).withColumn("dim", F.size("vec"))

    def blocks(df, rows):
        # A part of a hash is cut into blocks, so that none holds more than `rows`.
        counted = df.groupBy("dim").agg(F.count("*").alias("rows")).withColumn("parts", F.ceil(F.col("rows") / (rows // 2)))
        coarse = df.join(counted.select("dim", "parts"), "dim").withColumn("part", F.pmod(F.xxhash64("id", "vec"), F.col("parts")))
        place = F.row_number().over(Window.partitionBy("dim", "part").orderBy("id"))
        keyed = coarse.withColumn("piece", F.floor((place - 1) / rows)).withColumn("block", F.col("piece") * F.col("parts") + F.col("part"))
        return settle(keyed.select("dim", "block", "id", "vec").groupBy("dim", "block").applyInArrow(_pack(scale), _PACKED_DDL), "blocks")

    q, c = blocks(clean(queries), QUERY_ROWS), blocks(clean(vectors), CANDIDATE_ROWS)
    numbers = c.where("slice = 0").select("dim", "block")
    # Each block of candidates meets each block of queries: the queries are a stated part of all rows. They travel, some
    # blocks of them at a time, to the candidates.
    sent = q.withColumnRenamed("block", "qb").join(numbers, "dim").withColumn("lot", F.expr(f"qb div {QUERY_BLOCKS}"))
    lots = q.where("slice = 0").select("dim", F.expr(f"block div {QUERY_BLOCKS}").alias("lot")).distinct()
    nodes = c.join(lots, "dim").withColumns({"kind": F.lit(0), "qb": F.lit(None).cast("bigint")}).unionByName(sent.withColumn("kind", F.lit(1)))

    def run(more: DataFrame | None, f, name: str) -> DataFrame:
        """f over every node with its queries, and what else is meant for it."""
        rows = nodes if more is None else nodes.unionByName(more.withColumns({"kind": F.lit(2), "lot": F.expr(f"qb div {QUERY_BLOCKS}")}), allowMissingColumns=True)
        return settle(rows.groupBy("dim", "slice", "block", "lot").applyInArrow(f, _ENTRIES_DDL), name)

    def full(entries: DataFrame, name: str) -> DataFrame:
        every = c.select("dim", "block", F.col("slice").alias("to"))
        asked = entries.join(every, ["dim", "block"]).where("to <> slice").withColumn("slice", F.col("to")).drop("to", "partial")
        return settle(entries.unionByName(run(asked, _fetch, "partials")).groupBy("dim", "block", "qb").applyInArrow(_resolve(k), _FULL_DDL), name)

    lists = run(None, _first(k), "lists")
    sizes = q.where("slice = 0").select("dim", F.col("block").alias("qb"), (F.length("ids") / 8).cast("bigint").alias("rows"))
    cutoffs = settle(full(lists, "first").join(sizes, ["dim", "qb"]).groupBy("dim", "qb").applyInArrow(_thresholds(k), "dim int, qb bigint, vecs binary"), "cutoffs")
    collected = run(cutoffs.join(c.select("dim", "slice", "block"), "dim"), _collect(k), "collected")
    scored = full(collected, "scored")
    if counts is not None:
        size = lambda e: e.agg(F.sum(F.length("q") / 2)).first()[0] or 0
        rows = lambda b: b.where("slice = 0").groupBy("dim").agg(F.sum(F.length("ids") / 8).alias("n"))
        counts["pairs"] = int(rows(q).join(rows(c).withColumnRenamed("n", "m"), "dim").agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0)
        counts["full"] = int(size(lists) + size(collected))
    found = scored.join(c.where("slice = 0").mapInArrow(_places("c_block", "c_place", "vec_id"), "dim int, c_block bigint, c_place bigint, vec_id bigint"), ["dim", "c_block", "c_place"])
    best = Window.partitionBy("dim", "qb", "place").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = q.where("slice = 0").mapInArrow(_places("qb", "place", "query_id"), "dim int, qb bigint, place bigint, query_id bigint")
    return ranked.join(names, ["dim", "qb", "place"]).select("query_id", "rank", "vec_id", "score")
