"""Near-duplicate vectors by a forest of random-projection trees.

Each tree splits the vectors of a label again and again by random hyperplanes near the middle of what it holds; what lies
within a margin of a hyperplane goes to both sides. Vectors are compared in the leaves that they share, by their cosine in
double precision, so no pair below the threshold is linked; links are united to components. The splits are placed on a
bounded sample (`fit_rows`, a documented parameter), every row is routed; below the last split that the sample supports,
hyperplanes go through the sample's mean there, so that leaves don't grow with the table. A leaf of more than `BLOCK`
vectors is split into blocks, and each pair of blocks is compared by itself, so none is left out.

Equal vectors of a label are one class with a multiplicity. A pair counts in the least leaf that both share. Only ids of
classes are routed; vectors, as wide as the table has them, follow once a leaf. A pair just above the threshold is missed
where no tree puts it in one leaf: under one in a hundred at 8 million vectors of 64 components (simulated).

Null vectors, zero ones, those with null or non-finite components and those without a label link with nothing; vectors of
different length aren't compared. Rows with a null id take part like others; their component_id is null, and kept false,
where no other id is reachable, and a component is kept by its rows of the least id. Repeated rows have a row each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import settle
from inkwell.llm.components import connected_components

TREES = 4
LEAF = 256
SPILL = 0.35
BLOCK = 1024
FIT_ROWS = 20_000
FIT_BYTES = 32 << 20  # of vectors that the driver takes
_LEAST_SAMPLE = 16


def _normal(tree: int, node: int, dim: int) -> np.ndarray:
    w = np.random.default_rng([11, tree, node & 0xFFFFFFFF, node >> 32, dim]).normal(size=dim)
    return w / np.linalg.norm(w)


class Forest:
    """cuts[label, dim, tree, node]: where a fitted node splits; ends[...]: (mean, further levels) of the leaves of the fit."""

    def __init__(self, trees: int, threshold: float):
        self.trees, self.delta = trees, np.sqrt(max(0.0, 2 - 2 * threshold))
        self.cuts, self.ends = {}, {}

    def fit(self, label: int, unit: np.ndarray, rows_each: float):
        dim = unit.shape[1]
        for tree in range(self.trees):
            todo = [(1, np.arange(len(unit)))]
            while todo:
                node, i = todo.pop()
                held = len(i) * rows_each
                if held <= LEAF or len(i) < _LEAST_SAMPLE or node >= 1 << 30:
                    more = max(0, int(np.ceil(np.log2(max(1.0, held / LEAF)))))
                    self.ends[label, dim, tree, node] = (unit[i].mean(axis=0), min(more, 30)) if more else (None, 0)
                    continue
                p = unit[i] @ _normal(tree, node, dim)
                t = float(np.median(p))
                self.cuts[label, dim, tree, node] = t
                todo += [(2 * node, i[p <= t]), (2 * node + 1, i[p > t])]

    def leaves(self, label: int, unit: np.ndarray):
        """(row, tree, node) of each leaf that each vector falls in."""
        dim = unit.shape[1]
        margin = SPILL * self.delta / np.sqrt(dim)
        out = []
        for tree in range(self.trees):
            todo = [(1, np.arange(len(unit)), None, None)]
            while todo:
                node, i, mean, more = todo.pop()
                if not len(i):
                    continue
                t = None
                if more is None:
                    t = self.cuts.get((label, dim, tree, node))
                    if t is None:
                        mean, more = self.ends.get((label, dim, tree, node), (None, 0))
                if t is None and more:
                    t, more = float(mean @ _normal(tree, node, dim)), more - 1
                if t is None:
                    out.append((i, np.full(len(i), tree), np.full(len(i), node)))
                    continue
                p = unit[i] @ _normal(tree, node, dim)
                todo += [(2 * node, i[p <= t + margin], mean, more), (2 * node + 1, i[p > t - margin], mean, more)]
        return (np.concatenate(x) for x in zip(*out))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _members(batches):
    """A digest of the vector with its label, and its bytes, for rows that may link."""
    for b in batches:
        col, label = b.column("vec"), b.column("label").to_pylist()
        at, values = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False) + 0.0  # nulls become NaN, -0 becomes 0
        bad, some = (np.concatenate([[0], np.cumsum(x)]) for x in (~np.isfinite(values), values != 0))
        ok = col.is_valid().to_numpy(zero_copy_only=False) & (np.diff(at) > 0) & (bad[at[1:]] == bad[at[:-1]]) & (some[at[1:]] > some[at[:-1]])
        raw = [values[x:z].tobytes() if good and lb is not None else None for good, lb, x, z in zip(ok.tolist(), label, at[:-1].tolist(), at[1:].tolist())]
        dig = [None if x is None else hashlib.blake2b(x, digest_size=16, key=str(lb).encode()).digest() for x, lb in zip(raw, label)]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(dig, pa.binary()), pa.array(raw, pa.binary())], ["id", "label", "dig", "raw"])


def _route(forest, kind: str):
    names = ["leaf", "rep", "leaves"]

    def run(batches):
        f, width = forest.value, np.dtype(kind).itemsize
        for b in batches:
            label, raw = np.array(b.column("label").to_pylist(), np.int64), b.column("raw").to_pylist()
            size = np.array([len(x) // width for x in raw], np.int64)
            for lb, dim in sorted(set(zip(label.tolist(), size.tolist()))):
                at = np.flatnonzero((label == lb) & (size == dim))
                unit = _unit(np.frombuffer(b"".join(raw[i] for i in at), kind).reshape(-1, dim).astype(np.float64))
                row, tree, node = f.leaves(lb, unit)
                key = _keys(lb, dim, tree, node)
                order = np.lexsort((key, row))
                row, key = row[order], key[order]
                cuts = np.searchsorted(row, np.arange(len(at) + 1))
                lists = [key[a:z].tobytes() for a, z in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column("rep").take(pa.array(at[row])), pa.array([lists[r] for r in row.tolist()], pa.binary())], names)

    return run


def _keys(label, dim, tree, node):
    both = np.stack([tree, node], axis=1)
    distinct, which = np.unique(both, axis=0, return_inverse=True)
    key = [int.from_bytes(hashlib.blake2b(f"{label}:{dim}:{t}:{n}".encode(), digest_size=8).digest(), "little", signed=True) for t, n in distinct.tolist()]
    return np.array(key, np.int64)[which.ravel()]


def link_group(leaf, rep, mult, label, side, raw, leaves, cross, threshold, kind="f8"):
    """Links of one leaf, or of two blocks of it, that no lesser leaf has: (added links per row, forest edges)."""
    m = len(rep)
    size = np.array([len(x) for x in raw])
    same = (label[:, None] == label) & (size[:, None] == size)
    width = np.dtype(kind).itemsize
    v = np.zeros((m, int(size.max()) // width))
    for i, x in enumerate(raw):
        v[i, : len(x) // width] = np.frombuffer(x, kind)
    v /= np.abs(v).max(axis=1, keepdims=True)
    norm = np.sqrt((v * v).sum(axis=1))
    ok = (v @ v.T) / (norm[:, None] * norm) >= threshold
    ok &= same & (np.arange(m)[:, None] < np.arange(m))
    if cross:
        ok &= side[:, None] != side
    i, j = np.nonzero(ok)
    lists = [np.frombuffer(x, np.int64) for x in leaves]
    lists = [x[x < leaf] for x in lists]  # a pair with one of these in common counts there
    width = max(map(len, lists), default=0)
    if width and len(i):
        a = np.full((m, width), np.iinfo(np.int64).max)
        for r, x in enumerate(lists):
            a[r, : len(x)] = x
        b = np.where(a == np.iinfo(np.int64).max, np.iinfo(np.int64).max - 1, a)
        keep = np.ones(len(i), bool)
        for s in range(0, len(i), 100_000):
            x, y = a[i[s : s + 100_000]], b[j[s : s + 100_000]]
            keep[s : s + 100_000] = ~(x[:, :, None] == y[:, None, :]).any(axis=(1, 2))
        i, j = i[keep], j[keep]
    added = np.zeros(m, np.int64)
    np.add.at(added, i, mult[j])
    np.add.at(added, j, mult[i])
    root, edges = list(range(m)), []

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(i.tolist(), j.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[q] = p
            edges.append((int(rep[x]), int(rep[y])))
    return added, edges


_FOUND = pa.schema([("rep", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])


def _compare(threshold: float, kind: str):
    def run(t: pa.Table) -> pa.Table:
        get = lambda k: np.array(t.column(k).to_pylist(), np.int64)
        rep = get("rep")
        if len(rep) < 2:
            return _FOUND.empty_table()
        added, edges = link_group(t.column("leaf")[0].as_py(), rep, get("mult"), get("label"), get("side"), t.column("raw").to_pylist(), t.column("leaves").to_pylist(), t.column("lo")[0].as_py() != t.column("hi")[0].as_py(), threshold, kind)
        at = np.flatnonzero(added)
        return pa.Table.from_arrays([pa.array([*rep[at].tolist(), *(e[0] for e in edges)], pa.int64()), pa.array([*[None] * len(at), *(e[1] for e in edges)], pa.int64()), pa.array([*added[at].tolist(), *[0] * len(edges)], pa.int64())], schema=_FOUND)

    return run


def embedding_dedup(vectors: DataFrame, threshold: float = 0.98, trees: int = TREES, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: id_col, n_links, component_id, kept.

    fit_rows and fit_bytes bound the sample on which the splits are placed.
    """
    spark = vectors.sparkSession
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    kind = "f4" if single else "f8"
    src = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("bigint").alias("label"), F.col(f"`{vec_col}`").cast("array<float>" if single else "array<double>").alias("vec"))
    members = settle(src.mapInArrow(_members, "id bigint, label bigint, dig binary, raw binary"), "vectors")
    key = F.expr("cast(conv(hex(substr(dig, 1, 8)), 16, -10) as bigint)")
    classes = settle(members.where("dig is not null").groupBy("dig").agg(F.min("id").alias("least"), F.count("*").alias("mult"), F.first("label").alias("label"), F.first("raw").alias("raw")).withColumn("rep", key), "classes")
    total, widest = classes.agg(F.count("*"), F.max(F.length("raw"))).first()
    sample = classes.orderBy(F.xxhash64("dig"), "dig").select("label", "raw").limit(max(_LEAST_SAMPLE, min(fit_rows, fit_bytes // (widest or 1)))).collect()
    forest = Forest(trees, threshold)
    groups: dict[tuple[int, int], list[bytes]] = {}
    for r in sample:
        groups.setdefault((r.label, len(r.raw) // np.dtype(kind).itemsize), []).append(bytes(r.raw))
    for (label, dim), raws in groups.items():
        forest.fit(label, _unit(np.stack([np.frombuffer(x, kind).astype(np.float64) for x in raws])), total / max(1, len(sample)))
    shared = spark.sparkContext.broadcast(forest)  # bounded by the sample
    routed = settle(classes.select("label", "rep", "raw").mapInArrow(_route(shared, kind), "leaf bigint, rep bigint, leaves binary"), "routed")
    blocks = routed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.count("*").alias("held")).where("held > 1").drop("held")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    split = routed.join(blocks, "leaf").withColumn("own", own).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    split = split.select("leaf", F.least("own", "j").alias("lo"), F.greatest("own", "j").alias("hi"), (F.col("own") > F.col("j")).cast("int").alias("side"), "rep", "leaves")
    split = split.join(classes.select("rep", "label", "mult", "raw"), "rep").select("leaf", "lo", "hi", "side", "label", "rep", "mult", "raw", "leaves")
    found = settle(split.groupBy("leaf", "lo", "hi").applyInArrow(_compare(threshold, kind), "rep bigint, other bigint, links bigint"), "links")
    links = found.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("other is not null"), "rep", "other")
    of_class = classes.select("dig", "rep", "least", "mult").join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("dig", "least", F.coalesce("component", "rep").alias("component"), (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    of_class = of_class.join(of_class.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("dig", "n_links", "component_id")
    full = members.where("dig is not null").select("id", "dig").join(of_class, "dig").select("id", "n_links", "component_id")
    bare = members.where("dig is null").select("id", F.lit(0).alias("n_links"), F.col("id").alias("component_id"))  # they'd all meet in one task
    out = full.unionByName(bare).select(F.col("id").alias(id_col), F.col("n_links").cast("bigint").alias("n_links"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
