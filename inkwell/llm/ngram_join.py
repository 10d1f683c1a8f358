"""N-gram Jaccard join by prefix trees: every pair of texts whose n-gram sets overlap enough, exactly.

Sets are ordered globally, rarest n-gram first. Two linked sets share an n-gram within their leading prefixes, so each
set is posted under its prefix n-grams, without those that no other set has. A posting holds the few n-grams before it:
two sets that share one of these have met already, so a set goes in full only to the groups where it meets some other for
the first time; before that, groups compare the n-grams that come first and bitmaps that may rule a link out. There the sets form a trie; one walk per set shares the partial overlaps of common beginnings and leaves a
subtree as soon as the lengths that remain can't give the overlap. A pair counts where its first common n-gram is the
group's, hence once. Groups give counts and a spanning forest, never their pairs. An n-gram of many sets is
split into blocks, and each pair of blocks is a group of its own.

Equal sets are one class with a multiplicity. Texts without words have an empty set and link with nothing; null is an
empty text; ties of rarity go by hash. N-grams are compared by 64 bits made of digests of their words.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import _LOWER, ceil_div, mix, pieces, settle, trim, utf8, word_digests
from inkwell.llm.components import connected_components

HOME_GRAMS = 650_000
BLOCK = 2048
BEFORE = 3
BAND = 64
HASH_BITS = 64
_A, _B, _C = (np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int):
    """(set of each text as sorted distinct hashes, all in one array; n+1 offsets)."""
    words, owner = word_digests(data, offsets)
    count = len(offsets) - 1
    n_words = np.bincount(owner, minlength=count) if len(owner) else np.zeros(count, np.int64)
    ends = np.cumsum(n_words)
    size = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    out_ends = np.cumsum(size)
    h = words * _A
    for k in range(1, width):
        shifted = np.zeros_like(words)
        shifted[:-k or None] = words[k:]
        h[: len(words) - k] = mix(h[: len(words) - k]) + shifted[: len(words) - k] * _B
    keep = np.zeros(len(words), bool)
    full = n_words >= width
    starts = ends - n_words
    place = np.arange(len(words)) - np.repeat(starts, n_words)
    keep = place < np.repeat(np.where(full, size, 0), n_words)
    value = np.zeros(int(out_ends[-1]) if count else 0, np.uint64)
    out_starts = out_ends - size
    whole = np.repeat(full, size)
    value[whole] = mix(h[keep])
    for i in np.flatnonzero(~full & (n_words > 0)):
        x = np.full(1, n_words[i], np.uint64)
        for k in range(starts[i], ends[i]):
            x = mix(x * _C + words[k : k + 1])
        value[out_starts[i]] = x[0]
    value[value == 0] = 1  # 0 stands for none
    for a, b in zip(out_starts.tolist(), out_ends.tolist()):
        value[a:b].sort()
    doc = np.repeat(np.arange(count), size)
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    bounds = np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=count))]) if count else np.zeros(1, np.int64)
    return value[new], bounds.astype(np.int64)


def _bytes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def _values(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _digests(values: np.ndarray, bounds: np.ndarray):
    raw = _bytes(values)
    return [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _members(width: int):
    def run(batches):
        for b in pieces(batches, 1):
            values, bounds = shingle_sets(*utf8(b.column(1)), width)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(bounds)), pa.array(_digests(values, bounds), pa.binary())], ["id", "n", "dig"])

    return run


def _sets(width: int, homes: int):
    """Each text in lower case and compressed, which takes less than half of what its set would; homes build the set again."""

    def run(batches):
        seen, codec = set(), pa.Codec("zstd")
        for b in pieces(batches, 0):
            data, offsets = utf8(b.column(0))
            values, bounds = shingle_sets(data, offsets, width)
            low, cuts, out = _LOWER[data].tobytes(), offsets.tolist(), []
            for i, (d, a, z) in enumerate(zip(_digests(values, bounds), bounds[:-1].tolist(), bounds[1:].tolist())):
                if z > a and d not in seen:
                    if len(seen) < 1_000_000:  # only saves work; copies are dropped again at home
                        seen.add(d)
                    text = low[cuts[i] : cuts[i + 1]]
                    out.append((int.from_bytes(d[:4], "little") % homes, d, len(text), codec.compress(text, asbytes=True)))
            if out:
                h, d, n, s = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int32()), pa.array(d, pa.binary()), pa.array(n, pa.int64()), pa.array(s, pa.binary())], ["home", "dig", "size", "text"])

    return run


class _Home:
    """The distinct sets of one home, in the order of their digests."""

    def __init__(self, t: pa.Table, width: int):
        digs, sizes, texts = (t.column(c).to_pylist() for c in ("dig", "size", "text"))
        first = {}
        for i, d in enumerate(digs):
            first.setdefault(d, i)
        self.digs, codec = sorted(first), pa.Codec("zstd")
        rows = [first[d] for d in self.digs]
        values, counts, some, held = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], 0
        for k, i in enumerate(rows):  # about a MB of text at a time, for what sets take on their way
            some.append(codec.decompress(texts[i], sizes[i], asbytes=True))
            held += sizes[i]
            if held > 1 << 20 or k == len(rows) - 1:
                v, b = shingle_sets(np.frombuffer(b"".join(some), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in some])]).astype(np.int64), width)
                values.append(v)
                counts.append(np.diff(b))
                some, held = [], 0
        self.values = np.concatenate(values)
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)
        self.n = np.diff(bounds)
        self.ends = bounds[1:]
        del values, texts
        trim()

    def cells(self, bits: int):
        """Sorted distinct cells (leading bits) of all n-grams, and in how many sets' n-grams each occurs."""
        c = np.sort(self.values >> np.uint64(HASH_BITS - bits))
        new = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        return c[new], np.diff(np.append(new, len(c)))


def _request(bits: int, parts: int, width: int):
    schema = pa.schema([("part", pa.int32()), ("home", pa.int32()), ("payload", pa.binary())])

    def run(t: pa.Table) -> pa.Table:
        home = t.column("home")[0].as_py()
        cells, counts = _Home(t, width).cells(bits)
        edges = _part_edges(cells, bits, parts)
        rows = []
        for p in range(parts):
            a, b = edges[p], edges[p + 1]
            if b > a:
                rows.append((p, home, _pack_cells(cells[a:b], counts[a:b])))
        return pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)

    return run


def _part_edges(cells: np.ndarray, bits: int, parts: int) -> np.ndarray:
    limits = [ceil_div(p << bits, parts) for p in range(1, parts)]
    return np.concatenate([[0], np.searchsorted(cells, np.array(limits, np.uint64), "left"), [len(cells)]]).astype(np.int64)


def _pack_cells(cells: np.ndarray, counts: np.ndarray) -> bytes:
    """Cells by differences, then counts in a byte each; those that need more follow in full."""
    delta = cells.copy()
    delta[1:] -= cells[:-1]
    planes = np.ascontiguousarray(delta.view(np.uint8).reshape(-1, 8).T)
    top = max([1, *(k + 1 for k in range(8) if planes[k, 1:].any())])
    large = counts[counts >= 255].astype(np.int64)
    return b"".join([np.int64(len(large)).tobytes(), large.tobytes(), bytes([top]), cells[:1].tobytes(), planes[:top, 1:].tobytes(), np.minimum(counts, 255).astype(np.uint8).tobytes()])


def _unpack_cells(blob: bytes):
    many = int(np.frombuffer(blob, np.int64, 1)[0])
    large, blob = np.frombuffer(blob, np.int64, many, 8), blob[8 + 8 * many :]
    top = blob[0]
    n = (len(blob) - 9 + top) // (top + 1)
    delta = np.zeros((8, n), np.uint8)
    delta[:top, 1:] = np.frombuffer(blob, np.uint8, top * (n - 1), 9).reshape(top, n - 1)
    d = np.ascontiguousarray(delta.T).view(np.uint64).ravel()
    d[0] = np.frombuffer(blob[1:9], np.uint64)[0]
    counts = np.frombuffer(blob, np.uint8, n, 9 + top * (n - 1)).astype(np.int64)
    counts[counts == 255] = large
    return np.cumsum(d, dtype=np.uint64), counts


def _code(df: np.ndarray) -> np.ndarray:
    """A document frequency in one byte, exact below 128, then by quarter octaves; order is kept."""
    big = 128 + np.floor(4 * np.log2(np.maximum(df, 128) / 128))
    return np.where(df < 128, df, np.minimum(big, 255)).astype(np.uint8)


def _upper(code: np.ndarray) -> np.ndarray:
    c = code.astype(np.float64)
    return np.where(c < 128, c, np.ceil(128 * 2 ** ((c - 127) / 4))).astype(np.int64)


_ANSWER = pa.schema([("home", pa.int32()), ("kind", pa.int32()), ("part", pa.int32()), ("payload", pa.binary()), ("dig", pa.binary()), ("rep", pa.int64()), ("mult", pa.int64())])


def _answer(t: pa.Table) -> pa.Table:
    part, homes = t.column("part")[0].as_py(), t.column("home").to_pylist()
    parts = [_unpack_cells(x) for x in t.column("payload").to_pylist()]
    cells = np.concatenate([c for c, _ in parts])
    order = np.argsort(cells, kind="stable")
    ordered = cells[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    group = np.cumsum(new) - 1
    total = np.bincount(group, weights=np.concatenate([k for _, k in parts])[order])
    code = np.empty(len(cells), np.uint8)
    code[order] = _code(total)[group]
    at, rows = 0, []
    for h, (c, _) in zip(homes, parts):
        rows.append({"home": h, "kind": 0, "part": part, "payload": zlib.compress(code[at : at + len(c)].tobytes(), 1)})
        at += len(c)
    return pa.Table.from_pylist(rows, _ANSWER)


def _codes(home: _Home, z: pa.Table, bits: int, picked: np.ndarray) -> np.ndarray:
    """The rarity code of each picked n-gram of a home."""
    own = z.filter(pa.compute.equal(z.column("kind"), 0)).sort_by("part")
    codes = np.frombuffer(b"".join(map(zlib.decompress, own.column("payload").to_pylist())), np.uint8)
    cells, _ = home.cells(bits)
    return codes[np.searchsorted(cells, picked >> np.uint64(HASH_BITS - bits))]


def _classes(home: _Home, z: pa.Table):
    own = z.filter(pa.compute.equal(z.column("kind"), 1))
    by = dict(zip(own.column("dig").to_pylist(), zip(own.column("rep").to_pylist(), own.column("mult").to_pylist())))
    got = np.array([by[d] for d in home.digs], np.int64).reshape(-1, 2)
    return got[:, 0], got[:, 1]


def _prefix(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (n * percent + 99) // 100 + 1


def _ordered(home: _Home, codes: np.ndarray, docs: np.ndarray):
    """For the given sets: n-grams that others have too, rarest first, with code and place; and each set's start."""
    sizes = home.n[docs]
    at = np.repeat(home.ends[docs] - sizes - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    who = np.repeat(np.arange(len(docs)), sizes)
    value, code = home.values[at], codes[at]
    alone = code == 1
    singles = np.bincount(who[alone], minlength=len(docs))
    value, code, who = value[~alone], code[~alone], who[~alone]
    order = np.lexsort((value, code, who))
    value, code, who = value[order], code[order], who[order]
    count = np.bincount(who, minlength=len(docs))
    start = np.cumsum(count) - count
    return value, code, who, count, start, singles


#: Fields and the bytes of each that travel.
_POSTING = [("token", np.uint64, 8), ("idx", np.uint32, 4), ("n", np.uint32, 4), ("pos", np.uint32, 4), ("lo", np.uint32, 4), ("hi", np.uint32, 4), ("side", np.uint8, 1), *((f"before{k}", np.uint64, 8) for k in range(BEFORE))]


def _planes(f: dict, layout) -> bytes:
    """Columns byte plane by byte plane, so that leading zeros compress away; idx, ascending, by differences."""
    out = []
    for k, kind, used in layout:
        x = np.ascontiguousarray(f[k].astype(kind))
        if k == "idx":
            x = np.diff(x, prepend=x.dtype.type(0))
        out.append(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1)[:, :used].T).tobytes())
    return b"".join(out)


def _post(bits: int, parts: int, percent: int, width: int):
    schema = pa.schema([("bucket", pa.int32()), ("home", pa.int32()), ("payload", pa.binary())])

    def run(x: pa.Table, z: pa.Table) -> pa.Table:
        if not x.num_rows:
            return schema.empty_table()
        h = _Home(x, width)
        codes = _codes(h, z, bits, h.values)
        lonely = np.add.reduceat((codes == 1).astype(np.int64), h.ends - h.n)
        docs = np.flatnonzero(lonely < _prefix(h.n, percent))
        if not len(docs):
            return schema.empty_table()
        value, code, who, count, start, singles = _ordered(h, codes, docs)
        place = np.arange(len(value)) - start[who]
        pos = place + singles[who]
        keep = np.flatnonzero(pos < _prefix(h.n[docs], percent)[who])
        before = np.zeros((len(keep), BEFORE), np.uint64)
        for k in range(BEFORE):
            ok = place[keep] > k
            before[ok, k] = value[keep[ok] - k - 1]
        f = {"token": value[keep], "idx": docs[who[keep]].astype(np.uint32), "n": h.n[docs][who[keep]].astype(np.uint32), "pos": pos[keep].astype(np.uint32)}
        blocks = -(-_upper(code[keep]) // BLOCK)
        own = np.array([int.from_bytes(h.digs[d][8:], "little") & 0x7FFFFFFFFFFFFFFF for d in docs], np.int64)[who[keep]] % blocks
        times = blocks  # block pairs that the posting takes part in
        rep = np.repeat(np.arange(len(keep)), times)
        other = np.arange(len(rep)) - np.repeat(np.cumsum(times) - times, times)
        mine = own[rep]
        lo, hi = np.minimum(mine, other).astype(np.uint32), np.maximum(mine, other).astype(np.uint32)
        side = (mine > other).astype(np.uint8)
        f = {k: v[rep] for k, v in f.items()} | {"lo": lo, "hi": hi, "side": side}
        f |= {f"before{k}": before[rep, k] for k in range(BEFORE)}
        bucket = (mix(f["token"] + lo.astype(np.uint64) * _A + hi.astype(np.uint64) * _B) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(parts + 1))
        home, rows = x.column("home")[0].as_py(), []
        for p in np.flatnonzero(np.diff(edges)):
            i = order[edges[p] : edges[p + 1]]
            rows.append({"bucket": int(p), "home": home, "payload": _planes({k: v[i] for k, v in f.items()}, _POSTING)})
        return pa.Table.from_pylist(rows, schema)

    return run


def _fields(blobs: list[bytes], layout):
    width = sum(used for _, _, used in layout)
    out = {k: [] for k, _, _ in layout} | {"row": []}
    for r, blob in enumerate(blobs):
        n, at = len(blob) // width, 0
        for k, kind, used in layout:
            x = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
            x[:, :used] = np.frombuffer(blob, np.uint8, n * used, at).reshape(used, n).T
            x = x.view(kind).ravel()
            out[k].append(np.cumsum(x, dtype=kind) if k == "idx" else x)
            at += n * used
        out["row"].append(np.full(n, r, np.int64))
    return {k: np.concatenate(v) for k, v in out.items()}


def _live_rows(n, pos, before, side, cross, percent):
    """For groups of one size (groups x members): which members meet some other here, perhaps for the first time."""
    g, m = n.shape
    live = np.zeros((g, m), bool)
    step = max(1, 1_000_000 // max(1, g * m))
    for a in range(0, m, step):
        z = min(m, a + step)
        nx, ny = n[:, a:z, None], n[:, None, :]
        need = (percent * (nx + ny) + 99 + percent) // (100 + percent)
        ok = np.minimum(nx - pos[:, a:z, None], ny - pos[:, None, :]) >= need
        ok &= (side[:, a:z, None] != side[:, None, :]) | ~cross[:, None, None]
        ok[:, np.arange(z - a), np.arange(a, z)] = False
        if ok.any():
            for k in range(BEFORE):
                left = before[:, a:z, None, k]
                for j in range(BEFORE):
                    ok &= (left != before[:, None, :, j]) | (left == 0)
            live[:, a:z] = ok.any(axis=2)
    return live


_LIVE = [("idx", np.uint32, 4), ("token", np.uint64, 8), ("lo", np.uint32, 4), ("hi", np.uint32, 4), ("side", np.uint8, 1)]


def _live(percent: int):
    def run(t: pa.Table) -> pa.Table:
        homes = np.array(t.column("home").to_pylist(), np.int64)
        f = _fields(t.column("payload").to_pylist(), _POSTING)
        before = np.stack([f[f"before{k}"] for k in range(BEFORE)], axis=1)
        order = np.lexsort((f["hi"], f["lo"], f["token"]))
        tok, lo, hi = f["token"][order], f["lo"][order], f["hi"][order]
        new = np.flatnonzero(np.concatenate([[True], (tok[1:] != tok[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
        sizes = np.diff(np.append(new, len(order)))
        picked = []
        for m in np.unique(sizes[sizes > 1]).tolist():
            starts = new[sizes == m]
            step = max(1, 400_000 // (m * m))
            for a in range(0, len(starts), step):
                rows = order[starts[a : a + step, None] + np.arange(m)]
                live = _live_rows(f["n"][rows].astype(np.int64), f["pos"][rows].astype(np.int64), before[rows], f["side"][rows], f["lo"][rows[:, 0]] != f["hi"][rows[:, 0]], percent)
                picked.append(rows[live])
        got = np.concatenate(picked) if picked else np.zeros(0, np.int64)
        home = homes[f["row"][got]]
        return _live_table(f, got, home)

    return run


def _live_table(f: dict, got: np.ndarray, home: np.ndarray) -> pa.Table:
    order = np.argsort(home, kind="stable")
    got, home = got[order], home[order]
    out = []
    for h in np.unique(home).tolist():
        i = got[np.searchsorted(home, h) : np.searchsorted(home, h, "right")]
        out.append({"home": h, "kind": 2, "part": 0, "payload": _planes({k: f[k][i] for k, _, _ in _LIVE}, _LIVE)})
    return pa.Table.from_pylist(out, _ANSWER)


_SKETCH = pa.schema([("bucket", pa.int32()), ("home", pa.int32()), ("idx", pa.int64()), ("token", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("side", pa.int32()), ("n", pa.int64()), ("bits", pa.binary()), ("before", pa.binary())])


def parity_bits(values: np.ndarray) -> np.ndarray:
    """A bitmap of about two bits an n-gram: a bit is the parity of the n-grams that fall on it. Folding halves it."""
    size = max(64, 1 << int(2 * len(values) - 1).bit_length())
    place = (mix(values) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=size) & 1).astype(np.uint8))


def may_link(n: np.ndarray, bits: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs' bitmaps leave room for a link: they differ in no more bits than the sets may differ in n-grams."""
    ok = np.zeros((len(n), len(n)), bool)
    widths = np.array([len(b) for b in bits])
    for w in np.unique(widths).tolist():
        mine = np.flatnonzero(widths == w)
        wider = np.flatnonzero((widths == w) | (widths == 2 * w))  # sizes further apart can't link
        s = np.stack([bits[j] if len(bits[j]) == w else bits[j][:w] ^ bits[j][w:] for j in wider.tolist()])
        for i in mine.tolist():
            total = n[wider] + n[i]
            differ = np.bitwise_count(s ^ s[wider == i]).sum(axis=1, dtype=np.int64)
            fits = (total - differ) // 2 >= (percent * total + 99 + percent) // (100 + percent)
            ok[i, wider] |= fits
            ok[wider, i] |= fits
    ok[np.arange(len(n)), np.arange(len(n))] = False
    return ok


def _bucket(f: dict, parts: int) -> np.ndarray:
    return (mix(f["token"] + f["lo"].astype(np.uint64) * _A + f["hi"].astype(np.uint64) * _B) % np.uint64(parts)).astype(np.int32)


def _lists(h: _Home, z: pa.Table, bits: int):
    """Of a home's live memberships: their fields, the sets concerned, which one is whose, the ordered lists, the places."""
    f = _fields(z.filter(pa.compute.equal(z.column("kind"), 2)).column("payload").to_pylist(), _LIVE)
    docs, at = np.unique(f["idx"].astype(np.int64), return_inverse=True)
    sizes = h.n[docs]
    take = np.repeat(h.ends[docs] - sizes - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    codes = np.zeros(len(h.values), np.uint8)
    codes[take] = _codes(h, z, bits, h.values[take])
    value, _, _, count, start, _ = _ordered(h, codes, docs)
    lists = [value[s : s + c] for s, c in zip(start.tolist(), count.tolist())]
    places = [int(np.flatnonzero(lists[d] == t)[0]) for d, t in zip(at.tolist(), f["token"])]
    return f, docs, at, lists, places


def _any_live(z: pa.Table) -> bool:
    return bool(z.num_rows) and pa.compute.any(pa.compute.equal(z.column("kind"), 2)).as_py()


def _sketch(bits: int, parts: int, width: int):
    def run(x: pa.Table, z: pa.Table) -> pa.Table:
        if not x.num_rows or not _any_live(z):
            return _SKETCH.empty_table()
        h = _Home(x, width)
        f, docs, at, lists, places = _lists(h, z, bits)
        marks = [parity_bits(h.values[h.ends[d] - h.n[d] : h.ends[d]]).tobytes() for d in docs.tolist()]
        home = x.column("home")[0].as_py()
        before = [_bytes(lists[d][:p]) for d, p in zip(at.tolist(), places)]
        return pa.Table.from_arrays([pa.array(_bucket(f, parts)), pa.array(np.full(len(at), home, np.int32)), pa.array(docs[at]), pa.array(f["token"].view(np.int64)), pa.array(f["lo"].astype(np.int32)), pa.array(f["hi"].astype(np.int32)), pa.array(f["side"].astype(np.int32)), pa.array(h.n[docs[at]]), pa.array([marks[d] for d in at.tolist()], pa.binary()), pa.array(before, pa.binary())], schema=_SKETCH)

    return run


def _strangers(ok: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
    """ok without the pairs whose lists have something in common."""
    longest = max(map(len, before))
    if longest:
        tokens, dense = np.unique(np.concatenate(before), return_inverse=True)
        table = np.full((len(before), longest), len(tokens))
        at = 0
        for r, x in enumerate(before):
            table[r, : len(x)] = dense[at : at + len(x)]
            at += len(x)
        has = np.zeros(len(tokens) + 1, bool)
        for i in np.flatnonzero(ok.any(axis=1)).tolist():
            has[:] = False
            has[table[i, : len(before[i])]] = True
            j = np.flatnonzero(ok[i])
            ok[i, j] = ~has[table[j]].any(axis=1)
    return ok


def _groups(c: dict, by: str):
    """Rows of each (token, block pair), ordered."""
    order = np.lexsort((c[by], c["hi"], c["lo"], c["token"]))
    key = np.stack([c["token"][order], c["lo"][order], c["hi"][order]])
    new = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
    return [order[a:z] for a, z in zip(new, np.append(new[1:], len(order))) if z - a > 1]


def _prune(percent: int):
    def run(t: pa.Table) -> pa.Table:
        c = {k: np.array(t.column(k).to_pylist(), np.int64) for k in ("home", "idx", "token", "lo", "hi", "side", "n")}
        bits, before = t.column("bits").to_pylist(), t.column("before").to_pylist()
        live = []
        for i in _groups(c, "idx"):
            ok = may_link(c["n"][i], [np.frombuffer(bits[j], np.uint8) for j in i.tolist()], percent)
            if c["lo"][i[0]] != c["hi"][i[0]]:
                ok &= c["side"][i][:, None] != c["side"][i]
            live.append(i[_strangers(ok, [_values(before[j]) for j in i.tolist()]).any(axis=1)])
        got = np.concatenate(live) if live else np.zeros(0, np.int64)
        f = {"token": c["token"].view(np.uint64)} | {k: c[k] for k in ("idx", "lo", "hi", "side")}
        return _live_table(f, got, c["home"][got])

    return run


_SENT = pa.schema([("bucket", pa.int32()), ("token", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("side", pa.int32()), ("rep", pa.int64()), ("mult", pa.int64()), ("n", pa.int64()), ("place", pa.int32()), ("grams", pa.binary())])


def _send(bits: int, parts: int, width: int):
    def run(x: pa.Table, z: pa.Table) -> pa.Table:
        if not x.num_rows or not _any_live(z):
            return _SENT.empty_table()
        h = _Home(x, width)
        f, docs, at, lists, places = _lists(h, z, bits)
        rep, mult = _classes(h, z)
        raw = [_bytes(x) for x in lists]
        bucket = _bucket(f, parts)
        who = docs[at]
        return pa.Table.from_arrays([pa.array(bucket), pa.array(f["token"].view(np.int64)), pa.array(f["lo"].astype(np.int32)), pa.array(f["hi"].astype(np.int32)), pa.array(f["side"].astype(np.int32)), pa.array(rep[who]), pa.array(mult[who]), pa.array(h.n[who]), pa.array(places, pa.int32()), pa.array([raw[d] for d in at.tolist()], pa.binary())], schema=_SENT)

    return run


class Trie:
    """Ordered sets as a prefix tree whose edges are bands of n-grams; equal beginnings are one node.

    lists: int arrays of dense ids below `width`, in the global order. overlaps(x) walks it once: each node adds the
    overlap of its band to its parent's, and a node where the remaining lengths can't reach the need is left with its subtree.
    """

    def __init__(self, lists: list[np.ndarray], sizes: np.ndarray, width: int, percent: int):
        self.percent = percent
        longest = max(map(len, lists))
        bands = max(1, ceil_div(longest, BAND))
        table = np.full((len(lists), bands * BAND), width, np.int32)
        for r, x in enumerate(lists):
            table[r, : len(x)] = x
        length = np.array([len(x) for x in lists], np.int64)
        node = np.zeros(len(lists), np.int64)
        self.levels = []
        for b in range(bands):
            band = np.ascontiguousarray(table[:, b * BAND : (b + 1) * BAND])
            key = np.concatenate([node[:, None].astype(np.int32), band], axis=1)
            view = np.ascontiguousarray(key).view([("", np.int32)] * key.shape[1]).ravel()
            _, first, inverse = np.unique(view, return_index=True, return_inverse=True)
            remain = np.zeros(len(first), np.int64)
            np.maximum.at(remain, inverse, np.maximum(length - (b + 1) * BAND, 0))
            least = np.full(len(first), np.iinfo(np.int64).max)
            np.minimum.at(least, inverse, sizes)
            self.levels.append((node[first], band[first], remain, least))
            node = inverse
        self.leaf, self.width = node, width

    def overlaps(self, x: np.ndarray, size: int) -> np.ndarray:
        """The overlap of x with each list, or -1 where the walk left its subtree."""
        has = np.zeros(self.width + 1, np.int16)
        has[x] = 1
        partial = np.zeros(1, np.int64)
        for parent, band, remain, least in self.levels:
            up = partial[parent]
            alive = np.flatnonzero(up >= 0)
            now = np.full(len(parent), -1, np.int64)
            got = up[alive] + has[band[alive]].sum(axis=1)
            need = (self.percent * (least[alive] + size) + 99 + self.percent) // (100 + self.percent)
            now[alive] = np.where(got + np.minimum(remain[alive], len(x) - got) >= need, got, -1)
            partial = now
        return partial[self.leaf]


def join_group(rep, mult, n, side, lists, places, cross: bool, percent: int):
    """Links of one group whose first common n-gram is the group's: (added links per member, forest edges)."""
    m = len(rep)
    tokens, dense = np.unique(np.concatenate(lists), return_inverse=True)
    cut = np.cumsum([len(x) for x in lists])[:-1]
    dense = np.split(dense.astype(np.int32), cut)
    after = [d[p:] for d, p in zip(dense, places)]
    longest = max(places)
    before = np.full((m, longest), len(tokens), np.int32)
    for i, (d, p) in enumerate(zip(dense, places)):
        before[i, :p] = d[:p]
    trie = Trie(after, n, len(tokens), percent)
    added, edges, root = np.zeros(m, np.int64), [], list(range(m))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    has = np.zeros(len(tokens) + 1, bool)
    for i in range(m):
        got = trie.overlaps(after[i], int(n[i]))
        ok = (100 + percent) * got >= percent * (n + n[i])
        ok &= np.arange(m) > i
        if cross:
            ok &= side != side[i]
        if ok.any() and longest:
            has[:] = False
            has[before[i, : places[i]]] = True
            at = np.flatnonzero(ok)
            ok[at] = ~has[before[at]].any(axis=1)
        at = np.flatnonzero(ok)
        if len(at):
            added[i] += mult[at].sum()
            added[at] += mult[i]
            for j in at.tolist():
                a, b = find(i), find(j)
                if a != b:
                    root[b] = a
                    edges.append((int(rep[i]), int(rep[j])))
    return added, edges


_FOUND = pa.schema([("rep", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])


def _verify(percent: int):
    def run(t: pa.Table) -> pa.Table:
        c = {k: np.array(t.column(k).to_pylist(), np.int64) for k in ("token", "lo", "hi", "side", "rep", "mult", "n", "place")}
        grams = t.column("grams")
        links: dict[int, int] = {}
        pairs: list[tuple[int, int]] = []
        for i in _groups(c, "rep"):
            lists = [_values(grams[int(j)].as_py()) for j in i]
            added, edges = join_group(c["rep"][i], c["mult"][i], c["n"][i], c["side"][i], lists, c["place"][i].tolist(), bool(c["lo"][i[0]] != c["hi"][i[0]]), percent)
            for r, k in zip(c["rep"][i].tolist(), added.tolist()):
                if k:
                    links[r] = links.get(r, 0) + k
            pairs += edges
        return pa.Table.from_arrays([pa.array([*links, *(p for p, _ in pairs)], pa.int64()), pa.array([*[None] * len(links), *(q for _, q in pairs)], pa.int64()), pa.array([*links.values(), *[0] * len(pairs)], pa.int64())], schema=_FOUND)

    return run


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2, percent: int = 60) -> DataFrame:
    """One row per document: id_col, n_shingles, n_similar, component_id.

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of `width`-word shingles (A-Z as a-z;
    with fewer words the whole sequence is the one shingle). n_similar counts the other documents linked directly,
    component_id is the smallest id reachable, the own one included. Rows with a null id take part like others; their
    component_id is null where no other id is reachable. Repeated ids count as separate documents: classes of equal sets go by the first 64 bits of their digest, not by an id. Other columns of docs are not looked at.
    """
    if not 0 < percent <= 100 or width < 1:
        raise ValueError("percent must be in 1..100 and width at least 1")
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    members = settle(src.mapInArrow(_members(width), "id bigint, n bigint, dig binary"), "members")
    grams = members.agg(F.sum("n")).first()[0] or 0
    homes = max(4, ceil_div(grams, HOME_GRAMS))
    bits = min(HASH_BITS, max(32, grams.bit_length() + 9))
    classes = settle(members.where("n > 0").groupBy("dig").agg(F.min("id").alias("least"), F.count("*").alias("mult")).withColumn("rep", F.expr("cast(conv(hex(substr(dig, 1, 8)), 16, -10) as bigint)")), "classes")
    home_of = F.expr(f"cast(cast(conv(concat(substr(hex(dig),7,2),substr(hex(dig),5,2),substr(hex(dig),3,2),substr(hex(dig),1,2)),16,10) as bigint) % {homes} as int)")
    class_rows = classes.select(home_of.alias("home"), F.lit(1).alias("kind"), F.lit(0).alias("part"), F.lit(None).cast("binary").alias("payload"), "dig", "rep", "mult")
    x = src.select("text").mapInArrow(_sets(width, homes), "home int, dig binary, size bigint, text binary")
    asked = x.groupBy("home").applyInArrow(_request(bits, homes, width), "part int, home int, payload binary")
    told = asked.groupBy("part").applyInArrow(_answer, _ddl(_ANSWER))
    posted = x.groupBy("home").cogroup(told.unionByName(class_rows).groupBy("home")).applyInArrow(_post(bits, homes, percent, width), "bucket int, home int, payload binary")
    live = posted.groupBy("bucket").applyInArrow(_live(percent), _ddl(_ANSWER))
    sketched = x.groupBy("home").cogroup(told.unionByName(live).groupBy("home")).applyInArrow(_sketch(bits, homes, width), _ddl(_SKETCH))
    live = sketched.groupBy("bucket").applyInArrow(_prune(percent), _ddl(_ANSWER))
    sent = x.groupBy("home").cogroup(told.unionByName(class_rows).unionByName(live).groupBy("home")).applyInArrow(_send(bits, homes, width), _ddl(_SENT))
    found = settle(sent.groupBy("bucket").applyInArrow(_verify(percent), _ddl(_FOUND)), "links")
    links = found.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("other is not null"), "rep", "other")
    of_class = classes.join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("dig", "least", F.coalesce("component", "rep").alias("component"), (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_similar"))
    of_class = of_class.join(of_class.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("dig", "n_similar", "component_id")
    full = members.where("n > 0").join(of_class, "dig").select("id", "n", "n_similar", "component_id")
    bare = members.where("n = 0").select("id", "n", F.lit(0).alias("n_similar"), F.col("id").alias("component_id"))  # they'd all meet in one task
    return full.unionByName(bare).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("n_similar").cast("bigint").alias("n_similar"), "component_id")
