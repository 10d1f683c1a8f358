"""Byte-level BPE encoding and decoding with DuckDB inside each task.

Texts are cut by the tokenizer's pattern. Every distinct piece becomes token-position rows; a recursive query joins
neighbouring tokens with the merge table and contracts each piece's leftmost pair of least rank, until no pair is in the
table. Pieces are told apart by their bytes. A long piece is contracted at all occurrences of its least pair at a time and
cut where no contraction can reach, so that its time doesn't follow the square of its length. Ids are gathered back to texts; decoding joins ids with the vocabulary and aggregates their bytes in order.

Null texts encode as empty ones. Special tokens are never produced. The pattern must be the GPT-2 one; its classes are
taken from the Unicode database by the `regex` library, so that cutting is a few array operations a text.
"""

from __future__ import annotations

import base64
import hashlib
from contextlib import contextmanager
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import Distinct, _spread, extend, trim, utf8

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK = 1 << 20
WORDS_A_QUERY = 20_000
LONG = 200  # bytes of a piece from which on a step contracts all occurrences of its least pair
ROWS_A_QUERY = 400_000
MEMORY_MB = 160
KNOWN_WORDS = 300_000
_L, _N, _S, _O = 1, 2, 3, 0


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point: letter, number, white space or other."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    codes = np.frombuffer(every.encode("utf-32-le"), np.uint32)
    out = np.zeros(0x110000, np.uint8)
    for p, k in ((r"\p{L}+", _L), (r"\p{N}+", _N), (r"\s+", _S)):
        for m in regex.finditer(p, every):
            out[codes[m.start() : m.end()]] = k
    return out


def piece_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where the pattern's matches begin in texts laid end to end (code points; text_starts: sorted, of non-empty texts)."""
    n = len(points)
    c = _classes()[points]
    first = np.zeros(n + 1, bool)
    first[text_starts] = True
    first[n] = True
    begin = first[:n].copy()
    begin[1:] |= c[1:] != c[:-1]
    space = c == _S
    # The last of several white spaces before something else stands alone or leads it.
    last_space = np.zeros(n, bool)
    last_space[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    if n:
        last_space[n - 1] = False
    begin |= last_space
    leads = np.flatnonzero(last_space & (points == 32))
    begin[leads + 1] = False
    # Contractions: an apostrophe that begins a piece, then one of the endings.
    q = np.flatnonzero((points == 39) & begin)
    q = q[(q + 1 < n)]
    q = q[~first[q + 1]]
    one = points[q + 1]
    two = np.zeros(len(q), np.uint32)
    room = (q + 2 < n)
    room[room] &= ~first[q[room] + 2]
    two[room] = points[q[room] + 2]
    short = np.isin(one, [ord(x) for x in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    for at, size in ((q[short], 2), (q[long], 3)):
        begin[at + 1] = False
        after = at + size
        after = after[after < n]
        # The rest of the letters is a piece; what follows otherwise began one anyway, unless a space led it.
        rest = after[(c[after] == _L) & ~first[after]]
        begin[rest] = True
    return np.flatnonzero(begin)


_RECURSION = """
WITH RECURSIVE t AS (
  SELECT w, 0 AS step, pos, tok, nxt, npos FROM start
  UNION ALL
  SELECT t.w, t.step + 1, t.pos,
         CASE WHEN t.pos = b.q THEN b.m ELSE t.tok END,
         CASE WHEN t.npos = b.p THEN b.m ELSE t.nxt END,
         CASE WHEN t.npos = b.p THEN b.q ELSE t.npos END
  FROM t JOIN (
    SELECT w, key >> 24 AS m, key & 16777215 AS p, q FROM (
      SELECT w, min((m.m::BIGINT << 24) | t.pos) AS key, arg_min(t.npos, (m.m::BIGINT << 24) | t.pos) AS q
      FROM t JOIN merges m ON m.l = t.tok AND m.r = t.nxt GROUP BY w)
  ) b ON t.w = b.w AND t.pos <> b.p
)
SELECT t.w, t.tok FROM t JOIN (SELECT w, max(step) AS step FROM t GROUP BY w) e ON t.w = e.w AND t.step = e.step
ORDER BY t.w, t.pos
"""
# The same for long pieces: a step contracts every occurrence of a piece's least pair, of those that overlap the first,
# third and so on. Pairs that a contraction makes rank after it, so that is what leftmost contractions come to.
_ROUNDS = """
WITH RECURSIVE t AS (
  SELECT w, 0 AS step, pos, tok, nxt, npos FROM start
  UNION ALL
  (WITH c AS MATERIALIZED (SELECT t.w, t.step, t.pos AS p, t.npos AS q, m.m FROM t JOIN merges m ON m.l = t.tok AND m.r = t.nxt WHERE t.step < {steps}),
   least AS MATERIALIZED (SELECT w, min(m) AS m FROM c GROUP BY w),
   f AS (SELECT c.w, c.p, c.q, c.m, lag(c.q) OVER (PARTITION BY c.w ORDER BY c.p) IS DISTINCT FROM c.p AS head FROM c JOIN least ON c.w = least.w AND c.m = least.m),
   g AS (SELECT *, sum(head::INT) OVER (PARTITION BY w ORDER BY p) AS run FROM f),
   s AS MATERIALIZED (SELECT w, p, q, m FROM (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY p) AS place FROM g) WHERE place % 2 = 1)
  SELECT t.w, t.step + 1, t.pos, coalesce(b.m, t.tok), coalesce(n.m, t.nxt), coalesce(n.q, t.npos)
  FROM t JOIN least ON t.w = least.w LEFT JOIN s a ON t.w = a.w AND t.pos = a.p LEFT JOIN s b ON t.w = b.w AND t.pos = b.q LEFT JOIN s n ON t.w = n.w AND t.npos = n.p
  WHERE a.p IS NULL)
)
SELECT t.w, t.pos, t.tok FROM t JOIN (SELECT w, max(step) AS step FROM t GROUP BY w) e ON t.w = e.w AND t.step = e.step
ORDER BY t.w, t.pos
"""


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(b): int(r) for b, r in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _tables(path: str):
    """Merge table, vocabulary (bytes as code points) and the ids of the single bytes; a few MB."""
    rank = _ranks(path)
    pairs = [(rank[b[:k]], rank[b[k:]], r) for b, r in rank.items() for k in range(1, len(b)) if b[:k] in rank and b[k:] in rank]
    l, r, m = (pa.array(x, pa.int32()) for x in zip(*pairs))
    named = sorted((i, b.decode("latin-1")) for b, i in rank.items())
    vocab = pa.table({"id": pa.array([i for i, _ in named], pa.int32()), "piece": pa.array([b for _, b in named])})
    return pa.table({"l": l, "r": r, "m": m}), vocab, np.array([rank[bytes([b])] for b in range(256)], np.int32)


def _pair_keys(l, r) -> np.ndarray:
    return np.asarray(l, np.int64) << 32 | np.asarray(r, np.int64)


@lru_cache(maxsize=1)
def _alive(path: str) -> np.ndarray:
    """Sorted keys of the pairs of ids that lie side by side in some id's bytes. Between others no contraction ever reaches."""
    rank = _ranks(path)
    parts = {b[i:k] for b in rank for i in range(len(b)) for k in range(i + 2, len(b) + 1)}
    return np.unique(np.array([rank[s[:j]] << 32 | rank[s[j:]] for s in parts for j in range(1, len(s)) if s[:j] in rank and s[j:] in rank], np.int64))


@lru_cache(maxsize=1)
def _ordered(path: str) -> bool:
    """Whether each id comes of two others by contractions that all rank before it. Then no contraction makes a pair of lesser rank."""
    rank = _ranks(path)
    name = {i: b for b, i in rank.items()}
    for b, r in rank.items():
        t = [b[i : i + 1] for i in range(len(b))]
        while len(t) > 1:
            best = min((rank.get(x + y, r + 1), i) for i, (x, y) in enumerate(zip(t, t[1:])))
            if best[0] > r or (best[0] == r and len(t) > 2):
                return False
            t[best[1] : best[1] + 2] = [name[best[0]]]
    return True


def _among(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys


class Codec:
    """A vocabulary of ranks (a .tiktoken file) loaded into an in-memory DuckDB of one thread, which never writes to disk."""

    def __init__(self, path: str):
        merges, vocab, self.byte_id = _tables(path)
        self.path = path
        self.pairs = np.sort(_pair_keys(merges.column("l").to_numpy(), merges.column("r").to_numpy()))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY_MB}MB", "temp_directory": ""})
        for name, rows in (("merges", merges), ("vocab", vocab)):
            self.db.register("src", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM src")
            self.db.unregister("src")
        self.known = Distinct()
        self.forget()

    def forget(self):
        self.known.forget()
        self.at, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _start(self, w, pos, tok):
        """Token-position rows: each with its right neighbour in its word, -1 where there is none."""
        nxt, npos = np.full(len(tok), -1, np.int32), np.full(len(tok), -1, np.int64)
        inner = np.append(w[1:] == w[:-1], False) if len(w) else np.zeros(0, bool)
        nxt[:-1], npos[:-1] = tok[1:], pos[1:]
        nxt[~inner], npos[~inner] = -1, -1
        self.db.register("start", pa.table({"w": w.astype(np.int32), "pos": pos.astype(np.int64), "tok": tok.astype(np.int32), "nxt": nxt, "npos": npos}))

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all given byte pieces, end to end; number of ids of each)."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        size = ends - starts
        long = np.flatnonzero(size > LONG)
        if len(long) and not _ordered(self.path):
            long = long[:0]
        short = np.setdiff1d(np.arange(len(size)), long)
        got = []
        for a in range(0, len(short), WORDS_A_QUERY):
            k = short[a : a + WORDS_A_QUERY]
            n, tok = size[k], self.byte_id[data[_spread(starts[k], size[k])]]
            w = np.repeat(np.arange(len(k)), n)
            self._start(w, np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n), tok)
            out = self.db.execute(_RECURSION).fetchnumpy()
            got.append((k[np.asarray(out["w"])], np.asarray(out["tok"])))
        if len(long):
            n = size[long]
            w, tok = self._contract(np.repeat(np.arange(len(long)), n), self.byte_id[data[_spread(starts[long], n)]])
            got.append((long[w], tok))
        owner, tok = (np.concatenate(x) for x in zip(*got))
        order = np.argsort(owner, kind="stable")
        return tok[order].astype(np.uint32), np.bincount(owner, minlength=len(starts))

    def _contract(self, w: np.ndarray, tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for long pieces, some steps at a time: (piece, id) in order.

        Between the queries pieces are cut where no contraction can reach, and those without a pair of the merge table set aside.
        """
        place, done, word = np.arange(len(w)), [], w
        while len(tok):
            cut = np.ones(len(tok), bool)
            cut[1:] = (word[1:] != word[:-1]) | ~_among(_pair_keys(tok[:-1], tok[1:]), _alive(self.path))
            word = np.cumsum(cut) - 1
            joins = np.zeros(word[-1] + 1, bool)
            joins[word[:-1][~cut[1:] & _among(_pair_keys(tok[:-1], tok[1:]), self.pairs)]] = True
            ended = ~joins[word]
            done.append((place[ended], w[ended], tok[ended]))
            w, tok, place, word = w[~ended], tok[~ended], place[~ended], word[~ended]
            if not len(tok):
                break
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(word))))
            out, a = [], 0
            while a < len(first):  # as many words as one query takes
                z = min(len(first), max(a + 1, int(np.searchsorted(first, first[a] + ROWS_A_QUERY, "right")) - 1)) if first[-1] > first[a] + ROWS_A_QUERY else len(first)
                i = slice(first[a], first[z] if z < len(first) else len(tok))
                rows = i.stop - i.start
                self._start(number[i] - a, place[i], tok[i])
                self.db.execute(f"SET memory_limit = '{max(MEMORY_MB, rows // 2000)}MB'")
                got = self.db.execute(_ROUNDS.format(steps=max(1, ROWS_A_QUERY // rows))).fetchnumpy()
                out.append((np.asarray(got["pos"]), np.asarray(got["tok"])))
                a = z
            at, tok = (np.concatenate(x) for x in zip(*out))
            kept = np.searchsorted(place, at)
            w, word, place = w[kept], word[kept], at
        place, w, tok = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(place)
        return w[order], tok[order]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end to end; n+1 offsets). data: UTF-8 bytes; offsets: of the texts in it."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if len(data) > 3 * CHUNK // 2 and len(cuts := _stops(data, offsets)) > 2:
            parts = [self.encode(data[a:z], np.array([0, z - a])) for a, z in zip(cuts, cuts[1:])]
            total = np.cumsum([0, *(len(ids) for ids, _ in parts)])
            return np.concatenate([ids for ids, _ in parts]), total[np.searchsorted(cuts, offsets)]
        text = data.tobytes().decode("utf-8")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)  # byte of each code point
        filled = offsets[:-1][np.diff(offsets) > 0]
        starts = lead[piece_starts(points, np.searchsorted(lead, filled))]
        ends = np.append(starts[1:], len(data))
        del text, points, lead
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        which = self.known.numbers(data, starts, ends)
        if len(self.known) > len(self.at):
            a = self.known.at[len(self.at) :]
            fresh, n = self.words(self.known.data, a, a + self.known.size[len(self.at) :])
            self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(n) - n])
            self.count, self.ids = np.concatenate([self.count, n]), np.concatenate([self.ids, fresh])
        count = self.count[which]
        ids = self.ids[_spread(self.at[which], count)]
        before = np.concatenate([[0], np.cumsum(count)])
        return ids, before[np.searchsorted(starts, offsets, "left")]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of each text of ids, by ordered aggregation. Unknown ids raise."""
        n, step = len(offsets) - 1, 200_000
        out: list[list[bytes]] = [[] for _ in range(n)]
        bounds = np.unique(np.concatenate([offsets, *(np.arange(a, z, step) for a, z in zip(offsets[:-1], offsets[1:]) if z - a > step)]))
        owner = np.searchsorted(offsets, bounds[:-1], "right") - 1
        a = 0
        while a < len(owner):
            z = max(a + 1, int(np.searchsorted(bounds, bounds[a] + step, "right")) - 1)
            part = ids[bounds[a] : bounds[z]]
            doc = np.repeat(np.arange(a, z), np.diff(bounds[a : z + 1]))
            self.db.register("given", pa.table({"doc": doc, "pos": np.arange(len(part)), "id": part.astype(np.int32)}))
            rows = self.db.execute("SELECT doc, string_agg(piece, '' ORDER BY pos), count(piece) FROM given LEFT JOIN vocab USING (id) GROUP BY doc ORDER BY doc").fetchall()
            self.db.unregister("given")
            if sum(r[2] for r in rows) != len(part):
                raise ValueError("ids that the vocabulary lacks")
            for d, s, _ in rows:
                out[owner[d]].append(s.encode("latin-1"))
            a = z
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]


def _stops(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places about CHUNK bytes apart, and all of offsets, at which a piece surely begins: blanks after what isn't white space."""
    blank = (data == 0x20) | (data == 0x0A)
    after = blank[1:] & (data[:-1] > 0x20) & (data[:-1] < 0x7F)
    letters = np.flatnonzero(blank[1:] & (data[:-1] >= 0x80)) + 1
    good = [np.flatnonzero(after) + 1]
    if not len(good[0]) and len(letters):  # the character before may be a white space itself
        raw = data.tobytes()
        good = [np.array([k for k in letters.tolist() if not raw[max(0, k - 4) : k].decode("utf-8", "ignore")[-1:].isspace()], np.int64)]
    good = good[0]
    picked = good[np.minimum(np.searchsorted(good, np.arange(CHUNK, len(data), CHUNK)), len(good) - 1)] if len(good) else good
    return np.unique(np.concatenate([offsets, picked]))


@contextmanager
def _codec(path: str):
    """A codec for one task; its memory goes back at the end."""
    c = Codec(path)
    try:
        yield c
    finally:
        c.db.close()
        c.forget()
        trim()


def _chunks(column):
    """(data, offsets) of consecutive texts of about CHUNK bytes."""
    data, offsets = utf8(column)
    n, a = len(offsets) - 1, 0
    while a < n:
        z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1)
        yield data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]
        a = z


def _run(path: str, keep_ids: bool, decode: bool):
    def run(batches):
        with _codec(path) as codec:
            for b in batches:
                at = 0
                for data, offsets in _chunks(b.column("__text")):
                    n = len(offsets) - 1
                    ids, bounds = codec.encode(data, offsets)
                    raw = ids.astype("<u4").tobytes()
                    cuts = bounds.tolist()
                    cols = [*(b.column(i).slice(at, n) for i in range(b.num_columns - 1)), pa.array(np.diff(bounds))]
                    names = [*b.schema.names[:-1], "n_tokens"]
                    cols.append(pa.array([hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in zip(cuts, cuts[1:])], pa.string()))
                    names.append("ids_sha256")
                    if decode:
                        cols.append(pa.array([hashlib.sha256(x).hexdigest() for x in codec.decode(ids, bounds)], pa.string()))
                        names.append("decoded_sha256")
                    if keep_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))))
                        names.append("ids")
                    at += n
                    yield pa.RecordBatch.from_arrays(cols, names)

    return run


def encode(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None, ids: bool = True, decode: bool = False) -> DataFrame:
    """The columns in keep (default: all but the text), then n_tokens, ids_sha256, decoded_sha256 if asked, and ids.

    One output row per row; repeated rows repeat. path: the rank file, which every executor must be able to read. Digests
    are of the ids as little-endian unsigned 32-bit integers and of the decoded bytes.
    """
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    clash = {"n_tokens", "ids_sha256", "ids", "decoded_sha256", "__text"} & set(keep)
    src = docs.select(*(F.col(f"`{c}`") for c in keep if c not in clash), F.col(f"`{text_col}`").cast("string").alias("__text"))
    new = "n_tokens bigint, ids_sha256 string" + ", decoded_sha256 string" * decode + ", ids array<int>" * ids
    return src.mapInArrow(_run(path, ids, decode), extend(src.drop("__text").schema, new))


def _decode(path: str):
    def run(batches):
        with _codec(path) as codec:
            for b in batches:
                a = b.column("ids")
                n = np.array([0 if x is None else x for x in pa.compute.list_value_length(a).to_pylist()], np.int64)
                flat = a.flatten().to_numpy(zero_copy_only=False).astype(np.uint32)
                raw = codec.decode(flat, np.concatenate([[0], np.cumsum(n)]))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array([x if v else None for x, v in zip(raw, a.is_valid().to_pylist())], pa.binary())], [*b.schema.names[:-1], "decoded"])

    return run


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Replaces ids by decoded, the bytes as binary (ids may end inside a character); null ids stay null."""
    rest = [c for c in encoded.columns if c not in (ids_col, "decoded")]
    src = encoded.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    return src.mapInArrow(_decode(path), extend(src.drop("ids").schema, "decoded binary"))
