"""What the operators share: tables, durable intermediates, and a vectorised word hasher."""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import os
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder from spark.checkpoint.dir; where unset, a temporary one of this process, on a local master only."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="inkwell-"))
        atexit.register(shutil.rmtree, _own_dir[0], True)
    return f"file://{_own_dir[0]}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def extend(schema: StructType, ddl: str) -> StructType:
    """The schema with further columns."""
    return StructType(schema.fields + StructType.fromDDL(ddl).fields)


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


# --- words -----------------------------------------------------------------

SEGMENT = 1 << 20
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)  # odd
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["p"]) < n:
        size = max(n, SEGMENT + 1)
        for key, base in (("p", _P), ("i", _PINV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[key] = np.multiply.accumulate(x)
    return _powers["p"], _powers["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = column.cast(pa.large_string())
    if a.null_count:
        a = a.fill_null("")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if len(a) and a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches, at: int, limit: int = 2 << 20):
    """The batches cut to rows of about `limit` bytes of text in column `at`, so that memory doesn't follow the batch size."""
    for b in batches:
        offsets = utf8(b.column(at))[1]
        a, n = 0, b.num_rows
        while a < n:
            z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
            yield b.slice(a, z - a)
            a = z
    trim()


def trim() -> None:
    """Gives freed memory back, since workers live on after a task."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def _cuts(data: np.ndarray, offsets: np.ndarray, white: np.ndarray) -> list[int]:
    """Where to cut the bytes into segments: at text ends, and within long texts at white space."""
    cuts, at, total = [0], 0, int(offsets[-1])
    while at < total:
        if total - at <= SEGMENT:
            at = total
        else:
            end = int(offsets[np.searchsorted(offsets, at + SEGMENT, "right") - 1])
            if end <= at:  # inside a long text
                limit = int(offsets[np.searchsorted(offsets, at, "right")])
                end, step = at + SEGMENT, SEGMENT
                while end < limit:
                    gap = np.flatnonzero(white[data[end : end + step]])
                    if len(gap):
                        end += int(gap[0])
                        break
                    end += step
                end = min(end, limit)
            at = end
        cuts.append(at)
    return cuts


def _starts_ends(part: np.ndarray, inner: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of some bytes begin and end; inner: ends of texts among them."""
    edge = np.zeros(len(part) + 1, bool)
    edge[inner] = True
    word = ~separators[part]
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Distinct:
    """Numbers byte strings, equal ones alike. A 64-bit hash finds a string's place and its bytes are compared there, so
    strings that share a hash are told apart."""

    def __init__(self):
        self.forget()

    def forget(self):
        self.hash, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.data, self.at, self.size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.clashes: dict[bytes, int] = {}

    def __len__(self):
        return len(self.at)

    def _add(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size, base = ends - starts, len(self.data)
        number = len(self.at) + np.arange(len(size))
        self.at = np.concatenate([self.at, base + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.data = np.concatenate([self.data, data[_spread(starts, size)]])
        return number

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        p, inv = _pow(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * p[: len(data)], out=sums[1:])
        size = ends - starts
        h = mix((sums[ends] - sums[starts]) * inv[starts] + size.astype(np.uint64))
        del sums
        distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
        where = np.searchsorted(self.hash, distinct)
        new = np.ones(len(distinct), bool)
        inside = where < len(self.hash)
        new[inside] = self.hash[where[inside]] != distinct[inside]
        if new.any():
            number = self._add(data, starts[first[new]], ends[first[new]])
            order = np.argsort(np.concatenate([self.hash, distinct[new]]), kind="stable")
            self.hash, self.number = np.concatenate([self.hash, distinct[new]])[order], np.concatenate([self.number, number])[order]
            where = np.searchsorted(self.hash, distinct)
        out = self.number[where][which]
        same = self.size[out] == size
        odd = np.flatnonzero(~same)
        i = np.flatnonzero(same)
        for a in range(0, len(i), 200_000):
            k = i[a : a + 200_000]
            differ = np.flatnonzero(data[_spread(starts[k], size[k])] != self.data[_spread(self.at[out[k]], size[k])])
            if len(differ):
                odd = np.concatenate([odd, k[np.unique(np.searchsorted(np.cumsum(size[k]), differ, "right"))]])
        for k in odd.tolist():
            raw = data[starts[k] : ends[k]].tobytes()
            if raw not in self.clashes:
                self.clashes[raw] = int(self._add(data, starts[k : k + 1], ends[k : k + 1])[0])
            out[k] = self.clashes[raw]
        return out


def _spread(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the given stretches, one after another."""
    total = int(size.sum())
    return np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(total)


_LONG_WORD = 64


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of each word: its bytes, eight at a time, each time spread over all bits; of a word of more than 64 bytes a
    cryptographic digest. Words of one length up to eight never share theirs."""
    size = ends - starts
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    out = mix(size.astype(np.uint64) + _P)
    long = size > _LONG_WORD
    some = np.flatnonzero(~long)
    k = 0
    while len(some):
        rest = size[some] - 8 * k
        block = eights[starts[some] + 8 * k].view(np.uint64).ravel()
        cut = rest < 8
        block[cut] &= (np.uint64(1) << (8 * rest[cut]).astype(np.uint64)) - np.uint64(1)
        out[some] = mix(out[some] ^ block) + _P
        k += 1
        some = some[rest > 8]
    for i in np.flatnonzero(long).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def word_digests(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit digest, text index) of each word, in order: words as those of word_hashes, digests that don't add up letter by letter."""
    digests, owners = [], []
    cuts = _cuts(data, offsets, _WHITE)
    for a, b in zip(cuts, cuts[1:]):
        part = _LOWER[data[a:b]]
        inner = offsets[np.searchsorted(offsets, a, "left") : np.searchsorted(offsets, b, "left")] - a
        starts, ends = _starts_ends(part, inner, _WHITE)
        if len(starts):
            digests.append(_digests(part, starts, ends))
            owners.append(np.searchsorted(offsets, starts + a, "right") - 1)
    if not digests:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(digests), np.concatenate(owners)


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _WHITE, values: np.ndarray = _BYTE_LOWER, heads: tuple[int, ...] = ()):
    """(64-bit hash, text index) of each word, in order. A word is a longest run of non-separator bytes of one text; A-Z count as a-z.

    With heads, further arrays have the hashes of each word's first so many bytes.
    """
    hashes, owners, begun = [], [], [[] for _ in heads]
    cuts = _cuts(data, offsets, separators)
    for a, b in zip(cuts, cuts[1:]):
        part = data[a:b]
        inner = offsets[np.searchsorted(offsets, a, "left") : np.searchsorted(offsets, b, "left")] - a
        starts, ends = _starts_ends(part, inner, separators)
        if not len(starts):
            continue
        p, inv = _pow(b - a)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(values[part] * p[: b - a], out=sums[1:])

        def spans(to):
            return mix((sums[to] - sums[starts]) * inv[starts] + (to - starts).astype(np.uint64))

        hashes.append(spans(ends))
        owners.append(np.searchsorted(offsets, starts + a, "right") - 1)
        for k, size in enumerate(heads):
            begun[k].append(spans(np.minimum(ends, starts + size)))
    if not hashes:
        none = np.zeros(0, np.uint64)
        return (none, np.zeros(0, np.int64), *(none for _ in heads))
    return (np.concatenate(hashes), np.concatenate(owners), *map(np.concatenate, begun))
