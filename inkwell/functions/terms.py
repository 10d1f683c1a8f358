"""Words of texts, their counts and candidates for the best words of articles, over Arrow batches in the Python workers.

Counts go in pieces, a row each: ids, the piece's distinct words with the number of articles that have them, and `counts`, the
(row, code, title_tf, text_tf) of each article and word as a compressed Arrow stream, where code is the word's place in the piece.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from inkwell.functions.text import NEGATIVE, POSITIVE, STOP_WORDS

PIECE = 1 << 20  # words worked on at a time


def _pieces(batch: pa.RecordBatch, columns):
    """The batch in runs of rows whose lists in the columns hold PIECE words together, or one row; of a text, 8 bytes count as a word."""
    ends = np.zeros(batch.num_rows, np.int64)
    for c in map(batch.column, columns):
        n = pc.fill_null(pc.list_value_length(c) if pa.types.is_list(c.type) else pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends += np.cumsum(n) if pa.types.is_list(c.type) else np.cumsum(n) // 8
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + PIECE, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row of each word, words)."""
    return pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()


def _split(texts: pa.Array, words: pa.Array) -> pa.Array:
    """Lists of the words of texts, as text.words splits them, with empty words left in; none where the words are told."""
    texts = texts.cast(pa.string())
    if words.null_count < len(words):
        texts = pc.if_else(words.is_valid(), pa.scalar(None, pa.string()), texts)
    return pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L} \t\n\x0B\f\r]+", ""))


def tokens(texts: pa.Array, words: pa.Array) -> pa.Array:
    """Lists of the words of texts without stop words, in order; null for null. words: as in counted, of a plain text."""
    none = pa.array(("", *STOP_WORDS), pa.string())
    split = _split(texts, words)
    flat = []
    for lists in (split, words):
        rows, of = _flat(lists)
        kept = pc.invert(pc.is_in(of, value_set=none))
        flat.append((rows[kept.to_numpy(zero_copy_only=False)], of.filter(kept).cast(pa.string())))
    rows, of = np.concatenate([r for r, _ in flat]), pa.concat_arrays([w for _, w in flat])
    if len(flat[0][1]) and len(flat[1][1]):
        order = np.argsort(rows, kind="stable")
        rows, of = rows[order], of.take(pa.array(order))
    ends = pa.array(np.searchsorted(rows, np.arange(len(texts) + 1)), pa.int32())
    return pa.ListArray.from_arrays(ends, of, mask=texts.is_null())


def _coded(lists: list[pa.Array], dropped=()) -> tuple[list[np.ndarray], list[np.ndarray], pa.Array]:
    """(rows, codes, distinct words) of the words of each array of lists, without those dropped."""
    rows, words = zip(*map(_flat, lists))
    coded = pa.concat_arrays([w.cast(pa.string()) for w in words]).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    names = coded.dictionary
    if len(dropped) and len(names):
        keep = pc.invert(pc.is_in(names, value_set=pa.array(dropped, pa.string())))
        kept = keep.to_numpy(zero_copy_only=False)
        names, at = names.filter(keep), np.where(kept, np.cumsum(kept) - 1, -1)
        codes = at[codes]
    codes = np.split(codes, np.cumsum([len(w) for w in words])[:-1])
    return [r[c >= 0] for r, c in zip(rows, codes)], [c[c >= 0] for c in codes], names


def _piece(ids: pa.Array, words: pa.Array, rows: np.ndarray, codes: np.ndarray, title_tf: np.ndarray, text_tf: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(x, pa.int32()) for x in (rows, codes, title_tf, text_tf)]
    counts = pa.RecordBatch.from_arrays(columns, ["row", "code", "title_tf", "text_tf"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, counts.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_batch(counts)
    df = np.bincount(codes, minlength=len(words))
    one = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, words, pa.array(df, pa.int32()))]
    return pa.RecordBatch.from_arrays([*one, pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["ids", "words", "df", "counts"])


def _opened(batches):
    """(ids, words, rows, codes, title_tf, text_tf) of each piece."""
    for batch in batches:
        for k in range(batch.num_rows):
            counts = pa.ipc.open_stream(batch.column(3)[k].as_buffer()).read_next_batch()
            yield batch.column(0)[k].values, batch.column(1)[k].values, *(c.to_numpy().astype(np.int64) for c in counts.columns)


def counted(batches, plain: bool = False):
    """(id, title_tokens, text_tokens) to pieces. plain: (id, title, text, title_words, text_words), of which stop words are dropped.

    Of plain articles a field comes with its words, if it has characters that the JVM must split.
    """
    for batch in batches:
        for b in _pieces(batch, range(1, batch.num_columns)):
            lists = b.columns[1:]
            if plain:
                lists = [_split(lists[0], lists[2]), _split(lists[1], lists[3]), *lists[2:]]
            rows, codes, words = _coded(lists, ("", *STOP_WORDS) if plain else ())
            size = max(1, len(words))
            keys = np.concatenate([(r * size + c) * 2 + k % 2 for k, (r, c) in enumerate(zip(rows, codes))])
            keys.sort()  # by row, word and field; sorting plain numbers is much faster than sorting their places
            pair = keys >> 1
            start = np.flatnonzero(np.diff(pair, prepend=-1))
            pairs, n = pair[start], np.diff(start, append=len(keys))
            in_text = np.add.reduceat(keys & 1, start) if len(start) else n
            yield _piece(b.column(0), words, pairs // size, pairs % size, n - in_text, in_text)


def packed(batches):
    """Rows (id, words, title_tf, text_tf) to pieces."""
    for batch in batches:
        for b in _pieces(batch, (1,)):
            (rows,), (codes,), words = _coded([b.column(1)])
            yield _piece(b.column(0), words, rows, codes, *(b.column(k).flatten().to_numpy(zero_copy_only=False) for k in (2, 3)))


def unpacked(batches):
    """Pieces to rows (id, words, title_tf, text_tf)."""
    for ids, words, rows, codes, *tfs in _opened(batches):
        ends = pa.array(np.searchsorted(rows, np.arange(len(ids) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, x) for x in (words.take(pa.array(codes)), *(pa.array(tf, pa.int32()) for tf in tfs))]
        yield pa.RecordBatch.from_arrays([ids, *lists], ["id", "words", "title_tf", "text_tf"])


def filled(batches):
    """Of each piece the number of rows that have words."""
    for _, _, rows, *_ in _opened(batches):
        yield pa.RecordBatch.from_arrays([pa.array([len(np.unique(rows))], pa.int64())], ["n"])


def vectors(batches, size: int):
    """Rows (piece, pos, index, counts) sorted by piece and pos to sparse vectors of `size`, one for each row of a piece that has words.

    A piece's counts come first, at pos -1; then the index of each of its words that has one, by the word's place.
    """

    def vectors_of(counts, parts):
        rows, codes, *tfs = (c.to_numpy().astype(np.int64) for c in pa.ipc.open_stream(counts.as_buffer()).read_next_batch().columns)
        at = np.full(codes.max(initial=-1) + 1, -1, np.int64)
        for pos, index in parts:
            at[pos] = index
        some, index, tf = np.unique(rows), at[codes], sum(tfs)
        kept = np.flatnonzero(index >= 0)
        kept = kept[np.argsort((rows[kept] << 32) + index[kept])]
        ends = pa.array(np.append(np.searchsorted(rows[kept], some), len(kept)), pa.int32())
        n = len(some)
        fields = [pa.array(np.zeros(n), pa.int8()), pa.array(np.full(n, size), pa.int32()), *(pa.ListArray.from_arrays(ends, x) for x in (pa.array(index[kept], pa.int32()), pa.array(tf[kept], pa.float64())))]
        return pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, ["type", "size", "indices", "values"])], ["features"])

    counts, parts = None, []
    for batch in batches:
        pos, index = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
        new = np.flatnonzero(pos < 0)
        for start, stop in zip([0, *new], [*new, len(pos)]):
            if start < stop and pos[start] < 0:
                if counts is not None:
                    yield vectors_of(counts, parts)
                counts, parts, start = batch.column(3)[int(start)], [], start + 1
            if start < stop:
                parts.append((pos[start:stop].astype(np.int64), index[start:stop].astype(np.int64)))
    if counts is not None:
        yield vectors_of(counts, parts)


def said(batches):
    """(id, month, day, weekday, title, text, title_words, text_words) to (id, month, day, weekday, n_title, n_text, score).

    Fields come as in counted; n is the number of tokens, null for null, score that of good less that of bad words in the text.
    """
    good, bad, none = (pa.array(w, pa.string()) for w in (POSITIVE, NEGATIVE, ("", *STOP_WORDS)))
    for batch in batches:
        for b in _pieces(batch, range(4, 8)):
            sums, score = [], np.zeros(b.num_rows, np.int64)
            rows, codes, words = _coded([_split(b.column(4), b.column(6)), _split(b.column(5), b.column(7)), *b.columns[6:]])
            weight, token = (np.array(x.to_numpy(zero_copy_only=False), np.int64) for x in (pc.subtract(*(pc.is_in(words, value_set=v).cast(pa.int8()) for v in (good, bad))), pc.invert(pc.is_in(words, value_set=none))))
            for k in (0, 1):
                r, c = (np.concatenate([x[k], x[k + 2]]) for x in (rows, codes))
                null = b.column(4 + k).is_null().to_numpy(zero_copy_only=False)
                sums.append(pa.array(np.bincount(r, token[c], b.num_rows).astype(np.int32), mask=null))
                if k:
                    score = pa.array(np.bincount(r, weight[c], b.num_rows).astype(np.int32), mask=null)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *sums, score], ["id", "month", "day", "weekday", "n_title", "n_text", "score"])


def _nth(rows: np.ndarray, values: np.ndarray, n: int, n_rows: int) -> np.ndarray:
    """A number just below the n-th largest value of each row, minus infinity for rows with fewer.

    Row and value, rounded down to 32 bits, are sorted as one whole number.
    """
    bits = np.nextafter(values.astype(np.float32), np.float32(-np.inf)).view(np.int32).astype(np.int64)
    bits ^= (bits >> 63) & 0x7FFFFFFF  # now in the order of the values
    keys = (rows << 32) + (bits + (1 << 31))
    keys.sort()
    counts = np.bincount(rows, minlength=n_rows)
    some = counts >= n
    bits = (keys[(np.cumsum(counts) - n)[some]] & 0xFFFFFFFF) - (1 << 31)
    bits ^= (bits >> 63) & 0x7FFFFFFF
    out = np.full(n_rows, -np.inf)
    out[some] = bits.astype(np.int32).view(np.float32)
    return out


def candidates(batches, n: int, known, low: float | None, high: float | None):
    """(id, words, title_tf, text_tf) to rows (id, word, title_tf, text_tf, idf) of all words that may be among a field's n best.

    known: (words, idf). Any other word's idf lies between low and high and is null here; where they are None there are no others.
    """
    yield from piece_candidates(packed(batches), n, known, low, high)


def piece_candidates(batches, n: int, known, low: float | None, high: float | None):
    """The same of pieces; a word is looked up once a piece."""
    told, idf = pa.array(known[0], pa.string()), np.append(known[1], np.nan)
    for ids, words, rows, codes, *tfs in _opened(batches):
        place = pc.fill_null(pc.index_in(words.cast(pa.string()), value_set=told), len(told)).to_numpy(zero_copy_only=False)
        value, known_here = idf[place][codes], (place < len(told))[codes]
        least, most = (value, value) if low is None else (np.where(known_here, value, low), np.where(known_here, value, high))
        keep = np.zeros(len(rows), bool)
        for tf in tfs:
            at = np.flatnonzero((tf > 0) & (known_here | (low is not None)))
            bar = _nth(rows[at], tf[at] * least[at], n, len(ids))
            keep[at] |= tf[at] * most[at] >= bar[rows[at]]
        kept = np.flatnonzero(keep)
        columns = [ids.take(pa.array(rows[kept])), words.take(pa.array(codes[kept])), *(pa.array(tf[kept], pa.int32()) for tf in tfs), pa.array(value[kept], mask=~known_here[kept])]
        yield pa.RecordBatch.from_arrays(columns, ["id", "word", "title_tf", "text_tf", "idf"])
