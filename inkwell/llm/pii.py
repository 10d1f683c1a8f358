"""Personal data by format-preserving Feistel pseudonyms.

Numbers and dates that pass their validation, and e-mail names, are permuted by a keyed Feistel network within the set of
values of the same format, so that a value has the same pseudonym in every document and the format stays valid: a card
number keeps its length, separators and a right check digit, a date stays a date. Nothing else of a text changes.

Null stays null, an empty text empty. A value may be its own pseudonym only as often as a random permutation has fixed
points; for the formats here that is at most once in tens of thousands of values, but for very short e-mail names.
"""

from __future__ import annotations

import hashlib
import re
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import extend

ROUNDS = 8
KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "date")


def _stream(key: bytes, text: bytes, size: int) -> bytes:
    """As many pseudo-random bytes of a keyed digest as are asked for."""
    if size <= 64:
        return hashlib.blake2b(text, key=key[:64], digest_size=size).digest()
    seed = hashlib.blake2b(text, key=key[:64]).digest()
    return b"".join(hashlib.blake2b(seed + k.to_bytes(8, "big"), key=key[:64]).digest() for k in range(-(-size // 64)))[:size]


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): a balanced Feistel network over bits, walked until it is in range."""
    if not 0 <= value < size:
        raise ValueError("value out of range")
    if size < 2:
        return value
    half = ((size - 1).bit_length() + 1) // 2
    mask = (1 << half) - 1
    width = (half + 7) // 8
    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS):
            digest = _stream(key, f"{tweak}:{size}:{r}:".encode() + right.to_bytes(width, "big"), width + 8)
            left, right = right, left ^ (int.from_bytes(digest, "big") & mask)
        value = left << half | right
        if value < size:
            return value


def permute_symbols(values: np.ndarray, sizes: np.ndarray, key: bytes, tweak: str) -> np.ndarray:
    """A keyed permutation of all rows with values[i] in range(sizes[i]): a Feistel network whose halves are added to symbol
    by symbol, all of a half each round, in time that follows the length."""
    out, cut = values.astype(np.uint64), len(values) // 2
    sizes = sizes.astype(np.uint64)
    head = f"{tweak}:{len(values)}:".encode() + hashlib.blake2b(sizes.astype(np.uint8).tobytes(), digest_size=16).digest()
    left, right = slice(0, cut), slice(cut, len(values))
    for r in range(ROUNDS):
        add = np.frombuffer(_stream(key, head + bytes([r]) + out[right].astype(np.uint8).tobytes(), 8 * max(1, left.stop - left.start)), np.uint64)
        if left.stop > left.start:
            out[left] = (out[left] + add % sizes[left]) % sizes[left]
        left, right = right, left
    return out.astype(np.int64)


def luhn_digit(digits: str) -> int:
    """The check digit that follows digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2 == 0:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return -total % 10


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _number(digits: str, key: bytes, tweak: str) -> str:
    return str(permute(int(digits), 10 ** len(digits), key, tweak)).zfill(len(digits))


def _card(text: str, key: bytes) -> str | None:
    d = _digits(text)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != int(d[-1]):
        return None
    body = _number(d[:-1], key, "card")
    return _refill(text, body + str(luhn_digit(body)))


def _iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


_IBAN_LENGTH = dict((x[:2], x[2:]) for x in "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20".split())


def _iban(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "")
    country, body = plain[:2], plain[4:]
    if _IBAN_LENGTH.get(country) != str(len(plain)) or _iban_check(country, body) != plain[2:4]:
        return None
    digits = _digits(body)
    body = _refill(body, _number(digits, key, "iban" + country)) if digits else body
    plain = country + _iban_check(country, body) + body
    it = iter(plain)
    return "".join(" " if c == " " else next(it) for c in text)


def _ssn(text: str, key: bytes) -> str | None:
    a, g, s = int(text[:3]), int(text[4:6]), int(text[7:])
    if a in (0, 666) or a > 899 or not g or not s:
        return None
    area = a - 1 - (a > 666)
    n = permute((area * 99 + g - 1) * 9999 + s - 1, 898 * 99 * 9999, key, "ssn")
    area, g, s = n // (99 * 9999), n // 9999 % 99 + 1, n % 9999 + 1
    return f"{area + 1 + (area >= 665):03d}{text[3]}{g:02d}{text[6]}{s:04d}"


_TWO = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())  # country codes of two digits


def _american(d: str) -> bool:
    return d[0] not in "01" and d[3] not in "01"


def _ten(d: str, key: bytes) -> str:
    """Ten digits; numbers that are valid in North America stay so."""
    if _american(d):
        n = permute((int(d[0]) - 2) * 8 * 10**8 + int(d[1:3]) * 8 * 10**6 + (int(d[3]) - 2) * 10**6 + int(d[4:]), 64 * 10**8, key, "phone1")
        return f"{n // (8 * 10**8) + 2}{n // (8 * 10**6) % 100:02d}{n // 10**6 % 8 + 2}{n % 10**6:06d}"
    while True:
        d = _number(d, key, "phone1")
        if not _american(d):
            return d


def _phone(text: str, key: bytes) -> str | None:
    """Separators are evidence enough, ten bare digits must be a valid North American number."""
    d = _digits(text)
    if text[0] != "+":
        if len(d) == 10 and (not text.isdigit() or _american(d)) or len(d) == 11:
            return _refill(text, d[:-10] + _ten(d[-10:], key))
        return None
    if not 8 <= len(d) <= 15:
        return None
    if d[0] == "1" and len(d) == 11:
        return _refill(text, "1" + _ten(d[1:], key))
    country = 1 if d[0] in "17" else 2 if d[:2] in _TWO else 3
    return _refill(text, d[:country] + _number(d[country:], key, "phone" + d[:country]))


def _ip(text: str, key: bytes) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    n = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, n.to_bytes(4, "big")))


_SPANS = ((1900, 2099), (1, 1899), (2100, 9999))  # a date stays in its span of years


def _date(text: str, key: bytes) -> str | None:
    """Days keep the order of their parts and whether they have leading zeros; read with the day first where both are possible."""
    sep = next(c for c in text if c in "-/.")
    words = text.split(sep)
    iso = len(words[0]) == 4
    parts = [int(x) for x in words]
    padded = all(len(w) > 1 for w in words)
    for y, m, d in ((0, 1, 2),) if iso else ((2, 1, 0), (2, 0, 1)):
        try:
            day = date(parts[y], parts[m], parts[d])
        except ValueError:
            continue
        first, last = next((date(a, 1, 1), date(z, 12, 31)) for a, z in _SPANS if a <= day.year <= z)
        month_first = m == 0
        while True:
            day = first + timedelta(permute((day - first).days, (last - first).days + 1, key, "date"))
            if not month_first or day.day > 12:  # else it would be read with the day first
                break
        out = [0, 0, 0]
        out[y], out[m], out[d] = day.year, day.month, day.day
        return sep.join(f"{v:04d}" if i == y else f"{v:02d}" if padded else str(v) for i, v in enumerate(out))
    return None


_CLASS, _VALUE, _SIZE = np.zeros(128, np.uint8), np.zeros(128, np.int64), np.zeros(128, np.int64)
for _base, _n in ((48, 10), (97, 26), (65, 26)):
    _CLASS[_base : _base + _n], _VALUE[_base : _base + _n], _SIZE[_base : _base + _n] = _base, range(_n), _n


def _email(text: str, key: bytes) -> str | None:
    name, domain = text.rsplit("@", 1)
    raw = np.frombuffer(name.encode(), np.uint8).copy()
    at = np.flatnonzero(_CLASS[raw])
    c = raw[at]
    raw[at] = permute_symbols(_VALUE[c], _SIZE[c], key, "email") + _CLASS[c]
    return raw.tobytes().decode() + "@" + domain


_MAKERS = {"email": _email, "iban": _iban, "card": _card, "ssn": _ssn, "phone": _phone, "ip": _ip, "date": _date}
_EDGE = r"(?![0-9A-Za-z])"
_PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}" + _EDGE,
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "date": r"(?<![0-9A-Za-z.\-/])(?:[0-9]{4}(?P<s1>[-/.])[0-9]{2}(?P=s1)[0-9]{2}|[0-9]{1,2}(?P<s2>[-/.])[0-9]{1,2}(?P=s2)[0-9]{4})(?![0-9A-SU-Za-z]|T(?![0-9]))",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}" + _EDGE,
    "phone": r"(?<![0-9A-Za-z+])(?:(?:(?:\+[0-9]{1,3}|1)[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[1-9][0-9]{0,2}(?:[ .-]?\([0-9]{1,5}\))?(?:[ .-]?[0-9]){4,14}|(?<!\.)[2-9][0-9]{2}[2-9][0-9]{6}(?!\.[0-9]))" + _EDGE,
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}" + _EDGE,
}
_ONE = {k: re.compile(p) for k, p in _PATTERNS.items()}
_FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _PATTERNS.items()))
_PART = re.compile(r"[0-9]+")


def _shorter(kind: str, old: str):
    """A match, then what it may have swallowed more than: its beginnings, longest first, that end where a group of digits does."""
    yield old
    if kind == "iban":
        size, ends = int(_IBAN_LENGTH.get(old[:2], 0)), [i + 1 for i, c in enumerate(old) if c != " "]
        if 0 < size < len(ends) and old[ends[size - 1]] == " ":
            yield old[: ends[size - 1]]
    elif kind == "card" or kind == "phone" and old[0] == "+":
        for m in reversed(list(_PART.finditer(old))[:-1]):
            yield old[: m.end()]


def _at(text: str, start: int, first: str, key: bytes):
    """(kind, match, pseudonym) of the first kind, from `first` on, that has a valid value beginning at start."""
    kinds = list(_PATTERNS)
    for kind in kinds[kinds.index(first) :]:
        m = _ONE[kind].match(text, start)
        for old in _shorter(kind, m.group()) if m else ():
            new = _MAKERS[kind](old, key)
            if new is not None:
                return kind, old, new
    return None


_MAYBE = re.compile(r"[0-9@]")


def pseudonymise(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """(text with pseudonyms, how many of each kind)."""
    counts: dict[str, int] = {}
    if not _MAYBE.search(text):
        return text, counts
    out, done, at = [], 0, 0
    while m := _FIND.search(text, at):
        found = _at(text, m.start(), m.lastgroup, key)
        if found is None:  # what begins later may still be one
            at = m.start() + 1
            continue
        kind, old, new = found
        counts[kind] = counts.get(kind, 0) + 1
        out += [text[done : m.start()], new]
        done = at = m.start() + len(old)
    return "".join([*out, text[done:]]), counts


def _run(key: bytes):
    def run(batches):
        for b in batches:
            texts, counts = [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                new, c = (None, {}) if t is None else pseudonymise(t, key)
                texts.append(new)
                counts.append(c)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(texts, pa.string()), *(pa.array([c.get(k, 0) for c in counts], pa.int64()) for k in KINDS)], [*b.schema.names[:-1], "__text", *(f"n_{k}" for k in KINDS)])

    return run


def pseudonyms(docs: DataFrame, key: bytes, text_col: str = "text", counts: bool = True) -> DataFrame:
    """docs with text_col rewritten, and the count of each kind as n_<kind>; no shuffle, one row per row, repeated ones alike.

    key: 16 to 64 secret bytes; who has them can undo the pseudonyms, and without the same ones no two runs agree.
    Columns of docs that have the name of a count are left out when counts are asked for.
    """
    if len(key) < 16:
        raise ValueError("the key must have 16 bytes at least")
    new = [f"n_{k}" for k in KINDS]
    keep = [c for c in docs.columns if c != text_col and not (counts and c in new)]
    hidden = {c: f"__k{i}" for i, c in enumerate(keep)}
    src = docs.select(*(F.col(f"`{c}`").alias(h) for c, h in hidden.items()), F.col(f"`{text_col}`").cast("string").alias("__text"))
    out = src.mapInArrow(_run(key), extend(src.schema, ", ".join(f"{c} bigint" for c in new)))
    order = [c for c in docs.columns if c == text_col or c in hidden]
    return out.select(*(F.col("__text" if c == text_col else hidden[c]).alias(c) for c in order), *(new if counts else []))
