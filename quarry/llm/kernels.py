"""Vectorised kernels over the UTF-8 buffer of an Arrow string column.

Every kernel works on (data, offsets): one byte buffer that holds all texts of
a batch and the byte offsets of the texts in it. Nothing here loops over
characters or words in Python, and nothing looks across a text's border.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that a byte-level kernel handles at once; its temporary arrays take about 40 times this.
CHUNK_BYTES = 1 << 19


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit integers."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ordered combination of two 64-bit hashes."""
    return mix64(mix64(a + U64(0x9E3779B97F4A7C15)) ^ (b * U64(0xD6E8FEB86659FD93)))


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.array([], pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(wide)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def text_chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes each; a longer text is a range of its own."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


_TABLE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)


@functools.lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _power(base: int, n: int) -> np.ndarray:
    size = 1 << max(19, int(n).bit_length())
    return _powers(base, size)[:n]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased, other bytes as they are."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of every text, in order, and the index of each text's first word.

    A word is a maximal run of bytes other than space and 0x09-0x0D, the hash
    a 64-bit polynomial over the whole word. Returns (hashes, first) with
    len(first) = texts + 1.
    """
    parts, counts = [], np.zeros(len(offsets), np.int64)
    for a, b in text_chunks(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        raw = data[lo:hi]
        if lower:
            raw = lower_ascii(raw)
        n = len(raw)
        if not n:
            continue
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        starts_text = np.zeros(n + 1, bool)
        starts_text[offsets[a:b] - lo] = True
        begin = ~space
        begin[1:] &= space[:-1] | starts_text[1:n]
        ends = ~space
        ends[:-1] &= space[1:] | starts_text[1:n]
        s, e = np.flatnonzero(begin), np.flatnonzero(ends) + 1
        total = np.zeros(n + 1, U64)
        np.cumsum(_TABLE[raw] * _power(_P, n), out=total[1:])
        h = (total[e] - total[s]) * _power(_P_INV, n)[s]
        parts.append(mix64(h ^ ((e - s).astype(U64) * U64(0xA24BAED4963EE407))))
        counts[a + 1 : b + 1] = np.diff(np.searchsorted(s, offsets[a : b + 1] - lo))
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), np.cumsum(counts)


# ---- pieces of the byte-level tokenizers -------------------------------------------------

LETTER, NUMBER, SPACE, OTHER, ODD = 0, 1, 2, 3, 4


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point; ODD where libraries' Unicode tables may disagree."""
    out = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x30000):
        kind = unicodedata.category(chr(cp))
        if kind[0] == "L":
            out[cp] = LETTER
        elif kind[0] == "N":
            out[cp] = NUMBER
        elif kind in ("Cn", "Cs"):
            out[cp] = ODD
    out[0x30000:] = ODD
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x2000, 0x200B)]] = SPACE
    out[[0x1C, 0x1D, 0x1E, 0x1F, 0x180E, 0x200B, 0xFEFF]] = ODD
    return out


def split_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of the byte-level pattern start, and which texts are odd.

    The pattern is 's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?other+|\\s+(?!\\S)|\\s+.
    Returns the byte starts of all pieces of all texts, ascending (pieces cover
    the texts without gaps), and a flag per text that holds a character on
    whose class the libraries may differ; such a text is left to the library.
    """
    n = len(data)
    odd = np.zeros(len(offsets) - 1, bool)
    if not n:
        return np.zeros(0, np.int64), odd
    table = _classes()
    cls = table[:256].astype(np.uint8)[data]
    high = np.flatnonzero(data >= 0x80)
    cont = np.zeros(n, bool)
    if len(high):
        b0 = data[high]
        lead = b0 >= 0xC0
        at, b0 = high[lead], b0[lead].astype(np.uint32)
        cont[high[~lead]] = True
        pad = np.concatenate([data, np.zeros(3, np.uint8)])
        b1, b2, b3 = (pad[at + k].astype(np.uint32) & 0x3F for k in (1, 2, 3))
        cp = np.where(b0 < 0xE0, ((b0 & 0x1F) << 6) | b1, np.where(b0 < 0xF0, ((b0 & 0x0F) << 12) | (b1 << 6) | b2, ((b0 & 0x07) << 18) | (b1 << 12) | (b2 << 6) | b3))
        kinds = table[np.minimum(cp, 0x10FFFF)]
        cls[at] = kinds
        for k in (1, 2, 3):  # bytes that follow take the class of their character
            far = (b0 >= (0xC0, 0xE0, 0xF0)[k - 1]) & (at + k < n)
            cls[at[far] + k] = kinds[far]
    hit = np.flatnonzero(cls == ODD)
    if len(hit):
        odd[np.searchsorted(offsets, hit, "right") - 1] = True
    first = np.zeros(n + 1, bool)  # of a text
    first[offsets[:-1]] = True
    first[n] = True
    space = cls == SPACE
    start = first[:n].copy()
    start[1:] |= (cls[1:] != cls[:-1]) & ~cont[1:]
    # the last character of a run of white space before something else stands apart
    nxt = np.zeros(n, bool)
    nxt[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    last = np.flatnonzero(nxt)  # last byte of that character
    if len(last):
        back = last.copy()
        for _ in range(3):
            back = np.where(cont[back], back - 1, back)
        start[back] = True
        start[last[data[last] == 32] + 1] = False  # a blank joins what follows
    quote = np.flatnonzero((data == 39) & start)
    if len(quote):
        pad = np.concatenate([data, np.zeros(3, np.uint8)])
        ends = np.concatenate([first, np.ones(3, bool)])
        c1, c2 = pad[quote + 1], pad[quote + 2]
        one = np.isin(c1, np.frombuffer(b"stmd", np.uint8)) & ~ends[quote + 1]
        two = (((c1 == 114) & (c2 == 101)) | ((c1 == 118) & (c2 == 101)) | ((c1 == 108) & (c2 == 108))) & ~ends[quote + 1] & ~ends[quote + 2]
        for mask, size in ((one, 2), (two, 3)):
            q = quote[mask]
            for k in range(1, size):
                start[q + k] = False
            start[(q + size)[q + size < n]] = True
    return np.flatnonzero(start), odd


def spread(codes: np.ndarray, sizes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Indices that concatenate, for each code, the slice [begins, begins + sizes) of a flat array."""
    n = sizes[codes]
    total = int(n.sum())
    before = np.cumsum(n) - n
    return np.repeat(begins[codes] - before, n) + np.arange(total)
