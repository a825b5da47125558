"""Vectorised text scanning on UTF-8 bytes: words, byte-level pre-tokens and 64-bit span hashes, many documents at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: White space `[\x20\x09-\x0D]`.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True

#: Spans of more bytes are hashed by BLAKE2b.
LONG = 64
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ODD_SIZE, _ODD_LANE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, as a new array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, little-endian; beyond the end are zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hasher(data: np.ndarray):
    """A function of (starts, ends) that gives a 64-bit hash of each data[start:end]: its eight-byte lanes one after the other, each mixed in by a finaliser; spans of more than LONG bytes by BLAKE2b."""
    eight = lanes(data)

    def hash_(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        h = mix((eight[starts] & _KEEP[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * _ODD_SIZE))
        rest, k = np.flatnonzero(size > 8), 8
        while len(rest) and k < LONG:
            lane = eight[starts[rest] + k] & _KEEP[np.minimum(size[rest] - k, 8)]
            h[rest] = mix(h[rest] ^ (lane * _ODD_LANE + np.uint64(k)))
            k += 8
            rest = rest[size[rest] > k]
        for i in rest.tolist():
            h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
        return h

    return hash_


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hasher(data)(starts, ends)


def chunks(column, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of an Arrow string column: (first row, row after the last, bytes, offsets of the rows in them), each of about limit bytes, one row at least. Null counts as empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that aren't blank, no run over two rows; and the index of each row's first run, with the number of all at the end."""
    word = ~blank[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cut = offsets[1:-1]
    inner = cut[(cut > 0) & (cut < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


_O, _L, _N, _S = 0, 1, 2, 3
_SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    """Of each code point: letter, number, white space or other."""
    if not _classes:
        import regex

        t = np.zeros(0x110000, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((_L, r"\p{L}+"), (_N, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                a, b = m.span()
                t[a + 0x800 * (a >= 0xD800) : b + 0x800 * (b > 0xD800)] = kind
        t[_SPACES] = _S
        _classes.append(t)
    return _classes[0]


def _byte_classes(data: np.ndarray) -> np.ndarray:
    t = _class_table()
    cls = t[:256].copy()
    cls[128:] = _O
    cls = cls[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b = data[lead].astype(np.int32)
        pad = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
        n = 2 + (b >= 0xE0) + (b >= 0xF0)
        code = np.where(n == 2, (b & 31) << 6 | pad[lead + 1] & 63, np.where(n == 3, (b & 15) << 12 | (pad[lead + 1] & 63) << 6 | pad[lead + 2] & 63, (b & 7) << 18 | (pad[lead + 1] & 63) << 12 | (pad[lead + 2] & 63) << 6 | pad[lead + 3] & 63))
        c = t[code]
        for k in range(4):
            own = n > k
            cls[lead[own] + k] = c[own]
    return cls


def pretoken_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the matches of the byte-level pattern (contractions, optional space with letters, numbers or others, white space), in order; each match ends where the next one or its row ends."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    cls = _byte_classes(data)
    row = np.zeros(n, bool)
    row[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    run = row.copy()
    run[1:] |= cls[1:] != cls[:-1]
    start = run.copy()
    i = np.flatnonzero(run[1:] & ~row[1:] & (cls[1:] != _S) & (cls[:-1] == _S)) + 1  # words after white space
    spaced = data[i - 1] == 0x20
    start[i[spaced]] = False
    start[i[spaced] - 1] = True
    k = i[~spaced] - 1  # the last white space stands alone
    while (more := (data[k] & 0xC0) == 0x80).any():
        k = k - more
    start[k] = True
    q = np.flatnonzero((data[:-1] == 0x27) & start[:-1] & ~row[1:])
    if len(q):
        a = data[q + 1]
        pad = np.concatenate([data, np.zeros(2, np.uint8)])
        b = np.where(np.concatenate([row, np.ones(2, bool)])[q + 2], 0, pad[q + 2])
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C)
        for hit, size in ((q[one], 1), (q[two & ~one], 2)):
            start[hit + 1] = False
            after = hit + 1 + size
            after = after[after < n]
            start[after[(cls[after] == _L)]] = True
    return np.flatnonzero(start)


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the slices start, start + 1, ..., one slice after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    base = starts - np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return np.repeat(base, lengths) + np.arange(total)
