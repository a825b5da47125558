"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A shard of the corpus is reduced to its distinct pre-tokens. An inverted index leads from a merge's rank to the positions
of its token pair in these words; the merges run in rank order, each over all its positions at once, and only the two
neighbours of a merged pair enter the index anew. Documents are then put together from their words' ids.

Null and empty texts have no ids. Whole texts of any length are encoded; repeated rows are encoded as often as they come.
Columns of the input with the names of result columns are replaced, other ones are kept where asked for.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .spans import LONG, chunks, gather, lanes, pretoken_starts, span_hashes

_NONE = np.int64(1 << 40)
#: Positions that are looked up at a time, and bytes of text that are scanned and whose new words are encoded together.
_PIECE, _SCAN, _GROUP = 1 << 18, 2 << 20, 24 << 20
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeReplay:
    """Applies the merges of a rank table to many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {ranks[t[:k]] << 20 | ranks[t[k:]]: r for t, r in ranks.items() if len(t) > 1 for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.values = np.append(keys[order], _NONE), np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], _NONE)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], _NONE)

    def encode(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """data: words one after another, size: the bytes of each. (ids of all words one after another, their number for each word). A word that is a token itself is that token."""
        begin = np.cumsum(size) - size
        raw, get = data.tobytes(), self.ranks.get
        whole = np.fromiter((get(raw[a:z], -1) for a, z in zip(begin.tolist(), (begin + size).tolist(), strict=True)), np.int64, len(size))
        n = len(data)
        tok = self.byte[data].astype(np.int32)
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        full = size > 0
        nxt[(begin + size - 1)[full]] = -1
        prv[begin[full]] = -1
        known = (whole >= 0) & full
        rest = np.ones(n, bool)
        rest[gather(begin[known], size[known])] = False
        tok[~rest] = -1
        tok[begin[known]] = whole[known]
        pending: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def index(pos: np.ndarray) -> None:
            if not len(pos):
                return
            r = self._rank(tok[pos], tok[nxt[pos]])
            hit = r < _NONE
            pos, r = pos[hit], r[hit]
            if not len(pos):
                return
            order = np.argsort(r, kind="stable")
            pos, r = pos[order], r[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            for rank, part in zip(r[np.concatenate([[0], cuts])].tolist(), np.split(pos, cuts), strict=True):
                if rank in pending:
                    pending[rank].append(part)
                else:
                    pending[rank] = [part]
                    heapq.heappush(heap, rank)

        for k in range(0, n, _PIECE):
            index((np.flatnonzero((rest & (nxt >= 0))[k : k + _PIECE]) + k).astype(np.int32))
        while heap:
            rank = heapq.heappop(heap)
            parts = pending.pop(rank)
            pos = np.unique(np.concatenate(parts)) if len(parts) > 1 else np.sort(parts[0])
            right = nxt[pos]
            live = (tok[pos] >= 0) & (right >= 0)
            pos, right = pos[live], right[live]
            if not len(pos):
                continue
            same = self._rank(tok[pos], tok[right]) == rank
            pos, right = pos[same], right[same]
            if not len(pos):
                continue
            if (pos[1:] == right[:-1]).any():  # overlaps: from the left
                keep, free = np.ones(len(pos), bool), -1
                for k, (p, q) in enumerate(zip(pos.tolist(), right.tolist(), strict=True)):
                    if p == free:
                        keep[k] = False
                    else:
                        free = q
                pos, right = pos[keep], right[keep]
            tok[pos], tok[right] = rank, -1
            after = nxt[right]
            nxt[pos] = after
            more = after >= 0
            prv[after[more]] = pos[more]
            before = prv[pos]
            index(np.concatenate([before[before >= 0], pos[more]]))
        ids = tok[tok >= 0]
        ends = np.concatenate([[0], np.cumsum(tok >= 0)])
        return ids.astype(np.int32), ends[begin + size] - ends[begin]


class WordTable:
    """Ids of the distinct pre-tokens that a task has met; it is emptied when it holds more than most.

    Words are looked up by hash and then compared byte by byte, so ids don't hang on the hash. encode: as MergeReplay.encode().
    """

    def __init__(self, encode, most: int = 1_200_000):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        none = np.zeros(0, np.int64)
        self.hashes, self.entry = np.zeros(0, np.uint64), none  # sorted; the word of each
        self.raw, self.begin, self.bytes = np.zeros(0, np.uint8), none, none
        self.ids, self.at, self.size = np.zeros(0, np.int32), none, none

    def encode_column(self, column) -> Iterator[np.ndarray]:
        """The ids of each text. The new words of some megabytes of text are encoded together."""
        group, size = [], 0
        for _, _, data, off in chunks(column, _SCAN):
            if not size and len(self.bytes) > self.most:
                self._clear()
            group.append(self._words(data, off))
            size += len(data)
            if size >= _GROUP:
                yield from self._rows(group)
                group, size = [], 0
        yield from self._rows(group)

    def _add(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> None:
        self.begin = np.concatenate([self.begin, len(self.raw) + np.cumsum(size) - size])
        self.raw = np.concatenate([self.raw, data[gather(starts, size)]])
        self.bytes = np.concatenate([self.bytes, size])

    def _words(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the word of each pre-token, the first pre-token of each row and the number of all)."""
        starts = pretoken_starts(data, off)
        size = np.diff(np.append(starts, len(data)))
        h, first, inverse = np.unique(span_hashes(data, starts, starts + size), return_index=True, return_inverse=True)
        near = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
        known = self.hashes[near] == h if len(self.hashes) else np.zeros(len(h), bool)
        entry = np.empty(len(h), np.int64)
        entry[known] = self.entry[near[known]]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            entry[fresh] = len(self.bytes) + np.arange(len(fresh))
            at = np.searchsorted(self.hashes, h[fresh])
            self.hashes, self.entry = np.insert(self.hashes, at, h[fresh]), np.insert(self.entry, at, entry[fresh])
            self._add(data, starts[first[fresh]], size[first[fresh]])
        word = entry[inverse]
        other = self._differing(data, starts, size, word)
        if len(other):  # words whose hash another word has
            own: dict[bytes, int] = {}
            for i in other.tolist():
                w = data[starts[i] : starts[i] + size[i]].tobytes()
                if w not in own:
                    own[w] = len(self.bytes)
                    self._add(data, starts[i : i + 1], size[i : i + 1])
                word[i] = own[w]
        return word.astype(np.int32), np.searchsorted(starts, off)

    def _differing(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Indices of the pre-tokens whose bytes aren't those of their word."""
        a, b, begin = lanes(data), lanes(self.raw), self.begin[word]
        bad = (size != self.bytes[word]) | ((a[starts] ^ b[begin]) & _KEEP[np.minimum(size, 8)] != 0)
        rest, k = np.flatnonzero((size > 8) & ~bad), 8
        while len(rest) and k < LONG:
            bad[rest] = (a[starts[rest] + k] ^ b[begin[rest] + k]) & _KEEP[np.minimum(size[rest] - k, 8)] != 0
            k += 8
            rest = rest[(size[rest] > k) & ~bad[rest]]
        for i in rest.tolist():
            bad[i] = not np.array_equal(data[starts[i] : starts[i] + size[i]], self.raw[begin[i] : begin[i] + size[i]])
        return np.flatnonzero(bad)

    def _rows(self, group: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
        done = len(self.size)
        if done < len(self.bytes):
            ids, size = self.encode(self.raw[self.begin[done] :], self.bytes[done:])
            self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(size) - size])
            self.ids, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.size, size])
        for word, cut in group:
            size = self.size[word]
            ids = self.ids[gather(self.at[word], size)]
            total = np.concatenate([[0], np.cumsum(size)])[cut]
            for a, b in zip(total[:-1].tolist(), total[1:].tolist(), strict=True):
                yield ids[a:b]


_tables: dict[str, tuple[WordTable, list[bytes]]] = {}


def _table_of(path: str) -> tuple[WordTable, list[bytes]]:
    if path not in _tables:
        ranks = read_ranks(path)
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            tokens[r] = t
        _tables[path] = WordTable(MergeReplay(ranks).encode), tokens
    return _tables[path]


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row. vocabulary: path of a rank file that every executor can read."""
    import pyarrow as pa

    ship(docs.sparkSession)
    kind = docs.schema[key].dataType

    def run(batches):
        words, _ = _table_of(vocabulary)
        for b in batches:
            rows = list(words.encode_column(b.column(1)))
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, np.int32), *rows]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=[key, "ids"])

    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind.simpleString()}, ids array<int>")


def decode(ids: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """(key, bytes binary) of the ids that encode() made; a null list gives empty bytes."""
    import pyarrow as pa

    ship(ids.sparkSession)
    kind = ids.schema[key].dataType

    def run(batches):
        _, tokens = _table_of(vocabulary)
        get = tokens.__getitem__
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([b"".join(map(get, x or ())) for x in b.column(1).to_pylist()], pa.binary())], names=[key, "bytes"])

    return ids.select(key, "ids").mapInArrow(run, f"`{key}` {kind.simpleString()}, bytes binary")


def digests(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Round trip of every row in one pass: (key, n_tokens long, ids_sha256, decoded_sha256), of the decimal ids joined by commas and of the bytes that the ids decode to."""
    import pyarrow as pa

    ship(docs.sparkSession)
    kind = docs.schema[key].dataType

    def run(batches):
        words, tokens = _table_of(vocabulary)
        decimal = [b"%d" % i for i in range(len(tokens))]
        number, piece = decimal.__getitem__, tokens.__getitem__
        for b in batches:
            n, ids, back = [], [], []
            for row in words.encode_column(b.column(1)):
                row = row.tolist()
                n.append(len(row))
                ids.append(hashlib.sha256(b",".join(map(number, row))).hexdigest())
                back.append(hashlib.sha256(b"".join(map(piece, row))).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
