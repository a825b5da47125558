"""Token-id files under Re-Pair grammar compression.

Texts are encoded with a `tokenizers` vocabulary, one end id follows each document, and the ids go to shard files in
ascending order of the key. In each shard, rounds replace the most frequent id pairs by nonterminals; no nonterminal
reaches over a document's end. A shard holds its rules, the expansion length of each symbol, the compressed sequence and
the documents' places, so any document or id range can be decoded without the rest.

Null and empty texts are the end id alone. Rows of equal keys are all kept, next to each other; rows without a key come last.
An empty table gives no file.
Other columns of the input are not read.

File: b"RPR1", uint32 length of the JSON header, header, then little-endian arrays in the header's order.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import WordTable
from .common import materialize, open_fs, scratch, ship, write_once
from .spans import gather


MAGIC = b"RPR1"


def repair(ids: np.ndarray, ends: np.ndarray, first: int, per_round: int = 6000, least: int = 12, gain: float = 0.04) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compress ids: (sequence, rules as pairs, ends of the documents in the sequence). Symbols from first on are nonterminals; rules only use earlier symbols.

    A round replaces up to per_round of the most frequent pairs that occur least times, the more frequent first where they
    overlap; rounds go on until no pair is so frequent or one shortens the sequence by less than the share gain.
    """
    seq, rules = ids.astype(np.int32), [np.zeros((0, 2), np.int32)]
    ends = ends.astype(np.int64)
    top, never, r = first, np.int32(1 << 30), 0
    while len(seq) > 1:
        # Pairs are counted in 2**20 slots, by another hash each round; a slot stands for one of its pairs.
        slot = seq[:-1].astype(np.uint32)
        slot *= np.uint32((0x9E3779B1 + 2 * r * 0x85EBCA6B) % (1 << 32))
        slot ^= slot >> np.uint32(15)
        slot += seq[1:].astype(np.uint32)
        slot *= np.uint32(0xC2B2AE35)
        slot >>= np.uint32(12)
        slot = slot.view(np.int32)
        cut = ends[ends > 0] - 1
        slot[cut[cut < len(slot)]] = 1 << 20  # a pair mustn't begin at a document's last id
        count = np.bincount(slot, minlength=(1 << 20) + 1)
        count[1 << 20] = 0
        bar = max(least, int(np.partition(count, -per_round)[-per_round]))
        cand = np.flatnonzero((count >= bar)[slot])
        own = slot[cand]
        stands = np.zeros((1 << 20) + 1, np.int32)
        stands[own] = cand
        first_of = stands[own]
        same = (seq[cand] == seq[first_of]) & (seq[cand + 1] == seq[first_of + 1])
        cand, own = cand[same], own[same]
        count = np.bincount(own, minlength=(1 << 20) + 1)
        order = np.argsort(-count, kind="stable")[:per_round]
        order = order[count[order] >= least]
        if not len(order):
            break
        priority = np.full((1 << 20) + 1, never, np.int32)
        priority[order] = np.arange(len(order), dtype=np.int32)
        at = np.full(len(seq) + 2, never, np.int32)  # shifted by one
        at[cand + 1] = priority[own]
        here = at[cand + 1]
        won = (here < at[cand]) & (here <= at[cand + 2]) & (here < never)
        take = cand[won]
        used, symbol = np.unique(here[won], return_inverse=True)
        chosen = stands[order[used]]
        rules.append(np.stack([seq[chosen], seq[chosen + 1]], 1))
        seq[take] = top + symbol
        keep = np.ones(len(seq), bool)
        keep[take + 1] = False
        ends = ends - np.searchsorted(take, ends - 1)  # a pair lies in one document
        small = len(take) < gain * len(seq)
        seq = seq[keep]
        top += len(used)
        r += 1
        if small:
            break
    return seq, np.concatenate(rules), ends


def expansions(rules: np.ndarray, first: int) -> list[np.ndarray]:
    """The ids that each nonterminal stands for."""
    out: list[np.ndarray] = []
    for a, b in rules.tolist():
        out.append(np.concatenate([out[x - first] if x >= first else np.array([x], np.int32) for x in (a, b)]))
    return out


def expand(seq: np.ndarray, whole: list[np.ndarray], first: int) -> np.ndarray:
    """whole: as expansions() gives."""
    table = np.concatenate([np.arange(first, dtype=np.int32), *whole])
    size = np.concatenate([np.ones(first, np.int64), np.fromiter(map(len, whole), np.int64, len(whole))])
    begin = np.cumsum(size) - size
    seq = seq.astype(np.int64)
    return table[gather(begin[seq], size[seq])]


def _packed(seq: np.ndarray) -> list[tuple[str, np.ndarray]]:
    """Symbols as their low 16 bits and a bit plane for each further bit."""
    planes = max(0, int(seq.max(initial=0)).bit_length() - 16)
    return [("low", (seq & 0xFFFF).astype("<u2")), *((f"high{k}", np.packbits((seq >> (16 + k) & 1).astype(bool))) for k in range(planes))]


def shard_bytes(keys: np.ndarray, named: np.ndarray, ids: np.ndarray, ends: np.ndarray, first: int) -> bytes:
    """named: whether each document has a key."""
    seq, rules, cut = repair(ids, ends, first)
    n = np.diff(np.concatenate([[0], ends]))
    size = np.fromiter(map(len, expansions(rules, first)), np.int64, len(rules))
    arrays = [("keys", keys.astype("<i8")), ("named", np.packbits(named)), ("n_ids", n.astype("<u4")), ("cut", cut.astype("<i8")), ("rules", rules.astype("<i4").ravel()), ("expansion", size.astype("<u4")), *_packed(seq)]
    header = json.dumps({"first": first, "arrays": [[k, a.dtype.str, len(a)] for k, a in arrays]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *(a.tobytes() for _, a in arrays)])


class Shard:
    """A shard file that is open for reading; decodes one document, a range of ids, or all."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token shard")
        (n,) = struct.unpack("<I", data[4:8])
        header = json.loads(data[8 : 8 + n])
        self.first, at, arrays = header["first"], 8 + n, {}
        for name, kind, size in header["arrays"]:
            arrays[name] = np.frombuffer(data, kind, size, at)
            at += arrays[name].nbytes
        self.keys, self.n_ids, self.cut, self.expansion = (arrays[k] for k in ("keys", "n_ids", "cut", "expansion"))
        self.named = np.unpackbits(arrays["named"], count=len(self.keys)).astype(bool)
        self.rules = arrays["rules"].reshape(-1, 2)
        self.whole = expansions(self.rules, self.first)
        self.seq = arrays["low"].astype(np.int32)
        for k in range(16):
            if f"high{k}" in arrays:
                self.seq |= np.unpackbits(arrays[f"high{k}"], count=len(self.seq)).astype(np.int32) << (16 + k)
        self.ends = np.cumsum(self.n_ids.astype(np.int64))

    def __len__(self) -> int:
        return len(self.keys)

    def all(self) -> np.ndarray:
        return expand(self.seq, self.whole, self.first)

    def document(self, i: int) -> np.ndarray:
        return expand(self.seq[self.cut[i - 1] if i else 0 : self.cut[i]], self.whole, self.first)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard; only the symbols that cover them are expanded."""
        if not hasattr(self, "_begin"):
            size = np.ones(len(self.seq), np.int64)
            long = self.seq >= self.first
            size[long] = self.expansion[self.seq[long].astype(np.int64) - self.first]
            self._begin = np.concatenate([[0], np.cumsum(size)])
        stop = min(stop, int(self._begin[-1]))
        if stop <= start:
            return np.zeros(0, np.int64)
        a, b = np.searchsorted(self._begin, start, "right") - 1, np.searchsorted(self._begin, stop, "left")
        return expand(self.seq[a:b], self.whole, self.first)[start - self._begin[a] : stop - self._begin[a]]


class _Library:
    """Ids of whole texts as the tokenizers library's encode(text, add_special_tokens=False) gives them.

    Of a byte-level BPE vocabulary without other settings, the library's model is called once for each distinct pre-token,
    between the added tokens of a text; of any other vocabulary, encode_batch() is called on the texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = t = Tokenizer.from_file(path)
        self.first = max([0, *t.get_vocab(with_added_tokens=True).values()]) + 1
        self.added = {x.content: i for i, x in t.get_added_tokens_decoder().items()}
        self.words = WordTable(self._model) if self._is_byte_level(json.loads(t.to_str())) else None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self._letters = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(rest)}

    @staticmethod
    def _is_byte_level(said: dict) -> bool:
        model, split = said["model"], said.get("pre_tokenizer") or {}
        plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        whole = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        bare = not any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in said.get("added_tokens") or ())
        return bool(plain and whole and bare) and not any(said.get(k) for k in ("normalizer", "truncation", "padding"))

    def _model(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tokenize, ids, n = self.tokenizer.model.tokenize, [], np.empty(len(size), np.int64)
        text, a = data.tobytes().decode("latin-1").translate(self._letters), 0
        for k, z in enumerate(np.cumsum(size).tolist()):
            own = [x.id for x in tokenize(text[a:z])]
            ids += own
            n[k] = len(own)
            a = z
        return np.array(ids, np.int32), n

    def encode_column(self, column):
        """The ids of each row of an Arrow string column; null counts as empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        column = column.fill_null("")
        if self.words is None:
            for at in range(0, len(column), 64):
                for x in self.tokenizer.encode_batch(column.slice(at, 64).to_pylist(), add_special_tokens=False):
                    yield np.array(x.ids, np.int32)
            return
        if not any(pc.any(pc.match_substring(column, x)).as_py() for x in self.added):
            yield from self.words.encode_column(column)
            return
        at = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        pieces, marks = [], []
        for t in column.to_pylist():
            parts = at.split(t)
            pieces += parts[::2]
            marks.append([np.array([self.added[x]], np.int32) for x in parts[1::2]])
        own = self.words.encode_column(pa.array(pieces, pa.string()))
        for mark in marks:
            row = [next(own)]
            for x in mark:
                row += [x, next(own)]
            yield np.concatenate(row)


_libraries: dict[str, _Library] = {}


def _library(path: str) -> _Library:
    if path not in _libraries:
        _libraries[path] = _Library(path)
    return _libraries[path]


def write_shards(docs: DataFrame, out: str, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int = 0, shard_ids: int = 4 << 20) -> DataFrame:
    """Write the shard files under out; the manifest: (shard long in order of the keys, path, n_docs, n_ids, start: ids in the shards before).

    The rows are range-partitioned and sorted by the key; a task writes a shard whenever it holds shard_ids ids. File names
    are unique to an attempt and the manifest is itself a committed table, so a retried task leaves at most an unread file.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    spark = docs.sparkSession
    ship(spark)

    def run(batches):
        import uuid

        library = _library(vocabulary)
        part, k, held, keys, rows = TaskContext.get().partitionId(), 0, 0, [], []

        def flush():
            ids = np.concatenate(rows)
            ends = np.cumsum([len(r) for r in rows])
            path = f"{out}/shard-{part:06d}-{k:06d}-{uuid.uuid4().hex}.rpr"
            size = write_once(path, [shard_bytes(np.array([x or 0 for x in keys], np.int64), np.array([x is not None for x in keys]), ids, ends, library.first)])
            return pa.RecordBatch.from_pylist([{"part": part, "k": k, "path": path, "n_docs": len(rows), "n_ids": len(ids), "n_bytes": size}], schema)

        end = np.array([end_id], np.int32)
        for b in batches:
            for x, row in zip(b.column(0).to_pylist(), library.encode_column(b.column(1)), strict=True):
                keys.append(x)
                rows.append(np.concatenate([row, end]))
                held += len(row) + 1
                if held >= shard_ids:
                    yield flush()
                    k, held, keys, rows = k + 1, 0, [], []
        if rows:
            yield flush()

    schema = pa.schema([("part", pa.int64()), ("k", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])
    ordered = docs.select(F.col(key).cast("bigint").alias(key), F.col(text).cast("string").alias(text)).repartitionByRange(F.col(key).asc_nulls_last()).sortWithinPartitions(F.col(key).asc_nulls_last())
    made = materialize(ordered.mapInArrow(run, "part bigint, k bigint, path string, n_docs bigint, n_ids bigint, n_bytes bigint"), "manifest")
    before = W.orderBy("part", "k")  # a row a shard file, not of the documents
    return made.select((F.row_number().over(before) - 1).cast("bigint").alias("shard"), "path", "n_docs", "n_ids", "n_bytes", (F.sum("n_ids").over(before) - F.col("n_ids")).alias("start"))


def read_shards(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the files alone."""
    import pyarrow as pa

    ship(manifest.sparkSession)

    def run(batches):
        from .common import read_all

        for b in batches:
            for m in b.to_pylist():
                s = Shard(read_all(m["path"]))
                ids = s.all().astype("<u4")
                ends = s.ends
                begin = ends - s.n_ids
                crc = [zlib.crc32(ids[a:z].tobytes()) for a, z in zip(begin.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(s.keys.astype(np.int64), mask=~s.named), pa.array(begin + m["start"]), pa.array(s.n_ids.astype(np.int64)), pa.array(crc, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])

    spread = manifest.select("path", "start").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, "path")
    return spread.mapInArrow(run, f"`{key}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write to the shared folder and read back."""
    return read_shards(write_shards(docs, scratch(docs.sparkSession, "tokens"), vocabulary, key, text), key)


def remove(uri: str) -> None:
    filesystem, path = open_fs(uri)
    filesystem.delete_dir(path)
