"""WARC archives: a writer with revisit records, a normaliser for monolithic gzip files, and a reader by offset index.

The normaliser inflates a whole-file stream once, rewrites every record as a gzip member of its own and writes a sidecar
index, a JSON line a record: offset, length, id, type, uri, digest. Bodies pass through in pieces, so a record of any
size takes bounded memory. A cut-off or malformed file raises ValueError.

Of rows with equal payloads of `least` bytes or more, that with the smallest key is a response, others are revisits that
refer to it (rows equal in key and payload too are all responses); smaller payloads and rows without a key are always
responses. Null html is the empty payload. Files are written under private names and moved into place, so a task that is
run again replaces whole files.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, open_fs, scratch, ship

PIECE = 1 << 16
END = b"\r\n\r\n"


def record(key: object, url: str | None, payload: bytes, digest: str, refers_to: object | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A response or revisit record, not compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is None:
        block, kind = http + b"Content-Length: %d" % len(payload) + END + payload, "response"
    else:
        block, kind = http + END[2:], "revisit"
    uri = quote(url, safe=":/?#[]@!$&'()*+,;=%-._~") if url else f"urn:page:{key}"
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{key}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"X-Payload-Length: {len(payload)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def headers_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def inflate(source, piece: int = PIECE) -> Iterator[bytes]:
    """The bytes of a gzip file of one member or more, in pieces."""
    z, any_data = zlib.decompressobj(31), False
    while data := source.read(piece):
        data = bytes(data)
        while data:
            if out := z.decompress(data):
                yield out
            data, any_data = z.unused_data, not z.eof
            if z.eof:
                z = zlib.decompressobj(31)
    if any_data:
        raise ValueError("the gzip stream is cut off")


def normalise(source, target, level: int = 6) -> Iterator[dict]:
    """Rewrite an open monolithic (or any) WARC gzip file as one member a record; yields the index entries."""
    stream, buffer, offset = inflate(source), bytearray(), 0

    def fill() -> bool:
        piece = next(stream, None)
        if piece is None:
            return False
        buffer.extend(piece)
        return True

    while True:
        while (cut := buffer.find(END)) < 0:
            if not fill():
                if bytes(buffer).strip():
                    raise ValueError("a record's head is cut off")
                return
        head = bytes(buffer[:cut])
        h = headers_of(head.lstrip())
        todo = int(h["content-length"]) + len(END)
        del buffer[: cut + len(END)]
        z, size = zlib.compressobj(level, zlib.DEFLATED, 31), 0
        pending = [z.compress(head + END)]
        while todo:
            if not buffer and not fill():
                raise ValueError("a record is cut off")
            part = bytes(buffer[:todo])
            del buffer[: len(part)]
            todo -= len(part)
            pending.append(z.compress(part))
            if len(pending) > 8:
                size += target.write(b"".join(pending)) or sum(map(len, pending))
                pending = []
        pending.append(z.flush())
        size += target.write(b"".join(pending)) or sum(map(len, pending))
        yield {"offset": offset, "length": size, "id": h.get("warc-record-id"), "type": h.get("warc-type"), "uri": h.get("warc-target-uri"), "digest": h.get("warc-payload-digest")}
        offset += size


def normalise_file(source: str, target: str, level: int = 6) -> int:
    """normalise() from file to file, with the index at target + ".idx"; both appear only when they are complete. The number of records."""
    filesystem, src = open_fs(source)
    out_fs, dst = open_fs(target)
    part = f"{dst}.{uuid.uuid4().hex}.part"
    n = 0
    with filesystem.open_input_file(src) as f, out_fs.open_output_stream(part, compression=None) as out, out_fs.open_output_stream(part + ".idx", compression=None) as index:
        for entry in normalise(f, out, level):
            index.write(json.dumps(entry).encode() + b"\n")
            n += 1
    out_fs.move(part + ".idx", dst + ".idx")
    out_fs.move(part, dst)
    return n


def read_record(f, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of the member at offset of an open file."""
    f.seek(offset)
    data = zlib.decompress(f.read(length), 31)
    head, _, rest = data.partition(END)
    h = headers_of(head)
    n = int(h["content-length"])
    if len(rest) != n + len(END):
        raise ValueError("a record's length is wrong")
    return h, rest[:n]


def write_archives(pages: DataFrame, out: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 100, archive_bytes: int = 64 << 20) -> DataFrame:
    """Write all rows under out; the manifest (path, n_records). Payload digests are grouped by partial aggregation on narrow rows."""
    import pyarrow as pa

    spark = pages.sparkSession
    ship(spark)
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    narrow = pages.select(F.col(key).cast("bigint").alias("_key"), F.sha2(F.encode(payload, "UTF-8"), 256).alias("_digest"), F.octet_length(payload).alias("_n")).where(F.col("_n") >= least)
    first = narrow.groupBy("_digest").agg(F.min("_key").alias("_refers"), F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    revisits = materialize(narrow.join(first, "_digest").where("_key <> _refers").select("_key", F.col("_digest").alias("_same"), "_refers").distinct(), "revisits")
    rows = pages.select(F.col(key).cast("bigint").alias("_key"), F.col(url).cast("string").alias("_url"), payload.alias("_html"), F.sha2(F.encode(payload, "UTF-8"), 256).alias("_digest"))
    rows = rows.join(revisits, (rows["_key"] == revisits["_key"]) & (rows["_digest"] == revisits["_same"]), "left").select(rows["_key"], "_url", "_html", "_digest", "_refers")

    def run(batches):
        state = None
        name = uuid.uuid4().hex
        k = 0

        def close():
            nonlocal state, k
            filesystem, path, sink, z, _ = state
            sink.write(z.flush())
            sink.close()
            final = f"{out}/{name}-{k:05d}.warc.gz"
            n = normalise_file(f"{out}/{name}-{k:05d}.mono.gz", final)
            filesystem.delete_file(path)
            state, k = None, k + 1
            return pa.RecordBatch.from_pylist([{"path": final, "n_records": n}], pa.schema([("path", pa.string()), ("n_records", pa.int64())]))

        for b in batches:
            for page, target, text, digest, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state is None:
                    filesystem, path = open_fs(f"{out}/{name}-{k:05d}.mono.gz")
                    filesystem.create_dir(path.rpartition("/")[0], recursive=True)
                    state = [filesystem, path, filesystem.open_output_stream(path, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0]
                raw = record(page, target, text.encode(), digest, refers)
                state[2].write(state[3].compress(raw))
                state[4] += len(raw)
                if state[4] >= archive_bytes:
                    yield close()
        if state is not None:
            yield close()

    return materialize(rows.mapInArrow(run, "path string, n_records bigint"), "archives")


def read_archives(manifest: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to) of every record, by the index; digests of responses are computed anew and must agree."""
    import pyarrow as pa

    ship(manifest.sparkSession)
    schema = pa.schema([(key, pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    number = lambda urn: None if urn is None or urn.endswith(":None>") else int(urn[10:-1])

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                filesystem, p = open_fs(path)
                with filesystem.open_input_stream(p + ".idx", compression=None) as f:
                    entries = [json.loads(x) for x in f.read().splitlines()]
                rows = []
                with filesystem.open_input_file(p) as f:
                    for e in entries:
                        h, block = read_record(f, e["offset"], e["length"])
                        stated = h["warc-payload-digest"].removeprefix("sha256:")
                        if h["warc-type"] == "response":
                            body = block.partition(END)[2]
                            n, digest = len(body), hashlib.sha256(body).hexdigest()
                            if digest != stated:
                                raise ValueError(f"{path}: the payload of {e['id']} doesn't match its digest")
                        else:
                            n, digest = int(h["x-payload-length"]), stated
                        rows.append({key: number(h["warc-record-id"]), "payload_bytes": n, "payload_digest": digest, "record_type": h["warc-type"], "refers_to": number(h.get("warc-refers-to"))})
                        if len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    spread = manifest.select("path").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 2, "path")
    return spread.mapInArrow(run, f"`{key}` bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    return read_archives(write_archives(pages, scratch(pages.sparkSession, "warc"), key, url, html), key)
