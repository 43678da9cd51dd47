"""WARC archives written and read back as a chunked record table.

Payloads of equal digest and length: the record of largest page_id is the response, the others are
revisits that refer to it. Payloads are never shuffled: each task writes its rows as they come to a
draft, all as responses, and only the records' places and digests are joined; then each draft is
copied, member by member, with a revisit's header in place of a payload that another record holds.

Archives are gzip members, a record each, in a folder that all executors share, under a name of
their own for each attempt; only those in the returned manifest (and drafts in the stored places)
count, so an attempt that was lost leaves nothing but an unread file. Payloads go through the
compressor and the digest in chunks.

Reading streams an archive into rows (record_id, chunk_no): each has at most `CHUNK` bytes of
payload, the digest of all bytes so far, and whether it is the last; no record is held whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CHUNK, LEAST_REVISIT = 1 << 20, 0
#: A payload with more than one in so many of the rows is hot.
HOT = 1000
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _sha1(h) -> str:
    return base64.b32encode(h.digest()).decode()


def _clean(s) -> str:
    """A header's value: no line ends, no control characters."""
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in s or "")


def _filesystem(uri: str):
    from pyarrow import fs

    uri = re.sub("^s3[an]:", "s3:", uri)
    return fs.FileSystem.from_uri(uri if re.match("[a-z0-9]+:", uri) else f"file://{uri}")


def record_urn(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>"


class _Archive:
    """A new archive of a task, made when its first record comes: gzip members, one for each record."""

    def __init__(self, folder: str):
        self.folder, self.out, self.records, self.bytes = folder, None, 0, 0

    def put(self, data) -> None:
        if self.out is None:
            from pyspark import TaskContext

            fs, root = _filesystem(self.folder)
            fs.create_dir(root, recursive=True)
            name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
            self.path, self.out = f"{self.folder}/{name}", fs.open_output_stream(f"{root}/{name}", compression=None)
        self.out.write(data)
        self.bytes += len(data)

    def record(self, page, url, digest: str, length: int, payload, refers=None) -> None:
        """One member: a response with its payload, in pieces, or with `payload` None a revisit."""
        block = memoryview(b"") if payload is None else payload
        head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {record_urn(page)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: text/html; charset=utf-8", f"X-Payload-Length: {length}"]
        head += [f"X-Page-ID: {page}"] if page is not None else []
        head += [f"WARC-Refers-To: {record_urn(refers)}", f"X-Refers-To-Page-ID: {refers}", f"WARC-Profile: {_PROFILE}"] if payload is None else []
        head += [f"Content-Length: {len(block)}", "", ""]
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        self.put(z.compress("\r\n".join(head).encode()))
        for a in range(0, len(block), CHUNK):
            self.put(z.compress(block[a : a + CHUNK]))
        self.put(z.compress(b"\r\n\r\n") + z.flush())
        self.records += 1

    def copy(self, stream, size: int) -> None:
        """A member as it stands in another archive."""
        while size:
            got = stream.read(min(size, CHUNK))
            if not got:
                raise ValueError("a draft ends inside a record")
            self.put(got)
            size -= len(got)
        self.records += 1


def draft(pages: DataFrame, folder: str) -> DataFrame:
    """Writes every row as a response, an archive a task, and returns the stored places of the records:
    (part, path, at, size, page_id, url, digest, bytes). Null html is the empty payload."""
    common.tune(pages.sparkSession)
    schema = "part long, path string, at long, size long, page_id long, url string, digest string, bytes long"

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        out, part = _Archive(folder), TaskContext.get().partitionId()
        for batch in batches:
            ids, urls, payloads = (batch.column(i) for i in range(3))
            rows = []
            for i in range(batch.num_rows):
                payload = memoryview(payloads[i].as_buffer() or b"")
                h = hashlib.sha1()
                for a in range(0, len(payload), CHUNK):
                    h.update(payload[a : a + CHUNK])
                page, url, digest, at = ids[i].as_py(), urls[i].as_py(), _sha1(h), out.bytes
                out.record(page, url, digest, len(payload), payload)
                rows.append((part, out.path, at, out.bytes - at, page, url, digest, len(payload)))
            if rows:
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in schema.split(", ")])
        if out.out:
            out.out.close()

    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    return common.stored(p.mapInArrow(run, schema), "drafts")


def plan(records: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """`records` (of `draft`) with refers_to: the response's page_id for a revisit, else null. A row that repeats the largest page_id is a
    response too, and null ids never answer for others. Payloads with over one in `HOT` of all rows, so fewer than `HOT` payloads, are
    broadcast; no key of the other join has more rows than that."""
    tops = records.where(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1")
    hot = F.col("n") * HOT > records.count()
    tops = common.stored(tops, "tops")
    few, rest = F.broadcast(tops.where(hot).select("digest", "top")), tops.where(~hot).select("digest", "top")
    d = records.join(few, "digest").unionByName(records.join(few, "digest", "left_anti").join(rest, "digest", "left"))
    return d.withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("top")), F.col("top"))).drop("top")


def settle(planned: DataFrame, folder: str) -> DataFrame:
    """Writes the drafts again with their revisits: a response's member is copied as it is. Returns the stored manifest: (path, records, bytes)."""
    parts = planned.agg(F.coalesce(F.max("part"), F.lit(0)).alias("n")).first()["n"] + 1
    planned = planned.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("path", "at")

    def run(batches):
        import pyarrow as pa

        out, path, stream = _Archive(folder), None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["path"] != path:
                    if stream:
                        stream.close()
                    path = r["path"]
                    fs, name = _filesystem(path)
                    stream = fs.open_input_stream(name, compression=None, buffer_size=CHUNK)
                if r["refers_to"] is None:
                    out.copy(stream, r["size"])
                else:
                    left = r["size"]
                    while left:
                        got = len(stream.read(min(left, CHUNK)))
                        if not got:
                            raise ValueError("a draft ends inside a record")
                        left -= got
                    out.record(r["page_id"], r["url"], r["digest"], r["bytes"], None, r["refers_to"])
        if out.out:
            stream.close()
            out.out.close()
            yield pa.RecordBatch.from_arrays([pa.array([out.path]), pa.array([out.records], pa.int64()), pa.array([out.bytes], pa.int64())], ["path", "records", "bytes"])

    return common.stored(planned.mapInArrow(run, "path string, records long, bytes long"), "manifest", keep=True)


def write(pages: DataFrame, folder: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes archives of all rows into `folder` and returns the stored manifest: (path, records, bytes). The drafts go."""
    spark = pages.sparkSession
    drafts = common.scratch(spark, "drafts")
    try:
        with common.temporary():
            return settle(plan(draft(pages, drafts), least), folder)
    finally:
        common.remove(spark, drafts)


def _records(stream):
    """(headers, piece of payload, whether last) from a gzip stream of records; pieces are at most CHUNK bytes."""
    z = zlib.decompressobj(31)
    raw = b""
    ended = False

    def more() -> bytes:
        nonlocal z, raw, ended
        while not ended:
            if z.eof:
                raw, z = z.unused_data or raw, zlib.decompressobj(31)
            if not raw:
                raw = stream.read(CHUNK)
                if not raw:
                    ended = True
                    break
            got = z.decompress(raw, CHUNK)
            raw = b"" if z.eof and not z.unused_data else z.unconsumed_tail
            if z.eof and z.unused_data:
                raw = z.unused_data
                z = zlib.decompressobj(31)
            if got:
                return got
        return b""

    held = b""
    while True:
        while b"\r\n\r\n" not in held:
            got = more()
            if not got:
                if held.strip():
                    raise ValueError("an archive ends inside a record's header")
                return
            held += got
        head, held = held.split(b"\r\n\r\n", 1)
        lines = head.decode().split("\r\n")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        left = int(headers["Content-Length"])
        first = True
        while left or first:
            while not held and left:
                held = more()
                if not held:
                    raise ValueError("an archive ends inside a payload")
            piece, held = held[: min(left, CHUNK)], held[min(left, CHUNK) :]
            left -= len(piece)
            first = False
            yield headers, piece, left == 0
        while len(held) < 4:
            got = more()
            if not got:
                raise ValueError("an archive ends inside a record")
            held += got
        held = held[4:]


def read(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """The chunked record table of all archives: record_id, chunk_no, page_id, url, record_type, refers_to, bytes_so_far, digest_so_far, header_digest, header_bytes, last, and chunk (null unless `payload`)."""
    schema = "record_id string, chunk_no int, page_id long, url string, record_type string, refers_to long, bytes_so_far long, digest_so_far string, header_digest string, header_bytes long, last boolean, chunk binary"

    def run(batches):
        import pyarrow as pa

        types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]
        names = [x.split()[0] for x in schema.split(", ")]
        rows: list = []
        held = 0

        def flush():
            cols = list(zip(*rows)) or [[] for _ in names]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
            rows.clear()
            return out

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = _filesystem(uri)
                with fs.open_input_stream(path, compression=None) as stream:
                    h, n, k = hashlib.sha1(), 0, 0
                    for head, piece, last in _records(stream):
                        h.update(piece)
                        n += len(piece)
                        number = lambda x: int(x) if x is not None else None
                        rows.append((head["WARC-Record-ID"], k, number(head.get("X-Page-ID")), head["WARC-Target-URI"], head["WARC-Type"], number(head.get("X-Refers-To-Page-ID")), n, _sha1(h), head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"]), last, piece if payload else None))
                        held += len(piece) if payload else 64
                        k += 1
                        if last:
                            if head["WARC-Type"] == "response" and (_sha1(h) != rows[-1][8] or n != rows[-1][9]):
                                raise ValueError(f"{head['WARC-Record-ID']} in {uri} is damaged")
                            h, n, k = hashlib.sha1(), 0, 0
                        if held > 4 * CHUNK or len(rows) >= 4096:
                            yield flush()
                            held = 0
        yield flush()

    n = max(1, manifest.count())  # an archive a task
    return manifest.select("path").repartition(n).mapInArrow(run, schema)


def round_trip(pages: DataFrame, folder: str | None = None, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes and reads back: page_id, payload_bytes, payload_digest, record_type, refers_to of every row of `pages`."""
    folder = folder or common.scratch(pages.sparkSession, "warc")
    chunks = read(write(pages, folder, least), payload=False)
    whole = chunks.where("last")
    seen = lambda a, b: F.when(F.col("record_type") == "response", F.col(a)).otherwise(F.col(b))
    return whole.select("page_id", seen("bytes_so_far", "header_bytes").alias("payload_bytes"), seen("digest_so_far", "header_digest").alias("payload_digest"), "record_type", "refers_to")
