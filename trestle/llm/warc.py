"""WARC archives: written with one gzip member a record, and read back sequentially.

The reader takes the bytes as they come: zlib inflates them piece by piece, a member at a time; the header ends at an empty
line, Content-Length frames the block, and the block's and the payload's digests are computed on the way and compared
with the header's. It holds one piece at a time, however long a record is.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded, partitions, shared_dir, slices, written

# The format's version line and the profile of a revisit of an identical payload.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes that are read, and inflated, at once; and those after which a writer begins another archive.
PIECE, ARCHIVE = 1 << 16, 256 << 20
#: The most bytes of a record's header, and of the head of an HTTP message.
HEAD = 1 << 20


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, name: str, uri: str, date: str, payload: bytes, of: str, extra: dict[str, str]) -> bytes:
    """A record as a gzip member. of: the payload's digest; a revisit holds the head of the response only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{name}>", "WARC-Date": date, "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{of}", "WARC-Block-Digest": f"sha1:{digest(block)}", **extra, "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    text = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return squeeze.compress(text.encode() + block + b"\r\n\r\n") + squeeze.flush()


class BadRecord(ValueError):
    """The archive isn't what its headers say."""


def records(read: Callable[[int], bytes], payload: Callable[[bytes], None] | None = None) -> Iterator[dict[str, str]]:
    """The header fields (names in lower case) of each record, with payload-bytes and payload-sha1 of what its block held.

    read(n): up to n further bytes of the archive, none at its end. payload: is given each record's payload in pieces.
    """
    rest = b""
    while rest or (rest := read(PIECE)):
        inflate = zlib.decompressobj(31)

        def more(inflate=inflate) -> bytes:
            """The next inflated piece of this member; none at its end."""
            nonlocal rest
            while not inflate.eof:
                if not (given := inflate.unconsumed_tail or rest or read(PIECE)):
                    raise BadRecord("the archive ends within a member")
                rest = b""
                if out := inflate.decompress(given, PIECE):
                    return out
            return b""

        have = b""
        while b"\r\n\r\n" not in have:
            if not (piece := more()):
                raise BadRecord("a member without a header")
            have += piece
            if len(have) > HEAD + PIECE:
                raise BadRecord("a header that doesn't end")
        head, have = have.split(b"\r\n\r\n", 1)
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise BadRecord(f"a record begins with {version[:20]!r}")
        fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        left = int(fields["content-length"])
        block, body, size, http = hashlib.sha1(), hashlib.sha1(), 0, b"" if "msgtype=" in fields.get("content-type", "") else None
        while left:
            if not have and not (have := more()):
                raise BadRecord("a block shorter than its Content-Length")
            piece, have = have[:left], have[left:]
            left -= len(piece)
            block.update(piece)
            if http is not None:  # still in the head of the HTTP message
                http += piece
                if b"\r\n\r\n" not in http:
                    if len(http) > HEAD:
                        raise BadRecord("a head of a message that doesn't end")
                    continue
                piece, http = http.split(b"\r\n\r\n", 1)[1], None
            body.update(piece)
            size += len(piece)
            if payload and piece:
                payload(piece)
        while piece := more():
            have += piece
        if have != b"\r\n\r\n":
            raise BadRecord("a block longer than its Content-Length")
        rest = inflate.unused_data + rest
        said = {k: f"sha1:{base64.b32encode(h.digest()).decode()}" for k, h in (("block", block), ("payload", body))}
        if fields.get("warc-block-digest", said["block"]) != said["block"]:
            raise BadRecord("a block that doesn't match its digest")
        if fields["warc-type"] != "revisit" and fields.get("warc-payload-digest", said["payload"]) != said["payload"]:
            raise BadRecord("a payload that doesn't match its digest")
        fields |= {"payload-bytes": str(size), "payload-sha1": said["payload"][5:]}
        yield fields


def revisits(pages: DataFrame, id: str, payload: str, least: int) -> DataFrame:
    """_id and _refers, a map from a payload's digest to the largest id of those with it, for rows with smaller ids."""

    def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(parts, "_text"):
            data = [(t or "").encode() for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(map(digest, data), pa.string()), pa.array(map(len, data), pa.int64())], ["_id", "digest", "size"])

    rows = bounded(pages).select(F.col(id).alias("_id"), F.col(payload).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    seen = written(rows.mapInArrow(hashed, f"_id {kind}, digest string, size long").where((F.col("size") >= least) & F.col("_id").isNotNull()))
    last = written(seen.groupBy("digest").agg(F.max("_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n"))
    again = seen.join(last, "digest").where("_id < last").select("_id", "digest", "last").distinct()
    return again.groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("digest", "last"))).alias("_refers"))


def write_archives(pages: DataFrame, to: str, id: str = "page_id", payload: str = "html", uri: str = "url", least: int = 0, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each row into archives in the folder to; returns path and records of each, as a table.

    Of rows with equal payloads of at least `least` bytes the one with the largest id is a response, and those with smaller ids are revisits of it.
    A null payload is empty, a null uri made up from the id; a row with a null id is a response. Repeated rows of the largest id are all responses.
    An archive's name has a part that no other attempt shares, and only finished ones are returned: a task that runs again leaves no
    record twice. to: any place that pyarrow's file systems reach from the executors.
    """
    rows = bounded(pages).select(F.col(id).alias("_id"), F.col(payload).alias("_text"), F.col(uri).alias("_uri"))
    refers = revisits(pages, id, payload, least)
    rows = rows.join(refers, "_id", "left").select(F.col("_id").cast("string").alias("_id"), "_text", "_uri", F.expr("transform(map_entries(_refers), x -> struct(x.key AS k, cast(x.value AS string) AS v))").alias("_refers"))

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(to)
        system.create_dir(base, recursive=True)
        done, out, path, n, size = [], None, "", 0, 0
        space = uuid.UUID(int=0)
        for b in slices(parts, "_text"):
            for i, t, u, r in zip(*(b.column(c).to_pylist() for c in ("_id", "_text", "_uri", "_refers")), strict=True):
                data = (t or "").encode()
                of = digest(data)
                last = {x["k"]: x["v"] for x in r or ()}.get(of)
                extra = {"X-Page-ID": i} if i is not None else {}
                if last is not None:
                    extra |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:uuid:{uuid.uuid5(space, f'{last} {of}')}>", "X-Refers-To-Page-ID": last, "X-Payload-Bytes": str(len(data))}
                where = quote(u, safe=":/?#[]@!$&'()*+,;=%~") if u else f"urn:page:{i}"
                made = record("response" if last is None else "revisit", str(uuid.uuid5(space, f"{i} {of}")), where, date, data, of, extra)
                if out is None:
                    path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    out = system.open_output_stream(path, compression=None)
                out.write(made)
                n, size = n + 1, size + len(made)
                if size >= ARCHIVE:
                    out.close()
                    done.append((path, n))
                    out, n, size = None, 0, 0
        if out is not None:
            out.close()
            done.append((path, n))
        yield pa.RecordBatch.from_arrays([pa.array([f"{to.rstrip('/')}/{p.rsplit('/', 1)[1]}" for p, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], ["path", "records"])

    return written(rows.mapInArrow(write, "path string, records long"))


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record of the archives in the column path: record_type, id, payload_bytes, payload_digest, refers_to, uri (ids as text).

    Of a revisit, size and digest are those its header gives of the full payload. A record that isn't what its header says fails the job.
    """

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_type", "id", "payload_bytes", "payload_digest", "refers_to", "uri"]
        for b in parts:
            for path in b.column("path").to_pylist():
                system, at = fs.FileSystem.from_uri(path)
                rows = []
                with system.open_input_stream(at, compression=None) as f:
                    for r in records(f.read):
                        full = r["warc-type"] != "revisit"
                        rows.append((r["warc-type"], r.get("x-page-id"), int(r["payload-bytes" if full else "x-payload-bytes"]), r["payload-sha1"] if full else r["warc-payload-digest"][5:], r.get("x-refers-to-page-id"), r["warc-target-uri"]))
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 2 else pa.string()) for k, c in enumerate(zip(*rows, strict=True))], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 2 else pa.string()) for k, c in enumerate(zip(*rows, strict=True))], names)

    paths = archives.select("path").repartition(partitions(archives.sparkSession), "path")
    return paths.mapInArrow(read, "record_type string, id string, payload_bytes long, payload_digest string, refers_to string, uri string")


def round_trip(pages: DataFrame, id: str = "page_id", **how) -> DataFrame:
    """What the archives of pages hold: id, payload_bytes, payload_digest, record_type, refers_to of each row."""
    kind = pages.schema[id].dataType
    found = read_archives(write_archives(pages, shared_dir(pages.sparkSession), id, **how))
    return found.select(F.col("id").cast(kind).alias(id), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
