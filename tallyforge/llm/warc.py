"""WARC archives: writer, and a reader that salvages what damaged archives still hold.

Writing: each task writes archive files of some SEGMENT bytes, one gzip member for each record, into a folder that
all executors share (any file system pyarrow opens by URI). Each attempt has files of its own names; the manifest
lists the files of the attempts that counted. Payloads that recur are stored once: the page with the smallest id
holds the payload in a response record, the others are revisit records that refer to it. Only ids and digests are
grouped and joined to find them, so a payload that a third of all pages share makes no large group; pages meet
their reference by page_id.

Reading: each file is read by one task, in blocks, record by record, so that a task holds a record and a few MB, not a
file; the time is linear in the file. A record of any type counts if its member inflates with a
right checksum, its block has the stated length, and block and payload have the digests that are stated, by the
algorithm they name (md5 and the SHAs, in hex or base32; others are not checked). The payload is what follows the HTTP
headers, or the whole block if it has none; payload_digest is its SHA-256, for revisits the digest they state. The
stated payload digests of revisits and of segments are of other bytes than theirs and are not checked. A member may
hold several records, which have its start and stop. After a failed check the reader searches for the next place
where a valid member or a version line starts, goes on there, and logs the bytes between as a gap. Archives may be
compressed or not.

Bounds of the reader, beyond which bytes are a gap: records and inflated members of LARGEST bytes, headers of
MOST_HEADERS bytes.

Cases: null html is an empty payload; null url leaves the header out; a null page_id is never referred to, but may
refer. Payloads under MIN_REVISIT bytes are always responses. Rows equal in page_id and payload are of one kind.
Empty tables and files give no rows. Columns other than page_id, url and html are not read, whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_dir, releasing, stage

SEGMENT = 16 << 20
#: Bytes read at a time, and kept ahead of a record's start; the most that a record, or a member inflated, may have; and that a record's headers may.
BLOCK, AHEAD, LARGEST, MOST_HEADERS = 4 << 20, 1 << 10, 1 << 30, 1 << 20
MIN_REVISIT = 100
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
RECORDS = "path string, start long, stop long, fault string, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"
_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
_MANIFEST, _RECORDS = (pa.schema([(n, _TYPES[t]) for n, t in map(str.split, ddl.split(", "))]) for ddl in (MANIFEST, RECORDS))
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_ALGORITHMS = {"md5", "sha1", "sha224", "sha256", "sha384", "sha512"}
_NAMESPACE = uuid.UUID(int=0)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}:{digest}')}>"


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None) -> bytes:
    """One record, not compressed. A revisit has the HTTP headers alone, whose Content-Length is the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _headers(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def _parse(data: bytes, at: int) -> tuple[dict, int]:
    """The record that starts at `at`, and where it ends. Raises ValueError if a check fails."""
    if not data.startswith(b"WARC/1.", at):
        raise (Cut if b"WARC/1.".startswith(data[at : at + 7]) else ValueError)("no version line")
    if (end := data.find(b"\r\n\r\n", at, at + MOST_HEADERS)) < 0:
        raise (Cut if len(data) < at + MOST_HEADERS else ValueError)("headers do not end")
    h = _headers(bytes(data[at:end]))
    if not (size := h.get("content-length", "")).isdigit():
        raise ValueError("no content length")
    stop = end + 4 + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise (Cut if stop + 4 > len(data) else ValueError)("block and length differ")
    if not re.fullmatch("[A-Za-z0-9!#$%&'*+.^_`|~-]+", kind := h.get("warc-type", "")):
        raise ValueError("no record type")
    block = bytes(data[end + 4 : stop])
    if not _holds(h.get("warc-block-digest"), block):
        raise ValueError("block and digest differ")
    head, payload = b"", block
    if h.get("content-type", "").lower().startswith("application/http") or block.startswith(b"HTTP/"):
        first, gap, rest = block.partition(b"\r\n\r\n")
        head, payload = (first, rest) if gap else (head, payload)
    http, stated = _headers(head), h.get("warc-payload-digest")
    if kind == "revisit":
        size = http.get("content-length", "")
        length, digest, payload = int(size) if size.isdecimal() and len(size) < 19 else 0, (stated or "").removeprefix("sha256:"), None
    else:
        length, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if "warc-segment-number" not in h and not _holds(stated, payload, digest):
            if "chunked" not in http.get("transfer-encoding", "").lower() or not _holds(stated, _joined(payload)):
                raise ValueError("payload and digest differ")
    return {"record_type": kind, "page_id": _number(h.get("x-page-id")), "url": h.get("warc-target-uri"), "payload_bytes": length, "payload_digest": digest, "refers_to": _number(h.get("x-refers-to-page-id")), "payload": payload}, stop + 4


def _number(x: str | None) -> int | None:
    return int(x) if x is not None and re.fullmatch("-?[0-9]{1,18}", x) else None


def _holds(stated: str | None, data: bytes, sha256: str | None = None) -> bool:
    """Have the bytes the digest `algorithm:value`? True if none is stated, or one of an unknown algorithm."""
    name, _, value = (stated or "").partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in _ALGORITHMS:
        return True
    value = value.strip()
    digest = bytes.fromhex(sha256) if name == "sha256" and sha256 else hashlib.new(name, data).digest()
    if value.lower() == digest.hex():
        return True
    try:
        return base64.b32decode(value.rstrip("=").upper() + "=" * (-len(value.rstrip("=")) % 8)) == digest
    except (binascii.Error, ValueError):
        return False


def _joined(body: bytes) -> bytes:
    """A chunked HTTP body without its chunk sizes, as far as it is one."""
    out, at = [], 0
    while m := re.compile(rb"([0-9A-Fa-f]{1,8})[^\r\n]*\r\n").match(body, at):
        size = int(m[1], 16)
        if not size:
            break
        out.append(body[m.end() : m.end() + size])
        at = m.end() + size + 2
    return b"".join(out)


class Cut(ValueError):
    """A check that failed where the bytes at hand end: more of them may mend it."""


class Feed:
    """A file's bytes from `base` on, as far as they have been read; read gives the next bytes, none at the end."""

    def __init__(self, read: Callable[[int], bytes]):
        self.read, self.data, self.base, self.ended = read, bytearray(), 0, False

    @classmethod
    def of(cls, data: bytes) -> Feed:
        feed = cls(lambda n: b"")
        feed.data, feed.ended = data, True
        return feed

    def more(self) -> None:
        """As many bytes again as there are, BLOCK at least."""
        block = self.read(max(BLOCK, len(self.data)))
        self.ended = not block
        self.data += block

    def drop(self, to: int) -> None:
        """Forget what lies before `to`, once that is worth a move."""
        if to - self.base >= BLOCK and not isinstance(self.data, bytes):
            del self.data[: to - self.base]
            self.base = to


def _at(data: bytes, at: int) -> tuple[list[dict], int]:
    """The records that start at `at`, several in a gzip member; gaps inside a member are among them."""
    if not data.startswith(b"\x1f\x8b", at):
        rec, stop = _parse(data, at)
        return [rec], stop
    # in steps, so that what follows the member is not copied for each
    z, plain, stop, step = zlib.decompressobj(31), [], at, 1 << 12
    with memoryview(data) as view:
        while not z.eof:
            if stop == len(data):
                raise Cut("member is cut off")
            if sum(map(len, plain)) > LARGEST:
                raise ValueError("member is too large")
            try:
                plain.append(z.decompress(view[stop : stop + step]))
            except zlib.error as e:
                raise ValueError(f"member: {e}") from e
            stop, step = min(len(data), stop + step) - len(z.unused_data), min(2 * step, 1 << 18)
    found = [{k: v for k, v in r.items() if k not in ("start", "stop")} for r in _scan(Feed.of(b"".join(plain)), _one, _VERSION)]
    if all("fault" in r for r in found):
        raise ValueError(found[0]["fault"] if found else "member is empty")
    return found, stop


def _one(data: bytes, at: int) -> tuple[list[dict], int]:
    rec, stop = _parse(data, at)
    return [rec], stop


def salvage(data: bytes | Callable[[int], bytes]) -> Iterator[dict]:
    """Records with start and stop, and gaps: start, stop and the fault that was found at the start. data: bytes, or a function that gives the next n bytes of a file."""
    return _scan(Feed(data) if callable(data) else Feed.of(data), _at, _START)


def _scan(feed: Feed, read: Callable[[bytes, int], tuple[list[dict], int]], begin: re.Pattern) -> Iterator[dict]:
    at, gap, fault = 0, None, ""
    while True:
        feed.drop(at)
        while not feed.ended and at + AHEAD > feed.base + len(feed.data):
            feed.more()
        here = at - feed.base
        if here >= len(feed.data):
            break
        try:
            recs, stop = read(feed.data, here)
        except ValueError as e:
            if isinstance(e, Cut) and not feed.ended and len(feed.data) - here <= LARGEST:
                feed.more()
                continue
            if gap is None:
                gap, fault = at, str(e)
            found = begin.search(feed.data, here + 1)
            # a start may lie across the end of what has been read
            at = feed.base + (found.start() if found else len(feed.data) if feed.ended else max(here + 1, len(feed.data) - 16))
            continue
        if gap is not None:
            yield {"start": gap, "stop": at, "fault": fault}
            gap = None
        stop += feed.base
        for rec in recs:
            yield rec | {"start": at, "stop": stop}
        at = stop
    if gap is not None:
        yield {"start": gap, "stop": feed.base + len(feed.data), "fault": fault}


def _rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def references(pages: DataFrame) -> DataFrame:
    """page_id, digest, refers_to of the pages whose payload another page with a smaller id holds."""
    p = pages.select("page_id", "digest", F.length(F.col("payload")).alias("n")).where(F.col("n") >= MIN_REVISIT)
    first = p.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1 AND refers_to IS NOT NULL").drop("c")
    return p.join(first, "digest").where("NOT (page_id <=> refers_to)").select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "refers_to").distinct()


def write_archives(pages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Write pages (page_id, url, html) as archives; return the manifest of the files (path, records, bytes)."""
    spark = pages.sparkSession
    p = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    refs = references(p)
    p = p.join(refs, F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("digest") == F.col("r_digest")), "left")
    p = p.select("page_id", "url", "payload", "digest", "refers_to")
    folder = new_dir(spark, "warc")

    @releasing
    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        out, name, n, size = None, "", 0, 0
        for batch in it:
            for row in batch.to_pylist():
                if out is None:
                    name, n, size = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                data = member(record(**row))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= segment:
                    out.close()
                    out = None
                    yield _rows([{"path": f"{folder}/{name}", "records": n, "bytes": size}], _MANIFEST)
        if out is not None:
            out.close()
            yield _rows([{"path": f"{folder}/{name}", "records": n, "bytes": size}], _MANIFEST)

    return stage(p.mapInArrow(write, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, payload: bool = False) -> DataFrame:
    """Rows of RECORDS for the files of a manifest: records have no fault, gaps have one and no record_type."""

    @releasing
    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path in batch.column("path").to_pylist():
                system, name = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with system.open_input_stream(name, compression=None) as f:
                    for r in salvage(f.read):
                        held += len(r.get("payload") or b"") if payload else 0
                        rows.append({k: v for k, v in r.items() if payload or k != "payload"} | {"path": path})
                        if len(rows) >= 2000 or held >= SEGMENT:
                            yield _rows(rows, _RECORDS)
                            rows, held = [], 0
                yield _rows(rows, _RECORDS)

    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(read, RECORDS)
