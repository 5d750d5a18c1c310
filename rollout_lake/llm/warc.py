"""WARC archives: one gzip member a record, written by tasks and read back as a stream.

The reader decompresses a member at a time in small pieces, frames records by their content length and
holds both digests against the bytes it saw; it never holds more than a piece of a payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollout_lake.session import scratch_path

from .common import NO_ID, join_hot, written

PIECE = 1 << 16
ARCHIVE_BYTES = 64 << 20
"""Compressed size at which a task begins its next archive."""

LEAST_REVISIT = 1000
"""Payloads of fewer bytes are always written in full."""

DATE = "2024-01-01T00:00:00Z"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _plain(value: str) -> str:
    """A header value without control characters or blanks."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def _digest(hexed: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexed)).decode()


def _sha1_hex(header: str | None) -> str | None:
    """The SHA-1 that a header states in base32 or hexadecimal, as hexadecimal; None without one."""
    kind, _, value = (header or "").partition(":")
    value = value.strip()
    if kind.strip().lower() != "sha1" or not re.fullmatch(r"[A-Za-z2-7]{32}|[0-9A-Fa-f]{40}", value):
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def record(page: str, url: str | None, size: int, sha1: str, payload: bytes | None, refers_to: str | None) -> bytes:
    """One record as a gzip member; a revisit of ``refers_to`` if there is no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    target = _plain(url) if url else f"urn:page:{page}"
    headers = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <urn:page:{page}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: {_digest(sha1)}",
        f"WARC-Block-Digest: {_digest(hashlib.sha1(block).hexdigest())}",
    ]
    if refers_to:
        headers += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {SAME_PAYLOAD}"]
    headers += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    whole = "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return packer.compress(whole) + packer.flush()


class Headers(dict[str, str]):
    """Header fields by name, in any case of letters; of a name that is given twice the last one counts."""

    @classmethod
    def of(cls, lines: list[str], strict: bool = True) -> Headers:
        """Lines that begin with a blank go on the line before; others without a colon are damage, if strict."""
        made, name = cls(), ""
        for line in lines:
            if line[:1] in (" ", "\t") and name:
                made[name] += " " + line.strip()
            elif ":" in line:
                name, value = line.split(":", 1)
                name = name.strip().lower()
                made[name] = value.strip()
            elif line and strict:
                raise ValueError(f"not a header field: {line[:40]}")
        return made

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(name.lower())

    def __contains__(self, name: object) -> bool:
        return super().__contains__(str(name).lower())

    def get(self, name: str, default=None):
        return super().get(name.lower(), default)


def _agrees(stated: str | None, found: str) -> bool | None:
    """Whether a stated digest is the SHA-1 found; None without one, or of another kind."""
    value = _sha1_hex(stated)
    return None if value is None else value == found


@dataclass
class Record:
    """``http_size`` is the length that the HTTP header states, if any; ``verified`` is None where nothing can be held against the bytes."""

    headers: Headers
    http_size: int | None = None
    payload_bytes: int = 0
    payload_sha1: str = ""
    verified: bool | None = None
    payload: bytes | None = field(default=None, repr=False)


class Reader:
    """Records of any type from a stream of gzip members, one each, whoever wrote them.

    Only damage raises ``ValueError``: cut-off or malformed records. A ``warcinfo``, ``request``, ``metadata`` or other record
    is returned like a response, with the headers it has.
    """

    def __init__(self, stream, keep_payload: bool = False):
        self.stream, self.keep_payload = stream, keep_payload
        self.packed, self.buffer = b"", b""
        self.member = None

    def _more(self) -> bool:
        """Decompress a further piece of the current member; False at its end."""
        while True:
            if self.member is None or self.member.eof:
                return False
            pending = self.member.unconsumed_tail or self.packed or self.stream.read(PIECE)
            if not self.member.unconsumed_tail:
                self.packed = b""
            if not pending:
                raise ValueError("the archive ends within a record")
            piece = self.member.decompress(pending, PIECE)
            if self.member.eof:
                self.packed = self.member.unused_data
            if piece:
                self.buffer += piece
                return True

    def _until(self, mark: bytes) -> bytes:
        at = 0
        while (found := self.buffer.find(mark, max(0, at - len(mark)))) < 0:
            at = len(self.buffer)
            if not self._more():
                raise ValueError("a header has no end")
        head, self.buffer = self.buffer[:found], self.buffer[found + len(mark):]
        return head

    def _pieces(self, size: int) -> Iterator[bytes]:
        """Exactly ``size`` bytes, in pieces."""
        while size:
            if not self.buffer and not self._more():
                raise ValueError("a record is shorter than its content length")
            piece, self.buffer = self.buffer[:size], self.buffer[size:]
            size -= len(piece)
            yield piece

    def __iter__(self) -> Iterator[Record]:
        while self.packed or (piece := self.stream.read(PIECE)):
            self.packed = self.packed or piece
            self.member, self.buffer = zlib.decompressobj(31), b""
            yield self._record()

    def _record(self) -> Record:
        try:
            version, *lines = self._until(b"\r\n\r\n").decode("utf-8").split("\r\n")
            if not version.startswith("WARC/"):
                raise ValueError(f"not a record: {version[:20]}")
            made = Record(Headers.of(lines))
            size = int(made.headers["Content-Length"])
            block, payload, head, kept = hashlib.sha1(), hashlib.sha1(), b"", []
            http = made.headers.get("Content-Type", "").replace(" ", "").lower().startswith("application/http")
            in_payload = not http  # of other records the whole block is the payload
            for piece in self._pieces(size):
                block.update(piece)
                if not in_payload:
                    head += piece
                    if b"\r\n\r\n" not in head:
                        continue
                    head, piece = head.split(b"\r\n\r\n", 1)
                    in_payload = True
                    fields = Headers.of(head.decode("latin-1").split("\r\n")[1:], False)
                    if fields.get("Content-Length", "").isdigit():
                        made.http_size = int(fields["Content-Length"])
                payload.update(piece)
                made.payload_bytes += len(piece)
                if self.keep_payload:
                    kept.append(piece)
            while self._more():
                pass
            if self.buffer != b"\r\n\r\n":
                raise ValueError("a record does not end where its content length says")
        except (zlib.error, KeyError, IndexError, UnicodeDecodeError) as error:
            raise ValueError(f"malformed record: {error!r}") from error
        made.payload_sha1 = payload.hexdigest()
        made.payload = b"".join(kept) if self.keep_payload else None
        revisit = made.headers.get("WARC-Type") == "revisit"
        agree = [_agrees(made.headers.get("WARC-Block-Digest"), block.hexdigest())]
        if not revisit:  # a revisit's digest and length are those of the payload it leaves out
            agree += [_agrees(made.headers.get("WARC-Payload-Digest"), made.payload_sha1),
                      None if made.http_size is None else made.http_size == made.payload_bytes]
        known = [a for a in agree if a is not None]
        made.verified = all(known) if known else None
        return made


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def mark_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``id, url, html, size, sha1, keeper``: ``keeper`` is the largest id with an equal payload, null if written in full.

    Only payloads of at least ``least`` bytes that several rows hold meet the table of payloads; a
    payload that a third of the rows hold is dealt out.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.coalesce(F.col("page_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.col("url").cast("string").alias("url"),
        html.alias("html"), F.octet_length(html).cast("bigint").alias("size"), F.sha1(html).alias("sha1"),
    )
    repeated = rows.where(F.col("size") >= least).groupBy("sha1").agg(
        F.max("id").alias("keeper"), F.count(F.lit(1)).alias("n")
    ).where("n > 1").withColumnRenamed("sha1", "of")
    # a payload's length decides with its digest, so that short rows keep out of the join
    keyed = rows.withColumn("long_sha1", F.when(F.col("size") >= least, F.col("sha1")).otherwise(
        F.concat(F.lit("-"), F.col("id").cast("string"))
    ))
    return join_hot(keyed, written(repeated, "payloads"), [("long_sha1", "of")], "n").drop("long_sha1", "n")


MANIFEST = "path string, n_records long, n_bytes long"


def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages as archives below ``folder`` (shared by all executors) and return the written manifest.

    Each task writes files of its own, named anew at each attempt; only the manifest, committed with
    its table, says which ones count. A lost or repeated task leaves at most files that nothing lists.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    marked = mark_revisits(pages).select(
        F.col("id"), "url", "size", "sha1", F.when(F.col("keeper") != F.col("id"), F.col("keeper")).alias("refers"),
        F.when(F.col("keeper").isNull() | (F.col("keeper") == F.col("id")), F.encode("html", "UTF-8")).alias("payload"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = _file_system(folder)
        out, path, count, size = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for row in zip(*[batch.column(c) for c in ("id", "url", "size", "sha1", "payload", "refers")]):
                page, url, length, sha1, payload, refers = (v.as_py() for v in row)
                if out is None:
                    files.create_dir(top, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, out, count, size = f"{folder}/{name}", files.open_output_stream(f"{top}/{name}", compression=None), 0, 0
                coded = record(str(page), url, length, sha1, payload, None if refers is None else str(refers))
                out.write(coded)
                count, size = count + 1, size + len(coded)
                if size >= archive_bytes:
                    out.close()
                    done.append((path, count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, count, size))
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), *[pa.array([d[i] for d in done], pa.int64()) for i in (1, 2)]],
            names=["path", "n_records", "n_bytes"],
        )

    return written(marked.mapInArrow(write, MANIFEST), "warc-manifest")


RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, verified boolean"


def _page(uri: str | None) -> int | None:
    """The page that a record's name stands for; None for names of other writers."""
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return None if found is None or int(found[1]) == NO_ID else int(found[1])


def read_archives(manifest: DataFrame, keep_payload: bool = False) -> DataFrame:
    """The records of all archives of a manifest, one task for a run of archives.

    Columns as in ``RECORDS`` and, if asked, ``payload``. Size and digest are those of the full payload, for
    a revisit as its headers state them. ``verified`` is false where the bytes disagree with a digest, and null where
    a record states none. Records of other types and writers come through; their page ids are null.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]

        def batch_of() -> pa.RecordBatch:
            made = [pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))]
            rows.clear()
            return pa.RecordBatch.from_arrays(made, names=names)

        held = 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, inner = _file_system(path)
                with files.open_input_stream(inner, compression=None) as stream:
                    for r in Reader(stream, keep_payload):
                        revisit = r.headers.get("WARC-Type") == "revisit"
                        stated = _sha1_hex(r.headers.get("WARC-Payload-Digest")) if revisit else None
                        rows.append((
                            _page(r.headers.get("WARC-Record-ID")), r.headers.get("WARC-Target-URI"), r.headers.get("WARC-Type"),
                            r.http_size if revisit and r.http_size is not None else r.payload_bytes,
                            stated or r.payload_sha1,
                            _page(r.headers.get("WARC-Refers-To")) if revisit else None, r.verified, r.payload,
                        ))
                        held += len(r.payload or b"")
                        if len(rows) >= 5000 or held > (8 << 20):
                            held = 0
                            yield batch_of()
        yield batch_of()

    schema = RECORDS + (", payload binary" if keep_payload else "")
    n = max(1, manifest.count())
    return manifest.select("path").repartition(n, "path").mapInArrow(read, schema)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages and read them back: a row of ``RECORDS`` per page.

    Of records with equal payloads of at least ``LEAST_REVISIT`` bytes the one with the largest page id is the
    response and the others revisit it. Null html: empty payload. Null page ids: written as below all
    others, read back as null. Null url: the page's own name. Rows that repeat an id with an equal payload
    are all responses if theirs is the largest. Empty table: no archives, empty result.
    """
    return read_archives(write_archives(pages, folder))
