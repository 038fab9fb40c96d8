"""WARC archives: written as one gzip stream a file, then normalised to a gzip member a record with an offset index.

Each task writes its rows as archives of its own. The normaliser inflates a monolithic archive once, in pieces, and
holds one record at a time; it writes each record as its own gzip member and, beside the archive, a sidecar index
with a line "offset length page_id" for each. Readers seek by that index. Files have names of their own for each
attempt, and the list of those that count is a written table, so a repeated task does no harm.

Defined results: a null html is an empty payload, a null url an empty target; line ends in a url are percent-encoded.
Of records with equal payloads of min_revisit bytes or more, those with the smallest page_id are responses, others
revisit it (a null page_id counts as the largest); the payload's length and digest are in the header of either kind.
Every row has a record with an id of its own, repeated rows too; an empty table makes no archive. Other columns are not archived.
An archive that breaks off or is damaged is normalised up to the last whole record and marked as damaged; zero bytes behind a
gzip member are padding. archived() refuses damage, as it would lose rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, shared_dir, written

GZIP = 31  # zlib's window bits for a gzip wrapper
PIECE = 1 << 20
INDEX = ".idx"


class Damaged(ValueError):
    """An archive that breaks off or holds no records."""


def marked(pages: DataFrame, *, min_revisit: int = 100) -> DataFrame:
    """page_id, url, html and digest, with refers_to: the page that holds the same payload, null for responses."""
    df = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    df = df.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    long = df.where(F.octet_length("html") >= min_revisit)
    # written, so that the join reads a plain table: broadcast if it is small, else Spark can split a frequent payload
    first = written(long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    df = df.join(first, "digest", "left")
    return df.select("page_id", "url", "html", "digest", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("refers_to"))


def record(page_id, url, html: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC record; a revisit has no block."""
    kind = "response" if refers_to is None else "revisit"
    block = b"" if kind == "revisit" else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n%b" % (len(html), html)
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>",
        "WARC-Date": date,
        "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Payload-Length": len(html),
        "Page-ID": "" if page_id is None else page_id,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    if refers_to is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "Refers-To-Page": refers_to}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def header(raw: bytes) -> dict[str, str]:
    version, *lines = raw.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise Damaged(f"no WARC record: {version[:40]!r}")
    return dict(x.split(": ", 1) for x in lines if x)


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, whole record) out of a stream of bytes, holding one record and one piece at a time."""
    rest = bytearray()
    pieces = iter(pieces)

    def fill(n: int) -> bool:
        while len(rest) < n:
            if (x := next(pieces, None)) is None:
                return False
            rest.extend(x)
        return True

    while fill(1):
        seen = 0
        while (end := rest.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(rest) - 3)
            if not fill(len(rest) + 1):
                raise Damaged("a record's header doesn't end")
        head = header(bytes(rest[:end]))
        size = end + 4 + int(head["Content-Length"]) + 4
        if not fill(size):
            raise Damaged("a record's block doesn't end")
        yield head, bytes(rest[:size])
        del rest[:size]


def inflated(stream) -> Iterator[bytes]:
    """The bytes behind a gzip file of one or more members, in bounded pieces."""
    unzip, raw, fresh = zlib.decompressobj(GZIP), b"", True
    while raw or (raw := stream.read(PIECE)):
        if fresh and not (raw := raw.lstrip(b"\0")):  # padding
            continue
        try:
            out = unzip.decompress(raw, PIECE)
        except zlib.error as e:
            raise Damaged(str(e)) from e
        raw, fresh = unzip.unconsumed_tail or unzip.unused_data, False
        if out:
            yield out
        if unzip.eof:
            unzip, fresh = zlib.decompressobj(GZIP), True
    if not fresh:
        yield unzip.flush()
        raise Damaged("a gzip member doesn't end")


def write_archives(marked_pages: DataFrame, where: str, *, file_bytes: int = 256 << 20, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Monolithic archives below where, each one gzip stream; returns the written table of their paths."""

    def write(batches):
        fs, top = file_system(where)
        fs.create_dir(top, recursive=True)
        out = None
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")]
            for page_id, url, html, digest, refers_to in zip(*columns, strict=True):
                if out is None:
                    name, size, n, gz = f"{uuid.uuid4().hex}.warc.gz", 0, 0, zlib.compressobj(1, zlib.DEFLATED, GZIP)
                    out = fs.open_output_stream(f"{top}/{name}", compression=None)
                raw = record(page_id.as_py(), url.as_py(), html.as_py().encode(), digest.as_py(), refers_to.as_py(), date)
                out.write(gz.compress(raw))
                size, n = size + len(raw), n + 1
                if size >= file_bytes:
                    out.write(gz.flush())
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [f"{where}/{name}"], "n": [n]})
        if out is not None:
            out.write(gz.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{where}/{name}"], "n": [n]})

    return written(marked_pages.mapInArrow(write, "path string, n long"))


def normalise(archives: DataFrame, where: str) -> DataFrame:
    """Rewrites each archive of the table (path) with a member a record and a sidecar index; returns the new table (path, n,
    damaged)."""

    def rewrite(batches):
        fs, top = file_system(where)
        fs.create_dir(top, recursive=True)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                source_fs, source = file_system(path)
                name, at, n, damaged = f"{uuid.uuid4().hex}.warc.gz", 0, 0, False
                with source_fs.open_input_stream(source, compression=None) as f, fs.open_output_stream(f"{top}/{name}", compression=None) as out, fs.open_output_stream(f"{top}/{name}{INDEX}", compression=None) as index:
                    try:
                        for head, raw in records(inflated(f)):
                            gz = zlib.compressobj(4, zlib.DEFLATED, GZIP)
                            member = gz.compress(raw) + gz.flush()
                            out.write(member)
                            index.write(f"{at} {len(member)} {head.get('Page-ID', '')}\n".encode())
                            at, n = at + len(member), n + 1
                    except Damaged:
                        damaged = True
                yield pa.RecordBatch.from_pydict({"path": [f"{where}/{name}"], "n": [n], "damaged": [damaged]})

    return written(_spread(archives).mapInArrow(rewrite, "path string, n long, damaged boolean"))


def _spread(files: DataFrame) -> DataFrame:
    """A table of files, dealt out so that each has a task of its own."""
    return files.repartition(min(max(files.count(), 1), 20_000))


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record, by seeks to the indexed offsets."""

    def read(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, source = file_system(path)
                with fs.open_input_stream(source + INDEX, compression=None) as f:
                    spans = [tuple(map(int, x.split(b" ")[:2])) for x in f.read().split(b"\n") if x]
                rows = []
                with fs.open_input_file(source) as f:
                    for at, size in spans:
                        f.seek(at)
                        rows.append(_row(zlib.decompress(f.read(size), GZIP)))
                        if len(rows) == 5000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    return _spread(archives).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _row(raw: bytes) -> tuple:
    end = raw.index(b"\r\n\r\n")
    head = header(raw[:end])
    page_id = int(head["Page-ID"]) if head["Page-ID"] else None
    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
    if head["WARC-Type"] == "revisit":
        return page_id, int(head["Payload-Length"]), digest, "revisit", int(head["Refers-To-Page"])
    block = raw[end + 4 : end + 4 + int(head["Content-Length"])]
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    if (got := hashlib.sha256(payload).hexdigest()) != digest:
        raise ValueError(f"page {page_id}: the payload's digest is {got}, the header says {digest}")
    return page_id, len(payload), got, "response", None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def archived(pages: DataFrame, *, min_revisit: int = 100) -> DataFrame:
    """Writes pages as archives, normalises them and reads them back."""
    where = shared_dir(pages.sparkSession)
    whole = write_archives(marked(pages, min_revisit=min_revisit), f"{where}/whole")
    members = normalise(whole, f"{where}/members")
    if not members.where("damaged").isEmpty():
        raise Damaged("an archive just written is damaged")
    return read_archives(members)
