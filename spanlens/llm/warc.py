"""WARC archives: one gzip member for each record, written by Spark's tasks and read back in sequence.

Writing: each task writes files of about FILE_BYTES to a shared folder, under names of its own, and returns one row for
each finished file.  Those rows are stored by Spark's committed writer as the archive's manifest; a file that is not in it,
left by a task that was lost or repeated, is never read.

Payloads that repeat (at least ``REVISIT_BYTES``) are written once, by the page with the largest id; the others are
revisit records that refer to it.

Reading: a file is read as a stream.  Each gzip member is inflated piece by piece, headers end at the first empty line,
the block is as long as Content-Length says, and the payload's digest is held against the record's own.

Defined cases: a null or empty html is an empty payload; pages with a null id never answer for others unless all do,
and are named ``none``; rows that repeat the largest id and the payload are all responses; an empty table writes no files.
"""

import hashlib
import uuid
import zlib
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import scratch, stored
from .common import map_arrow, whole

REVISIT_BYTES = 1000
FILE_BYTES = 64 << 20
_READ = 1 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
# Fixed values of the format.
_VERSION, _END = b"WARC/1.1", b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class CorruptArchive(ValueError):
    """A record that is cut short, framed wrongly or altered."""


def record_id(page) -> str:
    return f"<urn:x-page:{'none' if page is None else page}>"


def page_of(name: str) -> int | None:
    number = name.removeprefix("<urn:x-page:").removesuffix(">")
    return None if number == "none" else int(number)


def record(page, url, payload: bytes, digest: str, refers_to=None, revisit: bool = False, date: str = "") -> bytes:
    """One record as one gzip member.  A revisit has the HTTP headers only."""
    block = _HTTP % len(payload) + (b"" if revisit else payload)
    head = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(page), "WARC-Date": date,
        "WARC-Target-URI": " ".join((url or "").split()), "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{hashlib.sha1(block).hexdigest()}",
        "Content-Type": "application/http; msgtype=response",
    }
    if revisit:
        head |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": record_id(refers_to)}
    head["Content-Length"] = str(len(block))
    lines = b"\r\n".join([_VERSION, *[f"{k}: {v}".encode() for k, v in head.items()]])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(lines + _END + block + _END) + packer.flush()


def members(stream, size: int = _READ):
    """The inflated bytes of each gzip member of a stream, as an iterator of pieces for each."""
    rest = stream.read(size)
    while rest:
        inflate = zlib.decompressobj(31)

        def pieces(inflate=inflate):
            nonlocal rest
            while not inflate.eof:
                if not rest:
                    rest = stream.read(size)
                    if not rest:
                        raise CorruptArchive("the last member is cut short")
                try:
                    piece = inflate.decompress(rest, size)
                except zlib.error as broken:
                    raise CorruptArchive(str(broken)) from broken
                rest = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
                if piece:
                    yield piece

        yield pieces()
        if not inflate.eof:
            raise CorruptArchive("a member was not read to its end")
        rest = rest or stream.read(size)


def read_records(stream):
    """(headers, payload bytes, payload length, payload digest) of each record in turn.

    ``payload`` is None for a revisit; its length is then the one that the HTTP headers state.
    """
    for pieces in members(stream):
        data = bytearray()
        end = -1
        for piece in pieces:
            data += piece
            end = data.find(_END)
            if end >= 0:
                break
        if end < 0 or not data.startswith(_VERSION):
            raise CorruptArchive("no record header")
        head = dict(line.split(": ", 1) for line in bytes(data[:end]).decode().split("\r\n")[1:])
        size, begin = int(head["Content-Length"]), end + len(_END)
        for piece in pieces:
            data += piece
        block = bytes(data[begin:begin + size])
        if len(data) != begin + size + len(_END) or data[-len(_END):] != _END:
            raise CorruptArchive(f"{head['WARC-Record-ID']}: block is not Content-Length long")
        if "sha1:" + hashlib.sha1(block).hexdigest() != head["WARC-Block-Digest"]:
            raise CorruptArchive(f"{head['WARC-Record-ID']}: block digest differs")
        http, _, payload = block.partition(_END)
        stated = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if head["WARC-Type"] == "revisit":
            yield head, None, stated, digest
            continue
        if len(payload) != stated or hashlib.sha1(payload).hexdigest() != digest:
            raise CorruptArchive(f"{head['WARC-Record-ID']}: payload digest differs")
        yield head, payload, stated, digest


def _place(folder: str):
    """File system and path of a shared folder, for a Python task."""
    if folder.startswith("file:") or "://" not in folder:
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


def with_roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               least: int = REVISIT_BYTES) -> DataFrame:
    """(page, url, html, digest, owner): ``owner`` is the page that holds an equal payload of at least ``least`` bytes.

    Only payloads that repeat are looked up, by digest.  Counting is aggregated before its shuffle and stored, so the
    lookup is a join that Spark can split where one payload is very frequent.
    """
    source = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), whole(html_col).alias("html"))
    payload = F.encode("html", "UTF-8")
    hashed = source.withColumn("digest", F.sha1(payload))
    owners = stored(
        source.filter(F.octet_length("html") >= least).select(F.sha1(payload).alias("digest"), "page")
        .groupBy("digest").agg(F.max("page").alias("owner"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1).drop("n"), "payload-owners",
    )
    return hashed.join(owners, "digest", "left").select("page", "url", "html", "digest", "owner")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` below ``folder`` and return the manifest: (file, records, bytes)."""
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def step(batches):
        system, top = _place(folder)
        system.create_dir(f"{top}/data", recursive=True)
        out, name, count, written = None, "", 0, 0
        for batch in batches:
            for page, url, html, digest, owner in zip(*(c.to_pylist() for c in batch.columns)):
                revisit = owner is not None and page != owner
                data = record(page, url, html.encode(), digest, owner, revisit, date)
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, count, written = system.open_output_stream(f"{top}/data/{name}", compression=None), 0, 0
                out.write(data)
                count, written = count + 1, written + len(data)
                if written >= file_bytes:
                    out.close()
                    yield pa.record_batch([[name], [count], [written]], ["file", "records", "bytes"])
                    out = None
        if out is not None:
            out.close()
            yield pa.record_batch([[name], [count], [written]], ["file", "records", "bytes"])

    done = map_arrow(with_roles(pages, id_col, url_col, html_col), step, "file string, records long, bytes long")
    done.write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


_FOUND = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
          "payload binary")


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """One row for each record of the archives in the manifest, each file read once from start to end.

    ``payload`` is null for revisits, and everywhere unless ``payloads``.  The number of records of a file is held
    against the manifest.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    names = [x.split()[0] for x in _FOUND.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def rows(held):
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

    def step(batches):
        system, top = _place(folder)
        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held, size, seen = [], 0, 0
                with system.open_input_stream(f"{top}/data/{name}", compression=None) as stream:
                    for head, payload, length, digest in read_records(stream):
                        refers = head.get("WARC-Refers-To")
                        held.append((page_of(head["WARC-Record-ID"]), head["WARC-Target-URI"], length, digest,
                                     head["WARC-Type"], page_of(refers) if refers else None,
                                     payload if payloads else None))
                        seen, size = seen + 1, size + 200 + (len(payload) if payloads and payload else 0)
                        if size > 8 << 20:
                            yield rows(held)
                            held, size = [], 0
                if held:
                    yield rows(held)
                if seen != records:
                    raise CorruptArchive(f"{name}: {seen} records of {records}")

    # A file is some tens of MB to inflate, its row in the manifest some tens of bytes: files are dealt one by one.
    files = manifest.select("file", "records").repartition(max(1, manifest.count()), "file")
    return map_arrow(files, step, _FOUND)


def archive_report(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html") -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back and report each record."""
    folder = scratch(pages.sparkSession, "warc")
    write_archives(pages, folder, id_col, url_col, html_col)
    return read_archives(pages.sparkSession, folder, payloads=False).select(
        F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
