"""WARC archives: a writer with revisit records and a reader that splits the files.

Writing: each task turns its pages into records, each a gzip member of its own, and writes one archive at a time. The
names carry a number made up anew in each attempt, and only archives whose names a task has returned count, so that
a lost or repeated task leaves no record twice. Of records with equal payloads of `REVISIT_BYTES` bytes or more, the
one with the largest page_id is the response; the others are revisit records that refer to it and hold no payload.

Reading: a task gets a range of bytes. It scans it for the gzip magic, validates each candidate by decoding the
beginning of the member (a gzip header, and a WARC version line in what follows) and owns the records that start in
its range; it reads on past the end for the last one. Ranges are cut without looking at the file, so archives of any
size, also of one big file, are dealt out to many tasks. Bytes that merely look like a member's start are skipped when they
lie inside an owned record, and fail the validation otherwise.

Archives are read and written through the file system that the folder's address names.

Defined cases: null html is an empty payload; page_id null stays null (such a page refers to none and none to it, and
is always a response); equal page_ids with equal payloads are all responses if theirs is the largest; no pages give no
records; other columns are ignored. A damaged member is an error that names the file and the place.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import keep, shared_folder, table

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
#: Archive bytes that a reading task takes where there are more ranges than tasks that run at once.
TASK_BYTES = 64 << 20
MAGIC = b"\x1f\x8b\x08"
_HEAD = 4096


def _folder(address: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else (pafs.LocalFileSystem(), address)


def _address(folder: str) -> str:
    return "file://" + folder.removeprefix("file:") if folder.startswith("file:/") and not folder.startswith("file://") else folder


# -- records ---------------------------------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One record as a gzip member. A revisit holds the payload's length and digest, not the payload."""
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", date),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(c for c in url if c not in "\r\n")))
    status = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    block = status if refers_to is not None else status + payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n") + squeeze.flush()


def parsed(data: bytes) -> dict[str, object]:
    """page_id, record_type, refers_to, payload_bytes and payload_digest of a whole record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    status, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    size = next((int(line.split(b":")[1]) for line in status.split(b"\r\n") if line.lower().startswith(b"content-length:")), len(payload))
    if fields["WARC-Type"] == "response" and (size != len(payload) or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of record {fields['WARC-Record-ID']} is not the one its header describes")
    refers = fields.get("WARC-Refers-To")
    return {"page_id": number(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"],
            "refers_to": number(refers) if refers else None, "url": fields.get("WARC-Target-URI"), "payload": payload if fields["WARC-Type"] == "response" else None}


# -- writing ---------------------------------------------------------------------------------------------------------


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, and refers_to: the response's page_id for revisits."""
    html = F.coalesce("html", F.lit(""))
    digest = F.sha1(html.cast("binary"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), digest.alias("digest"))
    long_ones = own.filter(F.octet_length("html") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("page_id").alias("n"))
    several = long_ones.filter("n > 1").drop("n").withColumnRenamed("digest", "_digest")
    refers = F.when(F.col("page_id") < F.col("response"), F.col("response"))
    return own.join(several, F.col("digest") == F.col("_digest"), "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the pages as archives below a folder that all executors share; (path, size) of the archives that count."""
    address = _address(folder)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _folder(address)
        files.create_dir(base, recursive=True)
        out, path, size = None, "", 0
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path, size = f"{base}/pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(path, compression=None)
                data = record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers_to)
                out.write(data)
                size += len(data)
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[1]]), pa.array([size])], ["path", "size"])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[1]]), pa.array([size])], ["path", "size"])

    return keep(with_revisits(pages).mapInArrow(work, "path string, size long"), "archives")


# -- reading ---------------------------------------------------------------------------------------------------------


def is_start(data: bytes) -> bool:
    """Whether a gzip member that holds a WARC record begins here: its header, and the version line behind it."""
    if len(data) < 18 or data[3] & 0xE0:
        return False
    try:
        return zlib.decompressobj(31).decompress(data, 16).startswith(b"WARC/1.")
    except zlib.error:
        return False


def records_in(source: pa.NativeFile, size: int, begin: int, end: int, name: str = "") -> Iterator[bytes]:
    """The decoded records that start in [begin, end) of an archive."""
    window, chunk = b"", 1 << 20
    at = base = begin  # window holds the bytes from base

    def fill(upto: int) -> None:
        nonlocal window
        while base + len(window) < min(upto, size):
            source.seek(base + len(window))
            got = source.read(chunk)
            if not got:
                break
            window += got

    while at < end:
        window, base = window[at - base :], at
        fill(min(end + len(MAGIC) - 1, base + chunk))
        found = window.find(MAGIC)
        if found < 0:
            step = max(1, len(window) - len(MAGIC) + 1)
            if base + len(window) >= min(size, end + len(MAGIC) - 1):
                return
            at = base + step
            continue
        at = base + found
        if at >= end:
            return
        fill(at + _HEAD)
        if not is_start(window[at - base : at - base + _HEAD]):
            at += 1
            continue
        decode, parts, place = zlib.decompressobj(31), [], at
        while not decode.eof:
            fill(place + chunk)
            data = window[place - base : place - base + chunk]
            if not data:
                raise ValueError(f"{name}: the record at {at} is cut off")
            try:
                parts.append(decode.decompress(data))
            except zlib.error as e:
                raise ValueError(f"{name}: the record at {at} can't be decoded: {e}") from e
            place += len(data) - len(decode.unused_data)
        yield b"".join(parts)
        at = place


_ROW = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(archives: DataFrame, folder: str, range_bytes: int = RANGE_BYTES, payloads: bool = False) -> DataFrame:
    """The records of archives (path, size) below a folder: page_id, payload_bytes, payload_digest, record_type,
    refers_to, and with `payloads` the url and payload."""
    address = _address(folder)
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long")))
    ranges = archives.filter("size > 0").select("path", "size", begin.alias("begin"))
    # the ranges are few small rows, which Spark would read in one task: they are dealt out by number
    count, size = archives.filter("size > 0").agg(F.sum(F.ceil(F.col("size") / range_bytes)), F.sum("size")).first()
    tasks = min(count or 1, max(2 * archives.sparkSession.sparkContext.defaultParallelism, (size or 0) // TASK_BYTES))
    ranges = ranges.repartitionByRange(int(tasks), "path", "begin")
    names = [x.split(" ")[0] for x in _ROW.split(", ")] + ["url", "payload"] * payloads

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = _folder(address)
        kinds = {"page_id": "Int64", "refers_to": "Int64"}
        for batch in batches:
            for path, size, begin in zip(batch["path"], batch["size"], batch["begin"], strict=True):
                with files.open_input_file(f"{base}/{path}") as source:
                    rows, held = [], 0
                    for data in records_in(source, size, begin, min(size, begin + range_bytes), path):
                        rows.append(parsed(data))
                        held += len(data)
                        if held > 16 << 20:
                            yield pd.DataFrame(rows, columns=names).astype(kinds)
                            rows, held = [], 0
                    if rows:
                        yield pd.DataFrame(rows, columns=names).astype(kinds)

    return ranges.mapInPandas(work, _ROW + (", url string, payload binary" if payloads else ""))


def op8_splittable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    return read_archives(write_archives(table(spark, sf_dir, "pages"), folder), folder)


QUERIES = {"op8_splittable_warc": op8_splittable_warc}
SQL = {"op8_splittable_warc": f"""
WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id < last THEN last END AS refers_to
FROM m"""}
