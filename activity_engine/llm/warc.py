"""WARC archives: a writer with revisit records, and a splittable reader of gzip members.

Each record is one gzip member. The reader's tasks take byte ranges: a task scans its range for the gzip magic number,
accepts a candidate if it decodes to a WARC header, and owns the records that begin inside its range; it reads beyond
the range's end to finish the last of them. Archives lie in a folder that all executors share and are reached through
`pyarrow.fs`, by URI, so that the folder may be in any file system it knows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, written

FILE_BYTES, SPLIT_BYTES, READ_BYTES = 64 << 20, 8 << 20, 1 << 20
MAGIC = b"\x1f\x8b\x08"
SCHEMA = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, url string, payload binary, record_id string, refers_to_id string"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit whose block is the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    head += ["WARC-Date: 2024-01-01T00:00:00Z", "WARC-Target-URI: " + " ".join(url.split()), f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(wbits=31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _writer(folder: str, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = pafs.FileSystem.from_uri(folder)
        out, name, size = None, "", 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [name], "size": [size]})

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:  # a new name for each attempt of a task: only what a finished task reports is read
                    name, size = f"{path}/{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(name, compression=None)
                out.write(data := record(row["id"], row["url"], row["payload"], row["digest"], row["refers_to"]))
                size += len(data)
                if size >= file_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return write


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record for each row and return the manifest (path, size) of the archives.

    Of records with equal payloads of at least `min_revisit_bytes` bytes the one with the largest id is the response
    and the others revisit it; if that row is repeated, all its repetitions are responses. Null html is an empty
    payload; rows with a null id are responses. An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    if "://" not in folder and folder.startswith("file:"):
        folder = "file://" + folder[len("file:") :]
    system, path = pafs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    payload = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b""))
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    base = base.withColumn("sha", F.sha1("payload"))
    first = base.filter(F.length("payload") >= min_revisit_bytes).groupBy("sha").agg(F.max("id").alias("last"), F.count("*").alias("n")).filter("n > 1").select("sha", "last")
    # A table, so that AQE can split a payload that very many pages have; it grows with the pages: never a broadcast.
    first = written(first, "payloads").hint("merge")
    rows = base.join(first, "sha", "left").select("id", "url", "payload", F.when(F.col("id") < F.col("last"), F.col("last")).alias("refers_to"), "sha")
    rows = rows.mapInArrow(_digests, "id long, url string, payload binary, refers_to long, digest string")
    return written(rows.mapInArrow(_writer(folder, file_bytes), "path string, size long"), "manifest")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digest = [base64.b32encode(bytes.fromhex(s)).decode() for s in batch.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(digest, pa.string())], ["id", "url", "payload", "refers_to", "digest"])


class Window:
    """Bytes of a file from `start` on, read as they are asked for and forgotten by `drop`."""

    def __init__(self, file, start: int, size: int):
        self.file, self.base, self.size, self.data = file, start, size, bytearray()

    def to(self, end: int) -> bool:
        """Hold the bytes before `end`, or as many as there are."""
        end = min(end, self.size)
        while self.base + len(self.data) < end:
            self.file.seek(at := self.base + len(self.data))
            self.data += self.file.read(max(READ_BYTES, end - at))
        return self.base + len(self.data) >= end

    def drop(self, before: int) -> None:
        if before - self.base > READ_BYTES:
            del self.data[: before - self.base]
            self.base = before


def head_and_rest(data: bytes) -> tuple[list[str], bytes] | None:
    """The lines of a header and what follows its empty line; None if there is no such line. Folded lines are joined."""
    ends = [(i, len(e)) for e in (b"\r\n\r\n", b"\n\n") if (i := data.find(e)) >= 0]
    if not ends:
        return None
    at, gap = min(ends)
    lines: list[str] = []
    for line in data[:at].decode("utf-8", "replace").splitlines():
        if line[:1] in (" ", "\t") and lines:
            lines[-1] += " " + line.strip()
        else:
            lines.append(line)
    return lines, data[at + gap :]


def fields_of(lines: list[str]) -> dict[str, str]:
    """Header fields by lower-cased name; the first of a repeated one counts."""
    out: dict[str, str] = {}
    for line in lines:
        name, sep, value = line.partition(":")
        if sep:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"[0-9]{1,18}", text) else None


def _page(record_id: str) -> int | None:
    """The page's id in the ids that `record` writes; null for the ids of others."""
    m = re.fullmatch(r"<urn:page:(-?[0-9]{1,19})>", record_id)
    return int(m[1]) if m else None


def parse(member: bytes) -> Iterator[dict]:
    """The records of a decoded member, of any type and writer; it ends where one can't be read."""
    while member.startswith(b"WARC/"):
        got = head_and_rest(member)
        if got is None:
            return
        fields = fields_of(got[0][1:])
        length = _number(fields.get("content-length"))
        if length is None:
            return
        block, member = got[1][:length], got[1][length:].lstrip(b"\r\n")
        kind, record_id, refers = (fields.get(f"warc-{x}", "") for x in ("type", "record-id", "refers-to"))
        payload, size = block, None
        if fields.get("content-type", "").lower().startswith("application/http") and (http := head_and_rest(block)):
            payload, size = http[1], _number(fields_of(http[0][1:]).get("content-length"))
        revisit = kind.lower() == "revisit"
        stated = fields.get("warc-payload-digest", "")
        yield {
            "page_id": _page(record_id), "record_type": kind.lower(), "refers_to": _page(refers), "payload_bytes": size if revisit else len(payload),
            "payload_digest": stated.partition(":")[2] or None if revisit else sha1_base32(payload), "url": fields.get("warc-target-uri"),
            "payload": None if revisit else payload, "record_id": record_id or None, "refers_to_id": refers or None,
        }


def member_at(window: Window, at: int) -> tuple[bytes, int] | None:
    """The decoded gzip member that begins at `at` and the place after it; None if no WARC record begins there."""
    unpack, out, pos, step = zlib.decompressobj(wbits=31), [], at, 4 << 10
    checked = False
    while not unpack.eof:
        window.to(pos + step)
        piece = bytes(window.data[pos - window.base : pos - window.base + step])
        if not piece:
            return None
        try:
            out.append(unpack.decompress(piece))
        except zlib.error:
            return None
        pos += len(piece)
        if not checked and sum(map(len, out)) >= 5:
            if not b"".join(out).startswith(b"WARC/"):
                return None
            checked = True
        step = 64 << 10
    end = pos - len(unpack.unused_data)
    window.to(end + 3)
    after = bytes(window.data[end - window.base : end - window.base + 3])
    return (b"".join(out), end) if end >= window.size or after == MAGIC else None


def records_in(file, size: int, start: int, stop: int) -> Iterator[dict]:
    """The records that begin in [start, stop) of a file of `size` bytes."""
    window, at = Window(file, start, size), start
    while at < stop:
        window.to(min(stop + 2, at + READ_BYTES))
        found = window.data.find(MAGIC, at - window.base, stop + 2 - window.base)
        if found < 0:
            at = max(at, window.base + len(window.data) - 2)
            if window.base + len(window.data) >= min(stop + 2, size):
                return
            continue
        at = window.base + found
        got = member_at(window, at)
        if got:
            yield from parse(got[0])
        at = got[1] if got else at + 1
        window.drop(at)


def _reader(folder: str, with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
        schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
        system, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, size, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                with system.open_input_file(path) as file:
                    for r in records_in(file, size, start, stop):
                        if not with_payload:
                            r["payload"] = None
                        rows.append(r)
                        held += len(r["payload"] or b"") + 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return read


def read_warc(spark: SparkSession, manifest: DataFrame, folder: str | None = None, with_payload: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of the archives in `manifest` (path, size), read by byte ranges of `split_bytes`.

    Archives of any writer are read: every record of every type (warcinfo, request, metadata, ..) is a row, header names
    count in any case, and ids are kept as text in record_id and refers_to_id; page_id and refers_to are null unless
    `write_warc` made them. The payload of an HTTP record is what follows the HTTP header, as it stands; of others, the
    block. A revisit has no payload; its size and digest are what its headers say, or null. Members that aren't WARC
    records, or whose header can't be read, are passed over. An empty manifest or empty archives give no rows.
    """
    folder = folder or "file:///"
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long")))
    splits = manifest.filter("size > 0").select("path", "size", starts.alias("start")).withColumn("stop", F.least(F.col("start") + split_bytes, F.col("size")))
    splits = splits.repartition(spark.sparkContext.defaultParallelism * 4, "path", "start")
    return splits.mapInArrow(_reader(folder, with_payload), SCHEMA)


def warc_round_trip(pages: DataFrame, min_revisit_bytes: int = 0, with_payload: bool = False) -> DataFrame:
    """Write `pages` to archives in the shared folder and return the records read back from them."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    manifest = write_warc(pages, folder, min_revisit_bytes=min_revisit_bytes)
    return read_warc(spark, manifest, folder, with_payload)
