"""WARC archives of web pages, written and read as rows of (record, chunk number).

A payload is cut into chunks while it is still in Spark, so neither writer nor reader holds a whole record: the
writer compresses one chunk after the other into the record's gzip member, the reader decompresses a bounded piece,
hands it on as a row and carries the SHA-256 of the payload so far from chunk to chunk.

Of pages with equal payloads of at least ``REVISIT_BYTES`` bytes the smallest page_id is a response, the others are
revisits of it without a payload. Payloads that occur once are written where they are read; only copies
are shuffled, large groups of them over many tasks.

A task writes files under names of its own and reports those it has closed; files of lost attempts are in no report and
are never read. The folder may be anything that pyarrow can open by its address.

Defined results: a null payload is empty; a null url is left out; of a null page_id the record is called
``urn:page:``, and it revisits a page with an id but is never revisited; rows with the same page_id are each a record with
the same name, all of them responses where the id is the group's smallest; an empty table gives no archive; other
columns are ignored. A cut-off or malformed archive raises an error that names the file.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from gradeloom.llm.common import saved
from gradeloom.llm.repeats import hinted, spread
from gradeloom.session import scratch_path

REVISIT_BYTES = 100
CHUNK = 1 << 20
FILE_BYTES = 256 << 20
#: Rows of an Arrow batch that the reader hands on carry about this many bytes.
BATCH_BYTES = 8 << 20
LONGEST_HEAD = 1 << 20
_LEVEL = 5
_PREFIX = "urn:page:"

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DEFAULT_DATE = "2000-01-01T00:00:00Z"

_PLAN = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long"
CHUNKS = (
    "file string, record long, page_id long, url string, record_type string, refers_to long, chunk_no long, "
    "data binary, last boolean, payload_bytes long, payload_digest string, intact boolean"
)


def plan_records(pages: DataFrame) -> DataFrame:
    """The pages with payload, payload_bytes, payload_digest, record_type and refers_to; a revisit's payload is null."""
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    digested = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload")).select(
        "*", F.sha2("payload", 256).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes")
    )
    narrow = saved(digested.select("page_id", "payload_digest", "payload_bytes"), "digests")
    groups = narrow.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest")
    held = groups.agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first_id IS NOT NULL")
    repeated = saved(held, "repeated")
    marked = hinted(digested, "payload_digest", repeated)
    copied = saved(marked.where("_maybe").drop("_maybe").withColumn("_row", F.monotonically_increasing_id()), "copies")
    left, right = spread(copied, F.col("_row"), "payload_digest", repeated, narrow.count())
    joined = left.join(right.drop("n"), ["payload_digest", "_salt"], "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    columns = ["page_id", "url", "payload_digest", "payload_bytes", "record_type", "refers_to", "payload"]
    judged = joined.select(
        "page_id",
        "url",
        "payload_digest",
        "payload_bytes",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first_id")).alias("refers_to"),
        F.when(~again, F.col("payload")).alias("payload"),
    )
    alone = marked.where(~F.col("_maybe")).withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")})
    return alone.select(*columns).unionByName(judged)


def chunked(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per record and chunk number, in the order of the records; an empty payload has one empty chunk."""
    pieces = F.greatest(F.ceil(F.octet_length("payload") / chunk), F.lit(1)).cast("int")
    numbered = records.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.coalesce(pieces, F.lit(1)) - 1)))
    data = F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk))
    return numbered.select(
        "page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "chunk_no", F.coalesce(data, F.lit(b"")).alias("data")
    )


def _address(url: str | None) -> list[str]:
    """The header line of a url; white space and control characters are percent-encoded."""
    return [] if url is None else ["WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)]


def _name(page_id: int | None) -> str:
    return f"<{_PREFIX}{'' if page_id is None else page_id}>"


def _heads(row: dict, date: str) -> tuple[bytes, bytes]:
    """Record header and the HTTP head that begins the record's block."""
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" f"Content-Length: {row['payload_bytes']}\r\n\r\n").encode()
    revisit = row["record_type"] == "revisit"
    lines = [VERSION, f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_name(row['page_id'])}", f"WARC-Date: {date}", *_address(row["url"])]
    lines.append(f"WARC-Payload-Digest: sha256:{row['payload_digest']}")
    if revisit:
        lines += [f"WARC-Refers-To: {_name(row['refers_to'])}", f"WARC-Profile: {PROFILE}"]
    size = len(http) + (0 if revisit else row["payload_bytes"])
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {size}", "", ""]
    return "\r\n".join(lines).encode(), http


class _Archive:
    """One file of gzip members, one per record."""

    def __init__(self, folder: str):
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        self.path, self.records, self.bytes = f"{folder.rstrip('/')}/{name}", 0, 0
        self.out = system.open_output_stream(f"{root.rstrip('/')}/{name}", compression=None)
        self.member = None

    def begin(self) -> None:
        self.member = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)

    def add(self, data: bytes) -> None:
        self._put(self.member.compress(data))

    def end(self) -> None:
        self.add(b"\r\n\r\n")
        self._put(self.member.flush())
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def report(self) -> pa.RecordBatch:
        self.out.close()
        return pa.RecordBatch.from_pydict({"file": [self.path], "records": pa.array([self.records], pa.int64()), "bytes": pa.array([self.bytes], pa.int64())})


def _writer(folder: str, date: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, opened = None, False
        for batch in batches:
            heads = batch.drop_columns(["data"])
            for k in range(batch.num_rows):
                if batch.column("chunk_no")[k].as_py() == 0:
                    if opened:
                        archive.end()
                    if archive is not None and archive.bytes >= file_bytes:
                        yield archive.report()
                        archive = None
                    archive = archive or _Archive(folder)
                    archive.begin()
                    for part in _heads(heads.slice(k, 1).to_pylist()[0], date):
                        archive.add(part)
                    opened = True
                archive.add(batch.column("data")[k].as_buffer())
        if opened:
            archive.end()
            yield archive.report()

    return run


def write_archives(records: DataFrame, folder: str, date: str = DEFAULT_DATE, chunk: int = CHUNK, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write planned records below ``folder``; the report has a row (file, records, bytes) per archive."""
    schema = "file string, records long, bytes long"
    return saved(chunked(records, chunk).mapInArrow(_writer(folder, date, file_bytes), schema), "archives")


class _Source:
    """Decompressed bytes of an archive, in pieces of at most ``CHUNK`` bytes; plain and gzip files."""

    def __init__(self, path: str):
        system, name = fs.FileSystem.from_uri(path)
        self.path, self.raw = path, system.open_input_stream(name, compression=None)
        self.packed, self.ready, self.unpack = self.raw.read(CHUNK), b"", None
        self.zipped = self.packed[:2] == b"\x1f\x8b"

    def _more(self) -> bool:
        """Get at least one more byte into ``ready``; false at the end of the file."""
        had = len(self.ready)
        while len(self.ready) == had:
            if not self.packed:
                self.packed = self.raw.read(CHUNK)
                if not self.packed:
                    if self.unpack is not None:
                        raise ValueError(f"{self.path}: cut off within a record")
                    return False
            if not self.zipped:
                self.ready, self.packed = self.ready + self.packed, b""
                continue
            if self.unpack is None:
                self.unpack = zlib.decompressobj(31)
            self.ready += self.unpack.decompress(self.packed, CHUNK)
            if self.unpack.eof:
                self.packed, self.unpack = self.unpack.unused_data, None
            else:
                self.packed = self.unpack.unconsumed_tail
        return True

    def head(self, limit: int = LONGEST_HEAD) -> bytes | None:
        """Bytes up to the next empty line; None at the end of the file."""
        while (end := self.ready.find(b"\r\n\r\n")) < 0:
            if len(self.ready) > limit:
                raise ValueError(f"{self.path}: no end of a header within {limit} bytes")
            if not self._more():
                if self.ready.strip():
                    raise ValueError(f"{self.path}: cut off within a header")
                return None
        out, self.ready = self.ready[:end], self.ready[end + 4 :]
        return out

    def take(self, size: int) -> bytes:
        """Between one and ``size`` bytes."""
        if not self.ready and not self._more():
            raise ValueError(f"{self.path}: cut off within a block")
        out, self.ready = self.ready[:size], self.ready[size:]
        return out

    def skip(self, size: int) -> None:
        while size:
            size -= len(self.take(min(size, CHUNK)))


def _fields(head: bytes) -> dict[str, str]:
    """Header fields, names in lower case; folded lines continue the field before."""
    found: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def _page(name: str | None) -> int | None:
    number = (name or "").strip("<>").removeprefix(_PREFIX)
    return int(number) if re.fullmatch(r"-?[0-9]+", number) else None


def read_records(path: str) -> Iterator[dict]:
    """The chunks of all responses and revisits of one archive, in order, without ever holding a whole record."""
    source, number = _Source(path), -1
    while (head := source.head()) is not None:
        head = head.lstrip(b"\r\n")
        if not head.startswith(b"WARC/"):
            raise ValueError(f"{path}: no record where one should begin")
        fields = _fields(head)
        try:
            left = int(fields["content-length"])
        except (KeyError, ValueError):
            raise ValueError(f"{path}: a record without a length") from None
        number += 1
        kind = fields.get("warc-type")
        if kind not in ("response", "revisit"):
            source.skip(left)
            source.skip(4)
            continue
        row = {
            "file": path,
            "record": number,
            "page_id": _page(fields.get("warc-record-id")),
            "url": fields.get("warc-target-uri"),
            "record_type": kind,
            "refers_to": _page(fields.get("warc-refers-to")) if kind == "revisit" else None,
        }
        declared = fields.get("warc-payload-digest", "").removeprefix("sha256:")
        http = {}
        if fields.get("content-type", "").startswith("application/http") and left:
            block = source.head() or b""
            left -= len(block) + 4
            if left < 0:
                raise ValueError(f"{path}: a block without an HTTP head")
            http = _fields(block)
        if kind == "revisit":
            source.skip(left)
            size = http.get("content-length", "")
            yield row | {"chunk_no": 0, "data": b"", "last": True, "payload_bytes": int(size) if size.isdigit() else None, "payload_digest": declared or None, "intact": None}
        else:
            digest, done, chunk = hashlib.sha256(), 0, 0
            while True:
                data = source.take(min(left, CHUNK)) if left else b""
                left -= len(data)
                done += len(data)
                digest.update(data)
                so_far = digest.hexdigest()
                intact = so_far == declared if declared and not left else None
                yield row | {"chunk_no": chunk, "data": data, "last": not left, "payload_bytes": done, "payload_digest": so_far, "intact": intact}
                chunk += 1
                if not left:
                    break
        source.skip(4)


def _reader(with_data: bool):
    schema = pa.schema(
        [("file", pa.string()), ("record", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int64()), ("data", pa.binary()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for path in batch.column("file").to_pylist():
                for row in read_records(path):
                    size += len(row["data"]) + 500
                    rows.append(row if with_data else row | {"data": None})
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_archives(files: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives named in the column ``file``.

    One row per record and chunk number. ``payload_bytes`` and ``payload_digest`` cover the payload up to and with the
    chunk, so the ``last`` chunk has those of the whole; ``intact`` says there whether the digest is the declared one. A
    revisit has one row with what its header declares. ``with_data=False`` leaves the bytes out.
    """
    names = files.select("file")
    return names.repartition(max(1, min(names.count(), 100_000))).mapInArrow(_reader(with_data), CHUNKS)


def whole_records(chunks: DataFrame) -> DataFrame:
    """One row per record, without its bytes."""
    return chunks.where("last").select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the pages as archives (to a new scratch folder unless one is named) and read the records back."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return whole_records(read_archives(write_archives(plan_records(pages), folder), with_data=False))
