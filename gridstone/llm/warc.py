"""WARC archives: a writer, and a reader whose tasks own byte ranges of the compressed files.

Every record is a gzip member of its own. A reading task scans its byte range for the gzip
magic, takes a candidate for a member only if its first bytes inflate to a WARC version line,
and owns the records that start inside the range, reading beyond its end to finish the last.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone.llm.common import new_path, small_enough

VERSION = b"WARC/1.1\r\n"
MAGIC = b"\x1f\x8b\x08"
#: Payloads below this many bytes are always written whole.
REVISIT_BYTES = 100
#: Bytes of an archive that one reading task owns, and bytes read at once.
SPLIT_BYTES, READ_BYTES = 16 << 20, 1 << 20
#: Tasks that read at most; beyond, each takes several ranges.
MOST_TASKS = 20_000
#: The table of files that writing tasks have committed, in the archives' folder.
WRITTEN, COMMITTED = "written", "name string, bytes long, n long"
#: Groups of equal payloads that are broadcast at most; beyond, they are joined by a salted shuffle.
BROADCAST_GROUPS, SALTS = 100_000, 32

RECORDS = "file string, start long, record_type string, target_uri string, page_id long, refers_to long, payload_digest string, payload_bytes long, payload binary"
_RECORDS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed. A revisit has no payload but names the response and the full payload's size and digest."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Page-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"Page-Refers-To: {refers_to}"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_roles(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest, refers_to: what each page is to be written as.

    Of equal payloads of at least `least` bytes the one with the smallest page_id is the
    response; rows that repeat that page_id are responses too, and a group without any
    page_id is written whole. Only groups of two or more reach the join.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    large = rows.where(F.length("payload") >= least)
    groups = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    if small_enough(groups, BROADCAST_GROUPS):
        joined = rows.join(F.broadcast(groups), "digest", "left")
    else:
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        copies = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", salt).join(copies, ["digest", "salt"], "left")
    refers = F.when((F.length("payload") >= least) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_warc(pages: DataFrame, folder: str, level: int = 4) -> int:
    """Writes the pages as archives in a shared folder, one per task; returns the number of records.

    Every attempt of a task writes a file of its own name and nothing is renamed or removed. Which files count is a
    table beside them, written by Spark, of which each task commits one attempt: what a lost or repeated attempt leaves is not in it.
    """
    path_of = folder.replace("file:///", "/") if folder.startswith("file:") else folder
    spark = pages.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, path = _filesystem(path_of)
        store.create_dir(path, recursive=True)
        name, n, out = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            if out is None:
                out = store.open_output_stream(f"{path}/{name}", compression=None)  # members are packed here
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                out.write(packer.compress(record(page_id, url, payload, digest, refers_to)) + packer.flush())
                n += 1
        if out is not None:
            out.close()
            size = store.get_file_info(f"{path}/{name}").size
            yield pa.RecordBatch.from_pydict({"name": pa.array([name]), "bytes": pa.array([size], pa.int64()), "n": pa.array([n], pa.int64())})

    with_roles(pages).mapInArrow(write, COMMITTED).write.mode("overwrite").parquet(f"{folder}/{WRITTEN}")
    return spark.read.schema(COMMITTED).parquet(f"{folder}/{WRITTEN}").agg(F.sum("n")).first()[0] or 0


def archive_splits(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES, most_tasks: int = MOST_TASKS) -> DataFrame:
    """file, first, last: the byte ranges of all archives in a folder: those of write_warc's table, else all that end in .warc.gz.

    Files are listed and cut by Spark, and ranges dealt evenly, one a task up to most_tasks tasks.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{WRITTEN}")):
        files = spark.read.schema(COMMITTED).parquet(f"{folder}/{WRITTEN}").select(F.concat(F.lit(f"{store.makeQualified(at).toString()}/"), "name").alias("file"), "bytes")
    elif store.exists(at):
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select(F.col("path").alias("file"), F.col("length").alias("bytes"))  # the content is not read
    else:
        files = spark.createDataFrame([], "file string, bytes long")
    files = files.where("bytes > 0")
    tasks = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    ranges = files.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("first"))
    return ranges.select("file", "first", F.least("bytes", F.col("first") + split_bytes).alias("last")).repartition(min(int(tasks), most_tasks))


class _Range:
    """Bytes of one file from a position on, read as they are needed; what is dropped is given up from time to time, not at once."""

    def __init__(self, stream, at: int):
        self.stream, self.at, self.data, self.low = stream, at, bytearray(), 0
        stream.seek(at)

    def __len__(self) -> int:
        return len(self.data) - self.low

    def more(self) -> bool:
        got = self.stream.read(READ_BYTES)
        self.data += got
        return bool(got)

    def find(self, mark: bytes) -> int:
        hit = self.data.find(mark, self.low)
        return hit - self.low if hit >= 0 else -1

    def since(self, n: int, size: int | None = None) -> bytes:
        """A copy of what comes after the first n bytes, at most `size` of it."""
        return bytes(self.data[self.low + n : len(self.data) if size is None else self.low + n + size])

    def drop(self, n: int) -> None:
        self.low += n
        self.at += n
        if self.low > READ_BYTES and 2 * self.low > len(self.data):
            del self.data[: self.low]
            self.low = 0


def _is_member(data: bytes) -> bool:
    """Whether bytes that begin with the magic inflate to a WARC version line."""
    try:
        return zlib.decompressobj(31).decompress(data[:4096], 16).startswith(b"WARC/1.")
    except zlib.error:
        return False


def records_in(stream, first: int, last: int) -> Iterator[tuple[int, bytes]]:
    """Start and inflated bytes of each record whose member starts in [first, last)."""
    r = _Range(stream, first)
    synced = False
    while True:
        if not synced:  # find the next member that starts here or later
            while True:
                hit = r.find(MAGIC)
                if hit < 0:
                    r.drop(max(0, len(r) - len(MAGIC) + 1))
                    if r.at >= last or not r.more():
                        return
                    continue
                if r.at + hit >= last:
                    return
                r.drop(hit)
                while len(r) < 4096 and r.more():
                    pass
                if _is_member(r.since(0, 4096)):
                    synced = True
                    break
                r.drop(1)
        if r.at >= last:
            return
        if not len(r) and not r.more():
            return
        inflate = zlib.decompressobj(31)
        parts, start, used = [], r.at, 0
        try:
            while True:
                parts.append(inflate.decompress(r.since(used)))
                used = len(r) - len(inflate.unused_data)
                if inflate.eof or not r.more():
                    break
        except zlib.error:
            parts = []
        whole = b"".join(parts)
        if not inflate.eof or not whole.startswith(b"WARC/1."):
            r.drop(1)  # damaged or foreign bytes: look for the next member
            synced = False
            continue
        r.drop(used)
        yield start, whole


def parsed(whole: bytes) -> tuple[str, str | None, int | None, int | None, str | None, int | None, bytes]:
    """record_type, target_uri, page_id, refers_to, payload_digest, payload_bytes and payload of an inflated record."""
    head, _, rest = whole.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields.get("content-length", len(rest)))]
    payload = block.partition(b"\r\n\r\n")[2]
    kind = fields.get("warc-type", "")
    number = lambda name: int(fields[name]) if name in fields else None
    if kind == "revisit":
        return kind, fields.get("warc-target-uri"), number("page-id"), number("page-refers-to"), fields.get("warc-payload-digest", "").rpartition(":")[2] or None, number("page-payload-length"), b""
    return kind, fields.get("warc-target-uri"), number("page-id"), None, hashlib.sha256(payload).hexdigest(), len(payload), payload


def read_warc(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """One row per record of all archives in a folder: file, start, record_type, target_uri, page_id, refers_to, payload_digest, payload_bytes, payload.

    Of responses, digest and size are those of the payload that was read; of revisits they are
    the header's, and the payload is empty. Bytes between members are skipped.
    payloads=False leaves the payload column empty once it has been hashed.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first, last in zip(*(batch.column(c).to_pylist() for c in ("file", "first", "last"))):
                store, path = _filesystem(file if "://" in file else file.replace("file:", "", 1))
                rows, held = [], 0
                with store.open_input_file(path) as stream:
                    for start, whole in records_in(stream, first, last):
                        *fields, payload = parsed(whole)
                        rows.append((file, start, *fields, payload if payloads else b""))
                        held += len(rows[-1][-1]) + 500
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _RECORDS.types)], schema=_RECORDS)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _RECORDS.types)], schema=_RECORDS)

    return archive_splits(spark, folder, split_bytes).mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as archives in the shared folder and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload, a null url is left out, a null page_id stays null. Repeated
    rows are records of their own. An empty table gives no archives and no rows.
    """
    folder = new_path(pages.sparkSession, "warc")
    write_warc(pages, folder)
    return read_warc(pages.sparkSession, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridstone.llm.common import table

    return round_trip(table(spark, sf_dir, "pages"))


#: The contract's result; needs no archive, as what is read back is what was written.
ORACLE = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload) as payload_bytes, sha256(payload) as payload_digest from p),
g as (select *, min(page_id) over (partition by payload_digest) as first from d)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> first then first end as refers_to from g"""
