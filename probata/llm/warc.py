"""WARC archives in dictionary-compressed Zstandard: writer, reader, and revisit records for equal payloads.

An archive starts with a skippable frame that holds the dictionary; every record after it is a frame of its own, so an
archive can be read from any record on. The dictionary is trained on a bounded sample of the pages (``sample`` different
ones, those whose id and payload have the least hash, cut at ``sample_bytes`` each for the training only): hashes are
chosen first, and only what they stand for goes to the driver. Everything is archived whole.

Of the pages with one payload of at least ``least`` bytes that with the largest id is a response record and the others
are revisit records that refer to it; the revisit's HTTP header still has the full payload's length. Digests are found
where the pages are; only ids, digests and roles are joined, and pages meet their role by id. A page whose id repeats is
one record per row, and of equal rows all are responses.

Archives go to the folder given, which executors must be able to write: a path or URI that pyarrow's file systems know
(local and mounted folders, hdfs, s3, gs). A task writes archives under names of its own attempt, and the manifest names
those of the attempts that counted; reading goes by the manifest, through Spark's binaryFile source, so what a lost or
repeated task left behind is never read.

Defined results: a null payload is an empty one; payloads under ``least`` bytes are always responses; a page without
an id is a response of its own; a table without rows gives no archive and no record.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint

# The magic numbers of the formats.
DICTIONARY_FRAME = 0x184D2A5D
FRAME = 0xFD2FB528
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Names of archives are broadcast up to this many.
BROADCAST_ROWS = 500_000


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, sha: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id} {sha.hex()}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, sha: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, sha)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha).decode()}"]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, sha)}", f"Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC/1.1 record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("the record doesn't end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def dictionary_frame(data: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_FRAME, len(data)) + data


def frame_size(data: memoryview, at: int) -> int:
    """Bytes of the Zstandard frame at ``at``, from the headers of its blocks."""
    flags = data[at + 4]
    single = flags >> 5 & 1
    size = 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        head = int.from_bytes(data[at + size : at + size + 3], "little")
        size += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return size + (4 if flags & 4 else 0)


def records(archive: bytes | pa.Buffer) -> Iterator[bytes]:
    """The records of an archive; the dictionary comes from its own leading frame."""
    data, at, reader = memoryview(archive), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at)
        if magic == DICTIONARY_FRAME:
            if size:
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(data[at + 8 : at + 8 + size])))
            at += 8 + size
            continue
        if magic != FRAME:
            raise ValueError(f"no frame at byte {at}")
        size = frame_size(data, at)
        yield reader.decompress(bytes(data[at : at + size]))
        at += size


def train(pages: DataFrame, html: str = "html", sample: int = 1000, sample_bytes: int = 16_384, dict_bytes: int = 65_536) -> bytes:
    """A dictionary from records of ``sample`` pages; empty if there is too little to train on."""
    own = F.xxhash64(F.col("page_id"), F.col(html))
    chosen = pages.groupBy(own.alias("__h")).agg(F.count("*").alias("n")).select("__h").orderBy(F.xxhash64("__h"), "__h").limit(sample)
    rows = pages.withColumn("__h", own).join(F.broadcast(chosen), "__h")
    rows = rows.select("__h", "page_id", "url", F.substring(F.col(html), 1, sample_bytes).alias("html")).dropDuplicates(["__h"]).collect()
    rows.sort(key=lambda r: r["__h"])
    samples = [record(r.page_id, r.url, p := (r.html or "").encode("utf-8", "surrogatepass"), hashlib.sha1(p).digest(), None, "") for r in rows]
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(dict_bytes, max(1024, total // 8)), samples).as_bytes()
    except zstandard.ZstdError:  # fewer samples than the training needs
        return b""


def roles(pages: DataFrame, html: str = "html", least: int = 0) -> DataFrame:
    """(page_id, sha, refers_to) of the pages whose payload a page with a larger id has too; sha is the digest in hex."""
    seen = pages.select(F.col("page_id").cast("long"), *_payload(html)).distinct()
    best = seen.where(F.col("n") >= least).groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("pages"))
    best = checkpoint(best.where("pages > 1").select("sha", "refers_to"))  # with an exchange of its own the join can split a hot payload
    return seen.join(best, "sha").where("page_id < refers_to").select("page_id", "sha", "refers_to")


def _payload(html: str) -> list:
    data = F.coalesce(F.col(html), F.lit("")).cast("binary")
    return [F.sha1(data).alias("sha"), F.octet_length(data).cast("long").alias("n")]


def write(pages: DataFrame, folder: str, html: str = "html", least: int = 0, archive_bytes: int = 32_000_000, level: int = 3, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archive all ``pages`` (page_id, url, html) under ``folder``; returns the manifest (file, records, bytes), a row per archive."""
    spark, words = pages.sparkSession, train(pages, html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, place = TaskContext.get(), folder.replace("s3a://", "s3://", 1)
        store, root = fs.FileSystem.from_uri(place) if "://" in place else (fs.LocalFileSystem(), place)
        store.create_dir(root, recursive=True)
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words) if words else None)
        head, out, made, size = dictionary_frame(words), [], [], 0

        def close() -> tuple[str, int, int]:
            name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(made):04d}.warc.zst"
            with store.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(head + b"".join(out))
            return name, len(out), size + len(head)

        for batch in batches:
            for page_id, url, text, sha, refers_to in zip(*map(batch.column, range(5)), strict=True):
                payload = (text.as_py() or "").encode("utf-8", "surrogatepass")
                out.append(packer.compress(record(page_id.as_py(), url.as_py(), payload, bytes.fromhex(sha.as_py()), refers_to.as_py(), date)))
                size += len(out[-1])
                if size >= archive_bytes:
                    made.append(close())
                    out, size = [], 0
        if out:
            made.append(close())
        files, counts, sizes = zip(*made, strict=True) if made else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["file", "records", "bytes"])

    role = roles(pages, html, least).select(F.col("page_id").alias("p"), F.col("sha").alias("s"), "refers_to")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html).alias("html"), _payload(html)[0])
    rows = rows.join(role, (F.col("page_id") == F.col("p")) & (F.col("sha") == F.col("s")), "left").select("page_id", "url", "html", "sha", "refers_to")
    rows.mapInArrow(run, "file string, records long, bytes long").write.parquet(f"{folder}-manifest")
    return spark.read.parquet(f"{folder}-manifest")


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, record_id and, if asked for, the payload of every record.

    A response whose payload doesn't have the digest its header names is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", *["payload"] * payloads]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), *[pa.binary()] * payloads]
        for batch in batches:
            for archive in batch.column(0):
                rows, size = [], 0
                for data in records(archive.as_buffer()):
                    fields, http, payload = parse(data)
                    sha1 = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = fields["WARC-Type"]
                    if kind == "response" and digest(payload) != sha1:
                        raise ValueError(f"{fields['WARC-Record-ID']}: the payload doesn't have its digest")
                    number = lambda k, f=fields: int(f[k]) if k in f else None
                    row = (number("Page-ID"), fields["WARC-Target-URI"], int(http["Content-Length"]), sha1, kind, number("Refers-To-Page-ID"), fields["WARC-Record-ID"])
                    rows.append(row + (payload,) * payloads)
                    size += len(data) * payloads + 200
                    if size > 16_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string" + ", payload binary" * payloads
    listed = spark.read.parquet(f"{folder}-manifest").select(F.col("file").alias("__file"))
    archives = listed.count()
    if not archives:
        return spark.createDataFrame([], schema)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    listed = F.broadcast(listed) if archives <= BROADCAST_ROWS else listed
    found = found.join(listed, F.regexp_extract("path", r"[^/]+$", 0) == F.col("__file"), "left_semi")
    return found.select("content").mapInArrow(run, schema)
