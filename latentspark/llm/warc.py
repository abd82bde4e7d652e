"""WARC archives of pages, compressed record by record with a Zstandard dictionary that the archive carries itself.

A map task gathers records up to ARCHIVE_BYTES, trains a dictionary on records spread over the archive, and writes one file: a leading
skippable frame with the dictionary, then one frame for each record. The file goes to a new name in the shared folder, so a task that is
tried again harms nothing; only files named in the manifest count, and that is a saved table. The reader takes the manifest, finds each
frame by its block headers, and checks every payload against the digest in its record.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, shared_folder, sized_hint, tidy, until_exit, whole

#: Equal payloads of at least so many bytes are stored once.
REVISIT_FROM = 1000
#: Bytes of records in one archive; bytes of its records that train its dictionary, from records at even distances; the dictionary's size.
ARCHIVE_BYTES, TRAIN_BYTES, DICTIONARY_BYTES = 16 << 20, 1 << 20, 64 << 10
LEVEL = 3
#: Revisit ids that are broadcast at most; beyond, the join is shuffled.
BROADCAST_ROWS = 1_000_000
#: Fixed values of the formats.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def roles(pages: DataFrame) -> DataFrame:
    """pages with html as bytes in `payload` (null: empty), payload_bytes, payload_digest (SHA-1), record_type, refers_to.

    Of equal payloads of at least REVISIT_FROM bytes the one with the largest page_id is the response, the others revisit it. A null
    page_id is never the largest; if all ids of a group are null, all are responses. Rows that repeat the largest id are responses too.
    """
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "utf-8"), F.lit(b""))
    marked = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    narrow = marked.where(F.col("payload_bytes") >= REVISIT_FROM).select("page_id", "payload_digest")
    kept = narrow.groupBy("payload_digest").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1 and kept is not null").select("payload_digest", "kept")
    # ids alone are joined here; the payloads below meet one row for each page that revisits, at most
    again = narrow.join(kept, "payload_digest").where("page_id is null or page_id != kept").select(F.col("page_id").alias("__id"), F.col("payload_digest").alias("__digest"), F.col("kept").alias("refers_to")).distinct()
    again = sized_hint(saved(again), BROADCAST_ROWS)
    joined = marked.join(again, marked.page_id.eqNullSafe(F.col("__id")) & (marked.payload_digest == F.col("__digest")), "left").drop("__id", "__digest")
    return joined.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, record_type: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header but no payload."""
    http = HTTP % len(payload)
    block = http if record_type == "revisit" else http + payload
    uri = re.sub(rb"[\x00-\x20\x7f<>]", lambda m: b"%%%02X" % m[0][0], (url or f"urn:page:{page_id}").encode())
    fields = [b"WARC-Type: " + record_type.encode(), b"WARC-Record-ID: <urn:page:%s>" % str(page_id).encode(), b"WARC-Date: " + date.encode(), b"WARC-Target-URI: " + uri,
              b"WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)), b"X-Payload-Length: %d" % len(payload), b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    if record_type == "revisit":
        fields[1:1] = [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:page:%d>" % refers_to]
    return b"WARC/1.1\r\n" + b"\r\n".join(fields) + b"\r\n\r\n" + block + b"\r\n\r\n"


def trained(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from records at even distances; None if they are too few or too short to train one."""
    total = sum(map(len, records))
    step = max(1, total // TRAIN_BYTES)
    samples = [r[:65536] for r in records[::step]]
    if len(samples) < 8:
        return None
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8)), samples, k=128, d=8)
    except zstandard.ZstdError:
        return None


def archive_bytes(records: list[bytes]) -> bytes:
    dictionary = trained(records)
    out = io.BytesIO()
    if dictionary is not None:
        packed = zstandard.ZstdCompressor(level=19).compress(dictionary.as_bytes())
        out.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary) if dictionary is not None else zstandard.ZstdCompressor(level=LEVEL)
    for r in records:
        out.write(compressor.compress(r))
    return out.getvalue()


def frames(data: memoryview, at: int) -> Iterator[memoryview]:
    """The frames from `at` on, found by their block headers."""
    while at < len(data):
        parameters = zstandard.get_frame_parameters(data[at : at + 18])
        end = at + zstandard.frame_header_size(data[at : at + 18])
        last = False
        while not last:
            head = data[end] | data[end + 1] << 8 | data[end + 2] << 16
            last = bool(head & 1)
            end += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        end += 4 * parameters.has_checksum
        yield data[at:end]
        at = end


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive."""
    view, at, dictionary = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", data, 4)[0]
        raw = bytes(view[8 : 8 + size])
        if struct.unpack_from("<I", raw)[0] == FRAME:
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary, at = zstandard.ZstdCompressionDict(raw), 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary is not None else zstandard.ZstdDecompressor()
    for frame in frames(view, at):
        record = reader.decompress(frame)
        head, _, rest = record.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"not a WARC record: {version!r}")
        fields = dict(line.split(": ", 1) for line in lines)
        block = rest[: int(fields["Content-Length"])]
        if rest[len(block) :] != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        yield fields, block


@whole
def write_archives(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", folder: str | None = None) -> DataFrame:
    """Writes all rows of pages as records to new archives in folder; the saved manifest: path, records, raw_bytes, stored_bytes, folder.

    Without a folder they lie in a new one of the shared folder, which goes when the application ends. It can have any scheme that pyarrow.fs opens (file, hdfs, s3, gs). An empty table writes no archive.
    """
    if folder is None:
        folder = shared_folder(pages.sparkSession, lasting=True)
        until_exit(pages.sparkSession, folder)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        held: list[bytes] = []
        size = 0

        def out() -> pa.RecordBatch:
            data, name = archive_bytes(held), f"{base}/{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(name) as f:
                f.write(data)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([size], pa.int64()), pa.array([len(data)], pa.int64())], ["path", "records", "raw_bytes", "stored_bytes"])

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")]
            for i in range(batch.num_rows):
                r = record_bytes(*(c[i].as_py() for c in columns), date)
                held.append(r)
                size += len(r)
                if size >= ARCHIVE_BYTES:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return saved(roles(pages).select("page_id", "url", "payload", "payload_digest", "record_type", "refers_to").mapInArrow(tidy(rows), "path string, records long, raw_bytes long, stored_bytes long")).withColumn("folder", F.lit(folder))


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to of every record; a wrong digest is an error."""
    number = lambda x: None if x == "<urn:page:None>" else int(x[len("<urn:page:") : -1])
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, _ = fs.FileSystem.from_uri(folder)
                with store.open_input_stream(path) as f:
                    data = f.read()
                out: list[tuple] = []
                for fields, block in records_of(data):
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    n, kind, payload = int(fields["X-Payload-Length"]), fields["WARC-Type"], None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if len(payload) != n or hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{path}: a payload doesn't have its digest")
                    refers = number(fields["WARC-Refers-To"]) if kind == "revisit" else None
                    out.append((number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], payload, n, digest, kind, refers))
                    if len(out) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    archives = manifest.select("path", "folder").repartition(max(1, min(manifest.count(), 100_000)))
    return archives.mapInArrow(tidy(rows), "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")
