"""WARC archives in Zstandard form, written and read by Spark.

An archive begins with a skippable frame that holds its dictionary; each record is a frame of its own. Spark's text
writer puts the frames into files, with its commits and retries: a row is a frame's bytes, and the line separator is an
empty skippable frame, which any reader passes over. Each task trains its file's dictionary on its first records.

Of records with equal payloads of LEAST_SHARED bytes or more, that with the smallest page_id is the response; the
others are revisits, which hold headers and no payload. Null html is an empty payload; rows without a page_id are always
responses and share nothing; of rows alike in page_id and payload one is the response. An empty table gives no record.

The reader checks the version line, the fields a record must have, the lengths of the record, its block and its
payload, and the digest of a payload that is there. What fails is a row with `error` set, as is a file that breaks off.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.llm.common import BATCH_BYTES, map_rows, ship, small, written

LEAST_SHARED = 100
#: Records a dictionary is trained on at most, by number and bytes, and its size.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 4 << 20, 32 << 10
#: The archive's date: the table has none.
DATE = "1970-01-01T00:00:00Z"
#: A record of more bytes is refused by the reader.
LARGEST = 1 << 30

# Fixed values of the formats.
DICTIONARY_MAGIC, SKIPPABLE, FRAME_MAGIC = 0x184D2A5D, range(0x184D2A50, 0x184D2A60), 0xFD2FB528
SEPARATOR = "P*M\x18\x00\x00\x00\x00"  # an empty skippable frame; every byte is ASCII
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, serial: int) -> bytes:
    """One record; `payload` is left out for revisits, `size` and `digest` are of the full payload."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    fields = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {serial}')}>", f"WARC-Date: {DATE}"]
    if url is not None:
        fields.append(f"WARC-Target-URI: {' '.join(url.split())}")
    if page_id is not None:
        fields.append(f"X-Page-ID: {page_id}")
    fields += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        fields += [f"X-Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {PROFILE}"]
    fields.append(f"Content-Length: {len(block)}")
    return ("WARC/1.1\r\n" + "\r\n".join(fields) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def dictionary_for(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the records; too few of them serve as they are."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(r[:4096] for r in records)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def dictionary_frame(dictionary: zstandard.ZstdCompressionDict) -> bytes:
    packed = zstandard.ZstdCompressor(level=10).compress(dictionary.as_bytes())
    return DICTIONARY_MAGIC.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed


def write(pages: DataFrame, path: str, files: int) -> None:
    """Writes `files` archives under `path` from page_id, url and html."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    shared = rows.where(F.col("page_id").isNotNull() & (F.col("size") >= LEAST_SHARED)).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = written(shared.where("n > 1").drop("n"), "payloads")
    named = rows.join(small(shared), "digest", "left").withColumn("first", F.when(F.col("page_id").isNotNull(), F.col("first")))
    lean = named.withColumn("payload", F.when(F.col("first").isNull() | (F.col("first") == F.col("page_id")), F.col("payload")))
    dealt = lean.repartition(files, F.coalesce("page_id", F.xxhash64("url", "digest"))).select("page_id", "url", "payload", "digest", "size", "first")
    ship(pages.sparkSession)
    frames = dealt.mapInArrow(_frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
    frames.write.option("lineSep", SEPARATOR).option("compression", "none").text(path)


def _records(batches) -> Iterator[bytes]:
    seen: set[tuple] = set()  # first records of shared payloads in this task
    serial = 0
    for batch in batches:
        for page_id, url, payload, digest, size, first in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            refers_to = first if first is not None and (first != page_id or (page_id, digest) in seen) else None
            if first is not None and first == page_id:
                seen.add((page_id, digest))
            serial += 1
            yield record(page_id, url, payload or b"", digest, size, refers_to, serial if page_id is None or page_id == refers_to else 0)


def _frames(batches) -> Iterator[pa.RecordBatch]:
    records = _records(batches)
    sample, held = [], 0
    for r in records:
        sample.append(r)
        held += len(r)
        if len(sample) >= SAMPLE_RECORDS or held >= SAMPLE_BYTES:
            break
    if not sample:
        return
    dictionary = dictionary_for(sample)
    packer = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=True, write_checksum=True)
    out = [dictionary_frame(dictionary)]
    size = 0
    for part in (sample, records):
        for r in part:
            out.append(packer.compress(r))
            size += len(out[-1])
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
                out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at `at` ends, by its headers alone."""
    described = data[at + 4]
    single, content = described >> 5 & 1, (0, 2, 4, 8)[described >> 6]
    place = at + 5 + (not single) + (0, 1, 2, 4)[described & 3] + (content or single)
    while True:
        header = int.from_bytes(data[place : place + 3], "little")
        if place + 3 > len(data):
            raise ValueError("frame breaks off")
        kind, size = header >> 1 & 3, header >> 3
        place += 3 + (1 if kind == 1 else size)
        if header & 1:
            break
    place += 4 * (described >> 2 & 1)
    if place > len(data):
        raise ValueError("frame breaks off")
    return place


def parse(raw: bytes) -> dict:
    """A record's fields after all checks; ValueError says what fails."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        raise ValueError("no version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("field without colon")
        fields[name.strip()] = value.strip()
    for name in NEEDED:
        if name not in fields:
            raise ValueError(f"no {name}")
    length = int(fields["Content-Length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("length of block")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    sizes = [int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response":
        if sizes != [len(payload)]:
            raise ValueError("length of payload")
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("digest of payload")
    elif kind == "revisit":
        if payload or len(sizes) != 1 or "X-Refers-To-Page-ID" not in fields:
            raise ValueError("revisit")
    else:
        raise ValueError("type of record")
    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
    return {"page_id": None if page is None else int(page), "url": fields.get("WARC-Target-URI"), "record_type": kind, "payload_bytes": sizes[0], "payload_digest": digest, "refers_to": None if refers is None else int(refers), "payload": payload if kind == "response" else None}


def records_of(data: bytes) -> Iterator[tuple[int, dict | None, str | None]]:
    """Offset, fields and error of each record of an archive."""
    view, at, unpacker = memoryview(data), 0, None
    while at < len(data):
        begin = at
        try:
            magic = int.from_bytes(view[at : at + 4], "little")
            if magic in SKIPPABLE:
                size = int.from_bytes(view[at + 4 : at + 8], "little")
                at += 8 + size
                if at > len(data):
                    raise ValueError("skippable frame breaks off")
                if magic == DICTIONARY_MAGIC and begin == 0:
                    held = bytes(view[8:at])
                    if int.from_bytes(held[:4], "little") == FRAME_MAGIC:
                        held = zstandard.ZstdDecompressor().decompress(held, max_output_size=LARGEST)
                    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
                continue
            if magic != FRAME_MAGIC:
                raise ValueError("no frame")
            at = frame_end(view, at)
        except (ValueError, IndexError, zstandard.ZstdError) as fault:
            yield begin, None, f"archive: {fault}"  # what follows has no known beginning
            return
        try:
            frame = view[begin:at]
            if zstandard.frame_content_size(frame) > LARGEST:
                raise ValueError("record too large")
            unpacker = unpacker or zstandard.ZstdDecompressor()
            yield begin, parse(unpacker.decompress(frame, max_output_size=LARGEST)), None
        except (ValueError, zstandard.ZstdError) as fault:
            yield begin, None, str(fault)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record: file, offset, page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload, error.

    A file is read whole by one task, so files should hold some ten to hundred MB.
    """
    names = ("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload")

    def make():
        def row(file, content):
            for offset, fields, error in records_of(content):
                values = [None] * len(names) if fields is None else [fields[n] for n in names]
                yield file, offset, *(values if payloads else [*values[:-1], None]), error

        return row

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    schema = "file string, offset long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, error string"
    return map_rows(files.select(F.col("path").alias("file"), "content"), make, schema)
