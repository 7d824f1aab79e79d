"""WARC archives compressed record by record with a shared Zstandard dictionary.

The dictionary is trained on a bounded sample of the records and stands in a skippable frame at the head of every
archive; each record is a frame of its own. A task closes an archive before the record that would take it past a number
of bytes or of records, so an archive is at most that large, or one record with the dictionary if that alone is larger. Spark's text
writer puts every archive in a file of its own on any file system and commits it whole, so a lost executor's archives are
simply written again: the line separator it wants is an empty skippable frame, which readers pass over.
"""

from __future__ import annotations

import base64
import io
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallkeeper.session import cut_lineage

DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = "P*M\x18\0\0\0\0"  # skippable frame 0x184D2A50 of length 0
REVISIT_BYTES = 1000
ARCHIVE_BYTES = 32 << 20  # of compressed frames; an archive is one row where it is written and read
ARCHIVE_RECORDS = 65_536
SAMPLE_RECORDS = 512
SAMPLE_BYTES = 8192
DICTIONARY_BYTES = 112_640
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(page: str, url: str | None, payload: bytes, size: int, digest: bytes, refers: str | None, date: str) -> bytes:
    """One WARC record; ``refers`` is the id of the response a revisit stands for."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{page}>",
            f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:x-page:{refers}>", f"WARC-Profile: {PROFILE}"]
    head += ["WARC-Payload-Digest: sha1:" + base64.b32encode(digest).decode(),
             "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(pages: DataFrame, id_column: str, html_column: str) -> bytes:
    """A dictionary from the heads of the SAMPLE_RECORDS records with the smallest hashes; empty if they are too few."""
    mark = F.xxhash64(F.col(id_column), F.col(html_column))
    chosen = pages.where(F.col(html_column).isNotNull()).select(mark.alias("h")).distinct().orderBy("h").limit(SAMPLE_RECORDS)
    heads = pages.select(mark.alias("h"), F.encode(F.substring(html_column, 1, SAMPLE_BYTES), "UTF-8").alias("b"))
    sample = heads.join(F.broadcast(chosen), "h").dropDuplicates(["h"]).orderBy("h").collect()
    records = [_record("0", f"http://host/{i}", bytes(r["b"]), len(r["b"]), bytes(20), None, DATE) for i, r in enumerate(sample)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records).as_bytes() if len(records) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url",
                   html_column: str = "html", revisit_bytes: int = REVISIT_BYTES, level: int = LEVEL,
                   archive_bytes: int = ARCHIVE_BYTES, archive_records: int = ARCHIVE_RECORDS, date: str = DATE) -> None:
    """Write one record per row to the archives of a new folder.

    Of rows with equal payloads of revisit_bytes or more, the one with the largest id is the response and the others
    revisit it; all shorter payloads are responses. Payloads count as equal if SHA-256 and length agree. A null html is
    the empty payload. Rows that repeat id and payload are written as often as they occur, as responses. A row without id
    revisits a row with id that has its payload, and is a response if there is none. An empty table gives a folder without
    records; a very long html is one record, in an archive of its own if it is past archive_bytes; other columns are not read.
    """
    trained = train_dictionary(pages, id_column, html_column)
    payload = F.encode(F.coalesce(F.col(html_column), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(id_column).cast("long").alias("page"), F.col(url_column).cast("string").alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("size"), F.unhex(F.sha1(payload)).alias("digest"),
        F.unhex(F.sha2(payload, 256)).alias("k"))
    # stored, so that its size is known and a payload with very many pages can be split over tasks
    keys = cut_lineage(rows.where(F.col("size") >= revisit_bytes).groupBy(F.col("k").alias("key"), F.col("size").alias("bytes")).agg(
        F.max("page").alias("response"), F.count("*").alias("n")).where("n > 1 AND response IS NOT NULL").drop("n"))
    known = rows.join(keys, (rows["k"] == keys["key"]) & (rows["size"] == keys["bytes"]), "left")
    refers = F.when(~F.col("page").eqNullSafe(F.col("response")), F.col("response"))
    ready = known.select("page", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "size", "digest", refers.alias("refers"))

    def frames(batches):
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        head = struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained
        held, size = [head], len(head)

        def archive():
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])

        def name(number):
            return "" if number is None else str(number)

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page", "url", "payload", "size", "digest", "refers"))):
                page, url, body, length, digest, refers = (x.as_py() for x in row)
                frame = packer.compress(_record(name(page), url, body or b"", length, digest, None if refers is None else name(refers), date))
                full = size + len(frame) + len(EMPTY_FRAME) > archive_bytes or len(held) > archive_records
                if full and len(held) > 1:
                    yield archive()
                    held, size = [head], len(head)
                held.append(frame)
                size += len(frame)
        if len(held) > 1:
            yield archive()

    ready.mapInArrow(frames, "archive binary").select(F.col("archive").cast("string").alias("value")).write.option(
        "lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def read_records(content: bytes):
    """Headers and block of each record of one archive."""
    source = io.BytesIO(content)
    head = source.read(8)
    trained = b""
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_MAGIC:
        trained = source.read(struct.unpack("<I", head[4:])[0])
    else:
        source.seek(0)
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
    lines = io.BufferedReader(opener.stream_reader(source, read_across_frames=True), 1 << 20)
    while version := lines.readline():
        if not version.strip():
            continue
        fields = {}
        while (line := lines.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        yield fields, lines.read(int(fields["content-length"]))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``page, url, record_type, refers_to, payload_bytes, payload_digest, payload`` of every record of the archives.

    For a response, size and digest are taken from the payload read; a revisit has them in its headers.
    """
    fields = [("page", "long"), ("url", "string"), ("record_type", "string"), ("refers_to", "long"),
              ("payload_bytes", "long"), ("payload_digest", "string"), ("payload", "binary")]

    def number(urn: str | None):
        digits = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
        return int(digits) if digits else None

    def parse(batches):
        import hashlib

        schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in fields])
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for head, block in read_records(content.as_py()):
                    http, _, body = block.partition(b"\r\n\r\n")
                    kind = head["warc-type"]
                    if kind == "response":
                        size, digest, payload = len(body), hashlib.sha1(body).hexdigest(), body
                    else:
                        size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        digest, payload = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex(), None
                    rows.append((number(head["warc-record-id"]), head.get("warc-target-uri"), kind,
                                 number(head.get("warc-refers-to")), size, digest, payload))
                    held += len(body)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, ", ".join(f"{n} {t}" for n, t in fields))
