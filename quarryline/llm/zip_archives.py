"""WARC records in ZIP-packaged archives: a writer, and a reader by byte ranges.

Each archive is a ZIP file with two stored members: ``archive/data.warc.gz``, one gzip member for
each record, and ``indexes/index.cdxj``, a line for each record with its offset and length in the
WARC. The reader takes the end of the file, the central directory (ZIP64 too), the index member and
then each record's bytes; nothing is unpacked to disk. Files go through Arrow's file systems to the
folder in spark.checkpoint.dir, so executors read what others wrote.

Records: a page is a response, or a revisit of the response with the same payload. Of equal
payloads of at least MIN_REVISIT bytes the one with the largest page_id is the response.

Defined results: a null html is an empty payload; a null page_id is never the largest, and such a
page is a response unless a page with an id has the same payload; repeated rows with the largest
page_id are all responses; a null url is recorded as an empty one; an empty table makes no archive.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import SALTS, fresh_path, materialize, read_table, salts, ship

MIN_REVISIT = 1000
#: An archive is closed when its WARC has this many bytes.
ARCHIVE_BYTES = 32 << 20
WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"

# Fixed values of the ZIP format: signatures and field layouts.
LOCAL, CENTRAL, END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
END64, LOCATOR64 = b"PK\x06\x06", b"PK\x06\x07"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def file_system(uri: str):
    """Arrow's file system for a URI of a shared folder, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


# ---- ZIP


def zip_bytes(members: list[tuple[str, bytes]], zip64: bool = False) -> Iterator[bytes]:
    """A ZIP file with stored members, piece by piece; zip64: in the large format even if it is small."""
    at, directory = 0, b""
    for name, data in members:
        crc, size, raw = zlib.crc32(data), len(data), name.encode()
        big = zip64 or size >= FULL32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if big else b""
        shown = FULL32 if big else size
        head = LOCAL + struct.pack("<5H3L2H", 45 if big else 20, 0x800, 0, 0, 0x21, crc, shown, shown, len(raw), len(extra)) + raw + extra
        far = zip64 or at >= FULL32
        extra = (struct.pack("<QQ", size, size) if big else b"") + (struct.pack("<Q", at) if far else b"")
        extra = struct.pack("<HH", 1, len(extra)) + extra if extra else b""
        directory += CENTRAL + struct.pack("<6H3L5H2L", 45, 45 if big or far else 20, 0x800, 0, 0, 0x21, crc, shown, shown, len(raw), len(extra), 0, 0, 0, 0, FULL32 if far else at) + raw + extra
        yield head
        yield data
        at += len(head) + size
    n, size = len(members), len(directory)
    yield directory
    if zip64 or at >= FULL32 or n >= FULL16:
        yield END64 + struct.pack("<Q2H2L4Q", 44, 45, 45, 0, 0, n, n, size, at) + LOCATOR64 + struct.pack("<LQL", 0, at + size, 1)
        n, size, at = min(n, FULL16) if not zip64 else FULL16, FULL32, FULL32
    yield END + struct.pack("<4H2LH", 0, 0, n, n, size, at, 0)


def zip_members(read_at, length: int) -> dict[str, tuple[int, int]]:
    """(offset of the data, size) of each stored member; read_at(size, offset) gives bytes."""
    tail_at = max(0, length - 65_557)
    tail = read_at(length - tail_at, tail_at)
    end = tail.rfind(END)
    while end >= 0 and end + 22 + int.from_bytes(tail[end + 20 : end + 22], "little") != len(tail):
        end = tail.rfind(END, 0, end)
    if end < 0:
        raise ValueError("not a ZIP file: it has no end of central directory")
    n, size, at = struct.unpack("<H2L", tail[end + 10 : end + 20])
    if FULL16 == n or FULL32 in (size, at):
        locator = read_at(20, tail_at + end - 20)
        if locator[:4] == LOCATOR64:
            record = read_at(56, struct.unpack("<Q", locator[8:16])[0])
            if record[:4] != END64:
                raise ValueError("the ZIP64 end of central directory is not where its locator says")
            n, size, at = struct.unpack("<3Q", record[32:56])
    directory, found, p = read_at(size, at), {}, 0
    for _ in range(n):
        if directory[p : p + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method = int.from_bytes(directory[p + 10 : p + 12], "little")
        packed, plain = struct.unpack("<2L", directory[p + 20 : p + 28])
        names, extras, comment = struct.unpack("<3H", directory[p + 28 : p + 34])
        offset = int.from_bytes(directory[p + 42 : p + 46], "little")
        name = directory[p + 46 : p + 46 + names].decode()
        q, stop = p + 46 + names, p + 46 + names + extras
        while q + 4 <= stop:
            kind, room = struct.unpack("<2H", directory[q : q + 4])
            if kind == 1:  # 64-bit values of just the fields that are full
                values = iter(struct.unpack(f"<{room // 8}Q", directory[q + 4 : q + 4 + room // 8 * 8]))
                plain = next(values) if plain == FULL32 else plain
                packed = next(values) if packed == FULL32 else packed
                offset = next(values) if offset == FULL32 else offset
            q += 4 + room
        if method == 0:
            local = read_at(30, offset)
            if local[:4] != LOCAL:
                raise ValueError(f"no local header of {name}")
            found[name] = (offset + 30 + sum(struct.unpack("<2H", local[26:30])), packed)
        p = stop + comment
    return found


# ---- WARC


def warc_record(kind: str, page: int | None, url: str, payload: bytes, digest: str, original: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if kind == "response" else b"")
    url = "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in url)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Target-URI: {url}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{original}>", f"X-Payload-Length: {len(payload)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        parts: list[bytes] = []
        index: list[str] = []
        size = 0

        def close() -> pa.RecordBatch:
            name = f"{path}/{uuid.uuid4().hex}.zip"  # an attempt that is repeated leaves its own file unread
            with system.open_output_stream(name) as out:
                for piece in zip_bytes([(WARC, b"".join(parts)), (INDEX, "".join(index).encode())]):
                    out.write(piece)
            made = pa.RecordBatch.from_arrays([pa.array([os.path.basename(name)]), pa.array([len(index)], pa.int64())], names=["archive", "records"])
            parts.clear()
            index.clear()
            return made

        for whole in batches:
            for start in range(0, len(whole), 64):
                for row in whole.slice(start, 64).to_pylist():
                    payload = (row["html"] or "").encode()
                    kind = "response" if row["original"] is None else "revisit"
                    record = gzip.compress(warc_record(kind, row["page_id"], row["url"] or "", payload, row["digest"], row["original"]), 1, mtime=0)
                    index.append(json.dumps({"page": row["page_id"], "offset": size, "length": len(record)}) + "\n")
                    parts.append(record)
                    size += len(record)
                    if size >= ARCHIVE_BYTES:
                        yield close()
                        size = 0
        if index:
            yield close()

    return run


def _reader(folder: str):
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def number(urn: str) -> int | None:
        digits = urn.removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def one(source, at: int, length: int) -> tuple:
        headers, payload = parse_record(gzip.decompress(source.read_at(length, at)))
        digest = headers["warc-payload-digest"].removeprefix("sha1:")
        kind = headers["warc-type"]
        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError("a payload does not have its digest")
        size = len(payload) if kind == "response" else int(headers["x-payload-length"])
        refers = number(headers["warc-refers-to"]) if kind == "revisit" else None
        return number(headers["warc-record-id"]), headers["warc-target-uri"], size, digest, kind, refers, payload if kind == "response" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_file(f"{path}/{name}") as source:
                    members = zip_members(lambda size, at: source.read_at(size, at), source.size())  # noqa: B023
                    base, _ = members[WARC]
                    at, length = members[INDEX]
                    entries = [json.loads(x) for x in source.read_at(length, at).splitlines()]
                    for k in range(0, len(entries), 256):
                        rows = [one(source, base + e["offset"], e["length"]) for e in entries[k : k + 256]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def write_archives(pages: DataFrame, folder: str, least: int = MIN_REVISIT) -> DataFrame:
    """Write pages (page_id, url, html) to folder; (archive, records) of each archive, already written."""
    ship(pages.sparkSession)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    payload = F.coalesce(F.col("html"), F.lit(""))
    p = p.withColumn("digest", F.sha1(F.encode(payload, "UTF-8"))).withColumn("size", F.octet_length(payload))
    same = p.filter(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("n"))
    same = materialize(same.filter("n > 1 AND newest IS NOT NULL").select("digest", "size", "newest"), "payloads")
    same = same.select("digest", "size", "newest", F.explode(salts()).alias("s"))
    p = p.withColumn("s", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    p = p.join(same, ["digest", "size", "s"], "left")
    p = p.select("page_id", "url", "html", "digest", F.when(~F.col("newest").eqNullSafe(F.col("page_id")), F.col("newest")).alias("original"))
    return materialize(p.mapInArrow(_writer(folder), "archive string, records long"), "archives")


def read_archives(spark: SparkSession, archives: DataFrame, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for a revisit) of all records."""
    ship(spark)
    n = spark.sparkContext.defaultParallelism
    dealt = archives.select("archive").repartition(max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return dealt.mapInArrow(_reader(folder), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "zip")
    archives = write_archives(read_table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, archives, folder).drop("payload", "url")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS newest FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN newest IS NULL OR newest IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN newest IS DISTINCT FROM page_id THEN newest END AS refers_to
FROM m
"""
