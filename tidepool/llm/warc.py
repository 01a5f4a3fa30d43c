"""WARC archives of dictionary-compressed records, and their reading."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, HOT, shared_folder, spread_join, written

#: Fixed values of the formats: the skippable frame that holds a dictionary, and a dictionary's own magic number.
SKIPPABLE, DICTIONARY = 0x184D2A5D, b"\x37\xa4\x30\xec"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 16


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record.  A revisit has the response's HTTP header, which tells the payload's size, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Page-Id: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"Refers-To-Page: {'' if refers_to is None else refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def dictionary_of(records: list[bytes], size: int) -> bytes:
    """A dictionary trained on these records; of too few to train on, their beginnings as they are."""
    try:
        return zstandard.train_dictionary(size, records).as_bytes()
    except zstandard.ZstdError:
        return (b"\0" + b"".join(r[:1024] for r in records)[-size:]).ljust(8, b"\0")


def as_dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == DICTIONARY else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(raw, dict_type=kind)


class Archive:
    """A file being written: first records are held until a dictionary is built from them."""

    def __init__(self, fs: FileSystem, path: str, held: int, size: int, level: int):
        self.fs, self.path, self.most, self.size, self.level = fs, path, held, size, level
        self.held: list[bytes] = []
        self.held_bytes = self.records = self.bytes = 0
        self.out = self.compress = None

    def add(self, raw: bytes) -> None:
        self.records += 1
        if self.compress:
            return self.write(self.compress(raw))
        self.held.append(raw)
        self.held_bytes += len(raw)
        if self.held_bytes >= self.most:
            self.start()

    def write(self, data: bytes) -> None:
        self.bytes += self.out.write(data)

    def start(self) -> None:
        # no sample is over 64 KiB, or one long page would be the dictionary
        raw = dictionary_of([r[:65_536] for r in self.held], self.size)
        self.out = self.fs.open_output_stream(self.path, compression=None)
        self.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
        self.compress = zstandard.ZstdCompressor(level=self.level, dict_data=as_dictionary(raw)).compress
        held, self.held = self.held, []
        for r in held:
            self.write(self.compress(r))

    def close(self) -> tuple[str, int, int]:
        if not self.compress:
            self.start()
        self.out.close()
        return self.path, self.records, self.bytes


def read_archive(fs: FileSystem, path: str) -> Iterator[bytes]:
    """The records of an archive, each decompressed by itself with the leading dictionary."""
    with fs.open_input_stream(path, compression=None) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{path}: no leading dictionary")
        reader = zstandard.ZstdDecompressor(dict_data=as_dictionary(f.read(size)))
        one, out = None, []
        while data := f.read(CHUNK):
            while data:
                one = one or reader.decompressobj()
                out.append(one.decompress(data))
                data = one.unused_data if one.eof else b""
                if one.eof:
                    yield b"".join(out)
                    one, out = None, []
        if one:
            raise ValueError(f"{path}: ends within a record")


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, size: int = 32_768, held: int = 2 << 20, most: int = 256 << 20, level: int = 3, hot: int = HOT, few: int = BROADCAST_ROWS) -> DataFrame:
    """Writes every page as a record and returns the archives: ``path, records, bytes``.

    Of pages with equal payloads of ``least_bytes`` or more, that with the smallest page_id is the response and
    others revisit it; if several rows share that page_id, the one that stands first in the table is the response and the
    rest, too, revisit its id.  Which payloads repeat is found from digests alone; the pages themselves are read again, and
    are not shuffled unless the list of repeated payloads is too long to send to all tasks, nor are the pages of a payload
    that over ``hot`` pages have.  An archive's dictionary is built from its first ``held`` bytes of records.  Files are
    written under names of their own by each attempt of a task, so a task that runs again overwrites nothing; the returned
    table names the files that count.  Null html is an empty payload; a null page_id is never referred to unless no other
    is there.  Other columns are not looked at."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark)
    html = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.monotonically_increasing_id().alias("place"))
    digest = F.unhex(F.sha1(F.encode("html", "utf-8")))
    # payloads that are too short to be referred to get a digest of their own
    pages = pages.withColumn("digest", F.when(F.octet_length("html") >= least_bytes, digest).otherwise(F.encode(F.col("place").cast("string"), "utf-8")))
    first = F.min(F.struct(F.isnull("page_id").alias("no_id"), "page_id", "place"))
    twice = pages.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), first.alias("first")).where("n > 1")
    twice = written(twice.select("digest", "n", F.col("first.page_id").alias("first"), F.col("first.place").alias("at")), "repeated")
    if twice.count() <= few:
        marked = pages.join(F.broadcast(twice.drop("n")), "digest", "left")
    else:
        # pages by their digest's n: one list of all digests, so that single pages need no second look
        every = pages.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
        every = written(every.select("digest", "n", F.col("first.page_id").alias("first"), F.col("first.place").alias("at")), "digests")
        marked = spread_join(pages, every, "digest", hot)
    marked = marked.select("page_id", "url", "html", "first", (F.col("at").isNotNull() & (F.col("at") != F.col("place"))).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:/") else f"file://{folder}")
        fs.create_dir(root, recursive=True)
        archive, done = None, []
        for batch in batches:
            for page_id, url, html, first, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                archive = archive or Archive(fs, f"{root}/{uuid.uuid4().hex}.warc.zst", held, size, level)
                archive.add(record(page_id, url, html.encode(), first, again))
                if archive.bytes >= most:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*((f"{folder}/{p.rpartition('/')[2]}", n, b) for p, n, b in done), strict=True)], ["path", "records", "bytes"])

    return written(marked.mapInArrow(run, "path string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame, batch: int = 512) -> DataFrame:
    """The records of the archives: ``page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload``.

    A response's digest and size are those of the payload as read; a revisit has no payload, and its header's."""
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def rows(path: str) -> Iterator[tuple]:
        fs, at = FileSystem.from_uri(path if "://" in path or path.startswith("file:/") else f"file://{path}")
        for raw in read_archive(fs, at):
            fields, block = parse(raw)
            http, _, payload = block.partition(b"\r\n\r\n")
            told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
            kind, number = fields["WARC-Type"], lambda k: int(fields[k]) if fields.get(k) else None
            if kind == "response":
                if base32_sha1(payload) != told or len(payload) != size:
                    raise ValueError(f"{path}: a payload differs from its digest")
            yield number("Page-Id"), fields["WARC-Target-URI"], kind, told, size, number("Refers-To-Page"), payload if kind == "response" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                held: list[tuple] = []
                for row in rows(path):
                    held.append(row)
                    if len(held) >= batch:
                        yield make(held)
                        held = []
                if held:
                    yield make(held)

    def make(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    paths = archives.select("path")
    count = max(1, paths.count())
    return paths.repartition(count, "path").mapInArrow(run, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")
