"""WARC records in ZIP-packaged archives (operator 7).

``write_files`` packs one record a row into archive files: ZIP files whose members, a WARC file and an index of
its records, are stored without compression. ``records_of`` goes the way back without extraction: it finds
the end record of the central directory (and the ZIP64 one where a field is full), reads the
directory, takes the members' places from their local headers, deals the byte ranges that the indexes name
over tasks, and reads each record by its range. An index line is ``surt timestamp {json}``, or the JSON alone. Members that no
index names are walked record by record, gzip ones in pieces of ``PIECE_BYTES``. Files may
be on any system that Arrow reaches and executors share. A task that runs again writes new files, and only
those that its rows name are read. ``write`` and ``read`` do the same with archives in a binary column.

Duplicates: of records with equal payloads of ``LEAST`` bytes or more, the one with the smallest id
is the response, the others are revisits without payload that refer to it. Smaller payloads and
rows that repeat the smallest id itself are responses. A null id never is the smallest, so it is a
revisit if its payload stands elsewhere with an id. A null payload is an empty one.

The equal payloads of one digest may be a third of all rows: digests that a thousandth of the
duplicates have (so a thousand at most) are broadcast, and their rows keep out of the shuffle's key.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fresh_folder, read as read_table, stored

#: Payload bytes from which equal ones are not stored twice.
LEAST = 100
#: Bytes of records after which a task closes an archive.
ARCHIVE_BYTES = 4 << 20
#: Bytes of records whose rows are handed on at once.
BATCH_BYTES = 4 << 20

#: Bytes of a gzip member that are looked at at once, and those they may unpack to at a time.
PIECE_BYTES = 1 << 16

WARC_MEMBER = "archive/data.warc"
INDEX_MEMBER = "indexes/index.cdxj"
NOBODY = "<urn:nobody>"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

Source = Callable[[int, int], bytes]

RECORD = "id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"


class Member(NamedTuple):
    name: str
    method: int
    header: int
    size: int
    full_size: int


# ---------------------------------------------------------------- records


def record(id_: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record; a revisit (refers_to is not None) has the HTTP header of its payload only."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    named = lambda x: NOBODY if x is None else f"<urn:page:{_plain(x)}>"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {named(id_)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_plain(url)}")
    if any(x is not None and _plain(x) != x for x in (id_, url, refers_to)):
        lines.append("X-Fields: percent-encoded")
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is None:
        block += payload
    else:
        lines += [f"WARC-Refers-To: {named(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _plain(value: str) -> str:
    """Without line ends, which would end a header, and without white space at its ends, which readers drop."""
    return re.sub(r"[%\r\n]|^\s+|\s+$", lambda m: quote(m[0], safe=""), value)


def head(data: bytes, at: int = 0) -> tuple[dict[str, str], int]:
    """Header fields of the WARC or HTTP header at a place, and the place behind it."""
    to = data.find(b"\r\n\r\n", at)
    if to < 0:
        raise ValueError("a header without an end")
    fields = {}
    for line in data[at:to].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return fields, to + 4


def parsed(data: bytes) -> tuple:
    """(id, url, payload_bytes, digest, type, refers_to) and payload of the record in data."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    if data[:5] != b"WARC/":
        raise ValueError("no WARC record here")
    fields, at = head(data)
    block = data[at : at + int(fields["content-length"])]
    http, body = head(block) if block[:5] == b"HTTP/" else ({}, 0)
    payload = block[body:]
    kind = fields.get("warc-type", "")
    size, digest = len(payload), ""
    if kind == "revisit":
        size, digest = int(http.get("content-length", 0)), fields.get("warc-payload-digest", "").partition(":")[2]
    else:
        digest = hashlib.sha256(payload).hexdigest()
    raw = unquote if "x-fields" in fields else str
    name = lambda key: raw(fields[key].removeprefix("<urn:page:").removesuffix(">")) if fields.get(key, NOBODY) != NOBODY else None
    return (name("warc-record-id"), raw(fields["warc-target-uri"]) if "warc-target-uri" in fields else None, size, digest, kind, name("warc-refers-to")), payload


# ---------------------------------------------------------------- archives


def pack(records: list[tuple[str | None, bytes]], zip64: bool = False) -> bytes:
    """A ZIP archive of records with their index."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        index, at = [], 0
        with z.open(zipfile.ZipInfo(WARC_MEMBER), "w", force_zip64=zip64) as f:
            for id_, data in records:
                f.write(data)
                index.append(index_line(id_, data, at))
                at += len(data)
        z.writestr(zipfile.ZipInfo(INDEX_MEMBER), "\n".join(sorted(index)))
    return out.getvalue()


def index_line(id_: str | None, data: bytes, at: int) -> str:
    """A record's line of an index: its address with the host turned round, its time, and its place as JSON."""
    fields, _ = head(data)
    url = fields.get("warc-target-uri", "-")
    entry = {"url": url, "id": id_, "offset": str(at), "length": str(len(data)), "filename": WARC_MEMBER.rpartition("/")[2]}
    return f"{surt(url)} {re.sub('[^0-9]', '', fields.get('warc-date', '')) or '-'} {json.dumps(entry)}"


def surt(url: str) -> str:
    """com,example)/path?query of an address; what has no host stays, without white space and braces."""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname, parts.port
    except ValueError:
        host = None
    if not host:
        return quote(url, safe="/:?&=%") or "-"
    place = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return quote(place.lower(), safe="/:?&=%,)")


def indexed(text: str) -> Iterator[tuple[str | None, int, int]]:
    """(file name if there is one, offset, length) of the lines of an index; headers (! ...) and blank lines are none."""
    for line in text.split("\n"):
        brace = line.find("{")
        if brace >= 0 and not line.startswith("!"):
            entry = json.loads(line[brace:])
            yield entry.get("filename"), int(entry["offset"]), int(entry["length"])


def zipped(source: Source, start: int, size: int) -> Iterator[tuple[int, int]]:
    """(place, length) of the gzip streams that stand one after another; only a piece of them is held."""
    first = at = 0
    unzip = zlib.decompressobj(31)
    while at < size:
        piece = source(start + at, min(PIECE_BYTES, size - at))
        if not piece:
            raise ValueError("an archive that ends before its members")
        at += len(piece)
        while piece:
            unzip.decompress(piece, PIECE_BYTES)
            piece = unzip.unconsumed_tail
            if unzip.eof:
                piece = unzip.unused_data
                yield start + first, at - len(piece) - first
                first, unzip = at - len(piece), zlib.decompressobj(31)
    if first < size:  # cut off: whoever reads it says so
        yield start + first, size - first


def directory(source: Source, size: int) -> list[Member]:
    """Members by the central directory, with the ZIP64 records where there are any."""
    tail_size = min(size, 65_557 + 20)
    tail = source(size - tail_size, tail_size)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("not a ZIP archive")
    _, _, _, count, length, start = struct.unpack("<HHHHII", tail[end + 4 : end + 20])
    if (count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF) and end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        place = struct.unpack("<Q", tail[end - 12 : end - 4])[0]
        more = source(place, 56)
        if more[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record where its locator points")
        count, length, start = struct.unpack("<QQQ", more[32:56])
    entries, members, at = source(start, length), [], 0
    for _ in range(count):
        if entries[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack("<H", entries[at + 10 : at + 12])
        packed, full, n, e, c = struct.unpack("<IIHHH", entries[at + 20 : at + 34])
        header, = struct.unpack("<I", entries[at + 42 : at + 46])
        name = entries[at + 46 : at + 46 + n].decode("utf-8", "replace")
        extra, x = entries[at + 46 + n : at + 46 + n + e], 0
        while x + 4 <= len(extra):
            key, long = struct.unpack("<HH", extra[x : x + 4])
            if key == 1:  # the full fields stand here, in this order, if their short ones are all ones
                y = x + 4
                if full == 0xFFFFFFFF:
                    full, y = struct.unpack("<Q", extra[y : y + 8])[0], y + 8
                if packed == 0xFFFFFFFF:
                    packed, y = struct.unpack("<Q", extra[y : y + 8])[0], y + 8
                if header == 0xFFFFFFFF:
                    header = struct.unpack("<Q", extra[y : y + 8])[0]
            x += 4 + long
        members.append(Member(name, method, header, packed, full))
        at += 46 + n + e + c
    return members


def place(source: Source, member: Member) -> int:
    """Where a member's data begins: its local header has lengths of its own."""
    fixed = source(member.header, 30)
    if fixed[:4] != b"PK\x03\x04":
        raise ValueError("no local header where the directory points")
    name, extra = struct.unpack("<HH", fixed[26:30])
    return member.header + 30 + name + extra


def content(source: Source, member: Member) -> bytes:
    data = source(place(source, member), member.size)
    return zlib.decompress(data, -15) if member.method == 8 else data


def ranges(source: Source, size: int) -> Iterator[tuple[int, int]]:
    """(offset in the archive, length) of every record of the stored WARC members of an archive."""
    members = directory(source, size)
    index = [m for m in members if m.name.startswith("indexes/") and m.name.endswith(".cdxj")]
    data = [m for m in members if m.name.endswith((".warc", ".warc.gz"))]
    for m in data:
        if m.method:
            raise ValueError(f"{m.name} is compressed; ranges need stored members")
    starts = {m.name: place(source, m) for m in data}
    short = {name.rpartition("/")[2]: name for name in starts}
    named = set()
    for m in index:
        for name, at, length in indexed(content(source, m).decode()):
            name = data[0].name if len(data) == 1 else name if name in starts else short.get((name or "").rpartition("/")[2])
            if name is None:
                raise ValueError(f"{m.name} names none of several members")
            named.add(name)
            yield starts[name] + at, length
    for m in data:
        start, at = starts[m.name], 0
        if m.name in named:
            continue
        if m.name.endswith(".gz"):
            yield from zipped(source, start, m.size)
            continue
        while at < m.size:
            top = source(start + at, min(8192, m.size - at))
            fields, behind = head(top)
            length = min(behind + int(fields["content-length"]) + 4, m.size - at)
            yield start + at, length
            at += length


# ---------------------------------------------------------------- on Spark


def response_of(records: DataFrame) -> DataFrame:
    """records (id, digest, size, ...) with ``refers_to``: the response's id for revisits, else null."""
    same = records.where(F.col("size") >= LEAST).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    same = stored(same, "digests")
    many = same.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(same.where(F.col("n") * 1000 >= many).select("digest", F.col("first").alias("hot_first")))  # 1000 rows at most
    found = records.join(hot, "digest", "left")
    key = F.when(F.col("hot_first").isNull() & (F.col("size") >= LEAST), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("id", "digest").cast("string")))
    rest = same.where(F.col("n") * 1000 < many).select(F.col("digest").alias("key"), "first")
    found = found.withColumn("key", key).join(rest, "key", "left").withColumn("first", F.coalesce("hot_first", "first"))
    return found.withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col("id")), F.col("first"))).drop("key", "first", "hot_first")


def write(pages: DataFrame, id_: str, url: str, payload: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive binary) packed from the rows of pages; the caller stores them. Other columns are left out."""

    def run(batches):
        for data in _archives(batches, archive_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["archive"])

    return _records(pages, id_, url, payload).mapInArrow(run, "archive binary")


def write_files(pages: DataFrame, id_: str, url: str, payload: str, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(path, length) of the archive files that the rows of pages are written to, in a folder that executors share; a stored table."""

    def run(batches):
        system, inner = _system(folder)
        system.create_dir(inner, recursive=True)
        for data in _archives(batches, archive_bytes):
            name = f"{uuid.uuid4().hex}.zip"
            with system.open_output_stream(f"{inner}/{name}") as f:
                f.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(data)], pa.int64())], names=["path", "length"])

    return stored(_records(pages, id_, url, payload).mapInArrow(run, "path string, length long"), "archives")


def _records(pages: DataFrame, id_: str, url: str, payload: str) -> DataFrame:
    """(id, url, payload, size, digest, refers_to): what a record is made of; a revisit has no payload."""
    body = F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_).alias("id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = response_of(rows.withColumns({"digest": F.sha2("payload", 256), "size": F.length("payload").cast("long")}))
    return rows.select(F.col("id").cast("string").alias("id"), "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "size", "digest", F.col("refers_to").cast("string").alias("refers_to"))


def _archives(batches: Iterator[pa.RecordBatch], archive_bytes: int) -> Iterator[bytes]:
    held, size = [], 0
    for batch in batches:
        cols = [batch.column(i) for i in range(6)]
        for i in range(batch.num_rows):
            name, address, body, n, digest, refers = (c[i].as_py() for c in cols)
            data = record(name, address, body if refers is None else _Sized(n), digest, refers)
            held.append((name, data))
            size += len(data)
            if size >= archive_bytes:
                yield pack(held)
                held, size = [], 0
    if held:
        yield pack(held)


def _system(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


class _Sized:
    """Stands for a payload of which only the length counts."""

    def __init__(self, n: int):
        self.n = n

    def __len__(self) -> int:
        return self.n


def read(archives: DataFrame, column: str = "archive", payload: bool = False) -> DataFrame:
    """The records of archives in a binary column: RECORD, and the payload if asked for (null for revisits)."""

    def run(batches):
        for batch in batches:
            for cell in batch.column(0):
                if not cell.is_valid:
                    continue
                view = memoryview(cell.as_buffer())
                source = lambda at, n, v=view: bytes(v[at : at + n])
                yield _batch([parsed(source(at, n)) for at, n in ranges(source, len(view))], payload)

    return archives.select(column).mapInArrow(run, RECORD + ", payload binary" * payload)


def _batch(found: list[tuple], payload: bool) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    cols = [pa.array([r[0][i] for r in found], k) for i, k in enumerate(kinds)]
    names = [x.split()[0] for x in RECORD.split(", ")]
    if payload:
        cols.append(pa.array([None if r[0][4] == "revisit" else r[1] for r in found], pa.binary()))
    return pa.RecordBatch.from_arrays(cols, names=names + ["payload"] * payload)


def read_files(spark: SparkSession, path: str, glob: str = "*.zip", payload: bool = False, tasks: int | None = None) -> DataFrame:
    """The records of archive files under a path; files may be of any size."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return records_of(files.select("path", "length"), payload, tasks)


def records_of(files: DataFrame, payload: bool = False, tasks: int | None = None) -> DataFrame:
    """The records of the archive files of a table (path, length): RECORD, and the payload if asked for (null for revisits).

    First all directories and indexes are read, then the records by ranges that are dealt over tasks.
    """

    def opened(name: str):
        system, inner = _system(name)
        return system.open_input_file(inner)

    def listed(batches):
        for batch in batches:
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with opened(name) as f:
                    found = list(ranges(lambda at, n: f.read_at(n, at), size))
                yield pa.RecordBatch.from_pydict({"path": pa.array([name] * len(found), pa.string()), "at": pa.array([a for a, _ in found], pa.int64()), "n": pa.array([n for _, n in found], pa.int64())})

    def fetched(batches):
        file, last = None, None
        for batch in batches:
            found, size = [], 0
            for name, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                if name != last:
                    if file is not None:
                        file.close()
                    file, last = opened(name), name
                found.append(parsed(file.read_at(n, at)))
                size += n
                if size >= BATCH_BYTES:
                    yield _batch(found, payload)
                    found, size = [], 0
            if found:
                yield _batch(found, payload)
        if file is not None:
            file.close()

    places = files.mapInArrow(listed, "path string, at long, n long")
    piece = ["path", F.floor(F.col("at") / (64 << 20))]
    places = places.repartition(tasks, *piece) if tasks else places.repartition(*piece)
    return places.sortWithinPartitions("path", "at").mapInArrow(fetched, RECORD + ", payload binary" * payload)


def op7_warc_zip(spark, sf_dir) -> DataFrame:
    """Pages written to archives and read back."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archives = write_files(pages, "page_id", "url", "html", fresh_folder(spark, "archives"))
    return records_of(archives).select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY html)
SELECT page_id, n AS payload_bytes, sha256(p.html) AS payload_digest,
  CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN NULL ELSE first END AS refers_to
FROM p LEFT JOIN f ON f.html = p.html
"""
