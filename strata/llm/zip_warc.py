"""Web archives packaged in ZIP files: a writer, and a reader that never extracts.

An archive is a ZIP whose members are stored, not deflated: ``archive/data.warc.gz`` (one
gzip member per WARC record) and ``indexes/index.cdxj`` (offset and length of each record).
Writing: equal payloads are found by an aggregate of digests, each task then writes archives
of a bounded size into the shared folder under names of its own attempt and returns a
manifest, so a retried or lost task leaves no half archive in use. Reading: the end of each
file gives the central directory (also ZIP64), its entries give the stored members, the
index gives the records, and tasks read byte ranges of neighbouring records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from strata.llm.common import parts_for
from strata.session import persist_table, scratch_path

#: Payloads below this size are always stored whole.
MIN_BYTES = 0
#: Compressed bytes after which a task starts another archive; records read by one task at a time.
ARCHIVE_BYTES, RANGE_BYTES, GAP = 16 << 20, 32 << 20, 64 << 10
DATE = "1970-01-01T00:00:00Z"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"

# Fixed values of the ZIP format: signatures and the marks that stand for "see ZIP64".
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL16, FULL32, STORED, EXTRA64 = 0xFFFF, 0xFFFFFFFF, 0, 1


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI of the shared folder."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- ZIP ---------------------------------------------------------------------------------------


def zip_stored(members: list[tuple[str, list[bytes]]]) -> list[bytes]:
    """The chunks of a ZIP64 file with the members stored."""
    out: list[bytes] = []
    central: list[bytes] = []
    at = 0

    def put(b: bytes) -> None:
        nonlocal at
        out.append(b)
        at += len(b)

    for name, chunks in members:
        raw, size, crc, start = name.encode(), sum(map(len, chunks)), 0, at
        for c in chunks:
            crc = zlib.crc32(c, crc)
        extra = struct.pack("<HHQQ", EXTRA64, 16, size, size)
        put(LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x800, STORED, 0, 33, crc, FULL32, FULL32, len(raw), len(extra)) + raw + extra)
        for c in chunks:
            put(c)
        extra = struct.pack("<HHQQQ", EXTRA64, 24, size, size, start)
        central.append(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x800, STORED, 0, 33, crc, FULL32, FULL32, len(raw),
                                             len(extra), 0, 0, 0, 0, FULL32) + raw + extra)
    start = at
    for c in central:
        put(c)
    end64 = at
    put(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, len(central), len(central), end64 - start, start))
    put(LOCATOR64 + struct.pack("<IQI", 0, end64, 1))
    put(END + struct.pack("<HHHHIIH", 0, 0, FULL16, FULL16, FULL32, FULL32, 0))
    return out


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int


def _extra64(extra: bytes, want: list[bool]) -> list[int | None]:
    """The ZIP64 values (in the format's order) for the fields that are marked as too large."""
    while len(extra) >= 4:
        kind, n = struct.unpack_from("<HH", extra)
        if kind == EXTRA64:
            values = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
            return [next(values) if w else None for w in want]
        extra = extra[4 + n :]
    return [None] * len(want)


def directory(f, size: int) -> list[Member]:
    """The members listed in the central directory of a ZIP file, by range reads only."""
    tail_at = max(0, size - (22 + FULL16 + 20))
    tail = f.read_at(size - tail_at, tail_at)
    end = tail.rfind(END)
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(END, 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    _, _, _, count, length, start, _ = struct.unpack_from("<HHHHIIH", tail, end + 4)
    where = tail_at + end - 20
    if where >= 0 and (loc := f.read_at(20, where))[:4] == LOCATOR64:
        (at,) = struct.unpack_from("<Q", loc, 8)
        record = f.read_at(56, at)
        if record[:4] != END64:
            raise ValueError("bad ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    block = f.read_at(length, start)
    out, p = [], 0
    for _ in range(count):
        if block[p : p + 4] != CENTRAL:
            raise ValueError("bad central directory entry")
        _, _, flags, method, _, _, _, packed, plain, n, m, k, _, _, _, header = struct.unpack_from("<HHHHHHIIIHHHHHII", block, p + 4)
        raw, extra = block[p + 46 : p + 46 + n], block[p + 46 + n : p + 46 + n + m]
        large = _extra64(extra, [plain == FULL32, packed == FULL32, header == FULL32])
        packed, header = (packed if large[1] is None else large[1]), (header if large[2] is None else large[2])
        out.append(Member(raw.decode("utf-8" if flags & 0x800 else "cp437"), method, packed, header))
        p += 46 + n + m + k
    return out


def data_start(f, m: Member) -> int:
    """Where a stored member's bytes begin: its local header has lengths of its own."""
    head = f.read_at(30, m.header)
    if head[:4] != LOCAL:
        raise ValueError(f"bad local header of {m.name}")
    if m.method != STORED:
        raise ValueError(f"{m.name} is not stored")
    n, k = struct.unpack_from("<HH", head, 26)
    return m.header + 30 + n + k


# --- WARC --------------------------------------------------------------------------------------


def record_bytes(kind: str, record_id: str, url: str, digest: str, length: int, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record. A revisit keeps the HTTP head, with the full payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Target-URI: {url}", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of one WARC record; a response's payload must have the digest that its head names."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    full = next((int(v) for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:]) if k.strip().lower() == "content-length"), len(payload))
    digest = h["warc-payload-digest"].removeprefix("sha1:")
    if h["warc-type"] == "response" and (len(payload) != full or digest32(payload) != digest):
        raise ValueError(f"payload of {h['warc-record-id']} does not match its digest")
    return {"record_type": h["warc-type"], "record_id": h["warc-record-id"].strip("<>"), "url": h["warc-target-uri"], "payload_digest": digest,
            "payload_bytes": full, "refers_to": h.get("warc-refers-to", "").strip("<>") or None, "payload": payload if h["warc-type"] == "response" else None}


_RECORD = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()),
                     ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())])
_RECORD_SQL = "record_type string, record_id string, url string, payload_digest string, payload_bytes long, refers_to string, payload binary"


@F.arrow_udf(StringType())
def _base32(hexes: pa.Array) -> pa.Array:
    return pa.array([base64.b32encode(bytes.fromhex(x)).decode() for x in hexes.to_pylist()], pa.string())


def plan_records(records: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """records (id, url, payload) -> (id, url, payload, digest, kind, refers_to). Of the records with
    equal payloads of at least min_bytes the smallest id is the response; null ids are never referred to."""
    sized = records.select("id", "url", F.coalesce("payload", F.lit(b"")).alias("payload")).withColumn("hex", F.sha1("payload"))
    firsts = (sized.filter(F.length("payload") >= min_bytes).groupBy("hex")
              .agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("hex", "first"))
    later = sized.select("id", "hex").join(firsts, "hex").filter("id <> first").select("id", "hex", "first").distinct()
    out = sized.join(later, ["id", "hex"], "left")
    return out.select("id", "url", "payload", _base32("hex").alias("digest"), F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("kind"),
                      F.col("first").alias("refers_to"))


def write_archives(planned: DataFrame, folder: str, prefix: str = "urn:page:", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ZIP-packaged archives into ``folder`` and return their manifest (path, bytes, records).

    Run it once (write the manifest to a table): names carry the attempt, so files of attempts
    that did not finish are not in the manifest and are never read.
    """

    def save(k: int, chunks: list[bytes], index: list[tuple[str, str]]) -> tuple[str, int, int]:
        body = "".join(f"{key} {DATE} {value}\n" for key, value in sorted(index)).encode()
        package = json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}).encode()
        parts = zip_stored([("datapackage.json", [package]), (DATA, chunks), (INDEX, [body])])
        t = TaskContext.get()
        path = f"{folder.rstrip('/')}/part-{t.partitionId():05d}-{t.taskAttemptId()}-{k:04d}.zip"
        fs, p = open_fs(path)
        fs.create_dir(p.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(p) as f:
            for c in parts:
                f.write(c)
        return path, sum(map(len, parts)), len(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: list[bytes] = []
        index: list[tuple[str, str]] = []
        at = k = 0
        done = []
        for b in batches:
            for r in zip(*(b.column(i) for i in range(b.num_columns))):
                i, url, payload, digest, kind, refers = (x.as_py() for x in r)
                url = quote(url or "about:blank", safe="!#$%&'()*+,/:;=?@[]~-._")
                to = None if refers is None else f"{prefix}{refers}"
                raw = gzip.compress(record_bytes(kind, f"{prefix}{'-' if i is None else i}", url, digest, len(payload), payload, to), 4, mtime=0)
                index.append((url, json.dumps({"digest": f"sha1:{digest}", "offset": at, "length": len(raw), "filename": DATA})))
                chunks.append(raw)
                at += len(raw)
                if at >= archive_bytes:
                    done.append(save(k, chunks, index))
                    chunks, index, at, k = [], [], 0, k + 1
        if index:
            done.append(save(k, chunks, index))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["path", "bytes", "records"])

    return planned.mapInArrow(run, "path string, bytes long, records long")


def list_records(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """archives (path, bytes) -> a row per record of the index: path, offset in the file, length, range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, p = open_fs(path)
                with fs.open_input_file(p) as f:
                    members = {m.name: m for m in directory(f, size)}
                    starts = {n: data_start(f, m) for n, m in members.items() if n.startswith("archive/")}
                    for n, m in members.items():
                        if not n.startswith("indexes/"):
                            continue
                        rows = [json.loads(x.split(" ", 2)[2]) for x in f.read_at(m.size, data_start(f, m)).decode().split("\n") if x]
                        if rows:
                            at = [starts[r["filename"]] + r["offset"] for r in rows]
                            yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(at, pa.int64()), pa.array([r["length"] for r in rows], pa.int64()),
                                                              pa.array([x // range_bytes for x in at], pa.int64())], names=["path", "at", "length", "span"])

    return archives.select("path", "bytes").mapInArrow(run, "path string, at long, length long, span long")


def read_records(archives: DataFrame, columns: list[str] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """archives (path, bytes) -> one row per WARC record. Ranges of an archive are dealt to tasks, and
    records next to each other are fetched by one read of at most range_bytes and one record."""
    names = columns or _RECORD.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(b.column(i).to_pylist() for i in range(3))))
            i = 0
            while i < len(rows):
                path, start, n = rows[i]
                j, end = i + 1, start + n
                while j < len(rows) and rows[j][0] == path and 0 <= rows[j][1] - end <= GAP and rows[j][1] + rows[j][2] - start <= range_bytes:
                    end = rows[j][1] + rows[j][2]
                    j += 1
                fs, p = open_fs(path)
                with fs.open_input_file(p) as f:
                    raw = f.read_at(end - start, start)
                got = [parse_record(zlib.decompress(raw[at - start : at - start + m], 31)) for _, at, m in rows[i:j]]
                yield pa.RecordBatch.from_pylist([{c: r[c] for c in names} for r in got], pa.schema([_RECORD.field(c) for c in names]))
                i = j

    # A row stands for a range of bytes far larger than itself: a set number of tasks, not one by rows' sizes.
    total = archives.agg(F.sum("bytes")).first()[0] or 0
    listed = list_records(archives, range_bytes).repartition(parts_for(archives, total, range_bytes), "path", "span").sortWithinPartitions("path", "at").select("path", "at", "length")
    kept = [c.strip() for c in _RECORD_SQL.split(",") if c.split()[0] in names]
    return listed.mapInArrow(run, ", ".join(sorted(kept, key=lambda c: names.index(c.split()[0]))))


def archive_round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES, name: str = "zip-warc") -> DataFrame:
    """pages (page_id, url, html) written as archives and read back: page_id, payload_bytes,
    payload_digest, record_type, refers_to; a row per input row.

    A null html is an empty payload, a null url 'about:blank'. Records without an id are
    responses whatever their payload, and their page_id is null again.
    """
    records = pages.select(F.col("page_id").cast("long").alias("id"), F.col("url").cast("string").alias("url"),
                           F.col("html").cast("string").cast("binary").alias("payload"))
    folder = scratch_path(pages.sparkSession, f"{name}-archives")
    manifest = persist_table(write_archives(plan_records(records, min_bytes), folder), f"{name}-manifest")
    # A manifest row is one archive: dealt out, so that tasks read a few each.
    archives = manifest.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    got = read_records(archives, ["record_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    page = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) as long)")
    return got.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
