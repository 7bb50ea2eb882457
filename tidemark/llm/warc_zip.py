"""WARC records in ZIP packages: written by tasks, and read back by ranges without unpacking.

A package holds stored members: archives, in which each record is a gzip member of its own or lies as it is,
and indexes, whose lines say where each record lies. The reader parses the central directory (and its ZIP64
form) at the package's end, finds all archives and indexes, whatever their names, and reads indexes and
records by range. The writer makes one archive and one index.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import os
import re
import struct
import uuid
import zipfile
import zlib
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import scratch, staged, table

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ARCHIVES, INDEXES = re.compile(r"\.warc(\.gz)?$", re.I), re.compile(r"\.cdxj?(\.gz)?$", re.I)
#: Pages have no time of capture.
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# Files by range, local or in any store that pyarrow knows


def create(uri: str):
    at = urlparse(uri)
    if at.scheme in ("", "file"):
        os.makedirs(os.path.dirname(path := unquote(at.path)), exist_ok=True)
        return open(path, "wb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path))
    return store.open_output_stream(path)


def open_ranges(uri: str):
    at = urlparse(uri)
    if at.scheme in ("", "file"):
        return open(unquote(at.path), "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def read_range(f, at: int, n: int) -> bytes:
    f.seek(at)
    if len(out := f.read(n)) != n:
        raise ValueError(f"the package ends before {at + n}")
    return out


# The ZIP directory


@dataclass
class Member:
    name: str
    method: int
    size: int
    at: int  # of its local header


def members(f) -> list[Member]:
    """The members that the central directory of a ZIP file names, in its order."""
    end = f.seek(0, 2)
    end = f.tell() if end is None else end
    tail = read_range(f, end - min(end, 65_557), min(end, 65_557))
    at = len(tail)
    while (at := tail.rfind(b"PK\5\6", 0, at)) >= 0:  # the signature may also occur in the comment
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
    if at < 0:
        raise ValueError("no end of a central directory")
    count, size, begin = struct.unpack_from("<HII", tail, at + 10)
    if count == 0xFFFF or 0xFFFFFFFF in (size, begin):
        where = end - len(tail) + at - 20
        if where >= 0 and (locator := read_range(f, where, 20))[:4] == b"PK\6\7":
            record = read_range(f, struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 end of a central directory where the locator says")
            count, size, begin = struct.unpack_from("<QQQ", record, 32)
    entries, at, out = read_range(f, begin, size), 0, []
    for _ in range(count):
        if entries[at : at + 4] != b"PK\1\2":
            raise ValueError("no central directory entry where one must be")
        flags, method = struct.unpack_from("<HH", entries, at + 8)
        packed, full, names, extras, comment = struct.unpack_from("<IIHHH", entries, at + 20)
        header = struct.unpack_from("<I", entries, at + 42)[0]
        name = entries[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
        x, stop = at + 46 + names, at + 46 + names + extras
        while x + 4 <= stop:
            kind, n = struct.unpack_from("<HH", entries, x)
            if kind == 1:  # ZIP64 has, in this order, those of the sizes and the offset that don't fit above
                large = iter(struct.unpack_from(f"<{n // 8}Q", entries, x + 4))
                full = next(large) if full == 0xFFFFFFFF else full
                packed = next(large) if packed == 0xFFFFFFFF else packed
                header = next(large) if header == 0xFFFFFFFF else header
            x += 4 + n
        out.append(Member(name, method, packed, header))
        at = stop + comment
    return out


def stored_at(f, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method:
        raise ValueError(f"{member.name} is compressed, not stored")
    header = read_range(f, member.at, 30)
    if header[:4] != b"PK\3\4":
        raise ValueError(f"no local header of {member.name} where the directory says")
    return member.at + 30 + sum(struct.unpack_from("<HH", header, 26))


# Records


def urn(kind: str, page_id, nth: int = 0) -> str:
    """A record's id; a page's response has the same one wherever it is written."""
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{page_id}:{nth}').urn}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, nth: int = 0) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    lines = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", urn(kind, page_id, nth * (kind == "revisit"))),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Payload-Length", len(payload)),
    ]
    if page_id is not None:
        lines.append(("Page-ID", page_id))
    if url is not None:
        lines.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to is not None:
        lines += [("WARC-Refers-To", urn("response", refers_to)), ("Refers-To-Page", refers_to), ("WARC-Profile", REVISIT)]
    body = payload if refers_to is None else b""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*lines, ("Content-Length", len(body))])
    return f"WARC/1.1\r\n{head}\r\n".encode() + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record where the index says")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    return fields, rest[: int(fields["content-length"])]


def page_of(n: str | None) -> int | None:
    return int(n) if n and n.lstrip("-").isdigit() else None


def sort_key(url: str | None) -> str:
    """A URL with its host's labels turned round, as indexes are sorted by; one without a host is its own key."""
    at = urlparse(url or "-")
    return (f"{','.join(reversed(at.netloc.lower().split('.')))}){at.path or '/'}{'?' + at.query if at.query else ''}" if at.netloc else url or "-").replace(" ", "%20").replace("\n", "%0A")


def index_line(url: str | None, page_id, at: int, n: int, digest: str) -> str:
    said = {"url": url, "digest": f"sha1:{digest}", "length": n, "offset": at, "filename": DATA.rpartition("/")[2], "page": page_id}
    return f"{sort_key(url)} {re.sub('[^0-9]', '', DATE)} {json.dumps(said)}"


def entries_of(raw: bytes, name: str) -> list[tuple[str, int, int]]:
    """(archive's file name, offset, length) of the lines of an index; empty, comment and header lines hold none."""
    text = (gzip.decompress(raw) if name.lower().endswith(".gz") else raw).decode("utf-8", "replace")
    found = [json.loads(line[line.index("{") :]) for line in text.split("\n") if "{" in line and not line.startswith("!")]
    return [(e.get("filename") or "", int(e["offset"]), int(e["length"])) for e in found if "offset" in e and "length" in e]


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class Package:
    """A package while a task writes it."""

    def __init__(self, uri: str):
        self.uri, self.file, self.index, self.at, self.n = uri, create(uri), [], 0, 0
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(DATA, "w", force_zip64=True)

    def add(self, page_id, url: str | None, raw: bytes, digest: str) -> None:
        packer = zlib.compressobj(3, zlib.DEFLATED, 31)
        packed = packer.compress(raw) + packer.flush()
        self.data.write(packed)
        self.index.append(index_line(url, page_id, self.at, len(packed), digest))
        self.at += len(packed)
        self.n += 1

    def close(self) -> tuple[str, int]:
        self.data.close()
        self.zip.writestr(INDEX, "\n".join(sorted(self.index)))
        self.zip.close()
        self.file.close()
        return self.uri, self.n


def _write(folder: str, most: int):
    def run(batches):
        from pyspark import TaskContext

        task, n, package, done = TaskContext.get(), 0, None, []
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if package is None:
                    package, n = Package(f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{n}.wacz"), n + 1
                payload = (html or "").encode()
                digest = digest_of(payload)
                package.add(page_id, url, record(page_id, url, payload, digest, refers_to, package.n), digest)
                if package.at >= most:
                    done.append(package.close())
                    package = None
        if package is not None:
            done.append(package.close())
        yield pa.RecordBatch.from_pylist([{"path": p, "records": r} for p, r in done], pa.schema([("path", pa.string()), ("records", pa.int64())]))

    return run


def write_packages(pages: DataFrame, folder: str, least_bytes: int = 0, most: int = 64 << 20) -> DataFrame:
    """Writes the rows (page_id, url, html) of pages into packages of about most bytes below folder; returns (path, records) of each.

    Of equal payloads of at least least_bytes, that with the largest page_id is a response and the others
    revisit it; a row that repeats this page_id is a response too, and a null page_id is the smallest (if it is
    the only one, its rows are all responses). A null html is an empty payload. Each attempt at a task writes
    files of its own, and only those of the one that Spark commits are in the returned table.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    kept = rows.where(F.col("size") >= least_bytes).groupBy("sha", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.hint("merge").join(kept, ["sha", "size"], "left")
    refers_to = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    rows = rows.select("page_id", "url", "html", refers_to.alias("refers_to"))
    return staged(rows.mapInArrow(_write(folder, most), "path string, records long"), "packages")


def located(f) -> list[tuple[int, int]]:
    """(begin, length) in the package of every record that its indexes name, once each and in order."""
    every = members(f)
    archives = {m.name.rpartition("/")[2]: m for m in every if ARCHIVES.search(m.name)}
    starts, found = {name: stored_at(f, m) for name, m in archives.items()}, set()
    for m in every:
        if INDEXES.search(m.name):
            for name, at, n in entries_of(read_range(f, stored_at(f, m), m.size), m.name):
                name = name.rpartition("/")[2] or (next(iter(archives)) if len(archives) == 1 else "")
                if name not in archives:
                    raise ValueError(f"{m.name} names the archive {name!r}, which the package doesn't have")
                found.add((starts[name] + at, n))
    return sorted(found)


def _blocks(most: int):
    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_ranges(path) as f:
                    entries = located(f)
                blocks, used, last = [], most, None
                for at, n in entries:
                    if used + n > most or at - last > most:
                        blocks.append({"path": path, "at": [], "n": []})
                        used = 0
                    blocks[-1]["at"].append(at)
                    blocks[-1]["n"].append(n)
                    used, last = used + n, at + n
                yield pa.RecordBatch.from_pylist(blocks, pa.schema([("path", pa.string()), ("at", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))]))

    return run


def opened(raw: bytes) -> bytes:
    """A record as it is, or out of its gzip member."""
    return zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw


def _read(with_payload: bool):
    def run(batches):
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()][: 6 + with_payload]
        for batch in batches:
            for path, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                with open_ranges(path) as f:
                    block = read_range(f, at[0], at[-1] + n[-1] - at[0])
                rows = []
                for a, size in zip(at, n):
                    fields, payload = parse_record(opened(block[a - at[0] : a - at[0] + size]))
                    kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    length = int(fields.get("payload-length", len(payload)))
                    if kind == "response" and "payload-length" in fields and (digest_of(payload) != digest or len(payload) != length):
                        raise ValueError(f"{path}, {a}: the payload isn't the one that was written")
                    row = (page_of(fields.get("page-id")), fields.get("warc-target-uri"), kind, length, digest, page_of(fields.get("refers-to-page")), payload)
                    rows.append(row[: 6 + with_payload])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"][: 6 + with_payload])

    return run


def read_packages(packages: DataFrame, with_payload: bool = False, most: int = 4 << 20) -> DataFrame:
    """One row per record of the packages whose paths are given: page_id, url, record_type, payload_bytes, payload_digest, refers_to, and payload if asked for.

    Indexes are read first; then ranges of about most bytes, dealt evenly over the tasks, whatever package they
    lie in. Packages of other writers do too: what a record doesn't say (its page, a revisit's) is null, and its
    payload is what follows its head. No packages, or packages without records, give no rows; records that
    repeat are rows each; a null path fails.
    """
    n = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number, as rows this small would be coalesced
    blocks = packages.select("path").repartition(n, "path").mapInArrow(_blocks(most), "path string, at array<long>, n array<long>")
    made = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
    return blocks.repartition(n).mapInArrow(_read(with_payload), made + ", payload binary" * with_payload)


def folder_for(spark: SparkSession) -> str:
    """A new folder for packages, as a whole URI."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark, "warc"))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def op1(spark, sf_dir):
    packages = write_packages(table(spark, sf_dir, "pages"), folder_for(spark))
    return read_packages(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + ((('0x' || substr(x, (1 + 5 * (i // 4))::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM d
"""
